"""Part of sliceloom."""
