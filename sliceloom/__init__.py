"""sliceloom: analytics over sliced load-run measurements, written for Spark."""
