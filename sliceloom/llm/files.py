"""Files in the shared folder, on any file system that pyarrow or Spark opens; whole or not at all."""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_file(uri: str, data: bytes) -> None:
    """Write under a name of its own, then rename: a task that dies or runs twice leaves one whole file."""
    system, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, path)


def read_range(uri: str, begin: int, length: int) -> bytes:
    system, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))
    with system.open_input_file(path) as f:
        return f.read_at(length, begin)
