"""Files of our own formats in the shared folder: written whole under another name, then moved, so that a task that
is run again, or twice at once, leaves one complete file. Any store that pyarrow has a file system for will do."""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def put(path: str, data: bytes) -> None:
    system, name = at(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, name)


def whole(path: str) -> bytes:
    system, name = at(path)
    with system.open_input_stream(name) as f:
        return f.read()


class Ranges:
    """Reads ranges of one file."""

    def __init__(self, path: str):
        system, name = at(path)
        self.file = system.open_input_file(name)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()
