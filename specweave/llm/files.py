"""Files of our own formats in the shared folder, written and read by executors."""

from __future__ import annotations

import uuid


def _system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class NewFile:
    """A file that appears under its name only when it is whole: a lost or repeated task leaves
    no half file, and a repeated one writes the same bytes again."""

    def __init__(self, path: str):
        self.system, self.path = _system(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream = self.system.open_output_stream(self.part, compression=None)
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None:
            self.system.move(self.part, self.path)
        else:
            self.system.delete_file(self.part)


def open_stream(path: str):
    system, at = _system(path)
    return system.open_input_stream(at, compression=None)


def open_random(path: str):
    system, at = _system(path)
    return system.open_input_file(at)
