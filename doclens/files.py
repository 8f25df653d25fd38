"""Files that tasks write into a shared folder, and ranges that tasks read from them."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path in it; works for file, hdfs, s3 and gs addresses."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def make_folder(uri: str) -> None:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)


class Whole:
    """A file that appears under its name only when it is complete.

    It is written under another name and moved at the end, so an attempt that dies leaves nothing under the name.
    """

    def __init__(self, uri: str, name: str):
        self.system, folder = opened(uri)
        self.path, self.draft = f"{folder}/{name}", f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.draft, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.draft, self.path)


def read_range(system: fs.FileSystem, path: str, start: int, length: int) -> bytes:
    with system.open_input_file(path) as file:
        file.seek(start)
        return file.read(length)
