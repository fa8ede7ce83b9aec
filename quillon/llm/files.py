"""Binary files in the shared folder, written and read by tasks with pyarrow's file systems (file, hdfs, s3, gs, abfs).

A task writes under a name that no other attempt uses and returns the name as a row, so that only files of successful
attempts are ever read; files of lost attempts are never referred to.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def fresh(folder: str, name: str) -> str:
    return f"{folder}/{name}-{uuid.uuid4().hex}"


class Writer:
    """An output stream that counts its bytes."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.stream, self.at = system.open_output_stream(path, compression=None), 0

    def write(self, data: bytes) -> int:
        """Returns where the data begin."""
        begin = self.at
        self.stream.write(data)
        self.at += len(data)
        return begin

    def close(self) -> None:
        self.stream.close()


class Reader:
    """Range reads."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.file = system.open_input_file(path)

    def size(self) -> int:
        return self.file.size()

    def read(self, begin: int, length: int) -> bytes:
        return self.file.read_at(length, begin)

    def close(self) -> None:
        self.file.close()
