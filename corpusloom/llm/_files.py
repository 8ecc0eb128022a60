"""Byte files in the shared folder, read and written by tasks through pyarrow file systems."""

from __future__ import annotations

from pyarrow import fs
from pyspark import TaskContext


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a URI or a plain absolute path."""
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


class open_write:
    """Output stream to ``path``, which appears whole when the stream is closed.

    Bytes go to a name of the task attempt and are moved then, so a second attempt of a task, or one
    that dies half-way, never touches a finished file. The folder is made if needed.
    """

    def __init__(self, path: str):
        self.system, self.path = locate(path)
        context = TaskContext.get()
        self.part = f"{self.path}.attempt-{context.taskAttemptId() if context else 0}"
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream = self.system.open_output_stream(self.part, compression=None)
        self.write = self.stream.write

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.part, self.path)

    def __enter__(self) -> open_write:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is None:
            self.close()
        else:
            self.stream.close()
            self.system.delete_file(self.part)


def open_read(path: str):
    """Seekable input file."""
    system, inner = locate(path)
    return system.open_input_file(inner)
