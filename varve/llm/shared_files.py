"""Files on storage that every executor reaches, opened through pyarrow's filesystem layer."""

from __future__ import annotations

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The filesystem and the path in it for a Hadoop-style URI or a plain path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only when complete, so a retried task replaces it whole."""

    def __init__(self, uri: str, attempt: int):
        self.files, self.path = filesystem(uri)
        self.part = f"{self.path}.{attempt}.part"
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream = self.files.open_output_stream(self.part)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.stream.close()
        self.files.move(self.part, self.path)
