"""Files in the shared folder, opened by URI from any executor."""

from __future__ import annotations

from pyarrow import fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; a bare path is local."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class Publishing:
    """A file that appears under its name only when whole, so that a retried task repeats it safely."""

    def __init__(self, uri: str, attempt: int):
        self.fs, self.path = locate(uri)
        self.temp = f"{self.path}.attempt{attempt}"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def publish(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)
