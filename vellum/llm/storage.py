"""Files in shared storage, opened from tasks through Arrow's file systems (local, HDFS, S3, GCS)."""

from __future__ import annotations

from pyarrow import fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``uri`` and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Window:
    """Sequential reads at any offset of a file, holding one block of it at a time."""

    def __init__(self, file, size: int, block: int = 1 << 20):
        self.file, self.size, self.block, self.base, self.data = file, size, block, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``offset``: fewer at the end of the held block, none at the end of the file."""
        if not self.base <= offset < self.base + len(self.data):
            if offset >= self.size:
                return b""
            self.base, self.data = offset, self.file.read_at(min(self.block, self.size - offset), offset)
        return self.data[offset - self.base : offset - self.base + n]
