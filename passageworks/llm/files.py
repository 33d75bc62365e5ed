"""Files in the shared folder, written and read by tasks.

The shared folder is a URI that `pyarrow.fs` opens (file:, hdfs:, s3:, gs:), so tasks
read byte ranges without passing whole files through Spark.
"""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of an absolute path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Ranges:
    """Random access to one file: `size` and `read(start, length)`."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.size = system.get_file_info(path).size
        self._file = system.open_input_file(path)

    def read(self, start: int, length: int) -> bytes:
        data = self._file.read_at(length, start)
        if len(data) != length:
            raise ValueError(f"{length} bytes wanted at {start}, {len(data)} there")
        return data

    def close(self) -> None:
        self._file.close()
