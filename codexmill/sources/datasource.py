"""Directory of books as a Python data source: ``spark.read.format("codexmill_books").load(directory)`` gives the entries.

One partition a file, so that a task opens one archive. The directory may lie in any file system that the workers reach by
its address.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codexmill.sources.books import ENTRIES, archive_entries


def _open(address: str):
    """File system and path of an address; a plain path is local."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(address) if "://" in address else (pafs.LocalFileSystem(), address)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, directory: str, suffix: str):
        self.directory, self.suffix = directory, suffix.lower()

    def partitions(self) -> list[_File]:
        import pyarrow.fs as pafs

        fs, root = _open(self.directory)
        files = fs.get_file_info(pafs.FileSelector(root, recursive=False))
        return [_File(p) for p in sorted(f.path for f in files if f.is_file and f.base_name.lower().endswith(self.suffix))]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition is None:
            return
        fs, _ = _open(self.directory)
        with fs.open_input_file(partition.path) as f:
            data = f.read()
        pub = partition.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        for e in archive_entries(data):
            yield (pub, *(e[c.split()[0]] for c in ENTRIES.split(", ")[1:]))


class BookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codexmill_books"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("suffix", ".epub"))
