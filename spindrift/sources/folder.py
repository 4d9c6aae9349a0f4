"""A data source of Python: documents below a folder, each with the metadata file of its stem, in batches and as they arrive."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Fixed: endings that are read as documents, and those of metadata, the first of which goes before the second.
ENDINGS = (".pdf", ".html", ".htm", ".md", ".markdown", ".txt")
SIDES = (".yaml", ".yml")
#: Bytes of files in a partition, about; a larger file is one of its own.
PART_BYTES = 64 << 20


def _system(path: str):
    """(file system, root) of a folder: any that Arrow knows by its URI, or a local path."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), os.path.abspath(path))


class Part(InputPartition):
    def __init__(self, files: list[tuple[str, str | None]]):
        super().__init__(None)
        self.files = files


class _Folder:
    """Files below a folder in the order of their paths; a folder that is not there has none."""

    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("partbytes", PART_BYTES))

    def listed(self) -> list[tuple[tuple[int, str], int, str | None]]:
        """((time, path), bytes, metadata file) of every document."""
        from pyarrow.fs import FileSelector, FileType

        fs, root = _system(self.path)
        files = sorted((f for f in fs.get_file_info(FileSelector(root, recursive=True, allow_not_found=True)) if f.type == FileType.File), key=lambda f: f.path)
        there = {f.path for f in files}
        out = []
        for f in files:
            stem, ending = os.path.splitext(f.path)
            if ending.lower() in ENDINGS:
                out.append(((f.mtime_ns or 0, f.path), f.size or 0, next((stem + s for s in SIDES if stem + s in there), None)))
        return out

    def parts(self, files) -> list[Part]:
        out, held, size = [], [], 0
        for (_, path), n, side in files:
            if held and size + n > self.bytes:
                out.append(Part(held))
                held, size = [], 0
            held.append((path, side))
            size += n
        return out + [Part(held)] if held else out

    def read(self, partition: Part | None) -> Iterator[tuple]:
        """A row a document; one that cannot be read is a row with an error."""
        fs, _ = _system(self.path)

        def content(path):
            with fs.open_input_stream(path) as stream:
                return stream.read()

        for path, side in partition.files if partition is not None else []:  # None stands for an empty list of partitions
            try:
                yield path, os.path.splitext(path)[1].lower()[1:], content(path), content(side) if side else None, None
            except OSError as e:
                yield path, os.path.splitext(path)[1].lower()[1:], None, None, f"{type(e).__name__}: {e}"


class _Reader(_Folder, DataSourceReader):
    def partitions(self):
        return self.parts(self.listed())


class _Arrivals(_Folder, DataSourceStreamReader):
    """Offsets are the time and path of the latest file: what has a later one has arrived since."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        time, path = max((at for at, _, _ in self.listed()), default=(-1, ""))
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict):
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return self.parts([f for f in self.listed() if low < f[0] <= high])

    def commit(self, end: dict) -> None:
        pass


class DocumentFolder(DataSource):
    """`spark.read.format("document_folder").load(path)`, or readStream; option partBytes."""

    @classmethod
    def name(cls) -> str:
        return "document_folder"

    def schema(self) -> str:
        return "path string, ending string, content binary, metadata binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Arrivals(self.options)
