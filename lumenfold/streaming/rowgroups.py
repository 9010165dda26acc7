"""A stream over Parquet files whose cursor is (file, row group, row).

The source gives out slices, places in files, and no rows: the driver reads footers alone, and tasks
read the slices' rows. A batch has a bounded number of rows, so it may end within a row group; the
checkpoint keeps the cursor, and a restart goes on at the next row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..shipping import ship

#: Rows of a batch and of a slice at most, unless the options say otherwise.
BATCH, SLICE = 1_000_000, 100_000


def _files(path: str) -> list[str]:
    """Parquet files of a folder, or the file itself, in order of name, on any file system that pyarrow opens."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    names = [f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet") and not f.base_name.startswith(("_", "."))]
    prefix = path[: path.index(root)] if root in path else ""
    return [prefix + n for n in sorted(names)]


def _open(path: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    if ":" in path.split("/")[0]:
        system, name = fs.FileSystem.from_uri(path)
        return pq.ParquetFile(system.open_input_file(name))
    return pq.ParquetFile(path)


class _Cursor(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.batch, self.slice = int(options.get("batch", BATCH)), int(options.get("slice", SLICE))
        self.sizes: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"file": "", "group": 0, "row": 0}

    def _groups(self, name: str) -> list[int]:
        if name not in self.sizes:
            with _open(name) as f:
                self.sizes[name] = [f.metadata.row_group(i).num_rows for i in range(f.metadata.num_row_groups)]
        return self.sizes[name]

    def _slices(self, start: dict) -> Iterator[tuple[tuple, dict]]:
        """(slice, cursor behind it) from a cursor on."""
        for name in _files(self.path):
            if name < start["file"]:
                continue
            for g, n in enumerate(self._groups(name)):
                row = 0
                if name == start["file"]:
                    if g < start["group"]:
                        continue
                    row = start["row"] if g == start["group"] else 0
                while row < n:
                    last = min(n, row + self.slice)
                    yield (name, g, row, last), {"file": name, "group": g, "row": last}
                    row = last

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        out, left, at = [], self.batch, start
        for (name, g, first, last), _ in self._slices(start):
            last = min(last, first + left)
            if last == first:
                break
            out.append((name, g, first, last))
            left, at = left - (last - first), {"file": name, "group": g, "row": last}
        return iter(out), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        place = lambda o: (o["file"], o["group"], o["row"])
        for (name, g, first, last), behind in self._slices(start):
            if (name, g, first) >= place(end):
                return
            if place(behind) > place(end):
                last = end["row"]
            yield name, g, first, last


class RowGroups(DataSource):
    """format("parquet_row_groups"): slices (src, grp, first, last) of the Parquet files of `path`.

    Options: path, batch (rows of a batch at most), slice (rows of a slice at most). Files are read in
    order of name; one that comes later must have a later name, and files must not change.
    """

    @classmethod
    def name(cls) -> str:
        return "parquet_row_groups"

    def schema(self) -> str:
        return "src string, grp int, first bigint, last bigint"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Cursor(self.options)


def read_slices(slices: DataFrame, schema: StructType) -> DataFrame:
    """The rows of slices, read by the tasks that have them; columns that a file lacks are null."""
    ship(slices.sparkSession)
    names = schema.fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                with _open(s["src"]) as f:
                    there, at = [n for n in names if n in f.schema_arrow.names], 0
                    # a row group is read piece by piece and no further than the slice; without columns there is nothing to read
                    pieces = f.iter_batches(10_000, row_groups=[s["grp"]], columns=there) if there else [None]
                    for piece in pieces:
                        n = piece.num_rows if there else s["last"]
                        first, last = max(s["first"], at), min(s["last"], at + n)
                        if last > first:
                            t = {c: piece.column(c).slice(first - at, last - first) for c in there}
                            columns = [t[c].cast(kinds.field(c).type) if c in t else pa.nulls(last - first, kinds.field(c).type) for c in names]
                            yield from pa.table(columns, schema=kinds).to_batches(max_chunksize=10_000)
                        at += n
                        if at >= s["last"]:
                            break

    return slices.mapInArrow(run, schema)


def row_stream(spark: SparkSession, path: str, schema: StructType, batch: int = BATCH, piece: int = SLICE) -> DataFrame:
    """A stream of the rows of a folder's Parquet files, at most `batch` rows a batch, in slices of at
    most `piece` rows, which tasks share."""
    spark.dataSource.register(RowGroups)
    slices = spark.readStream.format("parquet_row_groups").option("path", path).option("batch", batch).option("slice", piece).load()
    return read_slices(slices.repartition(spark.sparkContext.defaultParallelism), schema)
