"""A source that is read page by page, each page telling the cursor of the next: `spark.read.format("litgrid_cursor")` and readStream.

The pages lie in Parquet files (a service's export); a file is cut to shards of consecutive rows, and every shard is a chain of
pages of its own, so a batch reads as many chains at a time as there are tasks, a page in memory each. A chain ends when a
page gives no cursor or the one it was asked with. Filters that Spark pushes are applied to each page before its rows leave
the reader; where a file's statistics rule out all rows of a row group, its pages are skipped unread.

As a stream the offset is the cursor of every file: a batch takes the pages that have come since, and a query that is started
again goes on at the cursors in its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from litgrid.session import ready_workers

NAME = "litgrid_cursor"
START = "*"
COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


@dataclass
class Shard(InputPartition):
    """Rows first to end of a file: a chain of pages."""

    file: str
    first: int
    end: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """The Parquet files of a path, in order."""
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    root = path.rstrip("/")
    return sorted(root + x.path[len(at.rstrip("/")) :] for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


def shards(path: str, count: int) -> list[Shard]:
    out, names = [], files(path)
    each = max(1, count // max(1, len(names)))
    for name in names:
        system, at = _open(name)
        with system.open_input_file(at) as f:
            n = pq.ParquetFile(f).metadata.num_rows
        cuts = [n * k // each for k in range(each + 1)]
        out += [Shard(name, a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    return out


class Pages:
    """The service: pages of a shard by cursor. A cursor is the place of its first row; the last page's answer has none."""

    def __init__(self, shard: Shard, size: int) -> None:
        self.shard, self.size = shard, size
        system, at = _open(shard.file)
        self.file = pq.ParquetFile(system.open_input_file(at))
        self.starts = [0]
        for g in range(self.file.num_row_groups):
            self.starts.append(self.starts[-1] + self.file.metadata.row_group(g).num_rows)
        self.held: tuple[int, pa.Table] | None = None
        self.read_groups = 0

    def place(self, cursor: str) -> int:
        return self.shard.first if cursor == START else int(cursor)

    def next(self, cursor: str) -> str | None:
        """The cursor after a page, without reading it."""
        end = self.place(cursor) + self.size
        return str(end) if end < self.shard.end else None

    def fetch(self, cursor: str, columns: list[str], ruled_out=None) -> tuple[list[pa.Table], str | None]:
        """The page's rows, and the next cursor. ruled_out: of a row group's statistics, whether no row of it is wanted."""
        first = self.place(cursor)
        end, out = min(first + self.size, self.shard.end), []
        for g in range(self.file.num_row_groups):
            a, b = max(first, self.starts[g]), min(end, self.starts[g + 1])
            if a < b and not (ruled_out and ruled_out(self.file.metadata.row_group(g))):
                if self.held is None or self.held[0] != g:
                    self.held = (g, self.file.read_row_group(g, columns=columns))
                    self.read_groups += 1
                out.append(self.held[1].slice(a - self.starts[g], b - a))
        return out, self.next(cursor)


def _asks(filters: list[Filter], page: pa.Table) -> pa.Table:
    for f in filters:
        column, kind = page[f.attribute[0]], page.schema.field(f.attribute[0]).type
        if isinstance(f, IsNotNull):
            mask = pc.is_valid(column)
        elif isinstance(f, In):
            mask = pc.is_in(column, value_set=pa.array([v for v in f.value if v is not None], kind))
        else:
            mask = COMPARE[type(f)](column, pa.scalar(f.value, kind))
        page = page.filter(mask)
    return page


def _ruled_out(filters: list[Filter]):
    """Whether a row group's least and largest values leave no row for one of the filters."""

    def test(group) -> bool:
        by_name = {group.column(k).path_in_schema: group.column(k).statistics for k in range(group.num_columns)}
        for f in filters:
            s = by_name.get(f.attribute[0])
            if s is None or not s.has_min_max or isinstance(f, IsNotNull):
                continue
            least, most, values = s.min, s.max, [v for v in f.value if v is not None] if isinstance(f, In) else [f.value]
            try:
                inside = {EqualTo: lambda v: least <= v <= most, In: lambda v: least <= v <= most, GreaterThan: lambda v: most > v, GreaterThanOrEqual: lambda v: most >= v, LessThan: lambda v: least < v, LessThanOrEqual: lambda v: least <= v}[type(f)]  # noqa: B023
                if not any(map(inside, values)):
                    return True
            except TypeError:
                continue
        return False

    return test


def _walk(shard: Shard, size: int, schema: pa.Schema, filters: list[Filter]) -> Iterator[pa.RecordBatch]:
    """The rows of a chain's pages, until one gives no further cursor or its own."""
    pages, cursor = Pages(shard, size), START
    needed = list(schema.names)
    ruled_out = _ruled_out(filters)
    while cursor is not None:
        parts, after = pages.fetch(cursor, needed, ruled_out)
        for part in parts:
            for batch in _asks(filters, part).cast(schema).to_batches():
                if batch.num_rows:
                    yield batch
        if after == cursor:
            break
        cursor = after


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.arrow, self.options, self.filters = to_arrow_schema(schema), options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in (*COMPARE, In, IsNotNull) and len(f.attribute) == 1 and (isinstance(f, IsNotNull) or f.value is not None):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Shard]:
        return shards(self.options["path"], int(self.options.get("shards", "8")))

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        yield from _walk(partition, int(self.options.get("pageSize", "1000")), self.arrow, self.filters)


class _StreamReader(DataSourceStreamReader):
    """Offsets: of each file the cursor at which its chain of pages ends just now; files and pages that come later go on from there."""

    def __init__(self, schema: StructType, options: dict) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.arrow, self.options = to_arrow_schema(schema), options
        self.size = int(options.get("pageSize", "1000"))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {s.file: str(s.end) for s in shards(self.options["path"], 1)}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        """Each file's pages between the two cursors, dealt to a few chains of whole pages."""
        out, many = [], int(self.options.get("shards", "8"))
        for file, until in end.items():
            a, b = int(start.get(file, 0)), int(until)
            each = -(-max(1, -(-(b - a) // self.size)) // many) * self.size
            out += [Shard(file, k, min(k + each, b)) for k in range(a, b, each)]
        return out

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        yield from _walk(partition, self.size, self.arrow, [])

    def commit(self, end: dict) -> None:
        """Nothing is kept here: the cursors are in the query's checkpoint."""


class CursorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        system, at = _open(files(self.options["path"])[0])
        with system.open_input_file(at) as f:
            return from_arrow_schema(pq.ParquetFile(f).schema_arrow.remove_metadata())

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark push filters to it."""
    ready_workers(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CursorSource)

