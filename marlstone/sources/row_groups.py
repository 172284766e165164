"""A Python data source over the row groups of Parquet files: partitions, pushed filters, and a stream with offsets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

NAME = "row_groups"
#: Comparisons that are pushed: how a row is compared, and whether a group of values from low to high may hold one.
_PUSHED = {
    EqualTo: (pc.equal, lambda low, high, v: low <= v <= high),
    GreaterThan: (pc.greater, lambda low, high, v: high > v),
    GreaterThanOrEqual: (pc.greater_equal, lambda low, high, v: high >= v),
    LessThan: (pc.less, lambda low, high, v: low < v),
    LessThanOrEqual: (pc.less_equal, lambda low, high, v: low <= v),
}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that the nodes can reach, and the path in it."""
    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The Parquet files of a file or folder by name."""
    system, inside = _open(path)
    if system.get_file_info(inside).type == fs.FileType.File:
        return [path]
    found = [i.path for i in system.get_file_info(fs.FileSelector(inside, recursive=True)) if i.type == fs.FileType.File and i.base_name.endswith(".parquet")]
    return [path.rstrip("/") + f[len(inside.rstrip("/")) :] for f in sorted(found)]


def _parquet(path: str) -> pq.ParquetFile:
    system, inside = _open(path)
    return pq.ParquetFile(system.open_input_file(inside))


#: Partitions up to which each has one group; beyond, a partition has groups of one file of about so many rows.
PARTITIONS, ROWS = 64, 50_000


@dataclass
class Group(InputPartition):
    """A group of a file, and others of it that are read with it."""

    path: str
    group: int
    others: tuple[int, ...] = ()


def _rows(part: Group | None, schema: pa.Schema, filters: list[Filter]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in batches, the columns of the schema only, without rows that a filter rules out; where there is no group at all Spark asks for none."""
    if part is None:
        return
    for batch in _parquet(part.path).iter_batches(row_groups=[part.group, *part.others], columns=schema.names, batch_size=10_000):
        table = pa.Table.from_batches([batch])
        for f in filters:
            table = table.filter(_PUSHED[type(f)][0](table[f.attribute[0]], pa.scalar(f.value).cast(table.schema.field(f.attribute[0]).type)))
        yield from table.select(schema.names).cast(schema).to_batches()


class RowGroupReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, to_arrow_schema(schema)
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        """Comparisons of a top-level number or string column with a value are done here, all others by Spark."""
        for f in filters:
            plain = type(f) in _PUSHED and len(f.attribute) == 1 and f.attribute[0] in self.schema.names and isinstance(f.value, (int, float, str))
            if plain:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Group]:
        """The groups but for those whose statistics rule out all rows: one each, or where they are many several of a file, as a task costs more than a small group."""
        files, n, rows = [], 0, 0
        for path in _files(self.path):
            data, there = _parquet(path).metadata, []
            for k in range(data.num_row_groups):
                group = data.row_group(k)
                columns = {group.column(c).path_in_schema: group.column(c).statistics for c in range(data.num_columns)} if self.filters else {}
                if all(self._may_hold(columns.get(f.attribute[0]), f) for f in self.filters):
                    there.append(k)
                    rows += group.num_rows
            files.append((path, there))
            n += len(there)
        each = max(1, min(n // PARTITIONS, ROWS * n // max(rows, 1)))
        return [Group(path, there[i], tuple(there[i + 1 : i + each])) for path, there in files for i in range(0, len(there), each)]

    @staticmethod
    def _may_hold(statistics, f: Filter) -> bool:
        if statistics is None or not statistics.has_min_max or not isinstance(statistics.min, type(f.value)):
            return True
        return _PUSHED[type(f)][1](statistics.min, statistics.max, f.value)

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        return _rows(partition, self.schema, self.filters)


class RowGroupStreamReader(DataSourceStreamReader):
    """Offsets are how many groups were taken, in order of files by name; files must only be added after all others."""

    def __init__(self, path: str, schema: StructType, groups: int):
        self.path, self.schema, self.groups = path, to_arrow_schema(schema), groups
        self.given = None

    def _all(self) -> list[Group]:
        return [Group(p, k) for p in _files(self.path) for k in range(_parquet(p).metadata.num_row_groups)]

    def initialOffset(self) -> dict:
        return {"groups": 0}

    def latestOffset(self) -> dict:
        """``groups`` more than were given last, or all that there are."""
        there = len(self._all())
        self.given = there if self.groups <= 0 or self.given is None else min(there, self.given + self.groups)
        return {"groups": self.given}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        return self._all()[start["groups"] : end["groups"]]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        return _rows(partition, self.schema, [])

    def commit(self, end: dict) -> None:
        pass


class RowGroups(DataSource):
    """``spark.read.format("row_groups").load(path)``, or ``readStream``: a partition is a row group, of a batch over many several."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return from_arrow_schema(_parquet(_files(self.options["path"])[0]).schema_arrow, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> DataSourceReader:
        return RowGroupReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RowGroupStreamReader(self.options["path"], schema, int(self.options.get("groups", "0")))


def register(spark: SparkSession) -> None:
    """Make the source known to the session; filters are pushed into it while the setting holds."""
    spark.dataSource.register(RowGroups)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
