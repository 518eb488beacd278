"""A connector that fetches a dated table in windows of days, newest first.

The source is opened once a window, as an interface that answers by date range
would be: one partition of the scan is one window. Bounds on `day` are handed to
the source before windows are laid out, so windows outside them are never opened;
Spark still applies every filter to the rows that come.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema

DAY = "day"
_ONE = datetime.timedelta(days=1)
#: Rows that are decoded at once, and bytes of a column that are read at once.
BATCH_ROWS, READ_BYTES = 32_768, 1 << 20


def _dataset(path: str) -> ds.Dataset:
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return ds.dataset(place, filesystem=system, format="parquet")


@dataclass
class Window(InputPartition):
    """Days from `first` to `last`, both inclusive; rows without a date are a window of their own."""

    first: datetime.date | None
    last: datetime.date | None


class DatedTable(DataSource):
    """Options: path (URI of Parquet), date (its column), days (length of a window, 30), newest (the day to begin at; else the latest there is)."""

    @classmethod
    def name(cls) -> str:
        return "dated_windows"

    def schema(self) -> T.StructType:
        found = from_arrow_schema(_dataset(self.options["path"]).schema, prefer_timestamp_ntz=True)
        return T.StructType([*found.fields, T.StructField(DAY, T.DateType())])

    def reader(self, schema: T.StructType) -> DatedReader:
        return DatedReader(dict(self.options))


class DatedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.date, self.days = options["path"], options["date"], int(options.get("days", 30))
        if self.days < 1:
            raise ValueError("a window has at least one day")
        self.newest = datetime.date.fromisoformat(options["newest"]) if "newest" in options else None
        self.low: datetime.date | None = None
        self.high: datetime.date | None = None
        self.bounded = False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the day narrow the windows; every filter is given back, for Spark to apply."""
        for f in filters:
            if getattr(f, "attribute", None) == (DAY,) and isinstance(getattr(f, "value", None), datetime.date):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    low = f.value + _ONE if isinstance(f, GreaterThan) else f.value
                    self.low, self.bounded = max(low, self.low or low), True
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    high = f.value - _ONE if isinstance(f, LessThan) else f.value
                    self.high, self.bounded = min(high, self.high or high), True
            yield f

    def span(self) -> tuple[datetime.date, datetime.date] | None:
        """First and last day there is, from the statistics of the files; None if there are none."""
        low = high = None
        for fragment in _dataset(self.path).get_fragments():
            for group in fragment.row_groups:
                values = (group.statistics or {}).get(self.date)
                if values is not None and values["min"] is not None:
                    first, last = (v.date() if isinstance(v, datetime.datetime) else v for v in (values["min"], values["max"]))
                    low, high = min(first, low or first), max(last, high or last)
        return None if low is None else (low, high)

    def partitions(self) -> list[Window]:
        out, found = [], self.span()
        if found is not None:
            low, high = found
            end = min(high, self.newest or high)
            # windows are laid out from the newest day, whatever is asked for, so that a day is always in the same one
            while end >= low:
                begin = end - datetime.timedelta(days=self.days - 1)
                if (self.low is None or end >= self.low) and (self.high is None or begin <= self.high):
                    out.append(Window(max(begin, low), end))
                end = begin - _ONE
        if not self.bounded:
            out.append(Window(None, None))
        return out

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        data = _dataset(self.path)
        kind = data.schema.field(self.date).type
        edges = None if partition.first is None else [pa.scalar(datetime.datetime.combine(d, datetime.time())).cast(kind) for d in (partition.first, partition.last + _ONE)]
        wanted = ds.field(self.date).is_null() if edges is None else (ds.field(self.date) >= edges[0]) & (ds.field(self.date) < edges[1])
        for fragment in data.get_fragments():
            # only row groups that may hold the window; of these a batch at a time, without reading ahead
            groups = [g.id for part in fragment.split_by_row_group(wanted) for g in part.row_groups]
            if not groups:
                continue
            with fragment.filesystem.open_input_file(fragment.path) as source:
                file = pq.ParquetFile(source, pre_buffer=False, buffer_size=READ_BYTES)
                for batch in file.iter_batches(batch_size=BATCH_ROWS, row_groups=groups, use_threads=False):
                    when = batch.column(batch.schema.get_field_index(self.date)).cast(kind) if self.date in batch.schema.names else pa.nulls(len(batch), kind)
                    rows = batch.filter(pc.is_null(when) if edges is None else pc.and_(pc.greater_equal(when, edges[0]), pc.less(when, edges[1])))
                    if len(rows):
                        held = [rows.column(f.name).cast(f.type) if f.name in rows.schema.names else pa.nulls(len(rows), f.type) for f in data.schema]
                        day = held[data.schema.get_field_index(self.date)]
                        yield pa.RecordBatch.from_arrays([*held, pc.cast(day, pa.date32(), safe=False)], names=[*data.schema.names, DAY])


def read_dated(spark: SparkSession, path: str, date: str, days: int = 30, newest: str | None = None, where: Column | None = None) -> DataFrame:
    """The rows of the table that `where` accepts, with the column `day`, fetched in windows; bounds on `day` in `where` decide which.

    Spark keeps the filters that it has handed to a Python source with the loaded
    table, and a second query over it would get the windows of the first. So each
    call loads the table anew, and row numbers, which no filter may pass, keep what
    is asked of the result later from reaching the source.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DatedTable)
    reader = spark.read.format(DatedTable.name()).option("path", path).option("date", date).option("days", days)
    loaded = (reader.option("newest", newest) if newest else reader).load()
    found = loaded if where is None else loaded.where(where)
    return found.withColumn("_row", F.monotonically_increasing_id()).where("_row >= 0").drop("_row")
