"""A catalogue kept as pages of JSON features, as a Spark data source that prunes pages by pushed filters.

A page is a feature collection, as catalogue services return them. Writing makes pages of ``page_size`` features a task
with a list of their extremes and, when all tasks are done, one index file that names these lists; pages of failed or
repeated tasks are in no index and are never read. Reading deals the pages that the pushed filters leave over partitions and
applies the filters to their rows too, so a search by time, box, cloud or tile opens the pages that may hold an answer and no others.

    register(spark)
    df.write.format("catalogue_pages").option("page_size", 500).mode("append").save(path)
    spark.read.format("catalogue_pages").load(path).filter("cloud < 60 AND tile = 'T1'")

Missing values are NULL and pass no filter but IS NULL, which isn't pushed. Paths are those of pyarrow's file systems.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = "scene_id string, ts timestamp, cloud double, tile string, west double, south double, east double, north double"
ARROW = pa.schema([("scene_id", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("cloud", pa.float64()), ("tile", pa.string()), *((c, pa.float64()) for c in ("west", "south", "east", "north"))])
COMPARED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CataloguePages)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def features(batch: pa.Table) -> list[dict]:
    out = []
    for r in batch.to_pylist():
        box = [r[c] for c in ("west", "south", "east", "north")]
        known = {"datetime": r["ts"] and r["ts"].astimezone(dt.UTC).isoformat(), "eo:cloud_cover": r["cloud"], "grid:code": r["tile"]}
        out.append({"type": "Feature", "id": r["scene_id"], "bbox": None if None in box else box, "properties": {k: v for k, v in known.items() if v is not None}})
    return out


def rows_of(page: dict) -> pa.Table:
    """A page's features as a table. What a feature lacks is NULL."""
    columns: dict[str, list] = {n: [] for n in ARROW.names}
    for f in page.get("features", ()):
        props, box = f.get("properties") or {}, f.get("bbox") or (None,) * 4
        when = props.get("datetime")
        values = (f.get("id"), dt.datetime.fromisoformat(when) if when else None, props.get("eo:cloud_cover"), props.get("grid:code"), *box)
        for n, v in zip(ARROW.names, values, strict=True):
            columns[n].append(v)
    return pa.table(columns, schema=ARROW)


def extremes(table: pa.Table) -> dict[str, list | None]:
    """Smallest and largest known value per column, None where all are missing."""
    out = {}
    for name in ARROW.names:
        m = pc.min_max(table[name]).as_py()
        plain = [v.isoformat() if isinstance(v, dt.datetime) else v for v in (m["min"], m["max"])]
        out[name] = None if m["min"] is None else plain
    return out


def literal(column: str, value) -> object:
    if column == "ts" and isinstance(value, dt.datetime):
        return value if value.tzinfo else value.astimezone()  # Spark hands a moment over in the worker's local time
    return value


@dataclass(frozen=True)
class Test:
    """A pushed filter: a column, a comparison and its values."""

    column: str
    kind: type
    values: tuple

    @classmethod
    def of(cls, f: Filter) -> Test | None:
        if len(f.attribute) != 1 or f.attribute[0] not in ARROW.names or type(f) not in (*COMPARED, In, IsNotNull):
            return None
        values = tuple(f.value) if isinstance(f, In) else () if isinstance(f, IsNotNull) else (f.value,)
        return cls(f.attribute[0], type(f), tuple(literal(f.attribute[0], v) for v in values if v is not None))

    def page_may_hold(self, known: list | None) -> bool:
        if known is None:
            return False
        lo, hi = (dt.datetime.fromisoformat(v) if self.column == "ts" else v for v in known)
        if self.kind is IsNotNull:
            return True
        if self.kind in (EqualTo, In):
            return any(lo <= v <= hi for v in self.values)
        v = self.values[0]
        return {LessThan: lo < v, LessThanOrEqual: lo <= v, GreaterThan: hi > v, GreaterThanOrEqual: hi >= v}[self.kind]

    def rows(self, table: pa.Table) -> pa.ChunkedArray:
        column = table[self.column]
        if self.kind is IsNotNull:
            return pc.is_valid(column)
        if self.kind is In:
            return pc.and_(pc.is_in(column, pa.array(self.values, column.type)), pc.is_valid(column))
        return pc.fill_null(COMPARED[self.kind](column, pa.scalar(self.values[0], column.type)), False)


SPREAD, TASK_ROWS = 200, 50_000  # up to so many partitions hold one page each; above, a partition holds pages of about so many rows at most


@dataclass
class Pages(InputPartition):
    files: list[str]


def packed(entries: list[tuple[str, int]]) -> list[Pages]:
    """Pages (file, rows) dealt in order to partitions of about equal rows, so that their number follows the rows and not the pages."""
    parts = min(len(entries), max(SPREAD, -(-sum(n for _, n in entries) // TASK_ROWS)))
    cuts = [k * len(entries) // parts for k in range(parts + 1)] if parts else [0]
    return [Pages([f for f, _ in entries[a:b]]) for a, b in zip(cuts, cuts[1:])] or [Pages([])]


class PageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path.rstrip("/"), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            test = Test.of(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def index(self) -> Iterator[dict]:
        """The entries of all indexes; one index part, which is one task's, is held at a time."""
        files, at = opened(self.path)
        found = files.get_file_info(fs.FileSelector(at, recursive=False, allow_not_found=True))
        for n in sorted(f.path for f in found if f.base_name.startswith("_index-")):
            for entry in json.loads(files.open_input_stream(n).readall()):
                yield from json.loads(files.open_input_stream(f"{at}/{entry['part']}").readall()) if "part" in entry else (entry,)

    def partitions(self) -> Sequence[InputPartition]:
        return packed([(e["file"], e["rows"]) for e in self.index() if all(t.page_may_hold(e["known"][t.column]) for t in self.tests)])

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        files, at = opened(self.path)
        for name in partition.files:
            table = rows_of(json.loads(files.open_input_stream(f"{at}/{name}").readall()))
            for t in self.tests:
                table = table.filter(t.rows(table))
            yield from table.combine_chunks().to_batches()


@dataclass
class Written(WriterCommitMessage):
    part: str
    files: list[str]


class PageWriter(DataSourceArrowWriter):
    def __init__(self, path: str, page_size: int, overwrite: bool):
        self.path, self.page_size, self.overwrite = path.rstrip("/"), page_size, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, at = opened(self.path)
        files.create_dir(at, recursive=True)
        pages, held, rows = [], [], 0

        def flush(table: pa.Table) -> None:
            name = f"page-{uuid.uuid4().hex}.json"
            with files.open_output_stream(f"{at}/{name}") as out:
                out.write(json.dumps({"type": "FeatureCollection", "features": features(table), "numberReturned": len(table)}).encode())
            pages.append({"file": name, "rows": len(table), "known": extremes(table)})

        for batch in iterator:
            held.append(pa.Table.from_batches([batch]).select(ARROW.names).cast(ARROW))
            rows += batch.num_rows
            while rows >= self.page_size:
                table = pa.concat_tables(held)
                flush(table.slice(0, self.page_size))
                held, rows = [table.slice(self.page_size)], rows - self.page_size
        if rows:
            flush(pa.concat_tables(held))
        if not pages:
            return Written("", [])
        part = f"part-{uuid.uuid4().hex}.json"  # a task lists its own pages, so the driver holds none of the lists
        with files.open_output_stream(f"{at}/{part}") as out:
            out.write(json.dumps(pages).encode())
        return Written(part, [p["file"] for p in pages])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """One new index makes all pages visible at once; overwriting drops the indexes that were there."""
        files, at = opened(self.path)
        files.create_dir(at, recursive=True)
        old = [f.path for f in files.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("_index-")] if self.overwrite else []
        with files.open_output_stream(f"{at}/_index-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([{"part": m.part} for m in messages if m and m.part]).encode())
        for name in old:
            files.delete_file(name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, at = opened(self.path)
        for name in (n for m in messages if m and m.part for n in (m.part, *m.files)):
            files.delete_file(f"{at}/{name}")


class CataloguePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogue_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"], int(self.options.get("page_size", 500)), overwrite)
