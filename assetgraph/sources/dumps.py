"""Dumps of key-value, time-series and document stores, and feeds of events, as data sources for `spark.read.format` and `spark.readStream.format`.

A dump is a folder: `columns.tsv` is the store's list of columns (path, type); `data` holds cells, a line `key TAB path TAB value` each, sorted by key; `blocks`
is a Parquet table that says where each block of whole records lies and its first and last key. A scan has a task for each block; comparisons of the key with
constants go into the scan, where blocks are left out before any is read. A column's name is its path; a cell that doesn't read as its column's type is null.

A feed is a folder of segments that are never changed, named by their first and last number: `00000000000000000001-00000000000000000099.tsv`, with a line
`seq TAB level TAB text` for each event. A stream's offset is the last number that was read.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from assetgraph.scratch import write_new

#: Bytes of a block, but for a record that is larger by itself.
BLOCK_BYTES, BATCH_ROWS = 16 << 20, 4096
#: The key's name and type for each kind of store.
KEYS = {"timeseries": ("time", T.LongType()), "keyvalue": ("key", T.StringType()), "document": ("key", T.LongType())}
TYPES = {"BOOLEAN": T.BooleanType(), "INTEGER": T.IntegerType(), "LONG": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType()}
ARROW = {T.BooleanType(): pa.bool_(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.FloatType(): pa.float32(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}
COMPARED = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_ESCAPES = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}
_PLAIN = {v: k for k, v in _ESCAPES.items()}


def escaped(text: str) -> str:
    return re.sub(r"[\\\t\n\r]", lambda m: _ESCAPES[m[0]], text)


def plain(text: str) -> str:
    return re.sub(r"\\[\\tnr]", lambda m: _PLAIN[m[0]], text) if "\\" in text else text


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it. Spark writes local URIs with one slash."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def _long(text: str) -> int | None:
    return int(text) if re.fullmatch(r"[+-]?[0-9]{1,18}", text) else None


def typed(values: list[str | None], kind: T.DataType) -> pa.Array:
    """Texts as a column; null for what doesn't read as the type."""
    if kind == T.StringType():
        return pa.array(values, pa.string())
    if kind == T.BooleanType():
        return pa.array([{"true": True, "false": False}.get(v.lower()) if v is not None else None for v in values], pa.bool_())
    if kind in (T.LongType(), T.IntegerType()):
        most = 1 << (31 if kind == T.IntegerType() else 63)
        found = [None if v is None else _long(v) for v in values]
        return pa.array([v if v is not None and -most <= v < most else None for v in found], ARROW[kind])

    def number(v: str | None) -> float | None:
        try:
            return None if v is None else float(v)
        except ValueError:
            return None

    return pa.array([number(v) for v in values], ARROW[kind])


def write_dump(spark: SparkSession, cells: DataFrame, columns: list[tuple[str, str]], path: str, block_bytes: int = BLOCK_BYTES) -> None:
    """Writes cells (key long or string, path, value string) as a dump. Cells without key, path or value are left out; of a cell that is there twice, the largest value stays.

    A record lies in one file, since files are ranges of keys. Files of failed tasks are in no block.
    """
    key = cells.schema["key"].dataType
    rows = cells.where("key is not null and path is not null and value is not null").groupBy("key", "path").agg(F.max("value").alias("value"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        name = f"{uuid.uuid4().hex}.tsv"
        out, blocks, begin, at, first, last = None, [], 0, 0, None, None
        for b in batches:
            for k, where, value in zip(*(b.column(n).to_pylist() for n in ("key", "path", "value")), strict=True):
                if out is None:
                    store.create_dir(f"{root}/data", recursive=True)
                    out = store.open_output_stream(f"{root}/data/{name}")
                    first = k
                if k != last and at - begin >= block_bytes:
                    blocks.append((name, begin, at - begin, first, last))
                    begin, first = at, k
                line = f"{escaped(str(k))}\t{escaped(where)}\t{escaped(value)}\n".encode()
                out.write(line)
                at, last = at + len(line), k
        if out is not None:
            out.close()
            blocks.append((name, begin, at - begin, first, last))
        kinds = (pa.string(), pa.int64(), pa.int64(), ARROW[key], ARROW[key])
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in blocks], t) for i, t in enumerate(kinds)], ["file", "offset", "length", "first", "last"])

    kind = key.simpleString()
    rows.mapInArrow(run, f"file string, offset long, length long, first {kind}, last {kind}").write.parquet(f"{path}/blocks")
    write_new(spark, f"{path}/columns.tsv", "".join(f"{escaped(p)}\t{t}\n" for p, t in columns))


@dataclass
class Block(InputPartition):
    file: str
    offset: int
    length: int


class DumpReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema
        self.key, self.kept = schema.fields[0], []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of the key with constants, which the blocks' borders answer in part and each row in full."""
        for f in filters:
            constants = f.value if isinstance(f, In) else (getattr(f, "value", None),)
            if type(f) in (*COMPARED, In) and f.attribute == (self.key.name,) and all(v is not None for v in constants):
                self.kept.append(("in" if isinstance(f, In) else COMPARED[type(f)], f.value))
            else:
                yield f

    def _may_hold(self) -> pds.Expression | None:
        """Of a block's borders: whether it can hold a key that all filters take."""
        first, last, out = pds.field("first"), pds.field("last"), None
        for op, value in self.kept:
            if op == "in":
                tests = [(first <= v) & (last >= v) for v in value]
                one = tests[0]
                for t in tests[1:]:
                    one |= t
            else:
                one = {"==": (first <= value) & (last >= value), ">": last > value, ">=": last >= value, "<": first < value, "<=": first <= value}[op]
            out = one if out is None else out & one
        return out

    def partitions(self) -> list[Block]:
        store, root = opened(self.path)
        table = pds.dataset(f"{root}/blocks", filesystem=store, format="parquet").to_table(["file", "offset", "length"], filter=self._may_hold())
        blocks = [Block(**r) for r in table.to_pylist()]
        return blocks or [Block("", 0, 0)]  # no rows

    def _taken(self, keys: pa.Array) -> pa.Array:
        mask = pc.is_valid(keys)
        for op, value in self.kept:
            if op == "in":
                one = pc.is_in(keys, pa.array(list(value), keys.type))
            else:
                one = {"==": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}[op](keys, pa.scalar(value, keys.type))
            mask = pc.and_(mask, one)
        return mask

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if not block.length:
            return
        store, root = opened(self.path)
        with store.open_input_file(f"{root}/data/{block.file}") as f:
            f.seek(block.offset)
            lines = f.read(block.length).decode().split("\n")[:-1]
        names = [x.name for x in self.schema.fields]
        keys, cells = [], {n: [] for n in names[1:]}
        for line in lines:
            key, where, value = line.split("\t")
            if not keys or key != keys[-1]:
                if len(keys) == BATCH_ROWS:
                    yield self._batch(keys, cells)
                    keys, cells = [], {n: [] for n in names[1:]}
                keys.append(key)
                for column in cells.values():
                    column.append(None)
            if (column := cells.get(plain(where))) is not None:
                column[-1] = plain(value)
        yield self._batch(keys, cells)

    def _batch(self, keys: list[str], cells: dict[str, list]) -> pa.RecordBatch:
        key = typed([plain(k) for k in keys], self.key.dataType)
        arrays = [key, *(typed(cells[f.name], f.dataType) for f in self.schema.fields[1:])]
        return pa.RecordBatch.from_arrays(arrays, self.schema.names).filter(self._taken(key))


class StoreDump(DataSource):
    """Options: path, and kind (timeseries, keyvalue or document)."""

    @classmethod
    def name(cls) -> str:
        return "ag_dump"

    def schema(self) -> T.StructType:
        kind = self.options.get("kind", "")
        if kind not in KEYS:
            raise ValueError(f"kind is one of {', '.join(KEYS)}")
        store, root = opened(self.options["path"])
        with store.open_input_stream(f"{root}/columns.tsv") as f:
            listed = [line.split("\t") for line in f.read().decode().split("\n") if line]
        key, of = KEYS[kind]
        return T.StructType([T.StructField(key, of, False), *(T.StructField(plain(p), TYPES.get(t.upper(), T.StringType())) for p, t in listed)])

    def reader(self, schema: T.StructType) -> DumpReader:
        return DumpReader(self.options["path"], schema)


FEED = "seq long, level string, text string"


def append_feed(events: DataFrame, path: str) -> None:
    """Writes events (seq, level, text) as further segments of a feed, sorted; a segment has its name only when it is complete. The numbers go on after those that are there."""
    rows = events.select("seq", "level", "text").where("seq is not null").repartitionByRange("seq").sortWithinPartitions("seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        store.create_dir(root, recursive=True)
        draft, out, first, last = f"{root}/.{uuid.uuid4().hex}", None, None, None
        for b in batches:
            for seq, level, text in zip(*(b.column(n).to_pylist() for n in ("seq", "level", "text")), strict=True):
                out = out or store.open_output_stream(draft)
                first, last = seq if first is None else first, seq
                out.write(f"{seq}\t{escaped(level or '')}\t{escaped(text or '')}\n".encode())
        if out is not None:
            out.close()
            store.move(draft, f"{root}/{first:020d}-{last:020d}.tsv")
        yield pa.RecordBatch.from_arrays([pa.array([first] if out else [], pa.int64())], ["first"])

    rows.mapInArrow(run, "first long").count()


@dataclass
class Segment(InputPartition):
    name: str
    after: int
    to: int


class FeedReader(DataSourceStreamReader):
    def __init__(self, path: str, since: int):
        self.path, self.since = path, since

    def _segments(self) -> list[tuple[int, int, str]]:
        store, root = opened(self.path)
        files = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        found = [(re.fullmatch(r"(\d{20})-(\d{20})\.tsv", f.base_name), f.base_name) for f in files]
        return sorted((int(m[1]), int(m[2]), name) for m, name in found if m)

    def initialOffset(self) -> dict:
        return {"seq": self.since}

    def latestOffset(self) -> dict:
        return {"seq": max([self.since, *(last for _, last, _ in self._segments())])}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return [Segment(name, start["seq"], end["seq"]) for first, last, name in self._segments() if last > start["seq"] and first <= end["seq"]]

    def read(self, part: Segment) -> Iterator[tuple]:
        store, root = opened(self.path)
        with io.BufferedReader(store.open_input_file(f"{root}/{part.name}")) as f:
            for line in f:
                seq, level, text = line.decode().rstrip("\n").split("\t")
                if part.after < int(seq) <= part.to:
                    yield int(seq), plain(level), plain(text)


class EventFeed(DataSource):
    """Options: path, and since, the number after which events are read (0)."""

    @classmethod
    def name(cls) -> str:
        return "ag_feed"

    def schema(self) -> str:
        return FEED

    def streamReader(self, schema: T.StructType) -> FeedReader:
        return FeedReader(self.options["path"], int(self.options.get("since", "0")))


def register_sources(spark: SparkSession) -> None:
    """Makes `ag_dump` and `ag_feed` known to the session, and lets filters go into sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (StoreDump, EventFeed):
        spark.dataSource.register(source)
