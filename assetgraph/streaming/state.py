"""Streams whose state lives in Spark's state store: the last value of every column of an asset, and requests that are in flight.

Both are processors of `transformWithState`: state is kept by key in RocksDB, beside the checkpoint and as large as disks allow, and a micro-batch reads
and writes the keys that it brings and no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assetgraph.scratch import complete_folders, delete, fresh_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SEQ = "__seq"
REVISION = "__revision"


@contextmanager
def _rocksdb(spark: SparkSession):
    """Queries that start here keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def stream_id(spark: SparkSession) -> str:
    """The id of the stream that calls a batch function: it stays with the stream's checkpoint, and a new checkpoint has another."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def batch_folder(path: str, batch: DataFrame, batch_id: int) -> str:
    """Where a micro-batch writes: its own folder, whatever other streams have written to path. The same batch tried again writes there again."""
    return f"{path}/stream={stream_id(batch.sparkSession)}/batch={batch_id}"


# --- catalog state ---------------------------------------------------------------------------------------------------


class LastValues(StatefulProcessor):
    """The last value of every column of a key, by seq, and for equal seqs the larger text.

    State is a map from column names to (seq, text), so a column that appears later is one more entry and the state's schema never changes.
    A key whose values change gives one row with all that is known of it, and its revision, which grows by one each time. Rows come and go as such,
    since most keys have few, for which a data frame costs more than the state.
    """

    def __init__(self, seq: str, values: list[str]):
        self.seq, self.values = seq, values

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "name string", "seq long, value string")
        self.revision = handle.getValueState("revision", "n long")

    def handleInitialState(self, key, row: Row, timers) -> None:
        for c in self.values:
            if row[c + _SEQ] is not None:
                self.cells.updateValue((c,), (row[c + _SEQ], row[c]))
        self.revision.update((row[REVISION],))

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        held = {name[0]: (cell[0], cell[1]) for name, cell in self.cells.iterator()}
        fresh: dict[str, tuple[int, str]] = {}
        for row in rows:
            for c in self.values:
                if row[c] is not None and row[self.seq] is not None:
                    found = (row[self.seq], row[c])
                    if found > fresh.get(c, held.get(c, (-(1 << 63), ""))):
                        fresh[c] = found
        if not fresh:
            return
        for c, cell in fresh.items():
            self.cells.updateValue((c,), cell)
        before = self.revision.get()
        revision = (before[0] if before else 0) + 1
        self.revision.update((revision,))
        now = held | fresh
        cells = {n: x for c in self.values for n, x in zip((c + _SEQ, c), now.get(c, (None, None)), strict=True)}
        yield Row(**{"key": key[0], REVISION: revision} | cells)

    def close(self) -> None:
        pass


class StreamedCatalog:
    """A table of catalog states at `path`, kept by streams of sparse upserts (key, seq, values).

    A micro-batch appends one row for each key that it changes and rewrites nothing. A stream that starts on a new checkpoint
    takes up the states that the table has; each stream has folders of its own, so no batch is lost or overwritten. Values are kept as text and
    get the types of the schema again when they are read; columns that an older row does not have are null. Rows without key or seq change nothing.
    """

    def __init__(self, path: str, key: str, seq: str):
        self.path, self.key, self.seq = path, key, seq

    def _schema(self, schema) -> str:
        key = next(f for f in schema if f.name == self.key)
        values = [f.name for f in schema if f.name not in (self.key, self.seq)]
        return ", ".join([f"key {key.dataType.simpleString()}", f"{REVISION} long", *(f"`{c}{_SEQ}` long, `{c}` string" for c in values)])

    def _rows(self, spark: SparkSession, schema) -> DataFrame:
        """The newest row of each key."""
        found = complete_folders(spark, self.path, 2)
        rows = spark.read.schema(self._schema(schema)).parquet(*found) if found else spark.createDataFrame([], self._schema(schema))
        return rows.groupBy("key").agg(F.max_by(F.struct(*rows.columns), REVISION).alias("_row")).select("_row.*")

    def start(self, stream: DataFrame, checkpoint: str | None = None, trigger: dict | None = None):
        """The running query. trigger: as of Spark's writer, by default what there is now."""
        spark, schema = stream.sparkSession, stream.schema
        values = [c for c in stream.columns if c not in (self.key, self.seq)]
        texts = stream.where(F.col(self.key).isNotNull() & F.col(self.seq).isNotNull()).select(self.key, F.col(self.seq).cast("long"), *(F.col(c).cast("string").alias(c) for c in values))
        known = self._rows(spark, schema)
        changes = texts.groupBy(self.key).transformWithState(LastValues(self.seq, values), self._schema(schema), "update", "none", known.groupBy("key"))
        with _rocksdb(spark):
            writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint or fresh_path(spark, "stream-checkpoint"))
            return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(self._write).start()

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(self.path, batch, batch_id))

    def state(self, spark: SparkSession, schema) -> DataFrame:
        """key and values, typed; schema: of the stream's rows."""
        rows = self._rows(spark, schema)
        return rows.select(F.col("key").alias(self.key), *(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name not in (self.key, self.seq)))

    def compact(self, spark: SparkSession, schema) -> None:
        """Writes the newest row of each key into one folder; what it stands for is deleted by the next call, when readers have gone on."""
        old = complete_folders(spark, self.path, 2)
        into = f"{self.path}/stream=merged-{uuid.uuid4().hex}/batch=0"
        self._rows(spark, schema).write.parquet(into)
        last = [f for f in old if "/stream=merged-" in f]
        if last:
            merged = {r["folder"] for r in spark.read.schema("folder string").parquet(f"{self.path}/merged").collect()}  # a name for each batch since the last call
            for folder in merged & set(old):
                delete(spark, folder)
        spark.createDataFrame([(f,) for f in old], "folder string").write.mode("overwrite").parquet(f"{self.path}/merged")


# --- retained events -------------------------------------------------------------------------------------------------


class EventRing:
    """The last `most` events of a feed, by seq, kept by streams at `path`; an event that comes late is kept if it is among them.

    A micro-batch is cut to its newest events by the tasks that hold it, so a batch of any size writes `most` rows; of an event that comes again one is kept. Readers take the newest of
    what all batches have left. Now and then a batch puts them together: it writes the ring anew and deletes what the batches before had left.
    """

    def __init__(self, path: str, seq: str, schema: str, most: int = 300, batches: int = 32):
        self.path, self.seq, self.schema, self.most, self.batches = path, seq, schema, most, batches

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, batch_folder(self.path, batch, batch_id)
        old = complete_folders(spark, self.path, 2)
        late = [f for f in old if not f.endswith(own.split(":")[-1])]
        merge = len(late) >= self.batches
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*late)) if merge else batch
        self._newest(rows).coalesce(1).write.mode("overwrite").parquet(own)  # `most` rows
        for folder in late if merge else ():
            delete(spark, folder)

    def _newest(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col(self.seq).isNotNull()).dropDuplicates([self.seq]).orderBy(F.desc(self.seq)).limit(self.most)

    def events(self, spark: SparkSession) -> DataFrame:
        found = complete_folders(spark, self.path, 2)
        return self._newest(spark.read.schema(self.schema).parquet(*found)) if found else spark.createDataFrame([], self.schema)


# --- requests in flight ----------------------------------------------------------------------------------------------


class InFlight(StatefulProcessor):
    """Admits a request if none of its focus is in flight; it is in flight until its end comes or `timeout_ms` have passed since.

    State is one row for a focus that has a request in flight and nothing for the others: it is cleared by the end, or by a timer once the watermark is beyond
    the time-out. A request at the time-out or later is admitted whether or not the timer has run.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        before = self.opened.get() if self.opened.exists() else None
        opened = was = before[0] if before else None
        admitted: list[tuple[int, int]] = []
        for seq, ms, is_end in sorted(r for batch in rows for r in zip(batch["seq"], batch["ms"], batch["is_end"], strict=True)):
            if is_end:
                opened = None
            elif opened is None or ms >= opened + self.timeout_ms:
                opened = int(ms)
                admitted.append((int(seq), int(ms)))
        if opened != was:
            if was is not None:
                self.handle.deleteTimer(was + self.timeout_ms)
            if opened is None:
                self.opened.clear()
            else:
                self.opened.update((opened,))
                self.handle.registerTimer(opened + self.timeout_ms)
        if admitted:
            yield pd.DataFrame({"focus": key[0], "seq": [s for s, _ in admitted], "ms": [m for _, m in admitted]})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.opened.clear()
        return iter(())

    def close(self) -> None:
        pass


def in_flight_requests(feed: DataFrame, focus: str, seq: str, time: str, is_end: str, timeout_ms: int, delay: str) -> DataFrame:
    """(focus, seq, ms) of the admitted requests of a stream of requests and ends, in the order of seq. Feed rows that are later than the delay are dropped; so are rows without focus, seq or time."""
    whole = feed.select(F.col(focus).cast("string").alias("focus"), F.col(seq).cast("long").alias("seq"), F.col(time).cast("timestamp").alias("at"), F.coalesce(F.col(is_end), F.lit(False)).alias("is_end"))
    whole = whole.where("focus is not null and seq is not null and at is not null").withColumn("ms", F.unix_millis("at")).withWatermark("at", delay)
    return whole.groupBy("focus").transformWithStateInPandas(InFlight(timeout_ms), "focus string, seq long, ms long", "append", "eventTime")


def collect_stream(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Runs a stream with state over what there is, each batch into a folder of its own below path, and gives what path then holds."""
    spark, path = stream.sparkSession, path or fresh_path(stream.sparkSession, "stream")
    write = sink or (lambda batch, n: batch.write.mode("overwrite").parquet(batch_folder(path, batch, n)))
    with _rocksdb(spark):
        stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint or fresh_path(spark, "stream-checkpoint")).foreachBatch(write).start().awaitTermination()
    found = complete_folders(spark, path, 2)
    return spark.read.schema(stream.schema).parquet(*found) if found else spark.createDataFrame([], stream.schema)
