"""Event feeds and recurring pipelines, for batches and as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetgraph.functions.paths import normalize_path, parent_path, path_chain
from assetgraph.operators.extract import roll_up
from assetgraph.operators.sinks import merge_table, read_table
from assetgraph.scratch import fresh_path, saved
from assetgraph.streaming.state import batch_folder

LEVELS = ("INFO", "WARN", "ERROR", "SUCCESS", "RUNNING")
MOST = 120
#: Events that a feed keeps.
RETAINED = 300


def level(c: Column) -> Column:
    up = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(up == "WARNING", "WARN").when(up.isin(*LEVELS), up).otherwise("INFO")


def events_since(events: DataFrame, seq: str, since: int, limit: int) -> DataFrame:
    """The newest `limit` (1 to 120) events after a number, the oldest of them first."""
    newest = events.where(F.col(seq) > since).orderBy(F.desc(seq)).limit(min(MOST, max(1, limit)))
    return newest.withColumn("level", level(F.col("level"))).orderBy(seq)


def retained(events: DataFrame, seq: str, most: int = RETAINED) -> DataFrame:
    """The last events of a feed, which alone can still be asked for."""
    return events.orderBy(F.desc(seq)).limit(most)


def dedup_requests(requests: DataFrame, focus: str, seq: str) -> DataFrame:
    """The first request of each focus."""
    return requests.groupBy(focus).agg(F.min(F.struct(seq, *(c for c in requests.columns if c not in (focus, seq)))).alias("_x")).select(focus, "_x.*")


def dedup_requests_stream(requests: DataFrame, focus: str, time: str, delay: str) -> DataFrame:
    """As a stream: one request of each focus within the delay."""
    return requests.withWatermark(time, delay).dropDuplicatesWithinWatermark([focus])


def status_windows(events: DataFrame, time: str, width: str, delay: str | None = None) -> DataFrame:
    """(window_start, level, n) by tumbling windows; with a delay, late events are dropped and closed windows are final."""
    source = events.withWatermark(time, delay) if delay else events
    counts = source.groupBy(F.window(time, width), level(F.col("level")).alias("level")).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "level", "n")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> str | None:
    """Runs a stream over what there is; returns the folder of its result if no sink is given. Checkpoints lie in the shared folder."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", fresh_path(spark, "stream-checkpoint"))
    if sink:
        writer.foreachBatch(sink).start().awaitTermination()
        return None
    out = fresh_path(spark, "stream")
    writer.format("parquet").option("path", out).start().awaitTermination()
    return out


def collected(stream: DataFrame) -> DataFrame:
    """The result of a stream over what there is, as a table."""
    out = run_available(stream)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


class LeafPipeline:
    """A recurring extraction: each micro-batch of waiting assets is extracted as a whole and its rows appended to the log at `path`, in a folder of the stream and the batch."""

    def __init__(self, path: str, extract: Callable[[DataFrame], DataFrame]):
        self.path, self.extract = path, extract

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        waiting = batch.where("status in ('PENDING', 'FAILED') and is_valid")
        self.extract(waiting).write.mode("overwrite").parquet(batch_folder(self.path, batch, batch_id))


class DirectoryPipeline:
    """A recurring roll-up: each micro-batch of changed assets brings its folders and their ancestors up to date in the table at `path`.

    `assets` gives the current assets (asset_key, logical_path, status, keywords). Only the folders that the batch touches are computed anew;
    their other sub-folders count with what the table says of them.
    """

    SCHEMA = "path string, status string, keywords array<string>"

    def __init__(self, path: str, assets: Callable[[], DataFrame]):
        self.path, self.assets = path, assets

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        touched = saved(batch.select(F.explode(path_chain(normalize_path(F.col("logical_path")))).alias("folder")).distinct(), "touched")
        own = self.assets().join(touched, normalize_path(F.col("logical_path")) == F.col("folder"), "left_semi")
        rows = own.select(F.col("asset_key").cast("long").alias("key"), F.lit(None).cast("string").alias("sub"), normalize_path(F.col("logical_path")).alias("at"), "status", "keywords")
        stored = self.table(batch.sparkSession).where("path <> '/'")
        beside = stored.join(touched, F.col("path") == F.col("folder"), "left_anti").withColumn("at", parent_path(F.col("path")))
        rows = rows.unionByName(beside.join(touched, F.col("at") == F.col("folder"), "left_semi").select(F.lit(None).cast("long").alias("key"), F.col("path").alias("sub"), "at", "status", "keywords"))
        if not rows.isEmpty():
            merge_table(self.path, roll_up(rows, "key", "at", "keywords", saved, folder="sub"), ["path"])

    def table(self, spark) -> DataFrame:
        return read_table(spark, self.path, self.SCHEMA)


def start_recurring(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds"):
    """The running query that hands a micro-batch to the sink at each tick and goes on where it stopped."""
    return stream.writeStream.trigger(processingTime=every).option("checkpointLocation", checkpoint).foreachBatch(sink).start()
