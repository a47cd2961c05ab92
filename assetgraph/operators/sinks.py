"""Sinks of the catalog and the graph: plain Parquet, written so that a retried job leaves no doubles."""

from __future__ import annotations

import contextlib
import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetgraph import scratch


def append_log(rows: DataFrame, path: str, day: str) -> None:
    """Appends upserts to the log at path, a folder for each day. State readers take the last value by seq, so rows that are appended twice do no harm."""
    rows.withColumn("day", F.lit(day)).write.mode("append").partitionBy("day").parquet(path)


def read_log(spark, path: str, schema: str, since: str | None = None) -> DataFrame:
    """The log, from a day on; other days' folders are not read."""
    log = spark.read.schema(f"{schema}, day string").parquet(path)
    return (log.where(F.col("day") >= since) if since else log).drop("day")


BUCKETS = 16
#: Files that a merge writes for each bucket at most.
SPLIT = 4
_BUCKET = "__bucket"
#: Seconds after which a manifest that is not whole is given up.
STALE = 600


class ConcurrentMerge(RuntimeError):
    """Another writer has committed the version that this one was to be."""


def _manifests(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in scratch.names(spark, f"{path}/manifests") if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest (or one) version of a merged table: version, n_buckets, keys, and folders, which holds the folder of each bucket that has rows. None before the first merge."""
    for n in [version] if version is not None else reversed(_manifests(spark, path)):
        with contextlib.suppress(json.JSONDecodeError):  # of a writer that is not ready, or has died
            return json.loads(scratch.read_text(spark, f"{path}/manifests/{n}.json"))
    return None


def _rows(spark: SparkSession, path: str, schema, folders) -> DataFrame:
    found = [f"{path}/data/{f}" for f in folders]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The rows of the newest version of a merged table, or of one; no rows before the first merge."""
    now = manifest(spark, path, version)
    return _rows(spark, path, schema, now["folders"].values() if now else ())


def merge_table(path: str, fresh: DataFrame, keys: list[str], order: str | None = None, buckets: int = BUCKETS) -> int:
    """Merges rows by key into the table at path and gives its new version: rows with a fresh key are replaced, the others stay.

    Rows lie in hash buckets of their key (as many as the table was made with). A merge reads and rewrites the buckets that fresh rows fall into, into
    folders of its own; a new manifest that names the folder of every bucket makes it visible at once. Readers of an older manifest go on
    with its folders: those that the last two versions name are kept, older ones deleted. The manifest's number can be taken once, so of two writers that began at
    one version the second gets ConcurrentMerge, leaves nothing visible behind, and can merge again. Of fresh rows with one key the last by `order` counts, without it the largest.
    """
    spark, columns = fresh.sparkSession, fresh.columns
    now = manifest(spark, path)
    for newer in [v for v in _manifests(spark, path) if v > (now["version"] if now else 0)]:  # half written: by a writer at work, or one that died
        if scratch.age(spark, f"{path}/manifests/{newer}.json") < STALE:
            raise ConcurrentMerge(f"version {newer} of {path}")
        scratch.delete(spark, f"{path}/manifests/{newer}.json")
    n = now["n_buckets"] if now else buckets
    if now and now["keys"] != keys:
        raise ValueError(f"the table at {path} is merged by {now['keys']}")
    last = F.max_by(F.struct(*columns), F.col(order)) if order else F.max(F.struct(*columns))
    once = scratch.saved(fresh.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(last.alias("_row")).select("_row.*"), "fresh")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    touched = {r[0] for r in once.select(bucket).distinct().collect()}  # a number for each bucket
    folders = dict(now["folders"]) if now else {}
    stored = _rows(spark, path, fresh.schema, [folders[str(b)] for b in sorted(touched) if str(b) in folders])
    same = [stored[k].eqNullSafe(once[k]) for k in keys]
    merged = stored.join(once, functools.reduce(lambda x, y: x & y, same), "left_anti").select(*columns).unionByName(once).withColumn(_BUCKET, bucket)
    own = uuid.uuid4().hex
    merged.repartition(F.col(_BUCKET), F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(SPLIT))).write.partitionBy(_BUCKET).parquet(f"{path}/data/{own}")
    version = (now["version"] if now else 0) + 1
    folders |= {str(b): f"{own}/{_BUCKET}={b}" for b in touched}
    text = json.dumps({"version": version, "n_buckets": n, "keys": keys, "folders": folders}, sort_keys=True)
    if not scratch.write_new(spark, f"{path}/manifests/{version}.json", text):
        scratch.delete(spark, f"{path}/data/{own}")
        raise ConcurrentMerge(f"version {version} of {path}")
    kept = set(folders.values()) | set(now["folders"].values() if now else ())
    for old in [v for v in _manifests(spark, path) if v < version - 1]:
        for folder in set((manifest(spark, path, old) or {"folders": {}})["folders"].values()) - kept:
            scratch.delete(spark, f"{path}/data/{folder}")
        scratch.delete(spark, f"{path}/manifests/{old}.json")
    return version


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes, then edges, merged by id and by (src, dst, type)."""
    merge_table(f"{path}/nodes", nodes, ["id"])
    merge_table(f"{path}/edges", edges, ["src", "dst", "type"])
