"""Tables, the shared folder and small plan helpers that the corpus operators have in common."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetgraph.llm.textvec import blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of our own only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="assetgraph-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/assetgraph/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's switch that frees the files of a query's shuffles at its end.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The written table; the shuffles that made it, are freed."""
    conf = df.sparkSession.conf
    before = conf.get(_FREE)
    conf.set(_FREE, "true")
    try:
        return materialise(df.select("*"), name)
    finally:
        conf.set(_FREE, before)


#: Keys that hold more than this share of all rows (so at most so many) are joined by broadcast; from this number of rows on.
HOT_SHARE, HOT_LEAST = 1000, 10_000


def joined_by(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with the one row of groups that has their key. count: the column of groups that says how many rows have the key; both are written tables."""
    from_ = max(HOT_LEAST, rows.count() // HOT_SHARE)
    hot = F.broadcast(groups.where(F.col(count) > from_))  # at most HOT_SHARE rows: their counts add up to no more than all
    cold = groups.where(F.col(count) <= from_)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `at`, its place from 0 in that order, and `part`, the sorted range that holds it. Rows that are equal in the order's
    columns are numbered in any order, and spread over the ranges; df is a written table. The driver sees one number for each range."""
    spread = "_spread"
    ranged = df.withColumn(spread, F.monotonically_increasing_id()).repartitionByRange(*order, spread).sortWithinPartitions(*order, spread)
    written = materialise(ranged.drop(spread).withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("_id", 33).cast("int")  # a partition and the place within it
    total = 0
    base = []
    for r in written.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        base.append((r["part"], total))
        total += r["n"]
    bases = df.sparkSession.createDataFrame(base, "part int, base long")
    return written.withColumn("part", part).join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "base")


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table below the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def map_blocks(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow over blocks of whole texts with a bounded number of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text):
                yield fn(block)

    return df.mapInArrow(run, schema)


#: Bytes of an Arrow batch between the JVM and Python; a batch has one row at least.
BATCH_BYTES = 8 << 20


def bounded(docs: DataFrame) -> DataFrame:
    """docs; from here on the session bounds Arrow batches by bytes, not by rows alone. A smaller bound that is set stays."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", docs.sparkSession.conf
    now = conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return docs


def doc_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone, so that other columns neither travel nor clash."""
    bounded(docs)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def sample_texts(docs: DataFrame, rated: DataFrame, rows: int, size: int) -> DataFrame:
    """doc_id, text and the other columns of rated for a bounded sample of rated documents, the same on every run: those with the
    smallest hashes of doc_id, as long as they are no more than `rows` rows and `size` bytes of text together.

    rated: doc_id (long, not null) and a rating, one row for each doc_id at least. A rated document that stands alone beyond the bounds ends the sample.
    """
    texts = doc_texts(docs)
    by = "doc_id"
    once = rated.groupBy(by).agg(*(F.min(c).alias(c) for c in rated.columns if c != by))
    chosen = once.orderBy(F.xxhash64(by), by).limit(rows)
    lengths = texts.select(by, F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).join(F.broadcast(chosen.select(by)), by)  # at most `rows` ids
    found = lengths.groupBy(by).agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")).orderBy(F.xxhash64(by), by)
    ids, n, total = [], 0, 0
    for r in found.collect():  # at most `rows` rows of three numbers
        n, total = n + r["rows"], total + r["bytes"]
        if n > rows or total > size:
            break
        ids.append((r[by],))
    kept = docs.sparkSession.createDataFrame(ids, f"{by} long")
    return texts.join(F.broadcast(chosen.join(kept, by)), by)
