"""Raw files as chunks, their reassembly, and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetgraph.operators.ordered import within_budget

CHUNK = 1 << 20


def chunks(df: DataFrame, key: str, content: str, size: int = CHUNK) -> DataFrame:
    """(key, chunk_no, bytes): pieces of `size` bytes, at least one even if there is nothing."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(content) / size)).cast("int")
    cut = df.select(key, F.col(content).cast("binary").alias("_c"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return cut.select(key, "chunk_no", F.substring("_c", F.col("chunk_no") * size + 1, F.lit(size)).alias("bytes"))


def reassemble(pieces: DataFrame, key: str, cap: int, chunk_no: str = "chunk_no", content: str = "bytes") -> DataFrame:
    """(key, content): the pieces in order, no more than `cap` bytes; pieces past the cap are dropped where they are read, or in the first shuffle."""
    sized = pieces.select(key, chunk_no, content, F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("_size"))
    kept = within_budget(sized, key, chunk_no, "_size", cap)
    clipped = kept.withColumn("_piece", F.substring(F.col(content), F.lit(1), (cap - F.col("_before")).cast("int")))
    joined = clipped.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(chunk_no).alias("n"), F.col("_piece").alias("b")))).alias("_all"))
    return joined.select(key, F.aggregate("_all", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["b"])).alias("content"))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes) of the files below path, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select(F.col("path"), F.col("length").alias("bytes"))


def parse_usage(lines: DataFrame, line: str = "line") -> DataFrame:
    """(path, bytes) of disk-usage lines in KiB; other lines are dropped."""
    kib = F.regexp_extract(line, r"^\s*([0-9]+)\s+(\S.*)$", 1)
    return lines.select(F.regexp_extract(line, r"^\s*([0-9]+)\s+(\S.*)$", 2).alias("path"), (kib.try_cast("long") * 1024).alias("bytes")).where("bytes is not null")
