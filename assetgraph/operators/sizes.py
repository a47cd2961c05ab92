"""Size estimates: exact, by the first rows, by the schema and by chunks, for all assets in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 100
MAX = (1 << 63) - 1
WIDTHS = {T.BooleanType: 1, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8}


def value_bytes(c: Column) -> Column:
    return F.coalesce(F.octet_length(c.cast("string")), F.lit(0)).cast("long")


def row_bytes(columns: list[str]) -> Column:
    total = F.lit(0).cast("long")
    for c in columns:
        total = total + value_bytes(F.col(c))
    return total


def saturating_sum(c: Column) -> Column:
    return F.when(F.count(c) == 0, 0).otherwise(F.coalesce(F.try_sum(c), F.lit(MAX))).cast("long")


def saturating_product(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(a, b), F.lit(MAX)).cast("long")


def _first_rows(df: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where(F.col("_nth") <= n).drop("_nth")


def structured(df: DataFrame, group: list[str], order: str, columns: list[str], sample: int = SAMPLE) -> DataFrame:
    """(group, rows, bytes): exact below `sample` rows, else the mean of the first rows times their number."""
    counts = df.groupBy(*group).agg(F.count("*").alias("rows"))
    head = _first_rows(df.select(*group, order, row_bytes(columns).alias("_b")), group, order, sample).groupBy(*group).agg(F.sum("_b").alias("_head"))
    mean = F.greatest(F.lit(1), F.floor(F.col("_head") / sample)).cast("long")
    return counts.join(head, group).select(*group, "rows", F.when(F.col("rows") < sample, F.col("_head")).otherwise(saturating_product(mean, F.col("rows"))).alias("bytes"))


def by_schema(df: DataFrame, group: list[str], order: str, columns: list[str], sample: int = SAMPLE) -> DataFrame:
    """(group, rows, bytes): widths of the column types, for text the mean of the first rows, times the count of the first column of fixed width."""
    kinds = {f.name: type(f.dataType) for f in df.schema.fields}
    fixed = sum(WIDTHS.get(kinds[c], 0) for c in columns)
    counted = next((c for c in columns if kinds[c] in WIDTHS), columns[0])
    texts = [c for c in columns if kinds[c] in (T.StringType, T.BinaryType)]
    counts = df.groupBy(*group).agg(F.count(counted).alias("rows"))
    head = _first_rows(df.select(*group, order, *(c for c in texts if c not in group and c != order)), group, order, sample).groupBy(*group)
    width = F.lit(fixed).cast("long")
    for i, _ in enumerate(texts):
        width = width + F.col(f"_w{i}")
    means = head.agg(F.count("*").alias("_n"), *(F.greatest(F.lit(1), F.floor(F.coalesce(F.avg(value_bytes(F.col(c))), F.lit(0)))).cast("long").alias(f"_w{i}") for i, c in enumerate(texts)))
    return counts.join(means, group).select(*group, "rows", saturating_product(width, F.col("rows")).alias("bytes"))


def chunked(pieces: DataFrame, key: str, chunk: int, chunk_no: str = "chunk_no", content: str = "bytes") -> DataFrame:
    """(key, bytes): full chunks but the last, and the last one's own length."""
    return pieces.groupBy(key).agg(((F.count("*") - 1) * chunk + F.max_by(F.octet_length(content), chunk_no)).cast("long").alias("bytes"))


def exact(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(saturating_sum(row_bytes(columns)).alias("bytes"))


def looked_up(assets: DataFrame, sizes: DataFrame, key: str, size: str, fallback: Column) -> DataFrame:
    """assets with bytes: from the size table, or the fallback where that is missing or not positive."""
    return assets.join(sizes.select(key, F.col(size).alias("_s")), key, "left").withColumn("bytes", F.coalesce(F.when(F.col("_s") > 0, F.col("_s")), fallback)).drop("_s")


def format_bytes(c: Column) -> Column:
    """1024 units up to PB; no decimals for bytes and from 100 on, else two."""
    out = F.concat(c, F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        cents = F.floor(c * 100 / F.lit(float(1024**k)) + 0.5).cast("long")
        whole = F.floor(c / F.lit(float(1024**k)) + 0.5).cast("long")
        text = F.when(c / F.lit(float(1024**k)) >= 100, whole.cast("string")).otherwise(F.concat(F.floor(cents / 100), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")))
        out = F.when(c >= F.lit(1024**k), F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out
