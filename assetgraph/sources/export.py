"""Tables as delimited or JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetgraph.operators.ordered import ordinals


def csv_cell(c: Column) -> Column:
    """Quoted where it has a comma, a quote or a line break; quotes doubled; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, columns: list[str], name: str = "line") -> DataFrame:
    """df with each row's delimited line."""
    return df.withColumn(name, F.array_join(F.array(*(csv_cell(F.col(c)) for c in columns)), ","))


def write_csv(df: DataFrame, path: str, time_series: bool = False, key: str = "key") -> None:
    """Files with a header of the last parts of the column names; the key stays, first, for time series alone."""
    rest = [c for c in df.columns if c != key]
    out = df.select(*([key] if time_series and key in df.columns else []), *(F.col(f"`{c}`").alias(c.rsplit(".", 1)[-1]) for c in rest))
    out.write.option("header", True).option("escape", '"').csv(path)


def pairs_json(pairs: DataFrame, key: str, k: str = "k", v: str = "v") -> DataFrame:
    """(key, body): a JSON object for each key, its names in order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(k).alias("key"), F.col(v).alias("value"))))
    return pairs.groupBy(key).agg(F.to_json(F.map_from_entries(entries)).alias("body"))


def table_json(df: DataFrame, group: str, row_order: str, part_rows: int = 10_000) -> DataFrame:
    """(group, part, body): columns, rows in order and totalRows of each group as JSON texts of at most part_rows rows, part from 0; all parts have the group's total.

    row_order: an integer column.
    """
    names = [c for c in df.columns if c != group]
    placed = ordinals(df, group, row_order, "_at").withColumn("part", F.floor(F.col("_at") / part_rows).cast("int"))
    parts = placed.groupBy(group, "part").agg(F.array_sort(F.collect_list(F.struct(row_order, *(c for c in names if c != row_order)))).alias("_rows"))
    totals = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    body = F.to_json(F.struct(F.array(*map(F.lit, names)).alias("columns"), F.col("_rows").alias("rows"), F.col("_n").alias("totalRows")))
    return parts.join(totals, F.col(group) == F.col("_g")).select(group, "part", body.alias("body"))
