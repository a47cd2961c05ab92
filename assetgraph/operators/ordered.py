"""Places and running budgets within ordered groups, whatever the order's values are and however large a group is.

Places: rows are sorted by group and order into ranges whose borders Spark takes from quantiles of a sample, so a large group
is spread over many ranges and small ones share one; sparse orders make no more of them. A range counts its rows of each group, and prefix sums over
those counts give every row its place. Budgets: what can't be within the budget by the rows before it in its own task
is dropped there, then among the tasks of a portion, and only what is left of a group is brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetgraph.scratch import saved


def ranges(df: DataFrame, group: str, order: str) -> DataFrame:
    """df, sorted and written, with `_ord_range` and `_ord_at`, a number that rises by one within the range."""
    ranged = df.repartitionByRange(group, order).sortWithinPartitions(group, order)
    kept = saved(ranged.withColumn("_ord_at", F.monotonically_increasing_id()), "ranges")
    return kept.withColumn("_ord_range", F.shiftrightunsigned("_ord_at", 33))


def ordinals(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Adds the place of each row within its group, from 0, by an order that has no ties. Rows without a group are a group."""
    kept = ranges(df, group, order)
    counts = kept.groupBy(F.col(group).alias("_ord_g"), F.col("_ord_range").alias("_ord_r")).agg(F.count("*").alias("_ord_n"), F.min("_ord_at").alias("_ord_first"))
    before = F.sum("_ord_n").over(Window.partitionBy("_ord_g").orderBy("_ord_r").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("_ord_g", "_ord_r", (F.coalesce(before, F.lit(0)) - F.col("_ord_first")).alias("_ord_shift"))
    joined = kept.join(shifts, F.col(group).eqNullSafe(F.col("_ord_g")) & (F.col("_ord_range") == F.col("_ord_r")))
    return joined.withColumn(name, (F.col("_ord_at") + F.col("_ord_shift")).cast("long")).drop("_ord_range", "_ord_at", "_ord_g", "_ord_r", "_ord_shift")


def cut_locally(rows: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """rows but for those that come, within their partition, after rows of their group that use up the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, spent = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys, costs = b.column(group), b.column(cost).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.diff(keys.dictionary_encode(null_encoding="encode").indices.to_numpy(), prepend=-1))
            before = np.cumsum(costs) - costs
            base = before[begins]
            if last is not None and keys[0].as_py() == last.as_py():
                base[0] -= spent
            before -= np.repeat(base, np.diff(np.append(begins, b.num_rows)))
            last, spent = keys[b.num_rows - 1], before[-1] + costs[-1]
            yield b.filter(pa.array(before < budget))

    return rows.sortWithinPartitions(group, order).mapInArrow(run, rows.schema)


def within_budget(rows: DataFrame, group: str, order: str, cost: str, budget: int, before: str = "_before") -> DataFrame:
    """The rows whose group's earlier rows cost less than the budget, with what those cost. Costs are long, not negative and not null.

    Of n tasks with rows of a group each keeps a budget's worth; about the root of n portions bring as many together, and
    the last step one for each portion.
    """
    near = cut_locally(rows, group, order, cost, budget)
    dealt = near.withColumn("_portion", F.floor(F.sqrt(F.spark_partition_id()))).repartition(group, "_portion").drop("_portion")
    few = cut_locally(dealt, group, order, cost, budget)
    sums = F.sum(cost).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return few.withColumn(before, F.coalesce(sums, F.lit(0))).where(F.col(before) < budget)
