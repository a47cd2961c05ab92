"""Names that differ within their group: a name that an earlier row has gets the smallest free suffix, as one row after the other would take them.

Rows of one name in a group are a family; those that can't have the name itself take the suffixes 2, 3 and so on in order. A suffixed name meets other rows
only where it is the plain name of another family, as `a_2` beside rows named `a`. The first row of that family claims it, and has it if family `a` has not come so far
by then: if fewer than c - 1 suffixes below c are gone, by rows of `a` before it and by claims on smaller suffixes. So claims, and no rows, are gone through in order,
families before those whose names are theirs with a suffix; rows find their suffix by their place, moved on by the claims up to it.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetgraph.operators.ordered import ordinals

_SUFFIX = "([2-9]|[1-9][0-9]{1,16})$"


def _settle(claims: pa.Table) -> pa.Table:
    """The claims on one family's suffixes with whether they succeed, and the number of the row that moves on over it."""
    claims = claims.sort_by("_c")
    had, has, at = 0, [], []
    for c, before, own in zip(*(claims.column(n).to_pylist() for n in ("_c", "_q", "_own")), strict=True):
        has.append(max(0, before - own) + had < c - 1)
        at.append(c - 1 - had)
        had += has[-1]
    return pa.table({"_child": claims.column("_child"), "_key": claims.column("_key"), "_has": pa.array(has, pa.bool_()), "_m": pa.array(at, pa.int64())})


def suffixed(df: DataFrame, group: str, position: str, name: str, sep: str, out: str, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds `out`: name, or name, sep and the smallest number from 2 that gives a name that no earlier row of the group has. Positions have no ties in a group; names are not null."""
    text = F.col(group).cast("string")
    home = F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-:"))  # tells where the group ends
    rows = save(ordinals(df.withColumn("_key", F.concat(home, name)).withColumn("_home", F.length(home)), "_key", position, "_a"))
    # families whose name is another's with a suffix, and when their first row claims it
    families = rows.where("_a = 0").select("_key", "_home", F.col(position).alias("_t"))
    own = F.substring(F.col("_key"), F.col("_home") + 1, F.length("_key"))
    pattern = rf"(?s)^(.*)\Q{sep}\E{_SUFFIX}"
    parent = F.concat(F.substring(F.col("_key"), F.lit(1), F.col("_home")), F.regexp_extract(own, pattern, 1))
    asked = families.where(own.rlike(pattern)).select(parent.alias("_key"), F.regexp_extract(own, pattern, 2).cast("long").alias("_c"), F.col("_key").alias("_child"), "_t")
    claims = save(asked.join(families.select("_key"), "_key", "left_semi"))
    plain = F.when(F.col("_m") == 0, F.col(name))
    if claims.isEmpty():
        numbered = rows.withColumn("_m", F.col("_a"))
        return numbered.withColumn(out, plain.otherwise(F.concat_ws(sep, name, F.col("_m") + 1))).drop("_key", "_home", "_a", "_m")
    # rows of the family before each claim: its place among both without the claims before it
    held = claims.select("_key").distinct()
    both = rows.join(held, "_key", "left_semi").select("_key", F.col(position).alias("_t"), F.lit(None).cast("long").alias("_c")).unionByName(claims.select("_key", "_t", "_c"))
    placed = ordinals(both, "_key", "_t", "_p").where("_c is not null")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_p")) - 1
    todo = save(claims.join(placed.select("_key", "_c", (F.col("_p") - nth).alias("_q")), ["_key", "_c"]))
    done, front = None, todo.join(todo.select(F.col("_child").alias("_key")), "_key", "left_anti").withColumn("_own", F.lit(1))
    while True:
        found = save(front.groupBy("_key").applyInArrow(_settle, "_child string, _key string, _has boolean, _m long"))
        if found.isEmpty():
            break
        done = found if done is None else done.unionByName(found)
        front = todo.join(found.select(F.col("_child").alias("_key"), F.col("_has").cast("int").alias("_own")), "_key")
    settled = done.select(F.col("_child").alias("_key"), F.col("_has").cast("int").alias("_own"))
    numbered = save(rows.join(settled, "_key", "left").withColumn("_m", F.col("_a") + 1 - F.coalesce("_own", F.lit(1))).drop("_own"))
    # a row moves on by the claims up to its number: its place among both without the rows before it
    moving = numbered.join(held, "_key", "left_semi")
    marks = done.where("_has").select("_key", F.lit(None).cast("long").alias("_at"), (2 * F.col("_m")).alias("_o"))
    merged = ordinals(moving.where("_m > 0").select("_key", F.col("_m").alias("_at"), (2 * F.col("_m") + 1).alias("_o")).unionByName(marks), "_key", "_o", "_p").where("_at is not null")
    moved = merged.select("_key", F.col("_at").alias("_m"), (F.col("_p") + 2).alias("_k"))
    whole = numbered.join(moved, ["_key", "_m"], "left")
    return whole.withColumn(out, plain.otherwise(F.concat_ws(sep, name, F.coalesce("_k", F.col("_m") + 1)))).drop("_key", "_home", "_a", "_m", "_k")
