"""Connected components of a link table, as rounds of joins with checkpoints between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetgraph.llm.jobs import discard, fresh_path

#: Classes of node ids whose rows are counted, and the least rows of a portion. A class with more rows than 8 times
#: the mean is dealt to portions, so at most an eighth of the classes are.
CLASSES, LEAST = 1 << 14, 250


def _class(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(CLASSES)).cast("int")


def _joined(rows: DataFrame, minima: DataFrame, node: str, other: str, heavy: DataFrame | None) -> DataFrame:
    """rows with the minimum of their node. heavy (class, parts): rows of these classes are dealt by their other node, the minima are copied to each part."""
    if heavy is None:
        return rows.join(minima, node)
    parts = F.coalesce("parts", F.lit(1))
    dealt = lambda df, part: df.withColumn("class", _class(node)).join(F.broadcast(heavy), "class", "left").withColumn("part", part).drop("class", "parts")
    spread = dealt(rows, F.pmod(F.xxhash64(other, F.lit(5)), parts).cast("int"))
    return spread.join(dealt(minima, F.explode(F.sequence(F.lit(0), parts - 1))), [node, "part"]).drop("part")


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, component: the smallest node that it can reach. Nodes without links have no row.

    Alternates two rounds until nothing changes: every node hands its smallest neighbour to its larger neighbours, then to its
    smaller ones. Links shrink to stars in about log(n) rounds. Minima are taken by partial aggregation; in the joins with the
    minima a hub's neighbours are dealt to portions, whose number follows the counted rows of its class of ids.
    A round's table is deleted when the next one is written.
    """
    spark, last = links.sparkSession, None

    def written(df: DataFrame) -> DataFrame:
        nonlocal last
        path = fresh_path(spark, "links")
        df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().write.parquet(path)
        if last:
            discard(spark, last)
        last = path
        return spark.read.schema("a long, b long").parquet(path)

    def counted(both: DataFrame) -> tuple[tuple, DataFrame | None]:
        """What tells two tables apart, and the heavy classes if there are any."""
        wide = lambda c: c.cast("decimal(38,0)")
        classes = both.groupBy(_class("u").alias("class")).agg(F.count("*").alias("n"), F.sum(wide(F.xxhash64("u", "v"))).alias("s"))
        n, s, most = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("s"), F.coalesce(F.max("n"), F.lit(0))).first()
        portion = max(LEAST, 8 * n // CLASSES)
        heavy = classes.where(F.col("n") > portion).select("class", F.ceil(F.col("n") / portion).cast("int").alias("parts")) if most > portion else None
        return (n, s), heavy

    both_ways = lambda df: df.union(df.select("b", "a")).toDF("u", "v")
    links = written(links)
    before, heavy = counted(both_ways(links))
    while True:
        both = both_ways(links)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # a < b: each node's smaller neighbours; a node has no more rows here than in both, so the classes hold
        down = _joined(both.where("v > u"), low, "u", "v", heavy).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        low = down.groupBy("b").agg(F.min("a").alias("m"))
        small = _joined(down, low, "b", "a", heavy).select("m", "a").union(low.select("m", "b"))
        links = written(small.toDF("a", "b"))
        after, heavy = counted(both_ways(links))
        if after == before:
            break
        before = after
    stars = links.groupBy("b").agg(F.min("a").alias("component"))
    return stars.select(F.col("b").alias("node"), "component").union(stars.select(F.col("component").alias("node"), "component").distinct())
