"""Longest-processing-time scheduling: groups that stay together, the largest first, each to the least-loaded shard.

Texts are read once, for a narrow row of each document. Groups are summed by their key and sorted by falling size across the cluster. The heap's
loads after each part of that order depend only on how many groups of each size come before it, so the driver runs through the counted sizes
(distinct sizes: at most the root of twice the total, read as a stream) and keeps the loads where each part begins. Every part then runs the heap over its
own groups from there: the schedule is that of one heap over all groups, ties to the lower shard, groups of one size by key.

Within a shard, documents are numbered in the order of doc_id, text_crc32 and size by sorted ranges and their counts.

Defined results: a null text counts as empty (size 1, crc 0), and all empty texts are one group. Rows without doc_id, repeated rows and equal
texts under several ids are rows of their own and share the shard of their text. A group larger than a shard's share stays whole, and the others go around it.
An empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetgraph.llm.jobs import joined_by, materialise, numbered, table

SHARDS = 16
LAW = "bytes"
#: From so many groups of one size on their places are computed at once.
MANY = 512


def advance(loads: list[int], size: int, count: int) -> list[int]:
    """The loads after `count` groups of one size: they take the count smallest of load + k * size, ties to the lower shard."""
    if count <= MANY:
        heap = [(load, k) for k, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
        return [load for load, _ in sorted(heap, key=lambda x: x[1])]
    below = lambda level: sum(max(0, -((load - level) // size)) for load in loads)  # noqa: E731  of the places below a level
    low, high = min(loads), min(loads) + size * count + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if below(middle) <= count else (low, middle)
    left = count - below(low)
    out = []
    for load in loads:
        taken = max(0, -((load - low) // size))
        more = left > 0 and load <= low and (low - load) % size == 0
        left -= more
        out.append(load + size * (taken + more))
    return out


def starts(sizes: Iterable[tuple[int, int]], ends: list[int], shards: int) -> list[list[int]]:
    """The loads where each part begins. sizes: falling sizes and their counts; ends: of the parts, in groups from the first."""
    out, loads, done = [], [0] * shards, 0
    waiting = iter(ends)
    end = next(waiting, None)
    out.append(loads)
    for size, count in sizes:
        while count:
            while end is not None and end == done:
                out.append(loads)
                end = next(waiting, None)
            step = count if end is None else min(count, end - done)
            loads = advance(loads, size, step)
            done, count = done + step, count - step
    return out + [loads] * (len(ends) + 1 - len(out))


def _heap(begin) -> Callable:
    """A part's groups in order, each to the least-loaded shard. begin: a broadcast, the loads at each part's begin."""

    def run(key: tuple, groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("at")
        heap = [(load, k) for k, load in enumerate(begin.value[key[0].as_py()])]
        heapq.heapify(heap)
        shard = np.empty(groups.num_rows, np.int32)
        for row, size in enumerate(groups.column("bytes").to_pylist()):
            load, k = heap[0]
            shard[row] = k
            heapq.heapreplace(heap, (load + size, k))
        return pa.table({"group": groups.column("group"), "rows": groups.column("rows"), "shard": pa.array(shard)})

    return run


def schedule(items: DataFrame, shards: int = SHARDS) -> DataFrame:
    """group, rows, shard of every group. items: group (binary, not null) and size (long, at least 1) of what belongs to it."""
    spark = items.sparkSession
    groups = materialise(items.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    ordered = numbered(groups, [F.desc("bytes"), F.asc("group")], "ordered-groups")
    counts = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a number for each part
    parts = sorted(counts)
    ends = np.cumsum([counts[p] for p in parts]).tolist()
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n")).orderBy(F.desc("bytes"))
    begin = dict(zip(parts, starts(((r["bytes"], r["n"]) for r in sizes.toLocalIterator()), ends, shards), strict=False))
    return ordered.groupBy("part").applyInArrow(_heap(spark.sparkContext.broadcast(begin)), f"group {dict(items.dtypes)['group']}, rows long, shard int")


def narrow(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (bytes and 1), text_crc32 and the text's digest as its group."""
    bytes_ = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    return docs.select(F.col(key).cast("long").alias("doc_id"), bytes_.alias("b")).select("doc_id", (F.octet_length("b") + 1).cast("long").alias("size"), F.crc32("b").alias("text_crc32"), F.unhex(F.sha2("b", 256)).alias("group"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (from 0 within the shard) of every row; equal texts share a shard."""
    rows = materialise(narrow(docs), "document-sizes")
    placed = materialise(schedule(rows.select("group", "size"), shards), "schedule")
    dealt = materialise(joined_by(rows, placed, "group", "rows").select("doc_id", "size", "text_crc32", "shard"), "dealt")
    ordered = numbered(dealt, [F.asc(c) for c in ("shard", "doc_id", "text_crc32", "size")], "slots")
    before = dealt.groupBy("shard").agg(F.count("*").alias("n")).collect()  # a number for each shard
    first = {r["shard"]: sum(x["n"] for x in before if x["shard"] < r["shard"]) for r in before}
    base = dealt.sparkSession.createDataFrame(sorted(first.items()), "shard int, first long")
    return ordered.join(F.broadcast(base), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    found = shard_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
