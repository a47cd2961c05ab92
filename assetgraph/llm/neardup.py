"""Near-duplicates by min-max hashing: both extremes of every permutation make the signature, so that half the hash
evaluations give as many independent estimates; bands of signature values name candidates, whole shingle sets confirm.

1. Each document: its set of n-word shingles (64-bit fingerprints of whole words), the set's digest, its bands.
2. Documents with equal sets collapse to the smallest doc_id (one aggregation; no pairs).
3. Within a band's bucket every member is held against the smallest one. The confirmed links are joined to components.
4. Large buckets whose members still lie in different components get further hubs, members drawn by a hash, as long as these
   join a fair part of what is left.
5. Buckets that stay open are settled exactly: the members outside the bucket's main component, in blocks of bounded size, meet
   all its members, in blocks too, and pairs across components are counted inside the task. Only links leave it, at most one for
   each member and block.

Nothing is capped: the hubs only save work, step 5 covers what they leave. Rows of a bucket are joined in portions of about `PORTION`, a
hub's set is dealt to as many tasks as its bucket needs. If the extremes were independent, a pair at the threshold would share no band with
probability (1 - 0.8^5)^32 = 3e-6; in sets of a few shingles they are not, and it is about 2e-5.

Defined results: null and empty texts have an empty set and stay alone. Rows with the same doc_id are one document (their
sets are held apart, their links are joined); each row is returned. A null doc_id takes no part: its component is null,
its row is kept. An empty table has no rows. Further columns are not looked at (`components`) or stay (`keep_first`).
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetgraph.llm.components import connected_components
from assetgraph.llm.jobs import doc_texts, map_blocks, materialise
from assetgraph.llm.textvec import LOWER, mix, ngram_hash, span_hash, text_bytes, words

BANDS, BAND_ROWS = 32, 5
PERCENT = 80
#: Shingles per block when buckets are settled exactly; memory per task follows it, results do not.
BLOCK_SHINGLES = 100_000
#: Members of a bucket that are joined in one portion.
PORTION = 1000
#: Further hubs of large buckets end after so many, or when one joins less than this share of what it is held against.
MORE_HUBS, FAIR = 6, 0.1

_U = np.uint64


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each text; with fewer words, the whole sequence as one."""
    buf, offsets = text_bytes(column)
    buf = LOWER[buf]
    starts, ends, of = words(buf, offsets)
    word = span_hash(buf, starts, ends)
    grams, gram_of = ngram_hash(word, of, n)
    out = []
    for i in range(len(offsets) - 1):
        a, b = of[i], of[i + 1]
        if b - a >= n:
            out.append(np.unique(grams[gram_of[i] : gram_of[i + 1]]))
        elif b > a:
            h = word[a : a + 1]
            for k in range(a + 1, b):
                h = mix(h * _U(0x9E3779B97F4A7C15) + word[k : k + 1])
            out.append(mix(h + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def _permutations(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=_U)) | _U(1)


def signature(grams: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, side by side."""
    out = np.empty(2 * len(factors), _U)
    low, high = np.full(len(factors), ~_U(0)), np.zeros(len(factors), _U)
    for at in range(0, len(grams), 4096):
        h = grams[None, at : at + 4096] * factors[:, None]
        h ^= h >> _U(31)
        h *= _U(0x94D049BB133111EB)
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    out[0::2], out[1::2] = low, high
    return out


def bands(sig: np.ndarray, count: int, rows: int) -> np.ndarray:
    """A key for each band; the band's number is part of it."""
    parts = sig[: count * rows].reshape(count, rows)
    h = mix(np.arange(count, dtype=_U))
    for k in range(rows):
        h = mix(h * _U(0x9E3779B97F4A7C15) + parts[:, k])
    return h


def _features(n: int, count: int, rows: int):
    factors = _permutations(-(-count * rows // 2))

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(block.column("text"), n)
        keys = np.zeros((len(sets), count), _U)
        digest = np.zeros((len(sets), 2), _U)
        for i, s in enumerate(sets):
            if len(s):
                keys[i] = bands(signature(s, factors), count, rows)
                digest[i] = mix(s).sum(dtype=_U), mix(s * _U(3) + _U(len(s))).sum(dtype=_U)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        of = np.concatenate([[0], np.cumsum(np.where(sizes > 0, count, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(of), pa.array(keys[sizes > 0].ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [block.column("doc_id"), pa.array(sizes), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)), lists], ["doc_id", "n_shingles", "d0", "d1", "bands"]
        )

    return run


def _sets(n: int):
    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(block.column("text"), n)
        of = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        grams = np.concatenate([*sets, np.zeros(0, _U)]).view(np.int64)
        return pa.RecordBatch.from_arrays([block.column("doc_id"), pa.ListArray.from_arrays(pa.array(of), pa.array(grams))], ["doc", "grams"])

    return run


def _settle(percent: int):
    """Links across components between the drivers and all members of a group: joins what it finds as it goes, so at most one per member."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group["set"] = [np.asarray(g, np.int64).tobytes() for g in group["grams"]]  # a doc_id may have several
        group = group.sort_values(["doc", "driver"], ascending=[True, False]).drop_duplicates(["doc", "set"])
        docs, labels, drivers = group["doc"].to_numpy(), group["component"].to_numpy().copy(), np.flatnonzero(group["driver"].to_numpy())
        sets = [np.asarray(g, np.int64) for g in group["grams"]]
        size = np.array([len(s) for s in sets])
        every, flat = np.repeat(np.arange(len(sets)), size), np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        flat, every = flat[order], every[order]
        found = []
        for i in drivers:
            left, right = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            hit = right - left
            at = np.repeat(left - (np.cumsum(hit) - hit), hit) + np.arange(hit.sum())
            common = np.bincount(every[at], minlength=len(sets))
            link = (100 * common >= percent * (size + size[i] - common)) & (labels != labels[i])
            for j in np.flatnonzero(link):
                if labels[j] != labels[i]:
                    found.append((docs[i], docs[j]))
                    labels[labels == labels[j]] = labels[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _portions(size: Column) -> Column:
    return F.ceil(size / PORTION).cast("int")


def _portion(doc: Column, size: Column) -> Column:
    return F.pmod(F.xxhash64(doc, F.lit(2)), _portions(size)).cast("int")


def _for_each_portion(buckets: DataFrame, size: str) -> DataFrame:
    return buckets.withColumn("portion", F.explode(F.sequence(F.lit(0), _portions(F.col(size)) - 1)))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, size, ...) that are links on whole shingle sets. size: of the bucket of hub a, whose set is dealt to as many portions."""
    left = pairs.join(sets.select(F.col("doc").alias("b"), F.col("grams").alias("gb")), "b").withColumn("portion", _portion(F.col("b"), F.col("size")))
    hubs = _for_each_portion(pairs.groupBy("a").agg(F.max("size").alias("most")).join(sets.select(F.col("doc").alias("a"), F.col("grams").alias("ga")), "a"), "most").select("a", "portion", "ga")
    common = F.size(F.array_intersect("ga", "gb"))
    return left.join(hubs, ["a", "portion"]).where(100 * common >= percent * (F.size("ga") + F.size("gb") - common)).select(*pairs.columns)


def components(docs: DataFrame, shingle: int = 2, percent: int = PERCENT, count: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    texts = doc_texts(docs)
    found = materialise(map_blocks(texts, "text", _features(shingle, count, rows), "doc_id long, n_shingles long, d0 long, d1 long, bands array<long>"), "signatures")
    full = found.where("doc_id is not null and n_shingles > 0")
    same = ["d0", "d1", "n_shingles"]
    # documents with one set: the smallest of them stands for all
    first = materialise(full.groupBy(*same).agg(F.min(F.struct("doc_id", "bands")).alias("m")).select(*same, F.col("m.doc_id").alias("doc"), F.col("m.bands").alias("bands")), "firsts")
    copies = full.join(first.select(*same, "doc"), same).where("doc <> doc_id").select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))

    members = first.select("doc", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(
        F.count("*").alias("size"), F.min(F.struct("doc", "n")).alias("hub"), F.bit_xor(F.xxhash64("doc", "n")).alias("x0"), F.bit_xor(F.xxhash64("doc", "n", F.lit(1))).alias("x1")
    )
    # buckets of several bands with the very same members are one
    shared = shared.where("size > 1").groupBy("size", F.col("hub.doc").alias("hub"), "x0", "x1").agg(F.min("key").alias("key"), F.min("hub.n").alias("hub_n")).select("key", "size", "hub", "hub_n")
    buckets = materialise(members.join(shared, "key").select("key", "doc", "n", "size", "hub", "hub_n"), "buckets")
    candidates = buckets.select("doc").distinct().hint("merge")  # grows with the corpus: never broadcast
    sets = materialise(map_blocks(texts.join(candidates, texts["doc_id"] == candidates["doc"], "left_semi"), "text", _sets(shingle), "doc long, grams array<long>"), "sets")

    pairs = buckets.where(_near("n", "hub_n", percent) & (F.col("doc") != F.col("hub"))).groupBy(F.col("hub").alias("a"), F.col("doc").alias("b")).agg(F.max("size").alias("size"))
    links = materialise(_confirm(pairs, sets, percent).select("a", "b"), "confirmed")
    # with two members the hub has settled the bucket
    label = connected_components(links).select(F.col("node").alias("doc"), F.col("component").alias("c"))
    labelled = buckets.where("size > 2").select("key", "doc", "n", "size").join(label, "doc", "left").select("key", "doc", "n", "size", F.coalesce("c", "doc").alias("component"))
    open_buckets = materialise(_unsettled(labelled), "open")
    for turn in range(MORE_HUBS):
        large = open_buckets.where(F.col("total") > BLOCK_SHINGLES)
        if large.isEmpty():
            break
        tried = materialise(_held_against_a_hub(large, turn, percent), "tried")
        new = materialise(_confirm(tried, sets, percent), "confirmed")
        links = links.unionByName(new.select("a", "b"))
        joined = connected_components(new.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        moved = open_buckets.join(joined.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left")
        open_buckets = materialise(_unsettled(moved.select("key", "doc", "n", "size", F.coalesce("c", "component").alias("component"))), "open")
        if new.count() < FAIR * tried.count():
            break
    if not open_buckets.isEmpty():
        links = links.unionByName(_settled(open_buckets, sets, percent))
    label = connected_components(links.unionByName(copies))
    out = found.select("doc_id", "n_shingles").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _near(n: str, m: str, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _unsettled(labelled: DataFrame) -> DataFrame:
    """key, doc, n, size, component of the members of buckets that span several components, with the bucket's main component, its shingles
    (total) and those outside the main component (rest)."""
    by_component = labelled.groupBy("key", "component").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max("size").alias("size"))
    main = F.max(F.struct("k", "component", "n"))
    spread = by_component.groupBy("key").agg(F.count("*").alias("parts"), main.alias("m"), F.sum("n").alias("total"), F.max("size").alias("size")).where("parts > 1")
    spread = _for_each_portion(spread.select("key", F.col("m.component").alias("main"), "total", (F.col("total") - F.col("m.n")).alias("rest"), "size"), "size").drop("size")
    return labelled.withColumn("portion", _portion(F.col("doc"), F.col("size"))).join(spread, ["key", "portion"]).drop("portion")


def _held_against_a_hub(large: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b, size, ca, cb) of a hub that a hash draws in each bucket and the members of other components."""
    hub = F.min(F.struct(F.xxhash64("doc", F.lit(100 + turn)), "doc", "n", "component"))
    hubs = _for_each_portion(large.groupBy("key").agg(hub.alias("h"), F.max("size").alias("size")), "size").select("key", "portion", F.col("h.doc").alias("a"), F.col("h.n").alias("hub_n"), F.col("h.component").alias("ca"))
    joined = large.withColumn("portion", _portion(F.col("doc"), F.col("size"))).join(hubs, ["key", "portion"])
    pairs = joined.where((F.col("component") != F.col("ca")) & _near("n", "hub_n", percent))
    return pairs.groupBy("a", F.col("doc").alias("b")).agg(F.max("size").alias("size"), F.first("ca").alias("ca"), F.first("component").alias("cb"))


def _settled(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact links across components: the members, and those outside the main component once more as drivers, are dealt to blocks of
    bounded size; every block of drivers meets every block of members in a group."""
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK_SHINGLES)).cast("int")
    place = lambda seed, n: F.pmod(F.xxhash64("doc", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = buckets.withColumn("_p", blocks("total")).withColumn("_q", blocks("rest"))
    members = own.select("key", "doc", "component", place(3, F.col("_p")).alias("p"), every(F.col("_q")).alias("q"), F.lit(False).alias("driver"))
    drivers = own.where("component <> main").select("key", "doc", "component", every(F.col("_p")).alias("p"), place(4, F.col("_q")).alias("q"), F.lit(True).alias("driver"))
    met = members.unionByName(drivers).join(sets, "doc")
    return met.groupBy("key", "p", "q").applyInPandas(_settle(percent), "a long, b long").distinct()


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group of near-duplicates: the one with the smallest doc_id. Of rows that repeat a
    doc_id one stays, that with the smallest text, null before others; rows without doc_id stay."""
    found = materialise(components(docs, shingle, percent), "components")
    mark = f"_{uuid.uuid4().hex}"  # clashes with no column of docs
    dropped = found.where("not kept").select(F.col("doc_id").alias(mark)).distinct().hint("merge")  # grows with the corpus: never broadcast
    out = docs.join(dropped, docs["doc_id"] == F.col(mark), "left_anti")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(mark))
    if repeated.isEmpty():
        return out
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    once = out.join(repeated, out["doc_id"] == F.col(mark), "left_semi").withColumn(mark, nth).where(F.col(mark) == 1).drop(mark)
    return out.join(repeated, out["doc_id"] == F.col(mark), "left_anti").unionByName(once)


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    from assetgraph.llm.jobs import table

    return components(table(spark, sf_dir, "documents"), shingle=2)


#: All pairs that share a shingle, on whole sets; labels then spread along the links.
ORACLE = f"""
with recursive texts as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
grams as (select doc_id, len(w) as n, case when len(w) = 1 then [w[1]] when len(w) > 1 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) else [] end as g from texts),
sized as (select doc_id, len(g) as n_shingles from grams),
flat as (select distinct doc_id, unnest(g) as s from grams),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from flat a join flat b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sized x on x.doc_id = a join sized y on y.doc_id = b where 100 * c >= {PERCENT} * (x.n_shingles + y.n_shingles - c)),
both_ways as (select a as u, b as v from links union all select b, a from links),
reach as (select u, u as v from both_ways union select r.u, l.v from reach r join both_ways l on l.u = r.v),
label as (select u as doc_id, min(v) as component from reach group by 1)
select doc_id, cast(n_shingles as bigint) as n_shingles, coalesce(component, doc_id) as component_id, coalesce(component, doc_id) = doc_id as kept from sized left join label using (doc_id)"""
