"""Benchmark decontamination: a BM25 inverted index of the test items with block maxima; every training passage is a query.

Scores are divided by the item's score for itself, so they say which weight of the item's terms the passage has. Passages
are two neighbouring cells of as many words as the longest item has, so that a whole copy lies in one passage.

Retrieval is block-max WAND: items stand in blocks; a block's maxima bound what any of its items can reach. First all
passages of a block of texts are bounded at once, block by block; terms in many items are bounded together by what they can add
to an item at most. Passages whose bound reaches the block's least threshold go on to the pivot loop, which skips items by the sums
of term maxima and scores the others exactly. Every item above its threshold is retrieved.

A retrieved item is a leak if at least 80 % of its five-word shingles stand in the passage (question and answer
together), and at least `answer_overlap` of the answer's words. An item's threshold follows from the 80 %: a term is missing only
where all shingles that hold it are, so spreading its weight over these shingles bounds what the missing fifth can weigh. No
passage that verification would accept lies below it.

The index is broadcast in slices, bounded in items and in bytes; long items have slices of their own, so that they don't widen the passages of
short ones. Defined results: null and empty items are never found; items with fewer than five words count as one shingle; null and empty
texts have no leaks; a null doc_id is returned as null; repeated rows are reported once for each distinct doc_id and item, with the figures
of the one passage that has the most of the item. Empty tables: no leaks. Further columns are not looked at (`find_leaks`) or stay (`drop_leaks`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetgraph.llm.jobs import bounded, doc_texts
from assetgraph.llm.plainwords import code_points, plain_words
from assetgraph.llm.textvec import blocks, mix, ngram_hash

K1, B = 1.2, 0.75
OVERLAP = 0.8
ANSWER_OVERLAP = 0.5
SHINGLE = 5
#: Items and bytes of their texts in a slice; an item with more bytes is a slice of its own. Items of LONG bytes don't share one with shorter ones.
SLICE_ITEMS = 20_000
SLICE_BYTES = 8 << 20
LONG = 1 << 16
BLOCK_ITEMS = 4
#: What terms in many items may add to an item while they are bounded together.
COMMON_SHARE = 0.25

_U = np.uint64
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def answer_start(text: str) -> int:
    """Where the answer begins: the last line or sentence of the item; at the end if there is only one."""
    last = None
    for m in _SENTENCE.finditer(text.rstrip()):
        last = m
    return last.end() if last else len(text)


def _shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    if len(words) < n:
        return mix(np.bitwise_xor.reduce(mix(words + np.arange(len(words), dtype=_U)), keepdims=True)) if len(words) else np.zeros(0, _U)
    return np.unique(ngram_hash(words, np.array([0, len(words)]), n)[0])


def threshold(words: np.ndarray, weights: dict[int, float], overlap: float = OVERLAP) -> float:
    """The least weight of an item's terms in a passage that has `overlap` of its shingles. weights: of each word, 1 in all."""
    if len(words) < SHINGLE:
        return 1.0
    grams = ngram_hash(words, np.array([0, len(words)]), SHINGLE)[0]
    distinct, back = np.unique(grams, return_inverse=True)
    may_miss = len(distinct) - int(np.ceil(overlap * len(distinct) - 1e-9))
    terms, place = np.unique(words, return_inverse=True)
    pairs = np.unique(np.concatenate([back * len(terms) + place[k : k + len(grams)] for k in range(SHINGLE)]))
    gram, term = pairs // len(terms), pairs % len(terms)
    share = np.array([weights[t] for t in terms.tolist()]) / np.bincount(term, minlength=len(terms))
    lost = np.sort(np.bincount(gram, share[term], len(distinct)))[::-1][:may_miss].sum()
    return float(max(0.0, 1.0 - lost))


@dataclass
class Index:
    """Block postings of a term t: block[block_at[t]:block_at[t + 1]] with block_max; its items stand in by_block."""

    ids: list
    terms: np.ndarray
    lookup: np.ndarray
    common: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    common_bound: np.ndarray
    cell: int
    words: list[np.ndarray]
    shingles: list[np.ndarray]
    answers: list[np.ndarray]
    thresholds: np.ndarray
    block_threshold: np.ndarray
    #: For each term, by block: block maximum, items and impacts.
    by_block: list[dict[int, tuple[float, list[int], list[float]]]]

    def term_ids(self, hashes: np.ndarray) -> np.ndarray:
        """The term of each word, or -1."""
        at = self.lookup[(hashes >> _U(44)).astype(np.int64)]
        out = np.full(len(hashes), -1, np.int64)
        some = np.flatnonzero(at)
        found = np.minimum(np.searchsorted(self.terms, hashes[some]), len(self.terms) - 1)
        hit = self.terms[found] == hashes[some]
        out[some[hit]] = found[hit]
        return out

    def bounded(self, terms: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs whose bound reaches the threshold; passage c is cells c and c + 1."""
        n_blocks = len(self.common_bound)
        rare = (terms >= 0) & ~self.common[terms]
        t, c = terms[rare], cell[rare]
        size = self.block_at[t + 1] - self.block_at[t]
        at = np.repeat(self.block_at[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key, back = np.unique(np.repeat(c, size) * n_blocks + self.block[at], return_inverse=True)
        total = np.bincount(back, self.block_max[at], len(key))
        after = np.searchsorted(key, key + n_blocks)
        after_ok = (after < len(key)) & (key[np.minimum(after, len(key) - 1)] == key + n_blocks) if len(key) else np.zeros(0, bool)
        own = total + np.where(after_ok, total[np.minimum(after, len(key) - 1)], 0) if len(key) else total
        before = np.searchsorted(key, key - n_blocks)
        alone = ~((before < len(key)) & (key[np.minimum(before, len(key) - 1)] == key - n_blocks)) & (key >= n_blocks) if len(key) else np.zeros(0, bool)
        # and the passages whose first cell holds no rare term of the block
        key, own = np.concatenate([key, key[alone] - n_blocks]), np.concatenate([own, total[alone]])
        good = own + self.common_bound[key % n_blocks] >= self.block_threshold[key % n_blocks] - 1e-9
        return key[good] // n_blocks, key[good] % n_blocks

    def retrieve(self, terms: np.ndarray, in_blocks: list[int]) -> list[tuple[int, float]]:
        """WAND within each of the given blocks: items whose score for the distinct terms of a passage reaches their threshold."""
        own = [self.by_block[t] for t in set(terms[terms >= 0].tolist())]
        found = []
        for block in in_blocks:
            lists = [x[block] for x in own if block in x]
            least = self.block_threshold[block] - 1e-9
            if sum(x[0] for x in lists) < least:  # the block maxima of distinct terms
                continue
            cursors = [[0, items, impacts, bound] for bound, items, impacts in lists]
            while cursors:
                cursors.sort(key=lambda x: x[1][x[0]])
                total, pivot = 0.0, None
                for x in cursors:
                    total += x[3]
                    if total >= least:
                        pivot = x[1][x[0]]
                        break
                if pivot is None:
                    break
                if cursors[0][1][cursors[0][0]] == pivot:
                    score = 0.0
                    for x in cursors:
                        if x[1][x[0]] == pivot:
                            score += x[2][x[0]]
                            x[0] += 1
                    if score >= self.thresholds[pivot] - 1e-9:
                        found.append((pivot, score))
                else:
                    for x in cursors:
                        while x[0] < len(x[1]) and x[1][x[0]] < pivot:
                            x[0] += 1
                cursors = [x for x in cursors if x[0] < len(x[1])]
        return found


def build_index(items: list[tuple[object, str | None]], overlap: float = OVERLAP) -> Index | None:
    """items: (id, text). Items without words are left out; None if none is left. overlap: what a leak has of an item at least."""
    w = plain_words(pa.array([t or "" for _, t in items], pa.string()))
    at = code_points(w)
    rows = [(i, w.hashes[w.of[k] : w.of[k + 1]], t or "", at[w.starts[w.of[k] : w.of[k + 1]]] - at[w.offsets[k]]) for k, (i, t) in enumerate(items) if w.of[k + 1] > w.of[k]]
    if not rows:
        return None
    rows.sort(key=lambda r: len(r[1]))
    ids, tokens = [r[0] for r in rows], [r[1] for r in rows]
    answers = [h[starts >= answer_start(text)] for _, h, text, starts in rows]
    size = np.array([len(t) for t in tokens])
    item = np.repeat(np.arange(len(rows)), size)
    terms, term = np.unique(np.concatenate(tokens), return_inverse=True)
    pair, tf = np.unique(term * len(rows) + item, return_counts=True)
    term, item = pair // len(rows), pair % len(rows)
    df = np.bincount(term, minlength=len(terms))
    idf = np.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / size.mean()))
    impact /= np.bincount(item, impact, len(rows))[item]
    at = np.concatenate([[0], np.cumsum(df)])
    common, used = np.zeros(len(terms), bool), np.zeros(len(rows))
    for t in np.argsort(-df, kind="stable"):
        if df[t] <= 8:
            break
        own = slice(at[t], at[t + 1])
        if (used[item[own]] + impact[own]).max() <= COMMON_SHARE:
            common[t] = True
            used[item[own]] += impact[own]
    n_blocks = -(-len(rows) // BLOCK_ITEMS)
    common_bound = np.zeros(n_blocks)
    np.maximum.at(common_bound, np.arange(len(rows)) // BLOCK_ITEMS, used)
    block_pair, back = np.unique(term * n_blocks + item // BLOCK_ITEMS, return_inverse=True)
    block_max = np.zeros(len(block_pair))
    np.maximum.at(block_max, back, impact)
    by_block: list[dict[int, tuple[float, list[int], list[float]]]] = [{} for _ in terms]
    for t, i, w in zip(term.tolist(), item.tolist(), impact.tolist(), strict=True):
        top, items, impacts = by_block[t].get(i // BLOCK_ITEMS, (0.0, [], []))
        by_block[t][i // BLOCK_ITEMS] = (max(top, w), [*items, i], [*impacts, w])
    lookup = np.zeros(1 << 20, bool)
    lookup[(terms >> _U(44)).astype(np.int64)] = True
    block_at = np.concatenate([[0], np.cumsum(np.bincount(block_pair // n_blocks, minlength=len(terms)))])
    weights: list[dict[int, float]] = [{} for _ in rows]
    for t, i, w in zip(terms[term].tolist(), item.tolist(), impact.tolist(), strict=True):
        weights[i][t] = w
    thresholds = np.array([threshold(x, w, overlap) for x, w in zip(tokens, weights, strict=True)])
    block_threshold = np.full(n_blocks, np.inf)
    np.minimum.at(block_threshold, np.arange(len(rows)) // BLOCK_ITEMS, thresholds)
    return Index(ids, terms, lookup, common, block_at, block_pair % n_blocks, block_max, common_bound, int(size.max()), tokens, [_shingles(t) for t in tokens], answers, thresholds, block_threshold, by_block)


def leaks(index: Index, column: pa.Array, overlap: float = OVERLAP, answer_overlap: float = ANSWER_OVERLAP) -> list[tuple[int, object, float, float, float]]:
    """(row, item id, score, overlap, answer overlap) of the verified leaks of a block of texts."""
    w = plain_words(column)
    n_words = np.diff(w.of)
    if not len(w.hashes):
        return []
    text = np.repeat(np.arange(len(n_words)), n_words)
    cells = np.maximum(-(-n_words // index.cell), 1) + 1  # an empty cell after each text keeps passages apart
    first = np.cumsum(cells) - cells
    cell = first[text] + (np.arange(len(text)) - w.of[:-1][text]) // index.cell
    terms = index.term_ids(w.hashes)
    passage, block = index.bounded(terms, cell)
    if not len(passage):
        return []
    order = np.argsort(passage, kind="stable")
    passage, block = passage[order], block[order]
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    of_text = np.repeat(np.arange(len(n_words)), cells)
    distinct, cut = np.unique(passage, return_index=True)
    for p, lo, hi in zip(distinct.tolist(), cut.tolist(), [*cut[1:].tolist(), len(passage)], strict=True):
        row = int(of_text[p])
        begin = int(w.of[row] + (p - first[row]) * index.cell)
        end = int(min(w.of[row + 1], begin + 2 * index.cell))
        hashes = w.hashes[begin:end]
        own = None
        for item, score in index.retrieve(terms[begin:end], block[lo:hi].tolist()):
            own = own if own is not None else (_shingles(hashes) if len(hashes) >= SHINGLE else hashes)
            goal = index.shingles[item]
            if len(index.words[item]) < SHINGLE:
                n = len(index.words[item])
                share = float(any(np.array_equal(hashes[k : k + n], index.words[item]) for k in range(len(hashes) - n + 1)))
            else:
                share = float(np.isin(goal, own).mean())
            answer = index.answers[item]
            answered = float(np.isin(answer, hashes).mean()) if len(answer) else share
            if share >= overlap - 1e-9 and answered >= answer_overlap - 1e-9:
                best[row, item] = max(best.get((row, item), (0.0, 0.0, 0.0)), (share, answered, score))
    return [(row, index.ids[item], score, share, answered) for (row, item), (share, answered, score) in sorted(best.items())]


def slices(classes: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(least class, last class, number of slices) of neighbouring classes of lengths. classes: (floor(log2(bytes)), items, bytes), ascending."""
    out: list[list[int]] = []
    for c, items, size in classes:
        if out and out[-1][2] + items <= SLICE_ITEMS and out[-1][3] + size <= SLICE_BYTES and not (out[-1][0] < LONG.bit_length() - 1 <= c):
            out[-1][1:] = [c, out[-1][2] + items, out[-1][3] + size]
        else:
            out.append([c, c, items, size])
    return [(a, b, max(1, -(-items // SLICE_ITEMS), -(-size // SLICE_BYTES))) for a, b, items, size in out]


def indexes(benchmark: DataFrame, key: str = "item_id", text: str = "text", overlap: float = OVERLAP) -> Iterator[Index]:
    """One index for each slice of the items."""
    items = benchmark.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t <> ''")
    items = items.withColumn("n", F.octet_length("t")).withColumn("c", F.floor(F.log2("n")).cast("int"))
    classes = items.groupBy("c").agg(F.count("*").alias("items"), F.sum("n").alias("bytes")).orderBy("c").collect()  # a row for each power of two
    for first, last, n in slices([tuple(r) for r in classes]):
        for s in range(n):
            own = items.where(F.col("c").between(first, last) & (F.pmod(F.xxhash64("k"), F.lit(n)) == s)).orderBy("k", "t").select("k", "t").collect()
            if index := build_index([(r["k"], r["t"]) for r in own], overlap):
                yield index


SCHEMA = "doc_id long, item_id long, score double, overlap double, answer_overlap double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, answer_overlap: float = ANSWER_OVERLAP) -> DataFrame:
    """doc_id, item_id, score, overlap, answer_overlap of every document and item that it holds."""
    spark, out = docs.sparkSession, None
    for index in indexes(benchmark, overlap=overlap):
        shared = spark.sparkContext.broadcast(index)  # at most SLICE_ITEMS items of SLICE_BYTES

        def run(batches, shared=shared):
            for batch in batches:
                for b in blocks(batch, "text"):
                    found = leaks(shared.value, b.column("text"), overlap, answer_overlap)
                    ids = b.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([f[1] for f in found], pa.int64()), *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4))], ["doc_id", "item_id", "score", "overlap", "answer_overlap"])

        found = doc_texts(docs).mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    best = F.max(F.struct("overlap", "answer_overlap", "score")).alias("best")  # of repeated rows, and of items that repeat an id
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *(f"best.{c}" for c in ("score", "overlap", "answer_overlap")))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, answer_overlap: float = ANSWER_OVERLAP) -> DataFrame:
    """docs without the rows that hold a benchmark item; columns stay as they are."""
    where = docs.columns.index("text")
    for index in indexes(benchmark, overlap=overlap):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for b in blocks(batch, batch.schema.names[where]):
                    keep = np.ones(b.num_rows, bool)
                    keep[[f[0] for f in leaks(shared.value, b.column(where), overlap, answer_overlap)]] = False
                    yield b.filter(pa.array(keep))

        docs = bounded(docs).mapInArrow(run, docs.schema)
    return docs


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    from assetgraph.llm.jobs import table

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
