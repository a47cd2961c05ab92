"""Toxicity by a weighted lexicon matched with Aho-Corasick on folded text.

Folding: lower case, homoglyphs to Latin letters, digit and symbol substitutions, `l`/`1`/`|` to one skeleton
letter, other punctuation to spaces. Lexicon entries are beginnings of folded words with log-odds weights; they are learned
from at most `SAMPLE_ROWS` labelled rows and `SAMPLE_BYTES` bytes of their texts, and nothing else bounds them. Exception phrases (an entry
within two words that only harmless texts have) mask the hits inside them. The score is a logistic function of the hits' weights, normalised
by the text's length.

Defined results: null and empty texts have no hits and take the score of a text without hits. Null doc_ids stay null and count
as held out only if their crc32 is divisible, which it is not (null: false). Without labels the lexicon is empty and every score is the prior.
Repeated rows each get their score; an empty table has no rows; further columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetgraph.llm.jobs import doc_texts, map_blocks, sample_texts

#: The bounds on the labelled rows that lexicon and weights are learned from.
SAMPLE_ROWS = 16000
SAMPLE_BYTES = 64 << 20
MIN_TOXIC, MIN_LOG_ODDS = 4, 2.0
PREFIX = (3, 14)

# Letters of other scripts that look like Latin ones, and usual substitutions.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ɡ": "g", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ı": "i", "ℓ": "l", "ⅼ": "l", "ⅰ": "i",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}

_TABLE = {chr(c): " " for c in range(128) if not chr(c).isalnum()}
_TABLE |= {chr(c): "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_TABLE |= {chr(c): chr(c + 32) for c in range(65, 91)}
_TABLE |= {k: SUBSTITUTIONS.get(v, v) for k, v in HOMOGLYPHS.items()}
_TABLE |= {chr(0xFF21 + k): chr(97 + k) for k in range(26)} | {chr(0xFF41 + k): chr(97 + k) for k in range(26)}
_TABLE |= SUBSTITUTIONS | {"L": "i"}
_FOLD = str.maketrans(_TABLE)
_ASCII = bytes(ord(_TABLE.get(chr(c), chr(c))) if c < 128 else c for c in range(256))
_OTHER_SCRIPT = re.compile("[­ıɐ-ʯͰ-ԯ​-‍⁠℀-↏﻿＀-￯]")
_MARKED_SYMBOLS = re.compile(r"(?<=\w)[!|$@]+(?!\w)|(?<!\w)[!|$@]+(?=\W|$)")


def fold(text: str) -> str:
    """Folded text with a space before it. Symbols stand for letters only before or between word characters."""
    if "!" in text or "|" in text or "$" in text or "@" in text:
        text = _MARKED_SYMBOLS.sub(" ", text)
    if _OTHER_SCRIPT.search(text):
        return " " + text.lower().translate(_FOLD)
    return " " + text.encode().translate(_ASCII).decode().lower()


@dataclass(frozen=True)
class Lexicon:
    """entries: beginnings of folded words, each with a space before it. exceptions: folded phrases that mask hits."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = ()
    calibration: tuple[float, ...] = field(default=(-2.0, 1.0, 0.0))

    @lru_cache(maxsize=1)  # noqa: B019  one per worker
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for e, w in self.entries.items():
            found.add_word(e, (len(e), w))
        for e in self.exceptions:
            found.add_word(e, (len(e), None)) if e not in self.entries else None
        if len(found):
            found.make_automaton()
        return found if len(found) else None

    def __hash__(self) -> int:
        return id(self)

    def hits(self, folded: str) -> list[tuple[int, str, float]]:
        """(start, entry, weight): the longest entry at each word, outside exception phrases."""
        found = self.automaton()
        if found is None:
            return []
        best: dict[int, tuple[int, float]] = {}
        masked: list[tuple[int, int]] = []
        for end, (size, weight) in found.iter(folded):
            start = end - size + 1
            if weight is None:
                masked.append((start, end))
            elif size > best.get(start, (0, 0.0))[0]:
                best[start] = (size, weight)
        # starts and masks both ascend: a hit is masked if the furthest end of the masks that begin before it reaches it
        masked.sort()
        out, k, reach = [], 0, -1
        for s, (n, w) in sorted(best.items()):
            while k < len(masked) and masked[k][0] <= s:
                reach = max(reach, masked[k][1])
                k += 1
            if s > reach:
                out.append((s, folded[s : s + n], w))
        return out

    def measures(self, text: str) -> tuple[float, float]:
        """The summed weights of distinct hits, and of all hits per hundred words."""
        folded = fold(text)
        hits = self.hits(folded)
        if not hits:
            return 0.0, 0.0
        return sum({e: w for _, e, w in hits}.values()), sum(w for _, _, w in hits) / (1 + folded.count(" ") / 100)

    def score(self, measures: np.ndarray) -> np.ndarray:
        b, w1, w2 = self.calibration
        return 1 / (1 + np.exp(-np.clip(b + measures @ np.array([w1, w2]), -60, 60)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _folded_words(block: pa.RecordBatch) -> pa.RecordBatch:
    """Distinct folded words of each text, with the label."""
    toxic, words = [], []
    for text, label in zip(block.column("text").to_pylist(), block.column("toxic").to_pylist(), strict=True):
        own = set(fold(text or "").split())
        words += own
        toxic += [label] * len(own)
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], ["word", "toxic"])


def _phrases(entries: dict[str, float]):
    """Two-word phrases around entries, with the label."""
    lexicon = Lexicon(entries)

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        phrases, toxic = [], []
        for text, label in zip(block.column("text").to_pylist(), block.column("toxic").to_pylist(), strict=True):
            folded = fold(text or "")
            own = set()
            for start, _, _ in lexicon.hits(folded):  # a hit starts at the space before its word
                end = folded.find(" ", start + 1)
                after = folded.find(" ", end + 1) if end > 0 else -1
                if after > 0:
                    own.add(folded[start : after + 1])
                before = folded.rfind(" ", 0, start)
                if 0 <= before < start - 1 and end != start + 1:
                    own.add((folded[before:end] if end > 0 else folded[before:]) + " ")
            phrases += own
            toxic += [label] * len(own)
        return pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(toxic, pa.int32())], ["phrase", "toxic"])

    return run


def _telling(rows: list) -> dict[str, float]:
    """Drops a beginning that one longer by a letter covers, and one where a shorter one that stays says as much."""
    toxic = {r["prefix"]: r["t"] for r in rows}
    covered = {p[:-1] for p, t in toxic.items() if t >= 0.9 * toxic.get(p[:-1], 1 << 60)}
    kept: dict[str, float] = {}
    for prefix, odds in sorted(((r["prefix"], r["odds"]) for r in rows if r["prefix"] not in covered), key=lambda x: (len(x[0]), x[0])):
        if not any(kept.get(prefix[:n], -9.0) >= odds - 0.4 for n in range(2, len(prefix))):
            kept[prefix] = odds
    return {f" {p}": round(w, 6) for p, w in kept.items()}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    x1 = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x1.shape[1])
    for _ in range(60):  # Newton with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + 0.5 * np.eye(len(w))
        w += np.linalg.solve(h, x1.T @ (y - p) - 0.5 * w)
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = (), size: int = SAMPLE_BYTES) -> Lexicon:
    """labels: doc_id and toxic (0 or 1). Rows that are held out are never read."""
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id"))
    texts = sample_texts(docs, rated, sample, size).persist()  # at most `sample` rows and `size` bytes
    try:
        counts = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
        n1, n0 = counts.get(1, 0), counts.get(0, 0)
        if not n1 or not n0:
            return Lexicon({}, tuple(fold(e).rstrip() + " " for e in exceptions), (float(np.log((n1 + 0.5) / (n0 + 0.5))), 0.0, 0.0))
        by_word = map_blocks(texts, "text", _folded_words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        prefixes = by_word.select(F.explode(F.expr(f"transform(sequence({PREFIX[0]}, greatest({PREFIX[0]}, least({PREFIX[1]}, length(word)))), n -> substring(word, 1, n))")).alias("prefix"), "t", "c").where(F.length("prefix") >= PREFIX[0])
        odds = F.log(((F.col("t") + 0.2) / (n1 + 0.4)) / ((F.col("c") + 0.2) / (n0 + 0.4)))
        rows = (
            prefixes.groupBy("prefix").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).withColumn("odds", odds)
            .where((F.col("t") >= MIN_TOXIC) & (F.col("odds") >= MIN_LOG_ODDS)).collect()
        )
        entries = _telling(rows)
        harmless = (
            map_blocks(texts, "text", _phrases(entries), "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
            .where("t = 0 and c >= 3").orderBy("phrase").collect()
        )
        lexicon = Lexicon(entries, tuple([*(fold(e).rstrip() + " " for e in exceptions), *(r["phrase"] for r in harmless)]))

        def run(block: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([lexicon.measures(t or "") for t in block.column("text").to_pylist()])
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), block.column("toxic")], ["a", "b", "toxic"])

        measured = map_blocks(texts, "text", run, "a double, b double, toxic int").toPandas().sort_values(["a", "b", "toxic"])
        fitted = _logistic(measured[["a", "b"]].to_numpy(), measured["toxic"].to_numpy().astype(float))
        return Lexicon(lexicon.entries, lexicon.exceptions, fitted)
    finally:
        texts.unpersist()


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the sample that it was learned from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from assetgraph.llm.textvec import blocks

        lexicon = shared.value
        for batch in batches:
            for b in blocks(batch, "text"):
                found = np.array([lexicon.measures(t or "") for t in b.column("text").to_pylist()])
                score = lexicon.score(found)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    from assetgraph.llm.jobs import table

    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels"))).withColumn("held_out", held_out("doc_id"))
