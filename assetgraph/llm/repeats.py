"""Substring dedup by line hashing, and by passages inside lines.

Units are named by a 64-bit digest of their words in lower case without outer punctuation, and there are two kinds of them. A line is a unit however
short it is. A passage is the shortest run of whole sentences that begins at a sentence and has at least `min_words` words; it may end
in another line, as shared text also begins and ends inside lines. Digests are grouped over the whole corpus; of equal units the occurrence with
the smallest (doc_id, text, place) stays and the others are removed, so whatever is removed stands, as a line or as a passage, earlier in the ranked corpus, and a line
that occurs once goes only as far as passages of it occur elsewhere. Where a repeat overlaps the occurrence that stays, only what lies beyond it is removed.
Removed units of a document that touch are one span, with its offsets in the original text. Sentences of more than 16 words are cut at
words that depend on the words alone, so that a passage without a stop is found inside different lines, but for a few words at its ends.

A digest's occurrences are never gathered: one aggregation finds the first and the count, one join marks the rest. Digests
that hold more than a thousandth of all units (so at most a thousand) are joined by broadcast, the others by shuffle.

Defined results: null and empty texts have no units. A null doc_id has no rank and takes no part. Rows that repeat a doc_id
and its text are one document; their equal units are the same occurrence. Different texts of one doc_id are told apart by
text_digest, which orders them too. Very long texts are units of a block of their own. An empty table gives no rows; columns beside doc_id and text
are not looked at. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetgraph.llm.jobs import bounded, doc_texts, joined_by, map_blocks, materialise, written
from assetgraph.llm.plainwords import code_points, plain_words, run_hash, units
from assetgraph.llm.textvec import mix

#: Words from which a run of sentences is a passage and no chance.
MIN_WORDS = 20
_PASSAGE = np.uint64(0x5A17)


def _units(passages: bool, min_words: int):
    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        w = plain_words(block.column("text"))
        lines = units(w, False)
        first, last, digest = lines.first, lines.last, lines.hashes
        if passages and len(w.starts):
            s = units(w, True)
            whole = np.searchsorted(s.last, s.first + min_words)  # the sentence that completes the passage
            of = np.searchsorted(w.of, s.first, "right")
            within = whole < len(s.last)
            within[within] = s.last[whole[within]] <= w.of[of[within]]
            begin, end = s.first[within], s.last[whole[within]]
            first, last = np.concatenate([first, begin]), np.concatenate([last, end])
            digest = np.concatenate([digest, mix(run_hash(w, begin, end) ^ _PASSAGE)])
        text = np.searchsorted(w.of, first, "right") - 1
        at = code_points(w)
        base = at[w.offsets[:-1]][text]
        start = at[w.starts[first]] - base if len(first) else np.zeros(0, np.int64)
        end = at[w.ends[last - 1]] - base if len(first) else np.zeros(0, np.int64)
        own = w.of[text]
        return pa.RecordBatch.from_arrays(
            [pa.array(digest.view(np.int64)), *(block.column(c).take(pa.array(text)) for c in ("doc_id", "text_digest")), *(pa.array(x.astype(np.int32)) for x in (first - own, last - own, start, end))],
            ["digest", "doc_id", "text_digest", "first", "last", "start", "end"],
        )

    return run


def occurrences(docs: DataFrame, passages: bool = True, min_words: int = MIN_WORDS) -> DataFrame:
    """digest, doc_id, text_digest, first and last (words, exclusive), start, end of every line and passage of every ranked document."""
    texts = doc_texts(docs).where("doc_id is not null").withColumn("text_digest", F.xxhash64("text"))
    return map_blocks(texts, "text", _units(passages, min_words), "digest long, doc_id long, text_digest long, first int, last int, start int, end int")


def repeated_units(docs: DataFrame, passages: bool = True, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_digest, first, last, start, end, kept_doc_id: what each later occurrence of a unit has beyond the one that stays."""
    found = materialise(occurrences(docs, passages, min_words), "units")
    place = ("doc_id", "text_digest", "first", "last", "end")
    groups = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("keep")).where("n > 1")
    groups = written(groups.select("digest", "n", *(F.col(f"keep.{c}").alias(f"kept_{c}") for c in place)), "repeated")
    marked = joined_by(found, groups, "digest", "n")
    same = (F.col("doc_id") == F.col("kept_doc_id")) & (F.col("text_digest") == F.col("kept_text_digest"))
    beyond = lambda c, kept: F.when(same, F.greatest(c, kept)).otherwise(F.col(c)).alias(c)
    rest = marked.select("doc_id", "text_digest", beyond("first", "kept_last"), "last", beyond("start", "kept_end"), "end", "kept_doc_id").where("first < last")
    return rest.groupBy("doc_id", "text_digest", "first", "last").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("kept_doc_id").alias("kept_doc_id"))


def repeated_spans(docs: DataFrame, passages: bool = True, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_digest, start, end, n_units, n_words, kept_doc_id: the spans to be removed, and where the first unit of each stays."""
    order = Window.partitionBy("doc_id", "text_digest").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = repeated_units(docs, passages, min_words).withColumn("opens", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1)))
    runs = opens.withColumn("run", F.sum("opens").over(order))
    return runs.groupBy("doc_id", "text_digest", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), (F.max("last") - F.min("first")).alias("n_words"), F.min_by("kept_doc_id", F.struct("first", "last")).alias("kept_doc_id")
    ).drop("run")


def remove_spans(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """docs without the spans. The spans of one text travel together; documents without spans stay as they are."""
    doc, digest, cuts = (f"_{x}_{uuid.uuid4().hex}" for x in ("doc", "text", "spans"))  # clash with no column of docs
    own = spans.groupBy(F.col("doc_id").alias(doc), F.col("text_digest").alias(digest)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts))
    names = docs.columns
    joined = docs.join(own, (docs["doc_id"] == own[doc]) & (F.xxhash64(docs[text]) == own[digest]), "left").select(*(docs[c] for c in names), cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = names.index(text)
        for b in batches:
            out = []
            for t, cut in zip(b.column(i).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if t and cut:
                    at, parts = 0, []
                    for c in cut:
                        parts.append(t[at : max(at, c["start"])])
                        at = max(at, c["end"])
                    t = "".join([*parts, t[at:]])
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, b.schema.field(i).type) if k == i else b.column(k) for k in range(len(names))], names)

    return bounded(joined).mapInArrow(run, docs.schema)


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    from assetgraph.llm.jobs import table

    return repeated_spans(table(spark, sf_dir, "documents"))
