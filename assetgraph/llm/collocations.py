"""Phrase collocations by SETM: sorted occurrence relations, merge-joined by piece and adjacent position, one length after the other.

Texts are dealt to portions of about PORTION_BYTES within the task that reads them, by language. A portion's occurrence relation, one entry for each word
with its place, sorted by place, is written once to the shared folder. Places of neighbours in one piece differ by 1, those across a piece's
end by more, so a place stands for piece and position together, and the relation of length k + 1 is the merge join of that of
length k with itself at place + 1. What leaves a portion is one row for each distinct phrase and its count. Spark sums these over
all portions, keeps the phrases that are frequent, and sends each portion those that it has: the portion's relation is semi-joined with
them before the next length. So occurrences are never shuffled, the most frequent word is one row for each portion, and a task
holds one portion.

Words are compared as strings; in longer phrases they are named by the ids of the frequent words.

Defined results: a null text is empty; a null language counts as `und`. Repeated rows count as often as they stand; doc_id isn't looked at.
Texts longer than a portion are portions of their own. An empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetgraph.llm.jobs import bounded, fresh_path, table, written
from assetgraph.llm.textvec import LOWER

LEAST, LONGEST, FIRST = 10, 3, 2000
COVER = 50
SCORE = 1_000_000
PORTION_BYTES = 16 << 20
#: Portions that one task of a level may hold on the average.
PORTIONS_A_TASK = 1

# The bytes that end a piece, and those that part words.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PARTS = b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_PARTS)] = 1
_KIND[list(_ENDS)] = 2


def relation(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of the texts in order, and their places: neighbours in a piece are 1 apart, others more."""
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(texts)], pa.int64()), pc.fill_null(texts, "").cast(pa.large_string())), pa.scalar("\n", pa.large_string()))
    raw = joined.buffers()[2]
    buf = LOWER[np.frombuffer(raw, np.uint8)] if raw is not None and raw.size else np.zeros(0, np.uint8)
    kind = _KIND[buf]
    word = kind == 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
    begins, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - begins)])
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(buf[word]))
    return words.dictionary_encode(), np.arange(len(begins)) + np.searchsorted(np.flatnonzero(kind == 2), begins)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(uri: str, name: str, **columns: np.ndarray) -> None:
    """A file of the shared folder. A task that runs again writes the same columns under the same name."""
    store, root = _store(uri)
    store.create_dir(root, recursive=True)
    data = pa.table({k: pa.array(v) for k, v in columns.items()})
    with store.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_stream(out, data.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(data)


def _read(uri: str, name: str) -> list[np.ndarray]:
    store, root = _store(uri)
    with store.open_input_stream(f"{root}/{name}") as source, pa.ipc.open_stream(source) as reader:
        return [c.to_numpy() for c in reader.read_all().columns]


def _portions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, pa.Array]]:
    """Texts of one language, about `size` bytes of all languages at a time."""
    held: list[pa.RecordBatch] = []
    total = 0

    def by_language() -> Iterator[tuple[str, pa.Array]]:
        rows = pa.Table.from_batches(held).combine_chunks()
        for lang in pc.unique(rows.column("lang")).to_pylist():
            own = rows.filter(pc.equal(rows.column("lang"), lang)).column("text")
            yield lang, pa.chunked_array(own.chunks, own.type).combine_chunks()

    for batch in batches:
        bytes_ = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(bytes_):
            to = at + max(1, int(np.searchsorted(np.cumsum(bytes_[at:]), size - total, "right")))
            held.append(batch.slice(at, to - at))
            total, at = total + int(bytes_[at:to].sum()), to
            if total >= size or at < len(bytes_):
                yield from by_language()
                held, total = [], 0
    if held:
        yield from by_language()


def _words(uri: str, size: int) -> Callable:
    """Writes the relation of each portion; gives its distinct words, their codes there and counts, and all its words as a null word of code -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, (lang, texts) in enumerate(_portions(batches, size)):
            portion = part << 32 | k
            words, place = relation(texts)
            if not len(words):
                continue
            codes = words.indices.to_numpy().astype(np.int32)
            planes = codes.view(np.uint8).reshape(-1, 4)  # apart, they compress better
            _write(uri, f"{portion}-words", opens=np.diff(place, prepend=0) > 1, **{f"code{k}": np.ascontiguousarray(planes[:, k]) for k in range(4)})
            n = len(words.dictionary)
            of = pa.array(np.zeros(n + 1, np.int64))
            names = pa.concat_arrays([words.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
            counts = np.append(np.bincount(codes, minlength=n), len(codes))
            yield pa.RecordBatch.from_arrays(
                [pa.array([portion], pa.int64()).take(of), pa.array([lang]).take(of), names, pa.array(np.append(np.arange(n), -1).astype(np.int32)), pa.array(counts)],
                ["portion", "lang", "word", "code", "n"],
            )

    return run


def _numbers(codes: np.ndarray) -> np.ndarray:
    """The place of each code among the frequent ones, -1 for the others up to the largest and in the last entry, which stands for all beyond."""
    of = np.full(int(codes.max()) + 2, -1, np.int32)
    of[codes] = np.arange(len(codes))
    return of


def _frequent_words(uri: str, portion: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The relation of length 1, semi-joined with the frequent words: places and numbers. number: of each code, -1 where the word is not frequent."""
    opens, *planes = _read(uri, f"{portion}-words")
    codes = np.ascontiguousarray(np.stack(planes, axis=1)).view(np.int32).ravel()
    number = number[np.minimum(codes, len(number) - 1)]
    kept = number >= 0
    return np.cumsum(opens.astype(np.int64) + 1)[kept], number[kept].astype(np.int64)


def merge_join(place: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins a sorted relation with itself at place + 1: the places and both sides' entries. Places are distinct, so a partner is the next entry."""
    meets = np.flatnonzero(np.diff(place) == 1)
    return place[meets], left[meets], right[meets + 1]


def _pairs(uri: str) -> Callable:
    """Length 2 of a portion; writes the numbers of its frequent words for the next length."""

    def run(key: tuple, known: pa.Table) -> pa.Table:
        portion = key[0].as_py()
        known = known.sort_by("w")
        ids, codes = known.column("w").to_numpy(), known.column("code").to_numpy()
        of = _numbers(codes)
        _write(uri, f"{portion}-ids", code=codes, w=ids)
        place, number = _frequent_words(uri, portion, of)
        _, a, b = merge_join(place, number, number)
        pair, n = np.unique(a << 32 | b, return_counts=True)
        return pa.table({"portion": pa.array(np.full(len(pair), portion)), "w1": pa.array(ids[pair >> 32]), "w2": pa.array(ids[pair & 0xFFFFFFFF]), "n": pa.array(n)})

    return run


def _triples(uri: str) -> Callable:
    """Length 3 of a portion: its relation of frequent pairs, joined with itself."""

    def run(key: tuple, known: pa.Table) -> pa.Table:
        portion = key[0].as_py()
        codes, ids = _read(uri, f"{portion}-ids")
        of = _numbers(codes)
        place, number = _frequent_words(uri, portion, of)
        frequent = np.sort(np.searchsorted(ids, known.column("w1").to_numpy()) << 32 | np.searchsorted(ids, known.column("w2").to_numpy()))
        place, a, b = merge_join(place, number, number)
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(frequent, pair), len(frequent) - 1)
        kept = frequent[at] == pair
        _, first, second = merge_join(place[kept], at[kept], at[kept])
        triple, n = np.unique(first << 32 | second, return_counts=True)
        first, second = frequent[triple >> 32], frequent[triple & 0xFFFFFFFF]
        return pa.table({"w1": pa.array(ids[first >> 32]), "w2": pa.array(ids[first & 0xFFFFFFFF]), "w3": pa.array(ids[second & 0xFFFFFFFF]), "n": pa.array(n)})

    return run


def _by_portion(known: DataFrame, fn: Callable, schema: str) -> DataFrame:
    portions = known.agg(F.approx_count_distinct("portion")).first()[0]
    return known.repartition(min(20_000, max(1, portions // PORTIONS_A_TASK)), "portion").groupBy("portion").applyInArrow(fn, schema)


def _summed(partial: DataFrame, *phrase: str) -> DataFrame:
    """The rows of each portion with the phrase's total, `first` on one of them. A phrase has a row for each portion at most."""
    dealt = partial.repartition(*phrase).withColumn("id", F.monotonically_increasing_id())
    own = Window.partitionBy(*phrase)
    return dealt.withColumn("total", F.sum("n").over(own)).withColumn("w", F.min("id").over(own)).withColumn("first", F.col("id") == F.col("w"))


#: Exact in decimals, for counts below 10^15.
_SCORE = "(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast({score} as decimal(7,0))) div (cast({l} as decimal(15,0)) * cast({r} as decimal(15,0)))"


def _score(first: str, rest: str) -> Column:
    return F.expr(_SCORE.format(score=SCORE, l=first, r=rest))


def phrases(docs: DataFrame, least: int = LEAST, portion_bytes: int = PORTION_BYTES, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases that occur `least` times or more. The first: lang, phrase, a, l, r, score, w1, w2 of those of 2 words; the second the same and w3 for 3 words;
    the third: lang, n. l and r are the counts before and after the cut with the lowest score."""
    bounded(docs)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    uri = fresh_path(docs.sparkSession, "occurrences")
    uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
    words = _summed(rows.mapInArrow(_words(uri, portion_bytes), "portion long, lang string, word string, code int, n long"), "lang", "word")
    words = words.where(F.col("word").isNull() | (F.col("total") >= least)).withColumn("word", F.when(F.col("first"), F.col("word")))
    words = written(words.select("portion", "lang", "word", "code", "w", "total", "first"), "words")
    sizes = words.where("first and code < 0").select("lang", F.col("total").alias("n"))
    pairs = _by_portion(words.where("code >= 0").select("portion", "code", "w"), _pairs(uri), "portion long, w1 long, w2 long, n long")
    pairs = written(_summed(pairs, "w1", "w2").where(F.col("total") >= least).select("portion", "w1", "w2", "total", "first"), "pairs")
    triples = _by_portion(pairs.select("portion", "w1", "w2"), _triples(uri), "w1 long, w2 long, w3 long, n long")
    triples = written(triples.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("a")).where(F.col("a") >= least), "triples")
    known = words.where("first and code >= 0")
    one, two = (known.select(*(["lang"] if k == 1 else []), F.col("word").alias(f"word{k}"), F.col("w").alias(f"w{k}"), F.col("total").alias(f"f{k}")) for k in (1, 2))
    named = written(pairs.where("first").select("w1", "w2", F.col("total").alias("a")).join(one, "w1").join(two, "w2"), "named-pairs")
    of_two = named.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("f1", "f2").alias("score"), "w1", "w2")
    front = named.withColumnRenamed("a", "front")
    back = named.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("word2").alias("word3"), F.col("f2").alias("f3"), F.col("a").alias("back"))
    joined = triples.join(front, ["w1", "w2"]).join(back, ["w2", "w3"]).withColumn("s1", _score("f1", "back")).withColumn("s2", _score("front", "f3"))
    early = F.col("s1") <= F.col("s2")
    of_three = joined.select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("front")).alias("l"),
        F.when(early, F.col("back")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"), "w1", "w2", "w3",
    )
    return of_two, of_three, sizes


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, cover: int = COVER, portion_bytes: int = PORTION_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, a and phrase. A phrase of 2 words within one of 3 that has `cover` hundredths of its occurrences is left out."""
    two, three, sizes = phrases(docs, least, portion_bytes)
    inside = F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))))
    longer = three.select(inside.alias("p"), "a").groupBy("p.w1", "p.w2").agg(F.max("a").alias("longer"))
    kept = two.join(longer, ["w1", "w2"], "left").where(~F.coalesce(F.col("longer") * 100 >= F.col("a") * cover, F.lit(False)))
    columns = ("lang", "phrase", "a", "l", "r", "score")
    return _top(kept.select(*columns).unionByName(three.select(*columns)), first).join(sizes, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def _top(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each language, which are cut in portions before a language meets in one task."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    cut = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    cut = cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most).drop("part")


_PIECES = r"[.,;:!?\x0A-\x0D]"
ORACLE = f"""
with texts as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(string_split_regex(t, '{_PIECES}')) as piece from texts),
cut as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from pieces),
grams as (select lang, unnest(w) as g, 1 as k from cut union all
  select lang, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])), 2 from cut where len(w) >= 2 union all
  select lang, unnest(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3])), 3 from cut where len(w) >= 3),
f as materialized (select lang, k, g, count(*) as a from grams group by all),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by 1),
cand as materialized (select *, string_split(g, ' ') as w from f where k > 1 and a >= {LEAST}),
cuts as (select c.lang, c.k, c.g, c.w, c.a, p.c, x.a as l, y.a as r, ({SCORE}::hugeint * c.a * c.a) // (x.a::hugeint * y.a) as score from cand c join (select unnest([1, 2]) as c) p on p.c < c.k
  join f x on x.lang = c.lang and x.k = p.c and x.g = array_to_string(c.w[1 : p.c], ' ') join f y on y.lang = c.lang and y.k = c.k - p.c and y.g = array_to_string(c.w[p.c + 1 : c.k], ' ')),
best as (select * from (select *, row_number() over (partition by lang, g order by score, c) as nth from cuts) where nth = 1),
longer as (select lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as g, a from cand where k = 3),
covered as (select b.lang, b.g from best b join longer x on x.lang = b.lang and x.g = b.g and 100 * x.a >= {COVER} * b.a),
ranked as (select lang, g as phrase, a, l, r, score, row_number() over (partition by lang order by score desc, a desc, g) as rank from best anti join covered using (lang, g))
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join n using (lang) where rank <= {FIRST}"""


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
