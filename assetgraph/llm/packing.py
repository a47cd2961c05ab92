"""Concatenate and cut: token ids of all documents as one stream, cut into sequences of a fixed length.

Pass one tokenises each partition and keeps, per document, the place of its first id within the partition; the
totals per partition give by prefix sums the global place of each partition. Pass two cuts every document at the
multiples of the length. Both passes are narrow: no row is shuffled. The driver sees one number per partition.

Defined results: a null text is empty; every document ends with `eos`, so an empty one has one token. Rows that repeat a
doc_id or have none are documents of their own. The order is that of the scan's partitions. No documents: no pieces. Further columns
are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetgraph.llm.jobs import doc_texts, materialise
from assetgraph.llm.textvec import LOWER, SPACE, blocks, span_hash, text_bytes

LENGTH = 2048
EOS = 1
#: Distinct word pieces whose ids a worker remembers.
CACHE_PIECES = 1_000_000

#: Latin letters that are their own composed form and have lower cases of one letter.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+")
#: The usual printable stand-ins of byte-level BPE: printable Latin-1 as it is, the others from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_LETTER, _DIGIT, _PUNCT, _OTHER = 1, 2, 3, 4
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[:128] = _PUNCT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[ord("'")] = _OTHER
_KIND[:0x21] = _KIND[0x7F] = _OTHER
_KIND[SPACE] = 0
#: Where the tokenizer's own pattern always breaks between two neighbouring bytes.
_BREAK = np.zeros((5, 5), bool)
_BREAK[_LETTER, _PUNCT] = _BREAK[_PUNCT, _LETTER] = True
_BREAK[_DIGIT, [_LETTER, _DIGIT, _PUNCT]] = _BREAK[[_LETTER, _PUNCT], _DIGIT] = True
_BREAK = _BREAK.ravel()


# The normalisation and pre-tokenization under which pieces of words have ids of their own.
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def in_pieces(spec: dict) -> bool:
    """Whether a tokenizer's file describes one that gives the pieces of a text the ids that they have in it."""
    return spec.get("normalizer") == _NORMALISER and spec.get("pre_tokenizer") == _PRE_TOKENIZER and spec.get("model", {}).get("type") == "BPE" and not spec.get("truncation") and not spec.get("padding") and not spec["model"].get("dropout")


class PieceTokenizer:
    """Ids of a word tokenizer that drops white space: encodes each distinct word piece once and looks up the rest.

    Pieces are cut at ASCII white space and between ASCII letters, digits and punctuation (apostrophes apart), where
    the tokenizer's pre-tokenization breaks whatever stands around. Texts with added tokens are encoded whole, and so is every text
    where the tokenizer is of another kind (`in_pieces`).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.whole = not in_pieces(json.load(file))
        self.added = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.model.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._flat([e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])

    def _encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of plain letters are one pre-token and go to the model at once; others take the whole path."""
        found: list[list[int]] = []
        other: list[int] = []
        model = self.model.model
        for k, text in enumerate(texts):
            if _PLAIN.fullmatch(text):
                text = text.lower()
                if not text.isascii():
                    text = text.encode().decode("latin-1").translate(_BYTE_CHARS)
                found.append([t.id for t in model.tokenize(text)])
            else:
                found.append([])
                other.append(k)
        for k, e in zip(other, self.model.encode_batch_fast([texts[k] for k in other], add_special_tokens=False), strict=True):
            found[k] = e.ids
        return self._flat(found)

    def _flat(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), self.dtype, int(size.sum())), size

    def _learn(self, low: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = low.tobytes()
        ids, size = self._encode_pieces([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        at = len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        self.ids = np.concatenate([self.ids, ids])
        keys, at, size = np.concatenate([self.keys, keys]), np.concatenate([self.at, at]), np.concatenate([self.size, size])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[order], at[order], size[order]

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return i, self.keys[i] == keys

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts and the n + 1 offsets of each text's."""
        buf, offsets = text_bytes(column)
        n = len(offsets) - 1
        if not len(buf):
            return np.zeros(0, self.dtype), np.zeros(n + 1, np.int64)
        raw = buf.tobytes()
        if self.whole or any(a in raw for a in self.added):
            ids, size = self._encode([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return ids, np.concatenate([[0], np.cumsum(size)])
        low, kind = LOWER[buf], _KIND[buf]
        cut = np.ones(len(buf) + 1, bool)
        cut[1:-1] = _BREAK[kind[:-1] * 5 + kind[1:]] | (kind[:-1] == 0) | (kind[1:] == 0)
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        word = kind[starts] != 0
        starts, ends = starts[word], ends[word]
        keys = span_hash(low, starts, ends)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at, known = self._place(distinct)
        if not known.all():
            if len(self.keys) > CACHE_PIECES:
                self.clear()
                known[:] = False
            new = first[~known]
            self._learn(low, distinct[~known], starts[new], ends[new])
            at, _ = self._place(distinct)
        at = at[back]
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[at] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def tokenise(docs: DataFrame, path: str, eos: int = EOS) -> DataFrame:
    """(part, part_start, doc_id, doc_tokens, ids): ids as little-endian bytes of 2 or 4 each, eos included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, at, part = tokenizer(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for block in blocks(batch, "text"):
                ids, offsets = model.encode(block.column("text"))
                n = len(offsets) - 1
                ids = np.insert(ids, offsets[1:], eos).astype(model.dtype)
                offsets = offsets + np.arange(n + 1)
                data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets * model.dtype.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(at + offsets[:-1]), block.column("doc_id"), pa.array(np.diff(offsets)), data],
                    ["part", "part_start", "doc_id", "doc_tokens", "ids"],
                )
                at += int(offsets[-1])

    return doc_texts(docs).mapInArrow(run, "part int, part_start long, doc_id long, doc_tokens long, ids binary")


def pack(docs: DataFrame, path: str, length: int = LENGTH, eos: int = EOS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and is_last (of its document)."""
    tokens = materialise(tokenise(docs, path, eos), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()  # one row per input partition
    base = np.zeros(max([r["part"] for r in totals], default=0) + 1, np.int64)
    for r in totals:
        base[r["part"]] = r["n"]
    base = np.cumsum(base) - base
    shared = docs.sparkSession.sparkContext.broadcast(base)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            tokens = b.column("doc_tokens").to_numpy()
            first = base[b.column("part").to_numpy()] + b.column("part_start").to_numpy()
            pieces = (first + tokens - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(tokens)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            left = np.maximum((first[row] // length + nth) * length, first[row])
            right = np.minimum((first[row] // length + nth + 1) * length, (first + tokens)[row])
            start, size = left - first[row], right - left
            crc, ids, at = np.empty(len(row), np.int64), None, -1
            column = b.column("ids")
            for k, (i, s, n) in enumerate(zip(row.tolist(), start.tolist(), size.tolist(), strict=True)):
                if i != at:
                    raw, at = column[i].as_buffer(), i
                    ids = np.frombuffer(raw, f"<u{raw.size // int(tokens[i])}").astype("<u4")
                crc[k] = zlib.crc32(ids[s : s + n])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), *(pa.array(x) for x in (start, size, crc, tokens[row], left // length, left % length, right == (first + tokens)[row]))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "is_last"],
            )

    return tokens.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, is_last boolean")


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """sequence_id, pieces, tokens, padded: full sequences have `length`; the last one is padded to a power of two."""
    tokens = F.sum("length")
    return pieces.groupBy("sequence_id").agg(F.count("*").alias("pieces"), tokens.alias("tokens")).withColumn(
        "padded", F.when(F.col("tokens") > length // 2, F.lit(length)).otherwise(F.pow(F.lit(2), F.ceil(F.log2("tokens")))).cast("long")
    )


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from assetgraph.llm.jobs import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
