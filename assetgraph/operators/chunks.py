"""Packing of a document's units into requests that keep several budgets at once: tokens, bytes of JSON, images and characters.

Costs of a unit are counted on its bytes of UTF-8, many units at once. A unit that is too large by itself is cut then, in the task that reads it. What is then brought together for each
document is numbers alone: prefix sums of every cost, in which bisection finds the furthest unit that still fits all budgets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a request has besides its units.
OVERHEAD_BYTES = 8192


@dataclass(frozen=True)
class Budgets:
    """Of one request. bytes_: of the units as a JSON list with all but ASCII escaped, and OVERHEAD_BYTES; image_tokens: what an image costs."""

    tokens: int
    bytes_: int
    images: int
    chars: int = 1 << 62
    image_tokens: int = 0


_TWICE = np.zeros(128, bool)
_TWICE[[ord(x) for x in '"\\\n\r\t\b\f']] = True
#: By a byte of UTF-8: what its character takes within JSON's quotes, all but printable ASCII escaped; bytes that go on with a character take nothing.
_JSON = np.array([2 if b < 128 and _TWICE[b] else 1 if 32 <= b < 127 else 6 if b < 128 else 0 if b < 0xC0 else 6 if b < 0xF0 else 12 for b in range(256)])
_SLICE = 256  # rows that are counted at once


def _counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ASCII characters, others and JSON bytes of each text."""
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    marks = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    of = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[at - at[0]])
    return of(marks < 128), of(marks >= 0xC0), of(_JSON[marks])


def _sums(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of ASCII characters and of JSON bytes, and the places after a stop."""
    marks = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = marks < 128
    size = np.where(marks >= 0x10000, 12, np.where((marks < 32) | (marks > 126), 6, 1))
    size[low] = np.where(_TWICE[marks[low]], 2, size[low])
    before = lambda x: np.concatenate([[0], np.cumsum(x)])
    return before(low), before(size), np.flatnonzero((marks == ord("\n")) | (marks == ord("。"))) + 1


def cut_text(text: str, fits: Callable[[int, int, int], bool]) -> list[tuple[int, int]]:
    """(begin, end) of the parts of a text that fit by themselves: what doesn't is cut in two, after the last stop of its first half unless that leaves less
    than a quarter before the cut, else in the middle, and so are its parts. fits: of ASCII and other characters and JSON bytes. One character always fits."""
    ascii_, size, stops = _sums(text)
    out, todo = [], [(0, len(ascii_) - 1)]
    while todo:
        a, b = todo.pop()
        own = int(ascii_[b] - ascii_[a])
        if b - a < 2 or fits(own, b - a - own, int(size[b] - size[a])):
            out.append((a, b))
            continue
        half = (b - a) // 2
        nearest = int(np.searchsorted(stops, a + half, "right")) - 1
        cut = int(stops[nearest]) if nearest >= 0 and stops[nearest] > a + half // 2 else a + half
        todo += [(cut, b), (a, cut)]
    return out


def fragments(units: DataFrame, key: str, order: str, budgets: Budgets) -> DataFrame:
    """(key, order, part, begin, end, tokens, bytes, images, chars) of the units (key, order, location, text, has_image), those that are too large cut. The location counts for every part.
    Tokens: a third of the ASCII characters, rounded up, and two for each other."""
    place, text = F.coalesce("location", F.lit("")), F.coalesce("text", F.lit(""))
    image = F.coalesce(F.col("has_image"), F.lit(False)).cast("long")
    names = (key, order, "part", "begin", "end", "tokens", "bytes", "images", "chars")
    brackets = len('{"location": "", "text": ""}') + 2  # and the comma before it

    def costs(low: np.ndarray, other: np.ndarray, size: np.ndarray, place_low: np.ndarray, place_other: np.ndarray, frame: np.ndarray, images: np.ndarray):
        return (low + place_low + 2) // 3 + 2 * (other + place_other) + images * budgets.image_tokens, size + frame, low + other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, _SLICE) for whole in batches for k in range(0, whole.num_rows, _SLICE)):
            images = b.column("images").to_numpy()
            place_low, place_other, frame = _counts(b.column("place"))
            own = place_low, place_other, frame + brackets, images
            low, other, size = _counts(b.column("text"))
            tokens, bytes_, chars = costs(low, other, size, *own)
            large = (tokens > budgets.tokens) | (bytes_ + OVERHEAD_BYTES > budgets.bytes_) | (chars > budgets.chars)
            fit = np.flatnonzero(~large)
            none = np.zeros(len(fit), np.int64)
            found = [np.stack([fit, none, none, chars[fit], tokens[fit], bytes_[fit], images[fit], chars[fit]])]
            for i in np.flatnonzero(large):
                mine = [x[i] for x in own]

                def fits(a, o, size, mine=mine):
                    t, s, c = costs(a, o, size, *mine)
                    return t <= budgets.tokens and s + OVERHEAD_BYTES <= budgets.bytes_ and c <= budgets.chars

                body = b.column("text")[int(i)].as_py()
                low_, size_, _ = _sums(body)
                cuts = np.array(cut_text(body, fits))
                x, y = cuts[:, 0], cuts[:, 1]
                a = low_[y] - low_[x]
                t, s, c = costs(a, y - x - a, size_[y] - size_[x], *mine)
                found.append(np.stack([np.full(len(cuts), i), np.arange(len(cuts)), x, y, t, s, np.full(len(cuts), images[i]), c]))
            of, *columns = np.concatenate(found, axis=1)
            at = pa.array(of)
            types = (*[pa.int32()] * 3, *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([b.column(key).take(at), b.column(order).take(at), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], list(names))

    base = units.select(key, order, text.alias("text"), place.alias("place"), image.alias("images"))
    kinds = dict(base.dtypes)
    schema = [f"`{n}` {kinds[n]}" for n in (key, order)] + [f"`{n}` int" for n in names[2:5]] + [f"`{n}` long" for n in names[5:]]
    return base.mapInArrow(run, ", ".join(schema))


def furthest(sums: list[np.ndarray], budgets: list[int]) -> np.ndarray:
    """The number of the first unit of each request: it takes units while all prefix sums keep their budgets, and one unit always."""
    starts, at, n = [], 0, len(sums[0]) - 1
    while at < n:
        starts.append(at)
        at = max(at + 1, min(int(np.searchsorted(s, s[at] + b, "right")) - 1 for s, b in zip(sums, budgets, strict=True)))
    return np.array(starts, np.int64)


def pack_units(units: DataFrame, key: str, order: str, budgets: Budgets) -> DataFrame:
    """(key, order, part, begin, end, chunk): the request, from 0, that each part of each unit goes into, neighbours together as long as all budgets hold.

    Null texts and locations are empty. A single character, or an image, that is beyond a budget is a request of its own.
    """
    parts = fragments(units, key, order, budgets)
    names = [key, order, "part", "begin", "end", "chunk"]
    most = [budgets.tokens, budgets.bytes_ - OVERHEAD_BYTES, budgets.images, budgets.chars]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(order, "ascending"), ("part", "ascending")])
        sums = [np.concatenate([[0], np.cumsum(group.column(c).to_numpy())]) for c in ("tokens", "bytes", "images", "chars")]
        chunk = np.searchsorted(furthest(sums, most), np.arange(group.num_rows), "right") - 1
        return group.select(names[:-1]).append_column("chunk", pa.array(chunk.astype(np.int32)))

    kinds = dict(parts.dtypes)
    return parts.groupBy(key).applyInArrow(run, ", ".join(f"`{n}` {kinds.get(n, 'int')}" for n in names))
