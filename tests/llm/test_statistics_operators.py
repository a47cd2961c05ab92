"""Whitening, sharding and collocations against their definitions."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from assetgraph.llm import collocations, sharding, whitening


# --- whitening -------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, v string, component int")


def _by_definition(rows, components=whitening.COMPONENTS):
    """vec_id and deviation of each row, exact covariances, by fractions."""
    x = [[math.floor(Fraction(c) * 64) + 1000000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * c - s for c, s in zip(r, sums, strict=True)] for r in x]
    cov = [[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(len(sums))] for i in range(len(sums))]
    return n, y, np.array(cov)


def test_whitening_equals_its_definition(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 40)) + rng.normal(size=(400, 40)) * 0.3 + 5
    good = [(i if i % 7 else None, v.tolist()) for i, v in enumerate(base)] + [(3, base[3].tolist()), (3, base[3].tolist())]
    bad = [(900, None), (901, []), (902, [None] * 40), (903, [math.nan] * 40), (904, [math.inf] + [0.0] * 39)]
    got = whitening.whiten(vectors(spark, good + bad)).collect()
    n, y, cov = _by_definition(good)
    assert len(got) == len(good) * 32 and {r.n for r in got} == {n}
    dev = collections.Counter((g[0], sum(c * c for c in r)) for g, r in zip(good, y, strict=True))
    assert collections.Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == dev
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    explained = {r.component: r.explained for r in got}
    assert all(abs(explained[k + 1] - e[k] / e.sum()) < 1e-9 * e[0] / e.sum() for k in range(32))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    want = (np.array(y, float) / n) @ axes / np.sqrt(np.maximum(e, 1e-300))
    white = np.array([[r.whitened for r in sorted((r for r in got if r.vec_id == i), key=lambda r: r.component)][:32] for i in (1, 2, 4)])
    assert np.allclose(np.abs(white), np.abs(want[[1, 2, 4], :32]), atol=1e-6)


def test_sums_of_squares_are_exact_however_large():
    rng = random.Random(2)
    for bits in (3, 31, 45, 60):
        z = [[rng.randrange(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(50)]
        for kind in (np.int64, object):
            total = lambda f, kind=kind, z=z: [sum(int(v[j]) << place for place, v in f(np.array(z, kind))) for j in range(3)]
            assert total(whitening.square_sums) == [sum(r[j] ** 2 for r in z) for j in range(3)]
            assert total(whitening.plain_sums) == [sum(r[j] for r in z) for j in range(3)]
    x = np.array([[10**6, -5], [10**6 + 7, 10**15]])
    assert whitening.centred(x, 10**9, [2 * 10**6 + 7, 3]).tolist() == [[10**15 - 2 * 10**6 - 7, -5 * 10**9 - 3], [10**15 + 7 * 10**9 - 2 * 10**6 - 7, 10**24 - 3]]
    assert whitening.levels(np.array([[1e300, -0.01]])).tolist() == [[int(1e300) * 64 + 10**6, 10**6 - 1]]


def test_whitening_of_odd_lists(spark):
    rows = [(1, [1.0, 2.0, 2.0]), (2, [2.0, 1.0, 1.0]), (3, [0.0, 5.0, 5.0]), (4, [7.0]), (5, [1e300, 0.0]), (6, [0.0, 1.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    by = {(r.vec_id, r.component): r for r in got}
    assert set(by) == {(i, k) for i in (1, 2, 3) for k in (1, 2, 3)} | {(4, 1)} | {(i, k) for i in (5, 6) for k in (1, 2)}
    assert by[1, 1].n == 3 and by[1, 3].whitened is None and by[1, 3].explained == 0 and by[1, 1].identity_error < 1e-9  # two dimensions are alike
    assert by[4, 1].whitened is None and by[4, 1].deviation == 0 and by[4, 1].identity_error is None
    assert by[5, 1].deviation is None and abs(abs(by[5, 1].whitened) - 1) < 1e-9 and abs(by[5, 1].explained - 1) < 1e-9
    assert whitening.whiten(vectors(spark, [])).count() == 0


# --- sharding --------------------------------------------------------------------------------------------------------


def _lpt(groups, shards):
    """One heap over all groups: key -> shard."""
    heap, out = [(0, k) for k in range(shards)], {}
    for key, size in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        load, k = heap[0]
        out[key] = k
        heapq.heapreplace(heap, (load + size, k))
    return out


@pytest.mark.parametrize("n", [0, 1, 600])
def test_shards_equal_one_heap(spark, n):
    rng = random.Random(n)
    texts = ["x" * rng.choice((3, 3, 3, 50, rng.randrange(1, 400))) + rng.choice("abcdefghij") for _ in range(n // 2)] + ["hot " * 400] * (n // 3) + ["né"] * (n > 0) + [None, ""] * (n // 100)
    rows = [(rng.choice((i, None, 5)), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, size string, shard int").repartition(7)
    got = sharding.shard_documents(df).collect()
    own = [(d, t or "") for d, t in rows]
    groups = collections.Counter()
    for _, t in own:
        groups[hashlib.sha256(t.encode()).digest()] += len(t.encode()) + 1
    placed = _lpt(groups, 16)
    want = collections.Counter((d, len(t.encode()) + 1, zlib.crc32(t.encode()), placed[hashlib.sha256(t.encode()).digest()]) for d, t in own)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == want
    for shard in {r.shard for r in got}:
        inside = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in inside] == list(range(len(inside)))
        ids = [(r.doc_id is not None, r.doc_id or 0) for r in inside]
        assert ids == sorted(ids)


def test_loads_after_many_groups_of_one_size_equal_a_heap(monkeypatch):
    rng = random.Random(4)
    for _ in range(300):
        loads = [rng.choice((0, rng.randrange(60), 500)) for _ in range(rng.randrange(1, 9))]
        size, count = rng.randrange(1, 9), rng.randrange(0, 500)
        heap = [(load, k) for k, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
        want = [load for load, _ in sorted(heap, key=lambda x: x[1])]
        monkeypatch.setattr(sharding, "MANY", 10**9)
        assert sharding.advance(loads, size, count) == want
        monkeypatch.setattr(sharding, "MANY", -1)
        assert sharding.advance(loads, size, count) == want


# --- collocations ----------------------------------------------------------------------------------------------------


def _phrases(rows, least, first, cover=50):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    cand = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        if len(w) == 2 and any(lg == lang and len(x) == 3 and w in (x[:2], x[1:]) and 100 * b >= cover * a for (lg, x), b in cand.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank + 1, p.decode(), -a, l_, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l_, r) in enumerate(sorted(found)[:first]))


def test_collocations_equal_their_definition(spark):
    rng = random.Random(9)
    words = ["the", "The", "of", "new", "york", "city", "É", "a\x01", "a", "x-y", "|", " ", "zz"]
    rows = []
    for _ in range(300):
        body = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "? !"]) for _ in range(rng.randrange(0, 60)))
        rows.append((body, rng.choice(["en", "en", "de", None, "und", ""])))
    rows += [("the " * 5000, "en"), (None, "en"), ("", None), ("only", "fr")] + [("new york city of the", "de")] * 40
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "text string, lang string, word string, n int").repartition(5)
    for size, first in ((500, 2000), (1 << 20, 7)):
        got = sorted(tuple(r) for r in collocations.collocations(df, first=first, portion_bytes=size).collect())
        assert got == _phrases(rows, 10, first)
    assert collocations.collocations(df.limit(0)).count() == 0
