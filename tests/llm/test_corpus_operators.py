"""Near-duplicates, decontamination, nearest neighbours, licences, archives, repeats and the pipeline."""

import collections
import functools
import gzip
import hashlib
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from oracles import connection, spark_rows, sql_rows
from pyspark.sql import functions as F

from assetgraph.llm import components, decontaminate, licenses, neardup, repeats, vptree, warc
from assetgraph.llm.registry import QUERIES, oracle_sql

WORDS = [a + b for a in ("th", "er", "on", "in", "es", "ré", "st") for b in ("", "a", "ou", "ti", "nd")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, component string, key int")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


# --- components and near-duplicates ----------------------------------------------------------------------------------


def _union(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    want = _union(400, links)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == want[i] for i in range(400))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _sets(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def _classes(rows, n, percent=80):
    rows = sorted(rows)
    sets = _sets([t for _, t in rows], n)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return {rows[i][0]: rows[c][0] for i, c in enumerate(_union(len(rows), links))}, {r[0]: len(s) for r, s in zip(rows, sets, strict=True)}


def test_components_of_hubs_in_portions(spark, monkeypatch):
    """Two large stars and a chain; hubs with large and with small ids are dealt to portions."""
    monkeypatch.setattr("assetgraph.llm.components.LEAST", 20)
    pairs = [(0, 10 * i + 1) for i in range(1, 1500)] + [(10 * i + 2, 90000) for i in range(1, 1200)] + [(50001, 50003), (50003, 50004)] + [(90000, 90001), (90001, 90005)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {n: 0 for p in pairs[:1499] for n in p} | {n: 12 for p in pairs[1499:2698] for n in p} | {50001: 50001, 50003: 50001, 50004: 50001, 90001: 12, 90005: 12}
    assert got == want


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_equal_brute_force(spark, shingle, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)  # several blocks a bucket, and further hubs
    monkeypatch.setattr(neardup, "PORTION", 3)
    rng = random.Random(shingle)
    rows, families = [], [prose(rng, 60) for _ in range(6)]
    for i in range(150):
        base = families[i % 6] if i % 3 else prose(rng, rng.randrange(1, 50))
        rows.append((1000 - i * 3, edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05, 0.08])).upper() if i % 7 == 0 else edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05, 0.08]))))
    rows += [(2001, ""), (2002, None), (2003, " \t"), (2004, "one"), (2005, "One"), (2006, "one two"), (2007, "a b c")]
    want, sizes = _classes(rows, shingle)
    got = neardup.components(docs(spark, rows), shingle).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = neardup.keep_first(docs(spark, rows), shingle)
    assert kept.columns == ["doc_id", "text", "component", "key"] and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, c in want.items() if d == c)


def test_a_large_bucket_of_loose_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 1000)
    monkeypatch.setattr(neardup, "PORTION", 10)
    rng = random.Random(21)
    base = [f"{rng.choice(WORDS)}{i}" for i in range(40)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(40)] = f"new{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    want, _ = _classes(rows, 2)
    got = neardup.components(docs(spark, rows), 2, count=64, rows=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    out = neardup.components(docs(spark, rows)).collect()
    assert sorted(((r.doc_id or 0), r.component_id or 0, r.kept) for r in out) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert sorted(r.doc_id or 0 for r in neardup.keep_first(docs(spark, rows), 2).collect()) == [0, 1, 3]
    twice = [(7, "some text"), (7, "another text"), (7, None), (8, "b"), (8, "a")]
    assert sorted((r.doc_id, r.text or "") for r in neardup.keep_first(docs(spark, twice).repartition(3), 2).collect()) == [(7, ""), (8, "a")]
    assert neardup.components(docs(spark, [])).count() == 0 and neardup.keep_first(docs(spark, []), 2).count() == 0


def test_a_doc_id_with_two_texts_keeps_the_links_of_both(spark, monkeypatch):
    import pandas as pd

    one, two = list(range(100, 120)), list(range(300, 330))
    rows = [(5, True, 5, one), (5, True, 5, two), (9, False, 9, two), (11, False, 11, one)]
    for order in (rows, rows[::-1]):
        found = neardup._settle(80)(pd.DataFrame(order, columns=["doc", "driver", "component", "grams"]))
        assert set(zip(found["a"], found["b"], strict=True)) == {(5, 9), (5, 11)}

    monkeypatch.setattr(neardup, "PORTION", 3)
    rng = random.Random(31)
    first, second = (" ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(60)) for _ in range(2))
    rows = [(50, first), (50, second), *((60 + i, edited(rng, first, 0.03)) for i in range(6)), *((80 + i, edited(rng, second, 0.03)) for i in range(6)), (99, first + " " + second)]
    want = {i: min(_component(rows, i)) for i, _ in rows}
    for order in (rows, rows[::-1]):
        got = neardup.components(docs(spark, order), 2, count=64, rows=2).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def _component(rows, start):
    """doc_ids reachable over links between any texts."""
    sets = list(zip([i for i, _ in rows], _sets([t for _, t in rows], 2), strict=True))
    seen, todo = {start}, [start]
    while todo:
        own = [s for i, s in sets if i in seen]
        todo = [i for i, s in sets if i not in seen and any(100 * len(s & t) >= 80 * len(s | t) for t in own)]
        seen |= set(todo)
    return seen


# --- decontamination -------------------------------------------------------------------------------------------------


def _items(rng, n):
    return [(i, " ".join(prose(rng, rng.randrange(4, 9)) + "." for _ in range(rng.randrange(1, 5)))) for i in range(n)]


def test_retrieval_equals_exhaustive_scores():
    rng = random.Random(5)
    index = decontaminate.build_index(_items(rng, 60))
    for _ in range(200):
        item = rng.randrange(60)
        terms = index.term_ids(index.words[item])
        terms = terms[[rng.random() < 0.7 for _ in terms]]
        scores = collections.Counter()
        for t in set(terms.tolist()):
            for _, items, impacts in index.by_block[t].values():
                for i, w in zip(items, impacts, strict=True):
                    scores[i] += w
        want = {i for i, s in scores.items() if s >= index.thresholds[i] - 1e-9}
        got = dict(index.retrieve(terms, list(range(len(index.common_bound)))))
        assert set(got) == want and all(abs(got[i] - scores[i]) < 1e-9 for i in want)


def test_no_passage_that_verification_accepts_lies_below_the_threshold():
    rng = random.Random(15)
    common = [f"c{i}" for i in range(12)]
    items = [(i, " ".join(["rare%d" % i] * (i % 2) + [rng.choice(common) for _ in range(rng.randrange(4, 40))] + ["odd%d" % i] * (i % 3))) for i in range(201)]
    items.append((201, "unique0 c1 c2 c3 c4 c5 c6 c7 c8 c9 c10 c11 c0 unique1"))
    index = decontaminate.build_index(items)
    assert index.thresholds[index.ids.index(201)] < 0.5
    for n, words in enumerate(index.words):
        grams = {tuple(words[k : k + 5].tolist()): set(words[k : k + 5].tolist()) for k in range(len(words) - 4)}
        scored = {}
        for t, blocks in enumerate(index.by_block):
            for _, own, impacts in blocks.values():
                if n in own:
                    scored[int(index.terms[t])] = impacts[own.index(n)]
        for _ in range(20):
            kept = rng.sample(sorted(grams), -(-len(grams) * 8 // 10)) if grams else []
            there = set().union(*(grams[g] for g in kept)) if grams else set(words.tolist())
            assert sum(scored[t] for t in there) >= index.thresholds[n] - 1e-9
    passage = "and so c0 c1 c2 c3 c4 c5 c6 c7 c8 c9 c10 c11 c0 c5 on".replace("c0 c1", "x c1", 1)
    assert 201 in [f[1] for f in decontaminate.leaks(index, pa.array([passage]), answer_overlap=0.5)]


def test_long_items_have_slices_of_their_own(spark, monkeypatch):
    assert decontaminate.slices([]) == [] and decontaminate.slices([(3, 10, 100), (6, 10, 1000), (17, 1, 1 << 17)]) == [(3, 6, 1), (17, 17, 1)]
    assert decontaminate.slices([(6, 50_000, 4_000_000), (7, 10, 1500)]) == [(6, 6, 3), (7, 7, 1)]
    rng = random.Random(16)
    items = [(i, prose(rng, 12)) for i in range(30)] + [(100, prose(rng, 20_000))]
    rows = [(i, "before " + t + " after") for i, t in items]
    monkeypatch.setattr(decontaminate, "SLICE_ITEMS", 8)
    got = decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.where("doc_id = item_id").collect()} == {(i, i) for i, _ in items}
    assert len(list(decontaminate.indexes(spark.createDataFrame(items, "item_id long, text string")))) > 3


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(i, t) for i, t in _items(rng, 50) if len(t.split()) >= 5] + [(90, None), (91, ""), (92, "rare words")]
    rows = []
    for k in range(120):
        body = prose(rng, rng.randrange(0, 300)).split(" ")
        if k % 3 == 0:
            _, t = items[k % 40]
            cut = rng.choice([t, t.upper(), t.replace(".", " ?"), " ".join(t.split()[:3]), edited(rng, t, 0.02)])
            at = rng.randrange(len(body) + 1)
            body[at:at] = [cut]
        rows.append((k, " ".join(body)))
    rows += [(500, None), (501, ""), (502, "so rare words here"), (None, items[0][1]), (3, rows[3][1])]
    plain = lambda t: [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower() for w in (t or "").split()]
    want = set()
    for d, t in rows:
        w = plain(t)
        for i, b in items:
            x = plain(b)
            if not x:
                continue
            n = min(5, len(x))
            grams = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            there = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if len(grams & there) >= 0.8 * len(grams):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")).collect()}
    assert got == want and len(want) > 20
    kept = decontaminate.drop_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "component", "key"] and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, _ in rows if d not in {x for x, _ in want})
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(docs(spark, rows), none).count() == 0 and decontaminate.drop_leaks(docs(spark, rows), none).count() == len(rows)


# --- nearest neighbours ----------------------------------------------------------------------------------------------


def _nearest(rows, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    out = {}
    for q in good:
        if q % 5 == 0:
            a = np.array(good[q], float)
            scored = sorted((-float(a @ np.array(v, float)) / (np.sqrt(a @ a) * np.sqrt(np.array(v, float) @ np.array(v, float))), i) for i, v in good.items() if i != q and len(v) == len(a))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) + (i % 4)]) for i in range(700)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] + [1.0] * 7), (1004, [1.0] * 3), (1005, [2.0, 1.0, 0.0]), (None, [1.0] * 8), (1006, [float("inf")] * 8), (1007, [None] + [1.0] * 7)]
    rows += [(1010, [1.0] * 8), (1011, [2.0] * 8), (1012, [4.0] * 8), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    want = _nearest(rows)
    found = vptree.search(df, F.col("vec_id") % 5 == 0, shard_rows=150, block_queries=50).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {q for q, v in want.items() if v}
    for q, v in got.items():
        assert [i for i, _ in v] == [i for i, _ in want[q]] and np.allclose([s for _, s in v], [s for _, s in want[q]], atol=1e-12)
    assert vptree.search(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_ties_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(11)
    base = [float(np.float32(x)) for x in rng.normal(size=6)]
    rows = [(i, [x * (1, 3, 0.7, 1e200)[i // 2 % 4] for x in base]) for i in range(0, 900, 2)]
    rows += [(i, [float(x) for x in rng.permutation([3.0, 1.0, -2.0, 0.5, 0.25, 1.5])]) for i in range(1, 400, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = {i: [math.ldexp(x, -math.frexp(max(map(abs, v)))[1]) for x in v] for i, v in rows}
    want = {}
    for q in (i for i in good if i % 5 == 0):
        cosine = {i: _measure(good[q], v) for i, v in good.items() if i != q}
        want[q] = sorted(cosine, key=lambda i: (-cosine[i], i))[:5]
    got = {}
    for r in sorted(vptree.search(df, F.col("vec_id") % 5 == 0, shard_rows=200, block_queries=60).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want


def _measure(a, b):
    """The cosine by its definition, one product after the other."""
    dot = lambda x, y: functools.reduce(lambda t, p: t + p[0] * p[1], zip(x, y, strict=True), 0.0)
    return dot(a, b) / math.sqrt(dot(a, a)) / math.sqrt(dot(b, b))


def test_close_cosines_are_not_rounded(spark):
    rows = [(0, [1.0, 0.0])] + [(i, [1.0, 1 + (10 - i) * 1e-14]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(vptree.search(df, F.col("vec_id") == 0).collect(), key=lambda r: r.rank)
    assert [r.vec_id for r in found] == [8, 7, 6, 5, 4]
    assert [r.score for r in found] == [_measure([1.0, 0.0], rows[i][1]) for i in (8, 7, 6, 5, 4)]


def test_relaxed_search_has_the_stated_recall():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    v = centres[rng.integers(0, 20, 3000)] + 0.2 * rng.normal(size=(3000, 16))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    own = np.arange(0, 3000, 50)
    sims = unit[own] @ unit.T
    sims[np.arange(len(own)), own] = -9
    want = np.argsort(-sims, axis=1)[:, :5]
    for factor, least in ((1.0, 1.0), (1.5, 0.9)):
        found = vptree.Tree(v).search(v[own], own, 5, factor)
        assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found, want, strict=True)]) >= least


# --- licences --------------------------------------------------------------------------------------------------------


def test_licences(spark):
    mit = licenses.TEXTS["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("SUBLICENSE", "sub-license")), (2, "text before\n  Released   under the MIT Licence!\nafter"), (3, "Released under the MIT License, mostly."),
        (4, None), (5, ""), (6, "...\n\n..."), (None, "All rights reserved"), (7, "a\n\n" + mit + "\n\nb"), (2, "ALL RIGHTS RESERVED."),
    ]
    got = sorted((r.doc_id or 0, r.unit_kind, r.unit, r.license) for r in licenses.scan(docs(spark, rows)).collect())
    assert got == [(0, "document", 0, "all-rights-reserved"), (1, "document", 0, "MIT"), (1, "paragraph", 1, "MIT"), (2, "document", 0, "all-rights-reserved"), (2, "line", 1, "MIT"), (7, "paragraph", 1, "MIT")]
    more = licenses.scan(docs(spark, [(1, "my own terms")]), {"own": ["My own terms."]}).collect()
    assert [r.license for r in more] == ["own"] and licenses.scan(docs(spark, [])).count() == 0


def test_licences_in_their_usual_layout(spark):
    mit = re.sub(licenses.BREAKS, "\n\n", licenses.TEXTS["MIT"])
    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
    rows = [(1, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + mit), (2, "Some project\n\n" + mit + "\n\nmore"), (3, mit.split("\n\n")[0] + "\n\n" + mit.split("\n\n")[2])]
    rows += [(4, "BSD 2-Clause License\n\nCopyright (c) 2020, One\nAll rights reserved.\n\n" + bsd), (5, "intro\n\n" + bsd), (6, "MIT License\n\nhow it was chosen"), (2, rows[1][1])]
    got = sorted((r.doc_id, r.unit_kind, r.unit, r.license) for r in licenses.scan(docs(spark, rows)).collect() if r.unit_kind != "line")
    assert got == [(1, "document", 0, "MIT"), (1, "run", 2, "MIT"), (2, "run", 1, "MIT"), (2, "run", 1, "MIT"), (4, "document", 0, "BSD-2-Clause"), (4, "paragraph", 1, "all-rights-reserved"), (4, "run", 2, "BSD-2-Clause"), (5, "run", 1, "BSD-2-Clause")]
    own = licenses.known_table(spark, {"own": ["My own terms, which are long enough to make a paragraph of their own here.\n\nAnd a second one."]})
    text = "x\n\nMy own terms, which are long enough to make a paragraph of their own here.\n\nAnd a second one.\n\ny"
    assert [(r.unit_kind, r.license) for r in licenses.scan(docs(spark, [(1, text)]), more=own.where("license = 'own'")).collect()] == [("run", "own")]


def test_long_licences(spark):
    at = "/usr/share/common-licenses/"
    if not os.path.exists(at + "GPL-3"):
        pytest.skip("no licence texts on this machine")
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = []
    for i, f in enumerate(names):
        with open(at + f, encoding="utf-8") as t:
            text = t.read()
        rows += [(i, text), (100 + i, "A project.\n\n" + text + "\n\nThe end.")]
    got = {(r.doc_id, r.unit_kind, r.license) for r in licenses.scan(docs(spark, rows)).collect() if r.unit_kind in ("document", "run")}
    assert got >= {(i, "document", n) for i, n in enumerate(names.values())} | {(j + i, "run", n) for i, n in enumerate(names.values()) for j in (0, 100)}


# --- archives --------------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_archive_round_trip(spark):
    big = "é\r\n\r\nWARC/1.1\r\n" * 200
    rows = [(i, f"http://h{i % 3}.example.com:80/p/{i}?q=1#f", f"<p>{i}</p>" * (i * 9)) for i in range(60)]
    rows += [(100, "http://a/1", big), (101, "http://a/2", big), (102, "http://a/3", big), (103, "http://a/4", "small"), (104, "http://a/5", "small"), (105, None, None), (None, "http://a/1", big), (106, "not a url\n", ""), (7, rows[7][1], rows[7][2]), (200, "http://b/1", big + "x"), (201, "http://b/2", big + "x"), (201, "http://b/2", big + "x")]
    df = pages(spark, rows)
    directory, index, archive = warc.archive(df)
    got = warc.read_all(directory, index, archive).collect()
    asked = warc.lookup(directory, df, index, archive).collect()
    assert sorted(map(str, asked)) == sorted(map(str, got))
    want = []
    for p, u, h in rows:
        raw = (h or "").encode()
        same = [q for q, _, x in rows if q is not None and (x or "").encode() == raw] if len(raw) >= 1000 else []
        refers = max(same) if same and p is not None and max(same) != p else None
        want.append((p or -1, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers or -1))
    assert sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == sorted((p if p else (0 if p == 0 else p), *x) for p, *x in [(w[0] if w[0] != -1 or rows[k][0] is None else rows[k][0], *w[1:]) for k, w in enumerate(want)])
    asked = spark.createDataFrame([("https://H1.example.com/p/1?q=1",), ("http://a/1",), ("http://none/",), (None,)], "url string")
    assert sorted(str(r.page_id) for r in warc.lookup(directory, asked, index, archive).collect()) == ["1", "100", "105", "None"]
    ids, refers = [], []
    for f in os.listdir(archive.removeprefix("file:")):
        with open(f"{archive.removeprefix('file:')}/{f}", "rb") as file:
            raw = gzip.decompress(file.read())
        ids += re.findall(rb"WARC-Record-ID: (\S+)", raw)
        refers += re.findall(rb"WARC-Refers-To: (\S+)", raw)
    assert len(ids) == len(set(ids)) == len(rows) and set(refers) <= set(ids) and len(set(refers)) == 1


def test_index_is_sorted_and_sparse(spark, monkeypatch):
    df = pages(spark, [(i, f"http://www.z{i % 7}.org/{i}", "x") for i in range(500)])
    at = warc.fresh_path(spark, "t")
    directory = warc.write_index(warc.write_archives(df, at + "/a"), at + "/i", block_lines=32)
    rows = directory.orderBy("first_key").collect()
    assert len(rows) >= 500 // 32 and all(a.last_key <= b.first_key for a, b in zip(rows, rows[1:], strict=False)) and sum(r.lines for r in rows) == 500
    for bound in (200_000, 5):  # the directory at once, and in slices
        monkeypatch.setattr(warc, "DIRECTORY_ROWS", bound)
        got = warc.lookup(directory, df.select("url"), at + "/i", at + "/a").collect()
        assert sorted(r.page_id for r in got) == list(range(500))


def test_a_key_with_many_captures_spans_blocks(spark, monkeypatch):
    df = pages(spark, [(i, "http://a.b/same" if i % 3 else f"http://a.b/{i}", "x") for i in range(300)])
    at = warc.fresh_path(spark, "t")
    directory = warc.write_index(warc.write_archives(df, at + "/a"), at + "/i", block_lines=16)
    for bound in (200_000, 3):
        monkeypatch.setattr(warc, "DIRECTORY_ROWS", bound)
        got = warc.lookup(directory, df.where("page_id < 2"), at + "/i", at + "/a").collect()
        assert sorted(r.page_id for r in got) == [0] + [i for i in range(300) if i % 3]
    assert warc.read_all(*warc.archive(pages(spark, []))).count() == 0


@pytest.mark.parametrize(
    ("url", "key"), [("http://www.Ex.com:80/A?b#c", "com,ex)/a?b"), ("https://u@a.b.org:8080", "org,b,a:8080)/"), (None, ""), ("plain", "plain"), ("http://x.y?q", "y,x)/?q")]
)
def test_sort_key(url, key):
    assert warc.sort_key(url) == key


# --- repeats ---------------------------------------------------------------------------------------------------------


def _units(text):
    """(line, start, end, plain words) of each sentence."""
    out = []
    for n, line in enumerate(re.finditer(r"[^\n]+", text or "")):
        own = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", line[0]):
            own.append((m.start() + line.start(), m.end() + line.start(), m[0].strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()))
            if m[0][-1] in ".!?":
                out.append((n, own))
                own = []
        if own:
            out.append((n, own))
    return [(n, u[0][0], u[-1][1], tuple(w for _, _, w in u)) for n, u in out]


def _repeated(rows, least):
    """doc -> text -> the words (places) that are removed, by the definition of lines and passages; and the text's word spans."""
    found = collections.defaultdict(list)
    ranked = sorted({r for r in rows if r[0] is not None and r[1]})
    spans = {}
    for d, t in ranked:
        sentences = _units(t)
        words = [w for u in sentences for w in u[3]]
        starts = np.cumsum([0] + [len(u[3]) for u in sentences]).tolist()
        spans[d, t] = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        for line in {u[0] for u in sentences}:
            own = [k for k, u in enumerate(sentences) if u[0] == line]
            a, b = starts[own[0]], starts[own[-1] + 1]
            found["line", tuple(words[a:b])].append((d, t, a, b))
        for k in range(len(sentences)):
            j = next((j for j in range(k, len(sentences)) if starts[j + 1] - starts[k] >= least), None)
            if j is not None:
                found["passage", tuple(words[starts[k] : starts[j + 1]])].append((d, t, starts[k], starts[j + 1]))
    gone = collections.defaultdict(set)
    for places in found.values():
        d, t, _, kept = min(places, key=lambda p: (p[0], p[1], p[2]))
        for p in places:
            if p != min(places, key=lambda p: (p[0], p[1], p[2])):
                gone[p[0], p[1]] |= set(range(max(p[2], kept) if p[:2] == (d, t) else p[2], p[3]))
    return gone, spans


def _merged(gone, spans):
    """(doc, start, end, words) of the runs of removed words."""
    out = set()
    for (d, t), words in gone.items():
        for w in words:
            if w - 1 not in words:
                end = next(e for e in range(w, len(spans[d, t]) + 1) if e not in words)
                out.add((d, spans[d, t][w][0] if w else spans[d, t][0][0], spans[d, t][end - 1][1], end - w))
    return out


def test_repeats_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr("assetgraph.llm.jobs.HOT_LEAST", 20)
    rng = random.Random(9)
    sentences = [prose(rng, rng.randrange(1, 15)).capitalize() + "." for _ in range(40)]
    rows = [(i * 2, "".join(rng.choice([s, s.upper(), s.replace(".", "!")]) + rng.choice([" ", "\n", " \n\n"]) for s in rng.choices(sentences + [prose(rng, 9) + "."] * 20, k=rng.randrange(12)))) for i in range(60)]
    passage = " ".join(sentences[:6])
    rows += [(300 + i, f"{prose(rng, 5)}. {passage} {prose(rng, 4)}.") for i in range(5)]
    rows += [(200 + i, sentences[0] + " " + prose(rng, 12)) for i in range(50)] + [(5, None), (7, ""), (9, " \n"), (None, rows[1][1]), rows[4]]
    want = _merged(*_repeated(rows, repeats.MIN_WORDS))
    spans = repeats.repeated_spans(docs(spark, rows))
    # where a repeat overlaps what stays of it, its span begins at the end of that
    key = lambda d, e, n: (d, e, n)
    assert {key(r.doc_id, r.end, r.n_words) for r in spans.collect()} == {key(d, e, n) for d, _, e, n in want} and len(want) > 40
    starts = {(d, e): s for d, s, e, _ in want}
    assert all(r.start <= starts[r.doc_id, r.end] for r in spans.collect())
    cleaned = collections.Counter((r.doc_id, " ".join((r.text or "").split())) for r in repeats.remove_spans(docs(spark, rows), spans).collect())
    gone, words = _repeated(rows, repeats.MIN_WORDS)
    after = collections.Counter((d, " ".join(t[a:b] for k, (a, b) in enumerate(words.get((d, t), [])) if k not in gone.get((d, t), ())) if d is not None and t else " ".join((t or "").split())) for d, t in rows)
    assert cleaned == after
    assert repeats.repeated_spans(docs(spark, [])).count() == 0


def test_a_line_that_occurs_once_stays_whatever_its_sentences(spark):
    rows = [(1, "red fox runs home. x1 y1"), (2, "blue cat sits down. x2 y2"), (3, "own words before\nred fox runs home. blue cat sits down.\nown words after"), (4, "zz\nred fox runs home. blue cat sits down.\nyy")]
    rows += [(5, "tail\ntail\ntail"), (6, "a tail\nTAIL!")]
    got = sorted((r.doc_id, dict(rows)[r.doc_id][r.start : r.end].strip()) for r in repeats.repeated_spans(docs(spark, rows)).collect())
    assert got == [(4, "red fox runs home. blue cat sits down."), (5, "tail\ntail"), (6, "TAIL!")]


def test_rows_that_repeat_a_document(spark):
    short = " ".join(f"word{i} three words{i}." for i in range(10))
    texts = [(1, short), (2, "own start here. " + short + " own end."), (2, short + "\nAnother end of the same id."), (None, short)]
    want = {(2, 16, 16 + len(short), 30), (2, 0, len(short), 30)}
    for rows in (texts, texts + texts[:3] * 2 + texts[1:2]):
        spans = repeats.repeated_spans(docs(spark, rows))
        got = spans.collect()
        assert len(got) == 2 and {(r.doc_id, r.start, r.end, r.n_words) for r in got} == want
        cleaned = repeats.remove_spans(docs(spark, rows), spans).collect()
        after = {short: short, texts[1][1]: "own start here.  own end.", texts[2][1]: "\nAnother end of the same id."}
        assert sorted(((r.doc_id or 0), r.text) for r in cleaned) == sorted((d or 0, after[t]) for d, t in rows)


def test_passages_without_stops_and_short_sentences(spark):
    rng = random.Random(13)
    names = [f"w{i}" for i in range(60)]
    passage = " ".join(names)
    rows = [(1, "Released under the MIT license.\nFirst own line. Thank you. More of it"), (2, "An own line\n  Released under the MIT license.  \nIs that so? Thank you. And on"), (3, "Thank you. Only here\nReleased under the MIT license.\n\nthe end")]
    rows += [(10, "before it " + passage + " after"), (11, "other words that come first " + passage + " and others"), (20, "क ख ग।\nown one"), (21, "other start\nक ख ग।\nown two"), (30, prose(rng, 50) + " zz"), (31, "A clean text. With nothing twice\n")]
    spans = repeats.repeated_spans(docs(spark, rows))
    text = dict(rows)
    got = sorted((r.doc_id, text[r.doc_id][r.start : r.end]) for r in spans.collect())
    line = "Released under the MIT license."
    assert [g for g in got if g[0] != 11] == [(2, line), (3, line), (21, "क ख ग।")]
    (long,) = [g for g in got if g[0] == 11]
    assert len(long[1].split()) >= 20 and long[1] in passage
    cleaned = {r.doc_id: r.text for r in repeats.remove_spans(docs(spark, rows), spans).collect()}
    assert cleaned == text | {2: text[2].replace(line, ""), 3: text[3].replace(line, ""), 11: text[11].replace(long[1], ""), 21: text[21].replace("क ख ग।", "")}


def test_lines_alone(spark):
    line = "A long line. It has more than eight words, as it must."
    rows = [(1, line + "\nown words here"), (2, "x\n" + line), (3, line.split(".")[0] + "."), (4, "as " + line)]
    assert [(r.doc_id, r.start, r.kept_doc_id) for r in repeats.repeated_spans(docs(spark, rows), passages=False).collect()] == [(2, 2, 1)]


# --- all together ----------------------------------------------------------------------------------------------------


def test_queries_with_sql(spark, sf):
    con = connection(sf)
    for name, sql in oracle_sql().items():
        assert spark_rows(QUERIES[name](spark, sf)) == sql_rows(con, sql)
    assert sorted({n.split("_")[0] for n in QUERIES}, key=lambda n: int(n[2:])) == [f"op{i}" for i in range(1, 14)]


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in d.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf)
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(before)
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out = neardup.materialise(out, "stage")
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count()
        if name == "near-duplicates":
            classes, _ = _classes(list(before.items()), 5)
            assert set(after) == {k for k, c in classes.items() if k == c}
        if name == "personal data":
            assert set(after) == set(before) and not any("@mail" in (t or "") for t in after.values())
        before, d = after, out


def test_stages_on_odd_rows(spark, sf):
    import corpus_pipeline

    rng = random.Random(30)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    good = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id").orderBy("doc_id").first().text
    rows = [(1, None), (2, ""), (None, good + " one"), (3, good), (3, good), (4, good + " end"), (5, item), (6, "mail a@b.co"), (7, prose(rng, 60_000)), (8, "one"), (8, "two")]
    df = spark.createDataFrame([(d, t, "en", "src", len(t or ""), "x", 1.5, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component string, rank double, _dropped string")
    key = lambda frame: sorted((str(r.doc_id), r.text or "") for r in frame.collect())
    every = key(df)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, df, sf), stage(spark, df.limit(0), sf)
        assert none.count() == 0
        if name == "packing":
            assert out.agg(F.sum(F.col("is_last").cast("int"))).first()[0] == len(rows)
            continue
        assert out.columns == df.columns == none.columns and {(r.component, r.rank) for r in out.select("component", "rank").collect()} == {("x", 1.5)}
        got = key(out)
        if name == "quality classifier":
            assert set(got) <= set(every) and got.count(("3", good)) == 2
        elif name == "near-duplicates":
            assert [d for d, _ in got] == ["1", "2", "3", "5", "6", "7", "8", "None"] and ("8", "one") in got
        elif name == "decontamination":
            assert got == [x for x in every if x[0] != "5"]
        else:
            assert [d for d, _ in got] == [d for d, _ in every] and ("6", "mail [EMAIL]") in got and out.where("doc_id = 6").first().n_chars == len("mail [EMAIL]")
