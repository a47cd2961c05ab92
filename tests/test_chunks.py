"""Packing under several budgets against the rule, unit by unit."""

import json
import random

from assetgraph.operators import chunks


def _tokens(t):
    a = sum(ord(c) < 128 for c in t)
    return (a + 2) // 3 + 2 * (len(t) - a)


def _fits(units, b):
    return (
        sum(_tokens(p + t) + b.image_tokens * i for p, t, i in units) <= b.tokens and sum(i for _, _, i in units) <= b.images and sum(len(t) for _, t, _ in units) <= b.chars
        and sum(len(json.dumps({"location": p, "text": t})) + 2 for p, t, _ in units) + chunks.OVERHEAD_BYTES <= b.bytes_
    )


def _cut(unit, b):
    p, t, i = unit
    if _fits([unit], b) or len(t) < 2:
        return [unit]
    half = len(t) // 2
    stop = max(t.rfind("\n", 0, half), t.rfind("。", 0, half))
    half = stop + 1 if stop >= half // 2 else half
    return _cut((p, t[:half], i), b) + _cut((p, t[half:], i), b)


def _pack(units, b):
    out, batch = [], []
    for n, unit in enumerate(units):
        for piece in _cut(unit, b):
            if batch and not _fits([*(u for _, u in batch), piece], b):
                out.append(batch)
                batch = []
            batch.append((n, piece))
    return [[(n, u[1]) for n, u in x] for x in [*out, batch] if x]


def test_units_are_packed_as_one_after_the_other(spark):
    rng = random.Random(5)
    docs = {d: [("p%d" % rng.randrange(30), "".join(rng.choice('ab "\\\n\t\x01\x7fé中𝄞。 ') for _ in range(rng.choice((0, 1, 5, 40, 400)))), rng.random() < 0.2) for _ in range(rng.randrange(1, 25))] for d in range(25)}
    rows = [(d, k, p or None, t or None, i or None) for d, units in docs.items() for k, (p, t, i) in enumerate(units)]
    df = spark.createDataFrame(rows, "doc long, pos long, location string, text string, has_image boolean").repartition(4)
    for b in (chunks.Budgets(120, 9500, 2, image_tokens=30), chunks.Budgets(10_000, 8700, 3), chunks.Budgets(10_000, 1 << 40, 99, chars=90), chunks.Budgets(1, 1, 0, image_tokens=5)):
        found = {}
        for r in chunks.pack_units(df, "doc", "pos", b).collect():
            found.setdefault(r.doc, {}).setdefault(r.chunk, []).append((r.pos, r.part, docs[r.doc][r.pos][1][r.begin : r.end]))
        got = {d: [[(n, t) for n, _, t in sorted(c[k])] for k in sorted(c)] for d, c in found.items()}
        assert got == {d: _pack(units, b) for d, units in docs.items()}
    assert chunks.pack_units(df.limit(0), "doc", "pos", b).count() == 0


def test_a_text_is_read_once_and_cut_in_one_pass(spark, sf):
    from assetgraph.plans.extract import QUERIES

    plan = QUERIES["q_pack_units"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "substring(text" not in plan


def test_units_of_lengths_around_a_multiple(spark, tmp_path):
    from assetgraph.plans.extract import QUERIES, UNIT

    lengths = {1: 0, 2: UNIT - 1, 3: UNIT, 4: UNIT + 1, 5: 3 * UNIT}
    rows = [(d, ("a𝄞\n" * n)[:n], "s", "en") for d, n in lengths.items()] + [(6, None, "s", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r.doc_id, r.pos, r.begin, r.end) for r in QUERIES["q_pack_units"](spark, str(tmp_path)).collect())
    assert found == [(d, k, 0, min(UNIT, n - k * UNIT)) for d, n in lengths.items() for k in range(n // UNIT + 1)]
