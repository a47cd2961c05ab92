"""Places and budgets in groups that are large, sparse or hot, against the rule."""

import random

import pytest

from assetgraph.operators import extract, ordered
from assetgraph.sources import files


@pytest.fixture
def eight_ranges(spark):
    """Small shuffles stay apart, as large ones would."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _rows():
    """A hot group, sparse orders, a group of one, and rows without a group."""
    rng = random.Random(3)
    orders = rng.sample(range(1 << 60), 9000)
    return [("hot", o) for o in orders[:8000]] + [("cold", o) for o in orders[8000:8500]] + [(None, o) for o in orders[8500:8999]] + [("one", orders[8999])]


def test_places_of_sparse_and_hot_groups(eight_ranges):
    rows = _rows()
    df = eight_ranges.createDataFrame(rows, "g string, o long").repartition(5)
    want = {}
    for g in {g for g, _ in rows}:
        want |= {(g, o): k for k, o in enumerate(sorted(o for h, o in rows if h == g))}
    assert {(r.g, r.o): r.at for r in ordered.ordinals(df, "g", "o", "at").collect()} == want
    sizes = [r["count"] for r in ordered.ranges(df, "g", "o").groupBy("_ord_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * len(rows) / 8
    assert ordered.ordinals(df.limit(0), "g", "o", "at").count() == 0


def test_budgets_of_hot_groups(eight_ranges):
    rng = random.Random(4)
    rows = [(g, o, rng.choice((0, 1, 7, 300))) for g, o in _rows()]
    df = eight_ranges.createDataFrame(rows, "g string, o long, c long").repartition(7)
    for budget in (1, 50, 2000, 1 << 40):
        want = set()
        for g in {g for g, _, _ in rows}:
            spent = 0
            for _, o, c in sorted(r for r in rows if r[0] == g):
                if spent < budget:
                    want.add((g, o, spent))
                spent += c
        assert {(r.g, r.o, r.b) for r in ordered.within_budget(df, "g", "o", "c", budget, "b").collect()} == want
        near = ordered.cut_locally(df, "g", "o", "c", budget).count()
        assert near >= len(want) and (budget > 2000 or near < len(rows) / 2)


def test_one_asset_is_cut_where_it_is_read(eight_ranges):
    """Of an asset with many values each task keeps a budget's worth, so what is shuffled does not grow with the asset."""
    values = eight_ranges.range(0, 20_000, 1, 10).selectExpr("'a' as asset", "id as pos", "concat('v', id) as v")
    text = "\n".join(f"v{k}" for k in range(3000))
    got = extract.bounded_text(values, "asset", "pos", "v", total=100).collect()
    assert len(got) == 1 and got[0].text.startswith(text[:90]) and len(got[0].text) <= 100
    pieces = eight_ranges.range(0, 2000, 1, 6).selectExpr("1L as k", "id as chunk_no", "cast(repeat('x', 10) as binary) as bytes").unionAll(eight_ranges.sql("select 2L, 0L, cast(null as binary)"))
    found = {r.k: bytes(r.content or b"") for r in files.reassemble(pieces, "k", 95).collect()}
    assert found == {1: b"x" * 95, 2: b""}
