"""The table function that takes a table, for keys of several types, against the rule."""

import random

import pytest

from assetgraph.operators.table_functions import register_relations


def _expected(facts, focus, each):
    out = {}
    for key in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == key and f[1] is not None]
        norms = sorted({f[1] for f in own if f[2] is None})
        if focus not in norms:
            continue
        for c in [n for n in norms[:each] if n != focus]:
            pair = [f for f in own if f[2] is not None and {f[1], f[2]} == {c, focus}]
            known = [f[3] for f in pair if f[3] is not None]
            answers = [f[4] for f in pair if f[4] is not None]
            status = "unknown" if not known else "related" if any(known) else "unrelated"
            out[key, c] = (status, min(c, focus), max(c, focus), *((bool(answers), min(answers) if answers else "no relation", "query-udf") if not known else (None, None, None)))
    return out


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_relations_of_any_table(spark, kind):
    import datetime

    rng, make = random.Random(8), {"long": int, "string": str, "date": lambda k: datetime.date(2024, 1, 1 + k)}[kind]
    words = [f"w{k}" for k in range(9)] + ["é", "𝄞", ""]
    facts = [(make(k), rng.choice(words), None, None, None) for k in range(20) for _ in range(6)]
    facts += [(make(k), *rng.sample(words, 2), rng.choice((True, False, None)), rng.choice(("x", "y", None))) for k in range(20) for _ in range(12)]
    facts += [facts[0], facts[-1], (make(3), None, "w1", True, None), (make(21), "w1", None, None, None)]
    rng.shuffle(facts)
    register_relations(spark)
    spark.createDataFrame(facts, f"k {kind}, norm string, other string, related boolean, answer string").repartition(5).createOrReplaceTempView("facts")
    for each in (3, 30):
        found = spark.sql(f"select * from ag_relations(TABLE(facts), 'w1', {each})")
        assert dict(found.dtypes)["k"] == {"long": "bigint"}.get(kind, kind)
        assert {(r[0], r[1]): tuple(r[2:]) for r in found.collect()} == _expected(facts, "w1", each)
    short = spark.sql("select * from ag_relations(TABLE(select k, norm, other, related from facts), 'w1')")
    assert short.columns == ["k", "candidate", "status"]
    assert {(r[0], r[1]): r[2] for r in short.collect()} == {x: v[0] for x, v in _expected(facts, "w1", 30).items()}
    assert spark.sql("select * from ag_relations(TABLE(select * from facts where false), 'w1')").count() == 0


def test_arguments_that_do_not_fit(spark):
    register_relations(spark)
    spark.sql("select 1L as k, 'a' as norm, 'b' as other, true as related").createOrReplaceTempView("fits")
    for table, rest in (("select 1 as k, 2 as norm, 'b' as other, true as related", "'a'"), ("select norm, other, related from fits", "'a'"), ("select * from fits", "3"), ("select * from fits", "'a', 0")):
        with pytest.raises(Exception, match="ag_relations needs"):
            spark.sql(f"select * from ag_relations(TABLE({table}), {rest})").collect()


def test_the_query_passes_facts_once_and_around_the_focus(spark, sf):
    from assetgraph.plans.surface import QUERIES

    QUERIES["q_sql_relations"](spark, sf)
    shipped = spark.table("ag_shipped")
    assert shipped.count() == shipped.distinct().count()
    known = spark.table("ag_known")
    assert known.select("asset_key").distinct().count() == known.where("norm = 'the'").count() > 0
