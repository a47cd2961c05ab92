"""Names that differ within their group, in few passes whatever the names are."""

import random

import pytest

from assetgraph.functions.names import dedup_headers
from assetgraph.operators.drawings import stable_ids
from assetgraph.operators.suffixes import suffixed
from assetgraph.scratch import saved


def _one_by_one(rows, sep):
    used, out = {}, {}
    for g, i, n in sorted(rows, key=lambda r: r[1]):
        taken = used.setdefault(g, set())
        out[g, i] = n if n not in taken else next(x for k in range(2, len(taken) + 3) if (x := f"{n}{sep}{k}") not in taken)
        taken.add(out[g, i])
    return out


@pytest.mark.parametrize("sep", ["_", "-"])
def test_suffixes_as_one_row_after_the_other_takes_them(spark, sep):
    rnd = random.Random(5)
    pools = [["a", "a_2", "a_2_2", "a_3"], ["a", "a_2", "a_3", "a_4", "a_5", "b", "b_2"], ["a", "a_02", "a_1", "a_2", "a_2_3", "a_10"], ["x\n", "x\n_2", "", "_2", "_2_2"]]
    rows = []
    for g in [None, *range(30)]:
        pool = rnd.choice(pools)
        rows += [(g, i * 7, rnd.choice(pool).replace("_", sep)) for i in range(rnd.randint(1, 60))]
    df = spark.createDataFrame(rows, "g long, i long, n string")
    got = {(r.g, r.i): r.out for r in suffixed(df, "g", "i", "n", sep, "out", saved).collect()}
    assert got == _one_by_one(rows, sep)


def _counted():
    calls = []

    def save(df):
        calls.append(1)
        if len(calls) > 20:
            raise AssertionError("a round for each repeat")
        return saved(df)

    return save


def test_headers_take_few_rounds(spark):
    rows = [("t", i, "a_2" if i == 40 else "a") for i in range(80)] + [("t", 80, "a_2")]
    found = dedup_headers(spark.createDataFrame(rows, "g string, i long, n string"), "g", "i", "n", _counted())
    assert {(r.g, r.i): r.header for r in found.collect()} == _one_by_one(rows, "_")


def test_ids_take_few_rounds(spark):
    rows = [("t", i, "p-2" if i == 1 else "p") for i in range(60)]
    found = stable_ids(spark.createDataFrame(rows, "g string, i long, n string"), "g", "i", "n", "occ", _counted())
    assert {(r.g, r.i): r.id for r in found.collect()} == _one_by_one(rows, "-")
