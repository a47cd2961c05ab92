"""Patterns run on the triples between keywords, not on all of them, and ask what they asked before."""

from assetgraph.operators import extract as x
from assetgraph.plans.registry import QUERIES

ROWS = [
    (1, 1, "a", " r ", "b", " one\n two "), (1, 2, "a", "  ", "b", "no predicate"), (1, 3, "b", None, "a", "no predicate"), (1, 4, "b", "r", "a", " \t　"), (1, 5, "b", "r", "a", None),
    (1, 6, "b", "p" * 64 + " ", "a", "x" * 161), (1, 7, "b", "p" * 65, "a", "too long"), (1, 8, "a", "r", "c", "no keyword"), (1, 9, "a", "r", "a", "\u0001"), (2, 1, "a", "r", "b", "other asset"), (1, 10, "a", "r", "b", "late"),
]


def test_admission_of_odd_predicates_and_evidences(spark):
    triples = spark.createDataFrame(ROWS, "k long, pos int, subject string, predicate string, object string, evidence string")
    keywords = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k long, keyword string")
    found = x.document_triples(triples, keywords, "k", "pos")
    assert sorted((r.pos, r.predicate, r.evidence) for r in found.collect()) == [(1, "r", "one two"), (6, "p" * 64, "x" * 159 + "…"), (9, "r", "\u0001")]


def test_patterns_stand_behind_the_keywords(spark, sf):
    lines = QUERIES["q_document_triples"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(lines) if "Join Inner" in line)
    assert "regexp_replace" in lines[join] and lines[join].index("array_contains") < lines[join].index("RLIKE")
    assert not [line for line in lines[join + 1 :] if "regexp" in line or "RLIKE" in line]
