"""Analyses are normalised by all tasks, and their lists are read of drawings alone."""

from assetgraph.operators import drawings as d
from assetgraph.plans.graph import QUERIES

BODIES = {
    1: '{"classification":{"documentClass":" engineering_drawing "},"dimensions":[{"a": 1},"no object", {"b":[2]},3,null],"notes":["x",{"y":1}]}',
    2: '{"classification":{"documentClass":"photo"},"dimensions":[{"a":1}],"notes":["x"]}',
    3: '{"classification":{"documentClass":"photo","isEngineeringDrawing":true},"dimensions":"no list","notes":["n"]}',
    4: '{"classification":{"documentClass":"engineering_drawing"},"notes":["n"],"dimensions":[{}',
    5: None,
    6: '{"classification":{"documentClass":"technical_illustration"}}',
}
DRAWINGS = {1: (['{"a":1}', '{"b":[2]}'], ["x", '{"y":1}']), 3: ([], ["n"]), 6: ([], [])}


def test_lists_are_those_of_drawings(spark):
    found = d.normalize_analysis(spark.createDataFrame(list(BODIES.items()), "k long, body string"), "k", "body").collect()
    assert {r.k: (r.dimensions, r.notes) for r in found if r.engineering} == DRAWINGS
    assert all(r.dimensions == r.notes == [] for r in found if r.k not in DRAWINGS) and len(found) == len(BODIES)


def test_entries_are_read_after_the_class_is_known(spark):
    found = d.normalize_analysis(spark.createDataFrame(list(BODIES.items()), "k long, body string"), "k", "body")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("StructField(dimensions") == 1 and "THEN from_json(StructField(partDefinitions" in plan


def test_analyses_are_spread_over_tasks(spark, sf):
    assert QUERIES["q_drawing_normalize"](spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
