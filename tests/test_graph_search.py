"""Search by path, type and word at once, and the graph around the hits."""

import pytest
from pyspark.sql import functions as F

from assetgraph.operators import graph, graph_search


@pytest.fixture(scope="module")
def data(spark):
    assets = spark.createDataFrame(
        [(1, "/a/b", "one.pdf", "file", 90), (2, "/a/b", "two.csv", "relational", None), (3, "/a", "three.pdf", "FILE", None), (4, "/c", "york.pdf", "file", 1), (5, "/", "root.pdf", "file", None)],
        "k long, logical_path string, file_name string, data_type string, updated long",
    )
    mentions = spark.createDataFrame([(1, "newyork", "New York"), (1, "boston", "Boston"), (1, "paris", "Paris"), (2, "newyork", "New York"), (3, "boston", "Boston"), (4, "rome", "Rome")], "k long, norm string, name string")
    folders = spark.createDataFrame([("/a", 3), ("/a/b", 2), ("/c", 4), ("/", 5)], "path string, key long")
    told = spark.createDataFrame([("/c", "newyork", "New York"), ("/c", "rome", "Rome")], "path string, norm string, name string")
    relations = spark.createDataFrame([(1, "boston", "newyork", True), (1, "newyork", "paris", False), (2, "boston", "newyork", True)], "k long, a string, b string, related boolean")
    return assets, mentions, folders, told, relations


def _ids(df):
    return [(r.kind, r.id) for r in sorted(df.collect(), key=lambda r: (r.kind, r.rank))]


def test_hits_by_entity_names_folders_and_filters(data):
    assets, mentions, folders, told, _ = data
    find = lambda *a, **k: _ids(graph_search.hits(assets, mentions, "k", *a, folders=folders, folder_mentions=told, **k))
    assert find("new york") == [("asset", "asset:2"), ("asset", "asset:1"), ("directory", "/c")]
    assert find("new york", updated="updated") == [("asset", "asset:1"), ("asset", "asset:2"), ("directory", "/c")]
    assert find("NEWYORK", "file") == [("asset", "asset:1")]
    assert find("boston", "File", "/a") == [("asset", "asset:3"), ("asset", "asset:1")]
    assert find("york", path="/c") == [("asset", "asset:4"), ("directory", "/c")]
    assert find("", path="/a/b/t") == [("asset", "asset:2")]
    assert [i for k, i in find("") if k == "asset"] == ["asset:5", "asset:4", "asset:3", "asset:2", "asset:1"]
    assert find("nothing there") == []


def test_the_graph_around_hits(data):
    assets, mentions, folders, told, relations = data
    found = graph_search.hits(assets, mentions, "k", "new york", folders=folders, folder_mentions=told)
    drawings = assets.where("k = 2").select("k", F.lit("component:2").alias("component"))
    rows = graph_search.expanded(found, mentions, relations, "k", "new york", 20, drawings, told).collect()
    edges = {(r.hit, r.kind, r.src, r.dst) for r in rows if r.kind != "NODE"}
    assert {(r.src, r.matched) for r in rows if r.kind == "NODE"} == {("asset:1", True), ("asset:2", True), ("/c", True)}
    assert edges == {
        ("asset", "CONTAINS", "/", "/a"), ("asset", "CONTAINS", "/a", "/a/b"), ("asset", "HAS_DATA", "/a/b", "asset:1"), ("asset", "HAS_DATA", "/a/b", "asset:2"),
        ("asset", "MENTIONS", "asset:1", "newyork"), ("asset", "MENTIONS", "asset:1", "boston"), ("asset", "SEMANTIC_RELATION", "boston", "newyork"), ("asset", "DEPICTS", "asset:2", "component:2"),
        ("directory", "CONTAINS", "/", "/c"), ("directory", "MENTIONS", "/c", "newyork"), ("directory", "MENTIONS", "/c", "rome"),
    }
    assert graph_search.expanded(found.limit(0), mentions, relations, "k", "x").count() == 0


def test_the_row_budget_keeps_the_best_ranks(spark):
    assets = spark.createDataFrame([(i, "/p", f"f{i}", "file") for i in range(40)], "k long, logical_path string, file_name string, data_type string")
    mentions = spark.createDataFrame([(i, f"e{j}", f"E {j}") for i in range(40) for j in range(30)], "k long, norm string, name string")
    relations = spark.createDataFrame([], "k long, a string, b string, related boolean")
    found = graph_search.hits(assets, mentions, "k", max_nodes=20)
    rows = graph_search.expanded(found, mentions, relations, "k", max_nodes=20).collect()
    assert found.count() == 20 and len(rows) == 100 and {r.rank for r in rows} == {1, 2, 3, 4} and sum(r.rank == 1 for r in rows) == 33


def test_assets_below_a_path_by_update_time(data):
    assets, mentions, _, _, _ = data
    ranks = lambda **k: [r.dst for r in graph.query_prefix(assets, mentions, "k", "logical_path", "/a", 20, **k).where("kind = 'HAS_DATA'").orderBy("rank").collect()]
    assert ranks() == ["asset:3", "asset:2", "asset:1"] and ranks(updated="updated") == ["asset:1", "asset:3", "asset:2"]


def test_names_that_are_shown(spark):
    rows = [("LogicalPath", " ", None, "/a/b/", None, None, "b"), ("LogicalPath", "n", None, "/", None, None, "n"), ("LogicalPath", None, None, "/", None, None, "/"), ("DataAsset", None, "f", None, "/l", None, "f"), ("DataAsset", None, "", None, "/l", None, "/l"), ("DataAsset", None, None, "/p", None, "x", "/p"), ("Entity", None, None, None, None, "x", "x"), ("Entity", None, None, None, None, None, "(unknown)")]
    df = spark.createDataFrame(rows, "label string, name string, file_name string, path string, logical_path string, norm string, want string")
    assert all(r.shown == r.want for r in graph_search.display_names(df).collect())
