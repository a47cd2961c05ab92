"""XML texts are dealt among tasks by their number, and leaves are named and typed as before."""

from pyspark.sql import functions as F

from assetgraph.plans import ingest
from assetgraph.sources import documents


def test_orders_are_dealt_by_their_number(spark, sf, monkeypatch):
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert len(ingest.q_xml_documents(spark, sf).inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(ingest, "TASK_ORDERS", -(-n // 9))
    assert len(ingest.q_xml_documents(spark, sf).inputFiles()) == 9


def test_leaves_without_variants(spark):
    body = """{"a": 2147483647, "b": [2147483648, -2147483648, -2147483649, 1.5, 1e300, true, null, "x\\"y"], " 1c d\\n": {"$oid": "q"}, "e": {"$oid": null}, "f": {"$oid": {"g": 1}},
 "k\\n": {}, "h": [], "": "", "ä$@-": 9223372036854775807, "_kind": [[1, {"t": 2}]]}"""
    docs = spark.createDataFrame([(1, 0, body)], "k int, doc_no int, j string").select("k", "doc_no", F.try_parse_json("j").alias("doc"))
    got = sorted((r.path, r.elem, r.type, r.value) for r in documents.shred(docs, "k").collect())
    assert got == sorted([
        ("a", 0, "integer", "2147483647"), ("b", 0, "long", "2147483648"), ("b", 1, "integer", "-2147483648"), ("b", 2, "long", "-2147483649"), ("b", 3, "double", "1.5"), ("b", 4, "double", "1.0E300"),
        ("b", 5, "boolean", "true"), ("b", 7, "text", 'x"y'), ("c_1c_d", 0, "text", 'ObjectId("q")'), ("f", 0, "text", 'ObjectId("{"g":1}")'), ("value", 0, "text", ""),
        ("_$@-", 0, "long", "9223372036854775807"), ("_kind", 0, "integer", "1"), ("_kind.t", 1, "integer", "2"),
    ])
