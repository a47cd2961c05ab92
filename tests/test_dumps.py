"""Dumps and feeds written from rows and read back through their data sources."""

import contextlib
import io

import pytest

from assetgraph.sources import dumps

HARD = ["", "tab\there", "line\nbreak\r", "back\\slash\\t", "é𝄞", "true", "12", "x" * 5000]


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_a_dump_is_read_back_typed_and_in_blocks(spark, tmp_path):
    path = f"{tmp_path}/d"
    cells = [(k, p, v) for k in range(-300, 300) for p, v in (("text", HARD[k % 8]), ("n", str(k)), ("x.y", str(k / 4)), ("b", "TRUE" if k % 2 else "odd"), ("not listed", "1")) if (k + len(p)) % 5]
    df = spark.createDataFrame([*cells, (None, "n", "1"), (7, None, "1"), (8, "n", None), (9, "n", "9")], "key long, path string, value string").repartition(3)
    dumps.write_dump(spark, df, [("text", "TEXT"), ("n", "INTEGER"), ("x.y", "double"), ("b", "BOOLEAN"), ("empty", "LONG")], path, block_bytes=20_000)
    dumps.register_sources(spark)
    read = lambda: spark.read.format("ag_dump").option("kind", "timeseries").load(path)
    want = {}
    for k, p, v in cells:
        row = want.setdefault(k, {"text": None, "n": None, "x.y": None, "b": None})
        if p in row:
            row[p] = {"text": lambda v: v, "n": int, "x.y": float, "b": lambda v: {"TRUE": True}.get(v)}[p](v)
    want.setdefault(9, {"text": None, "n": None, "x.y": None, "b": None})["n"] = 9
    assert read().dtypes == [("time", "bigint"), ("text", "string"), ("n", "int"), ("x.y", "double"), ("b", "boolean"), ("empty", "bigint")]
    assert {r[0]: (r[1], r[2], r[3], r[4], r[5]) for r in read().collect()} == {k: (*v.values(), None) for k, v in want.items()}
    whole = dumps.DumpReader(path, read().schema)
    assert len(whole.partitions()) > 5
    for text, keep in (("time > 250", lambda k: k > 250), ("time >= -3 and time < 4", lambda k: -3 <= k < 4), ("time in (-299, 17, 1000)", lambda k: k in (-299, 17)), ("time = 5", lambda k: k == 5), ("time <= -290 and n is not null", lambda k: k <= -290 and want[k]["n"] is not None)):
        found = read().where(text)
        assert {r.time for r in found.collect()} == {k for k in want if keep(k)}
        assert found.rdd.getNumPartitions() < len(whole.partitions())
    assert "PushedFilters" in _plan(read().where("time > 250"))
    assert read().where("time > 100000").count() == 0
    with pytest.raises(Exception, match="kind is one of"):
        spark.read.format("ag_dump").load(path)


def test_keys_that_are_texts_and_a_dump_without_cells(spark, tmp_path):
    keys = [*HARD, "a", "Z", "zz"]
    cells = spark.createDataFrame([(k, "v", str(i)) for i, k in enumerate(keys)], "key string, path string, value string")
    dumps.register_sources(spark)
    for name, rows in (("full", cells), ("none", cells.limit(0))):
        dumps.write_dump(spark, rows, [("v", "LONG")], f"{tmp_path}/{name}", block_bytes=1)
    found = spark.read.format("ag_dump").option("kind", "keyvalue").load(f"{tmp_path}/full")
    assert {(r.key, r.v) for r in found.collect()} == {(k, i) for i, k in enumerate(keys)}
    assert {r.key for r in found.where("key >= 'b'").collect()} == {k for k in keys if k.encode() >= b"b"}
    assert spark.read.format("ag_dump").option("kind", "keyvalue").load(f"{tmp_path}/none").count() == 0


def test_a_feed_goes_on_where_the_stream_stopped(spark, tmp_path):
    dumps.register_sources(spark)
    feed, out, state = f"{tmp_path}/feed", f"{tmp_path}/out", f"{tmp_path}/state"
    events = lambda a, b: spark.range(a, b).selectExpr("id as seq", "if(id % 3 = 0, null, 'WARN') as level", "concat('a\\tb', id) as text")

    def run():
        stream = spark.readStream.format("ag_feed").option("since", "10").load(feed)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.seq, r.level, r.text) for r in spark.read.parquet(out).collect())

    want = lambda b: [(k, "" if k % 3 == 0 else "WARN", f"a\tb{k}") for k in range(11, b)]
    dumps.append_feed(events(1, 400), feed)
    assert run() == want(400)
    assert run() == want(400)
    dumps.append_feed(events(400, 1000), feed)
    assert run() == want(1000)
