from pyspark.sql import functions as F

from assetgraph.operators.catalog import current_state
from assetgraph.scratch import complete_folders, fresh_path
from assetgraph.streaming import feeds, state


def _append(spark, path, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _run(spark, source, schema, catalog, checkpoint=None):
    catalog.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), checkpoint).awaitTermination()


def _states(spark, catalog, schema):
    return sorted(map(tuple, catalog.state(spark, spark.createDataFrame([], schema).schema).collect()))


def test_streamed_catalog_equals_the_batch_state_on_any_checkpoint(spark, tmp_path):
    """Several batches, a restart on the checkpoint, and new checkpoints on a table that other streams have written."""
    path, source, checkpoint, catalog = fresh_path(spark, "catalog"), str(tmp_path / "log"), str(tmp_path / "c"), None
    schema = "k long, seq long, a string, b long"
    catalog = state.StreamedCatalog(path, "k", "seq")
    assert _states(spark, catalog, schema) == []
    for part in ([(1, 5, "new", None), (2, 1, None, 7), (None, 1, "x", 1)], [(1, 1, "old", 3), (2, 9, "a", None)], [(3, 1, None, None), (1, 7, None, 4), (3, None, "z", None)]):
        _append(spark, source, schema, part)
    _run(spark, source, schema, catalog, checkpoint)
    _append(spark, source, schema, [(2, 10, "late", None), (1, 6, "newer", 99), (4, 1, "four", None)])
    _run(spark, source, schema, catalog, checkpoint)
    batch = current_state(spark.read.schema(schema).parquet(source).where("k is not null and (a is not null or b is not null)"), "k", "seq").where("a is not null or b is not null")
    want = sorted(map(tuple, batch.where("k <> 3").collect()))
    assert _states(spark, catalog, schema) == want == [(1, "newer", 4), (2, "late", 7), (4, "four", None)]
    other = str(tmp_path / "other")
    for rows in ([(2, 11, "again", None)], [(5, 1, "five", 5)], [(1, 2, "too old", None)]):
        _append(spark, other, schema, rows)
    for _ in range(2):  # two new checkpoints on the old table; the second brings nothing new
        _run(spark, other, schema, catalog)
        assert _states(spark, catalog, schema) == [(1, "newer", 4), (2, "again", 7), (4, "four", None), (5, "five", 5)]


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    path, source, checkpoint = fresh_path(spark, "catalog"), str(tmp_path / "log"), str(tmp_path / "c")
    schema = "k long, seq long, a string"
    catalog = state.StreamedCatalog(path, "k", "seq")
    _append(spark, source, schema, [(k, 1, f"v{k}") for k in range(300)])
    _run(spark, source, schema, catalog, checkpoint)
    _append(spark, source, schema, [(7, 2, "changed"), (8, 0, "stale"), (9, 1, "v9")])
    _run(spark, source, schema, catalog, checkpoint)
    sizes = [spark.read.parquet(f).count() for f in complete_folders(spark, path, 2)]
    assert sizes == [300, 1]
    assert len(_states(spark, catalog, schema)) == 300 and (7, "changed") in _states(spark, catalog, schema)
    for _ in range(2):
        catalog.compact(spark, spark.createDataFrame([], schema).schema)
        assert len(_states(spark, catalog, schema)) == 300 and (7, "changed") in _states(spark, catalog, schema)
    assert len(complete_folders(spark, path, 2)) == 2  # the two merged ones: the batches are gone
    wider = "k long, seq long, a string, n int"  # a column that appears later, on the old checkpoint's table
    more = str(tmp_path / "more")
    _append(spark, more, wider, [(7, 3, None, 70), (400, 1, None, 4)])
    _run(spark, more, wider, catalog)
    found = dict((k, (a, n)) for k, a, n in _states_null(spark, catalog, wider))
    assert found[7] == ("changed", 70) and found[400] == (None, 4) and found[8] == ("v8", None) and len(found) == 301


def _states_null(spark, catalog, schema):
    return [tuple(r) for r in catalog.state(spark, spark.createDataFrame([], schema).schema).collect()]


def test_leaf_pipelines_on_new_checkpoints_keep_earlier_rows(spark, tmp_path):
    schema, path = "asset_key long, status string, is_valid boolean", fresh_path(spark, "leaves")
    for n in (1, 2):
        source = str(tmp_path / f"in{n}")
        _append(spark, source, schema, [(n, "PENDING", True), (10 + n, "SUCCESS", True)])
        feeds.run_available(spark.readStream.schema(schema).parquet(source), feeds.LeafPipeline(path, lambda df: df.select("asset_key")))
    assert sorted(r.asset_key for r in spark.read.schema("asset_key long").parquet(path).select("asset_key").collect()) == [1, 2]


def test_a_ring_keeps_the_last_events_late_ones_too(spark, tmp_path):
    path, schema = fresh_path(spark, "ring"), "seq long, text string"
    ring = state.EventRing(path, "seq", schema, most=10, batches=3)
    assert ring.events(spark).count() == 0
    seen = set()
    for n, seqs in enumerate([range(1, 40), [3, 50, 49], range(60, 64), [], [48, 47, 2, 63], [61, 200], range(41, 46), range(70, 72)]):
        source = str(tmp_path / f"in{n}")
        _append(spark, source, schema, [(q, f"e{q}") for q in seqs] + [(None, "x")])
        feeds.run_available(spark.readStream.schema(schema).parquet(source), ring)  # a checkpoint of its own each time
        seen |= set(seqs)
        assert sorted(r.seq for r in ring.events(spark).collect()) == sorted(seen)[-10:]
        assert len(complete_folders(spark, path, 2)) <= 4
        since = [r.seq for r in feeds.events_since(ring.events(spark).withColumn("level", F.lit("info")), "seq", 45, 3).collect()]
        assert since == [q for q in sorted(seen)[-10:] if q > 45][-3:]


def test_requests_are_in_flight_until_their_end_or_the_time_out(spark, tmp_path):
    source, path, checkpoint = str(tmp_path / "feed"), fresh_path(spark, "admitted"), str(tmp_path / "c")
    schema = "focus string, seq long, s long, done boolean"
    parts = [
        [("a", 1, 0, False), ("a", 2, 5, False), ("b", 3, 6, True), ("b", 4, 7, False), (None, 5, 8, False)],
        [("a", 6, 20, False), ("a", 7, 30, True), ("b", 8, 40, None)],  # a is released at 7; b's request is still in flight
        [("a", 9, 50, False), ("b", 10, 107, False), ("b", 11, 150, False)],  # b's request of 7 s has run out at 107
        [("a", 12, 9000, False), ("b", 13, 9001, True), ("b", 14, 9002, False)],
    ]
    for rows in parts:
        _append(spark, source, schema, rows)
        feed = spark.readStream.schema(schema).parquet(source).withColumn("at", F.timestamp_seconds(F.col("s") + 1000))
        found = state.collect_stream(state.in_flight_requests(feed, "focus", "seq", "at", "done", 100_000, "30 seconds"), checkpoint=checkpoint, path=path)
    assert sorted((r.focus, r.seq) for r in found.collect()) == [("a", 1), ("a", 9), ("a", 12), ("b", 4), ("b", 10), ("b", 14)]


def test_deduplicated_stream(spark, tmp_path):
    path = str(tmp_path / "requests")
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], "focus string, s int").withColumn("ts", F.timestamp_seconds(F.col("s")))
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    assert sorted(r.focus for r in feeds.collected(feeds.dedup_requests_stream(stream, "focus", "ts", "1 hour")).collect()) == ["a", "b"]


def test_directories_over_several_batches_equal_one_roll_up(spark, tmp_path):
    from assetgraph.operators.extract import roll_up
    from assetgraph.scratch import saved

    schema = "asset_key long, logical_path string, status string, keywords array<string>"
    parts = [[(1, "/a/b", "SUCCESS", ["x"]), (2, "/a/c", "SUCCESS", ["y"])], [(3, "/a/c", "FAILED", None), (4, "/d", "SUCCESS", ["z"])], [(3, "/a/c", "SUCCESS", ["w"])]]
    now = {}
    sink = feeds.DirectoryPipeline(fresh_path(spark, "folders"), lambda: spark.createDataFrame(list(now.values()), schema))
    sink(spark.createDataFrame([], schema), 0)  # a batch without rows first
    assert sink.table(spark).count() == 0
    for n, part in enumerate(parts, 1):
        now |= {r[0]: r for r in part}
        sink(spark.createDataFrame(part, schema), n)
        want = roll_up(spark.createDataFrame(list(now.values()), schema), "asset_key", "logical_path", "keywords", saved)
        got = sink.table(spark)
        assert sorted((r.path, r.status, sorted(r.keywords or [])) for r in got.collect()) == sorted((r.path, r.status, sorted(r.keywords or [])) for r in want.collect())


def test_last_values_go_by_rows():
    """No data frame is made for a key."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    kept = {}
    one = {}
    cells = SimpleNamespace(iterator=lambda: iter(list(kept.items())), updateValue=lambda k, v: kept.update({k: v}))
    revision = SimpleNamespace(get=lambda: one.get("n"), update=lambda v: one.update(n=v))
    last = state.LastValues("seq", ["a", "b"])
    last.init(SimpleNamespace(getMapState=lambda *_: cells, getValueState=lambda *_: revision))
    rows = lambda *r: iter([Row(k=1, seq=s, a=a, b=b) for s, a, b in r])
    assert list(last.handleInputRows((1,), rows((2, "x", None), (1, "y", "z"), (2, "w", None)), None)) == [Row(**{"key": 1, state.REVISION: 1, "a__seq": 2, "a": "x", "b__seq": 1, "b": "z"})]
    assert list(last.handleInputRows((1,), rows((1, "late", None), (0, None, "old")), None)) == []
    assert list(last.handleInputRows((1,), rows((3, None, "new")), None)) == [Row(**{"key": 1, state.REVISION: 2, "a__seq": 2, "a": "x", "b__seq": 3, "b": "new"})]
