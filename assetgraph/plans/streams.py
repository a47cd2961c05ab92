"""Queries over feeds and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetgraph.fixtures import fixture, oracle, table
from assetgraph.operators.extract import route_file
from assetgraph.scratch import fresh_path
from assetgraph.sources import dumps
from assetgraph.streaming import feeds, state

SINCE, LIMIT, WIDTH = 100, 50, "1 hour"
IN_FLIGHT_MS = 2 * 86_400_000


def q_events_since(spark, sf):
    return feeds.events_since(fixture(spark, sf, "fx_events_log"), "seq", SINCE, LIMIT).select("seq", "level", "text")


def q_stream_events_since(spark, sf):
    """The events after a number among the last that a streamed feed has kept."""
    feed = _stream(spark, sf, "events").select((F.col("event_id") + 1).alias("seq"), F.col("event_type").alias("level"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("text"))
    ring = state.EventRing(fresh_path(spark, "ring"), "seq", "seq long, level string, text string", feeds.RETAINED)
    feeds.run_available(feed, ring)
    kept = ring.events(spark)
    first = kept.agg(F.min("seq")).first()[0]  # one number
    return feeds.events_since(kept, "seq", (first or 0) + SINCE, LIMIT).select("seq", "level", "text").unionByName(feeds.events_since(kept, "seq", 0, 1000).select("seq", "level", "text").withColumn("text", F.concat(F.lit("all: "), "text")))


def q_feed_source(spark, sf):
    """The events after a number, read by a stream from the segments of a feed."""
    dumps.register_sources(spark)
    path = fresh_path(spark, "feed")
    dumps.append_feed(fixture(spark, sf, "fx_events_log"), path)
    return state.collect_stream(spark.readStream.format("ag_feed").option("since", str(SINCE)).load(path))


def q_dedup_requests(spark, sf):
    return feeds.dedup_requests(fixture(spark, sf, "fx_events_log").select("text", "seq", "level"), "text", "seq")


def q_status_windows(spark, sf):
    events = table(spark, sf, "events").select("ts", F.col("event_type").alias("level"))
    return feeds.status_windows(events, "ts", WIDTH).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "level", "n")


def _stream(spark, sf, name):
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parquet*")


def q_stream_status_windows(spark, sf):
    """The windows that the watermark has closed, from the same events as a stream."""
    events = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("level"))
    return feeds.collected(feeds.status_windows(events, "ts", WIDTH, "10 minutes")).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "level", "n")


def q_stream_catalog(spark, sf):
    """Catalog state kept by a stream of sparse upserts, the same as the batch state of the log."""
    log = _stream(spark, sf, "orders").select(
        F.col("o_custkey").alias("asset_key"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("keywords"),
    )
    catalog = state.StreamedCatalog(fresh_path(spark, "catalog"), "asset_key", "seq")
    catalog.start(log).awaitTermination()
    return catalog.state(spark, log.schema)


def q_in_flight_requests(spark, sf):
    """Requests for a user that are admitted because none is in flight: it ends with an error or a purchase, or after two days."""
    feed = _stream(spark, sf, "events").select("user_id", "event_id", "ts", F.col("event_type").isin("error", "purchase").alias("is_end"))
    return state.collect_stream(state.in_flight_requests(feed, "user_id", "event_id", "ts", "is_end", IN_FLIGHT_MS, "40 days"))


def q_stream_leaf_pipeline(spark, sf):
    """Waiting assets from a stream of documents, routed and appended to a log."""
    assets = _stream(spark, sf, "documents").select(
        F.col("doc_id").alias("asset_key"), F.concat("source", F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".png").otherwise(".zip")).alias("file_name"),
        F.when(F.col("doc_id") % 4 == 0, "SUCCESS").otherwise("PENDING").alias("status"), (F.col("doc_id") % 29 != 0).alias("is_valid"),
    )
    path = fresh_path(spark, "leaves")
    feeds.run_available(assets, feeds.LeafPipeline(path, lambda df: df.select("asset_key", route_file(F.col("file_name")).alias("route"))))
    return spark.read.schema("asset_key long, route string").parquet(path).select("asset_key", "route")


def q_stream_directories(spark, sf):
    """Folders brought up to date by a stream of assets."""
    rows = lambda df: df.select(
        F.col("doc_id").alias("asset_key"), F.concat(F.lit("/docs/"), "lang", F.lit("/"), "source").alias("logical_path"),
        F.when(F.col("n_chars") > 12000, "FAILED").when(F.col("doc_id") % 7 == 4, "SKIPPED").otherwise("SUCCESS").alias("status"), F.array("lang").alias("keywords"),
    )
    path = fresh_path(spark, "folders")
    sink = feeds.DirectoryPipeline(path, lambda: rows(table(spark, sf, "documents")))
    feeds.run_available(rows(_stream(spark, sf, "documents")), sink)
    return sink.table(spark).select("path", "status")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_LEVEL = "case upper(trim(coalesce(level, ''))) when 'WARNING' then 'WARN' when 'INFO' then 'INFO' when 'WARN' then 'WARN' when 'ERROR' then 'ERROR' when 'SUCCESS' then 'SUCCESS' when 'RUNNING' then 'RUNNING' else 'INFO' end"
_WINDOWS = f"select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, {_LEVEL.replace('level', 'event_type')} as level, count(*) as n from events group by 1, 2"

ORACLE = {
    "q_feed_source": oracle(f"select seq, level, text from fx_events_log where seq > {SINCE}", "fx_events_log"),
    "q_events_since": oracle(f"select seq, {_LEVEL} as level, text from fx_events_log where seq > {SINCE} order by seq desc limit {LIMIT}", "fx_events_log"),
    "q_stream_events_since": f"""with k as (select event_id + 1 as seq, event_type as level, 'user ' || user_id as text from events order by seq desc limit {feeds.RETAINED}),
 s as (select seq, {_LEVEL} as level, text from k where seq > (select min(seq) from k) + {SINCE} order by seq desc limit {LIMIT}), a as (select seq, {_LEVEL} as level, 'all: ' || text as text from k order by seq desc limit 120)
 select * from s union all select * from a""",
    "q_dedup_requests": oracle("select text, min(seq) as seq, arg_min(level, seq) as level from fx_events_log group by 1", "fx_events_log"),
    "q_status_windows": _WINDOWS,
    "q_stream_status_windows": f"{_WINDOWS} having date_trunc('hour', any_value(ts)) + interval 1 hour <= (select max(ts) from events) - interval 10 minute",
    "q_stream_catalog": """select o_custkey as asset_key, arg_max(o_orderstatus, o_orderkey) filter (where o_orderkey % 3 <> 0) as status, arg_max(o_orderpriority, o_orderkey) filter (where o_orderkey % 2 = 0) as keywords
 from orders group by 1 having count(*) filter (where o_orderkey % 3 <> 0 or o_orderkey % 2 = 0) > 0""",
    # islands of requests between ends; within an island the next request at the time-out or later opens a new one
    "q_in_flight_requests": f"""with recursive e as (select cast(user_id as varchar) as focus, event_id as seq, epoch_us(ts) // 1000 as ms, event_type in ('error', 'purchase') as is_end from events),
 i as (select *, sum(is_end::int) over (partition by focus order by seq) as island from e),
 r as (select focus, island, seq, ms, row_number() over (partition by focus, island order by seq) as n from i where not is_end),
 o as (select focus, island, seq, ms, n from r where n = 1 union all
   select o.focus, o.island, x.seq, x.ms, x.n from o, lateral (select seq, ms, n from r where r.focus = o.focus and r.island = o.island and r.n > o.n and r.ms >= o.ms + {IN_FLIGHT_MS} order by r.n limit 1) x)
 select focus, seq, ms from o""",
    "q_stream_directories": """with a as (select '/docs/' || lang as up, '/docs/' || lang || '/' || source as path, case when n_chars > 12000 then 'FAILED' when doc_id % 7 = 4 then 'SKIPPED' else 'SUCCESS' end as status from documents),
 d as (select up, path, bool_or(status <> 'SKIPPED') and bool_and(status in ('SKIPPED', 'SUCCESS')) as ready from a group by 1, 2), l as (select up as path, bool_and(ready) as ready from d group by 1)
 select path, case when ready then 'SUCCESS' else 'PENDING' end as status from (select path, ready from d union all select * from l union all select unnest(['/docs', '/']), (select bool_and(ready) from l))""",
    "q_stream_leaf_pipeline": "select doc_id as asset_key, case when doc_id % 3 = 2 then 'skipped' when doc_id % 3 = 0 then 'office' else 'image' end as route from documents where doc_id % 4 <> 0 and doc_id % 29 <> 0",
}
