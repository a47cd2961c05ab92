"""Queries over the rarer forms of ingest, catalog, extraction and drawings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetgraph.fixtures import fixture, oracle, run_sql
from assetgraph.operators import catalog as c
from assetgraph.operators import drawings as d
from assetgraph.operators import extract as x
from assetgraph.sources import delimited, external

#: A file for each customer: a header, blank for every tenth, and a line for each order, blank unless it is urgent.
_ORDER_LINES = """select c_custkey as file_no, cast(-1 as bigint) as line_no, case when c_custkey % 10 = 0 then ' ' else 'order,price' end as line from customer
 union all select o_custkey, o_orderkey, case when o_orderpriority = '1-URGENT' and o_orderkey % 4 = 0 then concat(cast(o_orderkey as string), ',x') else '  ' end from orders"""
_SERIES = "select concat(event_type, '-', cast(event_id % 12 as string)) as file, time_text, case when event_id % 5 = 0 then null else 'v_num' end as name from (select file as event_type, line_no as event_id, time_text from fx_ts_cells) t"
#: Stores by size: with headers, with headers in the other order, and with headers alone.
_REPLIES = "select distinct p_size as store, case p_size % 3 when 0 then array('a.path', 'a.type') when 1 then array('Type', 'Path') else array('data.x.c1', 'data.x.c2') end as headers, array('LONG', 'TEXT') as types from part"
_REPLY_ROWS = "select p_size as store, p_partkey as row_no, case p_size % 3 when 0 then array(p_name, case when p_partkey % 5 = 0 then '' else p_brand end) when 1 then array(p_brand, p_name) else array(' ', 'x') end as cells from part"
_ADDRESSES = r"""select s_suppkey, case s_suppkey % 5 when 0 then concat('extern.a.', cast(s_suppkey as string), '.*.*') when 1 then ' ' else null end as content,
 case s_suppkey % 7 when 0 then concat('/extern/filesystem/dir a.b/', s_name) when 1 then concat('/extern/mysql/mysql/', s_name) when 2 then '/extern/postgres10_0_0_1_5432/shop/t.1'
   when 3 then concat('/extern/redis1//', s_name) when 4 then concat('/extern/other/', s_name) when 5 then '/extern/' else concat('/docs/n', cast(s_nationkey as string)) end as path,
 case s_suppkey % 3 when 0 then '' when 1 then 't.1' else 'a b.csv' end as file from supplier"""


def q_csv_rejects(spark, sf):
    return delimited.rejected_files(run_sql(spark, sf, _ORDER_LINES))


def q_timeseries_rejects(spark, sf):
    fixture(spark, sf, "fx_ts_cells").createOrReplaceTempView("fx_ts_cells")
    return delimited.rejected_series(spark.sql(_SERIES), "file", "time_text")


def q_yaml_pairs(spark, sf):
    return delimited.colon_pairs(fixture(spark, sf, "fx_kv_lines"))


def q_column_replies(spark, sf):
    return external.reply_columns(run_sql(spark, sf, _REPLIES), run_sql(spark, sf, _REPLY_ROWS), "store")


def _rows(df):
    return df.select("asset_key", "logical_path", "file_name")


def q_legacy_forms(spark, sf):
    """Folders as an older catalog stored them, below themselves, and columns of tables that were assets of their own."""
    assets = fixture(spark, sf, "fx_assets")
    name = F.regexp_extract("logical_path", "([^/]*)$", 1)
    folders = assets.groupBy("logical_path").agg((-F.min("asset_key")).alias("asset_key"))
    stored = folders.select("asset_key", "logical_path", name.alias("file_name"))
    right = folders.select("asset_key", F.regexp_replace("logical_path", "/[^/]*$", "").alias("logical_path"), name.alias("file_name"))
    tables = assets.where("data_type in ('relational', 'timeseries')")
    columns = tables.select("asset_key", F.concat("logical_path", F.lit("/"), "file_name").alias("logical_path"), F.lit("c1").alias("file_name"))
    old = c.legacy_directories(assets, stored.unionByName(right), "asset_key", "logical_path", "file_name").withColumn("form", F.lit("directory"))
    single = c.legacy_columns(c.live(tables), _rows(assets).unionByName(columns), "asset_key", "logical_path", "file_name").withColumn("form", F.lit("column"))
    return old.unionByName(single)


def q_resolve_data_path(spark, sf):
    return run_sql(spark, sf, _ADDRESSES).select("s_suppkey", c.resolve_data_path(F.col("content"), F.col("path"), F.col("file")).alias("data_path"))


def q_triple_filter(spark, sf):
    """Assets by type, folder and name: those that a list of triples holds, and the rest."""
    assets, on = fixture(spark, sf, "fx_assets"), ("data_type", "logical_path", "file_name")
    chosen = assets.where("status = 'SUCCESS' and is_valid")
    return c.rows_by_key(assets, chosen, *on).select("asset_key", F.lit(True).alias("listed")).unionByName(c.rows_by_key(assets, chosen, *on, listed=False).select("asset_key", F.lit(False).alias("listed")))


def q_fields_values(spark, sf):
    paths = fixture(spark, sf, "fx_columns")
    text = F.when(F.col("type") == "LONG", F.concat("path", F.lit(".data."))).when(F.col("type") == "DOUBLE", F.lit("no dot")).when(F.col("type") == "BINARY", F.rpad("path", 180, ".z")).otherwise(F.col("path"))
    values = paths.select("source_type", "path", text.alias("value"))
    return x.value_fields(values, "source_type", "path", "value").select("source_type", F.array_join("fields", "|").alias("fields"))


def q_drawing_summaries(spark, sf):
    """A summary for each part's analysis; its returned lines are its issues."""
    many = lambda n: f"concat('[', array_join(array_repeat('{{}}', {n}), ','), ']')"
    bodies = f"""select p_partkey, concat('{{"classification":{{"documentClass":"engineering_drawing","domain":"steel","confidence":"0.5"}},"structure":{{"kind":"ebom","authority":"title"}},"documentInfo":{{"title":"',
      case when p_partkey % 2 = 0 then p_brand else '' end, '"}},"mainObjectName":"', p_type, '","summaryText":"', p_name, '","occurrences":', {many("p_size")}, ',"dimensions":', {many("cast(p_partkey % 4 as int)")}, ',"textBlocks":', {many("cast(p_partkey % 3 as int)")}, '}}') as body from part"""
    issues = run_sql(spark, sf, "select l_partkey as p_partkey from lineitem where l_returnflag = 'R'")
    return d.summaries(d.normalize_analysis(run_sql(spark, sf, bodies), "p_partkey", "body"), issues, "p_partkey")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_TRIM = r"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_MS = r"""(regexp_matches(trim(time_text), '^[+-]?[0-9]{1,19}$') or try_strptime(replace(replace(regexp_replace(trim(time_text), '[+Z].*$', ''), 'T', ' '), '/', '-'), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d']) is not null)"""
_V = "trim(substr(t, strpos(t, ':') + 1))"
_CLEAN = "regexp_replace(s_name, '[^a-zA-Z0-9._-]', '_', 'g')"
ORACLE = {
    "q_csv_rejects": f"select file_no, case when n = 0 then 'empty' else 'header alone' end as reason from (select file_no, count(*) filter (where trim(line) <> '') as n from ({_ORDER_LINES}) group by 1) where n < 2",
    "q_timeseries_rejects": oracle(f"select file, 'no line with a time and a value' as reason from ({_SERIES}) group by 1 having count(*) filter (where {_MS} and name is not null) = 0", "fx_ts_cells"),
    "q_yaml_pairs": oracle(f"""with r as (select file_no, line_no, {_TRIM.format(x="line")} as t from fx_kv_lines)
 select file_no, trim(substr(t, 1, strpos(t, ':') - 1)) as k, arg_max(case when length({_V}) >= 2 and ((starts_with({_V}, '"') and ends_with({_V}, '"')) or (starts_with({_V}, chr(39)) and ends_with({_V}, chr(39)))) then substr({_V}, 2, length({_V}) - 2) else {_V} end, line_no) as v
 from r where t not like '#%' and strpos(t, ':') > 1 group by 1, 2""", "fx_kv_lines"),
    "q_column_replies": """with r as (select p_size as store, trim(p_name) as path, case when p_size % 3 = 0 and p_partkey % 5 = 0 then '' else p_brand end as t, row_number() over (partition by p_size order by p_partkey) as nth from part where p_size % 3 <> 2)
 select store, path, case when t <> '' then t when nth = 1 then 'LONG' when nth = 2 then 'TEXT' else '' end as type from r
 union all select s, h, t from (select distinct p_size as s from part where p_size % 3 = 2), (values ('data.x.c1', 'LONG'), ('data.x.c2', 'TEXT')) v(h, t)""",
    "q_legacy_forms": oracle("""select -min(asset_key) as asset_key, logical_path, regexp_extract(logical_path, '([^/]*)$', 1) as file_name, 'directory' as form from fx_assets group by 2, 3
 union all select asset_key, logical_path || '/' || file_name, 'c1', 'column' from fx_assets where data_type in ('relational', 'timeseries') and is_valid""", "fx_assets"),
    "q_resolve_data_path": rf"""with a as ({_ADDRESSES}), b as (select *, case s_suppkey % 7 when 0 then 'data.extern.dir_a\.b.' || {_CLEAN} when 1 then 'data.extern.' || {_CLEAN} when 2 then 'data.extern.postgres10_0_0_1_5432.shop.t\.1'
   when 3 then 'data.extern.redis1.' || {_CLEAN} when 4 then 'data.extern.other.' || {_CLEAN} when 5 then 'data.extern' else 'data.docs.n' || s_nationkey end as base from a join supplier using (s_suppkey))
 select s_suppkey, case when s_suppkey % 5 = 0 then 'data.extern.a.' || s_suppkey when file = '' or s_suppkey % 7 in (4, 5) then base when s_suppkey % 7 in (0, 6) then base || '.' || replace(file, '.', '\.')
   when s_suppkey % 7 = 2 and file = 't.1' then base else base || '.' || replace(file, ' ', '_') end as data_path from b""",
    "q_triple_filter": oracle("select asset_key, exists (select 1 from fx_assets b where b.status = 'SUCCESS' and b.is_valid and b.data_type = a.data_type and b.logical_path = a.logical_path and b.file_name = a.file_name) as listed from fx_assets a", "fx_assets"),
    "q_fields_values": oracle(r"""with v as (select source_type, path, regexp_replace(regexp_extract(path, '([^.]*)$', 1), '[^A-Za-z0-9_\-一-龥]', '', 'g') as name from fx_columns where type not in ('DOUBLE', 'BINARY')),
 o as (select source_type, name, min(path) as o from v where name <> '' group by 1, 2), r as (select *, row_number() over (partition by source_type order by o, name) as nth from o)
 select source_type, string_agg(name, '|' order by o, name) as fields from r where nth <= 120 group by 1""", "fx_columns"),
    "q_drawing_summaries": """select p_partkey, 'ENGINEERING_DRAWING' as document_class, 'STEEL' as domain, 'UNKNOWN' as drawing_type, 'EBOM' as kind, 'TITLE' as authority, trim(case when p_partkey % 2 = 0 then p_brand else p_type end) as object_name, trim(p_name) as summary, 0.5::double as score,
 p_size as part_count, cast(p_partkey % 4 as int) as dimension_count, cast(p_partkey % 3 as int) as text_count, coalesce(n, 0) as issue_count from part left join (select l_partkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1) on l_partkey = p_partkey""",
}
