"""Queries over ingest and export, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetgraph.fixtures import fixture, oracle, table
from assetgraph.functions.names import sanitize_column
from assetgraph.scratch import fresh_path
from assetgraph.sources import delimited, documents, dumps, export, external, files, quoted

CHUNK, CAP = 1024, 1 << 20
#: Orders whose texts one task has.
TASK_ORDERS = 25_000
PREFIX = "data.extern.mysql10_0_0_1_3306"


def q_csv_ingest(spark, sf):
    return delimited.parse(fixture(spark, sf, "fx_csv_lines"))


def q_csv_quoted(spark, sf):
    """A file for each language with its documents' whole texts in quotes, line breaks and all, cut into lines and read back."""
    quoted_ = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    texts = table(spark, sf, "documents")
    # numbers that a document has for its lines: no text has more lines than bytes and one
    room = max(1 << 20, (texts.agg(F.max(F.octet_length("text"))).first()[0] or 0) + 1)
    docs = texts.select("lang", "doc_id", F.concat_ws(",", F.col("doc_id").cast("string"), quoted_(F.coalesce("text", F.lit("")))).alias("record"))
    lines = docs.select("lang", "doc_id", F.posexplode(F.split("record", "\n"))).select("lang", (F.col("doc_id") * room + F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))
    heads = docs.select("lang").distinct().select("lang", F.lit(0).cast("long").alias("line_no"), F.lit("doc id,text").alias("line"))
    cells = quoted.parse_quoted(quoted.record_starts(lines.unionByName(heads), "lang"))
    return cells.select("file", "key", "pos", "name", F.length("value").alias("n_chars"), F.md5("value").alias("digest"))


def q_detect_delimiter(spark, sf):
    return delimited.headers(fixture(spark, sf, "fx_csv_lines"))


def q_sanitize_columns(spark, sf):
    names = fixture(spark, sf, "fx_columns").select("path")
    return names.select("path", sanitize_column(F.regexp_replace("path", "^data\\.extern\\.[a-z]+", "")).alias("name"))


def _cells(spark, sf):
    ts = fixture(spark, sf, "fx_ts_cells")
    return ts.unpivot(["file", "line_no", "time_text"], ["v_num", "v_text"], "name", "value")


def q_timeseries_ingest(spark, sf):
    return delimited.timeseries(_cells(spark, sf), "file", "line_no", "time_text")


def q_parse_timestamp(spark, sf):
    return fixture(spark, sf, "fx_ts_cells").select("file", "line_no", delimited.parse_time(F.col("time_text")).alias("ms"))


def q_infer_numeric(spark, sf):
    return delimited.infer_numeric(_cells(spark, sf), "file", "name")


def q_keyvalue_ingest(spark, sf):
    return delimited.key_values(fixture(spark, sf, "fx_kv_lines"))


def _docs(spark, sf):
    return documents.split_documents(fixture(spark, sf, "fx_json"), "file_no", "body")


def q_json_documents(spark, sf):
    return _docs(spark, sf).select("file_no", "doc_no", F.expr("size(json_object_keys(to_json(doc)))").alias("n_keys"))


def q_json_shred(spark, sf):
    return documents.shred(_docs(spark, sf), "file_no")


def q_json_types(spark, sf):
    return documents.widened_types(documents.shred(_docs(spark, sf), "file_no"))


def q_json_flat_kv(spark, sf):
    return documents.flat_pairs(documents.shred(_docs(spark, sf), "file_no"), "file_no")


def q_xml_documents(spark, sf):
    """Orders with an attribute, a nested part and their lines as repeated children."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("line"))  # seven at most
    orders = table(spark, sf, "orders")
    # a few bytes of an order become a whole text, so their number says how many tasks there are, not the bytes
    dealt = orders.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-orders.count() // TASK_ORDERS)), "o_orderkey")
    orders = dealt.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    shape = F.struct(F.col("o_orderkey").alias("_id"), F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"), F.lit("").alias("note")).alias("info"), "line")
    texts = orders.select(F.col("o_orderkey").alias("order_no"), F.to_xml(shape, {"attributePrefix": "_"}).alias("body"))
    return documents.shred(documents.xml_documents(texts, "order_no", "body"), "order_no").drop("doc_no")


def _chunks(spark, sf):
    return files.chunks(table(spark, sf, "documents").where("text is not null").select("doc_id", F.encode("text", "utf-8").alias("content")), "doc_id", "content", CHUNK)


def q_file_chunks(spark, sf):
    return _chunks(spark, sf).select("doc_id", "chunk_no", F.octet_length("bytes").alias("n_bytes"), F.md5(F.hex("bytes")).alias("digest"))


def q_file_reassemble(spark, sf):
    return files.reassemble(_chunks(spark, sf), "doc_id", CAP).select("doc_id", F.octet_length("content").alias("n_bytes"), F.md5(F.hex("content")).alias("digest"))


def q_dump_scan(spark, sf):
    """Events as the dump of a time-series store and parts as that of a key-value store, written and read through the data source with filters of the key."""
    dumps.register_sources(spark)
    cells = lambda df, key, **values: df.select(key, F.explode(F.create_map(*(x for p, v in values.items() for x in (F.lit(p), v.cast("string"))))).alias("path", "value"))
    series, pairs = fresh_path(spark, "dump"), fresh_path(spark, "dump")
    events = cells(table(spark, sf, "events"), F.col("event_id").alias("key"), user=F.col("user_id"), value=F.col("value"), kind=F.nullif("event_type", F.lit("view")), odd=F.col("event_type"))
    dumps.write_dump(spark, events, [("user", "LONG"), ("value", "DOUBLE"), ("kind", "TEXT"), ("odd", "LONG")], series)
    parts = cells(table(spark, sf, "part"), F.concat_ws("/", "p_brand", "p_partkey").alias("key"), name=F.col("p_name"), size=F.col("p_size"))
    dumps.write_dump(spark, parts, [("name", "TEXT"), ("size", "INTEGER")], pairs)
    read = lambda kind, path: spark.read.format("ag_dump").option("kind", kind).load(path)
    some = read("timeseries", series).where("time >= 100 and user is not null").select(F.col("time").cast("string").alias("key"), F.coalesce("kind", F.lit("none")).alias("name"), F.coalesce("odd", "user").alias("n"), F.col("value").alias("x"))
    others = read("keyvalue", pairs).where("key >= 'Brand#12' and key < 'Brand#3'").select("key", "name", F.col("size").cast("long").alias("n"), F.lit(None).cast("double").alias("x"))
    return some.unionByName(others)


def q_show_columns(spark, sf):
    return external.show_columns(fixture(spark, sf, "fx_columns"), PREFIX).select("source_type", "path", "type")


def q_batch_ingest_report(spark, sf):
    return delimited.ingest_report(fixture(spark, sf, "fx_kv_lines"))


def q_batch_ingest_totals(spark, sf):
    return delimited.ingest_totals(q_batch_ingest_report(spark, sf))


def q_file_sizes(spark, sf):
    listed = fixture(spark, sf, "fx_file_list").select(F.concat(F.ceil(F.col("size_chars") / 1024), F.lit("\t/"), "host", "path").alias("line"))
    return files.parse_usage(listed).groupBy("path").agg(F.sum("bytes").alias("bytes"))


def q_csv_export(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return export.csv_lines(rows, ["lang", "source", "text"]).select("doc_id", "line")


def q_kv_export(spark, sf):
    return export.pairs_json(delimited.key_values(fixture(spark, sf, "fx_kv_lines")), "file_no")


def q_document_export(spark, sf):
    return export.table_json(table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name"), "c_nationkey", "c_custkey", 25)


def q_external_scan(spark, sf):
    """The part table by way of the filesystem reader, with the columns that it shows."""
    return external.scan(spark, "filesystem", {"format": "parquet", "path": f"{sf}/part.parquet"}).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_TRIM = r"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_SAN = "case when {x} = '' then 'col' when regexp_matches({x}, '^[0-9]') then concat('c_', {x}) else {x} end"
_san = lambda x: _SAN.format(x=f"regexp_replace({x}, '[^a-zA-Z0-9_]', '_', 'g')")
_HEADERS = f"""kept as (select file_no, line_no, {_TRIM.format(x="line")} as l from fx_csv_lines where {_TRIM.format(x="line")} <> ''),
heads as (select file_no, arg_min(l, line_no) as header from kept group by 1),
delims as (select file_no, header, case when t >= c and t >= s and t > 0 then chr(9) when s > c then ';' else ',' end as delimiter
  from (select *, length(header) - length(replace(header, chr(9), '')) as t, length(header) - length(replace(header, ';', '')) as s, length(header) - length(replace(header, ',', '')) as c from heads))"""
_MS = r"""case when regexp_matches(trim(time_text), '^[+-]?[0-9]{1,19}$') then try_cast(trim(time_text) as bigint)
 else coalesce(epoch_ms(try_strptime(p, '%Y-%m-%d %H:%M:%S')), epoch_ms(try_strptime(p, '%Y-%m-%d %H:%M')), epoch_ms(try_strptime(p, '%Y-%m-%d'))) end"""
_PLAIN = "replace(replace(regexp_replace(trim(time_text), '[+Z].*$', ''), 'T', ' '), '/', '-')"
_CELLS = f"""cells as (select file, line_no, time_text, {_PLAIN} as p, 'v_num' as name, v_num as value from fx_ts_cells union all select file, line_no, time_text, {_PLAIN}, 'v_text', v_text from fx_ts_cells),
kinds as (select file, name, bool_and(coalesce(value, '') = '' or try_cast(value as double) is not null) as is_numeric from cells group by 1, 2)"""
_PAIRS = f"""a as (select file_no, line_no, {_TRIM.format(x="line")} as t from fx_kv_lines),
b as (select file_no, line_no, case when starts_with(t, 'export ') then {_TRIM.format(x="substr(t, 8)")} else t end as s from a where t <> '' and t not like '#%' and t not like '!%'),
c as (select file_no, line_no, {_TRIM.format(x="regexp_extract(s, '^([^=:]+)[=:]', 1)")} as k0, {_TRIM.format(x="regexp_extract(s, '^[^=:]+[=:](.*)$', 1)")} as v0 from b where regexp_matches(s, '^[^=:]+[=:]')),
pairs as (select file_no, {_san("k0")} as k, arg_max(case when length(v0) >= 2 and ((v0 like '"%' and v0 like '%"') or (starts_with(v0, chr(39)) and ends_with(v0, chr(39)))) then substr(v0, 2, length(v0) - 2) else v0 end, line_no) as v
  from c where k0 <> '' group by 1, 2)"""
_REPORT = """lines as (select file_no, count(*) filter (where t <> '') as n from a group by 1), paired as (select file_no, count(*) as pairs from c where k0 <> '' group by 1),
report as (select file_no, n >= 2 and pairs is not null as ok, case when n >= 2 and pairs is not null then n - 1 else 0 end as rows, case when n < 2 then 'needs a header and a row' when pairs is null then 'no pair' else '' end as reason from lines left join paired using (file_no))"""
_LEAVES = """leaves as (
  select file_no, 0 as doc_no, 0 as elem, '_id' as path, 'text' as type, 'ObjectId("' || json_extract_string(body, '$._id."$oid"') || '")' as value from fx_json where file_no % 4 = 0
  union all select file_no, 0, 0, 'user.id', 'integer', body->'user'->>'id' from fx_json where file_no % 4 = 0
  union all select file_no, 0, 0, 'user.tags', 'text', body->'user'->'tags'->>0 from fx_json where file_no % 4 = 0
  union all select file_no, 0, 1, 'user.tags', 'text', body->'user'->'tags'->>1 from fx_json where file_no % 4 = 0
  union all select file_no, 0, 0, 'v', 'integer', body->>'v' from fx_json where file_no % 4 = 0
  union all select file_no, 0, 0, 'v', 'text', body->0->>'v' from fx_json where file_no % 4 = 1
  union all select file_no, 1, 0, 'v', 'boolean', body->1->>'v' from fx_json where file_no % 4 = 1
  union all select file_no, 0, 0, 'v', 'long', body->>'v' from fx_json where file_no % 4 = 2
  union all select file_no, 0, 0, 'c_2b-c.' || k, 'integer', body->'2b-c'->>k from (select file_no, body, unnest(json_keys(body->'2b-c')) as k from fx_json where file_no % 4 = 2))"""
_HEX = "hex(encode(text))"

ORACLE = {
    "q_csv_ingest": oracle(
        f"""with {_HEADERS}, rows as (select k.file_no, row_number() over (partition by k.file_no order by line_no) - 2 as key, string_split(header, delimiter) as names, string_split(l, delimiter) as cs from kept k join delims d on k.file_no = d.file_no),
 flat as (select file_no, key, names, cs, unnest(range(0, len(names))) as pos from rows where key >= 0)
 select file_no, key, cast(pos as int) as pos, {_san("names[pos + 1]")} as name, coalesce(cs[pos + 1], '') as value from flat""", "fx_csv_lines"),
    "q_csv_quoted": """with r as (select lang, row_number() over (partition by lang order by doc_id) - 1 as key, cast(doc_id as varchar) as d, coalesce(text, '') as t from documents)
 select lang as file, key, 0 as pos, 'doc_id' as name, length(d) as n_chars, md5(d) as digest from r union all select lang, key, 1, 'text', length(t), md5(t) from r""",
    "q_detect_delimiter": oracle(f"with {_HEADERS} select file_no, header, delimiter from delims", "fx_csv_lines"),
    "q_sanitize_columns": oracle(f"""select path, {_san("regexp_replace(path, '^data\\.extern\\.[a-z]+', '')")} as name from fx_columns""", "fx_columns"),
    "q_timeseries_ingest": oracle(
        f"""with {_CELLS} select c.file, {_MS} as key, c.name, arg_max(case when is_numeric and coalesce(value, '') = '' then '0.0' else coalesce(value, '') end, line_no) as value
 from cells c join kinds k on c.file = k.file and c.name = k.name where {_MS} is not null group by 1, 2, 3""", "fx_ts_cells"),
    "q_parse_timestamp": oracle(f"select file, line_no, {_MS} as ms from (select *, {_PLAIN} as p from fx_ts_cells)", "fx_ts_cells"),
    "q_infer_numeric": oracle(f"with {_CELLS} select * from kinds", "fx_ts_cells"),
    "q_keyvalue_ingest": oracle(f"with {_PAIRS} select * from pairs", "fx_kv_lines"),
    "q_json_documents": oracle(
        """select file_no, 0 as doc_no, len(json_keys(body)) as n_keys from fx_json where file_no % 4 in (0, 2)
 union all select file_no, i, len(json_keys(body->i)) from fx_json, (values (0), (1)) as t(i) where file_no % 4 = 1""", "fx_json"),
    "q_json_shred": oracle(f"with {_LEAVES} select file_no, doc_no, elem, path, type, value from leaves", "fx_json"),
    "q_json_types": oracle(f"with {_LEAVES} select path, case when min(type) = max(type) then min(type) else 'text' end as type from leaves group by 1", "fx_json"),
    "q_json_flat_kv": oracle(f"with {_LEAVES} select file_no, path as k, arg_max(value, elem) as v from leaves where doc_no = 0 group by 1, 2", "fx_json"),
    "q_xml_documents": """select o_orderkey as order_no, 0 as elem, '@id' as path, 'text' as type, cast(o_orderkey as varchar) as value from orders union all select o_orderkey, 0, 'status', 'text', o_orderstatus from orders
 union all select o_orderkey, 0, 'info.priority', 'text', o_orderpriority from orders union all select o_orderkey, 0, 'info.customer', 'integer', cast(o_custkey as varchar) from orders union all select o_orderkey, 0, 'info.note', 'text', '' from orders
 union all select l_orderkey, cast(row_number() over (partition by l_orderkey order by l_linenumber) - 1 as int), 'line', 'integer', cast(l_linenumber as varchar) from lineitem where l_orderkey in (select o_orderkey from orders)""",
    "q_file_chunks": f"""select doc_id, cast(n as int) as chunk_no, cast(length(p) // 2 as int) as n_bytes, md5(p) as digest from (select doc_id, n, substr({_HEX}, n * {2 * CHUNK} + 1, {2 * CHUNK}) as p
 from (select doc_id, text, unnest(range(0, greatest(1, cast(ceil(octet_length(encode(text)) / {CHUNK}.0) as bigint)))) as n from documents where text is not null))""",
    "q_file_reassemble": f"select doc_id, cast(length(p) // 2 as int) as n_bytes, md5(p) as digest from (select doc_id, substr({_HEX}, 1, {2 * CAP}) as p from documents where text is not null)",
    "q_show_columns": oracle(f"select distinct source_type, path, type from fx_columns where starts_with(path, '{PREFIX}.')", "fx_columns"),
    "q_batch_ingest_report": oracle(f"with {_PAIRS}, {_REPORT} select * from report", "fx_kv_lines"),
    "q_batch_ingest_totals": oracle(f"with {_PAIRS}, {_REPORT} select count(*) as total, count(*) filter (where ok) as succeeded, count(*) filter (where not ok) as failed, cast(sum(rows) as bigint) as rows from report", "fx_kv_lines"),
    "q_file_sizes": oracle("select '/' || host || path as path, cast(sum(cast(ceil(size_chars / 1024.0) as bigint) * 1024) as bigint) as bytes from fx_file_list group by 1", "fx_file_list"),
    "q_kv_export": oracle(f"with {_PAIRS} select file_no, '{{' || string_agg(cast(to_json(k) as varchar) || ':' || cast(to_json(v) as varchar), ',' order by k) || '}}' as body from pairs group by 1", "fx_kv_lines"),
    "q_document_export": """select c_nationkey, cast(part as int) as part, '{"columns":["c_custkey","c_name"],"rows":[' || string_agg('{"c_custkey":' || c_custkey || ',"c_name":' || cast(to_json(c_name) as varchar) || '}', ',' order by c_custkey) || '],"totalRows":' || max(n) || '}' as body
 from (select *, (row_number() over (partition by c_nationkey order by c_custkey) - 1) // 25 as part, count(*) over (partition by c_nationkey) as n from customer) group by 1, 2""",
    "q_dump_scan": "select cast(event_id as varchar) as key, case when event_type = 'view' then 'none' else event_type end as name, user_id as n, value as x from events where event_id >= 100 union all select p_brand || '/' || p_partkey, p_name, cast(p_size as bigint), null from part where p_brand || '/' || p_partkey >= 'Brand#12' and p_brand || '/' || p_partkey < 'Brand#3'",
    "q_external_scan": "select p_brand, count(*) as n, cast(sum(p_size) as bigint) as size from part group by 1",
}
_cell = lambda x: f"""case when regexp_matches(coalesce({x}, ''), '[,"' || chr(13) || chr(10) || ']') then '"' || replace({x}, '"', '""') || '"' else coalesce({x}, '') end"""
ORACLE["q_csv_export"] = f"select doc_id, {_cell('lang')} || ',' || {_cell('source')} || ',' || {_cell('text')} as line from documents"
