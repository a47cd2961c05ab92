"""Queries over catalog, sizes and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetgraph.fixtures import fixture, oracle, table
from assetgraph.functions import names, paths, text
from assetgraph.operators import catalog as c
from assetgraph.operators import sizes
from assetgraph.scratch import saved
from assetgraph.sources import files

CHUNK = 1024


def _assets(spark, sf):
    return fixture(spark, sf, "fx_assets")


def q_catalog_state(spark, sf):
    return c.current_state(fixture(spark, sf, "fx_assets_log"), "asset_key", "seq")


def q_live_assets(spark, sf):
    return c.live(q_catalog_state(spark, sf)).select("asset_key", "logical_path", "status")


def q_last_value(spark, sf):
    return c.last_value(_assets(spark, sf), ["logical_path"], "asset_key", "status")


def q_allocate_ids(spark, sf):
    assets = _assets(spark, sf)
    return c.allocate_ids(table(spark, sf, "labels").select("doc_id"), "doc_id", assets.agg(F.max("asset_key") + 1), "new_id")


def q_latest_by_path(spark, sf):
    rows = _assets(spark, sf).select("asset_key", "logical_path", F.concat("data_type", F.lit("."), "file_format").alias("file_name"), "status")
    return c.latest(rows, ["logical_path", "file_name"], "asset_key")


def q_reject_duplicates(spark, sf):
    assets = _assets(spark, sf).select("asset_key", "logical_path", "file_name")
    finished = _assets(spark, sf).where("status = 'SUCCESS'").select("logical_path", "file_name")
    return c.reject_duplicates(assets, finished, ["logical_path", "file_name"]).select("asset_key", "accepted")


def q_ensure_directories(spark, sf):
    assets = _assets(spark, sf)
    return c.missing_directories(assets, assets.where("status = 'FAILED'").select("logical_path"), "logical_path")


def _legacy(assets):
    """JSON assets as an older catalog stored them: under a path that ends with the file."""
    return assets.where("file_name like '%.json'").select((F.col("asset_key") + 1000000).alias("asset_key"), F.concat("logical_path", F.lit("/"), "file_name").alias("logical_path"), "file_name")


def q_legacy_rows(spark, sf):
    assets, live = _assets(spark, sf).select("asset_key", "logical_path", "file_name"), c.live(_assets(spark, sf))
    return c.legacy_rows(live, assets.unionByName(_legacy(assets)), "asset_key", "logical_path", "file_name")


def _derived(spark, sf):
    return c.derive_assets(fixture(spark, sf, "fx_columns"))


def q_derive_assets(spark, sf):
    return _derived(spark, sf)


def q_group_file_assets(spark, sf):
    return c.group_file_assets(fixture(spark, sf, "fx_columns").where("source_type = 'filesystem'"))


def _file_assets(spark, sf):
    found = q_group_file_assets(spark, sf).select(F.lit("filesystem").alias("source_type"), "asset", F.transform(F.split("columns", ","), lambda x: F.split(x, ":")[0]).alias("names"))
    others = _derived(spark, sf).where("source_type <> 'filesystem'").withColumn("names", F.array().cast("array<string>"))
    return c.logical_names(found.unionByName(others))


def q_logical_path(spark, sf):
    return _file_assets(spark, sf).select("source_type", "asset", "logical_path", "file_name")


def q_source_key(spark, sf):
    return fixture(spark, sf, "fx_sources").select("source_key", c.source_key(F.col("source_type"), F.col("ip"), F.col("port")).alias("name"))


def q_infer_datatype(spark, sf):
    return _file_assets(spark, sf).select("asset", c.infer_data_type(F.col("source_type"), F.col("file_name"), F.col("names")).alias("data_type"))


def q_content_path(spark, sf):
    found = _file_assets(spark, sf).withColumn("data_type", c.infer_data_type(F.col("source_type"), F.col("file_name"), F.col("names")))
    return found.select("asset", c.content_path(F.col("asset"), F.col("data_type")).alias("content_path"), c.resolve_content(c.content_path(F.col("asset"), F.col("data_type"))).alias("data_path"))


def q_initial_status(spark, sf):
    status, keywords = c.initial_status(F.col("data_type"), F.col("file_name"))
    return _assets(spark, sf).select("asset_key", status.alias("status"), keywords.alias("keywords"))


def q_catalog_sync(spark, sf):
    """What a sync does with each derived asset, and its report: finished assets are stored, JSON ones under their legacy path."""
    assets = _assets(spark, sf)
    finished = assets.where("status = 'SUCCESS'")
    stored = finished.where("file_name not like '%.json'").unionByName(_legacy(finished), allowMissingColumns=True).select("logical_path", "file_name")
    actions = c.sync_actions(assets, stored, "logical_path", "file_name")
    report = c.sync_report(actions, assets, finished.select("logical_path"), "logical_path", "file_name", "file_size")
    return actions.unionByName(report.select(F.lit("").alias("logical_path"), F.concat_ws(":", "assets", "directories", "bytes").alias("file_name"), "action"))


def q_schema_sync(spark, sf):
    assets = _assets(spark, sf)
    old_type = F.when(F.col("asset_key") % 5 == 0, "file").otherwise(F.col("data_type"))
    new_path = F.when(F.col("asset_key") % 6 == 0, F.concat("logical_path", F.lit("/x"))).otherwise(F.col("logical_path"))
    size = F.when(F.col("asset_key") % 9 == 0, F.lit(None)).otherwise(F.col("file_size"))
    return assets.select("asset_key", c.needs_refresh(old_type, F.col("data_type"), F.col("logical_path"), new_path, size).alias("refresh"))


def _registry(spark, sf):
    return fixture(spark, sf, "fx_sources").select("source_key", c.source_key(F.col("source_type"), F.col("ip"), F.col("port")).alias("name"), "ip", "port")


def q_register_sources(spark, sf):
    """All sources are reported; the database ones are registered by name, the file systems by address alone, the key-value stores not yet."""
    sources = fixture(spark, sf, "fx_sources").select("source_key", F.col("source_type").alias("kind"), c.source_key(F.col("source_type"), F.col("ip"), F.col("port")).alias("name"), "ip", "port")
    named = F.when(F.col("kind") != "file-system", F.col("name")).otherwise("")
    registry = sources.where("kind <> 'redis'").select("source_key", named.alias("name"), "ip", "port", (F.col("source_key") == 2).alias("is_default"))
    incoming = sources.select(named.alias("name"), "ip", "port", F.col("source_key").alias("incoming_no"))
    return c.register_sources(registry, incoming, "name", "source_key").select("name", "ip", "port", "incoming_no", "source_key")


def q_source_sizes(spark, sf):
    """Sizes of the sources, of what is stored without one, and of all: external assets are those of numbered sources."""
    assets = _assets(spark, sf)
    deltas = assets.select(F.split("logical_path", "/")[3].alias("prefix"), (F.col("file_size") - 1000).alias("delta"))
    registry = table(spark, sf, "documents").select(F.col("source").alias("prefix")).distinct().where("prefix like 'src1%'")
    return c.source_sizes(registry, deltas, "prefix", "delta")


def q_list_directory(spark, sf):
    assets = _assets(spark, sf)
    return c.list_directory(assets, "/docs/en", "asset_key", "logical_path", "file_name").unionByName(c.list_directory(assets, "/docs/en/src1", "asset_key", "logical_path", "file_name"))


def q_resolve_file(spark, sf):
    assets = _assets(spark, sf).select("asset_key", "logical_path", "file_name")
    stored = assets.where("file_name not like '%.zip'").unionByName(_legacy(assets))
    return c.resolve_files(assets.select("logical_path", "file_name"), stored, "asset_key", "logical_path", "file_name")


def q_preview(spark, sf):
    """The first rows with a list, a map and an object id among their columns."""
    shown = (F.array("lang", F.lit(None), "source").alias("listed"), F.create_map(F.lit("l"), F.col("lang"), F.lit("s"), F.lit(None)).alias("mapped"), F.struct(F.col("source").alias("$oid")).alias("id"), F.encode("lang", "utf-8").alias("bytes"))
    return c.preview(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", *shown), "doc_id")


def q_paginate(spark, sf):
    return c.paginate(_assets(spark, sf).select("asset_key", "logical_path", "file_name"), "asset_key", 3, 20)


def q_reconcile_registry(spark, sf):
    stored = _registry(spark, sf).select("source_key", F.col("source_key").alias("id"), "ip", "port").where("source_key % 4 <> 3")
    observed = _registry(spark, sf).select((F.col("source_key") * 2).alias("id"), F.when(F.col("source_key") % 5 == 0, F.col("name")).alias("name"), "ip", F.when(F.col("source_key") % 2 == 0, F.col("port")).otherwise(F.lit(1)).alias("port"))
    return c.reconcile(observed, stored, "source_key").select("id", "port", "source_key", "shown_name")


def q_row_bytes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sizes.row_bytes(["doc_id", "text", "lang", "source"]).alias("bytes"))


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]


def q_size_structured(spark, sf):
    return sizes.structured(table(spark, sf, "part"), ["p_brand"], "p_partkey", _PART)


def q_size_schema(spark, sf):
    return sizes.by_schema(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])


def _pieces(spark, sf):
    return files.chunks(table(spark, sf, "documents").where("text is not null").select("doc_id", F.encode("text", "utf-8").alias("content")), "doc_id", "content", CHUNK)


def q_size_chunked(spark, sf):
    return sizes.chunked(_pieces(spark, sf), "doc_id", CHUNK)


def q_size_exact(spark, sf):
    return sizes.exact(table(spark, sf, "documents"), ["lang", "source"], ["text"])


def q_size_lookup(spark, sf):
    docs = table(spark, sf, "documents")
    listed = docs.where("doc_id % 3 < 2").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") * 2).otherwise(0).alias("size"))
    return sizes.looked_up(docs.select("doc_id", "text"), listed, "doc_id", "size", sizes.value_bytes(F.col("text"))).select("doc_id", "bytes")


def q_format_bytes(spark, sf):
    size = F.col("file_size") * F.pow(F.lit(37), F.col("asset_key") % 6).cast("long")
    return _assets(spark, sf).select("asset_key", sizes.format_bytes(size).alias("size"))


def q_path_functions(spark, sf):
    raw = F.concat(F.lit(" /"), "lang", F.lit("//"), "source", F.when(F.col("doc_id") % 2 == 0, "/").otherwise(""))
    p = paths.normalize_path(raw)
    file = F.concat("source", F.when(F.col("doc_id") % 3 == 0, ".CSV").otherwise(""))
    dotted = F.concat(F.lit("data.a\\.b."), "source")
    return table(spark, sf, "documents").select(
        "doc_id", p.alias("path"), paths.asset_path(p, file).alias("asset"), paths.parent_path(p).alias("parent"), paths.leaf_name(p).alias("leaf"), paths.depth(p).alias("depth"),
        F.array_join(paths.path_chain(p), ">").alias("chain"), F.array_join(F.transform(paths.split_unescaped(dotted), paths.unescape), "|").alias("segments"),
        paths.last_unescaped_dot(dotted).alias("last_dot"), paths.quote_identifier_path(dotted).alias("quoted"), paths.file_extension(file).alias("extension"), paths.to_data_path(paths.asset_path(p, file)).alias("data_path"),
        paths.normalize_escaped_path(F.concat(F.lit(" a\\\\\\b."), "source")).alias("escaped"), F.concat_ws("|", *paths.split_parent_leaf(dotted)).alias("parts"), paths.to_file_leaf_path(F.lit("data"), F.concat(F.lit("x\\y/"), file)).alias("file_leaf"),
    )


def q_name_functions(spark, sf):
    """All names of parts as headers of one table for each size, some blank, some with the suffix of a repeat."""
    base = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("w"), F.col("p_size").alias("source"), F.split("p_name", " ")[0].alias("first"))
    given = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 11 == 0, F.concat("first", F.lit("_2"))).otherwise(F.col("first"))
    heads = names.dedup_headers(base.withColumn("h", given), "source", "doc_id", "h", saved)
    return heads.select(
        "doc_id", "header", names.sanitize_column(F.concat("doc_id", F.lit("-"), "w")).alias("column"), names.normalize_field(F.concat(F.lit("t.("), "w", F.lit(")"))).alias("field"),
        names.normalize_column(F.concat(F.lit("max(`a`."), "w", F.lit(")"))).alias("inner"), names.entity_norm(F.col("w")).alias("norm"), names.display_name(F.concat(F.lit("  "), "w", F.lit("\t x "))).alias("shown"),
    )


def q_text_functions(spark, sf):
    words = F.split("text", " ")
    listed = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array("lang", "source", "lang"))).otherwise(F.concat_ws(",", "source", F.lit(" x "), "source"))
    return table(spark, sf, "documents").where("text is not null").select(
        "doc_id", F.array_join(text.dedup_strings(words, 5), "|").alias("first_words"), F.array_join(text.parse_keywords(listed), "|").alias("keywords"), text.token_estimate(F.col("text")).alias("tokens"),
        text.confidence(F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 3 == 1, "1.5").otherwise("0.25")).alias("confidence"),
        text.content_digest(F.encode("text", "utf-8")).alias("digest"), text.path_filter(F.concat(F.lit("see /"), "lang", F.lit("/"), "source", F.lit(" now"))).alias("path"),
        text.salvage_object(F.concat(F.lit("<think>{}</think>a {\"k\":\""), "lang", F.lit("\"} z"))).alias("object"),
    )


def q_bounded_summary(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.bounded_summary(F.col("text"), 120).alias("summary"))


def q_key_filter(spark, sf):
    return c.rows_by_key(_assets(spark, sf).select("asset_key", "status"), table(spark, sf, "labels").select(F.col("doc_id").alias("asset_key")), "asset_key")


def q_children_of_candidate(spark, sf):
    """The assets right below the first directory of failed ones: a scalar subquery picks the directory."""
    assets = _assets(spark, sf)
    assets.createOrReplaceTempView("fx_assets_view")
    return spark.sql("select asset_key, status from fx_assets_view where logical_path = (select min(logical_path) from fx_assets_view where status = 'FAILED')")


def q_content_join_meta(spark, sf):
    content = table(spark, sf, "labels").select(F.col("doc_id").alias("asset_key"), "quality")
    return c.content_with_meta(content, _assets(spark, sf).select("asset_key", "data_type", "status"), "asset_key")


def q_dynamic_columns(spark, sf):
    cells = fixture(spark, sf, "fx_keywords").select("asset_key", F.concat(F.lit("c"), "pos").alias("path"), F.col("keyword").alias("value"))
    chosen = table(spark, sf, "region").select(F.concat(F.lit("c"), F.col("r_regionkey") * 2).alias("path"))
    return c.dynamic_columns(cells, chosen, "path").select("asset_key", "path", "value")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_STATE = "select asset_key, " + ", ".join(f"arg_max({x}, seq) filter (where {x} is not null) as {x}" for x in ("logical_path", "file_name", "file_size", "is_valid", "status", "keywords")) + " from fx_assets_log group by 1"
_LEGACY = "select asset_key + 1000000 as asset_key, logical_path || '/' || file_name as logical_path, file_name from fx_assets where file_name like '%.json'"
_SEGS = r"regexp_extract_all(path, '((?:\\.|[^.\\])+)')"
_DERIVED = f"""derived as (select distinct source_type, case when source_type = 'redis' then array_to_string(segs[1:3], '.') when source_type = 'mongodb' and len(segs) >= 5 then array_to_string(segs[1:5], '.')
 when source_type in ('mysql', 'postgres', 'iotdb') and len(segs) > 3 then array_to_string(segs[1:len(segs) - 1], '.') else path end as asset from (select source_type, path, {_SEGS} as segs from fx_columns) where len(segs) > 3)"""
_FILES = f"""ended as (select path, type, segs, coalesce(list_min(list_filter(range(4, len(segs) + 1), lambda i: contains(segs[i], chr(92) || '.'))), len(segs)) as e from (select path, type, {_SEGS} as segs from fx_columns where source_type = 'filesystem')),
grouped as (select array_to_string(segs[1:e], '.') as asset, array_to_string(segs[e + 1:], '.') as rest, type from ended group by all)"""
_NAMED = f"""{_DERIVED}, {_FILES},
everything as (select source_type, asset, cast([] as varchar[]) as names from derived where source_type <> 'filesystem' union all select 'filesystem', asset, list(rest order by rest) from grouped group by asset),
parts as (select *, list_transform(regexp_extract_all(asset, '((?:\\\\.|[^.\\\\])+)'), lambda x: regexp_replace(x, '\\\\(.)', '\\1', 'g')) as segs from everything),
bodies as (select *, case when source_type = 'postgres' and lower(segs[4]) in ('postgres', 'postgresql') or source_type <> 'filesystem' and lower(segs[4]) = source_type then segs[5:] else segs[4:] end as body from parts),
named as (select source_type, asset, names, array_to_string(list_concat(['/extern', segs[3]], body[1:len(body) - 1]), '/') as logical_path, case when len(body) > 0 then body[len(body)] else segs[3] end as file_name from bodies),
typed as (select *, case when source_type in ('mysql', 'postgres') then 'relational' when source_type = 'iotdb' then 'timeseries' when source_type = 'mongodb' then 'document' when source_type = 'redis' then 'keyvalue'
 when file_name like '%.csv' then case when regexp_matches(file_name, '{c._HINT}') or len(list_filter(names, lambda x: regexp_matches(x, '{c._TIME}'))) > 0 then 'timeseries' else 'relational' end else 'file' end as data_type from named)"""
_KEY = """case when regexp_replace(lower(trim(source_type)), '[^a-z0-9]', '', 'g') = '' then '' else regexp_replace(lower(trim(source_type)), '[^a-z0-9]', '', 'g') || regexp_replace(regexp_replace(trim(ip), '[^a-zA-Z0-9]', '_', 'g'), '_+', '_', 'g')
 || '_' || case when source_type = 'iotdb' and trim(ip) = '127.0.0.1' and port = 6667 then 6668 else port end end"""
_REG = f"reg as (select source_key, {_KEY} as name, ip, port from fx_sources)"
_B = lambda *cs: " + ".join(f"coalesce(octet_length(encode(cast({x} as varchar))), 0)" for x in cs)


def _format(x: str) -> str:
    out = f"{x} || ' B'"
    for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        d = f"cast({1024**k} as double)"
        cents, whole = f"cast(floor({x} * 100 / {d} + 0.5) as bigint)", f"cast(floor({x} / {d} + 0.5) as bigint)"
        out = f"case when {x} >= {1024**k} then (case when {x} / {d} >= 100 then cast({whole} as varchar) else ({cents} // 100) || '.' || lpad(cast({cents} % 100 as varchar), 2, '0') end) || ' {unit}' else {out} end"
    return out


ORACLE = {
    "q_catalog_state": oracle(_STATE, "fx_assets_log"),
    "q_live_assets": oracle(f"select asset_key, logical_path, status from ({_STATE}) where is_valid", "fx_assets_log"),
    "q_last_value": oracle("select logical_path, max(asset_key) as last_key, arg_max(status, asset_key) as last_value from fx_assets group by 1", "fx_assets"),
    "q_allocate_ids": oracle("select doc_id, row_number() over (order by doc_id) + (select max(asset_key) from fx_assets) as new_id from labels", "fx_assets"),
    "q_latest_by_path": oracle("select max(asset_key) as asset_key, logical_path, data_type || '.' || file_format as file_name, arg_max(status, asset_key) as status from fx_assets group by 2, 3", "fx_assets"),
    "q_reject_duplicates": oracle("select asset_key, not exists (select 1 from fx_assets b where b.status = 'SUCCESS' and b.logical_path = a.logical_path and b.file_name = a.file_name) as accepted from fx_assets a", "fx_assets"),
    "q_ensure_directories": oracle("""with p as (select distinct array_to_string(s[1:n], '/') as path from (select string_split(logical_path, '/') as s, unnest([2, 3, 4]) as n from fx_assets)) select path from p where path <> '' and path not in (select logical_path from fx_assets where status = 'FAILED')""", "fx_assets"),
    "q_legacy_rows": oracle(f"with legacy as ({_LEGACY}) select l.asset_key, l.logical_path, l.file_name from legacy l join fx_assets a on l.logical_path = a.logical_path || '/' || a.file_name and l.file_name = a.file_name where a.is_valid", "fx_assets"),
    "q_derive_assets": oracle(f"with {_DERIVED} select source_type, asset from derived where len(regexp_extract_all(asset, '((?:\\\\.|[^.\\\\])+)')) >= 3", "fx_columns"),
    "q_group_file_assets": oracle(f"with {_FILES} select asset, count(*) as n_columns, string_agg(rest || ':' || type, ',' order by rest || ':' || type) as columns from grouped group by 1", "fx_columns"),
    "q_logical_path": oracle(f"with {_NAMED} select source_type, asset, logical_path, file_name from named", "fx_columns"),
    "q_source_key": oracle(f"select source_key, {_KEY} as name from fx_sources", "fx_sources"),
    "q_infer_datatype": oracle(f"with {_NAMED} select asset, data_type from typed", "fx_columns"),
    "q_content_path": oracle(f"with {_NAMED} select asset, substr(asset, 6) || case when data_type = 'file' then '' else '.*' end as content_path, asset as data_path from typed", "fx_columns"),
    "q_initial_status": oracle("select asset_key, case when data_type = 'file' and file_format = 'zip' then 'SKIPPED' else 'PENDING' end as status, case when data_type = 'file' and file_format = 'zip' then '[]' end as keywords from fx_assets", "fx_assets"),
    "q_catalog_sync": oracle(f"""with stored as (select logical_path, file_name from fx_assets where status = 'SUCCESS' and file_name not like '%.json' union all select logical_path || '/' || file_name, file_name from fx_assets where status = 'SUCCESS' and file_name like '%.json'),
 acts as (select logical_path, file_name, file_size, case when exists (select 1 from stored s where s.logical_path = a.logical_path and s.file_name = a.file_name) then 'SKIPPED' when exists (select 1 from stored s where s.logical_path = a.logical_path || '/' || a.file_name and s.file_name = a.file_name) then 'REPLACED' else 'IMPORTED' end as action from fx_assets a),
 dirs as (select distinct array_to_string(s[1:n], '/') as path from (select string_split(logical_path, '/') as s, unnest([2, 3, 4]) as n from fx_assets) where n <= len(s)), known as (select distinct logical_path as path from fx_assets where status = 'SUCCESS'),
 fresh as (select count(*) as n from dirs where path not in (select path from known)),
 tot as (select action, count(*) as n, sum(greatest(file_size, 0)) as b from acts group by 1)
 select logical_path, file_name, action from acts union all select '', n || ':' || case when action = 'IMPORTED' then (select n from fresh) else 0 end || ':' || cast(b as bigint), action from tot""", "fx_assets"),
    "q_schema_sync": oracle("select asset_key, (asset_key % 5 = 0 and data_type <> 'file') or asset_key % 6 = 0 or data_type not in ('relational', 'timeseries') or asset_key % 9 = 0 or file_size <= 0 as refresh from fx_assets", "fx_assets"),
    "q_register_sources": oracle(f"""with {_REG}, r as (select reg.source_key, case when source_type <> 'file-system' then name else '' end as name, reg.ip, reg.port, source_type from reg join fx_sources using (source_key)),
 g as (select * from r where source_type <> 'redis'), a as (select name, min(source_key) as k from g where name <> '' group by 1), b as (select trim(ip) as ip, port, min(source_key) as k from g where source_key <> 2 group by 1, 2),
 j as (select r.*, case when r.name <> '' then a.k else b.k end as k from r left join a on a.name = r.name and r.name <> '' left join b on b.ip = trim(r.ip) and b.port = r.port)
 select name, ip, port, source_key as incoming_no, case when k is not null then k else (select max(source_key) from g) + row_number() over (partition by k is null order by source_key) end as source_key from j""", "fx_sources"),
    "q_source_sizes": oracle("""with d as (select split_part(logical_path, '/', 4) as prefix, greatest(file_size - 1000, 0) as n from fx_assets), s as (select d.*, prefix like 'src1%' as own from d), p as (select distinct source as prefix from documents where source like 'src1%')
 select p.prefix, coalesce(cast(sum(n) as bigint), 0) as total_size, 1 as place from p left join s on s.prefix = p.prefix group by 1 union all select '(default)', coalesce(cast(sum(n) filter (where not own or own is null) as bigint), 0), 0 from s union all select '(total)', coalesce(cast(sum(n) as bigint), 0), 2 from s""", "fx_assets"),
    "q_list_directory": oracle("select 'folder' as kind, split_part(logical_path, '/', 4) as name, cast(null as bigint) as asset_key from fx_assets where logical_path like '/docs/en/%' group by 2 union all select 'file', file_name, max(asset_key) from fx_assets where logical_path = '/docs/en/src1' group by 2", "fx_assets"),
    "q_resolve_file": oracle(f"""with stored as (select asset_key, logical_path, file_name from fx_assets where file_name not like '%.zip' union all {_LEGACY})
 select a.logical_path, a.file_name, coalesce(s.asset_key, l.asset_key) as asset_key from fx_assets a left join stored s on s.logical_path = a.logical_path and s.file_name = a.file_name left join stored l on l.logical_path = a.logical_path || '/' || a.file_name and l.file_name = a.file_name""", "fx_assets"),
    "q_preview": """select cast(doc_id as varchar) as doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(cast(n_chars as varchar), '') as n_chars,
 coalesce(lang, '') || ', , ' || coalesce(source, '') as listed, '{l: ' || coalesce(lang, 'null') || ', s: null}' as mapped, 'ObjectId("' || coalesce(source, 'null') || '")' as id, coalesce(lang, '') as bytes from (select * from documents order by documents.doc_id limit 50)""",
    "q_paginate": oracle("select asset_key, logical_path, file_name from fx_assets order by asset_key limit 20 offset 40", "fx_assets"),
    "q_reconcile_registry": oracle(f"""with {_REG}, stored as (select * from reg where source_key % 4 <> 3), o as (select source_key * 2 as id, case when source_key % 5 = 0 then name end as name, ip, case when source_key % 2 = 0 then port else 1 end as port from reg)
 select id, port, coalesce((select min(source_key) from stored s where s.source_key = o.id), (select min(source_key) from stored s where s.ip = o.ip and s.port = o.port), (select min(source_key) from stored s where s.ip = o.ip)) as source_key,
 coalesce(name, 'node-' || trim(ip) || '-' || port) as shown_name from o""", "fx_sources"),
    "q_row_bytes": f"select doc_id, {_B('doc_id', 'text', 'lang', 'source')} as bytes from documents",
    "q_size_structured": f"""select p_brand, rows, cast(case when rows < 100 then head else greatest(1, cast(floor(head / 100) as bigint)) * rows end as bigint) as bytes from (select p_brand, max(n) as rows, sum(b) filter (where nth <= 100) as head
 from (select p_brand, count(*) over (partition by p_brand) as n, row_number() over (partition by p_brand order by p_partkey) as nth, {_B(*_PART)} as b from part) group by 1)""",
    "q_size_schema": """select o_orderpriority, rows, cast((24 + w) * rows as bigint) as bytes from (select o_orderpriority, count(o_orderkey) as rows, cast(greatest(1, floor(avg(octet_length(encode(o_orderstatus))) filter (where nth <= 100))) as bigint) as w
 from (select *, row_number() over (partition by o_orderpriority order by o_orderkey) as nth from orders) group by 1)""",
    "q_size_chunked": "select doc_id, cast(octet_length(encode(text)) as bigint) as bytes from documents where text is not null",
    "q_size_exact": f"select lang, source, cast(sum({_B('text')}) as bigint) as bytes from documents group by 1, 2",
    "q_size_lookup": f"select doc_id, cast(case when doc_id % 3 = 0 and n_chars > 0 then n_chars * 2 else {_B('text')} end as bigint) as bytes from documents",
    "q_format_bytes": oracle(f"select asset_key, {_format('size')} as size from (select asset_key, file_size * cast(pow(37, asset_key % 6) as bigint) as size from fx_assets)", "fx_assets"),
    "q_path_functions": r"""select doc_id, p as path, p || '/' || case when doc_id % 3 = 0 then source || '.CSV' else '' end as asset, '/' || lang as parent, source as leaf, 2 as depth, '/>/' || lang || '>' || p as chain, 'data|a.b|' || source as segments, 9 as last_dot,
 '`data`.`a\.b`.`' || source || '`' as quoted, case when doc_id % 3 = 0 then 'csv' else '' end as extension, 'data.' || lang || '.' || source || case when doc_id % 3 = 0 then '.' || source || '\.CSV' else '' end as data_path,
 'a' || chr(92) || 'b.' || source as escaped, 'data.a\.b|' || source as parts, 'data.' || source || case when doc_id % 3 = 0 then '\.CSV' else '' end as file_leaf
 from (select *, '/' || lang || '/' || source as p from documents)""".replace("p || '/' || case when doc_id % 3 = 0 then source || '.CSV' else '' end as asset", "case when doc_id % 3 = 0 then p || '/' || source || '.CSV' else p end as asset"),
    "q_name_functions": r"""with recursive b as (select p_partkey as doc_id, p_size as source, p_name as w, string_split(p_name, ' ')[1] as f from part), n as (select *, row_number() over (partition by source order by doc_id) as i, case when doc_id % 7 = 0 then 'column_' || doc_id when doc_id % 11 = 0 then f || '_2' else f end as h from b),
 walk as (select source, cast(0 as bigint) as i, cast(null as bigint) as doc_id, cast('' as varchar) as header, cast([] as varchar[]) as used from n group by 1
  union all select n.source, n.i, n.doc_id, x.c, list_append(walk.used, x.c) from walk join n on n.source = walk.source and n.i = walk.i + 1, lateral (select case when not list_contains(used, h) then h else list_filter(list_transform(range(2, len(used) + 3), lambda k: h || '_' || k), lambda y: not list_contains(used, y))[1] end as c) x)
 select n.doc_id, header, 'c_' || n.doc_id || '_' || regexp_replace(w, '[^a-zA-Z0-9_]', '_', 'g') as column,
 regexp_replace(regexp_extract(w, '([^.]*)$', 1), '[^A-Za-z0-9_\-一-龥]', '', 'g') as field, regexp_extract(w, '([^.]*)$', 1) as inner, regexp_replace(lower(w), '[^a-z0-9一-龥]', '', 'g') as norm, w || ' x' as shown
 from n join walk using (doc_id)""",
    "q_text_functions": """select doc_id, fw as first_words, case when doc_id % 2 = 0 then lang || '|' || source else source || '|x' end as keywords, cast((a + 2) // 3 + 2 * (length(text) - a) as bigint) as tokens,
 case when doc_id % 3 = 0 then 0.0 when doc_id % 3 = 1 then 1.0 else 0.25 end::double as confidence, sha256(text) as digest, '/' || lang || '/' || source as path, '{"k":"' || lang || '"}' as object
 from (select *, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) as a, (select string_agg(w, '|' order by i) from (select w, min(i) as i from (select unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i) group by w order by i limit 5)) as fw
 from (select *, list_filter(list_transform(string_split(text, ' '), lambda w: regexp_replace(w, '^\\s+|\\s+$', '', 'g')), lambda w: w <> '') as ws from documents where text is not null))""".replace("\\\\", "\\"),
    "q_bounded_summary": r"""select doc_id, case when length(t) <= 120 then t when length(regexp_extract(h, '(?s)^(.*[.!?。！？])', 1)) > 60 then regexp_extract(h, '(?s)^(.*[.!?。！？])', 1) else substr(t, 1, 119) || '…' end as summary
 from (select doc_id, t, substr(t, 1, 120) as h from (select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as t from documents))""",
    "q_key_filter": oracle("select asset_key, status from fx_assets where asset_key in (select doc_id from labels)", "fx_assets"),
    "q_children_of_candidate": oracle("select asset_key, status from fx_assets where logical_path = (select min(logical_path) from fx_assets where status = 'FAILED')", "fx_assets"),
    "q_content_join_meta": oracle("select coalesce(l.doc_id, a.asset_key) as asset_key, quality, data_type, status from labels l full join fx_assets a on l.doc_id = a.asset_key", "fx_assets"),
    "q_dynamic_columns": oracle("select asset_key, 'c' || pos as path, keyword as value from fx_keywords where 'c' || pos in (select 'c' || (r_regionkey * 2) from region)", "fx_keywords"),
}
