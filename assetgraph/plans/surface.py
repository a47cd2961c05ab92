"""Queries over the extraction stages, the SQL functions and the sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetgraph.fixtures import fixture, oracle, table
from assetgraph.functions.names import entity_norm
from assetgraph.operators import catalog as c
from assetgraph.operators import extract
from assetgraph.operators import graph as g
from assetgraph.operators import sinks, transforms
from assetgraph.plans.graph import _KNOWN, _REL
from assetgraph.scratch import fresh_path, saved

FOCUS = "the"
BRAND, BRANDS = "Brand#12", 12


def q_leaf_meta(spark, sf):
    return transforms.leaf_meta(c.live(fixture(spark, sf, "fx_assets")))


def _directories(spark, sf):
    """(asset_key, logical_path, file_name) of the folders of assets."""
    rows = fixture(spark, sf, "fx_assets").groupBy("logical_path").agg((F.min("asset_key") + 2000000).alias("asset_key"))
    return rows.select("asset_key", F.regexp_replace("logical_path", "/[^/]*$", "").alias("logical_path"), F.regexp_extract("logical_path", "([^/]*)$", 1).alias("file_name"))


def q_directory_meta(spark, sf):
    return transforms.directory_meta(_directories(spark, sf))


def q_directory_execute(spark, sf):
    """Results of the folders from the file formats and kinds of their assets."""
    assets = fixture(spark, sf, "fx_assets")
    folders = assets.groupBy("logical_path").agg((F.min("asset_key") + 2000000).alias("directory"))
    children = assets.join(folders, "logical_path").select("directory", F.col("asset_key").alias("child"), "status", "is_valid", F.array("file_format", "data_type").alias("keywords"))
    found = transforms.directory_execute(children)
    return found.withColumns({n: F.array_join(n, "|") for n in ("keywords", "fields")})


def q_enrich(spark, sf):
    """A user's function over batches of documents, in place of a model call, and its answers read."""

    def answer(frames):
        for f in frames:
            yield f.assign(raw=[f'Sure: {{"keywords": ["{lang}", "{source}"], "entities": ["{lang}"]}}' for lang, source in zip(f["lang"], f["source"], strict=True)])[["doc_id", "raw"]]

    answers = extract.enrich(table(spark, sf, "documents").select("doc_id", "lang", "source"), answer, "doc_id long, raw string")
    found = extract.parse_responses(answers, "doc_id", "raw")
    return found.select("doc_id", F.array_join("keywords", "|").alias("keywords"), F.array_join("entities", "|").alias("entities"), "error")


def q_leaf_execute(spark, sf):
    columns = fixture(spark, sf, "fx_keywords").select("asset_key", "pos", F.concat(F.lit("f"), "pos").alias("name"))
    kinds = F.when((F.col("data_type") == "relational") & (F.col("asset_key") % 14 == 2), "keyvalue").otherwise(F.col("data_type"))
    assets = c.live(fixture(spark, sf, "fx_assets")).select("asset_key", kinds.alias("data_type"), "file_name")
    bodies = table(spark, sf, "documents").select(F.col("doc_id").alias("asset_key"), F.concat(F.lit('{"lang":{"'), "lang", F.lit('":1}}')).alias("body"))
    found = transforms.leaf_execute(assets, columns, bodies)
    return found.withColumns({n: F.array_join(n, "|") for n in ("keywords", "fields")})


def q_sql_functions(spark, sf):
    """The functions in use from SQL."""
    transforms.register(spark)
    fixture(spark, sf, "fx_assets").createOrReplaceTempView("ag_assets")
    return spark.sql("select asset_key, ag_normalize_path(concat(logical_path, '//x/')) as path, ag_file_extension(file_name) as extension, ag_entity_norm(file_name) as norm, ag_token_estimate(file_name) as tokens, ag_confidence(cast(file_size as string)) as confidence from ag_assets")


def q_sql_expand(spark, sf):
    """The table function in use from SQL: what assets mention beside one entity."""
    transforms.register(spark, g.mentions(fixture(spark, sf, "fx_keywords"), "asset_key", "keyword"))
    return spark.sql(f"select asset_key, candidate from ag_expand('{FOCUS}')")


def q_sql_relations(spark, sf):
    """The table function that takes a table, over two of them with keys of different types: what documents and suppliers mention beside one
    entity, what is known of the pairs, and what is to be stored for the others after the answers."""
    transforms.register(spark)
    known = saved(g.mentions(fixture(spark, sf, "fx_keywords"), "asset_key", "keyword"), "mentions")
    # assets that don't mention the focus have no candidates, so their words and triples go no further
    focused = known.where(F.col("norm") == FOCUS).select("asset_key")
    around = known.join(focused, "asset_key", "left_semi")
    around.createOrReplaceTempView("ag_known")
    triples = fixture(spark, sf, "fx_triples").join(focused, "asset_key", "left_semi")
    triples = triples.where((entity_norm(F.col("subject")) == FOCUS) | (entity_norm(F.col("object")) == FOCUS))
    g.semantic_relations(triples, around, "asset_key", "pos").createOrReplaceTempView("ag_semantic")
    shipped = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    # equal facts say the same, so a supplier has one row for each brand and flag, however much it ships
    saved(shipped.select("l_suppkey", "p_brand", "l_returnflag").distinct(), "shipped").createOrReplaceTempView("ag_shipped")
    return spark.sql(f"""select 'document' as of, cast(asset_key as string) as asset, candidate, status, a, b, related, relation, source from ag_relations(TABLE(
      select asset_key, norm, cast(null as string) as other, cast(null as boolean) as related, cast(null as string) as answer from ag_known
      union all select asset_key, a, b, relation <> 'rel3', null from ag_semantic where a = '{FOCUS}' or b = '{FOCUS}'
      union all select asset_key, norm, '{FOCUS}', null, 'linked' from ag_known where norm like 't%' and norm <> '{FOCUS}'), '{FOCUS}')
    union all select 'supplier', asset, candidate, status, null, null, null, null, null from ag_relations(TABLE(
      select distinct concat('s', l_suppkey) as asset, p_brand as norm, cast(null as string) as other, cast(null as boolean) as related from ag_shipped
      union all select concat('s', l_suppkey), '{BRAND}', p_brand, l_returnflag = 'R' from ag_shipped where p_brand <> '{BRAND}' and l_returnflag <> 'A'), '{BRAND}', {BRANDS})""")


def q_graph_sink(spark, sf):
    """Edges that were merged in two steps, first those of finished assets, then all, and read back."""
    live = c.live(fixture(spark, sf, "fx_assets"), null_is_live=True)
    path = fresh_path(spark, "graph")
    for own in (live.where("status = 'SUCCESS'"), live):
        sinks.write_graph(g.nodes(own, "asset_key", "logical_path", "file_name"), g.edges(own, "asset_key", "logical_path"), path)
    return sinks.read_table(spark, f"{path}/edges", "src string, dst string, type string")


def q_log_sink(spark, sf):
    """State of a log that was appended day by day."""
    log, path = fixture(spark, sf, "fx_assets_log"), fresh_path(spark, "log")
    for day, part in (("2024-01-01", "seq % 4 = 0"), ("2024-01-02", "seq % 4 <> 0")):
        sinks.append_log(log.where(part), path, day)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields)
    return c.current_state(sinks.read_log(spark, path, schema, "2024-01-02"), "asset_key", "seq").select("asset_key", "status", "is_valid")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_PATH = "logical_path || '/' || file_name"
ORACLE = {
    "q_leaf_meta": oracle(f"select asset_key as meta_key, logical_path, {_PATH} as asset_path, file_name, data_type, file_format, file_size, cast(null as varchar) as create_time, replace(substr({_PATH}, 2), '/', '.') as content_path from fx_assets where is_valid", "fx_assets"),
    "q_directory_meta": oracle("""with d as (select logical_path as p, min(asset_key) + 2000000 as k from fx_assets group by 1) select k as meta_key, regexp_replace(p, '/[^/]*$', '') as logical_path, p as asset_path, regexp_extract(p, '([^/]*)$', 1) as file_name,
 'directory' as data_type, '' as file_format, cast(0 as bigint) as file_size, cast(null as varchar) as create_time, cast(null as varchar) as content_path from d""", "fx_assets"),
    "q_directory_execute": oracle("""with d as (select logical_path, min(asset_key) + 2000000 as k from fx_assets group by 1), w as (select k, w, min(asset_key * 2 + i) as o from d join (select logical_path, asset_key, status, is_valid, unnest([file_format, data_type]) as w, unnest([0, 1]) as i from fx_assets) a using (logical_path) where status = 'SUCCESS' and is_valid group by 1, 2),
 r as (select k, string_agg(w, '|' order by o, w) as kw from (select *, row_number() over (partition by k order by o, w) as nth from w) where nth <= 12 group by 1)
 select d.k as asset_key, case when kw is null then 'FAILED' else 'SUCCESS' end as status, coalesce(kw, '') as keywords, '' as fields, 'directory' as field_kind, case when kw is null then 'no keywords of children' else '' end as message from d left join r on r.k = d.k""", "fx_assets"),
    "q_enrich": "select doc_id, lang || '|' || source as keywords, lang as entities, false as error from documents",
    "q_leaf_execute": oracle("""with k0 as (select asset_key, string_agg('f' || pos, '|' order by pos) as fields from fx_keywords group by 1), a0 as (select asset_key, logical_path, file_name, file_format, is_valid, case when data_type = 'relational' and asset_key % 14 = 2 then 'keyvalue' else data_type end as data_type from fx_assets),
 k as (select a0.asset_key, case when data_type = 'keyvalue' then 'lang|lang.' || split_part(logical_path, '/', 3) else fields end as fields from a0 left join k0 using (asset_key)),
 r as (select a.asset_key, data_type, file_name, case when data_type = 'file' then '' else coalesce(fields, '') end as fields, case when data_type = 'file' and file_format = 'zip' then 'SKIPPED' when data_type <> 'file' and fields is null then 'FAILED' else 'SUCCESS' end as status from a0 a left join k on k.asset_key = a.asset_key where is_valid)
 select asset_key, status, case when status = 'SUCCESS' then array_to_string(array_slice(list_concat(case when fields = '' then [] else string_split(fields, '|') end, [data_type, file_name]), 1, 12), '|') else '' end as keywords, fields, case when data_type = 'file' then case when status = 'SKIPPED' then 'skipped' else 'office' end else data_type end as field_kind,
 case status when 'SKIPPED' then 'unsupported file' when 'FAILED' then 'no fields' else '' end as message from r""", "fx_assets", "fx_keywords"),
    "q_sql_functions": oracle("select asset_key, logical_path || '/x' as path, file_format as extension, replace(replace(file_name, '_', ''), '.', '') as norm, cast((length(file_name) + 2) // 3 as bigint) as tokens, case when file_size > 0 then 1.0 else 0.0 end::double as confidence from fx_assets", "fx_assets"),
    "q_sql_expand": oracle(f"""with known as (select distinct asset_key, regexp_replace(lower(keyword), '[^a-z0-9一-龥]', '', 'g') as norm from fx_keywords) select k.asset_key, k.norm as candidate from known k where norm not in ('', '{FOCUS}') and exists (select 1 from known f where f.asset_key = k.asset_key and f.norm = '{FOCUS}')""", "fx_keywords"),
    "q_sql_relations": oracle(f"""with {_KNOWN}, {_REL}, f as (select asset_key, norm, row_number() over (partition by asset_key order by norm) as nth from known where asset_key in (select asset_key from known where norm = '{FOCUS}')),
 c as (select f.asset_key, norm, least(norm, '{FOCUS}') as a, greatest(norm, '{FOCUS}') as b, relation from f left join rel r on r.asset_key = f.asset_key and r.a = least(norm, '{FOCUS}') and r.b = greatest(norm, '{FOCUS}') where nth <= 30 and norm <> '{FOCUS}'),
 sh as (select 's' || l_suppkey as asset, p_brand, l_returnflag as flag from lineitem join part on l_partkey = p_partkey), m as (select asset, p_brand, row_number() over (partition by asset order by p_brand) as nth, bool_or(flag = 'R') as r, bool_or(flag <> 'A') as k from sh group by 1, 2)
 select 'document' as "of", cast(asset_key as varchar) as asset, norm as candidate, case when relation is null then 'unknown' when relation <> 'rel3' then 'related' else 'unrelated' end as status, a, b,
  case when relation is null then norm like 't%' end as related, case when relation is null then case when norm like 't%' then 'linked' else 'no relation' end end as relation, case when relation is null then 'query-udf' end as source from c
 union all select 'supplier', asset, p_brand, case when not k then 'unknown' when r then 'related' else 'unrelated' end, null, null, null, null, null from m where nth <= {BRANDS} and p_brand <> '{BRAND}' and asset in (select asset from m where p_brand = '{BRAND}')""", "fx_keywords", "fx_triples"),
    "q_graph_sink": oracle("""with live as (select * from fx_assets where is_valid) select distinct case when n = 2 then '/' else array_to_string(s[1:n - 1], '/') end as src, array_to_string(s[1:n], '/') as dst, 'CONTAINS' as type
 from (select string_split(logical_path, '/') as s, unnest([2, 3, 4]) as n from live) union all select logical_path, 'asset:' || asset_key, 'HAS_DATA' from live""", "fx_assets"),
    "q_log_sink": oracle("select asset_key, arg_max(status, seq) filter (where status is not null) as status, arg_max(is_valid, seq) filter (where is_valid is not null) as is_valid from fx_assets_log where seq % 4 <> 0 group by 1", "fx_assets_log"),
}
