"""Derived inputs: SQL over the tables that gives the same rows in Spark and in DuckDB (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES = {
    "fx_assets": r"""
select d.doc_id as asset_key,
       concat('/docs/', d.lang, '/', d.source) as logical_path,
       case d.doc_id % 7 when 0 then 'document' when 1 then 'file' when 2 then 'relational' when 3 then 'timeseries' else 'file' end as data_type,
       concat('doc_', cast(d.doc_id as string), case d.doc_id % 7 when 0 then '.json' when 1 then '.pdf' when 2 then '.csv' when 3 then '.csv' when 4 then '.zip' else '.pdf' end) as file_name,
       d.n_chars as file_size,
       case d.doc_id % 7 when 0 then 'json' when 1 then 'pdf' when 2 then 'csv' when 3 then 'csv' when 4 then 'zip' else 'pdf' end as file_format,
       d.doc_id % 29 <> 0 as is_valid,
       case when d.doc_id % 7 = 4 or (d.lang = 'de' and d.source = 'src3') then 'SKIPPED' when d.lang = 'fr' or d.source like 'src1%' then 'SUCCESS' when l.quality = 1 then 'SUCCESS' when l.quality = 0 then 'FAILED' else 'PENDING' end as status
from documents d left join labels l on l.doc_id = d.doc_id
""",
    "fx_assets_log": r"""
select doc_id as asset_key, doc_id * 4 as seq, concat('/docs/', lang, '/', source) as logical_path, concat('doc_', cast(doc_id as string)) as file_name,
       n_chars as file_size, true as is_valid, 'PENDING' as status, cast(null as string) as keywords from documents
union all
select doc_id, doc_id * 4 + 1, null, null, null, null, 'PROCESSING', null from labels
union all
select doc_id, doc_id * 4 + 2, null, null, null, null, case when quality = 1 then 'SUCCESS' else 'FAILED' end, '["k"]' from labels
union all
select doc_id, doc_id * 4 + 3, null, null, null, false, null, null from documents where doc_id % 29 = 0
""",
    "fx_keywords": r"""
select asset_key, pos, word as keyword
from (select asset_key, word, row_number() over (partition by asset_key order by n desc, first_pos) as pos
      from (select asset_key, word, count(*) as n, min(pos) as first_pos from fx_words group by asset_key, word) c) r
where pos <= 12
""",
    "fx_triples": r"""
select asset_key, pos, word as subject, case when (asset_key + pos) % 7 = 0 then '' else concat('rel', cast(pos % 4 as string)) end as predicate,
       case when (asset_key + pos) % 5 = 0 then 'outsider' else next_word end as object
from (select asset_key, pos, word, lead(word) over (partition by asset_key order by pos) as next_word from fx_words) w
where next_word is not null
""",
    "fx_columns": r"""
select case p_partkey % 6 when 0 then 'mysql' when 1 then 'postgres' when 2 then 'iotdb' when 3 then 'mongodb' when 4 then 'redis' else 'filesystem' end as source_type,
       case p_partkey % 6
         when 0 then concat('data.extern.mysql10_0_0_1_3306.shop.t', cast(p_size as string), '.c', cast(p_partkey as string))
         when 1 then concat('data.extern.postgres10_0_0_1_5432.postgresql.t', cast(p_size as string), '.c', cast(p_partkey as string))
         when 2 then concat('data.extern.iotdb10_0_0_1_6667.root.d', cast(p_size as string), '.m', cast(p_partkey as string))
         when 3 then concat('data.extern.mongodb10_0_0_1_27017.db.coll', cast(p_size as string), '.a.b', cast(p_partkey as string))
         when 4 then concat('data.extern.redis10_0_0_1_6379.k', cast(p_partkey as string))
         else concat('data.extern.filesystem10_0_0_1_6670.root.dir', cast(p_size % 7 as string), '.f', cast(p_size as string), chr(92), '.csv.', case when p_partkey % 4 = 1 then 'event_time' else concat('c', cast(p_partkey as string)) end)
       end as path,
       case p_partkey % 5 when 0 then 'LONG' when 1 then 'DOUBLE' when 2 then 'BINARY' when 3 then 'INTEGER' else 'BOOLEAN' end as type
from part
""",
    "fx_csv_lines": r"""
select f.file_no, h.line_no, replace(h.line, ',', case f.file_no when 0 then ',' when 1 then chr(9) else ';' end) as line
from (values (0), (1), (2)) as f(file_no)
join (select 0 as file_no, cast(0 as bigint) as line_no, 'part key,2nd-name,size,' as line
      union all select 1, cast(0 as bigint), 'part key,2nd-name,size,' union all select 2, cast(0 as bigint), 'part key,2nd-name,size,'
      union all select cast(p_partkey % 3 as int), p_partkey + 1, concat(cast(p_partkey as string), ',', p_name, ',', cast(p_size as string), case when p_partkey % 10 = 0 then '' else ',x' end) from part) h
  on h.file_no = f.file_no
""",
    "fx_ts_cells": r"""
select event_type as file, event_id as line_no,
       case event_id % 6 when 0 then substring(cast(ts as string), 1, 19)
         when 1 then concat(replace(substring(cast(ts as string), 1, 19), ' ', 'T'), 'Z')
         when 2 then replace(substring(cast(ts as string), 1, 16), '-', '/')
         when 3 then substring(cast(ts as string), 1, 10)
         when 4 then cast(1704067200000 + event_id as string)
         else 'n/a' end as time_text,
       case when event_id % 11 = 0 then '' else cast(user_id as string) end as v_num,
       case when event_id % 13 = 0 then event_type else cast(user_id as string) end as v_text
from events
""",
    "fx_kv_lines": r"""
select user_id as file_no, event_id as line_no,
       case event_id % 6 when 0 then concat('# ', event_type) when 1 then concat('export ', event_type, '="', cast(event_id as string), '"')
         when 2 then concat(event_type, ' : a=b') when 3 then '' when 4 then concat('=', event_type) else concat('2', event_type, ' = ', cast(event_id as string)) end as line
from events
""",
    "fx_json": r"""
select event_id as file_no,
       case event_id % 4
         when 0 then concat('{"_id":{"$oid":"', cast(event_id as string), '"},"user":{"id":', cast(user_id as string), ',"tags":["', event_type, '","x"]},"v":', cast(event_id as string), '}')
         when 1 then concat('[{"v":"text"},{"v":true,"n":null}]')
         when 2 then concat('{"v":3000000000,"2b-c":', props, '}')
         else concat('{"broken": ', cast(event_id as string)) end as body
from events
""",
    "fx_responses": r"""
select doc_id as asset_key,
       case doc_id % 5
         when 0 then concat('{"keywords":["', lang, '","', source, '","', lang, '"],"triples":[{"subject":"', lang, '","predicate":"in","object":"', source, '"}]}')
         when 1 then concat('<think>x {y}</think>{"keywords":["', source, '"],"relations":[{"subject":"', source, '","relation":"r","object":"', lang, '"}]}')
         when 2 then concat('```json', chr(10), '{"keywords":["', lang, '"]}', chr(10), '```')
         when 3 then concat('Answer: {"keywords":["', source, '"],"entities":[""," ', lang, ' "]} done')
         else 'no json here' end as raw
from documents
""",
    "fx_parts": r"""
select p_partkey as occ, p_name as name, p_size as quantity,
       case when p_partkey < 8 then null
            when p_partkey % 97 = 0 then p_partkey + 1
            when p_partkey % 97 = 1 then p_partkey - 1
            when p_partkey % 101 = 0 then 999999
            else cast(floor(p_partkey / 8) as bigint) end as parent
from part
""",
    "fx_dims": r"""
select l_orderkey * 10 + l_linenumber as dim, case when l_partkey % 17 = 0 then null when l_partkey % 19 = 0 then -1 else l_partkey end as target,
       cast(l_quantity as bigint) as nominal, l_returnflag as kind
from lineitem
""",
    "fx_sources": r"""
select s_suppkey as source_key, case s_suppkey % 4 when 0 then 'MySQL' when 1 then 'iotdb' when 2 then 'file-system' else 'redis' end as source_type,
       case s_suppkey % 3 when 0 then '127.0.0.1' when 1 then '10.0..0-7' else ' db host ' end as ip, cast(case when s_suppkey = 9 then 6667 else 6000 + s_suppkey % 1000 end as int) as port
from supplier
""",
    "fx_events_log": r"""
select event_id + 1 as seq, substring(cast(ts as string), 1, 19) as ts_text, case event_type when 'error' then 'WARN' when 'signup' then 'running' when 'purchase' then 'success' else event_type end as level,
       concat('user ', cast(user_id as string)) as text
from events
""",
    "fx_file_list": r"""
select page_id, regexp_extract(url, 'https?://([^/?#]+)', 1) as host, regexp_extract(url, 'https?://[^/?#]+(/[^?#]*)?', 1) as path, length(html) as size_chars from pages
""",
}


#: Fixtures that the two engines write differently: the words of every whole text, by place from 1. In Spark whole texts are shuffled
#: by document, once; what is made of their words stays in its task. A number of tasks is given, so that they aren't coalesced by the size of the texts; it
#: grows with the texts, since words take some twenty times their memory where they are counted and sorted.
WORDS = {
    "spark": "select doc_id as asset_key, p + 1 as pos, word from (select /*+ repartition({parts}, doc_id) */ doc_id, text from documents) lateral view posexplode(split(text, ' ')) w as p, word where word <> ''",
    "duckdb": "select asset_key, cast(pos as int) as pos, ws[pos] as word from (select asset_key, ws, unnest(range(1, len(ws) + 1)) as pos from (select doc_id as asset_key, string_split(text, ' ') as ws from documents)) where ws[pos] <> ''",
}
FROM_WORDS = ("fx_keywords", "fx_triples")
#: Bytes of text whose words one task has.
TASK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the tables it names, as views of sf_dir."""
    import re

    for name in set(re.findall(r"\b\w+\b", sql)) & set(TABLES):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def word_tasks(spark: SparkSession, texts: DataFrame, each: int = TASK_BYTES) -> int:
    """The number of tasks among which texts are dealt for their words."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    words = f"with fx_words as ({WORDS['spark'].format(parts=word_tasks(spark, table(spark, sf_dir, 'documents')))}) " if name in FROM_WORDS else ""
    return run_sql(spark, sf_dir, words + FIXTURES[name])


def oracle(sql: str, *names: str) -> str:
    """DuckDB SQL with the named fixtures in front."""
    words = [f"fx_words as materialized ({WORDS['duckdb']})"] if set(names) & set(FROM_WORDS) else []
    parts = ", ".join(words + [f"{n} as materialized ({FIXTURES[n]})" for n in names])
    return f"with {parts} {sql}" if not sql.lstrip().lower().startswith("with ") else f"with {parts}, {sql.lstrip()[5:]}"
