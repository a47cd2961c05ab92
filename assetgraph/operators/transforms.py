"""The extraction pipeline's stages as DataFrame functions, and the functions to use from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetgraph.functions.paths import asset_path
from assetgraph.operators import extract
from assetgraph.operators.table_functions import register_relations

#: What a stage returns for an asset; errors are rows with status FAILED.
RESULT = "asset_key long, status string, keywords array<string>, fields array<string>, field_kind string, message string"


def leaf_meta(assets: DataFrame) -> DataFrame:
    """The nine columns that every extractor gets of an asset."""
    path = asset_path(F.col("logical_path"), F.col("file_name"))
    created = F.col("create_time") if "create_time" in assets.columns else F.lit(None)
    return assets.select(
        F.col("asset_key").alias("meta_key"), "logical_path", path.alias("asset_path"), "file_name", F.lower("data_type").alias("data_type"), "file_format", "file_size",
        created.cast("string").alias("create_time"), F.regexp_replace(F.substring(path, 2, 1 << 30), "/", ".").alias("content_path"),
    )


def directory_meta(directories: DataFrame) -> DataFrame:
    """The nine columns for directories (asset_key, logical_path, file_name): their content is that of their children."""
    rows = directories.withColumns({"data_type": F.lit("directory"), "file_format": F.lit(""), "file_size": F.lit(0).cast("long")})
    return leaf_meta(rows).withColumn("content_path", F.lit(None).cast("string"))


def directory_execute(children: DataFrame) -> DataFrame:
    """Results of directories from their children (directory, child, status, is_valid, keywords): FAILED without keywords of finished ones."""
    none = F.array().cast("array<string>")
    every = children.select(F.col("directory").alias("asset_key")).distinct()
    done = children.where("status = 'SUCCESS' and is_valid")
    words = extract.directory_summary(done, "directory", "child", "keywords").withColumnRenamed("directory", "asset_key")
    found = every.join(words, "asset_key", "left").withColumn("keywords", F.coalesce("keywords", none))
    good = F.size("keywords") > 0
    return found.select("asset_key", F.when(good, "SUCCESS").otherwise("FAILED").alias("status"), "keywords", none.alias("fields"), F.lit("directory").alias("field_kind"), F.when(good, "").otherwise("no keywords of children").alias("message"))


def leaf_execute(assets: DataFrame, columns: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """Results of all assets at once, each by the branch of its kind.

    assets: asset_key, data_type, file_name. columns: asset_key, pos, name. bodies: asset_key, body of key-value assets. Tables, time series and
    documents get fields from their columns, key-value assets from their bodies; files are routed by their extension; other kinds fail with a message.
    """
    none = F.array().cast("array<string>")
    table_like = ("relational", "document") if bodies is not None else ("relational", "keyvalue", "document")
    kinds = assets.select("asset_key", "data_type")
    own = columns.join(kinds, "asset_key")
    plain = extract.fields(own.where(F.col("data_type").isin(*table_like)), "asset_key", "pos", "name")
    timed = extract.fields(own.where("data_type = 'timeseries'"), "asset_key", "pos", "name", ("time", "timestamp"))
    named = plain.unionByName(timed)
    if bodies is not None:
        named = named.unionByName(extract.json_fields(bodies.join(kinds.where("data_type = 'keyvalue'"), "asset_key", "left_semi"), "asset_key", "body"))
    found = assets.join(named, "asset_key", "left").withColumn("fields", F.coalesce("fields", none))
    route = extract.route_file(F.col("file_name"))
    is_file, known = F.col("data_type") == "file", F.col("data_type").isin(*table_like, "keyvalue", "timeseries", "file")
    status = F.when(~known, "FAILED").when(is_file & (route == "skipped"), "SKIPPED").when(~is_file & (F.size("fields") == 0), "FAILED").otherwise("SUCCESS")
    message = F.when(~known, F.concat(F.lit("no extractor for "), "data_type")).when(is_file & (route == "skipped"), "unsupported file").when(status == "FAILED", "no fields").otherwise("")
    keywords = F.when(status == "SUCCESS", extract.fallback_keywords(none, F.col("fields"), F.array("data_type"), F.col("file_name"))).otherwise(none)
    return found.select("asset_key", status.alias("status"), keywords.alias("keywords"), "fields", F.when(is_file, route).otherwise(F.col("data_type")).alias("field_kind"), message.alias("message"))


#: Scalar functions for SQL. Their bodies are SQL too, so Catalyst inlines them.
SQL_FUNCTIONS = {
    "ag_normalize_path(p string) returns string": "regexp_replace(regexp_replace(concat('/', coalesce(trim(p), '')), '/+', '/'), '(.)/$', '$1')",
    "ag_entity_norm(s string) returns string": "regexp_replace(lower(s), '[^a-z0-9一-龥]', '')",
    "ag_file_extension(s string) returns string": r"lower(regexp_extract(coalesce(s, ''), '[.]([^./]+)$', 1))",
    "ag_token_estimate(s string) returns bigint": r"(length(regexp_replace(coalesce(s, ''), '[^\\x00-\\x7F]', '')) + 2) div 3 + 2 * (length(coalesce(s, '')) - length(regexp_replace(coalesce(s, ''), '[^\\x00-\\x7F]', '')))",
    "ag_confidence(s string) returns double": "coalesce(least(1.0d, greatest(0.0d, try_cast(s as double))), 0.0d)",
}


#: What assets mention beside a focus, over a view ag_mentions (asset_key, norm); a table function whose body Catalyst inlines.
EXPAND = """create or replace temporary function ag_expand(focus string) returns table (asset_key bigint, candidate string)
return select distinct m.asset_key, m.norm from ag_mentions m left semi join (select asset_key from ag_mentions f where f.norm = ag_expand.focus) f on m.asset_key = f.asset_key where m.norm <> ag_expand.focus"""


def register(spark: SparkSession, mentions: DataFrame | None = None) -> list[str]:
    """Makes the scalar functions known to SQL, the table function ag_relations and, given the mentions (asset_key, norm), ag_expand; returns their names."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    names = [*(h.split("(")[0] for h in SQL_FUNCTIONS), register_relations(spark)]
    if mentions is not None:
        mentions.createOrReplaceTempView("ag_mentions")
        spark.sql(EXPAND)
        names.append("ag_expand")
    return names
