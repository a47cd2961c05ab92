"""Search in the graph and the graph around what it finds.

A search is a union of hits from several sources, cut to the newest of each kind before anything is joined to them; hits then are at most some hundred rows. The expansion
carries each hit's rank along every edge that it leads to, and keeps the first edges by rank up to the row budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetgraph.functions.paths import asset_path, normalize_path, parent_path, path_chain

MOST_HITS = 120
KINDS = {"NODE": 0, "CONTAINS": 1, "HAS_DATA": 2, "DEPICTS": 3, "MENTIONS": 4, "SEMANTIC_RELATION": 5}


def window(max_nodes: int) -> int:
    return max(10, min(MOST_HITS, max_nodes))


def row_budget(max_nodes: int) -> int:
    return min(2000, max(100, 4 * max_nodes))


def _hit(c: Column, word: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(word.lower())), F.lit(False)) if word else F.lit(True)


def _newest(rows: DataFrame, order: list[Column], most: int, kind: str) -> DataFrame:
    first = rows.orderBy(*order).limit(most)  # each task keeps its first rows
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # over `most` rows
    return first.select(F.lit(kind).alias("kind"), "key", "id", "path", rank.cast("int").alias("rank"))


def hits(
    assets: DataFrame, mentions: DataFrame, key: str, word: str = "", data_type: str = "", path: str = "", max_nodes: int = 200, texts: tuple[DataFrame, ...] = (),
    folders: DataFrame | None = None, folder_mentions: DataFrame | None = None, updated: str | None = None,
) -> DataFrame:
    """(kind, key, id, path, rank): the newest assets, and without a data type the newest folders, that path, type and word all hold for. Empty filters hold for all.

    assets: key, logical_path, file_name, data_type. A word is looked for in the asset's path and name, in names and norms of the entities it mentions (mentions: key, norm,
    name) and in further texts (key, text). folders: path, key, hit by path or by their own mentions (folder_mentions: path, norm, name). Newest: by the column
    `updated` where it is set, else by key; ties by key.
    """
    spark = assets.sparkSession
    places = assets.select(F.col(key).alias("key"), normalize_path(F.col("logical_path")).alias("path"), "file_name", "data_type", (F.col(updated) if updated else F.lit(None)).cast("long").alias("_u"))
    whole = asset_path(F.col("path"), F.col("file_name"))
    allowed = places.where(F.startswith(whole, F.lit(path)) | F.startswith("path", F.lit(path))) if path else places
    allowed = allowed.where(F.lower("data_type") == data_type.lower()) if data_type else allowed
    named = lambda df: df.where(_hit(F.col("name"), word) | _hit(F.col("norm"), word))
    found = allowed
    if word:
        elsewhere = named(mentions).select(F.col(key).alias("key"))
        for t in texts:
            elsewhere = elsewhere.union(t.where(_hit(F.col("text"), word)).select(key))
        # one join for all sources; what the path or name shows needs none
        marked = allowed.join(elsewhere.distinct().withColumn("_there", F.lit(True)), "key", "left")
        found = marked.where(_hit(whole, word) | F.col("_there").isNotNull())
    order = [F.coalesce("_u", "key").desc(), F.col("key").desc()]
    out = _newest(found.withColumn("id", F.concat(F.lit("asset:"), "key")), order, window(max_nodes), "asset")
    if data_type or folders is None:
        return out
    own = folders.select(F.col("key").cast(assets.schema[key].dataType).alias("key"), normalize_path(F.col("path")).alias("path"), (F.col(updated) if updated and updated in folders.columns else F.lit(None)).cast("long").alias("_u"))
    own = own.where(F.startswith("path", F.lit(path))) if path else own
    if word:
        told = named(folder_mentions).select(normalize_path(F.col("path")).alias("path")).distinct().withColumn("_there", F.lit(True)) if folder_mentions is not None else spark.createDataFrame([], "path string, _there boolean")
        own = own.join(told, "path", "left").where(_hit(F.col("path"), word) | F.col("_there").isNotNull())
    return out.unionByName(_newest(own.withColumn("id", F.col("path")), [*order, F.col("path").asc()], window(max_nodes), "directory"))


def expanded(
    found: DataFrame, mentions: DataFrame, relations: DataFrame, key: str, word: str = "", max_nodes: int = 200, drawings: DataFrame | None = None, folder_mentions: DataFrame | None = None,
) -> DataFrame:
    """(hit, rank, kind, src, dst, matched): what the hits lead to, the first of each kind of hit up to the row budget.

    Every hit is a NODE, matched. From an asset: CONTAINS from the root to its folder, HAS_DATA, DEPICTS to the root component of a drawing (drawings: key, component),
    and for others MENTIONS of the entities that the word holds for, with SEMANTIC_RELATION of the asset's own relations (key, a, b, related) between one of those and another
    entity that it mentions, which is mentioned too. From a folder: CONTAINS and all its MENTIONS. Edges have the best rank that leads to them.
    """
    hit = F.broadcast(found)  # at most 2 * MOST_HITS rows
    assets, folders = hit.where("kind = 'asset'"), hit.where("kind = 'directory'")
    edge = lambda df, of, kind, src, dst, matched=False: df.select(F.lit(of).alias("hit"), "rank", F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), F.lit(matched).alias("matched"))
    chain = lambda df: df.select("rank", F.explode(path_chain(F.col("path"))).alias("dst")).where("dst <> '/'")
    none = F.lit(None).cast("string")
    own = mentions.select(F.col(key).alias("key"), "norm", "name").join(assets, "key")
    if drawings is not None:
        drawn = drawings.select(F.col(key).alias("key"), "component").join(assets, "key")
        own = own.join(F.broadcast(drawn.select("key").distinct()), "key", "left_anti")  # of the hits
    shown = own.where(_hit(F.col("name"), word) | _hit(F.col("norm"), word))
    parts = [
        edge(assets, "asset", "NODE", F.col("id"), none, True), edge(folders, "directory", "NODE", F.col("id"), none, True),
        edge(chain(assets), "asset", "CONTAINS", parent_path(F.col("dst")), F.col("dst")), edge(chain(folders), "directory", "CONTAINS", parent_path(F.col("dst")), F.col("dst")),
        edge(assets, "asset", "HAS_DATA", F.col("path"), F.col("id")), edge(shown, "asset", "MENTIONS", F.col("id"), F.col("norm")),
    ]
    if drawings is not None:
        parts.append(edge(drawn, "asset", "DEPICTS", F.col("id"), F.col("component")))
    if folder_mentions is not None:
        parts.append(edge(folder_mentions.select(normalize_path(F.col("path")).alias("path"), "norm").join(folders, "path"), "directory", "MENTIONS", F.col("id"), F.col("norm")))
    if word:
        links = relations.where("related").select(F.col(key).alias("key"), "a", "b").join(F.broadcast(found.where("kind = 'asset'").select("key")), "key", "left_semi")
        both = links.select("key", F.col("a").alias("norm"), F.col("b").alias("other")).union(links.select("key", "b", "a"))
        related = both.join(shown.select("key", "norm", "id", "rank"), ["key", "norm"]).join(own.select("key", F.col("norm").alias("other")), ["key", "other"], "left_semi")
        parts += [edge(related, "asset", "MENTIONS", F.col("id"), F.col("other")), edge(related, "asset", "SEMANTIC_RELATION", F.least("norm", "other"), F.greatest("norm", "other"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    once = out.groupBy("hit", "kind", "src", "dst", "matched").agg(F.min("rank").alias("rank"))
    nth = F.lit(len(KINDS))
    for k, n in KINDS.items():
        nth = F.when(F.col("kind") == k, n).otherwise(nth)
    order = ("rank", nth, "src", "dst")
    first = [once.where(F.col("hit") == h).orderBy(*order).limit(row_budget(max_nodes)) for h in ("asset", "directory")]
    return first[0].unionByName(first[1]).select("hit", "rank", "kind", "src", "dst", "matched")


def _text(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def display_names(nodes: DataFrame) -> DataFrame:
    """nodes (id, label, name, file_name, path, logical_path, norm) with `shown`: the first that is not blank of what the label asks for.

    A folder shows its name, else the last part of its path; an asset its name, file name or logical path; others name, file name, path, logical path or norm.
    """
    leaf = F.when(F.trim("path") == "/", F.lit("/")).otherwise(F.regexp_extract(F.trim("path"), "([^/]*)/*$", 1))
    folder = F.coalesce(_text("name"), F.nullif(leaf, F.lit("")))
    asset = F.coalesce(_text("name"), _text("file_name"), _text("logical_path"))
    rest = F.coalesce(*(_text(c) for c in ("name", "file_name", "path", "logical_path", "norm")), F.lit("(unknown)"))
    return nodes.withColumn("shown", F.coalesce(F.when(F.col("label") == "LogicalPath", folder).when(F.col("label") == "DataAsset", asset), rest))
