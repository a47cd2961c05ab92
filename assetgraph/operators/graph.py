"""The knowledge graph as tables of nodes and edges: building, searching and comparing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetgraph.functions.names import display_name, entity_norm
from assetgraph.functions.paths import asset_path, leaf_name, normalize_path, parent_path, path_chain
from assetgraph.functions.text import dedup_strings
from assetgraph.operators.extract import between

FOCUS_ASSETS, CANDIDATES = 8, 30
SIZES = {"LogicalPath": 36, "DataAsset": 42, "Entity": 30}


def nodes(assets: DataFrame, key: str, path: str, name: str) -> DataFrame:
    """(id, label, name, depth): every folder on the way to an asset, and the assets. One shuffle, prefixes combined before it."""
    folders = assets.select(F.explode(path_chain(normalize_path(F.col(path)))).alias("id")).distinct()
    depth = F.size(F.filter(F.split("id", "/"), lambda x: x != ""))
    folders = folders.select("id", F.lit("LogicalPath").alias("label"), F.when(F.col("id") == "/", "/").otherwise(leaf_name(F.col("id"))).alias("name"), depth.alias("depth"))
    own = assets.groupBy(F.col(key).alias("_k")).agg(F.max(name).alias("name"))
    return folders.unionByName(own.select(F.concat(F.lit("asset:"), "_k").alias("id"), F.lit("DataAsset").alias("label"), "name", F.lit(None).cast("int").alias("depth")))


def edges(assets: DataFrame, key: str, path: str) -> DataFrame:
    """(src, dst, type): CONTAINS between folders, HAS_DATA from the folder to the asset."""
    folders = assets.select(F.explode(path_chain(normalize_path(F.col(path)))).alias("dst")).where("dst <> '/'").distinct()
    contains = folders.select(parent_path(F.col("dst")).alias("src"), "dst", F.lit("CONTAINS").alias("type"))
    return contains.unionByName(assets.select(normalize_path(F.col(path)).alias("src"), F.concat(F.lit("asset:"), key).alias("dst"), F.lit("HAS_DATA").alias("type")).distinct())


def node_attributes(assets: DataFrame, key: str, path: str, file: str, kind: str, keywords: str, most: int = 80) -> DataFrame:
    """(id, data_type, keywords, meta_key): a directory's key belongs to its folder's node, other assets have kind and keywords on their own; rows without a kind have none."""
    kinds = F.lower(F.trim(F.coalesce(F.col(kind), F.lit(""))))
    typed = assets.where(kinds != "").withColumn("_kind", kinds)
    folder = asset_path(normalize_path(F.col(path)), F.col(file))
    none = F.array().cast("array<string>")
    rows = typed.select(
        F.when(F.col("_kind") == "directory", folder).otherwise(F.concat(F.lit("asset:"), key)).alias("id"), F.when(F.col("_kind") != "directory", F.col("_kind")).alias("data_type"),
        F.when(F.col("_kind") != "directory", dedup_strings(F.coalesce(keywords, none), most)).alias("keywords"), F.col(key).alias("meta_key"),
    )
    return rows.groupBy("id").agg(F.max_by(F.struct("data_type", "keywords", "meta_key"), "meta_key").alias("_x")).select("id", "_x.*")


def mention_words(assets: DataFrame, key: str, keywords: str, fields: str, entities: str) -> DataFrame:
    """(key, pos, word): the keywords of each asset, or its fields and entities where it has none; pos from 0."""
    none = F.array().cast("array<string>")
    given = dedup_strings(F.coalesce(keywords, none))
    words = F.when(F.size(given) > 0, given).otherwise(dedup_strings(F.concat(F.coalesce(fields, none), F.coalesce(entities, none))))
    return assets.select(key, F.posexplode(words).alias("pos", "word"))


def merge_snapshot(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """stored with the rows of every re-processed key replaced by the fresh ones."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def mentions(keywords: DataFrame, key: str, word: str) -> DataFrame:
    """(key, norm): the entities that an asset mentions."""
    return keywords.select(key, entity_norm(F.col(word)).alias("norm")).where("norm <> ''").distinct()


def entities(keywords: DataFrame, key: str, order: str, word: str) -> DataFrame:
    """(norm, name): the name that was seen first."""
    named = keywords.select(key, order, F.col(word).alias("_w"), entity_norm(F.col(word)).alias("norm")).where("norm <> ''")
    return named.groupBy("norm").agg(display_name(F.min_by("_w", F.struct(key, order, "_w"))).alias("name"))


def semantic_relations(triples: DataFrame, known: DataFrame, key: str, order: str, label: str = "DataAsset") -> DataFrame:
    """(key, a, b, relation, reversed, asset_ref): one undirected edge for each pair of an asset's entities, the last relation wins; asset_ref is `Label::key`."""
    rows = triples.where("predicate <> ''").select(key, order, "predicate", entity_norm(F.col("subject")).alias("_s"), entity_norm(F.col("object")).alias("_o"))
    rows = between(rows, known.where("norm <> ''"), key, "norm", "_s", "_o", self_loops=False)
    pairs = rows.select(key, order, F.least("_s", "_o").alias("a"), F.greatest("_s", "_o").alias("b"), "predicate", (F.col("_s") > F.col("_o")).alias("_r"))
    last = pairs.groupBy(key, "a", "b").agg(F.max(F.struct(order, "predicate", "_r")).alias("_x"))
    return last.select(key, "a", "b", F.col("_x.predicate").alias("relation"), F.col("_x._r").alias("reversed"), F.concat(F.lit(f"{label}::"), key).alias("asset_ref"))


def relation_candidates(known: DataFrame, relations: DataFrame, key: str, assets: int = FOCUS_ASSETS, each: int = CANDIDATES) -> DataFrame:
    """(focus, key, candidate, status) for all entities at once: what stands beside the focus in its newest assets, as related, unrelated or unknown.

    relations: key, a, b, related. The assets of a focus and the candidates of an asset are bounded before they are joined.
    """
    groups = known.withColumn("_nth", F.row_number().over(Window.partitionBy("norm").orderBy(F.desc(key)))).where(F.col("_nth") <= assets).select(F.col("norm").alias("focus"), key)
    beside = known.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy("norm"))).where(F.col("_nth") <= each).select(key, F.col("norm").alias("candidate"))
    pairs = groups.join(beside, key).where("focus <> candidate").withColumn("a", F.least("focus", "candidate")).withColumn("b", F.greatest("focus", "candidate"))
    joined = pairs.join(relations.select(key, "a", "b", "related"), [key, "a", "b"], "left")
    return joined.select("focus", key, "candidate", F.when(F.col("related"), "related").when(~F.col("related"), "unrelated").otherwise("unknown").alias("status"))


def write_back(candidates: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """(key, a, b, related, relation, source) for the unknown pairs: what was answered, and the rest as not related."""
    asked = candidates.where("status = 'unknown'").select(key, F.least("focus", "candidate").alias("a"), F.greatest("focus", "candidate").alias("b")).distinct()
    joined = asked.join(answers.select(key, "a", "b", F.col("relation").alias("_r")), [key, "a", "b"], "left")
    return joined.select(key, "a", "b", F.col("_r").isNotNull().alias("related"), F.coalesce("_r", F.lit("no relation")).alias("relation"), F.lit("query-udf").alias("source"))


def query_prefix(assets: DataFrame, known: DataFrame, key: str, path: str, prefix: str, max_nodes: int, drawings: DataFrame | None = None, updated: str | None = None) -> DataFrame:
    """(kind, rank, src, dst): the edges around the newest assets below a path, within the row budget. The limit comes before the joins. Newest: by the column
    `updated` where it is set, else by key; ties by key.

    HAS_DATA from the folder, CONTAINS from the root down to it, MENTIONS of entities, and for drawings (key, component), which show no
    mentions, DEPICTS with the root component. rank: of the asset, 0 for CONTAINS. Without assets the folders below the path, as NODE.
    """
    width, rows = min(200, max(10, max_nodes)), min(2000, max(100, 4 * max_nodes))
    below = lambda c: (c == prefix) | F.startswith(c, F.lit(prefix.rstrip("/") + "/"))
    age = [F.coalesce(F.col(updated), F.col(key)).desc(), F.desc(key)] if updated else [F.desc(key)]
    newest = assets.where(below(F.col(path))).orderBy(*age).limit(width)
    ranked = newest.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*age)))  # at most `width` rows
    drawn = drawings.select(F.col(key).alias("_d"), "component") if drawings is not None else assets.sparkSession.createDataFrame([], f"_d {assets.schema[key].dataType.simpleString()}, component string")
    ranked = ranked.join(drawn, F.col(key) == F.col("_d"), "left")
    told = ranked.join(known.select(F.col(key).alias("_m"), "norm"), (F.col(key) == F.col("_m")) & F.col("_d").isNull(), "left")
    found = told.select("rank", F.concat(F.lit("asset:"), key).alias("asset"), normalize_path(F.col(path)).alias("parent"), "norm", "component").orderBy("rank", "norm", "component").limit(rows)
    edge = lambda df, kind, rank, src, dst: df.select(F.lit(kind).alias("kind"), F.col(rank).cast("int").alias("rank") if rank else F.lit(0).alias("rank"), F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    chain = found.select(F.explode(path_chain(F.col("parent"))).alias("dst")).where("dst <> '/'").distinct().withColumn("src", parent_path(F.col("dst")))
    parts = [edge(found, "HAS_DATA", "rank", "parent", "asset"), edge(chain, "CONTAINS", None, "src", "dst"), edge(found.where("norm is not null"), "MENTIONS", "rank", "asset", "norm"), edge(found.where("component is not null"), "DEPICTS", "rank", "asset", "component")]
    if newest.isEmpty():
        folders = assets.select(F.explode(path_chain(normalize_path(F.col(path)))).alias("src")).distinct().where(below(F.col("src"))).orderBy("src").limit(rows)
        parts.append(edge(folders.withColumn("dst", F.lit(None).cast("string")), "NODE", None, "src", "dst"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def search(assets: DataFrame, known: DataFrame, key: str, word: str, types: list[str] | None = None, newest: int = 120, texts: list[DataFrame] = [], folders: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """(kind, id): the newest assets that a word hits by name, path, mentioned entities, or by one of the further texts (key, text): keywords, components,
    part numbers, specifications, dimensions. Without a type, the folders (path, key) hit by name or path too, the newest first."""
    hit = lambda c: F.contains(F.lower(c), F.lit(word.lower()))
    of_type = assets.where(F.lower("data_type").isin(*types)) if types else assets
    ids = of_type.where(hit(asset_path(normalize_path(F.col("logical_path")), F.col("file_name")))).select(key)
    for source in [known.where(hit(F.col("norm"))), *(t.where(hit(F.col("text"))) for t in texts)]:
        ids = ids.union(of_type.join(source.select(key), key, "left_semi").select(key))
    found = ids.distinct().orderBy(F.desc(key)).limit(newest).select(F.lit("asset").alias("kind"), F.col(key).cast("string").alias("id"))
    if types or folders is None:
        return found
    return found.unionByName(folders.where(hit(F.col("path"))).orderBy(F.desc("key"), "path").limit(newest).select(F.lit("directory").alias("kind"), F.col("path").alias("id")))


def matched_entities(assets: DataFrame, known: DataFrame, named: DataFrame, key: str, word: str, most: int = 16, drawings: DataFrame | None = None) -> DataFrame:
    """(norm, name): entities of the assets, but of no drawings (key), whose name contains a word, the first by name."""
    if drawings is not None:
        assets = assets.join(drawings.select(key), key, "left_anti")
    norms = known.join(assets.select(key).distinct(), key, "left_semi").select("norm").distinct()
    return named.join(norms, "norm", "left_semi").where(F.contains(F.lower("name"), F.lit(word.lower()))).orderBy("name", "norm").limit(most)


def shown_name(label: Column, name: Column, id_: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.when(label == "DataAsset", F.concat(F.lit("Asset "), id_)), id_)


def assemble(found: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label, name, category, size): distinct nodes, and a placeholder for every end of an edge that has none. Categories count the labels by their first node."""
    once = found.groupBy("id").agg(F.min(F.struct("label", "name")).alias("_x")).select("id", "_x.label", "_x.name")
    ends = links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct()
    missing = ends.join(once, "id", "left_anti").select("id", F.lit("Unknown").alias("label"), F.lit("(unknown)").alias("name"))
    every = once.unionByName(missing)
    labels = every.groupBy("label").agg(F.min("id").alias("_first"))  # a row for each label
    ranked = labels.withColumn("category", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_first", "label")) - 1).select("label", "category")
    size = F.lit(24)
    for label, n in SIZES.items():
        size = F.when(F.col("label") == label, n).otherwise(size)
    return every.join(F.broadcast(ranked), "label").select("id", "label", shown_name(F.col("label"), F.col("name"), F.col("id")).alias("name"), "category", size.alias("size"))


def assemble_edges(links: DataFrame) -> DataFrame:
    """(src, dst, type, relation): every edge once."""
    return links.select("src", "dst", "type", F.coalesce("relation", F.lit("")).alias("relation")).distinct()


def clamp_budget(most: int, policy: int = 200) -> int:
    """A node budget from 20 up to what the policy allows, itself from 20 to 500."""
    return max(20, min(most, max(20, min(policy, 500))))


def budget_report(found: DataFrame, kept: DataFrame) -> DataFrame:
    """One row (nodes, omitted, truncated)."""
    counts = found.agg(F.count("*").alias("_all")).join(F.broadcast(kept.agg(F.count("*").alias("nodes"))))  # two single rows
    return counts.select("nodes", (F.col("_all") - F.col("nodes")).alias("omitted"), (F.col("_all") > F.col("nodes")).alias("truncated"))


def within_budget(found: DataFrame, links: DataFrame, matched: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """The nodes that match first, then by id, up to the budget, and the edges with both ends among them."""
    kept = found.orderBy(F.desc(matched), "id").limit(most)
    ids = kept.select("id")
    own = links.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, own


def delta(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Rows of on with `change`: added or removed."""
    a, b = old.select(*on).distinct(), new.select(*on).distinct()
    return b.join(a, on, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, on, "left_anti").withColumn("change", F.lit("removed")))


LABEL_RANK = ("Component", "Entity", "DataAsset", "LogicalPath")


def focus(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, label): the first node (id, label) that is new, by the rank of its label, then by id; no row if none is."""
    rank = F.lit(len(LABEL_RANK))
    for i, label in enumerate(LABEL_RANK):
        rank = F.when(F.col("label") == label, i).otherwise(rank)
    return new.join(old.select("id"), "id", "left_anti").orderBy(rank, "id").limit(1).select("id", "label")


def signature(nodes_: DataFrame, edges_: DataFrame) -> str:
    """A text that is equal for equal sets of nodes (id) and edges (src, dst), whatever their order; two aggregations."""
    one = lambda df, *c: df.select(*c).distinct().agg(F.count("*"), F.bit_xor(F.xxhash64(*c)), F.sum(F.xxhash64(*c).cast("decimal(38,0)"))).first()
    return ":".join(map(str, (*one(nodes_, "id"), *one(edges_, "src", "dst"))))


def entity_degree(known: DataFrame, relations: DataFrame) -> DataFrame:
    """(norm, n_assets, n_relations)."""
    ends = relations.select(F.col("a").alias("norm")).union(relations.select(F.col("b").alias("norm"))).groupBy("norm").agg(F.count("*").alias("_r"))
    return known.groupBy("norm").agg(F.count("*").alias("n_assets")).join(ends, "norm", "left").select("norm", "n_assets", F.coalesce("_r", F.lit(0)).alias("n_relations"))
