"""Queries over the knowledge graph and bills of materials, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assetgraph.fixtures import fixture, oracle, table
from assetgraph.operators import catalog as c
from assetgraph.operators import drawings as d
from assetgraph.operators import extract as x
from assetgraph.operators import graph as g
from assetgraph.operators import graph_search as gs
from assetgraph.plans import extract as x_plans
from assetgraph.scratch import saved

NODES, WORD, MOST = 20, "re", 16
BOM_NODES = 20_000


def _live(spark, sf):
    return c.live(fixture(spark, sf, "fx_assets"), null_is_live=True)


def q_graph_nodes(spark, sf):
    """The current catalog as a tree: folders and assets."""
    state = c.live(c.current_state(fixture(spark, sf, "fx_assets_log"), "asset_key", "seq"), null_is_live=True)
    return g.nodes(state, "asset_key", "logical_path", "file_name")


def q_graph_edges(spark, sf):
    state = c.live(c.current_state(fixture(spark, sf, "fx_assets_log"), "asset_key", "seq"), null_is_live=True)
    return g.edges(state, "asset_key", "logical_path")


def _known(spark, sf):
    return g.mentions(fixture(spark, sf, "fx_keywords"), "asset_key", "keyword")


def q_mentions(spark, sf):
    """Stored mentions of all assets, those of French ones renewed."""
    french = table(spark, sf, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("asset_key"))
    known = saved(_known(spark, sf), "mentions")
    return g.merge_snapshot(known.where("norm <> 'de'"), known.join(french, "asset_key", "left_semi"), "asset_key")


def _entities(spark, sf):
    return g.entities(fixture(spark, sf, "fx_keywords"), "asset_key", "pos", "keyword")


def q_entities(spark, sf):
    return _entities(spark, sf)


def _relations(spark, sf, known):
    return g.semantic_relations(fixture(spark, sf, "fx_triples"), known, "asset_key", "pos")


def q_semantic_relations(spark, sf):
    return _relations(spark, sf, saved(_known(spark, sf), "mentions"))


def _candidates(spark, sf):
    """The mentions are made once and joined three times."""
    known = saved(_known(spark, sf), "mentions")
    relations = _relations(spark, sf, known).withColumn("related", F.col("relation") != "rel3")
    return g.relation_candidates(known, relations, "asset_key")


def q_relation_candidates(spark, sf):
    return _candidates(spark, sf)


def q_relation_writeback(spark, sf):
    """Answers link what begins alike; the other pairs that were asked for are not related."""
    found = _candidates(spark, sf)
    alike = F.substring("focus", 1, 1) == F.substring("candidate", 1, 1)
    answers = found.where(alike).select("asset_key", F.least("focus", "candidate").alias("a"), F.greatest("focus", "candidate").alias("b"), F.lit("linked").alias("relation")).distinct()
    return g.write_back(found, answers, "asset_key")


def q_node_attributes(spark, sf):
    """Folders as directory rows, assets with kind and keywords."""
    live = _live(spark, sf)
    folders = live.groupBy("logical_path").agg(F.min("asset_key").alias("k")).select((F.col("k") + 2000000).alias("asset_key"), F.regexp_replace("logical_path", "/[^/]*$", "").alias("logical_path"), F.regexp_extract("logical_path", "([^/]*)$", 1).alias("file_name"), F.lit("Directory").alias("data_type"))
    listed = fixture(spark, sf, "fx_keywords").groupBy("asset_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "keyword"))), lambda t: t["keyword"]).alias("kw"))
    rows = live.select("asset_key", "logical_path", "file_name", F.when(F.col("file_format") != "zip", F.col("data_type")).alias("data_type")).unionByName(folders).join(listed, "asset_key", "left")
    return g.node_attributes(rows, "asset_key", "logical_path", "file_name", "data_type", "kw").withColumn("keywords", F.array_join("keywords", "|"))


def q_mention_words(spark, sf):
    """Keywords of the answers, or format and kind as fields with the answers' entities."""
    answers = x.parse_responses(fixture(spark, sf, "fx_responses"), "asset_key", "raw").select("asset_key", F.when(F.col("asset_key") % 5 != 3, F.col("keywords")).alias("keywords"), "entities")
    rows = answers.join(fixture(spark, sf, "fx_assets").select("asset_key", F.array("file_format", "data_type").alias("fields")), "asset_key")
    return g.mention_words(rows, "asset_key", "keywords", "fields", "entities")


def _drawings(spark, sf):
    """JSON assets count as analysed drawings."""
    return _live(spark, sf).where("file_format = 'json'").select("asset_key", F.concat(F.lit("component:"), "asset_key").alias("component"))


def q_graph_query(spark, sf):
    """Around the newest English assets, and below a folder that has no assets."""
    live, known = _live(spark, sf).select("asset_key", "logical_path"), saved(_known(spark, sf), "mentions")
    return g.query_prefix(live, known, "asset_key", "logical_path", "/docs/en", NODES, _drawings(spark, sf)).unionByName(g.query_prefix(live, known, "asset_key", "logical_path", "/none", NODES))


def q_graph_search(spark, sf):
    """Assets by name, path, entities, keywords, parts and dimensions; of two kinds, and of all with folders."""
    live, known = _live(spark, sf), saved(_known(spark, sf), "mentions")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("asset_key"), F.concat_ws("\n", "p_name", "p_brand", "p_type").alias("text"))
    dims = fixture(spark, sf, "fx_dims").where("target > 0").select(F.col("target").alias("asset_key"), F.concat_ws(" ", "kind", "nominal").alias("text"))
    words = fixture(spark, sf, "fx_keywords").select("asset_key", F.col("keyword").alias("text"))
    folders = live.groupBy(F.col("logical_path").alias("path")).agg(F.max("asset_key").alias("key"))
    two = g.search(live, known, "asset_key", WORD, ["file", "document"], texts=[words, parts, dims])
    return two.withColumn("of", F.lit("two")).unionByName(g.search(live, known, "asset_key", "a 3", texts=[words, parts, dims], folders=folders).union(g.search(live, known, "asset_key", "src1", folders=folders).where("kind = 'directory'")).withColumn("of", F.lit("all")))


def _told(spark, sf, known):
    """Mentions with the names of their entities, of the assets and of their folders."""
    told = known.join(_entities(spark, sf), "norm")
    homes = _live(spark, sf).select("asset_key", F.col("logical_path").alias("path"), "data_type")
    return told, told.join(homes.where("data_type = 'relational'"), "asset_key").select("path", "norm", "name").distinct()


def q_graph_search_expanded(spark, sf):
    """The graph around what a word finds below a path in one kind of assets, and around what another word finds anywhere, folders too. The newest are the largest texts first."""
    live = _live(spark, sf).withColumn("updated", F.when(F.col("asset_key") % 3 == 0, F.col("file_size")))
    known = saved(_known(spark, sf), "mentions")
    told, of_folders = (saved(x, "told") for x in _told(spark, sf, known))
    relations = saved(_relations(spark, sf, known).withColumn("related", F.col("relation") != "rel3"), "relations")
    folders = live.groupBy(F.col("logical_path").alias("path")).agg(F.max("asset_key").alias("key"))
    out = []
    for name, word, kind, path in (("narrow", WORD, "document", "/docs/en"), ("wide", "src1", "", "")):
        found = saved(gs.hits(live, told, "asset_key", word, kind, path, NODES, folders=folders, folder_mentions=of_folders, updated="updated"), "hits")
        out.append(gs.expanded(found, told, relations, "asset_key", word, NODES, _drawings(spark, sf).where("asset_key % 2 = 0"), of_folders).withColumn("of", F.lit(name)))
    return out[0].unionByName(out[1])


def q_display_names(spark, sf):
    """Names of folders, assets and entities, each without some of its properties."""
    live = _live(spark, sf)
    blank = lambda n, c: F.when(F.col("asset_key") % n == 0, " ").otherwise(c)
    none = F.lit(None).cast("string")
    assets = live.select(F.concat(F.lit("asset:"), "asset_key").alias("id"), F.lit("DataAsset").alias("label"), blank(2, F.col("file_name")).alias("name"), blank(6, F.col("file_name")).alias("file_name"), none.alias("path"), blank(12, F.col("logical_path")).alias("logical_path"), F.col("file_format").alias("norm"))
    folders = live.groupBy("logical_path").agg(F.min("asset_key").alias("asset_key")).select(F.col("logical_path").alias("id"), F.lit("LogicalPath").alias("label"), blank(2, F.lit("a folder")).alias("name"), none.alias("file_name"), F.concat("logical_path", F.lit("/")).alias("path"), none.alias("logical_path"), none.alias("norm"))
    return gs.display_names(assets.unionByName(folders)).select("id", "shown")


def q_matched_entities(spark, sf):
    french = _live(spark, sf).where("logical_path like '/docs/fr/%'")
    return g.matched_entities(french, _known(spark, sf), _entities(spark, sf), "asset_key", WORD, MOST, _drawings(spark, sf))


def _parts_of_graph(spark, sf):
    live = _live(spark, sf)
    found = g.nodes(live, "asset_key", "logical_path", "file_name").where("id not like 'asset:%7'").select("id", "label", F.when(F.col("id").endswith("9"), "").otherwise(F.col("name")).alias("name"))
    return found, g.edges(live, "asset_key", "logical_path").select("src", "dst")


def q_graph_assemble(spark, sf):
    return g.assemble(*_parts_of_graph(spark, sf))


def q_graph_links(spark, sf):
    """The assembled edges of folders, assets, mentions and relations."""
    live, known = _live(spark, sf), saved(_known(spark, sf), "mentions")
    tree = g.edges(live, "asset_key", "logical_path").withColumn("relation", F.lit(None).cast("string"))
    told = known.select(F.concat(F.lit("asset:"), "asset_key").alias("src"), F.col("norm").alias("dst"), F.lit("MENTIONS").alias("type"), F.lit(None).cast("string").alias("relation"))
    between = _relations(spark, sf, known).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("SEMANTIC_RELATION").alias("type"), "relation")
    return g.assemble_edges(tree.unionByName(told).unionByName(between))


def q_graph_focus(spark, sf):
    """What to look at first after the finished assets have been joined by the others."""
    live = _live(spark, sf)
    nodes = lambda df: g.nodes(df, "asset_key", "logical_path", "file_name")
    return g.focus(nodes(live.where("status = 'SUCCESS'")), nodes(live))


def q_node_budget(spark, sf):
    found, links = _parts_of_graph(spark, sf)
    kept, own = g.within_budget(found, links, F.col("name").contains("src"), g.clamp_budget(60))
    report = g.budget_report(found, kept).select(F.concat_ws(":", "nodes", "omitted", F.col("truncated").cast("string")).alias("id"), F.lit("report").alias("kind"))
    return report.unionByName(kept.select("id", F.lit("node").alias("kind"))).unionByName(own.select(F.concat_ws(">", "src", "dst").alias("id"), F.lit("edge").alias("kind")))


def q_graph_signature(spark, sf):
    """Whether two states of the graph have the same signature: with rows in another order and twice, and without what is not finished."""
    live = saved(_live(spark, sf), "live")
    signed = lambda df: g.signature(g.nodes(df, "asset_key", "logical_path", "file_name"), g.edges(df, "asset_key", "logical_path"))
    whole = signed(live)
    again, done = signed(live.unionByName(live).repartition("file_name")), signed(live.where("status = 'SUCCESS'"))
    return live.limit(1).select(F.explode(F.create_map(F.lit("again"), F.lit(whole == again), F.lit("finished"), F.lit(whole == done))).alias("state", "same"))


def q_graph_delta(spark, sf):
    live = _live(spark, sf)
    return g.delta(g.edges(live.where("asset_key % 5 <> 0"), "asset_key", "logical_path"), g.edges(live.where("asset_key % 3 <> 0"), "asset_key", "logical_path"), ["src", "dst"])


def q_entity_degree(spark, sf):
    known = saved(_known(spark, sf), "mentions")
    return g.entity_degree(known, _relations(spark, sf, known))


def _raw(spark, sf):
    """Analyses that are up to 15 KB each, made of short rows; the rows are spread first, since a file of them can be one task's."""
    parts = table(spark, sf, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    cls = F.when(F.col("p_partkey") % 3 == 0, "engineering_drawing").when(F.col("p_partkey") % 3 == 1, "photo").otherwise("")
    kind = F.when(F.col("p_partkey") % 4 == 0, "ebom").when(F.col("p_partkey") % 4 == 1, "odd").otherwise("feature_tree")
    items = F.concat(F.lit('[{"featureId":"a"},"no object",{"featureId":"'), "p_brand", F.lit('"}]'))
    body = F.concat(
        F.lit('{"classification":{"documentClass":"'), cls, F.lit('","domain":" steel","signals":["x","x"," y "],"confidence":"'), F.col("p_size") / 40, F.lit('"},"structure":{"kind":"'), kind, F.lit('","rootOccurrenceIds":["r"]},"summaryText":" '), "p_name",
        F.lit('","features":'), items, F.lit(',"dimensions":'), F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("{}"), F.col("p_size") * 100), ","), F.lit("]")), F.lit(',"notes":["a","b"],"validation":{"issues":[]}}'),
    )
    return parts.select("p_partkey", body.alias("body"))


def q_drawing_normalize(spark, sf):
    """Every part's analysis, with the numbers of entries in its lists."""
    found = d.normalize_analysis(_raw(spark, sf), "p_partkey", "body")
    sizes = [F.size(name).alias(f"n_{name}") for name in ("features", "dimensions", "notes", "evidence")]
    return found.select("p_partkey", "document_class", "engineering", "confidence", "domain", "drawing_type", F.array_join("signals", "|").alias("signals"), "kind", "authority", F.array_join("roots", "|").alias("roots"), "summary", "score", *sizes)


def q_drawing_ids(spark, sf):
    items = table(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 7 == 1, F.concat(F.lit("p"), F.col("p_size") % 5, F.lit("-2"))).otherwise(F.concat(F.lit("p"), F.col("p_size") % 5)).alias("given"))
    return d.stable_ids(items, "p_brand", "p_partkey", "given", "occ").select("p_partkey", "id")


def _tile():
    """The third of the six tiles of a wide sheet."""
    return F.struct(F.lit(0.586667).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(0.58).alias("y1"))


def q_evidence_bbox(spark, sf):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double") * 4
    box = d.to_original(d.clamp_box(e(0), e(1), e(2), e(3)), _tile())
    return table(spark, sf, "embeddings").where("vec_id is not null").select("vec_id", box["x0"].alias("x0"), box["y0"].alias("y0"), box["x1"].alias("x1"), box["y1"].alias("y1"))


def q_tile_bounds(spark, sf):
    sheets = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("w"), (F.col("doc_id") * 37 % 3000).alias("h"))
    return d.tile_bounds(sheets, "doc_id", "w", "h").select("doc_id", "tile", "bounds.*")


def _parts(spark, sf):
    return fixture(spark, sf, "fx_parts")


def _checked(spark, sf):
    """Occurrences of fifty analyses, references, evidence, and the analyses themselves."""
    rows = _parts(spark, sf).select((F.col("occ") % 50).alias("doc"), "occ", (F.col("occ") % 370).cast("string").alias("item_no"), (F.col("quantity") - 3).alias("quantity"))
    evidence = rows.where("occ % 4 <> 0").select("doc", F.col("occ").alias("ev"), F.when(F.col("occ") % 3 == 0, "part_geometry").otherwise("TEXT").alias("region_type"), (F.col("occ") % 5 != 0).alias("has_box"), F.when(F.col("occ") % 7 == 0, "seen").otherwise(" ").alias("raw_text"))
    refs = rows.select("doc", "occ", F.col("occ").alias("ref"))
    analyses = rows.select("doc").distinct().select("doc", F.when(F.col("doc") % 2 == 0, "EBOM").otherwise("FEATURE_TREE").alias("kind"), F.when(F.col("doc") % 4 == 0, "PARTS_LIST").otherwise("NONE").alias("authority"), (1 - F.col("doc") / 100.0).alias("score"))
    return rows, refs, evidence, analyses


def _issues(spark, sf):
    rows, refs, evidence, _ = _checked(spark, sf)
    dims = fixture(spark, sf, "fx_dims").where("target > 0").select((F.col("target") % 50).alias("doc"), F.col("dim").alias("occ"), F.col("target").alias("ref"))
    bare = d.missing_evidence(dims.select("doc", "occ"), dims, evidence, "doc", "occ")
    return d.issues(rows, refs, refs.where("occ % 8 <> 1"), evidence, "doc", "occ").unionByName(bare)


def q_drawing_issues(spark, sf):
    return _issues(spark, sf)


def q_drawing_review(spark, sf):
    """Kinds after the check of parts lists, and which analyses need a review."""
    rows, _, _, analyses = _checked(spark, sf)
    settled = d.settled_kinds(analyses, rows, "doc")
    return d.reviews(settled, _issues(spark, sf), "doc").join(settled.select("doc", "kind", "downgraded"), "doc")


def _versions(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", (F.col("n_chars") % 100 / 100.0).alias("score"), (F.col("doc_id") % 11 == 0).alias("flagged"))
    return d.versions(rows, "source", "doc_id", "score", "flagged")


def q_drawing_version(spark, sf):
    return _versions(spark, sf).select("doc_id", "version", "status")


def q_drawing_summary(spark, sf):
    return d.latest_versions(_versions(spark, sf).select("source", "doc_id", "version", "status"), "source")


def q_drawing_project(spark, sf):
    return d.project(d.resolve_chains(_parts(spark, sf), "occ", "parent", saved))


def q_bom_expand(spark, sf):
    return d.resolve_chains(_parts(spark, sf), "occ", "parent", saved).where("depth is not null").select("occ", "depth")


def q_drawing_components(spark, sf):
    """One analysis for each size of parts: occurrences in threes below the first one, or features where the size is a multiple of ten."""
    w = Window.partitionBy("p_size").orderBy("p_partkey")
    rows = table(spark, sf, "part").select(F.col("p_size").alias("doc"), "p_partkey", "p_name", "p_brand", "p_type", (F.row_number().over(w) - 1).alias("i"))
    broken = F.when(F.col("p_partkey") % 17 == 0, F.lit(-1)).when((F.col("i") > 0) & ~((F.col("i") == 1) & (F.col("doc") % 2 == 0)), F.floor((F.col("i") - 1) / 3))
    placed = saved(rows.withColumn("parent", broken), "parts")
    kinds = placed.groupBy("doc").agg(F.min("p_brand").alias("title")).withColumn("kind", F.when(F.col("doc") % 10 == 0, "FEATURE_TREE").otherwise("EBOM"))
    occurrences = placed.select("doc", F.col("i").alias("occ"), "parent", F.lit(False).alias("explicit_root"), F.col("p_brand").alias("definition"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 5 == 0, "steel").alias("material"))
    definitions = placed.groupBy("doc", F.col("p_brand").alias("definition")).agg(F.concat(F.lit("def "), F.first("p_brand")).alias("name"), F.min("p_type").alias("material"))
    features = placed.select("doc", F.col("i").alias("feature"), "parent", F.col("p_name").alias("name"))
    return d.components(kinds, occurrences, definitions, features, "doc", saved)


def q_dimension_owner(spark, sf):
    """Dimensions of parts, of brands (all their parts) and of features, which climb to a part; null where that leads nowhere. With the first name on the way."""
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    part = F.concat(F.lit("o"), "p_partkey")
    targets = parts.select(part.alias("ref"), part.alias("owner")).unionByName(parts.select(F.col("p_brand").alias("ref"), part.alias("owner")))
    features = parts.select(F.concat(F.lit("f"), "p_partkey").alias("ref"), F.when(F.col("p_partkey") % 4 == 0, part).otherwise(F.concat(F.lit("f"), F.floor(F.col("p_partkey") / 2))).alias("parent"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(" ").alias("name"))
    dims = fixture(spark, sf, "fx_dims").withColumn("branded", F.coalesce((F.col("kind") == "A") & (F.col("dim") % 70 == 1), F.lit(False)))
    # only those of brands need their part
    branded = dims.where("branded").join(parts, F.col("target") == F.col("p_partkey"), "left").select("dim", F.col("p_brand").alias("ref"))
    ref = F.when(F.col("kind") == "R", F.concat(F.lit("o"), "target")).when(F.col("kind") == "A", F.lit(None)).otherwise(F.concat(F.lit("f"), "target"))
    found, lost = d.owned(dims.where("not branded").select("dim", ref.alias("ref")).unionByName(branded), targets, features, "dim", "ref", saved)
    return found.unionByName(lost.withColumn("owner", F.lit(None).cast("string")))


def q_projection_sync(spark, sf):
    docs = table(spark, sf, "documents")
    stored = docs.where("doc_id % 4 <> 0").select("doc_id", (F.col("doc_id") % 3).alias("version"), (F.col("doc_id") % 7).alias("analysis_id"))
    return d.replace_rule(stored, docs.select("doc_id", (F.col("doc_id") % 2).alias("version"), (F.col("doc_id") % 5).alias("analysis_id")), "doc_id")


def q_bom_budget(spark, sf):
    components = _parts(spark, sf).select(F.col("occ").alias("id"))
    dims = fixture(spark, sf, "fx_dims").select(F.col("dim").alias("id"))
    left_out = components.limit(1).select(F.lit("omitted").alias("kind"), F.lit(d.omitted(components, dims, BOM_NODES)).cast("long").alias("id"))
    return d.fill_budget(components, dims, BOM_NODES).unionByName(left_out)


def q_bom_related(spark, sf):
    related = d.below(_parts(spark, sf), 2, saved)
    return fixture(spark, sf, "fx_dims").join(related, F.col("target") == F.col("occ"), "left_semi").select("dim", "target")


def q_bom_evidence(spark, sf):
    dims = fixture(spark, sf, "fx_dims").where("target is not null")
    refs = dims.select(F.col("target").alias("node"), F.col("dim").alias("ref"), (F.col("kind") == "R").alias("explicit"), F.when(F.col("nominal") % 2 == 0, "PART_GEOMETRY").otherwise("TEXT").alias("region_type"))
    return d.geometry_evidence(refs, "node", F.col("region_type") == "PART_GEOMETRY", _parts(spark, sf).where("parent is null").select(F.col("occ").alias("node")))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_STATE = "state as (select asset_key, arg_max(logical_path, seq) filter (where logical_path is not null) as logical_path, arg_max(file_name, seq) filter (where file_name is not null) as file_name, arg_max(is_valid, seq) filter (where is_valid is not null) as is_valid from fx_assets_log group by 1), live as (select * from state where coalesce(is_valid, true))"
_LIVE = "live as (select * from fx_assets where is_valid)"
_TREE = "dirs as (select distinct case when n = 1 then '/' else array_to_string(s[1:n], '/') end as id, n - 1 as depth from (select string_split(logical_path, '/') as s, unnest([1, 2, 3, 4]) as n from live))"
_NODES = "select id, 'LogicalPath' as label, case when id = '/' then '/' else regexp_extract(id, '([^/]*)$', 1) end as name, cast(depth as int) as depth from dirs union all select 'asset:' || asset_key, 'DataAsset', file_name, null from live"
_EDGES = "select case when depth = 1 then '/' else regexp_replace(id, '/[^/]*$', '') end as src, id as dst, 'CONTAINS' as type from dirs where id <> '/' union all select logical_path, 'asset:' || asset_key, 'HAS_DATA' from live"
_N = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9一-龥]', '', 'g')"
_KNOWN = f"known as (select distinct asset_key, {_N('keyword')} as norm from fx_keywords where {_N('keyword')} <> '')"
_ENT = f"ent as (select {_N('keyword')} as norm, trim(regexp_replace(arg_min(keyword, asset_key * 100 + pos), '\\s+', ' ', 'g')) as name from fx_keywords where {_N('keyword')} <> '' group by 1)"
_REL = f"""t as (select asset_key, pos, predicate, {_N('subject')} as s, {_N('object')} as o from fx_triples where predicate <> ''),
rel as (select asset_key, least(s, o) as a, greatest(s, o) as b, arg_max(predicate, pos) as relation, arg_max(s > o, pos) as reversed, 'DataAsset::' || asset_key as asset_ref from t where s <> '' and o <> '' and s <> o
 and exists (select 1 from known k where k.asset_key = t.asset_key and k.norm = s) and exists (select 1 from known k where k.asset_key = t.asset_key and k.norm = o) group by 1, 2, 3)"""
_CAND = """grp as (select norm as focus, asset_key from (select *, row_number() over (partition by norm order by asset_key desc) as nth from known) where nth <= 8),
cand as (select focus, g.asset_key, k.norm as candidate, case when r.asset_key is null then 'unknown' when r.relation <> 'rel3' then 'related' else 'unrelated' end as status
 from grp g join known k on k.asset_key = g.asset_key and k.norm <> focus left join rel r on r.asset_key = g.asset_key and r.a = least(focus, k.norm) and r.b = greatest(focus, k.norm))"""
_FOUND = f"found as (select id, label, case when id like '%9' then '' else name end as name from ({_NODES}) where id not like 'asset:%7'), links as (select src, dst from ({_EDGES}))"
_VERS = "vers as (select doc_id, source, row_number() over (partition by source order by doc_id) as version, case when doc_id % 11 = 0 or n_chars % 100 / 100.0 < 0.9 then 'NEEDS_REVIEW' else 'AUTO_ACCEPTED' end as status from documents)"
_ISSUES = """o as (select occ % 50 as doc, occ, occ % 370 as item, quantity - 3 as q from fx_parts), ev as (select occ, occ % 3 = 0 and occ % 5 <> 0 and occ % 7 <> 0 as shape from fx_parts where occ % 4 <> 0),
 iss as (select doc, occ, 'DUPLICATE_ITEM_NO' as code from (select *, min(occ) over (partition by doc, item) as f from o) where occ <> f union all select doc, occ, 'INVALID_QUANTITY' from o where q <= 0
 union all select doc, occ, 'MISSING_OCCURRENCE_EVIDENCE' from o where occ not in (select occ from ev where shape or occ % 8 <> 1) union all select doc, occ, 'MISSING_PART_GEOMETRY' from o where occ not in (select occ from ev where shape)
 union all select target % 50, dim, 'MISSING_EVIDENCE' from fx_dims where target > 0 and (target % 50, dim) not in (select target % 50, dim from fx_dims where target in (select occ from ev)))"""
_DOWN = "tree as (select occ, 0 as depth from fx_parts where parent is null union all select p.occ, t.depth + 1 from fx_parts p join tree t on p.parent = t.occ)"


def _recursive(sql: str, *names: str) -> str:
    return oracle(sql, *names).replace("with ", "with recursive ", 1)


ORACLE = {
    "q_graph_nodes": oracle(f"with {_STATE}, {_TREE} {_NODES}", "fx_assets_log"),
    "q_graph_edges": oracle(f"with {_STATE}, {_TREE} {_EDGES}", "fx_assets_log"),
    "q_mentions": oracle(f"with {_KNOWN} select * from known where norm <> 'de' or asset_key in (select doc_id from documents where lang = 'fr')", "fx_keywords"),
    "q_entities": oracle(f"with {_ENT} select * from ent", "fx_keywords"),
    "q_semantic_relations": oracle(f"with {_KNOWN}, {_REL} select * from rel", "fx_keywords", "fx_triples"),
    "q_relation_candidates": oracle(f"with {_KNOWN}, {_REL}, {_CAND} select * from cand", "fx_keywords", "fx_triples"),
    "q_relation_writeback": oracle(f"""with {_KNOWN}, {_REL}, {_CAND}, asked as (select distinct asset_key, least(focus, candidate) as a, greatest(focus, candidate) as b from cand where status = 'unknown')
 select asset_key, a, b, a[1] = b[1] as related, case when a[1] = b[1] then 'linked' else 'no relation' end as relation, 'query-udf' as source from asked""", "fx_keywords", "fx_triples"),
    "q_node_attributes": oracle("""with a as (select asset_key, file_name, logical_path, case when file_format <> 'zip' then data_type end as data_type from fx_assets where is_valid), k as (select asset_key, string_agg(w, '|' order by pos) as kw from (select asset_key, regexp_replace(keyword, '^\\s+|\\s+$', '', 'g') as w, min(pos) as pos from fx_keywords group by 1, 2) where w <> '' group by 1)
 select 'asset:' || a.asset_key as id, data_type, coalesce(kw, '') as keywords, a.asset_key as meta_key from a left join k on k.asset_key = a.asset_key where data_type is not null union all select logical_path, null, null, min(asset_key) + 2000000 from a group by 1""", "fx_assets", "fx_keywords"),
    "q_mention_words": oracle(f"""with {x_plans._ANSWERS}, w as (select a.asset_key, case when a.asset_key % 5 <> 3 and keywords <> '' then string_split(keywords, '|') else list_concat([file_format], case when data_type <> file_format then [data_type] else [] end, case when entities <> '' then [entities] else [] end) end as ws from ans a join fx_assets f on f.asset_key = a.asset_key)
 select asset_key, cast(unnest(range(0, len(ws))) as int) as pos, unnest(ws) as word from w""", "fx_assets"),
    "q_graph_query": oracle(f"""with {_LIVE}, {_KNOWN}, w as (select row_number() over (order by asset_key desc) as rank, asset_key, logical_path, file_format = 'json' as drawn from live where logical_path like '/docs/en/%' order by asset_key desc limit {NODES}),
 f as (select cast(rank as int) as rank, 'asset:' || w.asset_key as asset, logical_path as parent, norm, case when drawn then 'component:' || w.asset_key end as component from w left join known k on k.asset_key = w.asset_key and not drawn order by rank, norm nulls first limit {max(100, 4 * NODES)})
 select distinct 'HAS_DATA' as kind, rank, parent as src, asset as dst from f union all select distinct 'MENTIONS', rank, asset, norm from f where norm is not null union all select distinct 'DEPICTS', rank, asset, component from f where component is not null
 union all select distinct 'CONTAINS', 0, case when n = 2 then '/' else array_to_string(s[1:n - 1], '/') end, array_to_string(s[1:n], '/') from (select string_split(parent, '/') as s, unnest([2, 3, 4]) as n from f)""", "fx_assets", "fx_keywords"),
    "q_graph_search": oracle(f"""with {_LIVE}, {_KNOWN}, t as (select asset_key, keyword as text from fx_keywords union all select p_partkey, p_name || chr(10) || p_brand || chr(10) || p_type from part union all select target, kind || ' ' || nominal from fx_dims where target > 0 union all select asset_key, norm from known union all select asset_key, logical_path || '/' || file_name from live),
 h as (select distinct l.asset_key, contains(lower(text), '{WORD}') as one, contains(lower(text), 'a 3') as two, data_type from live l join t on t.asset_key = l.asset_key),
 f as (select logical_path as path, max(asset_key) as key from live group by 1)
 select 'asset' as kind, cast(asset_key as varchar) as id, 'two' as of from (select distinct asset_key from h where one and data_type in ('file', 'document') order by asset_key desc limit 120)
 union all select 'asset', cast(asset_key as varchar), 'all' from (select distinct asset_key from h where two order by asset_key desc limit 120) union all select 'directory', path, 'all' from (select path from f where contains(lower(path), 'a 3') order by key desc, path limit 120)
 union all select 'directory', path, 'all' from (select path from f where contains(lower(path), 'src1') order by key desc, path limit 120)""", "fx_assets", "fx_keywords", "fx_dims"),
    "q_graph_search_expanded": oracle(f"""with {_LIVE}, {_KNOWN}, {_ENT}, {_REL}, told as (select asset_key, norm, name from known join ent using (norm)),
 ft as (select distinct logical_path as path, norm, name from told join live using (asset_key) where data_type = 'relational'),
 q as (select * from (values ('narrow', '{WORD}', 'document', '/docs/en'), ('wide', 'src1', '', '')) as t("of", word, kind, below)),
 ah as (select "of", word, asset_key, logical_path as path, row_number() over (partition by "of" order by coalesce(case when asset_key % 3 = 0 then file_size end, asset_key) desc, asset_key desc) as rank from live, q
  where (starts_with(logical_path || '/' || file_name, below) or starts_with(logical_path, below)) and (kind = '' or data_type = kind) and (contains(lower(logical_path || '/' || file_name), word)
   or asset_key in (select asset_key from told where contains(lower(name), '{WORD}') or contains(norm, '{WORD}')) and word = '{WORD}' or asset_key in (select asset_key from told where contains(lower(name), 'src1') or contains(norm, 'src1')) and word = 'src1')),
 dh as (select 'wide' as "of", path, row_number() over (order by key desc, path) as rank from (select logical_path as path, max(asset_key) as key from live group by 1) where contains(lower(path), 'src1') or path in (select path from ft where contains(lower(name), 'src1') or contains(norm, 'src1'))),
 a as (select * from ah where rank <= {NODES}), d as (select * from dh where rank <= {NODES}), drawn as (select asset_key from live where file_format = 'json' and asset_key % 2 = 0),
 own as (select a.*, norm, name from a join told using (asset_key) where asset_key not in (select asset_key from drawn)), shown as (select * from own where contains(lower(name), word) or contains(norm, word)),
 ways as (select asset_key, a as norm, b as other from rel where relation <> 'rel3' union all select asset_key, b, a from rel where relation <> 'rel3'),
 related as (select s.*, other from shown s join ways using (asset_key, norm) where exists (select 1 from own o where o."of" = s."of" and o.asset_key = s.asset_key and o.norm = other)),
 steps as (select 'asset' as hit, "of", rank, path from a union all select 'directory', "of", rank, path from d), chain as (select hit, "of", rank, string_split(path, '/') as s, unnest([2, 3, 4]) as n from steps),
 e as (select 'asset' as hit, "of", rank, 0 as k, 'NODE' as kind, 'asset:' || asset_key as src, null as dst, true as matched from a union all select 'directory', "of", rank, 0, 'NODE', path, null, true from d
  union all select hit, "of", rank, 1, 'CONTAINS', case when n = 2 then '/' else array_to_string(s[1:n - 1], '/') end, array_to_string(s[1:n], '/'), false from chain
  union all select 'asset', "of", rank, 2, 'HAS_DATA', path, 'asset:' || asset_key, false from a union all select 'asset', "of", rank, 3, 'DEPICTS', 'asset:' || asset_key, 'component:' || asset_key, false from a where asset_key in (select asset_key from drawn)
  union all select 'asset', "of", rank, 4, 'MENTIONS', 'asset:' || asset_key, norm, false from shown union all select 'asset', "of", rank, 4, 'MENTIONS', 'asset:' || asset_key, other, false from related
  union all select 'directory', "of", rank, 4, 'MENTIONS', path, norm, false from d join ft using (path) union all select 'asset', "of", rank, 5, 'SEMANTIC_RELATION', least(norm, other), greatest(norm, other), false from related),
 once as (select hit, "of", k, kind, src, dst, matched, min(rank) as rank from e group by all)
 select hit, "of", cast(rank as int) as rank, kind, src, dst, matched from (select *, row_number() over (partition by hit, "of" order by rank, k, src, dst) as nth from once) where nth <= {max(100, 4 * NODES)}""", "fx_assets", "fx_keywords", "fx_triples"),
    "q_display_names": oracle(f"""with {_LIVE} select 'asset:' || asset_key as id, case when asset_key % 2 <> 0 or asset_key % 6 <> 0 then file_name when asset_key % 12 <> 0 then logical_path else file_format end as shown from live
 union all select logical_path, case when min(asset_key) % 2 = 0 then regexp_extract(logical_path, '([^/]*)$', 1) else 'a folder' end from live group by logical_path""", "fx_assets"),
    "q_matched_entities": oracle(f"with {_LIVE}, {_KNOWN}, {_ENT} select norm, name from ent where contains(lower(name), '{WORD}') and norm in (select norm from known where asset_key in (select asset_key from live where logical_path like '/docs/fr/%' and file_format <> 'json')) order by name, norm limit {MOST}", "fx_assets", "fx_keywords"),
    "q_graph_links": oracle(f"""with {_LIVE}, {_TREE}, {_KNOWN}, {_REL} select src, dst, type, '' as relation from ({_EDGES}) union all select 'asset:' || asset_key, norm, 'MENTIONS', '' from known union all select distinct a, b, 'SEMANTIC_RELATION', relation from rel""", "fx_assets", "fx_keywords", "fx_triples"),
    "q_graph_focus": oracle("select 'asset:' || asset_key as id, 'DataAsset' as label from fx_assets where is_valid and status <> 'SUCCESS' order by id limit 1", "fx_assets"),
    "q_graph_assemble": oracle(f"""with {_LIVE}, {_TREE}, {_FOUND}, e as (select * from found union all select id, 'Unknown', '(unknown)' from (select src as id from links union select dst from links) where id not in (select id from found)),
 cat as (select label, row_number() over (order by min(id), label) - 1 as category from e group by 1) select id, label, case when trim(name) <> '' then name when label = 'DataAsset' then 'Asset ' || id else id end as name, cast(category as int) as category,
 case label when 'LogicalPath' then 36 when 'DataAsset' then 42 else 24 end as size from e join cat using (label)""", "fx_assets"),
    "q_node_budget": oracle(f"""with {_LIVE}, {_TREE}, {_FOUND}, kept as (select id from found order by contains(name, 'src') desc, id limit 60)
 select '60:' || ((select count(*) from found) - 60) || ':true' as id, 'report' as kind union all select id, 'node' as kind from kept union all select src || '>' || dst, 'edge' from links where src in (select id from kept) and dst in (select id from kept)""", "fx_assets"),
    "q_graph_signature": oracle(f"with {_LIVE} select 'again' as state, true as same where exists (select 1 from live) union all select 'finished', not exists (select 1 from live where status <> 'SUCCESS' or status is null) where exists (select 1 from live)", "fx_assets"),
    "q_graph_delta": oracle("""with p as (select unnest([1, 2, 3, 4]) as n), ex as (select asset_key, logical_path, string_split(logical_path, '/') as s, n from fx_assets, p where is_valid),
 ed as (select asset_key, case when n = 2 then '/' else array_to_string(s[1:n - 1], '/') end as src, array_to_string(s[1:n], '/') as dst from ex where n > 1 union all select asset_key, logical_path, 'asset:' || asset_key from fx_assets where is_valid),
 o as (select distinct src, dst from ed where asset_key % 5 <> 0), w as (select distinct src, dst from ed where asset_key % 3 <> 0)
 select *, 'added' as change from (select * from w except select * from o) union all select *, 'removed' from (select * from o except select * from w)""", "fx_assets"),
    "q_entity_degree": oracle(f"""with {_KNOWN}, {_REL}, en as (select norm, count(*) as n from (select a as norm from rel union all select b from rel) group by 1) select k.norm, count(*) as n_assets, coalesce(max(n), 0) as n_relations from known k left join en on en.norm = k.norm group by 1""", "fx_keywords", "fx_triples"),
    "q_drawing_normalize": """select p_partkey, case p_partkey % 3 when 0 then 'ENGINEERING_DRAWING' when 1 then 'PHOTO' else 'UNKNOWN' end as document_class, p_partkey % 3 = 0 as engineering, least(1.0, p_size / 40)::double as confidence, 'STEEL' as domain, 'UNKNOWN' as drawing_type, 'x|y' as signals,
 case when p_partkey % 3 <> 0 then 'NONE' when p_partkey % 4 = 0 then 'EBOM' when p_partkey % 4 = 1 then 'NONE' else 'FEATURE_TREE' end as kind, 'NONE' as authority, 'r' as roots, trim(p_name) as summary, least(1.0, p_size / 40)::double as score, case when p_partkey % 3 = 0 then 2 else 0 end as n_features,
 case when p_partkey % 3 = 0 then least(3000, p_size * 100) else 0 end as n_dimensions, case when p_partkey % 3 = 0 then 2 else 0 end as n_notes, 0 as n_evidence from part""",
    # one item after the other of every brand, each with the ids that are taken
    "q_drawing_ids": """with recursive n as (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) as nth, case when p_partkey % 3 = 0 then 'occ-' || row_number() over (partition by p_brand order by p_partkey) when p_partkey % 7 = 1 then 'p' || (p_size % 5) || '-2' else 'p' || (p_size % 5) end as base from part),
 t as (select p_brand, 0::bigint as nth, 0::bigint as p_partkey, ''::varchar as id, []::varchar[] as used from n group by 1 union all
  select p_brand, nth, p_partkey, id, list_append(used, id) from (select n.p_brand, n.nth, n.p_partkey, t.used, case when not list_contains(t.used, base) then base else base || '-' || list_min(list_filter(range(2, len(t.used) + 3), lambda k: not list_contains(t.used, base || '-' || k))) end as id from t join n on n.p_brand = t.p_brand and n.nth = t.nth + 1))
 select p_partkey, id from t where nth > 0""",
    "q_evidence_bbox": """with b as (select vec_id, least(1.0, greatest(0.0, cast(embedding[1] as double) * 4)) as a, least(1.0, greatest(0.0, cast(embedding[2] as double) * 4)) as b, least(1.0, greatest(0.0, cast(embedding[3] as double) * 4)) as c, least(1.0, greatest(0.0, cast(embedding[4] as double) * 4)) as d from embeddings),
 k as (select vec_id, case when c > a and d > b then a end as a, case when c > a and d > b then b end as b, case when c > a and d > b then c end as c, case when c > a and d > b then d end as d from b)
 select vec_id, floor((0.586667::double + a * (1.0::double - 0.586667::double)) * 1000000 + 0.5) / 1000000 as x0, floor((0.0::double + b * 0.58::double) * 1000000 + 0.5) / 1000000 as y0, floor((0.586667::double + c * (1.0::double - 0.586667::double)) * 1000000 + 0.5) / 1000000 as x1, floor((0.0::double + d * 0.58::double) * 1000000 + 0.5) / 1000000 as y1 from k""",
    "q_tile_bounds": """with s as (select doc_id, n_chars as w, doc_id * 37 % 3000 as h from documents), t as (select doc_id, case when w >= h then 3 else 2 end as nc, case when w >= h then 2 else 3 end as nr, unnest([0, 1, 2, 3, 4, 5]) as tile from s where w > 1600 or h > 1600),
 u as (select *, tile % nc as c, tile // nc as r from t) select doc_id, tile, floor(greatest(0.0::double, c::double / nc - case when c > 0 then 0.08 else 0.0 end::double) * 1000000 + 0.5) / 1000000 as x0, floor(greatest(0.0::double, r::double / nr - case when r > 0 then 0.08 else 0.0 end::double) * 1000000 + 0.5) / 1000000 as y0,
 floor(least(1.0::double, (c + 1)::double / nc + case when c < nc - 1 then 0.08 else 0.0 end::double) * 1000000 + 0.5) / 1000000 as x1, floor(least(1.0::double, (r + 1)::double / nr + case when r < nr - 1 then 0.08 else 0.0 end::double) * 1000000 + 0.5) / 1000000 as y1 from u""",
    "q_drawing_issues": oracle(f"with {_ISSUES} select * from iss", "fx_parts", "fx_dims"),
    "q_drawing_review": oracle(f"""with {_ISSUES}, n as (select doc, count(*) as n, max(case when code in ('DUPLICATE_ITEM_NO', 'INVALID_QUANTITY', 'MISSING_OCCURRENCE_EVIDENCE') then 2 else 1 end) as w from iss group by 1), a as (select distinct doc, doc % 4 = 2 as downgraded from o)
 select a.doc, coalesce(n, 0) + downgraded::int as n_issues, case when downgraded then 'ERROR' when w = 2 then 'WARNING' when w = 1 then 'INFO' else '' end as worst, coalesce(n, 0) > 0 or downgraded or 1 - a.doc / 100.0 < 0.9 as requires_review,
 case when downgraded then 'INFERRED_ASSEMBLY' when a.doc % 2 = 0 then 'EBOM' else 'FEATURE_TREE' end as kind, downgraded from a left join n on n.doc = a.doc""", "fx_parts", "fx_dims"),
    "q_drawing_version": f"with {_VERS} select doc_id, version, status from vers",
    "q_drawing_summary": f"with {_VERS} select source, arg_max(doc_id, version) as doc_id, max(version) as version, arg_max(status, version) as status from vers group by 1",
    "q_drawing_project": _recursive(f"""with {_DOWN}, p as (select f.occ, case when t.occ is not null then f.parent end as attached_to, coalesce(t.depth, 0) as depth, t.occ is not null as valid from fx_parts f left join tree t on t.occ = f.occ)
 select p.occ, attached_to, cast(depth as int) as depth, valid, coalesce(n, 0) as n_children from p left join (select attached_to as occ, count(*) as n from p where attached_to is not null group by 1) c on c.occ = p.occ""", "fx_parts"),
    "q_bom_expand": _recursive(f"with {_DOWN} select occ, cast(depth as int) as depth from tree", "fx_parts"),
    "q_drawing_components": """with recursive r as (select p_size as doc, p_partkey, p_name, p_brand, p_type, row_number() over (partition by p_size order by p_partkey) - 1 as i from part),
 p as (select *, case when p_partkey % 17 = 0 then -1 when i > 0 and not (i = 1 and doc % 2 = 0) then (i - 1) // 3 end as parent from r), t as (select doc, i from p where parent is null union all select p.doc, p.i from p join t on p.doc = t.doc and p.parent = t.i),
 tops as (select doc, count(*) as n, min(i) as top from p where parent is null and doc % 10 <> 0 group by 1 having count(*) = 1), root as (select d.doc, brand, case when exists (select 1 from p where p.doc = d.doc and p.parent = tops.top) then 'occ:' || tops.top else 'root' end as root from (select doc, min(p_brand) as brand from p group by 1) d left join tops on tops.doc = d.doc),
 c as (select p.doc, case when p.doc % 10 = 0 then 'feature:' else 'occ:' end || p.i as id, case when p.doc % 10 = 0 then p_name when p_partkey % 3 = 0 then p_name else 'def ' || p_brand end as name, case when p.doc % 10 = 0 then null when p_partkey % 5 = 0 then 'steel' else (select min(p_type) from p q where q.doc = p.doc and q.p_brand = p.p_brand) end as material,
  parent, t.i is not null as ok, root from p join root on root.doc = p.doc left join t on t.doc = p.doc and t.i = p.i),
 x as (select doc, id, case when id = root then 'ROOT' when doc % 10 = 0 then 'FEATURE' else 'ITEM' end as role, name, material, case when id = root then null when ok and parent is not null then case when doc % 10 = 0 then 'feature:' else 'occ:' end || parent else root end as attached_to, parent is not null and not ok as hierarchy_issue from c
  union all select doc, 'root', 'ROOT', brand, null, null, false from root where root = 'root')
 select x.*, (select count(*) from x y where y.doc = x.doc and y.attached_to = x.id) as n_children from x""",
    "q_dimension_owner": _recursive("""with f as (select 'f' || p_partkey as ref, case when p_partkey % 4 = 0 then 'o' || p_partkey else 'f' || (p_partkey // 2) end as up, case when p_partkey % 3 = 0 then p_name end as name from part),
 climb as (select ref, up, name from f union select c.ref, f.up, coalesce(c.name, f.name) from climb c join f on f.ref = c.up), ends as (select * from climb where up not in (select ref from f)),
 a as (select dim, case kind when 'R' then 'o' || target when 'A' then case when dim % 70 = 1 then p_brand end else 'f' || target end as ref from fx_dims left join part on p_partkey = target),
 targets as (select 'o' || p_partkey as ref, 'o' || p_partkey as owner from part union all select p_brand, 'o' || p_partkey from part)
 select distinct dim, t.owner, e.name as feature from a left join ends e on e.ref = a.ref left join targets t on t.ref = coalesce(e.up, a.ref)""", "fx_dims"),
    "q_projection_sync": "select doc_id, case when doc_id % 4 = 0 then true else not (doc_id % 3 > doc_id % 2 or (doc_id % 3 = doc_id % 2 and doc_id % 7 = doc_id % 5)) end as replace from documents",
    "q_bom_budget": oracle(f"with co as (select occ as id from fx_parts) select 'component' as kind, id from co union all select 'dimension', id from (select dim as id from fx_dims order by dim limit (select greatest(0, {BOM_NODES} - count(*)) from co)) union all select 'omitted', greatest(0, (select count(*) from fx_dims) - (select greatest(0, {BOM_NODES} - count(*)) from co))", "fx_parts", "fx_dims"),
    "q_bom_related": _recursive("with b as (select cast(2 as bigint) as occ union select p.occ from fx_parts p join b on p.parent = b.occ) select dim, target from fx_dims where target in (select occ from b)", "fx_parts", "fx_dims"),
    "q_bom_evidence": oracle("""with e as (select *, bool_or(kind = 'R') over (partition by target) as has from fx_dims where target is not null) select target as node, dim as ref from e where (kind = 'R' or not has) and nominal % 2 = 0 and target not in (select occ from fx_parts where parent is null)""", "fx_dims", "fx_parts"),
}
