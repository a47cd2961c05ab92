"""Bills of materials: normalising and checking analyses, parent chains, and their projection to a component graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetgraph.functions.text import confidence, dedup_strings
from assetgraph.operators.ordered import ordinals
from assetgraph.operators.suffixes import suffixed
from assetgraph.scratch import saved

HOPS = 6  # doublings: chains of up to 2^6 hops
MOST_ANCESTORS = 62
OWNERS, DIMENSIONS = 4096, 4096  # of one class that are joined in one place
PAIRS, TASKS = 50_000_000, 20_000  # that one task makes; tasks at most
KINDS = ("EBOM", "INFERRED_ASSEMBLY", "FEATURE_TREE", "ILLUSTRATED_STRUCTURE", "NONE")
ENGINEERING = ("ENGINEERING_DRAWING", "TECHNICAL_ILLUSTRATION")
OVERLAP, TILE_SIDE, MAX_TILES = 0.08, 1600, 6
REVIEW_BELOW = 0.9
#: The lists of an analysis and how many entries count.
LISTS = {"partDefinitions": 1000, "occurrences": 2000, "features": 1000, "dimensions": 3000, "textBlocks": 5000, "notes": 500, "views": 200, "evidence": 8000}
PLAIN = ("notes", "views")  # others hold objects alone
SHAPE = (
    "classification struct<documentClass:string,confidence:string,isEngineeringDrawing:boolean,domain:string,drawingType:string,signals:array<string>>, "
    "structure struct<kind:string,authority:string,rootOccurrenceIds:array<string>>, documentInfo struct<title:string>, summaryText string, mainObjectName string, validation struct<score:string,issues:array<string>>"
)
LIST_SHAPE = ", ".join(f"{name} array<string>" for name in LISTS)
SEVERITY = {"EBOM_WITHOUT_PARTS_LIST": "ERROR", "DUPLICATE_ITEM_NO": "WARNING", "INVALID_QUANTITY": "WARNING", "MISSING_OCCURRENCE_EVIDENCE": "WARNING", "MISSING_PART_GEOMETRY": "INFO", "MISSING_EVIDENCE": "INFO"}


def normalize_analysis(raw: DataFrame, key: str, body: str) -> DataFrame:
    """One row for each analysis: enums in upper case, unknown kinds NONE, lists cut to what counts (entries as JSON texts) and empty for what is no drawing.

    Entries are by far the most of a text; they are read of drawings alone.
    """
    j = raw.select(key, F.col(body).alias("_body"), F.from_json(body, SHAPE).alias("j"))
    upper = lambda c, default: F.coalesce(F.nullif(F.upper(F.trim(c)), F.lit("")), F.lit(default))
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    none = F.array().cast("array<string>")
    cls, sure = upper(F.col("j.classification.documentClass"), "UNKNOWN"), F.col("j.classification.confidence")
    engineering = F.coalesce("j.classification.isEngineeringDrawing", F.lit(False)) | cls.isin(*ENGINEERING)
    kind = upper(F.col("j.structure.kind"), "NONE")
    lists = []
    for name, most in LISTS.items():
        entries = F.coalesce(f"_lists.{name}", none)
        entries = entries if name in PLAIN else F.filter(entries, lambda x: F.startswith(F.ltrim(x), F.lit("{")))
        lists.append(F.slice(entries, 1, most).alias(name))
    return j.withColumn("_lists", F.when(engineering, F.from_json("_body", LIST_SHAPE))).select(
        key, cls.alias("document_class"), engineering.alias("engineering"), confidence(sure).alias("confidence"), upper(F.col("j.classification.domain"), "UNKNOWN").alias("domain"),
        upper(F.col("j.classification.drawingType"), "UNKNOWN").alias("drawing_type"), dedup_strings(F.coalesce("j.classification.signals", none), 32).alias("signals"),
        F.when(engineering & kind.isin(*KINDS), kind).otherwise("NONE").alias("kind"), upper(F.col("j.structure.authority"), "NONE").alias("authority"),
        dedup_strings(F.coalesce("j.structure.rootOccurrenceIds", none), 100).alias("roots"), text(F.col("j.documentInfo.title")).alias("title"), text(F.col("j.mainObjectName")).alias("main_object"), F.substring(text(F.col("j.summaryText")), 1, 500).alias("summary"),
        confidence(F.coalesce("j.validation.score", sure)).alias("score"), *lists,
    )


def summaries(analyses: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """One row for each normalised analysis: what it is, the object's name (the title before the main object) and the numbers of parts, dimensions, texts and issues (rows of key)."""
    counted = issues.groupBy(key).agg(F.count("*").alias("issue_count"))
    name = F.coalesce(F.nullif("title", F.lit("")), "main_object")
    sizes = [F.size(c).alias(n) for c, n in (("occurrences", "part_count"), ("dimensions", "dimension_count"), ("textBlocks", "text_count"))]
    own = analyses.select(key, "document_class", "domain", "drawing_type", "kind", "authority", name.alias("object_name"), "summary", "score", *sizes)
    return own.join(counted, key, "left").fillna(0, ["issue_count"])


def stable_ids(items: DataFrame, group: str, order: str, given: str, prefix: str, save: Callable[[DataFrame], DataFrame] = saved) -> DataFrame:
    """items with `id`: the given one, or prefix and place where it is missing; an id that an earlier item of the group has gets -2, -3 and so on.

    A suffixed id that an earlier item has as its own moves on to the next one that is free.
    """
    placed = ordinals(items.withColumn("_grp", F.col(group)), "_grp", order, "_at").drop("_grp")
    named = placed.withColumn("_id", F.coalesce(F.nullif(F.trim(given), F.lit("")), F.concat(F.lit(prefix + "-"), F.col("_at") + 1)))
    return suffixed(named, group, order, "_id", "-", "id", save).drop("_at", "_id")


def six(c: Column) -> Column:
    return F.floor(c * 1000000 + 0.5) / 1000000


def clamp_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The box within the unit square, or null if nothing of it is left."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    a, b, c, d = unit(x0), unit(y0), unit(x1), unit(y1)
    return F.when((c > a) & (d > b), F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")))


def to_original(box: Column, tile: Column) -> Column:
    """A box within a tile, in the coordinates of the whole sheet, six decimals."""
    w, h = tile["x1"] - tile["x0"], tile["y1"] - tile["y0"]
    return F.when(
        box.isNotNull(),
        F.struct(six(tile["x0"] + box["x0"] * w).alias("x0"), six(tile["y0"] + box["y0"] * h).alias("y0"), six(tile["x0"] + box["x1"] * w).alias("x1"), six(tile["y0"] + box["y1"] * h).alias("y1")),
    )


def tile_bounds(sheets: DataFrame, key: str, width: str, height: str, side: int = TILE_SIDE, most: int = MAX_TILES) -> DataFrame:
    """(key, tile, bounds): a grid of 3 by 2, or 2 by 3 for tall sheets, with an overlap inside; sheets that fit into a tile have none."""
    wide = F.col(width) >= F.col(height)
    cols, rows = F.when(wide, 3).otherwise(2), F.when(wide, 2).otherwise(3)
    large = sheets.where((F.col(width) > side) | (F.col(height) > side))
    tiles = large.select(key, cols.alias("_c"), rows.alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("tile")).where(F.col("tile") < most)
    c, r = F.col("tile") % F.col("_c"), F.floor(F.col("tile") / F.col("_c"))
    low = lambda i, n: six(F.greatest(F.lit(0.0), i / n - F.when(i > 0, OVERLAP).otherwise(0.0)))
    high = lambda i, n: six(F.least(F.lit(1.0), (i + 1) / n + F.when(i < n - 1, OVERLAP).otherwise(0.0)))
    return tiles.select(key, "tile", F.struct(low(c, F.col("_c")).alias("x0"), low(r, F.col("_r")).alias("y0"), high(c, F.col("_c")).alias("x1"), high(r, F.col("_r")).alias("y1")).alias("bounds"))


def valid_refs(refs: DataFrame, evidence: DataFrame, doc: str, item: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(doc, item, ref): references to evidence (doc, ev, region_type, has_box, raw_text) that there is, each once; with allowed types only
    regions of these that have a box and no text."""
    good = evidence.select(F.col(doc).alias("_d"), F.col("ev").alias("_e"), F.upper(F.trim(F.coalesce("region_type", F.lit("UNKNOWN")))).alias("_t"), "has_box", F.trim(F.coalesce("raw_text", F.lit(""))).alias("_x"))
    if allowed:
        good = good.where(F.col("_t").isin(*allowed) & F.col("has_box") & (F.col("_x") == ""))
    return refs.join(good, (F.col(doc) == F.col("_d")) & (F.col("ref") == F.col("_e")), "left_semi").select(doc, item, "ref").distinct()


def settled_kinds(analyses: DataFrame, occurrences: DataFrame, doc: str) -> DataFrame:
    """analyses (doc, kind, authority) with kind and `downgraded`: a parts structure without a parts list or without occurrences is an inferred one, or none."""
    some = occurrences.select(F.col(doc).alias("_d")).distinct().withColumn("_some", F.lit(True))
    joined = analyses.join(some, F.col(doc) == F.col("_d"), "left").withColumn("_some", F.coalesce("_some", F.lit(False)))
    down = (F.col("kind") == "EBOM") & ((F.col("authority") != "PARTS_LIST") | ~F.col("_some"))
    kind = F.when(down, F.when(F.col("_some"), "INFERRED_ASSEMBLY").otherwise("NONE")).otherwise(F.col("kind"))
    return joined.withColumn("downgraded", down).withColumn("kind", kind).drop("_d", "_some")


def issues(occurrences: DataFrame, shapes: DataFrame, others: DataFrame, evidence: DataFrame, doc: str, occ: str) -> DataFrame:
    """(doc, occ, code): repeated item numbers (all but the first), quantities that are not positive, missing evidence and geometry.

    shapes, others: references (doc, occ, ref) to geometry, and to text or anything.
    """
    first = occurrences.where("item_no <> ''").groupBy(doc, "item_no").agg(F.min(occ).alias("_first"))
    repeated = occurrences.join(first, [doc, "item_no"]).where(F.col(occ) != F.col("_first")).select(doc, occ, F.lit("DUPLICATE_ITEM_NO").alias("code"))
    quantity = occurrences.where("quantity <= 0").select(doc, occ, F.lit("INVALID_QUANTITY").alias("code"))
    shape = valid_refs(shapes, evidence, doc, occ, ("PART_GEOMETRY",)).select(doc, occ).distinct()
    some = valid_refs(others, evidence, doc, occ).select(doc, occ).union(shape).distinct()
    bare = occurrences.join(some, [doc, occ], "left_anti").select(doc, occ, F.lit("MISSING_OCCURRENCE_EVIDENCE").alias("code"))
    unseen = occurrences.join(shape, [doc, occ], "left_anti").select(doc, occ, F.lit("MISSING_PART_GEOMETRY").alias("code"))
    return repeated.unionByName(quantity).unionByName(bare).unionByName(unseen)


def missing_evidence(items: DataFrame, refs: DataFrame, evidence: DataFrame, doc: str, item: str) -> DataFrame:
    """(doc, item, code) of features or dimensions without a valid reference."""
    return items.join(valid_refs(refs, evidence, doc, item).select(doc, item).distinct(), [doc, item], "left_anti").select(doc, item, F.lit("MISSING_EVIDENCE").alias("code"))


def reviews(analyses: DataFrame, found: DataFrame, doc: str) -> DataFrame:
    """(doc, n_issues, worst, requires_review) of analyses (doc, score, downgraded) with the issues (doc, code) found in them."""
    rank = F.lit(0)
    for code, severity in SEVERITY.items():
        rank = F.when(F.col("code") == code, {"INFO": 1, "WARNING": 2, "ERROR": 3}[severity]).otherwise(rank)
    counts = found.groupBy(doc).agg(F.count("*").alias("_n"), F.max(rank).alias("_w"))
    joined = analyses.join(counts, doc, "left")
    n = F.coalesce("_n", F.lit(0)) + F.col("downgraded").cast("long")
    worst = F.greatest(F.coalesce("_w", F.lit(0)), F.when(F.col("downgraded"), 3).otherwise(0))
    return joined.select(doc, n.alias("n_issues"), F.element_at(F.array(*map(F.lit, ("", "INFO", "WARNING", "ERROR"))), worst + 1).alias("worst"), ((n > 0) | (F.col("score") < REVIEW_BELOW)).alias("requires_review"))


def versions(analyses: DataFrame, source: str, order: str, score: str, flagged: str) -> DataFrame:
    """analyses with version (from 1) and status."""
    out = ordinals(analyses, source, order, "version").withColumn("version", F.col("version") + 1)
    return out.withColumn("status", F.when(F.coalesce(flagged, F.lit(False)) | (F.coalesce(score, F.lit(0.0)) < REVIEW_BELOW), "NEEDS_REVIEW").otherwise("AUTO_ACCEPTED"))


def latest_versions(versioned: DataFrame, source: str) -> DataFrame:
    return versioned.groupBy(source).agg(F.max_by(F.struct(*(c for c in versioned.columns if c != source)), "version").alias("_x")).select(source, "_x.*")


def resolve_chains(parts: DataFrame, occ: str, parent: str, save: Callable[[DataFrame], DataFrame] = lambda df: df, hops: int = HOPS) -> DataFrame:
    """(occ, parent, depth): the number of ancestors, null where the chain ends at nothing, in a cycle or after too many hops.

    Pointer doubling: after k rounds a row points 2^k ancestors up, so 6 joins settle chains of 64 hops. Rows whose chain has
    ended are not joined again. More than MOST_ANCESTORS are too many.
    """
    rows = parts.select(F.col(occ).alias("occ"), F.col(parent).alias("parent"), F.col(parent).alias("_to"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("_n"), F.lit(False).alias("_lost"))
    for _ in range(hops):
        ahead = rows.select(F.col("occ").alias("_at"), F.col("_to").alias("_next"), F.col("_n").alias("_m"), F.col("_lost").alias("_gone"))
        joined = rows.where("_to is not null and not _lost").join(ahead, F.col("_to") == F.col("_at"), "left")
        lost = F.col("_at").isNull() | F.coalesce("_gone", F.lit(False))
        moved = joined.select("occ", "parent", F.col("_next").alias("_to"), (F.col("_n") + F.coalesce("_m", F.lit(0))).alias("_n"), lost.alias("_lost"))
        rows = save(rows.where("_to is null or _lost").unionByName(moved))
    return rows.select("occ", "parent", F.when(F.col("_to").isNull() & ~F.col("_lost") & (F.col("_n") <= MOST_ANCESTORS), F.col("_n")).alias("depth"))


def project(chains: DataFrame) -> DataFrame:
    """(occ, attached_to, depth, valid, n_children): parts whose chain is broken hang on the root (null)."""
    placed = chains.select("occ", F.when(F.col("depth").isNotNull(), F.col("parent")).alias("attached_to"), F.coalesce("depth", F.lit(0)).alias("depth"), F.col("depth").isNotNull().alias("valid"))
    children = placed.where("attached_to is not null").groupBy(F.col("attached_to").alias("occ")).agg(F.count("*").alias("_n"))
    return placed.join(children, "occ", "left").withColumn("n_children", F.coalesce("_n", F.lit(0))).drop("_n")


def components(kinds: DataFrame, occurrences: DataFrame, definitions: DataFrame, features: DataFrame, doc: str, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc, id, role, name, material, attached_to, hierarchy_issue, n_children): the component graph of every analysis.

    kinds: doc, kind, title. occurrences: doc, occ, parent, explicit_root, definition, name, material. definitions: doc, definition, name, material.
    features: doc, feature, parent, name. The only occurrence without a parent is the root if others hang on it, else a synthetic one is.
    What an occurrence says comes before its definition. A feature tree shows its features in place of occurrences. Parents that are
    missing, in or below a cycle or too far from the top are replaced by the root, and marked.
    """
    sep = "\u0001"
    node = lambda prefix, c: F.concat(F.lit(prefix), c)
    tree = kinds.where("kind = 'FEATURE_TREE'").select(doc)
    flat = kinds.where("kind in ('FEATURE_TREE', 'NONE')").select(doc)
    own = occurrences.join(flat, doc, "left_anti").join(definitions.select(doc, "definition", F.col("name").alias("_dn"), F.col("material").alias("_dm")), [doc, "definition"], "left")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    parts = own.select(
        doc, node("occ:", F.col("occ")).alias("id"), F.lit("ITEM").alias("role"), F.coalesce(blank("name"), blank("_dn"), F.col("occ").cast("string")).alias("name"), F.coalesce(blank("material"), blank("_dm")).alias("material"),
        F.when(~F.coalesce("explicit_root", F.lit(False)), node("occ:", F.col("parent"))).alias("parent"),
    )
    shapes = features.join(tree, doc, "left_semi").select(doc, node("feature:", F.col("feature")).alias("id"), F.lit("FEATURE").alias("role"), F.coalesce(blank("name"), F.col("feature").cast("string")).alias("name"), F.lit(None).cast("string").alias("material"), node("feature:", F.col("parent")).alias("parent"))
    every = save(parts.unionByName(shapes))
    whole = lambda c: F.concat_ws(sep, doc, c)
    chains = resolve_chains(every.select(whole("id").alias("k"), F.when(F.col("parent").isNotNull(), whole("parent")).alias("p")), "k", "p", save).select(F.col("occ").alias("_k"), F.col("depth").isNotNull().alias("_ok"))
    tops = every.where("role = 'ITEM' and parent is null").groupBy(doc).agg(F.count("*").alias("_n"), F.min("id").alias("_top")).where("_n = 1")
    used = every.where("role = 'ITEM' and parent is not null").select(F.col(doc).alias("_d"), F.col("parent").alias("_p")).distinct()
    top = tops.join(used, (F.col(doc) == F.col("_d")) & (F.col("_top") == F.col("_p")), "left_semi").select(doc, "_top")
    roots = save(kinds.select(doc, "title").join(top, doc, "left").select(doc, "title", F.coalesce("_top", F.lit("root")).alias("_root")))
    placed = every.join(roots.select(doc, "_root"), doc).join(chains, whole("id") == F.col("_k"))
    attached = F.when(F.col("id") == F.col("_root"), F.lit(None)).when(F.col("_ok") & F.col("parent").isNotNull(), F.col("parent")).otherwise(F.col("_root"))
    rows = placed.select(doc, "id", F.when(F.col("id") == F.col("_root"), "ROOT").otherwise(F.col("role")).alias("role"), "name", "material", attached.alias("attached_to"), (F.col("parent").isNotNull() & ~F.col("_ok")).alias("hierarchy_issue"))
    made = roots.where("_root = 'root'").select(doc, F.lit("root").alias("id"), F.lit("ROOT").alias("role"), F.coalesce(blank("title"), F.lit("drawing")).alias("name"), F.lit(None).cast("string").alias("material"), F.lit(None).cast("string").alias("attached_to"), F.lit(False).alias("hierarchy_issue"))
    rows = save(rows.unionByName(made))
    children = rows.where("attached_to is not null").groupBy(F.col(doc).alias("_d"), F.col("attached_to").alias("_a")).agg(F.count("*").alias("_n"))
    return rows.join(children, (F.col(doc) == F.col("_d")) & (F.col("id") == F.col("_a")), "left").withColumn("n_children", F.coalesce("_n", F.lit(0))).drop("_d", "_a", "_n")


def owned(dimensions: DataFrame, targets: DataFrame, features: DataFrame, dim: str, ref: str, save: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(dim, owner, feature) of the dimensions whose reference leads to a target, and (dim, feature) of the others. feature: the first name on the way up, null if there is none.

    targets: ref, owner (an occurrence by its own id; a definition with a row for each of its occurrences; a feature that is a component). features:
    ref, parent, name, for all features; dimensions of those that are no targets go to the first target on the way up, however long it is. Pointer doubling: a round doubles
    how far a feature looks, and those that have come to the end of the way are not joined again. As every way that ends has features at each distance from its end, each
    round brings some of them there; when one brings none, what is left leads into cycles and to no target.
    """
    taken = targets.select(F.col("ref").alias("_t")).distinct()
    name = F.nullif(F.trim("name"), F.lit("")) if "name" in features.columns else F.lit(None).cast("string")
    all_ = features.select("ref", F.col("parent").alias("_to"), name.alias("_name"))
    free = all_.join(taken, F.col("ref") == F.col("_t"), "left_anti")
    rows = save(free.join(free.select(F.col("ref").alias("_r")), F.col("_to") == F.col("_r"), "left").select("ref", "_to", "_name", F.col("_r").isNotNull().alias("_open")))
    left, before = rows.where("_open").count(), None
    while left and left != before:
        ahead = rows.select(F.col("ref").alias("_r"), F.col("_to").alias("_next"), F.col("_name").alias("_after"), F.col("_open").alias("_more"))
        moved = rows.where("_open").join(ahead, F.col("_to") == F.col("_r")).select("ref", F.col("_next").alias("_to"), F.coalesce("_name", "_after").alias("_name"), F.col("_more").alias("_open"))
        rows = save(rows.where("not _open").unionByName(moved))
        left, before = rows.where("_open").count(), left
    ends = rows.select(F.col("ref").alias("_f"), F.when(~F.col("_open"), F.col("_to")).alias("_end"), "_name")
    # owners with the same shared references (of several owners) are a class, and each owner is in one at most: dimensions meet whole classes, and pairs are distinct as they come
    pairs = targets.where("ref is not null").select(F.col("ref").alias("_t"), "owner").distinct()
    counted = pairs.join(pairs.groupBy("_t").agg(F.count("*").alias("_c")), "_t")
    held = lambda which: F.sort_array(F.collect_set(F.when(which, F.col("_t"))))
    holds = save(counted.groupBy("owner").agg(held(F.col("_c") > 1).alias("_shared"), held(F.col("_c") == 1).alias("_alone")))
    classes = save(holds.where(F.size("_shared") > 0).groupBy("_shared").agg(F.count("*").alias("_n")).withColumn("_class", F.monotonically_increasing_id()))
    classed = holds.join(classes, "_shared", "left")
    whole = classes.select(F.explode("_shared").alias("_t"), "_class", F.lit(None).cast(holds.schema["owner"].dataType).alias("owner"), F.lit(True).alias("_whole"))
    known = whole.unionByName(classed.select(F.explode("_alone").alias("_t"), "_class", "owner", F.lit(False).alias("_whole")))
    known = known.join(all_.select(F.col("ref").alias("_l"), F.col("_name").alias("_own")), F.col("_t") == F.col("_l"), "left")
    # where every reference leads: a class, the only owner, or neither (_whole is null)
    leads = known.select(F.col("_t").alias("_r"), F.col("_own").alias("feature"), "_class", "owner", "_whole")
    leads = leads.unionByName(ends.join(known, F.col("_end") == F.col("_t"), "left").select(F.col("_f").alias("_r"), F.coalesce("_name", "_own").alias("feature"), "_class", "owner", "_whole"))
    asked = dimensions.select(dim, F.col(ref).alias("_ref")).join(leads, F.col("_ref") == F.col("_r"), "left").select(dim, "feature", "_class", "owner", "_whole")
    group = [dim, "feature", "_class"]
    # an owner by itself goes where its whole class is there
    asked = asked.repartition(*group).distinct().withColumn("_met", F.coalesce(F.max("_whole").over(Window.partitionBy(*group)), F.lit(False)))
    asked = save(asked.where("_whole is null or _whole or not _met").drop("_met"))
    # a class and its dimensions meet in cells of bounded size; tasks go by the pairs that come out, not by the bytes that go in
    met = asked.where("_whole").groupBy("_class").agg(F.count("*").alias("_d")).join(classes, "_class")
    cells = save(met.select("_class", "_d", "_n", F.ceil(F.col("_n") / OWNERS).alias("_slices"), F.ceil(F.col("_d") / DIMENSIONS).alias("_portions")))
    tasks = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(cells.agg(F.sum(F.col("_d").cast("double") * F.col("_n"))).first()[0] or 0) // PAIRS))
    cell = ["_class", "_slice", "_portion"]
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    led = asked.where("_whole").select(*group).join(cells, "_class").withColumn("_portion", F.pmod(F.xxhash64(dim, "feature"), F.col("_portions"))).withColumn("_slice", each("_slices"))
    dealt = classed.select("_class", "owner").join(cells, "_class").withColumn("_slice", F.pmod(F.xxhash64("owner"), F.col("_slices"))).withColumn("_portion", each("_portions"))
    side = lambda df, *names: df.select(*cell, *names).repartition(min(int(tasks), TASKS), *cell)
    found = side(led, dim, "feature").join(side(dealt, "owner"), cell).select(dim, "owner", "feature")
    return found.unionByName(asked.where("not _whole").select(dim, "owner", "feature")), asked.where("_whole is null").select(dim, "feature")


def replace_rule(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """(key, replace): not where the stored version is newer, or the same with the same analysis."""
    s = stored.select(key, F.col("version").alias("_v"), F.col("analysis_id").alias("_a"))
    joined = incoming.join(s, key, "left")
    keep = (F.col("_v") > F.col("version")) | ((F.col("_v") == F.col("version")) & (F.col("_a") == F.col("analysis_id")))
    return joined.select(key, F.coalesce(~keep, F.lit(True)).alias("replace"))


def fill_budget(components: DataFrame, dimensions: DataFrame, most: int) -> DataFrame:
    """(kind, id): all components, then dimensions by id while the budget lasts."""
    left = max(0, most - components.count())
    return components.select(F.lit("component").alias("kind"), "id").unionByName(dimensions.orderBy("id").limit(left).select(F.lit("dimension").alias("kind"), "id"))


def omitted(components_: DataFrame, dimensions: DataFrame, most: int) -> int:
    """How many dimensions the budget leaves out."""
    n, left = dimensions.count(), max(0, most - components_.count())
    return max(0, n - left)


def below(parts: DataFrame, top: int, save: Callable[[DataFrame], DataFrame], occ: str = "occ", parent: str = "parent", max_depth: int = 64) -> DataFrame:
    """(occ): a part and everything below it, level by level until a level is empty."""
    front = parts.where(F.col(occ) == top).select(occ)
    out, edges = front, parts.select(F.col(occ).alias("_c"), F.col(parent).alias("_p"))
    for _ in range(max_depth):
        front = save(edges.join(front, F.col("_p") == F.col(occ), "left_semi").select(F.col("_c").alias(occ)).join(out, occ, "left_anti").distinct())
        if front.isEmpty():
            break
        out = save(out.unionByName(front))
    return out


def geometry_evidence(refs: DataFrame, node: str, allowed: Column, roots: DataFrame | None = None) -> DataFrame:
    """refs: node, ref, explicit, region_type. A node's explicit references, or its others where it has none, of a region that fits; roots (node) have none."""
    if roots is not None:
        refs = refs.join(roots.select(node), node, "left_anti")
    some = refs.where("explicit").select(node).distinct().withColumn("_e", F.lit(True))
    joined = refs.join(some, node, "left")
    return joined.where(F.col("explicit") | F.col("_e").isNull()).where(allowed).select(node, "ref")
