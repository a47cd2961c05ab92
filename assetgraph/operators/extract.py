"""Fields, keywords and relations of assets, the work queues, and the bottom-up roll-up of directories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetgraph.functions.names import normalize_field
from assetgraph.functions.paths import file_extension, parent_path, strip
from assetgraph.functions.text import ENTITY_CAP, KEYWORD_CAP, TRIPLE_CAP, bounded_summary, dedup_strings, salvage_object
from assetgraph.operators.ordered import within_budget
from assetgraph.scratch import saved

FIELD_CAP, RELATION_CAP, FINAL_CAP = 120, 24, 12
VALUE_CHARS, TOTAL_CHARS = 8000, 15000
TYPE_NAMES = ("BOOLEAN", "INTEGER", "LONG", "FLOAT", "DOUBLE", "BINARY", "STRING", "DATE", "TIME", "TIMESTAMP")
IMAGES, OFFICE = ("jpg", "jpeg", "png", "bmp", "gif", "webp"), ("doc", "docx", "pdf", "ppt", "pptx")
TRIPLE = "array<struct<subject:string,predicate:string,relation:string,object:string>>"


def fields(columns: DataFrame, asset: str, order: str, name: str, drop: tuple[str, ...] = (), cap: int | None = FIELD_CAP) -> DataFrame:
    """(asset, fields): normalised names in order, each once, all of them without a cap. Names in drop go unless nothing else is left."""
    named = columns.select(asset, F.col(order).alias("_o"), normalize_field(F.col(name)).alias("_n")).where("_n <> ''")
    first = named.groupBy(asset, "_n").agg(F.min("_o").alias("_o"))
    nth = F.row_number().over(Window.partitionBy(asset).orderBy(F.col("_n").isin(*drop) if drop else F.lit(0), "_o", "_n"))
    kept = first if cap is None else first.withColumn("_nth", nth).where(F.col("_nth") <= cap + len(drop))
    listed = kept.groupBy(asset).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_n"))), lambda x: x["_n"]).alias("_all"))
    rest = F.filter("_all", lambda x: ~x.isin(*drop)) if drop else F.col("_all")
    chosen = F.when(F.size(rest) > 0, rest).otherwise(F.col("_all"))
    return listed.select(asset, (chosen if cap is None else F.slice(chosen, 1, cap)).alias("fields"))


def value_fields(values: DataFrame, asset: str, order: str, value: str, cap: int = FIELD_CAP) -> DataFrame:
    """(asset, fields) of tables without a header: the last dotted part, other than `data`, of values with a dot and fewer than 180 characters."""
    short = values.where(F.contains(F.col(value), F.lit(".")) & (F.length(value) < 180))
    last = F.try_element_at(F.filter(F.split(F.col(value), "[.]"), lambda s: ~s.isin("", "data")), F.lit(-1))
    return fields(short.withColumn("_last", last).where("_last is not null"), asset, order, "_last", cap=cap)


def json_fields(df: DataFrame, key: str, body: str, cap: int = FIELD_CAP, save: Callable[[DataFrame], DataFrame] = saved, levels: int = 4) -> DataFrame:
    """(key, fields): all dotted keys of a JSON object, inner ones too, level by level; of other texts what looks like a quoted key."""
    out = df.select(key, F.col(body).alias("_b"), F.try_parse_json(F.col(body)).alias("_v"))
    out = out.withColumn("_front", F.expr("case when schema_of_variant(_v) like 'OBJECT%' then array(named_struct('p', '', 'v', _v)) else array() end")).withColumn("_keys", F.array().cast("array<string>")).drop("_v")
    step = """flatten(transform(filter(_front, n -> schema_of_variant(n.v) like 'OBJECT%'), n -> transform(map_entries(cast(n.v as map<string, variant>)),
      e -> named_struct('p', concat(n.p, if(n.p = '', '', '.'), e.key), 'v', e.value))))"""
    done = None
    while True:
        for _ in range(levels):
            out = out.withColumn("_front", F.expr(step)).withColumn("_keys", F.concat("_keys", F.transform("_front", lambda n: n["p"])))
        rest = F.expr("transform(filter(_front, n -> schema_of_variant(n.v) like 'OBJECT%'), n -> named_struct('p', n.p, 'v', to_json(n.v)))")
        rows = save(out.withColumn("_front", rest))
        closed = rows.where(F.size("_front") == 0).drop("_front")
        done = closed if done is None else done.unionByName(closed)
        out = rows.where(F.size("_front") > 0)
        if out.isEmpty():
            break
        out = out.withColumn("_front", F.expr("transform(_front, n -> named_struct('p', n.p, 'v', parse_json(n.v)))"))
    loose = F.regexp_extract_all("_b", F.lit(r'"([^"]+)"\s*:'), 1)
    return done.select(key, dedup_strings(F.when(F.size("_keys") > 0, F.col("_keys")).otherwise(loose), cap).alias("fields"))


def route_file(name: Column) -> Column:
    extension = file_extension(name)
    return F.when(extension.isin(*IMAGES), "image").when(extension.isin(*OFFICE), "office").otherwise("skipped")


def bounded_text(values: DataFrame, asset: str, order: str, value: str, each: int = VALUE_CHARS, total: int = TOTAL_CHARS) -> DataFrame:
    """(asset, text): values in order, each and all together clipped, on lines of their own. What is beyond `total` is dropped before values are gathered."""
    clipped = values.select(asset, F.col(order).alias("_o"), F.substring(value, 1, each).alias("_t")).where("_t <> ''")
    few = within_budget(clipped.withColumn("_size", (F.length("_t") + 1).cast("long")), asset, "_o", "_size", total)
    few = few.withColumn("_t", F.substring(F.col("_t"), F.lit(1), (total - F.col("_before")).cast("int")))
    return few.groupBy(asset).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]), "\n").alias("text"))


def is_type_row(cells: Column) -> Column:
    """All cells of a row are names of types."""
    return (F.size(cells) > 0) & F.forall(cells, lambda c: F.upper(strip(F.coalesce(c, F.lit("")))).isin(*TYPE_NAMES))


def fallback_keywords(keywords: Column, fields_: Column, entities: Column, file: Column, cap: int = FINAL_CAP) -> Column:
    return dedup_strings(F.concat(keywords, fields_, entities, F.array(file)), cap)


def parse_responses(responses: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, keywords, entities, triples, error) of model answers; what is no JSON object is an error with empty lists."""
    shape = f"keywords array<string>, entities array<string>, triples {TRIPLE}, relations {TRIPLE}"
    parsed = responses.select(key, salvage_object(F.col(raw)).alias("_t")).select(key, F.from_json("_t", shape).alias("_j"), (F.try_parse_json("_t").isNull() | (F.col("_t") == "")).alias("error"))
    none = F.array().cast("array<string>")
    both = F.concat(*(F.coalesce(f"_j.{n}", F.array().cast(TRIPLE)) for n in ("triples", "relations")))
    clean = F.transform(both, lambda t: F.struct(strip(F.coalesce(t["subject"], F.lit(""))).alias("subject"), strip(F.coalesce(t["predicate"], t["relation"], F.lit(""))).alias("predicate"), strip(F.coalesce(t["object"], F.lit(""))).alias("object")))
    whole = F.array_distinct(F.filter(clean, lambda t: (t["subject"] != "") & (t["predicate"] != "") & (t["object"] != "")))
    return parsed.select(
        key, dedup_strings(F.coalesce("_j.keywords", none), KEYWORD_CAP).alias("keywords"), dedup_strings(F.coalesce("_j.entities", none), ENTITY_CAP).alias("entities"),
        F.slice(whole, 1, TRIPLE_CAP).alias("triples"), "error",
    )


def final_keywords(answers: DataFrame, fallback: DataFrame, key: str, kind: str | None = None, cap: int = FINAL_CAP) -> DataFrame:
    """(key, keywords): those of the answer where it has any, else the fallback's, at most `cap`.

    kind: a column of fallback; a `drawing` has all keywords and entities of its answer, a `document` its keywords as they are, both uncapped.
    """
    none = F.array().cast("array<string>")
    entities = F.col("entities") if "entities" in answers.columns else none
    joined = fallback.select(key, F.col("keywords").alias("_f"), (F.col(kind) if kind else F.lit("")).alias("_kind")).join(answers.select(key, F.col("keywords").alias("_a"), entities.alias("_e")), key, "left")
    a, e = F.coalesce("_a", none), F.coalesce("_e", none)
    usual = F.slice(F.when(F.size(a) > 0, a).otherwise(F.col("_f")), 1, cap)
    return joined.select(key, F.when(F.col("_kind") == "drawing", dedup_strings(F.concat(a, e))).when((F.col("_kind") == "document") & (F.size(a) > 0), a).otherwise(usual).alias("keywords"))


def document_triples(triples: DataFrame, keywords: DataFrame, key: str, order: str, evidence: str = "evidence", most: int = 160) -> DataFrame:
    """Triples of documents (key, order, subject, predicate, object, evidence), uncapped: ends are keywords, the predicate has 1 to 64 characters, the evidence is not empty."""
    said, shown = strip(F.coalesce("predicate", F.lit(""))), F.coalesce(evidence, F.lit("")).rlike(r"(?U)\S")
    # patterns run on triples between keywords alone: few are, and what the patterns ask stands behind that in one condition
    good = between(triples, keywords, key, "keyword", "subject", "object", True, shown & (said != "") & (F.length(said) <= 64))
    told = good.withColumn("predicate", said).withColumn(evidence, bounded_summary(F.col(evidence), most))
    first = told.withColumn("_nth", F.rank().over(Window.partitionBy(key, "subject", "predicate", "object").orderBy(order))).where("_nth = 1")
    return first.select(key, order, "subject", "predicate", "object", evidence)


def between(rows: DataFrame, words: DataFrame, key: str, word: str, begin: str, end: str, self_loops: bool, more: Column | None = None) -> DataFrame:
    """The rows whose begin and end are both words (key, word) of their asset, and for which more holds. The words of an asset, some hundred at most, meet its rows as one set, so rows are shuffled by key
    alone, and not at all where they lie by it already; what is grouped by key and more afterwards stays there."""
    own = words.groupBy(F.col(key).alias("_a")).agg(F.collect_set(word).alias("_words"))
    # one condition, so that no part of it goes below the join, where the ends would be worked out once more
    rest = (F.lit(True) if self_loops else F.col(begin) != F.col(end)) & (F.lit(True) if more is None else more)
    both = F.when(F.array_contains("_words", F.col(begin)), F.array_contains("_words", F.col(end)) & rest).otherwise(False)
    return rows.join(own, F.col(key) == F.col("_a")).where(both).drop("_a", "_words")


def _admitted(triples: DataFrame, keywords: DataFrame, key: str, self_loops: bool, max_predicate: int | None) -> DataFrame:
    good = triples.where("predicate <> ''")
    if max_predicate:
        good = good.where(F.length("predicate") <= max_predicate)
    return between(good, keywords, key, "keyword", "subject", "object", self_loops)


def admitted_triples(triples: DataFrame, keywords: DataFrame, key: str, order: str, cap: int | None, self_loops: bool, max_predicate: int | None = None) -> DataFrame:
    """Triples (key, order, subject, predicate, object) whose ends are keywords (key, keyword) of their asset, each once, the first ones by order; all of them without a cap."""
    good = _admitted(triples, keywords, key, self_loops, max_predicate)
    once = good.groupBy(key, "subject", "predicate", "object").agg(F.min(order).alias(order))
    if cap is None:
        return once
    return once.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order, "subject", "predicate", "object"))).where(F.col("_nth") <= cap).drop("_nth")


def leaf_queue(assets: DataFrame, key: str, k: int, include_deleted: bool = False) -> DataFrame:
    """The k first assets that wait for extraction."""
    waiting = assets.where("data_type <> 'directory' and status in ('PENDING', 'FAILED')")
    return (waiting if include_deleted else waiting.where("is_valid")).orderBy(key).limit(k)


def directory_readiness(children: DataFrame, parent: str = "parent") -> DataFrame:
    """children: parent, status, has_keywords. (parent, n, ready): some child counts (is not SKIPPED), and all that count are done."""
    counts = F.col("status") != "SKIPPED"
    done = ~counts | ((F.col("status") == "SUCCESS") & F.col("has_keywords"))
    return children.groupBy(parent).agg(F.count("*").alias("n"), (F.bool_or(counts) & F.bool_and(done)).alias("ready"))


def directory_candidates(directories: DataFrame, path: str, k: int) -> DataFrame:
    """directories: path, key, status, ready. The next k: waiting before failed, the deepest first, then the smallest key."""
    depth = F.size(F.split(path, "/"))
    return directories.where("ready and status in ('PENDING', 'FAILED')").orderBy(F.col("status") == "FAILED", F.desc(depth), "key").limit(k)


def directory_summary(children: DataFrame, parent: str, order: str, keywords: str, cap: int = FINAL_CAP) -> DataFrame:
    """(parent, keywords): the first keywords of the children in order; at most KEYWORD_CAP children can matter for each keyword kept."""
    each = children.select(parent, F.col(order).alias("_o"), F.posexplode(keywords).alias("_p", "_k"))
    first = each.where("_k <> ''").groupBy(parent, "_k").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    kept = first.withColumn("_nth", F.row_number().over(Window.partitionBy(parent).orderBy("_at", "_k"))).where(F.col("_nth") <= cap)
    return kept.groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "_k"))), lambda x: x["_k"]).alias("keywords"))


def roll_up(assets: DataFrame, key: str, path: str, keywords: str, save: Callable[[DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """(path, status, keywords) of every directory after all rounds: level by level, the deepest first, down to the root.

    assets: key (a number), path (their folder), status and keywords of live assets. folder: a column with the path of rows that stand for whole
    folders, null for assets. Children count in the order of assets by key, then folders by path. `save` cuts the lineage of each level.
    """
    sub = F.col(folder) if folder else F.lit(None).cast("string")
    order = lambda number, name: F.struct(name.isNotNull().alias("f"), number.cast("long").alias("k"), name.alias("p"))
    children = save(assets.select(F.col(path).alias("parent"), order(F.col(key), sub).alias("_o"), "status", F.col(keywords).alias("_kw")))
    levels, up = [], None
    depth = F.size(F.filter(F.split("parent", "/"), lambda x: x != ""))
    for level in range(children.agg(F.max(depth)).first()[0] or 0, -1, -1):
        here = children.where(depth == level)
        here = here if up is None else here.unionByName(up)
        state = directory_readiness(here.withColumn("has_keywords", F.col("_kw").isNotNull()))
        done = here.where("status = 'SUCCESS'")
        rows = state.join(directory_summary(done, "parent", "_o", "_kw"), "parent", "left")
        rows = save(rows.select(F.col("parent").alias("path"), F.when(F.col("ready"), "SUCCESS").otherwise("PENDING").alias("status"), F.when(F.col("ready"), F.coalesce("keywords", F.array().cast("array<string>"))).alias("keywords")))
        levels.append(rows)
        # a folder's parent lies one level above it
        up = rows.where("path <> '/'").select(parent_path(F.col("path")).alias("parent"), order(F.lit(None), F.col("path")).alias("_o"), "status", F.col("keywords").alias("_kw"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def status_rows(callbacks: DataFrame, key: str, seq: str) -> DataFrame:
    """Log rows (key, seq, status, keywords, summary) of start and done callbacks: anything but SUCCESS or SKIPPED ends as FAILED."""
    status = F.when(F.col("event") == "start", "PROCESSING").when(F.upper("result").isin("SUCCESS", "SKIPPED"), F.upper("result")).otherwise("FAILED")
    words = F.when(F.col("event") == "done", F.coalesce(F.nullif(F.trim("keywords"), F.lit("")), F.lit("[]")))
    return callbacks.select(key, seq, status.alias("status"), words.alias("keywords"), F.nullif(F.trim("summary"), F.lit("")).alias("summary"))


def _pieces(unit: str, budget: int) -> list[tuple[int, int]]:
    """(tokens, characters) of the pieces of a unit, in order: one that is over the budget is cut in two, after the last line end or full
    stop of its first half unless that leaves less than a quarter before the cut, else in the middle."""
    marks = np.frombuffer(unit.encode("utf-32-le"), np.uint32)
    plain = np.concatenate([[0], np.cumsum(marks < 128)])
    stops = np.flatnonzero((marks == ord("\n")) | (marks == ord("。"))) + 1  # places after a stop

    def cost(a: int, b: int) -> int:
        ascii_ = int(plain[b] - plain[a])
        return (ascii_ + 2) // 3 + 2 * (b - a - ascii_)

    out, todo = [], [(0, len(marks))]
    while todo:
        a, b = todo.pop()
        n = b - a
        if n < 2 or cost(a, b) <= budget:
            out.append((cost(a, b), n))
            continue
        nearest = int(np.searchsorted(stops, a + n // 2, "right")) - 1
        cut = int(stops[nearest]) if nearest >= 0 and stops[nearest] > a + n // 2 // 2 else a + n // 2
        todo += [(cut, b), (a, cut)]
    return out


def pack_chunks(docs: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """(key, chunk, n_parts, tokens, chars): neighbouring paragraphs packed greedily under a token budget; larger ones are cut first.
    One row holds a whole document, so nothing is gathered."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for k, body in zip(df[key], df[text], strict=True):
                chunk, parts, used, chars = 0, 0, 0, 0
                for unit in filter(None, (body or "").split("\n")):
                    for cost, length in _pieces(unit, budget):
                        if parts and used + cost > budget:
                            rows.append((k, chunk, parts, used, chars))
                            chunk, parts, used, chars = chunk + 1, 0, 0, 0
                        parts, used, chars = parts + 1, used + cost, chars + length
                if parts:
                    rows.append((k, chunk, parts, used, chars))
            yield pd.DataFrame(rows, columns=[key, "chunk", "n_parts", "tokens", "chars"])

    return docs.select(key, text).mapInPandas(run, f"{key} long, chunk int, n_parts int, tokens long, chars long")


def merge_sections(triples: DataFrame, key: str, section: str) -> DataFrame:
    """The triples of all sections, each with the first section that has it."""
    return triples.where("subject <> '' and predicate <> '' and object <> ''").groupBy(key, "subject", "predicate", "object").agg(F.min(section).alias(section))


def merge_section_keywords(keywords: DataFrame, key: str, section: str, order: str, word: str) -> DataFrame:
    """(key, word, place): the keywords of all sections, each once, numbered from 1 by the first section and place that has it. Nothing is capped."""
    trimmed = keywords.select(key, section, order, strip(F.col(word)).alias(word)).where(F.col(word) != "")
    first = trimmed.groupBy(key, word).agg(F.min(F.struct(section, order)).alias("_at"))
    return first.select(key, word, F.row_number().over(Window.partitionBy(key).orderBy("_at", word)).alias("place"))


def dedup_blocks(docs: DataFrame, key: str, text: str, cap: int) -> DataFrame:
    """(key, pos, block): the distinct lines of each document in order, together at most `cap` characters."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "_l")).select(key, "pos", F.trim(F.regexp_replace("_l", "[ \t]+", " ")).alias("block")).where("block <> ''")
    first = lines.groupBy(key, "block").agg(F.min("pos").alias("pos"))
    kept = within_budget(first.withColumn("_size", F.length("block").cast("long")), key, "pos", "_size", cap)
    return kept.select(key, "pos", F.substring(F.col("block"), F.lit(1), (cap - F.col("_before")).cast("int")).alias("block"))


def enrich(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A user's own enrichment (a model call, for instance) over batches of rows; its rows make a table of responses."""
    return df.mapInPandas(fn, schema)
