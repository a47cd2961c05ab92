"""Catalog state, synchronisation and listing over tables of assets.

An upsert log holds sparse rows (key, seq, columns); the state of a key is the last value that was written to each column.
Every operator takes and returns DataFrames and shuffles on the key or the path; ids are given out by counts of key
ranges, never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetgraph.functions.paths import asset_path, base_name, escape, file_extension, leaf_name, normalize_escaped_path, normalize_path, path_chain, split_unescaped, to_data_path, to_file_leaf_path, unescape
from assetgraph.operators.ordered import ordinals

#: Kinds of files that keywords can be extracted from.
SUPPORTED = ("png", "jpg", "jpeg", "bmp", "gif", "webp", "pdf", "doc", "docx", "ppt", "pptx")
STRUCTURED = ("mysql", "postgres", "iotdb", "mongodb", "redis")
EXTERN = "/extern"
#: Sources that stand in paths without an address.
DEFAULT_SOURCES = ("filesystem", "mysql", "postgres", "iotdb")


def current_state(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The last value that is not null of every column, a row for each key. One aggregation, combined before the shuffle."""
    values = [c for c in log.columns if c not in (key, seq)]
    return log.groupBy(key).agg(*(F.expr(f"max_by(`{c}`, `{seq}`) filter (where `{c}` is not null)").alias(c) for c in values))


def live(assets: DataFrame, flag: str = "is_valid", null_is_live: bool = False) -> DataFrame:
    """Without the rows that are deleted; a null flag counts as deleted unless null_is_live. Without the column all are live."""
    if flag not in assets.columns:
        return assets
    return assets.where(F.coalesce(F.col(flag), F.lit(null_is_live)))


def last_value(df: DataFrame, group: list[str], key: str, value: str) -> DataFrame:
    return df.groupBy(*group).agg(F.max(key).alias("last_key"), F.max_by(value, key).alias("last_value"))


def allocate_ids(new: DataFrame, order: str, start, name: str = "id") -> DataFrame:
    """new with consecutive ids from start (a number, or a one-row DataFrame of one) in the order of an integer column."""
    out = ordinals(new.withColumn("_all", F.lit(0)), "_all", order, name).drop("_all")
    if isinstance(start, DataFrame):
        start = start.first()[0] or 0  # one number
    return out.withColumn(name, F.col(name) + start)


def latest(assets: DataFrame, by: list[str], key: str) -> DataFrame:
    """The row with the largest key of each group."""
    return assets.groupBy(*by).agg(F.max_by(F.struct(*assets.columns), key).alias("_row")).select("_row.*")


def reject_duplicates(incoming: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """incoming with `accepted`: nothing with the same folder and file exists."""
    known = existing.select(*(F.col(c).alias(f"_{c}") for c in on), F.lit(True).alias("_known")).distinct()
    joined = incoming.join(known, [F.col(c) == F.col(f"_{c}") for c in on], "left")
    return joined.withColumn("accepted", F.col("_known").isNull()).drop("_known", *(f"_{c}" for c in on))


def missing_directories(paths: DataFrame, existing: DataFrame, path: str) -> DataFrame:
    """(path): every ancestor folder but the root that has no directory row yet."""
    wanted = paths.select(F.explode(path_chain(normalize_path(F.col(path)))).alias("path")).where("path <> '/'").distinct()
    return wanted.join(existing.select(normalize_path(F.col(path)).alias("path")), "path", "left_anti")


def legacy_rows(new: DataFrame, existing: DataFrame, key: str, path: str, file: str) -> DataFrame:
    """Rows of existing that new assets replace: the same file, stored under a path that ends with it."""
    legacy = new.select(asset_path(F.col(path), F.col(file)).alias(path), file).distinct()
    return existing.join(legacy, [path, file], "left_semi").select(key, path, file)


def legacy_directories(directories: DataFrame, existing: DataFrame, key: str, path: str, file: str) -> DataFrame:
    """Directory rows of existing that are stored below themselves: the folder's path with its own name as the file."""
    own = directories.select(path).distinct()
    return existing.where(F.col(file) == leaf_name(F.col(path))).join(own, path, "left_semi").select(key, path, file)


def legacy_columns(tables: DataFrame, existing: DataFrame, key: str, path: str, file: str) -> DataFrame:
    """Rows of existing that stand for single columns, in a folder that is a table's own path now."""
    folders = tables.select(asset_path(F.col(path), F.col(file)).alias(path)).distinct()
    return existing.join(folders, path, "left_semi").select(key, path, file)


def _prefix(segs: Column) -> Column:
    return F.array_join(F.slice(segs, 1, 3), ".")


def derive_assets(columns: DataFrame, source: str = "source_type", path: str = "path") -> DataFrame:
    """(source, asset): redis is one asset, mongodb ends after two segments below the prefix, tables lose their last segment; others stay whole."""
    segs = split_unescaped(F.col(path))
    joined = lambda n: F.array_join(F.slice(segs, F.lit(1), n), ".")
    n = F.size(segs)
    asset = (
        F.when(F.col(source) == "redis", _prefix(segs)).when((F.col(source) == "mongodb") & (n >= 5), joined(F.lit(5)))
        .when(F.col(source).isin("mysql", "postgres", "iotdb") & (n > 3), joined(n - 1)).otherwise(F.col(path))
    )
    found = columns.where(n > 3).select(source, asset.alias("asset"))
    return found.where(F.size(split_unescaped(F.col("asset"))) >= 3).distinct()


def group_file_assets(columns: DataFrame, path: str = "path", type_: str = "type") -> DataFrame:
    """(asset, n_columns, columns): the first segment below the prefix with an extension ends the asset, the rest names its column."""
    segs = split_unescaped(F.col(path))
    flags = F.transform(segs, lambda s, i: (i >= 3) & F.contains(unescape(s), F.lit(".")))
    end = F.array_position(flags, True)
    cut = columns.withColumn("_end", F.when(end > 0, end).otherwise(F.size(segs)).cast("int"))
    asset = F.array_join(F.slice(segs, F.lit(1), F.col("_end")), ".")
    rest = F.array_join(F.slice(segs, F.col("_end") + 1, F.size(segs)), ".")
    found = cut.select(asset.alias("asset"), F.concat_ws(":", rest, type_).alias("_c")).distinct()
    return found.groupBy("asset").agg(F.count("*").alias("n_columns"), F.array_join(F.array_sort(F.collect_list("_c")), ",").alias("columns"))


def _body(source: Column, segs: Column) -> Column:
    below = F.slice(segs, F.lit(4), F.greatest(F.size(segs), F.lit(1)))
    first = F.lower(F.get(below, F.lit(0)))
    named = (first == source) | ((source == "postgres") & (first == "postgresql"))
    return F.when(F.coalesce(named, F.lit(False)), F.slice(below, F.lit(2), F.greatest(F.size(below), F.lit(1)))).otherwise(below)


def logical_names(assets: DataFrame, source: str = "source_type", asset: str = "asset") -> DataFrame:
    """Adds logical_path and file_name of external assets: /extern/<source key>/folders, the last segment is the file."""
    segs = F.transform(split_unescaped(F.col(asset)), unescape)
    body = F.when(F.col(source).isin(*STRUCTURED), _body(F.col(source), segs)).otherwise(F.slice(segs, F.lit(4), F.greatest(F.size(segs), F.lit(1))))
    named = assets.withColumn("_segs", segs).withColumn("_body", body)
    folders = F.slice("_body", F.lit(1), F.greatest(F.size("_body") - 1, F.lit(0)))
    path = normalize_path(F.array_join(F.concat(F.array(F.lit(EXTERN), F.get("_segs", F.lit(2))), folders), "/"))
    out = named.withColumn("logical_path", path)
    return out.withColumn("file_name", F.when(F.size("_body") > 0, base_name(F.element_at("_body", -1))).otherwise(leaf_name(F.col("logical_path")))).drop("_segs", "_body")


def source_key(kind: Column, ip: Column, port: Column) -> Column:
    """Kind and address as one token; empty if a part is missing."""
    kind_ = F.regexp_replace(F.lower(F.trim(F.coalesce(kind, F.lit("")))), "[^a-z0-9]", "")
    ip_ = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(ip, F.lit(""))), "[^a-zA-Z0-9]", "_"), "_+", "_")
    port_ = F.when((kind_ == "iotdb") & (F.trim(ip) == "127.0.0.1") & (port == 6667), 6668).otherwise(port)
    return F.when((kind_ == "") | (ip_ == "") | F.coalesce(port_ <= 0, F.lit(True)), "").otherwise(F.concat(kind_, ip_, F.lit("_"), port_))


_HINT = "_ts|timeseries|time_series|timeserie|metric|telemetry"
_TIME = "^(time|timestamp|date|datetime|.*_time|.*_timestamp)$"


def infer_data_type(source: Column, file: Column, column_names: Column | None = None) -> Column:
    """The kind of data of an asset; csv files are time series if their name or a column says so."""
    timed = F.lower(file).rlike(_HINT)
    if column_names is not None:
        timed = timed | F.exists(F.coalesce(column_names, F.array().cast("array<string>")), lambda c: F.lower(c).rlike(_TIME))
    csv = F.when(timed, "timeseries").otherwise("relational")
    return (
        F.when(source.isin("mysql", "postgres"), "relational").when(source == "iotdb", "timeseries").when(source == "mongodb", "document")
        .when(source == "redis", "keyvalue").when(file_extension(file) == "csv", csv).otherwise("file")
    )


def content_path(data_path: Column, data_type: Column) -> Column:
    """The stored content path: without `data.`, with `.*` for everything but files."""
    plain = F.regexp_replace(data_path, r"^data\.", "")
    return F.when(data_type == "file", plain).otherwise(F.concat(plain, F.lit(".*")))


def resolve_content(path: Column) -> Column:
    """The data path of a content path."""
    return F.concat(F.lit("data."), F.regexp_replace(path, r"\.\*$", ""))


def _cleaned(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "[^a-zA-Z0-9._-]", "_")


def resolve_data_path(content: Column, path: Column, file: Column) -> Column:
    """The data path of an asset: its stored content path, else made from its folder and file. Below `/extern` the first folder is the
    source: default ones add no segment, a file is a leaf with its dots escaped, a table a leaf unless the path ends with it."""
    stored = F.regexp_replace(normalize_escaped_path(content), r"(\.\*)+$", "")
    known = F.when((stored == "data") | stored.startswith("data."), stored).otherwise(F.concat(F.lit("data."), stored))
    path, file = F.coalesce(path, F.lit("")), F.trim(F.coalesce(file, F.lit("")))
    parts = F.split(F.substring(path, len(EXTERN) + 2, 1 << 30), "/")
    first = F.get(parts, F.lit(0))
    source, rest = F.lower(F.trim(first)), F.slice(parts, F.lit(2), F.size(parts))
    default = source.isin(*DEFAULT_SOURCES)
    twice = default & (first != "filesystem") & (F.size(rest) > 1) & (F.get(rest, F.lit(0)) == first)
    body = F.when(twice, F.slice(rest, F.lit(2), F.size(rest))).otherwise(rest)
    prefix = F.when(default | (first == ""), "data.extern").otherwise(F.concat(F.lit("data.extern."), _cleaned(first)))
    segs = F.transform(F.filter(F.transform(body, _cleaned), lambda s: s != ""), escape)
    base = F.array_join(F.concat(F.array(prefix), segs), ".")
    leaf = _cleaned(file)
    below = F.when(unescape(F.element_at(split_unescaped(base), -1)) == leaf, base).otherwise(F.concat(base, F.lit("."), leaf))
    outside = (file != "") & source.rlike("^(" + "|".join(STRUCTURED) + ")")
    extern = F.when((file != "") & source.startswith("filesystem"), to_file_leaf_path(base, file)).when(outside, below).otherwise(base)
    plain = to_data_path(path)
    own = F.when(file != "", to_file_leaf_path(plain, file)).otherwise(plain)
    return F.when(stored != "", known).when(path.startswith(EXTERN + "/"), extern).otherwise(own)


def initial_status(data_type: Column, file: Column) -> tuple[Column, Column]:
    """Status and keywords of a new row: files that nothing can be extracted from are skipped at once."""
    skipped = (data_type == "file") & ~file_extension(file).isin(*SUPPORTED)
    return F.when(skipped, "SKIPPED").otherwise("PENDING"), F.when(skipped, "[]")


def sync_actions(derived: DataFrame, catalog: DataFrame, path: str, file: str) -> DataFrame:
    """(path, file, action): IMPORTED, SKIPPED (there already) or REPLACED (there under its legacy path)."""
    own = derived.select(path, file).distinct()
    exact = catalog.select(F.col(path).alias("_p"), F.col(file).alias("_f")).distinct().withColumn("_there", F.lit(True))
    joined = own.join(exact, (F.col(path) == F.col("_p")) & (F.col(file) == F.col("_f")), "left").drop("_p", "_f")
    legacy = exact.withColumnRenamed("_there", "_old")
    joined = joined.withColumn("_legacy", asset_path(F.col(path), F.col(file))).join(legacy, (F.col("_legacy") == F.col("_p")) & (F.col(file) == F.col("_f")), "left")
    return joined.select(path, file, F.when(F.col("_there"), "SKIPPED").when(F.col("_old"), "REPLACED").otherwise("IMPORTED").alias("action"))


def sync_report(actions: DataFrame, derived: DataFrame, stored: DataFrame, path: str, file: str, size: str) -> DataFrame:
    """(action, assets, directories, bytes): how many assets each action has and their estimated size; directories that are new count as imported.

    stored: the folders (path) that have a row already.
    """
    sizes = derived.groupBy(path, file).agg(F.max(F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0))).alias("_b"))
    counts = actions.join(sizes, [path, file], "left").groupBy("action").agg(F.count("*").alias("assets"), F.sum(F.coalesce("_b", F.lit(0))).alias("bytes"))
    fresh = missing_directories(derived, stored, path).agg(F.count("*").alias("_d"))  # one row
    every = counts.join(F.broadcast(fresh), F.col("action") == "IMPORTED", "left")
    return every.select("action", "assets", F.coalesce("_d", F.lit(0)).alias("directories"), "bytes")


def needs_refresh(old_type: Column, new_type: Column, old_path: Column, new_path: Column, size: Column) -> Column:
    """Whether a schema sync replaces an existing row."""
    return (old_type != new_type) | (old_path != new_path) | ~new_type.isin("relational", "timeseries") | F.coalesce(size <= 0, F.lit(True))


def register_sources(registry: DataFrame, incoming: DataFrame, by: str, key: str) -> DataFrame:
    """incoming (by, ip, port, incoming_no) with the registered key of its source, or a new one.

    A source is known by its prefix `by`; without one by ip and port, but never as the default row (is_default).
    """
    named = registry.where(F.coalesce(F.col(by), F.lit("")) != "").groupBy(F.col(by).alias("_by")).agg(F.min(key).alias("_k1"))
    placed = registry.where(~F.coalesce("is_default", F.lit(False))).groupBy(F.trim("ip").alias("_ip"), F.col("port").alias("_port")).agg(F.min(key).alias("_k2"))
    joined = incoming.join(named, F.col(by) == F.col("_by"), "left").join(placed, (F.trim("ip") == F.col("_ip")) & (F.col("port") == F.col("_port")), "left")
    joined = joined.withColumn("_key", F.when(F.coalesce(F.col(by), F.lit("")) != "", F.col("_k1")).otherwise(F.col("_k2"))).drop("_by", "_k1", "_k2", "_ip", "_port")
    fresh = allocate_ids(joined.where("_key is null"), "incoming_no", registry.agg(F.max(key) + 1), key).drop("_key")
    return joined.where("_key is not null").withColumnRenamed("_key", key).select(*fresh.columns).unionByName(fresh)


def source_sizes(registry: DataFrame, deltas: DataFrame, by: str, size: str, default: str = "(default)", total: str = "(total)") -> DataFrame:
    """(by, total_size, place): registered sources with the sum of their sizes, negative ones as zero; before them the default source, which has
    what belongs to no registered one, after them the sum of all."""
    added = deltas.groupBy(by).agg(F.sum(F.greatest(F.col(size), F.lit(0))).alias("total_size"))
    own = registry.select(by).distinct().join(added, by, "left").select(by, F.coalesce("total_size", F.lit(0)).alias("total_size"), F.lit(1).alias("place"))
    rest = added.join(registry.select(F.col(by).alias("_r")).distinct(), F.col(by) == F.col("_r"), "left_anti")
    one = lambda df, name, place: df.agg(F.coalesce(F.sum("total_size"), F.lit(0)).alias("total_size")).select(F.lit(name).alias(by), "total_size", F.lit(place).alias("place"))
    return own.unionByName(one(rest, default, 0)).unionByName(one(added, total, 2))


def list_directory(assets: DataFrame, folder: str, key: str, path: str, file: str) -> DataFrame:
    """(kind, name, key) of the folders and files right below a folder: folders first, each kind by name; of files with one name the newest."""
    base = "" if folder == "/" else folder.rstrip("/")
    here = normalize_path(F.col(path))
    below = assets.where(here.startswith(base + "/")).select(F.split(F.substring(here, F.lit(len(base) + 2), F.length(here)), "/")[0].alias("name")).distinct()
    folders = below.select(F.lit("folder").alias("kind"), "name", F.lit(None).cast("long").alias(key))
    direct = (here == (base or "/")) | (here == F.concat(F.lit(base + "/"), F.col(file)))
    files = assets.where(direct).groupBy(F.col(file).alias("name")).agg(F.max(key).alias(key)).select(F.lit("file").alias("kind"), "name", key)
    return folders.join(files.select("name"), "name", "left_anti").select("kind", "name", key).unionByName(files).orderBy(F.col("kind") == "file", "name")


def resolve_files(requests: DataFrame, assets: DataFrame, key: str, path: str, file: str) -> DataFrame:
    """requests (path, file) with the key of the asset: the row itself before a legacy row, then the newest; null without any."""
    rows = assets.select(normalize_path(F.col(path)).alias("_p"), F.col(file).alias("_f"), F.col(key).alias("_k"))
    wanted = requests.withColumn("_try", F.explode(F.array(F.struct(F.lit(1).alias("rank"), normalize_path(F.col(path)).alias("p")), F.struct(F.lit(0).alias("rank"), asset_path(normalize_path(F.col(path)), F.col(file)).alias("p")))))
    joined = wanted.join(rows, (F.col("_try.p") == F.col("_p")) & (F.col(file) == F.col("_f")), "left")
    return joined.groupBy(path, file).agg(F.expr("max_by(_k, struct(_try.rank, _k)) filter (where _k is not null)").alias(key))


def display(c: Column, kind: T.DataType) -> Column:
    """Text of a value for a preview: bytes as text, lists joined by commas, `$oid` as `ObjectId("x")`, maps and structs as {k: v}; null is empty, within a map null."""
    return F.coalesce(_shown(c, kind), F.lit(""))


def _shown(c: Column, kind: T.DataType) -> Column:
    """As display, but null for null."""
    if isinstance(kind, T.BinaryType):
        return F.decode(c, "utf-8")
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: F.coalesce(_shown(x, kind.elementType), F.lit(""))), ", ")
    pair = lambda k, v: F.concat(k, F.lit(": "), F.coalesce(v, F.lit("null")))
    if isinstance(kind, T.MapType):
        listed = F.transform(F.map_entries(c), lambda e: pair(_shown(e["key"], kind.keyType), _shown(e["value"], kind.valueType)))
        plain = F.concat(F.lit("{"), F.array_join(listed, ", "), F.lit("}"))
        if not isinstance(kind.keyType, T.StringType):
            return plain
        return F.when(F.map_contains_key(c, F.lit("$oid")), F.concat(F.lit('ObjectId("'), F.coalesce(_shown(c["$oid"], kind.valueType), F.lit("null")), F.lit('")'))).otherwise(plain)
    if isinstance(kind, T.StructType):
        if "$oid" in kind.names:
            return F.when(c.isNotNull(), F.concat(F.lit('ObjectId("'), F.coalesce(_shown(c.getField("$oid"), kind["$oid"].dataType), F.lit("null")), F.lit('")')))
        fields = [pair(F.lit(f.name), _shown(c.getField(f.name), f.dataType)) for f in kind.fields]
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.array_join(F.array(*fields), ", "), F.lit("}")))
    return c.cast("string")


def preview(df: DataFrame, key: str, rows: int = 50) -> DataFrame:
    """The first rows by key, every column as text."""
    return df.orderBy(key).limit(rows).select(*(display(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def paginate(df: DataFrame, order: str, page: int, size: int) -> DataFrame:
    """One page of rows; the page number is clamped to those that exist."""
    pages = max(1, -(-df.count() // size))
    return df.orderBy(order).offset((min(max(1, page), pages) - 1) * size).limit(size)


def reconcile(observed: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """observed (id, ip, port) with the stored key: by id, then ip and port, then ip; a missing name is made from the address."""
    by_id = stored.groupBy(F.col("id").alias("_id")).agg(F.min(key).alias("_k1"))
    by_address = stored.groupBy(F.col("ip").alias("_ip"), F.col("port").alias("_port")).agg(F.min(key).alias("_k2"))
    by_ip = stored.groupBy(F.col("ip").alias("_host")).agg(F.min(key).alias("_k3"))
    out = observed.join(by_id, F.col("id") == F.col("_id"), "left").join(by_address, (F.col("ip") == F.col("_ip")) & (F.col("port") == F.col("_port")), "left").join(by_ip, F.col("ip") == F.col("_host"), "left")
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("node-"), F.trim("ip"), F.lit("-"), F.col("port")))
    return out.select(*observed.columns, F.coalesce("_k1", "_k2", "_k3").alias(key), name.alias("shown_name"))


def rows_by_key(df: DataFrame, keys: DataFrame, *on: str, listed: bool = True) -> DataFrame:
    """The rows whose key, of one or several columns, is listed; or those whose key is not."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi" if listed else "left_anti")


def content_with_meta(content: DataFrame, assets: DataFrame, on: str) -> DataFrame:
    """Content and assets by content path; assets without content and content without an asset stay."""
    return content.join(assets, on, "full")


def dynamic_columns(cells: DataFrame, chosen: DataFrame, path: str) -> DataFrame:
    """Cells (key, path, value) of the paths that another query chooses."""
    return cells.join(chosen.select(path).distinct(), path, "left_semi")
