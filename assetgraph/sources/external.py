"""External stores: readers by format, and the list of columns that a store shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetgraph.operators.ordered import ordinals

#: What each kind of source has to be given.
REQUIRED = {
    "filesystem": ("path",), "mysql": ("url", "dbtable"), "postgres": ("url", "dbtable"),
    "iotdb": ("url", "sql"), "mongodb": ("connection.uri", "database", "collection"), "redis": ("host", "port", "keys.pattern"),
}
#: The Spark format of each kind; the last three need their connector on the class path.
FORMATS = {"mysql": "jdbc", "postgres": "jdbc", "iotdb": "org.apache.iotdb.spark.db", "mongodb": "mongodb", "redis": "org.apache.spark.sql.redis"}
READERS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def register(kind: str, reader: Callable[[SparkSession, dict], DataFrame]) -> None:
    """Adds or replaces the reader of a kind of source."""
    READERS[kind] = reader


def scan(spark: SparkSession, kind: str, options: dict[str, str]) -> DataFrame:
    """The source as a DataFrame. ValueError for an unknown kind or a missing option."""
    if kind in READERS:
        return READERS[kind](spark, options)
    if kind not in REQUIRED:
        raise ValueError(f"unknown source {kind!r}")
    if missing := [k for k in REQUIRED[kind] if not options.get(k)]:
        raise ValueError(f"{kind} needs {', '.join(missing)}")
    if kind == "filesystem":
        form = options.get("format", "binaryFile")
        more = {k: v for k, v in options.items() if k not in ("path", "format")}
        return spark.read.format(form).options(**more).load(options["path"])
    return spark.read.format(FORMATS[kind]).options(**options).load()


def schema_columns(df: DataFrame, prefix: str) -> list[tuple[str, str]]:
    """(path, type) of every leaf of a schema below a prefix."""
    out: list[tuple[str, str]] = []

    def walk(at: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{at}.{f.name.replace('.', chr(92) + '.')}", f.dataType)
        elif isinstance(kind, T.ArrayType):
            walk(at, kind.elementType)
        else:
            out.append((at, kind.simpleString().upper()))

    walk(prefix, df.schema)
    return out


def show_columns(columns: DataFrame, prefix: str | None = None) -> DataFrame:
    """The columns below a prefix, each path once."""
    found = columns if prefix is None else columns.where(F.startswith("path", F.lit(prefix + ".")))
    return found.dropDuplicates(["path"])


def reply_columns(replies: DataFrame, rows: DataFrame, store: str) -> DataFrame:
    """(store, path, type) of what stores show. replies: store, headers, types; rows: store, row_no, cells.

    The headers name the cells of path and type (else the first two). A row without a type takes that at its place among the
    types. If a reply has no row with a path, its headers are the columns.
    """
    ends = lambda h, word: h.endswith(word) | F.contains(h, F.lit("." + word))
    heads = F.transform("headers", lambda h: F.lower(F.trim(F.coalesce(h, F.lit("")))))
    at = lambda test, default: F.coalesce(F.array_max(F.transform(heads, lambda h, i: F.when(test(h), i))), F.lit(default))
    named = replies.select(store, "headers", "types", at(lambda h: ends(h, "path"), 0).alias("_p"), at(lambda h: ends(h, "type") & ~ends(h, "path"), 1).alias("_t"))
    cell = lambda i: F.trim(F.coalesce(F.get("cells", F.col(i)), F.lit("")))
    good = rows.join(named, store).withColumn("path", cell("_p")).where("path <> ''")
    placed = ordinals(good, store, "row_no", "_nth").withColumn("_nth", F.col("_nth").cast("int"))
    listed = placed.select(store, "path", F.coalesce(F.nullif(cell("_t"), F.lit("")), F.get("types", F.col("_nth")), F.lit("")).alias("type"))
    silent = named.join(good.select(store).distinct(), store, "left_anti").select(store, "types", F.posexplode("headers").alias("_at", "path")).where("path is not null")
    return listed.unionByName(silent.select(store, "path", F.coalesce(F.get("types", F.col("_at")), F.lit("")).alias("type")))
