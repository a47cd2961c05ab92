"""Delimited text, time series and key-value files as long tables of cells.

Lines come as (file, line number, line). A file of any length is numbered by many tasks (`operators.ordered`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetgraph.functions.names import sanitize_column
from assetgraph.operators.ordered import ordinals

RANGE = 1 << 16
_EDGES = r"^[\x00-\x20]+|[\x00-\x20]+$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files: each file's lines by their order in the scan."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return lines


def trimmed(c: Column) -> Column:
    """Without characters up to the space at either end."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), _EDGES, "")


def detect_delimiter(header: Column) -> Column:
    """Tab where it is at least as frequent as comma and semicolon; else the semicolon if there are more of it; else the comma."""
    count = lambda c: F.length(header) - F.length(F.replace(header, F.lit(c), F.lit("")))
    tabs, semis, commas = count("\t"), count(";"), count(",")
    return F.when((tabs >= commas) & (tabs >= semis) & (tabs > 0), "\t").when(semis > commas, ";").otherwise(",")


def headers(lines: DataFrame, file: str = "file_no", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """(file, header, delimiter) from the first line that is not blank."""
    kept = lines.select(file, line_no, trimmed(F.col(line)).alias("_line")).where("_line <> ''")
    return kept.groupBy(file).agg(F.min_by("_line", line_no).alias("header")).withColumn("delimiter", detect_delimiter(F.col("header")))


def parse(lines: DataFrame, file: str = "file_no", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """(file, key, pos, name, value): key is the row's ordinal, missing cells are empty, all values are text. Files with a header alone have no rows."""
    kept = lines.select(file, line_no, trimmed(F.col(line)).alias("_line")).where("_line <> ''")
    numbered = ordinals(kept, file, line_no, "_at").where("_at > 0")
    rows = numbered.join(headers(lines, file, line_no, line), file)
    cut = lambda c: F.split(c, F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E")), -1)
    cells = rows.select(file, (F.col("_at") - 1).alias("key"), cut(F.col("header")).alias("_names"), cut(F.col("_line")).alias("_cells"))
    cells = cells.select(file, "key", "_cells", F.posexplode("_names").alias("pos", "_name"))
    return cells.select(file, "key", "pos", sanitize_column(F.col("_name")).alias("name"), F.coalesce(F.get("_cells", F.col("pos")), F.lit("")).alias("value"))


def rejected_files(lines: DataFrame, file: str = "file_no", line: str = "line") -> DataFrame:
    """(file, reason) of the files that `parse` has no rows for: fewer than two lines that are not blank."""
    found = lines.groupBy(file).agg(F.count_if(trimmed(F.col(line)) != "").alias("_n"))
    return found.where("_n < 2").select(file, F.when(F.col("_n") == 0, "empty").otherwise("header alone").alias("reason"))


def parse_time(c: Column) -> Column:
    """Milliseconds: integers as they are; date, or date and time to the minute or second, in UTC; an offset is dropped. Null for others."""
    text = F.trim(c)
    plain = F.replace(F.replace(F.regexp_replace(text, r"[+Z].*$", ""), F.lit("T"), F.lit(" ")), F.lit("/"), F.lit("-"))
    at = lambda shape, fmt: F.when(plain.rlike(shape), F.unix_millis(F.try_to_timestamp(plain, F.lit(fmt))))
    return F.coalesce(
        F.when(text.rlike(r"^[+-]?[0-9]{1,19}$"), text.try_cast("long")),
        at(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
        at(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
        at(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    )


def infer_numeric(cells: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """keys and is_numeric: every non-empty value reads as a double."""
    return cells.groupBy(*keys).agg(F.bool_and((F.coalesce(F.col(value), F.lit("")) == "") | F.col(value).try_cast("double").isNotNull()).alias("is_numeric"))


def timeseries(cells: DataFrame, file: str, line_no: str, time: str) -> DataFrame:
    """cells: file, line_no, time text, name, value. (file, key, name, value): rows with a bad time are dropped, a later row overwrites an
    earlier one of the same time, empty cells of numeric columns are 0.0."""
    typed = cells.join(infer_numeric(cells, file, "name"), [file, "name"])
    good = typed.withColumn("key", parse_time(F.col(time))).where("key is not null")
    filled = F.when(F.col("is_numeric") & (F.coalesce(F.col("value"), F.lit("")) == ""), "0.0").otherwise(F.coalesce("value", F.lit("")))
    return good.withColumn("value", filled).groupBy(file, "key", "name").agg(F.max_by("value", line_no).alias("value"))


def rejected_series(cells: DataFrame, file: str, time: str, name: str = "name") -> DataFrame:
    """(file, reason) of the files that `timeseries` has no rows for: no line has both a time that reads and a cell. A line without cells has a null name."""
    good = parse_time(F.col(time)).isNotNull() & F.col(name).isNotNull()
    return cells.groupBy(file).agg(F.count_if(good).alias("_n")).where("_n = 0").select(file, F.lit("no line with a time and a value").alias("reason"))


def _property(line: Column) -> tuple[Column, Column]:
    """A trimmed line, and what follows `export ` in it."""
    text = trimmed(line)
    return text, F.when(text.startswith("export "), trimmed(F.substring(text, 8, 1 << 30))).otherwise(text)


def _unquoted(value: Column) -> Column:
    quoted = (F.length(value) >= 2) & ((value.startswith('"') & value.endswith('"')) | (value.startswith("'") & value.endswith("'")))
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def colon_pairs(lines: DataFrame, file: str = "file_no", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """(file, k, v) of flat YAML: the first colon separates, # lines are skipped, keys stay as they are, the last of a key wins."""
    text = trimmed(F.col(line))
    rows = lines.select(file, line_no, text.alias("_t")).where("not startswith(_t, '#') and locate(':', _t) > 1")
    value = trimmed(F.regexp_extract("_t", "(?s)^[^:]+:(.*)$", 1))
    return rows.select(file, line_no, trimmed(F.regexp_extract("_t", "^([^:]+):", 1)).alias("k"), _unquoted(value).alias("_v")).groupBy(file, "k").agg(F.max_by("_v", line_no).alias("v"))


def key_values(lines: DataFrame, file: str = "file_no", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """(file, k, v) of properties-like lines: comments skipped, the first = or : separates, one pair of quotes stripped, the last of a key wins."""
    text, body = _property(F.col(line))
    rows = lines.select(file, line_no, text.alias("_t"), body.alias("_b")).where("_t <> '' and not startswith(_t, '#') and not startswith(_t, '!')")
    rows = rows.where(F.col("_b").rlike("^[^=:]+[=:]"))
    key = trimmed(F.regexp_extract("_b", r"(?s)^([^=:]+)[=:]", 1))
    value = trimmed(F.regexp_extract("_b", r"(?s)^[^=:]+[=:](.*)$", 1))
    pairs = rows.select(file, line_no, key.alias("_k"), _unquoted(value).alias("_v")).where("_k <> ''")
    return pairs.withColumn("k", sanitize_column(F.col("_k"))).groupBy(file, "k").agg(F.max_by("_v", line_no).alias("v"))


def ingest_report(lines: DataFrame, file: str = "file_no", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """(file, ok, rows, reason) per file: one bad file never fails the others."""
    blank, (text, body) = trimmed(F.col(line)) == "", _property(F.col(line))
    found = lines.groupBy(file).agg(F.count_if(~blank).alias("n"), F.count_if(~text.rlike("^[#!]") & (trimmed(F.regexp_extract(body, "^([^=:]+)[=:]", 1)) != "")).alias("pairs"))
    reason = F.when(F.col("n") < 2, "needs a header and a row").when(F.col("pairs") == 0, "no pair")
    return found.select(file, reason.isNull().alias("ok"), F.when(reason.isNull(), F.col("n") - 1).otherwise(0).alias("rows"), F.coalesce(reason, F.lit("")).alias("reason"))


def ingest_totals(report: DataFrame) -> DataFrame:
    """One row: how many files there are, how many were taken and failed, and the rows of those taken."""
    return report.agg(F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
