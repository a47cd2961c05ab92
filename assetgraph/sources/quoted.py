"""Delimited text with quotes, whose fields may hold delimiters and line breaks, read by many tasks at once.

Where a record begins depends on all quotes before it. What a line does to that is one of four functions of the state at its begin, outside or
inside quotes: it leaves it as it is, turns it around, or ends outside or inside whatever it was. Functions compose, so every range of lines
is one of the four as well: ranges are settled by themselves, a short prefix composition over the ranges of a file gives each its true
state at its begin, and only then are lines put together to records, numbered, and cut. A line that spans tasks needs nothing from its neighbours but that.

Lines come as (file, line number, line); a line break inside quotes becomes one newline. Fields are not trimmed. A field without quotes keeps quotes that
it holds; after a closing quote, what follows up to the delimiter is kept. Records without any character, outside quotes, are left out. Missing
cells are empty, cells beyond the header are dropped. Records are whole however long they are, as after a quote that nothing closes; those that can't be
a value of Spark's (2 GB) end the job. Who wants none that long gives a bound, and has those beyond it from `oversized` and not as cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetgraph.functions.names import sanitize_column
from assetgraph.operators.ordered import ordinals
from assetgraph.sources.delimited import RANGE, detect_delimiter

BLOCK = 64  # records that meet their header in one place
DELIMITERS = (",", ";", "\t")
_INNER = r'[^"]*+(?:""[^"]*+)*+'
_QUOTED = f'"{_INNER}"'


def _by_delimiter(delimiter: Column, of) -> Column:
    """of(delimiter as a pattern) for each of the known ones, so that every pattern is a constant."""
    out = F.when(F.lit(False), None)
    for d in DELIMITERS:
        out = out.when(delimiter == d, of("\\t" if d == "\t" else d))
    return out


def _fields(d: str) -> str:
    """Whole fields, each with the delimiter after it."""
    return rf'(?:(?:{_QUOTED}[^{d}]*+|(?!")[^{d}]*+){d})*+'


def _steps(lines: DataFrame) -> DataFrame:
    """Adds _c, the state that a line ends in whatever it began in (1 inside quotes), else null, and _n, 1 if it turns the state around."""
    text = F.col("line")
    opens = f'"{_INNER}$'
    from_outside = _by_delimiter(F.col("delimiter"), lambda d: text.rlike(rf"^{_fields(d)}{opens}"))
    from_inside = _by_delimiter(F.col("delimiter"), lambda d: text.rlike(rf'^{_INNER}(?:$|"[^{d}]*+{d}{_fields(d)}{opens})'))
    out = lines.withColumn("_o", from_outside.cast("int")).withColumn("_i", from_inside.cast("int"))
    return out.withColumn("_c", F.when(F.col("_o") == F.col("_i"), F.col("_o"))).withColumn("_n", ((F.col("_o") == 1) & (F.col("_i") == 0)).cast("int")).drop("_o", "_i")


def _before(group: list[str], order: str, begin: Column) -> Column:
    """The state before each row: from the last row that settles it, or begin, and the turns since. Needs _turns."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    since = F.coalesce(F.last("_turns").over(w), F.lit(0)) - F.coalesce(F.last(F.when(F.col("_c").isNotNull(), F.col("_turns")), True).over(w), F.lit(0))
    return F.pmod(F.coalesce(F.last("_c", True).over(w), begin) + since, F.lit(2))


def _turns(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds _turns, the number of turns up to each row."""
    return df.withColumn("_turns", F.sum("_n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def record_starts(lines: DataFrame, file: str = "file_no", line_no: str = "line_no", line: str = "line", span: int = RANGE) -> DataFrame:
    """(file, range, line_no, line, delimiter, record): record is the number of the line that its record begins with, ranges are of `span` lines and stay together."""
    rows = lines.select(F.col(file).alias("file"), F.col(line_no).alias("line_no"), F.coalesce(F.col(line), F.lit("")).alias("line"))
    rows = rows.withColumn("range", F.floor(F.col("line_no") / span))
    heads = rows.where("line <> ''").groupBy("file").agg(detect_delimiter(F.min_by("line", "line_no")).alias("delimiter"))
    # every range gets its file's delimiter first, so that a file's lines are never brought together
    heads = rows.select("file", "range").distinct().join(heads, "file").select("file", "range", "delimiter")
    steps = _steps(rows.join(heads, ["file", "range"]))
    steps = _turns(steps, ["file", "range"], "line_no")
    # a range as one step: what it settles, and turns since that or in all
    settled = F.col("_c").isNotNull()
    ranges = steps.groupBy("file", "range").agg(
        F.max_by("_c", F.when(settled, F.col("line_no"))).alias("_last"), F.max_by("_turns", F.when(settled, F.col("line_no"))).alias("_at"), F.sum("_n").alias("_all")
    ).select("file", "range", F.pmod(F.col("_last") + F.col("_all") - F.col("_at"), F.lit(2)).alias("_c"), F.when(F.col("_last").isNull(), F.col("_all")).otherwise(0).alias("_n"))
    ranges = _turns(ranges, ["file"], "range").withColumn("_begin", _before(["file"], "range", F.lit(0)))
    known = steps.join(ranges.select("file", "range", "_begin"), ["file", "range"])
    known = known.withColumn("_inside", _before(["file", "range"], "line_no", F.col("_begin")))
    # the record of a line is the last begin up to it, here or in an earlier range
    starts = F.when(F.col("_inside") == 0, F.col("line_no"))
    here = known.withColumn("_start", F.max(starts).over(Window.partitionBy("file", "range").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    carried = here.groupBy("file", "range").agg(F.max("_start").alias("_s")).withColumn("_before", F.max("_s").over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    joined = here.join(carried.select("file", "range", "_before"), ["file", "range"])
    return joined.select("file", "range", "line_no", "line", "delimiter", F.coalesce("_start", "_before").alias("record"))


def _sizes(starts: DataFrame) -> DataFrame:
    return starts.groupBy("file", "record").agg(F.sum(F.length("line") + 1).alias("size"))


def oversized(starts: DataFrame, most: int) -> DataFrame:
    """(file, record, size) of the records of more than `most` characters."""
    return _sizes(starts).where(F.col("size") > most)


def parse_quoted(starts: DataFrame, most: int | None = None) -> DataFrame:
    """(file, key, pos, name, value) of the records of `record_starts`, all of them without a bound: the first is the header, key counts the others from 0, all values are text."""
    if most is not None:
        starts = starts.join(oversized(starts, most).select("file", "record"), ["file", "record"], "left_anti")
    joined = lambda order, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    # lines become text where their range lies, so that a record is gathered from one piece of each range and not from its lines
    pieces = starts.groupBy("file", "range", "record", "delimiter").agg(joined("line_no", "line").alias("_piece"))
    records = pieces.groupBy("file", "record", "delimiter").agg(joined("range", "_piece").alias("_text")).where("_text <> ''")
    cut = _by_delimiter(F.col("delimiter"), lambda d: F.regexp_extract_all(F.concat(F.col("delimiter"), "_text"), F.lit(rf"{d}({_QUOTED}[^{d}]*+|[^{d}]*+)"), F.lit(1)))
    inner = lambda x: F.concat(F.replace(F.regexp_extract(x, rf'(?s)^"({_INNER})"', 1), F.lit('""'), F.lit('"')), F.regexp_extract(x, rf"(?s)^{_QUOTED}(.*)$", 1))
    cells = F.transform(cut, lambda x: F.when(x.startswith('"'), inner(x)).otherwise(x))
    numbered = ordinals(records.select("file", "record", cells.alias("_cells")), "file", "record", "_at")
    numbered = numbered.withColumn("_block", F.floor(F.col("_at") / BLOCK))
    names = numbered.where("_at = 0").select("file", F.col("_cells").alias("_names"))
    # every block of records gets its file's header, for the same reason
    names = numbered.where("_at > 0").select("file", "_block").distinct().join(names, "file").select("file", "_block", "_names")
    rows = numbered.where("_at > 0").join(names, ["file", "_block"]).select("file", (F.col("_at") - 1).alias("key"), "_cells", F.posexplode("_names").alias("pos", "_name"))
    return rows.select("file", "key", "pos", sanitize_column(F.col("_name")).alias("name"), F.coalesce(F.get("_cells", F.col("pos")), F.lit("")).alias("value"))
