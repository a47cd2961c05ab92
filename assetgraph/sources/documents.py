"""JSON and XML documents as long tables of leaves."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from functools import reduce
from json.encoder import encode_basestring as quoted
from operator import or_
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetgraph.scratch import saved

#: Levels that are opened between two looks at whether any is left.
LEVELS = 4


def split_documents(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, doc_no, doc) with doc as VARIANT: an object is a document, an array one for each element, else the text is cut at `;` line ends and before `{` lines. Documents are numbered in the order of the text."""
    cut = F.transform(F.split(body, r";\s*\n|\n(?=\s*\{)"), lambda x: F.try_parse_json(F.regexp_replace(x, r";\s*$", "")))
    parsed = df.select(key, F.try_parse_json(F.col(body)).alias("_whole"), cut.alias("_parts"))
    each = F.forall("_parts", lambda v: v.isNotNull())  # the parser ignores what follows a first document
    values = F.filter(F.when(F.col("_whole").isNotNull() & ~each, F.array("_whole")).otherwise(F.col("_parts")), lambda v: v.isNotNull())
    listed = parsed.select(key, values.alias("_values"))
    flat = F.expr("flatten(transform(_values, v -> case when schema_of_variant(v) like 'ARRAY%' then cast(v as array<variant>) else array(v) end))")
    return listed.select(key, F.posexplode(flat).alias("doc_no", "doc"))


_PLAIN = r"r'^[a-zA-Z_@$-][a-zA-Z0-9_@$-]*\z'"
_NAME = r"regexp_replace(regexp_replace(regexp_replace(coalesce({k}, ''), r'^[\x00-\x20]+|[\x00-\x20]+$', ''), '[^a-zA-Z0-9_@$-]', '_'), '^([0-9])', 'c_$1')"
# _kind is looked up once for each node, when it is made; that of an object or a list goes through all that is in it
_EXPAND = f"""flatten(transform(_nodes, n -> case
  when n.t is not null or n.v is null then array(n)
  when startswith(n._kind, 'OBJECT') then transform(map_entries(cast(n.v as map<string, variant>)), e -> named_struct(
    'path', concat(n.path, if(n.path = '', '', '.'), if(e.key rlike {_PLAIN}, e.key, {_NAME.format(k="e.key")})), 'elem', n.elem,
    't', concat('ObjectId("', try_variant_get(e.value, '$["$oid"]', 'string'), '")'), 'v', e.value, '_kind', schema_of_variant(e.value)))
  when startswith(n._kind, 'ARRAY') then transform(cast(n.v as array<variant>), (x, i) -> named_struct('path', n.path, 'elem', n.elem + i, 't', cast(null as string), 'v', x, '_kind', schema_of_variant(x)))
  else array(n) end))"""


def _begins(kind: Column, *names: str) -> Column:
    return reduce(or_, (F.startswith(kind, F.lit(n)) for n in names))


def _leaf_type(n: Column) -> Column:
    kind = n["_kind"]
    return (
        F.when(n["t"].isNotNull() | (kind == "STRING"), "text").when(kind == "BIGINT", F.when(F.to_json(n["v"]).try_cast("int").isNotNull(), "integer").otherwise("long")).when(kind == "BOOLEAN", "boolean")
        .when(_begins(kind, "DECIMAL", "DOUBLE", "FLOAT"), "double").when(_begins(kind, "OBJECT", "ARRAY"), "open").otherwise("text")
    )


def _leaf_text(n: Column) -> Column:
    # whole numbers and what is open are the same as JSON, without a cast of its own for each value
    return F.coalesce(n["t"], F.when(_begins(n["_kind"], "BIGINT", "OBJECT", "ARRAY"), F.to_json(n["v"])).otherwise(F.try_variant_get(n["v"], "$", "string")))


def shred(docs: DataFrame, key: str, save: Callable[[DataFrame], DataFrame] = saved, levels: int = LEVELS) -> DataFrame:
    """(key, doc_no, elem, path, type, value): every leaf of every document, however deep.

    Names are sanitised, list element j stands at elem + j, nulls are dropped, `{"$oid": x}` is `ObjectId("x")`, a scalar
    root has the path `value`. Some levels are opened in one pass over the rows; only what is still open after it is gone through again.
    """
    start = docs.select(key, "doc_no", F.lit("").alias("path"), F.lit(0).alias("elem"), F.col("doc").alias("v"))
    out = None
    while True:
        nodes = start.select(key, "doc_no", F.expr("array(named_struct('path', path, 'elem', elem, 't', cast(null as string), 'v', v, '_kind', schema_of_variant(v)))").alias("_nodes"))
        for _ in range(levels):
            nodes = nodes.withColumn("_nodes", F.expr(_EXPAND))
        kept = F.filter("_nodes", lambda n: (n["_kind"] != "VOID") | n["t"].isNotNull())
        # worked out within the array, so that no row has a variant, which brings all names of its document
        leaves = F.transform(kept, lambda n: F.struct(n["elem"].cast("int").alias("elem"), n["path"].alias("path"), _leaf_type(n).alias("type"), _leaf_text(n).alias("value")))
        rows = save(nodes.select(key, "doc_no", F.explode(leaves).alias("_leaf")).select(key, "doc_no", "_leaf.*"))
        closed = rows.where("type <> 'open'").withColumn("path", F.when(F.col("path") == "", "value").otherwise(F.col("path")))
        out = closed if out is None else out.unionByName(closed)
        rest = rows.where("type = 'open'")
        if rest.isEmpty():
            return out
        start = rest.select(key, "doc_no", "path", "elem", F.parse_json("value").alias("v"))


def widened_types(leaves: DataFrame) -> DataFrame:
    """(path, type): a path with two types is text."""
    return leaves.groupBy("path").agg(F.when(F.min("type") == F.max("type"), F.min("type")).otherwise("text").alias("type"))


def flat_pairs(leaves: DataFrame, key: str) -> DataFrame:
    """(key, k, v): dotted keys of the first document; of a list the last element."""
    return leaves.where("doc_no = 0").groupBy(key, F.col("path").alias("k")).agg(F.max_by("value", "elem").alias("v"))


_WHOLE = re.compile(r"[+-]?[0-9]+")
_NUMBER = re.compile(r"([+-]?)([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[fFdD]?")
_BLANK = "".join(map(chr, range(33)))


def _leaf(text: str) -> str:
    """A text as JSON: a boolean, a whole number of 64 bits, another number, or text."""
    if not text or text[0] not in "+-.0123456789":
        return low if (low := text.lower()) in ("true", "false") else quoted(text)
    if _WHOLE.fullmatch(text) and -(1 << 63) <= int(text) < 1 << 63:
        return str(int(text))
    if (m := _NUMBER.fullmatch(text)) and math.isfinite(x := float(m[1] + m[2] + (m[3] or ""))):
        return json.dumps(x)
    return quoted(text)


def _xml_json(text: str | None) -> str | None:
    """An XML text as JSON: attributes `@name` as text, repeated children lists, mixed text `#text`; null for what is no XML or brings a document type."""
    if text is None or not text.strip(_BLANK):
        return None
    stack: list[tuple[list[str], dict[str, list[str]], list[str]]] = []
    root: list[str] = []

    def start(name: str, attributes: list[str]) -> None:
        stack.append(([f"{quoted('@' + k)}:{quoted(v)}" for k, v in zip(attributes[::2], attributes[1::2], strict=True)] if attributes else [], {}, [""]))

    def cut() -> None:  # texts apart from each other are joined by a space
        if stack and stack[-1][2][-1]:
            stack[-1][2].append("")

    def end(name: str) -> None:
        members, children, texts = stack.pop()
        body = texts[0].strip(_BLANK) if len(texts) == 1 else " ".join([t for x in texts if (t := x.strip(_BLANK))])
        members += [f"{quoted(k)}:{v[0] if len(v) == 1 else '[' + ','.join(v) + ']'}" for k, v in children.items()]
        if members and body:
            members.append(f'"#text":{_leaf(body)}')
        found = "{" + ",".join(members) + "}" if members else _leaf(body)
        if stack:
            stack[-1][1].setdefault(name, []).append(found)
            cut()
        else:
            root.append(found)

    def data(value: str) -> None:
        stack[-1][2][-1] += value

    def refuse(*_) -> None:
        raise ValueError("a document type")

    parser = expat.ParserCreate()
    parser.ordered_attributes, parser.buffer_text = True, True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, data, refuse
    parser.StartCdataSectionHandler = parser.EndCdataSectionHandler = parser.CommentHandler = lambda *_: cut()
    try:
        parser.Parse(text.strip(_BLANK).encode("utf-8", "replace"), True)
    except (expat.ExpatError, ValueError):
        return None
    return root[0]


def xml_documents(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, doc_no, doc) of XML texts, for `shred`: attributes are `@name` and stay text, repeated children are lists, mixed text is `#text`, the texts of
    leaves are typed, empty leaves are empty texts, the root's name is dropped. Texts that are no XML, that bring a document type, or that are
    nested deeper than JSON is read (1000 levels) have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_xml_json(t) for t in b.column(1).to_pylist()], pa.string())], ["k", "json"])

    texts = df.select(F.col(key).alias("k"), F.col(body).cast("string").alias("body"))
    found = texts.mapInArrow(run, f"k {dict(texts.dtypes)['k']}, json string").select(F.col("k").alias(key), F.lit(0).alias("doc_no"), F.try_parse_json("json").alias("doc"))
    return found.where("doc is not null")
