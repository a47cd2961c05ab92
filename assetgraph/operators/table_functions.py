"""Table functions for SQL that take a table: relations around a focus, for each asset of any table that has the columns.

`select * from ag_relations(TABLE(facts), 'focus')` partitions its argument by the first column, whatever its name and type, and that column comes
back as it is. A task holds of one asset no more than its candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from assetgraph.operators.graph import CANDIDATES

NEEDED = {"norm": T.StringType(), "other": T.StringType(), "related": T.BooleanType()}
#: What an unknown pair without an answer is stored with, and who says so.
NO_RELATION, SOURCE = "no relation", "query-udf"


def _message(table: T.StructType, focus: AnalyzeArgument, each: AnalyzeArgument | None) -> str | None:
    kinds = {f.name: f.dataType for f in table.fields}
    if missing := [n for n, t in NEEDED.items() if kinds.get(n) != t]:
        return f"needs {', '.join(f'{n} {NEEDED[n].simpleString()}' for n in missing)}"
    if table.fields[0].name in (*NEEDED, "answer"):
        return "needs the asset's key as its first column"
    if "answer" in kinds and kinds["answer"] != T.StringType():
        return "needs answer string"
    if not focus.isConstantExpression or not isinstance(focus.value, str):
        return "needs a constant text as focus"
    if each is not None and not (each.isConstantExpression and isinstance(each.value, int) and each.value > 0):
        return "needs a positive constant as number of candidates"
    return None


class Relations:
    """Facts about assets: a mention is norm alone; a pair that is known has other too and says whether it is related; with an
    `answer` column, an answered pair has a text there. Either name of a pair may come first, and any related row makes it related.

    For each asset that mentions the focus: candidate and status (related, unrelated, unknown) of its first `each` mentions in order. Given answers, also the
    pair (a, b) with related, relation and source as they are to be stored, which are null for pairs that are known.
    """

    @staticmethod
    def analyze(facts: AnalyzeArgument, focus: AnalyzeArgument, each: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not facts.isTable:
            raise ValueError("ag_relations needs a table")
        if wrong := _message(facts.dataType, focus, each):
            raise ValueError(f"ag_relations {wrong}")
        key = facts.dataType.fields[0]
        schema = T.StructType([T.StructField(key.name, key.dataType), T.StructField("candidate", T.StringType()), T.StructField("status", T.StringType())])
        if "answer" in facts.dataType.names:
            schema.add("a", "string").add("b", "string").add("related", "boolean").add("relation", "string").add("source", "string")
        # mentions come first, since nothing is before null
        order = [OrderingColumn("other", ascending=True, overrideNullsFirst=True), OrderingColumn("norm", ascending=True)]
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(f"`{key.name}`")], orderBy=order)

    def __init__(self) -> None:
        self.key, self.focused, self.answering = None, False, False
        self.beside: dict[str, bool | None] = {}  # in order; whether the pair with the focus is known to be related
        self.answers: dict[str, str] = {}
        self.focus, self.last, self.seen = None, None, 0

    def eval(self, facts: Row, focus: str, each: int = CANDIDATES) -> None:
        self.key, self.focus, self.answering = facts[0], focus, "answer" in facts
        norm, other = facts["norm"], facts["other"]
        if norm is None:
            return
        if other is None:
            self.focused |= norm == focus
            if norm != self.last and self.seen < each:
                self.seen += 1
                if norm != focus:
                    self.beside[norm] = None
            self.last = norm
        elif focus in (norm, other) and (name := other if norm == focus else norm) in self.beside:
            if facts["related"] is not None:
                self.beside[name] = bool(self.beside[name]) or facts["related"]
            if self.answering and facts["answer"] is not None:
                self.answers[name] = min(facts["answer"], self.answers.get(name, facts["answer"]))

    def terminate(self) -> Iterator[tuple]:
        if not self.focused:
            return
        for name, related in self.beside.items():
            status = "unknown" if related is None else "related" if related else "unrelated"
            row = (self.key, name, status)
            if self.answering:
                answer = self.answers.get(name)
                stored = (answer is not None, answer or NO_RELATION, SOURCE) if related is None else (None, None, None)
                row += (min(name, self.focus), max(name, self.focus), *stored)
            yield row


def register_relations(spark: SparkSession, name: str = "ag_relations") -> str:
    """Makes the table function known to SQL. With Arrow, each row that goes in would make a batch of what comes out, mostly an empty one; rows go in batches of rows."""
    spark.udtf.register(name, F.udtf(Relations, useArrow=False))
    return name
