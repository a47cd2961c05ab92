"""Quoted text against DuckDB's reader and Python's, over ranges of a few lines."""

import collections
import csv
import io
import random

import duckdb
import pytest

from assetgraph.sources import quoted


def _lines(spark, texts):
    return spark.createDataFrame([(f, n, x) for f, t in texts.items() for n, x in enumerate(t.split("\n"))], "file_no long, line_no long, line string").repartition(3)


def _cells(spark, texts, **bounds):
    starts = quoted.record_starts(_lines(spark, texts), **bounds)
    out = collections.defaultdict(dict)
    for r in quoted.parse_quoted(starts).collect():
        out[r.file].setdefault(r.key, {})[r.pos] = r.value
    return {f: [[row[p] for p in sorted(row)] for _, row in sorted(rows.items())] for f, rows in out.items()}


@pytest.mark.parametrize("span", [1, 3, 1 << 16])
def test_quoted_records_equal_two_other_readers(spark, tmp_path, span):
    rng = random.Random(span)
    texts, want = {}, {}
    for f, d in enumerate(",;\t,,;"):
        rows = [[f"c{k}" for k in range(4)]]
        for _ in range(40):
            rows.append(["".join(rng.choice(["a", "é", " ", d, '"', "\n", "x y", "\n\n", '""', ""]) for _ in range(rng.randrange(5))) for _ in range(4)])
        out = io.StringIO()
        csv.writer(out, delimiter=d, lineterminator="\n", quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows(rows)
        texts[f], want[f] = out.getvalue(), rows[1:]
        path = tmp_path / f"{f}.csv"
        path.write_text(texts[f])
        seen = duckdb.execute(f"select * from read_csv('{path}', delim = '{d}', quote = '\"', escape = '\"', header = true, all_varchar = true, nullstr = '\\0', auto_detect = false, columns = {{'c0': 'varchar', 'c1': 'varchar', 'c2': 'varchar', 'c3': 'varchar'}})").fetchall()
        assert [list(r) for r in seen] == want[f]
    assert _cells(spark, texts, span=span) == want


def test_odd_quoted_text(spark):
    texts = {1: 'a,b\n1"2,"x ""y"" z"tail\n\n"p\n\nq",r,beyond\nshort', 2: "", 3: "only,header", 4: 'h1;h2\n"";";"\n;'}
    got = _cells(spark, texts, span=2)
    assert got == {1: [['1"2', 'x "y" ztail'], ["p\n\nq", "r"], ["short", ""]], 4: [["", ";"], ["", ""]]}
    broken = {7: 'a,b\n1,2\n"never closed\n' + "more\n" * 50}
    starts = quoted.record_starts(_lines(spark, broken), span=4)
    assert [(r.file, r.record) for r in quoted.oversized(starts, 100).collect()] == [(7, 2)]
    assert {(r.key, r.value) for r in quoted.parse_quoted(starts, 100).collect()} == {(0, "1"), (0, "2")}
    assert quoted.parse_quoted(quoted.record_starts(_lines(spark, {1: "x"}).limit(0))).count() == 0


def test_a_file_is_not_brought_together(spark):
    """Records of a file meet its header by blocks, not by the file."""
    found = quoted.parse_quoted(quoted.record_starts(_lines(spark, {1: 'id;text\n1;"a\nb"\n2;c'})))
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert "_block#" in joins[0]
    assert sorted((r.key, r.name, r.value) for r in found.collect()) == [(0, "id", "1"), (0, "text", "a\nb"), (1, "id", "2"), (1, "text", "c")]


def test_records_of_any_length_are_whole(spark, tmp_path):
    """Texts of more than 2 Mi characters, in few lines and in many, between others that come as they would without them."""
    from oracles import spark_rows, sql_rows

    from assetgraph.plans.registry import ORACLE, QUERIES

    con, at = duckdb.connect(), f"{tmp_path}/documents.parquet"
    long_ = [(1, "de", "repeat('x,\"\"é', 600000)"), (2, "de", "'short'"), (3, "de", "repeat(chr(10), 1200000) || repeat('ab', 500000)"), (4, "de", "'after'"), (5, "fr", "repeat('a\"b' || chr(10), 700000)"), (6, "fr", "null")]
    con.execute(f"copy ({' union all '.join(f'select {k}::bigint as doc_id, {t} as text, {lang!r} as lang' for k, lang, t in long_)}) to '{at}' (format parquet)")
    con.execute(f"create view documents as select * from '{at}'")
    assert con.execute("select count(*) from documents where length(text) > 2097152").fetchone()[0] == 3
    assert spark_rows(QUERIES["q_csv_quoted"](spark, str(tmp_path))) == sql_rows(con, ORACLE["q_csv_quoted"])
