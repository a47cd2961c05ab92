"""Golden cases of the quirks, and invariants."""

import pytest
from pyspark.sql import functions as F

from assetgraph import scratch
from assetgraph.functions import names as name_functions
from assetgraph.functions import paths, text
from assetgraph.operators import catalog, drawings, extract, graph, sinks, sizes
from assetgraph.scratch import fresh_path, names, saved
from assetgraph.sources import delimited, documents, export, external, files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "path"), [("a//b/", "/a/b"), ("", "/"), ("/", "/"), (" /x ", "/x"), ("//", "/")]
)
def test_normalize_path(spark, raw, path):
    assert one(spark, paths.normalize_path(F.col("c")), c=raw) == path


def test_unescaped_dots(spark):
    assert one(spark, paths.split_unescaped(F.col("c")), c="a.b\\.c.d") == ["a", "b\\.c", "d"]
    assert one(spark, paths.last_unescaped_dot(F.col("c")), c="a.b\\.c") == 1
    assert one(spark, paths.last_unescaped_dot(F.col("c")), c="ab") == -1
    assert one(spark, paths.to_data_path(F.col("c")), c="/a/b.csv") == "data.a.b\\.csv"


@pytest.mark.parametrize(
    ("raw", "ms"),
    [("12", 12), ("2024-01-02T03:04:05Z", 1704164645000), ("2024/01/02 03:04", 1704164640000), ("2024-01-02", 1704153600000), ("2024-02-30", None), ("2024-01-02 03:04:05+08:00", 1704164645000), ("x", None), ("", None)],
)
def test_parse_time(spark, raw, ms):
    assert one(spark, delimited.parse_time(F.col("c")), c=raw) == ms


def test_delimited_without_quotes_and_across_ranges(spark):
    lines = [(0, 0, "  "), (0, 1, "a;b;"), (0, 2, "1;2"), (0, 100, ""), (0, 70000, '"x;y";3;4'), (1, 0, "only a header")]
    rows = delimited.parse(spark.createDataFrame(lines, "file_no int, line_no long, line string")).orderBy("file_no", "key", "pos").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0, "a", "1"), (0, 0, 1, "b", "2"), (0, 0, 2, "col", ""), (0, 1, 0, "a", '"x'), (0, 1, 1, "b", 'y"'), (0, 1, 2, "col", "3")]


def test_key_values(spark):
    lines = ["# c", "! c", "export A = 'x'", "b:1=2", "=x", "2k = v", "A=last", "q=\"", "z"]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "file_no int, line_no long, line string")
    assert {r.k: r.v for r in delimited.key_values(df).collect()} == {"A": "last", "b": "1=2", "c_2k": "v", "q": '"'}


def test_json_cut_shred_and_types(spark):
    bodies = [(1, '{"a":1};\n{"a":2.5}'), (2, '[{"x":[1,{"y":null}]}]'), (3, "7"), (4, None), (5, '{"_id":{"$oid":"9"}}')]
    docs = documents.split_documents(spark.createDataFrame(bodies, "k int, body string"), "k", "body")
    leaves = documents.shred(docs, "k")
    found = {(r.k, r.doc_no, r.elem, r.path, r.type, r.value) for r in leaves.collect()}
    assert found == {(1, 0, 0, "a", "integer", "1"), (1, 1, 0, "a", "double", "2.5"), (2, 0, 0, "x", "integer", "1"), (3, 0, 0, "value", "integer", "7"), (5, 0, 0, "_id", "text", 'ObjectId("9")')}
    assert {r.path: r.type for r in documents.widened_types(leaves).collect()}["a"] == "text"
    arrays = spark.createDataFrame([(1, '[{"a":1},{"a":2}];\n[{"a":3},{"a":4}]')], "k int, body string")
    assert sorted((r.doc_no, r.value) for r in documents.shred(documents.split_documents(arrays, "k", "body"), "k").collect()) == [(0, "1"), (1, "2"), (2, "3"), (3, "4")]


def test_documents_of_any_depth(spark):
    depths = (1, 4, 5, 9)
    bodies = [(n, "".join(f'{{"k{i}":' for i in range(n)) + "[[1,[2]]]" + "}" * n) for n in depths]
    df = spark.createDataFrame(bodies, "k int, body string").coalesce(1)
    leaves = documents.shred(documents.split_documents(df, "k", "body"), "k")
    path = lambda n: ".".join(f"k{i}" for i in range(n))
    assert sorted((r.k, r.elem, r.path, r.value) for r in leaves.collect()) == [(n, e, path(n), str(e + 1)) for n in depths for e in (0, 1)]
    assert {r.k: r.fields for r in extract.json_fields(df, "k", "body").collect()} == {n: [path(i + 1) for i in range(n)] for n in depths}


def test_xml_documents(spark):
    bodies = [(1, '<r id="7"><a>1</a><a>x</a><b y="z">t<c>true</c></b><d/></r>'), (2, "<bad"), (3, "<r>5</r>"), (4, None), (5, ""), (6, "<!DOCTYPE r><r>1</r>"), (7, "<r id='007' f='1.50'><a> </a><b/><c>1.50</c><d>-9223372036854775809</d><e> x <f>TRUE</f><!-- c --> y<![CDATA[<z>]]></e><g>1e3</g><h>NaN</h></r>"), (8, "<r/>")]
    leaves = documents.shred(documents.xml_documents(spark.createDataFrame(bodies, "k int, body string"), "k", "body"), "k")
    found = {(r.k, r.elem, r.path, r.type, r.value) for r in leaves.collect()}
    assert found == {(1, 0, "@id", "text", "7"), (1, 0, "a", "integer", "1"), (1, 1, "a", "text", "x"), (1, 0, "b._text", "text", "t"), (1, 0, "b.@y", "text", "z"), (1, 0, "b.c", "boolean", "true"), (1, 0, "d", "text", ""), (3, 0, "value", "integer", "5"), (8, 0, "value", "text", "")} | {
        (7, 0, p, t, v) for p, t, v in (("@id", "text", "007"), ("@f", "text", "1.50"), ("a", "text", ""), ("b", "text", ""), ("c", "double", "1.5"), ("d", "double", "-9.223372036854776E18"), ("e._text", "text", "x y <z>"), ("e.f", "boolean", "true"), ("g", "double", "1000"), ("h", "text", "NaN"))
    }


def test_names_of_documents_are_trimmed(spark):
    df = spark.createDataFrame([(1, '{" a ": 1, "\\tb c\\n": {" 2": 3}}')], "k int, body string")
    assert {r.path for r in documents.shred(documents.split_documents(df, "k", "body"), "k").collect()} == {"a", "b_c.c_2"}


def test_ids_differ_whatever_suffixes_are_given(spark):
    given = ["a", "a-2", "a", "a-2", " ", "a-3", "occ-6", None, "a", "a-2-2", "x-5", "a"]
    df = spark.createDataFrame([(g, i, v) for g in (1, 2) for i, v in enumerate(given)], "g int, i long, given string")
    used = []
    for i, v in enumerate(given):
        base = (v or "").strip() or f"occ-{i + 1}"
        used.append(next(c for c in [base, *(f"{base}-{k}" for k in range(2, 99))] if c not in used))
    got = sorted((r.g, r.i, r.id) for r in drawings.stable_ids(df, "g", "i", "given", "occ").collect())
    assert got == [(g, i, x) for g in (1, 2) for i, x in enumerate(used)] and used[:3] == ["a", "a-2", "a-3"]


def test_owners_are_found_however_far_up(spark):
    chain = [(f"f{i}", f"f{i + 1}", "named" if i == 700 else "") for i in range(1000)] + [("f1000", "top", None)]
    cycle = [(f"c{i}", f"c{(i + 1) % 37}", "in a ring") for i in range(37)] + [("into", "c5", " ")] + [("self", "self", None), ("gone", "nowhere", "own"), ("leaf", None, "leaf")]
    features = spark.createDataFrame(chain + cycle, "ref string, parent string, name string")
    targets = spark.createDataFrame([("top", "o1"), ("top", "o2"), ("f900", "o3")], "ref string, owner string")
    refs = ["f0", "f701", "f950", "f900", "top", "c3", "into", "self", "gone", "leaf", "unknown", None]
    dims = spark.createDataFrame(list(enumerate(refs)), "dim int, ref string")
    found, lost = drawings.owned(dims, targets, features, "dim", "ref", saved)
    assert sorted((refs[r.dim], r.owner, r.feature) for r in found.collect()) == [("f0", "o3", "named"), ("f701", "o3", None), ("f900", "o3", None), ("f950", "o1", None), ("f950", "o2", None), ("top", "o1", None), ("top", "o2", None)]
    assert {(refs[r.dim], r.feature) for r in lost.collect()} == {("c3", "in a ring"), ("into", "in a ring"), ("self", None), ("gone", "own"), ("leaf", "leaf"), ("unknown", None), (None, None)}


def test_chunks_and_back(spark):
    df = spark.createDataFrame([(1, bytearray(range(250)) * 10), (2, bytearray())], "k int, content binary")
    pieces = files.chunks(df, "k", "content", 100)
    assert {r.k: r.n for r in pieces.groupBy("k").agg(F.count("*").alias("n")).collect()} == {1: 25, 2: 1}
    assert {r.k: bytes(r.content) for r in files.reassemble(pieces, "k", 1 << 20).collect()} == {1: bytes(range(250)) * 10, 2: b""}
    assert {r.k: len(r.content) for r in files.reassemble(pieces, "k", 150).collect()} == {1: 150, 2: 0}


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', "x\ny"), (2, None, "")], "key long, `t.a` string, b string")
    line = export.csv_lines(df.withColumnRenamed("t.a", "a"), ["a", "b"]).orderBy("key").first()["line"]
    assert line == '"a,""b""","x\ny"'
    export.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.columns == ["a", "b"] and 'a,"b"' in [r.a for r in back.collect()]


def test_external_sources(spark, sf):
    assert external.scan(spark, "filesystem", {"format": "parquet", "path": f"{sf}/region.parquet"}).count() == 5
    for kind, options in (("oracle", {}), ("mysql", {"url": "x"})):
        with pytest.raises(ValueError):
            external.scan(spark, kind, options)
    external.register("fixed", lambda s, o: s.range(int(o["n"])))
    assert external.scan(spark, "fixed", {"n": "3"}).count() == 3
    nested = spark.createDataFrame([], "a long, s struct<`x.y`:string,z:array<int>>")
    assert external.schema_columns(nested, "data") == [("data.a", "BIGINT"), ("data.s.x\\.y", "STRING"), ("data.s.z", "INT")]


def test_state_is_idempotent_and_sparse(spark):
    log = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, True), (1, 3, "b", None), (2, 1, None, None)], "k long, seq long, x string, ok boolean")
    state = catalog.current_state(log, "k", "seq")
    assert {tuple(r) for r in state.collect()} == {(1, "b", True), (2, None, None)}
    assert {tuple(r) for r in catalog.current_state(log.union(log), "k", "seq").collect()} == {(1, "b", True), (2, None, None)}
    assert catalog.live(state, "ok").count() == 1 and catalog.live(state, "ok", null_is_live=True).count() == 2 and catalog.live(state, "missing").count() == 2


def test_ids_are_dense_across_ranges(spark):
    ids = catalog.allocate_ids(spark.createDataFrame([(x,) for x in (5, 70000, 200000, 6)], "o long"), "o", 10).collect()
    assert sorted((r.o, r.id) for r in ids) == [(5, 10), (6, 11), (70000, 12), (200000, 13)]


def test_sizes_saturate(spark):
    df = spark.createDataFrame([((1 << 62),), ((1 << 62),)], "b long")
    assert df.agg(sizes.saturating_sum(F.col("b"))).first()[0] == sizes.MAX
    assert [one(spark, sizes.format_bytes(F.col("c")), c=n) for n in (0, 1023, 1024, 1536, 104857600, 1 << 50)] == ["0 B", "1023 B", "1.00 KB", "1.50 KB", "100 MB", "1.00 PB"]


def test_text_functions(spark):
    assert one(spark, text.parse_keywords(F.col("c")), c='["b"," a ","b"]') == ["b", "a"]
    assert one(spark, text.parse_keywords(F.col("c")), c="[broken, x") == ["[broken", "x"]
    assert one(spark, text.bounded_summary(F.col("c"), 20), c="One two. Three four five six.") == "One two. Three four…"
    assert one(spark, text.bounded_summary(F.col("c"), 20), c="One two three. Four five six.") == "One two three."
    assert one(spark, name_functions.entity_norm(F.col("c")), c="Ab é-9龥") == "ab9龥"
    fields = {"t.(key_2)": "key", "(t.key_2)": "key", "key_7": "key_7", "f(a)b": "fab", " (a.b c) ": "bc"}
    assert {c: one(spark, name_functions.normalize_field(F.col("c")), c=c) for c in fields} == fields


def test_headers_never_collide(spark):
    heads = ["a", "a_2", "a", "", "a", "column_3", "a_2", "b"]
    df = spark.createDataFrame([(0, i, h) for i, h in enumerate(heads)], "g int, i int, h string")
    out = [r.header for r in name_functions.dedup_headers(df, "g", "i", "h", saved).orderBy("i").collect()]
    assert out == ["a", "a_2", "a_3", "column_3", "a_4", "column_3_2", "a_2_2", "b"]


def test_path_parts(spark):
    parent, leaf = paths.split_parent_leaf(F.col("c"))
    assert [one(spark, parent, c=x) for x in ("a.b\\\\.c.d", "ab", ".a", "a.")] == ["a.b\\.c", "", "", ""] and one(spark, leaf, c="a.b\\.c") == "b\\.c"
    assert [one(spark, paths.to_file_leaf_path(F.lit("data.p"), F.col("c")), c=x) for x in ("x\\y/f.t.csv", " ", "dir/")] == ["data.p.f\\.t\\.csv", "data.p.content\\.bin", "data.p.dir/"]


def test_display_of_nested_values(spark):
    row = spark.sql("select array(1, null, 2) as a, map('k', array('x', 'y'), 'n', null) as m, map('$oid', 'z') as o, struct(1 as p, cast(null as string) as q) as s, cast(null as string) as n, cast('é' as binary) as b")
    assert list(catalog.preview(row, "n").first()) == ["1, , 2", "{k: x, y, n: null}", 'ObjectId("z")', "{p: 1, q: null}", "", "é"]


def test_chunks_fit_their_budget(spark):
    docs = spark.createDataFrame([(1, "\n".join(["word " * 40] * 5) + "x" * 1000), (2, None), (3, "")], "k long, t string")
    rows = extract.pack_chunks(docs, "k", "t", 60).collect()
    assert {r.k for r in rows} == {1} and all(0 < r.tokens <= 60 for r in rows)
    assert sum(r.chars for r in rows) == len(docs.first().t.replace("\n", ""))


def test_rollup_blocks_and_skips(spark):
    rows = [(1, "/a/b", "SUCCESS", ["x"]), (2, "/a/b", "SKIPPED", None), (3, "/a/c", "FAILED", None), (4, "/d", "SKIPPED", None)]
    out = {r.path: (r.status, r.keywords) for r in extract.roll_up(spark.createDataFrame(rows, "k long, p string, status string, kw array<string>"), "k", "p", "kw", saved).collect()}
    assert out == {"/a/b": ("SUCCESS", ["x"]), "/a/c": ("PENDING", None), "/a": ("PENDING", None), "/d": ("PENDING", None), "/": ("PENDING", None)}


def test_rollup_of_a_deep_tree_in_the_order_of_keys(spark):
    deep = "".join(f"/d{i}" for i in range(34))
    rows = [(10, deep, "SUCCESS", ["ten"]), (9, deep, "SUCCESS", ["nine"]), (3, "/z", "SUCCESS", ["last"]), (4, "/", "SUCCESS", ["own"])]
    out = {r.path: r.keywords for r in extract.roll_up(spark.createDataFrame(rows, "k long, p string, status string, kw array<string>"), "k", "p", "kw", saved).collect()}
    assert len(out) == 36 and out[deep] == out["/d0"] == ["nine", "ten"] and out["/"] == ["own", "nine", "ten", "last"]


def test_pieces_of_a_unit():
    text = "ab\n" + "c" * 50 + "。" + "é" * 30 + "\n" + "d" * 90
    pieces = extract._pieces(text, 25)
    assert sum(n for _, n in pieces) == len(text) and all(t <= 25 for t, _ in pieces) and extract._pieces("x", 0) == [(1, 1)] and extract._pieces("", 5) == [(0, 0)]
    assert [n for _, n in extract._pieces("aaaaa\nbbb" + "c" * 11, 5)] == [6, 14] and [n for _, n in extract._pieces("a\n" + "b" * 18, 5)] == [10, 10]


def test_a_merge_rewrites_the_buckets_it_touches(spark):
    path, schema = fresh_path(spark, "merged"), "k int, v string"
    read = lambda version=None: {r.k: r.v for r in sinks.read_table(spark, path, schema, version).collect()}
    assert read() == {} and sinks.manifest(spark, path) is None
    assert sinks.merge_table(path, spark.createDataFrame([(k, "0") for k in range(100)] + [(None, "null")], schema), ["k"], buckets=8) == 1
    first = sinks.manifest(spark, path)
    old = sinks.read_table(spark, path, schema)
    assert sinks.merge_table(path, spark.createDataFrame([(7, "a"), (7, "b"), (7, "B")], schema), ["k"], order="v") == 2
    second = sinks.manifest(spark, path)
    changed = [b for b in second["folders"] if second["folders"][b] != first["folders"][b]]
    assert len(changed) == 1 and len(first["folders"]) == 8 and second["n_buckets"] == 8
    assert read() == {k: "0" for k in range(100)} | {7: "b", None: "null"}
    assert {r.k: r.v for r in old.collect()}[7] == "0" and read(1)[7] == "0"  # a reader that has begun goes on
    sinks.merge_table(path, spark.createDataFrame([(7, "c"), (None, "new")], schema), ["k"])
    assert read() == {k: "0" for k in range(100)} | {7: "c", None: "new"}
    assert names(spark, f"{path}/manifests") == ["2.json", "3.json"]
    third = sinks.manifest(spark, path)
    untouched = [b for b in third["folders"] if third["folders"][b] == first["folders"][b]]
    assert len(untouched) == 8 - len({*changed} | {b for b in third["folders"] if third["folders"][b] != second["folders"][b]}) >= 6
    assert sinks.merge_table(path, spark.createDataFrame([], schema), ["k"]) == 4 and read()[7] == "c"
    with pytest.raises(ValueError):
        sinks.merge_table(path, spark.createDataFrame([], schema), ["v"])


def test_of_two_writers_of_one_version_the_second_is_told(spark, monkeypatch):
    path, schema = fresh_path(spark, "merged"), "k int, v string"
    sinks.merge_table(path, spark.createDataFrame([(1, "first")], schema), ["k"])
    now = sinks.manifest(spark, path)
    sinks.merge_table(path, spark.createDataFrame([(1, "other")], schema), ["k"])
    with monkeypatch.context() as m:
        m.setattr(sinks, "manifest", lambda *a: now)  # a writer that began before the other one ended
        with pytest.raises(sinks.ConcurrentMerge):
            sinks.merge_table(path, spark.createDataFrame([(1, "lost"), (2, "lost")], schema), ["k"])
    assert [tuple(r) for r in sinks.read_table(spark, path, schema).collect()] == [(1, "other")]
    sinks.merge_table(path, spark.createDataFrame([(2, "again")], schema), ["k"])
    assert sorted(tuple(r) for r in sinks.read_table(spark, path, schema).collect()) == [(1, "other"), (2, "again")]
    scratch.write_new(spark, f"{path}/manifests/9.json", '{"vers')  # half a manifest
    assert sinks.read_table(spark, path, schema).count() == 2
    with pytest.raises(sinks.ConcurrentMerge):
        sinks.merge_table(path, spark.createDataFrame([(3, "x")], schema), ["k"])
    monkeypatch.setattr(sinks, "STALE", -1)
    assert sinks.merge_table(path, spark.createDataFrame([(3, "x")], schema), ["k"]) == 4


def test_table_json_in_parts(spark):
    df = spark.range(7).select((F.col("id") % 2).alias("g"), "id")
    rows = {(r.g, r.part): r.body for r in export.table_json(df, "g", "id", 3).collect()}
    assert set(rows) == {(0, 0), (0, 1), (1, 0)} and rows[(0, 1)] == '{"columns":["id"],"rows":[{"id":6}],"totalRows":4}'


def test_chains_with_cycles_and_long_ones(spark):
    parts = [(0, None)] + [(i, i - 1) for i in range(1, 80)] + [(100, 101), (101, 100), (102, 100), (103, 999)]
    depth = {r.occ: r.depth for r in drawings.resolve_chains(spark.createDataFrame(parts, "occ long, parent long"), "occ", "parent", saved).collect()}
    assert all(depth[i] == (i if i <= 62 else None) for i in range(80))
    assert [depth[i] for i in (100, 101, 102, 103)] == [None] * 4


def test_every_edge_has_its_ends(spark):
    nodes = spark.createDataFrame([("a", "X", "")], "id string, label string, name string")
    out = graph.assemble(nodes, spark.createDataFrame([("a", "b")], "src string, dst string")).collect()
    assert {(r.id, r.label, r.name) for r in out} == {("a", "X", "a"), ("b", "Unknown", "(unknown)")}


def test_enrich_hook(spark):
    out = extract.enrich(spark.range(5), lambda frames: (f.assign(raw="{}") for f in frames), "id long, raw string")
    assert out.count() == 5


def test_plans_prune_and_push_down(spark, sf):
    from assetgraph.plans.registry import QUERIES

    plan = QUERIES["q_fields_relational"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
