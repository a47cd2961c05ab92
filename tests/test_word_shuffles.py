"""What is made of the words of documents stays with its document: texts are shuffled, words are not."""

from assetgraph.fixtures import fixture
from assetgraph.operators import extract as x
from assetgraph.operators import graph as g


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_not_shuffled(spark, sf):
    for name in ("fx_keywords", "fx_triples"):
        plan = _plan(fixture(spark, sf, name))
        assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(doc_id" in plan


def test_triples_meet_their_keywords_where_they_lie(spark, sf):
    triples, keywords = (fixture(spark, sf, n) for n in ("fx_triples", "fx_keywords"))
    for made in (
        x.admitted_triples(triples, keywords, "asset_key", "pos", None, True), x.document_triples(triples.withColumn("evidence", triples.subject), keywords, "asset_key", "pos"),
        g.semantic_relations(triples, g.mentions(keywords, "asset_key", "keyword"), "asset_key", "pos"),
    ):
        plan = _plan(made)
        assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(doc_id") == 2


def test_equal_triples_with_several_evidences(spark):
    rows = [(1, 1, "a", " r ", "b", "one"), (1, 1, "a", "r", "b", "two"), (1, 2, "a", "r", "b", "late"), (1, 0, "a", "r", "b", " "), (1, 3, "a", "r", "c", "no keyword"), (2, 1, "a", "r", "b", "other asset")]
    triples = spark.createDataFrame(rows, "k long, pos int, subject string, predicate string, object string, evidence string")
    keywords = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, None)], "k long, keyword string")
    assert sorted((r.k, r.pos, r.evidence) for r in x.document_triples(triples, keywords, "k", "pos").collect()) == [(1, 1, "one"), (1, 1, "two")]


def test_norms_by_the_pattern(spark):
    from pyspark.sql import functions as F

    from assetgraph.functions.names import entity_norm

    words = ["", "Ab", "a-b_c.", "É9x", "龥!", "𝄞a", "İx", "K", "\x00a\x7f", "no pattern", None, "ß.", *map(chr, range(1, 700))]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", entity_norm(F.col("w")).alias("n"), F.regexp_replace(F.lower("w"), "[^a-z0-9一-龥]", "").alias("p")).collect()
    assert [r.n for r in rows] == [r.p for r in rows]


def test_norms_of_ascii_need_no_pattern(spark):
    from pyspark.sql import functions as F

    from assetgraph.functions.names import entity_norm

    plan = _plan(spark.range(1).select(entity_norm(F.col("id").cast("string"))))
    assert "CASE WHEN" in plan and plan.index("translate") < plan.index("regexp_replace")


def test_tasks_grow_with_the_texts(spark):
    from assetgraph.fixtures import word_tasks

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = spark.createDataFrame([(i, "é" * 50 if i else None) for i in range(41)], "doc_id long, text string")
    assert word_tasks(spark, texts, 100) == max(least, 40) and word_tasks(spark, texts, 1) == 4000
    assert word_tasks(spark, texts) == word_tasks(spark, texts.limit(0)) == least
