"""Lists and pairs that are longer than in the small tables."""

import duckdb
from oracles import spark_rows, sql_rows

from assetgraph.operators.drawings import owned
from assetgraph.plans.registry import ORACLE, QUERIES
from assetgraph.scratch import saved


def test_time_series_of_many_columns_have_all_their_fields(spark, tmp_path):
    at = f"{tmp_path}/part.parquet"
    con = duckdb.connect()
    con.execute(f"copy (select i * 6 + 5 as p_partkey, 'n' as p_name, 'b' as p_brand, 't' as p_type, cast(9 as int) as p_size, 1.0::double as p_retailprice from range(150) r(i)) to '{at}' (format parquet)")
    con.execute(f"create view part as select * from '{at}'")
    assert spark_rows(QUERIES["q_fields_timeseries"](spark, str(tmp_path))) == sql_rows(con, ORACLE["q_fields_timeseries"])


def test_pairs_of_dimensions_and_owners_are_not_shuffled(spark):
    dims = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "x"), (3, "f"), (4, None)], "dim long, ref string")
    targets = spark.createDataFrame([("a", f"o{i}") for i in range(9000)] + [("b", "o1"), ("b", "o1"), ("b", "z")], "ref string, owner string")
    features = spark.createDataFrame([("f", "b", "up")], "ref string, parent string, name string")
    found, lost = owned(dims, targets, features, "dim", "ref", saved)
    rows = [(r.dim, r.owner, r.feature) for r in found.collect()]
    want = {(1, f"o{i}", None) for i in range(9000)} | {(1, "z", None), (2, "o1", None), (2, "z", None), (3, "o1", "up"), (3, "z", "up")}
    assert len(rows) == len(want) and set(rows) == want
    assert sorted((r.dim, r.feature) for r in lost.collect()) == [(3, None), (4, None)]
    # one reference each: what is joined is not grouped again
    single, _ = owned(dims.where("dim = 2"), targets, features, "dim", "ref", saved)
    plan = single._jdf.queryExecution().executedPlan().toString().split("\n")
    assert plan[1].strip() == "+- Union" and plan[2].strip().startswith(":- Project")
