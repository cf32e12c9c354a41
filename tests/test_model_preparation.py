"""Statistics of the preparation are worked out once, not by every job that uses the rows."""

from pyspark.sql import functions as F

from vigilo.operators import ml as ML


def rows(spark):
    return spark.createDataFrame([(1, 1.0, None, "b", "x", 1), (2, None, 4, "a", None, 1), (3, 5.0, 2, None, "y", 1), (4, None, None, None, None, 0)],
                                 "id long, p double, q int, c string, d string, train int")


def test_imputed_values_are_known_before_a_later_job(spark):
    d = rows(spark)
    fit = d.where("train = 1")
    out = ML.impute_mode(ML.impute_median(d, fit, ["p", "q"]), fit, ["c", "d"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" not in plan
    assert [tuple(r) for r in out.orderBy("id").select("p", "q", "c", "d").collect()] == [(1.0, 3.0, "b", "x"), (3.0, 4.0, "a", "x"), (5.0, 2.0, "a", "y"), (3.0, 3.0, "a", "x")]
    nothing = fit.withColumns({"p": F.lit(None).cast("double"), "c": F.lit(None).cast("string")})
    assert ML.impute_mode(ML.impute_median(d, nothing, ["p"]), nothing, ["c"]).where("id = 4 and p is null and c is null").count() == 1


def test_all_columns_are_indexed_by_one_stage():
    assert len(ML.onehot_stages(["a", "b", "c"])) == 2 and ML.onehot_stages([]) == []
