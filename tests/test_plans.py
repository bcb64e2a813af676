"""Plans wanted at scale, and the rules that stop a run."""

import pytest
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from riskframe.operators import explain as E
from riskframe.operators import models
from riskframe.operators.ordered import exact_quantiles
from riskframe.operators.quality import QualityError
from riskframe.plans import rules
from riskframe.plans.catalog import QUERIES
from riskframe.session import cut_lineage
from riskframe.sources import files

SMOKE = "/root/testdata/sf0.001"


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_quantiles_per_group_share_the_exchange(spark):
    rows = cut_lineage(spark.range(4000).selectExpr("id % 3 as g", "cast(id as double) as v"))
    counts = rows.groupBy("g", "v").count()
    got = exact_quantiles(counts, "v", "count", [0.5], by=["g"])
    assert executed(got).count("FileScan") == 1
    assert sorted(r["quantiles"][0] for r in got.collect()) == [1999.0, 1999.5, 2000.0]


def test_row_attributions_need_no_shuffle(spark):
    rows = cut_lineage(spark.range(50).selectExpr("id", "cast(id as double) as a", "cast(-id as double) as b"))
    maps = E.linear_maps(rows, E.Scorecard(0.0, DenseVector([1.0, 3.0])), rows, ["a", "b"], "id")
    top, records = E.top_attributions(maps, 1), E.attribution_records(maps, "m")
    assert "Exchange" not in executed(top) and "Exchange" not in executed(records)
    assert {r["feature"] for r in top.collect()} == {"b"}


def test_top_attributions_order(spark):
    maps = spark.sql("select 1 as id, map('a', 1D, 'b', -1D, 'c', null, 'd', double('NaN'), 'e', 2D) as attributions, 0D as base_value")
    assert [r["feature"] for r in E.top_attributions(maps, 5).orderBy("rank").collect()] == ["d", "e", "a", "b", "c"]


def test_broken_rules_stop(spark):
    series = spark.sql("select 'A' as series_id, date'2020-01-01' as observation_date, 1D as value union all select 'A', null, 2D")
    with pytest.raises(QualityError, match="raw_series.not_null_observation_date: 1"):
        rules.require(series, "raw_series")
    assert rules.require(series.where("observation_date is not null"), "raw_series").count() == 1
    with pytest.raises(ValueError):
        rules.table_rules("unknown")


def test_queries_split_huge_methods_in_any_session(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "65535")
        QUERIES["clean_loans"](spark, SMOKE)
        assert spark.conf.get(key) == "8000"
    finally:
        spark.conf.set(key, before)


def test_months_are_read_as_the_parser_reads_them(spark):
    texts = ["Jan-2020", "dec-1999", "DEC-1999", "Feb-0000", "Mar-0001", "May-10000", "Jun-99", "XXX-2020", "Jan-2020 ", "Anf-2020", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select(files.month_date(F.col("s")).cast("string").alias("a"), F.try_to_date("s", "MMM-yyyy").cast("string").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[0].a is not None
    # plainly written months do not reach the parser
    plan = df.select(files.month_date(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert "make_date" in plan


def test_training_reads_written_rows(spark, monkeypatch):
    seen = {}

    def fit(train, *args):
        seen["fit"] = train
        return fit_model(train, *args)

    def measure(scored, *args):
        seen["metrics"] = scored
        return scored

    fit_model = models.fit_model
    monkeypatch.setattr(models, "fit_model", fit)
    monkeypatch.setattr(models, "extended_metrics", measure)
    rows = spark.range(80).selectExpr("date_add(date'2020-01-01', cast(id as int)) as issue_d", "cast(id * 7 % 11 as double) as x",
                                      "cast(id % 3 as string) as c", "cast(id % 2 as int) as is_default")
    models.run_training(rows, "logistic_regression", {"maxIter": 3}, target="is_default", cutoff="2020-02-15", numeric=["x"], categorical=["c"])
    for df in seen.values():
        # neither imputed nor coded again in each pass, and not held in memory beside the fitter's own copy
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString() and not df.is_cached
