"""As-of join against a plain search, with a key that holds half of all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskframe.operators.asof import asof_join, get_features_at

START = datetime(2024, 1, 1)


def at(n):
    return None if n is None else START + timedelta(hours=n)


def brute(asked, old, ttl):
    out = []
    for n, k, t in asked:
        fit = [(s, tie, v) for key, s, tie, v in old if k is not None and t is not None and key == k and s is not None and s <= t]
        s, _, v = max(fit, key=lambda r: (r[0], -1 if r[1] is None else r[1])) if fit else (None, None, None)
        out.append((n, v, s) if s is not None and (ttl is None or s >= t - ttl) else (n, None, None))
    return sorted(out)


@pytest.mark.parametrize("ttl", [None, 9])
def test_equals_a_plain_search(spark, ttl):
    rng = random.Random(2)
    def key():
        return "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", "none", None])

    old = [(k if k != "none" else "d", at(rng.choice([*range(200), None])), i, None if i % 17 == 0 else f"v{i}")
           for i, k in enumerate(key() for _ in range(700))]
    asked = [(i, k, at(rng.choice([*range(-5, 205), None]))) for i, k in enumerate(key() for _ in range(500))]
    history = spark.createDataFrame(old, "k string, s timestamp, tie int, v string")
    requests = spark.createDataFrame(asked, "n int, k string, t timestamp")
    limit = None if ttl is None else timedelta(hours=ttl)
    got = asof_join(requests, history, "k", "t", "s", ["v"], ["tie"], limit, "seen", n_ranges=16).select("n", "v", "seen").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == brute(asked, old, limit)


def test_hot_key_is_spread_and_meets_its_history_ranges_back(spark):
    # one history row far before thousands of requests of its key: it is carried over many ranges
    history = spark.createDataFrame([(1, at(0), "x"), (2, at(5000), "y")], "k long, s timestamp, v string")
    requests = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).cast("long").alias("k"),
        F.timestamp_seconds(F.lit(START.timestamp()) + 3600 * (F.col("id") + 1)).alias("t"))
    got = asof_join(requests, history, "k", "t", "s", ["v"], n_ranges=12)
    counts = {r.v: r["count"] for r in got.groupBy("v").count().collect()}
    assert counts == {"x": 2001, None: 1999}  # the odd id 1 asks for the same key
    dealt = requests.repartitionByRange(12, "k", "t").groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).first()[0] < 1000


def test_edges(spark):
    history = spark.createDataFrame([(1, at(0), 5.0)], "id long, s timestamp, loan_amnt double")
    requests = spark.createDataFrame([(1, at(1)), (1, at(1)), (1, at(24 * 4000)), (None, at(1)), (3, None)], "id long, t timestamp")
    got = get_features_at(requests, history, "id", "t", "s", ["loan_features:loan_amnt"]).collect()
    assert sorted((str(r.id), r.loan_amnt) for r in got if r.loan_amnt) == [("1", 5.0), ("1", 5.0)] and len(got) == 5
    assert get_features_at(requests.limit(0), history, "id", "t", "s").count() == 0
    assert get_features_at(requests, history.limit(0), "id", "t", "s").where("loan_amnt is not null").count() == 0
    with pytest.raises(ValueError):
        asof_join(requests, history.withColumn("t", F.lit(1)), "id", "t", "s", ["t"])
    with pytest.raises(ValueError):
        get_features_at(requests, history, "id", "t", "s", ["loan_features:purpose"])
