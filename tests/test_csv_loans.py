import gzip
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from riskframe.plans import adapters as A
from riskframe.plans.catalog import QUERIES
from riskframe.session import CHECKPOINT_CONF


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """400 orders of one to seven line items; some keys repeat, some are null."""
    root = str(tmp_path_factory.mktemp("loans"))
    day = datetime(1996, 3, 1)
    frames = {
        "nation": ([(k, f"NATION {k}", 0) for k in range(5)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(k, f"Customer#{k:09d}", k % 5, 100.0 * k, "BUILDING") for k in range(40)],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(k % 390 if k != 7 else None, k % 40, "FOP"[k % 3], 1000.0 + k, day + timedelta(days=k), "1-URGENT")
                    for k in range(400)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
                   "o_orderpriority string"),
        "lineitem": ([(k if k != 9 else None, 1, 1, n, 3.0 + n, 500.0 + k, 0.05, 0.02, "RAN"[n % 3], "FO"[n % 2],
                       day + timedelta(days=k + n)) for k in range(400) for n in range(1 + k % 7)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                     "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                     "l_shipdate timestamp_ntz"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return root


def counted(df):
    return Counter(map(tuple, df.collect()))


def test_turns_are_all_loads_once(spark, tables):
    whole, turns = counted(A.loads(spark, tables)), [counted(A.loads(spark, tables, (i, 3))) for i in range(3)]
    assert sum(turns, Counter()) == whole and all(turns)
    assert not {r[0] for r in turns[0]} & {r[0] for r in turns[1]}


def test_csv_of_loans_is_packed_and_whole(spark, tables):
    shared = Path(spark.conf.get(CHECKPOINT_CONF))
    before = set(shared.rglob("loads-*"))
    got = QUERIES["csv_loans"](spark, tables)
    assert counted(got) == counted(QUERIES["clean_loans"](spark, tables))
    (path,) = set(shared.rglob("loads-*")) - before
    files = list(path.glob("part-*"))
    text = sum(len(gzip.decompress(f.read_bytes()) if f.suffix == ".gz" else f.read_bytes()) for f in files)
    assert sum(f.stat().st_size for f in files) < text / 2


def test_csv_of_loans_leaves_no_shuffle_files(spark, tables, monkeypatch):
    # a join of small tables would not shuffle
    monkeypatch.setattr(A, "loads", lambda *a, loads=A.loads: loads(*a).repartition(4, "loan_id"))
    jvm = spark.sparkContext._jvm
    tracker = jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    left = tracker.shuffleStatuses().size()
    QUERIES["csv_loans"](spark, tables)
    assert tracker.shuffleStatuses().size() <= left
