"""Session helpers: builder defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# the JVM never compiles methods above 8000 bytes of code: wide projections (typed CSV rows, candidates)
# run three times faster when Spark splits them instead of fusing one huge method
METHOD_LIMIT = {"spark.sql.codegen.hugeMethodLimit": "8000"}
# Spark removes a statement's shuffle files when it ends, not only when the JVM happens to collect their owner
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "riskframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; cluster settings win when already set."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    submitted = spark.sparkContext.getConf()
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **METHOD_LIMIT,
    }
    for key, value in defaults.items():
        if key not in conf and not submitted.contains(key):
            spark.conf.set(key, value)
    return spark


def split_huge_methods(spark: SparkSession) -> None:
    """The method limit for a session made elsewhere, unless the cluster sets its own."""
    submitted = spark.sparkContext.getConf()
    for key, value in METHOD_LIMIT.items():
        if not submitted.contains(key):
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder named by the cluster; a temporary one only when none is configured."""
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="riskframe-ckpt-"))
    return sc.getCheckpointDir()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Statements run inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read back.

    The result survives the loss of executors, is never recomputed, and stays columnar: each
    consumer reads only the columns it needs.  The shuffle files behind it are removed.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
