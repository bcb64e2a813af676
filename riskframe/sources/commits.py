"""Tables with optimistic commits: a log of version files, key-bucketed data, appended runs.

Writers put data into folders nobody else uses and then claim the next version by renaming a finished
file to its name, which fails when another writer has claimed it.  The loser looks at what changed: if
that does not touch its own buckets it claims the version after, else it merges again on the newer rows.
Every commit carries its run id, so a retried job or a replayed micro-batch changes nothing.

The rename is atomic on HDFS and on stores with such a rename; a store without one needs a lock around it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskframe.operators.snapshot import merge_latest
from riskframe.operators.upsert import upsert

N_BUCKETS = 64
ATTEMPTS = 20
PATHS_AT_ONCE = 2_000


class Conflict(RuntimeError):
    """Other writers kept changing the same buckets."""


class CommitLog:
    """Version files ``<path>/commits/<12 digits>.json``, one JSON line each."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, f"{path}/commits"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path, self._rename = hadoop.Path, hadoop.Options.Rename
        self._fs = hadoop.Path(path).getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(self._fs.getUri(), conf)

    def _file(self, version: int) -> str:
        return f"{self.folder}/{version:012d}.json"

    def last(self) -> int:
        """Newest version, 0 before the first."""
        if not self._fs.exists(self._path(self.folder)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return max((int(n[:12]) for n in names if re.fullmatch(r"\d{12}\.json", n)), default=0)

    def read(self, version: int) -> dict:
        stream = self._fs.open(self._path(self._file(version)))
        try:
            size = self._fs.getFileStatus(self._path(self._file(version))).getLen()
            content = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)
        finally:
            stream.close()
        return json.loads(bytes(content).decode())

    def claim(self, version: int, entry: dict) -> bool:
        """Make ``entry`` the given version; False when that is taken."""
        made = self._path(f"{self.folder}/.tmp-{uuid.uuid4().hex}")
        stream = self._fs.create(made, False)
        try:
            stream.write((json.dumps(entry | {"version": version}) + "\n").encode())
        finally:
            stream.close()
        try:
            self._context.rename(made, self._path(self._file(version)), self._no_overwrite())
            return True
        except Exception as error:
            if "FileAlreadyExistsException" not in str(error):
                raise
            self._fs.delete(made, False)
            return False

    def _no_overwrite(self):
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(self._rename, 1)
        options[0] = self._rename.NONE
        return options

    def rows(self) -> DataFrame:
        """(version, run_id, folder) of all commits."""
        return self.spark.read.schema("version long, run_id string, folder string").json(self.folder)

    def version_of(self, run_id: str) -> int | None:
        """Version that a run has committed, or None."""
        if not self.last():
            return None
        row = self.rows().where(F.col("run_id") == run_id).agg(F.min("version")).first()
        return row[0]


Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Staged:
    """Written buckets that are not committed yet."""

    run_id: str
    base: int
    folder: str
    touched: frozenset[int]
    schema: str


class BucketTable:
    """Rows by key hash in ``n_buckets`` buckets; a merge reads and rewrites only the buckets of its keys.

    Choose the number so that a bucket fits a task; it is fixed by the first commit.  A version lists the folder
    of each bucket, so older versions stay readable.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], n_buckets: int = N_BUCKETS) -> None:
        self.spark, self.path, self.keys, self.n_buckets = spark, path, list(keys), n_buckets
        self.log = CommitLog(spark, path)
        if version := self.log.last():
            first = self.log.read(version)
            if first["keys"] != self.keys:
                raise ValueError(f"the table's keys are {first['keys']}")
            self.n_buckets = first["n_buckets"]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n_buckets)).cast("int")

    def _entry(self, version: int) -> dict:
        return self.log.read(version) if version else {"buckets": {}, "schema": None}

    def _rows(self, entry: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of a version's buckets (all by default)."""
        schema = StructType.fromJson(json.loads(entry["schema"]))
        chosen = sorted(entry["buckets"], key=int) if buckets is None else [str(b) for b in buckets if str(b) in entry["buckets"]]
        paths = [f"{self.path}/data/{entry['buckets'][b]}/bucket={b}" for b in chosen]
        if not paths:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(*paths[at:at + PATHS_AT_ONCE]) for at in range(0, len(paths), PATHS_AT_ONCE)]
        return reduce(DataFrame.unionByName, parts)

    def read(self, version: int | None = None) -> DataFrame | None:
        """Rows of a version (the newest by default), or None before the first commit."""
        version = self.log.last() if version is None else version
        return self._rows(self.log.read(version)) if version else None

    def stage(self, batch: DataFrame, merge: Merge, run_id: str, empty: DataFrame | None = None) -> Staged:
        """Write the merged rows of the batch's buckets.  ``empty`` gives the schema of a new table."""
        base = self.log.last()
        entry = self._entry(base)
        schema = StructType.fromJson(json.loads(entry["schema"])) if base else (batch if empty is None else empty).schema
        # keys hash alike only in one type
        typed = batch.withColumns({k: F.col(k).cast(schema[k].dataType) for k in self.keys})
        # at most one row per bucket
        touched = [r[0] for r in typed.select(self._bucket().alias("b")).distinct().collect()]
        old = self._rows(entry, touched) if base else self.spark.createDataFrame([], schema)
        merged = merge(old, typed).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        folder = uuid.uuid4().hex
        placed = merged.withColumn("bucket", self._bucket())
        placed.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        return Staged(run_id, base, folder, frozenset(touched), schema.json())

    def commit(self, staged: Staged) -> int | None:
        """Version under which the staged buckets are current, or None if others changed one of them since."""
        version = staged.base
        while True:
            entry = self._entry(version)
            for newer in range(version + 1, self.log.last() + 1):
                entry = self.log.read(newer)
                if entry["run_id"] == staged.run_id:
                    return newer
                if staged.touched & set(entry["changed"]):
                    return None
                version = newer
            buckets = entry["buckets"] | {str(b): staged.folder for b in staged.touched}
            if self.log.claim(version + 1, {
                    "run_id": staged.run_id, "keys": self.keys, "n_buckets": self.n_buckets, "schema": staged.schema,
                    "changed": sorted(staged.touched), "buckets": buckets, "folder": staged.folder,
                    "committed_at": datetime.now(UTC).isoformat()}):
                return version + 1

    def merge(self, batch: DataFrame, merge: Merge, run_id: str | None = None, empty: DataFrame | None = None) -> int:
        """Merge a batch once per run id; the version that holds it."""
        run_id = run_id or uuid.uuid4().hex
        for _ in range(ATTEMPTS):
            if (done := self.log.version_of(run_id)) is not None:
                return done
            if (version := self.commit(self.stage(batch, merge, run_id, empty))) is not None:
                return version
        raise Conflict(f"{ATTEMPTS} attempts to change {self.path}")

    def upsert(self, incoming: DataFrame, update_cols: Sequence[str], order_col: str | None = None, ts_col: str = "loaded_at",
               now: datetime | Column | None = None, on_duplicate: str = "last", run_id: str | None = None) -> int:
        """``operators.upsert.upsert`` on the touched buckets.

        Rows with a NULL key are refused: they would match no row and come again with every batch.
        """
        if not incoming.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in self.keys])).isEmpty():
            raise ValueError("a key is NULL")
        now = now if now is not None else datetime.now(UTC)
        empty = incoming.drop(*([order_col] if order_col else []))
        if ts_col not in empty.columns:
            empty = empty.withColumn(ts_col, F.lit(None).cast("timestamp"))
        return self.merge(incoming, lambda old, batch: upsert(old, batch, self.keys, update_cols, order_col, ts_col, now, on_duplicate),
                          run_id, empty)

    def keep_latest(self, incoming: DataFrame, ts: str, tiebreak: Sequence[str] = (), run_id: str | None = None) -> int:
        """Snapshot merge: the later event time wins, late rows change nothing."""
        if len(self.keys) != 1:
            raise ValueError("a snapshot has one key")
        return self.merge(incoming, lambda old, batch: merge_latest(old, batch, self.keys[0], ts, tiebreak), run_id)


class AppendTable:
    """Runs appended once each: a commit names its run id and its folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.log = spark, path, CommitLog(spark, path)

    def append(self, rows: DataFrame, run_id: str) -> int:
        """Version that holds the run; a run that is there already is not written again."""
        if (done := self.log.version_of(run_id)) is not None:
            return done
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        version = self.log.last()
        while True:
            # whoever claimed a version in between may be this very run on another try
            for newer in range(version + 1, self.log.last() + 1):
                if self.log.read(newer)["run_id"] == run_id:
                    return newer
                version = newer
            if self.log.claim(version + 1, {"run_id": run_id, "folder": folder, "schema": rows.schema.json(),
                                            "committed_at": datetime.now(UTC).isoformat()}):
                return version + 1

    def read(self) -> DataFrame | None:
        """Rows of all committed runs in the newest run's schema, or None before the first."""
        last = self.log.last()
        if not last:
            return None
        schema = StructType.fromJson(json.loads(self.log.read(last)["schema"]))
        # one short row per run
        folders = sorted(r["folder"] for r in self.log.rows().select("folder").collect())
        parts = [self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders[at:at + PATHS_AT_ONCE]])
                 for at in range(0, len(folders), PATHS_AT_ONCE)]
        return reduce(DataFrame.unionByName, parts)
