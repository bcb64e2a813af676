"""Exact dedup on a cuckoo-filter index of live digests.

A ``CuckooIndex`` holds one live document per digest.  Its filter is an array of short
fingerprints in buckets of four; content (digest, document, count) is stored in the same bucket and
slot, so a filter hit is verified against the stored content of at most eight slots.  Entries can be
inserted and deleted; when an insertion finds no place the index doubles and is filled again from
its stored keys.

On Spark the index is built twice by the same code: each map task folds its own rows into a local
index and sends one row per digest it saw (a group that holds a third of the table sends one row per
task), and after the shuffle each digest partition folds those rows into its part of the global index.
Every document then looks its group up by digest in a join whose hot keys Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.text import whole

SLOTS = 4
MAX_KICKS = 200
_MIX = 0x5BD1E995
INDEX_SCHEMA = "digest binary, keep_id long, group_size long"
_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


class CuckooIndex:
    """Live digests with insertion, deletion, verified lookup and resizing."""

    def __init__(self, buckets: int = 1024) -> None:
        self.mask = buckets - 1
        self.size = 0
        self.resizes = 0
        self.fingerprints = [0] * (buckets * SLOTS)
        self.content: list[tuple | None] = [None] * (buckets * SLOTS)

    @staticmethod
    def _hash(key: bytes) -> tuple[int, int]:
        # keys are digests: their own bytes are uniform
        return int.from_bytes(key[:8], "little"), int.from_bytes(key[8:10], "little") or 1

    def _other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ (fingerprint * _MIX)) & self.mask

    def _find(self, key: bytes) -> int:
        """Slot that holds ``key``, -1 when absent: fingerprints first, stored content on a hit."""
        h, fp = self._hash(key)
        first = h & self.mask
        for bucket in (first, self._other(first, fp)):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.fingerprints[slot] == fp and self.content[slot][0] == key:
                    return slot
        return -1

    def get(self, key: bytes) -> tuple | None:
        slot = self._find(key)
        return None if slot < 0 else self.content[slot]

    def insert(self, key: bytes, doc: int | None, count: int) -> None:
        """Add a digest that is not live; doubles the index when no place is found."""
        entry = (key, doc, count)
        while True:
            entry = self._place(entry)
            if entry is None:
                self.size += 1
                return
            self._resize()

    def delete(self, key: bytes) -> bool:
        slot = self._find(key)
        if slot < 0:
            return False
        self.fingerprints[slot], self.content[slot] = 0, None
        self.size -= 1
        return True

    def _place(self, entry: tuple) -> tuple | None:
        """Put an entry in place; the entry left over when the kicks run out, else None."""
        h, fp = self._hash(entry[0])
        bucket = h & self.mask
        for candidate in (bucket, self._other(bucket, fp)):
            for slot in range(candidate * SLOTS, candidate * SLOTS + SLOTS):
                if not self.fingerprints[slot]:
                    self.fingerprints[slot], self.content[slot] = fp, entry
                    return None
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick + fp) % SLOTS
            moved_fp, moved = self.fingerprints[slot], self.content[slot]
            self.fingerprints[slot], self.content[slot] = fp, entry
            fp, entry = moved_fp, moved
            bucket = self._other(bucket, fp)
            for free in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.fingerprints[free]:
                    self.fingerprints[free], self.content[free] = fp, entry
                    return None
        return entry

    def _resize(self) -> None:
        """Double until every stored key has a place."""
        stored = [e for e in self.content if e is not None]
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self.mask = buckets - 1
            self.fingerprints = [0] * (buckets * SLOTS)
            self.content = [None] * (buckets * SLOTS)
            if all(self._place(e) is None for e in stored):
                return

    def offer(self, key: bytes, doc: int | None, count: int = 1) -> None:
        """Fold a document in: the largest id of a digest is the live one, counts add up."""
        live = self.get(key)
        if live is None:
            self.insert(key, doc, count)
            return
        _, old, n = live
        keep = doc if old is None or (doc is not None and doc > old) else old
        self.delete(key)
        self.insert(key, keep, n + count)

    def entries(self) -> Iterator[tuple]:
        return (e for e in self.content if e is not None)


def _emit(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.entries())
    for at in range(0, len(rows), 50_000):
        keys, docs, counts = zip(*rows[at:at + 50_000])
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(docs, pa.int64()),
                               pa.array(counts, pa.int64())], schema=_ARROW)


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, keep_id, group_size) of a task, folded into one index and written out."""
    index = CuckooIndex()
    for batch in batches:
        for key, doc, count in zip(*(batch.column(i).to_pylist() for i in range(3))):
            index.offer(key, doc, count)
    yield from _emit(index)


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest): SHA-256 of the whole text in UTF-8, NULL as empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.unhex(F.sha2(whole(text).cast("binary"), 256)).alias("digest"))


def build_index(rows: DataFrame) -> DataFrame:
    """Global index (digest, keep_id, group_size) of (doc_id, digest) rows."""
    single = rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    local = single.mapInArrow(_fold, INDEX_SCHEMA)
    return local.repartition("digest").mapInArrow(_fold, INDEX_SCHEMA)


def apply_changes(index: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """The index after deleting and then inserting live digests.

    ``deletes`` holds digests (absent ones are ignored), ``inserts`` (doc_id, digest) rows.  Each
    digest partition loads its stored keys into a cuckoo index and applies its changes there.
    """
    old = index.select("digest", "keep_id", "group_size", F.lit(0).alias("step"))
    gone = deletes.select("digest", F.lit(None).cast("long").alias("keep_id"),
                          F.lit(0).cast("long").alias("group_size"), F.lit(1).alias("step"))
    new = (inserts.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
           .mapInArrow(_fold, INDEX_SCHEMA).withColumn("step", F.lit(2)))
    rows = old.unionByName(gone.distinct()).unionByName(new)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = CuckooIndex()
        for batch in batches:
            for key, doc, count, step in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if step == 1:
                    live.delete(key)
                else:
                    live.offer(key, doc, count)
        yield from _emit(live)

    return rows.repartition("digest").sortWithinPartitions("step").mapInArrow(run, INDEX_SCHEMA)


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; NULL counts as empty.  Of equal texts the largest doc_id stays, a
    NULL id is smaller than any other.  Rows that repeat both id and text get the same answer, and
    each counts in group_size.  An empty table gives an empty result; other columns are not read.
    """
    rows = digests(docs, text, doc_id)
    found = build_index(rows).withColumnRenamed("digest", "__digest")
    return rows.join(found, F.col("digest") == F.col("__digest")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, all their columns; of rows repeating id and text one stays."""
    # plain equal keys, so that the join's partitioning also serves the removal of repeated rows
    keys = ["__digest", "__id", "__no_id"]
    known, unknown = F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), F.col(doc_id).isNull()
    live = build_index(digests(docs, text, doc_id)).select(
        F.col("digest").alias("__digest"), F.coalesce("keep_id", F.lit(0)).cast("long").alias("__id"),
        F.col("keep_id").isNull().alias("__no_id"))
    tagged = docs.withColumns({"__digest": F.unhex(F.sha2(whole(text).cast("binary"), 256)),
                               "__id": known, "__no_id": unknown})
    return tagged.join(live, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
