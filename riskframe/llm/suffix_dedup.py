"""Removal of byte strings that start more than once, by bucket-pointer refinement.

Every position is a suffix start; two positions repeat each other when their first ``LENGTH`` bytes are
equal.  Positions begin in buckets of equal ``GRAM``-byte strings.  A bucket is refined by the
identifiers of the buckets that its members' later offsets (GRAM, 2 GRAM, …) lie in, and the refined
identifiers are used again for the next, longer comparison; positions left alone in a bucket are
done.  Identifiers are two 64-bit fingerprints of the bytes, so a task knows the bucket of any later
offset of a text it holds, and no pointer has to be looked up across the cluster.

Only few positions are sent around:

1. the window of a position starts with GRAM-byte strings at LENGTH - GRAM + 1 offsets; the one with the
   smallest fingerprint is its anchor.  Equal strings have their anchor at the same place, and
   neighbouring positions share anchors, so there is about one per 150 bytes.  Anchors alone in
   their bucket end all their positions.
2. the positions of an anchor are refined in blocks of ``BLOCK``: the bytes all of a block's strings
   have in common (core), and all bytes they cover (hull).  A core alone in its bucket ends the block;
   a hull in company repeats as a whole.
3. blocks that share their core but not the hull are refined position by position.  A block that
   repeats as a whole takes part once, as a partner.

Texts are laid out once in a table bucketed by row number, so no later step moves them again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.text import whole
from riskframe.session import cut_lineage, ensure_checkpoint_dir

LENGTH = 400
GRAM = 96
BLOCK = 64
CHUNK = 1 << 20
_POSITION = np.uint64((1 << 21) - 1)
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Grams:
    """Fingerprints of all GRAM-byte strings of a byte array, and of longer strings made of them."""

    _rng = np.random.default_rng(20240)
    _tables = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64)
    _bases = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
    _mult = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))

    def __init__(self, data: np.ndarray, both: bool = True) -> None:
        self.ids = [self._grams(data, side) for side in range(2 if both else 1)]

    @classmethod
    def _mix(cls, x: np.ndarray, side: int) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * cls._mult[side]
        return x ^ (x >> np.uint64(29))

    @classmethod
    def _grams(cls, data: np.ndarray, side: int) -> np.ndarray:
        power = lambda n: np.uint64(pow(cls._bases[side], n, 1 << 64))
        h = cls._tables[side][data]
        length = 1
        while length < GRAM // 3:
            h = h[:-length] * power(length) + h[length:]
            length *= 2
        third = GRAM // 3
        two = h[:-third] * power(third) + h[third:]
        return cls._mix(two[:-third] * power(third) + h[2 * third:], side)

    def longer(self, starts: np.ndarray, lengths: np.ndarray | int, salt: np.ndarray | int = 0) -> list[np.ndarray]:
        """Identifiers of the strings at ``starts``: the bucket of the start refined by those behind it."""
        out = []
        most = int(np.max(lengths)) if np.size(lengths) else LENGTH
        for side, ids in enumerate(self.ids):
            acc = ids[starts] + np.asarray(salt).astype(np.uint64) * self._mult[side]
            for offset in range(GRAM, most - GRAM + 1, GRAM):
                acc = self._mix(acc * self._mult[1 - side] + ids[starts + np.minimum(offset, lengths - GRAM)], side)
            acc = self._mix(acc * self._mult[1 - side] + ids[starts + (lengths - GRAM)], side)
            out.append(acc.view(np.int64))
        return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    length = 1
    while 2 * length <= width:
        x = np.minimum(x[:-length], x[length:])
        length *= 2
    rest = width - length
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _chunks(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first position, bytes) pieces that hold every position with LENGTH bytes exactly once."""
    positions = len(data) - LENGTH + 1
    for at in range(0, max(positions, 0), CHUNK):
        yield at, data[at:min(at + CHUNK, positions) + LENGTH - 1]


def anchors(data: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(identifier, anchor, first d, last d) per chunk: positions anchor - d have this anchor."""
    out = []
    for at, part in _chunks(data):
        ids = Grams(part, both=False).ids[0]
        packed = (ids & ~_POSITION) | np.arange(len(ids), dtype=np.uint64)
        anchor = (_sliding_min(packed, LENGTH - GRAM + 1) & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        a = anchor[first]
        out.append((ids[a].view(np.int64), a + at, a - last, a - first))
    return out


def _pieces(values: list[np.ndarray], schema: pa.Schema, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(values[0]), rows):
        yield pa.record_batch([pa.array(v[at:at + rows], f.type) for v, f in zip(values, schema)], schema=schema)


def _bytes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_py() or b"", np.uint8)


def _ranges(anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors with their d-ranges cut at multiples of BLOCK: (block, anchor, low, high)."""
    first, n = low // BLOCK, high // BLOCK - low // BLOCK + 1
    row = np.repeat(np.arange(len(anchor)), n)
    block = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return block, anchor[row], np.maximum(low[row], block * BLOCK), np.minimum(high[row], block * BLOCK + BLOCK - 1)


def _lay_out(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Numbered texts as bytes, bucketed by number."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"),
                       whole(F.col(text).cast("string")).cast("binary").alias("data"))
    (rows.repartition(buckets, "rid").write.bucketBy(buckets, "rid").option("compression", "zstd")
     .option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


def _with_text(texts: DataFrame, per_row: DataFrame) -> DataFrame:
    """Bytes beside a row's items; only the items are shuffled."""
    return texts.select("rid", "data").join(per_row.hint("merge"), "rid")


def _anchor_rows(texts: DataFrame) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("anchor", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[np.ndarray]] = []
            size = 0
            for rid, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for ids, anchor, low, high in anchors(_bytes(data)):
                    held.append([ids, np.full(len(ids), rid), anchor, low, high])
                    size += len(ids)
                if size > 100_000:
                    yield from _pieces([np.concatenate(c) for c in zip(*held)], schema)
                    held, size = [], 0
            if held:
                yield from _pieces([np.concatenate(c) for c in zip(*held)], schema)

    return texts.select("rid", "data").mapInArrow(run, "id long, rid long, anchor long, low int, high int")


def _block_rows(joined: DataFrame) -> DataFrame:
    """Core and hull identifiers of the blocks of (rid, data, items: anchor, low, high)."""
    schema = pa.schema([("core1", pa.int64()), ("core2", pa.int64()), ("hull1", pa.int64()), ("hull2", pa.int64()),
                        ("rid", pa.int64()), ("first", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, value, items in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data, rows = _bytes(value), items.values
                anchor, low, high = (rows.field(k).to_numpy().astype(np.int64) for k in ("anchor", "low", "high"))
                order = np.argsort(anchor - high)
                anchor, low, high = anchor[order], low[order], high[order]
                begin = anchor - high
                for at, part in _chunks(data):
                    some = (begin >= at) & (begin < at + CHUNK)
                    if not some.any():
                        continue
                    grams = Grams(part)
                    block, a, lo, hi = _ranges(anchor[some] - at, low[some], high[some])
                    core = grams.longer(a - block * BLOCK, LENGTH - BLOCK + 1, block)
                    hull = grams.longer(a - hi, LENGTH + hi - lo, hi * LENGTH + lo)
                    yield from _pieces([*core, *hull, np.full(len(a), rid), a - hi + at, hi - lo + 1], schema)

    return joined.select("rid", "data", "items").mapInArrow(
        run, "core1 long, core2 long, hull1 long, hull2 long, rid long, first long, n int")


def _position_rows(joined: DataFrame) -> DataFrame:
    """Identifiers of single positions of (rid, data, items: first, n, asks)."""
    schema = pa.schema([("id1", pa.int64()), ("id2", pa.int64()), ("rid", pa.int64()), ("first", pa.int64()), ("asks", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, value, items in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data, rows = _bytes(value), items.values
                first, n = (rows.field(k).to_numpy().astype(np.int64) for k in ("first", "n"))
                asks = rows.field("asks").to_numpy(zero_copy_only=False)
                for at, part in _chunks(data):
                    some = (first >= at) & (first < at + CHUNK)
                    if not some.any():
                        continue
                    f, m = first[some] - at, n[some]
                    x = np.repeat(f, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    yield from _pieces([*Grams(part).longer(x, LENGTH), np.full(len(x), rid), x + at,
                                        np.repeat(asks[some], m)], schema)

    return joined.select("rid", "data", "items").mapInArrow(
        run, "id1 long, id2 long, rid long, first long, asks boolean")


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(rid, first, n): runs of positions whose LENGTH bytes start somewhere else as well."""
    found = cut_lineage(_anchor_rows(texts))
    shared = found.groupBy("id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("id")
    live = found.join(shared, "id").groupBy("rid").agg(F.collect_list(F.struct("anchor", "low", "high")).alias("items"))
    blocks = cut_lineage(_block_rows(_with_text(texts, live)))

    core, hull = ["core1", "core2"], ["hull1", "hull2"]
    classes = blocks.groupBy(*core, *hull).agg(F.count(F.lit(1)).alias("members"),
                                               F.min(F.struct("rid", "first", "n")).alias("one"))
    classes = cut_lineage(classes)
    whole_blocks = blocks.join(classes.where("members > 1").select(*core, *hull), [*core, *hull]).select("rid", "first", "n")
    # cores with different hulls: each class is refined once, those of one member ask for themselves
    mixed = classes.groupBy(*core).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*core)
    open_blocks = classes.join(mixed, core).select("one.*", (F.col("members") == 1).alias("asks"))
    items = open_blocks.groupBy("rid").agg(F.collect_list(F.struct("first", "n", "asks")).alias("items"))
    positions = cut_lineage(_position_rows(_with_text(texts, items)))
    twice = positions.groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("id1", "id2")
    single = positions.where("asks").join(twice, ["id1", "id2"]).select("rid", "first", F.lit(1).alias("n"))
    return whole_blocks.unionByName(single)


def spans(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs [begin, end) of position runs; bytes that touch form one run."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], (first + n - 1 + LENGTH)[order]
    reach = np.maximum.accumulate(end)
    cut = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
    return begin[cut], reach[np.concatenate([cut[1:], [len(begin)]]) - 1]


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are judged as UTF-8 bytes, NULL as empty; texts under LENGTH bytes lose nothing.  Rows are
    told apart by their place, so repeated rows repeat each other.  An empty table gives an empty
    result; other columns are not read.
    """
    texts = _lay_out(docs, text, doc_id)
    ranges = repeated_ranges(texts).groupBy("rid").agg(F.collect_list(F.struct("first", "n")).alias("items"))
    joined = texts.join(ranges.hint("merge"), "rid", "left").select("doc_id", "data", "items")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, value, items in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data, removed, count = value.as_py() or b"", 0, 0
                digest, at = hashlib.sha256(), 0
                if items.is_valid:
                    rows = items.values
                    begin, end = spans(rows.field("first").to_numpy(), rows.field("n").to_numpy())
                    removed, count = int((end - begin).sum()), len(begin)
                    for b, e in zip(begin.tolist(), end.tolist()):
                        digest.update(data[at:b])
                        at = e
                digest.update(data[at:])
                out.append((doc, len(data), removed, count, digest.hexdigest()))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else
                                  [pa.array([], f.type) for f in schema], schema=schema)

    return joined.mapInArrow(run, RESULT_SCHEMA)
