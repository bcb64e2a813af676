"""Jaccard self-join of documents on word n-grams, as a blocked sparse matrix product.

The document by n-gram incidence matrix A gives the overlaps of all pairs as A x A^T.  The product is
taken column by column, and only the columns that a linked pair must share are multiplied: with
similarity t, a pair overlaps by at least t times the larger set, so among the first n - ceil(t n) + 1
n-grams of both (in one common order) there is one they share.  The order puts n-grams seen often
last, so that these columns are short.

* Documents with equal sets are one row of the matrix (a class), so copies never multiply.
* A leader round comes first: in every column a node meets one leader, overlaps are accumulated per
  (node, leader), pairs below the bounds are discarded, and each node compares its full row with the leader
  it shares most columns with.
* What is left are pairs across components.  Their columns are multiplied in blocks of rows inside tasks,
  and a pair is found only when its sizes, its place in the common order and its parity vectors allow the
  overlap that it needs.  A task that finds more pairs than nodes gives one pair for each node, with the
  component that leads in this turn, and names the columns it found pairs in; when these are compared,
  components have grown and the product of those columns is taken again.  So a turn makes about a pair a node,
  and a group of near copies becomes one component in pairs that grow with its size.  The last turn gives
  every pair that no turn compared, however many.
* Two texts meet at one of them, so a text is shuffled once a pair, compressed, and n-grams are made where they
  are compared.  Other texts stay where they are: a bitmap of the asked keys (``SLOTS`` bits a key) is told to all tasks.
* The order only steers the cost, any order gives the same links: frequent n-grams are those that
  scan tasks saw repeatedly, and at most ``MAX_FREQUENT`` of them are told to all tasks.

N-grams are 64-bit fingerprints, sets are compared by 128-bit digests.  A parity vector has one bit for
each of ``BITS`` hash buckets, set when the set has an odd number of n-grams there: two sets differ in at
least as many n-grams as their vectors differ in bits, which bounds their overlap from above.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.components import components
from riskframe.llm.text import split_words
from riskframe.session import cut_lineage

WORDS = 5
PERCENT = 75
BITS = 512
ROUNDS = 10
BLOCK = 4096
FREQUENT_FROM = 8
MAX_FREQUENT = 1 << 18
TASK_GRAMS = 3_000_000
BUFFER = 500_000
HUB = 256  # texts that one task compares with the same other text
PAIRS = 1 << 20  # pairs that a product holds before it drops those found before
SLOTS = 32  # bits of the key bitmap for each key, at least
MORE = 16  # pairs a node that a task may give grow by this factor from turn to turn, so that they end
PAGE = 15  # a row of the bitmap has 2^15 bits
_K = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct fingerprints of each text's n-grams (all words when there are fewer)."""
    names, numbers, bounds = split_words(texts, lower=True)
    ids = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)[numbers]

    def mixed(of: np.ndarray, width: int) -> np.ndarray:
        n = len(of) - width + 1
        h = np.full(max(n, 0), width, np.uint64)
        for k in range(width if n > 0 else 0):
            h = (h ^ of[k:k + n]) * _K
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    every = mixed(ids, words)  # those across two texts are in no slice
    out = []
    for i, j in zip(bounds.tolist(), bounds[1:].tolist()):
        h = every[i:j - words + 1] if j - i >= words else mixed(ids[i:j], max(j - i, 1))
        out.append(np.unique(h))
    return out


def _slices(batch: pa.RecordBatch, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def parity(grams: np.ndarray) -> np.ndarray:
    """``BITS`` parities of the n-gram counts by bucket, as 64-bit words."""
    odd = np.bincount(grams & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def node(key: bytes) -> int:
    """Short name of a class in candidate rows; links are made between full digests."""
    return int.from_bytes(key[:8], "little", signed=True)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many first n-grams of a set of n a linked set must meet."""
    return n - -(-percent * n // 100) + 1


def _survey(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """Per document (doc_id, key, n, digest, node, bits), and per task (gram, seen) of n-grams seen twice or more there.

    ``key`` is a hash of the text that Spark computes, by which rows are found again.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
                        ("node", pa.int64()), ("bits", pa.list_(pa.int64())), ("gram", pa.int64()), ("seen", pa.int64())])

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        grams, seen = np.unique(np.concatenate(held), return_counts=True)
        some = seen > 1
        k = int(some.sum())
        return pa.record_batch([*(pa.nulls(k, f.type) for f in list(schema)[:6]), pa.array(grams[some]), pa.array(seen[some])], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, done = [], 0, set()
        for batch in (part for whole in batches for part in _slices(whole)):
            sets = shingles(batch.column(2), words)
            keys = [digest(s) for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                                   pa.array(keys, pa.binary()), pa.array([node(k) for k in keys], pa.int64()),
                                   pa.array([parity(s) for s in sets], pa.list_(pa.int64())), none, none], schema=schema)
            for s, k in zip(sets, keys):
                if k not in done:  # copies do not make an n-gram frequent
                    done.add(k)
                    held.append(s)
                    size += len(s)
            if size > TASK_GRAMS:
                yield repeated(held)
                held, size, done = [], 0, set()
        if held:
            yield repeated(held)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _text_key(text), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, n long, digest binary, node long, bits array<long>, gram long, seen long")


def _text_key(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string")).alias("key")


def _frequent(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent n-grams, sorted, and their frequency class; at most MAX_FREQUENT."""
    often = survey.where("gram is not null").groupBy("gram").agg(F.sum("seen").alias("seen")).where(
        F.col("seen") >= FREQUENT_FROM).orderBy(F.col("seen").desc(), "gram").limit(MAX_FREQUENT).toArrow()
    grams = often.column("gram").to_numpy().astype(np.int64)
    level = np.log2(np.maximum(often.column("seen").to_numpy().astype(float), 1)).astype(np.int64)
    order = np.argsort(grams)
    return grams[order], level[order]


def prefix(grams: np.ndarray, frequent: np.ndarray, level: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first n-grams of a set in the common order: by frequency class, then fingerprint."""
    k = prefix_length(len(grams), percent)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        rank = np.where(frequent[at] == grams, level[at], 0)
        if rank.any():
            return grams[np.lexsort((grams, rank))[:k]]
    return grams[:k]


def _columns(docs: DataFrame, text: str, words: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(gram, node, pos, n): the columns to multiply, one entry per class and task, with its place in the row's order and the row's size."""
    shipped = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("gram", pa.int64()), ("node", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())])

    def out(parts: list[np.ndarray], nodes: list[int], whole: list[int]) -> pa.RecordBatch:
        sizes = [len(p) for p in parts]
        return pa.record_batch([pa.array(np.concatenate(parts)), pa.array(np.repeat(np.array(nodes, np.int64), sizes)),
                                pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])),
                                pa.array(np.repeat(np.array(whole, np.int32), sizes))], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        often, level = shipped.value
        for batch in (part for whole in batches for part in _slices(whole)):
            parts, nodes, whole, size = [], [], [], 0
            for s in shingles(batch.column(0), words):
                key = digest(s)
                if not len(s) or key in done:
                    continue
                if len(done) < 2_000_000:
                    done.add(key)
                parts.append(prefix(s, often, level, percent))
                nodes.append(node(key))
                whole.append(len(s))
                size += len(parts[-1])
                if size > 200_000:
                    yield out(parts, nodes, whole)
                    parts, nodes, whole, size = [], [], [], 0
            if parts:
                yield out(parts, nodes, whole)

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "gram long, node long, pos int, n int")


def meetings(grams: np.ndarray, nodes: np.ndarray, pos: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(gram, node, pos, lead) of sorted entries in columns of two or more nodes; lead is a column's least node.

    With the rows' sizes ``n``: (gram, node, pos, n, lead, the lead's pos and n).
    """
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1])])
    more = [c[new] for c in ((nodes, pos) if n is None else (nodes, pos, n))]
    grams = grams[new]
    start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    size = np.diff(np.concatenate([start, [len(grams)]]))
    met = np.repeat(size, size) > 1
    lead = np.repeat(start, size)[met]
    return grams[met], *(c[met] for c in more), *(c[lead] for c in (more[:1] if n is None else more))


def _meetings(columns: DataFrame) -> DataFrame:
    """(gram, node, pos, n, lead, lead_pos, lead_n) of all columns where nodes meet, read in column order."""
    schema = pa.schema([("gram", pa.int64()), ("node", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("lead", pa.int64()),
                        ("lead_pos", pa.int32()), ("lead_n", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, told = 0, 0  # told: leading entries of the buffer that went out with an earlier one
        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            size += batch.num_rows
            if size < BUFFER:
                continue
            entries = tuple(np.concatenate(c) for c in zip(*held))
            cut = int(np.searchsorted(entries[0], entries[0][-1]))
            if cut == 0:
                # one column fills the buffer: its entries go out, leader and last entry stay for what follows
                found = meetings(*entries)
                keep = [0, len(entries[0]) - 1]
                held, fresh = [tuple(c[keep] for c in entries)], told
                told = 2 if len(found[0]) else 0
            else:
                found = meetings(*(c[:cut] for c in entries))
                held, fresh, told = [tuple(c[cut:] for c in entries)], told, 0
            size = len(held[0][0])
            yield from emit(found, fresh)
        if held:
            yield from emit(meetings(*(np.concatenate(c) for c in zip(*held))), told)

    def emit(found: tuple[np.ndarray, ...], told: int) -> Iterator[pa.RecordBatch]:
        for at in range(told, len(found[0]), 100_000):
            yield pa.record_batch([pa.array(c[at:at + 100_000]) for c in found], schema=schema)

    dealt = columns.repartition("gram").sortWithinPartitions("gram", "node")
    return dealt.mapInArrow(run, "gram long, node long, pos int, n int, lead long, lead_pos int, lead_n int")


def _could(pos_a: Column, a: Column, pos_b: Column, b: Column, percent: int) -> Column:
    """Whether sizes and places in the first column that two rows share allow the overlap they need.

    Of a linked pair at least that column passes.
    """
    a, b = a.cast("long"), b.cast("long")
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * F.least(a - pos_a, b - pos_b) >= percent * (a + b))


def _best(met: DataFrame, classes: DataFrame, tried: DataFrame | None, percent: int) -> DataFrame:
    """(a, b, hub): each node with the leader it shares most columns with, of (node, lead) entries; the leader is the hub."""
    counted = met.groupBy(F.col("node").alias("a"), F.col("lead").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.first(F.col("n") + F.col("lead_n")).alias("total"))
    if tried is not None:
        both = tried.select("a", "b").unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        counted = counted.join(both, ["a", "b"], "left_anti")
    side = classes.select("node", "bits")
    sized = counted.join(side.toDF("a", "va"), "a").join(side.toDF("b", "vb"), "b")
    differ = sum((F.bit_count(F.col("va")[i].bitwiseXOR(F.col("vb")[i])) for i in range(BITS // 64)), F.lit(0))
    possible = sized.where((100 + percent) * (F.col("total") - differ) >= 2 * percent * F.col("total"))
    best = possible.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    return cut_lineage(best.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("b").alias("hub")))


def _mixed(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(gram, node, pos, n, label, size) of the columns where components still meet, with the column's size."""
    named = met.select("gram", "node", "pos", "n").join(labels, "node")
    column = Window.partitionBy("gram")
    sized = named.select("*", F.count(F.lit(1)).over(column).alias("size"), F.min("label").over(column).alias("lo"),
                         F.max("label").over(column).alias("hi"))
    return cut_lineage(sized.where("lo < hi").drop("lo", "hi"))


def block_pairs(group: np.ndarray, nodes: np.ndarray, n: np.ndarray, pos: np.ndarray, label: np.ndarray, block: np.ndarray,
                bits: np.ndarray, percent: int = PERCENT, hit: np.ndarray | None = None) -> np.ndarray:
    """(a, b) rows: pairs across components within the groups of entries sorted by (group, n).

    ``block`` is -1 where a group is one block against itself; else only pairs of different blocks are
    taken.  A linked pair passes all bounds in the first column it shares: no n-gram before it is common.
    ``hit`` (by group) is set where a group has pairs.
    """
    bits = np.ascontiguousarray(bits).view(np.uint64)  # numpy counts the bits of a signed number's magnitude
    last = np.searchsorted(group, group, "right")
    left, k, out, held, most = np.arange(len(group)), 1, [], 0, PAIRS
    while len(left):
        left = left[left + k < last[left]]
        left = left[100 * n[left] >= percent * n[left + k]]  # sizes rise, so the rest of the group fails too
        right = left + k
        ok = (label[left] != label[right]) & ((block[left] < 0) | (block[left] != block[right]))
        a, b = left[ok], right[ok]
        total = n[a] + n[b]
        ok = (100 + percent) * np.minimum(n[a] - pos[a], n[b] - pos[b]) >= percent * total
        a, b, total = a[ok], b[ok], total[ok]
        differ = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
        ok = (100 + percent) * (total - differ) >= 2 * percent * total
        if hit is not None:
            hit[group[a[ok]]] = True
        a, b = nodes[a[ok]], nodes[b[ok]]
        out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        held += len(a)
        if held > most:  # columns of a group of near copies find the same pairs again and again
            out = [np.unique(np.concatenate(out), axis=0)]
            held, most = len(out[0]), max(PAIRS, 2 * len(out[0]))
        k += 1
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def one_each(pairs: np.ndarray, nodes: np.ndarray, label: np.ndarray, turn: int) -> np.ndarray:
    """Of many pairs, one for each node: with the component that comes first in the turn's order, and in it with
    the node that does, so that nodes of a group meet the same one."""
    names, at = np.unique(nodes, return_index=True)
    ends = np.concatenate([pairs, pairs[:, ::-1]])
    other = ends[:, 1]
    draws = []
    for keys in (label[at][np.searchsorted(names, other)], other):
        h = (keys.view(np.uint64) ^ np.uint64(turn)) * _K
        draws.append((h ^ (h >> np.uint64(29))) * _K)
    order = np.lexsort((draws[1], draws[0], ends[:, 0]))
    chosen = ends[order[np.unique(ends[order, 0], return_index=True)[1]]]
    return np.unique(np.sort(chosen, axis=1), axis=0)


def _across(mixed: DataFrame, classes: DataFrame, percent: int, turn: int | None = None) -> DataFrame:
    """(a, b, gram): pairs of different components that their bounds allow, from the product of the mixed columns.

    A column of more than ``BLOCK`` entries is cut into row blocks, and each two of them are a group of their own.
    In a ``turn``, a task that finds more pairs than nodes in them (``MORE`` times as many from turn to turn) gives one pair for each node only, and
    the columns that have pairs as rows of their ``gram`` alone.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("gram", pa.int64())])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    entries = mixed.withColumn("blocks", blocks).join(classes.select("node", "bits"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    entries = entries.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    entries = entries.select("gram", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "n", "node", "pos", "label",
                             "block", "bits")

    def product(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, i, j, n, nodes, pos, label, block = (batch.column(c).to_numpy() for c in range(8))
        new = (gram[1:] != gram[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        group = np.concatenate([[0], np.cumsum(new)])
        bits = batch.column(8).combine_chunks().flatten().to_numpy().reshape(-1, BITS // 64)
        hit = np.zeros(int(group[-1]) + 1, bool)
        found = block_pairs(group, nodes, n, pos, label, np.where(i == j, -1, block), bits, percent, hit)
        if turn is not None and len(found) > MORE ** (turn - 1) * len(np.unique(found)):
            found = one_each(found, nodes, label, turn)
            again = np.unique(gram[hit[group]])
            none = pa.nulls(len(again), pa.int64())
            yield pa.record_batch([none, none, pa.array(again)], schema=schema)
        for at in range(0, len(found), 100_000):
            part = found[at:at + 100_000]
            yield pa.record_batch([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy()), pa.nulls(len(part), pa.int64())], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < BUFFER // 5:
                continue
            table = pa.Table.from_batches(held)
            cut = _last_group([table.column(c).to_numpy() for c in range(3)])
            if cut:
                yield from product(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = table.num_rows - cut
        if size:
            yield from product(pa.Table.from_batches(held))

    dealt = entries.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j", "n")
    return dealt.mapInArrow(run, "a long, b long, gram long").distinct()


def _last_group(keys: list[np.ndarray]) -> int:
    """Where the last group of sorted entries begins."""
    other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
    return int(other[-1]) + 1 if len(other) else 0


def _bitmap(keys: DataFrame) -> tuple[DataFrame, int]:
    """(page, map): a bitmap of the written ``__key`` values by their remainders, and the number of its bits."""
    slots = 1 << max(PAGE, (SLOTS * keys.count()).bit_length())
    slot = F.pmod(F.col("__key"), F.lit(slots))
    pages = keys.groupBy(F.shiftright(slot, PAGE).alias("page")).agg(
        F.bitmap_construct_agg(slot.bitwiseAND(F.lit((1 << PAGE) - 1))).alias("map"))
    return pages, slots


def _maybe(rows: DataFrame, bitmap: tuple[DataFrame, int]) -> DataFrame:
    """``rows`` with ``__maybe``: whether their ``__key`` may be one of the bitmap's; every one that is has true."""
    pages, slots = bitmap
    slot = F.pmod(F.col("__key"), F.lit(slots))
    bit = slot.bitwiseAND(F.lit((1 << PAGE) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("map"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(pages), F.shiftright(slot, PAGE) == F.col("page"), "left").withColumn(
        "__maybe", F.coalesce(is_set, F.lit(False))).drop("page", "map")


def _packed(rows: DataFrame) -> DataFrame:
    """(id, key, size, packed): texts in few bytes."""
    schema = pa.schema([("__id", pa.int64()), ("__key", pa.int64()), ("__size", pa.int64()), ("__packed", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in (part for whole in batches for part in _slices(whole)):
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()),
                                   pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())], schema=schema)

    return rows.select("__id", "__key", "__text").mapInArrow(run, "__id long, __key long, __size long, __packed binary")


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """(a, b) digests of the (a, b, hub) node pairs whose sets are similar enough.

    The texts of a pair meet at its hub, of which a text of many pairs has one copy per ``HUB`` others; each
    text travels once a pair, and sets are made where they are compared.
    """
    other = F.when(F.col("a") == F.col("hub"), F.col("b")).otherwise(F.col("a")).alias("node")
    spokes = pairs.select("hub", other)
    dealt = spokes.join(spokes.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("parts")), "hub")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    spokes = cut_lineage(dealt.select("hub", part, "node"))
    visits = spokes.select("node", "hub", "part").unionByName(spokes.select(F.col("hub").alias("node"), "hub", "part").distinct())
    named = cut_lineage(classes.select("node", "doc_id", "key").join(visits, "node").select(
        F.col("doc_id").alias("__doc"), F.col("key").alias("__asked"), "node", "hub", "part"))
    some = docs.select(F.col(doc_id).cast("long").alias("__id"), _text_key(text).alias("__key"), F.col(text).cast("string").alias("__text"))
    asked = _packed(_maybe(some.where("__text is not null"), _bitmap(named.select(F.col("__asked").alias("__key")))).where("__maybe"))
    there = asked.join(named, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__key") == F.col("__asked")))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, middle, name, codec = None, None, None, pa.Codec("zstd")
        for batch in (part for whole in batches for part in _slices(whole, 500)):
            hubs, parts, nodes = (batch.column(c).to_pylist() for c in range(3))
            texts = [codec.decompress(z, n, asbytes=True) for n, z in zip(*(batch.column(c).to_pylist() for c in (4, 5)))]
            a, b = [], []
            for hub, part, own, s in zip(hubs, parts, nodes, shingles(pa.array(texts, pa.binary()).cast(pa.string()), words)):
                key = digest(s)
                if node(key) != own:
                    continue
                if own == hub:  # sorted first
                    at, middle, name = (hub, part), s, key
                    continue
                if at != (hub, part):
                    raise ValueError(f"node {hub} is not among its pairs")
                overlap = len(np.intersect1d(s, middle, assume_unique=True))
                if 100 * overlap >= percent * (len(s) + len(middle) - overlap):
                    a.append(min(key, name)), b.append(max(key, name))
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)

    met = there.select("hub", "part", "node", (F.col("node") != F.col("hub")).alias("spoke"), "__size", "__packed").repartition("hub", "part")
    return met.sortWithinPartitions("hub", "part", "spoke").mapInArrow(run, "a binary, b binary").distinct()


def _merged(components_of: DataFrame, links: DataFrame) -> DataFrame:
    """(digest, node, label): components after more links, of which only those across components count, once a pair of them."""
    of = components_of.select("digest", "label")
    across = links.join(of.toDF("a", "la"), "a").join(of.toDF("b", "lb"), "b").where("la != lb")
    joined = components(across.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    return cut_lineage(components_of.join(joined.toDF("label", "above"), "label", "left").select(
        "digest", "node", F.coalesce("above", "label").alias("label")))


def _names(components_of: DataFrame) -> DataFrame:
    """(node, label): each class with a short name of its component."""
    return components_of.select("node", F.xxhash64("label").alias("label"))


def _grouped(docs: DataFrame, text: str, doc_id: str, words: int, percent: int) -> DataFrame:
    """Per document (doc_id, key, n, component_id, first): ``first`` says the (doc_id, key) that stands for its group."""
    survey = cut_lineage(_survey(docs, doc_id, text, words))
    each = survey.where("digest is not null").select("doc_id", "key", "n", "digest", "node", "bits")
    # the row that stands for a class: the least id, then the least key; NULL ids only where there is no other
    stands = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = cut_lineage(each.where("n > 0").groupBy("digest").agg(
        F.min(stands).alias("s"), F.max("n").alias("n"), F.max("node").alias("node"), F.first("bits").alias("bits")).select(
        "digest", "s", F.col("s.doc_id").alias("doc_id"), F.col("s.key").alias("key"), "n", "node", "bits"))

    met = cut_lineage(_meetings(_columns(docs, text, words, percent, _frequent(survey))))

    def compare(pairs: DataFrame) -> DataFrame:
        return cut_lineage(_links(pairs, classes, docs, doc_id, text, words, percent))

    near = _could(F.col("pos"), F.col("n"), F.col("lead_pos"), F.col("lead_n"), percent)
    tried = _best(met.where(F.col("node") != F.col("lead")).where(near), classes, None, percent)
    parts = _merged(classes.select("digest", "node", F.col("digest").alias("label")), compare(tried))
    mixed = _mixed(met, _names(parts))
    for turn in range(1, ROUNDS + 1):
        found = cut_lineage(_across(mixed, classes, percent, turn if turn < ROUNDS else None).join(tried, ["a", "b"], "left_anti"))
        pairs = found.where("a is not null").select("a", "b", F.col("a").alias("hub"))
        if pairs.limit(1).count():
            tried, parts = tried.unionByName(pairs), _merged(parts, compare(pairs))
        again = found.where("a is null").select("gram")
        if not again.limit(1).count():
            break
        some = _maybe(mixed.withColumn("__key", F.col("gram")), _bitmap(again.withColumnRenamed("gram", "__key"))).where("__maybe")
        mixed = _mixed(some.join(again.distinct(), "gram", "left_semi"), _names(parts))

    found = classes.select("digest", "s").join(parts.select("digest", "label"), "digest")
    least = found.groupBy("label").agg(F.min("s").alias("first"))
    group = found.join(least, "label").select(F.col("digest").alias("__digest"), "first")
    some = each.where("n > 0").join(group, F.col("digest") == F.col("__digest")).select("doc_id", "key", "n", "first")
    return some.unionByName(each.where("n = 0").select("doc_id", "key", "n", stands.alias("first"))).select(
        "doc_id", "key", "n", F.col("first.doc_id").alias("component_id"), "first")


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links).

    NULL and empty texts, and texts of white space, have the empty set and are linked with nothing;
    texts under ``words`` words have their whole word sequence as one n-gram.  Repeated rows have equal
    sets and are linked.  Rows without doc_id are linked like others; NULL is the least id only where a
    component has no other.  An empty table gives an empty result.
    """
    return _grouped(docs, text, doc_id, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the least doc_id; documents without words all stay.

    Of different texts with that id in one group, one stays.  Rows that repeat doc_id and text are one
    document; a NULL id stays only where the whole group has no other.
    """
    found = cut_lineage(_grouped(docs, text, doc_id, words, percent))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    each = found.groupBy(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__no_id"), F.col("key").alias("__key")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(stays).alias("stays"))
    # only texts that may go or repeat are moved, to be told apart by id and key; all others are there once and stay
    doubtful = cut_lineage(each.where("rows > 1 or not stays").select("__key").distinct())
    names = ["__id", "__no_id", "__key"]
    rows = _maybe(docs.withColumns({"__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), "__no_id": F.col(doc_id).isNull(),
                                    "__key": _text_key(text)}), _bitmap(doubtful))
    told = rows.where("__maybe").join(each.where("stays").select(names), names, "left_semi").dropDuplicates([*names, text])
    return rows.where("not __maybe").unionByName(told).select(*docs.columns)
