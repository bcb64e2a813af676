"""Language-model scoring with a weighted backoff automaton.

Model.  Words count once per training text, plus one end token; the lowest order is add-one over all
words.  Longer n-grams (up to ``ORDER``) over all words are kept when seen at least ``MIN_COUNT`` times.
They are smoothed by absolute discounting: with c(h) the count of a history and c(hw) that of a kept n-gram

    p(w | h) = (c(hw) - D) / c(h) + b(h) p(w | h')      b(h) = 1 - sum over kept (c(hw) - D) / c(h)

where h' drops the first word of h; an n-gram that is not kept has p = b(h) p(w | h').

Automaton.  A state is a history with kept n-grams; its arcs are those n-grams with log p, its failure
arc leads to the state of h' with log b(h).  Reading a text leaves the automaton in the longest history
that is a state, so the states before all tokens of a block are looked up at once.

Spark.  Texts are tokenised once, in blocks (one per scan task up to ``BLOCK_BYTES`` of text): a written
table, bucketed by block, of token numbers local to the block, with its dictionary and training counts.
Words and n-grams are counted by 64-bit fingerprints (words by 96 bits): a block sends its distinct ones in
fingerprint order, packed, one row per range of fingerprints (``PART`` n-grams of the whole table on
average); a range is summed in one task, and the answer to a block says in the same order which are kept,
how often they are there and which the block leads, so that each is led by one block.  Leaders send
what an n-gram takes of its history in the same way, and every block asks for the histories it has.
A trigram is counted only where both its bigrams are kept, which it needs to be kept itself.  So a block
has its part of the automaton, which gives the same scores as the whole one; blocks are not shuffled.
Neither vocabulary nor n-grams are ever broadcast or collected.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from riskframe.llm.text import id_remainder
from riskframe.session import cut_lineage, ensure_checkpoint_dir

ORDER = 3
MIN_COUNT = 3
DISCOUNT = 0.75
FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 9 << 20
# word numbers inside a block's n-gram keys: 0 is none, 1 the text start, 2 on words with kept n-grams
BITS = 21
BOS = 1
# fingerprint of the text start; the end token's is 0
BOS_PRINT = 1
END_KEY = b"\0" * 12
# n-grams of all blocks that one task sums at a time, on average
PART = 1 << 20
BLOCK_SCHEMA = ("block long, doc_ids array<long>, held array<boolean>, sizes array<int>, tokens binary, "
                "keys binary, counts binary, n_tokens long, n_train long")
_BLOCK = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
    ("tokens", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("n_tokens", pa.int64()), ("n_train", pa.int64())])
# what rows between blocks and ranges are about
WORD, BIGRAM, TRIGRAM, WORD_MASS, BIGRAM_MASS, HISTORIES = range(1, 7)
ITEM_SCHEMA = "block long, kind int, part int, n int, prints binary, more binary, counts binary, others binary"
_ITEM = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("prints", pa.binary()),
                   ("more", pa.binary()), ("counts", pa.binary()), ("others", pa.binary())])
ANSWER_SCHEMA = "block long, kind int, part int, n int, kept binary, leads binary, counts binary, others binary, types long"
_ANSWER = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("kept", pa.binary()),
                     ("leads", pa.binary()), ("counts", pa.binary()), ("others", pa.binary()), ("types", pa.int64())])
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def word_key(word: bytes) -> bytes:
    """96 bits of a word; ``END_KEY`` is the end token's."""
    return xxhash.xxh3_128_digest(word)[:12]


def tokenise(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of (doc_id, held_out, text) rows; token 0 of every block is the end token."""
    def block(number: int, docs: list, words: dict, counts: np.ndarray) -> pa.RecordBatch:
        keys = b"".join([END_KEY, *(word_key(w) for w in words if w is not None)])
        doc_ids, held, tokens = zip(*docs)
        sizes, counts = [len(t) // 4 for t in tokens], counts[:len(words)]
        row = [number, doc_ids, held, sizes, b"".join(tokens), keys, counts.tobytes(), sum(sizes), int(counts.sum())]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        docs: list = []
        words: dict = {None: 0}
        counts = np.zeros(1 << 16, np.int64)
        size = 0
        for batch in batches:
            for doc_id, held, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                # bytes: lower() changes A-Z only and split() knows exactly the six word separators
                found = (text.as_py() or "").encode().lower().split()
                if docs and size + 8 * len(found) > 2 * block_bytes:
                    yield block(number, docs, words, counts)
                    number, docs, words, size = number + 1, [], {None: 0}, 0
                    counts = np.zeros(1 << 16, np.int64)
                numbers = array("i", [words.setdefault(w, len(words)) for w in found])
                numbers.append(0)
                ids = np.frombuffer(numbers, np.int32)
                if len(words) > len(counts):
                    counts = np.concatenate([counts, np.zeros(2 * len(words), np.int64)])
                if not held.as_py():
                    some, n = np.unique(ids, return_counts=True)
                    counts[some] += n
                docs.append((doc_id.as_py(), held.as_py(), ids.tobytes()))
                size += 8 * len(found) + 64
        if docs:
            yield block(number, docs, words, counts)

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def _bucketed(blocks: DataFrame) -> DataFrame:
    """Blocks written once, bucketed by number, so that answers come to them and they stay."""
    spark = blocks.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    (blocks.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("compression", "zstd")
     .option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of what two fingerprints name one behind the other."""
    h = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h = (h ^ b.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _pack(values: np.ndarray) -> bytes:
    """Numbers of 4 or 8 bytes, all first bytes first, then all second ones: small numbers leave little."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _items(number: int, kind: int, parts: int, prints: np.ndarray, counts: np.ndarray, others: np.ndarray | None = None,
           more: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of a block's sorted fingerprints, one per range that has some."""
    part = (((prints >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    at = np.searchsorted(part, np.arange(parts + 1))
    for i in np.flatnonzero(at[1:] > at[:-1]).tolist():
        own = slice(int(at[i]), int(at[i + 1]))
        steps = np.diff(prints[own], prepend=np.uint64(0))
        yield (number, kind, i, own.stop - own.start, _pack(steps), None if more is None else more[own].tobytes(),
               _pack(counts[own]), None if others is None else _pack(others[own]))


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 64:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _summed(items: DataFrame, min_count: int) -> DataFrame:
    """The answers to items of all blocks: of each the sum over blocks, where it is kept, and whether the block leads it.

    Words are all kept, n-grams from ``min_count`` on, and masses where there are some.
    """
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        kind, sizes = key[0].as_py(), rows.column("n").to_numpy()

        def column(name: str, dtype: type) -> np.ndarray:
            return np.concatenate([_unpack(x.as_buffer(), int(n), dtype) for x, n in zip(rows.column(name), sizes)])

        prints = np.concatenate([np.cumsum(_unpack(x.as_buffer(), int(n), np.uint64), dtype=np.uint64)
                                 for x, n in zip(rows.column("prints"), sizes)])
        if kind == WORD:
            more = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column("more")])
            order = np.lexsort((more, prints))
            new = np.append(True, (np.diff(prints[order]) != 0) | (np.diff(more[order].astype(np.int64)) != 0))
        else:
            order = np.argsort(prints)
            new = np.append(True, np.diff(prints[order]) != 0)
        start, group = np.flatnonzero(new), np.empty(len(order), np.int32)
        group[order] = np.cumsum(new) - 1
        total = np.add.reduceat(column("counts", np.int64)[order], start)
        other = None
        if kind in (WORD_MASS, BIGRAM_MASS):
            other = np.add.reduceat(column("others", np.int64)[order], start)
            keep = other > 0
        else:
            keep = total >= (0 if kind == WORD else min_count)
        leads = np.zeros(len(order), bool)
        leads[order[start]] = True
        out, at = [], 0
        for block, n in zip(rows.column("block").to_pylist(), sizes.tolist()):
            own, first = group[at:at + n], leads[at:at + n]
            kept = keep[own]
            own, first = own[kept], first[kept]
            out.append((block, kind, key[1].as_py(), n, np.packbits(kept).tobytes(), np.packbits(first).tobytes(),
                        _pack(total[own]), None if other is None else _pack(other[own]),
                        int((total[own][first] > 0).sum()) if kind == WORD else 0))
            at += n
        return pa.Table.from_batches(_batches(out, _ANSWER), schema=_ANSWER)

    return items.groupBy("kind", "part").applyInArrow(run, ANSWER_SCHEMA)


class Answers:
    """A block's answers, by kind in the order of the block's items."""

    def __init__(self, found: pa.Table) -> None:
        self.rows: dict[int, list[dict]] = {}
        for row in found.sort_by("part").to_pylist():
            self.rows.setdefault(row["kind"], []).append(row)

    def of(self, kind: int) -> tuple[np.ndarray, ...]:
        """(kept, leads, counts, others): ``kept`` for all items, the rest for kept ones."""
        parts: list[list[np.ndarray]] = [[np.zeros(0, bool)], [np.zeros(0, bool)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for row in self.rows.get(kind, []):
            kept = np.unpackbits(np.frombuffer(row["kept"], np.uint8), count=row["n"]).astype(bool)
            k = int(kept.sum())
            parts[0].append(kept)
            parts[1].append(np.unpackbits(np.frombuffer(row["leads"], np.uint8), count=k).astype(bool))
            parts[2].append(_unpack(row["counts"], k, np.int64))
            parts[3].append(np.zeros(k, np.int64) if row["others"] is None else _unpack(row["others"], k, np.int64))
        return tuple(np.concatenate(p) for p in parts)


class Block:
    """A block's token row with its words and n-grams in the order of their fingerprints."""

    def __init__(self, row: dict) -> None:
        self.number, self.doc_ids, self.held = row["block"], row["doc_ids"], np.array(row["held"], bool)
        self.sizes, tokens = np.array(row["sizes"], np.int64), np.frombuffer(row["tokens"], np.int32)
        self.counts = np.frombuffer(row["counts"], np.int64).copy()
        self.n_words = len(self.counts)
        raw = np.frombuffer(row["keys"], np.uint8).reshape(-1, len(END_KEY))
        words = np.ascontiguousarray(raw[:, :8]).view(">u8").ravel().astype(np.uint64)
        self.more = np.ascontiguousarray(raw[:, 8:]).view(np.uint32).ravel()
        self.order = np.lexsort((self.more, words))
        # the text start's is behind the words'
        self.prints = np.append(words, np.uint64(BOS_PRINT))
        # every text has the text start before it
        starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.row = np.empty(len(tokens) + len(self.sizes), np.int64)
        is_token = np.ones(len(self.row), bool)
        is_token[starts] = False
        self.row[starts], self.row[is_token] = self.n_words, tokens
        self.train = np.repeat(~self.held, self.sizes + 1)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints, the rest of the keys, and training counts of the words, in order."""
        return self.prints[self.order], self.more[self.order], self.counts[self.order]

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints, first words, second words and training counts of the distinct bigrams of all texts."""
        row = self.row
        keys = ((row[:-1] << 32) | (row[1:] << 1) | self.train[1:])[row[1:] != self.n_words]
        keys.sort()
        pairs = keys >> 1
        start = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        n, pairs = np.add.reduceat(keys & 1, start), pairs[start]
        first, second = pairs >> 31, pairs & ((1 << 31) - 1)
        prints = _joint(self.prints[first], self.prints[second])
        order = np.argsort(prints, kind="stable")
        return prints[order], first[order], second[order], n[order]

    def histories(self, least: int) -> np.ndarray:
        """Words of at least so many counts, and the text start, in the order of their fingerprints."""
        some = np.append(np.flatnonzero(self.counts >= least), self.n_words)
        return some[np.argsort(self.prints[some], kind="stable")]

    def number_words(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words for n-gram keys; larger words have larger numbers, the text start has ``BOS``."""
        out = np.zeros(self.n_words + 1, np.int64)
        words = np.unique(words[words < self.n_words])
        if len(words) > (1 << BITS) - 3:
            raise ValueError(f"a block has {len(words)} different words with kept n-grams")
        out[words] = np.arange(BOS + 1, BOS + 1 + len(words))
        out[self.n_words] = BOS
        return out

    def trigrams(self, of: np.ndarray, bigrams: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, ...]:
        """(fingerprints, keys, places of the histories, training counts) of the distinct trigrams whose bigrams are both
        among the sorted keys, with ``prints`` of these bigrams."""
        row = of[self.row]
        known = _find(bigrams, (row[:-1] << BITS) | row[1:])[1] & (self.row[1:] != self.n_words)
        ok = known[:-1] & known[1:]
        keys = ((((row[:-2] << BITS) | row[1:-1]) << BITS) | row[2:])[ok]
        keys = (keys.astype(np.uint64) << np.uint64(1)) | self.train[:-2][ok]
        keys.sort()
        start = np.flatnonzero(np.append(True, (keys[1:] ^ keys[:-1]) > 1)) if len(keys) else np.zeros(0, np.int64)
        n = np.add.reduceat(keys & np.uint64(1), start).astype(np.int64) if len(keys) else start
        every = (keys[start] >> np.uint64(1)).astype(np.int64)
        word_of = np.zeros(1 + int(of.max()), np.uint64)
        word_of[of] = self.prints
        history = np.searchsorted(bigrams, every >> BITS)
        found = _joint(prints[history], word_of[every & ((1 << BITS) - 1)])
        order = np.argsort(found, kind="stable")
        return found[order], every[order], history[order], n[order]


def first_items(blocks: DataFrame, parts: int) -> DataFrame:
    """The blocks' words and bigrams with their training counts.

    N-grams of held-out texts are there too, with what training texts add to them; they are the
    block's questions to the model.
    """
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block(batch.slice(at, 1).to_pylist()[0])
                prints, more, n = block.words()
                yield from _items(block.number, WORD, parts, prints, n, more=more)
                prints, _, _, n = block.bigrams()
                yield from _items(block.number, BIGRAM, parts, prints, n)

    return blocks.mapInArrow(lambda batches: _batches(rows(batches), _ITEM), ITEM_SCHEMA)


def _kept_bigrams(block: Block, answers: Answers, more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word numbers, sorted keys of the kept bigrams, their counts and fingerprints, whether the block leads them,
    their first words, and the places in key order of the bigrams in fingerprint order.

    ``more`` are words that need a number besides those of the bigrams.
    """
    prints, first, second, _ = block.bigrams()
    kept, leads, n, _ = answers.of(BIGRAM)
    prints, first, second = prints[kept], first[kept], second[kept]
    of = block.number_words(np.concatenate([first, second, more]))
    keys = (of[first] << BITS) | of[second]
    order = np.argsort(keys)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return of, keys[order], n[order], prints[order], leads[order], first[order], place


def second_items(blocks: DataFrame, answers: DataFrame, parts: int, min_count: int) -> DataFrame:
    """The blocks' trigrams whose bigrams are both kept, their places of histories, and what led bigrams take of words."""
    def rows(block: Block, found: Answers) -> Iterator[tuple]:
        block.counts[block.order] = found.of(WORD)[2]
        of, keys, n, prints, leads, first, place = _kept_bigrams(block, found, np.zeros(0, np.int64))
        asked = block.histories(min_count)
        taken, times = np.zeros(block.n_words + 1, np.int64), np.zeros(block.n_words + 1, np.int64)
        np.add.at(taken, first[leads], n[leads])
        np.add.at(times, first[leads], 1)
        yield from _items(block.number, WORD_MASS, parts, block.prints[asked], taken[asked], times[asked])
        by_key = np.empty(len(place), np.int64)
        by_key[place] = np.arange(len(place))
        tri, _, history, n = block.trigrams(of, keys, prints)
        yield from _items(block.number, TRIGRAM, parts, tri, n)
        # for the next step: fingerprints of kept bigrams, and of each trigram its history's place among them
        steps = np.diff(prints[place], prepend=np.uint64(0))
        yield (block.number, HISTORIES, 0, len(place), _pack(steps), None, _pack(by_key[history].astype(np.int32)),
               len(history).to_bytes(8, "little"))

    def run(key: tuple, block: pa.Table, found: pa.Table) -> pa.Table:
        out = [b for row in block.to_pylist() for b in _batches(rows(Block(row), Answers(found)), _ITEM)]
        return pa.Table.from_batches(out, schema=_ITEM)

    return blocks.groupBy("block").cogroup(_to_block(answers)).applyInArrow(run, ITEM_SCHEMA)


def third_items(second: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """What led trigrams take of the kept bigrams that a block has."""
    def run(key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        _, leads, n, _ = (kept := Answers(found).of(TRIGRAM))
        out = []
        for row in own.to_pylist():
            size = int.from_bytes(row["others"], "little")
            history = _unpack(row["counts"], size, np.int32)[kept[0]][leads]
            prints = np.cumsum(_unpack(row["prints"], row["n"], np.uint64), dtype=np.uint64)
            taken, times = np.zeros(row["n"], np.int64), np.bincount(history, minlength=row["n"])
            np.add.at(taken, history, n[leads])
            out += _batches(_items(row["block"], BIGRAM_MASS, parts, prints, taken, times), _ITEM)
        return pa.Table.from_batches(out, schema=_ITEM)

    own = second.where(F.col("kind") == HISTORIES).select("block", "n", "prints", "counts", "others")
    return own.groupBy("block").cogroup(_to_block(answers.where(F.col("kind") == TRIGRAM))).applyInArrow(run, ITEM_SCHEMA)


def _to_block(answers: DataFrame):
    return answers.drop("types").withColumnRenamed("block", "to").groupBy("to")


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted values in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _arrays(pairs: dict | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their values."""
    if isinstance(pairs, dict):
        pairs = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.float64)
    order = np.argsort(pairs[0])
    return pairs[0][order], pairs[1][order]


def _shorter(history: np.ndarray) -> np.ndarray:
    """Histories without their first word."""
    two, one = (1 << (2 * BITS)) - 1, (1 << BITS) - 1
    return np.where(history > two, history & two, np.where(history > one, history & one, 0))


class Automaton:
    """Backoff automaton over kept n-grams; states and arcs are keyed by n-gram keys.

    ``counts`` maps n-gram keys to counts, ``mass`` histories to the sum of (count - discount) over
    their kept n-grams, ``base`` word numbers of the text's own words to log10 of the add-one estimate;
    each is a dict or a pair of arrays.
    """

    def __init__(self, counts: dict | tuple, mass: dict | tuple, single: dict | tuple, base: dict | tuple,
                 discount: float) -> None:
        keys, n = _arrays(counts)
        history, kept = _arrays(mass)
        once, n_once = _arrays(single)
        self.words, self.base = _arrays(base)
        at, there = _find(np.concatenate([once, keys]), history)
        known = np.where(there, np.concatenate([n_once, n, [0.0]])[at], 0.0)
        some = known > 0
        self.fail, known = history[some], known[some]
        self.weight = np.log10(np.maximum(1.0 - kept[some] / known, 1e-12))
        self.lower = self._states(_shorter(self.fail))
        self.arcs, self.log_p = np.zeros(0, np.int64), np.zeros(0)
        for size in range(2, ORDER + 1):  # shorter n-grams have smaller keys, and longer ones build on them
            part = (keys >> (BITS * (size - 1)) > 0) & (keys >> (BITS * size) == 0)
            at, there = _find(self.fail, keys[part] >> BITS)
            grams, at = keys[part][there], at[there]
            p = (n[part][there] - discount) / known[at] + 10.0 ** (
                self.weight[at] + self._log_ps(self.lower[at], grams & ((1 << BITS) - 1)))
            self.arcs, self.log_p = np.concatenate([self.arcs, grams]), np.concatenate([self.log_p, np.log10(p)])

    def _states(self, history: np.ndarray) -> np.ndarray:
        """The longest end of each history that is a state; 0 is the root."""
        history = history.copy()
        for _ in range(1, ORDER):
            off = ~_find(self.fail, history)[1]
            history[off] = _shorter(history[off])
        history[~_find(self.fail, history)[1]] = 0
        return history

    def _log_ps(self, states: np.ndarray, words: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
        """log10 p of words in states: failure arcs until there is an arc, or the base estimate at the root."""
        total, state = np.zeros(len(states)), states.copy()
        for _ in range(1, ORDER):
            live = np.flatnonzero(state > 0)
            at, there = _find(self.arcs, (state[live] << BITS) | words[live])
            hit, miss = live[there], live[~there]
            total[hit] += self.log_p[at[there]]
            at = _find(self.fail, state[miss])[0]
            state[hit] = -1
            total[miss] += self.weight[at]
            state[miss] = self.lower[at]
        root = np.flatnonzero(state == 0)
        if base is None:
            total[root] += self.base[_find(self.words, words[root])[0]]
        else:
            total[root] += base[root]
        return total

    def _log_p(self, state: int, word: int) -> float:
        return float(self._log_ps(np.array([state], np.int64), np.array([word], np.int64))[0])

    def score_rows(self, row: np.ndarray, base: np.ndarray) -> np.ndarray:
        """log10 p of every token of texts one behind the other, each with ``BOS`` before it (which has 0).

        ``row`` are word numbers (0: without kept n-grams), ``base`` the tokens' base estimates.
        """
        history = np.zeros(len(row), np.int64)
        history[1:] = row[:-1]
        history[2:] |= np.where(row[1:-1] == BOS, 0, row[:-2] << BITS)
        out = np.zeros(len(row))
        token = row != BOS
        out[token] = self._log_ps(self._states(history[token]), row[token], base[token])
        return out

    def score(self, words: list[int], base: list[float]) -> float:
        """log10 probability of a token row: word numbers and their base estimates."""
        return math.fsum(self.score_rows(np.array([BOS, *words], np.int64), np.array([0.0, *base])).tolist())


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_count: int = MIN_COUNT,
          discount: float = DISCOUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all texts whose fold is not held out and scores all.  NULL and empty texts are
    one end token; repeated rows count and are scored one by one; without training texts every token has
    the add-one estimate of an unseen one; an empty table gives an empty result.
    """
    held = id_remainder(doc_id, FOLDS) == HELD_OUT
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"),
                       F.col(text).cast("string").alias("text"))
    blocks = _bucketed(tokenise(rows, block_bytes))
    tokens, total = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    parts = max(16, -(-tokens // PART))
    first = cut_lineage(_summed(first_items(blocks, parts), min_count))
    types = first.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    asked = cut_lineage(second_items(blocks, first, parts, min_count))
    second = cut_lineage(_summed(asked.where(F.col("kind") != HISTORIES), min_count))
    third = _summed(third_items(asked, second, parts), min_count)
    answers = first.unionByName(second).unionByName(third)
    unseen = math.log10(1 / (total + types + 1))

    def run(key: tuple, block: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            own, told = Block(row), Answers(found)
            counts = own.counts
            counts[own.order] = told.of(WORD)[2]
            base = np.where(counts > 0, np.log10((counts + 1.0) / (total + types + 1)), unseen)
            some, _, taken, times = told.of(WORD_MASS)
            histories = own.histories(min_count)[some]
            of, pairs, pair_n, prints, _, _, place = _kept_bigrams(own, told, histories)
            _, keys, _, _ = own.trigrams(of, pairs, prints)
            kept, _, n, _ = told.of(TRIGRAM)
            used = np.flatnonzero(of[:-1])
            longer, _, pair_taken, pair_times = told.of(BIGRAM_MASS)
            automaton = Automaton(
                (np.concatenate([pairs, keys[kept]]), np.concatenate([pair_n, n])),
                (np.concatenate([of[histories], pairs[place][longer]]),
                 np.concatenate([taken - discount * times, pair_taken - discount * pair_times])),
                # a text starts as often as one ends
                (np.append(of[used], BOS), np.append(counts[used], counts[0])), (of[used], base[used]), discount)
            padded = np.append(base, 0.0)[own.row]
            scores = automaton.score_rows(of[own.row], padded)
            known = np.append(counts > 0, False)[own.row]
            at = np.concatenate([[0], np.cumsum(own.sizes + 1)]).tolist()
            for i, (a, b) in enumerate(zip(at, at[1:])):
                out.append((own.doc_ids[i], bool(own.held[i]), b - a - 1, int(known[a:b].sum()),
                            math.fsum(padded[a:b].tolist()), math.fsum(scores[a:b].tolist())))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*out), [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = blocks.groupBy("block").cogroup(_to_block(answers)).applyInArrow(run, SCORE_SCHEMA)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                         "base_score", "score")
