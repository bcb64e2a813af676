"""Alignment of two tokenizers' tokens over the same bytes.

A is a byte-level BPE, B a sentence-piece BPE that puts a space before a text; both then cover the bytes of
space + text.  Per batch, ``pandas.merge_asof`` keyed by document finds for the start of every token the other
side's covering token; both directions together are all overlapping pairs.  Overlapping pairs that end
together are the links, and their ends cut the tokens into groups.

Counting links over all documents.  Scan tasks write blocks of about ``BLOCK_BYTES`` of text: a row per document
with its links as numbers into the block's list of different id pairs, and a row with that list and its
counts.  Only these lists are shuffled to be summed; every block is then told the corpus's count of its own
pairs and whether it is the B id's highest, which its documents' links are looked up in.

Words.  Tokens of neither side hold a space behind a character that is none (A cuts there before it merges, and
B has no such piece, which is checked), so texts are cut there, each stretch is encoded once and remembered.
Longer texts are worked on in segments that end at a single space between word characters: each is space +
rest again, with the same tokens.  A text of more than ``SEGMENT`` characters without such a place is one segment.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from riskframe.session import cut_lineage

BLOCK_BYTES = 4 << 20
SEGMENT = 1 << 17
PART_CHARS = 1 << 18
CACHE_UNITS = 400_000
SPACE_MARK = "▁"
CUT = re.compile(r"(?<=\w) (?=\w)")
WIDE_SPACE = re.compile(r"\s ")
UNIT = re.compile(r"(?<=\S)(?= .)", re.DOTALL)
# a document row has NULL pairs, a block's list of pairs has NULL links
BLOCK_SCHEMA = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                "links binary, pairs array<long>, counts array<long>")
_BLOCK = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())),
    ("counts", pa.list_(pa.int64()))])
RESULT_SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                 "groups_sha256 string")
GROUP_SCHEMA = ("doc_id long, groups array<struct<a:array<int>,b:array<int>>>, overlaps array<struct<a:int,b:int>>")


def _unmapped_bytes() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _byte_level(path: str) -> tuple:
    """A: function texts -> ids of each, and the ids' bytes, from a byte-level BPE file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    of = _unmapped_bytes()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    raw = [b""] * (1 + max(vocabulary.values()))
    for token, i in vocabulary.items():
        raw[i] = bytes(of[c] for c in token) if all(c in of for c in token) else b""
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], raw


def _pieces(path: str) -> tuple:
    """B: function texts -> ids of each, the ids' bytes, and whether no piece has a space behind another character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw, splits = [], True
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            raw.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            raw.append(b"")
        else:
            raw.append(piece.replace(SPACE_MARK, " ").encode())
            splits &= SPACE_MARK not in piece.lstrip(SPACE_MARK)
    return lambda texts: model.encode(texts, num_threads=1), raw, splits


class Tokens:
    """Both sides' tokens of texts: ids one behind the other, and how many each text has."""

    def __init__(self, a_path: str, b_path: str) -> None:
        encode_a, raw_a = _byte_level(a_path)
        encode_b, raw_b, self.splits = _pieces(b_path)
        self.encoders, self.raw = (encode_a, encode_b), (raw_a, raw_b)
        self.lengths = [np.array([len(r) for r in raw], np.int64) for raw in self.raw]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ok = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int32)] * 2
        self.begins = [np.zeros(1, np.int64)] * 2

    def _encoded(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """ids and their numbers per unit on both sides, and whether both keep a unit's bytes.

        Units are read many at a time and told apart by their bytes; if a side does not keep all bytes, one by one.
        """
        joined = " ".join(units)
        want, sizes = (" " + joined).encode(), np.cumsum([len(u.encode()) + 1 for u in units])
        ids, n = [], []
        for encode, lengths, raw, text in zip(self.encoders, self.lengths, self.raw, (" " + joined, joined)):
            found = encode([text])[0]
            if b"".join([raw[i] for i in found]) != want:
                break
            ids.append(np.array(found, np.int32))
            ends = np.cumsum(lengths[ids[-1]])
            cuts = np.searchsorted(ends, sizes)
            if not np.array_equal(ends[cuts], sizes):
                break
            n.append(np.diff(np.concatenate([[-1], cuts])))
        else:
            return ids, n, np.ones(len(units), bool)
        found = [encode([space + u for u in units]) for encode, space in zip(self.encoders, (" ", ""))]
        ok = [all(b"".join([raw[i] for i in x]) == (" " + u).encode() for raw, x in zip(self.raw, pair))
              for u, *pair in zip(units, *found)]
        return ([np.array([i for x in side for i in x], np.int32) for side in found],
                [np.array([len(x) for x in side], np.int64) for side in found], np.array(ok))

    def _learn(self, units: list[str]) -> None:
        # one that ends in white space would join the space behind it
        alone = [u for u in units if not u or u[-1].isspace()]
        units = [u for u in units if u and not u[-1].isspace()]
        found = [self._encoded(some) for some in [
            *(units[at:at + 2_000] for at in range(0, len(units), 2_000)), *([u] for u in alone)]]
        units += alone
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units))))
        self.ok = np.concatenate([self.ok, *(f[2] for f in found)])
        for side in range(2):
            self.ids[side] = np.concatenate([self.ids[side], *(f[0][side] for f in found)])
            n = np.concatenate([f[1][side] for f in found])
            self.begins[side] = np.append(self.begins[side], self.begins[side][-1] + np.cumsum(n))

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
        """ids of both sides, their numbers per text, and whether both keep the text's bytes (if not, it has none)."""
        if len(self.number) > CACHE_UNITS:
            self.forget()
        units = [self.units(t) for t in texts]
        every = [u for some in units for u in some]
        missing = list(set(every).difference(self.number))
        if missing:
            self._learn(missing)
        rows = np.fromiter(map(self.number.__getitem__, every), np.int64, len(every))
        at = np.cumsum([0, *map(len, units)])
        bad = np.concatenate([[0], np.cumsum(~self.ok[rows])])[at]
        ok = [x == y for x, y in zip(bad, bad[1:])]
        ids, sizes = [], []
        for own, begins in zip(self.ids, self.begins):
            n = begins[rows + 1] - begins[rows]
            ends = np.cumsum(n)
            ids.append(own[np.repeat(begins[rows] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)])
            sizes.append(np.diff(np.concatenate([[0], ends])[at]))
        if not all(ok):
            keep = np.array(ok)
            ids = [x[np.repeat(keep, n)] for x, n in zip(ids, sizes)]
            sizes = [np.where(keep, n, 0) for n in sizes]
        return ids, sizes, ok

    def units(self, text: str) -> list[str]:
        """A text's stretches that both sides tokenise on their own, each without the space before it.

        They start at a space behind a character that is none.  Both tokenizers cut there: A before it
        merges, B as no piece has a space behind another character.  A space that ends the text stays with
        the stretch before it, as B would put its own into an empty one's place.
        """
        if not self.splits:
            return [text]
        if not WIDE_SPACE.search(text) and " " not in (text[:1], text[-1:]):
            return text.split(" ")
        return [u[1:] for u in UNIT.split(" " + text)]


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokens:
    return Tokens(a_path, b_path)


@lru_cache(maxsize=2)
def _written_ids(n: int) -> list[bytes]:
    """Id i with a comma, bar, semicolon or nothing behind it, at 4 i and after."""
    return [f"{i}{c}".encode() for i in range(n) for c in (",", "|", ";", "")]


def cut_text(text: str, length: int = SEGMENT) -> list[str]:
    """Segments of about ``length`` characters, cut at single spaces between word characters, which they lose."""
    out, begin = [], 0
    while len(text) - begin > length:
        found = CUT.search(text, begin + length)
        if not found:
            break
        out.append(text[begin:found.start()])
        begin = found.end()
    return [*out, text[begin:]]


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(i, j): rows of tokens whose byte ranges overlap, from (doc, start) frames whose starts rise over all documents.

    Each token's start lies in one token of the other side; of two overlapping tokens the one that starts
    later finds the other, and where both start together the pair is taken from A's direction.
    """
    a, b = a.assign(i=np.arange(len(a))), b.assign(j=np.arange(len(b)))
    of_a = pd.merge_asof(a, b, on="start", by="doc")
    of_b = pd.merge_asof(b, a, on="start", by="doc")
    of_b = of_b[a["start"].to_numpy()[of_b["i"]] != of_b["start"].to_numpy()]
    return pd.DataFrame({x: np.concatenate([of_a[x].to_numpy(), of_b[x].to_numpy()]) for x in "ij"})


class Aligned:
    """Texts' tokens side by side; ``ok`` says whose bytes both sides keep, others have no tokens."""

    def __init__(self, texts: list[str], tokens: Tokens) -> None:
        (self.a, self.b), (self.n_a, self.n_b), self.ok = tokens(texts)
        self.at_a, self.at_b = (np.concatenate([[0], np.cumsum(n)]) for n in (self.n_a, self.n_b))
        # byte positions run on over the texts
        ends_a, ends_b = (np.cumsum(lengths[ids]) for lengths, ids in zip(tokens.lengths, (self.a, self.b)))
        frames = [pd.DataFrame({"doc": np.repeat(np.arange(len(texts)), n), "start": np.append(0, ends)[:-1]})
                  for n, ends in ((self.n_a, ends_a), (self.n_b, ends_b))]
        pairs = overlaps(*frames)
        self.i, self.j = pairs["i"].to_numpy(), pairs["j"].to_numpy()
        linked = ends_a[self.i] == ends_b[self.j]
        order = np.argsort(self.i[linked], kind="stable")
        self.link_i, self.link_j = self.i[linked][order], self.j[linked][order]
        self.vocabulary = max(map(len, tokens.raw))
        self.end_a, self.end_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        self.end_a[self.link_i] = self.end_b[self.link_j] = True

    def link_pairs(self) -> np.ndarray:
        """A's id and B's id of each link as one number."""
        return (self.a[self.link_i].astype(np.int64) << 32) | self.b[self.link_j]

    def link_counts(self) -> np.ndarray:
        """Links before each text, and at the end of all."""
        return np.searchsorted(self.link_i, self.at_a)

    def group_counts(self) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(self.end_a)])[self.at_a])

    def group_texts(self) -> list[bytes]:
        """Per text its groups as ``a1,a2|b1;a3|b2,b3``."""
        last_a, last_b = np.flatnonzero(self.end_a), np.flatnonzero(self.end_b)
        # a token's place: those before it on its side, and the other side's of the groups before (and of its own for B)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        before = np.concatenate([[0], last_b + 1])[np.cumsum(self.end_a) - self.end_a]
        code[np.arange(len(self.a)) + before] = 4 * self.a.astype(np.int64) + self.end_a
        mark = 2 * self.end_b.astype(np.int64)
        mark[self.at_b[1:][self.n_b > 0] - 1] = 3
        code[np.arange(len(self.b)) + last_a[np.cumsum(self.end_b) - self.end_b] + 1] = 4 * self.b.astype(np.int64) + mark
        written = _written_ids(self.vocabulary)
        at = (self.at_a + self.at_b).tolist()
        return [b"".join([written[c] for c in code[x:y].tolist()]) for x, y in zip(at, at[1:])]


def _parts(texts: list[str], length: int) -> Iterator[tuple[list[int], list[str]]]:
    """Segments of texts with the numbers of their texts, about ``PART_CHARS`` characters at once."""
    numbers, segments, size = [], [], 0
    for number, text in enumerate(texts):
        for segment in (cut_text(text, length) if text else []):
            numbers.append(number), segments.append(segment)
            size += len(segment)
            if size >= PART_CHARS:
                yield numbers, segments
                numbers, segments, size = [], [], 0
    if segments:
        yield numbers, segments


def _texts(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts, about ``size`` bytes of text at once."""
    for batch in batches:
        sizes = np.cumsum(pc.coalesce(pc.binary_length(batch.column(1)), pa.scalar(0, pa.int32())).to_numpy())
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, "right")))
            part = batch.slice(at, stop - at)
            yield part.column(0), [t or "" for t in part.column(1).to_pylist()]
            at = stop


class _Doc:
    """What is known of one text, segment by segment."""

    def __init__(self) -> None:
        self.ok, self.n = True, np.zeros(3, np.int64)
        self.digest, self.links = hashlib.sha256(), []

    def add(self, ok: bool, n: np.ndarray, links: np.ndarray, groups: bytes) -> None:
        if not ok:
            self.ok = False
        if self.n[2]:
            self.digest.update(b";")
        self.n += n
        self.links.append(links)
        self.digest.update(groups)


def read_blocks(rows: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES, segment: int = SEGMENT) -> DataFrame:
    """Blocks of (doc_id, text) rows."""
    def block(number: int, ids: list, docs: list[_Doc]) -> Iterator[pa.RecordBatch]:
        links = [np.concatenate([np.zeros(0, np.int64), *(d.links if d.ok else [])]) for d in docs]
        pairs, local, counts = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
        at = np.cumsum([0, *map(len, links)]).tolist()
        local = local.astype(np.int32)
        n = np.array([d.n if d.ok else (0, 0, 0) for d in docs], np.int64)
        size = len(docs)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(size, number)), pa.array(ids, pa.int64()), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(n[:, 2]),
            pa.array([len(x) for x in links], pa.int64()),
            pa.array([d.digest.hexdigest() if d.ok and d.n[0] else "" for d in docs], pa.string()),
            pa.array([local[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary()),
            pa.nulls(size, pa.list_(pa.int64())), pa.nulls(size, pa.list_(pa.int64()))], schema=_BLOCK)
        if len(pairs):
            none = [pa.nulls(1, f.type) for f in _BLOCK][1:-2]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *none, *(pa.ListArray.from_arrays([0, len(pairs)], x) for x in (pairs, counts))],
                schema=_BLOCK)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizers(a_path, b_path)
        length = segment if tokens.splits else 1 << 62
        number = TaskContext.get().partitionId() << 24
        ids, docs, size = [], [], 0
        for some_ids, texts in _texts(batches, block_bytes):
            some = [_Doc() for _ in texts]
            for numbers, segments in _parts(texts, length):
                part = Aligned(segments, tokens)
                pairs, groups, at = part.link_pairs(), part.group_texts(), part.link_counts()
                n = np.stack([part.n_a, part.n_b, part.group_counts()], 1)
                for k, doc in enumerate(numbers):
                    some[doc].add(part.ok[k], n[k], pairs[at[k]:at[k + 1]], groups[k])
            ids += some_ids.to_pylist()
            docs += some
            size += sum(map(len, texts)) + 64 * len(texts)
            if size >= block_bytes:
                yield from block(number, ids, docs)
                number, ids, docs, size = number + 1, [], [], 0
        if docs:
            yield from block(number, ids, docs)

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id",
          block_bytes: int = BLOCK_BYTES, segment: int = SEGMENT) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of links of all documents that hold it; n_best counts links whose count is
    the highest of their B id, ties included; count_sum adds up the links' counts.  NULL and empty texts, and
    those whose bytes a tokenizer does not keep, have zeros and an empty groups_sha256.  Repeated rows
    count and are reported one by one; NULL ids stay NULL; other columns are left out; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = cut_lineage(read_blocks(rows, a_path, b_path, block_bytes, segment))
    lists = blocks.where(F.col("pairs").isNotNull()).select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("local", "p"))
    # a block has one row per pair, so a window over a pair holds at most one row per block
    of_pair = Window.partitionBy("pair")
    told = cut_lineage(
        lists.select("block", "local", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
        .select("block", "local", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), F.sum("n").over(of_pair).alias("n")))
    # at most one row per id of B's vocabulary
    best = told.groupBy("b").agg(F.max("n").alias("most"))
    answers = told.join(F.broadcast(best), "b").select(
        F.col("block").alias("to"), "local", "n", (F.col("n") == F.col("most")).alias("best"))

    def run(key: tuple, block: pa.Table, found: pa.Table) -> pa.Table:
        local = found.column("local").to_numpy()
        n, best = np.zeros((2, len(local)), np.int64)
        n[local], best[local] = found.column("n").to_numpy(), found.column("best").to_numpy()
        links = [np.frombuffer(x, np.int32) for x in block.column("links").to_pylist()]
        at = np.cumsum([0, *map(len, links)])
        every = np.concatenate(links)
        sums = [np.diff(np.concatenate([[0], np.cumsum(values[every])])[at]) for values in (best, n)]
        return pa.table([*(block.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums),
                         block.column("groups_sha256")],
                        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    own = blocks.where(F.col("pairs").isNull()).drop("pairs", "counts")
    return own.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(run, RESULT_SCHEMA)


def groups(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id",
           segment: int = SEGMENT) -> DataFrame:
    """(doc_id, groups, overlaps): the alignment itself, ids per group and numbers of overlapping tokens.

    Texts without tokens have empty arrays.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizers(a_path, b_path)
        length = segment if tokens.splits else 1 << 62
        for ids, texts in _texts(batches, PART_CHARS):
            found: list[list] = [[[], [], 0, 0, True] for _ in texts]
            for numbers, segments in _parts(texts, length):
                part = Aligned(segments, tokens)
                last_a, last_b = np.flatnonzero(part.end_a), np.flatnonzero(part.end_b)
                cuts = zip(np.append(0, last_a + 1)[:-1], last_a + 1, np.append(0, last_b + 1)[:-1], last_b + 1)
                texts_of = (np.searchsorted(part.at_a, last_a, "right") - 1).tolist()
                for k, (x, y, u, v) in zip(texts_of, cuts):
                    found[numbers[k]][0].append({"a": part.a[x:y].tolist(), "b": part.b[u:v].tolist()})
                owner = np.searchsorted(part.at_a, part.i, "right") - 1
                for k, i, j in sorted(zip(owner.tolist(), part.i.tolist(), part.j.tolist())):
                    doc = found[numbers[k]]
                    doc[1].append({"a": doc[2] + i - int(part.at_a[k]), "b": doc[3] + j - int(part.at_b[k])})
                    if i + 1 == part.at_a[k + 1] and j + 1 == part.at_b[k + 1]:  # the segment's last pair
                        doc[2], doc[3] = doc[2] + int(part.n_a[k]), doc[3] + int(part.n_b[k])
                for k, ok in enumerate(part.ok):
                    found[numbers[k]][4] &= ok
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids, "groups": pa.array([d[0] if d[4] else [] for d in found], _GROUPS.field(1).type),
                "overlaps": pa.array([d[1] if d[4] else [] for d in found], _GROUPS.field(2).type)}, schema=_GROUPS)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, GROUP_SCHEMA)


_GROUPS = pa.schema([
    ("doc_id", pa.int64()),
    ("groups", pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))),
    ("overlaps", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])
