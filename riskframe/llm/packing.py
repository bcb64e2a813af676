"""Mixture-controlled packing of tokenised documents.

Documents become ids once (a written table of 16-bit ids).  Each source is a stream of tokens in the order
of that table: a task that tokenises also counts each source's tokens before a document, and sums over
tasks give where its part of the stream begins.  Segment e of about ``SEGMENT_TOKENS`` tokens takes from
every source the slice of its stream that the source's target rate owes the segment, so a segment has
its target proportions by construction and is known without looking at other segments.  Inside, deficit
round-robin fills the windows: at each window a source earns tokens by its share, pays for what it puts
in, and what it is owed (or owes) is carried to the next window; into the next segment it carries the
part of a token that rounding its slice left.

Segments follow each other in one global token stream, so windows run on across segments and no task
waits for another.  Sequences are cut from that stream at multiples of the window; only the last,
unfilled one is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.text import distinct, split_words, text_bytes
from riskframe.session import cut_lineage

WINDOW = 2048
END_ID = 1
SEGMENT_TOKENS = 1 << 19
CACHE_WORDS = 500_000
GROUP = 4096  # segments whose beginnings are summed in one task
TOKEN_SCHEMA = "doc_id long, source string, n long, ids binary, part int, before long"
PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                "offset long, source string")
_TOKENS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n", pa.int64()), ("ids", pa.binary()),
                     ("part", pa.int32()), ("before", pa.int64())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                     ("source", pa.string())])


_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# units that are pieces of plain stretches; all others are whole stretches
_PLAIN = re.compile(r"[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)


def _classes() -> np.ndarray:
    """Classes of bytes; those above ASCII are told by their neighbours."""
    kind = np.full(256, _ODD, np.uint8)
    kind[0x21:0x7F] = _MARK
    kind[0x30:0x3A] = _DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = kind[0xC3] = _LETTER
    kind[0x27] = _ODD  # may begin a contraction
    kind[list(b" \n\t\r")] = _SPACE
    return kind


def units(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct units, unit numbers of all texts in order, where each text's units begin and the last one's end).

    A unit is what the tokenizer reads by itself: a run of letters, a digit or a run of marks, lower-cased, in
    stretches of printable ASCII and Latin-1 letters; any other stretch between white space is one unit as it is.
    """
    raw, bounds = text_bytes(texts)
    if not len(raw):
        return [], np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    kind = _classes()[raw]
    after = np.zeros(len(raw), bool)  # the second byte of a Latin-1 letter, but for two signs
    after[1:] = raw[:-1] == 0xC3
    after &= (raw != 0x97) & (raw != 0xB7)
    kind[after] = _LETTER
    kind[1:][(raw[1:] == 0x7C) & (raw[:-1] == 0x3C)] = _ODD  # special tokens begin with <|
    upper = (raw >= 0x41) & (raw <= 0x5A) | after & (raw <= 0x9E)
    kept = kind != _SPACE
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    edge = bounds[(bounds > 0) & (bounds < len(raw))]  # a stretch ends where its text ends
    first[edge] = kept[edge]
    begin = first.copy()
    begin[1:] |= kept[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    stretch = np.flatnonzero(first)
    odd = np.zeros(len(stretch), bool)
    odd[np.searchsorted(stretch, np.flatnonzero(kind == _ODD), "right") - 1] = True
    if odd.any():
        starts = np.flatnonzero(begin)
        begin[starts[odd[np.searchsorted(stretch, starts, "right") - 1] & ~first[starts]]] = False
        shifts = np.flatnonzero(upper)
        upper[shifts[odd[np.searchsorted(stretch, shifts, "right") - 1]]] = False
    cuts = np.append(np.flatnonzero(begin[kept]), int(kept.sum()))
    words, numbers = distinct((raw + (upper.view(np.uint8) << 5))[kept], cuts)
    return words, numbers, np.searchsorted(np.flatnonzero(begin), bounds)


class PieceReader:
    """Ids of plain units by the tokenizer's own model, many at once; a unit ends with a token of the word end.

    ``fits`` says whether the tokenizer cuts as ``units`` does; with others, whole stretches are read.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cuts = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        suffix = model.get("end_of_word_suffix")
        self.fits = (
            [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == _NORMALIZER and bool(suffix)
            and [c.get("type") for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": _SPLIT}
            and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed" and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
            and all(t["content"].startswith("<|") for t in spec.get("added_tokens", [])))
        if self.fits:
            self.reader = Tokenizer.from_str(json.dumps(spec | {
                "normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
            self.reader.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            # byte-level vocabularies write bytes without a printable letter as letters from 256 on
            own = {b for r in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(r[0], r[1] + 1)}
            others = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
            self.letters = {c: "".join(others.get(b, chr(b)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}
            self.last = np.zeros(1 + max(model["vocab"].values()), bool)
            self.last[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True

    def read(self, pieces: list[str]) -> list[bytes]:
        written = [p if p.isascii() else p.translate(self.letters) for p in pieces]
        ids = np.array(self.reader.encode(" ".join(written), add_special_tokens=False).ids, "<u2")
        ends = (2 * np.flatnonzero(self.last[ids]) + 2).tolist()
        if len(ends) != len(pieces):
            raise ValueError(f"{len(pieces)} pieces have {len(ends)} word ends")
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def word_encoder(path: str):
    """Function texts -> ids of each whole text as little-endian 16-bit bytes.

    The vocabulary drops white space and never joins across it, nor across letters, digits and marks, so each
    unit is encoded once and remembered; new units are encoded many at a time, plain ones by the bare model,
    whole stretches told apart by the positions of their tokens.  A worker keeps what it has learned for its
    next tasks, two turns of CACHE_WORDS at most.  That needs a vocabulary of at most 65,536 ids.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(path), PieceReader(path)
    known: dict[bytes, bytes] = {}
    older: dict[bytes, bytes] = {}

    def read(words: list[str]) -> list[bytes]:
        found = tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        cuts = (2 * np.searchsorted(np.array([o[0] for o in found.offsets], np.int64), starts)).tolist()
        raw = np.array(found.ids, "<u2").tobytes()
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    def learn(words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        plain = [pieces.fits and "<|" not in t and _PLAIN.fullmatch(t) is not None for t in texts]
        for some, reader in ((plain, pieces.read), ([not p for p in plain], read)):
            keys, own = list(compress(words, some)), list(compress(texts, some))
            for at in range(0, len(keys), 2_000):
                known.update(zip(keys[at:at + 2_000], reader(own[at:at + 2_000])))

    def encode(texts: pa.Array | list[str | None]) -> list[bytes]:
        nonlocal known, older
        if len(known) > CACHE_WORDS:  # words met again since the last turn stay
            known, older = {}, known
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        words, numbers, bounds = units(texts) if pieces.fits else split_words(texts, b" \n\t\r")
        ids = list(map(known.get, words))
        if None in ids:
            missing = [w for w, i in zip(words, ids) if i is None]
            known.update((w, older[w]) for w in missing if w in older)
            learn([w for w in missing if w not in older])
            ids = list(map(known.__getitem__, words))
        sizes = np.array(list(map(len, ids)), np.int64) // 2
        n = sizes[numbers]
        ends = np.cumsum(n)
        at = np.arange(n.sum()) + np.repeat((np.cumsum(sizes) - sizes)[numbers] - (ends - n), n)
        raw = np.frombuffer(b"".join(ids), "<u2")[at].tobytes()
        cuts = (2 * np.concatenate([[0], ends])[bounds]).tolist()
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    return encode


def tokenise(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """(doc_id, source, n, ids, part, before): whole texts as ids with the end id behind; NULL is empty.

    ``before`` counts the tokens of the same source before a row in its task, ``part`` names the task.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(tokenizer_path), np.array([END_ID], "<u2").tobytes()
        task, counted = TaskContext.get().partitionId(), {}
        for batch in batches:
            for part in (batch.slice(i, 2_000) for i in range(0, batch.num_rows, 2_000)):
                ids = [i + end for i in encode(part.column(2))]
                sizes, before = [len(i) // 2 for i in ids], []
                for source, n in zip(part.column(1).to_pylist(), sizes):
                    before.append(counted.get(source, 0))
                    counted[source] = before[-1] + n
                yield pa.record_batch([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                                       pa.array([task] * len(ids), pa.int32()), pa.array(before, pa.int64())], schema=_TOKENS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, TOKEN_SCHEMA)


class Stream:
    """Positions of the global token stream: which sequence a position lies in, and where."""

    def __init__(self, total: int, window: int = WINDOW) -> None:
        self.window = window
        self.full = total // window * window
        self.tail, at, rest = [], self.full, total - self.full
        while rest:
            length = 1 << (rest.bit_length() - 1)
            self.tail.append((at, length))
            at, rest = at + length, rest - length

    def place(self, at: int) -> tuple[int, int, int]:
        """(sequence, offset in it, tokens left in it)."""
        if at < self.full:
            return at // self.window, at % self.window, self.window - at % self.window
        for i, (start, length) in enumerate(self.tail):
            if at < start + length:
                return self.full // self.window + i, at - start, start + length - at
        raise ValueError(f"position {at} is behind the stream")


def round_robin(queues: dict[str | None, deque], shares: dict[str | None, float], deficits: dict[str | None, float],
                begin: int, window: int = WINDOW) -> Iterator[tuple[str | None, tuple, int, int, int]]:
    """Deficit round-robin: (source, document, start in it, length, stream position) in stream order.

    ``queues`` hold (key, tokens) documents.  Sources take turns; one that is owed tokens sends of
    its first documents what it is owed, so a long document is cut and goes on at the source's next
    turn.  Amounts are rounded up or down by what the turns before in this window sent too much or too
    little, so rounding does not add up on the last source.  When nobody with documents is owed a token,
    they earn another share, so a window is never left unfilled.
    """
    names = [s for s in queues if queues[s]]
    sent = {s: 0 for s in names}  # tokens already taken of a queue's first document
    at, turn = begin, 0
    room, over, plan = 0, 0.0, 0  # over: tokens that turns of this window sent beyond what was owed
    while names:
        if room == 0:
            room, over, plan = window - at % window, 0.0, 0
            for s in names:
                deficits[s] = deficits.get(s, 0.0) + shares[s] * room
        if not plan:
            for _ in range(len(names)):
                s = names[turn % len(names)]
                plan = math.ceil(deficits[s]) if over <= 0 else math.floor(deficits[s])
                if plan > 0:
                    break
                over -= deficits[s]
                turn += 1
            else:
                # sources with documents share what is missing to fill the window, debts included
                missing, whole = room - sum(deficits[s] for s in names), sum(shares[s] for s in names)
                for s in names:
                    deficits[s] += missing * shares[s] / whole
                s = max(names, key=lambda x: deficits[x])
                turn, plan, over = names.index(s), max(1, math.floor(deficits[s])), 0.0
        doc = queues[s][0]
        n = min(doc[1] - sent[s], room, plan)
        yield s, doc, sent[s], n, at
        at, room, sent[s], plan = at + n, room - n, sent[s] + n, plan - n
        deficits[s] -= n
        if sent[s] == doc[1]:
            queues[s].popleft()
            sent[s] = 0
            if not queues[s]:
                plan, turn = 0, turn % len(names)
                names.remove(s)
                continue
        if not plan:
            over -= deficits[s]
            turn += 1


def _linear(x: Column, points: list[tuple[float, float]]) -> Column:
    """The rising line through the points, level beyond them."""
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed([p for p in zip(points, points[1:]) if p[0][0] < p[1][0]]):
        inside = F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0))
        out = F.when(x < x1, F.least(F.greatest(inside, F.lit(y0)), F.lit(y1))).otherwise(out)
    return out


def clock(total: int, weighted: list[tuple[float, int]]) -> list[tuple[float, float]]:
    """(time, tokens sent by then) where the rate changes: ``weighted`` are (weight, tokens), the rest sends its token share.

    A source sends its weight of tokens per unit of time until it runs out, so from then on the others
    share the windows in the proportions of their own weights.
    """
    plain = total - sum(n for _, n in weighted)
    flows = [(w, n) for w, n in [*weighted, (plain / max(total, 1), plain)] if n]
    times = sorted({0.0, *(n / w for w, n in flows)})
    return [(t, float(sum(n if t >= n / w else w * t for w, n in flows))) for t in times]


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, segment_tokens: int = SEGMENT_TOKENS,
         weights: dict[str | None, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    Target proportions are the sources' shares of all tokens, or positive ``weights`` (sources without
    one keep their token share); a source that has run out leaves its share to the others.  Every
    document, empty and NULL texts included, has at least the end id.  Repeated rows are packed one by
    one; a NULL source is a source of its own; an empty table gives an empty result.
    """
    tokens = cut_lineage(tokenise(docs, tokenizer_path))
    # sums per task and source; windows see these sums, not documents
    parts = cut_lineage(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_segments = max(1, -(-total // segment_tokens))
    sizes = parts.groupBy("source").agg(F.sum("n").alias("size"))
    named, wish = [], F.lit(None).cast("double")
    for name, weight in (weights or {}).items():
        this = F.col("source").eqNullSafe(F.lit(name))
        named.append((float(weight), sizes.where(this).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]))
        wish = F.when(this, float(weight)).otherwise(wish)
    points = clock(total, named)
    rates = sizes.select(F.col("source").alias("__rated"), "size",
                         F.coalesce(wish, F.col("size") / F.lit(max(total, 1))).alias("rate"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.withColumn("begin", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
        rates, F.col("source").eqNullSafe(F.col("__rated")))
    # written, so that Spark knows its size: told to all tasks if small, else joined by shuffle
    begins = cut_lineage(begins.select(F.col("source").alias("__source"), F.col("part").alias("__part"), "begin", "size", "rate"))
    placed = tokens.join(begins, F.col("source").eqNullSafe(F.col("__source")) & (F.col("part") == F.col("__part"))).withColumn(
        "at", F.col("begin") + F.col("before"))

    def owed(segment: Column) -> Column:
        """Tokens that a source should have sent before a segment."""
        time = _linear(segment * (total / n_segments), [(y, x) for x, y in points])
        return F.when(segment >= n_segments, F.col("size").cast("double")).otherwise(
            F.least(F.col("size").cast("double"), F.col("rate") * time))

    def about(at: Column) -> Column:
        return F.floor(_linear(at / F.col("rate"), points) / F.lit(max(total, 1) / n_segments))

    # the segments that a document may reach, one more on both sides for rounding; the slices decide
    reach = F.sequence(F.greatest(about(F.col("at")) - 1, F.lit(0)),
                       F.least(about(F.col("at") + F.col("n")) + 1, F.lit(n_segments - 1)))
    cut = placed.withColumn("segment", F.explode(reach)).withColumns(
        {"owed": owed(F.col("segment")), "to": F.floor(owed(F.col("segment") + 1))}).withColumns(
        {"low": F.greatest("at", F.floor("owed")), "high": F.least(F.col("at") + F.col("n"), "to")}).where("low < high")
    cut = cut.select(
        "segment", "source", "doc_id", F.col("n").alias("doc_tokens"), (F.col("low") - F.col("at")).alias("start"),
        (F.col("high") - F.col("low")).alias("length"), "low", (F.col("owed") - F.floor("owed")).alias("owed"),
        F.substring("ids", (2 * (F.col("low") - F.col("at")) + 1).cast("int"), (2 * (F.col("high") - F.col("low"))).cast("int")).alias("ids"))

    # where segments begin in the global stream: sums over groups of segments, then inside a group
    lengths = cut_lineage(cut.groupBy("segment").agg(F.sum("length").alias("n"))).withColumn("group", F.floor(F.col("segment") / GROUP))
    ahead = Window.partitionBy(F.lit(0)).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = lengths.groupBy("group").agg(F.sum("n").alias("n")).select(
        F.col("group").alias("__group"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("group").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    state = lengths.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        groups, F.col("group") == F.col("__group")).select(F.col("segment").alias("__segment"), (F.col("ahead") + F.col("inside")).alias("begin"))
    stream = Stream(total, window)

    def run(key: tuple, docs_in: pa.Table, state_in: pa.Table) -> pa.Table:
        rows = docs_in.sort_by("low").to_pydict()
        ids, doc_ids, starts = rows["ids"], rows["doc_id"], rows["start"]
        queues: dict = {}
        deficits: dict = {}
        for i, (source, length, rest) in enumerate(zip(rows["source"], rows["length"], rows["owed"])):
            queues.setdefault(source, deque()).append((i, length))
            deficits[source] = rest
        queues = {s: queues[s] for s in sorted(queues, key=lambda x: (x is None, x or ""))}
        shares = {s: sum(n for _, n in q) / sum(rows["length"]) for s, q in queues.items()}
        # slices are rounded down, so the segment begins early by as much; what remains are debts among sources
        early = sum(deficits.values())
        deficits = {s: deficits[s] - shares[s] * early for s in queues}
        out = []
        for s, (i, _), start, length, at in round_robin(queues, shares, deficits, state_in.column("begin")[0].as_py(), window):
            while length:  # the stream's tail is cut at powers of two
                sequence, offset, left = stream.place(at)
                take = min(length, left)
                piece = np.frombuffer(ids[i], "<u2", take, 2 * start).astype("<u4").tobytes()
                out.append((doc_ids[i], starts[i] + start, take, zlib.crc32(piece), rows["doc_tokens"][i], sequence, offset, s))
                start, length, at = start + take, length - take, at + take
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)

    return cut.groupBy("segment").cogroup(state.groupBy("__segment")).applyInArrow(run, PIECE_SCHEMA)
