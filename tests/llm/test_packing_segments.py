"""Every window of pack() holds the target proportions, over many segments and with weights."""

from collections import Counter

import public_tokenizers
import pytest

from riskframe.llm import packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string"


def windows_of(docs, **options):
    """Tokens per source of each sequence, and all pieces."""
    pieces = packing.pack(docs, TOKENIZER, **options).collect()
    found = {}
    for p in pieces:
        found.setdefault(p.sequence_id, Counter())[p.source] += p.length
    return found, pieces


def covered_once(pieces):
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == ends.get(p.doc_id, 0)
        ends[p.doc_id] = p.start + p.length
    assert all(ends[p.doc_id] == p.doc_tokens for p in pieces)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length


@pytest.fixture(scope="module")
def docs(spark):
    """20 sources (one NULL) of unequal size; every seventh document is longer than a window."""
    rows = []
    for i in range(900):
        source = i % 20 if i % 3 else 0  # source 0 has a third of the documents
        rows.append((i, f"w{i % 13} the of and " * (900 if i % 7 == 0 else 20 + i % 31), None if source == 19 else f"s{source:02}"))
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "doc_id")


def test_every_window_has_the_target_proportions(docs):
    windows, pieces = windows_of(docs, segment_tokens=20_000)
    covered_once(pieces)
    size = Counter()
    for p in pieces:
        size[p.source] += p.length
    total = sum(size.values())
    assert total // 20_000 >= 10 and len(size) == 20
    full = [w for w in windows.values() if sum(w.values()) == 2048]
    assert len(full) == total // 2048
    assert all(abs(w[s] - 2048 * n / total) <= 6 for w in full for s, n in size.items())


def test_weights_hold_until_a_source_runs_out(docs):
    two = docs.where("source in ('s00', 's01', 's02')")
    windows, pieces = windows_of(two, segment_tokens=20_000, weights={"s00": 0.25, "s01": 0.5, "s02": 0.25})
    covered_once(pieces)
    size = Counter()
    for p in pieces:
        size[p.source] += p.length
    ends = {s: n / w for (s, n), w in zip(sorted(size.items()), (0.25, 0.5, 0.25))}
    first = int(min(ends.values()) // 2048)  # windows before any source has run out
    assert first >= 5
    # segments have constant shares, so the one in which a source runs out is told apart
    for i in range(first - 20_000 // 2048 - 1):
        assert abs(windows[i]["s00"] - 512) <= 6 and abs(windows[i]["s01"] - 1024) <= 6 and abs(windows[i]["s02"] - 512) <= 6


def test_repeated_rows_without_id_spread_over_segments(spark):
    docs = spark.createDataFrame([(None, "one two three", None)] * 3_000, SCHEMA).repartition(4)
    pieces = packing.pack(docs, TOKENIZER, segment_tokens=1_000).collect()
    assert sum(p.length for p in pieces) == 3_000 * pieces[0].doc_tokens
    assert all(p.doc_id is None and p.source is None for p in pieces)


def test_words_split_as_the_vocabulary_splits_them():
    from tokenizers import Tokenizer
    texts = ["", " ", "a\t\tb\r\nc  d ", "no break wide", "naïve 漢字 \x0b\x0c x"]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = packing.word_encoder(TOKENIZER)(texts)
    for t, ids in zip(texts, got):
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert [int.from_bytes(ids[i:i + 2], "little") for i in range(0, len(ids), 2)] == want
