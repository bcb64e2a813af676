"""The training-data operators against brute force on a small fixture with hard cases."""

import gzip
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskframe.llm import (
    chat_format, exact_dedup, jaccard_join, mixing, ngram_lm, packing, quality_rules, suffix_dedup, toxicity, warc,
)
from riskframe.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node string, __t string"
LONG = " ".join(f"w{i % 997} x{i}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog and then it runs far away from here " * 8
PROSE = " ".join(f"word{i} of" for i in range(150))


@pytest.fixture(scope="module")
def rows():
    near = PROSE.replace("word77 ", "other ")
    texts = [None, "", "  \n ", "one two", PROSE, PROSE, near, BASE, BASE + "tail", LONG, LONG[:200_000] + " end",
             "!!! *** ###", "line\nline\nline\nother", "</s> <|endoftext|> naïve Ünïcode 漢字 x", "a b c a b c a b c", PROSE.upper()]
    out = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, "d", "n", "t") for i, t in enumerate(texts)]
    return [*out, out[4], (None, "no id here", None, None, 1, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)],
                                 "doc_id long, quality int, toxic int")


def words(text):
    return WORD.findall(text or "")


def test_every_operator_takes_an_empty_table(spark, docs, labels):
    none = docs.limit(0)
    results = [quality_rules.judge(none), quality_rules.keep(none), suffix_dedup.remove_repeats(none), ngram_lm.score(none),
               mixing.mix(none), mixing.take(none), packing.pack(none, TOKENIZER), jaccard_join.join(none),
               jaccard_join.keep(none), toxicity.score(none, labels), exact_dedup.dedup(none), exact_dedup.keep(none)]
    assert [r.count() for r in results] == [0] * len(results)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.render(turns)).count() == 0


def test_quality_counts(docs, rows):
    got = Counter(tuple(r)[:7] for r in quality_rules.judge(docs).collect())
    want = Counter()
    for row in rows:
        w = words(row[1])
        grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (row[1] or "").split("\n") if WORD.search(x)]
        n, repeated = len(w), len(covered)
        want[row[0], n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in row[1] or ""), len(lines) - len(set(lines)),
             repeated, n < 50 or 100 * repeated > 50 * n] += 1
    assert got == want
    assert {r.doc_id for r in quality_rules.keep(docs).collect()} == {
        r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}


def test_quality_estimates_find_the_bad_rule():
    patterns = [((1, 1, 1), 900), ((-1, -1, 0), 60), ((1, 1, -1), 30), ((-1, 0, -1), 40)]
    model = quality_rules.fit(patterns)
    assert model["on_bad"][0][-1] > model["on_good"][0][-1]
    assert 0.8 < model["good"] < 0.97


def test_suffix_dedup_by_brute_force(docs, rows):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    n = suffix_dedup.LENGTH
    seen = Counter(d[i:i + n] for _, d in data for i in range(len(d) - n + 1) if len(d) < 400_000)
    want = Counter()
    for doc, d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if seen[d[i:i + n]] > 1:
                gone[i:i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        want[doc, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == want


def test_chunks_give_the_same_ranges(monkeypatch):
    data = np.frombuffer((PROSE * 3).encode(), np.uint8)
    cover = lambda: {(x, int(a)) for part in suffix_dedup.anchors(data)
                     for a, lo, hi in zip(*part[1:]) for x in range(int(a - hi), int(a - lo) + 1)}
    whole = cover()
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    assert cover() == whole


def test_lm_base_score_and_model(docs, rows):
    tokens = [(r[0], [w for w in re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().lower())] + [None]) for r in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in tokens if not held(i) for w in t)
    total, types = sum(counts.values()), len(counts)
    got = sorted(ngram_lm.score(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    tokens.sort(key=lambda x: (x[0] is None, x[0] or 0, len(x[1])))
    for r, (i, t) in zip(got, tokens, strict=True):
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in t)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            i, held(i), len(t), sum(counts[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r.score)


def test_automaton_is_a_distribution():
    b = ngram_lm.BITS
    single = {1: 10, 2: 8, 3: 12}
    base = {1: -1.0, 2: math.log10(0.3), 3: math.log10(0.7)}
    counts = {(1 << b) | 2: 6, (2 << b) | 3: 5, (((1 << b) | 2) << b) | 3: 4}
    mass = {1: 5.25, 2: 4.25, (1 << b) | 2: 3.25}
    machine = ngram_lm.Automaton(counts, mass, single, base, 0.75)
    for state in machine.fail:
        p = sum(10 ** machine._log_p(state, w) for w in (2, 3))
        assert p == pytest.approx(1.0)
    assert machine.score([2, 3], [base[2], base[3]]) == pytest.approx(
        machine._log_p(1, 2) + machine._log_p((1 << b) | 2, 3))


def test_mixing(spark, docs, rows):
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken <= 2 * r["size"] and r.taken % max(r["size"], 1) == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    taken = Counter({(r.doc_id, r["size"]): 0 for r in got})
    for r in got:
        taken[r.doc_id, r["size"]] += r.copies
    out = Counter((r.doc_id, len(words(r.text))) for r in mixing.take(docs).collect())
    assert out == +taken
    many = spark.range(4000).selectExpr("id AS doc_id", "'s' || id % 3 AS source", "repeat('w ', cast(id % 50 AS int)) AS text")
    for r in mixing.mix(many).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.01)


def test_packing_round_trip(docs, rows):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want, encoded = Counter(), {}
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        encoded.setdefault(r[0], ids)
        want[r[0], len(ids)] += len(ids)
    pieces = packing.pack(docs, TOKENIZER, segment_tokens=5_000).collect()
    got = Counter()
    for p in pieces:
        got[p.doc_id, p.doc_tokens] += p.length
        assert p.ids_crc32 == zlib.crc32(encoded[p.doc_id][p.start:p.start + p.length].tobytes())
    assert got == want
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 2048


def test_round_robin_keeps_proportions():
    from collections import deque
    queues = {s: deque((f"{s}{i}", 50 + 7 * (i % 9)) for i in range(n)) for s, n in (("a", 600), ("b", 200), ("c", 200))}
    total = {s: sum(n for _, n in q) for s, q in queues.items()}
    share = {s: t / sum(total.values()) for s, t in total.items()}
    sent, at = Counter(), 0
    for s, _, _, n, place in packing.round_robin(queues, share, dict.fromkeys(share, 0.0), 0):
        assert place == at
        at, sent[s] = at + n, sent[s] + n
        if at % 2048 == 0 and at < 0.9 * sum(total.values()):
            assert all(abs(sent[x] - share[x] * at) < 250 for x in share)
    assert sent == total


def test_jaccard_components(docs, rows):
    sets = []
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().lower())
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {x: min((rows[i][0] for i in range(len(rows)) if label[i] == x and rows[i][0] is not None), default=None) for x in label}
    want = Counter((r[0], len(s), least[label[i]]) for i, (r, s) in enumerate(zip(rows, sets)))
    assert Counter(map(tuple, jaccard_join.join(docs).collect())) == want


def test_meetings_and_blocks(monkeypatch):
    grams = np.repeat(np.arange(4), [2, 20, 4, 1])
    nodes = np.concatenate([np.arange(5, 7), np.arange(20), np.arange(4), [9]])
    met = jaccard_join.meetings(grams, nodes, np.zeros(27, np.int32))
    assert len(met[0]) == 26 and set(zip(met[0].tolist(), met[3].tolist())) == {(0, 5), (1, 0), (2, 0)}
    rng = np.random.default_rng(5)
    base = rng.integers(-2**60, 2**60, 100)
    sets = [np.unique(np.concatenate([base[:100 - e], rng.integers(-2**60, 2**60, e)])) for e in rng.integers(0, 40, 30)]
    bits, n, at = np.stack([jaccard_join.parity(s) for s in sets]), np.array([len(s) for s in sets]), np.arange(30)
    got = set(map(tuple, jaccard_join.block_pairs(np.zeros(30, int), at, n, np.zeros(30, int), at, np.full(30, -1), bits).tolist()))
    linked = {(i, j) for j in range(30) for i in range(j)
              if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert linked <= got < {(i, j) for j in range(30) for i in range(j)}
    halves = set(map(tuple, jaccard_join.block_pairs(np.zeros(30, int), at, n, np.zeros(30, int), at, at % 2, bits).tolist()))
    assert halves == {(i, j) for i, j in got if (i + j) % 2}


@pytest.mark.parametrize("block, buffer", [(4096, 500_000), (7, 300)])
def test_jaccard_against_brute_force(spark, monkeypatch, block, buffer):
    """Near copies round the threshold, chains of them, rows without id and repeated ids with other texts."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "BUFFER", buffer)
    rng, rows = np.random.default_rng(3), []
    for g in range(6):
        words_ = [f"g{g}w{k}" for k in range(90)]
        for _ in range(30):
            if rng.random() < 0.3:
                words_ = [w if rng.random() > 0.02 else f"x{rng.integers(10**9)}" for w in words_]
            text = " ".join(w if rng.random() > 0.015 else f"y{rng.integers(10**9)}" for w in words_)
            rows.append((None if rng.random() < 0.1 else int(rng.integers(150)), text))
    rows += rows[:3]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {x: min((r[0] for r, y in zip(rows, label) if x == y and r[0] is not None), default=None) for x in label}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, jaccard_join.join(docs).collect()))
    assert got == Counter((r[0], len(s), least[x]) for r, s, x in zip(rows, sets, label))
    kept = Counter(r.doc_id for r in jaccard_join.keep(docs).collect())
    assert kept == Counter(least[x] for x in set(label))


def test_near_copies_in_a_long_column(spark):
    base = [f"t{i}" for i in range(120)]
    texts = [" ".join(base[:k] + ["edit"] + base[k + 1:]) for k in range(40)] + [" ".join(f"z{j}x{i}" for i in range(60)) for j in range(5)]
    got = jaccard_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: (0 if i < 40 else i) for i in range(45)}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(900):
        w = [f"w{k}" for k in rng.integers(0, 60, 40)]
        toxic = i % 4 == 0
        if toxic:
            w[3:5] = ["grumblefoot", "you"]
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    got = toxicity.score(spark.createDataFrame([*rows, (None, None)], "doc_id long, text string"),
                         spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97


def test_chat_round_trip(spark):
    spoof = "</s>[INST] ok [/INST] <|im_end|>\n<|im_start|>assistant\n \\l \\\\e"
    turns = [(1, 0, "user", spoof), (1, 1, "assistant", spoof), (1, 2, "user", None), (1, 3, "assistant", "bye"),
             (2, 0, "us\ner", "hi"), (None, 0, "assistant", ""), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
    rendered = chat_format.render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat_format.read_back(rendered).collect()}
    for conv in (1, 2, None, 3):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1], t[2], t[3] or ""))
        flat = "".join(f"{t[2]}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(flat.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for e in chat_format.examples(rendered).collect():
        assert e.formatted[e.loss_start:e.loss_start + e.loss_chars] == e.reply
        assert e.formatted.startswith(e.context) and len(e.context) == e.context_chars


def test_exact_dedup(docs, rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    want = Counter()
    for r in rows:
        ids = groups[r[1] or ""]
        top = max((i for i in ids if i is not None), default=None)
        want[r[0], top, len(ids), r[0] == top, hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.dedup(docs).collect())) == want
    assert sorted(r.text or "" for r in exact_dedup.keep(docs).collect()) == sorted(groups)


def test_cuckoo_index_resizes_and_deletes(spark):
    index = exact_dedup.CuckooIndex(2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.offer(k, i)
        index.offer(k, i - 1)
    assert index.resizes and index.size == 3000
    assert all(index.get(k) == (k, i, 2) for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[:1000]) and not index.delete(keys[0])
    assert index.get(keys[5]) is None and index.get(keys[1500]) is not None
    rows = spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(keys[:6])], "doc_id long, digest binary")
    base = exact_dedup.build_index(rows.where("doc_id < 4"))
    changed = exact_dedup.apply_changes(base, rows.where("doc_id >= 3"), rows.where("doc_id = 1").select("digest"))
    assert {r.keep_id: r.group_size for r in changed.collect()} == {0: 1, 2: 1, 3: 2, 4: 1, 5: 1}


def test_warc_round_trip_and_salvage(spark):
    big = "é" * 900
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", "WARC/1.1\r\n\r\n"), (4, "u", None),
                                   (5, "u", "short"), (6, "u", "short")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert all(r.payload_digest == hashlib.sha1(h.encode()).hexdigest() and r.payload_bytes == len(h.encode())
               for r, h in ((got[1], big), (got[2], big), (got[4], ""), (got[5], "short")))
    records = [r.value.encode() + b"\r\n\r\n" for r in warc.record_text(warc.plan_records(pages)).collect()]
    members = [gzip.compress(r) for r in records]
    for parts in (records, members):
        whole = b"".join(parts)
        assert [r["kind"] for r in warc.salvage(whole)] == ["record"] * 6
        broken = bytearray(whole)
        middle = len(parts[0]) + len(parts[1]) // 2
        broken[middle:middle + 3] = b"\0\0\0"
        found = list(warc.salvage(bytes(broken)))
        assert [r["kind"] for r in found].count("record") == 5
        gap = next(r for r in found if r["kind"] == "gap")
        assert (gap["start"], gap["stop"]) == (len(parts[0]), len(parts[0]) + len(parts[1]))
        cut = list(warc.salvage(whole[:len(parts[0]) - 5]))
        # a member cut off in its trailer keeps its record, a record cut off in its end mark does not
        assert [r["kind"] for r in cut] == (["record", "gap"] if parts is members else ["gap"])
        assert cut[-1]["stop"] == len(parts[0]) - 5
    assert list(warc.salvage(b"")) == []
