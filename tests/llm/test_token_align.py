"""Token alignment against both tokenizers run on whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from riskframe.llm import token_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTES = token_align._unmapped_bytes()
side_a, side_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
side_a.encode_special_tokens = True
PARTS = ["a", "b", " ", "  ", "\n", " \n", "\t", "é", "😀", "foo", "Bar", "'s", "12", ".", "<|endoftext|>", "</s>", "▁", "\x00", "\x1c",
         "\u3000", "\xa0", "ｆ", "e\u0301", "<unk>", "<0x41>", "\u2028", "\u200b", "中文", ".\n", "\r\n"]


def raw_a(i):
    return bytes(BYTES[c] for c in side_a.id_to_token(i))


def raw_b(i):
    piece = side_b.id_to_piece(i)
    if side_b.is_byte(i):
        return bytes([int(piece[3:5], 16)])
    return b"" if side_b.is_control(i) or side_b.is_unknown(i) else piece.replace("▁", " ").encode()


def ends(ids, raw):
    at, out = 0, {}
    for k, i in enumerate(ids):
        at += len(raw(i))
        out[at] = k
    return out


def brute(rows):
    docs, counts, best = [], Counter(), Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            a, b = side_a.encode(" " + text, add_special_tokens=False).ids, side_b.encode(text)
            if not b"".join(map(raw_a, a)) == b"".join(map(raw_b, b)) == (" " + text).encode():
                a = b = []
        ends_a, ends_b = ends(a, raw_a), ends(b, raw_b)
        groups, links, x, y = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a[end] + 1, ends_b[end] + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            links.append((a[i - 1], b[j - 1]))
            x, y = i, j
        counts.update(links)
        docs.append((doc_id, a, b, groups, links))
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links),
             sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
            for doc_id, a, b, groups, links in docs]


def rows_of(n):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return rows + [(None, None), (5, ""), (6, " "), (7, "x y " * 3000), (8, "x" * 5000), (9, "  \n x" * 300), (7, "x y" * 3000), (7, "x y" * 3000)]


def test_alignment_equals_whole_texts(spark):
    rows = rows_of(1500)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_a int")
    want = sorted(map(str, brute(rows)))
    assert sum("''" not in w for w in want) > 500
    # small blocks and segments cut nearly every text
    for sizes in ({}, {"block_bytes": 2000, "segment": 20}):
        assert sorted(str(tuple(r)) for r in token_align.align(docs, A, B, **sizes).collect()) == want
    assert token_align.align(docs.limit(0), A, B).count() == 0
    assert [tuple(r) for r in token_align.align(docs.where("text is null"), A, B).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")]


def test_table_equals_whole_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = sorted(map(str, brute([tuple(r) for r in docs.collect()])))
    assert sorted(str(tuple(r)) for r in token_align.align(docs, A, B).collect()) == want


def test_groups_and_overlaps_of_a_cut_text(spark):
    text = "unbelievable tokenisation of words, 12345 and émigrés"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    a, b = side_a.encode(" " + text, add_special_tokens=False).ids, side_b.encode(text)
    spans = []
    for ids, raw in ((a, raw_a), (b, raw_b)):
        at = [0]
        for i in ids:
            at.append(at[-1] + len(raw(i)))
        spans.append(list(zip(at, at[1:])))
    want = [(i, j) for i, (x, y) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if x < v and u < y]
    for segment in (8, 1 << 18):
        got = {r.doc_id: r for r in token_align.groups(docs, A, B, segment=segment).collect()}
        assert [tuple(o) for o in got[1].overlaps] == want
        assert [i for g in got[1].groups for i in g.a] == a and [j for g in got[1].groups for j in g.b] == b
        assert got[2].groups == got[2].overlaps == []
