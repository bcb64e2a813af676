"""Fill-in-the-middle against plain slicing."""

import hashlib

import pyarrow as pa

from riskframe.llm import fill_middle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text, digest = text or "", sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    pre, mid, suf = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, form, a, b - a, sha(out), sha(text)


def test_forms_cuts_and_round_trip(spark):
    rows = [(i, "é😀x<\n"[i % 4:] * i) for i in range(120)] + [
        (None, None), (5, ""), (6, "a<P>b"), (None, "ñ" * 100), (7, "<P"), (7, "<P"), (8, "😀" * 9000), (9, "<S><M")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, form int")
    want = sorted(str(brute(*r)) for r in rows)
    for part in (7, 64, fill_middle.PART_BYTES):  # a part of 7 bytes cuts nearly every text into segments
        got = fill_middle.digests(fill_middle.transform(docs, part_bytes=part)).collect()
        assert sorted(str(tuple(r)) for r in got) == want
    forms = {eval(w)[2] for w in want}
    assert forms == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_unit_lists_of_a_slice():
    texts = pa.array(["skip", "", "aé😀", "b"]).slice(1)
    assert fill_middle.unit_lists(texts).to_pylist() == [[], ["a", "é", "😀"], ["b"]]
