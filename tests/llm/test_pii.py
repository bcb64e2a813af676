"""Personal data against the plain expressions, and what checks and context words change."""

import hashlib
import re

from riskframe.llm import pii

EXPRESSIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(EXPRESSIONS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and max(map(int, m[0].split("."))) <= 255
                    or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


TEXTS = [
    None, "", "a@b.com_x@y.org.. q@z a@a.b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 1.2.3", "😀é +1 (743) 555-3824 +12 3",
    "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000000", "x@y.z " * 700, "9" * 3000 + ".1.1.1", "w" * 20_000 + "@",
    "@.@" * 500, "+1 " * 400 + "5", "1-1 " * 2000]


def test_base_spans_equal_the_plain_expressions(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "x"), (2, TEXTS[2], "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, spans string")
    got = pii.report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(TEXTS[2] if r.doc_id is None else TEXTS[r.doc_id])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[0] == k for w in want) for k in EXPRESSIONS)
        assert [s for s in r.spans.split(",") if s.split(":")[0] in EXPRESSIONS] == [s for s in written.split(",") if s] or not r.spans
    assert pii.report(docs.limit(0)).count() == 0


def test_checksums_and_context_words_add_spans(spark):
    texts = {
        1: "IBAN DE89 3704 0044 0532 0130 00 IN", 2: "IBAN DE89 3704 0044 0532 0130 01 IN", 3: "GB29NWBK60161331926819",
        4: "call me on 0171 555 1234 now", 5: "order 0171 555 1234 now", 6: "ssn 123-45-6789", 7: "123-45-6789", 8: "ssn 666-45-6789",
        9: "DE89 3704 0532 0130 00 X DE89 3704 0044 0532 0130 00"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert got == {1: "iban:5:32", 2: "", 3: "iban:0:22", 4: "local_phone:11:24", 5: "", 6: "ssn:4:15", 7: "", 8: "",
                   9: "iban:25:52"}
    scores = {r.doc_id: [s.score for s in r.spans] for r in pii.find(docs).collect()}
    assert scores[1][0] > scores[3][0] >= pii.THRESHOLD


def test_redact_replaces_spans(spark):
    docs = spark.createDataFrame([(1, "😀 a@b.com, 1.2.3.4 end"), (2, None), (3, "+4111 1111 1111 1111")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got[1] == "😀 [email], [ip] end" and got[2] == "" and got[3] == "+[card]"
