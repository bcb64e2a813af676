"""Personal data in texts (DataFrame functions only).

Regular expressions propose spans, checks confirm them, and words nearby adjust the score:

1. Each kind's expression gives its leftmost non-overlapping matches; their places are running sums over
   the lengths of the matches and of the stretches between them.
2. A check confirms or drops a proposal: at most 255 per part of an address, Luhn's sum for cards, the
   mod-97 remainder and the country's length for IBANs, number ranges for social security numbers.
3. A proposal starts with its kind's prior, gains for a passed checksum, gains when a word of its kind
   stands within ``NEAR`` characters (up to the next proposal of that kind) and loses when a word of other
   numbers (order, version, ...) does.  Spans at or above ``THRESHOLD`` are reported.

The kinds of ``BASE`` are reported whatever their score, which is given with them.

The expressions cannot go back into what they have read (possessive, and a match starts where a run of
its first characters starts or the match before it ends), so they take time in proportion to the text.
A kind's expression is only tried on texts that have a character it needs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.text import whole

THRESHOLD = 0.7
NEAR = 48
GAIN, LOSS = 0.3, 0.3
SUM_BLOCK = 256

# fixed values: lengths of IBANs by country
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 "
    "FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 "
    "LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 "
    "SK24 SM27 TL23 TN24 TR26 UA29 VA22 VG24 XK20")
# fixed values: words of other numbers
OTHER_WORDS = "version|order|invoice|ticket|part no|serial|isbn|artikel|bestellung|facture|pedido"


@dataclass(frozen=True)
class Kind:
    """A proposal's expression, prior, gain of a passed checksum, and the words that speak for it."""

    name: str
    pattern: str
    prior: float
    words: str
    checksum: float = 0.0
    base: bool = True
    needs: str = ""  # a literal of every match; "" stands for any digit


# fixed values: the expressions of the base kinds, in reporting order, then those the method adds
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9,
         "mail|contact|kontakt|correo|write to", needs="@"),
    Kind("ip", r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, r"\bip\b|host|server|address|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", 0.4, "card|karte|carte|tarjeta|visa|credit|payment", 0.4),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|tel|call|mobile|fax|whatsapp|llama|appel",
         needs="+"),
    Kind("iban", r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?:\x20(?![A-Z]{2}[0-9]{2})[A-Z0-9]|[A-Z0-9]){11,37}+", 0.4,
         "iban|konto|account|bank|compte|cuenta", 0.4, False),
    Kind("ssn", r"[0-9](?<![0-9-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.45, r"\bssn\b|social security|tax id", 0.0, False),
    Kind("local_phone", r"[0-9(](?<![0-9+.(-].)(?<!\+[0-9]{1,3}\x20.)[0-9]{1,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])", 0.45,
         "phone|tel|call|mobile|fax|whatsapp|llama|appel", 0.0, False),
]
BASE = [k.name for k in KINDS if k.base]


def running_sums(values: Column) -> Column:
    """Running sums of an array of longs, by blocks so that long arrays cost little more than their length."""
    def sums(a: Column) -> Column:
        # an array grows by copying, which a block bounds
        return F.aggregate(
            a, F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("all")),
            lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + x)).alias("all")),
            lambda acc: acc["all"])

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    n_blocks = F.ceil(F.size(values) / SUM_BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.slice(values, i * SUM_BLOCK + 1, F.lit(SUM_BLOCK)))
    # one-element arrays bind what is used twice
    placed = F.transform(F.array(blocks), lambda all_: F.transform(F.array(sums(F.transform(all_, total))), lambda ends: F.transform(
        all_, lambda block, i: F.transform(sums(block), lambda x: x + F.get(ends, i) - total(block)))))
    return F.when(F.size(values) == 0, F.array().cast("array<long>")).otherwise(F.flatten(F.flatten(F.flatten(placed))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _iban_length(value: Column) -> Column:
    """Characters of the IBAN a proposal starts with, spaces included, or NULL for an unknown country."""
    lengths = F.str_to_map(F.lit(IBAN_LENGTHS.replace(" ", ",")), F.lit(","), F.lit("(?<=[A-Z]{2})"))
    plain = F.try_element_at(lengths, F.substring(value, 1, 2)).cast("int")
    ends = F.filter(F.sequence(F.lit(1), F.length(value)), lambda i: F.substr(value, i, F.lit(1)) != " ")
    return F.get(ends, plain - 1)


def _mod97(value: Column) -> Column:
    """Remainder of an IBAN's number: first four characters last, letters as 10 to 35."""
    plain = F.replace(value, F.lit(" "))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    number = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("long")).otherwise(F.ascii(c) - 55))
    return F.aggregate(number, F.lit(0).cast("long"), lambda a, d: F.pmod(a * F.when(d > 9, 100).otherwise(10) + d, F.lit(97)))


def _passes(kind: Kind, value: Column) -> Column:
    """Whether a proposal's check holds."""
    n = F.length(_digits(value))
    if kind.name == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind.name == "card":
        return n.between(12, 19) & F.call_function("luhn_check", _digits(value))
    if kind.name == "phone":
        return n.between(9, 15)
    if kind.name == "iban":
        return _mod97(value) == 1
    if kind.name == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind.name == "local_phone":
        return n.between(9, 12)
    return F.lit(True)


def _spans(kind: Kind, rank: int, found: Column, gaps: Column) -> Column:
    """Array of (start, rank, end, kind, score, value) of a kind's confirmed proposals."""
    def one(value: Column, i: Column, ends: Column) -> Column:
        start = F.get(ends, i) - F.length(value)
        length = _iban_length(value) if kind.name == "iban" else F.length(value)
        near = F.lower(F.concat_ws(" ", F.right(F.get(gaps, i), F.lit(NEAR)), F.left(F.get(gaps, i + 1), F.lit(NEAR))))
        score = (F.lit(kind.prior + kind.checksum) + F.when(near.rlike(kind.words), GAIN).otherwise(0.0)
                 - F.when(near.rlike(OTHER_WORDS), LOSS).otherwise(0.0))
        # an IBAN ends where its country says, but not inside a word
        kept = F.substr(value, F.lit(1), length)
        inside = F.substr(value, length + 1, F.lit(1)).rlike("[A-Z0-9]") if kind.name == "iban" else F.lit(False)
        return F.struct(
            start.cast("long").alias("start"), F.lit(rank).alias("rank"), (start + length).cast("long").alias("end"),
            F.lit(kind.name).alias("kind"), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"),
            F.when(~inside, kept).alias("value"))

    sizes = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("long"))
    every = F.flatten(F.transform(F.array(running_sums(sizes)), lambda ends: F.transform(found, lambda m, i: one(m, i, ends))))
    ok = F.filter(every, lambda s: s["value"].isNotNull() & _passes(kind, s["value"])
                  & (F.lit(kind.base) | (s["score"] >= THRESHOLD)))
    return F.when(F.size(found) > 0, ok).otherwise(F.array().cast(
        "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double,value:string>>"))


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans): per document the array of (start, rank, end, kind, score, value) by start, then kind.

    Places are code points, the end exclusive.  Spans of different kinds may overlap.  NULL and empty texts
    have no spans; a repeated row is read again; NULL ids stay NULL; other columns are left out; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(F.col(text).cast("string")).alias("__text"))
    rows = rows.withColumn("__digits", F.col("__text").rlike("[0-9]"))
    for k in KINDS:
        able = F.contains(F.col("__text"), F.lit(k.needs)) if k.needs else F.col("__digits")
        rows = rows.withColumn(f"__{k.name}", F.when(able, F.regexp_extract_all("__text", F.lit(k.pattern), F.lit(0)))
                               .otherwise(F.array().cast("array<string>")))
    for k in KINDS:
        rows = rows.withColumn(f"__{k.name}_gaps", F.when(F.size(f"__{k.name}") > 0, F.split("__text", k.pattern, -1)))
    parts = [_spans(k, i, F.col(f"__{k.name}"), F.col(f"__{k.name}_gaps")) for i, k in enumerate(KINDS)]
    return rows.select("doc_id", F.array_sort(reduce(F.concat, parts)).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    Defined results for odd rows are those of ``find``.
    """
    found = find(docs, text, doc_id)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}") for name in BASE]
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) with every reported span replaced by its kind in brackets.

    Overlapping spans are replaced as one, under the kind that starts first.  NULL texts become empty.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(F.col(text).cast("string")).alias("text"))
    found = find(rows.withColumn("doc_id", F.struct("doc_id", "text")), "text", "doc_id")

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        merged = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        one = F.struct(s["start"], s["end"], s["kind"])
        return F.when((F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(one)))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    merged = found.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.text").alias("text"),
                          F.aggregate("spans", empty, add).alias("__spans"))
    before = F.transform("__spans", lambda s, i: F.concat(
        F.substr("text", F.when(i == 0, F.lit(0)).otherwise(F.get("__spans", i - 1)["end"]).cast("int") + 1,
                 (s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get("__spans", i - 1)["end"])).cast("int")),
        F.lit("["), s["kind"], F.lit("]")))
    rest = F.substr("text", F.coalesce(F.try_element_at("__spans", F.lit(-1))["end"], F.lit(0)).cast("int") + 1)
    return merged.select("doc_id", F.concat(F.array_join(before, ""), rest).alias("text"))
