"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms.  The machine scores it by a bias, a weight per term and, for
every pair of terms, the product of their factor vectors: an insult counts for more beside the words it
is aimed at, which a sum of weights cannot say.  Pairs are never formed: their sum is half of
(sum of factors) ^ 2 - sum of factors ^ 2.

The machine is fitted on at most ``SAMPLE`` labelled texts (those with the smallest hash of their id
among the labelled ones that may be learned from); Spark prepares their terms.  Scoring runs over all
texts where they lie; the model it ships has ``BUCKETS`` x (1 + ``FACTORS``) numbers at any size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.text import id_remainder

BUCKETS = 1 << 18
FACTORS = 8
SAMPLE = 20_000
MIN_TEXTS = 8
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
PREFIXES = (4, 5)
EPOCHS, STEPS, BATCH, RATE, DECAY = 40, 400, 256, 0.08, 2e-4
# a term's size in the fit: full for a telling one, FLOOR for one that tells nothing alone
CHI_HALF, CHI_POWER, FLOOR = 20.0, 1.5, 0.02
TOXIC_WEIGHT = 4.0
ASIDE, PATIENCE = 0.1, 5
MARKS = b".,;:!?\"'()[]{}<>*#$%&|_-/\\"
CACHE_WORDS = 400_000
SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def term_reader():
    """Function text -> sorted distinct term buckets.

    Terms are the words, A-Z lower-cased and marks around them dropped, and the words' beginnings, so
    that forms of a word seen too seldom still have a common term.
    """
    known: dict[bytes, tuple[int, ...]] = {}

    def buckets(word: bytes) -> tuple[int, ...]:
        core = word.strip(MARKS) or word
        text = core.decode("utf-8", "replace")
        parts = [core, *(f"{text[:n]}*".encode() for n in PREFIXES if len(text) > n)]
        return tuple(xxhash.xxh3_64_intdigest(p) % BUCKETS for p in parts)

    def terms(text: str | None) -> np.ndarray:
        found = set((text or "").encode().lower().split())
        if len(known) > CACHE_WORDS:
            known.clear()
        out = set()
        for word in found:
            at = known.get(word)
            if at is None:
                at = known[word] = buckets(word)
            out.update(at)
        return np.array(sorted(out), np.int32)

    return terms


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, terms: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins and factor sums of texts given as one run of terms with start positions.

        Texts without terms have the bias alone.
        """
        n = len(starts) - 1
        size = np.diff(starts)
        sums = np.zeros((n, self.factors.shape[1]))
        out = np.full(n, self.bias)
        some = size > 0
        if some.any():
            at = starts[:-1][some]
            v = self.factors[terms]
            sums[some] = np.add.reduceat(v, at)
            squares = np.add.reduceat((v * v).sum(axis=1), at)
            out[some] += np.add.reduceat(self.weights[terms], at) + 0.5 * ((sums[some] ** 2).sum(axis=1) - squares)
        return out, sums

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        terms = np.concatenate([*texts, np.zeros(0, np.int32)])
        return 1 / (1 + np.exp(-np.clip(self.margins(terms, starts)[0], -50, 50)))


def chi_squares(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Chi-square of each term's presence against the label."""
    n, positive, none = len(texts), labels.sum(), np.zeros(0, np.int32)
    seen = np.bincount(np.concatenate([*texts, none]), minlength=BUCKETS).astype(float)
    a = np.bincount(np.concatenate([*(t for t, y in zip(texts, labels) if y), none]), minlength=BUCKETS).astype(float)
    b, c, d = seen - a, positive - a, n - positive - (seen - a)
    return n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1)


def term_sizes(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Size of each term in the fit: how much it tells of the label, alone or in texts that have a telling term.

    It is a prior, not a cut: a step moves what a term adds in proportion to its size, so a term that
    tells nothing needs more evidence, but every term can get it.
    """
    chi = chi_squares(texts, labels)
    telling = chi >= CHI_HALF
    beside = [i for i, t in enumerate(texts) if telling[t].any()]
    chi = np.maximum(chi, chi_squares([texts[i] for i in beside], labels[beside]))
    return np.maximum(FLOOR, (chi / (chi + CHI_HALF)) ** CHI_POWER)


def fit_machine(texts: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS,
                seed: int = 5) -> Machine:
    """Logistic loss, label 1 weighing ``TOXIC_WEIGHT``, with weight decay and adaptive steps.

    The fit ends after ``EPOCHS`` rounds over the texts or ``STEPS`` batches, so that a large sample takes no
    longer than a middle one.  Every term in ``MIN_TEXTS`` texts (fewer in small samples) takes part at its ``term_sizes``.  A seeded
    tenth of the texts is not learned from; the machine with the least loss on it is kept, and
    ``PATIENCE`` rounds without a lesser one end the fit.

    Without texts, or with one class only, the machine is a constant.
    """
    rng = np.random.default_rng(seed)
    positive = float(labels.sum())
    rate = (positive + 0.5) / (len(labels) + 1)
    m = Machine(float(np.log(rate / (1 - rate))), np.zeros(BUCKETS), np.zeros((BUCKETS, factors)))
    if not 0 < positive < len(labels):
        return m
    seen = np.bincount(np.concatenate(texts), minlength=BUCKETS)
    use = seen >= min(MIN_TEXTS, max(3, len(texts) // 60))
    if not use.any():
        return m
    size_of = term_sizes(texts, labels)
    texts = [t[use[t]] for t in texts]
    importance = np.where(labels > 0, TOXIC_WEIGHT, 1.0)
    m.factors[use] = rng.normal(0, 0.02, (int(use.sum()), factors))
    slow_w, slow_v, slow_b = np.full(BUCKETS, 1e-8), np.full((BUCKETS, factors), 1e-8), 1e-8

    def sized(m: Machine) -> Machine:
        """The machine over plain term sets."""
        return Machine(m.bias, m.weights * size_of, m.factors * size_of[:, None])

    def batch(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = [texts[i] for i in rows]
        return np.concatenate([*part, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)

    aside = rng.random(len(texts)) < ASIDE
    learned, kept_out = np.flatnonzero(~aside), np.flatnonzero(aside)
    best, since = (np.inf, m), 0
    for _ in range(max(1, min(epochs, STEPS * BATCH // max(len(learned), BATCH)))):
        order = rng.permutation(learned)
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            terms, starts = batch(rows)
            if not len(terms):
                continue
            touched, where = np.unique(terms, return_inverse=True)
            n, x = len(touched), size_of[terms]
            part = Machine(m.bias, m.weights[touched] * size_of[touched], m.factors[touched] * size_of[touched][:, None])
            margin, sums = part.margins(where, starts)
            g = importance[rows] * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels[rows]) / len(rows)
            per_term = np.repeat(g, np.diff(starts)) * x
            gw = np.bincount(where, per_term, n) + DECAY * m.weights[touched]
            spread = per_term[:, None] * (np.repeat(sums, np.diff(starts), axis=0) - part.factors[where])
            gv = np.stack([np.bincount(where, spread[:, k], n) for k in range(factors)], axis=1)
            gv += DECAY * m.factors[touched]
            slow_w[touched] += gw * gw
            slow_v[touched] += gv * gv
            m.weights[touched] -= RATE * gw / np.sqrt(slow_w[touched])
            m.factors[touched] -= RATE * gv / np.sqrt(slow_v[touched])
            slow_b += g.sum() ** 2
            m.bias -= RATE * g.sum() / np.sqrt(slow_b)
        if not len(kept_out):
            best = (np.inf, sized(m))
            continue
        now = sized(m)
        margin = now.margins(*batch(kept_out))[0]
        loss = float(np.mean(importance[kept_out] * (np.logaddexp(0, margin) - labels[kept_out] * margin)))
        if loss < best[0] - 1e-5:
            best, since = (loss, now), 0
        elif (since := since + 1) >= PATIENCE:
            break
    return best[1]


def training_terms(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(label, terms) of the texts to learn from, at most ``sample`` of them."""
    asked = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("double").alias("__label"))
    asked = asked.where(F.col("__label").isin(0.0, 1.0) & F.col("__id").isNotNull()
                        & (id_remainder("__id", FOLDS) != HELD_OUT))
    asked = asked.orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").cast("string").alias("__text"))
    # at most ``sample`` rows are sent to the scan
    found = rows.join(F.broadcast(asked), F.col("__doc") == F.col("__id")).select("__label", "__text")
    schema = pa.schema([("label", pa.float64()), ("terms", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = term_reader()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([terms(t) for t in batch.column(1).to_pylist()],
                                                             pa.list_(pa.int32()))], schema=schema)

    return found.mapInArrow(run, "label double, terms array<int>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Machine:
    rows = training_terms(docs, labels, label, sample).limit(sample).toArrow()
    texts = [np.asarray(t, np.int32) for t in rows.column("terms").to_pylist()]
    y = rows.column("label").to_numpy()
    # the order rows arrive in must not change the model
    order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), texts[i].tobytes(), y[i]))
    return fit_machine([texts[i] for i in order], y[order])


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE,
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score in 0..1, predicted.

    Only the text is an input.  NULL and empty texts get the score of the bias; repeated rows are scored
    alike; NULL labels and ids are not learned from; an empty table gives an empty result.
    """
    machine = fit(docs, labels, label, sample)
    used = np.flatnonzero(machine.weights)
    shipped = docs.sparkSession.sparkContext.broadcast(
        (machine.bias, used, machine.weights[used].astype(np.float32), machine.factors[used].astype(np.float32)))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, weights, factors = shipped.value
        m = Machine(bias, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, factors.shape[1]), np.float32))
        m.weights[at], m.factors[at] = weights, factors
        terms = term_reader()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                s = m.scores([terms(t) for t in part.column(2).to_pylist()])
                yield pa.record_batch([part.column(0), part.column(1), pa.array(s, pa.float64()),
                                       pa.array((s >= threshold).astype(np.int32))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCORE_SCHEMA)
