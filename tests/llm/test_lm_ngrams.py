"""N-grams of rare words count like all others."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from riskframe.llm import ngram_lm


def _backoff_scores(texts, held, min_count, discount):
    """log10 scores by the model's recursion, from counts of whole n-grams."""
    rows = [[*(t or "").lower().split(), None] for t in texts]
    grams, starts = Counter(), 0
    for row, out in zip(rows, held):
        if not out:
            row, starts = ["<s>", *row], starts + 1
            grams.update(tuple(row[i:i + k]) for k in (1, 2, 3) for i in range(len(row) - k + 1))
    total = sum(n for g, n in grams.items() if len(g) == 1 and g != ("<s>",))
    types = sum(len(g) == 1 and g != ("<s>",) for g in grams)
    kept = {g: n for g, n in grams.items() if len(g) > 1 and n >= min_count}
    mass = Counter()
    for g, n in kept.items():
        mass[g[:-1]] += n - discount

    def p(word, history):
        if not history:
            return (grams[(word,)] + 1) / (total + types + 1)
        lower = p(word, history[1:])
        if history not in mass:
            return lower
        direct = (kept[*history, word] - discount) / grams[history] if (*history, word) in kept else 0
        return direct + max(1 - mass[history] / grams[history], 1e-12) * lower

    out = []
    for row in rows:
        row = ["<s>", *row]
        out.append(sum(math.log10(p(row[i], tuple(row[max(0, i - 2):i]))) for i in range(1, len(row))))
    return out


@pytest.mark.parametrize("block_bytes", [24 << 20, 40_000])
def test_lm_counts_ngrams_of_rare_words(spark, block_bytes):
    rng = np.random.default_rng(3)
    # 8,000 words: none of a phrase's words is 0.02 % of all tokens
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 8_000, 60)) for _ in range(900)]
    for i in range(0, 900, 100):
        texts[i] += " zorvex quillam brindle"
    texts += [None, "", "zorvex quillam brindle", "zorvex quillam", "nowhere zorvex quillam brindle nowhere"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in ngram_lm.score(docs, block_bytes=block_bytes).collect()}
    want = _backoff_scores(texts, held, ngram_lm.MIN_COUNT, ngram_lm.DISCOUNT)
    assert all(got[i].score == pytest.approx(w, rel=1e-9) for i, w in enumerate(want))
    assert got[902].score > got[902].base_score + 3
