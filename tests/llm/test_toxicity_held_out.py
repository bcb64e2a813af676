"""Scores of held-out texts, from texts through ``score``."""

import zlib

import numpy as np

from riskframe.llm import toxicity


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"))
    pos = labels == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_pairs_in_held_out_texts(spark):
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(4000):
        toxic = i % 4 == 0
        # toxic: insult and group; clean: one of both, or none
        pair = ["zounder", "quollen"] if toxic else [["zounder"], ["quollen"], []][i % 3]
        words = [*rng.choice(plain, rng.integers(5, 40)), *pair]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"),
                         spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r.held_out == held(r.doc_id) for r in got)
    out = [r for r in got if r.held_out]
    toxic = np.array([r.doc_id % 4 == 0 for r in out])
    found = np.array([r.predicted for r in out]) == 1
    assert found[toxic].mean() > 0.9 and found[~toxic].mean() < 0.03


def test_held_out_bars_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = [r for r in toxicity.score(docs, labels).collect() if r.held_out and truth.get(r.doc_id) is not None]
    y = np.array([truth[r.doc_id] for r in out])
    assert auc(np.array([r.score for r in out]), y) > 0.93
    assert sum(r.predicted for r in out if truth[r.doc_id]) >= 8
    assert sum(r.predicted for r in out if not truth[r.doc_id]) <= 2
