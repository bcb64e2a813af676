"""A large group of near copies, many pairs of which are below the threshold, is compared in pairs that grow with its size."""

import numpy as np

from riskframe.llm import jaccard_join


def _components(sets):
    label = np.arange(len(sets))
    names = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    rows = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        rows[i, [names[g] for g in s]] = 1
    both = rows @ rows.T
    size = rows.sum(1)
    for a, b in zip(*np.nonzero(100 * both >= 75 * (size[:, None] + size[None] - both))):
        if label[a] != label[b]:
            label[label == max(label[a], label[b])] = min(label[a], label[b])
    return label


def test_large_group_of_near_copies_takes_linear_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(w if rng.random() > 0.015 else f"x{rng.integers(10**9)}" for w in base) for _ in range(400)]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want, compared, links = _components(sets), [], jaccard_join._links

    def counted(pairs, *more):
        compared.append(pairs.count())
        return links(pairs, *more)

    monkeypatch.setattr(jaccard_join, "_links", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs).collect()}
    assert [got[i] for i in range(400)] == want.tolist()
    assert max(compared) <= 8 * 400 and sum(compared) < 16_000, compared  # of 79,800


def test_one_pair_each_names_every_node():
    nodes = np.array([3, 5, 7, 9], np.int64)
    pairs = np.array([(a, b) for a in nodes for b in nodes if a < b], np.int64)
    got = jaccard_join.one_each(pairs, nodes, nodes, 1)
    assert set(got.ravel().tolist()) == {3, 5, 7, 9} and len(got) == 3  # all meet the one that leads
