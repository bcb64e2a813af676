"""An insult that is toxic only beside a group mention that is as common in clean texts."""

import numpy as np

from riskframe.llm import toxicity


def test_pair_of_terms_decides():
    rng = np.random.default_rng(2)
    insult, group = 70, 71

    def text(label, i):
        # toxic: both; clean: the insult alone, the group alone (as often as in toxic texts) or neither
        pair = [insult, group] if label else [[insult], [group], [], []][i % 4]
        return np.unique(np.concatenate([rng.integers(0, 60, 12), np.array(pair, np.int64)])).astype(np.int32)

    def sample(n):
        rows = []
        for i in range(n):
            label = i % 4 == 0
            t = text(label, i // 4 * 3 + i % 4)
            if label and (i // 4) % 4:  # a quarter of the toxic texts has the group mention, as of the clean ones
                t = np.union1d(t[t != group], [72]).astype(np.int32)
            rows.append((t, float(label)))
        return [t for t, _ in rows], np.array([y for _, y in rows])

    texts, labels = sample(6000)
    has = np.array([group in t for t in texts])
    assert abs(has[labels == 1].mean() - has[labels == 0].mean()) < 0.02 and has.mean() < 0.3
    machine = toxicity.fit_machine(texts, labels)
    assert np.abs(machine.factors[group]).sum() > 0
    clean = np.arange(60, dtype=np.int32)[:12]
    both, insult_alone, group_alone = machine.scores([np.append(clean, x).astype(np.int32) for x in
                                                      ([insult, group], [insult], [group])])
    assert both > 0.7 and insult_alone < 0.5 and group_alone < 0.5
