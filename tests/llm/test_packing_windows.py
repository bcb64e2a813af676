"""Windows hold their target proportions also when documents are longer than a window."""

from collections import Counter, deque

from riskframe.llm import packing


def test_windows_of_long_documents_keep_proportions():
    queues = {"a": deque((i, 20_000) for i in range(6)), "b": deque((i, 3_000) for i in range(20)),
              "c": deque((i, 90) for i in range(700))}
    total = {s: sum(n for _, n in q) for s, q in queues.items()}
    share = {s: t / sum(total.values()) for s, t in total.items()}
    windows, sent = {}, Counter()
    for s, doc, start, n, at in packing.round_robin(queues, share, dict.fromkeys(share, 0.0), 0):
        assert at // 2048 == (at + n - 1) // 2048
        windows.setdefault(at // 2048, Counter())[s] += n
        sent[s] += n
    assert sent == total
    full = [w for w in windows.values() if sum(w.values()) == 2048]
    assert len(full) == sum(total.values()) // 2048
    assert all(abs(w[s] - 2048 * share[s]) <= 4 for w in full for s in share)
