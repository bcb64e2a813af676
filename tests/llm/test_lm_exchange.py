"""What blocks send and are told about words and n-grams is packed, summed by ranges and spreads no rows per n-gram."""

import numpy as np
import pyarrow as pa

from riskframe.llm import ngram_lm


def test_lm_packed_numbers_come_back():
    rng = np.random.default_rng(4)
    for values in (rng.integers(0, 1 << 63, 1000).astype(np.uint64), np.arange(5), np.zeros(0, np.int64), np.arange(9, dtype=np.int32)):
        assert (ngram_lm._unpack(ngram_lm._pack(values), len(values), values.dtype) == values).all()


def test_lm_blocks_send_a_row_per_range_and_are_told_sums_over_blocks(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 80) % 500) for _ in range(300)]
    docs = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    blocks = ngram_lm._bucketed(ngram_lm.tokenise(docs.coalesce(1), 20_000))
    items = ngram_lm.first_items(blocks, 4)
    n_blocks = blocks.count()
    assert n_blocks > 3
    # bigrams are thousands, rows a few a block
    assert items.count() <= 2 * 4 * n_blocks and items.agg({"n": "sum"}).first()[0] > 5_000
    told = ngram_lm._summed(items, 3).toArrow()
    every: dict[bytes, int] = {}
    for t in texts:
        words = [*t.encode().split(), None]
        for a, b in zip([b"<s>", *words], words):
            every[a, b] = every.get((a, b), 0) + 1
    kept = sorted(n for n in every.values() if n >= 3)
    led = []
    for block in set(told.column("block").to_pylist()):
        mask = pa.compute.equal(told.column("block"), block)
        _, leads, n, _ = ngram_lm.Answers(told.filter(mask)).of(ngram_lm.BIGRAM)
        led += n[leads].tolist()
    assert sorted(led) == kept
    distinct = {w for t in texts for w in t.split()}
    assert sum(told.column("types").to_pylist()) == len(distinct) + 1
