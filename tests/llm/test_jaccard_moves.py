"""What the near-copy join moves and holds: later turns, products and texts take only what they need."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from riskframe.llm import jaccard_join
from riskframe.session import cut_lineage


def test_product_of_equal_columns_holds_its_pairs_once(monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRS", 50_000, raising=False)
    columns, rows = 60, 200
    group, nodes = np.repeat(np.arange(columns), rows), np.tile(np.arange(rows), columns)
    n, pos, bits = np.full(len(group), 100), np.zeros(len(group), np.int64), np.zeros((len(group), 8), np.int64)
    tracemalloc.start()
    got = jaccard_join.block_pairs(group, nodes, n, pos, nodes, np.full(len(group), -1), bits)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == rows * (rows - 1) // 2  # of 1,194,000 found, 19 MB at once
    assert peak < 16 << 20, peak


def test_later_turns_multiply_only_columns_with_pairs_left(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(120)]
    near = [" ".join(w if rng.random() > 0.015 else f"x{rng.integers(10**9)}" for w in base) for _ in range(150)]
    # pairs that meet in many columns and that sizes keep apart
    apart = [" ".join([*(f"y{g}z{k}" for k in range(60)), *(f"q{g}r{j}v{k}" for k in range(150 * j))]) for g in range(20) for j in range(2)]
    texts, sizes, across = near + apart, [], jaccard_join._across

    def counted(mixed, *more):
        sizes.append(mixed.select("gram").distinct().count())
        return across(mixed, *more)

    monkeypatch.setattr(jaccard_join, "_across", counted)
    monkeypatch.setattr(jaccard_join, "BUFFER", 2_000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs).collect()}
    assert all(got[i] == i for i in range(150, len(texts)))
    assert len(sizes) > 1 and all(b < a / 2 for a, b in zip(sizes, sizes[1:])), sizes


def test_keys_told_to_all_tasks_find_every_asked_row(spark):
    rows = spark.range(20_000).select((F.xxhash64("id")).alias("__key"), "id")
    asked = cut_lineage(rows.where("id % 50 = 3").select("__key"))
    got = jaccard_join._maybe(rows, jaccard_join._bitmap(asked)).where("__maybe").select("id").toArrow().column(0).to_pylist()
    assert {i for i in got if i % 50 == 3} == set(range(3, 20_000, 50)) and len(got) < 1_500
    none = jaccard_join._maybe(rows, jaccard_join._bitmap(asked.where("false"))).where("__maybe")
    assert none.count() == 0


def test_keep_moves_only_texts_in_doubt(spark, monkeypatch):
    texts = [" ".join(f"t{i}w{k}" for k in range(30)) for i in range(300)]
    texts[7] = texts[5]
    rows = [*enumerate(texts), (9, texts[9]), (None, texts[11]), (400, None), (400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    moved, maybe = [], jaccard_join._maybe

    def counted(rows, bitmap):
        out = maybe(rows, bitmap)
        moved.append(out.where("__maybe").count())
        return out

    monkeypatch.setattr(jaccard_join, "_maybe", counted)
    kept = jaccard_join.keep(docs).collect()
    want = [(i, t) for i, t in enumerate(texts) if i != 7] + [(400, None), (401, "")]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))
    assert 5 <= moved[-1] < 30


def test_packed_texts_come_back(spark):
    texts = ["", "ä" * 10_000, "one two", "\x00\t"]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "__id long, __key long, __text string")
    codec = pa.Codec("zstd")
    got = {r[0]: codec.decompress(bytes(r[3]), r[2], asbytes=True).decode() for r in jaccard_join._packed(rows).collect()}
    assert got == dict(enumerate(texts))
