"""The corpus pipeline stage by stage against what each stage must keep."""

import corpus_pipeline
from riskframe.llm import exact_dedup, jaccard_join, quality_rules


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, want = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut_lineage(stage(spark, docs, sf_dir))
        if name == "quality_rules":
            want = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
        elif name == "exact_dedup":
            want = {r.doc_id for r in exact_dedup.dedup(docs).where("kept").collect()}
        elif name == "jaccard_join":
            want = {r.doc_id for r in jaccard_join.join(docs).where("doc_id = component_id").collect()}
        if name in ("quality_rules", "exact_dedup", "jaccard_join"):
            assert out.columns == columns
            assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(want)
        elif name == "source_mixing":
            assert out.columns == columns and 0 < out.count() <= 2 * docs.count()
        else:
            assert out.agg({"length": "sum"}).first()[0] > 0
        docs = out
