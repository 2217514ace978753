"""The pipeline over the small table, against plain counts."""

import corpus_pipeline
from lanewise.llm import decontaminate, jaccard, mixing


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(docs, corpus_pipeline.NEAR).collect()}
    firsts = {k for k, v in groups.items() if k == v}
    left = docs.where(docs["doc_id"].isin([int(k) for k in firsts]))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    leaks = {r["doc_id"] for r in decontaminate.contamination(left, bench).collect()}
    assert set(kept) == firsts - leaks and leaks
    assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in kept.values())
    by = {}
    for r in kept.values():
        by.setdefault((r["source"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(t) - target) <= 0.02 * target for (_, target), t in by.items())
    assert mixing.mix(docs.limit(0)).count() == 0
