import __spark_entry__
import corpus_pipeline
from tests.llm import test_decontaminate, test_neardup


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {name: corpus_pipeline_stage(spark, docs, sf, name) for name in ("language", "near_duplicates", "benchmark")}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"] for r in left["language"]} == {i for i, t in rows if any(c.isalpha() for c in t or "")}
    assert {r["doc_id"] for r in left["near_duplicates"]} == {i for i, c in test_neardup.brute(rows) if i == c}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in left["benchmark"]} == {r[0] for r in test_decontaminate.brute(rows, items) if not r[-1]}


def corpus_pipeline_stage(spark, docs, sf, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    assert out.columns == docs.columns
    return out.collect()


def test_run(spark, sf):
    rows = __spark_entry__.queries()["pipeline"](spark, sf).collect()
    assert rows and {r["shard"] for r in rows} <= set(range(24))
