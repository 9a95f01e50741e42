import corpus_pipeline as cp
from quern.llm import decontaminate, secret_scan, simhash, toxicity


def test_stages_in_order(spark, tiny):
    docs, seen = spark.read.parquet(f"{tiny}/documents.parquet").cache(), []
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, tiny).cache()
        assert out.columns == columns
        seen.append((name, docs.count(), out.count()))
        docs = out
    assert [n for n, *_ in seen] == ["toxicity", "near_duplicates", "decontamination", "secrets"]
    assert all(b <= a for _, a, b in seen) and seen[3][1] == seen[3][2]
    labels, items = spark.read.parquet(f"{tiny}/labels.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    whole = spark.read.parquet(f"{tiny}/documents.parquet")
    clean = {r["doc_id"] for r in toxicity.score_toxicity(whole, labels).where("score < 0.7").collect()}
    first = {r["doc_id"] for r in simhash.near_duplicates(whole.where(whole["doc_id"].isin(list(clean)))).where("doc_id = component_id").collect()}
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(whole, items).collect()}
    assert {r["doc_id"] for r in docs.collect()} == first - leaks
    assert secret_scan.scan_secrets(docs).where("size(spans) > 0").count() == 0
    packed = cp.run(spark, tiny)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == first - leaks


def test_odd_rows_pass_every_stage(spark, odd, empty, tiny):
    for docs in (odd, empty):
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, tiny)
            assert docs.columns == odd.columns
        assert cp.STAGES[-1][1](spark, docs, tiny).count() >= docs.count()
