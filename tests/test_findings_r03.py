"""Tests of the findings of round 3."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.functions.vector import Scorer, _places
from quern.operators import ingest, normalize
from quern.operators.ann import approx_topk
from quern.operators.retrieval import vector_topk
from quern.plans import stores


def test_f1_names_are_normalised_once_each(spark):
    """The expression had hundreds of replacements a name: every ending held the whole key thrice, every role the key again."""
    r = F.col("r")
    for made in (normalize.resolved_roles(r), normalize.unresolved_roles(r), normalize.normalize_role(F.col("t"))):
        assert str(made).count("regexp_replace") <= 2
    got = spark.createDataFrame([(["dev", "팀", "qa팀", "QA 개발자", "front-end dev", "pm team", "a dev", None],)], "r array<string>")
    assert got.select(normalize.resolved_roles(r)).first()[0] == ["QA", "프론트엔드"]
    assert got.select(normalize.unresolved_roles(r)).first()[0] == ["dev", "팀", "pm team", "a dev"]


def test_f4_role_impacts_normalise_once(spark):
    assert str(normalize.role_impacts(F.col("items"))).count("regexp_replace") <= 2


def test_f5_follow_up_tasks_parse_each_list_once(spark):
    made = str(normalize.follow_up_tasks(F.col("t"), F.col("team")))
    assert made.count("from_json") <= 2 and made.count("regexp_replace") <= 3
    rows = spark.createDataFrame([(['{"role": "qa", "task": "a", "evidenceRefs": [], "evidence_refs": ["e2", ""]}', '{"role": "be", "task": "b", "evidenceRefs": ["e1"], "evidence_refs": ["e2"]}', None],)], "t array<string>")
    assert [(x["role"], x["task"], x["evidenceRefs"]) for x in rows.select(normalize.follow_up_tasks(F.col("t"))).first()[0]] == [("QA", "a", ["e2"]), ("백엔드", "b", ["e1"])]


def test_f7_f9_f10_copies_take_no_more_than_k_rows_a_query():
    """Rows that tied with the k-th were all kept, so that the memory of a search grew with queries times copies."""
    table = lambda n, ids, v: pa.table({n: pa.array(ids), "embedding": pa.array(v, pa.list_(pa.float64()))})
    asked = table("query_id", list(range(50)), [[1.0, i / 100] for i in range(50)])
    rows = [(f"c{(i * 7919) % 30_000:05d}", [1.0, 0.1]) for i in range(30_000)] + [("d", [1.0, 0.5]), (None, [1.0, 0.1])]
    block, most = Scorer(asked, 3), 0
    for lo in range(0, len(rows), 1000):
        block.add(table("chunk_id", *zip(*rows[lo : lo + 1000])))
        most = max(most, block.size)
    assert most <= 1 << 16
    got = block.best({"query_id": pa.int64(), "chunk_id": pa.string()}).to_pylist()
    assert len(got) == 150
    assert [r["chunk_id"] for r in got if r["query_id"] == 10] == [None, "c00000", "c00001"]
    assert [r["chunk_id"] for r in got if r["query_id"] == 49] == ["d", None, "c00000"]
    half = [0.00005, 0.00015, 0.12345, 0.12344999999999999, -0.12345, -0.00004, 1.0]
    assert _places(np.array(half)).tolist() == [1, 2, 1235, 1234, -1235, 0, 10000]


def test_f2_approx_topk_shuffles_no_pairs(spark):
    r = np.random.default_rng(3)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.standard_normal((600, 32)))] + [(600, [0.0] * 32), (620, None)], "chunk_id long, embedding array<double>")
    q = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    got, exact = approx_topk(q, v, 5), vector_topk(q, v, 5, skip_self=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    rows = got.collect()
    assert len(rows) == 150 and all(r["query_id"] != r["chunk_id"] and r["score"] is not None for r in rows)
    assert got.join(exact, ["query_id", "chunk_id", "score"], "left_semi").count() >= 0.9 * exact.count()


def test_f3_vector_literal_rounds_as_sql(spark):
    import duckdb

    nan, inf = float("nan"), float("inf")
    rows = [[0.0078125, -0.0234375, 1.0000005, 2.5e-7, -1e-9, 0.0], [1e23, nan, inf, -inf], [1.0, None, 2.0], [], None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v array<double>").select("i", ingest.vector_literal(F.col("v"))).collect()
    sql = "SELECT '[' || array_to_string(list_transform(?::DOUBLE[], lambda x: printf('%.6f', x::DOUBLE)), ',') || ']'"
    assert dict(map(tuple, got)) == {i: duckdb.execute(sql, [v]).fetchone()[0] for i, v in enumerate(rows)}


def test_f6_token_truncate_without_python(spark):
    texts = ["a b  c\td", " 　x y z ", "", None, "one", "\n\n", "p\x85q\x1cr​s t", "w " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    cut = df.select("i", ingest.token_truncate(2)("t").alias("t"))
    assert "Python" not in cut._jdf.queryExecution().executedPlan().toString()
    assert dict(map(tuple, cut.collect())) == {i: " ".join((t or "").split()[:2]) for i, t in enumerate(texts)}
    letters = df.select("i", ingest.token_truncate(3, list, "".join)("t").alias("t"))
    assert dict(map(tuple, letters.collect())) == {i: (t or "")[:3] for i, t in enumerate(texts)}


def test_f8_stream_input_has_as_many_files_as_parts(spark, tmp_path):
    spark.range(3000).selectExpr("id as doc_id", "repeat('ab ', 20) as text", "'en' as lang", "'s' as source", "60L as n_chars").repartition(11).write.parquet(f"{tmp_path}/documents.parquet")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = stores.stream_ingest(spark, str(tmp_path))
        batches = [f for f in got.inputFiles() if f.endswith(".parquet")]
        assert len(batches) > 4 and {f.split("batch=")[1][0] for f in batches} == set("0123")
        assert sorted(r[0] for r in got.collect()) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
