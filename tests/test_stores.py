"""Vector search and index, the embedding stage, the keyed store and ingest streams."""
import random

import pytest
from pyspark.sql import functions as F

from quern.functions.vector import best_candidates
from quern.operators import embed, ivf
from quern.operators.retrieval import vector_topk
from quern.sources.store import Conflict, KeyedStore
from quern.streaming import ingest as stream

BIG = 9007199254740993


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(400, None), (401, [0.0] * 8), (402, [1.0, 2.0]), (403, [float("nan")] * 8), (404, rows[7][1])]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(3).cache()


def brute(rows, queries, k, skip):
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    ok = [(i, unit(v)) for i, v in rows if v and len(v) == 8 and any(v) and v[0] == v[0]]
    out = []
    for q, v in queries:
        if v and len(v) == 8 and any(v) and v[0] == v[0]:
            best = sorted((-round(sum(a * b for a, b in zip(unit(v), w)), 4), i) for i, w in ok if not (skip and i == q))[:k]
            out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("skip", [False, True])
def test_topk_in_one_block_and_in_cells(spark, vectors, skip):
    rows = [tuple(r) for r in vectors.collect()]
    queries = vectors.where("chunk_id % 5 = 0 or chunk_id > 399").withColumnRenamed("chunk_id", "query_id")
    want = brute(rows, [tuple(r) for r in queries.collect()], 4, skip)
    assert sorted(map(tuple, vector_topk(queries, vectors, 4, skip_self=skip).collect())) == want
    cells = best_candidates(vectors, queries, 4, (), skip, sent_bytes=1, tile=30).select("query_id", "chunk_id", F.round("similarity", 4).alias("score"))
    ranked = {}
    for q, c, s in sorted(map(tuple, cells.collect()), key=lambda x: (x[0], -x[2], x[1])):
        ranked.setdefault(q, []).append((q, c, s, len(ranked.get(q, [])) + 1))
    assert sorted(x for v in ranked.values() for x in v[:4]) == want


def test_ids_stay_as_they_are(spark, vectors):
    rows = vectors.where("chunk_id < 400")
    queries = rows.where("chunk_id < 3").withColumnRenamed("chunk_id", "query_id")
    plain = sorted(map(tuple, vector_topk(queries, rows, 3).collect()))
    large = vector_topk(queries.withColumn("query_id", F.col("query_id") + BIG), rows.withColumn("chunk_id", F.col("chunk_id") + BIG), 3)
    assert sorted((q - BIG, c - BIG, s, r) for q, c, s, r in large.collect()) == plain
    text = vector_topk(queries.withColumn("query_id", F.format_string("q%05d", "query_id")), rows.withColumn("chunk_id", F.format_string("c%05d", "chunk_id")), 3)
    assert sorted((int(q[1:]), int(c[1:]), s, r) for q, c, s, r in text.collect()) == plain
    assert vector_topk(queries.limit(0), rows, 3).collect() == [] and vector_topk(queries, rows.limit(0), 3).collect() == []


def test_a_hundred_thousand_queries_need_one_pass(spark, vectors):
    many = spark.range(100_000).select(F.col("id").alias("query_id"), F.array(*[F.rand(i) - 0.5 for i in range(8)]).alias("embedding"))
    df = best_candidates(vectors, many, 1)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert df.select("query_id").distinct().count() == 100_000


def test_index(spark, vectors, tmp_path):
    path = f"file://{tmp_path}/ivf"
    sizes = ivf.build_index(vectors.where("chunk_id <> 402"), path, 12)
    assert sizes.agg(F.sum("rows")).first()[0] == 401
    queries = vectors.where("chunk_id % 7 = 0 or chunk_id in (400, 401, 403)").withColumnRenamed("chunk_id", "query_id")
    exact = vector_topk(queries, vectors, 5, skip_self=True)
    assert sorted(map(tuple, ivf.search(queries, path, 5, 12, skip_self=True).collect())) == sorted(map(tuple, exact.collect()))
    probes = ivf.probes_for(vectors.where("chunk_id <> 402"), path, 5, recall=0.98)
    assert 1 <= probes <= 12
    got = ivf.search(queries, path, 5, probes, skip_self=True)
    assert ivf.recall_against(got, exact).first()["recall"] >= 0.95
    assert 0 < ivf.share_read(queries, path, probes).first()[0] <= 1
    one = ivf.search(queries.where("query_id = 7"), path, 5, 1, skip_self=True)
    assert one.where("chunk_id = 404 and rank = 1").count() == 1  # its copy is in its own list


def test_index_splits_large_lists(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "PART_ROWS", 20)
    path = f"file://{tmp_path}/ivf"
    rows = vectors.where("chunk_id < 400")
    ivf.build_index(rows, path, 3)
    queries = rows.where("chunk_id < 40").withColumnRenamed("chunk_id", "query_id")
    assert sorted(map(tuple, ivf.search(queries, path, 5, 3).collect())) == sorted(map(tuple, vector_topk(queries, rows, 5).collect()))


def test_index_reads_asked_lists_only(spark, tmp_path):
    path = f"file://{tmp_path}/ivf"
    r = random.Random(2)
    rows = [(i, [float(i % 4 == k) + r.gauss(0, 0.05) for k in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    ivf.build_index(df, path, 4)
    found = ivf.search(df.where("chunk_id = 0").withColumnRenamed("chunk_id", "query_id"), path, 5, 1)
    files = {f for f in spark.read.parquet(f"{path}/lists").where("list in (0, 1, 2, 3)").inputFiles()}
    assert len(files) >= 4 and found.count() == 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert ivf.share_read(df.withColumnRenamed("chunk_id", "query_id"), path, 1).first()[0] == pytest.approx(0.25)


class Flaky:
    """Fails as told for the first calls, then answers; refuses texts with a bang."""

    def __init__(self, errors=()):
        self.errors, self.calls = list(errors), []

    def __call__(self, texts):
        self.calls.append(list(texts))
        if self.errors:
            raise self.errors.pop(0)
        if any("!" in t for t in texts):
            raise embed.Rejected("bang")
        return [[float(len(t))] for t in texts]


def test_tries_and_waits():
    waits = []
    model = Flaky([embed.RateLimited("slow"), ValueError("x"), embed.RateLimited("slow")])
    assert embed.attempt(model, ["a"], wait=waits.append) == ([[1.0]], None, 4) and waits == [5, 3, 15]
    waits.clear()
    assert embed.attempt(Flaky([OSError("down")] * 9), ["a"], wait=waits.append) == (None, "OSError: down", 5) and waits == [3, 3, 3, 3]
    assert embed.attempt(Flaky(), ["a!"], wait=waits.append) == (None, "Rejected: bang", 1)
    assert embed.attempt(lambda t: [], ["a"], 1)[1].startswith("ValueError: 0 vectors")


def test_batches_by_budget():
    texts = ["a b c", "d", "e f g h i j k", "l m", "n", "o", "p"]
    assert embed.batches_of(texts, embed.words, 4, 10) == [[0, 1], [2], [3, 4, 5], [6]]
    assert embed.batches_of(texts, embed.words, 100, 3) == [[0, 1, 2], [3, 4, 5], [6]]
    assert embed.batches_of([], embed.words, 4, 3) == []


def _flaky_model():
    seen = set()

    def model(texts):
        if any("!" in t for t in texts):
            raise embed.Rejected("bang")
        if any("~" in t for t in texts) and tuple(texts) not in seen:
            seen.add(tuple(texts))
            raise embed.RateLimited("later")
        if any("#" in t for t in texts):
            raise OSError("down")
        return [[float(len(t)), 1.0] for t in texts]

    return model


def test_partial_failure_and_resume(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["one", "two!", "three~", None, " ", "six", "sev#en", "eight", "nine!"])]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = {r.id: (r.embedding, r.error, r.tries) for r in embed.embed(df, "text", _flaky_model, "flaky-1", most=2, tries=2, wait=lambda s: None).collect()}
    assert got[0] == ([3.0, 1.0], None, 2) and got[1] == (None, "Rejected: bang", 2) and got[3] == got[4] == (None, None, 0)
    assert got[2][0] == [6.0, 1.0] and got[2][2] == 2 and got[6][1] == "OSError: down"
    path = f"file://{tmp_path}/emb"
    options = {"most": 1, "tries": 2, "wait": lambda s: None}
    assert embed.ingest(df.where("id < 4"), "id", "text", _flaky_model, path, "flaky-2", **options) == {"saved": 2, "failed": 1, "rows": 4}
    assert embed.ingest(df, "id", "text", _flaky_model, path, "flaky-2", **options) == {"saved": 2, "failed": 3, "rows": 7}
    assert embed.ingest(df, "id", "text", _flaky_model, path, "flaky-2", **options) == {"saved": 0, "failed": 3, "rows": 5}
    assert sorted(r.id for r in spark.read.parquet(f"{path}/saved").collect()) == [0, 2, 5, 7]
    assert sorted(r.id for r in spark.read.parquet(f"{path}/failed").collect()) == [1, 6, 8]
    fixed = df.withColumn("text", F.translate("text", "!#", ""))
    assert embed.ingest(fixed, "id", "text", _flaky_model, path, "flaky-2", **options)["saved"] == 3


def test_queries_need_their_vectors(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "a b")], "query_id long, text string")
    assert {r.query_id: sum(r.embedding) for r in embed.embed_query(df, "text", embed.hashed_model(), "hashed").collect()} == {1: 1.0, 2: 2.0}
    with pytest.raises(Exception, match="no vector for a query: Rejected: bang"):
        embed.embed_query(df.withColumn("text", F.lit("!")), "text", _flaky_model, "flaky-3").collect()
    with pytest.raises(ValueError):
        embed.embed(df.withColumn("error", F.lit("")), "text", _flaky_model)


SCHEMA = "k string, n long, v string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_store_snapshots(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/store", ["k", "n"], SCHEMA, buckets=4)
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    assert store.read().collect() == [] and store.delete(make()) == store.manifest()
    store.upsert(make(("a", 1, "x"), ("b", 1, "y"), (None, 2, "z"), ("c", None, "w")))
    store.upsert(make(("a", 1, "x2"), (None, 2, None), ("d", 4, "new")))
    assert rows_of(store.read()) == sorted([("a", 1, "x2"), ("b", 1, "y"), (None, 2, None), ("c", None, "w"), ("d", 4, "new")], key=str)
    store.delete(make((None, 2, ""), ("b", 1, ""), ("zz", 9, "")))
    assert rows_of(store.read()) == sorted([("a", 1, "x2"), ("c", None, "w"), ("d", 4, "new")], key=str)
    assert rows_of(store.read(1)) == sorted([("a", 1, "x"), ("b", 1, "y"), (None, 2, "z"), ("c", None, "w")], key=str)
    assert store.read(0).collect() == [] and store.versions() == [1, 2, 3]
    kept = rows_of(store.read())
    assert store.vacuum() > 0 and store.versions() == [3] and rows_of(store.read()) == kept


def test_store_writes_touched_buckets_only(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/store", ["n"], SCHEMA, buckets=16)
    store.upsert(spark.range(200).select(F.lit("k").alias("k"), F.col("id").alias("n"), F.lit("v").alias("v")))
    before = store.manifest()["buckets"]
    after = store.upsert(spark.createDataFrame([("k", 5, "w")], SCHEMA))
    changed = {b for b in before if before[b] != after["buckets"][b]}
    assert len(before) == 16 and len(changed) == 1 and after["touched"] == [int(*changed)]
    assert store.read().count() == 200 and store.read().where("v = 'w'").count() == 1


def test_store_keeps_its_state_when_a_write_fails(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/store", ["n"], SCHEMA, buckets=2)
    store.upsert(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    bad = spark.createDataFrame([("b", 2, "y")], SCHEMA).withColumn("v", F.when(F.col("n") > 0, F.raise_error(F.lit("broken"))).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.upsert(bad)
    assert rows_of(store.read()) == [("a", 1, "x")] and store.versions() == [1]
    late = store.manifest()
    store.upsert(spark.createDataFrame([("c", 3, "z")], SCHEMA))
    with pytest.raises(Conflict):
        store._commit({"version": late["version"] + 1, "buckets": {}})
    assert rows_of(store.read()) == [("a", 1, "x"), ("c", 3, "z")]


def test_store_newest_wins(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/store", ["k"], SCHEMA, buckets=2)
    store.upsert(spark.createDataFrame([("a", 5, "x"), ("a", 7, "y"), ("b", 1, "z")], SCHEMA), ["n"])
    store.upsert(spark.createDataFrame([("a", 6, "late"), ("b", 2, "w")], SCHEMA), ["n"])
    assert rows_of(store.read()) == [("a", 7, "y"), ("b", 2, "w")]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    at = f"file://{tmp_path}"
    schema = "k long, v string"
    run = lambda **kw: stream.run_available(stream.stream_files(spark, f"{at}/in", schema, 1), f"{at}/out", f"{at}/check", **kw)
    spark.createDataFrame([(1, "a"), (2, "b")], schema).coalesce(1).write.json(f"{at}/in")
    sink, calls = stream.batch_sink(f"{at}/out"), []

    def dies(batch, number):
        sink(batch, number)
        calls.append(number)
        raise RuntimeError("killed")

    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            run(sink=dies)
    assert calls == [0, 0]
    run()
    spark.createDataFrame([(2, "c"), (3, "d")], schema).coalesce(1).write.mode("append").json(f"{at}/in")
    run()
    run()
    assert rows_of(stream.read_ingested(spark, f"{at}/out")) == [(1, "a", 0), (2, "b", 0), (2, "c", 1), (3, "d", 1)]
    assert rows_of(stream.read_ingested(spark, f"{at}/out", "k").select("k", "v", "batch")) == [(1, "a", 0), (2, "c", 1), (3, "d", 1)]
