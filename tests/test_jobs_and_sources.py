"""The job lifecycle in batch and as a stream; sources and sinks."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from quern.operators import jobs
from quern.sources import readers, sinks
from quern.streaming.jobs import job_states

T0 = dt.datetime(2024, 1, 1, 12)
EVENTS = [("a", 1, "PROCESSING", 0), ("a", 2, "FAILED", 40), ("a", 3, "COMPLETED", 50), ("b", 4, "PROCESSING", 0), ("c", 5, "COMPLETED", 1), ("d", 6, "PROCESSING", 50), ("e", 7, "PROCESSING", 0), ("e", 8, "COMPLETED", 5), ("e", 9, "PROCESSING", 9)]
SCHEMA = "job_id string, event_id long, status string, ts timestamp"


def events(spark):
    return spark.createDataFrame([(j, i, s, T0 + dt.timedelta(minutes=m)) for j, i, s, m in EVENTS], SCHEMA)


def test_last_terminal_event_wins(spark):
    got = {r["job_id"]: r["status"] for r in jobs.latest_state(events(spark)).collect()}
    assert got == {"a": "COMPLETED", "b": "PROCESSING", "d": "PROCESSING", "e": "PROCESSING"}  # e was submitted again


def test_reaping_twice_changes_nothing(spark):
    now = F.lit(T0 + dt.timedelta(minutes=60))
    once = jobs.reap_stale(jobs.latest_state(events(spark)), now)
    assert {r["job_id"] for r in once.where("reaped").collect()} == {"b", "e"}
    assert jobs.reap_stale(once.drop("reaped"), now).where("reaped").count() == 0
    assert jobs.reap_stale(jobs.latest_state(events(spark)), now, 0).where("reaped").count() == 0


def test_purge_takes_terminal_jobs_only(spark):
    state = jobs.latest_state(events(spark))
    now = F.lit(T0 + dt.timedelta(days=3))
    assert {r["job_id"] for r in jobs.purge_old(state, now, 1).collect()} == {"b", "d", "e"}
    assert jobs.purge_old(state, now, 0).count() == 4


def test_stream_agrees_with_the_fold(spark, tmp_path):
    for k in range(3):
        events(spark).where(f"event_id % 3 = {k}").where("event_id < 100").coalesce(1).write.json(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    q = job_states(stream, minutes=100_000_000).writeStream.format("memory").queryName("job_stream").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    deadline = time.time() + 120  # the timeout keeps empty batches coming, so the query does not end by itself
    while sum(p["numInputRows"] for p in q.recentProgress) < len(EVENTS) and time.time() < deadline:
        time.sleep(0.5)
    q.stop()
    got = {r["job_id"]: r["status"] for r in spark.sql("select job_id, max_by(status, struct(started_at, completed_at is not null, completed_at)) status from job_stream group by 1").collect()}
    assert got == {r["job_id"]: r["status"] for r in jobs.latest_state(events(spark)).collect()}


def test_stream_forgets_jobs_after_the_retention(spark, tmp_path):
    for k in range(2):
        events(spark).where(f"event_id % 2 = {k}").coalesce(1).write.json(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    q = job_states(stream, minutes=100_000_000, days=2 / 86_400).writeStream.format("memory").queryName("job_retention").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    rows, deadline = None, time.time() + 120
    running = sum(r["status"] == "PROCESSING" for r in jobs.latest_state(events(spark)).collect())
    while time.time() < deadline:
        done = sum(p["numInputRows"] for p in q.recentProgress) >= len(EVENTS)
        rows = q.lastProgress["stateOperators"][0]["numRowsTotal"] if done and q.lastProgress["stateOperators"] else None
        if rows == running:
            break
        time.sleep(0.5)
    q.stop()
    assert rows == running  # only jobs that still run are kept


def test_cases(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"case_id": "x", "query": "q", "gold_chunks": ["a"]}\n\n{"question": "what", "gold_ids": ["b"], "reference_keywords": ["k"]}\n')
    got = readers.read_cases(spark, str(path)).orderBy("query").collect()
    assert [(r["case_id"], r["query"], r["gold_chunks"]) for r in got] == [("x", "q", ["a"]), ("what", "what", ["b"])]
    path.write_text('{"case_id": "x"}\n')
    with pytest.raises(Exception, match="without a query"):
        readers.read_cases(spark, str(path)).collect()


def test_broken_lines_are_named(spark, tmp_path):
    path = tmp_path / "b.jsonl"
    path.write_text('{"a": 1}\n{oops\n\n{"a": 2}\n')
    assert [(r["line"], r["text"]) for r in readers.broken_lines(spark, str(path)).collect()] == [(2, "{oops")]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(path), "a int").collect()


def test_source_files(spark, tmp_path):
    root = tmp_path / "src"
    (root / "node_modules").mkdir(parents=True)
    for name, data in {"a.py": b"x = 1", "b.PY": b"y", "c.txt": b"no", "blank.py": b" \n", "bad.py": b"\xff\xfe", "big.py": b"z" * 50_000, "node_modules/m.py": b"m"}.items():
        (root / name).write_bytes(data)
    assert {r["file_path"] for r in readers.read_source_files(spark, str(root), (".py",)).collect()} == {"a.py", "b.PY"}


def test_appending_again_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    path = str(tmp_path / "t")
    assert [sinks.append_new(df, path, "id"), sinks.append_new(df, path, "id"), sinks.append_new(df.unionByName(spark.createDataFrame([(3, "c")], df.schema)), path, "id")] == [2, 0, 1]


def test_merge_replaces_by_key(spark):
    old, new = (spark.createDataFrame(x, "k long, v string") for x in ([(1, "a"), (2, "b")], [(2, "B"), (3, "C")]))
    assert {tuple(r) for r in sinks.merge_keyed(old, new, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "C")}


def test_callback_retries_then_raises():
    calls, waits = [], []

    def send(body):
        calls.append(body)
        raise OSError("down")

    with pytest.raises(OSError):
        sinks.send_with_retry(send, "x", wait=waits.append)
    assert (len(calls), waits) == (3, [1, 2])


def test_reports(spark):
    agg = spark.createDataFrame([("off", 0.5), ("on", None)], "run string, confidence double")
    ver = spark.createDataFrame([("on", "no_gain")], "run string, verdict string")
    assert "| off | 0.500 |" in sinks.text_report(agg, ver) and "| on | - |" in sinks.text_report(agg, ver)
    assert json.loads(sinks.json_report(agg, ver))["verdicts"] == [{"run": "on", "verdict": "no_gain"}]


def test_pull_requests_come_through_an_injected_fetcher(spark):
    def fetch(repo):
        if repo == "o/bad":
            raise RuntimeError("no access")
        return [{"number": n, "title": f"t{n}", "diff": "+x"} for n in (1, 2)]

    got = sorted((r["repo_name"], r["number"], r["title"], r["error"]) for r in readers.fetch_pull_requests(spark, ["o/a", "o/bad"], fetch).collect())
    assert got == [("o/a", 1, "t1", None), ("o/a", 2, "t2", None), ("o/bad", None, None, "no access")]


def test_files_of_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"x": 1},\n {"x": 2}\n]')
    assert sorted(r["x"] for r in readers.read_json_array(spark, str(tmp_path / "a.json"), "x int").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\n{bad\n{"x": 2}\nworse\n')
    assert [(r["line"], r["text"]) for r in readers.broken_lines(spark, str(tmp_path / "b.jsonl")).orderBy("line").collect()] == [(3, "{bad"), (5, "worse")]


def test_reports_are_whole_or_refused(spark, tmp_path):
    assert len(sinks.few(spark.range(50), 50)) == 50
    with pytest.raises(ValueError):
        sinks.few(spark.range(51), 50)
    assert sinks.write_parquet(spark.range(7), str(tmp_path / "p")) == 7 == sinks.measurement_dump(spark.range(7), str(tmp_path / "m"))
    text = sinks.keyword_text_report({"pr_count": 2, "total_keywords": 5, "error_count": 1, "important_rate": 0.5, "background_inference_rate": 0.25, "recurring": [("jwt", 2)]})
    assert "50.0%" in text and "jwt (2)" in text and "(none)" not in text


def test_job_table_is_made_once(spark, tmp_path):
    path = str(tmp_path / "jobs")
    assert jobs.init_jobs(spark, path).count() == 0
    spark.createDataFrame([("j", 1, "PROCESSING", None, None, None)], jobs.JOB).write.mode("append").parquet(path)
    assert jobs.init_jobs(spark, path).count() == 1


def test_approximate_search_finds_most(spark, tiny):
    from quern.operators.ann import approx_topk
    from quern.operators.retrieval import vector_topk

    e = spark.read.parquet(f"{tiny}/embeddings.parquet")
    q, c = e.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding"), e.selectExpr("vec_id as chunk_id", "embedding")
    exact = vector_topk(q, c, 5, skip_self=True).select("query_id", "chunk_id")
    assert approx_topk(q, c, 5).join(exact, ["query_id", "chunk_id"], "left_semi").count() >= 0.9 * exact.count()
