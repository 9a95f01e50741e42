"""Text expressions, normalisation of model output, diffs."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import ingest, judges, normalize, prompt
from quern.operators.measure import upper_median_by
from quern.operators.metrics import token_f1
from quern.operators.projects import project_info


def value(spark, column, **cells):
    names = list(cells) or ["_x"]
    return spark.createDataFrame([tuple(cells.values()) or (1,)], ", ".join(f"{n} string" for n in names) if cells else "_x int").select(column).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("45", 45), ("150", 100), ("-5", 0), ("null", 0), (None, 0), ("1e12", 100), ("99999999999", 100), ("-1e300", 0), (" 7.9 ", 7), ("x7", 0), ("7d", 0)])
def test_risk(spark, raw, want):
    assert value(spark, tx.risk_score(F.col("a")), a=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("21", 21), ("21.7", 21), ("null", None), ("abc", None)])
def test_nullable_int(spark, raw, want):
    assert value(spark, tx.nullable_int(F.col("a")), a=raw) == want


@pytest.mark.parametrize(("raw", "want"), [(" N/A ", None), ("-", None), ("", None), (None, None), ("\t x \n", "x"), ("\u3000\u00a0x\u3000", "x"), ("\u3000-", None)])
def test_nullish(spark, raw, want):
    assert value(spark, tx.nullish(F.col("a")), a=raw) == want


@pytest.mark.parametrize(("a", "b", "em", "f1"), [(" Foo  BAR ", "foo bar", 1.0, 1.0), ("alpha beta", "gamma", 0.0, 0.0), ("aa bb cc", "aa bb dd", 0.0, 0.6667), ("", "", 0.0, 0.0), ("xx xx", "xx", 0.0, 0.6667), (None, None, 0.0, 0.0)])
def test_match(spark, a, b, em, f1):
    assert value(spark, tx.exact_match(F.col("a"), F.col("b")), a=a, b=b) == em
    assert token_f1(spark.createDataFrame([(1, a, b)], "k int, a string, b string"), ["k"], "a", "b").first()["f1"] == f1


def test_keywords_keep_the_first_spelling(spark):
    assert value(spark, tx.keywords(F.col("a"), 3), a="Use JwtFilter, jwtfilter and auth/login.py with retry") == ["JwtFilter", "auth/login.py", "retry"]


def test_added_identifiers(spark):
    assert value(spark, tx.added_identifiers(F.col("a")), a="+++ b/file\n+def handler(x):\n-old_name\n+  handler(value)") == ["handler", "value"]


@pytest.mark.parametrize(("path", "change", "patch", "low"), [("a/package-lock.json", "MODIFIED", "x", True), ("vendor/x.go", "MODIFIED", "x", True), ("a.MIN.js", "ADDED", "x", True), ("a.py", "RENAMED", "same", True), ("a.py", "RENAMED", "@@ -1", False), ("a.py", "MODIFIED", None, False)])
def test_low_value(spark, path, change, patch, low):
    assert value(spark, tx.low_value_file(F.col("a"), F.col("b"), F.col("c")), a=path, b=change, c=patch) is low


@pytest.mark.parametrize(("raw", "want"), [("백엔드 개발자", "백엔드"), ("Front-End", "프론트엔드"), ("QA team", "QA"), ("Product Owner", "기획"), ("PM", None), ("full stack", None), ("plumber", None), ("", None), (None, None), ("ＡＩ", "AI")])
def test_roles(spark, raw, want):
    assert value(spark, normalize.normalize_role(F.col("a")), a=raw) == want
    assert normalize.role_of(raw) == want


def test_role_lists(spark):
    row = spark.createDataFrame([(["backend", "server", "ninja", "QA"], ["백엔드"])], "r array<string>, t array<string>")
    assert row.select(normalize.resolved_roles(F.col("r")), normalize.unresolved_roles(F.col("r")), normalize.allowed_roles(F.col("r"), F.col("t"))).first() == (["백엔드", "QA"], ["ninja"], ["백엔드"])


def test_record_parsing(spark):
    ok = '{"summary": "s", "riskScore": 7, "roleImpacts": [{"role": "be", "impact": "i", "basis": "guess"}, {"role": "x", "impact": "j"}]}'
    rows = spark.createDataFrame([(ok,), ("",), ("[1]",), ("{bad",), (None,)], "raw string").select(normalize.parse_record(F.col("raw")).alias("r"))
    assert [r[0] for r in rows.select(F.col("r").isNotNull()).collect()] == [True, False, False, False, False]
    impacts = rows.where("r is not null").select(normalize.role_impacts(F.col("r.roleImpacts"))).first()[0]
    assert [(x["role"], x["basis"]) for x in impacts] == [("백엔드", None)]


def test_follow_up_tasks_take_texts_and_objects(spark):
    row = spark.createDataFrame([(['"write docs"', '{"role": "qa", "task": " test "}', '{"role": "qa", "task": ""}'],)], "t array<string>")
    assert [(x["role"], x["task"]) for x in row.select(normalize.follow_up_tasks(F.col("t"))).first()[0]] == [(None, "write docs"), ("QA", "test")]


def test_evidence_ids_go_by_place(spark):
    """An unnamed citation is e and its place; a kept hit c and its place among all kept ones, moved on by their number where that id is cited."""
    kept = spark.createDataFrame([(1, 1, "a", "f.py", 0.9), (1, 2, "b", None, 0.8), (1, 3, "c", "", 0.7), (2, 1, "z", None, 0.5)], "query_id long, rank int, chunk_id string, file_path string, score double")
    cited = spark.createDataFrame([(1, 1, "c1", None, "b", "null"), (1, 2, None, None, "x.py", "why"), (1, 4, "c4", "context", None, None)], "query_id long, pos int, id string, source string, location string, description string")
    got = [(r["query_id"], r["ref_id"], r["source"], r["location"], r["description"], r["chunk_id"]) for r in normalize.evidence_refs(cited, kept).orderBy("query_id", "place").collect()]
    assert got == [(1, "c1", "context", "b", None, "b"), (1, "e2", "pr_diff", "x.py", "why", None), (1, "c4", "context", None, None, None), (1, "c7", "context", "f.py", None, "a"), (1, "c3", "context", "c", None, "c"), (2, "c1", "context", "z", None, "z")]


def test_a_judge_without_tokens_says_zero(spark):
    s = judges.generation_judge(F.col("q"), F.col("c"), F.col("a"), F.array().cast("array<string>"))
    row = spark.createDataFrame([("?", "text", "!!")], "q string, c string, a string").select(*(v.alias(n) for n, v in s.items())).first()
    assert (row["groundedness"], row["faithfulness"], row["hallucination"], row["context_relevance"], row["completeness"], row["answer_relevance"]) == (0.0, 0.0, 1.0, 0.0, None, None)


def test_model_scores(spark):
    rows = [(1, "groundedness", '{"score": 0.5, "reason": "r"}', None), (2, "groundedness", '{"score": "high"}', None), (3, "groundedness", "{bad", None), (4, "groundedness", None, "timeout"), (5, "taste", '{"score": 1}', None), (6, "groundedness", '{"reason": "r"}', None), (7, "groundedness", '{"score": "0.25"}', None)]
    got = {r["query_id"]: (r["score"], r["error"]) for r in judges.model_scores(spark.createDataFrame(rows, "query_id long, criterion string, raw string, error string")).collect()}
    assert got == {1: (0.5, None), 2: (None, "invalid_score"), 3: (None, "invalid_reply"), 4: (None, "timeout"), 5: (None, "unsupported_criterion"), 6: (None, None), 7: (0.25, None)}


def test_diff_assembly(spark):
    files = [(1, 1, "yarn.lock", "MODIFIED", "x"), (1, 2, "a.py", "MODIFIED", "y" * 5000), (1, 3, "b.py", "ADDED", " "), (2, 1, "go.sum", "MODIFIED", "z")]
    got = {r["pr_id"]: r for r in prompt.assemble_diff(spark.createDataFrame(files, "pr_id long, ord int, path string, change_type string, patch string")).collect()}
    assert got[1]["diff_content"].startswith("### a.py (MODIFIED)\nyyy") and "(patch truncated)" in got[1]["diff_content"] and (got[1]["included"], got[1]["omitted"]) == (1, 1)
    assert got[2]["diff_content"].strip() != "" and got[2]["included"] == 0


def test_judges(spark):
    s = judges.generation_judge(F.col("q"), F.col("c"), F.col("a"), F.split(F.col("k"), ","))
    row = spark.createDataFrame([("token expiry", "the token expiry check", "token expiry fixed", "expiry,retry")], "q string, c string, a string, k string").select(*(v.alias(n) for n, v in s.items())).first()
    assert (row["groundedness"], row["hallucination"], row["completeness"], row["context_relevance"]) == (0.6667, 0.3333, 0.5, 1.0)


@pytest.mark.parametrize(("word", "label"), [("", "not_important"), ("Record-12", "not_important"), (" React ", "not_important"), ("retry policy", None), (None, "not_important")])
def test_offline_keywords(spark, word, label):
    assert value(spark, judges.offline_keyword_label(F.col("a")), a=word) == label


def test_upper_median_is_not_interpolated(spark):
    df = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 3.0, 4.0)] + [(2, 5.0), (2, 5.0), (2, 1.0)], "k int, x double")
    assert {1: 3.0, 2: 5.0} == dict(upper_median_by(df, ["k"], "x").collect())


def test_project_lookup_prefers_the_full_name(spark):
    reg = spark.createDataFrame([("o/r", "full", None, None, None), ("r", "short", None, None, "ko")], "key string, name string, description string, purpose string, language string")
    req = spark.createDataFrame([("o/r",), ("x/r",), ("y",)], "repo_name string")
    got = {r["repo_name"]: (r["name"], r["language"]) for r in project_info(req, reg, {"name": "none", "language": "en"}).collect()}
    assert got == {"o/r": ("full", "en"), "x/r": ("short", "ko"), "y": ("none", "en")}


def test_adapters_share_their_columns(spark):
    frames = {
        "review_comments": spark.createDataFrame([("@@ d", "a comment long enough"), ("@@ d", "short"), (None, "a comment long enough")], "diff_hunk string, code_review_comment string"),
        "contextual": spark.createDataFrame([("a comment long enough", "a\nb", "a\nc")], "comment string, method_body string, method_body_after string"),
        "classified": spark.createDataFrame([("fix this", "o", "p", 1), ("fix this", "o", "p", None)], "msg string, oldf string, patch string, y int"),
    }
    got = {k: ingest.adapt(k, v) for k, v in frames.items()}
    assert all(v.columns == ingest.ADAPTED for v in got.values())
    assert [got[k].count() for k in frames] == [1, 1, 2] and "-b" in got["contextual"].first()["pr_diff"]
    with pytest.raises(ValueError):
        ingest.adapt("other", frames["classified"])


def test_chunks_overlap(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, ""), (3, None)], "id int, text string")
    assert [r["chunk"] for r in ingest.chunk_words(df, size=4, overlap=1).orderBy("id", "chunk_idx").collect()] == ["0 1 2 3", "3 4 5 6", "6 7 8 9"]


def test_items_of_a_team_and_their_spellings(spark):
    items = spark.createDataFrame([([("be", "i", "guess", ["e1"], None, ["x"]), ("qa", "j", None, [], [" ", "e2"], None), ("qa", "k", None, None, None, ["e3"]), ("painter", "l", None, None, None, None)], ["QA"], [])], "i array<struct<role: string, impact: string, basis: string, evidenceRefs: array<string>, evidence_refs: array<string>, evidenceIds: array<string>>>, team array<string>, none array<string>")
    names = ("evidenceRefs", "evidence_refs", "evidenceIds")
    of = lambda team: [(x["role"], x["impact"], x["evidenceRefs"]) for x in items.select(normalize.role_impacts(F.col("i"), team, names)).first()[0]]
    assert of(F.col("team")) == [("QA", "j", ["e2"]), ("QA", "k", ["e3"])]
    assert of(F.col("none")) == of(None) == [("\ubc31\uc5d4\ub4dc", "i", ["e1"]), ("QA", "j", ["e2"]), ("QA", "k", ["e3"])]
    tasks = spark.createDataFrame([(['"write"', '{"role": "be", "task": "a", "evidence_refs": ["e1"]}', '{"role": "qa", "task": "b", "evidenceRefs": [], "evidence_refs": ["e2"]}'], ["QA"])], "t array<string>, team array<string>")
    got = tasks.select(normalize.follow_up_tasks(F.col("t"), F.col("team"))).first()[0]
    assert [(x["role"], x["task"], x["evidenceRefs"]) for x in got] == [(None, "write", []), (None, "a", ["e1"]), ("QA", "b", ["e2"])]


def test_important_needs_a_criterion_that_is_there(spark):
    from quern.operators.judges import keyword_label, keyword_totals

    rows = [("caching layer", "important", c) for c in (None, [], ["E"], [None], [None, "B"], ["A"])]
    df = spark.createDataFrame(rows, "k string, l string, c array<string>")
    assert [r[0] for r in df.select(keyword_label(F.col("k"), F.col("l"), F.col("c"), F.lit(None).cast("boolean"))).collect()] == ["not_important"] * 4 + ["important"] * 2
    judged = spark.createDataFrame([(1, "important", False, None)], "pr_id long, label string, background boolean, error string")
    prs = spark.createDataFrame([(1,), (2,), (3,)], "pr_id long")
    assert keyword_totals(judged, prs).first()["pr_count"] == 3 and keyword_totals(judged).first()["pr_count"] == 1
    assert keyword_totals(judged.limit(0), prs.limit(0)).first()["pr_count"] == 0


def test_cases_take_the_first_gold_list_that_holds_any(spark):
    from quern import schemas
    from quern.sources.readers import as_case

    rows = [("a", "q", [], ["x"]), ("b", "q", ["y"], ["x"]), ("c", "q", None, ["x"]), ("d", "q", [], None), ("e", "q", None, None)]
    names = spark.createDataFrame([], schemas.CASE).columns
    df = spark.createDataFrame(rows, "case_id string, query string, gold_chunks array<string>, gold_ids array<string>")
    df = df.unionByName(spark.createDataFrame([], schemas.CASE), allowMissingColumns=True).select(*names)
    assert {r.case_id: r.gold_chunks for r in as_case(df).collect()} == {"a": ["x"], "b": ["y"], "c": ["x"], "d": [], "e": []}
