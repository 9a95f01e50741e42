"""More registered queries: sources and sinks, corpora and cases, structured output, prompts, reports, jobs."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as tx
from ..functions.tokenlimit import count_tokens, truncate_to_limit
from ..operators import evaluate as ev
from ..operators import filtering, ingest, jobs, judges, measure, metrics, normalize, prompt
from ..operators.retrieval import normalize_repo, normalize_review
from ..sources import readers, sinks
from ..sources.readers import read_table
from . import analysis
from .queries import HITS, JOBS, NOW, PAIRS, R4, SETTINGS, SIM, STAGE_SQL, STRIP, TOKENS, TS, WORDS, STOP, _asked, _files, _hits, _job_events, _pairs, _stages, _vectors, query


def none():
    return F.lit(None).cast("string")


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; one of this machine only in local runs."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = (conf or "file://" + tempfile.mkdtemp(prefix="quern-")).rstrip("/")
    path = f"{root}/io-{uuid.uuid4().hex[:12]}"
    atexit.register(_forget, spark, path if conf else root)  # results are lazy and may read it until then
    return path


def _forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the process ends; of no effect where the session has ended before."""
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


DOC = "doc_id long, text string, lang string, source string, n_chars long"


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark, d):
    path = _folder(spark)
    sinks.write_jsonl(read_table(spark, d, "documents"), path)
    return readers.read_jsonl(spark, path, DOC)


@query("SELECT doc_id, lang, n_chars FROM documents")
def parquet_append_new(spark, d):
    """Half of the table is written, then all of it appended twice: each row is there once."""
    path, docs = _folder(spark), read_table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    sinks.append_new(docs.where("doc_id % 2 = 0"), path, "doc_id")
    for _ in range(2):
        sinks.append_new(docs, path, "doc_id")
    return spark.read.parquet(path)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS source, n_chars FROM documents UNION ALL SELECT doc_id + 10000000, 'new', 0 FROM documents WHERE doc_id % 5 = 0")
def merge_keyed(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "source", "n_chars")
    new = docs.where("doc_id % 3 = 0").withColumn("source", F.lit("new")).unionByName(docs.where("doc_id % 5 = 0").select((F.col("doc_id") + 10000000).alias("doc_id"), F.lit("new").alias("source"), F.lit(0).cast("long").alias("n_chars")))
    return sinks.merge_keyed(docs, new, ["doc_id"])


@query("""SELECT CASE item_id % 3 WHEN 0 THEN 'c' || item_id WHEN 1 THEN 'i' || item_id ELSE left(text, 32) END AS case_id, text AS query, CASE item_id % 2 WHEN 0 THEN ['g' || item_id] ELSE ['a', 'b'] END AS gold_chunks, CASE WHEN item_id % 4 = 0 THEN ['k'] ELSE [] END AS reference_keywords FROM benchmark""")
def case_load(spark, d):
    """Cases written as JSON lines under both of their spellings."""
    i, text = F.col("item_id"), F.col("text")
    raw = read_table(spark, d, "benchmark").select(
        F.when(i % 3 == 0, F.concat(F.lit("c"), i)).otherwise("").alias("case_id"), F.when(i % 3 == 1, F.concat(F.lit("i"), i)).alias("id"), F.when(i % 2 == 0, text).alias("query"), text.alias("question"),
        F.when(i % 2 == 0, F.array(F.concat(F.lit("g"), i))).alias("gold_chunks"), F.array(F.lit("a"), F.lit("b")).alias("gold_ids"), F.when(i % 4 == 0, F.array(F.lit("k"))).alias("reference_keywords"),
    )
    path = _folder(spark)
    sinks.write_jsonl(raw, path)
    return readers.read_cases(spark, path).select("case_id", "query", "gold_chunks", "reference_keywords")


@query("""SELECT doc_id AS query_id, 'cr-' || doc_id AS chunk_id, 'review' AS source_type, CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 <> 0 THEN source ELSE 'code_review_vectors' END AS source, CASE WHEN doc_id % 11 = 0 THEN 0.0 ELSE round(n_chars / 7.0::DOUBLE, 4) END AS score,
CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN 'a comment' WHEN doc_id % 3 = 0 THEN text ELSE lang END AS text, doc_id * 2 AS orig_idx, doc_id % 5 > 1 AS has_issue,
doc_id::VARCHAR AS id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 3 <> 0 THEN source END AS dataset_source, lang AS source_code, CASE WHEN doc_id % 3 = 0 THEN text END AS pr_diff, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'a comment' END AS review_comment, NULL::VARCHAR AS file_path FROM documents""")
def review_normalise(spark, d):
    i = F.col("doc_id")
    rows = read_table(spark, d, "documents").select(i.alias("query_id"), i.alias("id"), (i * 2).alias("orig_idx"), F.when(i % 7 == 0, "").when(i % 3 != 0, F.col("source")).alias("dataset_source"), F.when(i % 11 != 0, F.col("n_chars") / 7.0).alias("score"), F.when(i % 5 == 0, "").when(i % 2 == 0, "a comment").alias("review_comment"), F.when(i % 3 == 0, F.col("text")).alias("pr_diff"), F.col("lang").alias("source_code"), (i % 5 > 1).alias("has_issue"))
    return normalize_review(rows)


@query("SELECT doc_id AS query_id, 'repo-' || left(md5(doc_id::VARCHAR), 8) AS chunk_id, 'repo' AS source_type, 'src/' || lang AS source, round(n_chars / 7.0::DOUBLE, 4) AS score, CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS text FROM documents")
def repo_normalise(spark, d):
    i = F.col("doc_id")
    rows = read_table(spark, d, "documents").select(i.alias("query_id"), F.md5(i.cast("string").cast("binary")).alias("node_id"), F.struct(F.lit("r").alias("repo_name"), F.concat(F.lit("src/"), "lang").alias("file_path"), F.lit(0).alias("chunk_idx")).alias("metadata"), (F.col("n_chars") / 7.0).alias("score"), F.when(i % 4 != 0, F.col("text")).alias("text"))
    return normalize_repo(rows)


@query(f"SELECT doc_id AS orig_idx, text AS review_comment, lang AS source_code FROM documents WHERE length({STRIP('text')}) >= 6")
def adapt_with_position(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", F.col("text").alias("msg"), F.col("lang").alias("oldf"), F.col("text").alias("patch"), F.lit(1).alias("y"))
    return ingest.adapt("classified", docs, "doc_id").select("orig_idx", "review_comment", "source_code")


@query(f"""SELECT coalesce(CASE WHEN doc_id % 4 <> 0 THEN source END, 'unknown') || '#' || coalesce(CASE WHEN doc_id % 3 <> 0 THEN n_chars END, doc_id) || '-' || doc_id AS case_id, lang || 'diff' AS query, ['cr-' || doc_id] AS gold_chunks, {STRIP('text')} AS reference_answer FROM documents WHERE length({STRIP('text')}) >= 15 AND doc_id % 10 <> 0""")
def review_cases(spark, d):
    i = F.col("doc_id")
    rows = read_table(spark, d, "documents").select(i.alias("idx"), F.when(i % 4 != 0, F.col("source")).alias("repo_name"), F.when(i % 3 != 0, F.col("n_chars")).alias("pr_id"), F.when(i % 10 == 0, " 　").otherwise(F.concat("lang", F.lit("diff "))).alias("diff_hunk"), F.col("text").alias("code_review_comment"))
    return ingest.review_cases(rows).drop("reference_keywords")


@query(f"SELECT a.doc_id, max(b.doc_id) AS orig_idx FROM documents a JOIN documents b ON {STRIP('a.text')} = {STRIP('b.text')} AND a.source = b.source GROUP BY 1")
def repair_join(spark, d):
    docs = read_table(spark, d, "documents")
    raw = docs.select(F.col("doc_id").alias("orig_idx"), F.concat(F.lit("　"), "text", F.lit(" ")).alias("pr_diff"), F.col("source").alias("review_comment"))
    return ingest.repair_join(docs.select("doc_id", F.col("text").alias("pr_diff"), F.concat("source", F.lit("\t")).alias("review_comment")), raw).select("doc_id", "orig_idx")


@query("SELECT count(DISTINCT label) AS gold, count(DISTINCT label) FILTER (label IN (SELECT n_nationkey FROM nation)) AS shared, count(DISTINCT label) FILTER (label IN (SELECT n_nationkey FROM nation)) = 0 AS mismatch FROM embeddings")
def gold_overlap(spark, d):
    return ingest.gold_overlap(read_table(spark, d, "embeddings").select(F.array("label").alias("gold_chunks")), read_table(spark, d, "nation").select(F.col("n_nationkey").alias("chunk_id")))


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def random_sample(spark, d):
    return ingest.random_sample(read_table(spark, d, "documents").select("doc_id", "lang"), 50, "doc_id")


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS v FROM embeddings")
def vector_literal(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", ingest.vector_literal(F.col("embedding")).alias("v"))


@query("SELECT doc_id, 'PR Diff:' || chr(10) || coalesce(CASE WHEN doc_id % 3 <> 0 THEN text END, '') || chr(10) || 'Review Comment:' || chr(10) || source AS t FROM documents")
def embedding_text(spark, d):
    return read_table(spark, d, "documents").select("doc_id", ingest.embedding_text(F.when(F.col("doc_id") % 3 != 0, F.col("text")), F.col("source")).alias("t"))


@query(f"SELECT doc_id, len({WORDS('text')})::INT AS n, CASE WHEN len({WORDS('text')}) <= 80 THEN coalesce(text, '') ELSE array_to_string({WORDS('text')}[1:80], ' ') END AS cut FROM documents")
def token_limits(spark, d):
    return read_table(spark, d, "documents").select("doc_id", count_tokens()("text").alias("n"), truncate_to_limit(80, 8)("text").alias("cut"))


# Three spellings of roles a customer: one known, one unknown, one that depends on the segment.
ROLES = "[c_mktsegment, ' Ｂackend dev', 'ninja ', CASE WHEN c_custkey % 2 = 0 THEN 'QA' ELSE '' END, 'server']"
KNOWN = "CASE WHEN c_custkey % 2 = 0 THEN ['백엔드', 'QA'] ELSE ['백엔드'] END"


def _roles(spark, d):
    c = F.col("c_custkey")
    return read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.array("c_mktsegment", F.lit(" Ｂackend dev"), F.lit("ninja "), F.when(c % 2 == 0, "QA").otherwise(""), F.lit("server")).alias("roles"), F.when(c % 3 == 0, F.array(F.lit("QA"), F.lit("AI"))).otherwise(F.array().cast("array<string>")).alias("team"))


@query(f"SELECT c_custkey, {KNOWN} AS resolved, [c_mktsegment, 'ninja'] AS unresolved, CASE WHEN c_custkey % 3 <> 0 THEN {KNOWN} WHEN c_custkey % 2 = 0 THEN ['QA'] ELSE [] END AS allowed FROM customer")
def role_lists(spark, d):
    r = F.col("roles")
    return _roles(spark, d).select("c_custkey", normalize.resolved_roles(r).alias("resolved"), normalize.unresolved_roles(r).alias("unresolved"), normalize.allowed_roles(r, F.col("team")).alias("allowed"))


@query("""SELECT c_custkey, ['백엔드: slower' || c_custkey, 'QA: '] AS impacts, [CASE WHEN c_custkey % 2 = 0 THEN '확인된 사실' END, NULL] AS bases, [1, 0] AS n_refs FROM customer""")
def role_impacts(spark, d):
    c = F.col("c_custkey")
    item = lambda role, impact, basis, refs: F.struct(F.lit(role).alias("role"), impact.alias("impact"), basis.alias("basis"), refs.alias("evidenceRefs"))
    no = F.array().cast("array<string>")
    items = F.array(item("ＢＥ", F.concat(F.lit("slower"), c), F.when(c % 2 == 0, " 확인된 사실 ").otherwise("guess"), F.array(F.lit("e1"), F.lit(" "))), item("painter", F.lit("x"), none(), no), item("tester", none(), none(), F.lit(None).cast("array<string>")))
    got = read_table(spark, d, "customer").select("c_custkey", normalize.role_impacts(items).alias("x"))
    return got.select("c_custkey", F.transform("x", lambda x: F.concat(x["role"], F.lit(": "), x["impact"])).alias("impacts"), F.transform("x", lambda x: x["basis"]).alias("bases"), F.transform("x", lambda x: F.size(x["evidenceRefs"])).alias("n_refs"))


@query("SELECT c_custkey, ['write ' || c_custkey, 'test', 'paint'] AS tasks, [NULL, 'QA', NULL] AS roles, [[], ['e1'], []] AS refs FROM customer")
def follow_up_tasks(spark, d):
    items = F.array(F.concat(F.lit('"write '), "c_custkey", F.lit('"')), F.lit('{"role": "Q.A.", "task": " test ", "evidenceRefs": ["e1", " "]}'), F.lit('{"role": "painter", "task": "paint"}'), F.lit('{"role": "qa", "task": "  "}'), F.lit('" "'))
    got = read_table(spark, d, "customer").select("c_custkey", normalize.follow_up_tasks(items).alias("x"))
    return got.select("c_custkey", F.transform("x", lambda x: x["task"]).alias("tasks"), F.transform("x", lambda x: x["role"]).alias("roles"), F.transform("x", lambda x: x["evidenceRefs"]).alias("refs"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 's' || c_custkey END AS summary, CASE WHEN c_custkey % 3 = 0 THEN 'f' || c_custkey END AS feature, c_custkey % 3 = 0 AS parsed FROM customer""")
def record_parse(spark, d):
    c = F.col("c_custkey")
    raw = F.when(c % 3 == 0, F.concat(F.lit(' {"summary": "s'), c, F.lit('", "relatedFeatures": ["f'), c, F.lit('"], "extra": 1}'))).when(c % 3 == 1, '["a"]').otherwise('{"summary": ')
    return read_table(spark, d, "customer").select("c_custkey", normalize.parse_record(raw).alias("r")).select("c_custkey", "r.summary", F.col("r.relatedFeatures")[0].alias("feature"), F.col("r").isNotNull().alias("parsed"))


@query("SELECT event_id, CASE WHEN event_id % 5 NOT IN (0, 4) THEN trunc(round(value, 2))::BIGINT END AS n, CASE WHEN event_id % 5 NOT IN (0, 4) AND trunc(round(value, 2)) > 0 THEN trunc(round(value, 2))::BIGINT END AS positive FROM events")
def nullable_numbers(spark, d):
    e = F.col("event_id") % 5
    raw = F.when(e == 0, "n/a").when(e == 4, "7 files").otherwise(F.concat(F.lit(" "), F.round("value", 2).cast("string")))
    return read_table(spark, d, "events").select("event_id", tx.nullable_int(raw).alias("n"), tx.positive_int(raw).alias("positive"))


@query(r"""WITH l AS (SELECT doc_id, regexp_extract_all(replace(text, '. ', ' '), '([A-Za-z_][A-Za-z0-9_]{3,})', 1) AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM l), f AS (SELECT doc_id, t, min(p) AS p FROM e GROUP BY 1, 2)
SELECT doc_id, list(t ORDER BY p)[1:40] AS identifiers FROM f GROUP BY 1""")
def added_identifiers(spark, d):
    patch = F.concat(F.lit("+++ b/skipped_file\n-removed_name\n+"), F.regexp_replace(F.replace("text", F.lit(". "), F.lit("\n")), "\n", "\n+"), F.lit("\n context_name"))
    return read_table(spark, d, "documents").select("doc_id", tx.added_identifiers(patch).alias("identifiers")).where(F.size("identifiers") > 0)


@query("SELECT doc_id, left('[' || source || '] ' || regexp_extract(text, '^[^\\n]*'), 300) AS message, CASE doc_id % 3 WHEN 0 THEN 'RETRIEVAL_FAILED' WHEN 1 THEN 'LLM_RESPONSE_INVALID' ELSE 'ANALYSIS_FAILED' END AS code FROM documents")
def failure_texts(spark, d):
    i = F.col("doc_id") % 3
    error = F.when(i == 0, "RetrievalError").when(i == 1, "LLMResponseParseError").otherwise("ValueError")
    return read_table(spark, d, "documents").select("doc_id", tx.failure_text(F.col("source"), F.col("text")).alias("message"), jobs.classify_failure(error).alias("code"))


@query(f"""WITH x AS (SELECT doc_id, source AS t, text AS d, CASE doc_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'prod_capped' ELSE 'files+diff' END AS v FROM documents)
SELECT doc_id, CASE v WHEN 'prod' THEN 'PR Title/Summary: ' || t || chr(10) || 'PR Diff:' || chr(10) || d WHEN 'prod_capped' THEN left('PR Title/Summary: ' || t || chr(10) || 'Changed files: a.py b.py' || chr(10) || 'PR Diff:' || chr(10) || d, 300)
ELSE t || chr(10) || 'a.py b.py' || chr(10) || 'run' END AS q, CASE WHEN doc_id % 2 = 0 THEN 'en ' || t ELSE {STRIP("t || ' '")} END AS translated FROM x""")
def query_variants(spark, d):
    i = F.col("doc_id")
    variant = F.when(i % 3 == 0, "prod").when(i % 3 == 1, "prod_capped").otherwise("files+diff")
    made = prompt.query_variant(variant, F.col("source"), F.col("text"), F.array(F.lit("a.py"), F.lit("b.py")), F.array(F.lit("run")), 300)
    return read_table(spark, d, "documents").select("doc_id", made.alias("q"), prompt.translated_query(F.when(i % 2 == 0, F.concat(F.lit(" en "), "source")).otherwise(" 　"), F.col("source"), F.lit("")).alias("translated"))


@query(f"""SELECT doc_id, CASE WHEN o + n <= 100 THEN text WHEN o < 93 THEN array_to_string({WORDS('text')}[1:93 - o], ' ') || chr(10) || chr(10) || '... (diff truncated to fit token budget)' END AS diff,
CASE WHEN o + n > 100 AND o >= 93 THEN o + n END AS refused FROM (SELECT *, (doc_id % 10) * 11 AS o, len({WORDS('text')}) AS n FROM documents)""")
def fit_diff(spark, d):
    """A budget of 100 tokens, of which the rest of the prompt takes 0 to 99; the marker takes 7."""
    overhead = F.col("doc_id") % 10 * 11
    rows = read_table(spark, d, "documents").select("doc_id", prompt.fit_diff(100)(overhead, F.col("text")).alias("x"))
    return rows.select("doc_id", "x.diff", F.regexp_extract("x.error", r"(\d+)", 1).cast("long").alias("refused"))


@query(f"""SELECT doc_id, 'P=' || CASE WHEN doc_id % 2 = 0 THEN source ELSE '(정보 없음)' END || ' T=' || lang || ' B=(정보 없음) F=' || CASE WHEN doc_id % 3 = 0 THEN '  - (없음)' ELSE '  - a.py' || chr(10) || '  - {{b}}.py' END || ' D=' || CASE WHEN {STRIP('text')} = '' THEN '(diff 없음)' ELSE {STRIP('text')} END || ' R=QA, AI C=관련 기존 컨텍스트 없음 L=ko S={{"x"}}' AS prompt,
CASE WHEN doc_id % 2 = 0 THEN '확인 필요 English' ELSE '확인 필요 한국어' END AS system FROM documents""")
def prompts(spark, d):
    i, no = F.col("doc_id"), F.array().cast("array<string>")
    rows = read_table(spark, d, "documents").select(
        "doc_id", F.when(i % 2 == 0, F.col("source")).otherwise(" ").alias("project_name"), none().alias("project_description"), none().alias("project_purpose"), no.alias("project_features"), F.array(F.lit("QA"), F.lit("AI")).alias("project_roles"), none().alias("language"),
        F.col("lang").alias("title"), F.lit("").alias("body"), F.when(i % 3 != 0, F.array(F.lit("a.py"), F.lit("{b}.py"))).otherwise(no).alias("files"), F.concat(F.lit("　"), "text").alias("diff"), no.alias("commits"), no.alias("issues"), none().alias("context"),
    )
    template = "P={project_name} T={title} B={body} F={files} D={diff} R={project_roles} C={context} L={language} S={schema}"
    return rows.select("doc_id", prompt.user_prompt('{"x"}', template).alias("prompt"), prompt.system_prompt(F.when(i % 2 == 0, "EN").otherwise("ko"), "{unknown} {language}").alias("system"))


@query(f"WITH {HITS} SELECT query_id, string_agg('[' || CASE WHEN chunk_id % 3 = 0 THEN 'unknown' ELSE 'cr-' || chunk_id END || '] (출처: ' || CASE WHEN chunk_id % 2 = 0 THEN 'f.py' ELSE 'unknown' END || ', similarity: ' || printf('%.4f', score) || ')' || chr(10) || CASE WHEN chunk_id % 2 = 0 THEN 'code' ELSE 'said' END, chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY 1")
def context_fallbacks(spark, d):
    c = F.col("chunk_id")
    hits = _hits(spark, d).select("query_id", "rank", "score", F.lit("").alias("source"), F.when(c % 2 == 0, "f.py").alias("file_path"), F.lit("").alias("text"), F.when(c % 2 == 0, "code").alias("source_code"), F.lit("said").alias("review_comment"), F.lit("").alias("id"), F.when(c % 3 != 0, F.concat(F.lit("cr-"), c)).alias("chunk_id"))
    return prompt.context_section(hits)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['check ' || source] WHEN doc_id % 2 = 0 THEN ['warning'] WHEN doc_id % 5 = 0 THEN ['look'] ELSE [] END AS items FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0) UNION ALL SELECT doc_id, ['check ' || source, 'warning'] FROM documents WHERE doc_id % 6 = 0")
def confirmation_items(spark, d):
    i = F.col("doc_id")
    items = F.when(i % 3 == 0, F.array(F.concat(F.lit(" check "), "source", F.lit("\t")), F.lit(" "))).otherwise(F.lit(None).cast("array<string>"))
    return read_table(spark, d, "documents").select("doc_id", normalize.confirmation_items(items, i % 2 == 0, i % 5 == 0, "warning", "look").alias("items"))


@query(f"""WITH {HITS} SELECT query_id, rank, CASE WHEN chunk_id % 2 = 0 THEN chunk_id::VARCHAR ELSE 'cr-' || chunk_id END AS id, CASE WHEN chunk_id % 3 = 0 THEN 0.0 ELSE score END AS similarity_score, 'cr-' || chunk_id AS chunk_id, 'repo' AS source_type FROM h""")
def evidence_records(spark, d):
    c = F.col("chunk_id")
    kept = _hits(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), F.when(c % 2 == 0, c.cast("string")).alias("id"), F.concat(F.lit("cr-"), c).alias("chunk_id"), *(none().alias(x) for x in ("source_code", "pr_diff", "review_comment", "file_path")), F.when(c % 3 != 0, F.col("score")).alias("score"), F.lit("repo").alias("source_type"))
    return normalize.evidences(kept).drop("source_code", "pr_diff", "review_comment", "file_path")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ['a.py: d' || c_custkey, 'unknown: x'] WHEN 1 THEN ['b.py: y'] ELSE ['unknown: '] END AS changes, CASE WHEN c_custkey % 2 = 0 THEN ['given'] ELSE ['QA: test', 'alone'] END AS recommendations FROM customer""")
def legacy_projections(spark, d):
    c = F.col("c_custkey")
    ref = lambda source, location, text: F.struct(F.lit(source).alias("source"), location.cast("string").alias("location"), text.cast("string").alias("description"))
    refs = F.when(c % 3 == 0, F.array(ref("pr_diff", F.lit("a.py"), F.concat(F.lit("d"), c)), ref("context", F.lit("z"), F.lit("z")), ref("pr_diff", none(), F.lit("x")), ref("pr_diff", none(), none())))
    draft = F.array(F.struct(F.when(c % 3 == 1, "b.py").otherwise(" null ").alias("filePath"), F.when(c % 3 == 1, "y").alias("description")))
    tasks = F.array(F.struct(F.lit("QA").alias("role"), F.lit("test").alias("task")), F.struct(none().alias("role"), F.lit("alone").alias("task")), F.struct(F.lit("AI").alias("role"), F.lit("").alias("task")))
    given = F.when(c % 2 == 0, F.array(F.lit("given"), F.lit(" "))).otherwise(F.lit(None).cast("array<string>"))
    got = read_table(spark, d, "customer").select("c_custkey", normalize.legacy_changes(refs, draft).alias("x"), normalize.legacy_lines(given, tasks, "role", "task").alias("recommendations"))
    return got.select("c_custkey", F.transform("x", lambda x: F.concat(x["file_path"], F.lit(": "), x["description"])).alias("changes"), "recommendations")


@query(f"""WITH {HITS}, x AS (SELECT query_id, chunk_id, CASE WHEN query_id % 60 = 0 THEN score >= {SIM} ELSE chunk_id % 3 <> 0 END AS keep, rank FROM h) SELECT query_id, chunk_id, rank = 1 OR keep AS kept, CASE WHEN query_id % 60 = 0 THEN 'llm_fallback' ELSE 'llm' END AS mode FROM x""")
def llm_filter_replies(spark, d):
    """Replies of a model as JSON: some decide without saying keep, some are no JSON."""
    hits = _hits(spark, d).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    one = F.concat(F.lit('{"chunk_id": "'), "chunk_id", F.when(F.col("chunk_id").cast("long") % 3 == 0, '", "keep": false}').otherwise('"}'))
    replies = hits.groupBy("query_id").agg(F.array_join(F.collect_list(one), ", ").alias("x")).select("query_id", F.when(F.col("query_id") % 60 == 0, "sorry").otherwise(F.concat(F.lit('{"decisions": ['), "x", F.lit("]}"))).alias("raw"))
    decisions, mode = filtering.llm_decisions(replies)
    return filtering.context_filter(hits, "llm", SIM, decisions=decisions).join(mode, "query_id").select("query_id", F.col("chunk_id").cast("long").alias("chunk_id"), "kept", "mode")


MODEL = """SELECT event_id AS query_id, CASE event_id % 7 WHEN 6 THEN 'taste' ELSE 'groundedness' END AS criterion, CASE event_id % 7 WHEN 0 THEN event_id % 10 / 10.0::DOUBLE WHEN 1 THEN 0.25 END AS score, CASE event_id % 7 WHEN 2 THEN 'timeout' WHEN 3 THEN 'invalid_reply' WHEN 4 THEN 'invalid_score' WHEN 6 THEN 'unsupported_criterion' END AS error FROM events"""


@query(f"WITH m AS ({MODEL}) SELECT * FROM m")
def llm_judge(spark, d):
    e = F.col("event_id")
    raw = F.when(e % 7 == 0, F.concat(F.lit('{"score": '), (e % 10 / 10.0).cast("string"), F.lit(', "reason": "r"}'))).when(e % 7 == 1, '{"score": "0.25"}').when(e % 7 == 3, "no json").when(e % 7 == 4, '{"score": "high"}').when(e % 7 == 5, '{"reason": "unsure"}').when(e % 7 == 6, '{"score": 1}')
    replies = read_table(spark, d, "events").select(e.alias("query_id"), F.when(e % 7 == 6, "taste").otherwise("groundedness").alias("criterion"), raw.alias("raw"), F.when(e % 7 == 2, "timeout").alias("error"))
    return judges.model_scores(replies).select("query_id", "criterion", "score", "error")


@query(f"WITH {PAIRS} SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN ['Key', 'word'] ELSE list_filter({TOKENS('answer')}, lambda t: NOT list_contains({STOP}, t)) END AS keywords FROM a")
def reference_keywords(spark, d):
    given = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("Key"), F.lit("word"))).otherwise(F.array().cast("array<string>"))
    return _pairs(spark, d).select("conv_id", "turn", judges.reference_keywords(given, F.col("answer")).alias("keywords"))


def _judged(spark, d):
    e = F.col("event_id")
    return read_table(spark, d, "events").select(F.floor(e / 8).cast("long").alias("pr_id"), e.alias("idx"), F.concat(F.col("event_type"), F.when(e % 9 == 0, F.concat(F.lit(" a b c "), e)).otherwise("")).alias("keyword"), F.when(e % 2 == 0, "important").otherwise("not_important").alias("label"),
        F.when(e % 3 == 0, F.array(F.lit("B"))).otherwise(F.array(F.lit("A"))).alias("criteria"), F.concat(F.lit("r"), e).alias("reason"), (e % 4 == 0).alias("background"), F.when(e % 6 == 0, F.array(F.lit("QA"), F.lit("AI"))).otherwise(F.array().cast("array<string>")).alias("roles"), F.when(e % 11 == 0, "timeout").alias("error"))


@query("SELECT count(DISTINCT event_id // 8) AS pr_count, count(*) AS total_keywords, count(*) FILTER (event_id % 11 = 0) AS error_count, round(count(*) FILTER (event_id % 11 <> 0 AND event_id % 2 = 0) / count(*) FILTER (event_id % 11 <> 0)::DOUBLE, 3) AS important_rate, round(count(*) FILTER (event_id % 11 <> 0 AND event_id % 4 = 0) / count(*) FILTER (event_id % 11 <> 0)::DOUBLE, 3) AS background_inference_rate FROM events")
def keyword_totals(spark, d):
    return judges.keyword_totals(_judged(spark, d))


@query("""WITH k AS (SELECT event_id // 8 AS pr_id, event_id AS idx, event_type || CASE WHEN event_id % 9 = 0 THEN ' a b c ' || event_id ELSE '' END AS keyword FROM events)
SELECT pr_id, coalesce(list(keyword ORDER BY idx) FILTER (idx % 2 = 0 AND idx % 9 <> 0), []) AS feature_tags, coalesce(flatten(list(['QA: r' || idx, 'AI: r' || idx] ORDER BY idx) FILTER (idx % 6 = 0)), []) AS impacts,
coalesce(list('kw-' || idx || ' ' || keyword ORDER BY idx) FILTER (idx % 6 = 0), []) AS follow_ups, coalesce(list('r' || idx ORDER BY idx) FILTER (idx % 4 = 0), []) AS checks FROM k GROUP BY 1""")
def frontend_fragment(spark, d):
    got = judges.frontend_fragment(_judged(spark, d))
    return got.select("pr_id", "feature_tags", F.transform("impacts", lambda x: F.concat(x["role"], F.lit(": "), x["description"])).alias("impacts"), F.transform("follow_ups", lambda x: F.concat(x["id"], F.lit(" "), x["label"])).alias("follow_ups"), "checks")


@query(f"WITH {HITS} SELECT query_id, count(*) FILTER (score >= 0.4) = 0 AS failed FROM h GROUP BY 1")
def reference_free(spark, d):
    return ev.reference_free(_hits(spark, d), _asked(spark, d), 0.4)


@query(f"{STAGE_SQL} SELECT query_id, CASE WHEN query_id % 60 = 0 THEN 'Execution' ELSE stage END AS stage, CASE WHEN query_id % 60 = 0 THEN 'boom' END AS error FROM st")
def execution_errors(spark, d):
    stages = _stages(spark, d)
    return ev.with_execution_errors(stages, stages.where("query_id % 60 = 0").select("query_id", F.lit("boom").alias("error")))


@query(f"WITH {HITS}, sig AS (SELECT query_id, max(score) AS top_score, {R4('avg(score)')} AS mean_score, count(*) FILTER (score >= 0.36)::DOUBLE AS strong_count FROM h WHERE rank = 1 OR score >= {SIM} GROUP BY 1) SELECT {R4('avg(top_score)')} AS top_score, {R4('avg(mean_score)')} AS mean_score, {R4('avg(strong_count)')} AS strong_count FROM sig")
def signal_means(spark, d):
    return metrics.aggregate_signals(metrics.retrieval_signals(filtering.context_filter(_hits(spark, d), "on", SIM), 0.36), ["top_score", "mean_score", "strong_count"])


@query(f"SELECT event_type AS variant, count(value) AS n, {R4('avg(value)')} AS mean, count(*) FILTER (value >= 80) AS n_high, count(*) FILTER (value >= 60) AS n_fair, (list_sort(list(value) FILTER (value IS NOT NULL)))[(count(value) // 2 + 1)::INT] AS median FROM events GROUP BY 1")
def variant_stats(spark, d):
    return measure.variant_stats(read_table(spark, d, "events").withColumnRenamed("event_type", "variant"), "variant", "value", 80, 60)


@query(f"WITH {HITS}, b AS (SELECT q.ql, max(h.score) AS top FROM h JOIN q USING (query_id) GROUP BY h.query_id, q.ql) SELECT ql AS label, list_sort(list(top))[(count(*) // 2 + 1)::INT] AS upper_median FROM b GROUP BY 1")
def grounding_by_label(spark, d):
    best = _hits(spark, d).groupBy("query_id").agg(F.max("score").alias("top")).join(_asked(spark, d).select("query_id", "label"), "query_id")
    return measure.upper_median_by(best, ["label"], "top")


@query(f"""WITH {HITS}, f AS (SELECT *, (rank = 1 OR score >= {SIM}) AS kept FROM h WHERE query_id % 60 <> 0), x AS (SELECT query_id, count(*) AS retrieved, count(*) FILTER (score >= {SIM}) AS above_threshold, count(*) FILTER (kept) AS n_kept, round(count(*) FILTER (NOT kept) / count(*)::DOUBLE, 4) AS filter_ratio FROM f GROUP BY 1)
SELECT query_id, coalesce(retrieved, 0) AS retrieved, coalesce(above_threshold, 0) AS above_threshold, coalesce(n_kept, 0) AS n_kept, filter_ratio, coalesce(above_threshold >= 1, false) AS sufficient, CASE WHEN retrieved IS NULL THEN 'no results' WHEN above_threshold >= 1 THEN 'ok' ELSE 'insufficient grounding' END AS reason FROM q LEFT JOIN x USING (query_id)""")
def analysis_trace(spark, d):
    asked = _asked(spark, d).withColumn("diff", F.when(F.col("query_id") % 60 == 0, " 　").otherwise("+x"))
    trace, _ = analysis.analyse(asked, _vectors(spark, d), None, SETTINGS, "on", skip_self=True)
    return trace.select("query_id", "retrieved", "above_threshold", "n_kept", "filter_ratio", "sufficient", "reason")


@query(f"WITH {JOBS} SELECT job_id, CASE WHEN stale THEN 'FAILED' ELSE status END AS status, {TS.format(c='started_at')} AS started_at, CASE WHEN stale THEN {TS.format(c=NOW)} ELSE {TS.format(c='completed_at')} END AS completed_at, CASE WHEN stale THEN 'the job ran out of time' END AS error_message FROM (SELECT *, status = 'PROCESSING' AND started_at < {NOW} - INTERVAL 30 MINUTE AS stale FROM j) WHERE substr(job_id, 5)::INT % 2 = 0")
def job_on_read(spark, d):
    state = jobs.latest_state(_job_events(spark, d))
    return jobs.read_job(state, state.where("cast(substr(job_id, 5) as int) % 2 = 0"), F.expr(NOW))


@query("SELECT vec_id AS \"vecId\", label AS \"theLabel\" FROM embeddings")
def camel_case(spark, d):
    return normalize.camel_case(read_table(spark, d, "embeddings").select("vec_id", F.col("label").alias("the_label")))
