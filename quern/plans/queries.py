"""The registered queries: each a plan over the driver's tables, with the DuckDB SQL that gives the same rows.

Thresholds follow the tables at hand (SIM, STRONG): similarities of unrelated vectors are near zero.
The query set is every vector whose id is divisible by 20.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as tx
from ..operators import evaluate as ev
from ..operators import ann, ingest, jobs, judges, measure, metrics, normalize, offline, projects, prompt
from ..operators.confidence import confidence, mean_confidence
from ..operators.filtering import context_filter, filter_outcome
from ..operators.retrieval import merge_sources, sufficiency, vector_topk
from ..sources.readers import read_table

SIM, STRONG, K = 0.32, 0.36, 5
SETTINGS = replace(DEFAULTS, sim_threshold=SIM, strong_evidence=STRONG)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return vector_topk(_asked(spark, d), _vectors(spark, d), K, skip_self=True)


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of the query's own label are what it should find."""
    return vector_topk(_asked(spark, d), _vectors(spark, d), 3, ("label",), True).select("query_id", "chunk_id")


ALL_SCORES = """q AS (SELECT vec_id AS query_id, embedding AS qe, label AS ql FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.query_id, e.vec_id AS chunk_id, q.ql, e.label AS cl, round(list_cosine_similarity(q.qe::DOUBLE[], e.embedding::DOUBLE[]), 4) AS score FROM q JOIN embeddings e ON e.vec_id <> q.query_id)"""
HITS = f"""{ALL_SCORES},
h AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= {K})"""
R4 = lambda x: f"round(CAST({x} AS DECIMAL(20, 12)), 4)::DOUBLE"
GOLD = """g AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s WHERE ql = cl) WHERE r <= 3)"""
FILTERED = f"""f AS (SELECT *, (rank = 1 OR score >= {SIM}) AS kept FROM h)"""


def CONF(loss: str, src: str = "f", sim: float = SIM) -> str:
    return f"""SELECT query_id, top_score, kept_count, evidence_count, strong_count, filter_ratio, information_loss, confidence, filter_ratio >= 0.8 AS quality_warning, (confidence < 0.6 OR filter_ratio >= 0.8) AS needs_confirmation FROM (
SELECT *, CASE WHEN kept_count = 0 THEN 0.0 ELSE {R4(f"greatest(0.0, least(1.0, (0.5 * top_score + 0.2 * least(evidence_count / 3.0::DOUBLE, 1.0) + 0.2 * least(strong_count / 3.0::DOUBLE, 1.0) + 0.1 * greatest(0.0, 1 - {loss})) / (0.5 + 0.2 + 0.2 + 0.1)))")} END AS confidence FROM (
SELECT query_id, coalesce(max(score) FILTER (kept), 0.0) AS top_score, count(*) FILTER (kept) AS kept_count, count(*) FILTER (kept AND score >= {sim}) AS evidence_count, count(*) FILTER (kept AND score >= {STRONG}) AS strong_count,
round(count(*) FILTER (NOT kept) / count(*)::DOUBLE, 4) AS filter_ratio, round(coalesce(count(*) FILTER (NOT kept AND score >= {sim}) / nullif(count(*) FILTER (score >= {sim}), 0)::DOUBLE, 0.0), 4) AS information_loss FROM {src} GROUP BY query_id))"""


@query(f"WITH {HITS} SELECT query_id, chunk_id, score, rank FROM h")
def vector_topk_query(spark, d):
    return _hits(spark, d).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {ALL_SCORES} SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE ql = cl) WHERE rank <= {K}")
def vector_topk_by_key(spark, d):
    return vector_topk(_asked(spark, d), _vectors(spark, d), K, ("label",), True).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


MERGED = f"""{ALL_SCORES}, two AS (SELECT query_id, chunk_id, score, chunk_id % 2 AS src_ord FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, src_ord ORDER BY score DESC, chunk_id) AS rank FROM two),
m AS (SELECT query_id, chunk_id, score, src_ord, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src_ord, rank) AS merged_rank FROM r WHERE rank <= {K})"""


def _merged(spark, d):
    v = _vectors(spark, d)
    return merge_sources(*(vector_topk(_asked(spark, d), v.where(f"chunk_id % 2 = {p}"), K, skip_self=True) for p in (0, 1)))


@query(f"WITH {MERGED} SELECT query_id, chunk_id, score, src_ord, merged_rank FROM m")
def retrieve_merge(spark, d):
    return _merged(spark, d).select("query_id", "chunk_id", "score", F.col("src_ord").cast("long").alias("src_ord"), F.col("merged_rank").cast("long").alias("merged_rank"))


@query(f"WITH {MERGED} SELECT query_id, count(*) AS retrieved, max(score) AS top_score, count(*) FILTER (score >= {SIM}) AS above_threshold, count(*) FILTER (score >= {SIM}) >= 1 AS sufficient, CASE WHEN count(*) FILTER (score >= {SIM}) >= 1 THEN 'ok' ELSE 'insufficient grounding' END AS reason FROM m GROUP BY query_id")
def retrieve_merge_signals(spark, d):
    return sufficiency(_merged(spark, d), SIM)


FCOLS = "query_id, chunk_id, score, kept"


@query(f"WITH {HITS}, {FILTERED} SELECT {FCOLS} FROM f")
def context_filter_on(spark, d):
    return context_filter(_hits(spark, d), "on", SIM).select("query_id", "chunk_id", "score", "kept")


@query(f"WITH {HITS} SELECT query_id, chunk_id, score, true AS kept FROM h")
def context_filter_off(spark, d):
    return context_filter(_hits(spark, d), "off").select("query_id", "chunk_id", "score", "kept")


@query(f"WITH {HITS} SELECT query_id, chunk_id, score, (rank = 1 OR CASE WHEN chunk_id % 5 = 0 THEN score >= {SIM} ELSE chunk_id % 3 <> 0 END) AS kept FROM h")
def context_filter_decisions(spark, d):
    hits = _hits(spark, d)
    decisions = hits.where("chunk_id % 5 <> 0").select("query_id", "chunk_id", (F.col("chunk_id") % 3 != 0).alias("keep"))
    return context_filter(hits, "llm", SIM, decisions=decisions).select("query_id", "chunk_id", "score", "kept")


@query(f"WITH {HITS} SELECT query_id, chunk_id, score, (rank = 1 OR chunk_id % 2 = 0) AS kept FROM h")
def context_filter_injected(spark, d):
    return context_filter(_hits(spark, d), "on", relevance=F.col("chunk_id") % 2 == 0).select("query_id", "chunk_id", "score", "kept")


@query(f"""WITH {HITS}, f AS (SELECT *, (rank = 1 OR chunk_id % 3 <> 0) AS kept FROM h) SELECT query_id, count(*) AS retrieved, count(*) FILTER (kept) AS n_kept, round(count(*) FILTER (NOT kept) / count(*)::DOUBLE, 4) AS filter_ratio,
round(coalesce(count(*) FILTER (NOT kept AND score >= {SIM}) / nullif(count(*) FILTER (score >= {SIM}), 0)::DOUBLE, 0.0), 4) AS information_loss, bool_or(kept AND rank = 1) AS top1_preserved FROM f GROUP BY query_id""")
def information_loss(spark, d):
    return filter_outcome(context_filter(_hits(spark, d), "on", SIM, relevance=F.col("chunk_id") % 3 != 0), SIM)


@query(f"WITH {HITS}, {FILTERED} {CONF('information_loss')}")
def confidence_score(spark, d):
    return confidence(context_filter(_hits(spark, d), "on", SIM), SETTINGS)


@query(f"WITH {HITS}, {FILTERED} {CONF('filter_ratio')}")
def confidence_eval_form(spark, d):
    return confidence(context_filter(_hits(spark, d), "on", SIM), SETTINGS, use_information_loss=False)


@query(f"WITH {HITS}, {FILTERED} SELECT query_id, {R4('avg(score) FILTER (kept)')} AS confidence FROM f GROUP BY query_id")
def confidence_mean_vulnerable(spark, d):
    return mean_confidence(context_filter(_hits(spark, d), "on", SIM))


def IR(hits: str, sim: float = SIM) -> str:
    return f"""SELECT coalesce(x.query_id, t.query_id) AS query_id, round(coalesce(n_hit / nullif(n_top, 0)::DOUBLE, 0.0), 4) AS precision_at_k, round(coalesce(n_found / nullif(n_gold, 0)::DOUBLE, 0.0), 4) AS recall_at_k,
round(coalesce(1.0::DOUBLE / first_gold, 0.0), 4) AS mrr, CASE WHEN n_found > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit_rate, n_above = 0 AS failed
FROM (SELECT {hits}.query_id, count(*) FILTER (rank <= {K}) AS n_top, count(*) FILTER (rank <= {K} AND g.chunk_id IS NOT NULL) AS n_hit, count(DISTINCT CASE WHEN rank <= {K} AND g.chunk_id IS NOT NULL THEN {hits}.chunk_id END) AS n_found, min(rank) FILTER (g.chunk_id IS NOT NULL) AS first_gold, count(*) FILTER (score >= {sim}) AS n_above
FROM {hits} LEFT JOIN g ON g.query_id = {hits}.query_id AND g.chunk_id = {hits}.chunk_id GROUP BY 1) x FULL JOIN (SELECT query_id, count(*) AS n_gold FROM g GROUP BY 1) t ON x.query_id = t.query_id"""


def FM(src: str) -> str:
    return f"""SELECT x.query_id, round(n_removed / n_retrieved::DOUBLE, 4) AS filter_ratio, round(CASE WHEN coalesce(n_gold, 0) = 0 THEN 1.0 ELSE kept_gold / n_gold::DOUBLE END, 4) AS gold_retained,
round(coalesce((retrieved_gold - kept_gold) / nullif(retrieved_gold, 0)::DOUBLE, 0.0), 4) AS false_deletion, round(coalesce(after_k / nullif(n_gold, 0)::DOUBLE, 0.0) - coalesce(before_k / nullif(n_gold, 0)::DOUBLE, 0.0), 4) AS recall_delta, retrieved_gold - kept_gold AS deleted_gold, retrieved_gold
FROM (SELECT query_id, count(*) AS n_retrieved, count(*) FILTER (NOT kept) AS n_removed, count(DISTINCT chunk_id) FILTER (gold) AS retrieved_gold, count(DISTINCT chunk_id) FILTER (gold AND kept) AS kept_gold, count(DISTINCT chunk_id) FILTER (gold AND rank <= {K}) AS before_k, count(DISTINCT chunk_id) FILTER (gold AND kept AND place <= {K}) AS after_k
FROM (SELECT {src}.*, g.chunk_id IS NOT NULL AS gold, sum(CASE WHEN kept THEN 1 ELSE 0 END) OVER (PARTITION BY {src}.query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS place FROM {src} LEFT JOIN g ON g.query_id = {src}.query_id AND g.chunk_id = {src}.chunk_id) GROUP BY 1) x LEFT JOIN (SELECT query_id, count(*) AS n_gold FROM g GROUP BY 1) t ON x.query_id = t.query_id"""


@query(f"WITH {HITS}, {GOLD} {IR('h')}")
def ir_metrics(spark, d):
    return metrics.retrieval_metrics(_hits(spark, d), _gold(spark, d), K, SIM)


@query(f"WITH {HITS}, {GOLD}, {FILTERED} {FM('f')}")
def filter_metrics(spark, d):
    return metrics.filter_metrics(context_filter(_hits(spark, d), "on", SIM), _gold(spark, d), K)


@query(f"WITH {HITS}, {FILTERED} SELECT query_id, max(score) AS top_score, {R4('avg(score)')} AS mean_score, count(*) AS evidence_count, count(*) FILTER (score >= {STRONG}) AS strong_count FROM f WHERE kept GROUP BY query_id")
def retrieval_signals(spark, d):
    return metrics.retrieval_signals(context_filter(_hits(spark, d), "on", SIM), STRONG)


@query(f"WITH {HITS} SELECT count(*) AS queries, round(avg(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS failure_rate FROM (SELECT query_id, count(*) FILTER (score >= 0.4) AS n FROM h GROUP BY 1)")
def retrieval_failure_rate(spark, d):
    got = _hits(spark, d).groupBy("query_id").agg(F.count_if(F.col("score") >= 0.4).alias("n"))
    return got.agg(F.count("*").alias("queries"), F.round(F.avg((F.col("n") == 0).cast("double")), 4).alias("failure_rate"))


RUNS = [ev.Run("off", "off", SIM), ev.Run("on", "on", SIM), ev.Run("strict", "on", 0.4), ev.Run("mean_off", "off", SIM, True), ev.Run("mean_on", "on", SIM, True)]


def _run_sql(run: ev.Run) -> str:
    n, t = run.name, run.threshold
    kept = "true" if run.mode == "off" else f"(rank = 1 OR score >= {t})"
    conf = f"(SELECT query_id, {R4('avg(score) FILTER (kept)')} AS confidence FROM f_{n} GROUP BY 1)" if run.mean_form else f"({CONF('filter_ratio', f'f_{n}', t)})"
    return f"""f_{n} AS (SELECT *, {kept} AS kept FROM h), k_{n} AS (SELECT query_id, chunk_id, score, rank FROM f_{n} WHERE kept),
c_{n} AS (SELECT '{n}' AS run, b.*, a.precision_at_k AS post_precision, a.recall_at_k AS post_recall, m.filter_ratio, m.false_deletion, m.recall_delta, m.gold_retained, c.confidence FROM ({IR('h', t)}) b JOIN ({IR(f'k_{n}', t)}) a USING (query_id) JOIN ({FM(f'f_{n}')}) m USING (query_id) JOIN {conf} c USING (query_id))"""


MEANS = ("precision_at_k", "recall_at_k", "mrr", "hit_rate", "post_precision", "post_recall", "filter_ratio", "false_deletion", "recall_delta", "gold_retained", "confidence")
COMPARE = f"WITH {HITS}, {GOLD}, {', '.join(map(_run_sql, RUNS))}, cases AS ({' UNION ALL BY NAME '.join(f'SELECT * FROM c_{r.name}' for r in RUNS)}), agg AS (SELECT run, count(*) AS case_count, {', '.join(f'{R4(f"coalesce(avg({m}), 0.0)")} AS {m}' for m in MEANS)}, {R4('coalesce(avg(failed::INT::DOUBLE), 0.0)')} AS failure_rate FROM cases GROUP BY run)"


def _aggregates(spark, d):
    return ev.aggregate_runs(ev.evaluate(_hits(spark, d), _gold(spark, d), RUNS, SETTINGS))


@query(f"{COMPARE} SELECT * FROM agg")
def eval_comparison(spark, d):
    return _aggregates(spark, d)


@query(f"""{COMPARE}, v AS (SELECT o.run, round(o.confidence - b.confidence, 4) AS confidence_delta, round(o.post_precision - b.post_precision, 4) AS precision_delta, round(o.post_recall - b.post_recall, 4) AS recall_change, o.recall_delta, o.false_deletion, o.filter_ratio FROM agg o, agg b WHERE b.run = 'mean_off' AND o.run <> 'mean_off')
SELECT *, CASE WHEN confidence_delta > 0 AND (recall_delta < 0 OR false_deletion > 0) THEN 'fake_confidence' WHEN confidence_delta > 0 AND precision_delta >= 0 AND recall_delta >= 0 THEN 'improved' ELSE 'no_gain' END AS verdict, filter_ratio > 0.8 AS ratio_warning FROM v""")
def fake_confidence_verdict(spark, d):
    return ev.verdicts(_aggregates(spark, d), "mean_off", SETTINGS).drop("quality_delta", "reasons", "warnings")


STAGE_SQL = f"""WITH {HITS}, {GOLD}, {FILTERED}, x AS (SELECT f.query_id, count(*) FILTER (g.chunk_id IS NOT NULL) > 0 AS got, count(*) FILTER (g.chunk_id IS NOT NULL AND rank <= 3) > 0 AS in_top, count(*) FILTER (g.chunk_id IS NOT NULL AND kept) > 0 AS kept, max(score) AS top FROM f LEFT JOIN g ON g.query_id = f.query_id AND g.chunk_id = f.chunk_id GROUP BY 1),
st AS (SELECT query_id, CASE WHEN NOT got THEN 'Retrieval' WHEN NOT in_top THEN 'Ranking' WHEN NOT kept THEN 'Filter' WHEN top * 2 < 0.6 THEN 'Context' WHEN top * 1.8 < 0.6 THEN 'Interpretation' WHEN query_id % 40 = 0 THEN 'Generation' WHEN 1 - top * 1.7 > 0.4 THEN 'Hallucination' END AS stage FROM x)"""


def _stages(spark, d):
    hits = context_filter(_hits(spark, d), "on", SIM)
    x = hits.join(_gold(spark, d).withColumn("gold", F.lit(True)), ["query_id", "chunk_id"], "left").withColumn("gold", F.coalesce("gold", F.lit(False)))
    x = x.groupBy("query_id").agg(F.bool_or("gold").alias("got"), F.bool_or(F.col("gold") & (F.col("rank") <= 3)).alias("in_top"), F.bool_or(F.col("gold") & F.col("kept")).alias("kept"), F.max("score").alias("top"))
    answer = F.when(F.col("query_id") % 40 == 0, "").otherwise("answer")
    scores = {"context_relevance": F.col("top") * 2, "answer_relevance": F.col("top") * 1.8, "hallucination": 1 - F.col("top") * 1.7}
    return x.select("query_id", ev.error_stage(F.lit(True), F.col("got"), F.col("in_top"), F.col("kept"), scores, answer, F.lit(True), SETTINGS).alias("stage"))


@query(f"{STAGE_SQL} SELECT query_id, stage FROM st")
def error_stages(spark, d):
    return _stages(spark, d)


@query(f"{STAGE_SQL} SELECT stage, count(*) AS cases FROM st WHERE stage IS NOT NULL GROUP BY stage")
def error_stage_histogram(spark, d):
    return ev.stage_histogram(_stages(spark, d))


@query(f"{STAGE_SQL} SELECT stage, cases FROM (SELECT stage, count(*) AS cases FROM st WHERE stage IS NOT NULL GROUP BY stage) ORDER BY cases DESC, stage LIMIT 1")
def worst_stage(spark, d):
    return ev.stage_histogram(_stages(spark, d)).limit(1)


@query(f"WITH {HITS} SELECT query_id, chunk_id, score, rank FROM h WHERE (score >= {STRONG} AND rank <= 3) OR (rank = 1 AND score < {STRONG})")
def silver_labels(spark, d):
    return ev.silver_gold(_hits(spark, d), STRONG).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


STRIP = lambda c: f"regexp_replace({c}, '^{tx.SPACE}+|{tx.SPACE}+$', '', 'g')"


@query(f"SELECT 'case-' || doc_id AS case_id, {STRIP('text')} AS query, ['cr-' || doc_id] AS gold_chunks FROM documents WHERE {STRIP('text')} <> ''")
def self_retrieval_cases(spark, d):
    docs = read_table(spark, d, "documents")
    return ingest.self_retrieval_cases(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("pr_diff"), F.lit("").alias("source_code")))


@query("SELECT text AS source_code, text AS pr_diff, source || repeat('x', doc_id % 20) AS review_comment, true AS has_issue FROM documents WHERE length(source || repeat('x', doc_id % 20)) >= 15 AND length(text) <= 4000")
def adapt_filter_short(spark, d):
    docs = read_table(spark, d, "documents")
    return ingest.adapt("review_comments", docs.select(F.col("text").alias("diff_hunk"), F.concat("source", F.repeat(F.lit("x"), (F.col("doc_id") % 20).cast("int"))).alias("code_review_comment")))


@query(f"""SELECT dataset_source, count(*) AS n, count(*) FILTER (has_issue) AS issues, sum(length(review_comment)) AS chars FROM (
SELECT 'documents' AS dataset_source, text AS review_comment, true AS has_issue FROM documents WHERE length({STRIP('text')}) >= 15 AND length(text) <= 4000
UNION ALL SELECT 'conversations', text, role = 'user' FROM conversations WHERE length({STRIP('text')}) >= 6) GROUP BY 1""")
def adapt_union(spark, d):
    docs, talk = read_table(spark, d, "documents"), read_table(spark, d, "conversations")
    one = ingest.adapt("review_comments", docs.select(F.col("text").alias("diff_hunk"), F.col("text").alias("code_review_comment"))).withColumn("dataset_source", F.lit("documents"))
    two = ingest.adapt("classified", talk.select(F.col("text").alias("msg"), F.lit("").alias("oldf"), F.lit("").alias("patch"), (F.col("role") == "user").cast("int").alias("y"))).withColumn("dataset_source", F.lit("conversations"))
    return one.unionByName(two).groupBy("dataset_source").agg(F.count("*").alias("n"), F.count_if("has_issue").alias("issues"), F.sum(F.length("review_comment")).alias("chars"))


@query("SELECT d.doc_id AS id, length(d.text) AS n FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE length(d.text) > 0 AND length(d.text) >= 15 ORDER BY 1 LIMIT 100")
def eval_row_sample(spark, d):
    docs = read_table(spark, d, "documents").join(read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    rows = docs.select(F.col("doc_id").alias("id"), "embedding", F.col("text").alias("review_comment"), F.col("text").alias("pr_diff"), F.lit("").alias("source_code"))
    return ingest.eval_row_sample(rows, 100).select("id", F.length("pr_diff").cast("long").alias("n"))


TOKENS = lambda c: f"list_transform(regexp_extract_all({c}, '({tx.TOKEN})', 1), lambda t: lower(t))"
PAIRS = """a AS (SELECT a.conv_id, a.turn, q.text AS question, a.text AS answer FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant' AND q.role = 'user')"""


def _pairs(spark, d):
    t = read_table(spark, d, "conversations")
    q = t.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return t.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(q, ["conv_id", "turn"])


@query(f"""WITH {PAIRS}, t AS (SELECT conv_id, turn, {TOKENS('answer')} AS x, {TOKENS('question')} AS y FROM a),
u AS (SELECT conv_id, turn, len(x) AS nx, len(y) AS ny, list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))) AS n_both FROM t)
SELECT conv_id, turn, CASE WHEN nx = 0 OR ny = 0 OR coalesce(n_both, 0) = 0 THEN 0.0::DOUBLE ELSE {R4('2.0::DOUBLE * n_both / (nx + ny)')} END AS f1 FROM u""")
def token_f1(spark, d):
    return metrics.token_f1(_pairs(spark, d), ["conv_id", "turn"], "answer", "question")


NORM = lambda c: f"lower(trim(regexp_replace({c}, '{tx.SPACE}+', ' ', 'g')))"


@query(f"WITH {PAIRS} SELECT conv_id, turn, CASE WHEN {NORM('question')} <> '' AND {NORM('answer')} = {NORM('question')} THEN 1.0::DOUBLE ELSE 0.0 END AS em FROM a")
def exact_match(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", tx.exact_match(F.col("answer"), F.col("question")).alias("em"))


STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"
COVER = lambda needles, hay: f"coalesce(len(list_filter({needles}, lambda n: contains(lower({hay}), n)))::DOUBLE / nullif(len({needles}), 0), 0.0)"


# Some answers and questions hold no token at all, and some no reference: what the offline judge says then is part of the check.
JUDGED = f"""{PAIRS}, b AS (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN '!!' ELSE answer END AS answer, CASE WHEN conv_id % 13 = 0 THEN chr(12288) || '?' ELSE question END AS question, CASE WHEN conv_id % 3 = 0 THEN ['Release', ' ', 'notes '] ELSE [] END AS ref FROM a),
t AS (SELECT *, list_filter({TOKENS('answer')}, lambda t: NOT list_contains({STOP}, t)) AS xa, list_filter({TOKENS('question')}, lambda t: NOT list_contains({STOP}, t)) AS xq, ['release', 'notes'] AS xr FROM b)"""


def _judged(spark, d):
    b = _pairs(spark, d).select("conv_id", "turn", F.when(F.col("conv_id") % 11 == 0, "!!").otherwise(F.col("answer")).alias("answer"), F.when(F.col("conv_id") % 13 == 0, "\u3000?").otherwise(F.col("question")).alias("question"))
    b = b.withColumn("ref", F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("Release"), F.lit(" "), F.lit("notes "))).otherwise(F.array().cast("array<string>")))
    t = b.withColumns({"xa": tx.content_tokens(F.col("answer")), "xq": tx.content_tokens(F.col("question"))})
    return t, judges.generation_judge(F.col("question"), F.lit(""), F.col("answer"), F.col("ref"), F.col("xa"), F.col("xq"))


@query(f"""WITH {JUDGED} SELECT conv_id, turn, {R4(COVER('xa', 'question'))} AS groundedness, {R4(COVER('xa', 'question'))} AS faithfulness, {R4('1 - ' + COVER('xa', 'question'))} AS hallucination,
CASE WHEN len(ref) > 0 THEN {R4(COVER('xr', 'answer'))} END AS completeness, CASE WHEN len(ref) > 0 THEN {R4(COVER('xr', 'answer'))} WHEN len(xq) > 0 THEN {R4(COVER('xq', 'answer'))} END AS answer_relevance FROM t""")
def coverage_judge(spark, d):
    t, s = _judged(spark, d)
    return t.select("conv_id", "turn", *(s[c].alias(c) for c in ("groundedness", "faithfulness", "hallucination", "completeness", "answer_relevance")))


@query(f"""WITH {JUDGED} SELECT conv_id, turn, {R4(COVER('xq', 'answer'))} AS context_relevance FROM t""")
def context_relevance(spark, d):
    t, _ = _judged(spark, d)
    s = judges.generation_judge(F.col("question"), F.col("answer"), F.col("answer"), F.col("ref"), F.col("xa"), F.col("xq"))
    return t.select("conv_id", "turn", s["context_relevance"].alias("context_relevance"))


@query(f"""WITH {PAIRS}, t AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 1 - len(answer) % 10 / 10.0::DOUBLE END AS h, CASE WHEN conv_id % 3 = 1 THEN len(answer) % 10 / 10.0::DOUBLE END AS g FROM a),
u AS (SELECT CASE WHEN h IS NOT NULL THEN round(h, 4) >= 0.6 WHEN g IS NOT NULL THEN round(g, 4) < 0.6 END AS bad FROM t) SELECT count(bad) AS judged, {R4('coalesce(avg(bad::INT::DOUBLE), 0.0)')} AS hallucination_rate FROM u""")
def hallucination_rate(spark, d):
    share = F.length("answer") % 10 / 10.0
    flag = metrics.hallucination_flag(F.round(F.when(F.col("conv_id") % 3 == 0, 1 - share), 4), F.round(F.when(F.col("conv_id") % 3 == 1, share), 4), F.lit(None).cast("double"))
    return _pairs(spark, d).select(flag.alias("bad")).agg(F.count("bad").alias("judged"), metrics.mean_metric(F.col("bad").cast("double")).alias("hallucination_rate"))


KSTOP = "[" + ", ".join(f"'{w}'" for w in tx.KEYWORD_STOPWORDS) + "]"
KW = f"""w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '({tx.KEYWORD})', 1), lambda t: NOT list_contains({KSTOP}, lower(t))) AS ws FROM conversations),
e AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
f AS (SELECT conv_id, turn, lower(word) AS lw, min(pos) AS pos, arg_min(word, pos) AS word FROM e GROUP BY 1, 2, 3)"""


@query(f"WITH {KW} SELECT conv_id, turn, list(word ORDER BY pos)[1:8] AS keywords FROM f GROUP BY 1, 2")
def extract_keywords(spark, d):
    got = read_table(spark, d, "conversations").select("conv_id", "turn", tx.keywords(F.col("text")).alias("keywords"))
    return got.where(F.size("keywords") > 0)


JUDGE = """CASE WHEN n = '' OR n IN ('수정함', '업데이트', '테스트 완료', '코드 정리', '버그 수정', '리팩토링') OR regexp_matches(n, '^(record-[0-9]+|test-.*|mock_.*|dummy@.*|foo|bar)$') OR n IN ('python', 'javascript', 'typescript', 'react', 'fastapi', 'github', 'java') THEN 'not_important' END"""
JROWS = f"""SELECT user_id, event_id, keyword, {NORM('keyword')} AS n FROM (SELECT user_id, event_id, CASE event_id % 8 WHEN 0 THEN ' Python ' WHEN 1 THEN 'record-' || event_id WHEN 2 THEN '' WHEN 3 THEN 'mock_' || event_type WHEN 4 THEN 'Test-x' ELSE event_type || user_id END AS keyword FROM events)"""


def _keyword_rows(spark, d):
    e = F.col("event_id")
    word = F.when(e % 8 == 0, " Python ").when(e % 8 == 1, F.concat(F.lit("record-"), e)).when(e % 8 == 2, "").when(e % 8 == 3, F.concat(F.lit("mock_"), "event_type")).when(e % 8 == 4, "Test-x").otherwise(F.concat("event_type", "user_id"))
    return read_table(spark, d, "events").select("event_id", "user_id", word.alias("keyword"))


@query(f"SELECT event_id, {JUDGE} AS label FROM ({JROWS})")
def keyword_offline_judge(spark, d):
    return _keyword_rows(spark, d).select("event_id", judges.offline_keyword_label(F.col("keyword")).alias("label"))


@query(f"""WITH l AS (SELECT event_id, keyword, coalesce({JUDGE}, CASE WHEN event_id % 11 = 0 THEN 'not_important' WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN 'important' WHEN event_id % 2 = 0 THEN 'not_important' ELSE 'not_important' END) AS label FROM ({JROWS}))
SELECT keyword, count(*) AS n, min(event_id) AS first_seen FROM l WHERE label = 'important' GROUP BY keyword HAVING count(*) >= 2""")
def keyword_report(spark, d):
    e = F.col("event_id")
    criteria = F.when(e % 3 == 0, F.array(F.lit("E"))).otherwise(F.array(F.lit("A")))
    label = judges.keyword_label(F.col("keyword"), F.when(e % 2 == 0, "important").otherwise("not_important"), criteria, e % 11 == 0)
    got = _keyword_rows(spark, d).withColumn("label", label).where("label = 'important'")
    return got.groupBy("keyword").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen")).where(f"n >= {DEFAULTS.recurring_keyword}")


@query(f"SELECT event_id, CASE WHEN lower(s) IN ('null', 'none', 'nil', 'n/a', 'na', '-', '') THEN NULL ELSE s END AS value FROM (SELECT event_id, {STRIP("CASE event_id % 5 WHEN 0 THEN chr(12288) || 'N/A' || chr(160) WHEN 1 THEN event_type || ' ' || chr(12288) WHEN 2 THEN 'None' WHEN 3 THEN '' ELSE event_type END")} AS s FROM events)")
def nullish_normalize(spark, d):
    e = F.col("event_id") % 5
    raw = F.when(e == 0, "\u3000N/A\u00a0").when(e == 1, F.concat("event_type", F.lit(" \u3000"))).when(e == 2, "None").when(e == 3, "").otherwise(F.col("event_type"))
    return read_table(spark, d, "events").select("event_id", tx.nullish(raw).alias("value"))


@query("SELECT event_id, trunc(greatest(0.0, least(100.0, coalesce(try_cast(s AS DOUBLE), 0.0))))::INT AS risk FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'null' WHEN 1 THEN '-5' WHEN 2 THEN '1e12' WHEN 3 THEN '99999999999' ELSE round(value, 2)::VARCHAR END AS s FROM events)")
def risk_clamp(spark, d):
    e = F.col("event_id") % 7
    return read_table(spark, d, "events").select("event_id", tx.risk_score(F.when(e == 0, "null").when(e == 1, "-5").when(e == 2, "1e12").when(e == 3, "99999999999").otherwise(F.round("value", 2).cast("string"))).alias("risk"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(spark, d):
    return read_table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


ROLE_OF = "CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in (("AUTOMOBILE", " Back-End Developer"), ("BUILDING", "UI"), ("FURNITURE", "qa team"), ("HOUSEHOLD", "Product_Owner"), ("MACHINERY", "plumber"))) + " ELSE 'ML.engineer' END"


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '백엔드' WHEN 'BUILDING' THEN NULL WHEN 'FURNITURE' THEN 'QA' WHEN 'HOUSEHOLD' THEN '기획' WHEN 'MACHINERY' THEN NULL ELSE 'AI' END AS role FROM customer")
def role_normalize(spark, d):
    return read_table(spark, d, "customer").select("c_custkey", normalize.normalize_role(F.expr(ROLE_OF.format(c="c_mktsegment"))).alias("role"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '백엔드' WHEN 'BUILDING' THEN NULL WHEN 'FURNITURE' THEN 'QA' WHEN 'HOUSEHOLD' THEN '기획' WHEN 'MACHINERY' THEN NULL ELSE 'AI' END AS role FROM customer")
def role_normalize_nfkc(spark, d):
    wide = F.translate(F.expr(ROLE_OF.format(c="c_mktsegment")), "aeBQAML _", "ａｅＢＱＡＭＬ\u3000＿")
    return read_table(spark, d, "customer").select("c_custkey", normalize.normalize_role(wide).alias("role"))


FILES = """p AS (SELECT page_id, page_id // 10 AS pr_id, CASE page_id % 6 WHEN 0 THEN 'src/package-lock.json' WHEN 1 THEN 'web/dist/app.js' WHEN 2 THEN 'a/b.min.js' WHEN 3 THEN 'src/m' || page_id || '.py' WHEN 4 THEN 'lib/r.py' ELSE 'x/y.ts' END AS path, CASE WHEN page_id % 6 = 4 THEN 'RENAMED' ELSE 'MODIFIED' END AS change_type, CASE WHEN page_id % 7 = 0 THEN '  ' ELSE html END AS patch FROM pages),
l AS (SELECT *, (regexp_extract(path, '[^/]*$') = 'package-lock.json' OR suffix(lower(path), '.min.js') OR contains('/' || lower(path), '/dist/') OR (change_type = 'RENAMED' AND NOT contains(patch, '@@'))) AS low FROM p)"""


def _files(spark, d):
    p = F.col("page_id")
    path = F.when(p % 6 == 0, "src/package-lock.json").when(p % 6 == 1, "web/dist/app.js").when(p % 6 == 2, "a/b.min.js").when(p % 6 == 3, F.concat(F.lit("src/m"), p, F.lit(".py"))).when(p % 6 == 4, "lib/r.py").otherwise("x/y.ts")
    return read_table(spark, d, "pages").select("page_id", F.floor(p / 10).cast("long").alias("pr_id"), path.alias("path"), F.when(p % 6 == 4, "RENAMED").otherwise("MODIFIED").alias("change_type"), F.when(p % 7 == 0, "  ").otherwise(F.col("html")).alias("patch"))


@query(f"WITH {FILES} SELECT page_id, low FROM l")
def low_value_files(spark, d):
    return _files(spark, d).select("page_id", tx.low_value_file(F.col("path"), F.col("change_type"), F.col("patch")).alias("low"))


@query(f"""WITH {FILES}, x AS (SELECT *, '### ' || path || ' (' || change_type || ')' || chr(10) || CASE WHEN length(patch) > 4000 THEN left(patch, 4000) || chr(10) || '... (patch truncated)' ELSE patch END AS b FROM l WHERE trim(patch) <> '')
SELECT pr_id, coalesce(string_agg(b, chr(10) || chr(10) ORDER BY page_id) FILTER (NOT low), '') || CASE WHEN count(*) FILTER (low) > 0 THEN chr(10) || chr(10) || '... (truncated, ' || count(*) FILTER (low) || ' files omitted: lockfile/generated/vendored/rename-only changes)' ELSE '' END AS diff_content, count(*) FILTER (NOT low) AS included, count(*) FILTER (low) AS omitted FROM x GROUP BY pr_id""")
def diff_assembly(spark, d):
    return prompt.assemble_diff(_files(spark, d), "pr_id", "page_id")


@query(f"WITH {HITS} SELECT query_id, string_agg('[cr-' || chunk_id || '] (출처: kb, similarity: ' || printf('%.4f', score) || ')' || chr(10) || 'chunk ' || chunk_id, chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY 1")
def context_section(spark, d):
    hits = _hits(spark, d)
    return prompt.context_section(hits.select("query_id", "rank", F.concat(F.lit("cr-"), "chunk_id").alias("chunk_id"), F.lit("kb").alias("source"), "score", F.concat(F.lit("chunk "), "chunk_id").alias("text")))


@query("SELECT doc_id, 'PR Title/Summary: ' || source || chr(10) || 'PR Diff:' || chr(10) || left(coalesce(text, ''), 4000) AS query FROM documents")
def query_text(spark, d):
    return read_table(spark, d, "documents").select("doc_id", prompt.query_text(F.col("source"), F.col("text")).alias("query"))


CANDS = "(VALUES (0.2), (0.25), (0.3), (0.35), (0.4), (0.45))"


@query(f"WITH {HITS}, b AS (SELECT query_id, max(score) AS top_score FROM h GROUP BY 1) SELECT t.threshold::DOUBLE AS threshold, count(*) FILTER (top_score >= t.threshold::DOUBLE) AS passed, count(*) FILTER (NOT top_score >= t.threshold::DOUBLE) AS skipped, round(count(*) FILTER (top_score >= t.threshold::DOUBLE) / count(*)::DOUBLE, 4) AS ratio FROM b, {CANDS} t(threshold) GROUP BY 1")
def threshold_sweep(spark, d):
    best = _hits(spark, d).groupBy("query_id").agg(F.max("score").alias("top_score"))
    return measure.threshold_sweep(best, thresholds=(0.2, 0.25, 0.3, 0.35, 0.4, 0.45))


@query("SELECT lang, count(n_chars) AS n, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS std, min(n_chars) AS least, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.75), 4) AS p75, round(quantile_cont(n_chars, 0.9), 4) AS p90, round(quantile_cont(n_chars, 0.95), 4) AS p95, round(quantile_cont(n_chars, 0.99), 4) AS p99, max(n_chars) AS most FROM documents GROUP BY lang")
def length_percentiles(spark, d):
    return measure.describe_lengths(read_table(spark, d, "documents"), "lang", "n_chars")


@query("SELECT source, list_sort(list(n_chars))[(count(*) // 2 + 1)::INT] AS upper_median FROM documents GROUP BY source")
def upper_median(spark, d):
    return measure.upper_median_by(read_table(spark, d, "documents"), ["source"], "n_chars")


@query("SELECT source, count(*) AS n, max(n_chars) AS most, count(*) FILTER (n_chars < 500) AS short FROM documents GROUP BY source")
def per_source_stats(spark, d):
    return read_table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("most"), F.count_if(F.col("n_chars") < 500).alias("short"))


@query("SELECT user_id, round(max(value) FILTER (event_type = 'click'), 4) AS click, round(max(value) FILTER (event_type = 'purchase'), 4) AS purchase, round(max(value) FILTER (event_type = 'view'), 4) AS view FROM events GROUP BY user_id")
def variant_pivot(spark, d):
    got = read_table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.max("value"))
    return got.select("user_id", *(F.round(c, 4).alias(c) for c in ("click", "purchase", "view")))


@query("SELECT user_id, event_type, count(*) AS repeats, round(max(value) - min(value), 4) AS spread, count(DISTINCT value >= 50) > 1 AS flipped FROM events GROUP BY 1, 2")
def run_stability(spark, d):
    return measure.run_stability(read_table(spark, d, "events"), ["user_id", "event_type"], "value", 50)


@query("SELECT count(*) AS n, sum(length(text)) AS chars, sum(length(text)) // 4 AS tokens, round((sum(length(text)) // 4)::DOUBLE / 1000000 * 0.02, 4) AS usd FROM documents")
def cost_estimate(spark, d):
    return measure.cost_estimate(read_table(spark, d, "documents"), "text")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def checkpoint_anti_join(spark, d):
    return ingest.not_yet_saved(read_table(spark, d, "documents"), read_table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT count(*) AS deleted FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id < 3)")
def delete_count(spark, d):
    docs = read_table(spark, d, "documents")
    return ingest.count_deleted(docs, docs.where("doc_id < 3"), ["source"])


@query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id < 3)")
def delete_set(spark, d):
    docs = read_table(spark, d, "documents")
    return ingest.delete_keys(docs, docs.where("doc_id < 3"), ["source"]).select("doc_id", "source")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, d):
    return ingest.upsert_latest(read_table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


NOW = "TIMESTAMP '2024-01-20 00:00:00'"
JOBS = """e AS (SELECT 'job-' || user_id AS job_id, event_id, ts, CASE WHEN user_id % 4 = 1 THEN 'PROCESSING' WHEN event_type = 'purchase' THEN 'COMPLETED' WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'click' AND user_id % 3 <> 0 THEN 'COMPLETED' ELSE 'PROCESSING' END AS status FROM events),
a AS (SELECT job_id, max((ts, event_id)) FILTER (status = 'PROCESSING') AS f, max((ts, event_id, status)) FILTER (status IN ('COMPLETED', 'FAILED')) AS l, count(*) AS n_events FROM e GROUP BY job_id),
j AS (SELECT job_id, CASE WHEN l IS NOT NULL AND (l[1] > f[1] OR (l[1] = f[1] AND l[2] > f[2])) THEN l[3] ELSE 'PROCESSING' END AS status, f[1] AS started_at, CASE WHEN l IS NOT NULL AND (l[1] > f[1] OR (l[1] = f[1] AND l[2] > f[2])) THEN l[1] END AS completed_at, n_events FROM a WHERE f IS NOT NULL)"""
TS = "strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


def _job_events(spark, d):
    t, u = F.col("event_type"), F.col("user_id")
    status = F.when(u % 4 == 1, "PROCESSING").when(t == "purchase", "COMPLETED").when(t == "error", "FAILED").when((t == "click") & (u % 3 != 0), "COMPLETED").otherwise("PROCESSING")
    return read_table(spark, d, "events").select(F.concat(F.lit("job-"), "user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))


@query(f"WITH {JOBS} SELECT job_id, status, {TS.format(c='started_at')} AS started_at, {TS.format(c='completed_at')} AS completed_at, n_events FROM j")
def job_latest_state(spark, d):
    return jobs.latest_state(_job_events(spark, d)).withColumns({c: jobs.iso(F.col(c)) for c in ("started_at", "completed_at")})


@query(f"WITH {JOBS} SELECT job_id, CASE WHEN status = 'PROCESSING' AND started_at < {NOW} - INTERVAL 30 MINUTE THEN 'FAILED' ELSE status END AS status, (status = 'PROCESSING' AND started_at < {NOW} - INTERVAL 30 MINUTE) AS reaped FROM j")
def job_reap(spark, d):
    return jobs.reap_stale(jobs.latest_state(_job_events(spark, d)), F.expr(NOW)).select("job_id", "status", "reaped")


@query(f"WITH {JOBS} SELECT job_id, status FROM j WHERE NOT (status IN ('COMPLETED', 'FAILED') AND completed_at IS NOT NULL AND completed_at < {NOW} - INTERVAL 5 DAY)")
def job_purge(spark, d):
    return jobs.purge_old(jobs.latest_state(_job_events(spark, d)), F.expr(NOW), 5).select("job_id", "status")


@query(f"WITH {JOBS}, r AS (SELECT *, (status = 'PROCESSING' AND started_at < {NOW} - INTERVAL 30 MINUTE) AS reaped FROM j) SELECT count(*) FILTER (reaped) AS reaped, count(*) FILTER (NOT reaped AND completed_at < {NOW} - INTERVAL 5 DAY) AS purged, count(*) AS jobs FROM r")
def job_maintenance(spark, d):
    return jobs.maintenance(jobs.latest_state(_job_events(spark, d)), F.expr(NOW), 30, 5)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'full ' || n_name WHEN o_orderkey % 3 = 1 THEN 'short ' || n_name ELSE 'default' END AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def project_lookup(spark, d):
    o = read_table(spark, d, "orders").join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(read_table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    m = F.col("o_orderkey") % 3
    req = o.select("o_orderkey", F.when(m == 0, F.concat(F.lit("team/"), "n_name")).when(m == 1, F.concat(F.lit("other/"), "n_name")).otherwise("none/none").alias("repo_name"))
    n = read_table(spark, d, "nation")
    none = F.lit(None).cast("string")
    row = lambda key, name: n.select(key.alias("key"), name.alias("name"), none.alias("description"), none.alias("purpose"), none.alias("language"))
    registry = row(F.concat(F.lit("team/"), "n_name"), F.concat(F.lit("full "), "n_name")).unionByName(row(F.col("n_name"), F.concat(F.lit("short "), "n_name")))
    return projects.project_info(req, registry, {"name": "default"}).select("o_orderkey", "name")


@query("SELECT user_id, count(*) AS n, round(CAST(coalesce(avg(CASE WHEN event_type IN ('click', 'view') THEN value END), 0.0) AS DECIMAL(20, 12)), 4)::DOUBLE AS mean FROM events GROUP BY user_id")
def metric_mean(spark, d):
    known = F.when(F.col("event_type").isin("click", "view"), F.col("value"))
    return read_table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), metrics.mean_metric(known).alias("mean"))


NAMES = "n AS (SELECT n_nationkey AS chunk_id, [n_name, left(n_name, 2), left(n_name, 1)] AS kws FROM nation)"


@query(f"""WITH {NAMES}, c AS (SELECT conv_id * 100 + turn AS query_id, array_to_string(list_transform(regexp_extract_all(text, '({tx.FIXTURE_TOKEN})', 1), lambda t: lower(t)), ' ') AS q FROM conversations WHERE conv_id % 20 = 0),
s AS (SELECT query_id, chunk_id, round(len(list_filter(kws, lambda k: contains(q, lower(k)))) / len(kws)::DOUBLE, 4) AS score FROM c, n) SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s) WHERE r <= 5""")
def keyword_retrieval(spark, d):
    cases = read_table(spark, d, "conversations").where("conv_id % 20 = 0").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    corpus = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("chunk_id"), F.array("n_name", F.left("n_name", F.lit(2)), F.left("n_name", F.lit(1))).alias("keywords"))
    return offline.keyword_topk(cases, corpus, 5).select("query_id", "chunk_id", "score")


@query(f"WITH {HITS}, {FILTERED} SELECT query_id, {R4('0.7 * coalesce(max(score) FILTER (kept), 0.0) + 0.3 * (count(*) FILTER (kept) / count(*)::DOUBLE)')} AS confidence FROM f GROUP BY query_id")
def confidence_simple(spark, d):
    return offline.simple_confidence(context_filter(_hits(spark, d), "on", SIM))


@query(f"WITH {HITS}, {FILTERED}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM f WHERE kept) SELECT query_id, string_agg('chunk ' || chunk_id, ' ' ORDER BY n) AS answer FROM k WHERE n <= 3 GROUP BY query_id")
def template_answer(spark, d):
    return offline.template_answer(context_filter(_hits(spark, d), "on", SIM).withColumn("text", F.concat(F.lit("chunk "), "chunk_id")))


@query()
def approx_topk(spark, d):
    return ann.approx_topk(_asked(spark, d), _vectors(spark, d), K)


WORDS = lambda c: f"list_filter(regexp_split_to_array({c}, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, {WORDS('text')} AS ws FROM documents), s AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 50, 1), 462)) AS st FROM w WHERE len(ws) > 0)
SELECT doc_id, (st // 462)::INT AS chunk_idx, array_to_string(ws[st + 1:st + 512], ' ') AS chunk FROM s""")
def chunk_text(spark, d):
    return ingest.chunk_words(read_table(spark, d, "documents").select("doc_id", "text"))


@query()
def unified_diff(spark, d):
    talk = _pairs(spark, d)
    return talk.select("conv_id", "turn", ingest.unified_diff("question", "answer").alias("diff"))


@query(f"SELECT doc_id, coalesce(array_to_string({WORDS('text')}[1:100], ' '), '') AS text FROM documents")
def token_truncate(spark, d):
    return read_table(spark, d, "documents").select("doc_id", ingest.token_truncate(100)("text").alias("text"))


# Citations of every query: one names an id that a kept hit would get, one has none, one is of the diff, one says nothing.
CITED = """c AS (SELECT query_id, 1 AS pos, 'c2' AS id, ' null ' AS source, 'cr-' || chunk_id AS location, 'x' AS description FROM h WHERE rank = 4
UNION ALL SELECT query_id, 2, NULL, 'pr_diff', 'src/a.py', '-' FROM h WHERE rank = 1 UNION ALL SELECT query_id, 4, ' ', NULL, 'cr-' || chunk_id, NULL FROM h WHERE rank = 2 AND query_id % 40 = 0
UNION ALL SELECT query_id, 5, 'c7', '', NULL, 'y' FROM h WHERE rank = 1)"""


@query(f"""WITH {HITS}, {CITED}, nul(x) AS (VALUES ('null'), ('none'), ('nil'), ('n/a'), ('na'), ('-'), ('')),
m AS (SELECT query_id, pos, CASE WHEN lower(trim(location)) NOT IN (FROM nul) THEN trim(location) END AS location, CASE WHEN lower(trim(source)) NOT IN (FROM nul) THEN trim(source) END AS s, CASE WHEN id IS NULL OR lower(trim(id)) IN (FROM nul) THEN 'e' || pos ELSE trim(id) END AS ref_id, CASE WHEN lower(trim(description)) NOT IN (FROM nul) THEN trim(description) END AS description FROM c),
one AS (SELECT m.query_id, pos::BIGINT AS place, ref_id, coalesce(s, CASE WHEN h.chunk_id IS NULL THEN 'pr_diff' ELSE 'context' END) AS source, location, description, 'cr-' || h.chunk_id AS chunk_id, h.score AS similarity_score FROM m LEFT JOIN h ON h.query_id = m.query_id AND 'cr-' || h.chunk_id = m.location),
u AS (SELECT query_id, list(ref_id) AS ids, max(place) AS cited FROM one GROUP BY 1), n AS (SELECT query_id, count(*) AS n FROM h GROUP BY 1)
SELECT * FROM one UNION ALL SELECT h.query_id, cited + rank, list_filter(list_transform(range(0, len(ids) + 1), lambda k: 'c' || (rank + k * n)), lambda x: NOT list_contains(ids, x))[1], 'context', CASE WHEN h.chunk_id % 2 = 0 THEN 'f' || h.chunk_id ELSE 'cr-' || h.chunk_id END, NULL, 'cr-' || h.chunk_id, h.score
FROM h JOIN u USING (query_id) JOIN n USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.query_id = h.query_id AND one.chunk_id = 'cr-' || h.chunk_id)""")
def evidence_refs(spark, d):
    hits = _hits(spark, d)
    kept = hits.select("query_id", "rank", F.concat(F.lit("cr-"), "chunk_id").alias("chunk_id"), F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("f"), "chunk_id")).otherwise("").alias("file_path"), "score")
    said = lambda pos, i, source, location, text: (F.lit(pos).alias("pos"), F.lit(i).cast("string").alias("id"), F.lit(source).cast("string").alias("source"), location.alias("location"), F.lit(text).cast("string").alias("description"))
    cited = kept.where("rank = 4").select("query_id", *said(1, "c2", " null ", F.col("chunk_id"), "x"))
    cited = cited.unionByName(kept.where("rank = 1").select("query_id", *said(2, None, "pr_diff", F.lit("src/a.py"), "-")))
    cited = cited.unionByName(kept.where("rank = 2 and query_id % 40 = 0").select("query_id", *said(4, " ", None, F.col("chunk_id"), None)))
    cited = cited.unionByName(kept.where("rank = 1").select("query_id", *said(5, "c7", "", F.lit(None).cast("string"), "y")))
    return normalize.evidence_refs(cited, kept)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Off, on and strict filter runs against each other over one scored set of hits."""
    return _aggregates(spark, d)

