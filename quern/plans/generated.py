"""Registered queries over generated answers and whole verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


from ..operators import chunking
from ..operators import evaluate as ev
from ..operators import generation as gen
from ..operators import record
from ..sources.readers import read_table
from .queries import COMPARE, COVER, PAIRS, R4, SETTINGS, STOP, TOKENS, _aggregates, _pairs, query


def _first_words():
    """Stands for a model: the context's first 12 words; a question whose length is a multiple of 9 breaks it."""

    def answer(question: str, context: str):
        if len(question) % 9 == 0:
            raise RuntimeError(f"no answer for {len(question)} characters")
        text = " ".join(context.split(" ")[:12])
        return {"answer": text, "confidence": len(context) % 10 / 10} if len(context) % 2 else text

    return answer


# Two runs over question and answer pairs: with the answer as context, and with the question before it.
RUNS = f"""{PAIRS}, c AS (SELECT *, answer AS context, 'plain' AS run FROM a UNION ALL SELECT *, question || ' ' || answer, 'asked' FROM a),
g AS (SELECT run, conv_id, turn, question, context, answer AS reference_answer, length(question) % 9 = 0 AS failed, array_to_string(string_split(context, ' ')[1:12], ' ') AS made, CASE WHEN length(context) % 2 = 1 THEN length(context) % 10 / 10.0::DOUBLE END AS stated FROM c),
t AS (SELECT *, list_filter({TOKENS('made')}, lambda t: NOT list_contains({STOP}, t)) AS xa, list_filter({TOKENS('question')}, lambda t: NOT list_contains({STOP}, t)) AS xq, list_filter({TOKENS('reference_answer')}, lambda t: NOT list_contains({STOP}, t)) AS xr FROM g WHERE NOT failed AND made <> ''),
s AS (SELECT run, conv_id, turn, {R4(COVER('xa', "(context || chr(10) || question)"))} AS groundedness, {R4(COVER('xq', 'context'))} AS context_relevance, CASE WHEN len(xr) > 0 THEN {R4(COVER('xr', 'made'))} END AS completeness FROM t)"""


def _answered(spark, d):
    a = _pairs(spark, d)
    runs = F.explode(F.array(F.struct(F.lit("plain").alias("run"), F.col("answer").alias("context")), F.struct(F.lit("asked").alias("run"), F.concat_ws(" ", "question", "answer").alias("context"))))
    cases = a.select("conv_id", "turn", "question", F.col("answer").alias("reference_answer"), runs.alias("r")).select("*", "r.run", "r.context").drop("r")
    made = gen.generate(cases.withColumn("reference_keywords", F.array().cast("array<string>")), _first_words, "first-words")
    return gen.judge_answers(made, ["run", "conv_id", "turn"], SETTINGS)


@query(f"""WITH {RUNS} SELECT g.run, g.conv_id, g.turn, CASE WHEN NOT failed THEN made END AS answer, CASE WHEN failed THEN 'RuntimeError: no answer for ' || length(question) || ' characters' END AS error, s.groundedness, s.context_relevance, s.completeness, failed AS execution FROM g LEFT JOIN s USING (run, conv_id, turn)""")
def eval_generation(spark, d):
    """Each case of two runs: a generator that breaks on some questions leaves the others as they are."""
    return _answered(spark, d).select("run", "conv_id", "turn", "answer", "error", "groundedness", "context_relevance", "completeness", F.coalesce(F.col("stage") == gen.EXECUTION, F.lit(False)).alias("execution"))


@query(f"""WITH {RUNS}, m AS (SELECT run, count(*) AS case_count, count(*) FILTER (failed) AS error_case_count, {R4('avg(CASE WHEN failed THEN NULL ELSE stated END)')} AS confidence FROM g GROUP BY run),
j AS (SELECT run, {R4('avg(groundedness)')} AS groundedness, {R4('avg(groundedness)')} AS faithfulness, {R4('avg(context_relevance)')} AS context_relevance, {R4('avg(completeness)')} AS completeness FROM s GROUP BY run) SELECT * FROM m JOIN j USING (run)""")
def eval_generation_runs(spark, d):
    return gen.aggregate_generation(_answered(spark, d), settings=SETTINGS).select("run", "case_count", "error_case_count", "confidence", "groundedness", "faithfulness", "context_relevance", "completeness")


@query(f"""{COMPARE}, x AS (SELECT *, (row_number() OVER (ORDER BY run)) / 10.0::DOUBLE AS faithfulness FROM agg),
v AS (SELECT o.run, round(o.confidence - b.confidence, 4) AS c, round(o.post_precision - b.post_precision, 4) AS p, round(o.faithfulness - b.faithfulness, 4) AS quality_delta, o.recall_delta AS r, o.false_deletion AS f, o.filter_ratio AS fr FROM x o, x b WHERE b.run = 'mean_off' AND o.run <> 'mean_off'),
w AS (SELECT *, CASE WHEN c > 0 AND (r < 0 OR f > 0) THEN 'fake_confidence' WHEN c > 0 AND p >= 0 AND quality_delta >= 0 THEN 'improved' ELSE 'no_gain' END AS verdict FROM v)
SELECT run, quality_delta, verdict, (r < 0)::INT + (f > 0)::INT + CASE verdict WHEN 'no_gain' THEN (c <= 0)::INT + (r < 0 OR f > 0)::INT ELSE 1 END AS n_reasons, (fr > {SETTINGS.filter_ratio_warn})::INT AS n_warnings FROM w""")
def verdict_reasons(spark, d):
    """Verdicts with a quality delta, how many reasons each has, and its warnings."""
    agg = _aggregates(spark, d)
    names = [r["run"] for r in agg.select("run").orderBy("run").collect()]  # a few runs
    quality = F.create_map(*[F.lit(x) for i, n in enumerate(names, 1) for x in (n, i / 10)])
    got = ev.verdicts(agg.withColumn("faithfulness", quality[F.col("run")]), "mean_off", SETTINGS)
    return got.select("run", "quality_delta", "verdict", F.size("reasons").alias("n_reasons"), F.size("warnings").alias("n_warnings"))


@query("""SELECT doc_id, lang AS summary, least(100, n_chars) AS risk, CASE WHEN doc_id % 4 = 0 THEN ['read ' || source] ELSE ['read ' || source, text] END AS tasks, CASE WHEN doc_id % 4 = 0 THEN [NULL] ELSE [NULL, 'QA'] END AS roles,
CASE WHEN doc_id % 4 = 0 THEN ['$.followUpTasks[1]: BIGINT'] ELSE [] END || CASE WHEN doc_id % 3 = 0 THEN ['$.source: unknown field'] ELSE [] END AS errors FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) = text AND text <> ''""")
def record_variants(spark, d):
    """Records of mixed types made from the texts: plain tasks beside objects, numbers where objects belong, unknown fields."""
    i = F.col("doc_id")
    docs = read_table(spark, d, "documents").where("trim(BOTH ' \\t\\n\\r' FROM text) = text and text <> ''")
    field = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    text = lambda c: F.to_json(F.struct(F.col(c).alias("x")))
    quoted = lambda c: F.regexp_extract(text(c), r'(?s)^\{"x":(.*)\}$', 1)
    second = F.when(i % 4 == 0, i.cast("string")).otherwise(F.concat(F.lit('{"role": "Tester", "task": '), quoted("text"), F.lit("}")))
    parts = [field("summary", quoted("lang")), field("riskScore", F.col("n_chars").cast("string")), field("followUpTasks", F.concat(F.lit('["read '), "source", F.lit('", '), second, F.lit("]")))]
    raw = F.concat(F.lit("{"), F.concat_ws(", ", *parts, F.when(i % 3 == 0, field("source", F.lit("null")))), F.lit("}"))
    got = record.parse(docs.select("doc_id", raw.alias("raw")))
    return got.select("doc_id", "summary", F.col("riskScore").cast("long").alias("risk"), F.transform("followUpTasks", lambda x: x["task"]).alias("tasks"), F.transform("followUpTasks", lambda x: x["role"]).alias("roles"), "errors")


@query("SELECT doc_id, length(text) AS reach, 0 AS over, 0 AS gaps FROM documents WHERE text <> ''")
def chunk_boundaries(spark, d):
    """Chunks at text boundaries reach from a text's start to its end, leave no gap and keep the budget."""
    cut = chunking.chunk_text(read_table(spark, d, "documents").select("doc_id", "text"), size=64, overlap=8)
    order = Window.partitionBy("doc_id").orderBy("chunk_idx")
    gap = F.col("start") > F.coalesce(F.lag("end").over(order), F.lit(0))
    seen = cut.withColumn("gap", gap).groupBy("doc_id")
    return seen.agg(F.max("end").alias("reach"), F.count_if(F.size(F.filter(F.split("chunk", r"\s+"), lambda w: w != "")) > 64).alias("over"), F.count_if("gap").alias("gaps"))
