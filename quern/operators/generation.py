"""Evaluation with generated answers: generation that keeps failures to their case, judge scores, means a run."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as tx
from .evaluate import error_stage
from .judges import CRITERIA, generation_judge
from .metrics import hallucination_flag, token_f1

EXECUTION = "Execution"
Generator = Callable[[str, str], "str | dict"]

_MADE: dict[str, Generator] = {}


def generate(cases: DataFrame, make: Callable[[], Generator], name: str = "default", question: str = "question", context: str = "context") -> DataFrame:
    """cases with answer, stated_confidence and error: what the generator gives for each question and context.

    The generator is made once in a Python worker. It gives a text, or a record with answer and confidence. What it
    raises becomes the row's error (class and message) and the row goes on without an answer; other rows are as if
    that one were not there. A row that has an error already is not sent.
    """
    known = "error" in cases.columns
    kept = [c for c in cases.columns if c != "error"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cases.schema.fields if f.name != "error") + ", answer string, stated_confidence double, error string"

    def one(generator: Generator, q: str | None, c: str | None, before: str | None) -> tuple[str | None, float | None, str | None]:
        if before is not None:
            return None, None, before
        try:
            made = generator(q or "", c or "")
            if not isinstance(made, dict):
                return str(made), None, None
            stated = made.get("confidence")
            return str(made.get("answer", "")), None if stated is None else round(float(stated), 4), None
        except Exception as e:
            return None, None, f"{type(e).__name__}: {e}"

    def run(batches):
        if name not in _MADE:
            _MADE[name] = make()
        for b in batches:
            before = b.column("error").to_pylist() if known else [None] * b.num_rows
            made = [one(_MADE[name], *row) for row in zip(b.column(question).to_pylist(), b.column(context).to_pylist(), before, strict=True)]
            new = [pa.array(list(x), t) for x, t in zip(zip(*made, strict=True) if made else ((), (), ()), (pa.string(), pa.float64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new], [*kept, "answer", "stated_confidence", "error"])

    return cases.mapInArrow(run, schema)


def judge_answers(answered: DataFrame, key: list[str], settings: Settings = DEFAULTS, gold: dict[str, Column] | None = None) -> DataFrame:
    """One row a case: the six criteria, exact match, token F1, the stage of its error.

    answered has the key, question, context, answer, reference_answer, reference_keywords and error. Only what has an
    answer is judged, and only what has a reference answer too is compared with it; a failed case has the stage
    Execution and no scores. gold: columns has_gold, gold_retrieved, gold_in_top_k, gold_kept for the stage, if cases have gold.
    """
    answer, failed = F.coalesce("answer", F.lit("")), F.col("error").isNotNull()
    judged = (answer != "") & ~failed
    words = F.when(F.coalesce(F.size("reference_keywords"), F.lit(0)) > 0, F.col("reference_keywords")).otherwise(tx.content_tokens(F.coalesce("reference_answer", F.lit(""))))
    rows = answered.withColumns({"_xa": tx.content_tokens(answer), "_xq": tx.content_tokens(F.coalesce("question", F.lit(""))), "_ref": words})
    scores = generation_judge(F.col("question"), F.col("context"), F.col("answer"), F.col("_ref"), F.col("_xa"), F.col("_xq"))
    rows = rows.withColumns({c: F.when(judged, scores[c]) for c in CRITERIA})
    compared = judged & (F.coalesce("reference_answer", F.lit("")) != "")
    rows = rows.withColumn("exact_match", F.when(compared, tx.exact_match(F.col("answer"), F.col("reference_answer"))))
    f1 = token_f1(rows.where(F.col("exact_match").isNotNull()), key, "answer", "reference_answer").withColumnRenamed("f1", "token_f1")
    no = F.lit(False)
    g = gold or dict.fromkeys(("has_gold", "gold_retrieved", "gold_in_top_k", "gold_kept"), no)
    stage = error_stage(g["has_gold"], g["gold_retrieved"], g["gold_in_top_k"], g["gold_kept"], {c: F.col(c) for c in CRITERIA}, F.col("answer"), judged, settings)
    rows = rows.withColumn("stage", F.when(failed, EXECUTION).otherwise(stage)).drop("_xa", "_xq", "_ref")
    return rows.join(f1, key, "left")


def aggregate_generation(cases: DataFrame, run: str = "run", settings: Settings = DEFAULTS) -> DataFrame:
    """One row a run of judged cases: counts, means of what is known (null if nothing is), hallucination rate, cases by stage."""
    mean = lambda c: tx.round4(F.avg(c))
    bad = hallucination_flag(F.col("hallucination"), F.col("groundedness"), F.col("faithfulness"), settings.score_pass)
    got = cases.groupBy(run).agg(
        F.count("*").alias("case_count"), F.count("error").alias("error_case_count"), *(mean(F.col(c)).alias(c) for c in (*CRITERIA, "exact_match", "token_f1")),
        tx.round4(F.coalesce(F.avg(bad.cast("double")), F.lit(0.0))).alias("hallucination_rate"), mean(F.col("stated_confidence")).alias("confidence"),
    )
    by_stage = cases.where("stage is not null").groupBy(run, "stage").agg(F.count("*").alias("n"))
    stages = by_stage.groupBy(run).agg(F.sort_array(F.collect_list(F.struct("stage", "n"))).alias("error_stages"))  # few stages
    return got.join(stages, run, "left").withColumn("error_stages", F.coalesce("error_stages", F.array().cast("array<struct<stage: string, n: bigint>>")))
