"""Sources: JSON lines, cases, files, tables, project registry."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULTS
from ..functions import text as tx

#: Folders that hold no sources.
EXCLUDED_DIRS = (".git", "node_modules", "dist", "build", "venv", ".venv", "__pycache__")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a line; blank lines are skipped, a broken line fails the read and names the file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of lines that are no JSON: for error reports, so the lines are numbered per file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("text"))
    bad = lines.where((tx.strip(F.col("text")) != "") & F.try_parse_json("text").isNull())
    # Lines of a file are read in order, over ascending partitions: a broken one's number is the count of lines up to it.
    order = Window.partitionBy("file").orderBy("n")
    return lines.join(F.broadcast(bad.select("file").distinct()), "file", "left_semi").withColumn("line", F.row_number().over(order)).join(bad.select("file", "n"), ["file", "n"], "left_semi").select("file", "line", "text")


def read_first(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame:
    """n rows at most, read no further than needed."""
    return read_jsonl(spark, path, schema).limit(n)


def as_case(raw: DataFrame) -> DataFrame:
    """Cases under their usual names: query or question, case_id or id or the query's start, gold chunks or gold ids."""
    query = F.coalesce(F.nullif("query", F.lit("")), F.nullif("question", F.lit("")))
    query = F.when(query.isNull(), F.raise_error(F.lit("a case without a query")).cast("string")).otherwise(query)
    none = F.array().cast("array<string>")
    return raw.withColumn("query", query).select(
        F.coalesce(F.nullif("case_id", F.lit("")), F.nullif("id", F.lit("")), F.left("query", F.lit(32))).alias("case_id"),
        "query",
        F.when(F.size("gold_chunks") > 0, F.col("gold_chunks")).otherwise(F.coalesce("gold_ids", "gold_chunks", none)).alias("gold_chunks"),
        "reference_answer",
        F.coalesce("reference_keywords", none).alias("reference_keywords"),
        "metadata",
    )


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return as_case(read_jsonl(spark, path, schemas.CASE))


def read_source_files(spark: SparkSession, root: str, extensions: tuple[str, ...], most: int = DEFAULTS.max_file_bytes, excluded: tuple[str, ...] = EXCLUDED_DIRS) -> DataFrame:
    """(file_path, content) of valid, non-blank UTF-8 files by suffix and size, outside the excluded folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.col("path"), f"^.*?{root.rstrip('/')}/", "")
    low = F.lower(rel)
    by_suffix = [low.endswith(e) for e in extensions]
    suffix = by_suffix[0]
    for s in by_suffix[1:]:
        suffix = suffix | s
    ok = suffix & (F.col("length") > 0) & (F.col("length") <= most) & ~F.arrays_overlap(F.split(rel, "/"), F.array(*map(F.lit, excluded)))
    return files.where(ok).where(F.is_valid_utf8("content")).select(rel.alias("file_path"), F.decode("content", "UTF-8").alias("content")).where(tx.strip(F.col("content")) != "")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array over many lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


PULL = "repo_name string, number long, title string, body string, diff string, error string"
PULL_ROW = pa.schema([(n, pa.int64() if n == "number" else pa.string()) for n in ("repo_name", "number", "title", "body", "diff", "error")])


def fetch_pull_requests(spark: SparkSession, repos: list[str], fetch: Callable[[str], list[dict]], per_task: int = 1) -> DataFrame:
    """Pull requests of repositories through an injected fetcher, from the executors; a failing one gives a row with its error."""

    def run(batches):
        for batch in batches:
            rows = []
            for repo in batch.column("repo_name").to_pylist():
                try:
                    rows += [{"repo_name": repo, "error": None, **{k: p.get(k) for k in ("number", "title", "body", "diff")}} for p in fetch(repo)]
                except Exception as e:  # one repository's failure leaves the others alone
                    rows.append({"repo_name": repo, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, PULL_ROW)

    return spark.createDataFrame([(r,) for r in repos], "repo_name string").repartition(max(1, len(repos) // per_task)).mapInArrow(run, PULL)


def tracked_files(spark: SparkSession, root: str) -> DataFrame | None:
    """Files that git tracks under root; None outside a repository."""
    got = subprocess.run(["git", "-C", root, "ls-files"], capture_output=True, text=True)
    return None if got.returncode else spark.createDataFrame([(x,) for x in got.stdout.splitlines()], "file_path string")


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(registry for project_info, default fields) of a YAML file with ``default`` and ``projects``."""
    import yaml  # optional: only this source needs it

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    names = ("name", "description", "purpose", "language")
    rows = [(k, *(None if v.get(n) is None else str(v.get(n)) for n in names)) for k, v in (data.get("projects") or {}).items()]
    return spark.createDataFrame(rows, "key string, name string, description string, purpose string, language string"), {n: data.get("default", {}).get(n) for n in names}
