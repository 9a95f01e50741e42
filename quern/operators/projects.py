"""Project registry lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("name", "description", "purpose", "language")


def project_info(requests: DataFrame, registry: DataFrame, default: dict[str, str]) -> DataFrame:
    """requests (repo_name, ...) with the project's fields: by full name, else by the part after the slash, else defaults.

    registry (key, name, description, purpose, language) is small and read from one file, so its size is bounded.
    """
    short = F.element_at(F.split("repo_name", "/"), -1)
    reg = F.broadcast(registry)
    one = reg.select(F.col("key").alias("repo_name"), *(F.col(c).alias(f"_f_{c}") for c in FIELDS), F.lit(True).alias("_full"))
    two = reg.select(F.col("key").alias("_short"), *(F.col(c).alias(f"_s_{c}") for c in FIELDS))
    got = requests.withColumn("_short", short).join(one, "repo_name", "left").join(two, "_short", "left")
    pick = lambda c: F.coalesce(F.when(F.col("_full"), F.col(f"_f_{c}")).otherwise(F.col(f"_s_{c}")), F.lit(default.get(c)))
    return got.select(*requests.columns, *(pick(c).alias(c) for c in FIELDS))
