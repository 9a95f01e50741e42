"""Model output of mixed types: parsed as VARIANT, so that one odd field never costs the others, with the paths at fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import normalize as nz

#: The fields of a record, by what they hold.
TEXTS = ("summary", "purpose", "changeReason", "before", "after")
TEXT_LISTS = ("relatedFeatures", "affectedRoles", "needsConfirmation")
ITEM_LISTS = ("roleImpacts", "followUpTasks", "evidence", "reviews")
FIELDS = (*TEXTS, *TEXT_LISTS, *ITEM_LISTS, "riskScore")


def kind(v: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID, ARRAY or OBJECT."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def text_of(v: Column) -> Column:
    """A scalar as text; null for what is no scalar."""
    return F.when(~kind(v).isin("ARRAY", "OBJECT", "VOID"), F.try_variant_get(v, "$", "string"))


def items_of(v: Column) -> Column:
    """The elements of an array, as variants; none for anything else."""
    none = F.array().cast("array<variant>")
    return F.coalesce(F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")), none)


def texts_of(v: Column) -> Column:
    """The elements of an array of scalars that are not blank; anything else gives none."""
    return F.filter(F.transform(items_of(v), text_of), lambda x: F.coalesce(tx.strip(x), F.lit("")) != "")


def _get(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "variant")


def _first_list(v: Column, *fields: str) -> Column:
    """The texts under the first of these fields that holds any."""
    lists = [texts_of(_get(v, f)) for f in fields]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<string>"))


def parse(df: DataFrame, raw: str = "raw", team: str | None = None) -> DataFrame:
    """df without raw, with a column for each field of the record, errors and parsed.

    followUpTasks takes plain texts and objects, references their spellings; roles are resolved and held to the team
    (a column of role names; none or no column: every known role). parsed is false where the text is no JSON object:
    all fields are then null or empty. errors names each path of a wrong type and each field that records do not
    have, the way a strict schema would refuse it; the rest is read all the same.
    """
    v = F.try_parse_json(raw)
    df = df.withColumn("_v", F.when(kind(v) == "OBJECT", v)).withColumn("parsed", F.col("_v").isNotNull())
    get = {f: _get(F.col("_v"), f) for f in FIELDS}
    df = df.withColumns({f"_{f}": get[f] for f in FIELDS})
    c = lambda f: F.col(f"_{f}")
    here = F.coalesce(F.col(team), F.array().cast("array<string>")) if team else None

    task = lambda x: F.struct(
        text_of(_get(x, "role")).alias("role"), tx.strip(F.coalesce(text_of(_get(x, "task")), F.when(kind(x) == "STRING", text_of(x)), F.lit(""))).alias("task"), _first_list(x, "evidenceRefs", "evidence_refs").alias("evidenceRefs")
    )
    impact = lambda x: F.struct(
        text_of(_get(x, "role")).alias("role"), F.coalesce(text_of(_get(x, "impact")), F.lit("")).alias("impact"), tx.nullish(text_of(_get(x, "basis"))).alias("basis"), _first_list(x, "evidenceRefs", "evidence_refs", "evidenceIds").alias("evidenceRefs")
    )
    evidence = lambda x: F.struct(*[tx.nullish(text_of(_get(x, f))).alias(f) for f in ("id", "source", "location", "description")])
    review = lambda x: F.struct(tx.nullish(text_of(_get(x, "filePath"))).alias("filePath"), tx.positive_int(text_of(_get(x, "lineNumber"))).alias("lineNumber"), tx.nullish(text_of(_get(x, "comment"))).alias("comment"))
    objects = lambda f: F.filter(items_of(c(f)), lambda x: kind(x) == "OBJECT")
    df = df.withColumns({"_tasks": F.filter(F.transform(items_of(c("followUpTasks")), task), lambda x: x["task"] != ""), "_impacts": F.transform(objects("roleImpacts"), impact)})
    # Normal form KC has no built-in function: one Arrow call for the names of all items.
    df = df.withColumns({"_task_roles": nz.roles_of(F.transform("_tasks", lambda x: x["role"])), "_impact_roles": nz.roles_of(F.transform("_impacts", lambda x: x["role"]))})
    mine = lambda r: F.when(nz._of_team(r, here), r)
    tasks = F.zip_with("_tasks", "_task_roles", lambda x, r: F.struct(mine(r).alias("role"), x["task"].alias("task"), x["evidenceRefs"].alias("evidenceRefs")))
    impacts = F.zip_with("_impacts", "_impact_roles", lambda x, r: F.struct(mine(r).alias("role"), x["impact"].alias("impact"), F.when(x["basis"].isin(*nz.BASIS), x["basis"]).alias("basis"), x["evidenceRefs"].alias("evidenceRefs")))

    fields = {f: tx.nullish(text_of(c(f))) for f in TEXTS} | {f: texts_of(c(f)) for f in TEXT_LISTS}
    fields |= {
        "roleImpacts": F.filter(impacts, lambda x: x["role"].isNotNull()), "followUpTasks": tasks, "evidence": F.transform(objects("evidence"), evidence), "reviews": F.transform(objects("reviews"), review),
        "riskScore": tx.risk_score(text_of(c("riskScore"))), "errors": _errors(raw, c),
    }
    kept = [n for n in df.columns if not n.startswith("_") and n not in (raw, "parsed")]
    out = df.select(*kept, "parsed", *[x.alias(n) for n, x in fields.items()])
    roles = nz.allowed_roles(F.col("affectedRoles"), here) if team else nz.resolved_roles(F.col("affectedRoles"))
    return out.withColumn("affectedRoles", roles)


def _errors(raw: str, c) -> Column:
    """Paths of a wrong type and fields that are not the record's."""
    wrong = lambda f, v, ok: F.when(~kind(v).isin(*ok, "VOID"), F.concat(F.lit(f"$.{f}: "), kind(v)))
    scalar = ("STRING", "BIGINT", "DECIMAL", "DOUBLE", "BOOLEAN")
    found = [wrong(f, c(f), scalar) for f in (*TEXTS, "riskScore")] + [wrong(f, c(f), ("ARRAY",)) for f in (*TEXT_LISTS, *ITEM_LISTS)]
    flat = F.filter(F.array(*found), lambda x: x.isNotNull())

    def inside(f: str, ok: tuple[str, ...]) -> Column:
        named = F.transform(items_of(c(f)), lambda x, i: F.when(~kind(x).isin(*ok), F.concat(F.lit(f"$.{f}["), i.cast("string"), F.lit("]: "), kind(x))))
        return F.filter(named, lambda x: x.isNotNull())

    deep = [inside(f, scalar) for f in TEXT_LISTS] + [inside(f, ("OBJECT", "STRING") if f == "followUpTasks" else ("OBJECT",)) for f in ITEM_LISTS]
    extra = F.transform(F.filter(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), lambda k: ~k.isin(*FIELDS)), lambda k: F.concat(F.lit("$."), k, F.lit(": unknown field")))
    return F.when(F.col("parsed"), F.concat(flat, *deep, extra)).otherwise(F.array(F.lit("$: no JSON object")))
