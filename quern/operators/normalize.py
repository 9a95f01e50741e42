"""Structured model output: parsing, roles, tasks, evidence."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

FRONT, BACK, AI, PLAN, DESIGN, QA, MANAGER = "프론트엔드", "백엔드", "AI", "기획", "디자인", "QA", "프로젝트 관리자"
#: Endings taken off a role's key.
ROLE_SUFFIXES = ("개발자", "개발", "담당자", "담당", "엔지니어", "파트", "팀원", "팀", "engineer", "developer", "dev", "team", "part")
#: Role keys and the role each means.
ROLE_ALIASES = {
    FRONT: ("프론트엔드", "프런트엔드", "프론트앤드", "프론트", "프런트", "frontend", "front", "fe", "client", "클라이언트", "react", "리액트", "nextjs", "next"),
    BACK: ("백엔드", "벡엔드", "백앤드", "백", "backend", "back", "be", "server", "서버", "api", "spring", "스프링", "springboot", "django", "node", "nodejs"),
    AI: ("ai", "인공지능", "aiml", "ml", "머신러닝", "machinelearning", "딥러닝", "deeplearning", "llm", "rag", "mlops", "데이터사이언스"),
    PLAN: ("기획", "기획자", "서비스기획", "planner", "planning", "plan", "po", "productowner", "productmanager", "프로덕트오너", "프로덕트매니저"),
    DESIGN: ("디자인", "디자이너", "design", "designer", "ux", "uiux", "uxui", "uxdesigner"),
    QA: ("qa", "qc", "테스터", "tester", "테스트", "test", "품질", "quality"),
    MANAGER: ("프로젝트관리자", "프로젝트매니저", "프로젝트리더", "projectmanager", "projectlead", "스크럼마스터", "scrummaster", "pl"),
}
#: Keys that stand for no single role.
AMBIGUOUS_ROLES = ("pm", "manager", "매니저", "ui", "유아이", "웹", "web", "풀스택", "fullstack", "개발", "리더", "leader", "팀장")
#: What is taken out of role names, what an impact may rest on, and where evidence comes from.
SEPARATORS = r"[\s_\-/·.,()\[\]]+"
BASIS = ("확인된 사실", "변경 기반 예상")
FROM_DIFF, FROM_CONTEXT = "pr_diff", "context"

RECORD = (
    "summary string, purpose string, changeReason string, before string, after string, relatedFeatures array<string>, affectedRoles array<string>, "
    "needsConfirmation array<string>, roleImpacts array<struct<role:string,impact:string,basis:string,evidenceRefs:array<string>>>, "
    "followUpTasks array<struct<role:string,task:string,evidenceRefs:array<string>>>, evidence array<struct<id:string,source:string,location:string,description:string>>, "
    "riskScore string, reviews array<struct<filePath:string,lineNumber:string,comment:string>>"
)


def parse_record(raw: Column) -> Column:
    """The record as a struct; null where the text is no JSON object."""
    ok = raw.isNotNull() & F.try_parse_json(raw).isNotNull() & raw.rlike(r"^\s*\{")
    return F.when(ok, F.from_json(raw, RECORD))


#: An ending that leaves something before it. None is the end of another, so at most one of them matches.
ROLE_ENDING = rf"(?s)(?<=.)(?:{'|'.join(ROLE_SUFFIXES)})\z"
#: The role of each key; those that stand for no single role have none.
ROLE_OF_KEY = {name: role for role, names in ROLE_ALIASES.items() for name in names if name not in AMBIGUOUS_ROLES}


def _key(text: Column) -> Column:
    """Each step takes the one before it once: the expression grows with its steps, not with their product."""
    return F.regexp_replace(F.regexp_replace(F.lower(tx.strip(F.coalesce(text, F.lit("")))), SEPARATORS, ""), ROLE_ENDING, "")


def _role(key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ROLE_OF_KEY.items() for x in pair]), key)


def _nfkc(s: pd.Series) -> pd.Series:
    return s.fillna("").map(lambda t: unicodedata.normalize("NFKC", t))


def _nfkc_all(s: pd.Series) -> pd.Series:
    return s.map(lambda ts: [unicodedata.normalize("NFKC", t or "") for t in ts] if ts is not None else [])


def nfkc(c: Column) -> Column:
    """Unicode normal form KC, for which there is no built-in function (it goes through Arrow); null gives ""."""
    return F.pandas_udf(_nfkc, "string")(c)


def nfkc_all(c: Column) -> Column:
    """nfkc of each text of an array; null gives an empty one."""
    return F.pandas_udf(_nfkc_all, "array<string>")(c)


def role_key(c: Column) -> Column:
    """NFKC, lower-cased, separators out, the first matching ending off if something is left."""
    return _key(nfkc(c))


def normalize_role(c: Column) -> Column:
    """The role a name stands for, or null."""
    return _role(role_key(c))


def roles_of(names: Column) -> Column:
    """normalize_role of each name of an array; null gives an empty one."""
    return F.transform(nfkc_all(names), lambda n: _role(_key(n)))


def role_of(text: str | None) -> str | None:
    """normalize_role for one value on the driver."""
    key = re.sub(SEPARATORS, "", unicodedata.normalize("NFKC", text or "").strip().lower())
    key = next((key[: -len(s)] for s in ROLE_SUFFIXES if key.endswith(s) and len(key) > len(s)), key)
    return None if not key or key in AMBIGUOUS_ROLES else next((r for r, names in ROLE_ALIASES.items() if key in names), None)


def resolved_roles(roles: Column) -> Column:
    """Distinct roles in first-seen order; unresolved names are left out."""
    return F.array_distinct(F.filter(roles_of(roles), lambda r: r.isNotNull()))


def unresolved_roles(roles: Column) -> Column:
    """Distinct names, stripped, that stand for no role."""
    pairs = F.zip_with(F.coalesce(roles, F.array().cast("array<string>")), roles_of(roles), lambda r, role: F.struct(tx.strip(r).alias("r"), role.alias("role")))
    return F.array_distinct(F.transform(F.filter(pairs, lambda p: (F.coalesce(p["r"], F.lit("")) != "") & p["role"].isNull()), lambda p: p["r"]))


def allowed_roles(roles: Column, team: Column) -> Column:
    """Resolved roles that the team has; all of them where the team is unknown."""
    known = resolved_roles(roles)
    return F.when(F.size(team) > 0, F.filter(known, lambda r: F.array_contains(team, r))).otherwise(known)


def string_list(items: Column) -> Column:
    """Blanks out; null gives none."""
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.coalesce(tx.strip(x), F.lit("")) != "")


def _refs(x: Column, names: set[str]) -> Column:
    """The references of an item under the first of their spellings that holds any."""
    given = [x[c] for c in ("evidenceRefs", "evidence_refs", "evidenceIds") if c in names]
    filled = [F.when(F.size(c) > 0, c) for c in given]
    return string_list(F.coalesce(*filled, F.array().cast("array<string>")))


def role_impacts(items: Column, team: Column | None = None, spellings: tuple[str, ...] = ("evidenceRefs",)) -> Column:
    """Impacts with a known role, one of the team's where it has any; a basis outside the set becomes null.

    spellings: under which of evidenceRefs, evidence_refs and evidenceIds the items name their references.
    """
    there = F.coalesce(items, F.array())
    roles = roles_of(F.transform(there, lambda x: x["role"]))
    made = F.zip_with(there, roles, lambda x, r: F.struct(r.alias("role"), F.coalesce(x["impact"], F.lit("")).alias("impact"), F.when(tx.nullish(x["basis"]).isin(*BASIS), tx.nullish(x["basis"])).alias("basis"), _refs(x, set(spellings)).alias("evidenceRefs")))
    return F.filter(made, lambda x: x["role"].isNotNull() & _of_team(x["role"], team))


def _of_team(role: Column, team: Column | None) -> Column:
    """Whether the team has a role; a team that names none has all."""
    return F.lit(True) if team is None else (F.coalesce(F.size(team), F.lit(0)) < 1) | F.coalesce(F.array_contains(team, role), F.lit(False))


REFS = "array<string>"


def follow_up_tasks(items: Column, team: Column | None = None) -> Column:
    """From an array of JSON texts, each a string or an object: blank tasks out, roles unknown or outside the team null, references kept."""
    there = F.coalesce(items, F.array().cast(REFS))
    roles = roles_of(F.transform(there, lambda v: F.get_json_object(v, "$.role")))
    task = lambda v: F.coalesce(F.get_json_object(v, "$.task"), F.when(~v.rlike(r"^\s*\{"), F.regexp_replace(v, r'^\s*"|"\s*$', "")))
    listed = lambda v, c: F.from_json(F.get_json_object(v, f"$.{c}"), REFS)
    lists = lambda v: F.filter(F.array(listed(v, "evidenceRefs"), listed(v, "evidence_refs")), lambda x: F.size(x) > 0)
    made = F.zip_with(there, roles, lambda v, r: F.struct(F.when(_of_team(r, team), r).alias("role"), tx.strip(task(v)).alias("task"), string_list(F.get(lists(v), 0)).alias("evidenceRefs")))
    return F.filter(made, lambda x: F.coalesce(x["task"], F.lit("")) != "")


def evidence_refs(cited: DataFrame, kept: DataFrame) -> DataFrame:
    """(query_id, place, ref_id, source, location, description, chunk_id, similarity_score): the model's citations, then kept hits that none cites.

    cited: query_id, pos (from 1), id, source, location, description; kept: query_id, rank (from 1), chunk_id, file_path,
    score. A citation without an id is e and its place; a kept hit is c and its place among all kept ones, moved on by
    their number as long as a citation has that id. Places of kept hits differ by less than that number, so they never
    meet each other. A query's citations and kept hits are few, and their ids are gathered a query.
    """
    mine = cited.select("query_id", "pos", tx.nullish(F.col("location")).alias("location"), tx.nullish(F.col("source")).alias("s"), F.coalesce(tx.nullish(F.col("id")), F.concat(F.lit("e"), F.col("pos").cast("string"))).alias("ref_id"), tx.nullish(F.col("description")).alias("description"))
    known = kept.select("query_id", F.col("chunk_id").alias("location"), "chunk_id", F.col("score").alias("similarity_score"))
    first = mine.join(known, ["query_id", "location"], "left").select(
        "query_id", F.col("pos").cast("long").alias("place"), "ref_id", F.coalesce("s", F.when(F.col("chunk_id").isNotNull(), FROM_CONTEXT).otherwise(FROM_DIFF)).alias("source"), "location", "description", "chunk_id", "similarity_score"
    )
    taken = first.groupBy("query_id").agg(F.collect_set("ref_id").alias("taken"), F.max("place").alias("cited"))
    numbered = kept.join(kept.groupBy("query_id").agg(F.count("*").alias("n")), "query_id").join(taken, "query_id", "left")
    used = F.coalesce("taken", F.array().cast("array<string>"))
    tries = F.transform(F.sequence(F.lit(0), F.size(used)), lambda m: F.concat(F.lit("c"), (F.col("rank") + m * F.col("n")).cast("string")))
    rest = numbered.withColumn("ref_id", F.filter(tries, lambda x: ~F.array_contains(used, x))[0]).join(first.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")
    second = rest.select(
        "query_id", (F.coalesce("cited", F.lit(0)) + F.col("rank")).cast("long").alias("place"), "ref_id", F.lit(FROM_CONTEXT).alias("source"), F.coalesce(F.nullif("file_path", F.lit("")), "chunk_id").alias("location"), F.lit(None).cast("string").alias("description"), "chunk_id", F.col("score").alias("similarity_score")
    )
    return first.unionByName(second)


def evidences(kept: DataFrame) -> DataFrame:
    """Kept hits (query_id, rank, id, chunk_id, source_code, pr_diff, review_comment, score, source_type, file_path) as evidence records: a missing id is the chunk's, a missing score 0."""
    return kept.select("query_id", "rank", F.coalesce("id", "chunk_id", F.lit("")).alias("id"), "source_code", "pr_diff", "review_comment", F.coalesce("score", F.lit(0.0)).alias("similarity_score"), "chunk_id", "source_type", "file_path")


def legacy_changes(refs: Column, changes: Column) -> Column:
    """What changed, as (file_path, description): the references that come from the diff, or else the draft's own list."""
    text = lambda c, other: F.coalesce(c, F.lit(other))
    mine = F.filter(F.coalesce(refs, F.array()), lambda e: (e["source"] == FROM_DIFF) & (e["location"].isNotNull() | e["description"].isNotNull()))
    one = F.transform(mine, lambda e: F.struct(text(e["location"], "unknown").alias("file_path"), text(e["description"], "").alias("description")))
    two = F.transform(F.coalesce(changes, F.array()), lambda c: F.struct(text(tx.nullish(c["filePath"]), "unknown").alias("file_path"), text(c["description"], "").alias("description")))
    return F.when(F.size(one) > 0, one).otherwise(two)


def legacy_lines(given: Column, items: Column, role: str, text: str) -> Column:
    """A plain list if the draft has one, else "role: text" of each item (the text alone without a role)."""
    clean = string_list(given)
    there = F.filter(F.coalesce(items, F.array()), lambda x: F.coalesce(x[text], F.lit("")) != "")
    made = F.transform(there, lambda x: F.when(F.coalesce(x[role], F.lit("")) != "", F.concat(x[role], F.lit(": "), x[text])).otherwise(x[text]))
    return F.when(F.size(clean) > 0, clean).otherwise(made)


def confirmation_items(items: Column, quality_warning: Column, needs: Column, warning_text: str, default_text: str) -> Column:
    """The model's list, the warning where quality is in doubt, a default where something is needed and nothing said."""
    base = F.concat(F.transform(string_list(items), tx.strip), F.when(quality_warning, F.array(F.lit(warning_text))).otherwise(F.array().cast("array<string>")))
    return F.when(needs & (F.size(base) == 0), F.array(F.lit(default_text))).otherwise(base)


def camel_case(df: DataFrame) -> DataFrame:
    """Column names in camel case, for sinks that want it."""
    return df.withColumnsRenamed({c: re.sub(r"_([a-z])", lambda m: m[1].upper(), c) for c in df.columns})
