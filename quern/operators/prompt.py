"""Prompt assembly: diffs of files, context sections, query variants."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as tx
from .normalize import BASIS

TRUNCATED = "\n... (patch truncated)"
#: What a prompt says where something is missing, and the layout of a context item.
EMPTY_CONTEXT = "관련 기존 컨텍스트 없음"
NOTHING_KNOWN, NO_ITEMS, NO_DIFF = "(정보 없음)", "  - (없음)", "(diff 없음)"
CONTEXT_ITEM = "[%s] (출처: %s, similarity: %.4f)\n"
#: The parts of a user prompt, in order; a template of one's own may name them as well.
USER_TEMPLATE = (
    "<project>\nname: {project_name}\ndescription: {project_description}\npurpose: {project_purpose}\nfeatures: {project_features}\nroles: {project_roles}\nlanguage: {language}\n</project>\n"
    "<pull_request>\ntitle: {title}\nbody: {body}\nfiles:\n{files}\ndiff:\n{diff}\ncommits:\n{commits}\nissues:\n{issues}\n</pull_request>\n"
    "<context>\n{context}\n</context>\n<output>\n{schema}\n</output>"
)
SYSTEM_TEMPLATE = "Describe the change only from its diff and the numbered context. What neither shows is \"{unknown}\". An impact rests on \"{confirmed}\" or \"{expected}\". Write in {language}."


class PromptTooLarge(ValueError):
    def __init__(self, tokens: int, limit: int):
        super().__init__(f"{tokens} tokens, the limit is {limit}")
        self.tokens, self.limit = tokens, limit


def assemble_diff(files: DataFrame, key: str = "pr_id", order: str = "ord", most: int = DEFAULTS.max_patch_chars) -> DataFrame:
    """One diff text a key from rows (key, ord, path, change_type, patch): blank patches skipped, low-value files counted, long ones cut."""
    low = tx.low_value_file(F.col("path"), F.col("change_type"), F.col("patch"))
    there = files.where(tx.strip(F.coalesce("patch", F.lit(""))) != "")
    block = F.concat(F.lit("### "), F.col("path"), F.lit(" ("), F.col("change_type"), F.lit(")\n"), F.when(F.length("patch") > most, F.concat(F.left("patch", F.lit(most)), F.lit(TRUNCATED))).otherwise(F.col("patch")))
    got = there.groupBy(key).agg(F.array_sort(F.collect_list(F.when(~low, F.struct(F.col(order).alias("o"), block.alias("b"))))).alias("blocks"), F.count_if(low).alias("omitted"), F.count_if(~low).alias("included"))
    body = F.array_join(F.transform("blocks", lambda x: x["b"]), "\n\n")
    note = F.when(F.col("omitted") > 0, F.concat(F.lit("\n\n... (truncated, "), F.col("omitted").cast("string"), F.lit(" files omitted: lockfile/generated/vendored/rename-only changes)"))).otherwise("")
    return got.select(key, F.concat(body, note).alias("diff_content"), "included", "omitted")


def context_section(kept: DataFrame, most: int = DEFAULTS.context_chars) -> DataFrame:
    """One text a query from its kept hits in rank order: query_id, rank, chunk_id, score and text, and if there are such columns id, source, file_path, source_code and review_comment to fall back on."""
    either = lambda *names: tx.truthy(*(F.col(c) for c in names if c in kept.columns))
    known = lambda *names: F.coalesce(F.nullif(either(*names), F.lit("")), F.lit("unknown"))
    head = F.format_string(CONTEXT_ITEM, known("chunk_id", "id"), known("source", "file_path"), F.coalesce("score", F.lit(0.0)))
    block = F.concat(head, F.left(either("text", "source_code", "review_comment"), F.lit(most)))
    got = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return got.select("query_id", F.coalesce(F.nullif(F.array_join(F.transform("x", lambda s: s["b"]), "\n\n"), F.lit("")), F.lit(EMPTY_CONTEXT)).alias("context"))


def bullet_list(items: Column, fallback: str = NO_ITEMS) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), x)), "\n")).otherwise(fallback)


def or_placeholder(c: Column, placeholder: str = NOTHING_KNOWN) -> Column:
    """The stripped text, or what stands for a missing one."""
    return F.coalesce(F.nullif(tx.strip(c), F.lit("")), F.lit(placeholder))


def filled(template: str, parts: dict[str, Column]) -> Column:
    """A template with its {names} replaced, in one pass, so that braces in a part stay as they are."""
    pieces, rest = [], template
    while (at := rest.find("{")) >= 0:
        end = rest.index("}", at)
        pieces += [F.lit(rest[:at]), parts[rest[at + 1 : end]]]
        rest = rest[end + 1 :]
    return F.concat(*pieces, F.lit(rest))


def system_prompt(language: Column, template: str = SYSTEM_TEMPLATE) -> Column:
    """The system prompt; English for "en" in any case, else Korean."""
    name = F.when(F.lower(language) == "en", "English").otherwise("한국어")
    return filled(template, {"unknown": F.lit("확인 필요"), "confirmed": F.lit(BASIS[0]), "expected": F.lit(BASIS[1]), "language": name})


def user_prompt(schema: str = "", template: str = USER_TEMPLATE, context: str = "context") -> Column:
    """The user prompt from columns project_*, title, body, files, diff, commits, issues, language and the context section."""
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(NOTHING_KNOWN)
    parts = {c: or_placeholder(F.col(c)) for c in ("project_name", "project_description", "project_purpose", "title", "body")}
    parts |= {c: joined(F.col(c)) for c in ("project_features", "project_roles")} | {c: bullet_list(F.col(c)) for c in ("files", "commits", "issues")}
    parts |= {"language": or_placeholder(F.col("language"), "ko"), "diff": or_placeholder(F.col("diff"), NO_DIFF), "context": F.coalesce(F.col(context), F.lit(EMPTY_CONTEXT)), "schema": F.lit(schema)}
    return filled(template, parts)


def query_text(title: Column, diff: Column, most: int = DEFAULTS.query_diff_chars) -> Column:
    return F.concat(F.lit("PR Title/Summary: "), F.coalesce(title, F.lit("")), F.lit("\nPR Diff:\n"), F.left(F.coalesce(diff, F.lit("")), F.lit(most)))


#: Fixed value: characters of a capped query.
CAP_CHARS = 20_000


def query_variant(variant: Column, title: Column, diff: Column, paths: Column, identifiers: Column, cap: int = CAP_CHARS) -> Column:
    """prod: title and whole diff; prod_capped: with the paths before the diff, which is cut so that the whole has cap characters;
    files+diff: title, paths and added identifiers, a line each, and any other variant title and paths; blank lines are left out."""
    listed = F.array_join(paths, " ")
    whole = F.concat(F.lit("PR Title/Summary: "), title, F.lit("\nPR Diff:\n"), diff)
    head = F.concat(F.lit("PR Title/Summary: "), title, F.lit("\nChanged files: "), listed, F.lit("\nPR Diff:\n"))
    lines = F.array(title, listed, F.when(variant == "files+diff", F.array_join(identifiers, " ")).otherwise(""))
    short = F.array_join(F.filter(lines, lambda x: tx.strip(x) != ""), "\n")
    return F.when(variant == "prod", whole).when(variant == "prod_capped", F.concat(head, F.left(diff, F.greatest(F.lit(0), F.lit(cap) - F.length(head))))).otherwise(short)


def translated_query(translated: Column, title: Column, description: Column) -> Column:
    """The injected translation, or title and description where it is null or blank."""
    plain = tx.strip(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    return F.coalesce(F.nullif(tx.strip(translated), F.lit("")), plain)


#: Fixed value: what ends a diff that was cut.
CUT_MARKER = "\n\n... (diff truncated to fit token budget)"


def fit_diff(limit: int, count: Callable[[str], int] | None = None, cut: Callable[[str, int], str] | None = None):
    """A pandas UDF of (overhead, diff): the diff, trimmed so that it, its marker and the row's other tokens stay within limit.

    Gives struct<diff, error>: where the rest of the prompt and the marker leave no room, or what was trimmed is still
    too long, the row is refused with an error, the others stay. Without a tokenizer tokens are white-space words.
    """
    count, cut = count or (lambda t: len(t.split())), cut or (lambda t, n: " ".join(t.split()[:n]))
    ending = count(CUT_MARKER)

    def fit(overhead: int, diff: str) -> tuple[str | None, str | None]:
        n = count(diff)
        if overhead + n <= limit:
            return diff, None
        room = limit - overhead - ending
        made = cut(diff, room) + CUT_MARKER if room > 0 else None
        if made is None or overhead + count(made) > limit:
            return None, str(PromptTooLarge(overhead + n, limit))
        return made, None

    @F.pandas_udf("diff string, error string")
    def fitted(overhead: pd.Series, diff: pd.Series) -> pd.DataFrame:
        rows = [fit(int(o), d) for o, d in zip(overhead, diff.fillna(""), strict=True)]
        return pd.DataFrame(rows, columns=["diff", "error"], dtype=object)

    return fitted
