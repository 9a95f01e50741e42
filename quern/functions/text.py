"""Text expressions: plain Column functions, evaluated in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a token, as a keyword, as an identifier.
TOKEN = r"[A-Za-z_][A-Za-z0-9_./#-]{1,}|[가-힣]{2,}|\p{Nd}+"
FIXTURE_TOKEN = r"[A-Za-z_][A-Za-z0-9_./#+-]{1,}|[가-힣]{2,}|\p{Nd}+"
KEYWORD = r"[A-Za-z_][A-Za-z0-9_./#-]{2,}"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{3,}"
#: Spellings that mean "no value".
NULLISH = ("null", "none", "nil", "n/a", "na", "-", "")
#: Words that are no keywords of a review comment.
KEYWORD_STOPWORDS = (
    "the", "this", "that", "with", "from", "have", "should", "would", "could", "please",
    "there", "here", "what", "when", "which", "your", "you", "not", "and", "for", "but",
    "can", "add", "use", "using", "just", "need", "needs", "think", "maybe", "also",
)
#: Words that the judges leave out.
STOPWORDS = (
    "the", "and", "for", "with", "this", "that", "from", "into", "have", "has",
    "was", "were", "are", "not", "but", "you", "your", "our", "its",
    "그리고", "하지만", "그러나", "이번", "위해", "대한", "관련", "있습니다", "합니다", "때문",
)
#: Files whose changes say little.
LOW_VALUE_NAMES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock",
    "Pipfile.lock", "Gemfile.lock", "composer.lock", "Cargo.lock", "go.sum",
)
#: Their endings and folders.
LOW_VALUE_SUFFIXES = (".min.js", ".min.css", ".map")
LOW_VALUE_MARKERS = ("/vendor/", "/node_modules/", "/dist/", "/build/", "/generated/")


#: White space of all of Unicode, as a class that Java and RE2 read alike.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters, one by one.
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A number as text.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end (trim() takes off spaces only)."""
    return F.trim(c, F.lit(WHITE))


def round4(c: Column) -> Column:
    """Four places, halves up, of the value at twelve places: sums of the same terms in another order round alike."""
    return F.round(c.cast("decimal(20,12)"), 4).cast("double")


def truthy(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else ""."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def nullish(c: Column) -> Column:
    """Null for null-like spellings, else the stripped text."""
    s = strip(c)
    return F.when(c.isNull() | F.lower(s).isin(*NULLISH), F.lit(None).cast("string")).otherwise(s)


def normalized(c: Column) -> Column:
    """White space runs as one space, stripped, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(c, f"{SPACE}+", " ")))


def tokens(c: Column, pattern: str = TOKEN) -> Column:
    """Lower-cased tokens, repeats included; null gives none."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({pattern})"), F.lit(1)), F.lower)


def content_tokens(c: Column) -> Column:
    return F.filter(tokens(c), lambda t: ~t.isin(*STOPWORDS))


def coverage(needles: Column, haystack: Column) -> Column:
    """Share of needles (stripped, lower-cased, non-empty, repeats count) that the haystack holds; 0 without needles."""
    clean = F.filter(F.transform(needles, lambda n: F.lower(strip(n))), lambda n: n != "")
    low = F.lower(F.coalesce(haystack, F.lit("")))
    return F.coalesce(F.size(F.filter(clean, lambda n: F.contains(low, n))) / F.nullif(F.size(clean), F.lit(0)), F.lit(0.0))


def keyword_similarity(query: Column, keywords: Column) -> Column:
    """Share of keywords that occur in the query's joined tokens, to four places; 0 without keywords."""
    q = F.array_join(tokens(query, FIXTURE_TOKEN), " ")
    hit = F.size(F.filter(keywords, lambda k: F.contains(q, F.lower(k))))
    return F.round(F.coalesce(hit / F.nullif(F.size(keywords), F.lit(0)), F.lit(0.0)), 4)


def keywords(c: Column, limit: int = 8) -> Column:
    """The first distinct keywords (compared without case, written as first seen)."""
    found = F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({KEYWORD})"), F.lit(1)), lambda t: ~F.lower(t).isin(*KEYWORD_STOPWORDS))
    add = lambda acc, t: F.when((F.size(acc) < limit) & ~F.exists(acc, lambda k: F.lower(k) == F.lower(t)), F.array_append(acc, t)).otherwise(acc)
    return F.aggregate(found, F.array().cast("array<string>"), add)


def added_identifiers(patch: Column, limit: int = 40) -> Column:
    """The first distinct identifiers on added lines of a patch."""
    lines = F.filter(F.split(F.coalesce(patch, F.lit("")), "\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.slice(F.array_distinct(F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(f"({IDENTIFIER})"), F.lit(1))), 1, limit)


def exact_match(answer: Column, reference: Column) -> Column:
    ref = normalized(F.coalesce(reference, F.lit("")))
    return F.when((ref != "") & (normalized(F.coalesce(answer, F.lit(""))) == ref), 1.0).otherwise(0.0)


def low_value_file(path: Column, change_type: Column, patch: Column) -> Column:
    name, low = F.element_at(F.split(path, "/"), -1), F.lower(path)
    any_of = lambda tests: reduce(or_, tests)
    return F.coalesce(
        name.isin(*LOW_VALUE_NAMES)
        | any_of([low.endswith(s) for s in LOW_VALUE_SUFFIXES])
        | any_of([F.contains(F.concat(F.lit("/"), low), F.lit(m)) for m in LOW_VALUE_MARKERS])
        | ((F.upper(change_type) == "RENAMED") & ~F.contains(F.coalesce(patch, F.lit("")), F.lit("@@"))),
        F.lit(False),
    )


def _number(c: Column) -> Column:
    """A text's value as a double; null where it is no number."""
    return F.when(strip(c).rlike(NUMBER), strip(c).try_cast("double"))


def nullable_int(c: Column) -> Column:
    """A number's whole part, or null where the text is no number (or beyond 64 bits)."""
    return _number(c).try_cast("bigint")


def positive_int(c: Column) -> Column:
    """nullable_int, null unless above 0."""
    n = nullable_int(c)
    return F.when(n > 0, n)


def risk_score(c: Column) -> Column:
    """A whole number held to 0..100, however large; nothing counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(_number(c), F.lit(0.0)))).cast("int")


def without_nul(c: Column) -> Column:
    """NUL characters taken out; null stays null."""
    return F.replace(c, F.lit("\0"), F.lit(""))


def failure_text(code: Column, message: Column, limit: int = 300) -> Column:
    """[CODE] and the message's first line, cut."""
    return F.left(F.concat(F.lit("["), code, F.lit("] "), F.coalesce(F.split(message, "\n")[0], F.lit(""))), F.lit(limit))
