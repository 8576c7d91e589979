"""Scalar text functions as column expressions; all run inside Spark's own expressions.

Classes of characters are spelled out where Python, Spark and DuckDB differ: letters and digits are ASCII unless a
function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a diagram id must not be.
RESERVED_IDS = ("end", "graph", "subgraph", "click", "style", "class", "classdef", "default", "linkstyle", "direction", "call", "href")
#: Source suffixes, in the order in which the first match is cut.
SOURCE_SUFFIXES = ("py", "tsx", "ts", "jsx", "js", "cs", "java")

#: Folders that hold independent units side by side.
GENERIC_ROOTS = ("src", "source", "sources", "app", "apps", "lib", "libs", "pkg", "pkgs", "packages", "services", "service", "cmd", "internal", "projects", "repos")


def slug_ascii(x: Column, default: str = "node") -> Column:
    """Lower case; each run of other characters than a-z and 0-9 becomes one underscore; none at the ends."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(default))


def slug_word(x: Column, default: str = "node") -> Column:
    """Lower case; each character that is no Unicode word character becomes an underscore; none at the ends."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_]", "_"), "^_+|_+$", ""), F.lit("")), F.lit(default))


def safe_id(x: Column) -> Column:
    """slug_word, with an underscore after reserved words."""
    s = slug_word(x)
    return F.when(s.isin(*RESERVED_IDS), F.concat(s, F.lit("_"))).otherwise(s)


def safe_label(x: Column) -> Column:
    """One line without double quotes and semicolons."""
    return F.trim(F.translate(x, '\n";', " ',"))


def compact(x: Column) -> Column:
    """Lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def normal(x: Column) -> Column:
    return F.lower(F.trim(x))


def external_id(x: Column, default: str = "ext") -> Column:
    """Runs of characters other than ASCII word characters become one underscore; none at the ends; lower case."""
    return F.lower(F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(default)))


def identifiers(x: Column) -> Column:
    """All identifiers in order, repeats included."""
    return F.regexp_extract_all(x, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1)


def last_segment(x: Column) -> Column:
    """The last identifier; null if there is none."""
    return F.try_element_at(identifiers(x), F.lit(-1))


def module_id(path: Column) -> Column:
    """A source path without its suffix."""
    return F.regexp_replace(path, rf"\.({'|'.join(SOURCE_SUFFIXES)})$", "")


def normalise_path(path: Column) -> Column:
    """Fold '.', '..' and empty segments; '..' at the top is dropped."""
    step = lambda acc, s: F.when((s == ".") | (s == ""), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def join_route(prefix: Column, path: Column) -> Column:
    """A slash and the non-empty parts of both, without slashes at their ends."""
    parts = F.array(*[F.regexp_replace(F.coalesce(x, F.lit("")), "^/+|/+$", "") for x in (prefix, path)])
    return F.concat(F.lit("/"), F.array_join(F.filter(parts, lambda x: x != ""), "/"))


def estimate_tokens(x: Column) -> Column:
    return F.floor(F.length(x) / 3) + 4000


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def round_even(x: Column) -> Column:
    """Round half to even, as an integer."""
    return F.bround(x, 0).cast("int")


def window_score(n: Column, low: float, high: float, floor: float = 0.0) -> Column:
    """1 inside [low, high], falling in proportion outside, never below floor."""
    return F.greatest(F.lit(floor), F.when(n < low, n / low).when(n > high, 1 - (n - high) / high).otherwise(F.lit(1.0)))


def grade(score: Column) -> Column:
    return F.when(score >= 85, "High").when(score >= 70, "Moderate").otherwise("Low")


def ratio(a: Column, b: Column, default: float) -> Column:
    """a / b, or default where b is zero."""
    return F.when(b == 0, F.lit(default)).otherwise(a / b)


def path_domain(path: Column) -> Column:
    """The topmost folder above a unit's own that is no generic root; null for units at the top or directly below generic roots."""
    parts = F.filter(F.split(F.coalesce(F.regexp_replace(path, r"\\", "/"), F.lit("")), "/"), lambda s: (s != "") & (s != "."))
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    skip = F.aggregate(above, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, s: F.struct((a["n"] + (a["on"] & F.lower(s).isin(*GENERIC_ROOTS)).cast("int")).alias("n"), (a["on"] & F.lower(s).isin(*GENERIC_ROOTS)).alias("on")), lambda a: a["n"])
    return F.get(above, skip)


def repository_name(url: Column) -> Column:
    """Last segment of a URL or path, without .git."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/:]+)$", 1), r"\.git$", "")


def is_git_url(x: Column) -> Column:
    return x.rlike(r"^(https?://|git@|ssh://)")


def leading_name(x: Column) -> Column:
    """Lower case without underscores at the start."""
    return F.lower(F.ltrim(x, F.lit("_")))


def with_token(url: Column, token: Column) -> Column:
    """A token put into an https URL; other URLs as they are."""
    return F.when(F.startswith(url, F.lit("https://")) & (F.coalesce(token, F.lit("")) != ""), F.concat(F.lit("https://"), token, F.lit("@"), F.substring(url, 9, 10_000))).otherwise(url)


def backoff(base: Column, attempt: Column) -> Column:
    """Seconds to wait before the next attempt, doubled with each."""
    return base * F.pow(F.lit(2.0), attempt - 1)


def image_name(x: Column) -> Column:
    """The last path part of an image reference, before the first colon."""
    return F.element_at(F.split(F.regexp_extract(x, "^([^:]*)", 1), "/"), -1)


def json_slice(x: Column) -> Column:
    """From the first opening to the last closing bracket of a text, code fences stripped; the text if there are none."""
    bare = F.regexp_replace(x, r"(?m)^```[a-zA-Z]*\s*$", "")
    found = F.regexp_extract(bare, r"(?s)([\{\[].*[\}\]])", 1)
    return F.when(found == "", F.trim(bare)).otherwise(found)


def retry_delay(x: Column) -> Column:
    """Seconds named by a rate-limit message; null if it names none."""
    a = F.regexp_extract(x, r"(?i)retry(?:[ _-]?delay|[ _-]?after)?[^0-9]{0,12}([0-9]+(?:\.[0-9]+)?)", 1)
    return F.nullif(a, F.lit("")).cast("double")


def brace_depths(x: Column) -> Column:
    """(least running depth, final depth) of curly braces."""
    marks = F.regexp_extract_all(x, F.lit(r"([{}])"), 1)
    folded = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda acc, c: F.struct((acc["depth"] + F.when(c == "{", 1).otherwise(-1)).alias("depth"), F.least(acc["least"], acc["depth"] + F.when(c == "{", 1).otherwise(-1)).alias("least")),
    )
    return folded
