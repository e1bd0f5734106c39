"""Scalar expressions of the health metrics, as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp01(x) -> Column:
    """x within 0 and 1; null stays null, which greatest and least by themselves would pass over."""
    v = col(x).cast("double")
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def round12(x) -> Column:
    return F.round(col(x), 12)


def micros(at) -> Column:
    """Microseconds of a time with or without zone; the session's zone is UTC."""
    return F.unix_micros(col(at).cast("timestamp"))


def age_days(at, anchor) -> Column:
    return (micros(anchor) - micros(at)) / F.lit(86_400e6)


def half_life(age, days) -> Column:
    """0.5 ^ (age / half life); the half life is at least a day."""
    return F.pow(F.lit(0.5), col(age) / F.greatest(F.lit(1.0), col(days).cast("double")))


def e_fold(base, age, days) -> Column:
    """Confidence that loses a factor e over `days`."""
    return col(base) * F.exp(-col(age) / col(days))


def soft_gate(v, least: float, slack: float) -> Column:
    """0 below the gate, 1 above it, a smooth step within `slack` of it."""
    x = col(v)
    if least <= 0:
        return F.when(x > 0, 1.0).otherwise(0.0)
    if slack <= 0:
        return F.when(x >= least, 1.0).otherwise(0.0)
    low = max(0.0, least * (1 - slack))
    high = max(low + 2.220446049250313e-16, least * (1 + slack))
    t = clamp01((x - low) / (high - low))
    return t * t * (3 - 2 * t)


def magnitude(v, least: float, slack: float) -> Column:
    low = max(0.0, least * (1 - slack))
    return clamp01((col(v) - low) / (max(low + 1, 8 * least) - low))


def above_floor(x, floor: float) -> Column:
    return clamp01((col(x) - floor) / (1 - floor)) if floor < 1 else F.lit(0.0)


def blend_weight(files, few: int = 6, many: int = 12) -> Column:
    """1 up to `few` files, 0 from `many`, linear between."""
    return clamp01((many - col(files)) / (many - few))


def violation_share(violations, total) -> Column:
    return F.when(col(total) <= 0, 1.0).otherwise(clamp01(1 - col(violations) / col(total)))


def saturating(x) -> Column:
    return 1 / (1 + col(x).cast("double"))


def spaced_hash(text) -> Column:
    """Key of a diagnostic: sha256 of its trimmed text with white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(col(text), "\\s+", " ")), 256)


def source_hash(text) -> Column:
    """Key of a body of source: the first 16 hex digits of sha256 without ASCII white space."""
    return F.substring(F.sha2(F.regexp_replace(col(text), "[\\t\\n\\x0B\\f\\r ]", ""), 256), 1, 16)


def token_count(text) -> Column:
    return F.size(F.regexp_extract_all(col(text), F.lit("[^\\t\\n\\x0B\\f\\r ]+"), F.lit(0)))


def non_blank_lines(text) -> Column:
    return F.size(F.filter(F.split(col(text), "\n"), lambda x: F.length(F.trim(x)) > 0))


def iso_week_key(at) -> Column:
    """Calendar year of the week's Monday and its ISO number; both ends of 2024 are 2024-W01, which is kept."""
    monday = F.date_trunc("week", col(at))
    return F.concat(F.year(monday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(monday).cast("string"), 2, "0"))


def week_end(at) -> Column:
    return F.timestamp_millis(F.unix_millis(F.date_trunc("week", col(at))) + 7 * 86_400_000 - 1)


def glob_regex(glob: str) -> str:
    """** crosses folders, * doesn't, a dot is itself; the whole path must match."""
    return "^" + re.sub(r"\*\*|\*|\.", lambda m: {"**": ".*", "*": "[^/]*", ".": "\\."}[m[0]], glob) + "$"


def glob_match(path, globs: list[str]) -> Column:
    return col(path).rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def entropy(text) -> Column:
    """Shannon entropy of a text's characters in bits."""
    chars = F.regexp_extract_all(col(text), F.lit("(?s)."), F.lit(0))
    n = F.size(chars)
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def sorted_json(mapping) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(mapping)))))


#: Naming conventions and their patterns, in the order in which they are tried.
CASINGS = {
    "camelCase": "^[a-z][a-zA-Z0-9]*$",
    "UPPER_SNAKE_CASE": "^[A-Z][A-Z0-9_]*$",
    "PascalCase": "^[A-Z][a-zA-Z0-9]*$",
    "snake_case": "^[a-z][a-z0-9_]*$",
    "kebab-case": "^[a-z][a-z0-9-]*$",
}


def casing(name) -> Column:
    """Naming convention of an identifier."""
    return F.coalesce(*(F.when(col(name).rlike(p), F.lit(k)) for k, p in CASINGS.items()), F.lit("unrecognized"))


def matches_casing(name, convention: Column) -> Column:
    """Whether a name keeps a convention; null for an unknown one."""
    return F.coalesce(*(F.when(convention == k, col(name).rlike(p)) for k, p in CASINGS.items()))
