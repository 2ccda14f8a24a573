"""Scalar normalisation as Column functions. All of them are null-safe and stay inside code generation where Spark allows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Unicode-aware white space stripping removes at either end.
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"

# Spellings of labels and splits, severities and their ranks and weights.
TRUE_WORDS = ("1", "true", "vulnerable", "vul", "yes", "bad")
FALSE_WORDS = ("0", "false", "benign", "safe", "no", "good", "")
SPLITS = ("train", "valid", "test", "unknown")
SPLIT_ALIASES = {"training": "train", "validation": "valid", "val": "valid", "dev": "valid", "testing": "test", "eval": "test"}
SEVERITY_RANKS = {"error": 3, "high": 3, "critical": 3, "warning": 2, "medium": 2, "note": 1, "low": 1, "recommendation": 1, "info": 1}
SEVERITY_WEIGHTS = {"high": 1.0, "error": 1.0, "critical": 1.0, "medium": 0.7, "warning": 0.7, "moderate": 0.7, "low": 0.4, "note": 0.4, "recommendation": 0.4}
UNKNOWN_WEIGHT = 0.3
UNKNOWN_CWES = ("", "unknown", "cwe-unknown")


def strip(c: Column) -> Column:
    """Strip white space of any kind, not only spaces."""
    return F.regexp_replace(c, rf"^{_BLANK}+|{_BLANK}+$", "")


def lookup(c: Column, values: dict, default: object) -> Column:
    """A literal table as a CASE; null gets the default."""
    out = None
    for v in dict.fromkeys(values.values()):
        test = c.isin(*[k for k, w in values.items() if w == v])
        out = F.when(test, F.lit(v)) if out is None else out.when(test, F.lit(v))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of SHA-1 over the parts joined by NUL; null parts count as empty."""
    joined = F.concat_ws("\x00", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.substring(F.sha1(joined), 1, 16)


def coerce_label(c: Column) -> Column:
    """0 or 1 from text: known words, else a number that is not 0 once its fraction is cut; anything else is 0."""
    t = F.lower(strip(c.cast("string")))
    number = t.try_cast("double")
    near = number.isNotNull() & ~F.isnan(number) & (F.abs(number) >= 1.0)
    return F.when(t.isin(*TRUE_WORDS), 1).when(t.isin(*FALSE_WORDS), 0).when(near, 1).otherwise(0)


def coerce_number_label(c: Column) -> Column:
    """0 or 1 from a number, whose fraction is cut."""
    return F.when(F.abs(c) >= 1, 1).otherwise(0)


def coerce_cwe(c: Column) -> Column:
    """Array of weakness ids from comma or semicolon separated text; null and blank give none."""
    parts = F.transform(F.split(strip(c), "[,;]"), strip)
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.filter(parts, lambda x: x != ""))


def coerce_cwe_list(c: Column) -> Column:
    """The same from an array: elements stripped, blanks dropped."""
    return F.coalesce(F.filter(F.transform(c, strip), lambda x: x != ""), F.array().cast("array<string>"))


def split_name(c: Column) -> Column:
    """A known split, by its aliases, or `unknown`."""
    t = F.lower(strip(c.cast("string")))
    t = F.coalesce(lookup(t, SPLIT_ALIASES, None), t)
    return F.when(t.isin(*SPLITS), t).otherwise("unknown")


def count_lines(code: Column) -> Column:
    """Lines of a body, at least 1."""
    c = F.coalesce(code, F.lit(""))
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def span(file: Column, code: Column) -> Column:
    """The default span: the whole body."""
    return F.struct(file.alias("file"), F.lit(1).alias("start_line"), count_lines(code).cast("int").alias("end_line"))


def first_present(*cols: Column) -> Column:
    """The first that is neither null nor empty; 0 and false count as present."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols])


def severity_rank(c: Column) -> Column:
    return lookup(F.lower(strip(c)), SEVERITY_RANKS, 0)


def severity_weight(c: Column) -> Column:
    return lookup(F.lower(strip(c)), SEVERITY_WEIGHTS, UNKNOWN_WEIGHT)


def coerce_line(c: Column) -> Column:
    """A line number of 1 or more, from a number or its text; else null."""
    n = c.cast("string").try_cast("double").try_cast("int")
    return F.when(n >= 1, n)


def tidy_path(c: Column) -> Column:
    """A path with slashes for backslashes and none at its beginning."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^/+", "")


def paths_match(a: Column, b: Column) -> Column:
    """Equal, or one is a suffix of the other at a slash; backslashes count as slashes and null matches nothing."""
    x, y = tidy_path(a), tidy_path(b)
    return F.coalesce((a == b) | (x == y) | F.endswith(x, F.concat(F.lit("/"), y)) | F.endswith(y, F.concat(F.lit("/"), x)), F.lit(False))


def basename(c: Column) -> Column:
    return F.regexp_extract(F.replace(c, F.lit("\\"), F.lit("/")), r"(?s)([^/]*)$", 1)


def unknown_cwe(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c)).isin(*UNKNOWN_CWES)


def clamp(c: Column) -> Column:
    """Into [0, 1]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def safe_div(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0 or null."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def number_or_zero(c: Column) -> Column:
    """A number, or its text; anything else is 0."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


def percent(c: Column) -> Column:
    """For display: a percentage with two decimals, n/a for null."""
    return F.when(c.isNull(), "n/a").otherwise(F.format_string("%.2f%%", c * 100))


def redact_key(c: Column, key: str) -> Column:
    """Text without the key, for logs."""
    return F.replace(c, F.lit(key), F.lit("***")) if key else c
