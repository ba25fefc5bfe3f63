"""Text functions as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions.columns import col

# The masking patterns of the secret filter, with their replacements, and texts
# one of which a value (in small letters) must hold for the pattern to match at all.
SECRET_PATTERNS = [
    (r"(?i)([a-zA-Z0-9_+.-]+://[^:]+:)([^@\s]+)(@)", "$1********$3", ["://"]),
    (r"""(?i)((?:password|pwd|secret|token|api[_-]?key|private[_-]?key|auth)\s*[:=]\s*["']?)([^"'\s,;}]+)(["']?)""",
     "$1********$3", ["password", "pwd", "secret", "token", "api", "private", "auth"]),
    (r"(?i)(Bearer\s+)[a-zA-Z0-9_\-\.]{15,}", "$1[REDACTED_BEARER_TOKEN]", ["bearer"]),
    (r"(?s)-----BEGIN [A-Z ]+PRIVATE KEY-----[^-]+-----END [A-Z ]+PRIVATE KEY-----",
     "[REDACTED_PRIVATE_KEY_BLOCK]", ["private key"]),
]


def title(c: Column) -> Column:
    """A capital after every non-letter, small letters elsewhere ("foo-bar" -> "Foo-Bar")."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.when(c.isNotNull(), F.array_join(F.transform(runs, F.initcap), ""))


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def zero_fill(c: Column, width: int) -> Column:
    """Zeros on the left up to ``width``, after a leading sign; longer text is kept whole."""
    sign = F.when(F.substring(c, 1, 1).isin("-", "+"), F.substring(c, 1, 1)).otherwise("")
    body = F.substr(c, F.length(sign) + 1)
    missing = F.greatest(F.lit(width) - F.length(c), F.lit(0))
    return F.concat(sign, F.repeat(F.lit("0"), missing), body)


def pad_right(c: Column, width: int) -> Column:
    missing = F.greatest(F.lit(width) - F.length(c), F.lit(0))
    return F.concat(c, F.repeat(F.lit(" "), missing))


def contains_flag(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike("(?i)" + pattern), F.lit(False))


def extract_regex(c: Column, pattern: str) -> Column:
    """First match of the pattern, "" where there is none."""
    return F.coalesce(F.regexp_extract(c, f"({pattern})", 1), F.lit(""))


def remove_special(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9\s]", "")


def split_first(c: Column, sep: str) -> Column:
    return F.substring_index(c, sep, 1)


def split_last(c: Column, sep: str) -> Column:
    """Text after the last separator; null where the separator does not occur."""
    return F.when(F.instr(c, sep) > 0, F.substring_index(c, sep, -1))


def repair_unicode(c: Column) -> Column:
    """Valid UTF-8: stray bytes become the replacement character."""
    return F.make_valid_utf8(c)


def mask_secrets(c: Column) -> Column:
    """Connection strings, key=value secrets, bearer tokens and key blocks masked.

    A plain text search decides first whether the costly pattern can match.
    """
    for pattern, replacement, marks in SECRET_PATTERNS:
        small = F.lower(c)
        possible = reduce(lambda a, b: a | b, [F.contains(small, F.lit(m)) for m in marks])
        c = F.when(possible, F.regexp_replace(c, pattern, replacement)).otherwise(c)
    return c


_OPERATIONS = {
    "upper": lambda c, p, r, w: F.upper(c),
    "lower": lambda c, p, r, w: F.lower(c),
    "title": lambda c, p, r, w: title(c),
    "strip": lambda c, p, r, w: strip(c),
    "replace": lambda c, p, r, w: F.replace(c, F.lit(p), F.lit(r)),
    "extract_regex": lambda c, p, r, w: extract_regex(c, p),
    "pad_left": lambda c, p, r, w: zero_fill(c, w),
    "pad_right": lambda c, p, r, w: pad_right(c, w),
    "length": lambda c, p, r, w: F.length(c),
    "contains_flag": lambda c, p, r, w: contains_flag(c, p),
    "remove_special": lambda c, p, r, w: remove_special(c),
    "split_first": lambda c, p, r, w: split_first(c, p),
    "split_last": lambda c, p, r, w: split_last(c, p),
}


def text_transform(df: DataFrame, column: str, operation: str, new_name: str | None = None,
                   pattern: str = "", replacement: str = "", width: int = 10) -> DataFrame:
    """One text function by name; the result is ``<column>_<operation>`` unless named."""
    if operation not in _OPERATIONS:
        raise ValueError(f"unknown text operation: {operation}")
    value = _OPERATIONS[operation](col(column).cast("string"), pattern, replacement, width)
    return df.withColumn(new_name or f"{column}_{operation}", value)
