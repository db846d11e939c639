"""Helpers for regular expressions written for a find-anywhere, RE2-style dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed value: the characters Unicode calls white space (for trimming and word splitting).
UNICODE_SPACE = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def trim_space(c: Column) -> Column:
    """Trim Unicode white space on both ends."""
    left = F.regexp_replace(c, rf"\A[{UNICODE_SPACE}]+", "")
    # The look-behind lets a match start only at the head of a run of blanks,
    # so a long run inside the text costs linear, not quadratic, time.
    return F.regexp_replace(left, rf"[{UNICODE_SPACE}](?<![{UNICODE_SPACE}]{{2}})[{UNICODE_SPACE}]*+\z", "")


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` mentions it."""
    return F.transform(F.array(value), fn)[0]


def words(c: Column) -> Column:
    """Split on runs of Unicode white space, without empty words."""
    return F.filter(F.split(c, f"[{UNICODE_SPACE}]+"), lambda w: w != "")


def replace_each(c: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` by ``fn(match)``.

    The text between matches and the matches themselves are two arrays, zipped back together.
    """
    between = F.split(c, pattern, -1)
    matches = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), fn)
    return F.array_join(
        F.zip_with(between, matches, lambda t, m: F.concat(t, F.coalesce(m, F.lit("")))), ""
    )


def search_form(pattern: str) -> str:
    """Drop a leading ``.*``: it changes nothing for a find-anywhere match but makes it quadratic."""
    if pattern.startswith(".*") and pattern[2:3] not in ("?", "+", "*", "{"):
        return pattern[2:]
    return pattern
