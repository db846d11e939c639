"""HTML character references."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, functions as F

from corpusmill.functions.regex import replace_each

# The standard library's names; some count even without the closing semicolon.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
REFERENCE = (
    r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+;|(?:" + _BARE + r")(?![A-Za-z0-9=]))"
)
_NAMED = "\x02".join(f"{name[:-1]}\x01{text}" for name, text in sorted(html5.items()) if name.endswith(";"))

# Code points 128 to 159 stand for the characters they have in Windows-1252.
_C1 = "".join(bytes([b]).decode("cp1252", "replace") for b in range(128, 160))


def _character(code_point: Column) -> Column:
    valid = code_point.between(1, 0x10FFFF) & ~code_point.between(0xD800, 0xDFFF)
    hex8 = F.lpad(F.hex(code_point), 8, "0")
    old = F.substring(F.lit(_C1), code_point - 127, F.lit(1))
    return F.when(code_point.between(128, 159), old).when(valid, F.decode(F.unhex(hex8), "UTF-32")).otherwise(F.lit("\ufffd"))


def _number(digits: Column, base: int, most: int) -> Column:
    """The value of digits without their leading zeros; 0, which is no character, when there are too many."""
    bare = F.regexp_replace(digits, "^0+", "")
    return F.when(F.length(bare).between(1, most), F.conv(bare, base, 10).cast("int")).otherwise(0)


def _decode_one(ref: Column) -> Column:
    named = F.str_to_map(F.lit(_NAMED), F.lit("\x02"), F.lit("\x01"))
    name = F.substring_index(F.substring_index(ref, ";", 1), "&", -1)
    return (
        F.when(name == "amp", F.lit("&"))
        .when(name == "lt", F.lit("<"))
        .when(name == "gt", F.lit(">"))
        .when(name == "quot", F.lit('"'))
        .when(name == "nbsp", F.lit("\u00a0"))
        .when(
            ref.rlike("^&#[xX]"),
            _character(_number(F.regexp_extract(ref, "([0-9a-fA-F]+);?$", 1), 16, 6)),
        )
        .when(
            ref.startswith("&#"),
            _character(_number(F.regexp_extract(ref, "([0-9]+);?$", 1), 10, 7)),
        )
        .otherwise(F.coalesce(F.try_element_at(named, name), ref))
    )


def decode_entities(c: Column) -> Column:
    """Replace named and numeric character references; unknown names stay as they are."""
    return F.when(c.contains("&"), replace_each(c, REFERENCE, _decode_one)).otherwise(c)


def escape_attribute(c: Column) -> Column:
    """Text as it may stand inside a double-quoted attribute."""
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit('"'), F.lit("&quot;"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
