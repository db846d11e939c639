"""String functions: titles, anchors, Markdown tidying, sizes, hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusmill.functions.regex import UNICODE_SPACE, trim_space, words

_S = r"[\t\n\f\r ]*"

# Phrases that documentation sites add to titles; removed wherever they stand.
STATUS_PHRASES = (
    rf"{_S}This feature is available in the latest.*?React{_S}",
    rf"{_S}This feature is available in the latest Canary{_S}",
    rf"{_S}This feature is available in the latest Experimental version of React{_S}",
)

# Branding at the end of titles.
BRANDING_SUFFIXES = (
    rf"{_S}–{_S}React{_S}\z",
    rf"{_S}-{_S}React{_S}\z",
    rf"{_S}\|{_S}React{_S}\z",
    rf"{_S}–{_S}Stripe{_S}\z",
    rf"{_S}-{_S}Stripe{_S}\z",
    rf"{_S}\|{_S}Stripe{_S}\z",
    rf"{_S}\|{_S}.*Documentation{_S}\z",
    rf"{_S}\|{_S}.*Docs{_S}\z",
)

# Fixed value: characters that may not stand in an anchor.
ANCHOR_DELETES = r""".()/\:;?!@#$%^&*+=[]{}|"'<>,"""


def clean_title(c: Column) -> Column:
    """Drop status phrases and branding, then words that repeat the word before them."""
    for pattern in STATUS_PHRASES + BRANDING_SUFFIXES:
        c = F.regexp_replace(c, "(?iud)" + pattern, "")
    # Each word is paired with its predecessor first: indexing the array from inside
    # a filter would split the title again for every word.
    split = words(c)
    pairs = F.arrays_zip(split.alias("word"), F.array_insert(split, 1, F.lit(None)).alias("before"))
    kept = F.filter(
        pairs,
        lambda p: p["word"].isNotNull()
        & (p["before"].isNull() | (F.lower(p["word"]) != F.lower(p["before"]))),
    )
    return F.array_join(F.transform(kept, lambda p: p["word"]), " ")


def title_case(c: Column) -> Column:
    """First letter of every word upper case, the rest lower case, one space between words."""
    def first(w: Column) -> Column:
        letter = F.substring(w, 1, 1)
        # one letter stays one letter, also where full case mapping would make it two
        return F.when(F.length(F.upper(letter)) == 1, F.upper(letter)).otherwise(letter)

    return F.array_join(
        F.transform(words(c), lambda w: F.concat(first(w), F.lower(w.substr(F.lit(2), F.length(w))))), " "
    )


def anchor(c: Column) -> Column:
    """Link target for a title; not made unique."""
    c = F.replace(F.lower(c), F.lit(" "), F.lit("-"))
    c = F.translate(c, ANCHOR_DELETES, "")
    c = F.regexp_replace(c, "-+", "-")
    return F.regexp_replace(c, r"^-|-\z", "")


def tidy_markdown(c: Column) -> Column:
    """No blanks at line ends, no runs of empty lines, no empty lines at the end."""
    blanks = "[" + UNICODE_SPACE.replace(r"\n", "") + "]+"
    # Patterns begin with the character they look for, so most positions fail at once; the
    # look-behind then keeps a long run of blanks from being tried from each of its characters.
    c = F.regexp_replace(c, r"[ \t](?<![ \t]{2})[ \t]*+(?=\n|\z)", "")
    c = F.regexp_replace(c, rf"\n{blanks}(?=\n|\z)", "\n")
    c = F.regexp_replace(c, rf"\A{blanks}(?=\n|\z)", "")
    c = F.regexp_replace(c, r"\A\n+", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"\n+\z", "")


def trim_body(c: Column) -> Column:
    """Page body as written into the document."""
    return trim_space(c)


def parse_size(c: Column) -> Column:
    """Bytes for ``10``, ``1KB``, ``5MB``, ``2GB``; NULL when there is no number.

    Only the upper-case suffixes count, and only the digits the text starts with are read.
    """
    digits = F.regexp_extract(c, r"^ *([+-]?[0-9]+)", 1)
    number = F.when(digits != "", digits.try_cast("bigint"))
    unit = (
        F.when(c.endswith("KB"), F.lit(1 << 10))
        .when(c.endswith("MB"), F.lit(1 << 20))
        .when(c.endswith("GB"), F.lit(1 << 30))
        .otherwise(F.lit(1))
        .cast("bigint")
    )
    return F.try_multiply(number, unit)


def content_hash(c: Column) -> Column:
    """Hexadecimal SHA-256 of the UTF-8 bytes."""
    return F.sha2(c, 256)
