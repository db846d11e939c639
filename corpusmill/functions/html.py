"""Fixed knowledge about HTML: token pattern, element classes, attribute parsing."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, functions as F

from corpusmill.functions.entities import decode_entities

# Elements whose content is text, never markup.
RAW_TEXT = ("script", "style", "noscript", "title", "textarea")

# Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr")

# Elements whose end tag may be left out, in the groups that end each other.
LIST_ITEM = ("li",)
DEFINITION = ("dt", "dd")
CELL = ("td", "th")
ROW = ("tr",)
ROW_GROUP = ("thead", "tbody", "tfoot")
IMPLIED_END = ("p",) + LIST_ITEM + DEFINITION + CELL + ROW + ROW_GROUP

# Elements that live inside a line of text.
INLINE = ("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font",
          "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var")

# Elements whose start tag ends an open paragraph.
BLOCK = ("address", "article", "aside", "blockquote", "center", "details", "dialog", "div", "dl",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "header", "hgroup", "main", "menu", "nav", "ol", "pre", "search", "section", "summary",
         "table", "ul") + IMPLIED_END

# One match per comment, raw-text element, tag, text run or stray "<". Possessive loops keep
# matching linear and the stack flat on hostile input; a ">" inside quotes does not end a tag.
TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)|<[!?][^>]*>|"
    + "|".join(rf"<{t}(?:[\s/][^>]*)?>.*?(?:</{t}[^>]*>|\z)" for t in RAW_TEXT)
    + r"""|</?[a-z][^>=]*+(?:=(?:\s*+(?:"[^"]*+"|'[^']*+'))?+[^>=]*+)*+>|[^<]+|<"""
)

_SPACE = r"\t\n\f\r "
_ATTRIBUTE = (
    rf"""[^{_SPACE}"'<>/=]+(?:[{_SPACE}]*=[{_SPACE}]*(?:"[^"]*"|'[^']*'|[^{_SPACE}"'>][^{_SPACE}>]*))?"""
)


def one_of(column: str, values) -> Column:
    """``column IN (values)``, built as one expression instead of one per value."""
    return F.expr(f"{column} IN ({', '.join(repr(v) for v in values)})") if values else F.lit(False)


def token_tag(raw: Column) -> Column:
    """Lower-case tag name; NULL for text and comments."""
    name = F.lower(F.regexp_extract(raw, rf"^</?([A-Za-z][^{_SPACE}/>]*)", 1))
    return F.when(raw.startswith("<"), F.nullif(name, F.lit("")))


def token_kind(raw: Column, tag: Column) -> Column:
    """One of text, comment, raw, void, close, open."""
    return (
        F.when(tag.isNull() & (raw.startswith("<!") | raw.startswith("<?")), "comment")
        .when(tag.isNull(), "text")
        .when(raw.startswith("</"), "close")
        .when(one_of("tag", RAW_TEXT), "raw")
        .when(one_of("tag", VOID), "void")
        .otherwise("open")
    )


def attribute(raw: Column, name: str) -> Column:
    """Decoded value of one attribute of a start tag, or NULL; the first of two equal names wins.

    One anchored pattern steps over the attributes before it, so that a name inside another
    attribute's quoted value is never taken for it.
    """
    value = rf"""(?:"[^"]*+"|'[^']*+'|[^{_SPACE}"'>][^{_SPACE}>]*+)"""
    found = (
        rf"(?is)\A<[^{_SPACE}/>]++(?:[{_SPACE}/]++(?!{name}[{_SPACE}=/>])[^{_SPACE}/>=]++"
        rf"(?:[{_SPACE}]*+=[{_SPACE}]*+{value})?+)*+[{_SPACE}/]++({name}(?=[{_SPACE}=/>])"
        rf"(?:[{_SPACE}]*+=[{_SPACE}]*+{value})?+)"
    )
    pair = F.regexp_extract(raw, found, 1)
    # Most tags have no attributes at all; they never reach the pattern.
    return F.when(raw.rlike(rf"^<[^{_SPACE}/>]+[{_SPACE}/]") & (pair != ""), _pair_value(pair))


@lru_cache(maxsize=None)
def attr(name: str) -> Column:
    """:func:`attribute` of the token in column ``text``.

    Building a long expression costs more than a short job; one per name is built and reused.
    """
    return attribute(F.col("text"), name)


def _pair_value(pair: Column) -> Column:
    v = F.regexp_replace(pair, rf"(?s)\A[^=]*=[{_SPACE}]*|\A[^=]*\z", "")
    v = F.regexp_replace(v, r"""(?s)\A(["'])(.*)\1\z""", "$2")
    return decode_entities(v)


def attributes(raw: Column) -> Column:
    """All attributes of a start tag as a map; the first of two equal names wins; NULL for none."""
    body = F.regexp_replace(raw, rf"\A<[^{_SPACE}/>]*|>\z", "")
    pairs = F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(0))

    def entry(pair: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(pair, rf"^[^{_SPACE}=]+", 0)).alias("key"), _pair_value(pair).alias("value")
        )

    def add_new(known: Column, pair: Column) -> Column:
        e = entry(pair)
        seen = F.exists(known, lambda k: k["key"] == e["key"])
        return F.when(seen, known).otherwise(F.array_append(known, e))

    entries = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), add_new)
    return F.when(
        raw.rlike(rf"^<[^{_SPACE}/>]+[{_SPACE}/]+[^{_SPACE}/>]"), F.map_from_entries(entries)
    )


def raw_inner(raw: Column) -> Column:
    """Text inside a raw-text element token."""
    return F.regexp_extract(raw, r"(?is)^<[^>]*>(.*?)(?:</[a-z]+[^>]*>)?\z", 1)


@lru_cache(maxsize=None)
def token_text() -> Column:
    """What a text extraction reads from a token row: decoded text, or NULL for markup."""
    kind, tag, raw = F.col("kind"), F.col("tag"), F.col("text")
    return F.when(kind == "text", decode_entities(raw)).when(
        kind == "raw",
        F.when(one_of("tag", ("title", "textarea")), decode_entities(raw_inner(raw))).otherwise(raw_inner(raw)),
    )
