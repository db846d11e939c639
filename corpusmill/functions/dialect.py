"""Patterns of specifications: what the dialect refuses, what Java writes for the rest, and what can be told without running them.

The dialect finds a pattern anywhere in a text, in time linear in the text. So it has no look-around, back-references, atomic groups or possessive
quantifiers, repeats at most a thousand times, and some escapes, flags and classes mean other things than in Java. A pattern is
taken apart into tokens; refusals are conditions on tokens and their neighbours, and one fold over them follows
the nesting of repeats. A valid pattern is rewritten token by token.

Patterns are used many at a time, and mixed row by row, so a regular expression should rarely run. Most patterns are only literals around
``.*`` and a few alternatives: they become starts-with, ends-with and contains tests. Of any other one the longest literal
that each match must contain is looked for first, and only where it is found the expression runs.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusmill.functions.regex import let

# Named character classes of the dialect and their Java names.
NAMED_CLASSES = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph",
    "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit", "word": "IsWord",
}
# Fixed value: how often something may be repeated, nested repeats multiplied.
MOST_REPEATS = 1000

_ESCAPE = r"\\[pP]\{[^}]*\}|\\[pP].|\\x\{[^}]*\}|\\x[0-9A-Fa-f]{2}|\\0[0-7]{0,2}|\\[1-7][0-7]{1,2}|\\.|\\\z"
_CLASS = rf"\[\^?\]?(?:\[:\^?[a-z]*:\]|{_ESCAPE}|[^\]\\])*+\]"
_QUANTIFIER = r"(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})\??"
_TOKEN = rf"(?s)\\Q(?:(?!\\E).)*(?:\\E|\z)|{_ESCAPE}|{_CLASS}|\(\?P?<[^>)]*>|\(\?[A-Za-z-]*[:)]|\(\?.?|{_QUANTIFIER}|."
_NAME = r"\\[pP](?:\{\^?[A-Z][A-Za-z_]*\}|[LMNPSCZ])"
_CODE = r"\\x(?:\{0*(?:10[0-9A-Fa-f]{4}|[0-9A-Fa-f]{1,5})\}|[0-9A-Fa-f]{2})|\\0[0-7]{0,2}|\\[1-7][0-7]{1,2}"
_PLAIN = r"\\[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_GOOD_ESCAPE = rf"(?s)\A(?:\\Q.*|\\[afnrtvdDsSwWbBAz]|{_NAME}|{_CODE}|{_PLAIN})\z"
_GOOD_ITEM = rf"(?s)\A(?:\\[afnrtvdDsSwW]|{_NAME}|{_CODE}|{_PLAIN}|\[:\^?(?:{'|'.join(NAMED_CLASSES)}):\]|[^\\].?)\z"
_GOOD_GROUP = r"\A\((?:\?P?<[A-Za-z0-9_]+>|\?[imsU]*(?:-[imsU]+)?[:)])?\z"
_ITEM = rf"(?s)\[:\^?[a-z]*:\]|{_ESCAPE}|."
_FLAGS = r"\A\(\?[imsU-]*\)\z"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens(pattern: Column) -> Column:
    return _all(pattern, _TOKEN)


def _is_class(t: Column) -> Column:
    return t.startswith("[") & (F.length(t) > 1)


def _items(t: Column) -> Column:
    """What stands in a class token, a leading ``]`` included."""
    inner = F.regexp_replace(t, r"(?s)\A\[\^?|\]\z", "")
    return _all(inner, _ITEM)


def _is_quantifier(t: Column) -> Column:
    return t.rlike(rf"\A{_QUANTIFIER}\z")


def _opens(t: Column) -> Column:
    return t.startswith("(") & ~t.rlike(_FLAGS)


def _repeats(t: Column) -> Column:
    """How often a counted quantifier repeats: its upper, else its lower bound."""
    low, high = F.regexp_extract(t, r"\A\{([0-9]+)", 1), F.regexp_extract(t, r",([0-9]+)\}", 1)
    return F.least(F.when(high != "", high).otherwise(low).cast("decimal(38,0)"), F.lit(10**6).cast("decimal(38,0)")).cast("long")


def _repeated_too_often(ts: Column) -> Column:
    """A fold over the tokens: how often the last operand repeats something in it, and the same for every open group."""
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("open"), F.lit(1).cast("long").alias("top"), F.lit(1).cast("long").alias("last"), F.lit(False).alias("bad"))

    def state(opened: Column, top: Column, last: Column, bad: Column) -> Column:
        return F.struct(opened.alias("open"), top.cast("long").alias("top"), last.cast("long").alias("last"), bad.alias("bad"))

    def step(s: Column, t: Column) -> Column:
        n = F.size(s["open"])
        product = F.greatest(_repeats(t), F.lit(1).cast("long")) * s["last"]
        outer = F.coalesce(F.get(s["open"], n - 1), F.lit(1).cast("long"))
        return (
            F.when(t.rlike(r"\A\{[0-9]"), state(s["open"], F.greatest(s["top"], product), F.least(product, F.lit(10**6)), s["bad"] | (product > MOST_REPEATS)))
            .when(_is_quantifier(t), s)
            .when(_opens(t), state(F.array_append(s["open"], s["top"]), F.lit(1), F.lit(1), s["bad"] | (n >= MOST_REPEATS)))
            .when(t == ")", state(F.slice(s["open"], 1, F.greatest(n - 1, F.lit(0))), F.greatest(outer, s["top"]), s["top"], s["bad"]))
            .otherwise(state(s["open"], s["top"], F.lit(1), s["bad"]))
        )

    return F.aggregate(ts, start, step)["bad"]


def _refused(pattern: Column, ts: Column) -> Column:
    after = lambda test: F.exists(F.sequence(F.lit(0), F.size(ts) - 1), test)
    escape = F.exists(ts, lambda t: t.startswith("\\") & ~t.rlike(_GOOD_ESCAPE))
    group = F.exists(ts, lambda t: t.startswith("(") & ~t.rlike(_GOOD_GROUP))
    # a range ends with one character, not with a class
    item = F.exists(ts, lambda t: _is_class(t) & F.exists(_items(t), lambda x: ~x.rlike(_GOOD_ITEM)))
    span = F.exists(ts, lambda t: _is_class(t) & t.rlike(r"(?s)(?:\A\[\^?|[^-\\])(?:[^\\\[\]-]|\\[^dDsSwWpP])-(?:\\[dDsSwWpP]|\[:)"))
    twice = after(lambda i: _is_quantifier(F.get(ts, i)) & F.coalesce(_is_quantifier(F.get(ts, i + 1)), F.lit(False)))
    bare = after(lambda i: _is_quantifier(F.get(ts, i)) & ((i == 0) | F.coalesce(_opens(F.get(ts, i - 1)) | (F.get(ts, i - 1) == "|"), F.lit(False))))
    bounds = F.exists(ts, lambda t: t.rlike(r"\A\{[0-9]+,[0-9]+\}") & (
        F.regexp_extract(t, r"\A\{([0-9]+)", 1).try_cast("decimal(38,0)") > F.regexp_extract(t, r",([0-9]+)", 1).try_cast("decimal(38,0)")))
    many = F.when(pattern.rlike(r"\{[0-9]"), _repeated_too_often(ts)).otherwise(F.lit(False))
    return escape | group | item | span | twice | bare | bounds | many


def _named(text: Column) -> Column:
    """A Unicode class as Java names it: one or two letters are a category, more a script."""
    name = F.regexp_extract(text, r"\A\\[pP]\{?\^?([A-Za-z_]+)\}?\z", 1)
    away = text.startswith("\\P") != text.contains("^")
    kind = F.when(F.length(name) <= 2, F.lit("gc=")).otherwise(F.lit("script="))
    return F.when(name == "Any", F.when(away, F.lit(r"[^\x{0}-\x{10FFFF}]")).otherwise(F.lit(r"[\x{0}-\x{10FFFF}]"))).otherwise(
        F.concat(F.when(away, F.lit(r"\P{")).otherwise(F.lit(r"\p{")), kind, name, F.lit("}")))


def _octal(text: Column) -> Column:
    return F.concat(F.lit(r"\x{"), F.conv(F.substring(text, 2, 3), 8, 16), F.lit("}"))


def _java_item(x: Column, first: Column) -> Column:
    """One item of a class."""
    posix = F.lit(None).cast("string")
    for name, java in NAMED_CLASSES.items():
        if name == "word":
            posix = F.when(x == "[:word:]", F.lit(r"\w")).when(x == "[:^word:]", F.lit(r"\W")).otherwise(posix)
        else:
            posix = F.when(x == f"[:{name}:]", F.lit(rf"\p{{{java}}}")).when(x == f"[:^{name}:]", F.lit(rf"\P{{{java}}}")).otherwise(posix)
    return (
        F.when(F.length(x) == 1, F.when(x.isin("[", "]", "&", "^"), F.concat(F.lit("\\"), x)).when((x == "-") & first, F.lit("\\-")).otherwise(x))
        .when(x.startswith("[:"), posix)
        .when(x == "\\s", F.lit(r"\t\n\f\r ")).when(x == "\\S", F.lit(r"[^\t\n\f\r ]")).when(x == "\\v", F.lit(r"\x0B"))
        .when(x.rlike(r"\A\\[pP]"), _named(x)).when(x.rlike(r"\A\\[0-7]"), _octal(x)).otherwise(x)
    )


def _java_token(t: Column, lines: Column) -> Column:
    items = _items(t)
    class_ = F.concat(
        F.when(t.startswith("[^"), F.lit("[^")).otherwise(F.lit("[")), F.array_join(F.transform(items, lambda x, i: _java_item(x, i == 0)), ""), F.lit("]"))
    flags = F.replace(F.regexp_replace(F.replace(t, F.lit("U"), F.lit("")), r"-(?=[:)])", ""), F.lit("(?)"), F.lit(""))
    return (
        F.when(_is_class(t), class_)
        .when(t.startswith("\\Q") & ~t.endswith("\\E"), F.concat(t, F.lit("\\E")))
        .when(t.rlike(r"\A\(\?P?<"), F.lit("("))
        .when(t.startswith("(?"), flags)
        .when(t.isin("{", "}", "]"), F.concat(F.lit("\\"), t))
        .when(t == "$", F.when(lines, F.lit("$")).otherwise(F.lit(r"\z")))
        .when(t == "\\s", F.lit(r"[\t\n\f\r ]")).when(t == "\\S", F.lit(r"[^\t\n\f\r ]")).when(t == "\\v", F.lit(r"\x0B"))
        .when(t.rlike(r"\A\\[pP]"), _named(t)).when(t.rlike(r"\A\\[0-7]"), _octal(t)).otherwise(t)
    )


def java_form(pattern: Column) -> Column:
    """A valid pattern as Java writes it. A leading ``.*`` changes nothing for a find-anywhere match and is dropped."""
    lines = pattern.rlike(r"\(\?[a-zA-Z]*m")
    bare = F.regexp_replace(pattern, r"\A\.\*(?![?+*{])", "")
    # only a line feed ends a line
    return F.concat(F.lit("(?d:"), F.array_join(F.transform(tokens(bare), lambda t: _java_token(t, lines)), ""), F.lit(")"))


def is_valid(pattern: Column) -> Column:
    """Whether the dialect accepts a pattern."""
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), java_form(pattern))
    refused = let(tokens(pattern), lambda ts: F.when(F.size(ts) > 0, _refused(pattern, ts)).otherwise(F.lit(False)))
    return ~refused & compiled.isNotNull()


# ------------------------------------------------------------------ literals

_LITERAL = r"""(?:[A-Za-z0-9_/:@%~=&;,!' #<>"-]|\\[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])"""
_CHOICE = rf"\((?:\?:)?{_LITERAL}*+(?:\|{_LITERAL}*+)*+\)"
_MOST_CHOICES = 64


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def _choices(bare: Column) -> Column:
    """All texts that a pattern of literals, optional characters and groups of literals stands for; NULL for others."""
    pieces = _all(bare, rf"{_CHOICE}|{_LITERAL}\??")
    options = lambda p: (
        F.when(p.startswith("("), F.transform(F.split(F.regexp_replace(p, r"\A\((?:\?:)?|\)\z", ""), r"(?<!\\)\|", -1), _unescaped))
        .when(p.rlike(r"[^\\]\?\z"), F.array(F.lit(""), _unescaped(F.regexp_replace(p, r"\?\z", ""))))
        .otherwise(F.array(_unescaped(p))))
    texts = F.aggregate(pieces, F.array(F.lit("")), lambda known, p: F.when(F.size(known) > _MOST_CHOICES, known).otherwise(
        F.flatten(F.transform(known, lambda k: F.transform(options(p), lambda o: F.concat(k, o))))))
    return F.when((F.array_join(pieces, "") == bare) & (F.size(texts) <= _MOST_CHOICES), texts)


def longest_literal(pattern: Column) -> Column:
    """The longest text that every match must contain, as far as the pattern's outermost level tells."""
    ts = tokens(pattern)
    state = lambda depth, run, best, ok: F.struct(depth.alias("depth"), run.alias("run"), best.alias("best"), ok.alias("ok"))
    longer = lambda s, run: F.when(F.length(run) > F.length(s["best"]), run).otherwise(s["best"])

    def step(s: Column, x: Column) -> Column:
        t, q = x["t"], x["q"]
        single = F.when(t.rlike(rf"\A{_LITERAL}\z"), _unescaped(t))
        at_top = s["depth"] == 0
        closed = longer(s, s["run"])
        grown = F.concat(s["run"], single)
        return (
            F.when(_opens(t), state(s["depth"] + 1, F.lit(""), closed, s["ok"]))
            .when(t == ")", state(s["depth"] - 1, F.lit(""), closed, s["ok"]))
            .when(at_top & (t == "|"), state(s["depth"], F.lit(""), closed, F.lit(False)))
            .when(at_top & single.isNotNull() & (q == ""), state(s["depth"], grown, closed, s["ok"]))
            .when(at_top & single.isNotNull() & q.rlike(r"\A(?:\+|\{0*[1-9])"), state(s["depth"], F.lit(""), longer(s, grown), s["ok"]))
            .otherwise(state(s["depth"], F.lit(""), closed, s["ok"]))
        )

    def told(all_: Column) -> Column:
        paired = F.filter(F.transform(all_, lambda t, i: F.struct(
            t.alias("t"), F.coalesce(F.when(_is_quantifier(F.get(all_, i + 1)), F.get(all_, i + 1)), F.lit("")).alias("q"))), lambda x: ~_is_quantifier(x["t"]))
        end = F.aggregate(paired, F.struct(F.lit(0).alias("depth"), F.lit("").alias("run"), F.lit("").alias("best"), F.lit(True).alias("ok")), step)
        return let(end, lambda s: F.when(s["ok"], longer(s, s["run"])).otherwise(""))

    return F.when(pattern.rlike(r"\(\?[a-zA-Z]*i"), "").otherwise(let(ts, told))


COMPILED = "struct<start:boolean,end:boolean,texts:array<string>,literal:string,java:string>"


def compiled(pattern: Column) -> Column:
    """A valid pattern in the form that :func:`found` takes: texts for starts-with, ends-with and contains tests, or a literal and an expression."""
    bare = F.regexp_replace(F.regexp_replace(pattern, r"\A(?:\^?\.\*(?![?+*{])|\^)", ""), r"(?<!\\)(?:\.\*\$?|\$)\z", "")
    start = pattern.startswith("^") & ~pattern.rlike(r"\A\^\.\*(?![?+*{])")
    end = pattern.rlike(r"(?<!\\)\$\z") & ~pattern.rlike(r"(?<!\\)\.\*\$\z")
    texts = _choices(bare)
    return F.struct(start.alias("start"), end.alias("end"), texts.alias("texts"), longest_literal(pattern).alias("literal"), java_form(pattern).alias("java"))


def found(text: Column, pattern: Column) -> Column:
    """Whether a compiled pattern is found in a text (without line feeds)."""

    def test(t: Column) -> Column:
        return (
            F.when(pattern["start"] & pattern["end"], text == t).when(pattern["start"], F.startswith(text, t))
            .when(pattern["end"], F.endswith(text, t)).otherwise(F.contains(text, t)))

    return F.when(pattern["texts"].isNotNull(), F.exists(pattern["texts"], test)).otherwise(runs(text, pattern) & F.rlike(text, pattern["java"]))


def runs(text: Column, pattern: Column) -> Column:
    """Whether the expression of a compiled pattern has to run on a text."""
    return pattern["texts"].isNull() & F.contains(text, pattern["literal"])


def any_of(patterns: Column) -> Column:
    """An array of valid patterns, compiled; NULL for an empty or NULL array."""
    return F.when(F.size(F.coalesce(patterns, F.array().cast("array<string>"))) > 0, F.transform(patterns, compiled))
