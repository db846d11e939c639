"""Sanitizing, and Markdown from page streams.

Every row of a content stream emits a short piece of text; one ordered concatenation per page
makes the document body, and a fixed chain of replacements settles the white space. Layout
decisions that depend on neighbours (how many line breaks, which line prefix) are left to that
chain: rows emit noncharacters such as ``BLOCK`` that never occur in text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusmill.functions import html as H
from corpusmill.functions.entities import escape_attribute
from corpusmill.functions.regex import let, replace_each, trim_space
from corpusmill.functions.text import tidy_markdown
from corpusmill.functions.urls import resolve_url
from corpusmill.operators.select import (
    DEFAULT_CONTENT, DEFAULT_TITLE, ordered_concat, page_stream, part_window, pick_title,
    title_columns, title_text,
)
from corpusmill.operators.tokens import KEYS, class_list, source_text

# Elements and attributes that survive sanitizing.
ALLOWED = (
    "pre", "code", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "table", "thead", "tbody", "tr",
    "th", "td", "ul", "ol", "li", "dl", "dt", "dd", "p", "br", "hr", "div", "span", "strong", "b",
    "em", "i", "u", "s", "del", "ins", "a",
)
ALLOWED_ATTRIBUTES = {
    "a": ("href", "title"), "img": ("src", "alt", "title", "width", "height"),
    "pre": ("class",), "code": ("class",),
}
# Elements dropped together with their text.
DROPPED = ("script", "style", "noscript")

# Layout marks: Unicode noncharacters, which text cannot contain.
BREAK = "\ufdd0"      # end of a line made by <br>
SOFT = "\ufdd1"       # next list item or table row
BLOCK = "\ufdd2"      # blank line between blocks
CUT = "\ufdd3"        # blank line without quote marks, around block quotes
QUOTE = "\ufdd4"      # line prefix "> "
INDENT = "\ufdd5"     # line prefix of two blanks
GLUE = "\ufdd6"       # after a list marker: swallow breaks
ITEM_END = "\ufdd7"
OPENER, OPENED = "\ufdd8", "\ufdd9"   # around an opening inline mark
CLOSER, CLOSED = "\ufdda", "\ufddb"   # around a closing inline mark
BLANK, LINE = "\ufddc", "\ufddd"      # blank and line end inside <pre>
FENCE, LANG, FENCE_END = "\ufdde", "\ufddf", "\ufde0"
TABLE, TABLE_END, ROW, CELL = "\ufde1", "\ufde2", "\ufde3", "\ufde4"   # a table's begin and end, its rows, and its cells with their spans
CELL_TEXT = "\ufde5"
MARKS = "[\ufdd0-\ufdef]"
# Fixed value: the most columns or rows that a cell can span.
MOST_SPAN = 1000

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LISTS = ("ul", "ol")
EMPHASIS = {"strong": "**", "b": "**", "em": "_", "i": "_", "del": "~~", "s": "~~", "strike": "~~"}
# Elements with a rule of their own in _pieces; every other block element is a plain paragraph.
_SPECIAL = HEADINGS + LISTS + H.LIST_ITEM + H.CELL + H.ROW + H.ROW_GROUP + ("blockquote", "pre", "table")


def is_allowed(preserve_images: bool | Column) -> Column:
    """Whether sanitizing keeps an element."""
    images = preserve_images if isinstance(preserve_images, Column) else F.lit(preserve_images)
    return H.one_of("tag", ALLOWED) | (images & (F.col("tag") == "img"))


def _safe_url(url: Column) -> Column:
    """Relative links and web or mail addresses stay; other schemes are dropped."""
    has_scheme = url.rlike(r"^\s*[A-Za-z][A-Za-z0-9+.\-]*:")
    return F.when(~has_scheme | url.rlike(r"(?i)^\s*(?:https?|mailto):"), url)


def sanitized_html(preserve_images: bool) -> Column:
    """The html an event stands for after sanitizing."""
    kind, tag, raw = F.col("kind"), F.col("tag"), F.col("text")
    attrs = F.lit("")
    for owner, names in ALLOWED_ATTRIBUTES.items():
        rendered = F.lit("")
        for name in names:
            value = H.attr(name)
            value = _safe_url(value) if name in ("href", "src") else value
            rendered = F.concat(
                rendered,
                F.coalesce(F.concat(F.lit(f' {name}="'), escape_attribute(value), F.lit('"')), F.lit("")),
            )
        attrs = F.when(tag == owner, rendered).otherwise(attrs)
    start = F.concat(F.lit("<"), tag, attrs, F.lit(">"))
    end = F.concat(F.lit("</"), tag, F.lit(">"))
    allowed = is_allowed(preserve_images)
    return (
        F.when(kind == "text", F.when(raw == "<", "&lt;").otherwise(raw))
        .when((kind == "raw") & ~H.one_of("tag", DROPPED), H.raw_inner(raw))
        .when(H.one_of("kind", ("open", "void")) & allowed, start)
        .when((kind == "end") & allowed, end)
        .otherwise("")
    )


def sanitize(
    pages: DataFrame, content: str, exclude: Sequence[str] = (), preserve_images: bool = False,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """``keys, html``: the sanitized inner HTML of the content matches of each page."""
    rows = page_stream(pages, title=None, content=content, exclude=exclude, keys=keys)
    return (
        rows.filter("part = 'content' AND NOT boundary")
        .withColumn("src", sanitized_html(preserve_images))
        .filter("src <> ''")
        .groupBy(*keys)
        .agg(ordered_concat("src", "", "true", "match_pos", "ord").alias("html"))
    )


# ------------------------------------------------------------------------- pieces


def _context(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add what surrounds each row: list, quote, table depth and the like."""
    kind, tag = F.col("kind"), F.col("tag")
    upto = part_window(keys).rowsBetween(W.unboundedPreceding, W.currentRow)

    def inside(flag: Column) -> Column:
        step = F.when(flag & (kind == "open"), 1).when(flag & (kind == "end"), -1).otherwise(0)
        return F.sum(step).over(upto).cast("int")

    is_list = H.one_of("tag", LISTS)
    rows = rows.withColumns({
        "pre": inside(tag == "pre"),
        "code": inside(tag == "code"),
        "lists": inside(is_list),
        "quotes": inside(tag == "blockquote"),
        "tables": inside(tag == "table"),
        # a link is one line of text, like a heading or a table cell
        "flat": inside(H.one_of("tag", HEADINGS + ("a",))),
        "bold": inside(H.one_of("tag", ("strong", "b"))),
        "italic": inside(H.one_of("tag", ("em", "i"))),
        "struck": inside(H.one_of("tag", ("del", "s", "strike"))),
    })
    outer = F.col("tables") == 1
    rows = rows.withColumns({
        # the end event of a table has left it already, so cells and rows see depth one throughout
        "cell": inside(H.one_of("tag", H.CELL) & outer),
        "outer_quotes": F.last(
            F.when((kind == "open") & is_list & (F.col("lists") == 1), F.col("quotes")), ignorenulls=True
        ).over(upto),
    })
    # Items of one list share its depth, between two starts of lists at that depth.
    at_depth = W.partitionBy(*keys, "part", "level", "lists").orderBy("ord").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    item = (kind == "open") & (tag == "li")
    list_start = (kind == "open") & is_list
    return (
        rows.withColumn("items", F.sum(F.when(item, 1).otherwise(0)).over(at_depth))
        .withColumns({
            "item_base": F.last(F.when(list_start, F.col("items")), ignorenulls=True).over(at_depth),
            "list_tag": F.last(F.when(list_start, tag), ignorenulls=True).over(at_depth),
            "list_from": F.last(F.when(list_start, F.coalesce(F.when(tag == "ol", H.attr("start").try_cast("int")), F.lit(1))), ignorenulls=True).over(at_depth),
        })
    )


# What Markdown would take for markup inside text: emphasis, code, links, tags and references.
_MARKUP = r"[\\*`\[]|(?<![\p{L}\p{N}])_|_(?![\p{L}\p{N}])|<(?=[A-Za-z/!?])|&(?=#?[A-Za-z0-9]{1,31};)|~(?=~)"


def _escaped(text: Column) -> Column:
    """Text that reads as it is: what looks like markup gets a backslash."""
    marked = F.regexp_replace(text, f"({_MARKUP})", r"\\$1")
    numbered = F.regexp_replace(marked, r"\A(\s*+[0-9]{1,9})([.)])(?=\s|\z)", r"$1\\$2")
    return F.regexp_replace(numbered, r"\A(\s*+)(#{1,6}(?=\s|\z)|[-+](?=\s|\z)|>|-{3,}|={3,})", r"$1\\$2")


def _pieces(absolute_base: Column | None, sanitized: Column) -> Column:
    """What a row of a content stream with context emits."""
    kind, tag, raw = F.col("kind"), F.col("tag"), F.col("text")
    opened, ended, void = kind == "open", kind == "end", kind == "void"
    lit = F.lit

    lists = F.greatest(F.col("lists"), lit(0))
    quotes = F.greatest(F.col("quotes"), lit(0))
    outer_quotes = F.when(lists > 0, F.least(F.coalesce("outer_quotes", lit(0)), quotes)).otherwise(quotes)

    def prefix(depth: Column) -> Column:
        return F.concat(
            F.repeat(lit(QUOTE), outer_quotes), F.repeat(lit(INDENT), depth),
            F.repeat(lit(QUOTE), quotes - outer_quotes),
        )

    pfx = prefix(lists)
    item_pfx = prefix(F.greatest(lists - 1, lit(0)))
    mark = lambda m: F.concat(lit(m), pfx)

    # State around the element itself: a start does not count as inside itself.
    flat_self = F.when(opened & H.one_of("tag", HEADINGS + ("a",)), 1).otherwise(0)
    cell_self = F.when(opened & H.one_of("tag", H.CELL) & (F.col("tables") == 1), 1).otherwise(0)
    flat = ((F.col("flat") - flat_self) > 0) | ((F.col("cell") - cell_self) > 0)
    pre_self = F.when(opened & (tag == "pre"), 1).otherwise(0)
    in_pre = (F.col("pre") - pre_self) > 0
    verbatim = in_pre & ~flat

    # ---- text
    text = F.regexp_replace(H.token_text(), MARKS, "")
    line = F.regexp_replace(text, r"[\t\n\f\r ]+", " ")
    line = F.when(F.col("code") > 0, line).otherwise(_escaped(line))
    in_cell = F.col("cell") > 0
    plain = F.when(in_cell, F.replace(line, lit("|"), lit("\\|"))).otherwise(line)
    pre_text = F.replace(
        F.replace(F.regexp_replace(text, r"\r\n?", "\n"), lit(" "), lit(BLANK)), lit("\n"), mark(LINE)
    )
    is_text = (kind == "text") | ((kind == "raw") & ~H.one_of("tag", DROPPED))

    # ---- inline
    def inline(before: str, on_open: Column, on_end: Column) -> Column:
        return F.when(opened, F.concat(lit(OPENER), on_open, lit(OPENED))).when(
            ended, F.concat(lit(CLOSER), on_end, lit(CLOSED))
        )

    language = F.regexp_extract(
        F.array_join(F.filter(class_list(H.attr("class")), lambda c: c.rlike("^(language|lang)-")), " "),
        r"^(?:language|lang)-(\S+)", 1,
    )
    lang_mark = F.concat(lit(LANG), F.coalesce(language, lit("")), lit(LANG))
    # the same rule for links as in sanitized_html: an unsafe one leaves its text
    safe = lambda c: F.when(sanitized, _safe_url(c)).otherwise(c)
    href = safe(H.attr("href"))
    src = safe(H.attr("src"))
    if absolute_base is not None:
        href = F.coalesce(resolve_url(absolute_base, href), href)
        src = F.coalesce(resolve_url(absolute_base, src), src)
    clean = lambda c: F.regexp_replace(c, MARKS + r"|[\n\r]", "")
    title = H.attr("title")
    title = F.coalesce(F.concat(lit(' "'), F.replace(clean(title), lit('"'), lit('\\"')), lit('"')), lit(""))
    link_end = F.concat(lit("]("), F.replace(clean(href), lit(" "), lit("%20")), title, lit(")"))
    image = F.concat(
        lit("!["), clean(F.coalesce(H.attr("alt"), lit(""))), lit("]("),
        F.replace(clean(src), lit(" "), lit("%20")), title, lit(")"),
    )
    nested = {"bold": ("strong", "b"), "italic": ("em", "i"), "struck": ("del", "s", "strike")}
    emphasis = None
    for depth, tags in nested.items():
        outermost = (F.col(depth) - F.when(opened, 1).otherwise(0)) <= 0
        sign = lit(EMPHASIS[tags[0]])
        piece = F.when(outermost, inline(depth, sign, sign)).otherwise("")
        emphasis = F.when(H.one_of("tag", tags), piece) if emphasis is None else emphasis.when(H.one_of("tag", tags), piece)

    # ---- blocks
    def block(mark_: str = BLOCK) -> Column:
        return F.when(flat, " ").otherwise(mark(mark_))

    hashes = F.repeat(lit("#"), F.substring(tag, 2, 1).cast("int"))
    # Markdown numbers items from 0 to 999999999
    ordinal = F.least(F.greatest(F.col("items") - F.coalesce("item_base", lit(0)) + F.coalesce("list_from", lit(1)) - 1, lit(0)), lit(999_999_999))
    task = F.lower(F.coalesce(H.attr("type"), lit(""))) == "checkbox"
    marker = F.when(F.col("list_tag") == "ol", F.concat(ordinal.cast("string"), lit(". "))).otherwise("- ")
    in_table = F.col("tables") == 1
    # the end event of a table has left it already
    outermost = F.col("tables") == F.when(opened, 1).otherwise(0)
    span = lambda name: F.coalesce(F.regexp_extract(F.coalesce(H.attr(name), lit("")), r"^\s*0*([0-9]{1,4})", 1), lit(""))
    spans = F.concat(span("colspan"), lit(","), span("rowspan"))
    other_blocks = [t for t in H.BLOCK if t not in _SPECIAL] + ["caption"]

    return (
        F.when(F.col("boundary"), " ")
        .when(is_text, F.when(verbatim, pre_text).otherwise(plain))
        .when(tag == "br", F.when(verbatim, mark(LINE)).when(flat, " ").otherwise(mark(BREAK)))
        .when(tag == "hr", F.when(flat, " ").otherwise(F.concat(mark(BLOCK), lit("---"), mark(BLOCK))))
        .when(tag == "img", F.coalesce(image, lit("")))
        .when((tag == "input") & void & task & (lists > 0) & ~in_pre, F.when(H.attr("checked").isNull(), "[ ] ").otherwise("[x] "))
        .when(void | ~H.one_of("kind", ("open", "end")), "")
        .when(
            tag == "pre",
            F.when(flat | in_pre, " ")
            .when(opened, F.concat(mark(BLOCK), lit("```" + FENCE), pfx,
                                   F.when(F.coalesce(language, lit("")) != "", lang_mark).otherwise("")))
            .otherwise(F.concat(lit(FENCE_END), pfx, lit("```"), mark(BLOCK))),
        )
        .when((tag == "code") & verbatim, F.when(opened, lang_mark).otherwise(""))
        .when(verbatim & H.one_of("tag", (*EMPHASIS, "a")), "")
        .when(tag == "code", F.when((F.col("code") - F.when(opened, 1).otherwise(0)) > 0, "").otherwise(
            inline("code", lit("`"), lit("`"))))
        .when(H.one_of("tag", EMPHASIS), emphasis)
        .when(tag == "a", F.when(href.isNull(), "").otherwise(inline("a", lit("["), link_end)))
        .when(H.one_of("tag", HEADINGS), F.when(flat, " ").when(opened, F.concat(mark(BLOCK), hashes, lit(" ")))
              .otherwise(mark(BLOCK)))
        .when(tag == "blockquote", block(CUT))
        .when(H.one_of("tag", LISTS), F.when(flat, " ").when((lists - F.when(opened, 1).otherwise(0)) > 0, mark(SOFT))
              .otherwise(mark(BLOCK)))
        .when(tag == "li", F.when(flat, " ").when(opened, F.concat(lit(SOFT), item_pfx, marker, lit(GLUE)))
              .otherwise(ITEM_END))
        .when(tag == "table", F.when(flat | ~outermost, block()).when(opened, F.concat(mark(BLOCK), lit(TABLE))).otherwise(F.concat(lit(TABLE_END), mark(BLOCK))))
        .when(tag == "tr", F.when(flat | ~in_table, " ").when(opened, F.concat(lit(ROW), pfx)).otherwise(""))
        .when(H.one_of("tag", H.CELL), F.when(flat | ~in_table, " ").when(opened, F.concat(lit(CELL), spans, lit(CELL_TEXT))).otherwise(" "))
        .when(H.one_of("tag", other_blocks), block())
        .otherwise("")
    )


def _cells(row: Column) -> Column:
    """``across, down, text`` of the cells of a row; what stands before the first one belongs to it."""

    def cell(text: Column, i: Column) -> Column:
        number = lambda k: F.regexp_extract(text, rf"\A([0-9]*),([0-9]*){CELL_TEXT}", k).try_cast("int")
        across, down = F.greatest(F.coalesce(number(1), F.lit(1)), F.lit(1)), F.coalesce(number(2), F.lit(1))
        return F.struct(
            F.least(across, F.lit(MOST_SPAN)).alias("across"), F.when(down == 0, MOST_SPAN).otherwise(F.least(down, F.lit(MOST_SPAN))).alias("down"),
            F.concat(F.when(i == 0, before).otherwise(""), F.regexp_replace(text, rf"\A[^{CELL_TEXT}]*+{CELL_TEXT}", "")).alias("text"))

    parts = F.split(row, CELL, -1)
    before = F.regexp_replace(F.get(parts, F.lit(0)), f"[{QUOTE}{INDENT}]", "")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), cell)


def _placed(rows: Column) -> Column:
    """Cells of every row in their columns: a fold over rows, in which each column knows how many more rows are taken by a cell above."""
    ints, texts = F.array().cast("array<int>"), F.array().cast("array<string>")
    grid = lambda taken, lines, width: F.struct(taken.alias("taken"), lines.alias("lines"), width.alias("width"))

    def place(line: Column, cell: Column, taken: Column) -> Column:
        """The next cell goes to the first column that is free."""
        at = F.size(line["texts"])
        free = F.filter(F.sequence(at, F.greatest(F.size(taken), at)), lambda j: F.coalesce(F.get(taken, j), F.lit(0)) <= 0)[0]
        return F.struct(
            F.concat(line["texts"], F.array_repeat(F.lit(""), free - at), F.array(cell["text"]), F.array_repeat(F.lit(""), cell["across"] - 1)).alias("texts"),
            F.concat(line["down"], F.array_repeat(F.lit(0), free - at), F.array_repeat(cell["down"] - 1, cell["across"])).alias("down"), (free + 1).alias("width"))

    def add(state: Column, row: Column) -> Column:
        empty = F.struct(texts.alias("texts"), ints.alias("down"), F.lit(0).alias("width"))
        line = F.aggregate(row, empty, lambda known, cell: place(known, cell, state["taken"]))
        return let(line, lambda own: grid(
            F.zip_with(state["taken"], own["down"], lambda a, b: F.greatest(F.coalesce(a, F.lit(0)) - 1, F.coalesce(b, F.lit(0)))),
            F.array_append(state["lines"], own["texts"]), F.greatest(state["width"], own["width"])))

    return F.aggregate(rows, grid(ints, F.array().cast("array<array<string>>"), F.lit(0)), add)


def _table(text: Column) -> Column:
    """A table's rows as lines of one width, which is that of the last column a cell begins in."""
    parts = F.split(F.translate(text, TABLE + TABLE_END, ""), ROW, -1)
    rows = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    prefix = F.regexp_extract(F.coalesce(F.get(rows, F.lit(0)), F.lit("")), f"\\A([{QUOTE}{INDENT}]*+)", 1)

    def lines(grid: Column) -> Column:
        start = F.concat(F.lit(SOFT), prefix, F.lit("|"))
        shown = F.transform(grid["lines"], lambda line: F.concat(start, F.array_join(F.transform(
            F.sequence(F.lit(0), grid["width"] - 1), lambda j: F.concat(F.lit(" "), F.coalesce(F.get(line, j), F.lit("")), F.lit(" |"))), "")))
        rule = F.concat(start, F.repeat(F.lit(" --- |"), grid["width"]))
        return F.when(grid["width"] > 0, F.array_join(F.concat(F.slice(shown, 1, 1), F.array(rule), F.slice(shown, 2, F.size(shown))), "")).otherwise("")

    return F.concat(F.get(parts, F.lit(0)), let(_placed(F.transform(rows, _cells)), lines))


def _settle(c: Column) -> Column:
    """Turn concatenated pieces into Markdown: every step is one linear pass."""
    c = F.when(c.contains(TABLE), replace_each(c, f"{TABLE}[^{TABLE_END}]*+{TABLE_END}", _table)).otherwise(c)
    pre, brk = f"[{QUOTE}{INDENT}]", f"[{BREAK}{SOFT}{BLOCK}{CUT}]"
    space, sign = f"(?:[ ]|{brk}{pre}*+)++", "(?:\\*\\*|_|~~|`)"
    steps = [
        # code fences: first language mark wins, one line end after the opening and before the closing
        (f"{FENCE}({pre}*+)(?:[ ]*+{LANG}([^{LANG}]*+){LANG})?+(?:{LANG}[^{LANG}]*+{LANG})*+(?:{LINE}{pre}*+)?+",
         f"$2{LINE}$1"),
        (f"{LANG}[^{LANG}]*+{LANG}", ""),
        (f"(?:{LINE}{pre}*+)?+{FENCE_END}", LINE),
        # inline marks: one that ends where it begins again goes on, none are around nothing, and no blanks just inside
        *[(f"{CLOSER}({sign}){CLOSED}{OPENER}\\1{OPENED}", "")] * 3,
        *[(f"{OPENER}{sign}{OPENED}{CLOSER}[^{CLOSED}]*+{CLOSED}", "")] * 2,
        (f"{OPENER}{sign}{OPENED}{space}{CLOSER}[^{CLOSED}]*+{CLOSED}", " "),
        (f"{OPENER}([^{OPENED}]*+){OPENED}({space})", f"$2{OPENER}$1{OPENED}"),
        (f"{OPENER}([^{OPENED}]*+){OPENED}({space})", f"$2{OPENER}$1{OPENED}"),
        (f"({space}){CLOSER}([^{CLOSED}]*+){CLOSED}", f"{CLOSER}$2{CLOSED}$1"),
        (f"({space}){CLOSER}([^{CLOSED}]*+){CLOSED}", f"{CLOSER}$2{CLOSED}$1"),
        (f"[{OPENER}{OPENED}{CLOSER}{CLOSED}]", ""),
        # list markers and their text stay on one line
        (f"{GLUE}(?:{space})?+", ""),
        (ITEM_END, ""),
        # runs of breaks: the strongest one counts, with the prefix of the last
        (f"[ ]*({brk}{pre}*+)[ ]*", "$1"),
        (f"(?:[{BREAK}{SOFT}{BLOCK}]{pre}*+)*+{CUT}(?:{pre}*+{brk})*+({pre}*+)", f"{CUT}$1"),
        (f"(?:[{BREAK}{SOFT}]{pre}*+)*+{BLOCK}(?:{pre}*+[{BREAK}{SOFT}{BLOCK}])*+({pre}*+)", f"{BLOCK}$1"),
        (f"(?:{BREAK}{pre}*+)*+{SOFT}(?:{pre}*+[{BREAK}{SOFT}])*+({pre}*+)", f"{SOFT}$1"),
        (f"\\A(?:[ {QUOTE}{INDENT}]*+{brk})++({pre}*+)", "$1"),
        (f"[ {BREAK}-{CUT}](?<![ {BREAK}-{INDENT}]{{2}})[ {BREAK}-{INDENT}]*+\\z", ""),
        (r"\A +| (?= )", ""),
        (f"{CUT}({pre}*+)", "\n\n$1"),
        (f"{BLOCK}({pre}*+)", "\n$1\n$1"),
        (f"[{SOFT}{BREAK}{LINE}]", "\n"),
    ]
    for pattern, replacement in steps:
        c = F.regexp_replace(c, pattern, replacement)
    c = F.replace(F.replace(c, F.lit(QUOTE), F.lit("> ")), F.lit(INDENT), F.lit("  "))
    return tidy_markdown(F.translate(c, BLANK, " "))


def content_pieces(
    rows: DataFrame, *, sanitize_html: bool | Column = True, preserve_images: bool | Column = False,
    absolute_base: Column | None = None, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Add ``piece``, what each content row of a page stream contributes to the Markdown.

    Rows of elements that sanitizing removes stay: of a block element the boundary is left, as of any plain
    block, of others nothing.
    """
    sanitized = sanitize_html if isinstance(sanitize_html, Column) else F.lit(sanitize_html)
    removed = sanitized & F.coalesce(
        (F.col("part") == "content") & H.one_of("kind", ("open", "end", "void")) & ~F.col("boundary") & ~is_allowed(preserve_images), F.lit(False))
    block = H.one_of("tag", tuple(t for t in H.BLOCK if t not in ALLOWED) + ("caption",)) & (F.col("kind") != "void")
    # A match's own start is not part of what it contains, so it takes no part in the context.
    hidden = F.col("boundary") | (removed & ~block)
    shown = rows.withColumns({
        "kind": F.when(hidden, "mark").otherwise(F.col("kind")),
        "tag": F.when(removed, F.when(block, "div").otherwise("")).otherwise(F.col("tag")),
    })
    return _context(shown, keys).withColumn("piece", _pieces(absolute_base, sanitized))


def convert(
    pages: DataFrame,
    *,
    title: str | None = DEFAULT_TITLE,
    content: str = DEFAULT_CONTENT,
    exclude: Sequence[str] = (),
    rules: int | None = None,
    sanitize_html: bool = True,
    preserve_images: bool = False,
    absolute_links: bool = False,
    outermost_only: bool = False,
    links: bool = False,
    keys: Sequence[str] = KEYS,
    carry: Sequence[str] = ("url",),
    partitions: int | None = None,
) -> DataFrame:
    """``keys, carry, title, content_length, body`` of every page with content.

    Title, content and Markdown come out of one pass over the token stream: one exchange. With ``links`` so do
    the links left on the page, as an array, and its ``<base href>``. With ``rules`` (see :func:`page_stream`) pages bring
    their selectors along, and columns ``sanitize_html`` and ``preserve_images``. Whether a page has content, and how many bytes, is measured on its
    source, before sanitizing. Pages without content (no match, or only blank ones) are not in the result.
    """
    own = ("sanitize_html", "preserve_images") if rules is not None else ()
    rows = page_stream(
        pages, title=title or "title", content=content, exclude=exclude, rules=rules, keys=keys, carry=(*carry, *own),
        outermost_only=outermost_only, links=links, partitions=partitions,
    )
    src = F.when((F.col("part") == "content") & ~F.col("boundary"), source_text())
    measured = title_text(rows).withColumns({
        "bytes": F.octet_length(src), "visible": trim_space(src) != "",
        "link": F.when(F.col("part").isin("link", "base"), H.attr("href")) if links else F.lit(None).cast("string"),
    })
    pieces = content_pieces(
        measured, sanitize_html=F.col("sanitize_html") if own else sanitize_html, preserve_images=F.col("preserve_images") if own else preserve_images,
        absolute_base=F.col("url") if absolute_links else None, keys=keys,
    )
    slim = pieces.select(
        *keys, *carry, "part", "boundary", "match_pos", "ord", "txt", "piece", "bytes", "visible", "link",
    )
    # a page's carried columns are the same in all its rows, so they need not be grouping keys
    per_page = slim.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carry],
        *title_columns(),
        ordered_concat("piece", "", "part = 'content' AND piece <> ''", "match_pos", "ord").alias("pieces"),
        F.sum("bytes").alias("content_length"),
        *([
            F.collect_set(F.when(F.col("part") == "link", F.col("link"))).alias("links"),
            F.min_by("link", F.when((F.col("part") == "base") & F.col("link").isNotNull(), F.col("ord"))).alias("base"),
        ] if links else []),
        F.bool_or("visible").alias("has_content"),
    )
    return per_page.filter("has_content").select(
        *keys, *carry, pick_title().alias("title"), "content_length",
        F.coalesce(_settle(F.col("pieces")), F.lit("")).alias("body"), *(["links", "base"] if links else []),
    )


def metadata_header(url: Column, title: Column, depth: Column) -> Column:
    """Comment lines that name the source of a page."""
    return F.concat(
        F.lit("<!-- Source: "), url, F.lit(" -->\n<!-- Title: "), title,
        F.lit(" -->\n<!-- Depth: "), depth.cast("string"), F.lit(" -->"),
    )


def with_metadata(body: Column, url: Column, title: Column, depth: Column) -> Column:
    """Markdown of a page with its metadata header."""
    return F.concat(metadata_header(url, title, depth), F.lit("\n\n"), body)
