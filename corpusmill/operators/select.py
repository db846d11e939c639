"""CSS selection, content extraction and titles over element events."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusmill.functions.regex import trim_space
from corpusmill.functions import html as H
from corpusmill.functions.text import clean_title
from corpusmill.operators.rules import CONTENT, EXCLUDE, TITLE, attribute_test, flag_by_hits, token_hits
from corpusmill.operators.tokens import KEYS, close_elements, events, is_added, source_text, tokenize

# What is looked for when a specification names no selector.
DEFAULT_TITLE = "h1"
DEFAULT_CONTENT = "main, article, .content"

_PART = re.compile(
    r"""([A-Za-z][\w-]*|\*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?)=\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+)))?\s*\]"""
)


def _compound(text: str) -> Column:
    """Predicate over an element event for one step such as ``div.note[role='main']``."""
    raw = F.col("text")
    conditions, end = [], 0
    for m in _PART.finditer(text):
        if m.start() != end:
            break
        end = m.end()
        tag, cls, ident, attr = m.group(1, 2, 3, 4)
        if tag:
            conditions.append(F.lit(True) if tag == "*" else F.col("tag") == tag.lower())
        elif cls:
            conditions.append(_has_class(raw, cls))
        elif ident:
            conditions.append(raw.contains(ident) & (H.attr("id") == ident))
        else:
            value = next((v for v in m.group(6, 7, 8) if v is not None), None)
            found = H.attr(re.escape(attr.lower()))
            conditions.append(found.isNotNull() if value is None else attribute_test(found, F.lit(m.group(5)), F.lit(value)))
    if end != len(text) or not conditions:
        raise ValueError(f"unsupported selector: {text!r}")
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))


def _has_class(raw: Column, name: str) -> Column:
    # The plain substring test spares nearly every tag the attribute pattern.
    boundary = r"[\t\n\f\r ]"
    return raw.contains(name) & H.attr("class").rlike(rf"(?:^|{boundary}){re.escape(name)}(?:\z|{boundary})")


def parse_selector(selector: str) -> list[list[str]]:
    """Comma groups, each a list of steps from ancestor to element."""
    groups = []
    for group in re.split(r",(?![^\[]*\])", selector):
        steps = re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", group.strip())
        if steps:
            groups.append(steps)
    return groups


def _is_event() -> Column:
    return H.one_of("kind", ("open", "end", "void", "raw"))


def _step(flag: Column) -> Column:
    """+1 where a flagged element starts, -1 where it ends."""
    return F.when(flag & (F.col("kind") == "open"), 1).when(flag & (F.col("kind") == "end"), -1).otherwise(0)


def _stream(keys: Sequence[str]) -> W:
    return W.partitionBy(*keys).orderBy("ord")


def flag_elements(stream: DataFrame, selectors: dict[str, str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Add one boolean column per selector; both events of a matching element are flagged."""
    before = _stream(keys).rowsBetween(W.unboundedPreceding, -1)
    columns = list(stream.columns)
    simple: dict[str, list[Column]] = {}
    chains: list[tuple[str, list[str]]] = []
    for name, selector in selectors.items():
        parsed = parse_selector(selector)
        simple[name] = [_compound(steps[0]) for steps in parsed if len(steps) == 1]
        chains += [(name, steps) for steps in parsed if len(steps) > 1]

    # A descendant step holds where an element of the step before it is open.
    for number, (name, steps) in enumerate(chains):
        flag = f"_chain{number}"
        stream = stream.withColumn(flag, _is_event() & _compound(steps[0]))
        for step in steps[1:]:
            opened = F.coalesce(F.sum(_step(F.col(flag))).over(before), F.lit(0))
            here = stream.withColumn("_inside", (opened > 0) & (F.col("kind") != "end"))
            here = here.withColumn(flag, F.col("_inside") & _is_event() & _compound(step)).drop("_inside")
            # Ends take the answer of their start, so that starts and ends always balance.
            stream = here.withColumn(flag, F.max(flag).over(W.partitionBy(*keys, "open_pos")))
            stream = stream.withColumn(flag, F.col(flag) & _is_event())
        simple[name].append(F.col(flag))

    flags = [
        (_is_event() & reduce(lambda a, b: a | b, conds, F.lit(False))).alias(name)
        for name, conds in simple.items()
    ]
    return stream.select(*columns, *flags)


def select(pages: DataFrame, selector: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, open_pos, tag, attrs`` of the elements a selector matches, in document order."""
    stream = events(close_elements(tokenize(pages, keys), keys), keys)
    return (
        flag_elements(stream, {"hit": selector}, keys)
        .filter(F.col("hit") & (F.col("kind") != "end") & ~is_added())
        .select(*keys, "open_pos", "tag", H.attributes(F.col("text")).alias("attrs"))
    )


def page_stream(
    pages: DataFrame,
    *,
    title: str | None = DEFAULT_TITLE,
    content: str | None = DEFAULT_CONTENT,
    exclude: Sequence[str] = (),
    rules: int | None = None,
    keys: Sequence[str] = KEYS,
    carry: Sequence[str] = (),
    links: bool = False,
    outermost_only: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """The rows of every page that its title, its content and its links are made of.

    With ``rules`` (the length of their longest chain) every page brings its own selectors, as a column of that name made by
    :func:`corpusmill.operators.rules.rules`, and those given here are not looked at.

    ``part`` is ``page`` (one row per page), ``title``, ``<title>``, ``content``, ``link`` or ``base``. ``level`` and ``match_pos`` name the
    selected element a row belongs to: a row inside nested matches is repeated once per match,
    because each match contributes its own text. A content row is left out when it lies in an
    excluded element below its match; a link when it lies in one below any content match.
    ``boundary`` rows mark the start of a match.
    """
    given = (("rules",), lambda tokens: token_hits(tokens, F.col("rules"))) if rules is not None else None
    stream = events(close_elements(tokenize(pages, keys, carry, given, partitions), keys), keys)
    if rules is not None:
        title = content = "by rules"
        stream = flag_by_hits(stream, {TITLE: "is_title", CONTENT: "is_content", EXCLUDE: "is_excluded"}, rules, keys)
        selectors = {}
    else:
        selectors = {"is_title": title, "is_content": content, "is_excluded": ", ".join(exclude)}
    selectors["is_page_title"] = "title" if title else None
    stream = flag_elements(stream, {name: text for name, text in selectors.items() if text}, keys)
    for name in ("is_title", "is_content", "is_excluded"):
        if name not in stream.columns:
            stream = stream.withColumn(name, F.lit(False))

    kind = F.col("kind")
    upto = _stream(keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = {n: F.sum(_step(F.col(f"is_{n}"))).over(upto) for n in ("title", "content", "excluded")}
    # An excluded element covers its own events as well; void and raw-text ones are their own region.
    stream = stream.select("*", *[c.alias(f"{n}_depth") for n, c in running.items()]).withColumn(
        "excluded_depth",
        F.col("excluded_depth") + F.when(F.col("is_excluded") & (kind != "open"), 1).otherwise(0),
    )
    starts = F.col("is_content") & (kind == "open")
    outer_excluded = F.last(
        F.when(starts & (F.col("content_depth") == 1), F.col("excluded_depth")), ignorenulls=True
    ).over(upto)
    stream = stream.withColumn("outer_excluded", outer_excluded)

    def levels(part: str, depth: Column, wanted: Column) -> Column:
        entry = lambda k: F.struct(F.lit(part).alias("part"), k.alias("level"))
        some = F.transform(F.sequence(F.lit(1), depth), entry)
        return F.when(wanted & (depth > 0), some).otherwise(F.array().cast("array<struct<part:string,level:int>>"))

    content_levels = F.col("content_depth").cast("int")
    if outermost_only:
        content_levels = F.least(content_levels, F.lit(1))
    title_levels = F.col("title_depth").cast("int")
    is_text = H.one_of("kind", ("text", "raw"))
    parts = [levels("page", F.lit(1), (F.col("open_pos") == 0) & (kind != "end") & ~is_added())]
    if title:
        # A raw-text element can itself be the match; it then has no level of its own.
        parts.append(levels("title", title_levels, is_text | (F.col("is_title") & (kind == "open"))))
        parts.append(levels("title", F.lit(1), F.col("is_title") & (kind == "raw") & (title_levels == 0)))
        parts.append(levels("<title>", F.lit(1), F.col("is_page_title") & (kind == "raw")))
    if content:
        parts.append(levels("content", content_levels, F.lit(True)))
    if links:
        in_removed = (F.col("content_depth") > 0) & (F.col("excluded_depth") > F.col("outer_excluded"))
        parts.append(
            levels("link", F.lit(1),
                   (kind == "open") & ~is_added() & (F.col("tag") == "a") & (F.coalesce(H.attr("href"), F.lit("")) != "")
                   & ~F.coalesce(in_removed, F.lit(False)))
        )
        parts.append(levels("base", F.lit(1), (kind == "void") & (F.col("tag") == "base")))
    spread = stream.select(
        *keys, *carry, "ord", "kind", "tag", "open_pos", "text", "explicit_close", "excluded_depth",
        "is_title", "is_content", "title_depth", "content_depth", F.explode(F.concat(*parts)).alias("p"),
    ).select("*", "p.part", "p.level").drop("p")

    boundary = (kind == "open") & (
        ((F.col("part") == "content") & F.col("is_content") & (F.col("level") == F.col("content_depth")))
        | ((F.col("part") == "title") & F.col("is_title") & (F.col("level") == F.col("title_depth")))
    )
    spread = spread.withColumn("boundary", boundary)
    in_match = part_window(keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.last(
        F.when(F.col("boundary"), F.struct(F.col("ord").alias("pos"), F.col("excluded_depth").alias("excluded"))),
        ignorenulls=True,
    ).over(in_match)
    return (
        spread.withColumn("start", start)
        .filter(
            (F.col("part") != "content") | F.col("boundary")
            | (F.col("excluded_depth") <= F.col("start.excluded"))
        )
        .select(
            *keys, *carry, "part", "level",
            F.coalesce(F.col("start.pos"), F.col("ord")).alias("match_pos"), "boundary",
            "ord", "kind", "tag", "open_pos", "text", "explicit_close",
        )
    )


def base_href() -> Column:
    """Aggregate over the rows of a page stream with links: the href of the first ``<base>``."""
    is_base = (F.col("part") == "base") & H.attr("href").isNotNull()
    return F.min_by(F.when(is_base, H.attr("href")), F.when(is_base, F.col("ord")))


def part_window(keys: Sequence[str] = KEYS) -> W:
    """Rows of one part of a page at one nesting level, in document order."""
    return W.partitionBy(*keys, "part", "level").orderBy("ord")


def ordered_concat(value: str, separator: str, condition: str, *order: str) -> Column:
    """Concatenate a column in a given order, over the rows where ``condition`` holds."""
    return F.expr(
        f"listagg({value}, '{separator}') WITHIN GROUP (ORDER BY {', '.join(order)}) FILTER (WHERE {condition})"
    )


def title_text(rows: DataFrame) -> DataFrame:
    """Add ``txt``, the decoded text of each row of a page stream."""
    return rows.withColumn("txt", H.token_text())


def title_columns() -> list[Column]:
    """Aggregates ``selected_title`` and ``page_title`` over rows with ``txt``."""
    order = ("match_pos", "ord")
    return [
        ordered_concat("txt", "", "part = 'title' AND NOT boundary", *order).alias("selected_title"),
        ordered_concat("txt", "", "part = '<title>'", *order).alias("page_title"),
    ]


def pick_title() -> Column:
    """The selected text, else the text of ``<title>``, else ``Untitled``; cleaned."""
    selected = trim_space(F.col("selected_title"))
    page = trim_space(F.col("page_title"))
    return (
        F.when(F.coalesce(selected, F.lit("")) != "", clean_title(selected))
        .when(F.coalesce(page, F.lit("")) != "", clean_title(page))
        .otherwise("Untitled")
    )


def page_titles(
    pages: DataFrame, selector: str | None = DEFAULT_TITLE, keys: Sequence[str] = KEYS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``keys, carry, title`` for every page."""
    if not selector:
        selector = "title"
    rows = title_text(page_stream(pages, title=selector, content=None, keys=keys, carry=carry))
    return rows.groupBy(*keys, *carry).agg(*title_columns()).select(*keys, *carry, pick_title().alias("title"))


def main_content(
    pages: DataFrame,
    content: str = DEFAULT_CONTENT,
    exclude: Sequence[str] = (),
    keys: Sequence[str] = KEYS,
    outermost_only: bool = False,
) -> DataFrame:
    """``keys, content``: inner HTML of the content matches, without excluded elements.

    Blank matches are skipped, the others joined by an empty line in document order. Pages
    without content are not in the result.
    """
    rows = page_stream(
        pages, title=None, content=content, exclude=exclude, keys=keys, outermost_only=outermost_only
    )
    rows = rows.withColumn("src", source_text()).filter("part = 'content' AND src <> ''")
    per_match = rows.groupBy(*keys, "match_pos").agg(
        ordered_concat("src", "", "part = 'content' AND NOT boundary", "ord").alias("html")
    )
    return (
        per_match.filter(trim_space(F.col("html")) != "")
        .groupBy(*keys)
        .agg(F.expr("listagg(html, '\\n\\n') WITHIN GROUP (ORDER BY match_pos)").alias("content"))
    )
