"""Pages as token rows, and element intervals over them.

A page is one row, so the only exchange in the whole HTML pipeline moves the *compressed-size*
html column: :func:`tokenize` distributes by the page key before it explodes. Every later window
and aggregation partitions by the page key plus something else, which that distribution already
satisfies, so none of them shuffles again. A table bucketed by the page key needs no exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusmill.functions import html as H

KEYS = ("page_id",)

# Bytes of html in a partition. Tokens of a page take many times its bytes in every sort, so a task's memory grows with them.
PARTITION_BYTES = 8 << 20


def html_partitions(pages: DataFrame, size: Column | None = None) -> int:
    """Into how many partitions pages are dealt, so that each has about ``PARTITION_BYTES`` of html; 0: as many as Spark finds right.

    Spark makes as many partitions as there are cores and lets them grow with the input, up to a size of compressed html that is far too large here.
    The bytes are summed by a job that reads the html, or ``size``; few pages and streams are left to Spark.
    """
    if pages.isStreaming:
        return 0
    total = pages.agg(F.sum(F.octet_length("html") if size is None else size)).first()[0] or 0
    n = -(-total // PARTITION_BYTES)
    return n if n > pages.sparkSession.sparkContext.defaultParallelism else 0


def by_page(pages: DataFrame, key: str, partitions: int) -> DataFrame:
    """Pages distributed by ``key``."""
    return pages.repartition(partitions, key) if partitions else pages.repartition(key)


def tokenize(
    pages: DataFrame, keys: Sequence[str] = KEYS, carry: Sequence[str] = (), extra: tuple[Sequence[str], Callable[[Column], Column]] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``keys, carry, n_tokens, pos, kind, tag, text``: one row per token of ``html``.

    ``extra`` adds a column ``hits``: names of columns of ``pages``, and what they and the array of all tokens make for every token.

    ``keys`` must identify a page. Rows are distributed by the last key alone, which serves every
    grouping by all of them, so that input already distributed by it (a bucketed table, a join by
    page) is not moved again. ``partitions`` are counted by :func:`html_partitions` unless given. The texts of a page, joined by
    ``pos``, give back its html.
    """
    # The outer form keeps the optimizer from adding a "has tokens" filter, which would run the
    # pattern a second time; a page without tokens yields one empty text token.
    needed, per_token = extra or ((), None)
    split = (
        by_page(pages.select(*keys, *carry, *needed, "html"), keys[-1], html_partitions(pages) if partitions is None else partitions)
        .select(*keys, *carry, *needed, F.regexp_extract_all("html", F.lit(H.TOKEN), F.lit(0)).alias("tokens"))
        .withColumn("n_tokens", F.greatest(F.size("tokens"), F.lit(1)))
    )
    if extra:
        exploded = split.withColumn("all", F.arrays_zip(F.col("tokens").alias("text"), per_token(F.col("tokens")).alias("hits"))).select(
            *keys, *carry, "n_tokens", F.posexplode_outer("all").alias("pos", "t")).select(*keys, *carry, "n_tokens", "pos", "t.text", "t.hits")
    else:
        exploded = split.select(*keys, *carry, "n_tokens", F.posexplode_outer("tokens").alias("pos", "text"))
    exploded = exploded.withColumns({"pos": F.coalesce("pos", F.lit(0)), "text": F.coalesce("text", F.lit(""))})
    tagged = exploded.withColumn("tag", H.token_tag(F.col("text")))
    return tagged.select(
        *keys, *carry, "n_tokens", "pos", H.token_kind(F.col("text"), F.col("tag")).alias("kind"), "tag", "text", *(["hits"] if extra else []),
    )


def with_attributes(tokens: DataFrame) -> DataFrame:
    """Add ``attrs``, the attribute map of start tags."""
    is_start = H.one_of("kind", ("open", "void", "raw"))
    return tokens.withColumn("attrs", F.when(is_start, H.attributes(F.col("text"))))


def _is_start(*tags: str) -> Column:
    return (F.col("kind") == "open") & H.one_of("tag", tags)


def _is_end(*tags: str) -> Column:
    return (F.col("kind") == "close") & H.one_of("tag", tags)


def close_elements(tokens: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Tokens without end tags; start tags get ``close_pos`` and ``explicit_close``.

    ``close_pos`` is the position of the token that ends the element: its end tag
    (``explicit_close``), the token that implies the end, or the number of tokens. Inner tokens
    are those strictly between. Void and raw-text elements close where they open.

    * Elements other than those with optional end tags are matched like brackets, tag by tag.
    * ``p li dt dd td th tr thead tbody tfoot`` and inline elements that were never closed end
      at the next token that cannot be inside them, at the same container level.
    * Other unclosed elements end with the element around them.
    """
    kind, tag, pos = F.col("kind"), F.col("tag"), F.col("pos")
    upto = (W.unboundedPreceding, W.currentRow)
    before = (W.unboundedPreceding, -1)

    # Bracket matching. An element's start and end see the same level, so they are neighbours
    # in the partition of that level.
    paired = H.one_of("kind", ("open", "close")) & ~H.one_of("tag", H.IMPLIED_END)
    step = F.when(paired, F.when(kind == "open", 1).otherwise(-1))
    by_tag = W.partitionBy(*keys, "tag").orderBy("pos")
    marked = tokens.withColumn(
        "tag_level", F.sum(step).over(by_tag.rowsBetween(*upto)) + F.when(kind == "close", 1).otherwise(0)
    )
    by_level = W.partitionBy(*keys, "tag", "tag_level").orderBy("pos")
    matched = marked.select(
        "*",
        F.when(paired, F.lead("kind").over(by_level)).alias("next_kind"),
        F.when(paired, F.lag("kind").over(by_level)).alias("prev_kind"),
        F.when(paired, F.lead("pos").over(by_level)).alias("next_pos"),
    ).select(
        *tokens.columns,
        F.when((kind == "open") & (F.col("next_kind") == "close"), F.col("next_pos")).alias("end_tag_pos"),
        F.coalesce(
            paired & ~H.one_of("tag", H.INLINE)
            & F.when(kind == "open", F.col("next_kind") == "close").otherwise(F.col("prev_kind") == "open"),
            F.lit(False),
        ).alias("container"),
    )

    # Container level: how many matched containers are open just before the token.
    in_page = W.partitionBy(*keys).orderBy("pos").rowsBetween(*before)
    container_step = F.when(F.col("container"), F.when(kind == "open", 1).otherwise(-1)).otherwise(0)
    leveled = matched.withColumn("container_depth", F.coalesce(F.sum(container_step).over(in_page), F.lit(0)))

    # Optional ends: the nearest following token of a family at the same container level.
    # Reading backwards, "nearest following" is a running last value.
    table_part = H.CELL + H.ROW + H.ROW_GROUP
    around = F.col("container") & (kind == "close")
    part = H.one_of("tag", table_part) & H.one_of("kind", ("open", "close"))
    item = H.one_of("tag", H.LIST_ITEM) & H.one_of("kind", ("open", "close"))
    definition = H.one_of("tag", H.DEFINITION) & H.one_of("kind", ("open", "close"))
    stops = {
        "p": around | _is_start(*H.BLOCK) | _is_end(*H.IMPLIED_END),
        "li": around | part | item,
        "def": around | part | definition,
        "cell": around | part,
        "row": around | (part & ~H.one_of("tag", H.CELL)),
        "group": around | (part & H.one_of("tag", H.ROW_GROUP)),
        "other": around | part | item | definition,
    }
    own = {
        "p": ("p",), "li": H.LIST_ITEM, "def": H.DEFINITION, "cell": H.CELL, "row": H.ROW,
        "group": H.ROW_GROUP, "other": (),
    }
    back = W.partitionBy(*keys, "container_depth").orderBy(F.desc("pos")).rowsBetween(*before)

    def nearest(name: str) -> Column:
        # Twice the position, plus one when the stop is the family's own end tag: a running
        # value of a primitive type is much cheaper than one of a struct.
        code = F.col("pos").cast("bigint") * 2 + F.when(_is_end(*own[name]), 1).otherwise(0)
        return F.last(F.when(stops[name], code), ignorenulls=True).over(back).alias(f"stop_{name}")

    stop = (
        F.when(H.one_of("tag", H.LIST_ITEM), F.col("stop_li"))
        .when(H.one_of("tag", H.DEFINITION), F.col("stop_def"))
        .when(H.one_of("tag", H.CELL), F.col("stop_cell"))
        .when(H.one_of("tag", H.ROW), F.col("stop_row"))
        .when(H.one_of("tag", H.ROW_GROUP), F.col("stop_group"))
        .when((tag == "p") | H.one_of("tag", H.INLINE), F.col("stop_p"))
        .otherwise(F.col("stop_other"))
    )
    return (
        leveled.select(*tokens.columns, "end_tag_pos", *[nearest(name) for name in stops])
        .filter(kind != "close")
        .withColumn("stop", F.when(kind == "open", stop))
        .select(
            *tokens.columns,
            F.when(
                kind == "open",
                F.coalesce(
                    F.col("end_tag_pos"), F.shiftright("stop", 1).cast("int"), F.col("n_tokens")
                ),
            ).when(H.one_of("kind", ("void", "raw")), pos).alias("close_pos"),
            F.when(
                kind == "open",
                F.col("end_tag_pos").isNotNull()
                | (H.one_of("tag", H.IMPLIED_END) & (F.coalesce(F.col("stop"), F.lit(0)) % 2 == 1)),
            ).alias("explicit_close"),
        )
    )


def elements(pages: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, open_pos, close_pos, explicit_close, tag, id, classes, attrs``: one row per element.

    Intervals nest. An inline element that crosses the end of another one is several rows: the first one begins at its start
    tag, each further one at the token that cut it, and only the last one can be closed explicitly.
    """
    closed = with_attributes(close_elements(tokenize(pages, keys), keys)).filter(F.col("close_pos").isNotNull())
    starts = _cuts(_element_events(closed), keys).filter("kind <> 'end'")
    cuts = F.coalesce("cuts", F.array().cast("array<int>"))
    pieces = F.arrays_zip(
        F.concat(F.array("open_pos"), cuts).alias("start"), F.concat(cuts, F.array("close_pos")).alias("end"))
    attrs = F.col("attrs")
    return starts.withColumn("n", F.size(cuts)).select("*", F.posexplode(pieces).alias("piece", "p")).select(
        *keys, F.col("p.start").alias("open_pos"), F.col("p.end").alias("close_pos"),
        (F.coalesce("explicit_close", F.lit(True)) & (F.col("piece") == F.col("n"))).alias("explicit_close"),
        "tag", attrs["id"].alias("id"), class_list(attrs["class"]).alias("classes"), "attrs",
    )


def class_list(value: Column) -> Column:
    """Class names in the value of a class attribute."""
    return F.filter(F.split(value, r"[\t\n\f\r ]+"), lambda c: c != "")


# Where an event stands in the order of its token: ends first, then what is opened again, then the token itself.
_ENDS, _AGAIN = -(1 << 31), -(1 << 30)


def _order(at: Column, rank: Column | int) -> Column:
    return F.shiftleft(at.cast("bigint"), 32) + rank


def _cuts(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``cuts`` to the starts of inline elements that cross others: the positions where elements around them end.

    An inline element that ends where others inside it are still open cuts these. Elements can only cross within a run
    of tokens in which some inline element is open. In a run without crossings every element starts and ends at the same
    depth, so the hashes of (element, depth) of its starts and ends cancel out; only in other runs are
    intervals compared, and only with those of the same run.
    """
    upto = W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = W.partitionBy(*keys, "_run")
    inline = H.one_of("tag", H.INLINE)
    opened = inline & (F.col("kind") == "open")
    step = F.when(opened, 1).when(inline & (F.col("kind") == "end"), -1)
    around = F.col("_open") - F.when(opened, 1).otherwise(0)
    marked = (
        stream.withColumn("_open", F.coalesce(F.sum(step).over(upto), F.lit(0)))
        .withColumn("_run", F.sum(F.when(opened & (F.col("_open") == 1), 1).otherwise(0)).over(upto))
        .withColumn("_odd", F.bit_xor(F.when(step.isNotNull(), F.xxhash64("open_pos", around))).over(run) != 0)
        .withColumn("_spans", F.collect_list(
            F.when(F.col("_odd") & opened, F.struct(F.col("open_pos").alias("start"), F.col("close_pos").alias("end")))).over(run))
    )
    crossing = F.filter("_spans", lambda x: (x["start"] < F.col("open_pos")) & (x["end"] > F.col("open_pos")) & (x["end"] < F.col("close_pos")))
    cuts = F.when(F.col("_odd") & opened, F.array_sort(F.array_distinct(F.transform(crossing, lambda x: x["end"]))))
    return marked.withColumn("cuts", cuts).drop("_open", "_run", "_odd", "_spans")


def _element_events(closed: DataFrame) -> DataFrame:
    start = F.struct(F.col("kind").alias("kind"), _order(F.col("pos"), 0).alias("ord"))
    end = F.struct(F.lit("end").alias("kind"), _order(F.col("close_pos"), _ENDS - F.col("pos").cast("bigint")).alias("ord"))
    both = F.when(F.col("kind") == "open", F.array(start, end)).otherwise(F.array(start))
    rest = [c for c in closed.columns if c not in ("kind", "pos")]
    return closed.select(*rest, F.col("pos").alias("open_pos"), F.explode(both).alias("e")).select(
        *rest, "open_pos", "e.ord", "e.kind"
    )


def events(closed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Start and end events of every element, with the text tokens between them.

    Row order within a page is ``ord``. ``kind`` is open, end, void, raw, text or comment; both
    events of an element carry its ``open_pos`` and, as ``text``, its start tag. Elements that end
    at one token end innermost first, before the token itself.

    Events nest: an inline element that is still open where one around it ends is ended there too, and opened again
    behind it. The events that this adds have no counterpart in the source; their ``explicit_close`` is NULL.
    """
    stream = _cuts(_element_events(closed), keys)
    rest = [c for c in stream.columns if c not in ("kind", "ord", "cuts", "close_pos", "explicit_close")]
    event = lambda kind, ord_, explicit: F.struct(kind.alias("kind"), ord_.alias("ord"), explicit.alias("explicit_close"))
    added = F.lit(None).cast("boolean")
    own = F.array(event(F.col("kind"), F.col("ord"), F.col("explicit_close")))
    more = F.flatten(F.transform("cuts", lambda at: F.array(
        event(F.lit("end"), _order(at, _ENDS - F.col("open_pos").cast("bigint")), added), event(F.lit("open"), _order(at, _AGAIN + F.col("open_pos").cast("bigint")), added))))
    split = F.when(F.size("cuts") > 0, F.concat(own, more)).otherwise(own)
    return stream.select(*rest, F.explode(split).alias("e")).select(*rest, "e.ord", "e.kind", "e.explicit_close")


def is_added() -> Column:
    """Whether an event of an element only makes events nest and is not in the source."""
    return F.col("explicit_close").isNull() & H.one_of("kind", ("open", "end"))


def source_text() -> Column:
    """The html an event stands for; implied ends and added events stand for nothing."""
    end_tag = F.when(F.col("explicit_close"), F.concat(F.lit("</"), F.col("tag"), F.lit(">"))).otherwise("")
    return F.when(F.col("kind") == "end", end_tag).when(is_added(), "").otherwise(F.col("text"))
