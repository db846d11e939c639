"""Assembly of one Markdown document per site, as ordered parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions.text import anchor, trim_body
from corpusmill.functions.urls import title_from_url

# Separators of the document.
RULE = "---\n\n"
BETWEEN_SECTIONS = "\n\n---\n\n"
TOC_HEAD = "## Table of Contents\n\n"
TOC_END = "\n---\n\n"


def header_text(name: Column, base_url: Column, pages: Column, max_depth: Column, generated_at: Column) -> Column:
    """Head of a document; the generation time is an input."""
    return F.concat(
        F.lit("# "), name, F.lit("\n\n*Generated on "), F.date_format(generated_at, "yyyy-MM-dd HH:mm:ss"),
        F.lit("*\n\n- **Base URL**: "), base_url, F.lit("\n- **Total Pages**: "), pages.cast("string"),
        F.lit("\n- **Max Depth**: "), max_depth.cast("string"), F.lit("\n\n" + RULE),
    )


def toc_line(title: Column, depth: Column) -> Column:
    """Line of the table of contents; shows the title as it is, even ``Untitled``."""
    return F.concat(F.repeat(F.lit("  "), depth), F.lit("- ["), title, F.lit("](#"), anchor(title), F.lit(")"))


def section_title(title: Column, url: Column) -> Column:
    """Title, or one made from the URL when there is none."""
    return F.when(title.isin("", "Untitled"), title_from_url(url)).otherwise(title)


def section_heading(title: Column, url: Column, depth: Column) -> Column:
    """Heading of a section, at most six levels deep."""
    return F.concat(F.repeat(F.lit("#"), F.least(depth + 1, F.lit(6))), F.lit(" "), section_title(title, url))


def section_text(title: Column, url: Column, depth: Column, body: Column, metadata: Column) -> Column:
    """Heading, source line and body of one page."""
    source = F.when(metadata, F.concat(F.lit("*Source: ["), url, F.lit("]("), url, F.lit(")*\n\n"))).otherwise("")
    text = trim_body(body)
    return F.concat(
        section_heading(title, url, depth), F.lit("\n\n"), source,
        F.when(text != "", F.concat(text, F.lit("\n"))).otherwise(""),
    )


def doc_header(counts: DataFrame, specs: DataFrame, generated_at: str) -> DataFrame:
    """``site, header`` for the sites in ``counts`` (site, pages)."""
    spec = specs.select(F.col("name").alias("site"), "base_url", "max_depth")
    return counts.join(spec, "site").select(
        "site",
        header_text(F.col("site"), F.col("base_url"), F.col("pages"), F.col("max_depth"),
                    F.lit(generated_at).cast("timestamp")).alias("header"),
    )


def toc_lines(ordered: DataFrame) -> DataFrame:
    """``site, ord, line``."""
    return ordered.select("site", "ord", toc_line(F.col("title"), F.col("depth")).alias("line"))


def sections(ordered: DataFrame, metadata: Column | bool = True) -> DataFrame:
    """``site, ord, section``."""
    flag = metadata if isinstance(metadata, Column) else F.lit(metadata)
    return ordered.select(
        "site", "ord",
        section_text(F.col("title"), F.col("url"), F.col("depth"), F.col("content"), flag).alias("section"),
    )


def assemble(ordered: DataFrame, specs: DataFrame, generated_at: str) -> DataFrame:
    """``site, part, chunk, markdown``: the document of every site, piece by piece.

    ``ordered`` has site, ord, depth, url, title, content. The pieces of a site, joined in the order
    (part, chunk) without anything between, are its document: header (0), one line of the table of contents
    per page (1, closed by 2) and one section per page (3). No row holds more than one page and nothing is
    gathered by site, so the size of a site does not matter; :func:`write_corpus` puts pieces into files.
    """
    spec = specs.select(
        F.col("name").alias("site"), "base_url", "max_depth", "include_metadata", "generate_toc"
    )
    counts = ordered.groupBy("site").agg(F.count("*").alias("pages"))
    once = counts.join(spec, "site")
    row = lambda part, text: F.struct(
        F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("chunk"), text.alias("markdown")
    )
    header = header_text(
        F.col("site"), F.col("base_url"), F.col("pages"), F.col("max_depth"), F.lit(generated_at).cast("timestamp")
    )
    head = F.concat(
        F.when(F.col("include_metadata"), header).otherwise(""),
        F.when(F.col("generate_toc"), F.lit(TOC_HEAD)).otherwise(""),
    )
    fixed = (
        once.select("site", F.explode(F.array(row(0, head), row(2, F.when(F.col("generate_toc"), TOC_END).otherwise("")))).alias("r"))
        .select("site", "r.*").filter("markdown <> ''")
    )
    flagged = ordered.join(spec.select("site", "include_metadata", "generate_toc"), "site")
    line = F.concat(toc_line(F.col("title"), F.col("depth")), F.lit("\n"))
    toc = flagged.filter("generate_toc").select("site", F.lit(1).alias("part"), F.col("ord").alias("chunk"), line.alias("markdown"))
    text = section_text(F.col("title"), F.col("url"), F.col("depth"), F.col("content"), F.col("include_metadata"))
    between = F.when(F.col("ord") > 1, BETWEEN_SECTIONS).otherwise("")
    body = flagged.select("site", F.lit(3).alias("part"), F.col("ord").alias("chunk"), F.concat(between, text).alias("markdown"))
    return fixed.unionByName(toc).unionByName(body)
