"""Cleaning of loaded documents before they are cut."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docmill.functions.text import blank_to_null, col, collapse, normalize_newlines, rstrip, strip

#: What is noise in a Markdown document.
ZERO_WIDTH = "​‌‍﻿⁠"
FENCE, IMAGE_TAG, TOC, DIVIDER, EMPTY_ITEM = r"^\s*(```|~~~)", r"(?i)<img\b[^>]*>", r"(?i)^\s*\[TOC\]\s*$", r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$", r"^\s*(?:[*+-]|\d+\.)\s*(?:[:：])?\s*$"
#: Longest repeated edge of a page, how often it repeats, and lines that are page numbers.
EDGE_MOST, EDGE_TIMES, PAGE_NUMBER = 80, 2, r"(?i)^(?:page\s+)?\d+$"


def normalize(text: Column | str) -> Column:
    """Line feeds only, at most one empty line in a row, no blanks at the ends."""
    return strip(F.regexp_replace(normalize_newlines(text), "\n{3,}", "\n\n"))


def without_images(line: str) -> str:
    """A line without ![alt](target) whose parentheses balance; anything else stays."""
    out, at = [], 0
    while (start := line.find("![", at)) >= 0:
        middle = line.find("](", start + 2)
        end, depth = middle + 2, 1
        while middle >= 0 and depth and end < len(line):
            depth += {"(": 1, ")": -1}.get(line[end], 0)
            end += 1
        if middle < 0 or depth:
            out.append(line[at : start + 1])
            at = start + 1
        else:
            out.append(line[at:start])
            at = end
    return "".join([*out, line[at:]])


def strip_images(text: Column | str) -> Column:
    """Texts without Markdown images, line by line outside fences."""

    def one(text: str | None) -> str | None:
        if text is None or "![" not in text:
            return text
        fenced, out = False, []
        for line in text.split("\n"):
            fence = line.lstrip().startswith(("```", "~~~"))
            out.append(line if fenced or fence else without_images(line))
            fenced ^= fence
        return "\n".join(out)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(text)


def strip_markdown_noise(text: Column | str) -> Column:
    """Without zero-width signs and, outside fences, images, [TOC], dividers and empty list items.

    The state of the fence runs through the lines in one fold; the text reaches Python only where it holds an image.
    """
    plain = F.translate(col(text), ZERO_WIDTH, "")
    plain = F.when(F.contains(plain, F.lit("![")), strip_images(normalize_newlines(plain))).otherwise(plain)
    lines = F.transform(F.split(normalize_newlines(plain), "\n"), lambda x: rstrip(x))
    start = F.struct(F.lit(False).alias("fenced"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, line: Column) -> Column:
        fence = line.rlike(FENCE)
        bare = F.regexp_replace(line, IMAGE_TAG, "")
        noise = bare.rlike(TOC) | bare.rlike(DIVIDER) | bare.rlike(EMPTY_ITEM)
        kept = F.when(fence | state["fenced"], F.array(line)).when(noise, F.array().cast("array<string>")).otherwise(F.array(bare))
        return F.struct((state["fenced"] != fence).alias("fenced"), F.concat(state["kept"], kept).alias("kept"))

    return normalize(F.array_join(F.aggregate(lines, start, step)["kept"], "\n"))


def filled_lines(text: Column | str) -> Column:
    """The stripped lines of a text that aren't blank."""
    return F.filter(F.transform(F.split(normalize_newlines(text), "\n"), lambda x: strip(x)), lambda x: x != "")


def repeated_edges(pages: DataFrame, file: str, text: str) -> DataFrame:
    """(file, line, edge, n): first and last lines that repeat on the pages of a file."""
    lines = pages.select(file, filled_lines(text).alias("lines")).where(F.size("lines") > 0)
    both = F.explode(F.array(F.struct(F.lit("first").alias("edge"), F.element_at("lines", 1).alias("line")), F.struct(F.lit("last").alias("edge"), F.element_at("lines", -1).alias("line")))).alias("e")
    edges = lines.select(file, both).select(file, "e.edge", "e.line").where(F.length("line") <= EDGE_MOST)
    return edges.groupBy(file, "edge", "line").agg(F.count("*").alias("n")).where(F.col("n") >= EDGE_TIMES)


def strip_page_noise(pages: DataFrame, file: str, text: str) -> DataFrame:
    """pages with `clean`: lines without repeated edges of their file and page numbers, joined by line feeds.

    The edges of a file come back as one array by a join on the file; a file without edges keeps its lines.
    """
    edges = repeated_edges(pages, file, text).groupBy(file).agg(F.collect_set("line").alias("_edges"))
    joined = pages.join(edges, file, "left")
    keep = F.filter(filled_lines(text), lambda x: ~F.coalesce(F.array_contains("_edges", x), F.lit(False)) & ~x.rlike(PAGE_NUMBER))
    return joined.withColumn("clean", normalize(F.array_join(keep, "\n"))).drop("_edges")


def section_title(text: Column | str, sheet: Column, heading_path: Column, page: Column) -> Column:
    """The sheet's name, else the heading path, else "Page n", else the first line that begins with #, else empty."""
    heads = F.filter(F.transform(F.split(normalize_newlines(text), "\n"), lambda x: strip(x)), lambda x: x.startswith("#"))
    first = strip(F.regexp_replace(F.get(heads, F.lit(0)), "^[# ]+", ""))
    return F.coalesce(F.nullif(sheet, F.lit("")), F.nullif(heading_path, F.lit("")), F.when(page != 0, F.concat(F.lit("Page "), page.cast("string"))), first, F.lit(""))


def enhance(docs: DataFrame, kb_name: Column | str) -> DataFrame:
    """Loaded documents (text, doc_type, file_path, mtime and optional sheet_name, heading_path, page_number, section_title) cleaned by type.

    Documents that are blank after cleaning are dropped; an existing section title stays.
    """
    for name, kind in (("sheet_name", "string"), ("heading_path", "string"), ("page_number", "int"), ("section_title", "string")):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    docs = docs.withColumn("text", normalize("text"))
    others = docs.where(~F.col("doc_type").eqNullSafe("pdf"))
    others = others.withColumn("text", F.when(F.col("doc_type") == "md", strip_markdown_noise("text")).otherwise(F.col("text")))
    pdf = strip_page_noise(docs.where(F.col("doc_type") == "pdf"), "file_path", "text").withColumn("text", F.col("clean")).drop("clean")
    both = others.unionByName(pdf).where(blank_to_null("text").isNotNull())
    title = F.coalesce(F.col("section_title"), section_title("text", F.col("sheet_name"), F.col("heading_path"), F.col("page_number")))
    modified = F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd HH:mm:ss")
    return both.withColumns({"section_title": title, "kb_name": col(kb_name) if isinstance(kb_name, Column) else F.lit(kb_name), "mtime": modified})


def block_text(text: Column | str) -> Column:
    """A block of a page: no-break spaces as spaces, then normalised."""
    return normalize(F.replace(col(text), F.lit("\xa0"), F.lit(" ")))


def repeated_text(text: Column | str) -> Column:
    """A block's text for comparison between pages."""
    return collapse(F.replace(col(text), F.lit("\xa0"), F.lit(" ")))

