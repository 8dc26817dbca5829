"""Fields out of web pages and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_text(html: Column) -> Column:
    """The text of a page: without scripts, styles and tags, lines trimmed, blank ones dropped."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    bare = F.regexp_replace(bare, r"<[^>]*>", "\n")
    lines = F.transform(F.split(bare, r"\r?\n|  "), lambda line: F.trim(line))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def line_with(text: Column, label: str) -> Column:
    """The first line that holds the label, or null."""
    return F.try_element_at(F.filter(F.split(text, "\n"), lambda line: F.contains(line, F.lit(label))), F.lit(1))


def number_in(line: Column) -> Column:
    """All digits of a line as one number."""
    return F.regexp_replace(line, r"[^0-9]", "").try_cast("long")


def without_prefix(line: Column, prefix: str) -> Column:
    return F.when(line.startswith(prefix), F.trim(F.substring(line, len(prefix) + 1, 1 << 30))).otherwise(line)


def links(html: Column) -> Column:
    """Addresses of the page's anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def within_sizes(rows: DataFrame, column: str, low: int = 1 << 15, high: int = 1 << 24) -> DataFrame:
    """Graphs that are neither too small nor too large."""
    return rows.where((F.col(column) > low) & (F.col(column) < high))


def page_fields(pages: DataFrame) -> DataFrame:
    """page_id, title, n_links, text_lines, digits of the address."""
    text = page_text(F.col("html"))
    return pages.select("page_id", title(F.col("html")).alias("title"), F.size(links(F.col("html"))).alias("n_links"), F.try_element_at(links(F.col("html")), F.lit(1)).alias("first_link"), F.size(F.split(text, "\n")).alias("text_lines"), number_in(F.col("url")).alias("url_number"))


def performance(log: Column) -> Column:
    """The first decimal number of the first line with AVG_PERF that has one; 0.0 without."""
    lines = F.filter(F.split(log, "\n"), lambda line: F.contains(line, F.lit("AVG_PERF")) & line.rlike(r"\d+\.\d+"))
    return F.coalesce(F.regexp_extract(F.try_element_at(lines, F.lit(1)), r"\d+\.\d+", 0).try_cast("double"), F.lit(0.0))


def error_count(log: Column) -> Column:
    """The number after "error count:", or null."""
    return F.regexp_extract(log, r"error count:\s*(\d+)", 1).try_cast("long")
