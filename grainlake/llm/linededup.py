"""Line dedup by site-relative frequency: lines that too large a share of a host's pages contain are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused

#: A line goes where more than this share of a host's pages has it, and at least so many pages: on a host of few pages
#: every line is on a large share of them, and a page and its copy would wipe each other out.
MAX_RATIO, LEAST_PAGES = 0.1, 3

#: HTML elements that begin a line of their own.
BLOCKS = "p|br|li|ul|ol|div|h[1-6]|article|nav|header|footer|section|aside|main|title|table|tr|td|th|head|body|html|pre|blockquote|hr"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def html_lines(html: Column) -> Column:
    """The text of a page, a line for each block element, without tags, scripts, styles and comments; null of null."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    broken = F.regexp_replace(bare, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    return F.regexp_replace(F.regexp_replace(broken, "<[^>]*>", ""), r"[\t\x20]*\n[\t\x20\n]*", "\n")


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def _key(host: Column) -> Column:
    """A key without nulls, so that null is a host like any other."""
    return F.when(host.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), host.cast("string")))


def boilerplate(df: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host_key, boilerplate``: 64-bit digests of each host's lines that more than ``max_ratio`` of its pages have, and
    at least ``least_pages`` of them, whatever the host's size.

    A page counts once for a line however often it has it; every page of the host counts, those without text too. An
    array holds at most a host's mean distinct lines a page over ``max_ratio``. Counts are combined before they are
    shuffled, by host and line, so a host with most pages is spread over its lines. Digests are compared within a host
    alone, where two lines share one with a chance of its lines squared over 2^65.
    """
    pages = df.select(_key(host).alias("host_key"), F.split(text, "\n").alias("lines"))
    totals = pages.groupBy("host_key").agg(F.count("*").alias("pages"))
    own = F.array_distinct(F.transform(F.filter("lines", lambda x: ~_blank(x)), lambda x: F.xxhash64(x)))
    counts = pages.select("host_key", F.explode(own).alias("line")).groupBy("host_key", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    often = counts.join(totals, "host_key").where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
    return often.groupBy("host_key").agg(F.collect_list("line").alias("boilerplate"))


def drop_boilerplate(df: DataFrame, host: Column, text_col: str = "text", max_ratio: float = MAX_RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``df`` with the boilerplate lines of each row's host cut out of ``text_col``; all rows, other columns as they are.

    A null host is a host of its own. Null texts stay null; a text of boilerplate alone becomes empty. Blank lines
    are neither counted nor dropped. Repeated rows count as pages each. No rows, no rows.
    """
    found = materialise(boilerplate(df, host, F.col(text_col), max_ratio, least_pages), "boilerplate")
    key, lines = unused(df, "_host_key"), unused(df, "_boilerplate")
    found = found.select(F.col("host_key").alias(key), F.col("boilerplate").alias(lines))
    joined = df.withColumn(key, _key(host)).join(found, key, "left")
    kept = F.array_join(F.filter(F.split(text_col, "\n"), lambda x: _blank(x) | ~F.array_contains(lines, F.xxhash64(x))), "\n")
    cut = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(kept)
    return joined.withColumn(text_col, cut).select(*df.columns)
