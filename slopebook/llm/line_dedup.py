"""Line dedup by site-relative frequency.

A line is boilerplate on a host when the pages of the host that contain it,
divided by the pages of the host, exceed ``MAX_SHARE`` (and at least
``MIN_PAGES`` pages contain it, so that tiny hosts are left alone).  Such lines
are dropped from every page of that host; the other lines stay as they are.

Plan: each page's distinct lines become 128-bit hashes, counted per (host,
line) with map-side combining, so a hot host or line is pre-aggregated before
the shuffle and its rows spread over all lines.  A host has at most (mean
lines a page) / MAX_SHARE boilerplate lines, so the per-host list that comes
back to the pages is short; it is written to the shared folder, and Spark
broadcasts it when the written size is small, else joins with adaptive skew
splitting.

Edge cases: a null text stays null and counts as a page without lines; a null
host is a host of its own; blank lines (only white space) are never dropped;
a page of only boilerplate keeps its row with empty text; repeated rows count
as pages of their own; columns of ``docs`` are returned unchanged but for the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopebook.llm.common import fresh
from slopebook.plans.session import materialize

MAX_SHARE = 0.1
MIN_PAGES = 5


def _key(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text",
                max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, a, b (a line's hash), n_pages, host_pages of the lines to drop."""
    slim = docs.select(F.col(host).alias("h"), F.col(text).alias("t"))
    totals = slim.groupBy("h").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = (slim.select("h", F.explode(F.array_distinct(F.filter(F.split("t", "\n", -1), _has_word))).alias("line"))
             .select("h", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), F.col("line")).alias("b")))
    counts = lines.groupBy("h", "a", "b").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages)
    return (counts.alias("c").join(totals.alias("s"), F.col("c.h").eqNullSafe(F.col("s.h")))
            .where(F.col("n_pages") > max_share * F.col("host_pages"))
            .select(F.col("c.h").alias("h"), "a", "b", "n_pages", "host_pages"))


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text",
               max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES, dropped: str | None = None) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text.

    ``dropped``: name of an added column with the number of lines removed.
    """
    # Written first, so that the join's strategy rests on the list's real size.
    bad = materialize(boilerplate(docs, host, text, max_share, min_pages).groupBy("h")
                      .agg(F.collect_set(F.struct("a", "b")).alias("bad")), "boilerplate")
    host_col, list_col, kept_col = fresh(docs, "__h", "__bad", "__kept")
    side = bad.select(F.col("h").alias(host_col), F.col("bad").alias(list_col))
    lines = F.split(F.col(text), "\n", -1)
    clean = F.when(F.col(list_col).isNull(), lines).otherwise(F.filter(
        lines, lambda x: ~_has_word(x) | ~F.array_contains(F.col(list_col), _key(x))))
    out = docs.join(side, F.col(host).eqNullSafe(F.col(host_col)), "left").withColumn(kept_col, clean)
    new_text = F.when(F.col(text).isNotNull(), F.array_join(F.col(kept_col), "\n")).alias(text)
    extra = []
    if dropped is not None:
        extra = [F.when(F.col(text).isNull(), F.lit(0).cast("long"))
                 .otherwise((F.size(lines) - F.size(F.col(kept_col))).cast("long")).alias(dropped)]
    return out.select(*[new_text if c == text else F.col(c) for c in docs.columns], *extra)
