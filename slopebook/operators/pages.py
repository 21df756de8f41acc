"""Published pages: E18 (publish = upsert + append version), E19 (latest k
versions per page), E20 (restore a version), B7 (page by key / version by
id), B8 (layout class), E24 (ordered HTML rewrite rules), E25 (seed
extraction), E27 (previous / next version of a page).

Pages are keyed by page_key; versions by id.  Latest-k uses a
``row_number() <= k`` filter, which Spark plans with a per-partition group
limit before the shuffle, so a page with millions of versions ships only k
rows per map task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopebook.operators import maintenance as mt
from slopebook.operators import markup

# JavaScript's \s, spelled out (Java's \s lacks NBSP, U+3000 and friends).
JS_SPACE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# Layout tests of the page renderer.
FIXED_WIDTH = rf"width:[{JS_SPACE}]*7[0-9]{{2}}px"
ABSOLUTE = rf"position:[{JS_SPACE}]*absolute"


def publish(pages: DataFrame, versions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply published changes (id, page_key, html, css, project_data,
    created_at, created_by): current page = last write per key (A6); every
    change is also a version row (A7)."""
    cur = changes.select("page_key", "html", "css", "project_data",
                         F.col("created_at").alias("updated_at"), F.col("created_by").alias("updated_by"),
                         F.col("id").alias("version_id"))
    base = pages if "version_id" in pages.columns else pages.withColumn("version_id", F.lit(None).cast("long"))
    new_pages = mt.upsert(base.select(*cur.columns), cur, "page_key", "version_id")
    new_versions = mt.append(versions, changes.select(*versions.columns))
    return new_pages, new_versions


def latest_versions(versions: DataFrame, k: int = 20) -> DataFrame:
    """The k newest versions per page (created_at desc, id desc as tie-break)."""
    w = Window.partitionBy("page_key").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return (versions.select("page_key", "id", "created_at", F.row_number().over(w).alias("rank"))
            .where(F.col("rank") <= k))


def restore(pages: DataFrame, versions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Republish the content of version ``version_id`` as a new change.

    requests: request_id (new version id), version_id, requested_at, requested_by.
    """
    src = versions.select(F.col("id").alias("version_id"), "page_key", "html", "css", "project_data")
    ch = requests.join(src, "version_id").select(
        F.col("request_id").alias("id"), "page_key", "html", "css", "project_data",
        F.col("requested_at").alias("created_at"), F.col("requested_by").alias("created_by"))
    return publish(pages, versions, ch)


def page_by_key(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """One row or NULL per asked key (``maybeSingle``)."""
    return keys.join(pages, "page_key", "left")


def version_by_id(versions: DataFrame, ids: DataFrame) -> DataFrame:
    """The version of each asked id, or a row of NULLs."""
    return ids.select("id").join(versions, "id", "left")


def layout_class(html: Column, css: Column) -> Column:
    """B8: 'unusable' for empty html, 'fixed_wide' for a 7dd px width or
    absolute positioning, else 'fluid'."""
    fixed = (F.coalesce(html, F.lit("")).rlike(FIXED_WIDTH) | F.coalesce(css, F.lit("")).rlike(FIXED_WIDTH)
             | F.coalesce(html, F.lit("")).rlike(ABSOLUTE))
    return F.when(F.coalesce(html, F.lit("")) == "", "unusable").when(fixed, "fixed_wide").otherwise("fluid")


def version_nav(versions: DataFrame) -> DataFrame:
    """Previous and next version of the same page in id order."""
    w = Window.partitionBy("page_key").orderBy("id")
    return versions.select("page_key", "id", F.lag("id").over(w).alias("prev_id"),
                           F.lead("id").over(w).alias("next_id"))


#: An element with the given class, up to its end tag.
ROW = r'(?is)<(\w+)\b[^>]*\bclass\s*=\s*["\'](?:[^"\']*\s)?%s(?:\s[^"\']*)?["\'][^>]*>.*?</\1\s*>'


def default_rewrite_rules(phone: str, old_handle: str, new_handle: str) -> list[tuple]:
    """E24 rules as (name, condition, pattern, replacement[, class]), applied in order.

    With a class, condition and pattern are tested and applied in each element
    of that class alone.

    Re-aimed from the home page's repair hook: footer links chosen by their
    text, old opening hours next to the hours label, an old social handle,
    and web booking links replaced by a phone link.  Shop phone and handles
    are parameters.  Patterns are Java regex; replacement groups use ``$n``.
    The hook works on DOM elements; on page text the condition is tested on
    the whole page.
    """
    tel = "tel:" + phone.replace("-", "")
    return [
        ("faq_link", r"よくある|質問", r'(<a\b[^>]*href=")#("[^>]*>[^<]*(?:よくある|質問))', "$1pages/faq.html$2"),
        ("contact_link", r"問い合わせ", r'(<a\b[^>]*href=")#("[^>]*>[^<]*問い合わせ)', f"$1{tel}$2"),
        ("privacy_link", r"プライバシー", r'(<a\b[^>]*href=")#("[^>]*>[^<]*プライバシー)', "$1pages/privacy.html$2"),
        ("hours_open", r"営業時間", r"8([:：])30", "8$1\\00", "access-row"),
        ("hours_close", r"営業時間", r"18([:：])00", "17$1\\00", "access-row"),
        ("old_handle", old_handle, "@?" + old_handle, new_handle),
        ("booking_link", r"reserve\.html", r'href="[^"]*reserve\.html[^"]*"', f'href="{tel}"'),
    ]


def rewrite_html(pages: DataFrame, rules: list[tuple], col: str = "html") -> DataFrame:
    """Apply ordered (condition, pattern, replacement) rules to each page.

    A rule fires when its condition and its pattern match the current text;
    each rule is one projection (``when(rlike, regexp_replace)``), so the
    rewrite is a chain of projections in one codegen stage.  Adds
    ``n_rules_hit``.
    """
    out = pages.withColumn("n_rules_hit", F.lit(0))
    for _name, cond, pat, rep, *scope in rules:
        t = F.col(col)
        if scope:
            rows = F.filter(F.regexp_extract_all(t, F.lit(ROW % re.escape(scope[0])), F.lit(0)), lambda r: r.rlike(cond) & r.rlike(pat))
            new = F.aggregate(rows, t, lambda text, r: F.replace(text, r, F.regexp_replace(r, pat, rep)))
            out = out.withColumn("_rows", rows).withColumn("_fire", F.size("_rows") > 0).drop("_rows")
        else:
            new = F.regexp_replace(t, pat, rep)
            out = out.withColumn("_fire", t.rlike(cond) & t.rlike(pat))
        out = (out.withColumn(col, F.when(F.col("_fire"), new).otherwise(t))
               .withColumn("n_rules_hit", F.col("n_rules_hit") + F.col("_fire").cast("int"))
               .drop("_fire"))
    return out


def first_style(html: Column) -> Column:
    """E25 (style part): text of the first ``<style>`` element."""
    return F.regexp_extract(html, r"(?is)<style\b[^>]*>(.*?)</style>", 1)


def extract_root_html(pages: DataFrame, root_id: str = "page-root", col: str = "html") -> DataFrame:
    """E25 (root part): inner HTML of the element with ``root_id`` (NULL if none), by the offsets of the page's one parse."""
    inner = F.substring(F.col(col), F.col("root.start") + 1, F.col("root.end") - F.col("root.start"))
    return (markup.scanned(pages, col, root_id).withColumn("root_html", F.when(F.col("root").isNotNull(), inner))
            .drop("nodes", "blocks", "root"))
