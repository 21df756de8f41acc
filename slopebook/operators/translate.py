"""E21 text translation, E22 page translation, E23 language-block selection.

E21 is pure column expressions: normalise, test for Japanese, look up the
dictionary (a DataFrame joined on the normalised text; small, so Spark
broadcasts it after its own size check), then the anchored rules, then the
affix-stripped core, then guarded term replacement - all inside one
projection.  Nothing runs in Python.

E22/E23 need HTML structure (which text nodes sit inside script/style/...,
where an element ends): the offsets come from the one parse of
:mod:`slopebook.operators.markup`.  E22 is split around E21: the translatable
nodes become rows, Spark translates them (E21), and the translations are
written back by source offset.  A page travels with the first of its rows, and
nothing between the parse and the writing moves a row, so no page is shuffled.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopebook.operators import markup

# JavaScript's \s spelled out for Java regex.
JS_SPACE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

# Character classes of the translator.
JP = r"[\x{3041}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}]"
KANA = r"[\x{3041}-\x{309F}\x{30A0}-\x{30FA}\x{30FC}-\x{30FF}]"
SENT = r"[\x{3002}\x{3001}\x{FF01}\x{FF1F}]"
# Leading symbols kept as they are; the JS class's surrogate range means "any
# character outside the BMP".
PRE = (rf"^([{JS_SPACE}\x{{3000}}\x{{00A0}}\x{{2190}}-\x{{2BFF}}\x{{3030}}\x{{FE0F}}\x{{10000}}-\x{{10FFFF}}"
       r"\x{FF3C}\\\x{30FB}\x{25C6}\x{25A0}\x{25CF}\x{25B6}]+)")
SUF = rf"([{JS_SPACE}\x{{3000}}\x{{00A0}}\x{{203A}}\x{{00BB}}\x{{2192}}\x{{FF1E}}>\x{{FF0F}}/]+)$"
TERM_STRIP = r"[ー・（）]"
MAX_TERM_LEN = 60

# Anchored rules (pattern, en, zh), first match wins.
RULES = [
    (r"^お子様 (\d+)人目$", "Child #$1", "兒童 第$1位"),
    (r"^大人 (\d+)人目$", "Adult #$1", "成人 第$1位"),
    (r"^この方の料金（(.+)日間・大人）$", "Price for this guest ($1 days, adult)", "此人費用（$1天・成人）"),
    (r"^この方の料金（(.+)日間・子供）$", "Price for this guest ($1 days, child)", "此人費用（$1天・兒童）"),
    (r"^(\d{4}-\d{2}-\d{2})（日帰り）$", "$1 (day trip)", "$1（當天來回）"),
    (r"^(\d{4}-\d{2}-\d{2}) 〜 (\d{4}-\d{2}-\d{2})（(\d+)日間）$", "$1 – $2 ($3 days)", "$1 〜 $2（$3天）"),
    (r"^希望する（(.+) 午後2時〜）$", "Yes (from 2 PM on $1)", "希望（$1 下午2點〜）"),
    (r"^利用者(\d+)（大人）$", "Guest $1 (adult)", "使用者$1（成人）"),
    (r"^利用者(\d+)（お子様）$", "Guest $1 (child)", "使用者$1（兒童）"),
]

# Terms replaced everywhere (pattern, en, zh), all applied in order.
TERMS = [
    (r"お子様 (\d+)人目", "Child #$1", "兒童 第$1位"),
    (r"大人 (\d+)人目", "Adult #$1", "成人 第$1位"),
    (r"(\d+)人目", "#$1", "第$1位"),
    (r"(\d+)日間", "$1 days", "$1天"),
    (r"(\d+)名", "$1", "$1位"),
    (r"(\d+)歳", "$1 yrs", "$1歲"),
    (r"日帰り", "day trip", "當天來回"),
    (r"追加:", "Add-ons:", "追加："),
    (r"フルセット（ウェア付き）", "Full Set (with clothing)", "全套組（含雪衣）"),
    (r"セットなし（単品のみ）", "No set", "不選套組"),
    (r"滑走セット", "Riding Set", "滑行組"),
    (r"フルセット", "Full Set", "全套組"),
    (r"板のレンタルなし", "No board", "不租雪板"),
    (r"スノーボード", "Snowboard", "單板滑雪"),
    (r"スキー", "Ski", "雙板滑雪"),
    (r"キッズ用ハーネス", "Kids' harness", "兒童安全吊帶"),
    (r"スノーシュー", "Snowshoes", "雪鞋"),
    (r"ヘルメット", "Helmet", "安全帽"),
    (r"ゴーグル", "Goggles", "護目鏡"),
    (r"ウェア（上）", "Jacket", "雪衣（上）"),
    (r"ウェア（下）", "Pants", "雪衣（下）"),
    (r"ソリ", "Sled", "雪橇"),
    (r"スタンス未定", "Stance TBD", "站姿未定"),
    (r"レギュラー", "Regular", "Regular"),
    (r"グーフィー", "Goofy", "Goofy"),
    (r"男性", "Male", "男性"),
    (r"女性", "Female", "女性"),
    (r"大人", "Adults", "成人"),
    (r"子供", "Children", "兒童"),
    (r" 様", "", ""),
]

LANG_COL = {"en": "en", "zh": "zh"}

#: Any rule: the test whether one applies.
ANY_RULE = "|".join(pat for pat, _en, _zh in RULES)
#: White space that normalising changes: all but single spaces between others.
LOOSE_SPACE = rf"[{JS_SPACE}]{{2}}|[{JS_SPACE}&&[^ ]]|^ | $"


def normalise(c: Column) -> Column:
    """Collapse runs of (JavaScript) whitespace to one space and trim."""
    collapsed = F.regexp_replace(c, rf"[{JS_SPACE}]+", " ")
    return F.when(c.rlike(LOOSE_SPACE), F.regexp_replace(collapsed, rf"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")).otherwise(c)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, as JavaScript counts (Spark counts code points)."""
    astral = F.length(c) - F.length(F.regexp_replace(c, r"[\x{10000}-\x{10FFFF}]", ""))
    return F.length(c) + astral


def _rules(k: Column, lang: str) -> Column:
    out = F.lit(None).cast("string")
    for pat, en, zh in reversed(RULES):
        rep = en if lang == "en" else zh
        if rep:
            out = F.when(k.rlike(pat), F.regexp_replace(k, pat, rep)).otherwise(out)
    return out


def _terms(core: Column, lang: str) -> Column:
    """All terms in order: those without a group are plain text; regular expressions in a row are tried only where one is found."""
    out = core
    for is_pattern, terms in itertools.groupby(TERMS, lambda t: "(" in t[0]):
        before, terms = out, list(terms)
        for pat, en, zh in terms:
            rep = en if lang == "en" else zh
            out = F.regexp_replace(out, pat, rep) if is_pattern else F.replace(out, F.lit(pat), F.lit(rep))
        if is_pattern:
            out = F.when(before.rlike("|".join(pat for pat, _en, _zh in terms)), out).otherwise(before)
    return out


def translate(df: DataFrame, text_col: str, lang: str, dictionary: DataFrame) -> DataFrame:
    """Add ``translated`` (NULL when no rule applies) and ``display``
    (translation with the original's surrounding whitespace, else the original).

    ``dictionary``: columns ja, en, zh (exact match on the normalised text).
    """
    if lang not in LANG_COL:
        return df.withColumn("translated", F.lit(None).cast("string")).withColumn("display", F.col(text_col))
    raw = F.col(text_col)
    # Everything after the Japanese test runs only for rows that pass it;
    # most text (and all of the test corpus) stops after two regex scans.
    jp = F.col("_jp")
    # The Japanese test does not depend on whitespace, so it runs on the raw
    # text and normalisation runs only for rows that pass it.
    base = (df.withColumn("_jp", raw.rlike(JP))
            .withColumn("_k", F.when(F.col("_jp"), normalise(raw)))
            .withColumn("_pre", F.when(jp, F.regexp_extract("_k", PRE, 1)))
            .withColumn("_rest", F.when(jp, F.expr("substring(_k, length(_pre) + 1)")))
            .withColumn("_suf", F.when(jp, F.regexp_extract("_rest", SUF, 1)))
            .withColumn("_core", F.when(jp, F.expr("substring(_rest, 1, length(_rest) - length(_suf))"))))
    dcol = LANG_COL[lang]
    # One value per key: the last entry wins, as in an object literal.
    d = (dictionary.select(F.col("ja").alias("_dk"), F.nullif(F.col(dcol), F.lit("")).alias("_dv"),
                           F.monotonically_increasing_id().alias("_at"))
         .groupBy("_dk").agg(F.max_by(F.struct("_dv"), "_at").alias("_last")).select("_dk", "_last._dv"))
    # Only Japanese rows probe the dictionary (a NULL key never matches).
    base = base.withColumn("_k_probe", F.when(jp, F.col("_k")))
    # A site's dictionary does not grow with its texts.  Without the hint the texts are shuffled by
    # these keys before it is known to be small, and all that are not Japanese (NULL) meet in one task.
    d = F.broadcast(d)
    j = (base.join(d.withColumnRenamed("_dk", "_k_probe").withColumnRenamed("_dv", "_d_k"), "_k_probe", "left")
         .join(d.withColumnRenamed("_dk", "_core").withColumnRenamed("_dv", "_d_core"), "_core", "left"))
    kk, cc, pp, ss = F.col("_k"), F.col("_core"), F.col("_pre"), F.col("_suf")
    # Each stage is its own projection: the terms chain is referenced three
    # times, and inlining it would overflow the 64 KB generated-method limit.
    # A stage runs only for texts that the ones before have left open.
    stripped = (pp != "") | (ss != "")
    j = (j.withColumn("_open", jp & (kk != "") & F.col("_d_k").isNull())
         .withColumn("_rule_k", F.col("_open") & kk.rlike(ANY_RULE))
         .withColumn("_open", F.col("_open") & ~F.col("_rule_k"))
         .withColumn("_inner", F.when(F.col("_open"), stripped & (cc != "") & cc.rlike(JP)).otherwise(F.lit(False)))
         .withColumn("_rule_core", F.col("_inner") & F.col("_d_core").isNull() & cc.rlike(ANY_RULE))
         .withColumn("_ruled", F.when(F.col("_rule_k"), kk).when(F.col("_rule_core"), cc))
         .withColumn("_ruled", F.when(F.col("_ruled").isNotNull(), _rules(F.col("_ruled"), lang)))
         .withColumn("_open", F.col("_open") & ~(F.col("_inner") & (F.col("_d_core").isNotNull() | F.col("_rule_core"))))
         .withColumn("_short", F.when(F.col("_open"), (utf16_length(cc) <= MAX_TERM_LEN) & ~cc.rlike(SENT)).otherwise(F.lit(False)))
         .withColumn("_terms", F.when(F.col("_short"), _terms(cc, lang))))
    terms_out = F.col("_terms")
    rest_chars = F.regexp_replace(terms_out, TERM_STRIP, "")
    dirty = rest_chars.rlike(JP) if lang == "en" else rest_chars.rlike(KANA)
    j = j.withColumn("_terms_ok", F.col("_short") & (terms_out != cc) & ~dirty)
    tr = (F.when(~jp | (kk == ""), F.lit(None))
          .when(F.col("_d_k").isNotNull(), F.col("_d_k"))
          .when(F.col("_rule_k"), F.col("_ruled"))
          .when(F.col("_inner") & F.col("_d_core").isNotNull(), F.concat(pp, F.col("_d_core"), ss))
          .when(F.col("_rule_core"), F.concat(pp, F.col("_ruled"), ss))
          .when(F.col("_terms_ok"), F.concat(pp, terms_out, ss)))
    lead = F.regexp_extract(raw, rf"^([{JS_SPACE}]*)", 1)
    trail = F.regexp_extract(raw, rf"([{JS_SPACE}]*)$", 1)
    out = j.withColumn("translated", tr)
    return (out.withColumn("display", F.when(F.col("translated").isNotNull(),
                                             F.concat(lead, F.col("translated"), trail)).otherwise(raw))
            .drop("_k", "_jp", "_k_probe", "_pre", "_rest", "_suf", "_core", "_d_k", "_d_core", "_rule_k",
                  "_rule_core", "_short", "_terms", "_terms_ok", "_open", "_inner", "_ruled"))


# ---------------------------------------------------------------------------
# HTML structure
# ---------------------------------------------------------------------------

def _written(v: str | None, edits: list[tuple[int, int, str, str]]) -> str | None:
    """The page ``v`` with its edits (start, end, kind, text) put in."""
    if v is None or not edits:
        return v
    pieces, pos = [], 0
    for start, end, kind, text in sorted(edits, key=lambda x: x[0]):
        if start < pos:
            continue
        pieces.append(v[pos:start])
        text = html.escape(text, quote=kind != "text")
        pieces.append(f'"{text}"' if kind.startswith("bare:") else text)
        pos = end
    pieces.append(v[pos:])
    return "".join(pieces)


#: What a node's row says of its page (number, the node's place, nodes in all) and of the edit; no text, no edit.
_EDIT = ["_page", "_pos", "_of", "_start", "_end", "_kind", "_text"]


def _write_back(rows: DataFrame, pages: DataFrame, html_col: str) -> DataFrame:
    """``pages`` with their edits put into ``html_col``.

    ``rows``: the columns of ``pages``, filled in on the first row of each page, then ``_EDIT``.  The rows of a page
    follow each other in their order; where they do not, this fails.
    """
    at, width, schema = pages.columns.index(html_col), len(pages.columns), pages.schema

    def written(columns: list[pa.Array], edits: list[list[tuple]]) -> pa.RecordBatch:
        new = pa.array([_written(v, e) for v, e in zip(columns[at].to_pylist(), edits)], type=columns[at].type)
        return pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(columns)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, (None, 0, 1)  # the page whose rows may go on, and its edits; the last row's page, place, rows in all
        for batch in (part for whole in batches for part in markup.slices(whole, at)):
            firsts, edits = [], [held[1]] if held else []
            for i, (page, pos, of, *edit) in enumerate(zip(*(c.to_pylist() for c in batch.columns[width:]))):
                if (pos != 0 or last[1] + 1 != last[2]) if page != last[0] else pos != last[1] + 1:
                    raise RuntimeError("the rows of a page do not follow each other")
                last = page, pos, of
                if pos == 0:
                    firsts.append(i)
                    edits.append([])
                if edit[3] is not None:
                    edits[-1].append(tuple(edit))
            if not firsts:
                continue
            columns = [c.take(pa.array(firsts)) for c in batch.columns[:width]]
            if held:
                yield written(held[0], edits[:1])
                del edits[0]
            if len(firsts) > 1:
                yield written([c[:-1] for c in columns], edits[:-1])
            held = [c[-1:] for c in columns], edits[-1]
        if last[1] + 1 != last[2]:
            raise RuntimeError("a page lacks rows")
        if held:
            yield written(held[0], [held[1]])

    return rows.mapInArrow(run, schema)


def page_nodes(pages: DataFrame, id_col: str = "id", html_col: str = "html") -> DataFrame:
    """E22 step 1: translatable nodes of each page (text nodes and four
    attributes containing Japanese, outside skipped elements)."""
    return (markup.scanned(pages.select(id_col, html_col), html_col).select(id_col, F.explode("nodes").alias("n"))
            .select(id_col, "n.node_no", "n.kind", "n.start", "n.end", "n.raw"))


def translate_pages(pages: DataFrame, lang: str, dictionary: DataFrame, id_col: str = "id",
                    html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(translated pages, node table).

    Nodes are translated by E21 in Spark; only nodes with a translation are
    written back (the page keeps its original text otherwise), keeping the
    node's surrounding whitespace.  Each page gets its own edits, also where ids
    repeat.  The per-page edit list is bounded by the page's own size.
    """
    tr = translate(page_nodes(pages, id_col, html_col), "raw", lang, dictionary)
    own = [f"_p{i}" for i in range(len(pages.columns))]
    # Every node of a page by itself, the page's own columns with the first; a page without nodes has one row.
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    rows = (markup.scanned(pages, html_col).drop("blocks", "root").toDF(*own, "_nodes")
            .withColumn("_page", F.monotonically_increasing_id()).withColumn("_of", F.greatest(F.size("_nodes"), F.lit(1)))
            .select(*own, "_page", "_of", F.posexplode_outer("_nodes").alias("_pos", "_n"))
            .select(*(F.when(first, F.col(c)).alias(c) for c in own), "_page", F.coalesce("_pos", F.lit(0)).alias("_pos"), "_of",
                    F.col("_n.start").alias("_start"), F.col("_n.end").alias("_end"), F.col("_n.kind").alias("_kind"), F.col("_n.raw").alias("_raw"),
                    F.col(own[pages.columns.index(id_col)]).isNotNull().alias("_known")))
    # A page without an id keeps its text.
    edits = (translate(rows, "_raw", lang, dictionary)
             .withColumn("_text", F.when(F.col("translated").isNotNull() & F.col("_known"), F.col("display"))))
    return _write_back(edits.select(*own, *_EDIT), pages, html_col), tr


def select_language_blocks(pages: DataFrame, lang: str, html_col: str = "html") -> DataFrame:
    """Keep only the ``data-langblock`` elements of ``lang`` (others removed)."""
    others = F.array_sort(F.filter("blocks", lambda b: b["lang"] != lang))
    return (markup.scanned(pages, html_col).withColumn("blocks", others)
            .withColumn(html_col, markup.without(F.col(html_col), F.col("blocks"))).drop("nodes", "blocks", "root"))
