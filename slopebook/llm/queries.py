"""The registered ``opN_`` queries and their DuckDB SQL.

Each query applies its operator, with production parameters, to a whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from slopebook.llm import (ann_forest, bwt_dedup, curve_packing, html_blocks, katz_lm, line_dedup, merkle_manifest,
                           ngram_join, phrase_graph, piece_tokens, quality_rules, secret_scan, url_filter)
from slopebook.llm.common import table

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_html_blocks(spark, sf_dir):
    """Main text of every page, by the recurrent labeller trained on a sample of the pages."""
    pages = table(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.fit(pages))


@query
def op2_quality_rules(spark, sf_dir):
    """Statistics, base check and the learned list's verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules)


@query
def op3_bwt_dedup(spark, sf_dir):
    """Bytes of every document that repeat a 100-byte string that starts earlier, as digests."""
    return bwt_dedup.digest(bwt_dedup.remove_repeats(table(spark, sf_dir, "documents")))


@query
def op4_secret_scan(spark, sf_dir):
    """Base secrets and random-looking tokens of every document."""
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


@query
def op5_piece_tokens(spark, sf_dir):
    """SentencePiece ids (by the prefix table) and the decoded text of every document, as digests."""
    return piece_tokens.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: Hosts whose pages make up the list that op6 filters against.
LISTED_HOSTS = "spam|pills|casino"


@query
def op6_url_filter(spark, sf_dir):
    """Rule or list verdict of every page; the list is the canonical URLs of the spam hosts' pages."""
    pages = table(spark, sf_dir, "pages")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    listed = pages.where(host.rlike(LISTED_HOSTS)).select(url_filter.canonical(host, path).alias("canonical"))
    return url_filter.judge(pages, listed)


ORACLE["op6_url_filter"] = r"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r, '\A[^/?#]*([^?#]*)', 1) AS path FROM rest),
named AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '\Awww\.', ''), ':(80|443)\z', '')
                         || regexp_replace(path, '/+\z', '') END AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, 'spam|pills|casino') AND canonical IS NOT NULL),
ruled AS (SELECT n.*, l.canonical IS NOT NULL AS listed, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM named n LEFT JOIN listed l USING (canonical))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict, canonical, listed FROM ruled
"""


@query
def op7_ann_forest(spark, sf_dir):
    """The 5 nearest vectors found of every vector whose id is divisible by 50."""
    return ann_forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op8_line_dedup(spark, sf_dir):
    """Every document without the lines that are boilerplate on its source, and how many were dropped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_lines(docs, dropped="n_dropped")


#: Line dedup over a view ``{docs}`` of documents; one row number stands for a row.
_LINE_DEDUP_CTES = r"""
numbered AS (SELECT *, row_number() OVER () AS rid FROM {docs}),
lines AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM numbered),
totals AS (SELECT source, count(*) AS host_pages FROM numbered GROUP BY source),
frequent AS (SELECT source, line, count(DISTINCT rid) AS n_pages FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line HAVING count(DISTINCT rid) >= 5),
bad AS (SELECT f.source, f.line FROM frequent f JOIN totals t ON f.source IS NOT DISTINCT FROM t.source WHERE n_pages > 0.1 * host_pages),
marked AS (SELECT l.*, b.line IS NOT NULL AS drop_it FROM lines l LEFT JOIN bad b ON l.line = b.line AND l.source IS NOT DISTINCT FROM b.source),
cleaned AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drop_it), '') AS clean,
  count(*) FILTER (WHERE drop_it) AS n_dropped FROM marked GROUP BY rid)
"""
ORACLE["op8_line_dedup"] = "WITH " + _LINE_DEDUP_CTES.replace("{docs}", "documents") + """
SELECT n.doc_id, n.source, c.clean AS text, coalesce(c.n_dropped, 0) AS n_dropped
FROM numbered n LEFT JOIN cleaned c USING (rid)
"""


@query
def op9_curve_packing(spark, sf_dir):
    """Every document's tokens packed into sequences along the Hilbert curve."""
    return curve_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                        public_tokenizers.PATTERN)


@query
def op10_ngram_join(spark, sf_dir):
    """Size of every document's set of 4-word shingles and its component of links at 85 percent."""
    return ngram_join.join(table(spark, sf_dir, "documents"), words=4, percent=85)


@query
def op11_phrase_graph(spark, sf_dir):
    """The 2000 best collocations of every language."""
    return phrase_graph.mine(table(spark, sf_dir, "documents"))


@query
def op12_merkle_manifest(spark, sf_dir):
    """Leaf, roots and proof of every document, and what a copy with lower-cased texts folds to."""
    docs = table(spark, sf_dir, "documents")
    proven = merkle_manifest.manifest(docs, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"],
                                      merkle_manifest.tampered(docs, "doc_id", "text"))
    return merkle_manifest.digest(proven, "doc_id")


@query
def op13_katz_lm(spark, sf_dir):
    """Log-probability of every document, learned from those whose hash does not hold them out."""
    docs = table(spark, sf_dir, "documents")
    out = katz_lm.score(docs, ~katz_lm.held_out(F.col("doc_id")))
    return out.withColumn("held_out", ~F.col("training")).drop("training")
