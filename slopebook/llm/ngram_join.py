"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence matrix.

A document's row holds its distinct word n-grams (hashed).  Two documents link
when ``100 * overlap >= percent * union``.  The product of the incidence matrix
with its transpose is taken in blocks, and only where the sizes allow a link:

1. Columns are put in one global order, frequent n-grams last.  A document is
   entered only in the first ``n - ceil(percent*n/100) + 1`` of its columns:
   documents that link share one of these.
2. Equal sets become one node, so copies are never paired with each other.
3. Every node points at the hub (smallest node) it shares most columns with;
   following the pointers gives groups of like documents.  Where groups meet
   in columns, the overlaps of a node with the larger group are accumulated; a
   node that could reach the bound that the sizes imply takes part in that group
   as a visitor, all others are discarded.
4. The documents of a group are sifted before any whole set is moved: one that
   shares too few prefix columns with each other document there, or whose sketch
   (its n-grams counted by hash, some two bits an n-gram) allows no overlap
   that is large enough, links with nothing in the group.
5. What is left is multiplied in numpy on whole sets, in blocks of bounded size: a
   row is multiplied with the columns of what is not yet connected, so a group of
   copies costs one product, and no pair is ever a row of a table.
6. Links join into components by alternating star contraction.

Only the order of columns and the groups are heuristic (they decide how much
work there is, not which links are found).  N-grams, words and sets are
compared by 64-bit hashes.

Edge cases: null, empty and wordless texts have no n-gram and link with
nothing; fewer words than ``words`` make one n-gram of the whole sequence;
rows with a null id are answered with themselves (component null) and link
with nothing; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopebook.llm.arrays import SPACES, byte_set, combine, hashed_words, mix, text_bytes, text_slices
from slopebook.llm.common import field, fresh, ship_package, with_text_columns
from slopebook.llm.url_filter import bloom, bloom_bits, bloom_block
from slopebook.plans.session import step

WORDS, PERCENT = 5, 80
#: Frequent n-grams that are moved to the end of the order, at most (16 bytes each in every task).
MAX_FREQUENT = 200_000
#: Occurrences that make an n-gram frequent, among those counted.
MIN_FREQUENT = 30
#: A task counts n-grams over so many incidences at once, and reports those met at least so often.
COUNT_CELLS, COUNT_LEAST = 4_000_000, 3
#: Incidences that one side of a block product holds.
BLOCK_CELLS = 4_000_000
#: Sizes of documents (n-grams in all) that one side of a sifted block has.
SIFT_CELLS = 8_000_000
#: N-grams for each bin of a sketch, at least.
SKETCH_SHARE = 4
#: Share of a node's prefix that it must have in common with its hub to join its group.
GROUP_PERCENT = 20

_MULTIPLIERS = np.random.default_rng(64).integers(1, 2 ** 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD = ~byte_set(SPACES)


def ngram_sets(texts: list[str | None] | pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes (int64) of each text.

    Words of many texts are hashed at once (capital ASCII letters as small
    ones); an n-gram's hash is a sum over its words' hashes, each times the
    number of its place.
    """
    data, offsets = text_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    for first, last in text_slices(offsets):
        cut = offsets[first:last + 1]
        h, starts = hashed_words(data, cut, WORD)
        bounds = np.searchsorted(starts, cut)
        with np.errstate(over="ignore"):
            key = np.zeros(max(len(h) - words + 1, 0), dtype=np.uint64)
            for k in range(words):
                key += h[k:len(h) - words + 1 + k] * _MULTIPLIERS[k] if len(key) else 0
            key = mix(key).view(np.int64)
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if end - start >= words:
                yield np.unique(key[start:end - words + 1])
            elif end > start:
                whole = np.full(1, end - start, dtype=np.uint64)
                for at in range(start, end):
                    whole = combine(whole, h[at:at + 1])
                yield whole.view(np.int64)
            else:
                yield np.zeros(0, dtype=np.int64)


def ngrams(text: str | None, words: int) -> np.ndarray:
    """The n-grams of one text."""
    return next(ngram_sets([text], words))


def least_overlap(n1, n2, percent: int):
    """The smallest overlap with which sets of these sizes link (numbers or columns)."""
    return -((-percent * (n1 + n2)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def frequent_ngrams(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """Frequent n-grams of all documents, rarest first: a summary of bounded size.

    Every task counts exactly over runs of documents and reports n-grams met
    ``COUNT_LEAST`` times or more in a run; the reports are added up.
    """
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = [], 0

        def report():
            got, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= COUNT_LEAST
            return pa.RecordBatch.from_arrays([pa.array(got[often]), pa.array(n[often])], names=["gram", "n"])
        for batch in batches:
            for grams in ngram_sets(batch.column(0), words):
                held.append(grams)
                cells += len(grams)
                if cells >= COUNT_CELLS:
                    yield report()
                    held, cells = [], 0
        if cells:
            yield report()

    top = (docs.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
           .where(F.col("n") >= MIN_FREQUENT).orderBy(F.desc("n"), "gram").limit(MAX_FREQUENT).toPandas())
    return top["gram"].to_numpy(dtype=np.int64)[::-1].copy()


class ColumnOrder:
    """The global order of columns: n-grams by hash, the frequent ones after all others, rarest first."""

    def __init__(self, frequent: np.ndarray):
        self.rank = np.argsort(frequent, kind="stable")
        self.grams = frequent[self.rank]

    def arrange(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams) or not len(grams):
            return grams
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        often = self.grams[at] == grams
        return np.concatenate([grams[~often], grams[often][np.argsort(self.rank[at[often]], kind="stable")]])


def node_of(grams: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes()))))


def sketch(grams: np.ndarray) -> bytes:
    """N-grams counted by the low bits of their hashes, a byte a bin; empty (nothing known) if a bin overflows."""
    width = 1 << max(len(grams) // SKETCH_SHARE, 1).bit_length() - 1
    bins = np.bincount(grams & np.int64(width - 1), minlength=width)
    return bins.astype(np.uint8).tobytes() if bins.max() < 256 else b""


def document_rows(docs: DataFrame, order: ColumnOrder, words: int, percent: int, id_col: str, text: str) -> DataFrame:
    """doc_id, n_shingles, node, prefix (the document's first columns), sketch per row."""
    known = docs.sparkSession.sparkContext.broadcast(order)  # at most MAX_FREQUENT n-grams
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("__text"))

    def compute(texts):
        for grams in ngram_sets(texts, words):
            n = len(grams)
            yield (n, node_of(grams), known.value.arrange(grams)[:prefix_length(n, percent)], sketch(grams)) if n else (0, None, [], None)

    fields = [field("n_shingles", "long"), field("node", "long"), field("prefix", "longs"), field("sketch", "binary")]
    return with_text_columns(slim, "__text", fields, compute).drop("__text")


def incidence(nodes: DataFrame) -> DataFrame:
    """gram, node, hub: the entries of columns that two or more nodes meet in; the hub is the smallest.

    Smallest and largest node are combined before the shuffle; the join back
    splits hot columns.  The hubs are written first, so that only one of the two
    shuffles is on disk at a time.  Sizes are joined later, to the few entries that are left.
    """
    cells = nodes.select("node", F.explode("prefix").alias("gram"))
    stats = step(cells.groupBy("gram").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
                 .where("hub < last").select("gram", "hub"), "ngram_hubs")
    return step(cells.join(stats, "gram"), "ngram_columns", [stats])


def group_nodes(cells: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """node, n, grp: every node of ``cells`` with the root of its hub pointers.

    A node points at the smaller node with which it shares most columns, if
    they are at least ``GROUP_PERCENT`` of its prefix; pointers lead to ever
    smaller nodes, so jumping along them ends after log2(longest path) rounds.
    """
    met = step(cells.select("node").distinct().join(nodes.select("node", "n"), "node"), "ngram_met")
    shared = cells.where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c"))
    best = (shared.groupBy("node").agg(F.max(F.struct("c", "hub")).alias("b"))
            .select("node", F.col("b.hub").alias("up"), F.col("b.c").alias("c")).join(met, "node"))
    prefix = F.floor((100 - percent) * F.col("n") / 100) + 1
    ups = step(best.where(100 * F.col("c") >= GROUP_PERCENT * prefix).select("node", "up"), "ngram_up")
    while True:
        ups = step(ups.alias("a").join(ups.alias("b"), F.col("a.up") == F.col("b.node"), "left")
                   .select(F.col("a.node").alias("node"), F.coalesce("b.up", "a.up").alias("up"),
                           F.col("b.up").isNotNull().alias("moved")), "ngram_up", [ups])
        if ups.where("moved").limit(1).count() == 0:
            break
    return step(met.join(ups, "node", "left").select("node", "n", F.coalesce("up", "node").alias("grp")), "ngram_groups", [met, ups])


def visitors(cells: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """node, grp: nodes that may link with a member of another group, and so take part in its product.

    Where two groups meet in a column, only the nodes of the smaller one are
    counted (of equal ones, of the smaller id), so a large group never makes
    rows for its visitors.  A node's overlap with a member is at most the columns it
    shares with the group, plus the longer rest beyond the two prefixes; pairs
    of node and group below what the sizes ask for are discarded.
    """
    own = step(cells.select("gram", "node").join(groups, "node"), "ngram_cells")
    facts = groups.groupBy("grp").agg(
        F.count(F.lit(1)).alias("size"), F.min("n").alias("low"), F.max("n").alias("high"))
    met = own.select("gram", "grp").distinct()
    common = met.groupBy("gram").agg(F.count(F.lit(1)).alias("g")).where("g > 1").select("gram")
    host = (met.join(common, "gram").join(facts, "grp")
            .select("gram", F.col("grp").alias("host"), F.col("size").alias("host_size"), "low", "high"))
    guest = own.join(common, "gram").join(facts.select("grp", "size"), "grp")
    n, low, high = F.col("n"), F.col("low"), F.col("high")
    smaller = (F.col("size") < F.col("host_size")) | ((F.col("size") == F.col("host_size")) & (F.col("grp") < F.col("host")))
    rows = guest.join(host, "gram").where(smaller & (100 * high >= percent * n) & (100 * n >= percent * low))

    def needed(m):
        """Columns that sets of n and m n-grams must share within their prefixes."""
        rest = F.greatest(F.floor(percent * n / 100), F.floor(percent * m / 100)) + 1
        return F.ceil(percent * (n + m) / (100 + percent)) - rest
    # The bound is least at an end of the sizes that can link at all.
    least_size = F.greatest(low, F.ceil(percent * n / 100))
    most_size = F.least(high, F.floor(100 * n / percent))
    counted = rows.groupBy("node", "n", "host", "low", "high").agg(F.count(F.lit(1)).alias("c"))
    found = counted.where(F.col("c") >= F.least(needed(least_size), needed(most_size))).select("node", F.col("host").alias("grp"))
    return step(found, "ngram_visitors", [own])


class Columns:
    """The incidence matrix of some sets, held by columns."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        grams, self.column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        self.rows_of = row[np.argsort(self.column, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.column, minlength=len(grams)))])
        self.firsts = np.concatenate([[0], np.cumsum(sizes)])

    def met(self, x: int) -> np.ndarray:
        """The rows that share a column with row ``x``, once for each column that others have too."""
        cols = self.column[self.firsts[x]:self.firsts[x + 1]]
        wide = cols[self.starts[cols + 1] - self.starts[cols] > 1]
        if not len(wide):
            return np.zeros(0, dtype=np.int64)
        lens = self.starts[wide + 1] - self.starts[wide]
        at = np.repeat(self.starts[wide] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        return self.rows_of[at]


def folded(bins: np.ndarray, width: int) -> np.ndarray:
    """Rows of sketches with ``width`` bins (both are powers of two)."""
    return bins if bins.shape[1] == width else bins.reshape(len(bins), -1, width).sum(axis=1, dtype=np.int64)


def sift(sizes: np.ndarray, columns: list[np.ndarray], sketches: list[bytes], percent: int) -> np.ndarray:
    """Whether each of these documents may link with another of them.

    sizes: of the whole sets; columns: the prefix columns that others meet in.
    Two sets share at most what their prefixes share and what the larger one
    has beyond its prefix, and at most the lesser of the two counts in each
    bin of their sketches.
    """
    matrix = Columns(columns)
    width = np.array([len(s) for s in sketches], dtype=np.int64)
    bins, place = {}, np.zeros(len(width), dtype=np.int64)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        place[at] = np.arange(len(at))
        bins[w] = np.frombuffer(b"".join(sketches[k] for k in at), dtype=np.uint8).reshape(len(at), w)
    may = np.zeros(len(sizes), dtype=bool)
    for x in range(len(sizes)):
        if may[x]:
            continue
        near, shared = np.unique(matrix.met(x), return_counts=True)
        beyond = -(-percent * np.maximum(sizes[near], sizes[x]) // 100) - 1
        least = least_overlap(sizes[near], sizes[x], percent)
        hit = (near != x) & (least <= np.minimum(sizes[near], sizes[x])) & (shared + beyond >= least)
        near, least = near[hit], least[hit]
        fits = np.ones(len(near), dtype=bool)
        for w in np.unique(width[near]).tolist() if width[x] else []:
            if w:
                at, both = np.flatnonzero(width[near] == w), min(w, int(width[x]))
                mine = folded(bins[int(width[x])][place[x]][None], both)
                most = np.minimum(folded(bins[w][place[near[at]]], both), mine).sum(axis=1, dtype=np.int64)
                fits[at] = most >= least[at]
        may[near[fits]] = True
        may[x] = fits.any()
    return may


def in_blocks(members: DataFrame) -> DataFrame:
    """``members`` (node, grp, blocks, ...) at every pair i, j of blocks of the group that the node's block is in."""
    return (members.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other")))


def several(members: DataFrame, nodes: DataFrame, cells: int) -> DataFrame:
    """node, grp, blocks: the members of groups of two or more, and the blocks that so many n-grams of the group ask for."""
    sizes = (members.join(nodes.select("node", "n"), "node").groupBy("grp")
             .agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("cells")).where("m > 1"))
    return members.join(sizes.select("grp", F.ceil(F.col("cells") / cells).cast("int").alias("blocks")), "grp")


def sifted(members: DataFrame, cells: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The rows of ``members`` (node, grp) that may link with another one of their group."""
    columns = cells.groupBy("node").agg(F.collect_list("gram").alias("columns"))
    facts = nodes.select("node", "n", "sketch").join(columns, "node")
    placed = in_blocks(several(members, nodes, SIFT_CELLS)).join(facts, "node").select("node", "grp", "i", "j", "n", "columns", "sketch")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["n"].to_numpy(dtype=np.int64)
        may = sift(sizes, [np.asarray(c, dtype=np.int64) for c in pdf["columns"]], [bytes(s) for s in pdf["sketch"]], percent)
        return pdf.loc[may, ["node", "grp"]]

    return placed.groupBy("grp", "i", "j").applyInPandas(product, "node long, grp long").distinct()


def peel(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of these documents, by sparse row products.

    A document's product with what is not yet connected gives all its overlaps;
    what links leaves the rest and is expanded in turn, so connected documents
    are not compared again.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    matrix = Columns(sets)
    left = np.ones(len(sets), dtype=bool)
    out: list[tuple[int, int]] = []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue and left.any():
            x = queue.pop()
            met = matrix.met(x)
            if not len(met):
                continue
            overlap = np.bincount(met, minlength=len(sets))
            hit = np.flatnonzero(left & (overlap >= least_overlap(sizes, sizes[x], percent)) & (overlap > 0))
            left[hit] = False
            queue += hit.tolist()
            out += [(int(nodes[x]), int(nodes[k])) for k in hit]
    return out


def placed_sets(docs: DataFrame, places: DataFrame, words: int, id_col: str, text: str) -> DataFrame:
    """node, grams (the whole set as little-endian longs), grp, i, j: the sets where they are multiplied.

    places: doc_id and its (node, grp, blocks). A Bloom filter of the wanted ids
    (bounded, broadcast) drops most other texts before any is shuffled; a row
    that is repeated is read once.
    """
    asked = F.col("doc_id")
    slim = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("__text"))
            .withColumn("__block", bloom_block(asked)).join(F.broadcast(bloom(places, "doc_id")), F.col("__block") == F.col("block"))
            .where(F.col("word").bitwiseAND(bloom_bits(asked)) == bloom_bits(asked)).select("doc_id", "__text")
            .repartition("doc_id").dropDuplicates(["doc_id", "__text"]).join(places, "doc_id"))

    def compute(texts):
        for grams in ngram_sets(texts, words):
            yield (node_of(grams), grams.tobytes()) if len(grams) else (None, b"")

    got = with_text_columns(slim, "__text", [field("node", "long"), field("grams", "binary")], compute)
    # A group has one block, or as many as its size asks for; each pair of blocks is one product.
    here = got.select("node", "grams", F.explode("places").alias("p")).where("node = p.node")
    return in_blocks(here.select("node", "grams", "p.grp", "p.blocks")).select("node", "grams", "grp", "i", "j")


def links(docs: DataFrame, nodes: DataFrame, words: int, percent: int, id_col: str, text: str) -> DataFrame:
    """a, b: links that span the components of ``nodes`` (node, n, doc_id, prefix, sketch)."""
    cells = incidence(nodes)
    groups = group_nodes(cells, nodes, percent)
    guests = visitors(cells, groups, percent)
    taking_part = step(groups.select("node", "grp").union(guests), "ngram_members", [groups, guests])
    left = step(sifted(taking_part, cells, nodes, percent), "ngram_sifted", [taking_part, cells])
    members = several(left, nodes, BLOCK_CELLS).join(nodes.select("node", "doc_id"), "node")
    places = step(members.groupBy("doc_id").agg(F.collect_set(F.struct("node", "grp", "blocks")).alias("places")), "ngram_places", [left])
    placed = placed_sets(docs, places, words, id_col, text)

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        found = peel(pdf["node"].to_numpy(), [np.frombuffer(g, dtype="<i8") for g in pdf["grams"]], percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return placed.groupBy("grp", "i", "j").applyInPandas(product, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for nodes with an edge.

    Alternating star contraction: every round hangs neighbours on smaller ones
    until each component is one star.  Minima are combined before the shuffle.
    """
    edges = step(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")

    def state(e):
        return e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()

    before = state(edges)
    while before["n"]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = step(large, "star", [edges])
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = step(small, "star", [large])
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs``."""
    order = ColumnOrder(frequent_ngrams(docs, text, words))
    whole = step(document_rows(docs, order, words, percent, id_col, text), "ngram_rows")
    known = whole.where("node is not null and doc_id is not null")
    nodes = step(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"),
                                           F.min("prefix").alias("prefix"), F.min("sketch").alias("sketch")), "ngram_nodes")
    # Prefixes and sketches make up most of both tables: they go as soon as they are no more read.
    rows = step(whole.select("doc_id", "n_shingles", "node"), "ngram_sizes", [whole])
    roots = step(components(links(docs, nodes, words, percent, id_col, text)), "ngram_roots")
    named = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = step(named.join(smallest, "root").select("node", "component_id"), "ngram_of_node", [nodes, roots])
    # A row whose id is null has no component of its own.
    return (rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
            .join(of_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                         id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with their columns unchanged.

    Rows with a null id stay; of rows that repeat an id that stays, one (of
    smallest hash) stays.  Only rows whose id passes a Bloom filter of the ids
    that go (bounded, broadcast) are shuffled; the others stay where they are.
    """
    found = step(join(docs, words, percent, id_col, text), "ngram_components")
    gone_id, nth, block, bits, word = fresh(docs, "__gone", "__nth", "__block", "__bits", "__word")
    gone = step(found.where("component_id < doc_id").select(F.col("doc_id").alias(gone_id)).distinct(), "ngram_gone")
    asked = docs[id_col].cast("long")
    blocks = F.broadcast(bloom(gone, gone_id).select(F.col("block").alias(block), F.col("word").alias(word)))
    marked = docs.withColumns({block: bloom_block(asked), bits: bloom_bits(asked)}).join(blocks, block, "left")
    passes = F.coalesce(F.col(word).bitwiseAND(F.col(bits)) == F.col(bits), F.lit(False))
    maybe = marked.where(passes).select(docs.columns)
    kept = marked.where(~passes).select(docs.columns).union(
        maybe.join(gone, maybe[id_col].cast("long") == F.col(gone_id), "left_anti"))
    repeated = found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias(gone_id))
    repeated = step(repeated, "ngram_repeated", [found])
    if repeated.limit(1).count() == 0:
        return kept
    same = F.col(id_col).cast("long") == F.col(gone_id)
    alone = kept.join(repeated, same, "left_anti")
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(*docs.columns))
    once = kept.join(repeated, same, "left_semi").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth)
    return alone.union(once)
