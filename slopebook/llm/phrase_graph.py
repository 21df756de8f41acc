"""Collocations from a weighted de Bruijn graph of words.

Nodes are runs of three words, edges runs of four; an edge's weight is the
number of its occurrences within pieces (stretches of text without punctuation),
for each language on its own.  Only edges and the ends of pieces are counted::

    f(three words) = weights of the edges that leave the node + pieces that end with it
    f(two words)   = f of the three-word runs that begin with them + pieces that end with them

* One scan cuts the corpus into blocks of word ids, written once.  Distinct words
  are counted by hash buckets; a word met fewer than ``MIN_COUNT`` times is in no
  candidate, so it ends a piece.  The others get numbers, which their buckets give.
* A block's runs (four words, or what is left before the end of a piece), sorted
  and counted, are dealt by the hash of the whole run, so neither a hot word nor a
  hot node gathers in a task.
* Buckets add up equal runs and pass each node's partial flow on, dealt by the
  node; that is done for runs of four, three and two words.  What has
  ``MIN_COUNT`` or more goes to the table of frequent runs.  Blocks and buckets are
  taken in ``SHARES`` shares, so that what is shuffled is never on disk as a whole
  beside what it is read from.
* Unary paths of the frequent graph (a node that one edge enters and one leaves,
  both with the node's own count) are compacted by pointer jumping.  Inner nodes
  of a path are never phrases of their own, and a phrase is told the length of
  the path that it lies on.

Scores are computed in decimals of 38 digits.  Nothing is pruned that could be,
or be part of, a candidate.

Edge cases: a null language is ``und``; null and empty texts have no piece; rows
with null ids and repeated rows count as any other; an empty table, or one
without a frequent run, has no rows; extra columns are ignored.  Words are told
apart by 64-bit hashes of language and lower-cased bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopebook.llm.arrays import byte_set, combine, hashed_words, mix, pack, text_bytes, text_slices, unpack
from slopebook.llm.common import ship_package
from slopebook.plans.session import discard, step

LONGEST = 4
MIN_COUNT = 30
#: A phrase goes when a longer one around it has this share (percent) of its occurrences.
INSIDE_PERCENT = 80
TOP = 2000
FACTOR = 2_000_000
BLOCK_WORDS = 2_000_000
#: Words of the corpus for each bucket.
BUCKET_WORDS = 500_000
#: Shares in which runs are shuffled, one after another.
SHARES = 4
#: Words of a block whose runs are sorted at once.
SORT_WORDS = 250_000

#: Texts over this size are read in parts that end after a break.
LONG_BYTES = 4_000_000

BREAKS = byte_set(b".,;:!?\n\x0b\x0c\r")
WORD = ~(BREAKS | byte_set(b" \t"))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

BLOCKS = "block long, keys binary, texts binary, langs array<string>, lang binary, tokens binary, firsts binary, n long"
REQUESTS = "bucket int, block long, keys binary, n binary"
REPLIES = "bucket int, block long, ids binary, total binary, own binary"
RUNS = "bucket int, words array<binary>, n binary, id long, lang string, word string, f long"
FLOWS = "bucket int, words array<binary>, n binary, run array<long>, f long"


class Chunk:
    """Words of some texts: ids into the distinct words, and which words are first in their piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, lang_keys: np.ndarray):
        hashes, starts = hashed_words(data, offsets, WORD)
        base = int(offsets[0])
        part = data[base:int(offsets[-1])]
        text = np.searchsorted(offsets, starts, side="right") - 1
        self.size = len(hashes)
        piece = np.cumsum(BREAKS[part])[starts - base] if self.size else np.zeros(0, dtype=np.int64)
        self.firsts = np.ones(self.size, dtype=bool)
        self.firsts[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
        keys = combine(lang_keys[langs[text]], hashes)
        self.keys, first, self.tokens = np.unique(keys, return_index=True, return_inverse=True)
        self.lang = langs[text[first]] if self.size else np.zeros(0, dtype=np.int64)
        stops = np.append(np.flatnonzero(~WORD[part]), len(part))
        begin = starts[first] - base
        end = np.minimum(stops[np.searchsorted(stops, begin)], offsets[text[first] + 1] - base) if self.size else begin
        raw = part.tobytes().translate(_LOWER)
        self.words = [raw[b:e] for b, e in zip(begin.tolist(), end.tolist())]


def block_row(number: int, chunks: list[Chunk], names: list[str]) -> pa.RecordBatch:
    keys, first, at = np.unique(np.concatenate([c.keys for c in chunks]), return_index=True, return_inverse=True)
    words = [w for c in chunks for w in c.words]
    lang = np.concatenate([c.lang for c in chunks])
    firsts = np.cumsum([0] + [len(c.keys) for c in chunks])
    tokens = np.concatenate([at[s:s + len(c.keys)][c.tokens] for s, c in zip(firsts, chunks)])
    order = np.lexsort((keys, -np.bincount(tokens, minlength=len(keys))))
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    texts = b"\n".join(words[i] for i in first[order])
    texts = len(texts).to_bytes(8, "little") + pa.compress(texts, codec="zstd", asbytes=True)
    blobs = [pack(lang[first[order]]), pack(rank[tokens]), pack(np.packbits(np.concatenate([c.firsts for c in chunks])))]
    values = [number, pack(keys[order], True), texts, names, *blobs, len(tokens)]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 3, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[c.split()[0] for c in BLOCKS.split(", ")])


def cut_long(data: np.ndarray, offsets: np.ndarray, size: int = LONG_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with cuts after a break in texts of over ``size`` bytes, and the text of each part: pieces need not stay together."""
    long = np.flatnonzero(np.diff(offsets) > size)
    cuts = []
    for i in long:
        places = np.flatnonzero(BREAKS[data[offsets[i]:offsets[i + 1]]]) + offsets[i] + 1
        wanted = np.searchsorted(places, np.arange(offsets[i] + size, offsets[i + 1], size))
        cuts.append(np.unique(places[wanted[wanted < len(places)]]))
        cuts[-1] = cuts[-1][cuts[-1] < offsets[i + 1]]
    text = np.concatenate([np.arange(len(offsets) - 1), *(np.full(len(c), i) for i, c in zip(long, cuts))]).astype(np.int64)
    starts = np.concatenate([offsets[:-1], *cuts])
    order = np.lexsort((starts, text))
    return np.append(starts[order], offsets[-1]), text[order]


def block_maker(block_words: int):
    """Makes blocks of the rows (lang, text) of a partition."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        made, held, size, names, known = 0, [], 0, [], {}
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            offsets, text = cut_long(data, offsets)
            langs = np.array([known.setdefault(v, len(known)) for v in batch.column(0).to_pylist()], dtype=np.int64)[text]
            names += list(known)[len(names):]
            keys = np.array([xxhash.xxh3_64_intdigest(v.encode("utf-8", "surrogatepass")) for v in names], dtype=np.uint64)
            for first, last in text_slices(offsets):
                chunk = Chunk(data, offsets[first:last + 1], langs[first:last], keys)
                if not chunk.size:
                    continue
                held.append(chunk)
                size += chunk.size
                if size >= block_words:
                    made += 1
                    yield block_row(task + made, held, names)
                    held, size = [], 0
        if held:
            yield block_row(task + made + 1, held, names)
    return make


def dealt(number: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of an ascending array."""
    filled, starts = np.unique(number, return_index=True)
    for b, start, end in zip(filled, starts, [*starts[1:], len(number)]):
        yield int(b), slice(int(start), int(end))


def key_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def word_requests(blocks: DataFrame, buckets: int) -> DataFrame:
    """Every block's distinct words and their counts, dealt into buckets by hash."""
    def ask(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                number, keys, tokens = (batch.column(c)[r].as_py() for c in range(3))
                keys = unpack(keys, np.uint64, True)
                n = np.bincount(unpack(tokens, np.int32), minlength=len(keys))
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], n[order]
                rows = [(b, number, pack(keys[s], True), pack(n[s])) for b, s in dealt(key_bucket(keys, buckets))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                                 names=["bucket", "block", "keys", "n"])

    return blocks.select("block", "keys", "tokens").mapInArrow(ask, REQUESTS)


def number_words(buckets: int, least: int):
    """Sums the words of a bucket and numbers the frequent ones; a number is never given twice."""
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        bucket = int(pdf["bucket"].iloc[0])
        keys = [unpack(k, np.uint64, True) for k in pdf["keys"]]
        _, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = sums(at, np.concatenate([unpack(b, np.int64) for b in pdf["n"]]))
        often = total >= least
        ids = np.where(often, (np.cumsum(often) - 1) * buckets + bucket, -1)
        own = np.zeros(len(at), dtype=bool)
        own[first] = True
        rows, start = [], 0
        for block, k in zip(pdf["block"], keys):
            s = slice(start, start + len(k))
            rows.append((bucket, block, pack(ids[at[s]]), pack(total[at[s]]), pack(np.packbits(own[s]))))
            start += len(k)
        return pd.DataFrame(rows, columns=["bucket", "block", "ids", "total", "own"])
    return count


def sums(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Exact sums of ``n`` by group number (every group has a member)."""
    order = np.argsort(at, kind="stable")
    sizes = np.bincount(at)
    return np.add.reduceat(n[order], np.cumsum(sizes) - sizes) if len(at) else np.zeros(0, dtype=np.int64)


def summed_runs(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns``, ascending, and their sums."""
    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    new = np.ones(len(n), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    starts = np.flatnonzero(new)
    return [c[starts] for c in columns], np.add.reduceat(n, starts) if len(n) else n


def dealt_runs(columns: list[np.ndarray], n: np.ndarray, buckets: int) -> Iterator[tuple[int, list[bytes], bytes]]:
    """Packed runs by bucket (the hash of the whole run), ascending in each."""
    key = np.zeros(len(n), dtype=np.uint64)
    for c in columns:
        key = combine(key, c.view(np.uint64))
    number = key_bucket(mix(key), buckets)
    order = np.argsort(number, kind="stable")
    places = list(dealt(number[order]))
    del key, number

    def packed(c, steps=False):  # a column is in order only while it is packed
        c = c[order]
        return [pack(c[s], steps) for _b, s in places]
    blobs = [packed(c, k == 0) for k, c in enumerate(columns)]
    for (b, _s), words, total in zip(places, zip(*blobs), packed(n)):
        yield b, list(words), total


def longest_runs(ids: np.ndarray, firsts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The run of up to four words from every word (-1 where its piece is over), distinct, with counts.

    ids: numbers of a block's words in order, -1 for words that are not frequent, which end a piece.
    """
    often = ids >= 0
    begin = firsts.copy()
    begin[1:] |= ~often[:-1]
    word, begin = ids[often], begin[often]
    if not len(word):
        return [np.zeros(0, dtype=np.int64)] * LONGEST, np.zeros(0, dtype=np.int64)
    run = np.cumsum(begin, dtype=np.int32)
    known = np.unique(word)
    local = np.searchsorted(known, word).astype(np.int32)
    size = len(known) + 1
    names = np.append(-1, known)
    del word, begin
    # Runs by their first word, so many at once that the sorts stay small.
    before = np.cumsum(np.bincount(local)) - 1
    part = (before // SORT_WORDS).astype(np.int32)[local]
    found: list[list[np.ndarray]] = []
    for p in np.unique(part):
        at = np.flatnonzero(part == p)

        def ahead(k):
            to = np.minimum(at + k, len(local) - 1)
            return np.where((at + k < len(local)) & (run[to] == run[at]), local[to].astype(np.int64) + 1, 0)
        # Pairs of words, then pairs of pairs: two sorts of single numbers instead of one of four columns.
        left, left_at = np.unique((local[at] + np.int64(1)) * size + ahead(1), return_inverse=True)
        right, right_at = np.unique(ahead(2) * np.int64(size) + ahead(3), return_inverse=True)
        both, n = np.unique(left_at * np.int64(len(right)) + right_at, return_counts=True)
        first, second = left[both // len(right)], right[both % len(right)]
        found.append([names[c] for c in (first // size, first % size, second // size, second % size)] + [n])
    *columns, n = (np.concatenate([f.pop(0) for f in found]) for _ in range(LONGEST + 1))
    return columns, n


def runs(blocks: DataFrame, replies: DataFrame, buckets: int, least: int) -> DataFrame:
    """Every block's runs, dealt into buckets, a row (id, lang, word, f) for each frequent word that it owns (bucket -1)
    and the block's words of each language (bucket -2)."""
    def one(mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        r = mine.iloc[0]
        answers = answers.sort_values("bucket")
        keys, tokens = unpack(r["keys"], np.uint64, True), unpack(r["tokens"], np.int32)
        order = np.argsort(keys, kind="stable")
        ids, total, own = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=bool)
        parts = [unpack(t, np.int64) for t in answers["ids"]]
        ids[order] = np.concatenate(parts)
        total[order] = np.concatenate([unpack(t, np.int64) for t in answers["total"]])
        own[order] = np.concatenate([np.unpackbits(unpack(o, np.uint8), count=len(p)) for o, p in zip(answers["own"], parts)])
        firsts = np.unpackbits(unpack(r["firsts"], np.uint8), count=len(tokens)).astype(bool)
        columns, n = longest_runs(ids[tokens], firsts)
        rows = [(b, w, c, 0, None, None, 0) for b, w, c in dealt_runs(columns, n, buckets)]
        mine_too = np.flatnonzero(own & (ids >= 0))
        texts = pa.decompress(r["texts"][8:], int.from_bytes(r["texts"][:8], "little"), codec="zstd", asbytes=True).split(b"\n")
        lang = unpack(r["lang"], np.int64)
        rows += [(-1, None, None, ids[k], r["langs"][lang[k]], texts[k].decode("utf-8", "replace"), total[k]) for k in mine_too]
        of_lang = np.bincount(lang[tokens], minlength=len(r["langs"]))
        rows += [(-2, None, None, 0, name, None, n) for name, n in zip(r["langs"], of_lang)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RUNS.split(", ")])

    kept = blocks.select("block", "keys", "texts", "langs", "lang", "tokens", "firsts")
    return kept.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(one, RUNS)


def flow_bucket(width: int, buckets: int, least: int):
    """Sums the runs of a bucket; the frequent ones as rows, and the flow of each shorter run, dealt on.

    Runs that end with their piece are shorter than ``width`` (-1 in place of words) and flow on as they are.
    """
    def flow(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = [np.concatenate([unpack(w[k], np.int64, k == 0) for w in pdf["words"]]) for k in range(width)]
        columns, total = summed_runs(columns, np.concatenate([unpack(b, np.int64) for b in pdf["n"]]))
        often = np.flatnonzero((total >= least) & (columns[-1] >= 0))
        rows = [(-1, None, None, run, f) for run, f in zip(np.stack(columns, axis=1)[often].tolist(), total[often].tolist())]
        if width > 2:
            shorter, n = summed_runs(columns[:-1], total)
            rows += [(b, w, c, None, 0) for b, w, c in dealt_runs(shorter, n, buckets)]
        return pd.DataFrame(rows, columns=["bucket", "words", "n", "run", "f"])
    return flow


def in_shares(make: Callable[[Column], DataFrame], by: str, name: str) -> list[DataFrame]:
    """What ``make`` gives for each share of the values of ``by`` (a condition), written one after another."""
    return [step(make(F.pmod(F.xxhash64(by), F.lit(SHARES)) == k), name) for k in range(SHARES)]


def frequent_runs(edges: list[DataFrame], buckets: int, least: int) -> DataFrame:
    """run (numbers of two to four words), f: all that occur at least ``least`` times.

    Each level's flows are deleted when the next one is written (``edges`` too), so no more than two are on disk.
    """
    out, level = [], edges
    for width in range(LONGEST, 1, -1):
        flows = reduce(DataFrame.unionAll, [part.where("bucket >= 0").select("bucket", "words", "n") for part in level])
        add_up = flow_bucket(width, buckets, least)
        done, level = level, in_shares(lambda share: flows.where(share).groupBy("bucket").applyInPandas(add_up, FLOWS), "bucket", f"phrase_flow{width}")
        discard(*done)
        out += [step(part.where("bucket < 0").select("run", "f"), "phrase_often") for part in level]
    return step(reduce(DataFrame.unionAll, out), "phrase_frequent", [*level, *out])


def at_least(f: Column, percent: int, of: Column) -> Column:
    """100 * f >= percent * of, without overflow."""
    big = "decimal(24,0)"
    return F.lit(100).cast(big) * f.cast(big) >= F.lit(percent).cast(big) * of.cast(big)


def around(grams: DataFrame, width: int) -> DataFrame:
    """run, best, before, after: the largest frequent run one word longer that holds a run, and those that end and begin with it."""
    longer = grams.where(F.size("run") == width + 1)
    sides = longer.select(F.explode(F.array(F.struct(F.slice("run", 1, width).alias("run"), F.lit(True).alias("leaves")),
                                            F.struct(F.slice("run", 2, width).alias("run"), F.lit(False).alias("leaves")))).alias("s"), "f")
    return sides.groupBy("s.run").agg(F.max("f").alias("best"), F.max(F.when(~F.col("s.leaves"), F.col("f"))).alias("before"),
                                      F.max(F.when(F.col("s.leaves"), F.col("f"))).alias("after"))


def compact(grams: DataFrame) -> DataFrame:
    """run, head, at: every edge with the first edge of its unary path and its place there.

    An edge follows another when they meet in a node whose count is that of
    both (then nothing else enters, leaves, starts or ends there).  Every path
    has a first edge, for a piece begins somewhere before it; jumping along the
    links doubles the distance each round.
    """
    nodes = grams.where(F.size("run") == LONGEST - 1).join(around(grams, LONGEST - 1), "run")
    inner = nodes.where("before = f and after = f").select("run")
    edges = grams.where(F.size("run") == LONGEST)
    # The edge that enters an inner node with the node's count is the only one.
    inner = inner.join(edges.select(F.slice("run", 2, LONGEST - 1).alias("run"), F.col("run").alias("back")), "run")
    links = edges.join(inner.select(F.col("run").alias("node"), "back"), F.slice("run", 1, LONGEST - 1) == F.col("node"), "left")
    links = step(links.select("run", F.coalesce("back", "run").alias("head"), F.col("back").isNotNull().cast("long").alias("at")), "phrase_path")
    while True:
        far = links.select(F.col("run").alias("head"), F.col("head").alias("further"), F.col("at").alias("more"))
        moved = links.join(far, "head").select("run", F.col("further").alias("head"), (F.col("at") + F.col("more")).alias("at"),
                                               (F.col("further") != F.col("head")).alias("moved"))
        links = step(moved, "phrase_path", [links])
        if links.where("moved").limit(1).count() == 0:
            return links.drop("moved")


def scored(grams: DataFrame, words: DataFrame) -> DataFrame:
    """run, a, l, r, score of the candidates ``grams`` (with ``kept``): by the cut of lowest score, the first of equal ones."""
    counts = grams.select("run", "f").unionAll(words.select(F.array("id").alias("run"), "f"))
    size = F.size("run")
    cuts = (grams.where("kept").select("run", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
            .select("run", "a", "k", F.slice("run", F.lit(1), F.col("k")).alias("first"), F.slice("run", F.col("k") + 1, size - F.col("k")).alias("rest")))
    both = (cuts.join(counts.select(F.col("run").alias("first"), F.col("f").alias("l")), "first")
            .join(counts.select(F.col("run").alias("rest"), F.col("f").alias("r")), "rest"))
    score = F.expr(f"cast({FACTOR} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    worst = both.groupBy("run", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return worst.select("run", "a", "c.l", "c.r", "c.score")


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = MIN_COUNT, top: int = TOP,
         block_words: int = BLOCK_WORDS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, path_words: the best phrases of every language.

    a, l and r are the occurrences of the phrase and of the two parts of its
    worst cut, n the words of the language, path_words the length of the
    compacted path that the phrase lies on.
    """
    ship_package(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    blocks = step(slim.mapInArrow(block_maker(block_words), BLOCKS), "phrase_blocks")
    buckets = (blocks.agg(F.sum("n")).first()[0] or 0) // bucket_words + 1
    replies = word_requests(blocks, buckets).groupBy("bucket").applyInPandas(number_words(buckets, least), REPLIES)
    counted = step(replies, "phrase_words")
    edges = in_shares(lambda share: runs(blocks.where(share), counted.where(share), buckets, least), "block", "phrase_runs")
    discard(blocks, counted)
    found = reduce(DataFrame.unionAll, edges)
    words = step(found.where("bucket = -1").select("id", "lang", "word", "f"), "phrase_names")
    totals = step(found.where("bucket = -2").groupBy("lang").agg(F.sum("f").alias("n")), "phrase_totals")
    grams = frequent_runs(edges, buckets, least)
    paths = compact(grams)
    lengths = paths.groupBy("head").agg((F.max("at") + LONGEST).alias("path_words"))
    paths = paths.join(lengths, "head").select("run", "path_words")
    wider = around(grams, 2).unionAll(around(grams, 3)).select("run", "best")
    kept = F.col("best").isNull() | ~at_least(F.col("best"), INSIDE_PERCENT, F.col("f"))
    judged = step(grams.join(wider, "run", "left").select("run", "f", kept.alias("kept")), "phrase_judged")
    named = scored(judged, words).join(words.select("id", "lang"), F.col("run")[0] == F.col("id")).drop("id")
    # First without the texts, ties included; then the texts of what is left decide ties.
    short = named.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top)
    spelled = (short.select("run", "lang", "a", "l", "r", "score", F.posexplode("run").alias("at", "id"))
               .join(words.select("id", "word"), "id").groupBy("run", "lang", "a", "l", "r", "score")
               .agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("parts"))
               .withColumn("phrase", F.array_join("parts.word", " ")).drop("parts"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = spelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return (best.join(totals, "lang").join(paths, "run", "left")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score",
                    F.coalesce("path_words", F.size("run")).cast("long").alias("path_words")))
