"""Language-model scores by Katz backoff over words.

Good-Turing discounts take mass from seen n-grams; a context's backoff weight
hands it to the lower order so that all probabilities of a context add up to 1::

    P(w | h) = (r - loss(r)) / c(h)       if h w was met r > 0 times in training
             = weight(h) * P(w)           else;   weight is 1 for a context never met
    P(w)     = (r - loss(r)) / N          for a word met r > 0 times
             = what that leaves           for all other words, as one class

``loss`` is r minus Katz's discounted count up to r = 5; larger counts lose what
5 loses, so that every context leaves something.  The order is two: the pairs of
a corpus are nearly as many as its words, triples do not fit the disk budget.

How the work is spread:

* One scan cuts the corpus into blocks of about ``BLOCK_TOKENS`` tokens, written
  once as word tables and token ids.  A longer text is cut into pieces, each
  led by the word before it.
* Each block reports its distinct words and pairs with their counts.  They are
  dealt by hash into buckets (more of them with more input) where counts of all
  blocks are added; the counted tables, partitioned by bucket, answer each block.
  One block of those that hold an n-gram is named its owner.
* The block then evaluates its tokens level by level: pair, else word, else the
  unseen class.  For the pairs that it owns it adds up what their contexts use;
  these sums are dealt by context into buckets and give the table of weights,
  which answers the blocks that back off in a text.

Everything but a handful of counts of counts stays distributed, and nothing is
pruned, capped or sampled.  Words are told apart by 64-bit hashes.

Edge cases: null and wordless texts have one token, the end; a row with a null
id trains and is not held out; repeated rows count and are scored each; without
training rows every token is of the unseen class, whose probability is 1; extra
columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopebook.llm.arrays import SPACES, byte_set, combine, hashed_words, pack, text_bytes, text_slices, unpack
from slopebook.llm.common import ship_package
from slopebook.plans.session import materialize

BLOCK_TOKENS = 1_250_000
#: Tokens of the corpus for each bucket of the counted tables.
BUCKET_TOKENS = 1_000_000
#: Counts up to this one get a Good-Turing discount of their own.
LARGEST = 5
WORD = ~byte_set(SPACES)
#: What stands before and after a text; no word has these hashes but by chance.
START, END = np.uint64(0x5357A87), np.uint64(0xE4D)

BLOCKS = ("block long, rows binary, keys binary, known binary, lengths binary, training binary, words binary, tokens binary, "
          "n long, texts long")
REQUESTS = "level int, bucket int, block long, keys binary, n binary"
REPLIES = "level int, bucket int, block long, total binary, own binary, spectrum array<long>, different long, tokens long"
SCORED = ("kind int, bucket int, block long, keys binary, counts binary, mass binary, lower binary, asked binary, row long, "
          "key long, has_key boolean, training boolean, n_tokens long, n_known long, base_score double, score double")
WEIGHTS = "bucket int, block long, weights binary"


def block_row(number: int, tokens: np.ndarray, lengths: np.ndarray, rows: np.ndarray, keys: np.ndarray, known: np.ndarray,
              training: np.ndarray) -> pa.RecordBatch:
    """One block: pieces, each led by the word before it, as ids into the block's words, the frequent first."""
    words, at, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.lexsort((words, -counts))
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    texts = int(training[tokens[np.cumsum(lengths) - lengths] == START].sum())
    blobs = [pack(rows, True), pack(keys), pack(known), pack(lengths), pack(training), pack(words[order], True), pack(rank[at])]
    values = [number, *blobs, len(tokens), texts]
    types = [pa.int64()] + [pa.binary()] * 7 + [pa.int64()] * 2
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[c.split()[0] for c in BLOCKS.split(", ")])


def streams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, tokens, lengths) of slices of texts: each text's start, words and end in one stream."""
    data, offsets = text_bytes(column)
    for first, last in text_slices(offsets):
        cut = offsets[first:last + 1]
        hashes, starts = hashed_words(data, cut, WORD)
        n = np.diff(np.searchsorted(starts, cut))
        lengths = n + 2
        begin = np.cumsum(lengths) - lengths
        tokens = np.full(int(lengths.sum()), START, dtype=np.uint64)
        tokens[begin + lengths - 1] = END
        is_word = np.ones(len(tokens), dtype=bool)
        is_word[begin] = is_word[begin + lengths - 1] = False
        tokens[is_word] = hashes
        yield first, last, tokens, lengths


def block_maker(block_tokens: int):
    """Makes blocks of the rows (key, training, text) of a partition."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        made, read, held, size = 0, 0, [], 0
        for batch in batches:
            rows = task + read + np.arange(batch.num_rows)
            read += batch.num_rows
            keys = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            known = pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.uint8)
            training = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            for first, last, tokens, lengths in streams(batch.column(2)):
                of_row = [x[first:last] for x in (rows, keys, known, training)]
                if last - first == 1 and len(tokens) > 2 * block_tokens:
                    # One very long text: pieces that begin with the last word of the piece before.
                    for at in range(0, len(tokens) - 1, block_tokens):
                        piece = tokens[at:at + block_tokens + 1]
                        made += 1
                        yield block_row(task + made, piece, np.array([len(piece)]), *of_row)
                    continue
                held.append((tokens, lengths, *of_row))
                size += len(tokens)
                if size >= block_tokens:
                    made += 1
                    yield block_row(task + made, *(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if held:
            yield block_row(task + made + 1, *(np.concatenate(x) for x in zip(*held)))
    return make


class Block:
    """A block's arrays, the same each time it is read."""

    def __init__(self, lengths: bytes, training: bytes, words: bytes, tokens: bytes):
        self.lengths, self.training = unpack(lengths, np.int64), unpack(training, np.uint8).astype(bool)
        self.words, self.tokens = unpack(words, np.uint64, True), unpack(tokens, np.int32)
        lead = np.cumsum(self.lengths) - self.lengths
        body = np.ones(len(self.tokens), dtype=bool)
        body[lead] = False
        self.at = np.flatnonzero(body)
        self.target, self.before = self.tokens[self.at], self.tokens[self.at - 1]
        self.piece = np.repeat(np.arange(len(self.lengths)), self.lengths - 1)
        self.trains = np.repeat(self.training, self.lengths - 1)
        # Words and pairs in the order of their keys, in which blocks and buckets exchange them.
        self.word_order = np.argsort(self.words, kind="stable")
        size = np.int64(len(self.words))
        pairs, at = np.unique(self.before * size + self.target, return_inverse=True)
        keys = combine(self.words[pairs // size], self.words[pairs % size])
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.pair_keys, self.pair = keys[order], rank[at]
        self.context, self.word = (pairs // size)[order], (pairs % size)[order]

    def counts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys and training counts of words and of pairs."""
        n = np.bincount(self.target[self.trains], minlength=len(self.words))
        pairs = np.bincount(self.pair[self.trains], minlength=len(self.pair_keys))
        return [(self.words[self.word_order], n[self.word_order]), (self.pair_keys, pairs)]


def dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Buckets of ascending keys: each takes an equal range of them."""
    number = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    filled, starts = np.unique(number, return_index=True)
    for b, start, end in zip(filled, starts, [*starts[1:], len(keys)]):
        yield int(b), slice(int(start), int(end))


def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield batch.column(0)[r].as_py(), Block(*(batch.column(c)[r].as_py() for c in range(1, 5)))


ARRAYS = ["block", "lengths", "training", "words", "tokens"]


def requests(blocks: DataFrame, buckets: int) -> DataFrame:
    """Every block's distinct words (level 1) and pairs (level 2) with their training counts, dealt into buckets."""
    def ask(batches):
        for number, block in of_blocks(batches):
            rows = [(level, b, number, pack(keys[s], True), pack(n[s].astype(np.int64)))
                    for level, (keys, n) in enumerate(block.counts(), 1) for b, s in dealt(keys, buckets)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                names=["level", "bucket", "block", "keys", "n"])

    return blocks.select(*ARRAYS).mapInArrow(ask, REQUESTS)


def count_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Replies to the blocks of one bucket (the summed counts and what each block owns) and a row about the bucket itself."""
    pdf = pdf.sort_values("block")
    level, bucket = int(pdf["level"].iloc[0]), int(pdf["bucket"].iloc[0])
    keys = [unpack(k, np.uint64, True) for k in pdf["keys"]]
    n = np.concatenate([unpack(b, np.int64) for b in pdf["n"]])
    distinct, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    order = np.argsort(at, kind="stable")
    total = np.add.reduceat(n[order], np.cumsum(np.bincount(at)) - np.bincount(at))
    own = np.zeros(len(at), dtype=bool)
    own[first] = True
    rows, start = [], 0
    for block, k in zip(pdf["block"], keys):
        s = slice(start, start + len(k))
        rows.append((level, bucket, block, pack(total[at[s]]), pack(np.packbits(own[s])), None, None, None))
        start += len(k)
    spectrum = [int((total == r).sum()) for r in range(1, LARGEST + 2)]
    rows.append((level, bucket, -1, None, None, spectrum, int((total > 0).sum()), int(total.sum())))
    return pd.DataFrame(rows, columns=["level", "bucket", "block", "total", "own", "spectrum", "different", "tokens"])


class Discount:
    """Katz's Good-Turing discount from counts of counts."""

    def __init__(self, spectrum: list[int], different: int, tokens: int):
        self.losses = losses(spectrum)
        self.different, self.tokens = different, tokens
        above = different - sum(spectrum[:LARGEST])
        lost = sum(n * x for n, x in zip(spectrum, self.losses[1:])) + above * self.losses[-1]
        #: The share of all that discounting leaves.
        self.left = float(lost) / tokens if tokens else 1.0

    def of(self, r: np.ndarray) -> np.ndarray:
        """The discounted count."""
        return r - np.array(self.losses)[np.minimum(r, LARGEST)]


def losses(spectrum: list[int]) -> list[float]:
    """What the counts 0 to ``LARGEST`` lose; larger counts lose what the last loses.

    The largest k is taken for which all discounts up to k lie between 0 and 1
    (counts above k then lose what k loses); where none does, all lose a half.
    """
    for k in range(min(LARGEST, len(spectrum) - 1), 0, -1):
        if min(spectrum[:k + 1]) <= 0:
            continue
        n = [0, *map(float, spectrum)]
        common = (k + 1) * n[k + 1] / n[1]
        if common >= 1:
            continue
        kept = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, k + 1)]
        if all(0 < d < 1 for d in kept):
            lost = [0.0] + [r * (1 - d) for r, d in enumerate(kept, 1)]
            return lost + [lost[-1]] * (LARGEST - k)
    return [0.0] + [0.5] * LARGEST


def evaluate(blocks: DataFrame, replies: DataFrame, word_model: Discount, pair_model: Discount, trained_rows: int, buckets: int) -> DataFrame:
    """kind 1: scores of a piece without its contexts' weights; kind 2: what contexts use (and which are asked for); kind 3: where weights are due."""
    def one(mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        r = mine.iloc[0]
        block, number = Block(*(r[c] for c in ARRAYS[1:])), int(r["block"])
        answers = answers.sort_values(["level", "bucket"])
        word, pair = (answers[answers["level"] == k] for k in (1, 2))
        count = np.empty(len(block.words), dtype=np.int64)
        count[block.word_order] = np.concatenate([unpack(t, np.int64) for t in word["total"]])
        totals = [unpack(t, np.int64) for t in pair["total"]]
        met = np.concatenate(totals)
        own = np.concatenate([np.unpackbits(unpack(o, np.uint8), count=len(t)) for o, t in zip(pair["own"], totals)]).astype(bool)
        # Level 1: words.
        known = count > 0
        word_p = np.where(known, word_model.of(count) / max(word_model.tokens, 1), word_model.left)
        base = np.log10((count + 0.1) / (word_model.tokens + 0.1 * (word_model.different + 1)))
        # Level 2: pairs, else the word after a weight.
        after = np.where(block.words == START, trained_rows, count)
        seen = met > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            pair_log = np.log10(np.where(seen, pair_model.of(met) / after[block.context], word_p[block.word]))
        pieces = len(block.lengths)

        def per_piece(values):
            return np.bincount(block.piece, weights=values, minlength=pieces)
        out = [scored(1, block=number, row=unpack(r["rows"], np.int64, True), key=unpack(r["keys"], np.int64),
                      has_key=unpack(r["known"], np.uint8).astype(bool), training=block.training, n_tokens=block.lengths - 1,
                      n_known=per_piece(known[block.target]).astype(np.int64), base_score=per_piece(base[block.target]),
                      score=per_piece(pair_log[block.pair]))]
        # What the contexts of owned pairs use of their mass, and of the lower order's.
        mine_too = own & seen
        of = block.context[mine_too]
        mass = np.bincount(of, weights=pair_model.of(met)[mine_too], minlength=len(block.words))
        lower = np.bincount(of, weights=word_p[block.word[mine_too]], minlength=len(block.words))
        off = ~seen[block.pair] & (after[block.before] > 0)
        asked = np.zeros(len(block.words), dtype=bool)
        asked[block.before[off]] = True
        take = block.word_order[((np.bincount(of, minlength=len(block.words)) > 0) | asked)[block.word_order]]
        keys = block.words[take]
        out += [scored(2, bucket=b, block=number, keys=[pack(keys[s], True)], counts=[pack(after[take[s]])], mass=[pack(mass[take[s]])],
                       lower=[pack(lower[take[s]])], asked=[pack(np.packbits(asked[take[s]]))]) for b, s in dealt(keys, buckets)]
        # Where weights are due: (place among the asked contexts, piece) and how often.
        place = np.full(len(block.words), -1, dtype=np.int64)
        wanted = take[asked[take]]
        place[wanted] = np.arange(len(wanted))
        due, times = np.unique(place[block.before[off]] * np.int64(pieces) + block.piece[off], return_counts=True)
        out.append(scored(3, block=number, keys=[pack(due, True)], counts=[pack(times)], mass=[r["rows"]]))
        return pd.concat(out, ignore_index=True)

    return (blocks.select(*ARRAYS, "rows", "keys", "known").groupBy("block").cogroup(replies.where("block >= 0").groupBy("block"))
            .applyInPandas(one, SCORED))


_EMPTY = {"int": 0, "long": 0, "double": 0.0, "boolean": False, "binary": None}


def scored(kind: int, **columns) -> pd.DataFrame:
    """Rows of SCORED; columns that are not given are empty."""
    rows = max(np.size(v) if not isinstance(v, list) else len(v) for v in columns.values())
    of = dict(c.split() for c in SCORED.split(", "))
    filled = {c: columns.get(c, _EMPTY[t]) for c, t in of.items()} | {"kind": kind}
    return pd.DataFrame(filled, index=range(rows))


def weigh_bucket(unseen: float):
    """The weights of one bucket's contexts, as replies to the blocks that ask."""
    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        keys = [unpack(k, np.uint64, True) for k in pdf["keys"]]
        distinct, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        count = np.concatenate([unpack(c, np.int64) for c in pdf["counts"]])[first]
        mass, lower = (np.bincount(at, weights=np.concatenate([unpack(b, np.float64) for b in pdf[c]])) for c in ("mass", "lower"))
        # The unseen class is in no context's pairs, so it is always left below.
        weights = (1 - mass / count) / np.maximum(1 - lower, unseen)
        rows, start = [], 0
        for block, k, asked in zip(pdf["block"], keys, pdf["asked"]):
            flags = np.unpackbits(unpack(asked, np.uint8), count=len(k)).astype(bool)
            rows.append((int(pdf["bucket"].iloc[0]), block, pack(weights[at[start:start + len(k)]][flags])))
            start += len(k)
        return pd.DataFrame(rows, columns=["bucket", "block", "weights"])
    return weigh


def backed_off(due: DataFrame, weights: DataFrame) -> DataFrame:
    """row, score: the logarithms of the weights that a text's tokens back off by."""
    def one(mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({"row": [], "score": []})
        r = mine.iloc[0]
        at, times, rows = unpack(r["keys"], np.int64, True), unpack(r["counts"], np.int64), unpack(r["mass"], np.int64, True)
        logs = np.log10(np.concatenate([unpack(w, np.float64) for w in answers.sort_values("bucket")["weights"]] or [np.zeros(0)]))
        return pd.DataFrame({"row": rows, "score": np.bincount(at % len(rows), weights=times * logs[at // len(rows)], minlength=len(rows))})

    return due.groupBy("block").cogroup(weights.groupBy("block")).applyInPandas(one, "row long, score double")


def score(docs: DataFrame, trains: Column, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS,
          bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """key, training, n_tokens, n_known, train_tokens, base_score, score of every row; rows where ``trains`` holds are learned from.

    A null of ``trains`` trains.  base_score is the sum of log10((c + 0.1) / (N + 0.1 * (V + 1))) over the tokens.
    """
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(trains, F.lit(True)).alias("training"), F.col(text).alias("text"))
    blocks = materialize(slim.mapInArrow(block_maker(block_tokens), BLOCKS), "katz_blocks")
    size = blocks.agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).first()
    buckets = (size["n"] or 0) // bucket_tokens + 1
    counts = materialize(requests(blocks, buckets).groupBy("level", "bucket").applyInPandas(count_bucket, REPLIES), "katz_counts")
    facts = {r["level"]: r for r in counts.where("block < 0").groupBy("level").agg(
        F.array(*(F.sum(F.col("spectrum")[k]) for k in range(LARGEST + 1))).alias("spectrum"),
        F.sum("different").alias("different"), F.sum("tokens").alias("tokens")).collect()}
    models = [Discount(list(facts[k]["spectrum"]), facts[k]["different"], facts[k]["tokens"]) if k in facts else Discount([0] * (LARGEST + 1), 0, 0)
              for k in (1, 2)]
    parts = materialize(evaluate(blocks, counts, *models, size["texts"] or 0, buckets), "katz_scored")
    weights = parts.where("kind = 2").select("bucket", "block", "keys", "counts", "mass", "lower", "asked").groupBy("bucket").applyInPandas(
        weigh_bucket(models[0].left), WEIGHTS)
    more = backed_off(parts.where("kind = 3").select("block", "keys", "counts", "mass"), weights)
    fields = ["key", "has_key", "training", "n_tokens", "n_known", "base_score"]
    both = parts.where("kind = 1").select("row", *fields, "score").unionByName(more, allowMissingColumns=True)
    whole = both.groupBy("row").agg(*(F.max(c).alias(c) for c in fields[:3]), *(F.sum(c).alias(c) for c in (*fields[3:], "score")))
    return whole.select(F.when(F.col("has_key"), F.col("key")).alias(key), "training", "n_tokens", "n_known",
                        F.lit(models[0].tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(key: Column) -> Column:
    """A tenth of the rows, by the crc32 of the key as text; null for a null key."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 10 == 0
