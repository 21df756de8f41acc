"""Learned quality rules: a decision list by sequential covering.

``text_stats`` computes counts of every whole text in one Arrow pass.
``learn_rules`` grows a conjunction of thresholds on the ratio features that
separates rejected (quality 0) from accepted (quality 1) labelled texts, prunes
it on held-out rows, removes what it covers and goes on; ``verdict`` turns the
ordered rules into one Spark CASE expression.  A text that no rule covers is
kept, so an empty or one-sided label table keeps everything.

Edge cases: null and empty texts have no words and fail the base check;
labels that are null or whose document is absent are ignored; a document
labelled twice counts once with its lowest label; repeated rows of a document
each get the same result; extra columns pass through and may clash with the
names used here (internal columns are renamed).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopebook.llm.common import bounded_sample, field, fresh, utf8, with_text_columns

#: Labelled rows that a decision list is fitted on at most: those of smallest
#: hash of doc_id.  The list has a handful of thresholds, which this many rows fix.
MAX_LABELLED = 20_000
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_bangs", "n_distinct_words", "max_word_bytes")
STATS = BASE + EXTRA

#: Ratio features: name -> (numerator, denominator) over STATS.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"), "chars_per_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"),
    "bangs_per_word": ("n_bangs", "n_words"), "distinct_share": ("n_distinct_words", "n_words"),
    "longest_word": ("max_word_bytes", None), "words": ("n_words", None),
}


def repeated_words(words: list[bytes], distinct: dict[bytes, int], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of ``window`` words found at least twice."""
    n = len(words)
    if n <= window or len(distinct) == n:
        return 0
    ids = np.fromiter(map(distinct.__getitem__, words), dtype=np.int64, count=n)
    size, key = len(distinct), ids
    if size ** window < 2 ** 63:
        key = ids[:n - window + 1].copy()
        for k in range(1, window):
            key *= size
            key += ids[k:n - window + 1 + k]
    else:  # exact for any vocabulary: rank the pairs after each added word
        for k in range(1, window):
            key = np.unique(key[:-1] * size + ids[k:], return_inverse=True)[1].astype(np.int64)
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(np.isin(key, twice))
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*SYMBOLS]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[33] = 4


def stats_of(texts: list[str | None]):
    for text in texts:
        raw = utf8(text)
        words = raw.split()  # bytes.split() splits at exactly \x20\x09-\x0D
        if not words:
            yield (0,) * len(STATS)
            continue
        distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
        lines = [x for x in raw.split(b"\n") if x.strip()]
        kinds = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=5)
        yield (len(words), len(text) - sum(map(text.count, _WHITE)), int(kinds[1]), len(lines) - len(set(lines)),
               repeated_words(words, distinct), len(lines), int(kinds[2]), int(kinds[3]), int(kinds[4]),
               len(distinct), max(map(len, distinct)))


def text_stats(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` plus one long column per name of ``STATS`` (with ``prefix``)."""
    return with_text_columns(docs, text, [field(prefix + s, "long") for s in STATS], stats_of)


def feature(name: str, prefix: str = "") -> Column:
    top, bottom = FEATURES[name]
    col = F.col(prefix + top).cast("double")
    return col if bottom is None else F.when(F.col(prefix + bottom) > 0, col / F.col(prefix + bottom)).otherwise(0.0)


def base_failed(prefix: str = "") -> Column:
    n, rep = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)


@dataclass(frozen=True)
class Rule:
    """Rejects a text for which every (feature, 'le' or 'gt', threshold) holds."""
    conditions: tuple[tuple[str, str, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for name, side, at in self.conditions:
            out &= x[name] <= at if side == "le" else x[name] > at
        return out

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for name, side, at in self.conditions:
            out &= feature(name, prefix) <= at if side == "le" else feature(name, prefix) > at
        return out


def _best_condition(x, bad, inside):
    """The condition of largest FOIL gain among those rows that are still inside."""
    p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
    base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
    for name, values in x.items():
        v, y = values[inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        low_p, low_n = np.cumsum(y)[cut], np.cumsum(~y)[cut]
        for side, p, n in (("le", low_p, low_n), ("gt", p0 - low_p, n0 - low_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), (name, side, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
    return best[1]


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray, max_conditions: int = 4,
                min_precision: float = 0.95, max_rules: int = 30) -> list[Rule]:
    """Sequential covering: grow on the rows not ``held``, prune on the held ones.

    A rule is taken only if at least ``min_precision`` of what it covers (over
    both parts together) is rejected by its label, so good texts stay.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < max_rules and (bad & left & ~held).any():
        inside, found = left & ~held, []
        while len(found) < max_conditions and (~bad[inside]).any():
            step = _best_condition(x, bad, inside)
            if step is None:
                break
            found.append(step)
            inside &= Rule((step,)).holds(x)
        if not found:
            break
        def worth(rule):
            hit = rule.holds(x) & left & held
            p, n = (bad & hit).sum(), (~bad & hit).sum()
            return (p - n) / (p + n) if p + n else -1.0
        options = [Rule(tuple(found[:k])) for k in range(1, len(found) + 1)]
        rule = max(options, key=lambda r: (worth(r), len(r.conditions)))
        hit = rule.holds(x) & left
        if not (bad & hit).any() or (bad & hit).sum() < min_precision * hit.sum():
            rule = options[-1]  # the whole conjunction, before pruning
            hit = rule.holds(x) & left
            if (bad & hit).sum() < min_precision * hit.sum():
                break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
        label: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learn the list from at most ``max_labelled`` labelled documents.

    The sample (ids and labels, bounded) is broadcast to the scan, so only the
    sampled texts go through the statistics pass.
    """
    named = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    sample = bounded_sample(named.groupBy("id").agg(F.min("y").alias("y")), "id", max_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).join(F.broadcast(sample), "id")
    got = (text_stats(texts, "t").drop("t").groupBy("id").agg(F.min("y").alias("y"), F.min("h").alias("h"), *[F.min(s).alias(s) for s in STATS])
           .select("y", "h", *[feature(n).alias(f"f_{n}") for n in FEATURES]).toPandas())
    if got.empty:
        return []
    got = got.sort_values(["h"], kind="stable")
    return learn_rules({n: got[f"f_{n}"].to_numpy(dtype=float) for n in FEATURES},
                       got["y"].to_numpy() == 0, (got["h"].to_numpy() % 3) == 0)


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """False for the first rule that holds, true if none does (one ordered CASE)."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(prefix), False)
    for rule in rules[1:]:
        out = out.when(rule.column(prefix), False)
    return out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the statistics, base_failed and kept for every row of ``docs``."""
    stats = text_stats(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("__text")), "__text")
    return stats.select("doc_id", *STATS, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def keep(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged."""
    (prefix,) = fresh(docs, "__q_")
    names = docs.columns
    while any(c.lower().startswith(prefix) for c in names):
        prefix = f"_{prefix}"
    return text_stats(docs, text, prefix).where(~base_failed(prefix) & verdict(rules, prefix)).select(*names)
