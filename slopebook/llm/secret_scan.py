"""Secret scan: three base patterns plus a randomness test battery.

Base kinds (assign, access, hex) are fixed patterns.  The method adds spans:
every run of 20 or more token characters, or what base spans leave of it to
their left and right, is read in the smallest encoding alphabet that holds it.
A ``=`` ends a run, so the name and the value of name=value are two runs and
padding belongs to none.
Three tests ask whether it is a uniform random string of that alphabet:
chi-squared over the symbols, Wald-Wolfowitz runs about the middle symbol, and
lag-1 serial correlation.  Fisher's method joins the p-values.

False-discovery control is per stratum (alphabet and length band, because the
tests' power depends on both): a Benjamini-Hochberg cut over all candidates of
the corpus names those that are *not* random, so at most ``FDR`` of the names
so struck off were truly random.  The rest are reported as kind ``random``.
That bounds lost secrets; words are kept out by the tests' power: a letters-only
run is tested only from the length on at which the chi-squared test tells text
of a language (``COLLISION``) from random letters 19 times in 20: 52 letters
of one case, 20 of both.  Shorter ones are tested where running text does not
stand, right after a ``=``; elsewhere a random key of one case without a digit
(one in some 600 of base36 keys of 20) is not reported.
The cut is found from counts per (stratum, p-value bucket), at most 36 x 6001
rows whatever the corpus; buckets are even in log p, 20 to a power of ten.

Positions are code points, ends exclusive; texts are read whole.

Edge cases: null and empty texts give no spans; repeated rows are scanned
alike; ties in p share a bucket and so a fate; extra columns are ignored by
``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopebook.llm.common import field, fresh, utf8, with_text_columns
from slopebook.plans.session import materialize

FDR = 0.05
#: Bucket b holds p-values from 10 ** (-b / 20) down to the next bucket's; the last one all from 1e-300 on.
LAST_BUCKET = 6000
MIN_TOKEN = 20
#: Chance that two letters of running text are equal (fixed value), level of the test and its least power for letters-only runs.
COLLISION, LEVEL_Z, POWER_Z = 0.065, 1.645, 1.645
#: Lengths at which a new band starts.
BANDS = (20, 32, 64)

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones can be passed over at once
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % MIN_TOKEN)
_HINTS = (b"passw", b"secret", b"token", b"api")

_DIGITS = "0123456789"
_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from small to large alphabet.
ALPHABETS = {
    "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "lower": _LOW, "UPPER": _UP, "base32": _UP + "234567",
    "base36": _DIGITS + _LOW, "BASE36": _DIGITS + _UP, "letters": _UP + _LOW, "base62": _DIGITS + _UP + _LOW, "base64": _UP + _LOW + _DIGITS + "+/",
    "base64url": _UP + _LOW + _DIGITS + "-_", "mixed": _UP + _LOW + _DIGITS + "+/-_",
}
_WORDLIKE = ("lower", "UPPER", "letters")
_CODE = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}

_IS_HEX, _IS_TOKEN = 1, 2
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[list(ALPHABETS["mixed"].encode())] = _IS_TOKEN
_CLASS[list(ALPHABETS["hex"].encode())] |= _IS_HEX


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees of freedom > x), Wilson-Hilferty."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(symbols: list[int], size: int) -> float:
    """Joint p-value of the battery for a string over an alphabet of ``size`` symbols."""
    n = len(symbols)
    x = np.asarray(symbols, dtype=float)
    counts = np.bincount(symbols, minlength=size)
    p1 = _chi2_tail(float(((counts - n / size) ** 2).sum() * size / n), size - 1)
    high = x >= size / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p2 = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p2 = 2.0 ** (1 - n)
    d = x - x.mean()
    s = float((d * d).sum())
    p3 = _normal_tail((float((d[1:] * d[:-1]).sum()) / s + 1 / n) * math.sqrt(n)) if s > 0 else 2.0 ** (1 - n)
    stat = -sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3))
    return math.exp(-stat) * (1 + stat + stat * stat / 2)  # Fisher: chi-squared with 6 degrees of freedom


def infer_encoding(token: str) -> str | None:
    """The smallest encoding that holds the token; None for a rule of signs alone, which 20 random symbols are once in 1e24."""
    if not any(c.isalnum() for c in token):
        return None
    used = set(token)
    return next((name for name, code in _CODE.items() if used <= code.keys()), None)


def least_length(encoding: str) -> int:
    """Symbols that a run of this encoding needs to be tested.

    For text of a language chi-squared is noncentral, with n * (COLLISION * size - 1)
    beyond its degrees of freedom; both are taken as normal.
    """
    if encoding not in _WORDLIKE:
        return MIN_TOKEN
    free = len(ALPHABETS[encoding]) - 1
    # Upper LEVEL_Z point of chi-squared (Wilson-Hilferty).
    limit = free * (1 - 2 / (9 * free) + LEVEL_Z * math.sqrt(2 / (9 * free))) ** 3
    n = MIN_TOKEN
    while True:
        beyond = n * (COLLISION * (free + 1) - 1)
        if free + beyond - limit >= POWER_Z * math.sqrt(2 * (free + 2 * beyond)):
            return n
        n += 1


_LEAST = {name: least_length(name) for name in ALPHABETS}


def bucket_of(p: float) -> int:
    return min(LAST_BUCKET, math.floor(-20 * math.log10(max(p, 1e-300)) + 1e-9)) if p < 1 else 0


def stratum_of(encoding: str, length: int) -> str:
    return f"{encoding}:{max(b for b in BANDS if length >= b)}"


def base_spans(text: str, raw: bytes, kinds: np.ndarray) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself), by start and then kind as listed."""
    out = []
    low = raw.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # A run of 16 holds a whole aligned block of 8.
    whole = (kinds & _IS_HEX)[:len(kinds) // 8 * 8].reshape(-1, 8)
    if whole.all(axis=1).any():
        out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, kinds: np.ndarray, taken: list[tuple[str, int, int, int]]) -> list[tuple[int, int, str, int]]:
    """(start, end, stratum, p-value bucket) of the runs to be tested."""
    # A run of 20 holds a whole aligned block of 10.
    whole = (kinds & _IS_TOKEN)[:len(kinds) // 10 * 10].reshape(-1, 10)
    if not whole.all(axis=1).any():
        return []
    out = []
    for m in TOKEN.finditer(text):
        for start, end in parts_beside(m.start(), m.end(), taken):
            token = text[start:end]
            encoding = infer_encoding(token)
            if encoding and (len(token) >= _LEAST[encoding] or is_value(text, start)):
                p = randomness([_CODE[encoding][c] for c in token], len(ALPHABETS[encoding]))
                out.append((start, end, stratum_of(encoding, len(token)), bucket_of(p)))
    return out


def is_value(text: str, start: int) -> bool:
    """Does a ``=`` stand before, with or without an opening quote?"""
    before = text[max(0, start - 2):start]
    return before.endswith("=") or before in ("='", '="')


def parts_beside(start: int, end: int, taken: list[tuple[str, int, int, int]]) -> list[tuple[int, int]]:
    """What the base spans leave of a run, in parts long enough to be tested."""
    out, at = [], start
    for s, e in sorted((s, e) for _k, s, e, _v in taken if s < end and start < e):
        out.append((at, s))
        at = max(at, e)
    return [(a, b) for a, b in [*out, (at, end)] if b - a >= MIN_TOKEN]


def scan_texts(texts):
    """(base spans, candidates) of each text."""
    for text in texts:
        if not text:
            yield [], []
            continue
        raw = utf8(text)
        kinds = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
        spans = base_spans(text, raw, kinds)
        yield spans, candidates(text, kinds, spans)


_SPAN = "array<struct<kind:string,start:int,end:int,value:int>>"
_CAND = "array<struct<start:int,end:int,stratum:string,bucket:int>>"


def _dicts(pair):
    spans, cands = pair
    return ([dict(zip(("kind", "start", "end", "value"), s)) for s in spans],
            [dict(zip(("start", "end", "stratum", "bucket"), c)) for c in cands])


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (spans) and cands (candidates with their p-value bucket) per row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("__text"))
    out = with_text_columns(slim, "__text", [field("base", _SPAN), field("cands", _CAND)],
                            lambda texts: map(_dicts, scan_texts(texts)))
    return out.drop("__text")


def cuts(scanned: DataFrame, fdr: float = FDR) -> dict[str, int]:
    """Per stratum the first bucket that is struck off as not random (Benjamini-Hochberg).

    A bucket b is struck off when its upper p-value 10 ** (-b / 20) is at most
    fdr * (candidates in buckets b and up) / (candidates of the stratum), or a
    lower bucket is.  At most 36 x (LAST_BUCKET + 1) counts reach the driver.
    """
    rows = (scanned.select(F.explode("cands").alias("c")).groupBy("c.stratum", "c.bucket")
            .agg(F.count(F.lit(1)).alias("n")).collect())
    by: dict[str, dict[int, int]] = {}
    for r in rows:
        by.setdefault(r["stratum"], {})[r["bucket"]] = r["n"]
    out = {}
    for stratum, counts in by.items():
        total, struck, cut = sum(counts.values()), 0, LAST_BUCKET + 1
        for bucket in sorted(counts, reverse=True):
            struck += counts[bucket]
            if 10 ** (-bucket / 20) <= fdr * struck / total:
                cut = bucket
        out[stratum] = cut
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """doc_id, base spans and random spans of every row; the texts are scanned once.

    The scan (spans only, no text) is written to the shared folder, so the
    corpus-wide cuts and the result read the same rows.
    """
    scanned = materialize(scan(docs, id_col, text), "secret_scan")
    limit = cuts(scanned, fdr)
    first = F.create_map(*[F.lit(x) for kv in sorted(limit.items()) for x in kv]) if limit else None
    random = F.filter("cands", lambda c: c["bucket"] < first[c["stratum"]]) if limit else F.col("cands")
    return scanned.select("doc_id", "base", F.transform(random, lambda c: F.struct(
        F.lit("random").alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
        c["start"].alias("value"))).alias("random"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_secrets``."""
    def label(s):
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    both = F.array_sort(F.transform(F.concat("base", "random"), lambda s: F.struct(
        s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(F.concat_ws(",", F.transform("base", label)), 256).alias("base_sha256"),
                        F.concat_ws(",", F.transform(both, label)).alias("spans"),
                        F.size("random").cast("long").alias("n_random"))


MASK = "[SECRET]"


def redact_text(text: str | None, limit: dict[str, int]) -> str | None:
    """``text`` with the secret part of every span replaced by ``MASK``."""
    if not text:
        return text
    ((base, cands),) = scan_texts([text])
    spans = sorted([(v, e) for _k, _s, e, v in base] + [(s, e) for s, e, st, b in cands if b < limit.get(st, LAST_BUCKET + 1)])
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """``docs`` with secrets masked in the text; every row and column stays.

    The cuts need all candidates first, so the texts are scanned twice rather
    than copied to disk.
    """
    limit = cuts(scan(docs, id_col, text), fdr)
    (new,) = fresh(docs, "__redacted")
    out = with_text_columns(docs, text, [field(new, "string")], lambda texts: ((redact_text(t, limit),) for t in texts))
    return out.select(*[F.col(new).alias(text) if c == text else F.col(c) for c in docs.columns])
