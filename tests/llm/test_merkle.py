"""The Merkle manifest against a row-by-row model."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from slopebook.llm import merkle_manifest as mm
from tests.llm.fixtures import SCHEMA, document_rows, documents

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values) -> str:
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves: list[str]):
    """Root and each leaf's siblings, as (left, right) pairs."""
    paths, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8:i // 8 * 8 + 8]
            paths[k].append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
            at[k] = i // 8
        level = [H(*level[i:i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def model(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    out, subroots, members = [], [], []
    for lang in sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode())):
        mine = [(r, leaf_of([r[0], r[3], r[2], r[4], r[1]])) for r in rows if r[2] == lang]
        mine.sort(key=lambda m: (m[0][0] is not None, m[0][0] or 0, m[1]))
        root, paths = tree([m[1] for m in mine])
        subroots.append(root)
        members.append(list(zip(mine, paths)))
    root, tops = tree(subroots) if subroots else (None, [])
    for subroot, top, rows_ in zip(subroots, tops, members):
        for ((r, leaf), path) in rows_:
            path = path + top
            text = lower(r[1]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[1]
            node = leaf_of([r[0], r[3], r[2], r[4], text])
            for left, right in path:
                node = H(left, node, right)
            out.append((r[0], leaf, subroot, root, H("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=lambda t: (t[0] is not None, t[0] or 0, t[1:]))


def run(df):
    got = mm.digest(mm.manifest(df, "lang", "doc_id", FIELDS, mm.tampered(df, "doc_id", "text")), "doc_id").collect()
    return sorted(map(tuple, got), key=lambda t: (t[0] is not None, t[0] or 0, t[1:]))


def many():
    langs = [None, "en", "en", "en", "é", "z", ""]
    rows = [(i, f"Text Number {i}" if i % 5 else None, langs[i % 7], None if i % 3 else "src", i) for i in range(700)]
    return rows + [(10_000, "alone", "lone", "s", 1)] + rows[:40] + [(7, "Other text of an id", "en", "s", None)]


def test_model_with_ties_and_lone_leaves(spark):
    rows = many()
    assert run(spark.createDataFrame(rows, SCHEMA)) == model(rows)


@pytest.mark.parametrize("rows", [[], [(5, "One", "en", "s", 3)], [(5, "One", None, None, None), (6, "Two", "en", "s", 3)]])
def test_small_tables(spark, rows):
    assert run(spark.createDataFrame(rows, SCHEMA)) == model(rows)


def test_awkward_rows_and_clashing_columns(spark):
    rows = document_rows()
    df = documents(spark).withColumns({c: F.lit(1) for c in ("tree", "idx", "digest", "claim", "proof", "block", "total", "leaf", "root", "key")})
    assert run(df) == model(rows)


def test_two_levels_of_superblocks(spark):
    """One tree of over 4096 leaves: its superblocks meet in a second exchange."""
    rows = [(i, f"T{i}", "en" if i % 10 else "de", "s", 1) for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert run(df) == model(rows)


def test_proof_of_every_row_folds_to_the_root(spark):
    df = spark.createDataFrame(many(), SCHEMA)
    for r in mm.manifest(df, "lang", "doc_id", FIELDS).collect():
        assert r["verified"] and mm.fold(r["leaf"], r["proof"]) == r["root"]
