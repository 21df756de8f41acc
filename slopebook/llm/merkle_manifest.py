"""Merkle manifest of a table: cogrouped subtree exchange.

Every row is a leaf, the sha256 of its fields.  Leaves of one tree ascend by
their key; while several nodes remain, each run of ``FANOUT`` consecutive ones
becomes the sha256 of their concatenated digests.  The roots of the trees,
ordered by tree name (null first), are the leaves of one more tree.

* Up: a superblock is ``BLOCK`` consecutive nodes of a tree, the leaves of whole
  subtrees.  A grouped reduction leaves one node a superblock, ``LEVELS``
  levels up; the nodes that are left are reduced again until a tree has one.
* Down: the outer nodes that a superblock's proofs need (the siblings from its
  top node to the root) are made by the same exchange among the nodes above.
  Leaves and these outer nodes are then cogrouped by superblock, and one call
  finishes the local reduction, joins the local proofs to the outer ones and
  folds every claimed digest up to the root.

A group never exceeds ``BLOCK`` rows whatever the size of a tree, and only keys
and digests are shuffled, never the rows' contents.  Positions in a tree come
from a range partitioning and the counts of its partitions.

A proof is a list of texts, two for each level: the digests left and right of
the node in its run.

Edge cases: a null field is hashed as ``-``; a null key sorts first; rows with
equal keys are ordered by leaf, so repeated rows are equal leaves in a row; a
tree of one leaf has that leaf as root; a manifest of one row has an empty
proof; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopebook.llm.common import ship_package
from slopebook.plans.session import materialize

FANOUT = 8
#: Levels that one superblock reduces, and its leaves.
LEVELS = 4
BLOCK = FANOUT ** LEVELS
#: Rows that one range of the position count holds, about.
RANGE_ROWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(values: Iterable[Column]) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, ``:`` and itself, ``-`` if null."""
    parts = []
    for v in values:
        v = v.cast("string")
        parts.append(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)))
    return F.sha2(F.concat(*parts), 256)


def height(total: int) -> int:
    """Levels between ``total`` nodes and their root."""
    levels = 0
    while total > 1:
        total = -(-total // FANOUT)
        levels += 1
    return levels


def tree_name(group: Column) -> Column:
    """A text that is never null and sorts as the group does, null first."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


def positioned(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with idx, the row's place in its tree by ``order``, and total, the tree's rows.

    Range partitioning by (tree, order) spreads a large tree, and rows equal in
    all of these too (their place among each other does not matter); a row's
    place is its number within its partition and tree plus the tree's rows in
    the partitions before.
    """
    count = rows.count()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // RANGE_ROWS))
    placed = (rows.withColumn("__tie", F.monotonically_increasing_id())
              .repartitionByRange(parts, "tree", *order, "__tie").sortWithinPartitions("tree", *order, "__tie").drop("__tie")
              .withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    placed = materialize(placed, name)
    runs = placed.groupBy("tree", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("tree").orderBy("__part")
    runs = (runs.withColumn("__before", F.sum("__n").over(before) - F.col("__n"))
            .withColumn("total", F.sum("__n").over(Window.partitionBy("tree"))))
    return (placed.join(runs, ["tree", "__part"]).withColumn("idx", F.col("__at") - F.col("__first") + F.col("__before"))
            .drop("__part", "__at", "__first", "__n", "__before").withColumn("block", F.floor(F.col("idx") / BLOCK)))


def levels_of(digests: list[str], total: int) -> list[list[str]]:
    """All levels of a superblock, from its own nodes to its top node; ``total`` nodes are in the tree."""
    out = [digests]
    for _ in range(min(LEVELS, height(total))):
        row = out[-1]
        out.append([sha(*row[i:i + FANOUT]) for i in range(0, len(row), FANOUT)])
    return out


def reduced(nodes: DataFrame) -> DataFrame:
    """tree, idx, block, total, digest: one node for each superblock of ``nodes``."""
    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        first, total = pdf.iloc[0], int(pdf["total"].iloc[0])
        at = int(first["idx"]) // BLOCK
        digest = levels_of(pdf["digest"].tolist(), total)[-1][0]
        return pd.DataFrame({"tree": [first["tree"]], "idx": [at], "block": [at // BLOCK], "total": [-(-total // BLOCK)], "digest": [digest]})

    return (nodes.select("tree", "block", "idx", "total", "digest").groupBy("tree", "block")
            .applyInPandas(top, "tree string, idx long, block long, total long, digest string"))


def pyramid(nodes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes`` and what superblocks reduce them to, until every tree has one node."""
    out = [nodes]
    while True:
        out.append(materialize(reduced(out[-1]), name))
        if out[-1].where("total > 1").limit(1).count() == 0:
            return out


def proof_of(levels: list[list[str]], at: int) -> list[str]:
    """What lies left and right of node ``at`` in its run, level by level below the top node."""
    out = []
    for row in levels[:-1]:
        start = at // FANOUT * FANOUT
        out += ["".join(row[start:at]), "".join(row[at + 1:start + FANOUT])]
        at //= FANOUT
    return out


def fold(digest: str, proof: list[str]) -> str:
    """The root that ``digest`` and its proof lead to."""
    for k in range(0, len(proof), 2):
        digest = sha(proof[k], digest, proof[k + 1])
    return digest


def exchange(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """``nodes`` with subroot, root, proof and folded, by superblock.

    outer: tree, block, subroot, root and proof of every superblock's top node.
    ``nodes`` may hold a claim, the digest to fold (else its own is folded).
    """
    claimed = nodes if "claim" in nodes.columns else nodes.withColumn("claim", F.lit(None).cast("string"))
    kept = [f for f in claimed.schema.fields if f.name not in ("block", "total")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", subroot string, root string, proof array<string>, folded string"
    names = [f.name for f in kept]

    def join(leaves: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("idx")
        top = above.iloc[0]
        rest = list(top["proof"])
        digests = leaves["digest"].tolist()
        levels = levels_of(digests, int(leaves["total"].iloc[0]))
        proofs = [proof_of(levels, at) + rest for at in range(len(digests))]
        claims = [d if c is None or c != c else c for c, d in zip(leaves["claim"], digests)]
        return leaves[names].assign(subroot=top["subroot"], root=top["root"], proof=proofs,
                                    folded=[fold(c, p) for c, p in zip(claims, proofs)])

    return claimed.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(join, schema)


def descend(levels: list[DataFrame], top: DataFrame, name: str) -> DataFrame:
    """tree, block, subroot, root, proof for the superblocks of ``levels[0]``, given those of the single nodes on top."""
    outer = top
    for nodes in reversed(levels[1:-1]):
        found = materialize(exchange(nodes, outer), name)
        # A node here is the top of the superblock of that number one level below.
        outer = found.select("tree", F.col("idx").alias("block"), "subroot", "root", "proof")
    return outer


def manifest(rows: DataFrame, group: str, key: str, fields: list[str], claims: dict[str, Column] | None = None) -> DataFrame:
    """group, key, leaf, subroot, root, proof, folded, verified for every row.

    ``claims`` replaces fields by what a receiver holds; the leaf of these is
    folded with the row's own proof, and verified tells whether that gives root.
    """
    ship_package(rows.sparkSession)
    mine = leaf(F.col(c) for c in fields)
    claim = leaf((claims or {}).get(c, F.col(c)) for c in fields) if claims else mine
    slim = rows.select(F.col(group).cast("string").alias("group"), tree_name(F.col(group)).alias("tree"), F.col(key).alias("key"),
                       mine.alias("digest"), claim.alias("claim"))
    # Only a claim that differs is kept: it is what verification is about.
    slim = materialize(slim.withColumn("claim", F.when(F.col("claim") != F.col("digest"), F.col("claim"))), "merkle_rows")
    leaves = materialize(positioned(slim, ["key", "digest"], "merkle_order"), "merkle_leaves")
    trees = pyramid(leaves, "merkle_nodes")
    # The roots of the trees are the leaves of the last tree, whose own name is the empty one.
    roots = trees[-1].select(F.lit("").alias("over"), "tree", "digest")
    roots = positioned(roots.withColumnsRenamed({"tree": "name", "over": "tree"}), ["name"], "merkle_roots")
    last = pyramid(materialize(roots, "merkle_roots"), "merkle_nodes")
    root = last[-1].select("tree", F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), F.col("digest").alias("root"),
                           F.array().cast("array<string>").alias("proof"))
    whole = materialize(exchange(last[0], descend(last, root, "merkle_outer")), "merkle_outer")
    tops = whole.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), "root", "proof")
    proven = exchange(leaves, descend(trees, tops, "merkle_outer"))
    return proven.select(F.col("group").alias(group), F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "proof",
                         "folded", (F.col("folded") == F.col("root")).alias("verified"))


def tampered(rows: DataFrame, key: str, text: str) -> dict[str, Column]:
    """What a careless copy holds: the text lower-cased (A-Z) where 3 divides the crc32 of the key; null keys are left alone."""
    hit = F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 3 == 0
    return {text: F.when(hit, F.translate(F.col(text), UPPER, LOWER)).otherwise(F.col(text))}


def digest(proven: DataFrame, key: str) -> DataFrame:
    """The contract's columns: the proof as one sha256."""
    return proven.select(key, "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
                         F.col("folded").alias("folded_root"), "verified")
