"""Approximate nearest neighbours by a forest of random-projection trees.

Splits are fitted on a bounded sample: a node's direction joins two random
sample vectors and its threshold is the sample's median projection.  Every
vector of the corpus is routed to one leaf per tree.  A query walks all trees
from one priority queue, most promising branch first, until the leaves it has
reached hold a given share of the sample (a vector counts once per tree); then
the candidates of those leaves are reranked by exact cosine in double precision.
The share buys recall: vectors without structure need a large one.

Rows with the same vector form one class that carries its smallest ids (as many
as any answer can show), so a vector that a third of all rows share is one
candidate and one search.  Leaves are cut into chunks as the corpus outgrows
the sample, so a rerank group stays bounded; each group returns a query's best
few, never all pairs.

Edge cases: vectors that are null, empty, zero, of another length than most of
the sample, or hold null or non-finite components take no part, neither as
query nor as candidate; ties go to the smaller id; a repeated (id, vector) row
counts once; with fewer candidates than asked all are returned; an empty table
gives no row; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopebook.llm.common import bounded_sample
from slopebook.plans.session import materialize, ship_package

#: Distinct vectors that the splits are fitted on at most.
SAMPLE = 16_384
TREES = 8
LEAF = 128
#: Sample vectors that a query's leaves hold before the search stops, as a share of the sample
#: (with ``TREES`` trees, so 1.4 reaches about three quarters of unstructured vectors).
SEARCH_SHARE = 1.4
SEED = 7


@dataclass
class Forest:
    """All trees' nodes in flat arrays; a child >= 0 is a node, below 0 it is leaf -child - 1."""
    roots: np.ndarray
    normals: np.ndarray
    cuts: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf_tree: np.ndarray
    leaf_size: np.ndarray

    def route(self, unit: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each unit vector in each tree."""
        out = np.empty((len(unit), len(self.roots)), dtype=np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(unit), root, dtype=np.int64)
            while True:
                live = np.flatnonzero(at >= 0)
                if not len(live):
                    break
                node = at[live]
                side = (unit[live] * self.normals[node]).sum(axis=1) > self.cuts[node]
                at[live] = np.where(side, self.right[node], self.left[node])
            out[:, t] = -at - 1
        return out

    def search(self, unit: np.ndarray, enough: int) -> list[int]:
        """Leaves for one query, by one queue over all trees; the priority is the least margin on the path."""
        margin = (self.normals @ unit - self.cuts) if len(self.cuts) else np.zeros(0)
        queue = [(-np.inf, int(r)) for r in self.roots]
        heapq.heapify(queue)
        found, held = [], 0
        while queue and held < enough:
            worst, node = heapq.heappop(queue)
            if node < 0:
                found.append(-node - 1)
                held += int(self.leaf_size[-node - 1])
                continue
            m = float(margin[node])
            near, far = (self.right, self.left) if m > 0 else (self.left, self.right)
            heapq.heappush(queue, (worst, int(near[node])))
            heapq.heappush(queue, (max(worst, abs(m)), int(far[node])))
        return found


def grow(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> Forest:
    """Fit the forest on unit vectors (rows of ``sample``)."""
    rng = np.random.default_rng(seed)
    normals, cuts, left, right, leaf_tree, leaf_size, roots = [], [], [], [], [], [], []

    def build(rows: np.ndarray, tree: int) -> int:
        if len(rows) > leaf:
            for _ in range(4):
                a, b = rng.choice(rows, 2, replace=False)
                direction = sample[a] - sample[b]
                size = np.sqrt((direction * direction).sum())
                if size == 0:
                    continue
                direction = direction / size
                p = sample[rows] @ direction
                cut = float(np.median(p))
                side = p > cut
                if side.any() and not side.all():
                    at = len(cuts)
                    normals.append(direction)
                    cuts.append(cut)
                    left.append(0)
                    right.append(0)
                    left[at] = build(rows[~side], tree)
                    right[at] = build(rows[side], tree)
                    return at
        leaf_tree.append(tree)
        leaf_size.append(len(rows))
        return -len(leaf_size)

    for t in range(trees):
        roots.append(build(np.arange(len(sample)), t))
    dim = sample.shape[1]
    return Forest(np.array(roots), np.array(normals).reshape(-1, dim), np.array(cuts), np.array(left, dtype=np.int64),
                  np.array(right, dtype=np.int64), np.array(leaf_tree), np.array(leaf_size))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.values.to_numpy(zero_copy_only=False), dtype=np.float64)[
        column.offsets[0].as_py():column.offsets[-1].as_py()].reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def vector_classes(vectors: DataFrame, keep: int, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """Valid (vec_id, vec) rows, and the classes (cid, vec, ids) of equal vectors with their ``keep`` smallest ids."""
    v = F.col("vec")
    valid = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
             .where("vec_id is not null and vec is not null")
             .where((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                    & F.exists(v, lambda x: x != 0)))
    first = Window.partitionBy("vec").orderBy("vec_id")
    classes = (valid.withColumn("nth", F.dense_rank().over(first)).where(F.col("nth") <= keep)
               .groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
               .select(F.col("ids")[0].alias("cid"), "vec", "ids"))
    return valid, classes


def search(vectors: DataFrame, queries_where, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, share: float = SEARCH_SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row that satisfies ``queries_where``.

    ``queries_where`` is a condition on the column ``vec_id``.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    keep = k + 1  # the query itself may be among a class's ids
    valid, classes = vector_classes(vectors, keep, id_col, vec_col)
    classes = materialize(classes, "vector_classes")
    dims = classes.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").take(1)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dims:
        return none
    dim = dims[0]["d"]
    classes = classes.where(F.size("vec") == dim)
    rows = bounded_sample(classes.select("cid", "vec"), "cid", sample).toPandas()
    points = _unit(np.array(rows["vec"].tolist(), dtype=np.float64).reshape(-1, dim))
    forest = grow(points, trees, leaf)
    enough = math.ceil(share * len(points))
    n_classes = classes.count()
    chunks = max(1, round(n_classes / len(points) / 4))
    known = spark.sparkContext.broadcast(forest)  # at most ``sample`` / leaf nodes a tree

    def place(batches):
        for b in batches:
            if b.num_rows:
                leaves = known.value.route(_unit(_matrix(b.column("vec"))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaves.tolist(), pa.list_(pa.int64()))],
                                                 names=[*b.schema.names, "leaves"])

    index = (classes.mapInArrow(place, "cid long, vec array<double>, ids array<long>, leaves array<long>")
             .select("cid", "vec", F.explode("leaves").alias("leaf"))
             .withColumn("chunk", F.pmod(F.xxhash64("cid"), F.lit(chunks)).cast("int")))

    def walk(batches):
        for b in batches:
            if b.num_rows:
                units = _unit(_matrix(b.column("vec")))
                leaves = [known.value.search(u, enough) for u in units]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaves, pa.list_(pa.int64()))],
                                                 names=[*b.schema.names, "leaves"])

    asked = valid.where(queries_where).where(F.size("vec") == dim).select("vec_id", "vec").distinct()
    searches = asked.groupBy("vec").agg(F.min("vec_id").alias("qid")).select("qid", "vec")
    probes = (searches.repartition("qid").mapInArrow(walk, "qid long, vec array<double>, leaves array<long>")
              .select("qid", "vec", F.explode("leaves").alias("leaf"))
              .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": [], "cid": [], "score": []})
        right = right.sort_values("cid", kind="stable")
        c = np.array(right["vec"].tolist(), dtype=np.float64)
        ids = right["cid"].to_numpy()
        norms = np.sqrt((c * c).sum(axis=1))
        near, scores = [], []
        for q in left["vec"]:
            q = np.asarray(q, dtype=np.float64)
            score = (c * q).sum(axis=1) / (norms * np.sqrt((q * q).sum()))
            best = np.argsort(-score, kind="stable")[:keep]
            near.append(ids[best])
            scores.append(score[best])
        return pd.DataFrame({"qid": np.repeat(left["qid"].to_numpy(), [len(x) for x in near]),
                             "cid": np.concatenate(near), "score": np.concatenate(scores)})

    found = (probes.groupBy("leaf", "chunk").cogroup(index.groupBy("leaf", "chunk"))
             .applyInPandas(rerank, "qid long, cid long, score double"))
    # A candidate met in several trees has one score; classes open into their smallest ids.
    best = (found.groupBy("qid", "cid").agg(F.max("score").alias("score"))
            .withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid")))
            .where(F.col("nth") <= keep).join(classes.select("cid", "ids"), "cid")
            .groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "ids"))).alias("classes"))
            .select("qid", F.slice(F.array_sort(F.flatten(F.transform(
                "classes", lambda c: F.transform(c["ids"], lambda i: F.struct(c["minus"].alias("minus"), i.alias("vec_id")))))),
                1, keep).alias("near")))
    names = searches.select("qid", F.col("vec").alias("v")).join(
        asked.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("v")), "v").select("query_id", "qid")
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (names.join(best, "qid").select("query_id", F.posexplode(own).alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                    (-F.col("hit.minus")).alias("score")))
