"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample and every vector is filed under its leaf. A query walks the tree best bin
first: a priority queue over nodes by distance to their centres yields leaves from near to far. How many leaves a
query visits is calibrated on sample queries against brute force, widening until the wanted recall is reached.
Visited leaves are compared in blocks of bounded numbers of queries and vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.storage import Workspace, read_table

K = 10
#: The sample that the tree is fitted on: one vector in SAMPLE_SHARE, but SAMPLE at least (or all) and MOST_SAMPLE at most.
SAMPLE, SAMPLE_SHARE, MOST_SAMPLE = 16_384, 64, 131_072
CALIBRATION_QUERIES = 256
TARGET_RECALL = 0.97
BRANCHES = 8
LEAF_SIZE = 64
#: Vectors and queries compared in one task's block.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024


class Tree:
    """Hierarchical k-means: nodes with centres, leaves numbered from 0."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf_size: int = LEAF_SIZE, seed: int = 7):
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        self.centres: list[np.ndarray] = [sample.mean(axis=0) if len(sample) else np.zeros(0)]
        self.n_leaves = 0
        rng = np.random.default_rng(seed)
        open_nodes = [(0, sample)]
        while open_nodes:
            node, rows = open_nodes.pop()
            parts = _kmeans(rows, branches, rng) if len(rows) > leaf_size else []
            if len(parts) < 2:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
                continue
            for centre, own in parts:
                self.children[node].append(len(self.centres))
                open_nodes.append((len(self.centres), own))
                self.centres.append(centre)
                self.children.append([])
                self.leaf.append(-1)
        self.child_centres = [np.stack([self.centres[c] for c in kids]) if kids else None for kids in self.children]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the nearest centre at each level."""
        leaves = np.full(len(rows), -1, dtype=np.int32)
        open_nodes = [(0, np.arange(len(rows)))]
        while open_nodes:
            node, at = open_nodes.pop()
            if not len(at):
                continue
            if self.leaf[node] >= 0:
                leaves[at] = self.leaf[node]
                continue
            nearest = _squared(rows[at], self.child_centres[node]).argmin(axis=1)
            open_nodes += [(child, at[nearest == i]) for i, child in enumerate(self.children[node])]
        return leaves

    def visit(self, query: np.ndarray, most: int) -> list[int]:
        """Up to `most` leaves, best bin first."""
        queue, found = [(0.0, 0)], []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
                continue
            for distance, child in zip(((self.child_centres[node] - query) ** 2).sum(axis=1).tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (distance, child))
        return found


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)


def _kmeans(rows: np.ndarray, branches: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
    centres = rows[rng.choice(len(rows), size=min(branches, len(rows)), replace=False)]
    for _ in range(10):
        own = _squared(rows, centres).argmin(axis=1)
        kept = [i for i in range(len(centres)) if (own == i).any()]
        centres = np.stack([rows[own == i].mean(axis=0) for i in kept])
    own = _squared(rows, centres).argmin(axis=1)
    return [(centres[i], rows[own == i]) for i in range(len(centres)) if (own == i).any()]


def calibrate(tree: Tree, sample: np.ndarray, k: int = K, target: float = TARGET_RECALL) -> int:
    """The least number of leaves, widened by a quarter at a time, that finds `target` of the sample queries' k nearest."""
    if len(sample) < 2:
        return tree.n_leaves
    leaves = tree.assign(sample)
    queries = np.linspace(0, len(sample) - 1, min(CALIBRATION_QUERIES, len(sample))).astype(int)
    needed = []
    for q in queries:
        distances = ((sample - sample[q]) ** 2).sum(axis=1)
        distances[q] = np.inf
        nearest = np.argsort(distances, kind="stable")[: min(k, len(sample) - 1)]
        order = {leaf: i for i, leaf in enumerate(tree.visit(sample[q], tree.n_leaves))}
        needed += [order[leaf] + 1 for leaf in leaves[nearest].tolist()]
    ranks = np.array(needed)
    visits = 1
    while visits < tree.n_leaves and np.mean(ranks <= visits) < target:
        visits = min(tree.n_leaves, visits + max(1, visits // 4))
    return visits


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id long, vector array<double> of the rows that take part.

    Left out: null ids, null vectors, vectors with null or non-finite components, zero vectors, and vectors of
    another length than the most frequent one (ties: the longer).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(finite & F.exists("vector", lambda x: x != 0))
    counts = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    width = counts.agg(F.max(F.struct("n", "length")).alias("top")).first()["top"]
    return rows.filter(F.size("vector") == (width["length"] if width else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, sample: int | None = None, target: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of the visited leaves by Euclidean distance.

    vectors, queries: id, vector as from `valid_vectors`. Candidates are all rows with another id than the query's;
    ties go to the smaller id. Of equal vectors only the k + 1 smallest ids can be among a query's k nearest, so the
    others are not indexed; this loses nothing and keeps a frequent vector from filling a leaf. Repeated queries
    are answered once; rows of one id with different vectors are candidates each. Where there are fewer than k
    candidates, all are returned; an empty table gives no rows. `valid_vectors` leaves other columns unread.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "neighbours")
    turn = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    distinct = vectors.dropDuplicates(["id", "vector"]).withColumn("turn", turn).filter(F.col("turn") <= k + 1)
    distinct = work.table(distinct, "distinct")
    queries = work.table(queries.dropDuplicates(["id", "vector"]), "queries")

    if sample is None:
        sample = min(MOST_SAMPLE, max(SAMPLE, distinct.filter("turn = 1").count() // SAMPLE_SHARE))
    picked = distinct.filter("turn = 1").select("vector", F.xxhash64("id").alias("h")).orderBy("h").limit(sample)
    rows = picked.select("vector").toArrow().column(0)
    points = _matrix(rows) if len(rows) else np.zeros((0, 1))
    tree = Tree(points)
    visits = calibrate(tree, points, k, target)
    shared = spark.sparkContext.broadcast(tree)  # at most 2 * MOST_SAMPLE centres

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                leaves = pa.array(shared.value.assign(_matrix(batch.column(1))), pa.int32())
                yield pa.RecordBatch.from_arrays([leaves, *batch.columns], names=["leaf", "id", "vector"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [shared.value.visit(q, visits) for q in _matrix(part.column(1))]
                rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
                taken = part.take(pa.array(rows))
                leaves = pa.array(np.concatenate(found).astype(np.int32) if found else [], pa.int32())
                yield pa.RecordBatch.from_arrays([leaves, *taken.columns], names=["leaf", "id", "vector"])

    schema = "leaf int, id long, vector array<double>"
    filed = work.table(distinct.select("id", "vector").mapInArrow(file, schema), "filed")
    walked = work.table(queries.select("id", "vector").mapInArrow(walk, schema), "walked")
    sizes = filed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).cast("int").alias("v_blocks"))
    loads = walked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("q_blocks"))
    # One row per leaf; leaves are bounded by the sample.
    grid = F.broadcast(sizes.join(loads, "leaf"))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = walked.join(grid, "leaf").withColumn("q", deal("q_blocks")).withColumn("v", every("v_blocks"))
    right = filed.join(grid, "leaf").withColumn("v", deal("v_blocks")).withColumn("q", every("q_blocks"))

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        parts = []
        if len(asked) and len(held):
            own, ids = held.column("id").to_numpy(), asked.column("id").to_numpy()
            points = _matrix(held.column("vector"))
            for i, query in enumerate(_matrix(asked.column("vector"))):
                other = own != ids[i]
                scores = np.sqrt(((points - query) ** 2).sum(axis=1))[other]
                order = np.lexsort((own[other], scores))[:k]
                parts.append((np.full(len(order), ids[i]), own[other][order], scores[order]))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    key = ["leaf", "v", "q"]
    pairs = left.select(*key, "id", "vector").groupBy(*key).cogroup(right.select(*key, "id", "vector").groupBy(*key))
    near = pairs.applyInArrow(compare, "query_id long, vec_id long, score double").dropDuplicates()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every row whose vec_id is divisible by 100, searched among all embeddings."""
    vectors = valid_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(vectors, vectors.filter("id % 100 = 0"))
