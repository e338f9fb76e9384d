"""Approximate nearest neighbours: a forest of random-projection trees searched through one priority queue.

Trees are fitted on a bounded sample and sent to every task; every vector of the table is then routed to a leaf of
each tree. A query's search pops the nearest open branch over all trees until the leaves visited hold a share of the
sample, the same at any size of the table; what these leaves hold of the whole table is reranked by exact distance.
Equal vectors are one entry with their smallest ids, as many as a result can need, and equal queries are one search, so
a group of copies costs no more than one vector.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, partitions, table

TREES, LEAF, NEAREST, EVERY = 24, 24, 10, 100
#: Fitted on at most so many vectors, those with the smallest hashes of their ids.
SAMPLE = 16_384
#: A search goes on until its leaves hold this share of the sample, summed over trees (recall: see the README).
SHARE = 1.0
FOUND = "asked long, vec_id long, score double"


class Tree:
    """Nodes in arrays: a split by the hyperplane half-way between two sample vectors, or a leaf."""

    def __init__(self, sample: np.ndarray, seed: int, leaf: int = LEAF):
        self.normal, self.offset, self.child, self.size = [], [], [], []
        drawn, width = np.random.default_rng(seed), sample.shape[1]
        todo = [(np.arange(len(sample)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = len(self.child)
            if parent is not None:
                self.child[parent][side] = me
            self.child.append([-1, -1])
            self.size.append(len(rows))
            right = None
            if len(rows) > leaf:
                for _ in range(4):
                    a, b = sample[drawn.choice(rows, 2, replace=False)]
                    normal = (a - b) / max(float(np.linalg.norm(a - b)), 1e-12)
                    offset = float(normal @ (a + b)) / 2
                    right = sample[rows] @ normal > offset
                    if 0.1 < right.mean() < 0.9:
                        break
                if not right.any() or right.all():
                    right = None
            self.normal.append(np.zeros(width) if right is None else normal)
            self.offset.append(0.0 if right is None else offset)
            if right is not None:
                todo += [(rows[~right], me, 0), (rows[right], me, 1)]
        self.normal, self.offset, self.child = np.array(self.normal), np.array(self.offset), np.array(self.child)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        at = np.zeros(len(x), dtype=np.int64)
        going = np.arange(len(x))
        while len(going):
            inner = self.child[at[going], 0] >= 0
            going = going[inner]
            node = at[going]
            right = np.einsum("ij,ij->i", x[going], self.normal[node]) > self.offset[node]
            at[going] = self.child[node, right.astype(np.int64)]
        return at


class Forest:
    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF):
        self.trees = [Tree(sample, 7919 * i + 1, leaf) for i in range(trees)]

    def search(self, x: np.ndarray, visit: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the leaves nearest to x: a branch's priority is its smallest margin so far."""
        queue, found, seen = [(-np.inf, t, 0) for t in range(len(self.trees))], [], 0
        heapq.heapify(queue)
        while queue and seen < visit:
            bound, t, node = heapq.heappop(queue)
            tree = self.trees[t]
            while tree.child[node][0] >= 0:
                margin = float(tree.normal[node] @ x) - tree.offset[node]
                side = int(margin > 0)
                heapq.heappush(queue, (max(bound, abs(margin)), t, int(tree.child[node][1 - side])))
                node = int(tree.child[node][side])
            found.append((t, node))
            seen += max(1, tree.size[node])
        return found


def usable(col):
    """Neither null nor zero, and every component a finite number."""
    finite = F.forall(col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return col.isNotNull() & (F.size(col) > 0) & finite & F.exists(col, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def fewest(asked: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest distinct ids of each search, ties to the smaller id."""
    order = np.lexsort((ids, scores, asked))
    asked, ids, scores = asked[order], ids[order], scores[order]
    new = np.concatenate(([True], (asked[1:] != asked[:-1]) | (ids[1:] != ids[:-1])))  # repeats of an id have its score
    asked, ids, scores = asked[new], ids[new], scores[new]
    first = np.flatnonzero(np.concatenate(([True], asked[1:] != asked[:-1])))
    rank = np.arange(len(asked)) - np.repeat(first, np.diff(np.concatenate((first, [len(asked)]))))
    return asked[rank < k], ids[rank < k], scores[rank < k]


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEAREST, every: int = EVERY, trees: int = TREES, sample: int = SAMPLE, share: float = SHARE) -> DataFrame:
    """(query_id, rank int, vec_id, score): each query's k nearest rows found, by Euclidean distance.

    Queries are the rows whose id is divisible by `every`; a query's own row is no candidate, all others are. Ties
    go to the smaller id. Rows with a null id, or whose vector is null, empty, zero or not finite throughout, take
    no part, nor do vectors of another width than most have. Repeated rows of one id and vector count once; an id
    with two vectors is one query by both; other columns are ignored, whatever their names; fewer than k other rows give what there is; an
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    fine = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull()).where(usable(F.col("v"))).withColumn("h", F.xxhash64("v"))
    wide = fine.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if wide is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fine = fine.where(F.size("v") == wide.w)
    # the smallest ids of each distinct vector: limited in each task before the shuffle
    w = Window.partitionBy("h", "v").orderBy("id")
    few = fine.dropDuplicates(["id", "h", "v"]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    grouped = few.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = cut(grouped.withColumn("entry", F.monotonically_increasing_id()), "entries")  # numbers hold once written
    fitted = _matrix(pa.array([r.v for r in entries.orderBy("h").select("v").limit(sample).collect()], pa.list_(pa.float64())))
    forest = spark.sparkContext.broadcast(Forest(fitted, trees))
    visit = max(1, round(share * len(fitted)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = _matrix(b.column(0)), b.num_rows
            for t, tree in enumerate(forest.value.trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t), pa.int32()), pa.array(tree.route(x), pa.int32()), pa.array([None] * n, pa.int64()), b.column(0), b.column(1)], ["tree", "leaf", "asked", "v", "ids"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(_matrix(b.column(1))):
                at = forest.value.search(x, visit)
                n = len(at)
                v = b.column(1).slice(i, 1)
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in at], pa.int32()), pa.array([a for _, a in at], pa.int32()), pa.array([b.column(0)[i].as_py()] * n, pa.int64()), v.take(pa.array([0] * n)), pa.array([None] * n, pa.list_(pa.int64()))], ["tree", "leaf", "asked", "v", "ids"])

    kind = entries.schema["v"].dataType.simpleString()
    schema = f"tree int, leaf int, asked long, v {kind}, ids array<long>"
    queries = cut(fine.where(F.col("id") % every == 0).select("id", "h", "v").distinct().join(entries.select("h", "v", "entry"), ["h", "v"]).select("id", "entry"), "queries")
    asking = entries.join(queries.select("entry").distinct(), "entry", "left_semi").select("entry", "v").repartition(partitions(spark))
    rows = entries.select("v", "ids").mapInArrow(index, schema).unionByName(asking.mapInArrow(ask, schema))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a leaf: searches first, then entries in pieces, so that a large leaf is never held whole.

        Of a piece, a search gets its k + 1 nearest ids (it may be one of them itself) and all that are as near as the last.
        """
        leaf, asked, asked_v = None, [], []
        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
            is_query = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            x, ids = _matrix(b.column(3)), b.column(4).to_pylist()
            who = b.column(2).fill_null(0).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (is_query[1:] != is_query[:-1]), [True])))
            out: list[list] = [[], [], []]
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if key[s] != leaf:
                    leaf, asked, asked_v = key[s], [], []
                if is_query[s]:
                    asked.append(who[s:e])
                    asked_v.append(x[s:e])
                    continue
                for q, v in zip(asked, asked_v):
                    step = max(1, 100_000 // (e - s))
                    for at in range(0, len(q), step):
                        d = np.sqrt(((x[None, s:e] - v[at : at + step, None]) ** 2).sum(axis=2))
                        edge = np.partition(d, k, axis=1)[:, k : k + 1] if e - s > k + 1 else np.full((len(d), 1), np.inf)
                        i, j = np.nonzero(d <= edge)
                        n = [len(ids[s + m]) for m in j]
                        out[0].append(np.repeat(q[at + i], n))
                        out[1].append([y for m in j for y in ids[s + m]])
                        out[2].append(np.repeat(d[i, j], n))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in fewest(np.concatenate(out[0]), np.concatenate(out[1]).astype(np.int64), np.concatenate(out[2]), k + 1)], ["asked", "vec_id", "score"])

    ordered = rows.repartition(partitions(spark), "tree", "leaf").sortWithinPartitions("tree", "leaf", F.col("asked").isNull()).select("tree", "leaf", "asked", "v", "ids")
    # a search keeps k + 1 rows, as a query that shares its vector drops its own
    near = Window.partitionBy("asked").orderBy("score", "vec_id")
    found = ordered.mapInArrow(rerank, FOUND).distinct().withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
    top = Window.partitionBy("query_id").orderBy("score", "vec_id")
    answers = queries.select(F.col("id").alias("query_id"), F.col("entry").alias("asked")).join(found, "asked").where("query_id <> vec_id")
    return answers.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
