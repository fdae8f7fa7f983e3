"""Nearest neighbours by largest inner product with a hierarchical k-means tree and best-bin-first search.

The tree is fitted to a bounded sample, then every usable row descends to its leaf. To search by inner product, a row of norm n gets one more component,
sqrt(m * m - n * n) for the largest norm m; the distance to a query then falls as the inner product rises. A query walks the tree through a priority
queue, nearest cell first, and visits leaves in that order. How many is calibrated: for a sample of the queries the true neighbours are found by brute
force over all rows, and visits widen until the stated recall is reached. Leaves are grouped, a large one over several groups, and queries are dealt in
blocks: a task has a block's queries at hand, its group's rows pass by, and only the k best rows of each query leave it, not those of each leaf.

Cases. Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows without id. Vectors of different lengths have no
product; each length has its own tree. Fewer candidates than k: all are returned. Repeated ids: each row is a candidate, except to queries of that id; query
rows that repeat id and vector are one query, different vectors under one id are searched for apart. Ties go to the smaller id. Empty table: no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import written
from callweave.llm.vectors import lengths, matrix, usable

#: Rows that the tree is fitted to and queries that calibrate the search, at most; those of the smallest hash of the id.
SAMPLE_ROWS, CALIBRATION_QUERIES = 20_000, 200
LEAF_ROWS, MOST_LEAVES, BRANCHES = 512, 65_536, 8
#: Groups of leaves, each of which gives a query k rows however many leaves it visits there; queries that a task has at once, and products.
GROUPS, QUERY_BLOCK, MATRIX = 16, 65_536, 1 << 20
RECALL = 0.96


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return np.unique(centres, axis=0)


class Tree:
    """centres: of every node; children: of inner nodes; leaf: number of a leaf, -1 for inner nodes. Node 0 is the root."""

    def __init__(self, sample: np.ndarray, leaf_sample: float, seed: int = 5):
        self.centres, self.children, self.leaf, self.leaves = [np.zeros(sample.shape[1])], [[]], [-1], 0
        rng, todo = np.random.default_rng(seed), [(0, sample)]
        while todo:
            node, x = todo.pop()
            k = min(BRANCHES, int(np.ceil(len(x) / max(1.0, leaf_sample))))
            centres = _kmeans(x, k, rng) if k > 1 else None
            if centres is None or len(centres) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            own = self._nearest(x, centres)
            for j, centre in enumerate(centres):
                self.children[node].append(len(self.leaf))
                todo.append((len(self.leaf), x[own == j]))
                self.centres.append(centre)
                self.children.append([])
                self.leaf.append(-1)
        self.norms = (np.array(self.centres) ** 2).sum(1)

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        centres = np.array(self.centres)
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                own = self._nearest(x[rows], centres[self.children[node]])
                todo += [(child, rows[own == j]) for j, child in enumerate(self.children[node])]
        return out

    def order(self, query: np.ndarray, visits: int) -> list[int]:
        """The first leaves that best-bin-first search visits."""
        centres, queue, out = np.array(self.centres) if not hasattr(self, "_array") else self._array, [(0.0, 0)], []
        self._array = centres
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                continue
            own = self.children[node]
            for d, child in zip((self.norms[own] - 2 * centres[own] @ query).tolist(), own, strict=True):
                heapq.heappush(queue, (d, child))
        return out


class _Nearest:
    """The k best rows so far of each query of a block: by exact scores, ties by id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.limit = np.full(len(ids), -np.inf)
        self.at, self.near, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.new = 0

    def see(self, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Shows rows to the queries at."""
        for lo in range(0, len(at), max(1, MATRIX // len(ids))):
            asked = at[lo : lo + max(1, MATRIX // len(ids))]
            rough = self.q[asked] @ x.T
            rough[self.ids[asked][:, None] == ids] = -np.inf
            limit = self.limit[asked]
            first = np.flatnonzero(limit == -np.inf)
            if len(first) and len(ids) > self.k:
                limit[first] = np.partition(rough[first], len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            tolerance = 1e-9 * np.maximum(1.0, np.where(np.isfinite(limit), np.abs(limit), 1.0))
            i, j = np.nonzero((rough >= (limit - tolerance)[:, None]) & (rough > -np.inf))
            for cut in range(0, len(i), MATRIX // 16):
                one, two = asked[i[cut : cut + MATRIX // 16]], j[cut : cut + MATRIX // 16]
                self.held.append((one, ids[two], (x[two] * self.q[one]).sum(1)))
            self.new += len(i)
            if self.new > max(MATRIX, len(self.ids) * self.k):
                self.settle()

    def settle(self) -> None:
        at, near, scores = (np.concatenate(c) for c in zip((self.at, self.near, self.scores), *self.held, strict=True))
        order = np.lexsort((near, -scores, at))
        starts = np.searchsorted(at[order], np.arange(len(self.ids)))
        order = order[np.arange(len(order)) - starts[at[order]] < self.k]
        self.at, self.near, self.scores, self.held, self.new = at[order], near[order], scores[order], [], 0
        full = np.flatnonzero(np.bincount(self.at, minlength=len(self.ids)) == self.k)
        self.limit[full] = self.scores[np.searchsorted(self.at, full, "right") - 1]


def neighbours(table: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (a selection of table's rows) its k best other rows."""
    out = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in lengths(queries, vector):
        found = _of_length(table, queries, dim, k, recall, key, vector)
        out = out.unionByName(found)
    return out


def _of_length(table: DataFrame, queries: DataFrame, dim: int, k: int, recall: float, key: str, vector: str) -> DataFrame:
    """neighbours() among the vectors of one length."""
    spark = table.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        return df.where(usable(df, vector) & (F.size(vector) == dim) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))

    rows, asked = clean(table), written(clean(queries).distinct())
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).first()
    n, m = facts["n"], facts["m"]

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0.0, m * m - (x * x).sum(1)))[:, None]])

    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
    leaves = min(MOST_LEAVES, max(1, -(-n // LEAF_ROWS)))
    tree = spark.sparkContext.broadcast(Tree(lifted(np.stack(sample["x"].map(np.asarray))), max(4.0, len(sample) / leaves)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.value.assign(lifted(matrix(b.column(1), dim))))], names=["id", "x", "leaf"])

    index = written(rows.mapInArrow(assign, "id long, x array<double>, leaf long"))
    visits = _calibrated(index, asked, tree, dim, k, recall)

    # leaves side by side make GROUPS groups of about as many rows; a leaf of more rows than a group is spread over several
    sizes = np.zeros(tree.value.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():  # a row for each leaf, MOST_LEAVES at most
        sizes[r["leaf"]] = r["count"]
    low = (np.cumsum(sizes) - sizes) * GROUPS // n
    high = np.where(sizes * GROUPS > n, (np.cumsum(sizes) - 1) * GROUPS // n, low)
    spans = spark.sparkContext.broadcast((low, high))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = spans.value
        for b in batches:
            x, at, groups, leaves = matrix(b.column(1), dim), [], [], []
            for i, q in enumerate(x):
                found = np.array(tree.value.order(np.append(q, 0.0), visits), np.int32)
                for g in np.unique(np.concatenate([np.arange(lo, hi + 1) for lo, hi in zip(low[found], high[found], strict=True)])).tolist():
                    at.append(i)
                    groups.append(g)
                    leaves.append(found[(low[found] <= g) & (g <= high[found])])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), b.column(1).take(pa.array(at, pa.int64())), pa.array(groups, pa.int64()), pa.array(leaves, pa.list_(pa.int32()))], names=["id", "x", "grp", "leaves"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = spans.value
        for b in batches:
            leaf, mark = b.column(2).to_numpy(), b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(low[leaf] + mark % (high[leaf] - low[leaf] + 1))], names=["id", "x", "leaf", "grp"])

    walks = asked.mapInArrow(walk, "id long, x array<double>, grp long, leaves array<int>").withColumn("mark", F.xxhash64("x"))
    cell = F.col("grp") * blocks + F.pmod(F.xxhash64("id", "x"), F.lit(blocks))
    sent_q = walks.select(cell.cast("int").alias("cell"), F.lit(-1).cast("long").alias("leaf"), "id", "mark", "x", "leaves")
    placed = index.withColumn("mark", F.pmod(F.xxhash64("id", "x"), F.lit(1 << 31))).mapInArrow(place, "id long, x array<double>, leaf long, grp long")
    sent_x = placed.withColumn("block", F.explode(F.expr(f"sequence(0, {blocks - 1})"))).select((F.col("grp") * blocks + F.col("block")).cast("int").alias("cell"), "leaf", "id", F.lit(0).cast("long").alias("mark"), "x", F.lit(None).cast("array<int>").alias("leaves"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cell first the queries, then the rows, by leaf; the rows pass by."""
        asked_here: list[pa.RecordBatch] = []
        nearest, now = None, -1

        def begun() -> None:
            nonlocal nearest, visitors, starts, marks
            queries = pa.Table.from_batches(asked_here).combine_chunks()
            ids, leaves = queries["id"].to_numpy(), queries["leaves"].combine_chunks()
            marks = queries["mark"].to_numpy()
            nearest = _Nearest(ids, matrix(queries["x"].combine_chunks(), dim), k)
            visitors = np.repeat(np.arange(len(ids)), leaves.value_lengths().to_numpy(zero_copy_only=False))
            own = leaves.flatten().to_numpy()
            order = np.argsort(own, kind="stable")
            visitors, starts = visitors[order], np.searchsorted(own[order], np.arange(tree.value.leaves + 1))

        def ended() -> Iterator[pa.RecordBatch]:
            if nearest is not None:
                nearest.settle()
                yield pa.RecordBatch.from_arrays([pa.array(nearest.ids[nearest.at]), pa.array(marks[nearest.at]), pa.array(nearest.near), pa.array(nearest.scores)], names=["query_id", "mark", "id", "score"])

        visitors = starts = marks = np.zeros(0, np.int64)
        for b in batches:
            cells, leaf = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(cells, prepend=-1) != 0) | (np.diff(leaf, prepend=-2) != 0))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(cells)], strict=True):
                if cells[lo] != now:
                    yield from ended()
                    asked_here, nearest, now = [], None, cells[lo]
                run = b.slice(lo, hi - lo)
                if leaf[lo] < 0:
                    asked_here.append(run)
                    continue
                if nearest is None and asked_here:
                    begun()
                    asked_here = [asked_here[0].slice(0, 0)]
                if nearest is not None:
                    at = visitors[starts[leaf[lo]] : starts[leaf[lo] + 1]]
                    if len(at):
                        nearest.see(at, run.column(2).to_numpy(), matrix(run.column(4), dim))
        yield from ended()

    sent = sent_q.unionByName(sent_x).repartitionById(GROUPS * blocks, "cell").sortWithinPartitions("cell", "leaf")
    partial = sent.mapInArrow(visit, "query_id long, mark long, id long, score double")
    return _first(partial, ["query_id", "mark"], k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _first(found: DataFrame, query: list[str], k: int) -> DataFrame:
    """The k best rows of each query, with rank; each task keeps k of a query before they are dealt."""
    order = Window.partitionBy(*query).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(index: DataFrame, asked: pd.DataFrame, dim: int, k: int) -> DataFrame:
    """query_id, id, leaf, score of the k best rows for a bounded set of queries, from all rows in blocks."""
    ids, q = asked["id"].to_numpy(), np.stack(asked["x"].map(np.asarray))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, x, leaf = b.column(0).to_numpy(), matrix(b.column(1), dim), b.column(2).to_numpy()
            out = []
            for lo in range(0, len(x), 8192):
                rough = q @ x[lo : lo + 8192].T
                for j in range(len(q)):
                    at = np.flatnonzero(own[lo : lo + 8192] != ids[j])
                    at = at[np.argsort(-rough[j][at], kind="stable")[:k]]
                    out.append(np.column_stack([np.full(len(at), ids[j]), own[lo + at], leaf[lo + at], rough[j][at]]))
            rows = np.vstack(out) if out else np.zeros((0, 4))
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, c].astype(np.int64)) for c in range(3)] + [pa.array(rows[:, 3])], names=["query_id", "id", "leaf", "score"])

    near = index.mapInArrow(scan, "query_id long, id long, leaf long, score double")
    return _first(near, ["query_id"], k).drop("rank")


def _calibrated(index: DataFrame, asked: DataFrame, tree, dim: int, k: int, recall: float) -> int:
    """The least number of leaves at which the sampled queries meet the stated share of their true neighbours."""
    sample = asked.groupBy("id").agg(F.min("x").alias("x")).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(CALIBRATION_QUERIES).toPandas()
    if not len(sample):
        return 1
    true = brute_force(index, sample, dim, k).select("query_id", "leaf").toPandas()
    at = {i: {leaf: rank for rank, leaf in enumerate(tree.value.order(np.append(np.asarray(x), 0.0), tree.value.leaves))} for i, x in zip(sample["id"], sample["x"], strict=True)}
    ranks = np.sort([at[i][leaf] for i, leaf in zip(true["query_id"], true["leaf"], strict=True)])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if len(ranks) else 1
