"""Nearest neighbours by inner product through a hierarchical k-means tree.

The tree is fitted on the driver from a bounded sample (``sample`` vectors, picked by a
hash of the id). A query walks it best bin first: a priority queue holds the branches
by the inner product with their centres, and leaves are visited in that order. How many
are visited is calibrated at the table's own density: at most ``TRIALS`` queries are
answered by brute force over all rows (one pass, a few rows a task go on), and the visits
are widened until ``recall`` of the true neighbours is reached. A query goes on to further
leaves until those visited hold enough vectors, so it gets k neighbours wherever there are
as many. Every vector is indexed: leaves are grouped into buckets of about ``BUCKET``
vectors, a leaf that is larger (a vector with many copies) is dealt over several. Blocks of
queries meet the buckets they visit in a join; a block and a bucket are one matrix product,
and the best are scored exactly in double precision.

Defined results: vectors that are null, zero, of another length than most, or hold null
or non-finite components take no part, neither do rows without an id; rows with the
query's own id are no candidates of it; a repeated query id asks once (its first vector that
takes part, in the order of its components), other repeated rows are separate candidates; ties
go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimill.functions.durable import written

from .textnp import tuned

#: Vectors the tree is fitted on, at most; and queries it is calibrated with.
SAMPLE, TRIALS = 16_384, 192
BRANCH, LEAF = 8, 64
#: Vectors in a bucket, queries in a block, and visits that a task holds before it sends on what blocks it has.
BUCKET, QUERIES, WAITING = 4096, 256, 100_000


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays: a node's children are ``first`` to ``first + count``; a leaf has count 0 and a leaf number."""

    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.count == 0).sum())

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child, from the root down."""
        node = np.zeros(len(x), np.int64)
        busy = np.arange(len(x)) if self.count[0] else np.zeros(0, np.int64)
        while len(busy):
            for n in np.unique(node[busy]):
                own = busy[node[busy] == n]
                c = self.centre[self.first[n] : self.first[n] + self.count[n]]
                node[own] = self.first[n] + ((c * c).sum(1) - 2 * x[own] @ c.T).argmin(1)
            busy = busy[self.count[node[busy]] > 0]
        return self.leaf[node]

    def visits(self, q: np.ndarray, most: int) -> np.ndarray:
        """The leaves of one query, best bin first."""
        near = self.centre @ q
        heap, out = [(-near[0], 0)], []
        while heap and len(out) < most:
            _, n = heapq.heappop(heap)
            if self.count[n]:
                for c in range(self.first[n], self.first[n] + self.count[n]):
                    heapq.heappush(heap, (-near[c], c))
            else:
                out.append(self.leaf[n])
        return np.array(out, np.int64)


def fitted(x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, rounds: int = 8) -> Tree:
    """A tree of k-means splits down to nodes of ``leaf`` vectors; the same vectors give the same tree."""
    centre, first, count, todo, at = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [0], [0], [(0, np.arange(len(x)))], 0
    while at < len(todo):
        node, own = todo[at]
        at += 1
        if len(own) <= leaf:
            continue
        y = x[own]
        c = y[np.linspace(0, len(own) - 1, branch).astype(int)]
        for _ in range(rounds):
            part = ((c * c).sum(1) - 2 * y @ c.T).argmin(1)
            size = np.bincount(part, minlength=branch)
            total = np.zeros_like(c)
            np.add.at(total, part, y)
            c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        used = np.unique(part)
        if len(used) < 2:  # copies of one vector
            continue
        first[node], count[node] = len(centre), len(used)
        for k in used:
            todo.append((len(centre), own[part == k]))
            centre.append(c[k])
            first.append(0)
            count.append(0)
    count_ = np.array(count)
    numbers = np.cumsum(count_ == 0) - 1
    return Tree(np.array(centre), np.array(first), count_, np.where(count_ == 0, numbers, -1))


def calibrated(tree: Tree, asked: np.ndarray, homes: list[np.ndarray], recall: float) -> int:
    """The fewest leaf visits (widened by a twentieth at a time) with which queries find ``recall`` of their neighbours, whose leaves are ``homes``."""
    order = [np.zeros(0, np.int64)]
    for q, home in zip(asked, homes, strict=True):
        rank = np.empty(tree.leaves, np.int64)
        rank[tree.visits(q, tree.leaves)] = np.arange(tree.leaves)
        order.append(rank[home])
    order = np.concatenate(order)
    if not len(order):
        return tree.leaves
    visits = 1
    while visits < tree.leaves and (order < visits).mean() < recall:
        visits = min(tree.leaves, visits + max(1, visits // 20))
    return visits


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their vectors in double precision."""
    rows, out = [], []
    for i, v in enumerate(column):
        if v.is_valid and len(v.values) == width and v.values.null_count == 0:
            rows.append(i)
            out.append(v.values.to_numpy(zero_copy_only=False))
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, width))
    x = np.array(out, np.float64)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return np.array(rows)[good], x[good]


def _best(q: np.ndarray, s: np.ndarray, x: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids and their exact scores. ``s``: the products as a matrix product gives them, -inf for what isn't visited."""
    s = np.where(ids == own, -np.inf, s)
    near = np.flatnonzero(s > -np.inf)
    if len(near) > k:
        bar = np.partition(s, len(s) - k)[len(s) - k]
        near = np.flatnonzero(s >= bar - 1e-9 * max(1.0, abs(bar)))
    exact = (x[near] * q).sum(1)  # one order of summation for all, so that equal vectors tie
    top = np.lexsort((ids[near], -exact))[:k]
    return ids[near][top], exact[top]


def nearest(frame: DataFrame, queries: Column, k: int = 20, recall: float = 0.95, sample: int = SAMPLE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found. ``queries``: a condition on ``vec_id``."""
    spark = frame.sparkSession
    tuned(spark)
    rows = frame.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull())
    asks = rows.where(queries).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    schema = "query_id long, rank int, vec_id long, score double"
    kept = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    lengths = kept["v"].map(len)
    if not len(kept) or not lengths.max():
        return spark.createDataFrame([], schema)
    width = int(lengths[lengths > 0].mode().iloc[0])
    taken, x = _matrix(pa.array(kept["v"].tolist(), pa.list_(pa.float64())), width)
    order = np.lexsort((*x.T, kept["vec_id"].to_numpy()[taken]))
    x = x[order]
    if not len(x):
        return spark.createDataFrame([], schema)
    tree = fitted(x)

    def indexed(batches):
        for batch in batches:
            own, y = _matrix(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([pa.array(tree.assign(y).astype(np.int32)), batch.column(0).take(pa.array(own)), pa.array([r.tobytes() for r in y], pa.binary())], ["leaf", "vec_id", "v"])

    index = written(rows.mapInArrow(indexed, "leaf int, vec_id long, v binary"), "vectors")
    trials = asks.orderBy(F.xxhash64(F.lit(7), "vec_id"), "vec_id").limit(TRIALS).toPandas()
    own, tried = _matrix(pa.array(trials["v"].tolist(), pa.list_(pa.float64())), width)
    tried_ids = trials["vec_id"].to_numpy()[own]

    def answered_in_full(batches):
        # the best of a task's vectors for each trial
        held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32))] * len(tried)
        for batch in batches:
            if not batch.num_rows or not len(tried):
                continue
            y = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(-1, width)
            leaf, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            near = tried @ y.T
            for t in range(len(tried)):
                score = np.where(ids == tried_ids[t], -np.inf, near[t])
                top = np.argpartition(-score, k)[:k] if len(score) > k else np.arange(len(score))
                i, s, h = (np.concatenate(c) for c in zip(held[t], (ids[top], score[top], leaf[top]), strict=True))
                best = np.lexsort((i, -s))[:k]
                held[t] = i[best], s[best], h[best]
        for t, (i, s, h) in enumerate(held):
            good = np.isfinite(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(good.sum(), t, np.int32)), pa.array(i[good]), pa.array(s[good]), pa.array(h[good])], ["trial", "vec_id", "score", "leaf"])

    full = index.mapInArrow(answered_in_full, "trial int, vec_id long, score double, leaf int")
    full = full.withColumn("_nth", F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "vec_id"))).where(F.col("_nth") <= k)
    true = full.select("trial", "leaf").toPandas()  # at most TRIALS * k rows
    visits = calibrated(tree, tried, [true["leaf"].to_numpy()[true["trial"].to_numpy() == t] for t in range(len(tried))], recall)
    # at most ``sample`` leaves
    sizes = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    held_by = np.array([sizes.get(leaf, 0) for leaf in range(tree.leaves)])
    start, parts, total, room = np.zeros(tree.leaves, np.int32), np.ones(tree.leaves, np.int32), 0, 0
    for leaf in range(tree.leaves):  # neighbouring leaves share a bucket; a large leaf has several
        n = sizes.get(leaf, 0)
        if n > BUCKET:
            total += room > 0
            start[leaf], parts[leaf], room = total, -(-n // BUCKET), 0
            total += parts[leaf]
        else:
            if room + n > BUCKET:
                total, room = total + 1, 0
            start[leaf] = total
            room += n

    most_copies = index.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0  # rows of one id at most

    def bucketed(batches):
        for batch in batches:
            leaf = batch.column(0).to_numpy()
            salt = np.arange(len(leaf)) % parts[leaf]  # any vector of a large leaf may lie in any of its buckets
            yield pa.RecordBatch.from_arrays([pa.array((start[leaf] + salt).astype(np.int32)), *batch.columns], ["bucket", "leaf", "vec_id", "v"])

    def asked(batches):
        held: dict[int, list] = {}
        waiting = 0

        def block(b):
            qs = held.pop(b)
            return pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([[i for i, _, _ in qs]], pa.list_(pa.int64())), pa.array([b"".join(v.tobytes() for _, v, _ in qs)], pa.binary()), pa.array([[w.tobytes() for _, _, w in qs]], pa.list_(pa.binary()))],
                ["bucket", "ids", "q", "leaves"],
            )

        for batch in batches:
            own, y = _matrix(batch.column(1), width)
            ids = batch.column(0).to_numpy()
            for i, v in zip(ids[own].tolist(), y, strict=True):
                way = tree.visits(v, visits)
                if held_by[way].sum() <= k + most_copies and len(way) < tree.leaves:  # go on until there are enough besides the query's own rows
                    way = tree.visits(v, tree.leaves)
                    way = way[: max(visits, int(np.searchsorted(np.cumsum(held_by[way]), k + most_copies, "right")) + 1)]
                goal = np.concatenate([np.arange(start[w], start[w] + parts[w]) for w in way])
                leaf = np.repeat(way, parts[way]).astype(np.int32)
                by = np.argsort(goal, kind="stable")
                goal, leaf = goal[by], leaf[by]
                cuts = np.flatnonzero(np.diff(goal)) + 1
                for b, ls in zip(goal[np.concatenate([[0], cuts])].tolist(), np.split(leaf, cuts), strict=True):
                    held.setdefault(b, []).append((i, v, ls))
                    waiting += 1
                    if len(held[b]) >= QUERIES:
                        waiting -= QUERIES
                        yield block(b)
                if waiting > WAITING:
                    for b in list(held):
                        yield block(b)
                    waiting = 0
        for b in list(held):
            yield block(b)

    def packed(batches):
        # rows come sorted by bucket; a bucket holds about BUCKET vectors and is sent on in one row
        held: list = []
        at = None

        def row():
            leaf, ids, v = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([leaf.astype("<i4").tobytes()], pa.binary()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["bucket", "leaf", "ids", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            leaf, ids = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            v = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float64).reshape(-1, width)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if at is not None and (bucket[a] != at or sum(len(h[0]) for h in held) >= 2 * BUCKET):
                    yield row()
                    held = []
                at = int(bucket[a])
                held.append((leaf[a:b], ids[a:b], v[a:b]))
        if held:
            yield row()

    def answered(batches):
        for batch in batches:
            out: list[tuple] = []
            for r in range(batch.num_rows):
                leaf, ids = np.frombuffer(batch.column(4)[r].as_py(), "<i4"), np.frombuffer(batch.column(5)[r].as_py(), "<i8")
                y = np.frombuffer(batch.column(6)[r].as_py(), np.float64).reshape(-1, width)
                qs = np.frombuffer(batch.column(2)[r].as_py(), np.float64).reshape(-1, width)
                near = qs @ y.T
                for q, s, own, way in zip(qs, near, batch.column(1)[r].as_py(), batch.column(3)[r].as_py(), strict=True):
                    use = np.zeros(tree.leaves, bool)
                    use[np.frombuffer(way, np.int32)] = True
                    got, score = _best(q, np.where(use[leaf], s, -np.inf), y, ids, own, k)
                    out += zip([own] * len(got), got.tolist(), score.tolist(), strict=True)
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])

    buckets = index.mapInArrow(bucketed, "bucket int, leaf int, vec_id long, v binary").repartition("bucket").sortWithinPartitions("bucket")
    buckets = written(buckets.mapInArrow(packed, "bucket int, leaf binary, ids binary, v binary"), "buckets")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    asks = asks.where((F.size("v") == width) & finite & F.exists("v", lambda c: c != 0))
    blocks = asks.groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(asked, "bucket int, ids array<long>, q binary, leaves array<binary>")
    joined = blocks.join(buckets.withColumnsRenamed({"leaf": "leaf_of", "ids": "vec_ids"}), "bucket").select("bucket", "ids", "q", "leaves", "leaf_of", "vec_ids", "v")
    found = joined.mapInArrow(answered, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
