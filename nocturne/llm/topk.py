"""Exact top-k inner products by ball trees, shard by shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import dropped, staged

SHARD_ROWS = BLOCK_ROWS = 8192
LEAF_ROWS = 128
#: Vectors that fit the top of the tree, at most, and its leaves, which all tasks get (a centre and a radius each); larger leaves are cut by hash.
SAMPLE_ROWS, MOST_LEAVES = 20_000, 4096


class BallTree:
    """Nodes with centre, radius and a range of the rows of order; children follow their parents."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(vectors))
        self.start, self.end, self.child, centre, radius = [], [], [], [], []
        todo = [(0, len(vectors), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = vectors[self.order[a:b]]
            middle = own.mean(axis=0)
            apart = np.sqrt(((own - middle) ** 2).sum(axis=1))
            i = len(self.start)
            if parent >= 0:
                self.child[parent].append(i)
            self.start.append(a)
            self.end.append(b)
            self.child.append([])
            centre.append(middle)
            radius.append(apart.max())
            if b - a > leaf_rows:
                far = own[apart.argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                half = (b - a) // 2
                split = np.argpartition(own @ (far - other), half)
                self.order[a:b] = self.order[a:b][split]
                todo += [(a, a + half, i), (a + half, b, i)]
        self.centre, self.radius = np.array(centre), np.array(radius)

    def bounds(self, queries: np.ndarray, nodes: list[int]) -> np.ndarray:
        """No row of a node has a larger inner product with a query."""
        return reach(queries, self.centre[nodes], self.radius[nodes])


def reach(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The largest inner product that each query can have with anything in each ball; the margin covers rounding."""
    length = np.sqrt((queries**2).sum(axis=1))[:, None]
    bound = queries @ centre.T + length * radius
    return bound + 1e-9 * (1 + length * (np.sqrt((centre**2).sum(axis=1)) + radius))  # terms may cancel out, their rounding doesn't


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """a @ b.T of whole numbers: as doubles while these hold every sum exactly, else as Python's integers."""
    if exact:
        return (a @ b.T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's row, ids, scores) of the k best rows with a score of at least `least`; the query's own id takes no part.

    Nodes are left out where their bound is under the query's current k-th score, which starts at
    least. A query visits its leaves from the highest bound on.
    """
    if not len(ids) or not len(query_ids):
        return
    most = max(np.abs(vectors).max(initial=0), np.abs(queries).max(initial=0))
    exact = float(most) ** 2 * max(1, vectors.shape[1]) < 2**53
    v, q = vectors.astype(np.float64), queries.astype(np.float64)
    tree = BallTree(v)
    limit = least.astype(np.float64).copy()
    # down the tree, level by level, with the queries that still need each node
    level, leaves = [(0, np.arange(len(q)))], []
    while level:
        below = []
        for node, rows in level:
            if not tree.child[node]:
                leaves.append((node, rows))
                continue
            bound = tree.bounds(q[rows], tree.child[node])
            for j, child in enumerate(tree.child[node]):
                on = rows[bound[:, j] >= limit[rows]]
                if len(on):
                    below.append((child, on))
        level = below
    if not leaves:
        return
    rows = np.concatenate([r for _, r in leaves])
    nodes = np.concatenate([np.full(len(r), n) for n, r in leaves])
    bound = np.concatenate([tree.bounds(q[r], [n])[:, 0] for n, r in leaves])
    order = np.lexsort((-bound, rows))
    rows, nodes, bound = rows[order], nodes[order], bound[order]
    turn = np.arange(len(rows)) - np.searchsorted(rows, rows)
    best_score = np.full((len(q), k), np.iinfo(np.int64).min)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    for t in range(int(turn.max()) + 1):
        now = np.flatnonzero((turn == t) & (bound >= limit[rows]))
        for node in np.unique(nodes[now]):
            on = rows[now[nodes[now] == node]]
            members = tree.order[tree.start[node] : tree.end[node]]
            score = products(q[on] if exact else queries[on], v[members] if exact else vectors[members], exact)
            good = (score >= limit[on][:, None]) & (ids[members][None, :] != query_ids[on][:, None])
            some = good.any(axis=1)
            if not some.any():
                continue
            on, score, good = on[some], score[some], good[some]
            score = np.concatenate([best_score[on], np.where(good, score, np.iinfo(np.int64).min)], axis=1)
            name = np.concatenate([best_id[on], np.where(good, ids[members][None, :], np.iinfo(np.int64).max)], axis=1)
            top = np.lexsort((name, ~score), axis=1)[:, :k]  # ~ turns the order around and can't overflow
            best_score[on], best_id[on] = np.take_along_axis(score, top, 1), np.take_along_axis(name, top, 1)
            full = best_score[on, -1]
            limit[on] = np.maximum(limit[on], np.where(full > np.iinfo(np.int64).min, full.astype(np.float64), -np.inf))
    for i in range(len(q)):
        real = best_score[i] > np.iinfo(np.int64).min
        if real.any():
            yield i, best_id[i][real], best_score[i][real]


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, dim and v (64-bit whole numbers floor(scale * x)) of the rows without a null or non-finite part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vec_id is None or x is None or None in x:
                    continue
                x = np.array(x, np.float64)
                if np.isfinite(x).all():
                    found.append((vec_id, len(x), np.floor(scale * x).astype("<i8").tobytes()))
            ids, dims, v = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(v, pa.binary())], names=["vec_id", "dim", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, dim int, v binary")


def _rows(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dim)


class Top:
    """The top of a ball tree, from a sample: planes that deal all vectors out to its leaves, and a centre for each leaf."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = (leaves - 1).bit_length()
        self.inner = (1 << self.depth) - 1
        self.plane, self.cut = np.zeros((self.inner, sample.shape[1])), np.full(self.inner, np.inf)
        held = {0: np.arange(len(sample))}
        for node in range(self.inner):
            rows = held.pop(node)
            right = np.zeros(len(rows), bool)
            if len(rows) > 1:
                own = sample[rows]
                far = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                plane = far - own[((own - far) ** 2).sum(axis=1).argmax()]
                side = own @ plane
                cut = np.median(side)
                cut = cut if side.min() < cut else np.nextafter(cut, np.inf)
                right = side >= cut
                if right.any():
                    self.plane[node], self.cut[node] = plane, cut
            held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]
        leaf = [sample[held[self.inner + i]] for i in range(self.inner + 1)]
        self.centre = np.array([x.mean(axis=0) if len(x) else np.zeros(sample.shape[1]) for x in leaf])

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + ((vectors * self.plane[node]).sum(axis=1) >= self.cut[node])
        return node - self.inner


def _tops(own: DataFrame, sizes: dict[int, int], shard_rows: int) -> dict[int, Top]:
    """A Top for each length of vectors, from the vectors with the smallest hashes: SAMPLE_ROWS at most."""
    tops = {}
    hashed = F.shiftrightunsigned(F.xxhash64("vec_id", "v"), 1)
    for dim, n in sizes.items():
        leaves = min(MOST_LEAVES, -(-n // shard_rows))
        want = min(SAMPLE_ROWS, 64 * leaves)
        some = own.where(F.col("dim") == dim).where(hashed <= min((1 << 63) - 1, int((1 << 63) * 2.0 * want / n)))
        sample = some.orderBy(hashed).limit(want).select("v").toArrow() if leaves > 1 else None
        tops[dim] = Top(_rows(sample.column("v"), dim).astype(np.float64) if sample is not None and len(sample) else np.zeros((1, dim)), leaves)
    return tops


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


HITS = "array<struct<n:long,id:long>>"
_HIT = pa.list_(pa.struct([("n", pa.int64()), ("id", pa.int64())]))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k highest inner products of each query, ties to the smaller id.

    The top of a ball tree, fitted on a bounded sample, deals all rows out to leaves that lie together (a large leaf to several
    shards of about shard_rows), and each leaf's radius is measured over all its rows. A query visits leaves in order of its bound on their inner products,
    one, then two, then four more, ..., and goes on with the k-th score found so far, as long as some leaf's
    bound reaches it. A task has one shard and at most about block_rows queries, builds the rest of the ball tree and leaves out the nodes that
    can't reach a query's k-th score.

    Rows whose vector is null, or holds a null or non-finite part, and rows without an id take no part. A
    query's own id is no answer, so repeated rows of one id don't find each other; as candidates
    they count each. Vectors of different lengths aren't compared. Scores have to fit in 64 bits.
    An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    own = staged(quantized(vectors, scale), "vectors")
    sizes = {r[0]: r[1] for r in own.groupBy("dim").count().collect()}  # a row per length
    tops = spark.sparkContext.broadcast(_tops(own, sizes, shard_rows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_dim(batch):
                v = _rows(rows.column("v"), dim).astype(np.float64)
                leaf = tops.value[dim].leaf(v)
                away = np.sqrt(((v - tops.value[dim].centre[leaf]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(leaf.astype(np.int32)), pa.array(away)], names=["vec_id", "dim", "v", "leaf", "away"])

    dealt = staged(own.mapInArrow(deal, "vec_id long, dim int, v binary, leaf int, away double"), "dealt")
    shape = dealt.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()  # MOST_LEAVES rows for each length
    leaves = {}
    for dim in sizes:
        mine = sorted((r for r in shape if r["dim"] == dim), key=lambda r: r["leaf"])
        leaves[dim] = (np.array([r["leaf"] for r in mine], np.int32), np.array([r["radius"] for r in mine]))
    balls = spark.sparkContext.broadcast(leaves)
    parts = {(r["dim"], r["leaf"]): -(-r["n"] // shard_rows) for r in shape}
    asking = "qid long, vec_id long, dim int, v binary, least double"
    numbered = own.where(is_query).select(F.monotonically_increasing_id().alias("qid"), "vec_id", "dim", "v", F.lit(float("-inf")).alias("least"), F.array().cast(HITS).alias("hits"))
    state = staged(numbered, "queries")

    def ask(begin: int, end: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, rows in _by_dim(batch):
                    q, least = _rows(rows.column("v"), dim).astype(np.float64), rows.column("least").to_numpy()
                    leaf, radius = balls.value[dim]
                    bound = reach(q, tops.value[dim].centre[leaf], radius)
                    order = np.argsort(-bound, axis=1, kind="stable")[:, begin:end]
                    i, j = np.nonzero(np.take_along_axis(bound, order, 1) >= least[:, None])
                    asked = [rows.column(c).take(pa.array(i)) for c in ("qid", "vec_id", "dim", "v", "least")]
                    yield pa.RecordBatch.from_arrays([*asked, pa.array(leaf[order[i, j]])], names=["qid", "vec_id", "dim", "v", "least", "leaf"])

        return run

    def meet(key: tuple, some: pa.Table, asking: pa.Table) -> pa.Table:
        dim, found = key[0].as_py(), [[], []]
        qid = asking.column("qid").to_numpy() if asking.num_rows else np.zeros(0, np.int64)
        if some.num_rows and asking.num_rows:
            for i, names, scores in search(some.column("vec_id").to_numpy(), _rows(some.column("v"), dim), asking.column("vec_id").to_numpy(), _rows(asking.column("v"), dim), asking.column("least").to_numpy(), k):
                found[0].append(qid[i])
                found[1].append([{"n": ~int(x), "id": int(a)} for a, x in zip(names, scores, strict=True)])
        return pa.table({"qid": pa.array(found[0], pa.int64()), "found": pa.array(found[1], _HIT)})

    begin, width, most = 0, 1, max((len(x[0]) for x in leaves.values()), default=0)
    while begin < most:
        asks = staged(state.select(*(c.split()[0] for c in asking.split(", "))).mapInArrow(ask(begin, begin + width), asking + ", leaf int"), "asks")
        counts = asks.groupBy("dim", "leaf").count().collect()
        if not counts:
            break
        plan = lambda: F.broadcast(spark.createDataFrame([(r["dim"], r["leaf"], parts[r["dim"], r["leaf"]], -(-r["count"] // block_rows)) for r in counts], "dim int, leaf int, parts int, blocks int"))  # noqa: B023, E731
        number = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        split = lambda c, n: F.pmod(F.xxhash64(c, F.lit(1)), F.col(n)).cast("int")
        there = dealt.select("vec_id", "dim", "v", "leaf").join(plan(), ["dim", "leaf"]).withColumn("part", split("vec_id", "parts")).withColumn("block", number("blocks"))
        going = asks.join(plan(), ["dim", "leaf"]).withColumn("block", split("qid", "blocks")).withColumn("part", number("parts"))
        by = ("dim", "leaf", "part", "block")
        found = there.groupBy(*by).cogroup(going.groupBy(*by)).applyInArrow(meet, f"qid long, found {HITS}")
        new = found.groupBy("qid").agg(F.flatten(F.collect_list("found")).alias("found"))
        hits = F.slice(F.array_sort(F.concat("hits", F.coalesce("found", F.array().cast(HITS)))), 1, k)
        joined = state.join(new, "qid", "left").withColumn("hits", hits).drop("found")
        kth = F.bitwise_not(F.element_at("hits", F.lit(k))["n"]).cast("double")
        last = (state, asks)
        state = staged(joined.withColumn("least", F.when(F.size("hits") == k, kth).otherwise(F.col("least"))), "queries")
        dropped(*last)
        begin, width = begin + width, 2 * width
    told = state.select(F.col("vec_id").alias("query_id"), F.explode("hits").alias("hit")).select("query_id", F.col("hit.id").alias("vec_id"), F.bitwise_not("hit.n").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return told.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same by plain comparison of all pairs.
SQL = """
WITH parts AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM numbered WHERE rank <= 20
"""
