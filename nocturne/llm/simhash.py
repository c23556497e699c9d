"""SimHash near-duplicates: fingerprints, a binary trie self-join, and connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILE, PLACE, ROW, Batches, beside, dropped, in_cells, in_python, placed, staged

BITS = 64
SEED = 42
#: About so many fingerprints in a node of the trie make a task's share.
NODE_ROWS = 16384
#: Node pairs that are held at a time.
FRONTIER = 1 << 18


def fingerprint(text: str | None, shingle: int) -> int:
    """The majority bits of the hashes of a text's shingles.

    A-Z is lowered, words are runs of anything but ASCII white space, and shingles keep
    their repeats. With fewer words the whole sequence is one shingle; without any
    word the fingerprint is 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    if len(words) <= shingle:
        return _majority([xxhash.xxh64_intdigest(joined, SEED)])
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return _majority([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])])


def _majority(hashes: list[int]) -> int:
    rows = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(rows), 255):  # so many ones fit in a byte
        ones += np.unpackbits(rows[i : i + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(rows), bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, PLACE and fp (the fingerprint's bits as a long) for each of rows, which have PLACE."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(3).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps.view(np.int64))], names=["doc_id", *PLACE, "fp"])

    wanted = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *PLACE, F.col("text").cast("string").alias("text"))
    return in_python(wanted, run, f"doc_id long, {FILE} long, {ROW} long, fp long")


def trie_pairs(left: np.ndarray, right: np.ndarray | None, budget: int, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values that differ in at most budget bits, block by block.

    left and right are sorted distinct uint64; a node of their tries is a range of
    equal leading bits. Node pairs go down together from depth on (the bits before
    it count as well), the differing bits of the path add up, and a pair is
    dropped once they exceed the budget. Pairs of small nodes are settled by their
    values. right None: left with itself, each pair once.
    """
    own = right is None
    other = left if own else right
    if not len(left) or not len(other):
        return
    todo = [(np.array([[0, len(left), 0, len(other)]], np.int64), depth)]
    while todo:
        nodes, d = todo.pop()
        if len(nodes) > FRONTIER:
            half = len(nodes) // 2
            todo += [(nodes[half:], d), (nodes[:half], d)]
            continue
        small = ((nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2]) <= 64) | (d == BITS)
        if small.any():
            yield from _settled(left, other, nodes[small], budget, own)
            nodes = nodes[~small]
        if not len(nodes):
            continue
        bit = np.uint64(1 << (BITS - 1 - d))
        above = ~np.uint64((1 << (BITS - d)) - 1) if d else np.uint64(0)
        cut = lambda values, lo: np.searchsorted(values, (values[lo] & above) | bit)
        a, b, x, y = nodes.T
        m, n = cut(left, a), cut(other, x)
        same = (a == x) & (b == y) & own
        parts = [np.stack(p, 1) for p in ((a, m, x, n), (m, b, n, y), (a, m, n, y))] + [np.stack((m, b, x, n), 1)[~same]]
        below = np.concatenate(parts)
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3])]
        seen = ~np.uint64((1 << (BITS - 1 - d)) - 1) if d < BITS - 1 else ~np.uint64(0)
        apart = np.bitwise_count((left[below[:, 0]] ^ other[below[:, 2]]) & seen)
        below = below[apart <= budget]
        if len(below):
            todo.append((below, d + 1))


def _settled(left: np.ndarray, other: np.ndarray, nodes: np.ndarray, budget: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    wide, high = nodes[:, 1] - nodes[:, 0], nodes[:, 3] - nodes[:, 2]
    before = np.concatenate([[0], np.cumsum(wide * high)])
    k = 0
    while k < len(nodes):
        e = max(k + 1, int(np.searchsorted(before, before[k] + (1 << 22), side="right")) - 1)
        of = np.repeat(np.arange(k, e), (wide * high)[k:e])
        at = np.arange(before[k], before[e]) - before[of]
        i, j = nodes[of, 0] + at // high[of], nodes[of, 2] + at % high[of]
        near = np.bitwise_count(left[i] ^ other[j]) <= budget
        if own:
            near &= i < j
        yield i[near], j[near]
        k = e


def _joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index of each index's component."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    return root


def _turned(values: np.ndarray, by: int) -> np.ndarray:
    """The bits of values, the first `by` of them behind the others."""
    return values if by % BITS == 0 else (values << np.uint64(by % BITS)) | (values >> np.uint64(BITS - by % BITS))


def trie_edges(fps: DataFrame, budget: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges (a, b), a < b as unsigned bits' longs, that connect what links of at most budget bits connect.

    fps has distinct fp. Bits are cut into budget + 1 blocks; two values within the budget agree on one of
    them whole. So each block gives a trie, of values turned until it comes first, and every value
    goes into each: a task has one node of a trie as deep as about node_rows values need (a block at most), and joins it with itself
    from there on. A node with more than node_rows values is cut into parts by hash, and every two
    parts meet; so shares stay bounded however many fingerprints crowd together. A share returns a star
    for each of its components, at most as many edges as values.
    """
    n = fps.count()
    block = BITS // (budget + 1)
    deep = min(block, max(1, math.ceil(math.log2(max(1, n) / node_rows)) + 1)) if n else 1
    tries = [F.shiftleft(F.lit(i).cast("long"), 40) + F.shiftrightunsigned(_turned_column("fp", i * block), BITS - deep) for i in range(budget + 1)]
    nodes = fps.select("fp", F.explode(F.array(*tries)).alias("node"))
    dealt = in_cells(nodes, "node", ["fp"], node_rows)
    if "cell" not in dealt.columns:
        dealt = dealt.withColumns({"cell": F.lit(0).cast("long"), "part": F.lit(0)})

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        by = (key[0].as_py() >> 40) * block
        fp, part = _turned(rows.column("fp").to_numpy().view(np.uint64), by), rows.column("part").to_numpy()
        cell = key[1].as_py()
        if cell >> 31 == cell & 0x7FFFFFFF:
            values = np.sort(fp)
            root = _joined(len(values), trie_pairs(values, None, budget, deep))
        else:
            first = part == cell >> 31
            a, b = np.sort(fp[first]), np.sort(fp[~first])
            values = np.concatenate([a, b])
            root = _joined(len(values), ((i, j + len(a)) for i, j in trie_pairs(a, b, budget, deep)))
        linked = root != np.arange(len(root))
        values = _turned(values, BITS - by)
        return pa.table({"a": values[root[linked]].view(np.int64), "b": values[linked].view(np.int64)})

    return dealt.groupBy("node", "cell").applyInArrow(meet, "a long, b long").distinct()


def _turned_column(name: str, by: int) -> Column:
    return F.col(name) if by % BITS == 0 else F.shiftleft(name, by % BITS).bitwiseOR(F.shiftrightunsigned(name, BITS - by % BITS))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node) of every node in edges (a, b).

    Large-star and small-star steps by turns: each node's neighbours are tied to the smallest
    node among them, until nothing changes. Only sums go to the driver; every step is
    written to the shared folder. What is joined to a node's neighbours is written before, so Spark can split a node with very many.
    """
    edges = staged(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi"), "edges")
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
    was = state(edges)
    while was[0]:
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = staged(both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct(), "large")
        down = staged(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")), "down")
        small = large.select(F.col("hi").alias("u"), F.col("lo").alias("v")).join(down, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi")
        then = staged(small.union(down.select(F.col("m").alias("lo"), F.col("u").alias("hi"))).distinct(), "edges")
        dropped(edges, least, large, down)
        edges, now = then, state(then)
        if now == was:
            break
        was = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def grouped(rows: DataFrame, shingle: int, budget: int) -> DataFrame:
    """Of rows with PLACE: doc_id, PLACE, fp and root, the same for all documents that links connect."""
    own = staged(fingerprints(rows, shingle), "fingerprints")
    distinct = staged(own.select("fp").distinct(), "fps")
    linked = components(trie_edges(distinct, budget))
    # written before the join, so that Spark can split a fingerprint with very many copies
    roots = staged(distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    return own.join(roots, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 5, budget: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach.

    Texts whose fingerprints differ in at most budget bits are linked. Copies share a fingerprint,
    which takes part once, so a group of copies of any size costs one row in the join.

    Null and empty texts have fingerprint 0 and are linked like any other. A null doc_id
    is kept; its component_id is the smallest id that is not null, or null if there is
    none. Equal rows are each returned. An empty table gives no rows; columns other
    than doc_id and text are ignored.
    """
    found = staged(grouped(placed(docs), shingle, budget).drop(*PLACE), "groups")
    smallest = staged(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    return found.join(smallest, "root").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int = 5, budget: int = 2) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id, a null one before all others; of rows with the same id the first in its file.

    Null and empty texts are one group. An empty table gives none. Texts don't move: which rows stay is told to where they are read.
    """
    first = F.min(F.struct("doc_id", *PLACE)).alias("first")
    kept, names = "_nocturne_kept", docs.columns
    rows = placed(docs)
    found = grouped(rows, shingle, budget).groupBy("root").agg(first).select("first.*").select(*PLACE, F.lit(True).alias(kept))

    def stay(batches: Batches) -> Batches:
        for batch in batches:
            yield batch.filter(pc.is_valid(batch.column(kept))).select(names)

    return beside(rows, found, stay, rows.select(names).schema)
