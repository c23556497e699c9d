"""A Merkle manifest of a dataset: a tree per source over its rows, one over the sources, stored block by block.

A block is an aligned subtree with up to ARITY ** HEIGHT leaves, kept in van Emde Boas order: the upper half of its
levels first, then each subtree below, both laid out the same way again. Where a node lies follows from arithmetic,
for building and for finding siblings alike. The roots of blocks are the leaves of blocks above them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, dropped, in_python, numbered, staged

ARITY = 16
#: Levels below the root of a block: 4,096 leaves, about 140 KB of digests.
HEIGHT = 3
#: Which tree a block belongs to: whether it has a source, and which.
TREE = ["named", "source"]
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- the layout of one block ---


def tree_size(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes of a depth (0: the root) with these numbers lie in a tree of so many levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    low, below = levels - top, ARITY ** (depth - top)
    return tree_size(top) + index // below * tree_size(low) + address(low, depth - top, index % below)


def counts(levels: int, leaves: int) -> list[int]:
    """How many nodes each depth has."""
    out = [leaves]
    for _ in range(levels - 1):
        out.append(-(-out[-1] // ARITY))
    return out[::-1]


def levels_of(leaves: int, height: int) -> int:
    """The levels of a block in a tree with so many leaves: as few as hold them, or height + 1."""
    levels = 1
    while levels <= height and ARITY ** (levels - 1) < leaves:
        levels += 1
    return levels


def digest(text: str | bytes) -> bytes:
    return sha256(text if isinstance(text, bytes) else text.encode()).digest()


def built(leaves: np.ndarray, levels: int) -> np.ndarray:
    """The nodes (rows of 32 bytes) of a block over leaves, in their places; unused places behind the last node are cut."""
    have = counts(levels, len(leaves))
    places = [address(levels, d, np.arange(n)) for d, n in enumerate(have)]
    nodes = np.zeros((max(int(p[-1]) for p in places) + 1, 32), np.uint8)
    nodes[places[-1]] = leaves
    for d in range(levels - 2, -1, -1):
        children = nodes[places[d + 1]]
        parents = b"".join(digest(children[i * ARITY : (i + 1) * ARITY].tobytes().hex()) for i in range(have[d]))
        nodes[places[d]] = np.frombuffer(parents, np.uint8).reshape(-1, 32)
    return nodes


def siblings(nodes: np.ndarray, levels: int, leaves: int) -> list[list[tuple[str, str]]]:
    """For each depth from the leaves up to the root's children, and each node there, the digests in its run before and after it."""
    out = []
    for d in range(levels - 1, 0, -1):
        hexes = [x.tobytes().hex() for x in nodes[address(levels, d, np.arange(counts(levels, leaves)[d]))]]
        runs = ["".join(hexes[i : i + ARITY]) for i in range(0, len(hexes), ARITY)]
        out.append([(runs[i // ARITY][: 64 * (i % ARITY)], runs[i // ARITY][64 * (i % ARITY + 1) :]) for i in range(len(hexes))])
    return out


# --- the trees, block by block ---


@dataclass
class Manifest:
    """What is stored: blocks (TREE, block, n, root, nodes) of each level of the sources' trees, the lowest ones with the rows' ids;
    of the tree over the sources likewise; and the root of all (None without rows)."""

    levels: list[DataFrame] = field(default_factory=list)
    tops: list[DataFrame] = field(default_factory=list)
    sources: DataFrame | None = None
    root: str | None = None


def _blocks(leaves: DataFrame, extra: Sequence[str], height: int) -> DataFrame:
    """A row per block, from leaves (TREE, block, place, n, digest and extra): TREE, block, n, root, nodes and lists of extra, in the order of the leaves.

    n is the number of leaves in the whole tree. A block has ARITY ** height leaves at most, however large its tree is.
    """
    of = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        n = rows.column("n")[0].as_py()
        nodes = built(np.frombuffer(b"".join(rows.column("digest").to_pylist()), np.uint8).reshape(-1, 32), levels_of(n, height))
        one = {c: rows.column(c).slice(0, 1) for c in (*TREE, "block", "n")}
        lists = {c: pa.array([rows.column(c).to_pylist()], pa.list_(rows.schema.field(c).type)) for c in extra}
        return pa.table(one | {"root": pa.array([nodes[0].tobytes()], pa.binary()), "nodes": pa.array([nodes.tobytes()], pa.binary())} | lists)

    schema = f"named int, source string, block long, n long, root binary, nodes binary{''.join(f', {c} array<{of[c]}>' for c in extra)}"
    return leaves.groupBy(*TREE, "block").applyInArrow(build, schema)


def _grown(leaves: DataFrame, extra: Sequence[str], height: int) -> list[DataFrame]:
    """The levels of blocks over leaves (TREE, place, digest, extra), each written, from the lowest to the one where every tree has a single block."""
    wide = ARITY**height
    in_blocks = leaves.withColumn("block", F.floor(F.col("place") / wide))
    # the size of a tree comes to its leaves block by block, so a source is never dealt out as a whole
    ends = in_blocks.groupBy(*TREE, "block").agg(F.max("place").alias("end"))
    sizes = ends.join(ends.groupBy(*TREE).agg((F.max("end") + 1).alias("n")), TREE).drop("end")
    levels = [staged(_blocks(in_blocks.join(sizes, [*TREE, "block"]), extra, height), "blocks")]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > wide:
        roots = levels[-1].where(F.col("n") > wide).select(*TREE, F.col("block").alias("place"), F.ceil(F.col("n") / wide).cast("long").alias("n"), F.col("root").alias("digest"))
        levels.append(staged(_blocks(roots.withColumn("block", F.floor(F.col("place") / wide)), [], height), "blocks"))
    return levels


def manifest(leaves: DataFrame, height: int = HEIGHT) -> Manifest:
    """The trees over leaves: source, doc_id, digest (32 bytes) and any other columns, which are kept beside the digests.

    In a source, leaves ascend by doc_id (null first), then by digest; every ARITY nodes in a row become one, level by level, until one is left.
    Sources, null first, then by their bytes, are the leaves of the last tree. No task holds a source: places come from ranges,
    and a task builds one block.
    """
    extra = [c for c in leaves.columns if c not in ("source", "digest")]
    told = leaves.select(F.col("source").isNotNull().cast("int").alias("named"), F.coalesce("source", F.lit("")).alias("source"), "digest", *extra, F.monotonically_increasing_id().alias("tie"))
    told = staged(told, "leaves")
    placed = numbered(told, TREE, ["doc_id", "digest", "tie"], "place").drop("tie")
    levels = _grown(placed, extra, height)
    dropped(told, placed)
    done = F.col("n") <= ARITY**height
    roots = [b.where(done).select(*TREE, F.lit(i).alias("level"), F.col("root").alias("digest")) for i, b in enumerate(levels)]
    for more in roots[1:]:
        roots[0] = roots[0].union(more)
    sources = numbered(roots[0], [], TREE, "place")
    # the tree over sources has a name that no source can have: named is 2
    over = sources.select(F.lit(2).alias("named"), F.lit("").alias("source"), "place", "digest")
    tops = _grown(over, [], height)
    root = tops[-1].select("root").first()
    return Manifest(levels, tops, sources, root and bytes(root[0]).hex())


#: Siblings from a block's root up to the root of all, one string a level.
PATH = "lefts array<string>, rights array<string>"


def _paths_below(blocks: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """TREE, place and PATH of the leaves of blocks, whose own paths are in paths (TREE, block, PATH)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                levels, leaves, nodes = _shape(row, height)
                near = siblings(nodes, levels, leaves)
                for at in range(0, leaves, 256):
                    these = range(at, min(leaves, at + 256))
                    up = [[near[k][i // ARITY**k] for k in range(levels - 1)] for i in these]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "named": pa.array([row["named"]] * len(these), pa.int32()),
                            "source": pa.array([row["source"]] * len(these), pa.string()),
                            "place": pa.array([(row["block"] * ARITY**height) + i for i in these], pa.int64()),
                            "lefts": pa.array([[x for x, _ in u] + row["lefts"] for u in up], pa.list_(pa.string())),
                            "rights": pa.array([[x for _, x in u] + row["rights"] for u in up], pa.list_(pa.string())),
                        }
                    )

    met = blocks.select(*TREE, "block", "n", "nodes").join(paths, [*TREE, "block"])
    return in_python(met, run, f"named int, source string, place long, {PATH}")


def _shape(row: dict, height: int) -> tuple[int, int, np.ndarray]:
    """Levels, leaves and nodes of a block."""
    wide = ARITY**height
    return levels_of(row["n"], height), min(wide, row["n"] - row["block"] * wide), np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32)


def _downwards(levels: list[DataFrame], paths: DataFrame, height: int) -> DataFrame:
    """The paths of all blocks of the lowest level, from those of the trees' roots: TREE, level (the one whose only block has the root) and PATH."""
    found = None
    for i in range(len(levels) - 1, -1, -1):
        own = paths.where(F.col("level") == i).select(*TREE, F.lit(0).cast("long").alias("block"), "lefts", "rights")
        found = own if found is None else own.union(_paths_below(levels[i + 1], found, height).withColumnRenamed("place", "block"))
        found = staged(found, "paths") if i else found
    return found


def proofs(made: Manifest, height: int = HEIGHT) -> DataFrame:
    """For each leaf: doc_id, leaf, subroot, root, proof_sha256 (of the siblings up to the root, left to right, level by level) and
    folded_root, the root that follows from those siblings and the leaf, or from `other` in its place where a row has one. Digests are hex.

    Blocks get the siblings above them from the blocks there; a task holds one block.
    """
    top = made.tops[-1].select(*TREE, F.lit(len(made.tops) - 1).alias("level"))
    none = F.array().cast("array<string>")
    over = _downwards(made.tops, top.withColumns({"lefts": none, "rights": none}), height)
    of_source = _paths_below(made.tops[0], over, height).select("place", "lefts", "rights")
    sources = staged(made.sources.join(of_source, "place").select(*TREE, "level", F.hex("digest").alias("subroot"), "lefts", "rights"), "sources")
    paths = _downwards(made.levels, sources.drop("subroot"), height).join(sources.select(*TREE, F.lower("subroot").alias("subroot")), TREE)
    root = made.root or ""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                levels, leaves, nodes = _shape(row, height)
                near = siblings(nodes, levels, leaves)
                above = list(zip(row["lefts"], row["rights"], strict=True))
                # for each node above the leaves, all that a proof has from there on
                rest = [b"".join((a + b).encode() for a, b in above)]
                for k in range(levels - 2, 0, -1):
                    rest = [(a + b).encode() + rest[i // ARITY] for i, (a, b) in enumerate(near[k])]
                own = nodes[address(levels, levels - 1, np.arange(leaves))]
                others = row["other"] or [None] * leaves
                columns: list[list] = [[], [], []]
                for i in range(leaves):
                    a, b = near[0][i] if near else ("", "")
                    now = (others[i] or own[i].tobytes()).hex()
                    for x, y in [*(near[k][i // ARITY**k] for k in range(levels - 1)), *above]:
                        now = sha256((x + now + y).encode()).hexdigest()
                    columns[0].append(own[i].tobytes().hex())
                    columns[1].append(sha256((a + b).encode() + rest[i // ARITY if levels > 1 else 0]).hexdigest())
                    columns[2].append(now)
                same = lambda text: pa.array([text] * leaves, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(columns[0]), same(row["subroot"]), same(root), pa.array(columns[1]), pa.array(columns[2])], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    lists = made.levels[0].select(*TREE, "block", "n", "nodes", "doc_id", "other")
    return in_python(lists.join(paths, [*TREE, "block"]), run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


# --- documents as leaves ---


def encoding(columns: Sequence[Column]) -> Column:
    """One text of several values that no other values give: `-` for a null, else the number of UTF-8 bytes, a colon and the value."""
    return F.concat(*(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns))


def document_leaves(docs: DataFrame, columns: Sequence[str] = COLUMNS, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """doc_id, source, digest of the columns, and `other`: the digest with the values of `changed` in their place, where that holds, else null."""
    hashed = lambda values: F.unhex(F.sha2(encoding(values).cast("binary"), 256))
    other = F.lit(None).cast("binary")
    if changed:
        other = F.when(where, hashed([changed.get(c, F.col(c)) for c in columns]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), hashed([F.col(c) for c in columns]).alias("digest"), other.alias("other"))


def audit(docs: DataFrame, every: int = 5, height: int = HEIGHT) -> DataFrame:
    """proofs() of the documents' tree, with verified: whether the folded root is the root, where texts are tampered with in one of `every` documents.

    Tampered: documents whose crc32 of the decimal doc_id is divisible by `every` come with the A-Z of their text lowered;
    a null text stays null, a null doc_id is never tampered with. A null source is a source of its own, the first. Null doc_ids come first in
    their source. Rows that share a doc_id are leaves of their own, by digest. An empty table gives no rows. Other columns are ignored.
    """
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    leaves = document_leaves(docs, changed={"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)}, where=picked)
    return proofs(manifest(leaves, height), height).withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, leaves: str, group: str, depth: int) -> str:
    """CTEs of a tree over leaves (group, i, h): {name}{k} has the nodes of level k, {name}_runs{k} the runs of level k, up to depth levels."""
    parts = [f"{name}0 AS (SELECT {group} AS g, i, h FROM {leaves})"]
    for k in range(depth):
        parts.append(f"{name}_runs{k} AS (SELECT g, i // {ARITY} AS i, list(h ORDER BY i) AS hs, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}) GROUP BY g, i // {ARITY})")
        parts.append(f"{name}{k + 1} AS (SELECT g, i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}_runs{k})")
    return ", ".join(parts)


def _fold_sql(name: str, rows: str, tree: str, depth: int) -> str:
    """CTEs that take rows (g, i, now, proof and others) up a tree: now is folded, proof gets the siblings' digests."""
    parts = [f"{name}0 AS ({rows})"]
    for k in range(depth):
        a, b = f"array_to_string(r.hs[1 : t.i // {ARITY**k} % {ARITY}], '')", f"array_to_string(r.hs[t.i // {ARITY**k} % {ARITY} + 2 :], '')"
        parts.append(
            f"{name}{k + 1} AS (SELECT t.* REPLACE (CASE WHEN r.n = 1 THEN t.now ELSE sha256({a} || t.now || {b}) END AS now, CASE WHEN r.n = 1 THEN t.proof ELSE t.proof || {a} || {b} END AS proof)"
            f" FROM {name}{k} t JOIN {tree}_runs{k} r ON r.g = t.g AND r.i = t.i // {ARITY ** (k + 1)})"
        )
    return ", ".join(parts)


def _sql() -> str:
    """Trees of up to ARITY ** 5 documents a source and ARITY ** 4 sources."""
    deep, wide = 5, 4
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in COLUMNS) + ")"
    bits = "list_reduce(range(8), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(a, b))"
    crc = f"xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    return (
        f"WITH d AS (SELECT doc_id, coalesce('s' || source, '') AS g, {leaf('text')} AS h, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS other FROM documents),"
        " leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d), "
        f"{_tree_sql('a', 'leaves', 'g', deep)}, subroots AS (SELECT g AS source, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, 1 AS one FROM a{deep}), "
        f"{_tree_sql('b', 'subroots', 'one', wide)}, "
        f"{_fold_sql('f', 'SELECT g, i, doc_id, h AS leaf, other AS now, CAST($$$$ AS VARCHAR) AS proof FROM leaves', 'a', deep)}, "
        f"{_fold_sql('e', f'SELECT s.one AS g, s.i, f.doc_id, f.leaf, s.h AS subroot, f.now, f.proof FROM f{deep} f JOIN subroots s ON s.source = f.g', 'b', wide)}"
        f" SELECT doc_id, leaf, subroot, b{wide}.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = b{wide}.h AS verified FROM e{wide} JOIN b{wide} USING (g)"
    )


SQL = _sql()
