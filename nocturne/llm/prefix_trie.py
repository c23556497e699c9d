"""The trie of conversations' prefixes: who shares a prefix, and sums over subtrees by parallel tree contraction."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Batches, dropped, in_python, numbered, staged

#: Conversations c to c + GROUP - 1 share first turns, MOST - 1 at most.
GROUP, MOST = 5, 9
#: Turns of a conversation whose running hashes one task holds, as a power of two.
CHUNK_BITS = 12
#: Ids that one row lists at most, as a power of two.
LIST_BITS = 12
#: A node: how deep, and 128 bits that its turns give.
NODE = ("depth", "a", "b")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, sha (of the text) and bytes (of the text) of every turn with a conv_id.

    Turns are in order of turn, null first; of equal numbers in order of role and then of the text's SHA-256. A null role or
    text is empty. Texts don't move, and a conversation may be longer than a task can hold.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("tie"),
    )
    told = staged(told, "turns")
    found = numbered(told, ["conv_id"], ["turn", "role", "sha", "tie"], "place").drop("turn", "tie")
    dropped(told)
    return found


def rebuilt(turns: DataFrame, group: int = GROUP, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Conversations that take their first turns from another one: (conv_id, n), how long each is, and (conv_id, at, role, sha, bytes), at from 1.

    Conversation c gets the first h turns of c - c % group (fewer if it has fewer, none if there is none), then its own turns after its
    first h; h is the crc32 of the decimal c modulo most. The remainder of a negative c is negative, as in SQL.
    """
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    convs = staged(convs, "convs")
    lent = turns.where((F.col("place") < most - 1) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    size = lent.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    told = convs.join(size, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    told = staged(told.select("conv_id", "h", "base", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "lengths")
    own = turns.join(told, "conv_id").where("place >= h").withColumn("at", F.col("place") - F.col("h") + F.col("taken") + 1)
    first = lent.join(told.where("h > 0").select("conv_id", "h", "base"), "base").where("place < h").withColumn("at", F.col("place") + 1)
    names = ("conv_id", "at", "role", "sha", "bytes")
    return told.select("conv_id", "n"), own.select(*names).union(first.select(*names))


def with_prefixes(sequences: DataFrame) -> DataFrame:
    """sequences (conv_id, at, role, sha, bytes) as conv_id, depth, a, b, up_a, up_b, bytes: what the first `depth` turns give, and those before them.

    Each turn gives two 64-bit hashes of its role, its text's SHA-256 and its place, from two seeds; a prefix has the exclusive or of
    its turns'. So what a stretch of turns does can be told by itself: a long conversation is summed up in chunks, and carried over them. Among
    10^10 different prefixes the chance that any two agree in 128 bits is about 10^-19.
    """
    own = lambda seed: F.xxhash64(F.lit(seed), "at", "role", "sha")
    slim = sequences.select("conv_id", "at", own(1).alias("x"), own(2).alias("y"), "bytes", F.shiftright(F.col("at") - 1, CHUNK_BITS).alias("chunk"))
    slim = staged(slim, "sequences")
    sums = slim.groupBy("conv_id", "chunk").agg(F.bit_xor("x").alias("cx"), F.bit_xor("y").alias("cy"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv_id", "chunk", F.bit_xor("cx").over(before).alias("cx"), F.bit_xor("cy").over(before).alias("cy")).where("chunk > 0")
    now = Window.partitionBy("conv_id", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = slim.join(carried, ["conv_id", "chunk"], "left")
    a = F.bit_xor("x").over(now).bitwiseXOR(F.coalesce("cx", F.lit(0)))
    b = F.bit_xor("y").over(now).bitwiseXOR(F.coalesce("cy", F.lit(0)))
    run = run.select("conv_id", F.col("at").alias("depth"), a.alias("a"), b.alias("b"), "x", "y", "bytes")
    return run.select("conv_id", *NODE, F.col("a").bitwiseXOR(F.col("x")).alias("up_a"), F.col("b").bitwiseXOR(F.col("y")).alias("up_b"), "bytes")


def subtree_totals(nodes: DataFrame, weights: Sequence[str]) -> DataFrame:
    """id and, for each of weights, its sum over the node's subtree, from nodes: id, up (the parent's id, null at a root), depth and weights.

    Parallel tree contraction. In each round of joins all leaves are raked: their sums are known, and go to their parents. Then unary
    chains are compressed: a node with one child left is taken out between its parent and that child, where a bit of
    its depth is set and the child's is not, so no two neighbours go at once; the bit changes from round to round, which halves
    chains of any length, and is turned round after each run through all bits. What is taken out says which child it had. When only roots are left,
    the rounds are gone through backwards, and each node gets its own sum and that of the child it had. Every round has at least
    its leaves to rake, so it ends; each round's tables are written, and rows only ever meet by unique ids or are summed by parent.
    """
    bits = max(1, int(nodes.agg(F.max("depth")).first()[0] or 0).bit_length())
    edges = [f"edge_{w}" for w in weights]  # what was taken out between a node and its parent
    kids = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    first = nodes.select("id", "up", "depth", *weights, *(F.lit(0).cast("long").alias(e) for e in edges)).join(kids, "id", "left")
    alive = staged(first.withColumn("kids", F.coalesce("kids", F.lit(0))), "alive")
    gone: list[tuple[DataFrame, DataFrame]] = []
    done = lambda rows: rows.where("kids = 0").select("id", *weights)
    while not (inner := alive.where("kids > 0")).isEmpty():
        turn = len(gone)
        coin = lambda depth: F.shiftright(depth, turn % bits).bitwiseAND(F.lit(1)) != (turn // bits) % 2  # noqa: B023, E731
        leaf = F.col("kids") == 0
        met = alive.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(
            *(F.sum(F.when(leaf, F.col(w) + F.col(e)).otherwise(0)).alias(f"from_{w}") for w, e in zip(weights, edges, strict=True)),
            F.sum((~leaf).cast("long")).alias("left"),
            F.min(F.when(~leaf, F.struct("depth", "id", *edges))).alias("one"),
        )
        out = F.coalesce(F.col("up").isNotNull() & (F.col("left") == 1) & coin(F.col("depth")) & ~coin(F.col("one.depth")), F.lit(False))
        raked = inner.join(met, "id").withColumn("out", out)
        # the sum of one that is taken out holds what lies between it and the child it had
        sums = [(F.col(w) + F.col(f"from_{w}") + F.when(F.col("out"), F.col(f"one.{e}")).otherwise(0)).alias(w) for w, e in zip(weights, edges, strict=True)]
        raked = staged(raked.select("id", "up", "depth", *sums, *edges, F.col("left").alias("kids"), F.col("one.id").alias("child"), "out"), "raked")
        moved = raked.where("out").select(F.col("child").alias("id"), F.col("up").alias("new_up"), *((F.col(w) + F.col(e)).alias(f"new_{e}") for w, e in zip(weights, edges, strict=True)))
        stay = raked.where("NOT out").join(moved, "id", "left").withColumn("up", F.coalesce("new_up", "up"))
        gone.append((alive, raked))
        alive = staged(stay.select("id", "up", "depth", *weights, *(F.coalesce(f"new_{e}", e).alias(e) for e in edges), "kids"), "alive")
    known, written = done(alive), []
    for was, raked in reversed(gone):
        compressed = raked.where("out")
        if not compressed.isEmpty():
            later = known.select(F.col("id").alias("child"), *(F.col(w).alias(f"from_{w}") for w in weights))
            again = compressed.join(later, "child").select("id", *((F.col(w) + F.col(f"from_{w}")).alias(w) for w in weights))
            written.append(staged(again, "expanded"))
            known = known.union(written[-1])
        known = known.union(done(was))
    totals = staged(known, "totals")
    dropped(alive, *written, *(t for pair in gone for t in pair))
    return totals


def hashed_lists(members: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """keys and `name`: the SHA-256 of the distinct whole numbers `value` of each key, ascending, decimal, comma between them.

    Numbers near each other are listed by a row, 2 ** LIST_BITS of them at most; the rows of a key come in order and are hashed one after the
    other, so a task holds a row and not a key's list.
    """
    bucket = F.shiftright(value, LIST_BITS).alias("bucket")
    text = F.array_join(F.transform(F.array_sort(F.collect_set(value)), lambda x: x.cast("string")), ",")
    parts = members.groupBy(*keys, bucket).agg(text.alias("part"))
    kinds = {f.name: f.dataType.simpleString() for f in members.schema.fields}

    def run(batches: Batches) -> Batches:
        now, so_far = None, sha256()
        for batch in batches:
            done: list[tuple] = []
            for key, part in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if key == now:
                    so_far.update(b"," + part.encode())
                    continue
                if now is not None:
                    done.append((*now, so_far.hexdigest()))
                now, so_far = key, sha256(part.encode())
            if done:
                yield as_batch(done)
        if now is not None:
            yield as_batch([(*now, so_far.hexdigest())])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        *key, digests = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(np.array(c, np.int64)) for c in key), pa.array(digests)], names=[*keys, name])

    dealt = parts.repartition(*keys).sortWithinPartitions(*keys, "bucket").select(*keys, "part")
    return in_python(dealt, run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{name} string"]))


def prefix_trie(lengths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences of lengths (conv_id, n) with prefixes from with_prefixes(): conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    n_leaves counts childless nodes of the subtree, saved_tokens sums (n_convs - 1) * bytes of the last text over it, ends_sha256 hashes
    the ids of the members that end there. The root is there unless there is no sequence at all.
    """
    zero = F.lit(0).cast("long")
    node = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, NODE, strict=True)))
    grouped = prefixes.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.max("bytes").alias("bytes"))
    below = grouped.select(node(*map(F.col, NODE)).alias("id"), node(F.col("depth") - 1, F.col("up_a"), F.col("up_b")).alias("up"), "depth", "conv_id", "n_convs", "bytes")
    root = lengths.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    top = root.select(node(zero, zero, zero).alias("id"), F.lit(None).cast(below.schema["up"].dataType).alias("up"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("bytes"))
    nodes = staged(below.unionByName(top).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")
    children = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    alone = nodes
    nodes = staged(nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    dropped(alone)
    totals = subtree_totals(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")), ["leaves", "saved"])
    over = nodes.where("n_children > 0").select(F.col("id").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    found = staged(nodes.drop("saved").join(over, "up", "left"), "parents")
    ends = prefixes.join(lengths.withColumnRenamed("n", "depth"), ["conv_id", "depth"]).select("conv_id", *NODE)
    ends = ends.union(lengths.where("n = 0").select("conv_id", zero, zero, zero))
    hashes = hashed_lists(ends, NODE, "conv_id", "ends_sha256").select(node(*map(F.col, NODE)).alias("id"), "ends_sha256")
    out = found.join(totals, "id").join(hashes, "id", "left")
    empty = F.lit(sha256().hexdigest())
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame, group: int = GROUP, most: int = MOST) -> DataFrame:
    """prefix_trie() of the rebuilt conversations.

    Rows without a conv_id take no part; a null role or text is empty; a null turn is the first; repeated rows are turns of their
    own, and turns of equal number are put in order by role and text hash. A conversation that ends up without turns is a member of the root.
    An empty table gives no rows. Other columns are ignored.
    """
    turns = turns_of(conversations)
    lengths, sequences = rebuilt(turns, group, most)
    found = with_prefixes(sequences)
    prefixes = staged(found, "prefixes")
    dropped(turns, found)
    return prefix_trie(lengths, prefixes)


def _crc_sql(value: str) -> str:
    step = "list_reduce(range(8), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(a, b))"
    return f"xor(list_reduce(list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(coalesce(role, '')), sha256(coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_crc_sql("conv_id")} % {MOST} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, t.role, t.text, 0 AS own, t.p FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL SELECT c.conv_id, t.role, t.text, 1, t.p FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS depth FROM r),
x AS (
  SELECT conv_id, depth, strlen(text) AS bytes, string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends, lag(prefix) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM x),
nodes AS (
  SELECT depth, prefix, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM ended GROUP BY depth, prefix),
kids AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up, depth),
full_nodes AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf
  FROM nodes n LEFT JOIN kids k ON k.up = n.prefix AND k.depth = n.depth),
totals AS (
  SELECT above.depth, above.prefix, sum(n.leaf) AS n_leaves, sum(n.saved) AS saved_tokens
  FROM full_nodes n JOIN x above ON above.conv_id = n.conv_id AND above.depth <= n.depth GROUP BY above.depth, above.prefix)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN totals t ON t.depth = n.depth AND t.prefix = n.prefix
LEFT JOIN full_nodes p ON p.depth = n.depth - 1 AND p.prefix = n.up
"""
