"""The Merkle manifest against trees built plainly, its layout, and odd rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nocturne.llm import merkle, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Levels of a tree, from the leaves to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def up(levels, i):
    for nodes in levels[:-1]:
        run = i // 16 * 16
        yield "".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])
        i //= 16


def plainly(rows):
    low = str.maketrans(merkle.UPPER, merkle.LOWER)
    by = {}
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
        by.setdefault(r[3], []).append((r[0], leaf_of(*r), leaf_of(r[0], r[1].translate(low), *r[2:]) if tampered else leaf_of(*r)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in order}
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (doc_id, leaf, now) in enumerate(sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            path = [*up(trees[s], i), *up(top, k)]
            for a, b in path:
                now = H(a + now + b)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], H("".join(a + b for a, b in path)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def odd(n, sources, seed=3):
    draw = random.Random(seed)
    rows = [(draw.randint(-5 * n, 5 * n), f"Text {i} ÄB", draw.choice(["en", None]), draw.choice(sources), i) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "A null id", "en", "é", 1), (7, None, "en", None, 3), (8, "", None, "", 0), (9, "X" * 100_000, "en", "z", 1)]
    return rows + rows[:3] + [(rows[0][0], "same id", "en", rows[0][3], 5)]


@pytest.mark.parametrize(("n", "sources", "height"), [(30, ["a", None, "Z", "é", "\U0001f600"], 1), (700, ["hot"] * 9 + ["b"], 1), (700, ["hot"] * 9 + ["b"], 2), (400, [f"s{i}" for i in range(300)], 1), (60, ["a"], 3)])
def test_against_trees_built_plainly(spark, n, sources, height):
    rows = odd(n, sources)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit(1), "place": F.lit(2), "named": F.lit(3), "other": F.lit("x"), "block": F.lit(4), "root": F.lit("r")})
    got = [tuple(r) for r in merkle.audit(docs.repartition(5), height=height).collect()]
    assert sorted(got, key=repr) == plainly(rows)


def test_query_and_its_sql_against_trees_built_plainly(spark):
    want = plainly([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    assert sorted(map(tuple, queries.op11_merkle(spark, SF).collect()), key=repr) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.sql(merkle.SQL).fetchall(), key=repr) == want


def test_sql_on_odd_rows():
    rows = odd(700, ["hot"] * 9 + [None, "é", "\U0001f600"])
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.sql(merkle.SQL).fetchall(), key=repr) == plainly(rows)


def test_empty_table_and_a_lone_row(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.audit(none).count() == 0
    one = [(3, "Only", None, None, 4)]
    assert [tuple(r) for r in merkle.audit(spark.createDataFrame(one, SCHEMA)).collect()] == plainly(one)


@pytest.mark.parametrize("levels", range(1, 6))
def test_places_fill_a_block_once_and_small_subtrees_lie_together(levels):
    every = [merkle.address(levels, d, np.arange(16**d)) for d in range(levels)]
    assert sorted(np.concatenate(every).tolist()) == list(range(merkle.tree_size(levels)))
    if levels > 2:
        # the subtrees below half of the levels are runs of places, one after the other
        top = levels // 2
        for i in range(16**top):
            below = np.concatenate([every[d][i * 16 ** (d - top) : (i + 1) * 16 ** (d - top)] for d in range(top, levels)])
            start = merkle.tree_size(top) + i * merkle.tree_size(levels - top)
            assert sorted(below.tolist()) == list(range(start, start + merkle.tree_size(levels - top)))


def test_blocks_are_stored_without_what_lies_behind_the_last_node():
    leaves = np.random.default_rng(1).integers(0, 256, (20, 32), np.uint8)
    nodes = merkle.built(leaves, 4)
    assert len(nodes) == 17 + 17 + 1 + 4
    assert nodes[0].tobytes().hex() == climb_fixed([x.tobytes().hex() for x in leaves], 3)


def climb_fixed(nodes, times):
    for _ in range(times):
        nodes = [H("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0]
