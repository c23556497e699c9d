"""The trie of conversations against one built plainly, and tree contraction on trees of several shapes."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from nocturne.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plainly(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3]))] for c, v in convs.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        full = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(full) + 1):
            n = nodes.setdefault(tuple(full[:d]), {"members": [], "ends": []})
            n["members"].append(c)
        nodes[tuple(full)]["ends"].append(c)
    out = []
    for key, n in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        leaf = [k for k in below if not any(o[:-1] == k for o in nodes if o)]
        saved = sum((len(nodes[k]["members"]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()
        parent = min(nodes[key[:-1]]["members"]) if key else None
        out.append((min(n["members"]), len(key), parent, len(n["members"]), sum(1 for o in nodes if o and o[:-1] == key), len(leaf), saved, ends))
    return sorted(out, key=repr)


def odd(seed, n=40):
    draw = random.Random(seed)
    rows = []
    for c in [*range(n), -7, -5, -3, 1003, 10**15]:
        shared = draw.random() < 0.5
        for turn in range(draw.choice([1, 2, 3, 12])):
            rows.append((c, turn, draw.choice(["user", None]) if not shared else "user", f"t{turn}" if shared else draw.choice(["é\U0001f600", "", None, "x"])))
    rows += [(50, None, None, None), (50, None, None, None), (50, 3, "a", "b"), (50, 3, "b", "a"), (50, 3, "a", "c"), (None, 1, "user", "no id"), (None, None, None, None)]
    return rows + [(51, i, "user", f"turn {i}") for i in range(70)] + [(52, i, "user", f"turn {i}") for i in range(66)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_trie_built_plainly(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    monkeypatch.setattr(prefix_trie, "LIST_BITS", 1)
    rows = odd(seed)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit(1), "id": F.lit(2), "place": F.lit(3), "a": F.lit("x"), "n": F.lit(0)})
    got = prefix_trie.conversation_trie(table.repartition(3))
    assert {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == plainly(rows)
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.sql(prefix_trie.SQL).fetchall(), key=repr) == plainly(rows)


def test_query_against_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert sorted(map(tuple, queries.op13_prefix_trie(spark, SF).collect()), key=repr) == sorted(con.sql(prefix_trie.SQL).fetchall(), key=repr)


def test_empty_table_and_conversations_without_turns(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # their turns are among the first h, and the conversations they take turns from aren't there
    lone = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1][:5]
    rows = [(c, 0, "user", "gone") for c in lone]
    assert sorted(map(tuple, prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == plainly(rows)


def shapes():
    draw = random.Random(5)
    yield "chain", [i - 1 for i in range(300)]
    yield "star", [-1] + [0] * 200
    yield "binary", [(i - 1) // 2 for i in range(255)]
    yield "caterpillar", [-1] + [i - (1 if i % 2 else 2) if i > 1 else 0 for i in range(1, 200)]
    yield "random", [-1] + [draw.randrange(max(0, i - 4), i) for i in range(1, 300)]
    yield "two roots", [-1, -1, 0, 1, 2, 3, 4, 5, 6, 7]


@pytest.mark.parametrize(("name", "up"), list(shapes()))
def test_contraction_sums_subtrees(spark, name, up):
    depth, total, leaves = [], [i + 1 for i in range(len(up))], [0 if i in up else 1 for i in range(len(up))]
    for i, p in enumerate(up):
        depth.append(0 if p < 0 else depth[p] + 1)
    for i in range(len(up) - 1, -1, -1):
        if up[i] >= 0:
            total[up[i]] += total[i]
            leaves[up[i]] += leaves[i]
    nodes = spark.createDataFrame([(i, p if p >= 0 else None, depth[i], i + 1, 0 if i in up else 1) for i, p in enumerate(up)], "id long, up long, depth long, w long, leaves long")
    got = {r["id"]: (r["w"], r["leaves"]) for r in prefix_trie.subtree_totals(nodes, ["w", "leaves"]).collect()}
    assert got == {i: (total[i], leaves[i]) for i in range(len(up))}
