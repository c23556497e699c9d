"""Overlaps of intervals against all pairs, recovery times and conditions."""

import random

import pytest

from nocturne.operators import diary


@pytest.mark.parametrize("bucket", [0.5, 7.0, 1000.0])
def test_overlaps_are_all_pairs_once(spark, bucket):
    draw = random.Random(3)

    def some(n):
        out = []
        for i in range(n):
            start = draw.choice([draw.uniform(-40, 40), float(draw.randint(-40, 40))])
            out.append((draw.choice(["a", "b"]), start, start + draw.choice([0.0, 0.3, 5.0, 30.0]), i))
        return out

    left, right = some(40), some(30)
    schema = "device_id string, start_ts double, end_ts double, id int"
    odd = [(None, 0.0, 9.0, 98), ("a", None, 1.0, 99), ("a", 5.0, 1.0, 97)]
    got = diary.overlapping(spark.createDataFrame(left + odd, schema), spark.createDataFrame(right + odd, schema), bucket_s=bucket).collect()
    want = [(x[3], y[3]) for x in left for y in right if x[0] == y[0] and min(x[2], y[2]) - max(x[1], y[1]) > 0]
    assert sorted((r["id"], r["other_id"]) for r in got) == sorted(want)
    assert all(r["overlap_s"] == pytest.approx(min(r["end_ts"], r["other_end_ts"]) - max(r["start_ts"], r["other_start_ts"])) for r in got)


def test_agreement_counts_both_sides(spark):
    schema = "device_id string, start_ts double, end_ts double"
    found = spark.createDataFrame([("a", 0.0, 10.0), ("a", 20.0, 30.0), ("b", 0.0, 1.0)], schema)
    entries = spark.createDataFrame([("a", 5.0, 25.0), ("a", 50.0, 60.0), ("c", 0.0, 1.0)], schema)
    got = {r["device_id"]: tuple(r)[1:] for r in diary.diary_agreement(found, entries).collect()}
    assert got == {"a": (2, 1, 2, 2, 10.0), "b": (0, 0, 1, 0, 0.0), "c": (1, 0, 0, 0, 0.0)}


def test_actions_clear(spark):
    rows = [("a", float(t), t, ["cool"] if 3 <= t <= 7 or t == 12 else ["heat"] if t == 5 else []) for t in range(15)]
    told = diary.action_episodes(spark.createDataFrame(rows, "device_id string, t double, seq int, actions array<string>"), ["cool", "dim_light"])
    assert sorted((r["action"], r["start_ts"], r["duration_s"]) for r in told.collect()) == [("cool", 3.0, 4.0), ("cool", 12.0, 0.0)]
    assert [tuple(r) for r in diary.recovery_times(told).collect()] == [("cool", 2, 2.0, 2.0, 4.0)]
