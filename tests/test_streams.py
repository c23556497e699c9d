"""Streams whose keys or flags are null in some rows."""

import random

import duckdb
import pandas as pd

from nocturne.plans.queries import FOUND
from nocturne.streaming import jobs, runs

SF = "/root/testdata/sf0.01"


def test_windows_of_a_null_key_take_no_other_devices(spark):
    us = [int(1e6) * 86400 + i * 100_000 for i in range(100)]
    rows = [(d, t / 1e6, float(t % 7)) for d in (1, 2, 2**60 + 1) for t in us] + [(None, us[-1] / 1e6 + 120.0, 0.0)]
    batch = runs._timed(spark.createDataFrame(rows, "device_id long, t double, value double"))
    folder = runs.new_folder(spark, "stream")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = runs.used_up(jobs.stream_windows(runs.source(batch, folder), size_s=3), folder).where("device_id IS NOT NULL").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    sizes = {d: [len(r["samples"]) for r in sorted(found, key=lambda r: r["window_end"]) if r["device_id"] == d] for d in (1, 2, 2**60 + 1)}
    assert all(n == [10, 20, *[30] * 8, 20, 10] for n in sizes.values()), sizes


def test_episodes_that_are_open_at_the_end_count(spark):
    query, sql = FOUND["st4_late_rows"]
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("events", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert sorted(map(tuple, query(spark, SF).collect())) == sorted(con.execute(sql).fetchall())


class Held:
    """State and timers of one key, which count how often they are asked."""

    def __init__(self):
        self.asked, self.kept, self.timers = 0, {}, set()

    def getListState(self, name, schema):
        return Part(self, name)

    getValueState = getListState

    def registerTimer(self, ms):
        self.asked += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.asked += 1
        self.timers.remove(ms)


class Part:
    def __init__(self, of, name):
        self.of, self.name = of, name

    def appendValue(self, value):
        self.put([*self.of.kept.get(self.name, []), value])

    def put(self, value):
        self.of.asked += 1
        self.of.kept[self.name] = value

    def get(self):
        self.of.asked += 1
        return self.of.kept.get(self.name, [] if self.name == "held" else None)

    def clear(self):
        self.of.asked += 1
        self.of.kept.pop(self.name, None)

    update = put


class Passed:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_windows_ask_state_a_few_times_a_micro_batch():
    """Whatever the number of windows and samples; late but on-time samples, a gap, and several windows due at a time."""
    held, windows, out, size = Held(), jobs._Windows(["device_id"], 12), [], 12
    windows.init(held)
    draw = random.Random(5)
    times = [100_000_000 + i * 20_000 for i in range(50 * 60)] + [900_000_000 + i * 20_000 for i in range(50 * 5)]
    values = {t: draw.random() for t in times}
    cuts, passed = [0, 900, 901, 2000, 3000, len(times)], 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = times[a:b]
        draw.shuffle(part)
        halves = [pd.DataFrame({"us": part[i::2], "value": [values[t] for t in part[i::2]]}) for i in (0, 1)]
        before = held.asked
        list(windows.handleInputRows(("1",), iter(halves), Passed(passed)))
        passed = max(part) // 1000 - 3000 if b < len(times) else 10**7
        while due := sorted(ms for ms in held.timers if ms < passed):
            held.timers.remove(due[0])
            out += list(windows.handleExpiredTimer(("1",), Passed(passed), Passed(due[0])))
        assert held.asked - before <= 10 and len(held.timers) <= 1
        if b == 2000:
            assert sum(len(x[0]) for x in held.kept["held"]) // 8 <= 50 * (size + 5)
    found = {e: list(s) for frame in out for e, s in zip(frame["end_us"], frame["samples"], strict=True)}
    assert sum(map(len, out)) == len(found) and not held.kept and not held.timers
    ends = sorted({(t // 1_000_000 + k) * 1_000_000 for t in times for k in range(1, size + 1)})
    assert found == {e: [values[t] for t in times if e - size * 1_000_000 <= t < e] for e in ends}
