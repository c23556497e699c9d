"""Scans by chunks of time give what windows over whole keys give, for chunks of any length."""

import random

import pytest
from pyspark.sql import functions as F

from nocturne.operators import fusion, radar, rhythm, timeline

LENGTHS = (0.5, 7.0, 40.0, 1e9)


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(4)
    out = []
    for device in ("a", "b", None):
        t = -30.0
        for i in range(120 if device != "b" else 3):
            t += draw.choice([0.0, 0.25, 1.0, 3.0, 25.0])
            out.append((device, t, i, draw.choice(["x", "x", "x", "y", None]), draw.random() < 0.6 if draw.random() < 0.9 else None, draw.choice([None, None, 1.5, 2.5])))
    return spark.createDataFrame(out, "device_id string, t double, seq int, kind string, flag boolean, v double").cache()


KEYS, SEQ = ["device_id"], ["seq"]
SCANS = {
    "filled": lambda d, c: timeline.filled(d, ("v", "kind"), KEYS, seq=SEQ, chunk_s=c),
    "runs": lambda d, c: timeline.with_runs(d, F.col("kind"), KEYS, seq=SEQ, chunk_s=c),
    "parts": lambda d, c: timeline.with_parts(d, F.struct("t"), lambda a, b: b["t"] - a["t"] > 2, KEYS, seq=SEQ, chunk_s=c),
    "episodes": lambda d, c: timeline.episodes(d, F.col("flag"), KEYS, 0.5, 0.0, seq=SEQ, chunk_s=c),
    "merged": lambda d, c: timeline.episodes(d, F.col("flag"), KEYS, 0.5, 4.0, seq=SEQ, chunk_s=c),
    "onsets": lambda d, c: timeline.count_onsets(d, F.col("flag"), KEYS, seq=SEQ, chunk_s=c),
    "longest": lambda d, c: timeline.longest_run(d, F.col("flag"), KEYS, seq=SEQ, chunk_s=c),
    "place": lambda d, c: timeline.place(d, KEYS, seq=SEQ, chunk_s=c),
    "debounce": lambda d, c: fusion.debounce(d, 2, raw="kind", chunk_s=c),
    "alerts": lambda d, c: fusion.emit_alerts(fusion.debounce(d.withColumns({"kind": F.coalesce("kind", F.lit("normal")), "reasons": F.array("kind")}), 1, raw="kind", chunk_s=c), 9.0, chunk_s=c),
}


@pytest.mark.parametrize("name", SCANS)
def test_any_chunk_gives_the_same(rows, name):
    plain = SCANS[name](rows, None)
    want = sorted(map(tuple, plain.collect()), key=repr)
    assert want
    for length in LENGTHS:
        got = SCANS[name](rows, length)
        assert got.columns == plain.columns
        assert sorted(map(tuple, got.collect()), key=repr) == want, length


def test_ticks_by_chunks(spark):
    draw = random.Random(9)
    states = spark.createDataFrame([(d, i * 0.7 + draw.random() / 3 + (40 if i > 60 else 0), *(draw.random() * 50 if draw.random() < p else None for p in (0.6, 0.1, 0.8)), draw.choice([True, False, None])) for d in ("a", "b") for i in range(110)], "device_id string, t double, breath double, heart double, distance double, presence boolean").cache()
    want = sorted(map(tuple, radar.sample_ticks(states).collect()), key=repr)
    assert want
    for length in (1.0, 3.5, 30.0, 1e6):
        assert sorted(map(tuple, radar.sample_ticks(states, chunk_s=length).collect()), key=repr) == want


def test_rhythm_by_chunks(spark):
    draw = random.Random(2)
    states = spark.createDataFrame([("a", 1, i, draw.choice(["calm_sleep"] * 4 + ["awake", "restless"])) for i in range(300)], "device_id string, night_id long, minute long, state string")
    want = rhythm.night_rhythm(states).collect()
    assert rhythm.night_rhythm(states, chunk_s=17.0).collect() == want


def test_a_window_holds_no_more_than_a_chunk(rows):
    """The plan of a chunked scan has no window over whole keys but those over chunks' summaries."""
    plan = timeline.filled(rows, ("v",), KEYS, seq=SEQ, chunk_s=5.0)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    assert sum("_own" in line and "_chunk" in line for line in windows) == 1  # rows, by chunk


@pytest.mark.parametrize("period,back", [(1.0, 2.0), (1.0, 2.5), (2.0, 0.7), (0.3, 5.0), (1 / 3, 2.0)])
def test_ticks_by_chunks_of_any_period(spark, period, back):
    """Several messages a moment, times on ticks and before the epoch, windows that are no multiple of the period or under one."""
    draw = random.Random(3)
    rows = [(d, round(-20 + i * 0.25 + (30 if i > 150 else 0), 2), kind) for d in ("a", None) for i in range(300) for kind in draw.sample(["breath", "distance", "presence"], draw.choice([0, 1, 2, 3]))]
    values = {"breath": lambda: draw.random() * 50, "distance": lambda: draw.choice([float("nan"), draw.random() * 50]), "presence": lambda: draw.random() < 0.5}
    states = spark.createDataFrame([(d, t, *(values[c]() if c == kind else None for c in ("breath", "heart", "distance", "presence"))) for d, t, kind in rows], "device_id string, t double, breath double, heart double, distance double, presence boolean").cache()
    ticks = lambda c: sorted((tuple("nan" if x != x else round(x, 9) if isinstance(x, float) else x for x in r) for r in radar.sample_ticks(states, period, 3.0, back, chunk_s=c).collect()), key=repr)
    want = ticks(None)
    assert len(want) > 100 and {r[-1] for r in want} > {0.1, 1.0} if back > 2 else want
    for length in (0.4, 3.0, 50.0, 1e6):
        assert ticks(length) == want, length


def test_a_tick_looks_back_on_periods(spark):
    """A chunked tick's window is over sums of periods: no window over messages has a frame of time."""
    states = spark.createDataFrame([("a", 0.5, 1.0, None, 2.0, True)], "device_id string, t double, breath double, heart double, distance double, presence boolean")
    plan = radar.sample_ticks(states, chunk_s=5.0)._jdf.queryExecution().optimizedPlan().toString()
    frames = [line for line in plan.splitlines() if "Window [" in line and "RangeFrame, -" in line]
    assert frames and all("_count_all" in line or "_count_late" in line for line in frames)
