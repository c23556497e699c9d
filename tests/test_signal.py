"""Signal features against one-signal-at-a-time numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nocturne.functions import kernels
from nocturne.operators import evaluate, signal

FS = 50.0


def breath(bpm, seconds, seed, noise=0.2, stop=None):
    rng = random.Random(seed)
    out = []
    for i in range(int(seconds * FS)):
        t = i / FS
        size = 0.03 if stop is not None and t >= stop else 1.0
        out.append(size * (math.sin(2 * math.pi * bpm / 60 * t) + 0.08 * math.sin(4 * math.pi * bpm / 60 * t)) + noise * size * rng.gauss(0, 1) + 0.001 * t)
    return out


def test_rates_of_clean_signals(spark):
    rows = [(float(b), breath(b, 30, b)) for b in (20, 25, 30, 35, 40, 45)]
    df = spark.createDataFrame(rows, "truth double, samples array<double>").withColumn("bpm", signal.estimate_bpm(F.col("samples"), FS))
    assert evaluate.mae_by(df.withColumn("g", F.lit(1)), "bpm", "truth", ["g"]).first()["mae"] < 1.01


def test_short_and_empty_signals(spark):
    df = spark.createDataFrame([([],), (None,), ([1.0],), ([1.0] * 600,)], "samples array<double>")
    rows = signal.process_windows(df, FS).collect()
    assert [(r["breathing_bpm"], r["apnea"], r["motion"], r["movement"]) for r in rows[:3]] == [(0.0, False, False, 0.1)] * 3
    assert not rows[3]["apnea"]


def test_apnea_in_both_forms(spark):
    rows = [("stop", breath(30, 12, 1, 0.05, 8.0)), ("go", breath(30, 12, 2, 0.05)), ("four", breath(30, 4, 3)), ("short", breath(30, 2, 4))]
    df = spark.createDataFrame(rows, "name string, samples array<double>").withColumn("own", signal.detect_apnea(F.col("samples"), FS))
    told = {r["name"]: (r["own"], r["apnea"]) for r in signal.process_windows(df, FS).collect()}
    assert told == {"stop": (True, True), "go": (False, False), "four": (False, False), "short": (False, False)}


def test_motion_needs_a_fast_burst(spark):
    calm = breath(30, 12, 1, 0.3)
    burst = [v + (3 * math.sin(8 * math.pi * i / FS) if i >= 500 else 0.0) for i, v in enumerate(calm)]
    df = spark.createDataFrame([(calm,), (burst,)], "samples array<double>")
    assert [r["m"] for r in df.select(signal.detect_motion(F.col("samples"), FS).alias("m")).collect()] == [False, True]


def test_multibin_beats_the_mean(spark):
    rows = []
    for b, bpm in enumerate((20, 30, 40, 50)):
        for k in range(8):
            base = breath(bpm, 30, 10 * b + k, 0.3) if k == 3 else [0.0] * 1500
            hum = [1.5 * math.sin(2 * math.pi * 2.5 * i / FS + k) + 0.3 * math.sin(2 * math.pi * 0.9 * i / FS) + 0.01 * i for i in range(1500)]
            rows.append((b, float(bpm), k, [4 * x + y * (0.2 if k == 3 else 1.0) for x, y in zip(base, hum, strict=True)]))
    df = spark.createDataFrame(rows, "window_id int, truth double, bin int, samples array<double>")
    got = {r["window_id"]: (r["bin"], r["bpm"]) for r in signal.estimate_bpm_multibin(df, FS, ["window_id"]).collect()}
    assert all(b == 3 and abs(rate - bpm) < 2.1 for (b, rate), bpm in zip((got[i] for i in range(4)), (20, 30, 40, 50), strict=True))
    assert signal.estimate_bpm_naive(df, FS, ["window_id"]).count() == 4


def test_detrend_and_bandpass(spark):
    t = np.arange(500)
    x = 3.0 + 0.02 * t + np.sin(2 * np.pi * 0.4 * t / FS)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    flat, band = df.select(signal.detrend(F.col("x")), signal.bandpass(signal.detrend(F.col("x")), FS)).first()
    a, b = np.polyfit(t, x, 1)
    assert np.allclose(flat, x - (a * t + b)) and np.corrcoef(band, np.sin(2 * np.pi * 0.4 * t / FS))[0, 1] > 0.95
    long = spark.createDataFrame([("d", int(i), float(v)) for i, v in enumerate(x)], "device_id string, i int, value double")
    assert np.allclose([r["detrended"] for r in signal.with_trend(long).orderBy("i").collect()], flat)


def test_sliding_windows_hold_the_last_seconds(spark):
    rows = [("d", i / 10, float(i)) for i in range(300) if not 150 <= i < 170]
    out = signal.signal_windows(spark.createDataFrame(rows, "device_id string, t double, value double"), 12, 1).collect()
    for r in out:
        assert r["samples"] == [v for _, t, v in rows if r["window_end"] - 12 <= t < r["window_end"]]


def test_delay_of_the_first_detection(spark):
    x = breath(30, 40, 5, 0.05, 20.0)
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate(x)], "device_id string, i int, value double")
    truth = spark.createDataFrame([("d", 20.0)], "device_id string, onset_s double")
    want = None
    for size in range(200, len(x) + 1, 25):
        a = np.array(x[:size])
        if size > 200 and a[-200:].std() + 1e-12 < 0.2 * (a[:-200].std() + 1e-12):
            want = size / FS
            break
    r = signal.apnea_delay(df, truth, FS).first()
    assert r["detected_s"] == pytest.approx(want) and r["delay_s"] == pytest.approx(want - 20)


def test_ema_in_chunks_equals_the_loop():
    """The vectorised baseline, whole and carried on from chunk to chunk, against the recurrence row by row."""
    rng = np.random.default_rng(4)
    for size in (0, 1, 2, 7, 200):
        rate = np.where(rng.random(size) < 0.3, rng.choice([0.0, np.nan, -1.0], size), rng.normal(40, 5, size))
        move = np.where(rng.random(size) < 0.3, np.nan, rng.random(size))
        mean, var, moved, want = np.nan, 0.0, np.nan, []
        for i, (r, m) in enumerate(zip(rate, move, strict=True)):
            if r > 0:
                d = 0.0 if np.isnan(mean) else r - mean
                mean, var = (r if np.isnan(mean) else mean + 0.1 * d), 0.9 * (var + 0.1 * d * d)
            if not np.isnan(m):
                moved = m if np.isnan(moved) else moved + 0.1 * (m - moved)
            want.append((i + 1, mean, mean - 2 * np.sqrt(var), mean + 2 * np.sqrt(var), max(0.4, 2 * (0.1 if np.isnan(moved) else moved) + 0.2)))
        for cuts in ([], [size // 3], sorted({0, min(1, size), size // 2, size})):
            state, got = (0, np.nan, 0.0, np.nan), []
            for x, m in zip(np.split(rate, cuts), np.split(move, cuts), strict=True):
                got += list(zip(*kernels.ema_series(x, m, 0.1, 2.0, state).values(), strict=True))
                first = [v[0] if len(v) else np.nan for v in (x[x > 0], m[~np.isnan(m)])]
                state = kernels.ema_carried(state, kernels.ema_summary(x, m, 0.1), tuple(first), 0.1)
            assert np.allclose(np.array(got).reshape(-1, 5), np.array(want).reshape(-1, 5), equal_nan=True)


def test_augmentation_steps():
    x = np.sin(np.arange(400) / 7)
    noisy = kernels.with_noise(x, np.random.default_rng(0).normal(size=150), 10.0)
    assert 10 * np.log10(np.mean(x**2) / np.mean((noisy - x) ** 2)) == pytest.approx(10.0)
    assert np.allclose(kernels.with_noise(x, np.zeros(3), 10.0), x)
    response = np.random.default_rng(1).normal(size=100)
    assert np.allclose(kernels.with_echo(x, response), np.convolve(x, response)[:400] / np.abs(np.convolve(x, response)[:400]).max())
    assert np.allclose(kernels.at_distance(x, 0.5, 3)[1:-1], 0.5 * (x[:-2] + x[1:-1] + x[2:]) / 3)
    assert len(kernels.room_response(np.random.default_rng(2), 0.2, 1000)) == 200
