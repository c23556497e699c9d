"""Episodes, the radar bridge, the night report, minutes and rhythm against plain twins and edge cases."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from nocturne.functions.bridge import Bridge
from nocturne.operators import minutes, night, radar, rhythm, timeline
from nocturne.sources import logs


def plain_episodes(points, min_len, merge_gap):
    out, start, last = [], None, None
    for t, flag in [*points, (None, False)]:
        if flag:
            start, last = (t if start is None else start), t
        elif start is not None:
            if merge_gap and out and start - out[-1][1] <= merge_gap:
                out[-1] = (out[-1][0], last)
            else:
                out.append((start, last))
            start = None
    return [(a, b) for a, b in out if b - a >= min_len]


@pytest.mark.parametrize("min_len,merge_gap", [(0, 0), (3, 0), (3, 10), (0, 4)])
def test_episodes_match_the_twin(spark, min_len, merge_gap):
    rng = random.Random(min_len + merge_gap)
    rows, t = [], 0
    for i in range(500):
        t += rng.choice([1, 1, 1, 2, 7])
        rows.append(("d", float(t), i, rng.random() < 0.4))
    df = spark.createDataFrame(rows, "device_id string, t double, seq int, on boolean")
    got = timeline.episodes(df, F.col("on"), ["device_id"], min_len, merge_gap, seq=["seq"])
    assert sorted((r["start_ts"], r["end_ts"]) for r in got.collect()) == plain_episodes([(r[1], r[3]) for r in rows], min_len, merge_gap)


def test_episodes_of_nothing_and_without_keys(spark):
    df = spark.createDataFrame([], "device_id string, t double, on boolean")
    assert timeline.episodes(df, F.col("on"), ["device_id"]).count() == 0
    with pytest.raises(ValueError):
        timeline.episodes(df, F.col("on"), [])


def test_gap_is_strict_and_lengths_are_inclusive(spark):
    rows = [("d", 1, t, i, False, False, 0.0, 30.0, None, None) for i, t in enumerate((0.0, 5.0, 10.1))]
    df = spark.createDataFrame(rows, "device_id string, night_id int, t double, seq int, presence boolean, motion boolean, movement double, breathing_rate double, source string, apnea boolean")
    assert [r["gap_s"] for r in night.collection_gaps(df).collect()] == [pytest.approx(5.1)]
    assert night.exit_episodes(df, 10.1).count() == 1
    assert night.coverage(df).first()["coverage"] == pytest.approx(1 - 5.1 / 10.1)
    assert night.night_header(df).first()["sources"] == ["?"]
    assert night.night_report(df).count() == 0  # under ten rows


@pytest.mark.parametrize("n", [9, 10, 11, 57])
def test_breathing_quantiles_are_exclusive(spark, n):
    rng = random.Random(n)
    values = [round(rng.uniform(5, 60), 1) for _ in range(n)]
    df = spark.createDataFrame([("d", v, True, None) for v in values] + [("d", 4.0, True, False), ("d", 40.0, False, False), ("d", 40.0, True, True)], "device_id string, breathing_rate double, presence boolean, motion boolean")
    r = night.breathing_distribution(df, ["device_id"]).first()
    assert r["samples"] == n
    if n < 10:
        assert r["median"] is None and r["p10"] is None
    else:
        q = statistics.quantiles(values, n=10)
        assert (r["median"], r["p10"], r["p90"]) == (pytest.approx(statistics.median(values)), pytest.approx(q[0]), pytest.approx(q[-1]))


def test_report_text_has_a_line_for_each_part(spark):
    rows = [("d", 1, float(i), i, True, False, 0.0, 30.0, "s") for i in range(20)]
    df = spark.createDataFrame(rows, "device_id string, night_id int, t double, seq int, presence boolean, motion boolean, movement double, breathing_rate double, source string")
    text = night.report_text(night.night_report(df)).first()["text"]
    assert "20 radar rows" in text and "coverage 100.00%" in text and "breathing 30.0 /min" in text


@pytest.mark.parametrize("low,told", [(-0.04, "-0.0"), (-0.05, "-0.1"), (0.04, "0.0"), (0.25, "0.3"), (38.9499, "38.9")])
def test_report_text_keeps_the_sign_of_what_rounds_to_zero(spark, low, told):
    rows = [("d", 1, float(i), i, True, False, 0.0, 30.0, "s") for i in range(20)]
    df = spark.createDataFrame(rows, "device_id string, night_id int, t double, seq int, presence boolean, motion boolean, movement double, breathing_rate double, source string")
    span = F.struct(F.lit(low).alias("bpm_low"), F.lit(70.0).alias("bpm_high"), F.lit(0.0).alias("t"), F.lit(1).alias("samples"))
    report = night.night_report(df).withColumn("normal_range", F.create_map(F.lit("1_first"), span))
    assert f"- normal breathing: {told} to 70.0 (" in night.report_text(report).first()["text"]


def test_written_reports_keep_the_sign_of_what_rounds_to_zero(spark, tmp_path):
    rows = [(d, 1, float(i), i, True, False, 0.0, 30.0, "s") for d in (1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "device_id long, night_id long, t double, seq int, presence boolean, motion boolean, movement double, breathing_rate double, source string")
    span = F.struct(F.when(F.col("device_id") == 1, -0.04).otherwise(0.04).alias("bpm_low"), F.lit(70.0).alias("bpm_high"), F.lit(0.0).alias("t"), F.lit(1).alias("samples"))
    report = night.night_report(df).withColumn("normal_range", F.create_map(F.lit("1_first"), span))
    logs.write_night_report(night.report_text(report), str(tmp_path / "reports"))
    found = {r["device_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "reports")).collect()}
    assert "- normal breathing: -0.0 to 70.0 (" in found[1] and "- normal breathing: 0.0 to 70.0 (" in found[2]


def raw_states(rng, n):
    rows, t = [], 0.0
    for i in range(n):
        t += rng.choice([0.2, 0.4, 1.0, 3.0, 14.0])
        kind = rng.choice(["breath_rate"] * 3 + ["distance"] * 3 + ["presence", "heart_rate"])
        text = {"breath_rate": rng.choice(["30", "32", "0", "NaN", "x"]), "distance": rng.choice(["60", "61", "90", "nan"]), "presence": rng.choice(["ON", " on ", "OFF", "1"]), "heart_rate": "99"}[kind]
        rows.append(("d", round(t, 3), i, f"mr60bha2/{kind}", text))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_bridge_batch_equals_message_by_message(spark, seed):
    rows = raw_states(random.Random(seed), 500)
    df = spark.createDataFrame(rows, "device_id string, t double, seq int, topic string, payload string")
    got = {r["t"]: r for r in radar.normalize_radar(df).collect()}
    names = {"breath_rate": "breath", "heart_rate": "heart", "distance": "distance", "presence": "presence"}
    messages = []
    for _, t, _, topic, text in rows:
        what = names[topic.split("/")[1]]
        if what == "presence":
            messages.append((t, what, float(text.strip().upper() in ("ON", "TRUE", "1"))))
        elif text != "x":
            messages.append((t, what, float(text)))
    want = list(Bridge(1.0, 10.0).readings(messages))
    assert len(got) == len(want) > 100
    for now, rate, move, here, apnea, motion, valid, *_ in want:
        r = got[now]
        assert (r["presence"], r["apnea"], r["motion"], r["breath_valid"]) == (here, apnea, motion, valid), now
        assert r["breathing_rate"] == pytest.approx(rate) and r["movement"] == pytest.approx(move)


def test_apnea_needs_a_breath_that_stopped(spark):
    rows = []
    for i in range(60):
        rows += [("d", i + 0.1, 2 * i, "mr60bha2/breath_rate", "30" if i < 30 else "0"), ("d", i + 0.2, 2 * i + 1, "mr60bha2/distance", "60")]
    df = spark.createDataFrame(rows, "device_id string, t double, seq int, topic string, payload string")
    apnea = [r["t"] for r in radar.normalize_radar(df).collect() if r["apnea"]]
    # the last trusted tick is 30, gone from 32 on, held for six seconds at 38
    assert min(apnea) == 38 and max(apnea) == 59
    assert radar.normalize_radar(df.where("t > 40")).where("apnea").count() == 0


def test_minutes_and_cry_context(spark):
    rng = random.Random(3)
    rows = [("d", m, 40.0, int(180 <= m < 300 and rng.random() < 0.5), int(m == 100), 0.1, 700.0, 22.0, 30.0 if 180 <= m < 300 else 45.0) for m in range(480)]
    df = spark.createDataFrame(rows, "device_id string, minute int, breathing_rate double, cry int, apnea int, movement double, co2 double, temp double, humidity double")
    found = {r["insight"]: r["value"] for r in minutes.cry_insights(df).collect()}
    assert found.keys() == {"dry", "peak_hour"} and found["peak_hour"] in (3, 4)
    s = minutes.night_summary(df).first()
    assert (s["monitored_min"], s["apnea_events"], s["avg_bpm"]) == (480, 1, pytest.approx(40.0))
    assert sum(s["cry_by_hour"].values()) == s["cry_minutes"]
    only = df.where("cry = 0")
    assert [r["insight"] for r in minutes.cry_insights(only).collect()] == ["insufficient"]


def test_minute_features_of_signals(spark):
    rows = [("d", 1.0, (30.0, True, 0.2), None), ("d", 2.0, (50.0, False, 0.9), None), ("d", 3.0, None, (True, 0.9)), ("d", 61.0, (0.0, True, 0.0), (True, 0.5))]
    df = spark.createDataFrame(rows, "device_id string, t double, radar struct<breathing_rate:double,breath_valid:boolean,movement:double>, cry struct<is_crying:boolean,confidence:double>")
    got = {r["minute"]: (r["breathing_rate"], r["cry"], r["movement"]) for r in minutes.minute_features(df).collect()}
    assert got == {0: (30.0, 1, 0.9), 1: (None, 0, 0.0)}


def test_rhythm_ties_go_to_the_first_seen(spark):
    nights = [["awake"] + ["calm_sleep"] * 69 + ["awake"] + ["calm_sleep"] * 9, ["calm_sleep"] * 80]
    rows = [("d", n, m, s) for n, states in enumerate(nights) for m, s in enumerate(states)]
    df = spark.createDataFrame(rows, "device_id string, night_id int, minute int, state string")
    r = rhythm.rhythm_insights(df).first()
    assert (r["nights"], r["avg_awakenings"], r["avg_longest_calm"], r["peak_hour"]) == (2, 1.0, 74.5, 0)
    assert math.isclose(r["avg_awake"], 0.0125, abs_tol=1e-3)
