"""Scenario tables and row-by-row twins of the fusion rules."""

import random

import pytest
from pyspark.sql import functions as F

from nocturne.operators import baseline, evaluate, fusion

SIGNALS = (
    "scenario string, radar struct<presence:boolean,breathing_rate:double,movement:double,apnea:boolean>, "
    "cry struct<is_crying:boolean,cls:string,confidence:double>, env struct<co2:double,temp:double>, expected boolean"
)
# Scenarios whose outcomes are given.
SCENARIOS = [
    ("normal", (True, 40.0, 0.1, None), (False, "none", 0.1), 600.0, False),
    ("cry_only", (True, 40.0, 0.1, None), (True, "hungry", 0.85), 600.0, False),
    ("bad_env_only", (True, 40.0, 0.1, None), (False, "none", 0.1), 1200.0, False),
    ("apnea_only", (True, 3.0, 0.05, True), (False, "none", 0.1), 600.0, True),
    ("apnea_with_cry", (True, 3.0, 0.2, True), (True, "discomfort", 0.9), 600.0, True),
    ("motion_noise_only", (True, 41.0, 0.85, None), (False, "none", 0.1), 600.0, False),
    ("bad_env_with_cry", (True, 42.0, 0.1, None), (True, "hungry", 0.82), 1250.0, False),
    ("transient_spike", (True, 40.0, 0.95, None), (False, "none", 0.1), 650.0, False),
    ("irregular_breath_with_cry", (True, 12.0, 0.3, False), (True, "discomfort", 0.88), 600.0, True),
    ("irregular_breath_bad_env", (True, 13.0, 0.2, False), (False, "none", 0.1), 1300.0, True),
    ("empty_crib_false_apnea", (False, 0.0, 0.0, True), (False, "none", 0.1), 600.0, False),
]


@pytest.fixture(scope="module")
def scenarios(spark):
    return spark.createDataFrame([(n, r, c, (co2, 22.0), e) for n, r, c, co2, e in SCENARIOS], SIGNALS)


def test_full_policy_has_no_false_alarm_and_no_miss(scenarios):
    told = {r["policy"]: r for r in evaluate.score_policies(fusion.with_policies(scenarios), rates=True).collect()}
    assert (told["full_fusion"]["false_alarms"], told["full_fusion"]["misses"]) == (0, 0)
    assert told["single_sensor"]["false_alarms"] > 0
    assert told["radar_only"]["misses"] == 2


def test_reasons_keep_their_order(scenarios):
    told = {r["scenario"]: r["reasons"] for r in fusion.with_decision(scenarios).collect()}
    assert told["apnea_with_cry"] == ["apnea_suspected", "cry_detected(discomfort)", "multi_signal"]
    assert told["irregular_breath_bad_env"] == ["borderline_cross", "co2_high"]
    assert told["normal"] == []


def test_cry_with_unmeasured_breath_alerts_without_presence(spark):
    rows = spark.createDataFrame([(None, (False, 0.0, 0.0, None), (True, None, 0.9), None, True)], SIGNALS)
    r = fusion.with_decision(rows).first()
    assert (r["raw_level"], r["reasons"]) == ("alert", ["cry_detected(None)", "multi_signal"])


def test_missing_modalities_and_nan(spark):
    nan = float("nan")
    rows = spark.createDataFrame([("none", None, None, None, False), ("nan", (True, nan, nan, None), None, (nan, nan), False)], SIGNALS)
    told = fusion.with_recommendations(fusion.with_sleep_state(fusion.with_decision(rows)))
    assert {r["scenario"]: (r["raw_level"], r["sleep_state"], r["actions"]) for r in told.collect()} == {"none": ("normal", "unknown", []), "nan": ("normal", "calm_sleep", [])}


def test_sleep_states(spark):
    rows = [("calm", True, 0.1, False), ("low", True, 0.3, False), ("restless", True, 0.5, False), ("restless2", True, 0.65, False), ("awake", True, 0.85, False), ("cry", True, 0.2, True), ("absent", False, 0.0, False)]
    df = spark.createDataFrame([(n, (p, m), (c,)) for n, p, m, c in rows], "scenario string, radar struct<presence:boolean,movement:double>, cry struct<is_crying:boolean>")
    told = {r["scenario"]: r["sleep_state"] for r in fusion.with_sleep_state(df).collect()}
    assert told == {"calm": "calm_sleep", "low": "calm_sleep", "restless": "restless", "restless2": "restless", "awake": "awake", "cry": "awake", "absent": "unknown"}


def test_recommendations(spark):
    rows = [
        (600.0, 45.0, 22.0, 10.0, "calm_sleep", []),
        (1200.0, 45.0, 22.0, 10.0, "calm_sleep", ["ventilate"]),
        (600.0, 28.0, 22.0, 10.0, "calm_sleep", ["humidify"]),
        (600.0, 45.0, 28.0, 10.0, "awake", ["cool"]),
        (600.0, 45.0, 16.0, 10.0, "calm_sleep", ["heat"]),
        (600.0, 45.0, 22.0, 80.0, "calm_sleep", ["dim_light"]),
        (600.0, 45.0, 22.0, 80.0, "awake", []),
        (1100.0, 30.0, 27.0, 90.0, "restless", ["ventilate", "humidify", "cool", "dim_light"]),
    ]
    df = spark.createDataFrame([((a, b, c, d), s, e) for a, b, c, d, s, e in rows], "env struct<co2:double,humidity:double,temp:double,lux:double>, sleep_state string, expected array<string>")
    assert evaluate.agreement(fusion.with_recommendations(df), "actions", "expected").first()["accuracy"] == 1.0


def timeline(spark):
    rows = []
    for t in range(100):
        stopped = 30 <= t < 45 or t in (60, 65, 70)
        radar = (True, 3.0, 0.05, True) if stopped else (True, 40.0, 0.1, False)
        rows.append(("d", float(t), t, radar, (False, "none", 0.1), (600.0, 22.0)))
    schema = "device_id string, t double, seq int, " + SIGNALS.split(", ", 1)[1].rsplit(", ", 1)[0]
    return fusion.with_decision(spark.createDataFrame(rows, schema))


def test_debounce_and_cooldown_thin_the_alerts(spark):
    alerts = evaluate.alert_sweep(timeline(spark), [(1, 0.0), (2, 10.0)]).collect()
    assert sorted(r["t"] for r in alerts if r["debounce_n"] == 1) == [30, 60, 65, 70]
    assert [r["t"] for r in alerts if r["debounce_n"] == 2] == [31]
    spans = spark.createDataFrame([("d", 30.0, 45.0)], "device_id string, start_ts double, end_ts double")
    blips = spark.createDataFrame([("d", t) for t in (60.0, 65.0, 70.0)], "device_id string, t double")
    told = evaluate.alert_quality(evaluate.alert_sweep(timeline(spark), [(1, 0.0), (2, 10.0)]), spans, blips, config=["debounce_n"], bucket_s=7.0)
    assert {r["debounce_n"]: (r["total_alerts"], r["latency_s"], r["false_alerts"]) for r in told.collect()} == {1: (4, 0.0, 3), 2: (1, 1.0, 0)}


def plain_alerts(levels, n, cooldown):
    """Row by row: debounce, then cooldown."""
    out, run, last, level, key0, at = [], 0, None, "normal", None, 0.0
    for t, (raw, reasons) in enumerate(levels):
        run = run + 1 if raw == last else 1
        last = raw
        now = raw if run >= n else "normal"
        if now not in ("normal", level):
            key = (now, tuple(reasons))
            if not (key == key0 and t - at < cooldown):
                out.append((t, now))
                key0, at = key, t
        level = now
    return out


@pytest.mark.parametrize("seed", range(3))
def test_alerts_match_the_row_by_row_twin(spark, seed):
    rng = random.Random(seed)
    states = [("normal", []), ("attention", ["co2_high"]), ("alert", ["multi_signal"]), ("alert", ["apnea_suspected"])]
    rows = [rng.choice(states) for _ in range(400)]
    df = spark.createDataFrame([("d", float(t), t, *r) for t, r in enumerate(rows)], "device_id string, t double, seq int, raw_level string, reasons array<string>")
    for n, cooldown in ((1, 5.0), (2, 12.0)):
        got = fusion.emit_alerts(fusion.debounce(df, n), cooldown).collect()
        assert sorted((int(r["t"]), r["level"]) for r in got) == plain_alerts(rows, n, cooldown)


def test_baseline_aggregate_equals_the_recurrence(spark):
    rng = random.Random(5)
    rows = [("a" if i % 2 else "b", float(i), i, rng.choice([0.0, None, rng.gauss(40, 2)]), rng.choice([None, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "device_id string, t double, seq int, breathing_rate double, movement double")
    last = {r["device_id"]: r for r in baseline.personal_baseline_series(df).collect() if r["samples"] == 150}
    for r in baseline.personal_baseline(df).collect():
        for c in ("samples", "bpm_mean", "bpm_low", "bpm_high", "restless_threshold"):
            assert r[c] == pytest.approx(last[r["device_id"]][c], rel=1e-9)


def test_baseline_converges(spark):
    rng = random.Random(0)
    rows = [(h, float(i), i, rng.gauss(m, 2), 0.1) for h, m in (("A", 40), ("B", 52)) for i in range(300)]
    df = spark.createDataFrame(rows, "device_id string, t double, seq int, breathing_rate double, movement double")
    truth = spark.createDataFrame([("A", 40.0), ("B", 52.0)], "device_id string, true_bpm double")
    assert all(r["error"] < 2 for r in evaluate.baseline_error(df, truth).collect())


def test_as_of_fill_takes_the_latest_of_each(spark):
    part = lambda rows, c: spark.createDataFrame(rows, f"device_id string, t double, seq int, {c} struct<x:int>")
    out = fusion.latest_signals(part([("d", 1.0, 1, (1,)), ("d", 3.0, 3, (2,))], "radar"), part([("d", 2.0, 2, (9,))], "cry"), part([], "env"))
    assert [(r["seq"], r["radar"] and r["radar"]["x"], r["cry"] and r["cry"]["x"], r["env"]) for r in out.orderBy("seq").collect()] == [(1, 1, None, None), (2, 1, 9, None), (3, 2, 9, None)]


def test_status_board_of_empty_tables(spark):
    states = spark.createDataFrame([], "device_id string, t double, seq int, topic string, level string, radar struct<presence:boolean,breath_valid:boolean,breathing_rate:double>")
    alerts = spark.createDataFrame([], "device_id string, t double, seq int, level string, reason string")
    assert fusion.status_board(states, alerts).count() == 0
    assert fusion.debounce(states.withColumn("raw_level", F.lit("alert"))).count() == 0
