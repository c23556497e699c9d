"""What plans hold: no Python workers where built-ins do, few exchanges, scans by chunks; folds against plain loops."""

import random

import numpy as np
import pytest

from nocturne.functions import kernels
from nocturne.operators import baseline
from nocturne.plans.queries import FOUND

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["f8_emit_alerts", "f9_baseline_series", "f9_per_message", "f12_status_board", "n7a_night_alerts", "n7c_baseline_convergence", "e5_alert_quality", "e5_quality_by_setting", "e5_alert_sweep", "n8_night_report", "f8_hot_device"])
def test_no_python_worker(spark, name):
    plan = plan_of(FOUND[name][0](spark, SF))
    assert not [word for word in ("Python", "Pandas", "Arrow") if word in plan]


def test_night_report_reads_events_once(spark):
    """Levels are written with one read of events and one exchange; the report has none of its own over rows but one for each part."""
    plan = plan_of(FOUND["n8_night_report"][0](spark, SF)).split("Initial Plan")[-1]
    assert "events.parquet" not in plan
    assert plan.count("Scan parquet") == 3  # radar, alerts, states
    assert plan.count("Exchange hashpartitioning") <= 8


def test_alert_sweep_numbers_runs_once(spark):
    plan = plan_of(FOUND["e5_alert_sweep"][0](spark, SF)).split("Initial Plan")[-1]
    assert plan.count("Scan parquet") == 1


@pytest.mark.parametrize("part", [1, 7, 256])
@pytest.mark.parametrize("chunk", [3.0, 50.0, 1e9])
def test_baseline_by_parts_and_chunks(spark, monkeypatch, part, chunk):
    monkeypatch.setattr(baseline, "PART", part)
    draw = random.Random(part)
    rows = [(d, float(t), t, draw.choice([None, -1.0, 0.0, float("nan"), 20 + 10 * draw.random()]), draw.choice([None, float("nan"), draw.random()])) for d in ("a", None) for t in range(-20, 70)]
    rows += [("c", float(t), t, None, None) for t in range(3)]
    df = spark.createDataFrame(rows, "device_id string, t double, seq int, breathing_rate double, movement double")
    got = sorted(map(tuple, baseline.personal_baseline_series(df.repartition(3), 0.2, chunk_s=chunk).collect()), key=lambda r: (r[0] or "", r[1]))
    for device in ("a", None, "c"):
        own = [r for r in rows if r[0] == device]
        x, m = (np.array([np.nan if r[i] is None else r[i] for r in own]) for i in (3, 4))
        want = kernels.ema_series(x, m, 0.2, 2.0)
        found = [r for r in got if r[0] == device]
        assert [r[1] for r in found] == [r[1] for r in own]
        for i, values in enumerate(want.values()):
            assert np.allclose(np.array([np.nan if r[3 + i] is None else r[3 + i] for r in found], float), values, equal_nan=True)
