"""Streaming twins of the batch operators.

Event time is a timestamp column, ts_col; `t` is the same as epoch seconds. Rows later than the watermark are
dropped by the windowed jobs, and counted: on_time() lets rows through one by one, and Spark's progress says how many it did not
(runs.late_rows()). The stateful jobs take each micro-batch in order of (t, seq) and leave out what is
older than the last row they have seen.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.columns import field
from ..operators.fusion import with_decision, with_recommendations, with_sleep_state
from ..operators.minutes import minute_features
from ..operators.signal import process_windows
from ..sources.logs import RAW, with_day

WATERMARK = "30 seconds"


def read_landing(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The raw log as it lands, as a stream of JSON lines."""
    reader = spark.readStream.schema(RAW).option("columnNameOfCorruptRecord", "_corrupt")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path).where("topic is not null").drop("_corrupt")


def stream_raw_log(raw: DataFrame, path: str, checkpoint: str, tz: str = "UTC") -> StreamingQuery:
    """Writes all topics to the raw log, partitioned by day; each line once."""
    writer = with_day(raw, tz).writeStream.partitionBy("day").format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)


STATES = "device_id string, t double, seq bigint, level string, raw_level string, reasons array<string>, sleep_state string, actions array<string>, alert boolean, samples bigint, bpm_mean double"
_MEMORY = "t double, seq bigint, run_level string, run int, level string, alert_key string, alert_t double, samples bigint, mean double"
_MODALITIES = ("radar", "cry", "env")


class _Fusion(StatefulProcessor):
    """Of each device the latest payloads, the debounce run, the last alert and the baseline: one small row."""

    def __init__(self, debounce_n: int, cooldown_s: float, alpha: float):
        self.n, self.cooldown, self.alpha = debounce_n, cooldown_s, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", _MEMORY)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = self.memory.get() if self.memory.exists() else (-1.0, -1, "normal", 0, "normal", None, 0.0, 0, None)
        t0, seq0, run_level, run, level, alert_key, alert_t, samples, mean = found
        out = []
        for r in pd.concat(list(rows)).sort_values(["t", "seq"], kind="stable").itertuples():
            if (r.t, r.seq) <= (t0, seq0):
                continue
            t0, seq0 = r.t, int(r.seq)
            run = run + 1 if r.raw_level == run_level else 1
            run_level = r.raw_level
            now = r.raw_level if run >= self.n else "normal"
            reasons = list(r.reasons) if now != "normal" else []
            alert = False
            if now not in ("normal", level):
                name = "|".join([now, *reasons])
                if name != alert_key or r.t - alert_t >= self.cooldown:
                    alert, alert_key, alert_t = True, name, r.t
            level = now
            if r.rate is not None and r.rate == r.rate and r.rate > 0:
                mean = r.rate if mean is None else mean + self.alpha * (r.rate - mean)
            samples += 1
            out.append((key[0], r.t, seq0, level, r.raw_level, reasons, r.sleep_state, list(r.actions), alert, samples, mean))
        self.memory.update((t0, seq0, run_level, run, level, alert_key, alert_t, samples, mean))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])

    def close(self) -> None:
        pass


class _Latest(StatefulProcessor):
    """Gives each message the latest payload (JSON text) of every modality of its device."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("payloads", "t double, seq bigint, radar string, cry string, env string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        t0, seq0, *known = self.memory.get() if self.memory.exists() else (-1.0, -1, None, None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["t", "seq"], kind="stable").itertuples():
            if (r.t, r.seq) <= (t0, seq0):
                continue
            t0, seq0 = r.t, int(r.seq)
            known = [new if isinstance(new, str) else old for new, old in zip((r.radar, r.cry, r.env), known, strict=True)]
            out.append((key[0], t0, seq0, *known))
        self.memory.update((t0, seq0, *known))
        yield pd.DataFrame(out, columns=["device_id", "t", "seq", *_MODALITIES])

    def close(self) -> None:
        pass


def _json(df: DataFrame, name: str):
    return F.when(F.col(name).isNotNull(), F.to_json(F.col(name), {"ignoreNullFields": "true"}))


def stream_fusion(messages: DataFrame, debounce_n: int = 2, cooldown_s: float = 10.0, alpha: float = 0.05) -> DataFrame:
    """For every message (device_id, t, seq, and one of the structs radar, cry and env) the fused state, and whether an alert goes out.

    A first state holds the latest payloads of each device; the rules of the batch job decide on them; a second
    state holds the debounce run, the last alert and the baseline. On ordered input this equals the batch result.
    """
    schemas = {m: messages.schema[m].dataType for m in _MODALITIES}
    text = messages.select("device_id", "t", "seq", *(_json(messages, m).alias(m) for m in _MODALITIES))
    latest = text.groupBy("device_id").transformWithStateInPandas(_Latest(), "device_id string, t double, seq bigint, radar string, cry string, env string", "Append", "None")
    filled = latest.select("device_id", "t", "seq", *(F.from_json(m, schemas[m]).alias(m) for m in _MODALITIES))
    told = with_recommendations(with_sleep_state(with_decision(filled)))
    rate = field(filled, "radar", "breathing_rate")
    ready = told.select("device_id", "t", "seq", "raw_level", "reasons", "sleep_state", "actions", rate.alias("rate"))
    return ready.groupBy("device_id").transformWithStateInPandas(_Fusion(debounce_n, cooldown_s, alpha), STATES, "Append", "None")


READINGS = "device_id string, t double, breathing_rate double, movement double, presence boolean, apnea boolean, motion boolean, breath_valid boolean, distance double, raw_breath double"


class _Radar(StatefulProcessor):
    """Of each device the last raw states, the distances and trusted rates of a few seconds, and the apnea clock."""

    def __init__(self, period: float, stale: float, scale: float, timed: bool):
        self.period, self.stale, self.scale, self.timed = period, stale, scale, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = "t double, tick bigint, breath double, distance double, presence boolean, since double, valid double, near array<struct<t:double,v:double>>, rates array<struct<t:double,v:double>>"
        self.handle, self.memory = handle, handle.getValueState("memory", kept)

    def _bridge(self):
        from ..functions.bridge import Bridge

        return Bridge(self.period, self.stale, self.memory.get() if self.memory.exists() else None, self.scale)

    def _told(self, key: Any, bridge: Any, readings: Iterator[tuple]) -> pd.DataFrame:
        out = [(key[0], *r) for r in readings]
        self.memory.update(bridge.memory())
        return pd.DataFrame(out, columns=[c.split()[0] for c in READINGS.split(", ")])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        bridge = self._bridge()
        messages = pd.concat(list(rows)).sort_values(["t", "seq"], kind="stable")
        out = self._told(key, bridge, bridge.readings(messages[["t", "what", "value"]].itertuples(index=False, name=None)))
        if self.timed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((bridge.t + self.stale) * 1000) + 1)
        yield out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """No message came for as long as the last one is fresh: its ticks are due."""
        bridge = self._bridge()
        yield self._told(key, bridge, bridge.silence())

    def close(self) -> None:
        pass


def stream_radar(states: DataFrame, period_s: float = 1.0, stale_s: float = 10.0, scale: float = 1.0, watermark: str | None = None, ts_col: str = "ts") -> DataFrame:
    """Clean readings from parsed device states (device_id, t, seq, breath, distance, presence), one per tick.

    A tick is emitted once a message at or after it arrived, and not at all if nothing was received for stale_s before it. With a watermark (on ts_col)
    a device that falls silent gets the ticks that its last message is fresh for as well, when the time of the others has gone on by stale_s: a
    timer for each device, set anew by its messages. A NaN comes out as null. scale stretches the spans of movement, smoothing and apnea.
    """
    what = F.when(F.col("breath").isNotNull(), "breath").when(F.col("distance").isNotNull(), "distance").when(F.col("presence").isNotNull(), "presence").otherwise("heart")
    value = F.coalesce("breath", "distance", F.col("presence").cast("double"), F.lit(0.0))
    timed = [ts_col] if watermark else []
    ready = (states.withWatermark(ts_col, watermark) if watermark else states).select("device_id", "t", "seq", *timed, what.alias("what"), value.alias("value"))
    processor = _Radar(period_s, stale_s, scale, bool(watermark))
    return ready.groupBy("device_id").transformWithStateInPandas(processor, READINGS, "Append", "EventTime" if watermark else "None")


def _text_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with keys as text: pandas makes whole numbers with a null among them floats, and Spark takes a float for a null key, so devices would share its state."""
    return rows.withColumns({c: F.col(c).cast("string") for c in keys})


def _typed_keys(rows: DataFrame, keys: Sequence[str], like: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast(like.schema[c].dataType) for c in keys})


class _Gate(StatefulProcessor):
    """Lets rows through. Spark leaves out what is behind the watermark before, and counts it row by row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield from rows

    def close(self) -> None:
        pass


def on_time(rows: DataFrame, keys: Sequence[str] = ("device_id",), ts_col: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """The rows that are not behind the watermark. A windowed aggregate counts late groups of its partial sums; here rows are counted."""
    timed = _text_keys(rows.withWatermark(ts_col, watermark), keys)
    out = timed.groupBy(*keys).transformWithStateInPandas(_Gate(), timed.schema, "Append", "EventTime", eventTimeColumnName=ts_col)
    return _typed_keys(out, keys, rows)


def stream_minutes(signals: DataFrame, keys: Sequence[str] = ("device_id",), ts_col: str = "ts", watermark: str = WATERMARK, count_late: bool = False) -> DataFrame:
    """minute_features() of a stream: a minute's record goes out once the watermark passes it. count_late: rows behind the watermark are counted."""
    timed = on_time(signals, keys, ts_col, watermark) if count_late else signals.withWatermark(ts_col, watermark)
    return minute_features(timed.withColumn("_window", F.window(ts_col, "1 minute")), [*keys, "_window"]).drop("_window")


class _Windows(StatefulProcessor):
    """Of each key its samples, each once, and one timer, for the first window that is to come; when time has passed that one, all windows that it has passed go out.

    What a micro-batch brings is appended as two arrays, so state is asked a few times for a key and a micro-batch, not for each window and second.
    """

    def __init__(self, keys: Sequence[str], size: int):
        self.keys, self.size = list(keys), size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us binary, value binary")
        self.due = handle.getValueState("due", "ms bigint")

    def _next(self, ms: int, before: int | None) -> None:
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).dropna(subset=["us"])
        if len(found):
            us = found["us"].to_numpy(np.int64)
            self.held.appendValue((us.tobytes(), found["value"].to_numpy(float).tobytes()))
            first, known = (int(us.min()) // 1_000_000 + 1) * 1000, self.due.get()
            if known is None or first < known[0]:
                self._next(first, known and known[0])
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        passed = max(timerValues.getCurrentWatermarkInMs(), due) // 1000
        held = [tuple(x) for x in self.held.get()]
        us, values = (np.concatenate([np.frombuffer(bytes(x[i]), kind) for x in held]) for i, kind in ((0, np.int64), (1, float)))
        order = np.lexsort((values, us))
        us, values = us[order], values[order]
        ends = np.unique(np.unique(us // 1_000_000)[:, None] + np.arange(1, self.size + 1))
        out, later = ends[(ends >= due // 1000) & (ends <= passed)], ends[ends > passed]
        first, last = (np.searchsorted(us, e * 1_000_000) for e in (out - self.size, out))
        for at in range(0, len(out), 256):
            part = slice(at, at + 256)
            samples = [values[a:b] for a, b in zip(first[part], last[part], strict=True)]
            yield pd.DataFrame({**{c: [k] * len(samples) for c, k in zip(self.keys, key, strict=True)}, "end_us": out[part] * 1_000_000, "samples": samples})
        if len(later):
            # samples go that no window to come holds
            kept = np.searchsorted(us, (later[0] - self.size) * 1_000_000)
            self.held.put([(us[kept:].tobytes(), values[kept:].tobytes())])
            self._next(int(later[0]) * 1000, None)
        else:
            self.held.clear()
            self.due.clear()

    def close(self) -> None:
        pass


def stream_windows(samples: DataFrame, keys: Sequence[str] = ("device_id",), ts_col: str = "ts", size_s: int = 12, watermark: str = WATERMARK) -> DataFrame:
    """keys, window_end and samples (in order of time) of the windows of size_s seconds that end on each whole second and hold a sample.

    State has each sample once, and at most the seconds of one window and of the watermark's delay; a sliding
    window() would hold each sample size_s times.
    """
    ready = samples.withWatermark(ts_col, watermark).select(*keys, ts_col, F.unix_micros(ts_col).alias("us"), F.col("value").cast("double").alias("value"))
    kinds = ", ".join(f"{c} string" for c in keys)
    out = _text_keys(ready, keys).groupBy(*keys).transformWithStateInPandas(_Windows(keys, size_s), f"{kinds}, end_us bigint, samples array<double>", "Append", "EventTime")
    return _typed_keys(out, keys, samples).select(*keys, F.timestamp_micros("end_us").alias("window_end"), "samples")


def stream_signal(samples: DataFrame, fs: float, keys: Sequence[str] = ("device_id",), ts_col: str = "ts", size_s: int = 12, watermark: str = WATERMARK) -> DataFrame:
    """process_windows() over sliding windows of a stream of samples (ts, value), when time has passed a window."""
    windows = stream_windows(samples, keys, ts_col, size_s, watermark)
    return process_windows(windows, fs).select(*keys, "window_end", "breathing_bpm", "breathing_rate", "apnea", "motion", "movement")


def stream_episodes(rows: DataFrame, flag: str, gap: str = "10 seconds", min_len_s: float = 3.0, keys: Sequence[str] = ("device_id",), ts_col: str = "ts", watermark: str = WATERMARK, count_late: bool = False) -> DataFrame:
    """Episodes of flag, which close when no true row came for gap; from the first to the last true row. count_late: rows behind the watermark are counted."""
    true = on_time(rows.where(flag), keys, ts_col, watermark) if count_late else rows.where(flag).withWatermark(ts_col, watermark)
    found = true.groupBy(*keys, F.session_window(ts_col, gap)).agg(F.min(ts_col).alias("start_ts"), F.max(ts_col).alias("end_ts"))
    span = F.unix_micros("end_ts") / 1e6 - F.unix_micros("start_ts") / 1e6
    return found.select(*keys, "start_ts", "end_ts", span.alias("duration_s")).where(F.col("duration_s") >= min_len_s)


def stream_status(raw: DataFrame, keys: Sequence[str] = ("device_id",)) -> DataFrame:
    """The latest payload of each topic, for update mode."""
    return raw.groupBy(*keys, "topic").agg(F.max_by("payload", F.struct("t", "seq")).alias("payload"), F.max("t").alias("last_ts"))
