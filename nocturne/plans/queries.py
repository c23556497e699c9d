"""One query per operator over the driver's tables, with DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..functions.intent import classify_intent, intent_action
from ..operators import baseline, clips, diary, evaluate, fusion, minutes, night, radar, rhythm, signal, timeline
from ..sources import clips as clip_source
from ..sources import logs
from ..sources.shared import new_folder, written
from . import views
from .views import ALERTS, DAY, FUSED, HOUR, LEVELS, LOG, MINUTES, RADAR, RAW_STATES, SIGNALS, STATES, WINDOWS

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FOUND[name] = (f, sql)
        return f

    return add


def episode_sql(source: str, flag: str, keys: str, min_len: float, merge: float, tail: str) -> str:
    """Common tables that end in `eps` (keys, start_ts, end_ts, duration_s)."""
    return f"""WITH {source},
flagged AS (SELECT *, coalesce({flag}, false) AS f FROM radar_log),
new_ AS (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY {keys} ORDER BY t, seq) THEN 0 ELSE 1 END AS new FROM flagged),
run_ AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY t, seq) AS run FROM new_),
first_ AS (SELECT {keys}, run, min(t) AS s, max(t) AS e FROM run_ WHERE f GROUP BY {keys}, run),
far_ AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY {keys} ORDER BY run) <= {merge} AND {merge} > 0 THEN 0 ELSE 1 END AS far FROM first_),
part_ AS (SELECT *, sum(far) OVER (PARTITION BY {keys} ORDER BY run) AS part FROM far_),
eps AS (SELECT {keys}, min(s) AS start_ts, max(e) AS end_ts, max(e) - min(s) AS duration_s FROM part_ GROUP BY {keys}, part HAVING max(e) - min(s) >= {min_len})
{tail}"""


# --- sources -------------------------------------------------------------------------------------------------------


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as a raw log: the payload is the event's own JSON, beside its kind as a topic."""
    ev = views.table(spark, sf, "events")
    return ev.selectExpr("CAST(user_id AS STRING) AS device_id", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6D AS rx_ts", "'sensor/' || event_type AS topic", "CASE WHEN event_id % 11 = 0 THEN 'ON' ELSE props END AS payload", "event_id")


@query("s2_decode_topic", """
SELECT event_id, CAST(user_id AS VARCHAR) AS device_id, CAST(props->>'$.k' AS DOUBLE) AS k FROM events WHERE event_type = 'click' AND event_id % 11 <> 0""")
def s2_decode_topic(spark, sf):
    return logs.decode_topic(_raw(spark, sf), "sensor/click", StructType().add("k", DoubleType()), ("event_id", "device_id"))


@query("s3_topic_matches", """
WITH topics AS (SELECT event_id, event_type, 'sensor/' || event_type AS topic FROM events)
SELECT event_id, true AS all_, event_id % 3 <> 2 AS under_sensor, event_id % 3 = 0 OR event_id % 3 = 2 AS one_level, event_id % 3 = 0 AND event_type = 'view' AS exact,
  event_id % 3 = 1 AS deeper, event_id % 3 = 1 AND event_type = 'click' AS ending FROM topics""")
def s3_topic_matches(spark, sf):
    patterns = {"all_": "#", "under_sensor": "sensor/#", "one_level": "+/+", "exact": "sensor/view", "deeper": "sensor/+/+", "ending": "+/click/raw"}
    topic = F.expr("CASE event_id % 3 WHEN 0 THEN topic WHEN 1 THEN topic || '/raw' ELSE 'sensors/' || substr(topic, 8) END").alias("topic")
    return _raw(spark, sf).select("event_id", topic).select("event_id", *(logs.topic_matches(F.col("topic"), p).alias(n) for n, p in patterns.items()))


@query("s4_raw_log_by_day", """
SELECT strftime(to_timestamp(epoch_us(ts) / 1e6::DOUBLE) AT TIME ZONE 'UTC', '%Y%m%d') AS day, event_type AS topic, count(*) AS rows, round(sum(round(epoch_us(ts) / 1e6::DOUBLE, 3) % 86400), 3) AS seconds FROM events GROUP BY 1, 2""")
def s4_raw_log_by_day(spark, sf):
    """The log written by day, and read again with its partitions."""
    folder = new_folder(spark, "raw-log")
    logs.write_raw_log(_raw(spark, sf), folder, fmt="parquet")
    rows = spark.read.schema("device_id string, rx_ts double, topic string, payload string, event_id long, day string").parquet(folder)
    return rows.groupBy("day", F.expr("substr(topic, 8)").alias("topic")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.col("rx_ts") % 86400), 3).alias("seconds"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """The messages as lines of JSON (value) with their time t: payloads that are objects, texts and numbers, and broken and blank lines among them."""
    ev = views.table(spark, sf, "events").selectExpr("event_id", "user_id", "event_type", "unix_micros(CAST(ts AS TIMESTAMP)) AS us", "props")
    payload = "CASE event_id % 5 WHEN 0 THEN '\"ON\"' WHEN 1 THEN CAST(event_id AS STRING) ELSE props END"
    line = f"concat('{{\"rx_ts\": ', CAST(us DIV 1000000 AS STRING), '.', lpad(CAST(us DIV 1000 % 1000 AS STRING), 3, '0'), ', \"topic\": \"sensor/', event_type, '\", \"device_id\": \"', CAST(user_id AS STRING), '\", \"payload\": ', {payload}, '}}')"
    return ev.selectExpr(f"CASE WHEN event_id % 13 = 0 THEN substr({line}, 1, 30) WHEN event_id % 17 = 0 THEN '' ELSE {line} END AS value", "us / 1e6D AS t")


LOGGED = """logged AS (
  SELECT CAST(user_id AS VARCHAR) AS device_id, (epoch_us(ts) // 1000) / 1e3::DOUBLE AS rx_ts, 'sensor/' || event_type AS topic,
    CASE event_id % 5 WHEN 0 THEN 'ON' WHEN 1 THEN CAST(event_id AS VARCHAR) ELSE replace(props, ' ', '') END AS payload FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0)"""


@query("s1_read_raw_log", f"WITH {LOGGED} SELECT * FROM logged")
def s1_read_raw_log(spark, sf):
    folder = new_folder(spark, "lines")
    _lines(spark, sf).select("value").write.text(folder)
    return logs.read_raw_log(spark, folder).select("device_id", "rx_ts", "topic", F.regexp_replace("payload", " ", "").alias("payload"))


@query("s1_bad_lines", "SELECT count(*) FILTER (WHERE event_id % 13 = 0 OR event_id % 17 <> 0) AS lines, count(*) FILTER (WHERE event_id % 13 = 0) AS broken, count(*) FILTER (WHERE event_id % 13 <> 0 AND event_id % 17 <> 0) AS messages FROM events")
def s1_bad_lines(spark, sf):
    folder = new_folder(spark, "lines")
    _lines(spark, sf).select("value").write.text(folder)
    return logs.bad_lines(spark, folder)


@query("s5_summary_csv", f"WITH {LOG} SELECT device_id, CAST(floor(t / {DAY}) AS BIGINT) AS minute, max(radar.movement) AS movement, round(avg(env.co2), 6) AS co2, count(*) AS rows FROM log GROUP BY device_id, floor(t / {DAY})")
def s5_summary_csv(spark, sf):
    """A summary written as CSV with a header, and read again."""
    log, folder = views.sensor_log(spark, sf), new_folder(spark, "summary")
    out = log.groupBy("device_id", F.floor(F.col("t") / DAY).cast("long").alias("minute")).agg(F.max("radar.movement").alias("movement"), F.round(F.avg("env.co2"), 6).alias("co2"), F.count(F.lit(1)).alias("rows"))
    logs.write_summary(out, folder)
    return logs.read_summary(spark, folder, out.schema)


@query("s6_index_clips", """
SELECT doc_id, source AS label, lang AS "group" FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def s6_index_clips(spark, sf):
    return clip_source.index_clips(views.clip_paths(spark, sf)).select("doc_id", "label", "group")


@query("s7_pending_clips", """
SELECT doc_id, md5('/clips/' || source || '/' || lang || '-' || CAST(doc_id AS VARCHAR) || '.wav' || CAST(doc_id % 1000 AS VARCHAR) || CAST(n_chars AS VARCHAR)) AS key
FROM documents WHERE doc_id % 3 <> 0""")
def s7_pending_clips(spark, sf):
    paths = views.clip_paths(spark, sf)
    cache = paths.where("doc_id % 3 = 0").select(clip_source.cache_key(F.col("path"), F.col("mtime"), F.col("size")).alias("key"))
    return clip_source.pending_clips(paths, cache).select("doc_id", "key")


def _clip_folder(spark, sf):
    """WAVE files of the embeddings, as <label>/<group>-<vec_id>.wav in a new folder, and their index."""
    folder = new_folder(spark, "clips")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    vectors = views.table(spark, sf, "embeddings").selectExpr(f"concat('{folder}/c', label, '/g', CAST(vec_id DIV 4 AS STRING), '-', CAST(vec_id AS STRING), '.wav') AS path", "transform(embedding, x -> floor(CAST(x AS DOUBLE) * 4096) / 32768) AS samples")
    clip_source.write_clips(vectors, 8000).write.format("noop").mode("overwrite").save()
    return folder, clip_source.index_clip_dir(spark, folder)


WAVES = "waves AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(x * 4096) / 32768::DOUBLE) AS samples FROM embeddings)"


@query("s6_clip_samples", f"WITH {WAVES} SELECT vec_id, 'c' || label AS label, 'g' || (vec_id // 4) AS \"group\", len(samples) AS n, round(list_sum(samples), 6) AS total, round(samples[1], 6) AS first FROM waves")
def s6_clip_samples(spark, sf):
    """WAVE files written by tasks, found in their folder and decoded."""
    _, index = _clip_folder(spark, sf)
    rows = clip_source.with_samples(index, 8000)
    vec = F.regexp_extract("path", r"-(\d+)\.wav$", 1).cast("long").alias("vec_id")
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return rows.select(vec, "label", "group", F.size("samples").alias("n"), F.round(total, 6).alias("total"), F.round(F.element_at("samples", 1).cast("double"), 6).alias("first"))


@query("s7_embedding_cache", f"WITH {WAVES} SELECT vec_id, 'c' || label AS label, round(list_avg(samples), 6) AS mean, round(list_stddev_pop(samples), 6) AS deviation, 1 AS times FROM waves")
def s7_embedding_cache(spark, sf):
    """Half the clips embedded and added to the cache, then all of them: what is there already isn't done again."""
    folder, index = _clip_folder(spark, sf)
    vec = F.regexp_extract("path", r"-(\d+)\.wav$", 1).cast("long")

    def embed(heard):
        x = F.transform("samples", lambda v: v.cast("double"))
        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size("samples")
        spread = F.aggregate(F.transform(x, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v) / F.size("samples")
        return heard.withColumn("embedding", F.array(mean, F.sqrt(spread)))

    clip_source.add_to_cache(index.where(vec % 2 == 0), f"{folder}-cache", embed, 8000)
    cache = clip_source.add_to_cache(index, f"{folder}-cache", embed, 8000)
    return cache.groupBy(vec.alias("vec_id"), "label").agg(F.round(F.first("embedding")[0], 6).alias("mean"), F.round(F.first("embedding")[1], 6).alias("deviation"), F.count(F.lit(1)).alias("times"))


# --- radar states ----------------------------------------------------------------------------------------------------


@query("p1_parse_device_states", f"WITH {RAW_STATES} SELECT * FROM parsed")
def p1_parse_device_states(spark, sf):
    return radar.parse_device_states(views.device_states(spark, sf)).select("device_id", "t", "seq", "breath", "heart", "distance", "presence")


TICKS = RAW_STATES + f""",
spans AS (
  SELECT device_id, CAST(ceil(t / {HOUR}) AS BIGINT) AS lo,
    CAST(floor(least(t + {10 * HOUR}, coalesce(lead(t) OVER (PARTITION BY device_id ORDER BY t), max(t) OVER (PARTITION BY device_id))) / {HOUR}) AS BIGINT) AS hi FROM parsed),
grid AS (SELECT DISTINCT device_id, k * {HOUR}::DOUBLE AS t FROM (SELECT device_id, unnest(range(lo, hi + 1)) AS k FROM spans WHERE lo <= hi)),
both_ AS (
  SELECT device_id, t, breath, heart, distance, presence, 0 AS tick, t AS rx FROM parsed
  UNION ALL SELECT device_id, t, NULL, NULL, NULL, NULL, 1, NULL FROM grid),
known AS (
  SELECT device_id, t, tick, last_value(breath IGNORE NULLS) OVER w AS breath, last_value(heart IGNORE NULLS) OVER w AS heart, last_value(distance IGNORE NULLS) OVER w AS distance,
    last_value(presence IGNORE NULLS) OVER w AS presence, last_value(rx IGNORE NULLS) OVER w AS rx,
    count(CASE WHEN NOT isnan(distance) THEN 1 END) OVER r AS n, max(CASE WHEN NOT isnan(distance) THEN distance END) OVER r - min(CASE WHEN NOT isnan(distance) THEN distance END) OVER r AS span
  FROM both_ WINDOW w AS (PARTITION BY device_id ORDER BY t, tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    r AS (PARTITION BY device_id ORDER BY t RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW)),
ticks AS (
  SELECT device_id, t, breath, heart, distance, coalesce(presence, true) AS presence, CASE WHEN n < 2 THEN 0.1::DOUBLE ELSE greatest(0.0, least(1.0, span / 30.0::DOUBLE)) END AS movement
  FROM known WHERE tick = 1 AND breath IS NOT NULL AND t - rx <= {10 * HOUR})"""

SMOOTH = TICKS + f""",
able AS (
  SELECT *, presence AND coalesce(distance >= 20 AND distance <= 150, false) AND movement <= 0.5::DOUBLE AS can FROM ticks),
judged AS (SELECT *, can AND NOT isnan(breath) AND breath >= 5 AND breath <= 60 AS trusted FROM able),
smoothed AS (
  SELECT *, median(CASE WHEN trusted THEN breath END) OVER (PARTITION BY device_id ORDER BY t RANGE BETWEEN {8 * HOUR} PRECEDING AND CURRENT ROW) AS smooth,
    max(CASE WHEN trusted THEN t END) OVER (PARTITION BY device_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS valid FROM judged)"""


def _ticks(spark, sf):
    return radar.sample_ticks(radar.parse_device_states(views.device_states(spark, sf)), HOUR, 10 * HOUR, 12 * HOUR)


@query("p2_sample_ticks", f"WITH {TICKS} SELECT device_id, t, breath, heart, distance, presence FROM ticks")
def p2_sample_ticks(spark, sf):
    return _ticks(spark, sf).select("device_id", "t", "breath", "heart", "distance", "presence")


@query("p3_movement", f"WITH {TICKS} SELECT device_id, t, movement FROM ticks")
def p3_movement(spark, sf):
    return _ticks(spark, sf).select("device_id", "t", "movement")


@query("p4_breath_is_trustworthy", f"WITH {SMOOTH} SELECT device_id, t, trusted FROM judged")
def p4_breath_is_trustworthy(spark, sf):
    trusted = radar.breath_is_trustworthy(F.col("breath"), F.col("distance"), F.col("presence"), F.col("movement"))
    return _ticks(spark, sf).select("device_id", "t", trusted.alias("trusted"))


@query("p5_smooth_breath", f"WITH {SMOOTH} SELECT device_id, t, smooth FROM smoothed")
def p5_smooth_breath(spark, sf):
    return radar.with_smooth_breath(_ticks(spark, sf), 8 * HOUR).select("device_id", "t", "smooth")


APNEA = SMOOTH + f""",
missing AS (SELECT *, can AND coalesce(t - valid <= {120 * HOUR} AND t - valid > 1.5, false) AS gone FROM smoothed),
new_ AS (SELECT *, CASE WHEN gone = lag(gone) OVER (PARTITION BY device_id ORDER BY t) THEN 0 ELSE 1 END AS new FROM missing),
run_ AS (SELECT *, sum(new) OVER (PARTITION BY device_id ORDER BY t) AS run FROM new_),
held AS (SELECT *, gone AND t - min(t) OVER (PARTITION BY device_id, run) >= {6 * HOUR} AS apnea FROM run_)"""


@query("p6_apnea", f"WITH {APNEA} SELECT device_id, t, apnea FROM held")
def p6_apnea(spark, sf):
    return radar.with_apnea(radar.with_smooth_breath(_ticks(spark, sf), 8 * HOUR), 6 * HOUR, 120 * HOUR).select("device_id", "t", "apnea")


@query("p7_normalize_radar", f"""WITH {APNEA}
SELECT device_id, t, CASE WHEN apnea OR smooth IS NULL THEN 0.0 ELSE smooth END AS breathing_rate, movement, presence, apnea, movement > 0.5::DOUBLE AS motion, 'mr60bha2' AS source,
       heart AS heart_rate, distance, breath AS raw_breath, smooth IS NOT NULL AS breath_valid FROM held""")
def p7_normalize_radar(spark, sf):
    return radar.normalize_radar(views.device_states(spark, sf), period_s=HOUR, stale_s=10 * HOUR, move_window_s=12 * HOUR, smooth_s=8 * HOUR, hold_s=6 * HOUR, prior_s=120 * HOUR)


@query("p8_normalize_cry_env", f"""WITH {LOG}
SELECT device_id, seq, k / 100.0::DOUBLE > 0.3::DOUBLE AS is_crying, 'none' AS cls, round(k / 100.0::DOUBLE, 2) AS confidence, CASE WHEN seq % 2 = 0 THEN 15.0::DOUBLE ELSE CAST(k AS DOUBLE) END AS lux FROM log""")
def p8_normalize_cry_env(spark, sf):
    rows = views.sensor_log(spark, sf).selectExpr("device_id", "seq", "k / 100D AS score", "CASE WHEN seq % 2 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS lux")
    return radar.normalize_env(radar.normalize_cry(rows)).drop("score")


# --- fusion ------------------------------------------------------------------------------------------------------------


def _fused(spark, sf):
    return fusion.fill_signals(views.sensor_log(spark, sf).drop("k", "event_type", "value"))


def _decided(spark, sf):
    return fusion.with_recommendations(fusion.with_sleep_state(fusion.with_decision(_fused(spark, sf))))


def _levels(spark, sf):
    return fusion.debounce(_decided(spark, sf))


@query("f1_latest_signals", f"""WITH {FUSED}
SELECT device_id, t, seq, radar.breathing_rate AS breathing_rate, radar.movement AS movement, cry.cls AS cls, cry.confidence AS confidence, env.co2 AS co2, env.temp AS temp FROM fused""")
def f1_latest_signals(spark, sf):
    return _fused(spark, sf).select("device_id", "t", "seq", "radar.breathing_rate", "radar.movement", "cry.cls", "cry.confidence", "env.co2", "env.temp")


@query("f1_tick_signals", f"""WITH {LOG},
hours AS (SELECT device_id, CAST(floor(t / 86400) AS BIGINT) AS t, radar, cry, env, seq FROM log),
r AS (SELECT device_id, t, max_by(radar.movement, seq) AS movement FROM hours WHERE radar IS NOT NULL GROUP BY ALL),
c AS (SELECT device_id, t, max_by(cry.confidence, seq) AS confidence FROM hours WHERE cry IS NOT NULL GROUP BY ALL),
e AS (SELECT device_id, t, max_by(env.co2, seq) AS co2 FROM hours WHERE env IS NOT NULL GROUP BY ALL),
j AS (SELECT * FROM r FULL JOIN c USING (device_id, t) FULL JOIN e USING (device_id, t))
SELECT device_id, t, last_value(movement IGNORE NULLS) OVER w AS movement, last_value(confidence IGNORE NULLS) OVER w AS confidence, last_value(co2 IGNORE NULLS) OVER w AS co2
FROM j WINDOW w AS (PARTITION BY device_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def f1_tick_signals(spark, sf):
    log = views.sensor_log(spark, sf).withColumn("t", F.floor(F.col("t") / 86400).cast("long"))
    part = lambda m: log.where(f"{m} IS NOT NULL").groupBy("device_id", "t").agg(F.max_by(m, "seq").alias(m))
    return fusion.tick_signals(part("radar"), part("cry"), part("env")).select("device_id", "t", "radar.movement", "cry.confidence", "env.co2")


@query("f2_decision", f"WITH {FUSED} SELECT device_id, seq, raw_level, raw_reasons AS reasons FROM decided")
def f2_decision(spark, sf):
    return fusion.with_decision(_fused(spark, sf)).select("device_id", "seq", "raw_level", "reasons")


SINGLE = "CASE WHEN coalesce(cry.is_crying, false) OR ap OR mv > 0.5::DOUBLE OR coalesce(env.co2, 0) > 800 THEN 'alert' ELSE 'normal' END"


@query("f3_single_sensor", f"WITH {FUSED} SELECT device_id, seq, {SINGLE} AS single_sensor FROM rules")
def f3_single_sensor(spark, sf):
    return fusion.with_single_sensor(_fused(spark, sf)).select("device_id", "seq", "single_sensor")


POLICIES = FUSED + f""",
policies AS (
  SELECT *, {SINGLE} AS single_sensor, CASE WHEN r1 THEN 'alert' ELSE 'normal' END AS radar_only, CASE WHEN cf THEN 'alert' ELSE 'normal' END AS audio_only,
    CASE WHEN bad OR r6 THEN 'alert' ELSE 'normal' END AS env_only, raw_level AS full_fusion, CASE WHEN cf THEN 'attention' ELSE 'normal' END AS cry_rules,
    CASE WHEN bad OR r6 THEN 'attention' ELSE 'normal' END AS env_rules, seq % 10 < 3 AS expected FROM decided)"""


@query("f4_policies", f"WITH {POLICIES} SELECT device_id, seq, single_sensor, radar_only, audio_only, env_only, full_fusion, cry_rules, env_rules FROM policies")
def f4_policies(spark, sf):
    names = (*fusion.POLICIES, "cry_rules", "env_rules")
    return fusion.with_policies(_fused(spark, sf), names).select("device_id", "seq", *names)


@query("f5_sleep_state", f"WITH {FUSED} SELECT device_id, seq, sleep_state, sleep_reason FROM decided")
def f5_sleep_state(spark, sf):
    return fusion.with_sleep_state(_fused(spark, sf)).select("device_id", "seq", "sleep_state", "sleep_reason")


@query("f6_recommendations", f"WITH {FUSED} SELECT device_id, seq, actions FROM advised")
def f6_recommendations(spark, sf):
    return _decided(spark, sf).select("device_id", "seq", "actions")


@query("f7_debounce", f"WITH {LEVELS} SELECT device_id, seq, raw_level, level FROM levels")
def f7_debounce(spark, sf):
    return _levels(spark, sf).select("device_id", "seq", "raw_level", "level")


@query("f8_emit_alerts", f"WITH RECURSIVE {ALERTS} SELECT * FROM alerts")
def f8_emit_alerts(spark, sf):
    return fusion.emit_alerts(_levels(spark, sf), DAY)


#: With four places, means of values with two have no half at the end that both sides would have to round alike.
ALPHA = 0.0473


def series_sql(source: str, rate: str, movement: str, keys: str = "device_id", alpha: float = 0.05) -> str:
    """Common tables that end in `series`: the baseline after each row of source, one after the other."""
    same = " AND ".join(f"n.{k} = e.{k}" for k in keys.split(", "))
    return f"""numbered_ AS (SELECT *, {rate} AS x_, {movement} AS m_, row_number() OVER (PARTITION BY {keys} ORDER BY t, seq) AS i_ FROM {source}),
ema_ AS (
  SELECT {keys}, t, seq, i_ AS samples, CASE WHEN x_ > 0 THEN x_ END AS mean, 0.0::DOUBLE AS var, m_ AS move FROM numbered_ WHERE i_ = 1
  UNION ALL
  SELECT {", ".join(f"n.{k}" for k in keys.split(", "))}, n.t, n.seq, n.i_, CASE WHEN n.x_ > 0 THEN coalesce(e.mean + {alpha}::DOUBLE * (n.x_ - e.mean), n.x_) ELSE e.mean END,
    CASE WHEN n.x_ > 0 AND e.mean IS NOT NULL THEN {1 - alpha}::DOUBLE * (e.var + {alpha}::DOUBLE * pow(n.x_ - e.mean, 2)) ELSE e.var END,
    CASE WHEN n.m_ IS NOT NULL THEN coalesce(e.move + {alpha}::DOUBLE * (n.m_ - e.move), n.m_) ELSE e.move END
  FROM ema_ e JOIN numbered_ n ON {same} AND n.i_ = e.samples + 1),
series AS (SELECT {keys}, t, seq, samples, mean AS bpm_mean, mean - 2 * sqrt(var) AS bpm_low, mean + 2 * sqrt(var) AS bpm_high, greatest(0.4, coalesce(move, 0.1) * 2 + 0.2) AS restless_threshold FROM ema_)"""


@query("f9_baseline_series", f"""WITH RECURSIVE {RADAR}, {series_sql("radar_log", "breathing_rate", "movement", alpha=ALPHA)}
SELECT device_id, t, seq, samples, round(bpm_mean, 6) AS bpm_mean, round(bpm_low, 6) AS bpm_low, round(bpm_high, 6) AS bpm_high, round(restless_threshold, 6) AS restless_threshold FROM series""")
def f9_baseline_series(spark, sf):
    out = baseline.personal_baseline_series(views.radar_log(spark, sf), ALPHA, chunk_s=10 * DAY)
    return out.withColumns({c: F.round(c, 6) for c in ("bpm_mean", "bpm_low", "bpm_high", "restless_threshold")})


@query("f9_per_message", f"""WITH RECURSIVE {FUSED}, fed AS (SELECT device_id, t, seq, radar.breathing_rate AS breathing_rate, radar.movement AS movement FROM fused WHERE radar IS NOT NULL), {series_sql("fed", "breathing_rate", "movement", alpha=ALPHA)}
SELECT device_id, t, seq, samples, round(bpm_mean, 6) AS bpm_mean, round(bpm_low, 6) AS bpm_low, round(bpm_high, 6) AS bpm_high, round(restless_threshold, 6) AS restless_threshold FROM series""")
def f9_per_message(spark, sf):
    """The baseline that every message feeds with the latest reading."""
    out = baseline.fused_baseline_series(_fused(spark, sf), True, ALPHA, chunk_s=10 * DAY)
    return out.withColumns({c: F.round(c, 6) for c in ("bpm_mean", "bpm_low", "bpm_high", "restless_threshold")})


def baseline_sql(source: str, table: str, keys: str, order: str, alpha: float) -> str:
    back = ", ".join(f"{c} DESC" for c in order.split(", "))

    def weighted(value: str, where: str, name: str) -> str:
        return f"""{name}_w AS (
  SELECT *, CASE WHEN i = n - 1 THEN pow({1 - alpha}::DOUBLE, i) ELSE pow({1 - alpha}::DOUBLE, i) * {alpha}::DOUBLE END AS w FROM (
    SELECT {keys}, {value} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY {back}) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {table} WHERE {where})),
{name}_m AS (SELECT {keys}, sum(w * x) AS mean, sum(w * x * x) - sum(w * x) * sum(w * x) AS var FROM {name}_w GROUP BY {keys})"""

    return f"""WITH {source},
{weighted("breathing_rate", "breathing_rate > 0", "bpm")},
{weighted("movement", "movement IS NOT NULL", "mv")},
samples AS (SELECT {keys}, count(*) AS samples FROM {table} GROUP BY {keys})"""


@query("f10_personal_baseline", baseline_sql(RADAR, "radar_log", "device_id", "t, seq", 0.05) + """
SELECT s.device_id, s.samples, round(b.mean, 6) AS bpm_mean, round(b.mean - 2 * sqrt(greatest(b.var, 0)), 4) AS bpm_low, round(b.mean + 2 * sqrt(greatest(b.var, 0)), 4) AS bpm_high,
       round(greatest(0.4, coalesce(m.mean, 0.1) * 2 + 0.2), 6) AS restless_threshold
FROM samples s LEFT JOIN bpm_m b USING (device_id) LEFT JOIN mv_m m USING (device_id)""")
def f10_personal_baseline(spark, sf):
    out = baseline.personal_baseline(views.radar_log(spark, sf))
    digits = {"bpm_mean": 6, "bpm_low": 4, "bpm_high": 4, "restless_threshold": 6}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("f11_fusion_states", f"""WITH {LEVELS}
SELECT device_id, t, seq, level, raw_level, CASE WHEN level <> 'normal' THEN raw_reasons ELSE CAST([] AS VARCHAR[]) END AS reasons, sleep_state AS state, sleep_reason AS reason, actions FROM levels""")
def f11_fusion_states(spark, sf):
    return fusion.fusion_states(_fused(spark, sf)).select("device_id", "t", "seq", "level", "raw_level", "reasons", "sleep.state", "sleep.reason", "actions")


@query("f11_control_actions", f"WITH {FUSED} SELECT device_id, t, seq, actions FROM advised WHERE len(actions) > 0")
def f11_control_actions(spark, sf):
    return fusion.control_actions(_decided(spark, sf))


@query("f12_status_board", f"""WITH RECURSIVE {ALERTS},
shown AS (SELECT *, CASE WHEN level = 'normal' AND here AND NOT ok THEN 'unmeasurable' ELSE level END AS display FROM levels),
newest AS (SELECT device_id, max(t) AS last_ts, arg_max(level, t * 1000 + seq % 1000) AS level, arg_max(display, t * 1000 + seq % 1000) AS display, count(*) AS messages FROM shown GROUP BY device_id),
rates AS (SELECT device_id, list(radar.breathing_rate ORDER BY n DESC) AS breathing FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t DESC, seq DESC) AS n FROM levels WHERE topic = 'sensor/radar') WHERE n <= 60 GROUP BY device_id),
last_ AS (SELECT device_id, list('[' || upper(level) || '] ' || reason ORDER BY n) AS events FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t DESC, seq DESC) AS n FROM alerts) WHERE n <= 12 GROUP BY device_id)
SELECT n.*, coalesce(r.breathing, CAST([] AS DOUBLE[])) AS breathing, coalesce(l.events, CAST([] AS VARCHAR[])) AS events FROM newest n LEFT JOIN rates r USING (device_id) LEFT JOIN last_ l USING (device_id)""")
def f12_status_board(spark, sf):
    levels = _levels(spark, sf)
    return fusion.status_board(levels, fusion.emit_alerts(levels, DAY))


@query("f12_latest_per_topic", f"WITH {LOG} SELECT device_id, topic, max(seq) AS payload, max(t) AS last_ts FROM log GROUP BY ALL")
def f12_latest_per_topic(spark, sf):
    return fusion.latest_per_topic(views.sensor_log(spark, sf).withColumn("payload", F.col("seq")))


# --- a device that sends a third of all rows, by chunks of time ------------------------------------------------------------

CHUNK_S = 5 * DAY
HOT = lambda sql: sql.replace("user_id AS device_id", "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS device_id")


def _hot_log(spark, sf):
    return views.sensor_log(spark, sf).withColumn("device_id", F.when(F.col("seq") % 3 == 0, 0).otherwise(F.col("device_id")))


def _hot_levels(spark, sf):
    filled = fusion.fill_signals(_hot_log(spark, sf).drop("k", "event_type", "value"), chunk_s=CHUNK_S)
    return fusion.debounce(fusion.with_decision(filled), chunk_s=CHUNK_S)


@query("f1_hot_device", f"""WITH {HOT(FUSED)}
SELECT device_id, t, seq, radar.breathing_rate AS breathing_rate, cry.cls AS cls, cry.confidence AS confidence, env.co2 AS co2 FROM fused""")
def f1_hot_device(spark, sf):
    rows = fusion.fill_signals(_hot_log(spark, sf), chunk_s=CHUNK_S)
    return rows.select("device_id", "t", "seq", "radar.breathing_rate", "cry.cls", "cry.confidence", "env.co2")


@query("f7_hot_device", f"WITH {HOT(LEVELS)} SELECT device_id, seq, raw_level, level FROM levels")
def f7_hot_device(spark, sf):
    return _hot_levels(spark, sf).select("device_id", "seq", "raw_level", "level")


@query("f8_hot_device", f"WITH RECURSIVE {HOT(ALERTS)} SELECT * FROM alerts")
def f8_hot_device(spark, sf):
    return fusion.emit_alerts(_hot_levels(spark, sf), DAY, chunk_s=CHUNK_S)


@query("ep1_hot_device", HOT(episode_sql(RADAR, "apnea OR motion", "device_id", 600.0, HOUR, "SELECT * FROM eps")))
def ep1_hot_device(spark, sf):
    rows = _hot_log(spark, sf).where("radar IS NOT NULL").select("device_id", "t", "seq", "radar.*")
    return timeline.episodes(rows, F.col("apnea") | F.col("motion"), ["device_id"], 600.0, HOUR, seq=["seq"], chunk_s=CHUNK_S)


@query("p2_hot_device", HOT(f"WITH {TICKS} SELECT device_id, t, breath, heart, distance, presence, movement FROM ticks"))
def p2_hot_device(spark, sf):
    states = views.device_states(spark, sf).withColumn("device_id", F.when(F.col("seq") % 3 == 0, 0).otherwise(F.col("device_id")))
    return radar.sample_ticks(radar.parse_device_states(states), HOUR, 10 * HOUR, 12 * HOUR, chunk_s=CHUNK_S).select("device_id", "t", "breath", "heart", "distance", "presence", "movement")


@query("r1_hot_device", HOT(f"""WITH {STATES},
numbered AS (SELECT *, row_number() OVER w - 1 AS place, state = 'awake' AND coalesce(lag(state) OVER w, '') <> 'awake' AS woke, row_number() OVER w - row_number() OVER (PARTITION BY device_id, state ORDER BY minute) AS run
  FROM states WINDOW w AS (PARTITION BY device_id ORDER BY minute)),
runs_ AS (SELECT device_id, max(n) AS longest_calm FROM (SELECT device_id, run, count(*) AS n FROM numbered WHERE state = 'calm_sleep' GROUP BY device_id, run) GROUP BY device_id)
SELECT n.device_id, count(*) AS minutes, CAST(sum(CAST(woke AS INTEGER)) AS BIGINT) AS awakenings, coalesce(any_value(r.longest_calm), 0) AS longest_calm, CAST(coalesce(sum(place // 60) FILTER (woke), 0) AS BIGINT) AS hours
FROM numbered n LEFT JOIN runs_ r USING (device_id) GROUP BY n.device_id"""))
def r1_hot_device(spark, sf):
    states = views.minute_states(spark, sf).withColumn("device_id", F.when(F.col("minute") % 3 == 0, 0).otherwise(F.col("device_id")))
    nightly = rhythm.night_rhythm(states, ["device_id"], chunk_s=1000.0)
    hours = F.aggregate("wake_hours", F.lit(0).cast("long"), lambda a, x: a + x)
    return nightly.select("device_id", "minutes", "awakenings", "longest_calm", hours.alias("hours"))


# --- night report ------------------------------------------------------------------------------------------------------

GAP = 10 * HOUR
LIMITS = {"gap_s": GAP, "exit_min_s": 1.0, "move_min_s": HOUR, "move_merge_s": DAY}
KEY = "device_id, night_id"
STEPS = RADAR + ",\nsteps AS (SELECT *, t - lag(t) OVER (PARTITION BY device_id, night_id ORDER BY t, seq) AS step, lag(t) OVER (PARTITION BY device_id, night_id ORDER BY t, seq) AS before FROM radar_log)"
COVERAGE = f"""SELECT device_id, night_id, count(*) AS rows, min(t) AS start_ts, max(t) AS end_ts, CAST(coalesce(sum(CASE WHEN step > {GAP} THEN 1 END), 0) AS BIGINT) AS gaps,
  coalesce(sum(CASE WHEN step > {GAP} THEN step END), 0) AS gap_total_s,
  CASE WHEN max(t) > min(t) THEN 1 - coalesce(sum(CASE WHEN step > {GAP} THEN step END), 0) / (max(t) - min(t)) ELSE 0 END AS coverage FROM steps GROUP BY device_id, night_id"""


@query("n1_min_rows", f"WITH {STEPS} SELECT device_id, night_id FROM radar_log GROUP BY ALL HAVING count(*) >= 10")
def n1_min_rows(spark, sf):
    return night.night_report(views.radar_log(spark, sf), min_rows=10, **LIMITS).select("device_id", "night_id")


@query("n2_collection_gaps", f"WITH {STEPS} SELECT device_id, night_id, before AS gap_start, t AS gap_end, step AS gap_s FROM steps WHERE step > {GAP}")
def n2_collection_gaps(spark, sf):
    return night.collection_gaps(views.radar_log(spark, sf), GAP)


@query("n3_coverage", f"WITH {STEPS} SELECT * REPLACE (round(coverage, 9) AS coverage, round(gap_total_s, 4) AS gap_total_s) FROM ({COVERAGE})")
def n3_coverage(spark, sf):
    return night.coverage(views.radar_log(spark, sf), GAP).withColumns({"coverage": F.round("coverage", 9), "gap_total_s": F.round("gap_total_s", 4)})


@query("n4_presence", f"WITH {RADAR} SELECT device_id, night_id, round(avg(CAST(presence AS INTEGER)), 9) AS presence_ratio FROM radar_log GROUP BY ALL")
def n4_presence(spark, sf):
    return night.presence_stats(views.radar_log(spark, sf)).withColumn("presence_ratio", F.round("presence_ratio", 9))


@query("n4_exit_episodes", episode_sql(RADAR, "NOT presence", KEY, 1.0, 0, "SELECT * FROM eps"))
def n4_exit_episodes(spark, sf):
    return night.exit_episodes(views.radar_log(spark, sf), 1.0)


@query("ep1_episodes", episode_sql(RADAR, "apnea OR motion", "device_id", 2 * HOUR, 2 * DAY, "SELECT * FROM eps"))
def ep1_episodes(spark, sf):
    return timeline.episodes(views.radar_log(spark, sf), F.col("apnea") | F.col("motion"), ["device_id"], 2 * HOUR, 2 * DAY, seq=["seq"])


MOVING = "coalesce(motion, false) OR movement > 0.5::DOUBLE"


@query("n6_movement_episodes", episode_sql(RADAR, MOVING, KEY, HOUR, DAY, "SELECT * FROM eps"))
def n6_movement_episodes(spark, sf):
    return night.movement_episodes(views.radar_log(spark, sf), HOUR, DAY)


def breath_sql(keys: str) -> str:
    place = lambda i: f"greatest(1, least((n * {i} + {i}) // 10, n - 1))"
    q = lambda i: f"sum(CASE WHEN i = {place(i)} THEN x * (1 - ({i} * (n + 1) - {place(i)} * 10) / 10.0::DOUBLE) WHEN i = {place(i)} + 1 THEN x * (({i} * (n + 1) - {place(i)} * 10) / 10.0::DOUBLE) END)"
    return f"""SELECT {keys}, count(*) AS samples, CASE WHEN count(*) >= 10 THEN round(median(x), 6) END AS median, CASE WHEN count(*) >= 10 THEN round({q(1)}, 6) END AS p10, CASE WHEN count(*) >= 10 THEN round({q(9)}, 6) END AS p90
FROM (SELECT {keys}, breathing_rate AS x, row_number() OVER (PARTITION BY {keys} ORDER BY breathing_rate) AS i, count(*) OVER (PARTITION BY {keys}) AS n
  FROM radar_log WHERE presence AND NOT motion AND breathing_rate >= 5 AND breathing_rate <= 60) GROUP BY {keys}"""


@query("n5_breathing_distribution", f"WITH {RADAR} {breath_sql('device_id')}")
def n5_breathing_distribution(spark, sf):
    return night.breathing_distribution(views.radar_log(spark, sf), ["device_id"]).withColumns({c: F.round(c, 6) for c in ("median", "p10", "p90")})


@query("n7a_night_alerts", f"""WITH RECURSIVE {ALERTS}
SELECT device_id, t, seq, nth, level, reason, total, level_total FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY device_id ORDER BY t, seq) AS INTEGER) AS nth, count(*) OVER (PARTITION BY device_id) AS total, count(*) OVER (PARTITION BY device_id, level) AS level_total FROM alerts) WHERE nth <= 20""")
def n7a_night_alerts(spark, sf):
    return night.night_alerts(fusion.emit_alerts(_levels(spark, sf), DAY), keys=["device_id"])


@query("n7b_sleep_state_share", f"""WITH {FUSED}
SELECT device_id, night_id, sleep_state, count(*) AS rows, count(*) / sum(count(*)) OVER (PARTITION BY device_id, night_id) AS share FROM decided GROUP BY device_id, night_id, sleep_state""")
def n7b_sleep_state_share(spark, sf):
    return night.sleep_state_share(_decided(spark, sf))


@query("n7c_baseline_convergence", f"""WITH {RADAR},
placed AS (SELECT device_id, seq, movement AS bpm_low, row_number() OVER (PARTITION BY device_id ORDER BY t, seq) - 1 AS i, count(*) OVER (PARTITION BY device_id) AS n FROM radar_log WHERE presence)
SELECT device_id, seq, bpm_low, stage FROM (SELECT *, '1_first' AS stage FROM placed WHERE i = 0 UNION ALL SELECT *, '2_middle' FROM placed WHERE i = n // 2 UNION ALL SELECT *, '3_last' FROM placed WHERE i = n - 1)""")
def n7c_baseline_convergence(spark, sf):
    rows = views.radar_log(spark, sf).withColumn("bpm_low", F.when(F.col("presence"), F.col("movement")))
    return night.baseline_convergence(rows, ["device_id"]).select("device_id", "seq", "bpm_low", "stage")


@query("n7d_night_header", f"WITH {RADAR} SELECT device_id, night_id, list_sort(list(DISTINCT source)) AS sources, round((max(t) - min(t)) / 3600, 9) AS span_h, count(*) AS rows FROM radar_log GROUP BY device_id, night_id")
def n7d_night_header(spark, sf):
    return night.night_header(views.radar_log(spark, sf)).withColumn("span_h", F.round("span_h", 9))


EXITS = episode_sql(RADAR, "NOT presence", KEY, 1.0, 0, f"SELECT {KEY}, count(*) AS exits, sum(duration_s) AS exit_s FROM eps GROUP BY ALL")
MOVES = episode_sql(RADAR, MOVING, KEY, HOUR, DAY, f"SELECT {KEY}, count(*) AS movements, sum(duration_s) AS movement_s FROM eps GROUP BY ALL")
GAP_LIST = f"WITH {STEPS} SELECT {KEY}, list(struct_pack(a := before, b := t) ORDER BY t, seq) AS gap_list FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY t, seq) AS n FROM steps WHERE step > {GAP}) WHERE n <= 10 GROUP BY {KEY}"
EXIT_LIST = episode_sql(RADAR, "NOT presence", KEY, 1.0, 0, f"SELECT {KEY}, list(struct_pack(a := start_ts, b := end_ts) ORDER BY start_ts) AS exit_list FROM eps GROUP BY {KEY}")
MOVE_LIST = episode_sql(RADAR, MOVING, KEY, HOUR, DAY, f"SELECT {KEY}, list(struct_pack(a := start_ts, b := end_ts) ORDER BY start_ts)[:30] AS move_list FROM eps GROUP BY {KEY}")
#: All parts of the report, joined: alerts have the night that they fall in, baselines start anew each night.
REPORT = f"""cov AS (WITH {STEPS} {COVERAGE}), dist AS (WITH {RADAR} {breath_sql(KEY)}), exits_ AS ({EXITS}), moves AS ({MOVES}),
pres AS (WITH {RADAR} SELECT {KEY}, avg(CAST(presence AS INTEGER)) AS presence_ratio, list_sort(list(DISTINCT source)) AS sources, (max(t) - min(t)) / 3600 AS span_h FROM radar_log GROUP BY {KEY}),
gap_lists AS ({GAP_LIST}), exit_lists AS ({EXIT_LIST}), move_lists AS ({MOVE_LIST}),
sent AS (WITH RECURSIVE {ALERTS} SELECT {KEY}, sum(n) AS alerts, array_to_string(list_sort(list(n || ' ' || level)), ', ') AS alert_levels FROM (
  SELECT device_id, CAST(floor(t / 864000) AS BIGINT) AS night_id, level, count(*) AS n FROM alerts GROUP BY ALL) GROUP BY {KEY}),
sent_lists AS (WITH RECURSIVE {ALERTS} SELECT {KEY}, list(struct_pack(t := t, level := level, reason := reason) ORDER BY t, seq)[:20] AS alert_list FROM (
  SELECT *, CAST(floor(t / 864000) AS BIGINT) AS night_id FROM alerts) GROUP BY {KEY}),
share AS (WITH {FUSED} SELECT {KEY}, list(struct_pack(state := sleep_state, share := share) ORDER BY sleep_state) AS sleep FROM (
  SELECT {KEY}, sleep_state, count(*) / sum(count(*)) OVER (PARTITION BY {KEY}) AS share FROM decided GROUP BY {KEY}, sleep_state) GROUP BY {KEY}),
ranges AS (WITH RECURSIVE {RADAR}, {series_sql("radar_log", "breathing_rate", "movement", KEY)},
  known AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY t, seq) - 1 AS i, count(*) OVER (PARTITION BY {KEY}) AS n FROM series WHERE bpm_low IS NOT NULL)
  SELECT {KEY}, list(struct_pack(low := bpm_low, high := bpm_high, t := t, samples := samples) ORDER BY stage) AS normal FROM (
    SELECT *, 1 AS stage FROM known WHERE i = 0 UNION ALL SELECT *, 2 FROM known WHERE i = n // 2 UNION ALL SELECT *, 3 FROM known WHERE i = n - 1) GROUP BY {KEY}),
report AS (
  SELECT c.*, p.presence_ratio, p.sources, p.span_h, coalesce(x.exits, 0) AS exits, coalesce(x.exit_s, 0) AS exit_s, coalesce(m.movements, 0) AS movements, coalesce(m.movement_s, 0) AS movement_s,
    coalesce(d.samples, 0) AS samples, d.median, d.p10, d.p90, CAST(coalesce(a.alerts, 0) AS BIGINT) AS alerts, a.alert_levels, s.sleep, r.normal,
    gl.gap_list, xl.exit_list, ml.move_list, al.alert_list
  FROM cov c JOIN pres p USING ({KEY}) LEFT JOIN exits_ x USING ({KEY}) LEFT JOIN moves m USING ({KEY}) LEFT JOIN dist d USING ({KEY}) LEFT JOIN sent a USING ({KEY}) LEFT JOIN share s USING ({KEY}) LEFT JOIN ranges r USING ({KEY})
    LEFT JOIN gap_lists gl USING ({KEY}) LEFT JOIN exit_lists xl USING ({KEY}) LEFT JOIN move_lists ml USING ({KEY}) LEFT JOIN sent_lists al USING ({KEY})
  WHERE c.rows >= 10)"""


def night_report(spark, sf):
    """The events are read once: levels and states are written, and radar, alerts and states are told from them."""
    rows = _levels(spark, sf).select("device_id", "night_id", "t", "seq", "topic", "radar", "level", "reasons", "sleep_state")
    levels = written(rows, "levels")
    radar_log = levels.where("topic = 'sensor/radar'").select("device_id", "night_id", "t", "seq", "radar.*")
    alerts = fusion.emit_alerts(levels, DAY).withColumn("night_id", F.floor(F.col("t") / 864000).cast("long"))
    return night.night_report(radar_log, alerts, levels, min_rows=10, baseline_alpha=0.05, **LIMITS)


@query("n8_night_report", f"""WITH RECURSIVE {REPORT}
SELECT device_id, night_id, rows, gaps, round(coverage, 9) AS coverage, round(presence_ratio, 9) AS presence_ratio, sources, exits, round(exit_s, 4) AS exit_s, movements, round(movement_s, 4) AS movement_s, samples, median, p10, p90,
  alerts, alert_levels, list_transform(sleep, lambda e: e.state) AS states, list_transform(sleep, lambda e: round(e.share, 9)) AS shares,
  list_transform(normal, lambda e: round(e.low, 6)) AS normal_low, list_transform(normal, lambda e: round(e.high, 6)) AS normal_high,
  list_transform(normal, lambda e: e.samples) AS normal_samples, coalesce(list_transform(gap_list, lambda e: e.a), []) AS gap_starts, coalesce(list_transform(gap_list, lambda e: e.b), []) AS gap_ends,
  coalesce(list_transform(exit_list, lambda e: e.a), []) AS exit_starts, coalesce(list_transform(exit_list, lambda e: e.b), []) AS exit_ends,
  coalesce(list_transform(move_list, lambda e: e.a), []) AS move_starts, coalesce(list_transform(move_list, lambda e: e.b), []) AS move_ends,
  coalesce(list_transform(alert_list, lambda e: e.t), []) AS alert_times, coalesce(list_transform(alert_list, lambda e: e.level || ': ' || e.reason), CAST([] AS VARCHAR[])) AS alert_texts FROM report""")
def n8_night_report(spark, sf):
    digits = {"coverage": 9, "presence_ratio": 9, "exit_s": 4, "movement_s": 4, "median": 6, "p10": 6, "p90": 6}
    out = night_report(spark, sf).withColumns({c: F.round(c, n) for c, n in digits.items()}).withColumns({
        "states": F.map_keys("sleep_share"),
        "shares": F.transform(F.map_values("sleep_share"), lambda x: F.round(x, 9)),
        "normal_low": F.transform(F.map_values("normal_range"), lambda e: F.round(e["bpm_low"], 6)),
        "normal_high": F.transform(F.map_values("normal_range"), lambda e: F.round(e["bpm_high"], 6)),
        "normal_samples": F.transform(F.map_values("normal_range"), lambda e: e["samples"]),
        **{f"{a}_{b}s": F.col(f"{a}_list")[b] for a in ("gap", "exit", "move") for b in ("start", "end")},
        "alert_times": F.coalesce(F.transform("alert_list", lambda a: a["t"]), F.array().cast("array<double>")),
        "alert_texts": F.coalesce(F.transform("alert_list", lambda a: F.concat(a["level"], F.lit(": "), a["reason"])), F.array().cast("array<string>")),
    })
    return out.select("device_id", "night_id", "rows", "gaps", "coverage", "presence_ratio", "sources", "exits", "exit_s", "movements", "movement_s", "samples", "median", "p10", "p90", "alerts", "alert_levels", "states", "shares", "normal_low", "normal_high", "normal_samples", "gap_starts", "gap_ends", "exit_starts", "exit_ends", "move_starts", "move_ends", "alert_times", "alert_texts")


def _fixed(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', round({value}, {digits}))"


def _lines_sql(name: str, line: str) -> str:
    return f"CASE WHEN len({name}) > 0 THEN array_to_string(list_transform({name}, lambda e: '  - ' || {line}), chr(10)) END"


def _clock(value: str) -> str:
    return f"strftime(to_timestamp({value}) AT TIME ZONE 'UTC', '%H:%M:%S')"


def _span_sql(value: str, digits: int, unit: str) -> str:
    return f"{_clock('e.a')} || ' to ' || {_clock('e.b')} || ' (' || {_fixed(value, digits)} || ' {unit})'"


TEXT = f"""SELECT device_id, night_id, array_to_string(list_filter([
  '# Night report ' || device_id || ' / ' || night_id,
  '- span: ' || strftime(to_timestamp(start_ts) AT TIME ZONE 'UTC', '%H:%M:%S') || ' to ' || strftime(to_timestamp(end_ts) AT TIME ZONE 'UTC', '%H:%M:%S') || ' (' || {_fixed("span_h", 1)} || ' h), ' || rows || ' radar rows',
  '- sources: ' || array_to_string(sources, ', '),
  '- coverage ' || {_fixed("coverage * 100", 2)} || '% (' || gaps || ' gaps, ' || {_fixed("gap_total_s", 0)} || ' s)',
  {_lines_sql("gap_list", _span_sql("e.b - e.a", 0, "s"))},
  '- presence ' || {_fixed("presence_ratio * 100", 1)} || '%, ' || exits || ' exits (' || {_fixed("exit_s", 0)} || ' s)',
  {_lines_sql("exit_list", _span_sql("(e.b - e.a) / 60", 1, "min"))},
  CASE WHEN median IS NOT NULL THEN '- breathing ' || {_fixed("median", 1)} || ' /min (p10 ' || {_fixed("p10", 1)} || ', p90 ' || {_fixed("p90", 1)} || ', ' || samples || ' samples)' ELSE '- too few breathing samples (' || samples || ')' END,
  '- ' || movements || ' movement episodes',
  {_lines_sql("move_list", _span_sql("e.b - e.a", 0, "s"))},
  CASE WHEN alerts > 0 THEN '- ' || alerts || ' alerts: ' || alert_levels ELSE '- no alerts' END,
  {_lines_sql("alert_list", _clock("e.t") + " || ' [' || e.level || '] ' || e.reason")},
  '- sleep: ' || array_to_string(list_transform(sleep, lambda e: e.state || ' ' || {_fixed("e.share * 100", 1)} || '%'), ', '),
  '- normal breathing: ' || array_to_string(list_transform(normal, lambda e: {_fixed("e.low", 1)} || ' to ' || {_fixed("e.high", 1)} || ' (' || {_clock("e.t")} || ', ' || e.samples || ' samples)'), ', then '),
  '> A functional summary, not a medical finding.'], lambda x: x IS NOT NULL), chr(10)) AS text FROM report"""


@query("n8_report_text", f"WITH RECURSIVE {REPORT} {TEXT}")
def n8_report_text(spark, sf):
    return night.report_text(night_report(spark, sf)).select("device_id", "night_id", "text")


@query("s8_night_report_sink", f"WITH RECURSIVE {REPORT} {TEXT}")
def s8_night_report_sink(spark, sf):
    """The reports' texts, written by night and read again."""
    folder = new_folder(spark, "reports")
    logs.write_night_report(night.report_text(night_report(spark, sf)), folder)
    return spark.read.schema("device_id long, night_id long, text string").parquet(folder)


# --- minutes, cry context, rhythm ----------------------------------------------------------------------------------------


@query("m1_minute_features", f"""WITH {LOG}
SELECT device_id, CAST(floor(t / {DAY}) AS BIGINT) AS minute, round(avg(CASE WHEN radar.breath_valid AND radar.breathing_rate > 0 THEN radar.breathing_rate END), 6) AS breathing_rate,
  CAST(max(CASE WHEN coalesce(cry.is_crying, false) AND coalesce(cry.confidence, 0) >= 0.7::DOUBLE THEN 1 ELSE 0 END) AS INTEGER) AS cry, CAST(max(CASE WHEN coalesce(radar.apnea, false) THEN 1 ELSE 0 END) AS INTEGER) AS apnea,
  max(radar.movement) AS movement, round(avg(env.co2), 6) AS co2, round(avg(env.temp), 6) AS temp, round(avg(env.humidity), 6) AS humidity FROM log GROUP BY device_id, floor(t / {DAY})""")
def m1_minute_features(spark, sf):
    out = minutes.minute_features(views.sensor_log(spark, sf), size_s=DAY)
    return out.withColumns({c: F.round(c, 6) for c in ("breathing_rate", "co2", "temp", "humidity")})


def onset_sql(flag: str) -> str:
    return f"SELECT device_id, sum(CASE WHEN {flag} = 1 AND coalesce(before, 0) = 0 THEN 1 ELSE 0 END) AS n FROM (SELECT *, lag({flag}) OVER (PARTITION BY device_id ORDER BY minute) AS before FROM minutes) GROUP BY device_id"


@query("m2_onsets", f"WITH {MINUTES} SELECT c.device_id, CAST(c.n AS BIGINT) AS cry_events, CAST(a.n AS BIGINT) AS apnea_events FROM ({onset_sql('cry')}) c JOIN ({onset_sql('apnea')}) a USING (device_id)")
def m2_onsets(spark, sf):
    rows, order = views.minutes(spark, sf), {"keys": ["device_id"], "ts": "minute"}
    cry = timeline.count_onsets(rows, F.col("cry") > 0, name="cry_events", **order)
    return cry.join(timeline.count_onsets(rows, F.col("apnea") > 0, name="apnea_events", **order), "device_id")


CALM = """calm_ AS (SELECT *, cry = 0 AND apnea = 0 AND movement < 0.3::DOUBLE AS calm FROM minutes),
calm_runs AS (SELECT device_id, minute - row_number() OVER (PARTITION BY device_id ORDER BY minute) AS g FROM calm_ WHERE calm),
longest_calm AS (SELECT device_id, max(n) AS n FROM (SELECT device_id, g, count(*) AS n FROM calm_runs GROUP BY device_id, g) GROUP BY device_id)"""


@query("m3_longest_calm", f"WITH {MINUTES}, {CALM} SELECT d.device_id, coalesce(c.n, 0) AS longest FROM (SELECT DISTINCT device_id FROM minutes) d LEFT JOIN longest_calm c USING (device_id)")
def m3_longest_calm(spark, sf):
    calm = (F.col("cry") == 0) & (F.col("apnea") == 0) & (F.col("movement") < 0.3)
    return timeline.longest_run(views.minutes(spark, sf), calm, ["device_id"], "minute")


@query("m4_night_summary", baseline_sql(MINUTES, "minutes", "device_id", "minute", 0.02) + f""", {CALM},
cry_n AS ({onset_sql("cry")}), apnea_n AS ({onset_sql("apnea")}),
base AS (SELECT device_id, count(*) AS monitored_min, sum(cry) AS cry_minutes, round(avg(CASE WHEN apnea = 0 THEN breathing_rate END), 6) AS avg_bpm, min(CASE WHEN apnea = 0 THEN breathing_rate END) AS bpm_min,
  max(CASE WHEN apnea = 0 THEN breathing_rate END) AS bpm_max, min(co2) AS co2_min, max(co2) AS co2_max, min(temp) AS temp_min, max(temp) AS temp_max FROM minutes GROUP BY device_id)
SELECT b.device_id, b.monitored_min, CAST(b.cry_minutes AS BIGINT) AS cry_minutes, b.avg_bpm, b.bpm_min, b.bpm_max, b.co2_min, b.co2_max, b.temp_min, b.temp_max, CAST(c.n AS BIGINT) AS cry_events, CAST(a.n AS BIGINT) AS apnea_events,
  coalesce(l.n, 0) AS longest_calm_min, round(p.mean - 2 * sqrt(greatest(p.var, 0)), 4) AS bpm_low, round(p.mean + 2 * sqrt(greatest(p.var, 0)), 4) AS bpm_high
FROM base b JOIN cry_n c USING (device_id) JOIN apnea_n a USING (device_id) LEFT JOIN longest_calm l USING (device_id) LEFT JOIN bpm_m p USING (device_id)""")
def m4_night_summary(spark, sf):
    out = minutes.night_summary(views.minutes(spark, sf), minutes_per_hour=10).drop("cry_by_hour")
    return out.withColumns({"avg_bpm": F.round("avg_bpm", 6), "bpm_low": F.round("bpm_low", 4), "bpm_high": F.round("bpm_high", 4)})


CONTEXT = MINUTES + ",\nwide AS (SELECT device_id, " + ", ".join(f"avg(CASE WHEN cry > 0 THEN {m} END) AS {m}_c, avg(CASE WHEN cry = 0 THEN {m} END) AS {m}_o" for m in ("humidity", "co2", "temp")) + """
  FROM minutes GROUP BY device_id HAVING sum(cry) > 0 AND sum(cry) < count(*)),
context AS (""" + " UNION ALL ".join(f"SELECT device_id, '{m}' AS measure, {m}_c AS cry_mean, {m}_o AS other_mean, {m}_c - {m}_o AS diff FROM wide" for m in ("humidity", "co2", "temp")) + """),
hours AS (SELECT device_id, minute // 10 AS hour, count(*) AS cry_minutes, min(minute) AS first FROM minutes WHERE cry > 0 GROUP BY device_id, minute // 10),
peaks AS (SELECT device_id, hour, cry_minutes, row_number() OVER (PARTITION BY device_id ORDER BY cry_minutes DESC, first) = 1 AS is_peak FROM hours)"""


@query("c1_cry_context", f"WITH {CONTEXT} SELECT device_id, measure, round(cry_mean, 6) AS cry_mean, round(other_mean, 6) AS other_mean, round(diff, 6) AS diff FROM context")
def c1_cry_context(spark, sf):
    return minutes.cry_context(views.minutes(spark, sf)).withColumns({c: F.round(c, 6) for c in ("cry_mean", "other_mean", "diff")})


@query("c2_cry_by_hour", f"WITH {CONTEXT} SELECT * FROM peaks")
def c2_cry_by_hour(spark, sf):
    return minutes.cry_by_hour(views.minutes(spark, sf), minutes_per_hour=10)


@query("c3_cry_insights", f"""WITH {CONTEXT},
coded AS (SELECT device_id, CASE WHEN measure = 'humidity' AND diff < -5 THEN 'dry' WHEN measure = 'co2' AND diff > 80 THEN 'stuffy' WHEN measure = 'temp' AND diff > 1 THEN 'warm' WHEN measure = 'temp' AND diff < -1 THEN 'cool' END AS insight, diff AS value FROM context)
SELECT device_id, insight, round(value, 6) AS value FROM coded WHERE insight IS NOT NULL
UNION ALL SELECT p.device_id, 'peak_hour', CAST(p.hour AS DOUBLE) FROM peaks p JOIN wide USING (device_id) WHERE is_peak
UNION ALL SELECT DISTINCT device_id, 'insufficient', NULL FROM minutes WHERE device_id NOT IN (SELECT device_id FROM wide)""")
def c3_cry_insights(spark, sf):
    return minutes.cry_insights(views.minutes(spark, sf), minutes_per_hour=10).withColumn("value", F.round("value", 6))


RHYTHM = STATES + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY device_id, night_id ORDER BY minute) - 1 AS place, state = 'awake' AND coalesce(lag(state) OVER (PARTITION BY device_id, night_id ORDER BY minute), '') <> 'awake' AS woke FROM states),
calm_g AS (SELECT device_id, night_id, place - row_number() OVER (PARTITION BY device_id, night_id ORDER BY place) AS g FROM placed WHERE state = 'calm_sleep'),
calm AS (SELECT device_id, night_id, max(n) AS longest FROM (SELECT device_id, night_id, g, count(*) AS n FROM calm_g GROUP BY ALL) GROUP BY ALL),
nightly AS (
  SELECT device_id, night_id, count(*) AS minutes, CAST(sum(CASE WHEN woke THEN 1 ELSE 0 END) AS BIGINT) AS awakenings, coalesce(list(place // 10 ORDER BY place) FILTER (WHERE woke), CAST([] AS BIGINT[])) AS wake_hours,
    """ + ", ".join(f"round(sum(CASE WHEN state = '{s}' THEN 1 ELSE 0 END) / count(*), 3) AS {s}" for s in rhythm.STATES) + """, max(coalesce(c.longest, 0)) AS longest_calm
  FROM placed p LEFT JOIN calm c USING (device_id, night_id) GROUP BY device_id, night_id),
by_hour AS (SELECT device_id, place // 10 AS hour, count(*) AS awakenings, min(night_id * 1000000 + place) AS first FROM placed WHERE woke GROUP BY device_id, place // 10),
wake AS (SELECT device_id, hour, awakenings, row_number() OVER (PARTITION BY device_id ORDER BY awakenings DESC, first) = 1 AS is_peak FROM by_hour),
means AS (SELECT device_id, count(*) AS nights, round(avg(awakenings), 6) AS avg_awakenings, round(avg(longest_calm), 6) AS avg_longest_calm, """ + ", ".join(f"round(avg({s}), 6) AS avg_{s}" for s in rhythm.STATES) + " FROM nightly GROUP BY device_id)"
MEANS = ("avg_awakenings", "avg_longest_calm", *(f"avg_{s}" for s in rhythm.STATES))


@query("r1_night_rhythm", f"WITH {RHYTHM} SELECT * FROM nightly")
def r1_night_rhythm(spark, sf):
    return rhythm.night_rhythm(views.minute_states(spark, sf), minutes_per_hour=10)


@query("r2_sleep_rhythm", f"WITH {RHYTHM} SELECT * FROM means")
def r2_sleep_rhythm(spark, sf):
    return rhythm.sleep_rhythm(rhythm.night_rhythm(views.minute_states(spark, sf), minutes_per_hour=10)).withColumns({c: F.round(c, 6) for c in MEANS})


@query("r2_wake_hours", f"WITH {RHYTHM} SELECT * FROM wake")
def r2_wake_hours(spark, sf):
    return rhythm.wake_hours(views.minute_states(spark, sf), minutes_per_hour=10)


@query("r3_rhythm_insights", f"WITH {RHYTHM} SELECT m.*, w.hour AS peak_hour, w.awakenings AS peak_awakenings FROM means m LEFT JOIN wake w ON m.device_id = w.device_id AND w.is_peak")
def r3_rhythm_insights(spark, sf):
    return rhythm.rhythm_insights(views.minute_states(spark, sf), minutes_per_hour=10).drop("text").withColumns({c: F.round(c, 6) for c in MEANS})


# --- signals -----------------------------------------------------------------------------------------------------------


def _seconds(spark, sf):
    """The long signals with 50 values a second."""
    return views.signal_samples(spark, sf).withColumn("t", F.col("i") / 50.0)


@query("d0_signal_windows", f"""WITH {SIGNALS},
hops AS (SELECT device_id, i // 50 AS hop, list(value ORDER BY i) AS chunk FROM samples GROUP BY ALL),
ends AS (SELECT a.device_id, a.hop, count(*) AS hops, sum(len(b.chunk)) AS size, min(b.hop) AS first FROM hops a JOIN hops b ON a.device_id = b.device_id AND b.hop BETWEEN a.hop - 11 AND a.hop GROUP BY a.device_id, a.hop)
SELECT e.device_id, e.hop + 1 AS window_end, CAST(e.size AS INTEGER) AS size, s.value AS first_value FROM ends e JOIN samples s ON s.device_id = e.device_id AND s.i = e.first * 50""")
def d0_signal_windows(spark, sf):
    out = signal.signal_windows(_seconds(spark, sf))
    return out.select("device_id", F.col("window_end").cast("long").alias("window_end"), F.size("samples").alias("size"), F.element_at("samples", 1).alias("first_value"))


SPECTRUM = WINDOWS + """,
vals AS (SELECT vec_id, samples, generate_subscripts(samples, 1) - 1 AS i, unnest(samples) AS v, list_avg(samples) AS m, len(samples) AS n FROM windows),
hann AS (SELECT vec_id, i, n, (v - m) * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS x FROM vals),
spec AS (SELECT vec_id, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2)) AS a FROM hann, (SELECT unnest(range(2, 10)) AS k) GROUP BY vec_id, k)"""


@query("d1_estimate_bpm", f"WITH {SPECTRUM} SELECT vec_id, round(arg_max(k, a) * 8 / 64.0 * 60, 6)::DOUBLE AS bpm FROM spec GROUP BY vec_id")
def d1_estimate_bpm(spark, sf):
    return views.signal_windows(spark, sf).select("vec_id", F.round(signal.estimate_bpm(F.col("samples"), 8.0), 6).alias("bpm"))


@query("d2_detect_apnea", f"""WITH {WINDOWS}
SELECT vec_id, list_stddev_pop(list_slice(samples, 33, 64)) + 1e-12 < 0.9::DOUBLE * (list_stddev_pop(list_slice(samples, 1, 32)) + 1e-12) AS apnea FROM windows""")
def d2_detect_apnea(spark, sf):
    return views.signal_windows(spark, sf).select("vec_id", signal.detect_apnea(F.col("samples"), 8.0, ratio=0.9).alias("apnea"))


#: Energies from 1.5 Hz on of the last two seconds and of what comes before, of windows (name, fs, samples) that are longer than two seconds.
HIGH = """parts_ AS (
  SELECT name, fs, 'recent' AS side, list_slice(samples, len(samples) - CAST(2 * fs AS BIGINT) + 1, len(samples)) AS s FROM sides
  UNION ALL SELECT name, fs, 'before', list_slice(samples, 1, len(samples) - CAST(2 * fs AS BIGINT)) FROM sides),
high_ AS (SELECT name, fs, side, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS v, list_avg(s) AS m, len(s) AS n FROM parts_),
hann_ AS (SELECT name, fs, side, i, n, (v - m) * (0.5 - 0.5 * cos(2 * pi() * i / greatest(n - 1, 1))) AS x FROM high_),
power_ AS (SELECT name, side, k, n, pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2) AS p
  FROM hann_, (SELECT unnest(range(0, 301)) AS k) WHERE k <= n // 2 AND k * fs / n >= 1.5::DOUBLE AND n >= 2 GROUP BY name, side, k, n),
energy_ AS (SELECT name, side, sum(p) / n AS e FROM power_ GROUP BY name, side, n),
moved AS (SELECT s.name, coalesce(r.e, 0) > 2 * (coalesce(b.e, 0) + 1e-12) AS motion FROM sides s LEFT JOIN energy_ r ON r.name = s.name AND r.side = 'recent' LEFT JOIN energy_ b ON b.name = s.name AND b.side = 'before')"""


@query("d3_detect_motion", f"WITH {WINDOWS}, sides AS (SELECT vec_id AS name, 8.0::DOUBLE AS fs, samples FROM windows), {HIGH} SELECT name AS vec_id, motion FROM moved")
def d3_detect_motion(spark, sf):
    return views.signal_windows(spark, sf).select("vec_id", signal.detect_motion(F.col("samples"), 8.0).alias("motion"))


def readings_sql(last: str) -> str:
    """Common tables that end in `readings` of the windows of 12 s that end at each second up to `last` (hops after the first sample)."""
    return f"""{SIGNALS},
ends_ AS (SELECT device_id, unnest(range(0, CAST({last} AS BIGINT))) AS hop FROM (SELECT device_id, max(i) // 50 AS top FROM samples GROUP BY device_id)),
cut_ AS (SELECT e.device_id * 1000 + e.hop AS name, 50.0::DOUBLE AS fs, list(s.value ORDER BY s.i) AS samples FROM ends_ e JOIN samples s ON s.device_id = e.device_id AND s.i >= (e.hop - 11) * 50 AND s.i < (e.hop + 1) * 50 GROUP BY ALL),
sides AS (SELECT * FROM cut_ WHERE len(samples) > 100), {HIGH},
flat_ AS (SELECT name, generate_subscripts(samples, 1) - 1 AS i, unnest(samples) AS v, list_avg(samples) AS m, len(samples) AS n FROM cut_),
spec_ AS (SELECT name, k, n, pow(sum((v - m) * (0.5 - 0.5 * cos(2 * pi() * i / greatest(n - 1, 1))) * cos(2 * pi() * k * i / n)), 2) + pow(sum((v - m) * (0.5 - 0.5 * cos(2 * pi() * i / greatest(n - 1, 1))) * sin(2 * pi() * k * i / n)), 2) AS p
  FROM flat_, (SELECT unnest(range(0, 20)) AS k) WHERE n >= 2 AND k <= n // 2 AND k * 50.0::DOUBLE / n >= 0.25::DOUBLE AND k * 50.0::DOUBLE / n <= 70.0::DOUBLE / 60 GROUP BY name, k, n),
rate_ AS (SELECT name, arg_max(k * 3000.0::DOUBLE / n, p) AS bpm FROM spec_ GROUP BY name),
told_ AS (SELECT c.name // 1000 AS device_id, c.name % 1000 + 1 AS window_end, round(coalesce(r.bpm, 0), 6) AS breathing_bpm,
    len(samples) > 200 AND list_stddev_pop(list_slice(samples, len(samples) - 199, len(samples))) + 1e-12 < 0.2::DOUBLE * (list_stddev_pop(list_slice(samples, 1, len(samples) - 200)) + 1e-12) AS apnea, coalesce(m.motion, false) AS motion
  FROM cut_ c LEFT JOIN rate_ r USING (name) LEFT JOIN moved m USING (name)),
readings AS (SELECT *, CASE WHEN apnea THEN 0 ELSE breathing_bpm END AS breathing_rate, CASE WHEN motion THEN 1.0 ELSE 0.1 END::DOUBLE AS movement FROM told_)"""


@query("d4_process_windows", f"WITH {readings_sql('top + 1')} SELECT * FROM readings")
def d4_process_windows(spark, sf):
    out = signal.process_windows(signal.signal_windows(_seconds(spark, sf)), 50.0).drop("samples")
    return out.withColumns({"window_end": F.col("window_end").cast("long"), "breathing_bpm": F.round("breathing_bpm", 6), "breathing_rate": F.round("breathing_rate", 6)})


@query("st5_stream_signal", f"WITH {readings_sql('top + 12')} SELECT * FROM readings")
def st5_stream_signal(spark, sf):
    from ..streaming import runs

    out = runs.signal_readings(spark, sf).withColumn("window_end", F.unix_timestamp("window_end"))
    return out.withColumns({"breathing_bpm": F.round("breathing_bpm", 6), "breathing_rate": F.round("breathing_rate", 6)})


BEST = SPECTRUM.replace("range(2, 10)", "range(1, 9)") + """,
best AS (SELECT window_id, bin, vec_id, samples, energy FROM (
  SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY energy DESC, bin) AS nth FROM (SELECT w.*, e.energy FROM windows w JOIN (SELECT vec_id, sum(a * a) AS energy FROM spec GROUP BY vec_id) e USING (vec_id))) WHERE nth = 1)"""
CLEAN = """level_ AS (SELECT vec_id, i, v - (regr_intercept(v, i) OVER w + regr_slope(v, i) OVER w * i) AS v, n FROM values_ WINDOW w AS (PARTITION BY vec_id)),
waves_ AS (SELECT vec_id, k, n, 2.0 / n * sum(v * cos(2 * pi() * k * i / n)) AS a, 2.0 / n * sum(v * sin(2 * pi() * k * i / n)) AS b FROM level_, (SELECT unnest(range(1, 9)) AS k) GROUP BY vec_id, k, n),
passed AS (SELECT vec_id, i, any_value(n) AS n, sum(a * cos(2 * pi() * k * i / n) + b * sin(2 * pi() * k * i / n)) AS v FROM waves_, (SELECT unnest(range(0, 64)) AS i) GROUP BY vec_id, i)"""


@query("d5_select_range_bin", f"WITH {BEST} SELECT window_id, bin, round(energy, 6) AS energy FROM best")
def d5_select_range_bin(spark, sf):
    return signal.select_range_bin(views.signal_windows(spark, sf), 8.0, ["window_id"]).select("window_id", "bin", F.round("energy", 6).alias("energy"))


@query("d6_detrend", f"""WITH {SIGNALS},
fit AS (SELECT device_id, regr_slope(value, i) AS a, regr_intercept(value, i) AS b FROM samples GROUP BY device_id)
SELECT device_id, i, round(value - (coalesce(a, 0) * i + b), 6) AS detrended FROM samples JOIN fit USING (device_id)""")
def d6_detrend(spark, sf):
    return signal.with_trend(views.signal_samples(spark, sf)).select("device_id", "i", F.round("detrended", 6).alias("detrended"))


EACH = "values_ AS (SELECT vec_id, generate_subscripts(samples, 1) - 1 AS i, unnest(samples) AS v, len(samples) AS n FROM windows)"
LEVEL = CLEAN.split("waves_")[0].rstrip().rstrip(",")


def _rounded(samples) -> Column:
    return F.transform(samples, lambda x: F.round(x, 6) + 0.0)


@query("d6_detrend_array", f"WITH {WINDOWS}, {EACH}, {LEVEL} SELECT vec_id, list(round(v, 6) + 0 ORDER BY i) AS samples FROM level_ GROUP BY vec_id")
def d6_detrend_array(spark, sf):
    return views.signal_windows(spark, sf).select("vec_id", _rounded(signal.detrend(F.col("samples"))).alias("samples"))


@query("d7_bandpass", f"WITH {WINDOWS}, {EACH.replace('values_', 'level_')}, {CLEAN[CLEAN.index('waves_'):]} SELECT vec_id, list(round(v, 6) + 0 ORDER BY i) AS samples FROM passed GROUP BY vec_id")
def d7_bandpass(spark, sf):
    return views.signal_windows(spark, sf).select("vec_id", _rounded(signal.bandpass(F.col("samples"), 8.0)).alias("samples"))


RATE = """shaped AS (SELECT vec_id, i, n, (v - avg(v) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS x FROM passed),
tones AS (SELECT vec_id, k, pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2) AS p FROM shaped, (SELECT unnest(range(2, 10)) AS k) GROUP BY vec_id, k),
rates AS (SELECT vec_id, arg_max(k, p) * 7.5::DOUBLE AS bpm FROM tones GROUP BY vec_id)"""


@query("d8_bpm_multibin", f"WITH {BEST}, {EACH.replace('FROM windows', 'FROM best')}, {CLEAN}, {RATE} SELECT window_id, bin, bpm FROM best JOIN rates USING (vec_id)")
def d8_bpm_multibin(spark, sf):
    return signal.estimate_bpm_multibin(views.signal_windows(spark, sf), 8.0, ["window_id"]).withColumn("bpm", F.round("bpm", 6))


@query("d8_bpm_naive", f"""WITH {WINDOWS}, {EACH.replace("vec_id, gen", "window_id, gen")},
passed AS (SELECT window_id AS vec_id, i, n, avg(v) AS v FROM values_ GROUP BY ALL), {RATE} SELECT vec_id AS window_id, bpm FROM rates""")
def d8_bpm_naive(spark, sf):
    return signal.estimate_bpm_naive(views.signal_windows(spark, sf), 8.0, ["window_id"]).withColumn("bpm", F.round("bpm", 6))


@query("d9_apnea_delay", f"""WITH {SIGNALS},
centred AS (SELECT device_id, i, value - avg(value) OVER (PARTITION BY device_id) AS v FROM samples),
sums AS (SELECT device_id, i, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM centred WINDOW w AS (PARTITION BY device_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT device_id, i + 1 AS size, s, q, coalesce(lag(s, 200) OVER (PARTITION BY device_id ORDER BY i), 0) AS s0, coalesce(lag(q, 200) OVER (PARTITION BY device_id ORDER BY i), 0) AS q0 FROM sums),
hits AS (SELECT device_id, min(size) AS size FROM ends WHERE size > 200 AND (size - 200) % 25 = 0
  AND sqrt(greatest((q - q0) / 200.0::DOUBLE - pow((s - s0) / 200.0::DOUBLE, 2), 0)) < 0.95::DOUBLE * sqrt(greatest(q0 / (size - 200) - pow(s0 / (size - 200), 2), 0)) GROUP BY device_id),
devices AS (SELECT DISTINCT device_id FROM samples)
SELECT d.device_id, h.size / 50.0::DOUBLE AS detected_s, 4.0::DOUBLE AS onset_s, h.size / 50.0::DOUBLE - 4.0::DOUBLE AS delay_s FROM devices d LEFT JOIN hits h USING (device_id)""")
def d9_apnea_delay(spark, sf):
    rows = views.signal_samples(spark, sf)
    truth = rows.select("device_id").distinct().withColumn("onset_s", F.lit(4.0))
    return signal.apnea_delay(rows, truth, 50.0, ratio=0.95)


# --- evaluation --------------------------------------------------------------------------------------------------------


def _policies(spark, sf):
    return fusion.with_policies(_fused(spark, sf)).withColumn("expected", F.col("seq") % 10 < 3)


SCORES = POLICIES + ",\nlong_ AS (" + " UNION ALL ".join(f"SELECT '{p}' AS policy, {p} = 'alert' AS alarm, expected FROM policies" for p in fusion.POLICIES) + """),
scores AS (SELECT policy, count(*) AS rows, CAST(sum(CASE WHEN expected THEN 1 ELSE 0 END) AS BIGINT) AS alerts, CAST(sum(CASE WHEN alarm AND NOT expected THEN 1 ELSE 0 END) AS BIGINT) AS false_alarms,
  CAST(sum(CASE WHEN expected AND NOT alarm THEN 1 ELSE 0 END) AS BIGINT) AS misses FROM long_ GROUP BY policy)"""


@query("e1_score_policies", f"WITH {SCORES} SELECT * FROM scores")
def e1_score_policies(spark, sf):
    return evaluate.score_policies(_policies(spark, sf))


@query("e1_level_matrix", f"WITH {POLICIES} SELECT device_id, seq, expected, single_sensor, radar_only, audio_only, env_only, full_fusion FROM policies")
def e1_level_matrix(spark, sf):
    return evaluate.level_matrix(_policies(spark, sf), row=("device_id", "seq"))


@query("e2_policy_rates", f"WITH {SCORES} SELECT *, false_alarms / (rows - alerts) AS false_alarm_rate, misses / greatest(1, alerts) AS miss_rate FROM scores")
def e2_policy_rates(spark, sf):
    return evaluate.score_policies(_policies(spark, sf), rates=True)


@query("e3_agreement", f"""WITH {FUSED},
judged AS (SELECT night_id, list_sort(list_distinct(actions)) = CASE WHEN coalesce(env.co2, 0) > 1000 THEN ['ventilate'] ELSE CAST([] AS VARCHAR[]) END AS ok FROM advised)
SELECT night_id, count(*) AS rows, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS correct, avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM judged GROUP BY night_id""")
def e3_agreement(spark, sf):
    truth = F.when(F.coalesce(F.col("env.co2"), F.lit(0.0)) > 1000, F.array(F.lit("ventilate"))).otherwise(F.array().cast("array<string>"))
    return evaluate.agreement(_decided(spark, sf).withColumn("truth", truth), "actions", "truth", ["night_id"])


ERRORS = SPECTRUM + ",\ntold AS (SELECT vec_id, arg_max(k, a) * 7.5::DOUBLE AS bpm, vec_id % 4 AS snr, vec_id % 3 AS size FROM spec GROUP BY vec_id)"


def _errors(spark, sf):
    rows = views.signal_windows(spark, sf).withColumns({"bpm": F.round(signal.estimate_bpm(F.col("samples"), 8.0), 6), "truth": F.lit(40.0)})
    return rows.withColumns({"snr": F.col("vec_id") % 4, "size": F.col("vec_id") % 3})


@query("e4_mae_by", f"WITH {ERRORS} SELECT snr, size, count(*) AS rows, round(avg(abs(bpm - 40)), 6) AS mae FROM told GROUP BY snr, size")
def e4_mae_by(spark, sf):
    return evaluate.mae_by(_errors(spark, sf), "bpm", "truth", ["snr", "size"]).withColumn("mae", F.round("mae", 6))


@query("e4_mae_matrix", f"WITH {ERRORS} SELECT size, " + ", ".join(f'round(avg(CASE WHEN snr = {s} THEN abs(bpm - 40) END), 6) AS "{s}"' for s in range(4)) + " FROM told GROUP BY size")
def e4_mae_matrix(spark, sf):
    out = evaluate.mae_by(_errors(spark, sf), "bpm", "truth", ["size"], "snr", range(4))
    return out.withColumns({str(s): F.round(str(s), 6) for s in range(4)})


START = "(SELECT floor(min(t) / 86400) * 86400 AS t0 FROM log)"
SPANS = f"spans AS (SELECT DISTINCT device_id, t0 + d * 86400 AS start_ts, t0 + (d + 2) * 86400 AS end_ts FROM log, {START}, (SELECT unnest([5, 15, 25]) AS d))"


@query("e5_alert_quality", f"""WITH RECURSIVE {ALERTS}, {SPANS},
totals AS (SELECT device_id, count(*) AS n FROM alerts GROUP BY device_id),
false_ AS (SELECT device_id, count(*) AS n FROM alerts WHERE seq % 4 = 0 GROUP BY device_id)
SELECT s.device_id, s.start_ts, s.end_ts, count(a.t) AS alerts_in, round(min(a.t) - s.start_ts, 4) AS latency_s, coalesce(any_value(n.n), 0) AS total_alerts, coalesce(any_value(f.n), 0) AS false_alerts
FROM spans s LEFT JOIN alerts a ON a.device_id = s.device_id AND a.t >= s.start_ts AND a.t < s.end_ts LEFT JOIN totals n ON n.device_id = s.device_id LEFT JOIN false_ f ON f.device_id = s.device_id
GROUP BY s.device_id, s.start_ts, s.end_ts""")
def e5_alert_quality(spark, sf):
    alerts = fusion.emit_alerts(_levels(spark, sf), DAY)
    out = evaluate.alert_quality(alerts, _spans(spark, sf), views.sensor_log(spark, sf).where("seq % 4 = 0").select("device_id", "t"), bucket_s=DAY)
    return out.withColumn("latency_s", F.round("latency_s", 4))


def _spans(spark, sf):
    """Labelled intervals of two days of each device."""
    log = views.sensor_log(spark, sf)
    first = (log.agg(F.min("t")).first()[0] or 0.0) // DAY * DAY
    days = F.explode(F.array(*(F.lit(first + d * DAY) for d in (5, 15, 25)))).alias("start_ts")
    return log.select("device_id").distinct().select("device_id", days).withColumn("end_ts", F.col("start_ts") + 2 * DAY)


SETTINGS = [(1, 0.0), (2, DAY), (3, 2 * DAY)]
SWEPT = "swept AS (" + " UNION ALL ".join(
    f"(WITH RECURSIVE {ALERTS.replace('>= 2 THEN raw_level', f'>= {n} THEN raw_level').replace('< 86400', f'< {cooldown}')} SELECT *, {n} AS debounce_n, {cooldown}::DOUBLE AS cooldown_s FROM alerts)" for n, cooldown in SETTINGS
) + ")"


@query("e5_quality_by_setting", f"""WITH RECURSIVE {LOG}, {SPANS}, {SWEPT},
settings(debounce_n, cooldown_s) AS (VALUES {", ".join(f"({n}, {c}::DOUBLE)" for n, c in SETTINGS)}),
totals AS (SELECT debounce_n, device_id, count(*) AS n FROM swept GROUP BY ALL)
SELECT c.debounce_n, c.cooldown_s, s.device_id, s.start_ts, s.end_ts, count(a.t) AS alerts_in, round(min(a.t) - s.start_ts, 4) AS latency_s, coalesce(any_value(n.n), 0) AS total_alerts
FROM spans s CROSS JOIN settings c LEFT JOIN swept a ON a.debounce_n = c.debounce_n AND a.device_id = s.device_id AND a.t >= s.start_ts AND a.t < s.end_ts LEFT JOIN totals n ON n.device_id = s.device_id AND n.debounce_n = c.debounce_n
GROUP BY c.debounce_n, c.cooldown_s, s.device_id, s.start_ts, s.end_ts""")
def e5_quality_by_setting(spark, sf):
    alerts = evaluate.alert_sweep(_decided(spark, sf), SETTINGS)
    out = evaluate.alert_quality(alerts, _spans(spark, sf), config=["debounce_n", "cooldown_s"], bucket_s=DAY, settings=SETTINGS)
    return out.withColumn("latency_s", F.round("latency_s", 4))


@query("e5_alert_sweep", f"WITH {SWEPT} SELECT device_id, debounce_n, cooldown_s, count(*) AS total_alerts FROM swept GROUP BY ALL")
def e5_alert_sweep(spark, sf):
    alerts = evaluate.alert_sweep(_decided(spark, sf), SETTINGS)
    return alerts.groupBy("device_id", "debounce_n", "cooldown_s").agg(F.count(F.lit(1)).alias("total_alerts"))


DIARY = f"diary AS (SELECT DISTINCT device_id, t0 + d * 86400 AS start_ts, t0 + (d + 3) * 86400 AS end_ts FROM log, {START}, (SELECT unnest([2, 8, 14, 20, 26]) AS d))"


def _diary(spark, sf):
    log = views.sensor_log(spark, sf)
    first = (log.agg(F.min("t")).first()[0] or 0.0) // DAY * DAY
    days = F.explode(F.array(*(F.lit(first + d * DAY) for d in (2, 8, 14, 20, 26)))).alias("start_ts")
    return log.select("device_id").distinct().select("device_id", days).withColumn("end_ts", F.col("start_ts") + 3 * DAY)


@query("e8_diary_overlaps", episode_sql(RADAR + ", " + DIARY, "apnea OR motion", "device_id", HOUR, DAY, "SELECT e.device_id, e.start_ts, e.end_ts, d.start_ts AS diary_start, round(least(e.end_ts, d.end_ts) - greatest(e.start_ts, d.start_ts), 4) AS overlap_s FROM eps e JOIN diary d ON d.device_id = e.device_id AND least(e.end_ts, d.end_ts) - greatest(e.start_ts, d.start_ts) > 0"))
def e8_diary_overlaps(spark, sf):
    found = timeline.episodes(views.radar_log(spark, sf), F.col("apnea") | F.col("motion"), ["device_id"], HOUR, DAY, seq=["seq"])
    pairs = diary.overlapping(found, _diary(spark, sf), bucket_s=DAY)
    return pairs.select("device_id", "start_ts", "end_ts", F.col("other_start_ts").alias("diary_start"), F.round("overlap_s", 4).alias("overlap_s"))


@query("e8_diary_agreement", episode_sql(RADAR + ", " + DIARY, "apnea OR motion", "device_id", HOUR, DAY, """,
pairs AS (SELECT e.*, d.start_ts AS s, least(e.end_ts, d.end_ts) - greatest(e.start_ts, d.start_ts) AS o FROM eps e JOIN diary d ON d.device_id = e.device_id AND least(e.end_ts, d.end_ts) - greatest(e.start_ts, d.start_ts) > 0),
hits AS (SELECT device_id, count(DISTINCT s) AS me, count(DISTINCT start_ts) AS mp, sum(o) AS o FROM pairs GROUP BY device_id)
SELECT d.device_id, d.n AS diary_entries, coalesce(h.me, 0) AS matched_entries, coalesce(e.n, 0) AS episodes, coalesce(h.mp, 0) AS matched_episodes, round(coalesce(h.o, 0), 3) AS overlap_s
FROM (SELECT device_id, count(*) AS n FROM diary GROUP BY device_id) d LEFT JOIN (SELECT device_id, count(*) AS n FROM eps GROUP BY device_id) e USING (device_id) LEFT JOIN hits h USING (device_id)"""))
def e8_diary_agreement(spark, sf):
    found = timeline.episodes(views.radar_log(spark, sf), F.col("apnea") | F.col("motion"), ["device_id"], HOUR, DAY, seq=["seq"])
    return diary.diary_agreement(found, _diary(spark, sf), bucket_s=DAY).withColumn("overlap_s", F.round("overlap_s", 3))


@query("e9_recovery_times", f"""WITH {FUSED},
each_ AS (SELECT device_id, t, seq, action, list_contains(actions, action) AS f FROM advised, (SELECT unnest(['ventilate', 'humidify', 'cool']) AS action)),
new_ AS (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY device_id, action ORDER BY t, seq) THEN 0 ELSE 1 END AS new FROM each_),
run_ AS (SELECT *, sum(new) OVER (PARTITION BY device_id, action ORDER BY t, seq) AS run FROM new_),
eps AS (SELECT device_id, action, max(t) - min(t) AS duration_s FROM run_ WHERE f GROUP BY device_id, action, run)
SELECT action, count(*) AS episodes, round(avg(duration_s), 3) AS mean_s, round(median(duration_s), 3) AS median_s, round(max(duration_s), 3) AS longest_s FROM eps GROUP BY action""")
def e9_recovery_times(spark, sf):
    told = diary.recovery_times(diary.action_episodes(_decided(spark, sf), ["ventilate", "humidify", "cool"]))
    return told.withColumns({c: F.round(c, 3) for c in ("mean_s", "median_s", "longest_s")})


@query("r4_conditions", f"""WITH {RHYTHM}
SELECT CASE WHEN night_id % 2 = 0 THEN 'on' ELSE 'off' END AS condition, count(*) AS nights, round(avg(awakenings), 6) AS avg_awakenings, round(avg(longest_calm), 6) AS avg_longest_calm,
  round(avg(calm_sleep), 6) AS avg_calm_sleep, round(avg(restless), 6) AS avg_restless, round(avg(awake), 6) AS avg_awake FROM nightly GROUP BY 1""")
def r4_conditions(spark, sf):
    nightly = r1_night_rhythm(spark, sf)
    nights = nightly.select("device_id", "night_id").distinct().withColumn("condition", F.when(F.col("night_id") % 2 == 0, "on").otherwise("off"))
    out = diary.compare_conditions(nightly, nights)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("avg_")})


@query("e6_baseline_error", baseline_sql(RADAR, "radar_log", "device_id", "t, seq", 0.05) + " SELECT s.device_id, s.samples, round(b.mean, 6) AS bpm_mean, 35.0::DOUBLE AS true_bpm, round(abs(b.mean - 35), 6) AS error FROM samples s JOIN bpm_m b USING (device_id)")
def e6_baseline_error(spark, sf):
    rows = views.radar_log(spark, sf)
    truth = rows.select("device_id").distinct().withColumn("true_bpm", F.lit(35.0))
    out = evaluate.baseline_error(rows, truth).where("bpm_mean IS NOT NULL")
    return out.withColumns({"bpm_mean": F.round("bpm_mean", 6), "error": F.round("error", 6)})


PAIRS = "pairs AS (SELECT l.quality AS truth, l.toxic AS pred FROM labels l)"


@query("e7_confusion_matrix", f"WITH {PAIRS} SELECT truth, pred, count(*) AS rows FROM pairs GROUP BY ALL")
def e7_confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(views.table(spark, sf, "labels"), "quality", "toxic")


@query("e7_classification_report", f"""WITH {PAIRS},
names AS (SELECT DISTINCT label FROM (SELECT truth AS label FROM pairs UNION ALL SELECT pred FROM pairs)),
sums AS (SELECT label, (SELECT count(*) FROM pairs WHERE truth = label AND pred = label) AS hit, (SELECT count(*) FROM pairs WHERE truth = label) AS support, (SELECT count(*) FROM pairs WHERE pred = label) AS told FROM names),
rates AS (SELECT label, support, CASE WHEN told > 0 THEN hit / told ELSE 0.0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS r FROM sums),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM rates)
SELECT label, CAST(p AS DOUBLE) AS precision, CAST(r AS DOUBLE) AS recall, CAST(f1 AS DOUBLE) AS f1, support, avg(f1) OVER () AS macro_f1 FROM f""")
def e7_classification_report(spark, sf):
    return evaluate.classification_report(views.table(spark, sf, "labels"), "quality", "toxic")


# --- text and clips ------------------------------------------------------------------------------------------------------

WORDS = {"status": ["status", "the", "how"], "warmth": ["warm", "ing ", "cold"], "light": ["light", "dark", "en "]}
HITS = {name: " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{w}') AS INTEGER)" for w in words) for name, words in WORDS.items()}
INTENT = "intents AS (SELECT doc_id, CAST(" + "greatest(" + ", ".join(HITS.values()) + ") AS INTEGER) AS hits, CASE WHEN greatest(" + ", ".join(HITS.values()) + ") = 0 THEN 'unknown' " + " ".join(f"WHEN {h} = greatest({', '.join(HITS.values())}) THEN '{n}'" for n, h in HITS.items()) + " END AS intent FROM documents)"


@query("t1_classify_intent", f"WITH {INTENT} SELECT doc_id, intent, hits FROM intents")
def t1_classify_intent(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", classify_intent(F.col("text"), WORDS).alias("r")).select("doc_id", "r.*")


@query("t2_intent_actions", f"WITH {INTENT} SELECT doc_id, CASE intent WHEN 'status' THEN 'report' WHEN 'light' THEN 'dim' END AS action FROM intents")
def t2_intent_actions(spark, sf):
    told = classify_intent(F.col("text"), WORDS)["intent"]
    return views.table(spark, sf, "documents").select("doc_id", intent_action(told, {"status": "report", "light": "dim"}).alias("action"))


@query("t3_class_distribution", "SELECT source AS label, count(*) AS clips, count(DISTINCT lang) AS groups FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source")
def t3_class_distribution(spark, sf):
    return clips.class_distribution(clip_source.index_clips(views.clip_paths(spark, sf)))


@query("t4_group_split", """SELECT doc_id, CASE WHEN CAST(('0x' || substr(md5(CAST(doc_id // 7 AS VARCHAR) || ':42'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.2::DOUBLE THEN 'test' ELSE 'train' END AS split FROM documents""")
def t4_group_split(spark, sf):
    rows = views.table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 7).cast("string").alias("group"))
    return clips.group_split(rows).select("doc_id", "split")


@query("t5_class_weights", "SELECT label, count(*) AS rows, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM embeddings GROUP BY label")
def t5_class_weights(spark, sf):
    return clips.class_weights(views.table(spark, sf, "embeddings"))


FRAMES = "frames AS (SELECT l_orderkey AS clip, l_linenumber AS class, CAST(l_discount AS DOUBLE) AS score, l_partkey AS frame FROM lineitem)"


def _frames(spark, sf):
    return views.table(spark, sf, "lineitem").selectExpr("l_orderkey AS clip", "l_linenumber AS class", "CAST(l_discount AS DOUBLE) AS score", "l_partkey AS frame")


@query("t6_pool_frames", f"""WITH {FRAMES},
means AS (SELECT clip, class, avg(score) AS m FROM frames GROUP BY clip, class)
SELECT clip, round(coalesce(max(CASE WHEN class IN (1, 2) THEN m END), 0), 9) AS cry_score, round(coalesce(max(CASE WHEN class IN (1, 2) THEN m END), 0), 9) > 0.05::DOUBLE AS is_crying FROM means GROUP BY clip""")
def t6_pool_frames(spark, sf):
    out = clips.pool_frames(_frames(spark, sf), (1, 2)).withColumn("cry_score", F.round("cry_score", 9))
    return out.withColumn("is_crying", F.col("cry_score") > 0.05)


@query("t6_pool_embeddings", """WITH cells AS (SELECT vec_id // 4 AS clip, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
means AS (SELECT clip, i, round(avg(v), 9) AS v FROM cells GROUP BY clip, i) SELECT clip, list(v ORDER BY i) AS embedding FROM means GROUP BY clip""")
def t6_pool_embeddings(spark, sf):
    rows = views.table(spark, sf, "embeddings").selectExpr("CAST(floor(vec_id / 4) AS BIGINT) AS clip", "CAST(embedding AS ARRAY<DOUBLE>) AS embedding")
    return clips.pool_embeddings(rows).withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 9)))


@query("t7_cry_score", f"""WITH {FRAMES}
SELECT clip, cry_score, label FROM (SELECT clip, score AS cry_score, class AS label, row_number() OVER (PARTITION BY clip ORDER BY score DESC, class) AS n FROM frames WHERE class IN (1, 2)) WHERE n = 1""")
def t7_cry_score(spark, sf):
    return clips.cry_score(_frames(spark, sf), (1, 2), ["clip"])


@query("t8_fit_window", """SELECT vec_id, list_slice(CAST(embedding AS DOUBLE[]), 25, 64) AS short, list_concat(CAST(embedding AS DOUBLE[]), list_transform(range(0, 16), lambda i: 0.0::DOUBLE)) AS long_ FROM embeddings""")
def t8_fit_window(spark, sf):
    rows = views.signal_windows(spark, sf)
    return rows.select("vec_id", clips.fit_window(F.col("samples"), 40).alias("short"), clips.fit_window(F.col("samples"), 80).alias("long_"))


@query("t8_resample", """WITH w AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS s FROM embeddings)
SELECT vec_id, list_transform(range(0, 21), lambda i: round(s[i * 64 // 21 + 1] + (i * 64 / 21.0::DOUBLE - i * 64 // 21) * (coalesce(s[i * 64 // 21 + 2], s[64]) - s[i * 64 // 21 + 1]), 4) + 0) AS samples FROM w""")
def t8_resample(spark, sf):
    resampled = clips.resample(F.col("samples"), 48.0, 16.0)
    return views.signal_windows(spark, sf).select("vec_id", F.transform(resampled, lambda x: F.round(x.cast("double"), 4) + 0.0).alias("samples"))


@query("t9_augment")
def t9_augment(spark, sf):
    rows = views.signal_windows(spark, sf).select("vec_id", "samples")
    noise = rows.where("vec_id % 5 = 0").select("samples")
    return clips.augment(clips.group_split(rows.withColumn("group", F.col("vec_id").cast("string"))).where("split = 'train'").drop("split", "group"), 2, noise, clip="vec_id", rate=8)


@query("t10_head")
def t10_head(spark, sf):
    rows = views.table(spark, sf, "embeddings").withColumn("group", F.col("vec_id").cast("string"))
    split = clips.group_split(rows)
    model = clips.train_head(split.where("split = 'train'"), max_iter=20)
    return clips.predict_head(model, split.where("split = 'test'")).select("vec_id", "label", "pred", "confidence")


@query("t10_hidden_head")
def t10_hidden_head(spark, sf):
    rows = views.table(spark, sf, "embeddings").withColumn("group", F.col("vec_id").cast("string"))
    split = clips.group_split(rows)
    head = clips.train_hidden_head(split.where("split = 'train'"), hidden=64, epochs=12, batches=2)
    return clips.predict_hidden_head(head, split.where("split = 'test'")).select("vec_id", "label", "pred", "confidence")


# --- streaming -----------------------------------------------------------------------------------------------------------


@query("st1_raw_log", f"WITH {LOGGED} SELECT *, CAST(strftime(to_timestamp(rx_ts) AT TIME ZONE 'UTC', '%Y%m%d') AS INTEGER) AS day FROM logged")
def st1_raw_log(spark, sf):
    from ..streaming import runs

    return runs.raw_log(spark, _lines(spark, sf)).select("device_id", "rx_ts", "topic", F.regexp_replace("payload", " ", "").alias("payload"), F.col("day").cast("int").alias("day"))


@query("st4_stream_minutes", f"""WITH {LOG}
SELECT device_id, CAST(floor(t / 60) AS BIGINT) AS minute, round(avg(CASE WHEN radar.breath_valid AND radar.breathing_rate > 0 THEN radar.breathing_rate END), 6) AS breathing_rate,
  CAST(max(CASE WHEN coalesce(cry.is_crying, false) AND coalesce(cry.confidence, 0) >= 0.7::DOUBLE THEN 1 ELSE 0 END) AS INTEGER) AS cry, CAST(max(CASE WHEN coalesce(radar.apnea, false) THEN 1 ELSE 0 END) AS INTEGER) AS apnea,
  max(radar.movement) AS movement, round(avg(env.co2), 6) AS co2, round(avg(env.temp), 6) AS temp, round(avg(env.humidity), 6) AS humidity FROM log GROUP BY device_id, floor(t / 60)""")
def st4_stream_minutes(spark, sf):
    from ..streaming import runs

    return runs.minutes(spark, sf).withColumns({c: F.round(c, 6) for c in ("breathing_rate", "co2", "temp", "humidity")})


@query("st2_stream_fusion", f"""WITH RECURSIVE {ALERTS}, {series_sql("levels", "radar.breathing_rate", "NULL::DOUBLE", alpha=ALPHA)}
SELECT l.device_id, l.t, l.seq, l.level, l.raw_level, CASE WHEN l.level <> 'normal' THEN l.raw_reasons ELSE CAST([] AS VARCHAR[]) END AS reasons, l.sleep_state, l.actions, a.seq IS NOT NULL AS alert, s.samples, round(s.bpm_mean, 6) AS bpm_mean
FROM levels l LEFT JOIN alerts a ON a.device_id = l.device_id AND a.seq = l.seq JOIN series s ON s.device_id = l.device_id AND s.seq = l.seq""")
def st2_stream_fusion(spark, sf):
    from ..streaming import runs

    return runs.fusion(spark, sf, ALPHA).withColumns({"device_id": F.col("device_id").cast("long"), "bpm_mean": F.round("bpm_mean", 6)})


STREAMED = APNEA.replace(f"RANGE BETWEEN {12 * HOUR} PRECEDING", f"RANGE BETWEEN {2 * HOUR} PRECEDING")


@query("st3_stream_radar", f"""WITH {STREAMED}
SELECT device_id, t, CASE WHEN apnea OR smooth IS NULL THEN 0.0 ELSE smooth END AS breathing_rate, movement, presence, apnea, movement > 0.5::DOUBLE AS motion, smooth IS NOT NULL AS breath_valid,
  distance, CASE WHEN isnan(breath) THEN NULL ELSE breath END AS raw_breath FROM held""")
def st3_stream_radar(spark, sf):
    from ..streaming import runs

    return runs.radar_readings(spark, sf).withColumn("device_id", F.col("device_id").cast("long"))


SILENT = f"CASE WHEN t + {10 * HOUR} < (SELECT max(t) - 30 FROM parsed) THEN t + {10 * HOUR} ELSE t END"


@query("st3_silent_devices", f"""WITH {STREAMED.replace("max(t) OVER (PARTITION BY device_id)", SILENT)}
SELECT device_id, t, CASE WHEN apnea OR smooth IS NULL THEN 0.0 ELSE smooth END AS breathing_rate, movement, presence, apnea, smooth IS NOT NULL AS breath_valid, distance FROM held""")
def st3_silent_devices(spark, sf):
    """With timers: devices that fell silent get the ticks that their last message is fresh for."""
    from ..streaming import runs

    rows = runs.radar_readings(spark, sf, "30 seconds").withColumn("device_id", F.col("device_id").cast("long"))
    return rows.select("device_id", "t", "breathing_rate", "movement", "presence", "apnea", "breath_valid", "distance")


@query("st4_late_rows", f"""WITH {RADAR},
true_ AS (SELECT device_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY device_id ORDER BY t) <= {DAY} THEN 0 ELSE 1 END AS new FROM radar_log WHERE motion OR apnea),
part_ AS (SELECT *, sum(new) OVER (PARTITION BY device_id ORDER BY t) AS part FROM true_),
eps AS (SELECT device_id, min(t) AS start_ts, max(t) AS end_ts FROM part_ GROUP BY device_id, part HAVING max(t) - min(t) >= {HOUR})
SELECT 'minutes' AS job, (SELECT count(*) FROM log WHERE seq % 7 = 0) AS late_rows, (SELECT count(DISTINCT (device_id, CAST(floor(t / 60) AS BIGINT))) FROM log) AS records
UNION ALL SELECT 'episodes', (SELECT count(*) FROM radar_log WHERE seq % 7 = 0 AND (motion OR apnea)), (SELECT count(*) FROM eps)""")
def st4_late_rows(spark, sf):
    from ..streaming import runs

    return runs.late(spark, sf)


@query("st6_stream_episodes", f"""WITH {RADAR},
true_ AS (SELECT device_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY device_id ORDER BY t) <= {DAY} THEN 0 ELSE 1 END AS new FROM radar_log WHERE motion OR apnea),
part_ AS (SELECT *, sum(new) OVER (PARTITION BY device_id ORDER BY t) AS part FROM true_),
eps AS (SELECT device_id, min(t) AS start_ts, max(t) AS end_ts FROM part_ GROUP BY device_id, part)
SELECT device_id, start_ts, end_ts, round(end_ts - start_ts, 4) AS duration_s FROM eps WHERE end_ts - start_ts >= {HOUR} AND end_ts + {DAY} <= (SELECT max(t) - 30 FROM true_)""")
def st6_stream_episodes(spark, sf):
    """Episodes that are closed by the end: the stream's last watermark has passed their gap."""
    from ..streaming import runs

    seconds = lambda c: (F.unix_micros(c) / 1e6).alias(c)
    return runs.episodes(spark, sf).select("device_id", seconds("start_ts"), seconds("end_ts"), F.round("duration_s", 4).alias("duration_s"))


@query("st7_stream_status", f"WITH {LOG} SELECT device_id, topic, max(seq) AS payload, max(t) AS last_ts FROM log GROUP BY ALL")
def st7_stream_status(spark, sf):
    from ..streaming import runs

    return runs.status(spark, sf)
