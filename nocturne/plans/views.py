"""The driver's tables seen as sensor data, in Spark and as DuckDB's SQL.

events are the messages of devices (users): views, clicks and errors are radar readings, purchases cries, signups the
room's air. Their times are hours apart, so queries take thresholds in hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HOUR, DAY = 3600.0, 86400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sensor_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device_id, t, seq, k, event_type, value, night_id (ten days each), topic and the structs radar, cry and env."""
    ev = table(spark, sf_dir, "events").selectExpr(
        "user_id AS device_id",
        "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6D AS t",
        "event_id AS seq",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "event_type",
        "value",
    )
    return ev.selectExpr(
        "*",
        "CAST(floor(t / 864000D) AS BIGINT) AS night_id",
        "CASE WHEN event_type = 'purchase' THEN 'audio/cry' WHEN event_type = 'signup' THEN 'sensor/env' ELSE 'sensor/radar' END AS topic",
        "CASE WHEN event_type NOT IN ('purchase', 'signup') THEN named_struct('breathing_rate', least(value, 70D), 'movement', k / 100D, 'presence', seq % 10 <> 0, "
        "'apnea', seq % 23 = 0, 'breath_valid', seq % 7 <> 0, 'motion', k > 80, 'source', event_type) END AS radar",
        "CASE WHEN event_type = 'purchase' THEN named_struct('is_crying', k >= 40, 'cls', CASE seq % 3 WHEN 0 THEN 'hungry' WHEN 1 THEN 'sleepy' ELSE 'discomfort' END, 'confidence', k / 100D) END AS cry",
        "CASE WHEN event_type = 'signup' THEN named_struct('co2', 400D + value * 8D, 'temp', 16D + k * 0.12D, 'humidity', CAST(20 + seq % 60 AS DOUBLE), 'lux', CAST(seq % 100 AS DOUBLE)) END AS env",
    )


def radar_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radar rows with their fields as columns."""
    return sensor_log(spark, sf_dir).where("radar IS NOT NULL").select("device_id", "night_id", "t", "seq", "radar.*")


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A minute record for each message of a device."""
    return sensor_log(spark, sf_dir).selectExpr(
        "device_id",
        "night_id",
        "CAST(row_number() OVER (PARTITION BY device_id ORDER BY t, seq) - 1 AS BIGINT) AS minute",
        "least(value, 70D) AS breathing_rate",
        "CAST(k >= 60 AS INT) AS cry",
        "CAST(seq % 23 = 0 AS INT) AS apnea",
        "k / 100D AS movement",
        "400D + value * 8D AS co2",
        "16D + k * 0.12D AS temp",
        "CAST(20 + seq % 60 AS DOUBLE) AS humidity",
    )


def minute_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_log(spark, sf_dir).selectExpr("device_id", "night_id", "seq AS minute", "CASE WHEN k < 60 THEN 'calm_sleep' WHEN k < 80 THEN 'restless' ELSE 'awake' END AS state")


def device_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw device states: topic and text payload."""
    return sensor_log(spark, sf_dir).selectExpr(
        "device_id",
        "t",
        "seq",
        "'mr60bha2/' || CASE event_type WHEN 'view' THEN 'breath_rate' WHEN 'purchase' THEN 'breath_rate' WHEN 'click' THEN 'distance' WHEN 'signup' THEN 'heart_rate' ELSE 'presence' END AS topic",
        "CASE event_type WHEN 'error' THEN CASE WHEN seq % 5 = 0 THEN 'OFF' ELSE ' on ' END WHEN 'click' THEN CAST(30 + k AS STRING) "
        "ELSE CASE WHEN seq % 41 = 0 THEN 'n/a' WHEN seq % 43 = 0 THEN 'NaN' ELSE CAST(k AS STRING) END END AS payload",
    )


def signal_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long signals: the lines of each supplier in order, as device_id, i and value."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS device_id",
        "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice) - 1L AS i",
        "CAST(l_quantity AS DOUBLE) AS value",
    )


def signal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals as arrays: window_id, bin and samples."""
    return table(spark, sf_dir, "embeddings").selectExpr("CAST(floor(vec_id / 8) AS BIGINT) AS window_id", "CAST(vec_id % 8 AS INT) AS bin", "vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS samples")


def clip_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "'/clips/' || source || '/' || lang || '-' || CAST(doc_id AS STRING) || '.wav' AS path", "CAST(n_chars AS BIGINT) AS size", "CAST(doc_id % 1000 AS BIGINT) AS mtime")


LOG = """
events_ AS (
  SELECT user_id AS device_id, epoch_us(ts) / 1e6::DOUBLE AS t, event_id AS seq, CAST(props->>'$.k' AS INTEGER) AS k, event_type, value FROM events),
log AS (
  SELECT *, CAST(floor(t / 864000) AS BIGINT) AS night_id,
    CASE WHEN event_type = 'purchase' THEN 'audio/cry' WHEN event_type = 'signup' THEN 'sensor/env' ELSE 'sensor/radar' END AS topic,
    CASE WHEN event_type NOT IN ('purchase', 'signup') THEN struct_pack(breathing_rate := least(value, 70.0::DOUBLE), movement := k / 100.0::DOUBLE,
      presence := seq % 10 <> 0, apnea := seq % 23 = 0, breath_valid := seq % 7 <> 0, motion := k > 80, source := event_type) END AS radar,
    CASE WHEN event_type = 'purchase' THEN struct_pack(is_crying := k >= 40,
      cls := CASE seq % 3 WHEN 0 THEN 'hungry' WHEN 1 THEN 'sleepy' ELSE 'discomfort' END, confidence := k / 100.0::DOUBLE) END AS cry,
    CASE WHEN event_type = 'signup' THEN struct_pack(co2 := 400.0::DOUBLE + value * 8.0::DOUBLE, temp := 16.0::DOUBLE + k * 0.12::DOUBLE,
      humidity := CAST(20 + seq % 60 AS DOUBLE), lux := CAST(seq % 100 AS DOUBLE)) END AS env
  FROM events_)"""

RADAR = LOG + """,
radar_log AS (
  SELECT device_id, night_id, t, seq, radar.breathing_rate AS breathing_rate, radar.movement AS movement, radar.presence AS presence, radar.apnea AS apnea,
         radar.breath_valid AS breath_valid, radar.motion AS motion, radar.source AS source FROM log WHERE radar IS NOT NULL)"""

FUSED = LOG + """,
fused AS (
  SELECT device_id, night_id, t, seq, topic, last_value(radar IGNORE NULLS) OVER w AS radar, last_value(cry IGNORE NULLS) OVER w AS cry, last_value(env IGNORE NULLS) OVER w AS env
  FROM log WINDOW w AS (PARTITION BY device_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
flags AS (
  SELECT *, coalesce(radar.breathing_rate, 99.0::DOUBLE) AS br, coalesce(radar.apnea, false) AS ap, coalesce(radar.presence, false) AS here,
         coalesce(radar.breath_valid, true) AS ok, coalesce(radar.movement, 0.0::DOUBLE) AS mv,
         coalesce(cry.is_crying, false) AND coalesce(cry.confidence, 0) >= 0.7::DOUBLE AS cf, coalesce(env.co2, 0) > 1000 AS bad FROM fused),
rules AS (
  SELECT *, radar IS NOT NULL AND here AND (ap OR (ok AND br < 8)) AS r1, radar IS NOT NULL AND cf AND (mv > 0.6::DOUBLE OR ap OR br < 8) AS r3,
         radar IS NOT NULL AND here AND NOT ap AND ok AND ((br >= 8 AND br <= 15) OR br > 55) AND (cf OR bad) AS r4,
         coalesce(env.temp < 18 OR env.temp > 26, false) AS r6 FROM flags),
decided AS (
  SELECT *, CASE WHEN r1 OR r3 OR r4 THEN 'alert' WHEN cf OR bad OR r6 THEN 'attention' ELSE 'normal' END AS raw_level,
         list_filter([CASE WHEN r1 THEN 'apnea_suspected' END, CASE WHEN cf THEN 'cry_detected(' || cry.cls || ')' END, CASE WHEN r3 THEN 'multi_signal' END,
           CASE WHEN r4 THEN 'borderline_cross' END, CASE WHEN bad THEN 'co2_high' END, CASE WHEN r6 THEN 'temp_abnormal' END], lambda x: x IS NOT NULL) AS raw_reasons,
         CASE WHEN radar IS NULL OR NOT here THEN 'unknown' WHEN ap OR (ok AND br < 8) THEN 'hold' WHEN NOT ok THEN 'hold'
           WHEN (coalesce(cry.is_crying, false) AND coalesce(cry.confidence, 1) >= 0.7::DOUBLE) OR mv >= 0.7::DOUBLE THEN 'awake' WHEN mv >= 0.4::DOUBLE THEN 'restless' ELSE 'calm_sleep' END AS sleep_state,
         CASE WHEN radar IS NULL OR NOT here THEN 'no_presence' WHEN ap OR (ok AND br < 8) THEN 'breathing_abnormal' WHEN NOT ok THEN 'breathing_not_measured'
           WHEN (coalesce(cry.is_crying, false) AND coalesce(cry.confidence, 1) >= 0.7::DOUBLE) OR mv >= 0.7::DOUBLE THEN 'cry_or_movement' WHEN mv >= 0.4::DOUBLE THEN 'movement' ELSE 'regular_breathing' END AS sleep_reason
  FROM rules),
advised AS (
  SELECT *, CASE WHEN env IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_filter([CASE WHEN env.co2 > 1000 THEN 'ventilate' END,
      CASE WHEN env.humidity < 35 THEN 'humidify' WHEN env.humidity > 60 THEN 'dehumidify' END, CASE WHEN env.temp > 26 THEN 'cool' WHEN env.temp < 18 THEN 'heat' END,
      CASE WHEN sleep_state IN ('calm_sleep', 'restless') AND env.lux > 40 THEN 'dim_light' END], lambda x: x IS NOT NULL) END AS actions FROM decided)"""

LEVELS = FUSED + """,
runs AS (
  SELECT *, sum(new) OVER (PARTITION BY device_id ORDER BY t, seq) AS run FROM (
    SELECT *, CASE WHEN raw_level = lag(raw_level) OVER (PARTITION BY device_id ORDER BY t, seq) THEN 0 ELSE 1 END AS new FROM advised)),
levels AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY device_id, run ORDER BY t, seq) >= 2 THEN raw_level ELSE 'normal' END AS level FROM runs)"""

#: Alerts with a cooldown of a day: candidates are numbered and followed one by one.
ALERTS = LEVELS + """,
turned AS (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t, seq) AS nth, level || '|' || array_to_string(raw_reasons, '|') AS alert_key
  FROM (SELECT *, coalesce(lag(level) OVER (PARTITION BY device_id ORDER BY t, seq), 'normal') AS before FROM levels) WHERE level <> before AND level <> 'normal'),
folded AS (
  SELECT device_id, nth, true AS emitted, alert_key AS last_key, t AS last_t FROM turned WHERE nth = 1
  UNION ALL
  SELECT c.device_id, c.nth, NOT (c.alert_key = f.last_key AND c.t - f.last_t < 86400),
         CASE WHEN c.alert_key = f.last_key AND c.t - f.last_t < 86400 THEN f.last_key ELSE c.alert_key END,
         CASE WHEN c.alert_key = f.last_key AND c.t - f.last_t < 86400 THEN f.last_t ELSE c.t END
  FROM folded f JOIN turned c ON c.device_id = f.device_id AND c.nth = f.nth + 1),
alerts AS (SELECT c.device_id, c.t, c.seq, c.level, array_to_string(c.raw_reasons, ', ') AS reason FROM turned c JOIN folded f ON c.device_id = f.device_id AND c.nth = f.nth WHERE f.emitted)"""

MINUTES = LOG + """,
minutes AS (
  SELECT device_id, night_id, row_number() OVER (PARTITION BY device_id ORDER BY t, seq) - 1 AS minute, least(value, 70.0::DOUBLE) AS breathing_rate,
         CAST(k >= 60 AS INTEGER) AS cry, CAST(seq % 23 = 0 AS INTEGER) AS apnea, k / 100.0::DOUBLE AS movement, 400.0::DOUBLE + value * 8.0::DOUBLE AS co2,
         16.0::DOUBLE + k * 0.12::DOUBLE AS temp, CAST(20 + seq % 60 AS DOUBLE) AS humidity FROM log)"""

STATES = LOG + """,
states AS (SELECT device_id, night_id, seq AS minute, CASE WHEN k < 60 THEN 'calm_sleep' WHEN k < 80 THEN 'restless' ELSE 'awake' END AS state FROM log)"""

RAW_STATES = LOG + """,
raw AS (
  SELECT device_id, t, seq,
    'mr60bha2/' || CASE event_type WHEN 'view' THEN 'breath_rate' WHEN 'purchase' THEN 'breath_rate' WHEN 'click' THEN 'distance' WHEN 'signup' THEN 'heart_rate' ELSE 'presence' END AS topic,
    CASE event_type WHEN 'error' THEN CASE WHEN seq % 5 = 0 THEN 'OFF' ELSE ' on ' END WHEN 'click' THEN CAST(30 + k AS VARCHAR)
      ELSE CASE WHEN seq % 41 = 0 THEN 'n/a' WHEN seq % 43 = 0 THEN 'NaN' ELSE CAST(k AS VARCHAR) END END AS payload FROM log),
parsed AS (
  SELECT device_id, t, seq, CASE WHEN topic LIKE '%/breath_rate' THEN TRY_CAST(trim(payload) AS DOUBLE) END AS breath, CASE WHEN topic LIKE '%/heart_rate' THEN TRY_CAST(trim(payload) AS DOUBLE) END AS heart,
         CASE WHEN topic LIKE '%/distance' THEN TRY_CAST(trim(payload) AS DOUBLE) END AS distance, CASE WHEN topic LIKE '%/presence' THEN upper(trim(payload)) IN ('ON', 'TRUE', '1') END AS presence
  FROM raw WHERE topic LIKE '%/presence' OR TRY_CAST(trim(payload) AS DOUBLE) IS NOT NULL)"""

SIGNALS = """
samples AS (
  SELECT l_suppkey AS device_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice) - 1 AS i,
         CAST(l_quantity AS DOUBLE) AS value FROM lineitem)"""

WINDOWS = """
windows AS (SELECT vec_id // 8 AS window_id, CAST(vec_id % 8 AS INTEGER) AS bin, vec_id, CAST(embedding AS DOUBLE[]) AS samples FROM embeddings)"""
