"""Topics, payload schemas and codes of the monitoring data."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

RADAR, ENV, CRY, VOICE = "sensor/radar", "sensor/env", "audio/cry", "audio/voice"
FUSION_STATE, ALERT, CONTROL = "fusion/state", "fusion/alert", "control/action"

_PLAIN = {"double": DoubleType(), "boolean": BooleanType(), "string": StringType(), "bigint": LongType()}


def _struct(fields: str) -> StructType:
    """A struct of plain fields, without a session."""
    return StructType([StructField(name, _PLAIN[kind]) for name, kind in (x.split() for x in fields.split(", "))])


RADAR_SCHEMA = _struct(
    "breathing_rate double, breathing_bpm double, movement double, presence boolean, apnea boolean, motion boolean, "
    "breath_valid boolean, source string, heart_rate double, distance double, raw_breath double, ts double"
)
ENV_SCHEMA = _struct("temp double, humidity double, co2 double, lux double, ts double")
CRY_SCHEMA = _struct("is_crying boolean, cls string, confidence double, cry_score double, ts double")
VOICE_SCHEMA = _struct("intent string, ts double")
FUSION_SCHEMA = (
    StructType()
    .add("level", StringType())
    .add("raw_level", StringType())
    .add("reasons", ArrayType(StringType()))
    .add("sleep", _struct("state string, reason string"))
    .add("personal", _struct("samples bigint, bpm_mean double").add("bpm_normal_range", ArrayType(DoubleType())).add("restless_threshold", DoubleType()))
    .add("actions", ArrayType(ArrayType(StringType())))
    .add("ts", DoubleType())
)
ALERT_SCHEMA = _struct("level string, reason string, ts double")
CONTROL_SCHEMA = StructType().add("actions", ArrayType(StringType())).add("ts", DoubleType())

#: The schema of each topic's payload.
TOPICS = {
    RADAR: RADAR_SCHEMA,
    ENV: ENV_SCHEMA,
    CRY: CRY_SCHEMA,
    VOICE: VOICE_SCHEMA,
    FUSION_STATE: FUSION_SCHEMA,
    ALERT: ALERT_SCHEMA,
    CONTROL: CONTROL_SCHEMA,
}

LEVELS = ("normal", "attention", "alert")

#: What the reason and action codes say on a report.
LABELS = {
    "apnea_suspected": "no breathing detected, apnea suspected",
    "cry_detected": "crying detected",
    "multi_signal": "several signals abnormal at once",
    "borderline_cross": "borderline breathing confirmed by another signal",
    "co2_high": "CO2 high",
    "temp_abnormal": "room temperature out of range",
    "ventilate": "ventilate",
    "humidify": "run the humidifier",
    "dehumidify": "dry the air",
    "cool": "cool the room",
    "heat": "heat the room",
    "dim_light": "dim the light",
}
