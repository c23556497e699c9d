"""Raw message logs and their decoded topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.schemas import TOPICS

RAW = "rx_ts double, topic string, payload string, device_id string, _corrupt string"


def read_raw_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """rx_ts, topic, payload (nested objects as JSON text) and device_id of the log's lines; broken and blank lines go.

    There is no global sort; operators order by rx_ts within their keys.
    """
    return read_log_lines(spark, paths).where("_corrupt is null and topic is not null").drop("_corrupt")


def read_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All lines, with `_corrupt` set for broken ones."""
    return spark.read.schema(RAW).option("columnNameOfCorruptRecord", "_corrupt").json(paths)


def bad_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """How many lines there are, how many of them are broken, and how many are messages."""
    # Spark refuses to scan for the corrupt column alone, so the topics are counted along
    return read_log_lines(spark, paths).agg(F.count(F.lit(1)).alias("lines"), F.count("_corrupt").alias("broken"), F.count("topic").alias("messages"))


def decode_topic(raw: DataFrame, topic: str, schema: StructType | None = None, keep: tuple[str, ...] = ("device_id", "rx_ts")) -> DataFrame:
    """The rows of one topic as typed columns, beside `keep`; payloads that are no objects go."""
    schema = schema or TOPICS[topic]
    rows = raw.where((F.col("topic") == topic) & F.ltrim("payload").startswith("{"))
    return rows.select(*(c for c in keep if c in raw.columns), F.from_json("payload", schema).alias("p")).select(*(c for c in keep if c in raw.columns), "p.*")


def decode_struct(raw: DataFrame, topic: str, name: str) -> DataFrame:
    """raw with the payload of one topic as the struct column `name`, null on rows of other topics."""
    own = (F.col("topic") == topic) & F.ltrim("payload").startswith("{")
    return raw.withColumn(name, F.when(own, F.from_json("payload", TOPICS[topic])))


def topic_regex(pattern: str) -> str:
    """The regular expression of a topic filter: + is one level, # the rest (with the parent itself)."""
    if pattern == "#":
        return "^.*$"
    out, levels = "", pattern.split("/")
    for i, level in enumerate(levels):
        if level == "#":
            return f"^{out}(/.*)?$" if i else "^.*$"
        out += ("/" if i else "") + ("[^/]*" if level == "+" else "".join(f"\\x{{{ord(c):x}}}" if not c.isalnum() else c for c in level))
    return f"^{out}$"


def topic_matches(topic: Column, pattern: str) -> Column:
    return topic.rlike(topic_regex(pattern))


def with_day(raw: DataFrame, tz: str = "UTC", ts: str = "rx_ts") -> DataFrame:
    """raw with `day`, the local date of its arrival."""
    return raw.withColumn("day", F.date_format(F.from_utc_timestamp(F.timestamp_seconds(ts), tz), "yyyyMMdd"))


def write_raw_log(raw: DataFrame, path: str, tz: str = "UTC", fmt: str = "json", ts: str = "rx_ts") -> None:
    """Appends the log, partitioned by local day, rx_ts to the millisecond."""
    with_day(raw.withColumn(ts, F.round(ts, 3)), tz, ts).write.mode("append").partitionBy("day").format(fmt).save(path)


def write_summary(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Minute features or evaluation summaries, CSV with a header by default."""
    df.write.mode("overwrite").option("header", True).format(fmt).save(path)


def read_summary(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "csv") -> DataFrame:
    return spark.read.schema(schema).option("header", True).format(fmt).load(path)


def write_night_report(report: DataFrame, path: str) -> None:
    """The text of each night's report (report_text()), one row per night, partitioned by night."""
    report.select("device_id", "night_id", "text").write.mode("overwrite").partitionBy("night_id").parquet(path)
