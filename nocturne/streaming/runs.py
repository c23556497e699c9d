"""Runs streaming jobs over the driver's tables until they are used up, and gives back what they wrote."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import radar
from ..plans import views
from ..sources.shared import new_folder, written
from . import jobs

#: Spark's store for the state of stateful processors.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stretches of time that become a micro-batch each, and the files of each of them.
BATCHES, FILES = 3, 4


def landed(batch: DataFrame, write: Callable[[DataFrame, int], None], ts: str = "t") -> None:
    """Writes batch in BATCHES stretches of time, one after the other, so that the files' times are in order; FILES files each."""
    cuts = batch.approxQuantile(ts, [i / BATCHES for i in range(1, BATCHES)], 0.01)
    part = F.lit(0)
    for cut in cuts:
        part = part + (F.col(ts) >= cut).cast("int")
    for i in range(BATCHES):
        write(batch.where(part == i), i)


def source(batch: DataFrame, folder: str, ts: str = "t") -> DataFrame:
    """batch as a stream of files, a stretch of time in each micro-batch; state goes from one to the next."""
    landed(batch, lambda rows, i: rows.repartition(FILES).write.mode("append").parquet(f"{folder}/in"), ts)
    return batch.sparkSession.readStream.schema(StructType(batch.schema.fields)).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/in")


def late_rows(progress: list) -> int:
    """How many rows came behind the watermark, by a query's progress."""
    return sum(operator["numRowsDroppedByWatermark"] for p in progress for operator in p["stateOperators"])


def used_up(out: DataFrame, folder: str, mode: str = "append", keys: Sequence[str] = (), progress: list | None = None) -> DataFrame:
    """What the stream `out` wrote once it has seen all there is; of several updates of the same keys the last one. progress gets what Spark says of each micro-batch."""
    spark, name = out.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        def keep(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

        writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        if progress is not None:
            progress += [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)
    rows = spark.read.schema(StructType([*out.schema.fields, StructField("epoch", IntegerType())])).parquet(f"{folder}/out")
    if keys:
        newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("epoch")))
        rows = rows.withColumn("_newest", newest).where("_newest = 1")
    return rows.select(*out.columns)


def fusion(spark: SparkSession, sf_dir: str, alpha: float = 0.05) -> DataFrame:
    log = views.sensor_log(spark, sf_dir).select(F.col("device_id").cast("string").alias("device_id"), "t", "seq", "radar", "cry", "env")
    folder = new_folder(spark, "stream")
    return used_up(jobs.stream_fusion(source(log, folder), cooldown_s=views.DAY, alpha=alpha), folder)


def radar_readings(spark: SparkSession, sf_dir: str, watermark: str | None = None) -> DataFrame:
    """Readings of all devices; with a watermark those of devices that fell silent too."""
    states = radar.parse_device_states(views.device_states(spark, sf_dir)).withColumn("device_id", F.col("device_id").cast("string"))
    folder = new_folder(spark, "stream")
    return used_up(jobs.stream_radar(source(_timed(states), folder), views.HOUR, 10 * views.HOUR, views.HOUR, watermark), folder)


def _timed(log: DataFrame) -> DataFrame:
    return log.withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))


def ticking(rows: DataFrame, ts: str = "t", by_s: float = 10 * views.DAY) -> DataFrame:
    """rows, and one of no device by_s after the last of them: time goes on, so what all others sent is passed by the watermark."""
    end = rows.agg((F.max(ts) + by_s).alias(ts))
    return rows.unionByName(_timed(end) if "ts" in rows.columns else end, allowMissingColumns=True)


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minutes' records, each once, when they are over."""
    folder = new_folder(spark, "stream")
    rows = ticking(_timed(views.sensor_log(spark, sf_dir)))
    return used_up(jobs.stream_minutes(source(rows, folder)), folder).where("device_id IS NOT NULL")


def late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """minutes and episodes of the log with rows planted behind the watermark, which change nothing and are counted: job, late_rows and records."""
    log = _timed(views.sensor_log(spark, sf_dir))
    true = log.where("radar IS NOT NULL").select("device_id", "ts", "t", "seq", (F.col("radar.motion") | F.col("radar.apnea")).alias("moving"))
    out = None
    for name, rows, job in (
        ("minutes", log, lambda s: jobs.stream_minutes(s, count_late=True)),
        ("episodes", true, lambda s: jobs.stream_episodes(s, "moving", "1 day", views.HOUR, count_late=True)),
    ):
        folder, progress = new_folder(spark, "stream"), []
        stream = source(rows, folder)
        # what is late goes by the watermark of the micro-batch before, so time goes on in two of them; then every seventh row comes again
        tick = ticking(rows).where("device_id IS NULL").coalesce(1)
        # episodes go by the time of true rows alone: one whose flag is null would not close any
        tick = tick.withColumn("moving", F.lit(True)) if "moving" in tick.columns else tick
        for _ in range(2 * FILES):
            tick.write.mode("append").parquet(f"{folder}/in")
        rows.where("seq % 7 = 0").repartition(FILES).write.mode("append").parquet(f"{folder}/in")
        found = used_up(job(stream), folder, progress=progress).where("device_id IS NOT NULL")
        told = found.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("job"), F.lit(late_rows(progress)).cast("long").alias("late_rows"), "records")
        out = told if out is None else out.union(told)
    return out


def episodes(spark: SparkSession, sf_dir: str, gap: str = "1 day") -> DataFrame:
    rows = _timed(views.sensor_log(spark, sf_dir)).where("radar IS NOT NULL").select("device_id", "ts", "t", "seq", (F.col("radar.motion") | F.col("radar.apnea")).alias("moving"))
    folder = new_folder(spark, "stream")
    return used_up(jobs.stream_episodes(source(rows, folder), "moving", gap, views.HOUR), folder)


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.sensor_log(spark, sf_dir).withColumn("payload", F.col("seq")).select("device_id", "topic", "payload", "t", "seq")
    folder = new_folder(spark, "stream")
    return used_up(jobs.stream_status(source(rows, folder)), folder, "update", ["device_id", "topic"])


def signal_readings(spark: SparkSession, sf_dir: str, fs: float = 50.0) -> DataFrame:
    """Readings of sliding windows over the long signals, each when it is over. Signals start on the epoch's second day: a first watermark is at the epoch."""
    us = (F.col("i") * int(1e6 / fs)).cast("long") + int(views.DAY * 1e6)
    # samples are numbered once, for the cuts, the end and each stretch
    rows = written(views.signal_samples(spark, sf_dir).select("device_id", (us / 1e6).alias("t"), F.timestamp_micros(us).alias("ts"), "value"), "samples")
    folder = new_folder(spark, "stream")
    out = used_up(jobs.stream_signal(source(ticking(rows, by_s=120.0), folder), fs), folder).where("device_id IS NOT NULL")
    return out.withColumn("window_end", F.col("window_end") - F.expr("INTERVAL 1 DAY"))


def raw_log(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """The raw log that the ingest wrote, partitioned by day, from landed lines (value, t)."""
    folder = new_folder(spark, "stream")
    landed(lines, lambda rows, i: rows.select("value").repartition(FILES).write.mode("append").text(f"{folder}/landing"))
    jobs.stream_raw_log(jobs.read_landing(spark, f"{folder}/landing", FILES), f"{folder}/log", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/log")
