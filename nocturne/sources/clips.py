"""Folders of labelled clips, their samples, and the cache of their embeddings."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from ..functions import kernels


def index_clips(paths: DataFrame, path: str = "path") -> DataFrame:
    """paths of .wav files with label (the folder) and group (the file's name up to the first -, without one its stem)."""
    wav = paths.where(F.lower(path).endswith(".wav"))
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    group = F.when(F.instr(name, "-") > 0, F.split_part(name, F.lit("-"), F.lit(1))).otherwise(stem)
    return wav.withColumns({"label": F.element_at(F.split(path, "/"), -2), "group": group})


def index_clip_dir(spark: SparkSession, root: str) -> DataFrame:
    """index_clips of the files under root/<label>/; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(root)
    return index_clips(files.select("path", F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size")))


def cache_key(path: Column, mtime: Column, size: Column) -> Column:
    return F.md5(F.concat(path.cast("string"), mtime.cast("string"), size.cast("string")))


def pending_clips(clips: DataFrame, cache: DataFrame) -> DataFrame:
    """clips (path, mtime, size) whose key isn't in the cache's column `key`: the ones still to be embedded."""
    keyed = clips.withColumn("key", cache_key(F.col("path"), F.col("mtime"), F.col("size")))
    return keyed.join(cache.select("key"), "key", "left_anti")


# --- the samples of clips ---

# Format codes of a WAVE file's fmt chunk.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (floats, -1 to 1, channels put together by their mean) of a RIFF WAVE file: PCM of 8 to 32 bits, or floats of 32 or 64.

    Chunks other than fmt and data are passed over; a data chunk that says it is longer than the file ends with the file. Anything else raises ValueError.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            form = (int.from_bytes(body[24:26], "little") if kind == EXTENSIBLE and len(body) >= 26 else kind), channels, rate, bits
        elif name == b"data":
            if form is None:
                raise ValueError("data before the format")
            return form[2], _samples(body, *form)
        at += 8 + size + size % 2
    raise ValueError("no data")


def _samples(body: bytes, kind: int, channels: int, rate: int, bits: int) -> np.ndarray:
    width = bits // 8
    if not channels or not rate or (kind, bits) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)}:
        raise ValueError(f"format {kind} of {bits} bits, {channels} channels")
    raw = np.frombuffer(body[: len(body) // (width * channels) * (width * channels)], np.uint8)
    if kind == FLOAT:
        x = raw.view(f"<f{width}").astype(np.float64)
    elif bits == 8:
        x = (raw.astype(np.float64) - 128) / 128
    elif bits == 24:
        parts = raw.reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = raw.view(f"<i{width}").astype(np.float64) / float(1 << (bits - 1))
    return x.reshape(-1, channels).mean(axis=1)


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """A mono WAVE file of 16-bit PCM; samples are cut to -1 to 1."""
    body = np.round(np.clip(samples, -1, 32767 / 32768) * 32768).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, PCM, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def write_clips(rows: DataFrame, rate: int = 16000) -> DataFrame:
    """Writes samples of each row (path, samples) to the WAVE file `path` in a folder that all tasks share: path and size. A task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        for batch in batches:
            sizes = []
            for name, wave in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                fs, file = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                fs.create_dir(file.rsplit("/", 1)[0])
                data = encode_wav(wave.values.to_numpy(zero_copy_only=False).astype(float) if wave.is_valid else np.zeros(0), rate)
                with fs.open_output_stream(file) as f:
                    f.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "size"])

    return rows.select("path", F.col("samples").cast("array<double>")).mapInArrow(run, "path string, size long")


def with_samples(clips: DataFrame, rate: int = 16000, path: str = "path") -> DataFrame:
    """clips with samples (floats at `rate`, mono) and error, from the files that `path` names; a file that can't be read or decoded has null samples and says why.

    Each task opens the files of its own rows, one at a time, so only the clips that are asked for are read and no
    more than a batch of waveforms is held.
    """
    names = clips.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                waves, errors = [], []
                for name in part.column(names.index(path)).to_pylist():
                    try:
                        fs, file = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                        with fs.open_input_file(file) as f:
                            own, wave = decode_wav(f.read())
                        waves.append(kernels.resample(wave, own, rate).astype(np.float32))
                        errors.append(None)
                    except (OSError, ValueError, TypeError) as e:
                        waves.append(None)
                        errors.append(str(e)[:200])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(waves, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[*names, "samples", "error"])

    schema = StructType([*clips.schema.fields, StructField("samples", ArrayType(FloatType())), StructField("error", StringType())])
    return clips.mapInArrow(run, schema)


CACHE = "key string, path string, label string, group string, embedding array<double>"


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The cache of embeddings; empty where nothing was added yet. Of a key that two runs added at the same time, one row."""
    try:
        return spark.read.schema(CACHE).parquet(folder).dropDuplicates(["key"])
    except AnalysisException:
        return spark.createDataFrame([], CACHE)


def add_to_cache(clips: DataFrame, folder: str, embed: Callable[[DataFrame], DataFrame], rate: int = 16000) -> DataFrame:
    """Embeds the clips (path, mtime, size, label, group) that aren't in the cache yet, adds them, and gives the cache.

    embed gets key, path, label, group and samples and gives key, path, label, group and embedding. Clips are known by path, time and size: a second
    run finds nothing to do, a file that changed is embedded again under a new key. Clips that can't be decoded are left
    out and tried again next time. Files are added in one commit, so a run that fails adds nothing.
    """
    spark = clips.sparkSession
    pending = pending_clips(clips, read_cache(spark, folder)).dropDuplicates(["key"])
    heard = with_samples(pending.select("key", "path", "label", "group"), rate).where("samples IS NOT NULL").drop("error")
    rows = embed(heard).select(*(f.name for f in StructType.fromDDL(CACHE)))
    rows.write.mode("append").parquet(folder)
    return read_cache(spark, folder)
