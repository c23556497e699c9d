"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import time
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..sources.shared import shared_folder

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of doc_id as text, modulo k; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(k)


def sampled_ids(ids: DataFrame, salt: int, most: int) -> DataFrame:
    """At most `most` distinct values of the column doc_id, those with the smallest hashes; the same ones in every run.

    A threshold taken from about how many there are leaves half as many again, so only so few are dealt out and put in order.
    """
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(salt)), 1)
    about = ids.agg(F.approx_count_distinct("doc_id")).first()[0]
    if about > 2 * most:
        ids = ids.where(hashed < int((1 << 63) * 1.5 * most / about))
    return ids.distinct().orderBy(hashed, "doc_id").limit(most)


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (doc_id and other columns, one row per doc_id, few enough to go to every task) with text: of several rows of one doc_id the one whose text has the smallest hash."""
    names = [c for c in chosen.columns if c != "doc_id"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in names), F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).select(*names, "text")


#: About so many bytes of rows go to a Python worker at a time: texts are long, and Spark's limit of rows alone would let batches grow with them.
BATCH_BYTES = 8 << 20


#: What a worker keeps from task to task, and what of it the task at hand has asked for.
_kept: dict[tuple, object] = {}
_used: set[tuple] = set()


def held_by_worker(make: Callable) -> Callable:
    """make, whose results a worker keeps until a task of in_python() goes by that doesn't ask for them: workers go on to other stages with what they hold."""

    @wraps(make)
    def get(*args):
        key = (make.__module__, make.__qualname__, *args)
        _used.add(key)
        if key not in _kept:
            _kept[key] = make(*args)
        return _kept[key]

    return get


def _ask_anew() -> None:
    _used.clear()  # here, as a nested function would have a copy


def _let_go() -> None:
    """Gives back what the task has not asked for, and free memory, which an idle worker would hold."""
    for key in _kept.keys() - _used:
        del _kept[key]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def in_python(rows: DataFrame, run: Callable[[Batches], Batches], schema: StructType | str) -> DataFrame:
    """rows through run, in small batches, unless the session has chosen their size itself."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))

    def task(batches: Batches) -> Batches:
        _ask_anew()
        yield from run(batches)
        _let_go()

    return rows.mapInArrow(task, schema)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again, which cuts its lineage.

    A lost executor then costs the tasks at hand, never the work before them, and
    two uses of the result don't compute it twice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that nothing refers to any more now, not only when the driver next happens to collect its garbage.

    The first collection frees what Python held, the second what that referred to.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def dropped(*tables: DataFrame) -> None:
    """Deletes what staged() wrote of what tables read, once nothing will read it any more; files outside the shared folder stay."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        top = path(shared_folder(spark))
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        top = fs.makeQualified(top).toString()
        for folder in {str(path(file).getParent().toString()) for file in t.inputFiles()}:
            if str(fs.makeQualified(path(folder)).toString()).startswith(f"{top}/"):
                fs.delete(path(folder), True)


#: A row's place: a hash of its file's path, and its number in the file. Every read of the files gives the same.
FILE, ROW = PLACE = ("_nocturne_file", "_nocturne_row")


def placed(docs: DataFrame) -> DataFrame:
    """docs with PLACE, as it is if it has them. Rows that don't come straight from files are written to some first."""
    if set(PLACE) <= set(docs.columns):
        return docs
    place = (F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    if "_metadata" not in docs.columns and docs.inputFiles():
        try:
            return docs.select("*", *place)
        except AnalysisException:  # rows of several tables
            pass
    if "_metadata" in docs.columns:
        named = docs.withColumnRenamed("_metadata", "_nocturne_metadata")
        return placed(staged(named, "rows")).withColumnRenamed("_nocturne_metadata", "_metadata")
    return staged(docs, "rows").select("*", *place)


#: Rows of a file whose decisions are held together.
BLOCK_BITS = 16


class _Blocks:
    """Reads what was decided about rows, a block of a file's rows at a time, from where beside() wrote it."""

    def __init__(self, uri: str, schema: pa.Schema):
        self.uri, self.schema = uri, schema

    def __enter__(self) -> _Blocks:
        import pyarrow.fs

        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(self.uri)
        self.last: dict = {}
        return self

    def __exit__(self, *_: object) -> None:
        self.last = {}

    def _block(self, file: int, block: int) -> pa.Table | None:
        import pyarrow.fs
        import pyarrow.parquet

        if (file, block) not in self.last:
            found = self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.root}/file={file}/block={block}", allow_not_found=True))
            parts = [pyarrow.parquet.ParquetFile(self.fs.open_input_file(x.path)).read() for x in found if x.path.endswith(".parquet")]
            rows = pa.concat_tables(parts).combine_chunks() if parts else None
            if len(self.last) >= 2:
                self.last.pop(next(iter(self.last)))
            self.last[file, block] = rows.take(pa.array(np.argsort(rows.column(ROW).to_numpy()))) if rows is not None else None
        return self.last[file, block]

    def beside(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """batch with the values of its rows, null where nothing was decided."""
        file, row = (batch.column(c).to_numpy() for c in PLACE)
        block = row >> BLOCK_BITS
        order = np.lexsort((block, file))
        cut = np.flatnonzero((np.diff(file[order]) != 0) | (np.diff(block[order]) != 0)) + 1
        parts = []
        for at in np.split(order, cut) if len(order) else []:
            rows = self._block(int(file[at[0]]), int(block[at[0]]))
            if rows is None:
                parts.append(self.schema.empty_table().take(pa.nulls(len(at), pa.int64())))
                continue
            names = rows.column(ROW).to_numpy()
            i = np.minimum(np.searchsorted(names, row[at]), len(names) - 1)
            parts.append(rows.select(self.schema.names).take(pa.array(i, mask=names[i] != row[at])).cast(self.schema))
        values = pa.concat_tables(parts).combine_chunks() if parts else self.schema.empty_table()
        if len(parts) > 1:
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            values = values.take(pa.array(back)).combine_chunks()
        flat = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in values.columns]
        return pa.RecordBatch.from_arrays([*batch.columns, *flat], names=[*batch.schema.names, *self.schema.names])


def beside(rows: DataFrame, found: DataFrame, then: Callable[[Batches], Batches] | None = None, schema: StructType | str | None = None) -> DataFrame:
    """rows with the values that found has for their PLACE, null where it has none, handed on to `then` if given (schema is what that returns).

    rows stay where they are, with their texts: found, which has each place once at most, is written by file
    and block of rows, and a task that reads rows fetches the few blocks they are in. What a task holds is bounded by a block,
    and what moves is only found. Where pyarrow can't open the shared folder, Spark joins instead.
    """
    spark = rows.sparkSession
    fields = [f for f in found.schema.fields if f.name not in PLACE]
    path = f"{shared_folder(spark)}/places-{uuid.uuid4().hex}"
    by = [F.col(FILE).alias("file"), F.shiftright(ROW, BLOCK_BITS).alias("block")]
    written = found.select(ROW, *(f.name for f in fields), *by).repartition("file", "block").sortWithinPartitions("file", "block", ROW)
    written.write.partitionBy("file", "block").parquet(path)
    cleared(spark)
    uri = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(path)).toString()
    uri = re.sub("^file:/+", "file:///", uri).replace("s3a://", "s3://", 1)
    full = StructType([*rows.schema.fields, *fields])
    types = pa.schema([pa.field(f.name, _arrow(f)) for f in fields])
    blocks, last = _Blocks(uri, types), then or (lambda batches: batches)

    def run(batches: Batches) -> Batches:
        with blocks:
            yield from last(blocks.beside(b) for b in batches if b.num_rows)

    try:
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        reached = fs.get_file_info(root).type != pyarrow.fs.FileType.NotFound
    except (OSError, ValueError, ImportError):
        reached = False
    if reached:
        return in_python(rows, run, schema or full)
    joined = rows.join(found.hint("merge"), list(PLACE), "left").select(*(f.name for f in full))
    return in_python(joined, last, schema) if then else joined


def _arrow(field: StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def ranked(df: DataFrame, group: list[str], cells: list[str], order: list[str], rank: str) -> DataFrame:
    """df with the 0-based rank of each row in its group, ordered by cells and then order.

    No task holds a group: rows are numbered within a cell (one combination of the
    columns in cells), cells within their neighbours of the level above, and so on,
    so a group with a third of all rows is dealt out over its cells. Group and
    cell columns must not be null. Rows that are equal in cells and order are
    numbered in any way.
    """
    counts = df.groupBy(*group, *cells).agg(F.count(F.lit(1)).alias("_n"))
    offset = F.lit(0)
    for depth in range(len(cells), 0, -1):
        # at each level the counts of what lies below are summed before they are numbered
        level = counts.groupBy(*group, *cells[:depth]).agg(F.sum("_n").alias("_n"))
        w = Window.partitionBy(*group, *cells[: depth - 1]).orderBy(cells[depth - 1])
        level = level.withColumn(f"_before{depth}", F.sum("_n").over(w) - F.col("_n")).drop("_n")
        counts = counts.join(level, [*group, *cells[:depth]])
        offset = offset + F.col(f"_before{depth}")
    offsets = counts.select(*group, *cells, offset.alias("_offset"))
    w = Window.partitionBy(*group, *cells).orderBy(*order)
    return df.join(offsets, [*group, *cells]).withColumn(rank, F.col("_offset") + F.row_number().over(w) - 1).drop("_offset")


def bucket_count(rows: int, least: int = 64) -> int:
    """So many buckets that one has about a million rows, up to the 65,521 that spread() tells apart."""
    return min(65_521, max(least, rows >> 20))


def spread(column: Column, buckets: int) -> Column:
    """A bucket from 0 on, by an integer column; the same arithmetic works in plain SQL and can't overflow."""
    return (F.pmod(F.coalesce(column, F.lit(0)), F.lit(65521)) * F.lit(40503) + F.lit(977)) % F.lit(65521) % F.lit(buckets)


#: The numbers of the two parts whose rows meet in a cell, the first one times 2**31, and a row's own part.
CELL = ("cell", "part")


#: Buckets of keys that are counted first; only keys of buckets with too many rows are counted one by one.
COARSE = 1 << 17


def in_cells(rows: DataFrame, key: str, names: list[str], most: int) -> DataFrame:
    """rows, with CELL if some key has over `most` rows: it is cut into parts by a hash of names, and every two parts meet in a cell of their own.

    So a task has 2 * most rows of a key or so, and each pair of rows is together in one cell where their parts
    differ, or, in the cell of the same part twice, where they don't. Other keys have cell 0.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(COARSE)).cast("int")
    full = rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_bucket")
    buckets = [r[0] for r in full.collect()]  # COARSE rows at most
    if not buckets:
        return rows
    some = rows.sparkSession.createDataFrame([(b,) for b in buckets], "_bucket int")
    counts = rows.withColumn("_bucket", bucket).join(F.broadcast(some), "_bucket", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_parts"))
    crowded = staged(counts.where(F.col("_parts") > most).withColumn("_parts", F.ceil(F.col("_parts") / most).cast("int")), "crowded")
    n = crowded.count()
    if not n:
        return rows
    parts = F.coalesce("_parts", F.lit(1))
    told = rows.join(F.broadcast(crowded) if n <= 4096 else crowded, key, "left").withColumn("part", F.pmod(F.xxhash64(*names), parts).cast("int"))
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    cell = F.shiftleft(F.least("part", "_other").cast("long"), 31) + F.greatest("part", "_other")
    return told.withColumn("_other", other).withColumn("cell", cell).drop("_parts", "_other")


def cells_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """CELL of some rows; 0 where no key was cut."""
    if "cell" in rows.schema.names:
        return rows.column("cell").to_numpy(), rows.column("part").to_numpy()
    return (np.zeros(len(rows), np.int64),) * 2


def apart(cell: np.ndarray, part: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j, which are in one cell, meet there and not in another one too."""
    return (part[i] != part[j]) | ((cell[i] >> 31) == (cell[i] & 0x7FFFFFFF))


def key_groups(batches: Iterator[tuple], columns: list[str], rows: int = 20_000, most: int = 1 << 62) -> Iterator[tuple]:
    """(rows, True) for whole groups of equal values of columns (those that rows have), several together, from (None, batch) in their order; (rows, False)
    for a part of a group with over `most` rows; (None, x) for each (x, None) that comes."""
    held: list[pa.RecordBatch] = []
    size, due = 0, rows
    for passing, batch in batches:
        if batch is None:
            yield None, passing
            continue
        held.append(batch)
        size += batch.num_rows
        if size < due:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(len(whole) - 1, bool)
        for c in columns:
            if c in whole.schema.names:
                value = whole.column(c).to_numpy()
                new |= value[1:] != value[:-1]
        cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
        if cut:
            yield whole.slice(0, cut), True
        held = whole.slice(cut).to_batches()
        size = len(whole) - cut
        if size > most:
            yield whole.slice(cut), False
            held, size = [], 0
        due = max(rows, 2 * size)  # a long group is put together a few times only
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), True


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows, written, with `name`: the 0-based place of each in its group by order, nulls first. Group columns must not be null.

    rows are dealt out by ranges of group and order, so a group with a third of all rows lies on as many tasks as it
    needs, given that order tells its rows apart. Each range counts by itself; only the first group of a range
    can have rows in ranges before it, so offsets are one small row a range at most.
    """
    part, first = f"{name}_part", f"{name}_first"
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    schema = StructType([*rows.schema.fields, StructField(part, IntegerType()), StructField(name, LongType()), StructField(first, BooleanType())])

    def count(batches: Batches) -> Batches:
        last, here, seen = None, 0, 0
        of = TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in group:
                value = batch.column(c)
                new[1:] |= pc.not_equal(value.slice(1), value.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = seen == 0 or tuple(batch.column(c)[0].as_py() for c in group) != last
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(start >= 0, at - start, here + at)
            last, here = tuple(batch.column(c)[n - 1].as_py() for c in group), int(place[-1]) + 1
            columns = [pa.array(np.full(n, of, np.int32)), pa.array(place), pa.array(place == seen + at)]
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    dealt = staged(in_python(rows.repartitionByRange(*by).sortWithinPartitions(*by), count, schema), "numbered")
    if group:
        running = dealt.where(first).select(*group).distinct()
        counts = dealt.join(F.broadcast(running), group, "left_semi").groupBy(*group, part).agg(F.count(F.lit(1)).alias("_n"))
    else:
        counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = staged(counts.withColumn("_before", before).where("_before > 0").drop("_n"), "offsets")
    found = dealt.join(F.broadcast(offsets), [*group, part], "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
    return found.select(*rows.columns, name)
