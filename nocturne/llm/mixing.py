"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import PLACE, WORD, Batches, beside, bucket_count, placed, ranked, spread, staged

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its own size.
MOST = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """target words of each source, from rows (no_source, source, source_size).

    Sources in code point order, null last, weigh weights, repeating. The sum of all
    sizes is shared by weight; a share above most times its source is cut to that, and
    what is left over is shared again by weight. All rounds together give
    min(most * size, level * weight): with sources in order of size per weight, the ones
    cut are the first ones, and each can be told by the level that those before it leave.
    The table has one row per source, which a window without partition may hold.
    """
    every = Window.partitionBy()
    named = sizes.withColumn("_i", F.row_number().over(Window.orderBy("no_source", "source")) - 1)
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights)).cast("int") + 1).cast("long"))
    named = named.withColumn("_all", F.sum("source_size").over(every)).withColumn("_weights", F.sum("weight").over(every))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "_i").rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn("_words", F.col("_all") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    named = named.withColumn("_left", F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    named = named.withColumn("_cut", F.col("_words").cast("double") / F.col("_left") * F.col("weight") > (most * F.col("source_size")).cast("double"))
    first = F.min(F.when(~F.col("_cut"), F.struct(F.col("source_size") / F.col("weight"), F.col("_i"), F.col("_words").cast("double") / F.col("_left")))).over(every)
    named = named.withColumn("_level", first["col3"])
    target = F.when(F.col("_cut"), (most * F.col("source_size")).cast("double")).otherwise(F.col("_level") * F.col("weight"))
    return named.select("no_source", "source", "source_size", target.alias("target"))


#: So many offsets of each source are tried.
OFFSETS = 256


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """One row per document with `copies`, how often the mix takes it, and `taken`, the words that gives.

    size is the number of words. Every document of a source expects target /
    source_size copies. Their running sum, in an order that runs through the sizes,
    plus one offset of the source decides: a document is taken once for each whole
    number that the sum passes at it. The first part of the offset comes from seed and source; of the
    OFFSETS equal steps after it, the one is taken whose words come nearest to the target (the first of equals).
    So reruns agree, and a few large documents at the end of the order don't decide alone.

    Places in a source are counted by cells of like size and a bucket of doc_id, so no task
    holds a source. A null text has size 0; a null source is a source of its own, last
    in order; a source without words has target 0 and gives no copies. Equal rows are
    separate documents. Null doc_ids are kept. An empty table gives no rows. Columns
    other than doc_id, text and source are ignored.
    """
    return _mixed(docs, [], weights, most, seed)


def _mixed(docs: DataFrame, more: list[str], weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """mix_sources() with further columns of docs."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *more,
        F.when(F.col("source").isNull(), 1).otherwise(0).alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = staged(sized, "sizes")  # texts are read once
    buckets = bucket_count(sized.count())
    sized = sized.withColumn("_tier", F.floor(F.sqrt(F.col("size").cast("double"))).cast("int")).withColumn("_bucket", spread(F.col("doc_id"), buckets).cast("int"))
    key = ["no_source", "source"]
    sources = source_targets(sized.groupBy(*key).agg(F.sum("size").alias("source_size")), weights, most)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("no_source").cast("string"), F.lit(":"), F.col("source"))), 1, 5), 16, 10).cast("double") / 1048576.0 / OFFSETS
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = staged(sources.withColumns({"_rate": rate, "_u": start}), "sources")
    ranks = ranked(sized, key, ["_tier", "_bucket"], ["size", "doc_id"], "_rank").join(sources, key)
    ranks = ranks.withColumn("_a", F.col("_rate") * F.col("_rank") + F.col("_u")).withColumn("_b", F.col("_rate") * (F.col("_rank") + 1) + F.col("_u"))
    ranks = staged(ranks.drop("_tier", "_bucket", "_rank"), "ranks")
    # at which step the floor of a sum goes up: the words gained there at the end of a document's share, and lost at its start
    step = lambda x: F.ceil((1 - (F.col(x) - F.floor(x))) * OFFSETS).cast("int")
    gains = F.array(
        F.struct(F.lit(0).alias("step"), ((F.floor("_b") - F.floor("_a")) * F.col("size")).alias("words")),
        F.struct(step("_b").alias("step"), F.col("size").alias("words")),
        F.struct(step("_a").alias("step"), (-F.col("size")).alias("words")),
    )
    gained = ranks.select(*key, F.inline(gains)).where(f"step < {OFFSETS}").groupBy(*key, "step").agg(F.sum("words").alias("words"))
    steps = sources.select(*key, "target", F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1))).alias("step")).join(gained, [*key, "step"], "left")
    so_far = F.sum(F.coalesce("words", F.lit(0))).over(Window.partitionBy(*key).orderBy("step"))
    best = steps.withColumn("_miss", F.abs(so_far - F.col("target"))).groupBy(*key).agg(F.min(F.struct("_miss", "step"))["step"].alias("_step"))
    told = ranks.join(staged(best, "offsets"), key).withColumn("_by", F.col("_step") / float(OFFSETS))
    copies = F.least(F.floor(F.col("_b") + F.col("_by")) - F.floor(F.col("_a") + F.col("_by")), F.lit(most)).cast("long")
    return told.select("doc_id", *more, "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as mix_sources() takes it: null texts and other texts without a word as often as their place in the order says.

    Equal rows count each, and come out as often as each is taken. An empty table gives none. Texts don't move: copies are fetched to where the rows are read.
    """
    times, rows = "_nocturne_copies", placed(docs)
    taken = _mixed(rows.select("doc_id", "source", "text", *PLACE), list(PLACE), **options).where("copies > 0").select(*PLACE, F.col("copies").cast("int").alias(times))

    def some(batches: Batches) -> Batches:
        for batch in batches:
            yield batch.filter(pc.is_valid(batch.column(times)))

    schema = StructType([*rows.schema.fields, StructField(times, IntegerType())])
    return beside(rows, taken, some, schema).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


#: The words, the targets and the copies of `documents` in plain SQL.
SQL = """
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 1 ELSE 0 END AS no_source, coalesce(source, '') AS source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT no_source, source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY no_source, source) - 1 AS i FROM sized GROUP BY no_source, source),
weighed AS (SELECT *, CAST(i % 3 + 1 AS BIGINT) AS weight FROM sources),
left_over AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS lvl
  FROM weighed WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT *, lvl * weight > CAST(3 * source_size AS DOUBLE) AS is_cut FROM left_over),
targets AS (
  SELECT *, CASE WHEN is_cut THEN CAST(3 * source_size AS DOUBLE) ELSE
    (SELECT lvl FROM cut WHERE NOT is_cut ORDER BY CAST(source_size AS DOUBLE) / weight, i LIMIT 1) * weight END AS target
  FROM cut),
ranked_ AS (
  SELECT s.doc_id, s.no_source, s.source, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST(('0x' || substr(md5('17:' || CAST(s.no_source AS VARCHAR) || ':' || s.source), 1, 5)) AS BIGINT) / 1048576.0::DOUBLE / 256 AS u,
         row_number() OVER (PARTITION BY s.no_source, s.source ORDER BY CAST(floor(sqrt(CAST(s.size AS DOUBLE))) AS BIGINT),
           (((s.doc_id % 65521 + 65521) % 65521 * 40503 + 977) % 65521) % (SELECT least(65521, greatest(64, count(*) // 1048576)) FROM documents), s.size, s.doc_id) - 1 AS rnk
  FROM sized s JOIN targets t USING (no_source, source)),
sums AS (SELECT *, rate * rnk + u AS a, rate * (rnk + 1) + u AS b FROM ranked_),
gains AS (
  SELECT no_source, source, 0 AS step, (floor(b) - floor(a)) * size AS words FROM sums
  UNION ALL SELECT no_source, source, CAST(ceil((1 - (b - floor(b))) * 256) AS INTEGER), size FROM sums
  UNION ALL SELECT no_source, source, CAST(ceil((1 - (a - floor(a))) * 256) AS INTEGER), -size FROM sums),
gained AS (SELECT no_source, source, step, sum(words) AS words FROM gains WHERE step < 256 GROUP BY ALL),
steps AS (
  SELECT no_source, source, step, target, sum(coalesce(words, 0)) OVER (PARTITION BY no_source, source ORDER BY step) AS words
  FROM (SELECT no_source, source, target, unnest(range(0, 256)) AS step FROM targets) LEFT JOIN gained USING (no_source, source, step)),
offsets AS (SELECT no_source, source, first(step ORDER BY abs(words - target), step) AS step FROM steps GROUP BY ALL),
counted AS (
  SELECT doc_id, size, source_size, target,
         CAST(least(floor(b + step / 256.0::DOUBLE) - floor(a + step / 256.0::DOUBLE), 3) AS BIGINT) AS copies FROM sums JOIN offsets USING (no_source, source))
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM counted
"""
