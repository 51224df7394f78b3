"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Within its source keys fall into equal ranges of about ``RANGE_ROWS`` documents
(the keys are uniform, so the ranges are even); sums of the ranges, of runs of ranges and of the source give each range
its start (a distributed prefix sum), a window inside the range gives each document its own. Each source is cut
exactly at its budget: whole epochs first, then the documents in key order, the last one in part.

Defined results: null text: size 0. Null source: a source of its own, the last. Null doc_id: keyed as "null".
Equal keys: by doc_id, then size; equal rows may stand for each other. No documents or no words: nothing is taken.
Columns source_size, target and taken that docs has already are replaced, other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, drop, written

RANGE_ROWS = 64
RUN = 1024
MOST_EPOCHS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: int = 3, most: int = MOST_EPOCHS) -> DataFrame:
    """For each source (source, source_size, n): its place among sources, weight 1..weights in turn, and target.

    The shares are the weights' part of all words; no target passes ``most`` times its source, the excess goes to the
    others by weight: sources in order of cap / weight are capped while the level of the rest stands above their ratio.
    One row for each source, so the windows run over a small table.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = totals.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("weight", (F.col("sid") % weights + 1).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_ = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    w = w.withColumn("level", left.cast("double") / open_)
    w = w.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid"))).over(whole))
    return w.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce("level", F.lit(0.0)))).select("source", "sid", "source_size", "n", "target")


def mixed(spark: SparkSession, docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs (doc_id, source, size and any other columns) with source_size, target and taken: the words the mix takes of each row."""
    docs = docs.drop("source_size", "target", "taken")
    size, source = F.col("size").cast("long"), F.col("source")
    narrow, at = written(spark, docs.select("doc_id", "source", size.alias("size")), "sizes")
    found, sources_at = written(spark, targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))), "sources")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))

    def placed(df: DataFrame) -> DataFrame:
        f = found.select(F.col("source").alias("__source"), F.col("sid").alias("__sid"), F.col("source_size"), F.col("n").alias("__n"), "target")
        f = F.broadcast(f) if found.count() <= 100_000 else f
        df = df.withColumn("__key", key).join(f, source.eqNullSafe(F.col("__source")))
        high = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
        return df.withColumn("__range", F.shiftright(high * F.ceil(F.col("__n") / RANGE_ROWS), 32))

    ranges = placed(narrow).groupBy("__sid", "__range").agg(F.sum("size").alias("__sum")).withColumn("__run", F.floor(F.col("__range") / RUN))
    runs = ranges.groupBy("__sid", "__run").agg(F.sum("__sum").alias("__all"))
    runs = runs.select("__sid", "__run", F.coalesce(F.sum("__all").over(Window.partitionBy("__sid").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__to_run"))
    inside = Window.partitionBy("__sid", "__run").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts, starts_at = written(spark, ranges.join(runs, ["__sid", "__run"]).select("__sid", "__range", (F.col("__to_run") + F.coalesce(F.sum("__sum").over(inside), F.lit(0))).alias("__start")), "starts")
    drop(spark, at) if docs is not narrow else None
    own = Window.partitionBy("__sid", "__range").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = placed(docs.withColumn("size", size)).join(starts, ["__sid", "__range"]).withColumn("__before", F.col("__start") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__before")))
    return out.withColumn("taken", taken.cast("long")).drop("__source", "__sid", "__n", "__key", "__range", "__start", "__before")


def copies(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row of mixed() as often as it is taken, the last time perhaps in part (its first words, single-spaced)."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest("size", F.lit(1)))).otherwise(0).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), part), " ")
    each = F.concat(F.array_repeat(F.col("text"), whole), F.when(part > 0, F.array(first)).otherwise(F.array().cast("array<string>")))
    out = docs.select(*[c for c in columns if c != "text"], F.explode(each).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else out.select(*columns)
