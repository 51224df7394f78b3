"""Deterministic reads from lineitem, for tests and benchmarks; the same rows in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

RID = "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', cast(cast(round(l_extendedprice * 100) as bigint) as string))"
ALPHABETS = {"plain": "ACGTACGTACGTACGN", "mixed": "ACGTacgtACGTRYKn"}
QUALITIES = {33: "#(/5:?DI#(/5:?DI", 64: "@JT^hBLV@JT^hBLV"}


#: Bytes that one task reads well; a table of fewer for each core may be one row group, which one task reads whole.
TASK_BYTES = 128 << 20


def _spread(t: DataFrame) -> DataFrame:
    """t dealt over all cores where it is so small that its row groups may be fewer than them; else as the scan splits it."""
    cores = t.sparkSession.sparkContext.defaultParallelism
    size = int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return t.repartition(cores) if size < cores * TASK_BYTES else t


def reads(spark: SparkSession, sf_dir: str, bases: str = "plain", offset: int = 33, varied: bool = False) -> DataFrame:
    """rid, l_partkey, l_orderkey, seq, qual: 64 bp, or 1 to 64 bp if varied."""
    ship(spark)
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    t = _spread(t).withColumn("rid", F.expr(RID))
    cut = "substr({}, 1, cast(1 + l_partkey % 64 as int))" if varied else "{}"
    seq = f"translate(concat(md5(rid), md5(concat(rid, 'x'))), '0123456789abcdef', '{ALPHABETS[bases]}')"
    qual = f"translate(concat(md5(concat(rid, 'q')), md5(concat(rid, 'r'))), '0123456789abcdef', '{QUALITIES[offset]}')"
    return t.select("rid", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.expr(cut.format(seq)).alias("seq"), F.expr(cut.format(qual)).alias("qual"))


def reads_sql(bases: str = "plain", offset: int = 33, varied: bool = False) -> str:
    """The same in DuckDB, as a parenthesised query."""
    rid = RID.replace("string", "varchar")
    cut = "substr({}, 1, 1 + l_partkey % 64)" if varied else "{}"
    seq = f"translate(concat(md5(rid), md5(concat(rid, 'x'))), '0123456789abcdef', '{ALPHABETS[bases]}')"
    qual = f"translate(concat(md5(concat(rid, 'q')), md5(concat(rid, 'r'))), '0123456789abcdef', '{QUALITIES[offset]}')"
    return f"(select *, {cut.format(seq)} as seq, {cut.format(qual)} as qual from (select *, {rid} as rid from lineitem))"


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def numbered(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df with record_idx in ORDER from 0: ranges of about ``rows`` rows on the key, rows counted by range, ranks inside each range."""
    n, low, high = df.agg(F.count("*"), F.min("l_orderkey"), F.max("l_orderkey")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // max(64, -(-n // rows))))
    placed = df.withColumn("range", F.floor((F.col("l_orderkey") - (low or 0)) / width))
    first = placed.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*ORDER)) - 1
    return placed.join(F.broadcast(first), "range").withColumn("record_idx", (F.col("first") + rank).cast("long")).drop("range", "first")
