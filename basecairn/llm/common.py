"""Helpers shared by the training-data operators: written tables in the shared folder, arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parents[2])

#: ASCII white space, the separators of words in every operator here.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Settings the operators rely on: small arrow batches, so that very long texts fit, and this package on the workers' path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), REPO]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; a folder of our own only where that is unset and
    all runs in one process, as in tests. On a cluster it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="basecairn-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


#: Paths in the shared folder that this process has made and not dropped.
_MADE: set[str] = set()


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _MADE.add(path)
    return path


def written(spark: SparkSession, df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and outlives executors. Also its path, for drop()."""
    path = new_path(spark, tag)
    df.write.option("compression", "lz4_raw").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _MADE.discard(p)


def release(spark: SparkSession) -> None:
    """Drops all tables that operators have written in the shared folder, also those that their lazy results still read: call it once results are used."""
    drop(spark, *_MADE)


def fresh(name: str, columns: list[str]) -> str:
    """name, or one like it that no column has."""
    while name in columns:
        name += "_"
    return name


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def input_bytes(df: DataFrame) -> int:
    """The bytes of the files that df reads, by Spark's estimate; 0 where Spark has none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def bounded(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, marked for broadcast only if a count shows at most ``most`` (narrow) rows; beyond that the join shuffles."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
