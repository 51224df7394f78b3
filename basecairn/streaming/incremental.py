"""Incremental ingestion: new FASTQ files of a folder become archive parts, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import archive
from ..sources import fastq


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, block_records: int = 100_000) -> StreamingQuery:
    """A stream over the folder's files (available ones, then it ends): each micro-batch is read as FASTQ and archived under target/batch=N."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")

    def one(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.distinct().collect()]  # names of this batch's files
        if paths:
            reads = fastq.read_fastq(batch.sparkSession, paths, block_records=block_records)
            archive.encode(reads).write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
