"""FASTQ text: a scan that splits files at any byte, and the text sink.

Lines are numbered exactly (a quality may begin with @ or +): rows are counted for each file split, a prefix sum over
the splits of a file gives each split its first line number (a join with one row for each split, broadcast up to ``MOST_SPLITS`` of
them), and four lines make a record by one shuffle on (file, record).
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.reads import fastq_text
from ..schema import BAD_HEADER, BAD_LENGTHS, BAD_PLUS, BLOCK_RECORDS, INCOMPLETE
from ..session import ship


#: Files and splits up to which the splits' first line numbers are broadcast.
MOST_SPLITS = 100_000


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, ln (from 0), value without one trailing carriage return, terminated (the file ends with a line feed).

    Files ending in .gz are decompressed by Spark's codec (one task each)."""
    text = spark.read.option("lineSep", "\n").text(path)
    raw = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("mid"))
    splits = raw.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("mid").alias("m0"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("file_size").alias("file_size"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    offsets = splits.select("file", "at", "m0", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), (F.lower("file").endswith(".gz") | (F.sum("bytes").over(whole) == F.col("file_size"))).alias("terminated"))
    offsets = F.broadcast(offsets) if len(text.inputFiles()) <= MOST_SPLITS and text.rdd.getNumPartitions() <= MOST_SPLITS else offsets
    return raw.drop("file_size").join(offsets, ["file", "at"]).select("file", (F.col("first") + F.col("mid") - F.col("m0")).alias("ln"), F.regexp_replace("value", "\r$", "").alias("value"), "terminated")


def by_magic(spark: SparkSession, path: str | list[str]) -> tuple[list[str], list[str]]:
    """The files of a path: those whose first bytes are gzip's though they don't end in .gz (which Spark's codec reads), and all others.
    The driver reads two bytes of each file that doesn't end in .gz."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    zipped, others = [], []
    for r in spark.read.format("binaryFile").load(path).select("path").distinct().orderBy("path").collect():
        if r.path.endswith(".gz"):
            others.append(r.path)
            continue
        at = jvm.org.apache.hadoop.fs.Path(r.path)
        stream = at.getFileSystem(conf).open(at)
        try:
            (zipped if stream.read() == 0x1F and stream.read() == 0x8B else others).append(r.path)
        finally:
            stream.close()
    return zipped, others


def read_by_magic(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines as read_lines() of gzip files, known by their first bytes whatever their names, and of all other files."""
    zipped, others = by_magic(spark, path)
    if not zipped:
        return read_lines(spark, others or path)
    lines = read_gzip_by_magic(spark, zipped)
    return lines.unionByName(read_lines(spark, others)) if others else lines


#: Names that Spark's text reader decodes by their suffix.
_NAMED = "(?i)[.](gz|bz2|deflate|lz4|snappy|zst|passthrough)$"
#: Bytes that are taken from a gzip stream at once.
_CHUNK = 1 << 20


class _Pieces(io.RawIOBase):
    """The bytes that an iterator gives, as a file."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.rest = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, room) -> int:
        while not len(self.rest):
            try:
                self.rest = memoryview(next(self.pieces))
            except StopIteration:
                return 0
        n = min(len(room), len(self.rest))
        room[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _gzip_lines(name: str, pieces: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """The lines of one gzip text, of which no more than a chunk and a line is held; nothing if its first bytes are not gzip's."""
    source = io.BufferedReader(_Pieces(pieces), 1 << 16)
    if source.peek(2)[:2] != b"\x1f\x8b":
        return
    n, rest = 0, b""
    text = gzip.GzipFile(fileobj=source)
    while True:
        held = [rest]  # a line of many chunks is joined once
        while (chunk := text.read(_CHUNK)) and b"\n" not in chunk:
            held.append(chunk)
        rest = b"".join([*held, chunk])
        whole = rest.rfind(b"\n") + 1 if chunk else len(rest)
        lines = np.frombuffer(rest, np.uint8, whole)
        ends = np.flatnonzero(lines == 10) + 1
        ended = bool(chunk) or not whole or len(ends) > 0 and ends[-1] == whole
        if not ended:
            ends = np.append(ends, whole)
        if len(ends):
            offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
            values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(rest[:whole])]).cast(pa.binary())
            done = np.ones(len(ends), bool)
            done[-1] = ended
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ends), pa.string()), pa.array(np.arange(n, n + len(ends))), values, pa.array(done)], ["file", "ln", "value", "terminated"])
            n += len(ends)
        if not chunk:
            return
        rest = rest[whole:]


def read_gzip_by_magic(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines as read_lines() of files whose first bytes are gzip's, whatever their names; concatenated members are one text.

    A file comes as pieces between its line feed bytes, which one shuffle brings into one task in order; they are unpacked as they come, so a
    file of any size takes the memory of a chunk. Files that Spark would decode by their names are read whole (less than 2 GB each)."""
    ship(spark)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        """Names and pieces of files one after another; a file's last piece has a line feed only where the file's size says so."""
        at, size = None, 0
        for batch in batches:
            for name, value, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != at:
                    at, size = name, 0
                size += len(value) + 1
                yield name, value + b"\n" if size <= total else value

    def by_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, own in groupby(pieces(batches), itemgetter(0)):
            yield from _gzip_lines(name, (x for _, x in own))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _gzip_lines(name, iter([content]))

    schema = "file string, ln long, value binary, terminated boolean"
    found = [r.path for r in spark.read.format("binaryFile").load(path).select("path").distinct().orderBy("path").collect()]
    named = [x for x in found if re.search(_NAMED, x)]
    free = [x for x in found if not re.search(_NAMED, x)]
    lines = []
    if free:
        raw = spark.read.option("lineSep", "\n").text(free).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("mid"))
        lines.append(raw.repartition("file").sortWithinPartitions("file", "at", "mid").select("file", "value", "size").mapInArrow(by_pieces, schema))
    if named or not found:
        files = spark.read.format("binaryFile").load(named or path)
        lines.append(files.where(F.substring("content", 1, 2) == F.unhex(F.lit("1F8B"))).select(F.col("_metadata.file_path").alias("path"), "content").mapInArrow(whole, schema))
    text = F.col("value").cast("string")
    for ending in ("\n", "\r"):
        text = F.when(F.endswith(text, F.lit(ending)), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return reduce(DataFrame.unionByName, lines).withColumn("value", text)


def problem(header: Column, sequence: Column, plus: Column, quality: Column, lines: Column) -> Column:
    """The first rule that a record breaks, null for a good one; columns hold whole lines."""
    return (
        F.when(lines < 4, INCOMPLETE)
        .when(~header.startswith("@"), BAD_HEADER)
        .when(~plus.startswith("+"), BAD_PLUS)
        .when(F.octet_length(sequence) != F.octet_length(quality), BAD_LENGTHS)
    )


def assemble(lines: DataFrame, mode: str = "strict", block_records: int = BLOCK_RECORDS) -> DataFrame:
    """Records from numbered lines: file, record_idx, block_idx, header, sequence, plus, quality.

    mode "strict": a bad record fails the query; "tag": adds the column problem instead; "lenient": an unterminated last line and
    an incomplete last record are dropped, other bad records fail."""
    if mode == "lenient":
        # one row for each file
        ends = lines.where(~F.col("terminated")).groupBy("file").agg(F.max("ln").alias("last"))
        lines = lines.join(ends, "file", "left").where(F.col("last").isNull() | (F.col("ln") < F.col("last"))).drop("last")
    part = lambda k: F.max(F.when(F.col("ln") % 4 == k, F.col("value"))).alias(f"l{k}")
    # strings are aggregated in sorted rows: dealt before that, a file that one task reads is sorted by all
    lines = lines.withColumn("record_idx", F.floor(F.col("ln") / 4)).repartition("file", "record_idx")
    r = lines.groupBy("file", "record_idx").agg(*(part(k) for k in range(4)), F.count("*").alias("n"))
    if mode == "lenient":
        r = r.where("n = 4")
    r = r.withColumn("problem", problem(F.col("l0"), F.col("l1"), F.col("l2"), F.col("l3"), F.col("n")))
    bad = F.col("problem")
    header = F.expr("substr(l0, 2)") if mode == "tag" else F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.lit(" (record "), F.col("record_idx").cast("string"), F.lit(")")))).otherwise(F.expr("substr(l0, 2)"))
    out = r.select("file", "record_idx", F.floor(F.col("record_idx") / block_records).alias("block_idx"), header.alias("header"), F.col("l1").alias("sequence"), F.expr("substr(l2, 2)").alias("plus"), F.col("l3").alias("quality"), "problem")
    return out if mode == "tag" else out.drop("problem")


def read_fastq(spark: SparkSession, path: str | list[str], mode: str = "strict", block_records: int = BLOCK_RECORDS, magic: bool = False) -> DataFrame:
    """Records of FASTQ files; with magic, gzip files are known by their first bytes as well as by .gz."""
    return assemble(read_by_magic(spark, path) if magic else read_lines(spark, path), mode, block_records)


def write_fastq(reads: DataFrame, path: str, partitions: int | None = None) -> None:
    """FASTQ text in record order: part files ascend."""
    n = partitions or int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = reads.repartitionByRange(n, "file", "record_idx").sortWithinPartitions("file", "record_idx")
    ordered.select(fastq_text(F.col("header"), F.col("sequence"), F.col("plus"), F.col("quality")).alias("value")).write.text(path)
