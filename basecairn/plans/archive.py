"""Compress, decompress, scramble, info and check, as plans."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reads as R
from ..operators import kernels
from ..schema import BLOCK_RECORDS, DETECT_RECORDS, FLAG_PAIRED, PHRED33
from ..session import ship
from ..sources import container, fastq


def detect_offset(reads: DataFrame) -> int:
    """The quality offset of a file's first records."""
    low = reads.where(F.col("record_idx") < DETECT_RECORDS).agg(F.min(R.lowest_code(F.col("quality"))).alias("low")).select(R.phred_offset(F.col("low")).alias("o")).first()
    return low.o if low else PHRED33


def file_offsets(reads: DataFrame) -> DataFrame:
    """file and the quality offset of each file's first records."""
    return reads.where(F.col("record_idx") < DETECT_RECORDS).groupBy("file").agg(F.min(R.lowest_code(F.col("quality"))).alias("low")).select("file", R.phred_offset(F.col("low")).alias("phred_offset"))


#: Files up to which their quality offsets are broadcast.
MOST_FILES = 10_000


def _few(offsets: DataFrame) -> DataFrame:
    """offsets, found once and marked for broadcast if they are few; else the join shuffles."""
    rows = offsets.limit(MOST_FILES + 1).collect()
    return F.broadcast(offsets.sparkSession.createDataFrame(rows, offsets.schema)) if len(rows) <= MOST_FILES else offsets


def block_stats(reads: DataFrame) -> DataFrame:
    return reads.groupBy("block_idx").agg(F.count("*").alias("num_records"), F.sum(F.octet_length("sequence")).alias("orig_seq_size"), F.sum(F.octet_length("quality")).alias("orig_qual_size"))


def encode(reads: DataFrame, offset: int | None = None, level: int = 1) -> DataFrame:
    """file, block_idx, num_records and the six compressed streams: one shuffle on both, one Arrow kernel for each block of a file.

    Without an offset each file's own is detected."""
    ship(reads.sparkSession)
    if "file" not in reads.columns:
        reads = reads.withColumn("file", F.lit(""))
    reads = reads.join(_few(file_offsets(reads)), "file", "left").fillna(PHRED33, ["phred_offset"]) if offset is None else reads.withColumn("phred_offset", F.lit(offset).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("record_idx")
        cols = [table.column(c).cast(pa.binary()).to_pylist() for c in ("header", "sequence", "plus", "quality")]
        offset = table.column("phred_offset")[0].as_py()
        raw = kernels.streams(*cols, offset)
        out = {"file": [table.column("file")[0].as_py()], "block_idx": [table.column("block_idx")[0].as_py()], "num_records": [table.num_rows]}
        out |= {f"{k}_data": [kernels.compressed(v, level)] for k, v in raw.items()}
        out["crc32"] = pa.array([_crc32(out[f"{k}_data"][0] for k in kernels.ORDER[2])], pa.int64())
        return pa.table(out | {"orig_seq_size": [sum(map(len, cols[1]))], "orig_qual_size": [sum(map(len, cols[3]))], "phred_offset": pa.array([offset], pa.int32())})

    streams = ", ".join(f"{k}_data binary" for k in kernels.ORDER[2])
    return reads.select("file", "block_idx", "record_idx", "header", "sequence", "plus", "quality", "phred_offset").groupBy("file", "block_idx").applyInArrow(run, f"file string, block_idx long, num_records long, {streams}, crc32 long, orig_seq_size long, orig_qual_size long, phred_offset int")


def _crc32(parts) -> int:
    out = 0
    for p in parts:
        out = zlib.crc32(p, out)
    return out


def decode(blocks: DataFrame, block_records: int = BLOCK_RECORDS) -> DataFrame:
    """Records of encoded blocks with their file, without a shuffle."""
    ship(blocks.sparkSession)
    if "file" not in blocks.columns:
        blocks = blocks.withColumn("file", F.lit(""))
    if "crc32" not in blocks.columns:
        blocks = blocks.withColumn("crc32", F.lit(None).cast("long"))
    names = kernels.ORDER[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if row["crc32"] is not None and row["crc32"] != _crc32(row[f"{k}_data"] for k in names):
                    raise ValueError(f"checksum of block {row['block_idx']} differs")
                raw = {k: kernels.decompressed(row[f"{k}_data"], k, kernels.most_bytes(k, row["num_records"], row["orig_seq_size"], row["orig_qual_size"])) for k in names}
                cols = kernels.block_records(raw, row["num_records"], row["phred_offset"])
                n, first = row["num_records"], row["block_idx"] * block_records
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * n, pa.string()), pa.array([row["block_idx"]] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], ["file", "block_idx", "record_idx", "header", "sequence", "plus", "quality"])

    out = blocks.select("file", "block_idx", "num_records", *(f"{k}_data" for k in names), "phred_offset", "crc32", "orig_seq_size", "orig_qual_size").mapInArrow(run, "file string, block_idx long, record_idx long, header binary, sequence binary, plus binary, quality binary")
    return out.withColumns({c: F.col(c).cast("string") for c in ("header", "sequence", "plus", "quality")})


def write_archive(reads: DataFrame, path: str, offset: int | None = None) -> None:
    """The native archive: Parquet with zstd, a row for each block of a file, block order kept in the files."""
    encode(reads, offset).repartitionByRange(F.col("file"), F.col("block_idx")).sortWithinPartitions("file", "block_idx").write.option("compression", "zstd").parquet(path)


def read_archive(spark: SparkSession, path: str, block_records: int = BLOCK_RECORDS) -> DataFrame:
    return decode(spark.read.parquet(path), block_records)


def compress(spark: SparkSession, source: str, target: str, block_records: int = BLOCK_RECORDS, magic: bool = True, mode: str = "strict", offset: int | None = None, paired: bool = False) -> None:
    """FASTQ, plain or gzip by name or first bytes, to a container file. A container holds one file: for several use write_archive()."""
    ship(spark)
    container.register(spark)
    reads = fastq.read_fastq(spark, source, mode, block_records, magic)
    refused = F.raise_error(F.format_string("record '%s': sequence length %d has ambiguous bases beyond position 65536", "header", F.length("sequence")))
    reads = reads.withColumn("sequence", F.when(R.ambiguous_too_far(F.col("sequence")), refused).otherwise(F.col("sequence")))
    if len(found := spark.read.format("binaryFile").load(source).select("path").limit(2).collect()) > 1:
        raise ValueError(f"a container holds one file; {source} has several, such as {found[0].path}")
    offset = detect_offset(reads) if offset is None else offset
    write_container(reads, target, offset, block_records, flags=FLAG_PAIRED if paired else 0)


def write_container(reads: DataFrame, target: str, offset: int, block_records: int = BLOCK_RECORDS, version: int = 2, flags: int = 0) -> None:
    """Reads of one file to a container. flags are kept in its header; the bit of the offset is set by the offset."""
    ship(reads.sparkSession)
    container.register(reads.sparkSession)
    n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    raw = [F.col(c).cast("binary").alias(c) for c in ("header", "sequence", "plus", "quality")]
    rows = reads.repartition(n, "block_idx").sortWithinPartitions("block_idx", "record_idx").select("block_idx", "record_idx", *raw)
    rows.write.format("fqz").option("offset", offset).option("blockRecords", block_records).option("version", version).option("flags", flags).mode("append").save(target)


def read_container(spark: SparkSession, source: str, columns: list[str] | None = None) -> DataFrame:
    """Records of a container, or only these columns of them: streams of other columns are not unpacked."""
    ship(spark)
    container.register(spark)
    fields = [f for f in container.SCHEMA.split(", ") if columns is None or f.split()[0] in columns]
    return spark.read.format("fqz").schema(", ".join(fields)).load(source)


def flags(source: str) -> int:
    """The flags in a container's header."""
    return container.block_headers(container._local(source))[0][2]


def decompress(spark: SparkSession, source: str, target: str) -> None:
    """A container file to FASTQ text parts in record order."""
    out = read_container(spark, source)
    text = [F.col(c).cast("string").alias(c) for c in ("header", "sequence", "plus", "quality")]
    fastq.write_fastq(out.select(F.lit(source).alias("file"), "record_idx", *text), target)


def scramble(reads: DataFrame, seed: str | int = 0) -> DataFrame:
    """Reads with the bases of each in a hashed order; everything else unchanged."""
    return reads.withColumn("sequence", R.scrambled(F.col("sequence"), F.col("record_idx"), seed))


def info(spark: SparkSession, source: str) -> DataFrame:
    """One row for each block, from headers only."""
    _, blocks = container.block_headers(container._local(source))
    rows = [(b["block_idx"], b["num_records"], b["orig_seq_size"], b["orig_qual_size"], b["payload"]) for b in blocks]
    return spark.createDataFrame(rows, "block_idx long, num_records long, orig_seq_size long, orig_qual_size long, compressed_size long")


def check(spark: SparkSession, source: str) -> int:
    """Decodes everything and returns the number of records; damage raises."""
    whole = F.sum(sum((F.octet_length(c) for c in ("header", "sequence", "plus", "quality")), F.lit(0)))
    return read_container(spark, source).agg(F.count("*").alias("n"), whole.alias("bytes")).first().n
