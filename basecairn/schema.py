"""Fixed values of the read archive, and schemas."""

from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

# fixed values of the interchange format
MAGIC = b"FQZ\0"
VERSIONS = (1, 2)
FLAG_PAIRED, FLAG_PHRED64 = 1, 2
BLOCK_RECORDS = 100_000
DETECT_RECORDS = 100_000
MOST_AMBIGUOUS = 65_536
PHRED33, PHRED64 = 33, 64
LOWEST64 = 64
STREAMS = ("sequence", "quality", "header", "plus", "npos", "lengths")

READS = StructType([StructField("file", StringType()), StructField("record_idx", LongType()), StructField("header", StringType()), StructField("sequence", StringType()), StructField("plus", StringType()), StructField("quality", StringType())])
BLOCKS = StructType(
    [StructField("file", StringType()), StructField("block_idx", LongType()), StructField("num_records", LongType())]
    + [StructField(f"{s}_data", BinaryType()) for s in STREAMS]
    + [StructField("crc32", LongType()), StructField("orig_seq_size", LongType()), StructField("orig_qual_size", LongType()), StructField("phred_offset", IntegerType())]
)

# messages that callers of the format know
BAD_HEADER = "invalid FASTQ: header line must start with @"
BAD_PLUS = "invalid FASTQ: separator line must start with +"
BAD_LENGTHS = "invalid FASTQ: sequence and quality lengths must match"
BAD_MAGIC = "invalid magic bytes: not an FQZ file"
INCOMPLETE = "invalid FASTQ: incomplete record at end of file"
