"""Column functions on reads: bases, qualities, bytes. Built-in expressions where they do the work in one pass; what they would do
base by base, or in quadratic time, are arrow functions over whole batches (``bulk``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bulk
from ..schema import LOWEST64, MOST_AMBIGUOUS, PHRED33, PHRED64


def chars(s: Column) -> Column:
    """Characters of an ASCII string; empty for the empty string."""
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def codes(s: Column) -> Column:
    return F.transform(chars(s), lambda c: F.ascii(c))


def lowest_code(s: Column) -> Column:
    """Least character code, null for the empty string."""
    return F.array_min(codes(s))


def phred_offset(lowest: Column) -> Column:
    """64 if the least byte is 64 to 254, else 33; also 33 where there is no byte."""
    return F.when((lowest >= LOWEST64) & (lowest < 255), PHRED64).otherwise(PHRED33).cast("int")


def normalize_quality(values: Column, offset: Column) -> Column:
    return F.transform(values, lambda x: F.pmod(x - offset, F.lit(256)))


def denormalize_quality(values: Column, offset: Column) -> Column:
    return F.transform(values, lambda x: F.pmod(x + offset, F.lit(256)))


def delta_encode(values: Column) -> Column:
    """First value, then differences modulo 256."""
    return F.arrow_udf(lambda v: bulk.delta(v), "array<int>")(values.cast("array<int>"))


def delta_decode(values: Column) -> Column:
    """Running sums modulo 256."""
    return F.arrow_udf(lambda v: bulk.undelta(v), "array<int>")(values.cast("array<int>"))


def packed_length(s: Column) -> Column:
    return F.floor((F.length(s) + 3) / 4).cast("int")


def canonical_sequence(s: Column) -> Column:
    """What packing and unpacking give: upper-case ACGT, all else N."""
    return F.regexp_replace(F.upper(s), "[^ACGT]", "N")


def n_positions(s: Column) -> Column:
    """0-based places of characters that are not ACGTacgt, within the first 65,536."""
    return F.arrow_udf(lambda v: bulk.ambiguous(v, MOST_AMBIGUOUS), "array<int>")(s)


def overlay_n(s: Column, positions: Column) -> Column:
    return F.arrow_udf(lambda v, at: bulk.overlaid(v, at), "string")(s, positions)


def pack_bases_hex(s: Column) -> Column:
    """Upper-case hex of the packed bases: four to a byte, the first in the low bits; other characters count as A."""
    return F.arrow_udf(lambda v: bulk.pack_hex(v), "string")(s)


def pack_bases(s: Column) -> Column:
    return F.unhex(pack_bases_hex(s))


def unpack_bases_hex(packed: Column, length: Column, positions: Column) -> Column:
    return F.arrow_udf(lambda p, n, at: bulk.unpack_hex(p, n, at), "string")(packed, length, positions)


def u16_hex(n: Column) -> Column:
    """Little-endian hex of an unsigned 16-bit number."""
    h = F.lpad(F.hex(n), 4, "0")
    return F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))


def u32_hex(n: Column) -> Column:
    h = F.lpad(F.hex(n), 8, "0")
    return F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])


def ambiguous_too_far(s: Column, most: int = MOST_AMBIGUOUS) -> Column:
    """An ambiguous base where the interchange format can't note it."""
    return F.substring(s, most + 1, 1 << 30).rlike("[^ACGTacgt]")


def scrambled(s: Column, row: Column, seed: str | int) -> Column:
    """The characters of s in an order decided by a hash of seed, row and place: same composition, whatever the partitioning."""
    seed = str(seed)
    return F.arrow_udf(lambda v, rows: bulk.scrambled(v, rows, seed), "string")(s, row)


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def with_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseOR(F.lit(bit))


def is_gzip(content: Column) -> Column:
    return F.substring(content, 1, 2) == F.unhex(F.lit("1F8B"))


def fastq_text(header: Column, sequence: Column, plus: Column, quality: Column) -> Column:
    """One record as four lines, without the last line feed."""
    return F.concat(F.lit("@"), header, F.lit("\n"), sequence, F.lit("\n+"), plus, F.lit("\n"), quality)
