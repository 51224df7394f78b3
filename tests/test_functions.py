import pytest
from pyspark.sql import functions as F

from basecairn.functions import reads as R


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("q,offset", [('!"#$', 33), ("5III", 33), ("@ABh", 64), ("efgh", 64), ("", 33), (";<=>", 33)])
def test_detects_offset(spark, q, offset):
    assert one(spark, q, lambda x: R.phred_offset(R.lowest_code(x))) == offset


@pytest.mark.parametrize("values,deltas", [([40, 40, 40, 40], [40, 0, 0, 0]), ([40, 39, 38, 37], [40, 255, 255, 255]), ([35], [35]), ([], [])])
def test_delta_and_back(spark, values, deltas):
    df = spark.createDataFrame([(values,)], "v array<int>")
    assert df.select(R.delta_encode(F.col("v")).alias("d")).first().d == deltas
    assert df.select(R.delta_decode(R.delta_encode(F.col("v"))).alias("d")).first().d == values


@pytest.mark.parametrize("seq,packed,n", [("ACGTT", "E403", []), ("acgt", "E4", []), ("NACTGN", None, [0, 5]), ("", "", []), ("R.Y", None, [0, 1, 2])])
def test_packs_and_unpacks(spark, seq, packed, n):
    if packed is not None:
        assert one(spark, seq, R.pack_bases_hex) == packed
    assert one(spark, seq, R.n_positions) == n
    back = one(spark, seq, lambda x: R.unpack_bases_hex(R.pack_bases_hex(x), F.length(x), R.n_positions(x)))
    assert back == one(spark, seq, R.canonical_sequence)


def test_guard_at_the_format_limit(spark):
    assert one(spark, "A" * 65536 + "N", R.ambiguous_too_far)
    assert not one(spark, "N" * 65536 + "a", R.ambiguous_too_far)


def test_scramble_keeps_letters_whatever_the_partitioning(spark):
    df = spark.createDataFrame([(i, "ACGTTGCANN" * 3) for i in range(20)], "record_idx long, s string")
    f = R.scrambled(F.col("s"), F.col("record_idx"), 1)
    a = {r.record_idx: r.y for r in df.repartition(1).select("record_idx", f.alias("y")).collect()}
    b = {r.record_idx: r.y for r in df.repartition(7).select("record_idx", f.alias("y")).collect()}
    assert a == b and all(sorted(y) == sorted("ACGTTGCANN" * 3) for y in a.values()) and len(set(a.values())) > 1
