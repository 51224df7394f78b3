import gzip
import random

import pytest

from basecairn.operators import kernels as K
from basecairn.plans import archive
from basecairn.schema import BAD_HEADER, BAD_LENGTHS, BAD_PLUS, INCOMPLETE
from basecairn.sources import fastq

RECORDS = [("read/1 first of three", "TTGACCAtgcaAC", "", "5:?DI##(/5:?D"), ("read/2", "GGCC" * 9, "read/2", "J" * 36), ("read/3 ambiguous", "NACGRTNNACGTYACGN", "", "#5I#?:#/IIJ(5:?D#")]


def text(records):
    return "".join(f"@{h}\n{s}\n+{p}\n{q}\n" for h, s, p, q in records)


def random_records(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = r.choice([0, 1, 2, 3, 4, 5, 63, 150])
        out.append((f"r{i}", "".join(r.choice("ACGTN") for _ in range(k)), r.choice(["", f"r{i}"]), "".join(chr(r.randint(33, 74)) for _ in range(k))))
    out[3] = ("r3", "ACG", "", "@+@")
    return out


def rows(df):
    return [tuple(x if isinstance(x, str) else bytes(x).decode() for x in (r.header, r.sequence, r.plus, r.quality)) for r in df.orderBy("record_idx").collect()]


def brute_streams(records, offset):
    """The six streams, base by base."""
    out = {k: b"" for k in K.ORDER[2]}
    for h, s, p, q in records:
        codes = [("ACGT".index(c) if c in "ACGT" else 0) for c in s.upper()]
        for i in range(0, len(s), 4):
            out["sequence"] += bytes([sum(c << 2 * j for j, c in enumerate(codes[i : i + 4]))])
        values = [(ord(c) - offset) % 256 for c in q]
        out["quality"] += bytes((v - w) % 256 for v, w in zip(values, [0, *values]))
        for name, x in (("header", h), ("plus", p)):
            out[name] += len(x).to_bytes(2, "little") + x.encode()
        at = [i for i, c in enumerate(s) if c not in "ACGTacgt"]
        out["npos"] += b"".join(x.to_bytes(2, "little") for x in [len(at), *at])
        out["lengths"] += len(s).to_bytes(4, "little")
    return out


def test_streams_like_brute_force():
    for records in (RECORDS, random_records(40, 11), [], [("", "", "", "")]):
        for offset in (33, 64):
            cols = [[x.encode() for x in c] for c in zip(*records)] if records else [[], [], [], []]
            assert K.streams(*cols, offset) == brute_streams(records, offset)


def test_pruned_columns_equal_whole_blocks():
    records = random_records(30, 12)
    cols = [[x.encode() for x in c] for c in zip(*records)]
    for version in (1, 2):
        block = K.encode_block(*cols, 33, version)
        whole = dict(zip(("header", "sequence", "plus", "quality"), K.decode_block(block, version, 33)))
        for some in (["header"], ["sequence"], ["plus"], ["quality", "record_idx"], ["sequence", "quality"], ["record_idx"], list(whole)):
            n, got = K.decode_columns(block, version, 33, some)
            assert n == 30 and got == {c: whole[c] for c in some if c in whole}


def test_frames_larger_than_their_header_allows_are_refused():
    with pytest.raises(ValueError, match="decompressing sequences: larger than 10 bytes"):
        K.decompressed(K.compressed(b"x" * 1_000_000), "sequence", 10)
    with pytest.raises(ValueError, match="decompressing headers"):
        K.decompressed(b"not a frame", "header")


def test_flags_offsets_and_pruned_reads_of_a_container(spark, tmp_path):
    records = [(h, s, p, "h" * len(s)) for h, s, p, _ in random_records(25, 9)]
    (tmp_path / "a.fq").write_text(text(records))
    archive.compress(spark, str(tmp_path / "a.fq"), str(tmp_path / "a.fqz"), block_records=10, paired=True)
    assert archive.flags(str(tmp_path / "a.fqz")) == 3 and rows(archive.read_container(spark, str(tmp_path / "a.fqz"))) == [(h, "".join(c if c in "ACGT" else "N" for c in s), p, q) for h, s, p, q in records]
    only = archive.read_container(spark, str(tmp_path / "a.fqz"), ["record_idx", "header"])
    assert only.columns == ["record_idx", "header"] and [bytes(r.header).decode() for r in only.orderBy("record_idx").collect()] == [r[0] for r in records]
    (tmp_path / "b.fq").write_text(text(records))
    with pytest.raises(ValueError, match="a container holds one file"):
        archive.compress(spark, str(tmp_path / "*.fq"), str(tmp_path / "c.fqz"))


def test_archive_refuses_a_wrong_checksum(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "a.fq").write_text(text(RECORDS))
    archive.write_archive(fastq.read_fastq(spark, str(tmp_path / "a.fq")), str(tmp_path / "p"))
    blocks = spark.read.parquet(str(tmp_path / "p"))
    assert archive.decode(blocks).count() == 3 and archive.decode(blocks.drop("crc32")).count() == 3
    with pytest.raises(Exception, match="checksum of block 0 differs"):
        archive.decode(blocks.withColumn("crc32", F.col("crc32") + 1)).collect()


def test_command_line_pipes(spark, tmp_path, monkeypatch, capfdbinary):
    import io
    import types

    from basecairn.cli import main

    records = random_records(20, 10)
    out = io.BytesIO()
    monkeypatch.setattr("sys.stdout", types.SimpleNamespace(buffer=out, write=lambda s: None, flush=lambda: None))
    for given in (text(records).encode(), gzip.compress(text(records).encode())):  # gzip is known by its first bytes
        out.seek(0), out.truncate()
        monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(given)))
        assert main(["compress", "-", "-c", "-b", "7"]) == 0
        packed = out.getvalue()
        out.seek(0), out.truncate()
        monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(packed)))
        assert main(["decompress"]) == 0 and out.getvalue().decode() == text(records)
    assert main(["decompress", str(tmp_path / "missing"), str(tmp_path / "x")]) == 1


def test_container_round_trips_over_several_blocks(spark, tmp_path):
    records = random_records(53)
    (tmp_path / "a.fq").write_text(text(records))
    archive.compress(spark, str(tmp_path / "a.fq"), str(tmp_path / "a.fqz"), block_records=10)
    assert archive.info(spark, str(tmp_path / "a.fqz")).count() == 6
    assert archive.check(spark, str(tmp_path / "a.fqz")) == 53
    assert rows(archive.read_container(spark, str(tmp_path / "a.fqz"))) == records
    archive.decompress(spark, str(tmp_path / "a.fqz"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == text(records)


def test_parquet_archive_round_trips(spark, tmp_path):
    records = random_records(25, 2)
    (tmp_path / "a.fq").write_text(text(records))
    archive.write_archive(fastq.read_fastq(spark, str(tmp_path / "a.fq"), block_records=10), str(tmp_path / "p"))
    assert rows(archive.read_archive(spark, str(tmp_path / "p"), 10)) == records


def test_records_across_splits_crlf_and_gzip(spark, tmp_path):
    records = random_records(3000, 3)
    data = text(records).replace("\n", "\r\n").encode()
    (tmp_path / "a.fq").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert fastq.read_lines(spark, str(tmp_path / "a.fq")).rdd.getNumPartitions() > 1
        assert rows(fastq.read_fastq(spark, str(tmp_path / "a.fq"))) == records
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows(fastq.read_fastq(spark, str(tmp_path / "b.bin"), magic=True)) == records


@pytest.mark.parametrize("data,problem", [("r\nA\n+\nI\n", BAD_HEADER), ("@r\nA\n-\nI\n", BAD_PLUS), ("@r\nAC\n+\nI\n", BAD_LENGTHS), ("@r\nA\n", INCOMPLETE), ("\n@r\nA\n+\nI\n", None)])
def test_bad_records_fail(spark, tmp_path, data, problem):
    (tmp_path / "a.fq").write_text(data)
    with pytest.raises(Exception, match=problem or "invalid FASTQ"):
        fastq.read_fastq(spark, str(tmp_path / "a.fq")).collect()
    if problem:
        assert fastq.read_fastq(spark, str(tmp_path / "a.fq"), mode="tag").first().problem == problem


def test_lenient_drops_an_unterminated_tail(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r\nA\n+\nI\n@s\nC\n+\nI")
    assert rows(fastq.read_fastq(spark, str(tmp_path / "a.fq"), mode="lenient")) == [("r", "A", "", "I")]
    assert len(rows(fastq.read_fastq(spark, str(tmp_path / "a.fq")))) == 2


def test_damage_is_refused_at_every_byte():
    block = K.encode_block([b"r1"], [b"ACGTN"], [b""], [b"IIIII"], 33)
    for cut in range(len(block)):
        with pytest.raises(ValueError):
            K.decode_block(block[:cut], 2, 33)
    with pytest.raises(ValueError, match="ambiguous bases beyond position"):
        K.ambiguous([b"A" * 66_000 + b"N"], [b"r"])
    with pytest.raises(ValueError):
        K.prefixed([b"x" * 65_536], "header")


def test_empty_input(spark, tmp_path):
    (tmp_path / "a.fq").write_text("")
    archive.compress(spark, str(tmp_path / "a.fq"), str(tmp_path / "a.fqz"))
    assert (tmp_path / "a.fqz").stat().st_size == 10 and archive.check(spark, str(tmp_path / "a.fqz")) == 0


def test_magic_reads_plain_files_too(spark, tmp_path):
    from basecairn.cli import main

    plain, zipped = random_records(12, 5), random_records(9, 6)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fq").write_text(text(plain))
    (folder / "b.bin").write_bytes(gzip.compress(text(zipped).encode()))
    (folder / "c.fq.gz").write_bytes(gzip.compress(text(zipped).encode()))
    (folder / "d.fq").write_text("")
    assert rows(fastq.read_fastq(spark, str(folder / "a.fq"), magic=True)) == plain
    mixed = fastq.read_fastq(spark, str(folder), magic=True)
    names = {"a.fq": plain, "b.bin": zipped, "c.fq.gz": zipped}
    assert mixed.count() == 30 and all(rows(mixed.where(mixed.file.endswith("/" + n))) == want for n, want in names.items())
    assert main(["compress", str(folder / "a.fq"), str(tmp_path / "a.fqz"), "--magic"]) == 0
    assert rows(archive.read_container(spark, str(tmp_path / "a.fqz"))) == plain
    archive.compress(spark, str(folder / "d.fq"), str(tmp_path / "d.fqz"), magic=True)
    assert archive.check(spark, str(tmp_path / "d.fqz")) == 0


def test_stream_ingestion(spark, tmp_path):
    from basecairn.streaming.incremental import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fq").write_text(text(random_records(12, 4)))
    q = ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), block_records=5)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).agg({"num_records": "sum"}).first()[0] == 12


def test_stream_ingestion_keeps_files_apart(spark, tmp_path):
    from basecairn.streaming.incremental import ingest

    files = {"a.fq": random_records(12, 7), "b.fq": [(h, s, p, "h" * len(s)) for h, s, p, _ in random_records(8, 8)]}
    (tmp_path / "in").mkdir()
    for name, records in files.items():
        (tmp_path / "in" / name).write_text(text(records))
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), block_records=5).awaitTermination(120)
    assert [p.name for p in (tmp_path / "out").iterdir() if p.is_dir() and p.name.startswith("batch")] == ["batch=0"]
    blocks = spark.read.parquet(str(tmp_path / "out"))
    got = sorted((r.file.rsplit("/", 1)[1], r.block_idx, r.num_records, r.phred_offset) for r in blocks.collect())
    assert got == [("a.fq", 0, 5, 33), ("a.fq", 1, 5, 33), ("a.fq", 2, 2, 33), ("b.fq", 0, 5, 64), ("b.fq", 1, 3, 64)]
    decoded = archive.read_archive(spark, str(tmp_path / "out"), 5)
    assert all(rows(decoded.where(decoded.file.endswith("/" + name))) == records for name, records in files.items())


def test_gzip_by_first_bytes_streams_in_pieces(spark, tmp_path):
    """Files are larger than what Spark reads whole, and come in many splits."""
    records = [(f"{h}/{i}", s, p, q) for i, (h, s, p, q) in enumerate(random_records(400, 21) * 5)]
    whole = text(records).encode()
    (tmp_path / "in").mkdir()
    cases = {
        "members": (gzip.compress(whole[:70_001]) + gzip.compress(whole[70_001:]), whole),
        "stored": (gzip.compress(whole, 0), whole),  # as many line feed bytes as the text has
        "open": (gzip.compress(whole[:-1]), whole[:-1]),
        "returns": (gzip.compress(whole.replace(b"\n", b"\r\n")), whole),
        "feed": (gzip.compress(b"\n") + gzip.compress(whole) + gzip.compress(b"x" * 10, 0), b"\n" + whole + b"x" * 10),
        "plain": (whole, whole),
    }
    for name, (data, _) in cases.items():
        (tmp_path / "in" / name).write_bytes(data)
    confs = {"spark.sql.sources.binaryFile.maxLength": "1000", "spark.sql.files.maxPartitionBytes": "3000"}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        found = fastq.read_gzip_by_magic(spark, str(tmp_path / "in")).collect()
        got = {}
        for r in sorted(found, key=lambda r: (r.file, r.ln)):
            got.setdefault(r.file.rsplit("/", 1)[1], []).append(r)
        assert set(got) == set(cases) - {"plain"}
        for name, rows_ in got.items():
            want = cases[name][1].decode()
            assert [r.ln for r in rows_] == list(range(len(rows_))) and [r.value for r in rows_] == want.removesuffix("\n").split("\n"), name
            assert [r.terminated for r in rows_] == [True] * (len(rows_) - 1) + [want.endswith("\n")], name
        (tmp_path / "cut").write_bytes(cases["stored"][0][:-100])
        with pytest.raises(Exception, match="end-of-stream"):
            fastq.read_gzip_by_magic(spark, str(tmp_path / "cut")).count()
    finally:
        for k in confs:
            spark.conf.unset(k)


def test_lines_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(fastq, "_CHUNK", 7)
    for given in (b"", b"\n", b"a", b"abcdefg", b"abcdefg\n", b"ab\n\n" + b"x" * 40 + b"\nyz\n", b"1234567890123\n123"):
        found = [x for b in fastq._gzip_lines("f", iter([gzip.compress(given)])) for x in b.to_pylist()]
        assert b"".join(x["value"] for x in found) == given and [x["ln"] for x in found] == list(range(given.count(b"\n") + (given[-1:] not in (b"", b"\n"))))
        assert [x["terminated"] for x in found] == [x["value"].endswith(b"\n") for x in found]


def test_offsets_of_more_files_than_are_broadcast(spark, tmp_path, monkeypatch):
    for name, q in (("a", "#"), ("b", "h"), ("c", "h")):
        (tmp_path / f"{name}.fq").write_text(f"@{name}\nACGT\n+\n{q * 4}\n")
    reads = fastq.read_fastq(spark, str(tmp_path))
    for most in (2, 3):
        monkeypatch.setattr(archive, "MOST_FILES", most)
        assert sorted((bytes(r.header_data) != b"", r.phred_offset) for r in archive.encode(reads).collect()) == [(True, 33), (True, 64), (True, 64)]
