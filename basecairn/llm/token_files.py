"""Token-id output: raw id payloads in shard files with a minimal perfect hash index for constant-time keyed access.

Layout of a shard, one to a file (little-endian; the text writer ends the file with a line feed)::

    magic b"BCTI0001", u32 id width (2 or 4), u32 documents n, u64 ids, u64 bytes of the parts that follow,
    i64 x n doc_ids in order, u8 x n null flags, u64 x n first id of each document within the shard,
    u32 keys m, u32 buckets b, u32 x b displacements, (u32 x m fingerprints, u32 x m document numbers),
    ids

The index is a minimal perfect hash of the shard's m distinct keys (hash and displace): a key's bucket gives a displacement
that sends it to its own of m slots; the slot's fingerprint rejects nearly all absent keys, the stored doc_id all others.
``Index`` finds a key with a few small reads at computed offsets, whatever the sizes; ``lookup`` takes a table of keys.

Documents are range-partitioned by doc_id (and a hash of the text, so that one doc_id or many nulls fill several partitions) and
sorted, so shards hold ascending ranges. The task that writes shards also writes their lines of the manifest. Files are written by
Spark's own writer (as raw bytes in one string column), so lost tasks are committed once and any file system of Spark's can hold them.

Defined results: null or empty text: only the end id. Null doc_ids come first and are not in the index. Repeated
doc_ids stay in order of a hash of their texts, equal rows in any order; the index gives the first. No documents: no shard.
Whole texts are encoded, however long. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, exists, input_bytes, new_path, prepare

MAGIC = b"BCTI0001"
END = 1
SHARD_IDS = 4_000_000
PARTITION_BYTES = 32 << 20
#: A shard goes to the writer in rows of about so many bytes, so that neither arrow nor Spark holds it at once several times.
ROW_BYTES = 256 << 10
#: Bytes of text that are encoded at once.
LOT_BYTES = 2 << 20
HEAD = struct.Struct("<8sIIQQ")
_DIRECT = np.uint32(1 << 31)


def _mix(x: np.ndarray, seed) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (np.asarray(seed, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(keys, 0x5EED) % np.uint64(buckets)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash of distinct uint64 keys: slot(key) = mix(key, displacement of its bucket) mod m;
    a bucket of one key has its slot itself, with the highest bit set."""
    m = len(keys)
    buckets = max(1, -(-m // 3))
    of = _bucket(keys, buckets)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=buckets)
    starts = np.concatenate([[0], np.cumsum(counts)])
    seeds, taken = np.zeros(buckets, np.uint32), np.zeros(m, bool)
    tries = np.arange(1, 65, dtype=np.uint64)
    for b in np.argsort(-counts, kind="stable"):
        if counts[b] < 2:
            break
        own, base = keys[order[starts[b] : starts[b + 1]]], 0
        while True:
            slots = (_mix(own[None, :], (tries + np.uint64(base))[:, None]) % np.uint64(m)).astype(np.int64)
            good = ~taken[slots].any(1)
            if len(own) > 1:
                ordered = np.sort(slots, 1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
            hit = np.flatnonzero(good)
            if len(hit):
                seeds[b] = base + hit[0] + 1
                taken[slots[hit[0]]] = True
                break
            base += len(tries)
    seeds[counts == 1] = np.flatnonzero(~taken).astype(np.uint32) | _DIRECT
    return seeds


def _slots(keys: np.ndarray, seeds: np.ndarray, m: int) -> np.ndarray:
    return _slot(keys, seeds[_bucket(keys, len(seeds))], m)


def _slot(keys: np.ndarray, own: np.ndarray, m: int) -> np.ndarray:
    """The slots of keys, given the displacement of each key's bucket."""
    hashed = (_mix(keys, own.astype(np.uint64)) % np.uint64(m)).astype(np.int64)
    return np.where(own & _DIRECT, np.minimum((own & ~_DIRECT).astype(np.int64), m - 1), hashed)


def _prints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 0xF1A6E4) >> np.uint64(32)).astype(np.uint32)


def shard(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a shard of documents in order: their doc_ids, how many ids each has, and all ids (16 or 32 bits)."""
    n = len(doc_ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], np.int64)
    first = (np.cumsum(counts) - counts).astype(np.uint64)
    places = np.flatnonzero((null == 0) & np.concatenate([[True], (keys[1:] != keys[:-1]) | (null[:-1] == 1)]))
    known = keys[places].view(np.uint64)
    m = len(known)
    seeds = perfect_hash(known) if m else np.zeros(1, np.uint32)
    prints, numbers = np.zeros(m, np.uint32), np.zeros(m, np.uint32)
    if m:
        at = _slots(known, seeds, m)
        prints[at], numbers[at] = _prints(known), places
    width = ids.dtype.itemsize
    parts = [keys.astype("<i8").tobytes(), null.tobytes(), first.astype("<u8").tobytes(), struct.pack("<II", m, len(seeds)), seeds.astype("<u4").tobytes(), prints.astype("<u4").tobytes(), numbers.astype("<u4").tobytes(), ids.astype(f"<u{width}").tobytes()]
    return b"".join([HEAD.pack(MAGIC, width, n, len(ids), sum(map(len, parts))), *parts])


def rows_of(data: bytes) -> Iterator[bytes]:
    """data in rows of about ``ROW_BYTES``, cut at line feed bytes, which go: the text writer ends each row with one."""
    at = 0
    while (cut := data.find(b"\n", at + ROW_BYTES)) >= 0:
        yield data[at:cut]
        at = cut + 1
    yield data[at:]


class Shard:
    """A shard read back: documents by number and by key."""

    def __init__(self, data: bytes | memoryview):
        magic, width, self.n, self.total, size = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        if HEAD.size + size > len(data):
            raise ValueError("truncated token shard")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.keys, self.null, self.first = take("<i8", self.n), take("u1", self.n), take("<u8", self.n)
        m, b = struct.unpack_from("<II", data, at)
        at += 8
        self.seeds, self.prints, self.numbers = take("<u4", b), take("<u4", m), take("<u4", m)
        self.ids = take(f"<u{width}", self.total)

    def document(self, number: int) -> np.ndarray:
        end = int(self.first[number + 1]) if number + 1 < self.n else self.total
        return self.ids[int(self.first[number]) : end]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Document numbers of int64 keys, -1 where absent: one hash, one slot, one comparison each."""
        if not len(self.numbers):
            return np.full(len(keys), -1)
        u = keys.view(np.uint64)
        at = _slots(u, self.seeds, len(self.numbers))
        number = self.numbers[at].astype(np.int64)
        return np.where((self.prints[at] == _prints(u)) & (self.keys[number] == keys), number, -1)


#: Texts that only the tokenizer itself cuts into words: special tokens, the mark, capitals that compose in lower case only.
_WHOLE = "<\\|" + "|\x01|[HJTWY][\u0300-\u036f]"
#: Punctuation (but for the apostrophe, < and |) between a letter or digit and white space is a word of its own.
_TAIL = "([a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f])([!-&(-;=?@\\[-`{}~]+)([\t-\r ]|$)"
#: Stands between words that are encoded in one string.
_MARK = "\x01"


class Encoder:
    """Ids of texts, by a tokenizer that lower-cases, composes, drops white space and keeps letters, digits and other characters
    apart, as ``word_bpe_49k.json`` does. Texts are cut into words by arrow kernels; the tokenizer encodes each word once and
    words are remembered in two generations, so that frequent ones stay."""

    most = 200_000

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.kind = np.dtype("<u4" if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16 else "<u2")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of words, some hundred in one string."""
        out: list[bytes] = []
        groups = [words[at : at + 256] for at in range(0, len(words), 256)]
        for at in range(0, len(groups), 40):
            lot = groups[at : at + 40]
            for own, e in zip(lot, self.tokenizer.encode_batch_fast([f" {_MARK} ".join(g) for g in lot], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.kind)
                cuts = np.flatnonzero(ids == self.mark).tolist() if self.mark is not None else []
                if len(cuts) == len(own) - 1:
                    raw, size = ids.tobytes(), self.kind.itemsize
                    out += [raw[size * a + size : size * b] for a, b in zip([-1, *cuts], [*cuts, len(ids)], strict=True)]
                else:  # the vocabulary has no id of its own for the mark
                    out += [np.array(one.ids, self.kind).tobytes() for one in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
        return out

    def _of_words(self, words: list[str]) -> list[bytes]:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in missing:
            x = found[i] = old.get(words[i])
            if x is None:
                new.append(i)
        for i, x in zip(new, self._encoded([words[i] for i in new]), strict=True):
            found[i] = x
        young.update((words[i], found[i]) for i in missing)
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, an end id after each, one after another; how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, _WHOLE)
        plain = pc.if_else(whole, "", texts)
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(plain), _TAIL, "\\1 \\2\\3"))
        coded = words.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        raw = self._of_words(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(raw), self.kind)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // self.kind.itemsize
        starts = np.cumsum(sizes) - sizes
        size = sizes[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(starts[at] - ends[:-1], size) + np.arange(ends[-1])]
        cuts = ends[np.asarray(words.offsets) - words.offsets[0].as_py()]
        counts = np.diff(cuts)
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(odd):
            each = np.split(ids, cuts[1:-1])
            for i in odd:
                each[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.kind)
            ids, counts = np.concatenate(each), np.array([len(x) for x in each])
        return np.insert(ids, np.cumsum(counts), END), counts + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    """One encoder for each worker process, so that its words outlive a task."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer_file: str, path: str, partitions: int | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encodes every text and writes under path the shards, ascending by (file number, no), and the manifest.

    There are as many partitions as shuffle partitions are set, or more, for ``PARTITION_BYTES`` of input each."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file)
        keys, counts, ids, size, no = [], [], [], 0, 0
        lines = []

        def line(kind: str, no: int, seq: int, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([no], pa.int32()), pa.array([seq], pa.int32()), pa.array([data], pa.binary())], ["kind", "no", "seq", "data"])

        def flush() -> Iterator[pa.RecordBatch]:
            known = [k for k in keys if k is not None]
            lines.append(f"{no},{len(keys)},{size},{known[0] if known else ''},{known[-1] if known else ''}")
            for seq, row in enumerate(rows_of(shard(keys, np.concatenate(counts), np.concatenate(ids)))):
                yield line("ids", no, seq, row)
            pa.default_memory_pool().release_unused()

        def lots() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lot = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // LOT_BYTES
                cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), batch.num_rows]
                yield from (batch.slice(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi > lo)

        for batch in lots():
            got, many = encode(batch.column(1))
            own, ends, lo = batch.column(0).to_pylist(), np.concatenate([[0], np.cumsum(many)]), 0
            while lo < len(own):  # a shard ends with the document that fills it
                hi = min(len(own), int(np.searchsorted(ends, ends[lo] + shard_ids - size)))
                keys += own[lo:hi]
                counts.append(many[lo:hi])
                ids.append(got[ends[lo] : ends[hi]])
                size, lo = size + int(ends[hi] - ends[lo]), hi
                if size >= shard_ids:
                    yield from flush()
                    keys, counts, ids, size, no = [], [], [], 0, no + 1
        if keys:
            yield from flush()
        if lines:
            yield line("manifest", 0, 0, "\n".join(lines).encode())

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // PARTITION_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = texts.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = ordered.mapInArrow(run, "kind string not null, no int not null, seq int not null, data binary").sortWithinPartitions("kind", "no", "seq")
    rows.select("kind", "no", F.col("data").cast("string").alias("value")).write.partitionBy("kind", "no").text(path)  # the order that this write asks for, so it sorts no more


def _part(column: str) -> Column:
    return F.regexp_extract(column, "part-([0-9]+)[^/]*$", 1).cast("int")


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """part, no and content of each shard."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return read.select(_part("path").alias("part"), F.regexp_extract("path", "/no=([0-9]+)/", 1).cast("int").alias("no"), "content")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each shard: part and no (ascending with the documents), documents, total ids, least and largest doc_id; from the lines that the writing tasks left."""
    if not exists(spark, f"{path}/kind=manifest"):
        return spark.createDataFrame([], "part int, no int, documents long, total long, least long, largest long")
    lines = spark.read.text(f"{path}/kind=manifest").select(_part("_metadata.file_path").alias("part"), F.split("value", ",").alias("x"))
    number = lambda i, kind: F.when(F.col("x")[i] != "", F.col("x")[i].cast(kind))
    return lines.select("part", number(0, "int").alias("no"), *(number(i, "long").alias(c) for i, c in enumerate(("documents", "total", "least", "largest"), 1)))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, read from the files."""
    prepare(spark)
    schema = "part int, no int, doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                no, part = (int(x) for x in re.search("/no=([0-9]+)/part-([0-9]+)[^/]*$", path_).groups())
                s = Shard(data.as_buffer())
                number = s.find(s.keys)  # by key, as any reader would; documents without a key of their own by number
                number = np.where((number >= 0) & (s.null == 0) & (s.keys[np.maximum(number, 0)] == s.keys) & (np.concatenate([[True], s.keys[1:] != s.keys[:-1]])), number, np.arange(s.n))
                for lo in range(0, s.n, 2000):
                    rows = range(lo, min(s.n, lo + 2000))
                    ids = [s.document(int(number[i])).astype("<u4") for i in rows]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part] * len(ids), pa.int32()),
                            pa.array([no] * len(ids), pa.int32()),
                            pa.array(s.keys[rows.start : rows.stop], pa.int64(), mask=s.null[rows.start : rows.stop] > 0),
                            pa.array(s.first[rows.start : rows.stop].astype(np.int64)),
                            pa.array([len(x) for x in ids], pa.int64()),
                            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        ],
                        ["part", "no", "doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    if not exists(spark, f"{path}/kind=ids"):
        return spark.createDataFrame([], schema).drop("part", "no")
    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/kind=ids").select("path", "content").mapInArrow(run, schema)  # each expression before would copy the content
    # one row for each shard: sums of the shards of a file, then of files
    sums = manifest(spark, path).select("part", "no", "total")
    parts = sums.groupBy("part").agg(F.sum("total").alias("all")).select("part", F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)).alias("to"), "all")
    inside = Window.partitionBy("part").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.join(parts, "part").select("part", "no", (F.col("to") - F.col("all") + F.coalesce(F.sum("total").over(inside), F.lit(0))).alias("__before"))
    return read.join(bounded(offsets, 100_000), ["part", "no"]).select("doc_id", (F.col("start") + F.col("__before")).alias("start"), "n_tokens", "ids_crc32")


class Index:
    """Keyed access from the driver: the manifest is held (some bytes for each shard); a key costs a few reads of fixed size at
    computed offsets and one of its document's ids, through Spark's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        rows = sorted((r.part, r.no, r.least, r.largest) for r in manifest(spark, path).where("least is not null").collect())
        named = {(r.part, r.no): r.path for r in _names(spark, path)} if rows else {}
        self.files, self.largest, self.least = [named[r[:2]] for r in rows], [r[3] for r in rows], [r[2] for r in rows]

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a document, None if there is none of this doc_id."""
        i = bisect_left(self.largest, key)
        if i == len(self.files) or self.least[i] > key:
            return None
        at = self.jvm.org.apache.hadoop.fs.Path(self.files[i])
        stream = at.getFileSystem(self.conf).open(at)
        try:

            def read(kind: str, offset: int, count: int = 1) -> np.ndarray:
                stream.seek(offset)
                return np.frombuffer(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, count * np.dtype(kind).itemsize)), kind)

            _, width, n, total, _ = HEAD.unpack(read("u1", 0, HEAD.size).tobytes())
            keys, firsts, tables = HEAD.size, HEAD.size + 9 * n, HEAD.size + 17 * n
            m, buckets = (int(x) for x in read("<u4", tables, 2))
            if not m:
                return None
            u = np.array([key], np.int64).view(np.uint64)
            seeds = tables + 8
            own = read("<u4", seeds + 4 * int(_bucket(u, buckets)[0]))
            slot = int(_slot(u, own, m)[0])
            if read("<u4", seeds + 4 * (buckets + slot))[0] != _prints(u)[0]:
                return None
            number = int(read("<u4", seeds + 4 * (buckets + m + slot))[0])
            if read("<i8", keys + 8 * number)[0] != key:
                return None
            start = int(read("<u8", firsts + 8 * number)[0])
            end = int(read("<u8", firsts + 8 * number + 8)[0]) if number + 1 < n else total
            return read(f"<u{width}", seeds + 4 * (buckets + 2 * m) + width * start, end - start)
        finally:
            stream.close()


def _names(spark: SparkSession, path: str) -> list:
    """part, no and path of each shard's file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/kind=ids").select("path")
    return files.select(_part("path").alias("part"), F.regexp_extract("path", "/no=([0-9]+)/", 1).cast("int").alias("no"), "path").collect()


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) for the doc_ids of keys that the files hold: keys go to the shard of their range, only these files are read, each key is one probe."""
    prepare(spark)
    rows = sorted((r.part, r.no, r.least, r.largest) for r in manifest(spark, path).where("least is not null").collect())
    schema = "doc_id long, ids array<long>"
    if not rows:
        return spark.createDataFrame([], schema)
    part, no, least, largest = (np.array(c, np.int64) for c in zip(*rows, strict=True))

    def shard_of(parts):
        import pandas as pd

        for ids in parts:
            x = ids.to_numpy(np.int64)
            i = np.minimum(np.searchsorted(largest, x, side="left"), len(largest) - 1)
            yield pd.Series(np.where((x >= least[i]) & (x <= largest[i]), (part[i] << 31) | no[i], -1))

    place = F.pandas_udf(shard_of, "long", F.PandasUDFType.SCALAR_ITER)
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    placed = wanted.withColumn("place", place("doc_id")).where("place >= 0").groupBy("place").agg(F.collect_list("doc_id").alias("keys"))  # at most a shard's documents
    needed = {r.place for r in placed.select("place").collect()}
    named = {(r.part << 31) | r.no: r.path for r in _names(spark, path)}
    if not needed:
        return spark.createDataFrame([], schema)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                want = np.array(sorted(asked), np.int64)
                s = Shard(data.as_buffer())
                at = s.find(want)
                hit = np.flatnonzero(at >= 0)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(want[hit]), pa.array([s.document(int(at[i])).astype(np.int64) for i in hit], pa.list_(pa.int64()))], ["doc_id", "ids"])

    files = _files(spark, [named[p] for p in sorted(needed)]).withColumn("place", F.shiftleft(F.col("part").cast("long"), 31).bitwiseOR(F.col("no").cast("long")))
    return files.join(placed, "place").select("keys", "content").mapInArrow(probe, schema)


def encoded(spark: SparkSession, docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Writes the shards of docs into the shared folder and reads them back as documents()."""
    path = new_path(spark, "tokens")
    write_shards(spark, docs, tokenizer_file, path)
    return documents(spark, path)
