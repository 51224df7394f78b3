"""Document fingerprints: I-Match with several randomised lexicons.

The lexicon keeps the terms whose share of documents lies in a band: log(1 / BAND_HIGH) <= idf <= log(1 / BAND_LOW).
As the shares of all terms sum to the mean number of distinct terms of a document, the lexicon holds at most that mean
divided by BAND_LOW, however large the corpus is, so it goes to every task. Where long documents would make that bound larger than
``MOST_TERMS``, the lower end of the band rises until the bound is MOST_TERMS. Counts cover all documents: each task counts its
own terms, partial counts are summed by term.

A fingerprint has one hash for each of the randomised lexicons (RATES). Lexicon s keeps each term with probability RATES[s],
decided by a hash of term and s; a document's distinct kept terms, sorted, are hashed; "-" where it has none. Coarse rates
serve short documents, fine ones long documents. Likeness: the share of equal hashes among the lexicons in which either
document has terms, 1 for equal fingerprints of which a lexicon has terms.

Defined results: null text: as empty. Texts without a term of the lexicon: "0:" and a hash of the text, like only an equal
fingerprint. Ties of doc_id: by a hash of the text, then alike; null doc_ids come last in the descending order. One document: its own next.
No documents: no rows. Whole texts count, however long. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, prepare, written

BAND_LOW, BAND_HIGH = 5e-4, 0.2
RATES = (1.0,) + (1 / 16,) * 12 + (1 / 64,) * 20 + (1 / 256,) * 20 + (1 / 1024,) * 12
MOST_TERMS = 1_000_000
_EMPTY = "-"


def _tokens(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of documents by term hash, flushed at a bounded number of terms."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in counts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(counts.values()), pa.int64())], ["term", "df"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(_tokens(text))
        if len(counts) > 500_000:
            yield flush()
            counts.clear()
    if counts:
        yield flush()


def lexicon(spark: SparkSession, docs: DataFrame, low: float = BAND_LOW, high: float = BAND_HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band; at most (mean distinct terms of a document) / low of them, and at most MOST_TERMS."""
    prepare(spark)
    n = docs.count()
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    terms, at = written(spark, counted.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n))), "lexicon")
    size, total = terms.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    kept = terms if size <= MOST_TERMS else terms.where(F.col("df") >= total / MOST_TERMS)  # no more than MOST_TERMS terms can stand in so many documents
    out = np.sort(np.asarray(kept.select("term").toArrow().column("term").to_numpy(), np.int64))
    drop(spark, at)
    return out


class Fingerprints:
    def __init__(self, terms: np.ndarray, rates: tuple[float, ...] = RATES):
        self.terms, self.rates = terms.view(np.uint64), rates
        self.place = {int(t): i for i, t in enumerate(terms)}
        # lexicons of each term, bit by bit
        self.member = np.zeros((len(rates), len(terms)), bool)
        for s, rate in enumerate(rates):
            h = self._mix(self.terms, s)
            self.member[s] = (h >> np.uint64(11)).astype(np.float64) / float(1 << 53) < rate
        self.known: dict[str, int] = {}

    @staticmethod
    def _mix(x: np.ndarray, seed: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(32))

    def places(self, tokens: set[str]) -> np.ndarray:
        known, out = self.known, []
        if len(known) > 400_000:
            known.clear()
        for t in tokens:
            at = known.get(t)
            if at is None:
                h = xxhash.xxh3_64_intdigest(t)
                at = known[t] = self.place.get(h - (1 << 64) if h >= 1 << 63 else h, -1)
            if at >= 0:
                out.append(at)
        return np.sort(np.array(out, np.int64))

    def of(self, text: str | None) -> list[str]:
        places = self.places(_tokens(text))  # sorted distinct terms
        if not len(places):
            return ["0:" + xxhash.xxh3_64_hexdigest(text or "")]
        out: list[str] = []
        member, terms = self.member[:, places], self.terms[places]
        for s in range(len(self.rates)):
            kept = terms[member[s]]
            out.append(xxhash.xxh3_64_hexdigest(kept.tobytes(), seed=s)[:6] if len(kept) else _EMPTY)
        return out


def likeness(a: list[str], b: list[str]) -> float:
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.0
    either = [(x, y) for x, y in zip(a, b, strict=True) if x != _EMPTY or y != _EMPTY]
    return sum(x == y for x, y in either) / len(either) if either else 0.0


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _ties(parts: int) -> np.ndarray:
    """Cuts of the hashes of texts into equal parts."""
    return np.array([-(1 << 63) + (i << 64) // parts for i in range(parts)], np.int64)


def _ranges(ids, ties, cuts: list[tuple[int, int]], nulls: int):
    """The range of each row in descending order of ids, then ascending order of ties. A cut (id, parts) begins a range with that id;
    an id that holds many rows has several parts, cut by the ties, and so have nulls, which come after all."""
    import pandas as pd

    known, tie = ids.notna().to_numpy(), ties.to_numpy()
    rising, parts = np.array([c for c, _ in cuts][::-1], np.int64), np.array([p for _, p in cuts][::-1], np.int64)
    above = np.concatenate([np.cumsum(parts[::-1])[::-1], [0]])  # ranges that begin with the cut or a larger one
    x = ids.fillna(0).astype("int64").to_numpy()
    out = above[np.searchsorted(rising, x, side="right")]
    for c, p in cuts:
        here = known & (x == c)
        out[here] += np.searchsorted(_ties(p), tie[here], side="right")
    # ids between two cuts are in the last range of the cut above them
    out[~known] = int(parts.sum()) + np.searchsorted(_ties(nulls)[1:], tie[~known], side="right") + 1
    return pd.Series(out.astype(np.int32))


def fingerprinted(spark: SparkSession, docs: DataFrame, terms: np.ndarray | None = None, partitions: int | None = None) -> DataFrame:
    """doc_id, n_chars, fingerprint; edited_sha256 and edited_fingerprint of each text edited with the next one in descending order of
    doc_id; near_edited and near_next.

    One shuffle: documents are range-partitioned in that order; the first of each range also goes to the range before it.
    """
    prepare(spark)
    terms = lexicon(spark, docs) if terms is None else terms
    shared = spark.sparkContext.broadcast(terms)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows, empty = docs.agg(F.count("*"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    found = base.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    cuts = sorted(Counter(int(c) for c in found).items(), reverse=True)  # an id is found as often as it fills a range
    nulls = max(1, -(-empty * n // max(1, rows)))
    range_of = F.pandas_udf(lambda ids, ties: _ranges(ids, ties, cuts, nulls), "int")
    placed = base.withColumn("place", range_of("doc_id", "tie"))
    least = F.lit(-(1 << 63))
    order = F.struct(F.coalesce(F.col("doc_id"), least).alias("d"), (-F.col("tie").cast("decimal(20,0)")).alias("t"))
    heads = placed.groupBy("place").agg(F.max(order).alias("h")).select("place", F.col("h.d").alias("d"), (-F.col("h.t")).cast("long").alias("t")).orderBy("place").collect()  # one row for each range
    rows = [(h.place, h.d, h.t, heads[i - 1].place) for i, h in enumerate(heads)]  # before the first range: the last
    first = F.broadcast(spark.createDataFrame(rows, "place int, d long, t long, before int"))
    own = F.struct("place", F.lit(False).alias("last"))
    is_head = (F.coalesce(F.col("doc_id"), least) == F.col("d")) & (F.col("tie") == F.col("t"))
    spread = placed.join(first, "place").withColumn("to", F.explode(F.when(is_head, F.array(own, F.struct(F.col("before").alias("place"), F.lit(True).alias("last")))).otherwise(F.array(own))))
    spread = spread.select("doc_id", "text", "tie", F.col("to.place").alias("place"), F.col("to.last").alias("last"))
    ranged = spread.repartitionById(sum(p for _, p in cuts) + 1 + nulls, F.col("place")).sortWithinPartitions("place", "last", F.col("doc_id").desc_nulls_last(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Fingerprints(shared.value)
        held = None  # (place, doc_id, text, fingerprint) that waits for the next
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        done: set[int] = set()
        for batch in batches:
            for doc_id, text, spot, last in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last and spot in done:
                    continue  # equal heads: one is enough
                mark = marks.of(text)
                if held is not None and held[0] == spot:
                    _, d, t, f = held
                    new = edited(t, text)
                    g = marks.of(new)
                    out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), " ".join(f), " ".join(g), likeness(f, g), likeness(f, mark)))
                held = None if last else (spot, doc_id, text, mark)
                if last:
                    done.add(spot)
            if len(out) >= 1000:
                yield flush()
                out = []
        if out:
            yield flush()

    return ranged.select("doc_id", "text", "place", "last").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
