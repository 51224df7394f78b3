"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(bias + sum w_i + sum_{i<j} <v_i, v_j>) over a text's distinct hashed terms (words and word beginnings),
so a pair of terms can count for more, or less, than both alone.

The model is fitted on the driver on at most ``TRAIN_ROWS`` labelled rows (the least hashes of doc_id), as a bounded
sample; terms are kept if their log-likelihood ratio against the label is at least ``LEAST_RATIO``, at most ``MOST_TERMS``.
They are counted and chosen by a grouped aggregate; the driver gets the chosen terms and each row's places among them.
The fitted model has a bounded size and goes to the tasks; scoring is one pass over the texts without a shuffle.

Defined results: null or empty text: scored as a text without terms. No labelled row or no document: every score is 0.
Rows with one label only: the smoothed share of toxic rows. Null labels are left out; repeated labels of one doc_id: toxic if any is;
several texts of one doc_id: the model sees the one with the least hash, each row is scored. Ties of the ratio: the smaller term.
Whole texts count, however long. A column toxic_score that docs has already is replaced, other columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, prepare, written

TRAIN_ROWS = 8000
LEAST_RATIO = 15.0
MOST_TERMS = 4096
FACTORS = 8
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def terms_of_word(word: str) -> tuple[int, ...]:
    """Hashed terms (32 bits) of a lower-case word: itself, and its first 4, 5 and 6 letters if it is longer."""
    out = [xxhash.xxh32_intdigest(word)]
    out += [xxhash.xxh32_intdigest(word[:n], seed=n) for n in (4, 5, 6) if len(word) > n]
    return tuple(out)


class _Terms(dict):
    """word -> its terms' places in a model, remembered for a bounded number of words."""

    def __init__(self, places: dict[int, int] | None):
        super().__init__()
        self.places = places

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 1 << 19:
            self.clear()
        terms = terms_of_word(word)
        value = self[word] = terms if self.places is None else tuple(self.places[t] for t in terms if t in self.places)
        return value


def terms_of(text: str | None, known: _Terms) -> np.ndarray:
    found: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        if ids := known[word]:
            found.update(ids)
    return np.fromiter(found, np.int64, len(found))


class FactorizationMachine:
    def __init__(self, terms: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.terms, self.bias, self.w, self.v = terms, bias, w, v

    def score(self, places: np.ndarray) -> float:
        z = self.bias
        if len(places):
            places = np.sort(places)
            v = self.v[places]
            z += self.w[places].sum() + 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, factors: int = FACTORS, epochs: int = 30, rate: float = 0.1, decay: float = 1e-3) -> FactorizationMachine:
    """A machine over ``terms`` from each row's places among them and 0/1 labels; the same rows give the same machine."""
    n, k = len(rows), int(labels.sum())
    if not n:
        return FactorizationMachine(np.empty(0, np.int64), -30.0, np.empty(0), np.empty((0, factors)))
    prior = (k + 1) / (n + 2)
    col, row = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(n), [len(r) for r in rows])
    if not 0 < k < n or not len(col):
        return FactorizationMachine(np.empty(0, np.int64), float(np.log(prior / (1 - prior))), np.empty(0), np.empty((0, factors)))
    starts = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(7)
    w, v, bias = np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), factors)), float(np.log(prior / (1 - prior)))
    gw, gv, gb = np.full(len(terms), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(n)
        for lot in np.array_split(order, max(1, n // 64)):
            cols = np.concatenate([col[starts[i] : starts[i + 1]] for i in lot])
            of = np.repeat(np.arange(len(lot)), [starts[i + 1] - starts[i] for i in lot])
            vs = np.zeros((len(lot), factors))
            np.add.at(vs, of, v[cols])
            sq = np.bincount(of, weights=(v[cols] ** 2).sum(1), minlength=len(lot))
            z = bias + np.bincount(of, weights=w[cols], minlength=len(lot)) + 0.5 * ((vs**2).sum(1) - sq)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[lot]
            gb += float(g.sum()) ** 2
            bias -= rate * float(g.sum()) / gb**0.5
            touched, back = np.unique(cols, return_inverse=True)
            dw = np.bincount(back, weights=g[of], minlength=len(touched)) + decay * w[touched]
            dv = np.zeros((len(touched), factors))
            np.add.at(dv, back, g[of, None] * (vs[of] - v[cols]))
            dv += decay * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= rate * dv / np.sqrt(gv[touched])
    return FactorizationMachine(terms, bias, w, v)


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Terms(None)
    for batch in batches:
        lists = [np.sort(terms_of(t, known)) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64())), batch.column(1)], names=["terms", "toxic"])


def chosen(lists: DataFrame, n: int, k: int, least: float = LEAST_RATIO, most: int = MOST_TERMS) -> np.ndarray:
    """The terms of ``lists`` (terms, toxic; n rows, k of them toxic) that stand in at least 3 rows and whose log-likelihood ratio
    against the label is at least ``least``, the ``most`` largest: counted by a grouped aggregate, only the chosen ones come to the driver."""
    if not 0 < k < n:
        return np.empty(0, np.int64)
    counts = lists.select(F.explode("terms").alias("term"), "toxic").groupBy("term").agg(F.count("*").alias("rows"), F.sum("toxic").alias("bad")).where("rows >= 3")
    rows, bad, share = F.col("rows"), F.col("bad"), k / n
    rest = F.greatest(F.lit(n) - rows, F.lit(1e-9))

    def part(a: Column, expected: Column) -> Column:
        return F.when(a > 0, a * F.log(a / expected)).otherwise(0.0)

    ratio = 2 * (part(bad, rows * share) + part(rows - bad, rows * (1 - share)) + part(k - bad, rest * share) + part(n - k - rows + bad, rest * (1 - share)))
    top = counts.withColumn("ratio", ratio).where(F.col("ratio") >= least).orderBy(F.col("ratio").desc(), "term").limit(most)
    return np.array(sorted(r.term for r in top.select("term").collect()), np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def trained(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorizationMachine:
    """Fitted on at most ``rows`` labelled rows that are not held out."""
    prepare(spark)
    marks = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("t")).join(F.broadcast(sample), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min("t").alias("t"), F.first("toxic").alias("toxic")).select("t.text", "toxic")
    lists, at = written(spark, one.mapInArrow(_term_lists, "terms array<long>, toxic int"), "terms")
    n, k = lists.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    terms = chosen(lists, n, k)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat = column.flatten().to_numpy()
            to = np.minimum(np.searchsorted(terms, flat), max(0, len(terms) - 1))
            known = terms[to] == flat if len(terms) else np.zeros(len(flat), bool)
            ends = np.concatenate([[0], np.cumsum(known)])[column.offsets.to_numpy() - column.offsets[0].as_py()].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(to[known].astype(np.int16))), batch.column(1)], names=["places", "toxic"])

    # of at most ``rows`` rows the places among the chosen terms, 2 bytes each
    got = lists.mapInArrow(places, "places array<short>, toxic int").toArrow()
    drop(spark, at)
    found = [np.array(x, np.int16) for x in got.column("places").to_pylist()]
    y = np.asarray(got.column("toxic").to_pylist(), float)
    order = sorted(range(len(found)), key=lambda i: (found[i].tobytes(), y[i]))  # whatever order the tasks ended in
    return fit([found[i] for i in order], y[order], terms)


def scored(spark: SparkSession, docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """docs with toxic_score; no shuffle."""
    prepare(spark)
    shared = spark.sparkContext.broadcast((model.terms, model.bias, model.w, model.v))

    def score(parts):
        import pandas as pd

        machine = FactorizationMachine(*shared.value)
        known = _Terms({int(t): i for i, t in enumerate(machine.terms)})
        for texts in parts:
            yield pd.Series([machine.score(terms_of(t, known)) for t in texts], dtype="float64")

    udf = F.pandas_udf(score, "double", F.PandasUDFType.SCALAR_ITER)
    return docs.withColumn("toxic_score", udf(F.col("text").cast("string")))
