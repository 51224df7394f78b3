"""Language identification of pages by Bayesian evidence fusion.

posterior(l) ~ prior(l | host) * P(text | l)^TEMPER * P(declared | l) * P(suffix | l)

* text: log likelihoods of hashed character trigrams under models fitted on at most ``FIT_DOCS`` labelled documents (the least
  hashes of doc_id), tempered because trigrams overlap;
* declared markup language (the html element's lang) and the address suffix (last label of the host): each value's share of a
  language's pages by their text posterior, from grouped sums over all pages, smoothed by ``HALF`` a page for each value there is;
* host: grouped sums of text posteriors, smoothed towards the registered domain's, those towards all pages' (each level counts
  ``STRENGTH`` pages);
* a page's own part is taken out of all these sums, so that no page is its own evidence: a lone page falls back to its domain.

Sums of up to ``MOST_KEYS`` hosts are broadcast after a count; more are joined by a shuffle, in which Spark splits the rows of a large host.

Defined results: null or empty html, or no text in it: the text tells nothing and the other evidence decides. Null or odd url: host,
domain and suffix are empty strings, a host of their own. No labelled document: language "und" with probability 1.
Repeated rows: each on its own. Ties go to the language that sorts first. No pages: no rows. Whole pages are read, however long.
Of several labelled texts of one doc_id the model sees the one with the least hash. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, drop, prepare, written

FIT_DOCS = 4000
CELLS = 1 << 15
TEMPER = 0.15
STRENGTH = 5.0
HALF = 0.5
MOST_KEYS = 200_000
_DROP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
# comments and scripts, which are skipped, or the html tag; what isn't closed goes to the end
_HTML = re.compile(r"(?is)<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style)\b.*?(?:</\1\s*>|\Z)|(?P<html><html(?=[\s/>]))")
_ATTRIBUTE = re.compile(r"""(?s)[\s/]*([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_LANG = re.compile(r"(?i)[\s\"']*([a-z]{2,3})")


def page_text(html: str | None) -> str:
    return html_module.unescape(_DROP.sub(" ", html or ""))


def declared_language(html: str | None) -> str:
    """The lang of the first html tag, wherever it stands; comments and scripts are skipped."""
    html = html or ""
    tag = next((m for m in _HTML.finditer(html) if m["html"]), None)
    one = tag and _ATTRIBUTE.match(html, tag.end())
    while one:
        if one[1].lower() == "lang":
            found = _LANG.match(one[2] or one[3] or one[4] or "")
            return found[1].lower() if found else ""
        one = _ATTRIBUTE.match(html, one.end())
    return ""


def cells(text: str) -> np.ndarray:
    """Hashed cells of a text's letter trigrams (lower case, runs of other characters as one space)."""
    flat = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
    c = np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < 3 or not flat.strip():
        return np.zeros(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(49)).astype(np.int64)


class TextModel:
    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table  # log probability of each cell under each language

    def loglik(self, text: str) -> np.ndarray:
        at = cells(text)
        return self.table[at].sum(0) if len(at) else np.zeros(len(self.langs))


def trained(docs: DataFrame, rows: int = FIT_DOCS) -> TextModel:
    known = docs.where("lang is not null and text is not null")
    chosen = known.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "lang", "text")).alias("x")
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(one).select("x.lang", "x.text").toArrow()
    names, texts = sample.column("lang").to_pylist(), sample.column("text").to_pylist()
    langs = sorted(set(names))
    counts = np.full((CELLS, len(langs)), 0.5)
    for lang, text in zip(names, texts, strict=True):
        counts[:, langs.index(lang)] += np.bincount(cells(text), minlength=CELLS)
    return TextModel(langs, np.log(counts / counts.sum(0)) if langs else counts)


def evidence(spark: SparkSession, pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, domain, suffix, declared and the text's posterior for each language; one pass, no shuffle."""
    shared = spark.sparkContext.broadcast((model.langs, model.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = TextModel(*shared.value)
        for batch in batches:
            logs, declared = [], []
            for page in batch.column(1).to_pylist():
                x = m.loglik(page_text(page)) * TEMPER
                logs.append(x - x.max())
                declared.append(declared_language(page))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(declared), batch.column(2), pa.array(logs, pa.list_(pa.float64()))], ["page_id", "declared", "host", "logs"])

    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    found = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"), host.alias("host")).mapInArrow(run, "page_id long, declared string, host string, logs array<double>")
    total = F.aggregate("logs", F.lit(0.0), lambda t, x: t + F.exp(x))
    return found.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1), "own": F.transform("logs", lambda x: F.exp(x) / total)})


def _sums(df: DataFrame, by: str, langs: list[str], name: str) -> DataFrame:
    return df.groupBy(by).agg(F.array(*[F.sum(F.col("own")[i]) for i in range(len(langs))]).alias(name))


def _total(a: str) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def identified(spark: SparkSession, pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, host for every page."""
    prepare(spark)
    langs = model.langs
    if not langs:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit("und").alias("lang"), F.lit(1.0).alias("probability"), F.lit("und").alias("text_lang"), F.lit("").alias("declared"), F.lit("").alias("host"))
    base, base_at = written(spark, evidence(spark, pages, model), "evidence")
    everything = base.agg(F.array(*[F.coalesce(F.sum(F.col("own")[i]), F.lit(0.0)) for i in range(len(langs))]).alias("x")).first().x
    whole = sum(everything)
    prior = [(x + 1) / (whole + len(langs)) for x in everything]
    all_ = F.array(*[F.lit(p) for p in prior])
    hosts = _sums(base.select("host", "own"), "host", langs, "n_host").withColumn("domain", F.substring_index("host", ".", -2))
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.col("n_host")[i]) for i in range(len(langs))]).alias("n_domain"))
    sums = hosts.join(domains, "domain").select("host", "n_host", "n_domain")
    out, paths, totals = base, [base_at], F.array(*[F.lit(e) for e in everything])
    for kind in ("declared", "suffix"):
        # what is declared, or not, is a short list on any web; a longer one is joined by a shuffle
        table, at = written(spark, _sums(base.select(kind, "own"), kind, langs, f"n_{kind}"), kind)
        paths.append(at)
        values = table.count()
        rest = F.zip_with(F.zip_with(f"n_{kind}", "own", lambda n, o: F.greatest(F.lit(0.0), n - o)), F.zip_with(totals, "own", lambda t, o: t - o), lambda n, t: F.log((n + HALF) / (t + HALF * values)))
        out = out.join(bounded(table, 100_000), kind).withColumn(f"log_{kind}", rest)
    hosts_of, at = written(spark, sums, "hosts")
    paths.append(at)
    out = out.join(bounded(hosts_of, MOST_KEYS), "host")
    without = lambda a: F.zip_with(a, "own", lambda n, o: F.greatest(F.lit(0.0), n - o))
    out = out.withColumns({"n_host": without("n_host"), "n_domain": without("n_domain")})
    out = out.withColumn("p_domain", F.zip_with("n_domain", all_, lambda n, p: (n + STRENGTH * p) / (_total("n_domain") + STRENGTH)))
    out = out.withColumn("p_host", F.zip_with("n_host", "p_domain", lambda n, p: (n + STRENGTH * p) / (_total("n_host") + STRENGTH)))
    out = out.withColumn("post", F.transform("logs", lambda x, i: x + F.log(F.element_at("p_host", i + 1)) + F.element_at("log_declared", i + 1) + F.element_at("log_suffix", i + 1)))
    out = out.withColumn("best", F.array_max("post")).withColumn("norm", F.aggregate("post", F.lit(0.0), lambda t, x: t + F.exp(x - F.array_max("post"))))
    names = F.array(*[F.lit(x) for x in langs])
    first = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    found = out.select("page_id", first("post").alias("lang"), (1 / F.col("norm")).alias("probability"), first("logs").alias("text_lang"), "declared", "host")
    result, _ = written(spark, found, "languages")
    drop(spark, *paths)
    return result
