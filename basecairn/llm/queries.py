"""Thin queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import imatch, language_id, licences, mixing, near_dedup, pii, rp_forest, sampled_pieces, token_files, toxicity
from .common import prepare, table, written


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pii_key(spark: SparkSession) -> str:
    """The secret of the pseudonyms: spark.basecairn.piiKey; without it a key for tests, which protects nothing."""
    return spark.conf.get("spark.basecairn.piiKey", "test key")


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, host of every page."""
    return language_id.identified(spark, table(spark, sf_dir, "pages"), language_id.trained(table(spark, sf_dir, "documents")))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with pseudonyms, and how many values of each kind were replaced."""
    prepare(spark)
    found = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))
    counts = [F.expr(f"bigint(size(filter(pii, x -> x.kind = '{kind}')))").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", "text", *counts)


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.trained(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(spark, docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    sized, _ = written(spark, table(spark, sf_dir, "documents").select("doc_id", "source", mixing.size_of(F.col("text")).alias("size")), "mix")
    return mixing.mixed(spark, sized).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
with d as (select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end::bigint as size from documents),
t as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, row_number() over (order by source nulls last) - 1 as sid from t),
c as (select *, (sid % 3 + 1)::bigint as weight, source_size * 3 as cap, (source_size * 3)::double / (sid % 3 + 1)::double as ratio from w),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by ratio, sid rows between unbounded preceding and 1 preceding), 0))::double
       / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, sid rows between unbounded preceding and 1 preceding), 0))::double as level from c),
g as (select level from l where level <= ratio order by ratio, sid limit 1),
s as (select l.source, source_size, least(cap::double, weight * coalesce(g.level, 0.0)) as target from l left join g on true),
k as (select d.doc_id, d.size, s.source_size, s.target, sum(d.size) over (partition by d.source order by md5('0:' || coalesce(d.doc_id::varchar, 'null')), d.doc_id, d.size rows between unbounded preceding and 1 preceding) as before
      from d join s on d.source is not distinct from s.source),
e as (select *, case when source_size > 0 then floor(floor(target) / source_size) else 0 end as epochs from k)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - coalesce(before, 0))))::bigint as taken from e
"""


def sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, rank, n_pieces, ids_crc32 (ids as text, comma-separated), log_p, perturbed, inclusion, decoded: two rows for most documents, one without a sample (nulls) where the text is null."""
    found = sampled_pieces.sampled(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"), F.col("doc_id"), keep=["doc_id"], remembered=200_000)
    one = found.select("doc_id", F.explode_outer("pieces").alias("s"))
    return one.select("doc_id", "s.rank", F.array_size("s.ids").cast("long").alias("n_pieces"), F.crc32(F.array_join(F.col("s.ids").cast("array<string>"), ",")).alias("ids_crc32"), "s.log_p", "s.perturbed", "s.inclusion", "s.decoded")


def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = licences.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"), F.size("sentence_ids").cast("long").alias("n_sentences"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprinted(spark, table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language,
    "op2_near_dedup": near_duplicates,
    "op3_pii": pseudonyms,
    "op4_toxicity": toxic,
    "op5_mixing": mix,
    "op6_sampled_pieces": sampled_segmentations,
    "op7_licences": licence_scan,
    "op8_token_files": token_ids,
    "op9_nearest": neighbours,
    "op10_imatch": fingerprints,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op5_mixing": MIX_SQL,
    "op7_licences": licences.oracle("doc_id, array_to_string(sentence_ids, ',') as sentences, array_to_string(licences, ',') as licences, len(sentence_ids)::bigint as n_sentences"),
}
