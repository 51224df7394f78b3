"""MinHash near-dedup with bottom-k sketches from one hash function.

1. One pass over the texts gives each document its set of 5-word shingles (64-bit hashes), a digest of that
   set and the k smallest hashes (the sketch). Documents with equal sets form a class; only classes go on.
2. Inverted lists of retained values give candidates. Two classes that reach the similarity share at least
   ``least_shared`` retained values (sampling bound below, exact where a set is retained whole), so of each sketch,
   ordered from rare to frequent, only the first ``size - least_shared + 1`` values are listed (prefix filter):
   a passage in thousands of documents is listed only for documents that hardly consist of anything else.
3. Of the listed classes the whole sets are counted: a class too many of whose values no other class has links with
   nothing. Each list is first compared with its most central member; what links falls into one component. Then only
   members of different components are compared, found by exact prefixes of the whole sets: a group of copies never meets itself in
   all pairs, and what resembles it without reaching the similarity is not compared with all of it.
4. The sketch of the union estimates the similarity and drops clear misses; the whole sets confirm the rest.
5. Components by alternating large-star and small-star rounds.

A set of over 72 values is drawn from, so its bound of shared values may lose a pair at the very threshold, with a probability of about
1e-9 (six standard deviations); pairs of smaller sets, and more similar pairs sooner, are never lost.

Defined results: null or blank text: an empty set, linked with nothing. Null doc_id: no component (null), kept.
Repeated rows and rows that share a doc_id: one node. No documents: no rows. Whole texts count, however long. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, drop, prepare, written

WORDS = 5
SIMILARITY = 75  # per cent
SKETCH = 96
#: Standard deviations between the mean of shared values of a pair at the threshold and the least that is asked for.
DEVIATIONS = 6.0
#: How many of the next rarer values a value in an exact prefix carries.
RARER = 32
_SIGN = np.uint64(1 << 63)
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class WordHashes(dict):
    """word -> 64-bit hash, remembered for a bounded number of words."""

    most = 1 << 19

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes | None, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes as int64 (order as unsigned): A-Z lower-cased, ASCII white space apart. Fewer words: the sequence as one."""
    tokens = (text or b"").lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.int64)
    if n < words:
        h = np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=n)], dtype=np.uint64)
    else:
        each = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, n)
        h = each[: n - words + 1] * _MULT[0]
        for i in range(1, words):
            h = h + each[i : n - words + 1 + i] * _MULT[i % len(_MULT)] + np.uint64(i)
        h = _mixed(h)
    return np.unique((h ^ _SIGN).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def _sketcher(sketch: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [shingles(t, hashes) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), _lists(sets if whole else [s[:sketch] for s in sets])],
                names=["doc_id", "n_shingles", "digest", "hashes"],
            )

    return run


def _with_sets(docs: DataFrame, sketch: int = SKETCH, whole: bool = False) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sketcher(sketch, whole), "doc_id long, n_shingles long, digest binary, hashes array<long>")


def _least_shared(n: Column, sketch: int, similarity: int) -> Column:
    """Of the retained values of a set of n, how many a partner at the threshold shares at least. A set of up to similarity * sketch
    meets only partners retained whole, so the bound is exact; beyond, the count is a draw without replacement."""
    s = similarity / 100
    exact = F.ceil(n * similarity / 100)
    spread = F.sqrt(F.lit(sketch * s * (1 - s)) * F.greatest(F.lit(0.0), 1 - sketch * s / n))
    drawn = F.floor(sketch * s - DEVIATIONS * spread)
    return F.when(n <= math.floor(sketch * s), exact).otherwise(F.greatest(F.lit(1), drawn)).cast("int")


def connected_components(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, root) for every node of the undirected edges (a, b); root is the least node of its component.

    Alternating large-star and small-star rounds (logarithmic in practice); each round is a written table.
    Returns also the paths to drop once the result has been used.
    """
    e, path = written(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    paths, before = [path], None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e, path = written(spark, small, "edges")
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        drop(spark, paths.pop())
        paths = [path]
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")), paths


def _reachable(pa_: str, pb: str, similarity: int) -> Column:
    """No pair (a, b) that fails this can reach the similarity: by sizes, and by how many of their values any other class has at all."""
    need = (F.col(f"n_{pa_}") + F.col(f"n_{pb}")) * similarity
    sizes = F.least(f"n_{pa_}", f"n_{pb}") * 100 >= F.greatest(f"n_{pa_}", f"n_{pb}") * similarity
    return sizes & (F.least(f"possible_{pa_}", f"possible_{pb}") * (100 + similarity) >= need)


def _confirmed(spark: SparkSession, pairs: DataFrame, sketches: DataFrame, sets: DataFrame, sketch: int, similarity: int) -> tuple[DataFrame, str]:
    """Of candidate pairs (a, b) of digests those whose whole sets reach the similarity: union sketches first, then the sets."""
    side = lambda df, x: df.select(F.col("digest").alias(x), F.size("hashes").alias(f"n_{x}"), F.col("hashes").alias(f"h_{x}"))
    brief = sketches.select("digest", F.slice("hashes", 1, sketch).alias("hashes"))
    both = pairs.join(side(brief, "a"), "a").join(side(brief, "b"), "b")
    union = F.slice(F.array_sort(F.array_union("h_a", "h_b")), 1, sketch)
    shared = F.size(F.array_intersect(F.array_intersect("h_a", "h_b"), union))
    likely = both.where(shared >= _least_shared(F.greatest("size_a", "size_b"), sketch, similarity)).select("a", "b")
    common = F.size(F.array_intersect("h_a", "h_b"))
    sure = likely.join(side(sets, "a"), "a").join(side(sets, "b"), "b").where(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * similarity).select("a", "b")
    return written(spark, sure, "links")


def near_duplicates(spark: SparkSession, docs: DataFrame, sketch: int = SKETCH, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links of at least the similarity), kept (doc_id = component_id), for every row of docs."""
    prepare(spark)
    base, _ = written(spark, _with_sets(docs, sketch), "sketches")
    ids = base.where("digest is not null and doc_id is not null")
    classes = ids.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    # one sketch for each class; a doc_id with several texts joins their classes below
    # rows of equal text and doc_id are one; where none is repeated, as narrow counts tell, sketches and sets need no shuffle for that
    repeated = bool(ids.groupBy("digest", "doc_id").count().where("count > 1").take(1))
    once = (lambda df: df.dropDuplicates(["digest", "doc_id"])) if repeated else (lambda df: df)
    reps, reps_at = written(spark, once(ids.join(classes.select(F.col("digest"), F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi")), "classes")
    postings = reps.select("digest", "n_shingles", F.explode("hashes").alias("value"))
    frequent = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    retained = F.least(F.col("n_shingles"), F.lit(sketch))
    listed = F.array_sort(F.collect_list(F.struct("df", "value")))
    prefix = retained - _least_shared(F.col("n_shingles"), sketch, similarity) + 1
    alone = retained - F.size("listed")
    lists, lists_at = written(
        spark,
        postings.join(frequent, "value")
        .groupBy("digest", "n_shingles")
        .agg(listed.alias("listed"))
        .where(prefix - alone > 0)
        .select("digest", "n_shingles", F.explode(F.slice("listed", F.lit(1), (prefix - alone).cast("int"))).alias("x"))
        .select("digest", "n_shingles", F.col("x.value").alias("value")),
        "lists",
    )
    # whole sets of the listed classes; how many of a class's values any other has, and how common they are
    wanted = lists.join(lists.groupBy("value").count().where("count > 1").select("value"), "value", "left_semi").select("digest").distinct()
    ids_of, ids_at = written(spark, reps.select("digest", "doc_id").join(wanted, "digest", "left_semi"), "ids")
    sets, sets_at = written(spark, once(_with_sets(docs.join(bounded(ids_of.select("doc_id").distinct()), "doc_id", "left_semi"), whole=True).join(bounded(ids_of), ["digest", "doc_id"], "left_semi")), "sets")
    values = sets.select("digest", "n_shingles", F.explode("hashes").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    able = values.join(common, "value").groupBy("digest", "n_shingles").agg(F.count("*").alias("possible"), F.sum(F.log("df")).alias("central")).where(F.col("possible") * 100 >= F.col("n_shingles") * similarity)
    known, known_at = written(spark, lists.select("value", "digest").join(able, "digest"), "able")
    # the first partner of a list's members is the member whose values are the most common: of a group of edited copies the one nearest to all
    pivots = known.groupBy("value").agg(F.max(F.struct(F.col("central") / F.col("n_shingles"), "digest", "n_shingles", "possible")).alias("p")).select("value", F.col("p.digest").alias("a"), F.col("p.n_shingles").alias("n_a"), F.col("p.possible").alias("possible_a"))
    members = known.select("value", F.col("digest").alias("b"), F.col("n_shingles").alias("n_b"), F.col("possible").alias("possible_b"))
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("n_a").alias("size_a"), F.col("n_b").alias("size_b")]
    first = members.join(pivots, "value").where("a <> b").where(_reachable("a", "b", similarity)).select(*pair).dropDuplicates(["a", "b"])
    links, links_at = _confirmed(spark, first, reps, sets, sketch, similarity)
    # classes that one doc_id holds together
    several = ids.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).where("a <> z").select("doc_id", "a")
    held = ids.join(several, "doc_id").where("digest <> a").select("a", F.col("digest").alias("b"))
    roots, roots_at = connected_components(spark, links.union(held))
    marked, marked_at = written(spark, known.drop("central").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest")), "marked")
    open_ = marked.join(marked.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("value"), "value", "left_semi")
    # what is still open meets by exact prefixes of the whole sets, rare values first: of a pair at the threshold the larger set
    # has a value of the smaller one's short prefix in its long prefix
    rest = open_.select("digest", "root").distinct()
    ranked = values.join(rest, "digest").join(common, "value").groupBy("digest", "n_shingles", "root").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("listed")).withColumn("possible", F.size("listed").cast("long"))
    ahead = lambda share: (F.col("possible") - F.ceil(F.col("n_shingles") * share[0] / share[1]) + 1).cast("int")
    long, short = ahead((similarity, 100)), ahead((2 * similarity, 100 + similarity))
    before = f"transform(slice(listed, 1, long), (x, i) -> named_struct('at', i, 'value', x.value, 'rarer', transform(slice(listed, greatest(i - {RARER - 1}, 1), least(i, {RARER})), y -> y.value)))"
    prefixes, prefixes_at = written(
        spark,
        ranked.withColumns({"long": long, "short": short}).where("long > 0").select("digest", "n_shingles", "possible", "root", "short", F.explode(F.expr(before)).alias("x"))
        .select("digest", "n_shingles", (F.col("possible") - F.col("x.at")).alias("possible"), "root", F.expr("x.at < short").alias("short"), "x.value", "x.rarer"),
        "prefixes",
    )
    side = lambda x: prefixes.select("value", F.col("short").alias(f"short_{x}"), F.col("digest").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("possible").alias(f"possible_{x}"), F.col("root").alias(f"root_{x}"), F.col("rarer").alias(f"rarer_{x}"))
    # a pair comes from the rarest value that both list; what is rarer is not shared, so `possible` counts from there on. It may come
    # again only where none of the next rarer ones is shared
    second = side("a").where("short_a").join(side("b"), "value").where("(n_a < n_b or n_a = n_b and a < b) and root_a <> root_b").where(_reachable("a", "b", similarity)).where(~F.arrays_overlap("rarer_a", "rarer_b")).select(*pair).dropDuplicates(["a", "b"])
    more, more_at = _confirmed(spark, second, reps, sets, sketch, similarity)
    final, final_at = connected_components(spark, links.union(held).union(more))
    grouped = classes.join(final.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "rep", F.coalesce("root", "digest").alias("root"))
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class, of_at = written(spark, grouped.join(least, "root").select("digest", "component_id"), "components")
    drop(spark, reps_at, lists_at, ids_at, sets_at, known_at, marked_at, prefixes_at, links_at, more_at, *roots_at, *final_at)
    out = base.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs of which near_duplicates keeps the doc_id, one row for each; rows with a null doc_id stay."""
    found, _ = written(spark, near_duplicates(spark, docs).where("doc_id is not null"), "kept")
    gone = bounded(found.where("not kept").select("doc_id"))
    rest = docs.join(gone, "doc_id", "left_anti")
    repeated = found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.take(1):
        return rest
    return rest.join(repeated, "doc_id", "left_anti").unionByName(rest.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
