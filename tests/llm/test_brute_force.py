"""Operators without SQL against plain recomputations, and the edge cases that the others share."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from basecairn.llm import imatch, language_id, near_dedup, pii, sampled_pieces, toxicity
from basecairn.llm.queries import tokenizer_path

from test_operators import KEY, brute_components, docs, edge_rows, sentence


def shifted(half, other, n, alphabet, kind, i, sign):
    d = hashlib.sha512(f"{KEY}:{kind}:{n}:{i}:{other}".encode()).digest()
    return "".join(alphabet[(alphabet.index(c) + sign * d[j]) % len(alphabet)] for j, c in enumerate(half))


def brute_permuted(value, alphabet, kind, inverse=False):
    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(pii.ROUNDS)[:: -1 if inverse else 1]:
        if i % 2 == 0:
            left = shifted(left, right, len(value), alphabet, kind, i, -1 if inverse else 1)
        else:
            right = shifted(right, left, len(value), alphabet, kind, i, -1 if inverse else 1)
    return left + right


def test_permutations_like_brute_force(spark):
    r = random.Random(6)
    for alphabet, kind, sizes in ((pii.DIGITS, "card", (1, 2, 12, 18)), (pii.HEX, "token", (8, 32, 64)), (pii.ALNUM, "email", (3, 17)), (pii.UPPER, "key", (16,))):
        values = ["".join(r.choice(alphabet) for _ in range(n)) for n in sizes for _ in range(10)]
        df = spark.createDataFrame([(v,) for v in values], "v string").select("v", F.expr(pii.permuted("v", alphabet, kind, KEY)).alias("p"))
        got = df.select("v", "p", F.expr(pii.permuted("p", alphabet, kind, KEY, True)).alias("back")).collect()
        assert all(x.p == brute_permuted(x.v, alphabet, kind) and x.back == x.v == brute_permuted(x.p, alphabet, kind, True) for x in got)


def test_pseudonyms_of_edge_cases(spark):
    schema = "doc_id long, text string, pii string, kind string"
    none = pii.pseudonymised(spark.createDataFrame([], schema), KEY)
    assert none.count() == 0 and none.columns.count("pii") == 1
    long = "word " * 200_000 + "a@b.example " + "x" * 200_000
    out = pii.pseudonymised(spark.createDataFrame([(1, "8.8.8.8", "old", "k")] * 3 + [(None, long, None, None)], schema), KEY).collect()
    assert len({r.text for r in out[:3]}) == 1 and out[0].text != "8.8.8.8" and out[0].kind == "k"
    assert [p.was for p in out[3].pii] == ["a@b.example"] and len(out[3].text) == len(long)
    other = pii.pseudonymised(spark.createDataFrame([(1, "8.8.8.8", "", "")], schema), "another key").first()
    assert other.text != out[0].text


def test_machine_scores_and_terms_like_brute_force(spark):
    r = np.random.default_rng(4)
    m = toxicity.FactorizationMachine(np.arange(20), -0.3, r.normal(size=20), r.normal(size=(20, 5)))
    for n in (0, 1, 2, 9, 20):
        x = r.permutation(20)[:n]
        z = m.bias + sum(m.w[i] for i in x) + sum(float(m.v[a] @ m.v[b]) for k, a in enumerate(x) for b in x[k + 1 :])
        assert m.score(x) == pytest.approx(1 / (1 + math.exp(-z)))
    rows = [(sorted({int(t) for t in r.integers(0, 60, 12)} | ({1000} if i % 3 == 0 else set())), int(i % 3 == 0)) for i in range(200)]
    n, k = len(rows), sum(y for _, y in rows)
    want = []
    for t in sorted({t for terms, _ in rows for t in terms}):
        table = [[sum((t in terms) == a and y == b for terms, y in rows) for b in (1, 0)] for a in (True, False)]
        both = [sum(x) for x in table]
        ratio = 2 * sum(x * math.log(x / (both[a] * (k, n - k)[b] / n)) for a, line in enumerate(table) for b, x in enumerate(line) if x)
        want += [t] if both[0] >= 3 and ratio >= 1.0 else []
    lists = spark.createDataFrame(rows, "terms array<long>, toxic int")
    assert toxicity.chosen(lists, n, k, least=1.0).tolist() == want and 1000 in want and len(toxicity.chosen(lists, n, k, least=0.0, most=7)) == 7


def test_toxicity_of_edge_cases(spark):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    rows = [(i, sentence(i, 20) + (" vile filth" if i % 3 == 0 else "")) for i in range(200)] + [(0, "another text of one id vile filth")] * 2 + [(900, "x" * 300_000 + " vile filth"), (901, None)]
    df = spark.createDataFrame([(i, t, 7.0, "q") for i, t in rows], "doc_id long, text string, toxic_score double, places string")
    out = toxicity.scored(spark, df, toxicity.trained(spark, df, labels))
    got = out.collect()
    assert out.columns.count("toxic_score") == 1 and len(got) == len(rows) and all(0 <= x.toxic_score <= 1 and x.places == "q" for x in got)
    assert next(x for x in got if x.doc_id == 900).toxic_score >= 0.3
    empty = df.limit(0)
    assert toxicity.scored(spark, empty, toxicity.trained(spark, empty, labels)).count() == 0


@pytest.fixture(scope="module")
def lattices():
    return sampled_pieces.Lattices(tokenizer_path("piece_bpe_32k.model"))


def all_segmentations(lattices, text):
    known = {lattices.pieces[i]: int(i) for i in lattices.id}
    out = [([], 0, 0.0)]
    done = []
    while out:
        ids, at, logp = out.pop()
        if at == len(text):
            done.append((tuple(ids), logp))
        for n in range(1, len(text) - at + 1):
            if (i := known.get(text[at : at + n])) is not None:
                out.append(([*ids, i], at + n, logp - sampled_pieces.TEMPER * math.log(i + 1)))
    return done


def test_samples_like_enumerated_lattices(lattices):
    for text in ("ab", "the", "is a", "un été"):
        every = all_segmentations(lattices, sampled_pieces.MARK + text.replace(" ", sampled_pieces.MARK))
        total = math.log(sum(math.exp(x) for _, x in every))
        want = {ids: x - total for ids, x in every}
        got = sampled_pieces.sample(sampled_pieces.Store(lattices), [text], ["k"], samples=len(want) + 3)[0]
        assert {tuple(s[0].tolist()) for s in got} == set(want) and len(got) == len(want)
        assert all(s[1] == pytest.approx(want[tuple(s[0].tolist())], abs=1e-4) and s[3] == 1.0 and s[4] for s in got)
        # the second of two without replacement: p(b) * sum over a of p(a) / (1 - p(a))
        if len(want) > 2:
            runs = sampled_pieces.sample(sampled_pieces.Store(lattices), [text] * 4000, [str(i) for i in range(4000)], samples=2)
            p = {ids: math.exp(x) for ids, x in want.items()}
            top = max(p, key=p.get)
            law = sum(p[a] * p[top] / (1 - p[a]) for a in p if a != top)
            assert np.mean([tuple(x[1][0].tolist()) == top for x in runs]) == pytest.approx(law, abs=0.03)


def test_a_store_that_forgets_gives_the_same_samples(lattices):
    texts = [sentence(i, 25) + f" é{i}ß, 語🙂 {i * 7919}" for i in range(60)]
    whole = sampled_pieces.sample(sampled_pieces.Store(lattices), texts, [str(i) for i in range(60)])
    small = sampled_pieces.Store(lattices)
    small.most = 40
    for _ in range(2):
        for i, t in enumerate(texts):
            got = sampled_pieces.sample(small, [t], [str(i)])[0]
            assert [(s[0].tolist(), s[4]) for s in got] == [(s[0].tolist(), True) for s in whole[i]] and small.count < 400


def test_sampling_of_an_empty_table_and_a_clashing_column(spark):
    df = spark.createDataFrame([(1, "one two", "old", "k")], "doc_id long, text string, pieces string, __key string")
    path = tokenizer_path("piece_bpe_32k.model")
    one = sampled_pieces.sampled(spark, df, path, F.col("doc_id")).first()
    assert len(one.pieces) == 2 and all(s.decoded for s in one.pieces) and sampled_pieces.sampled(spark, df.limit(0), path, F.col("doc_id")).count() == 0


def test_fingerprints_like_brute_force(spark):
    rows = [(i, sentence(i, 12 + i % 30), "a") for i in range(80)] + [(None, sentence(500 + i, 15), "n") for i in range(12)] + [(40, sentence(700 + i, 9), "h") for i in range(30)] + [(100, None, "a"), (101, "zzz", "a"), (102, sentence(3, 15), "b"), (102, sentence(3, 15), "b")]
    df = docs(spark, rows)
    terms = imatch.lexicon(spark, df, low=0.05, high=0.4)
    df_of = defaultdict(int)
    for _, t, _ in rows:
        for w in set((t or "").lower().split()):
            df_of[w] += 1
    n = len(rows)
    band = {w for w, c in df_of.items() if max(2, 0.05 * n) <= c <= max(2, 0.4 * n)}
    hashed = {w: xxhash.xxh3_64_intdigest(w) for w in band}
    assert sorted(terms.view(np.uint64).tolist()) == sorted(hashed.values())

    def mark(text):
        own = sorted((hashed[w] for w in set(text.lower().split()) if w in hashed), key=lambda h: h - (1 << 64) if h >> 63 else h)
        if not own:
            return ["0:" + xxhash.xxh3_64_hexdigest(text)]
        out = []
        for s, rate in enumerate(imatch.RATES):
            kept = [h for h in own if (int(imatch.Fingerprints._mix(np.array([h], np.uint64), s)[0]) >> 11) / float(1 << 53) < rate]
            out.append(xxhash.xxh3_64_hexdigest(b"".join(h.to_bytes(8, "little") for h in kept), seed=s)[:6] if kept else "-")
        return out

    got = imatch.fingerprinted(spark, df, terms, partitions=6).collect()
    assert len(got) == len(rows)
    tie = {t or "": x for t, x in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("x")).distinct().collect()}
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), tie[x[1]]))
    want = []
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        new = imatch.edited(t, following)
        f, g, h = mark(t), mark(new), mark(following)

        def likeness(a, b):
            if a == b:
                return 1.0
            both = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != ("-", "-")] if len(a) == len(b) > 1 else []
            return sum(x == y for x, y in both) / len(both) if both else 0.0

        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), " ".join(f), " ".join(g), likeness(f, g), likeness(f, h)))
    assert sorted((tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) for r in got), key=str) == sorted(want, key=str)


def test_ranges_ascend_in_the_order_of_documents():
    import pandas as pd

    r = np.random.default_rng(8)
    ids = pd.Series([None if x == 0 else int(x) for x in r.integers(0, 40, 3000)], dtype="Int64")
    ties = pd.Series(r.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64))
    place = imatch._ranges(ids.astype(object).where(ids.notna(), None).astype("float64"), ties, [(30, 1), (20, 4), (5, 1)], 3).to_numpy()
    order = sorted(range(3000), key=lambda i: (pd.isna(ids[i]), 0 if pd.isna(ids[i]) else -ids[i], ties[i]))
    assert (np.diff(place[order]) >= 0).all() and place.min() == 0 and place.max() == 1 + 4 + 1 + 3 and len(set(place[(ids == 20).fillna(False).to_numpy(bool)])) == 4


def test_languages_like_brute_force(spark):
    r = random.Random(5)
    words = {"en": "the and of with this from that", "de": "der und die nicht ist ein von", "fr": "le et les des une pas dans"}
    d = spark.createDataFrame([(i, " ".join(r.choice(words[x].split()) for _ in range(60)), x) for i, x in enumerate(["en", "de", "fr"] * 15)], "doc_id long, text string, lang string")
    model = language_id.trained(d)
    pages = []
    for i in range(60):
        x = r.choice(["en", "de", "fr"])
        html = "" if i % 11 == 0 else f"<html{r.choice(['', f' lang={x}'])}><p>{' '.join(r.choice(words[x].split()) for _ in range(r.randint(0, 6)))}</p>"
        pages.append((i, f"http://{r.choice(['a', 'b', 'c', 'd'])}.{x}x.{r.choice([x, 'com'])}/p", html if i % 13 else None))
    pages += [pages[5], pages[5], (None, None, None), (70, "nonsense", "<html lang='de'>")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, declared string")
    own, host, said = [], [], []
    for _, url, html in pages:
        z = model.loglik(language_id.page_text(html)) * language_id.TEMPER
        own.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        host.append(url.split("/")[2] if url and "://" in url else "")
        said.append(language_id.declared_language(html))
    own = np.array(own)
    domain, suffix = [".".join(h.split(".")[-2:]) for h in host], [h.split(".")[-1] for h in host]
    everything = own.sum(0)
    base = (everything + 1) / (everything.sum() + len(model.langs))
    want = []
    for i in range(len(pages)):
        rest = lambda keys: sum((own[j] for j in range(len(pages)) if keys[j] == keys[i]), np.zeros(3)) - own[i]  # noqa: E731, B023
        clip = lambda x: np.maximum(x, 0)
        p_domain = (clip(rest(domain)) + 5 * base) / (clip(rest(domain)).sum() + 5)
        p_host = (clip(rest(host)) + 5 * p_domain) / (clip(rest(host)).sum() + 5)
        post = np.log(own[i] / own[i].max()) + np.log(p_host)
        for keys in (said, suffix):
            post += np.log((clip(rest(keys)) + 0.5) / (everything - own[i] + 0.5 * len(set(keys))))
        want.append((pages[i][0], model.langs[int(post.argmax())], round(float(1 / np.exp(post - post.max()).sum()), 6), said[i], host[i]))
    got = language_id.identified(spark, df, model).collect()
    assert sorted(((x.page_id, x.lang, round(x.probability, 6), x.declared, x.host) for x in got), key=str) == sorted(want, key=str)
    assert language_id.identified(spark, df.limit(0), model).count() == 0


def test_a_long_text_among_near_copies(spark):
    base = sentence(77, 20_000).split()
    rows = []
    for i in range(6):
        w = list(base)
        for j in range(0, len(w), 400 + 50 * i):
            w[j] = f"edit{i}"
        rows.append((i, " ".join(w), "a"))
    rows += [(50 + i, " ".join(base[i * 3000 : i * 3000 + 3000]), "b") for i in range(6)] + [(90, sentence(5, 40), "c")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark, docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_pipeline_stages_like_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    rows = edge_rows() + [(200 + i, sentence(200 + i, 25) + (" vile filth a@b.example" if i % 2 else " mail c@d.example"), ["x", "y", None][i % 3]) for i in range(60)]
    spark.createDataFrame([(i, i % 2) for i in range(200, 260)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = docs(spark, rows).withColumn("toxic_score", F.lit(1.0))
    held = lambda x: sorted(((r.doc_id, r.text, r.source) for r in x), key=str)
    stages = dict(P.STAGES)
    model = toxicity.trained(spark, df, spark.read.parquet(str(tmp_path / "labels.parquet")))
    known = toxicity._Terms({int(t): i for i, t in enumerate(model.terms)})
    clean = [(i, t, s) for i, t, s in rows if model.score(toxicity.terms_of(t, known)) < toxicity.THRESHOLD]
    got = stages["toxicity"](spark, df, str(tmp_path)).collect()
    assert held(got) == sorted(clean, key=str) and len(clean) < len(rows)
    at = spark.createDataFrame(got, ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in P.COLUMNS))
    group = brute_components([x for x in clean if x[0] is not None])
    got = stages["near_dedup"](spark, at, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted([str(i) for i in {c for _, c in group.values()}] + ["None"] * sum(i is None for i, _, _ in clean))
    at = spark.createDataFrame(got, at.schema)
    got = stages["pii"](spark, at, str(tmp_path)).collect()
    for before, after in zip(sorted(at.collect(), key=lambda r: str(r.doc_id)), sorted(got, key=lambda r: str(r.doc_id)), strict=True):
        t = before.text
        if t and "c@d.example" in t:
            t = t.replace("c@d", brute_permuted_mail("c") + "@d")
        assert after.text == t and after.n_chars == (None if t is None else len(t))
    at = spark.createDataFrame(got, at.schema)
    mixed = stages["mixing"](spark, at, str(tmp_path)).collect()
    words = lambda t: len((t or "").split())
    own = {}
    for r in at.collect():
        own.setdefault((r.doc_id, r.source), []).append(r.text)
    assert mixed and all(any((r.text or "") == t or " ".join((t or "").split()).startswith(r.text) for t in own[r.doc_id, r.source]) for r in mixed)
    assert sum(words(r.text) for r in mixed) == pytest.approx(sum(words(r.text) for r in at.collect()), abs=5) and all(r.n_chars == len(r.text) for r in mixed)
    last = stages["sampled_pieces"](spark, spark.createDataFrame(mixed, at.schema), str(tmp_path)).collect()
    assert len(last) == len(mixed) and all(s.decoded for r in last for s in r.pieces)
    for name, stage in P.STAGES:
        nothing = stage(spark, df.limit(0), str(tmp_path))
        assert nothing.count() == 0 and (name == "sampled_pieces" or nothing.columns == P.COLUMNS)


def brute_permuted_mail(local):
    """The default key of the queries permutes a local part of small letters."""
    global KEY
    kept, KEY = KEY, "test key"
    try:
        return brute_permuted(local, pii.LOWER, "email")
    finally:
        KEY = kept
