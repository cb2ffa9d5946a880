"""Importance resampling, toxicity and phrase mining against brute force, on hot groups and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import CLASH, LONG, ODD
from veilspark.llm import collocations as C
from veilspark.llm import importance as I
from veilspark.llm import toxicity as T


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, 1, False, 0.5, 2, "x") for r in ODD], CLASH)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Importance resampling


def by_hand(texts: list, target: list, percent: int, least: int, buckets: int, seed: int = 7) -> dict:
    """Scores and ranks of texts (id, text) as the definition has them."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    grams = lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = collections.Counter(bucket(g) for _, t in texts for g in grams(words(t)))
    t_ = collections.Counter(bucket(g) for t in target for g in grams(words(t)))
    S, T_ = sum(s.values()), sum(t_.values())
    gain = lambda b: math.floor(1000 * math.log((t_[b] + 1) * (S + buckets) / ((s[b] + 1) * (T_ + buckets))))
    out = {}
    for i, t in texts:
        g = grams(words(t))
        weight = sum(gain(bucket(x)) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(words(t)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]
    able = sorted((i for i in out if out[i][0] >= least), key=lambda i: (-out[i][3], i))
    rank = {i: k + 1 for k, i in enumerate(able[: percent * len(able) // 100])}
    return {i: (*v[1:], rank.get(i)) for i, v in out.items()}


@pytest.mark.parametrize("part", [7, 1 << 20])
def test_resampling_by_brute_force(spark, monkeypatch, part):
    draw = random.Random(3)
    vocabulary = ["Alpha", "beta", "gamma-ray", "x1", "été", "日本", "don't", "under_score", "Ωmega"]
    texts = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(0, 40))) + draw.choice(["", "\x00tail", "."])) for i in range(300)]
    target = [" ".join(draw.choice(vocabulary[:3]) for _ in range(30)) for _ in range(20)]
    monkeypatch.setattr(I, "PART_BYTES", part)
    found = [b for batch in [pa.array([t for _, t in texts])] for b in I.features(batch, 997)]
    counts = collections.Counter(x for bucket, _, _ in found for x in bucket.tolist())
    expected = collections.Counter()
    for _, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        expected.update(zlib.crc32(g.encode()) % 997 for g in w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    assert counts == expected
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = I.resample(frame, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows} == by_hand(texts, target, 25, 20, 10_000)


def test_resampling_of_one_id_in_most_rows(spark):
    many = [(None, "one two three four five " * 5)] * 3000 + [(i, "six seven eight nine ten " * 5) for i in range(1000)]
    target = spark.createDataFrame([("six seven",)], "text string")
    results = []
    for parts in (3, 7):
        rows = I.resample(spark.createDataFrame(many, "doc_id long, text string").repartition(parts), target).collect()
        ranks = sorted(r["rank"] for r in rows if r["rank"] is not None)
        assert ranks == list(range(1, 1001)) and len(rows) == 4000
        results.append(sorted(map(str, rows)))
    assert results[0] == results[1]


def test_resampling_odd_rows(odd, empty):
    rows = I.resample(odd, odd.select("text")).collect()
    assert len(rows) == len(ODD) and sum(r["rank"] is not None for r in rows) == 25 * 3 // 100
    assert {r["n_features"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0} and {r["weight"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}
    assert I.resample(empty, odd.select("text")).count() == 0
    assert I.resample(odd, empty.select("text")).count() == len(ODD)
    assert I.resampled_documents(odd, odd, percent=100).columns == odd.columns
    assert {r["doc_id"] for r in I.resampled_documents(odd, odd, percent=100).collect()} == {1, 6}


# Toxicity


def brute(model: T.Model, at, x, k):
    """All cosines, from the postings laid out as a matrix."""
    dense = np.zeros((len(model.labels), len(model.terms)))
    for t in range(len(model.terms)):
        low, high = model.first[model.blocks_of[t]], model.first[model.blocks_of[t + 1]]
        dense[model.place[low:high], t] = model.value[low:high]
    cosine = dense[:, at] @ x
    order = sorted(np.flatnonzero((dense[:, at] > 0).any(axis=1)).tolist(), key=lambda p: (-round(cosine[p], 12), p))[:k]
    return order, cosine[order]


def test_neighbours_of_the_block_max_index_are_exact():
    draw = random.Random(5)
    terms = [f"t{i}" for i in range(40)]
    rows = []
    for i in range(700):
        some = sorted(draw.sample(range(40), draw.randrange(0, 6)))
        rows.append({"doc_id": i, "label": draw.randrange(2), "at": some, "n": [draw.randrange(1, 4) for _ in some]})
    model = T._indexed(terms, np.linspace(1, 5, 40), rows, {0: 2.0, 1: 1.0})
    opened = 0
    for _ in range(300):
        some = draw.sample(range(40), draw.randrange(1, 7))
        at, x = model.vector({t: draw.randrange(1, 4) for t in some})
        place, cosine = model.nearest(at, x, 10)
        expected, values = brute(model, at, x, 10)
        assert place.tolist() == expected and np.allclose(cosine, np.minimum(values, 1))
        opened += len(place)
    assert opened


def test_toxic_documents_are_told(spark):
    draw = random.Random(9)
    prose = lambda: [f"w{draw.randrange(400)}" for _ in range(60)]
    def text(toxic):
        words = prose()
        if toxic:
            words[draw.randrange(60)] = draw.choice(["vilest", "vilely", "VILEness,", "scoundrel"])
        return " ".join(words)
    rows = [(i, text(i % 5 < 2), int(i % 5 < 2)) for i in range(2000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = T.learn_toxicity(docs, docs.where(~T.held_out(F.col("doc_id"))), labels)
    assert {t.rstrip("*")[:4] for t in model.terms} <= {"vile", "scou"}
    found = {r["doc_id"]: r for r in T.score_toxicity(docs, model).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 200 and all(found[i]["predicted"] == rows[i][2] for i in held)
    assert all(found[i]["neighbours"][0]["label"] == 1 and found[i]["terms"] for i in held if rows[i][2])


def test_held_out_labels_do_not_matter(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    learn = docs.where(~T.held_out(F.col("doc_id")))
    score = lambda y: sorted((r["doc_id"], r["score"]) for r in T.score_toxicity(docs, T.learn_toxicity(docs, learn, y)).select("doc_id", "score").collect())
    assert score(labels) == score(turned)


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (7, 0), (7, 1)], "doc_id long, toxic int")
    model = T.learn_toxicity(odd, odd, labels, least_chi=0.0, least_docs=1, least_lift=0.0)
    rows = T.score_toxicity(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    none = T.learn_toxicity(empty, empty, labels.limit(0))
    assert {r["score"] for r in T.score_toxicity(odd, none).collect()} == {0.0}
    assert T.score_toxicity(empty, model).count() == 0


# Phrases


def phrases_by_hand(rows: list, least: int, top: int) -> list:
    count = collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\v\f\r]", lowered(text)):
            w = re.findall(r"[^ \t]+", piece)
            for k in (1, 2, 3):
                count.update((lang or "und", *w[p : p + k]) for p in range(len(w) - k + 1))
    out = []
    for key, a in count.items():
        lang, *w = key
        if len(w) < 2 or a < least:
            continue
        if len(w) == 2 and any(100 * n >= 50 * a for g, n in count.items() if len(g) == 4 and g[0] == lang and (g[1:3] == key[1:] or g[2:4] == key[1:])):
            continue
        cuts = [(1_000_000 * a * a // (count[lang, *w[:k]] * count[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, count[lang, *w[:k]], count[lang, *w[k:]], sum(n for g, n in count.items() if len(g) == 2 and g[0] == lang), score))
    ranked = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(best)]
    return sorted(ranked)


@pytest.mark.parametrize("bucket_words", [400, 1_000_000])
def test_phrases_by_brute_force(spark, monkeypatch, bucket_words):
    draw = random.Random(11)
    words = ["The", "the", "new", "York", "of", "été", "-", "x/y", "ab", "rare"]
    text = lambda: "".join(draw.choices(words, weights=[3, 30, 8, 8, 12, 4, 2, 2, 2, 1])[0] + draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(draw.randrange(0, 60)))
    rows = [(text(), draw.choice(["en", "en", None, "fr"])) for _ in range(160)]
    # Small buckets make the frequent words hot ones.
    monkeypatch.setattr(C, "BUCKET_WORDS", bucket_words)
    monkeypatch.setattr(C, "HOT_BITS", 6)
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    found = C.mine_phrases(frame, least=5, top=12)
    assert sorted(map(tuple, found.collect())) == phrases_by_hand(rows, 5, 12)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_multikey_quicksort_counts_like_a_dictionary():
    rng = np.random.default_rng(2)
    keys = rng.integers(1, 9, (5000, 3)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys[rng.random(5000) < 0.2, 2] = 0
    size = rng.integers(1, 5, 5000)
    for least in (1, 40):
        found = {}
        for depth, rows, n in C.phrases(keys, size, least):
            found |= {tuple(r): int(c) for r, c in zip(rows.tolist(), n)}
        expected = collections.Counter()
        for row, c in zip(keys.tolist(), size.tolist()):
            for k in (1, 2, 3):
                if row[k - 1]:
                    expected[tuple(row[:k])] += c
        assert found == {g: n for g, n in expected.items() if n >= least}


@pytest.mark.parametrize("kind", [0, 2, 3])
def test_a_bucket_is_sorted_in_bounded_parts(monkeypatch, kind):
    rng = np.random.default_rng(6)
    keys = rng.integers(1, 200, (6000, 3)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys[:, 1:] %= np.uint64(5)
    keys[:, 1:] += np.uint64(1)
    keys = keys[np.argsort(keys[:, 0], kind="stable")]
    if kind == 2:
        keys[:, 2] = 0
    count = rng.integers(1, 300, 6000)
    expected = collections.Counter()
    for row, c in zip(keys.tolist(), count.tolist()):
        for k in (kind,) if kind else (2, 3):
            expected[tuple(row[:k])] += c
    monkeypatch.setattr(C, "SORTED_WORDS", 1000)
    sizes, whole = [], C.phrases
    monkeypatch.setattr(C, "phrases", lambda k, *rest: (sizes.append(len(k)), whole(k, *rest))[1])
    blobs = [C._packed(keys[a : a + 700], count[a : a + 700]) for a in range(0, 6000, 700)]
    found = {}
    for _, rows, n in C.bucket_phrases(kind, blobs, 400):
        for row, c in zip(rows.tolist(), n.tolist()):
            assert tuple(row) not in found
            found[tuple(row)] = c
    assert found == {g: n for g, n in expected.items() if n >= 400} and found
    assert sum(sizes) == 6000 and max(sizes) <= 1500


def test_packed_suffixes_are_sent_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(C, "SENT_BYTES", 100)
    rows = [(0, k, b"x" * (k % 40)) for k in range(500)]
    sent = list(C._in_batches(iter(rows)))
    assert [r for b in sent for r in b] == rows and max(sum(len(r[2]) for r in b) for b in sent) < 140


def test_a_chunk_is_split_into_words_in_parts():
    texts = pa.array(["word " * 2000] * 100)
    parts = [len(t.data) for t in C._tokenised(texts, ["en"] * 100, 61)]
    assert sum(parts) == 1_000_000 and max(parts) <= 1 << 18


def test_suffixes_come_back_packed():
    rng = np.random.default_rng(4)
    keys = np.sort(rng.integers(0, 50, (300, 3)).astype(np.uint64), axis=0)
    count = rng.integers(1, 1000, 300)
    back = C._unpacked(C._packed(keys, count))
    assert (back[0] == keys).all() and (back[1] == count).all()


def test_score_is_exact_beyond_64_bits(spark):
    a, left, right = 10**14 + 7, 10**14 + 9, 10**14 + 11
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(C._score("l", "r").alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (left * right)


def test_phrases_odd_rows(odd, empty, spark):
    rows = C.mine_phrases(odd, least=2).collect()
    expected = phrases_by_hand([(r[1], r[2]) for r in ODD if r[1] != LONG], 2, 2000)
    assert [r for r in sorted(map(tuple, rows)) if r[0] == "de"] == [r for r in expected if r[0] == "de"]
    assert any(r["lang"] == "en" and r["n"] > 200_000 for r in rows)
    assert C.mine_phrases(empty).count() == 0
    one = spark.createDataFrame([("a b " * 20, None)], "text string, lang string")
    assert {r["lang"] for r in C.mine_phrases(one).collect()} == {"und"}
