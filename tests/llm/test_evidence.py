"""Learners and ratios against plain loops."""

import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from veilspark.llm import language_id as L
from veilspark.llm import quality_classifier as Q
from veilspark.llm.compression_rules import BANDS, WIDE_BANDS, CompressionRules, judge_quality, packed


def test_ftrl_by_loops():
    """Per-coordinate FTRL-proximal, one weight at a time."""
    r = random.Random(4)
    rows = []
    for _ in range(60):
        at = sorted(r.sample(range(30), r.randrange(1, 8)))
        rows.append((np.array([*at, 1 << Q.BITS]), np.array([*(r.random() for _ in at), 1.0])))
    labels = np.array([float(3 in x[0] or 5 in x[0]) for x in rows])
    alpha, beta, l1, l2, passes = 0.3, 1.0, 0.02, 1.0, 3
    z, n = {}, {}

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(passes):
        for k in order.permutation(len(rows)):
            at, x = rows[k]
            w = {i: weight(i) for i in at.tolist()}
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] * v for i, v in zip(at.tolist(), x.tolist()))))))
            for i, v in zip(at.tolist(), x.tolist()):
                g = (p - labels[k]) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    found = Q.ftrl(rows, labels)
    assert np.allclose([found[i] for i in sorted(z)], [weight(i) for i in sorted(z)], atol=1e-9) and np.count_nonzero(found) > 3


def test_quality_scores_are_sparse_dot_products(spark):
    weights = np.random.default_rng(1).normal(size=(1 << Q.BITS) + 1).astype(np.float32)
    texts = ["one two two three", "", None, "a, b; c!", "long " * 3000]
    got = {r["doc_id"]: r["score"] for r in Q.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights).collect()}
    import pyarrow as pa

    from veilspark.llm import words as W

    for k, t in enumerate(texts):
        places = [p for s in W.slices(pa.array([t or ""])) for p in Q.features(s)[0].tolist()]
        margin = Q.SCALE * sum(float(weights[p]) for p in places) / max(1, len(places)) + float(weights[-1])
        assert got[k] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-5)


def test_support_vectors_reach_the_least_loss():
    """Dual coordinate descent against plain gradient steps on the primal loss."""
    r = np.random.default_rng(3)
    x = r.normal(size=(40, 4))
    sign = np.sign(x @ np.array([1.0, -2.0, 0.5, 0.0]) + 0.3)
    rows = [(np.arange(4), row) for row in x]
    w = L.support_vectors(rows, sign, cost=1.0, passes=400)
    found = np.append(w[:4], w[-1])
    full = np.hstack([x, np.ones((40, 1))])
    loss = lambda v: 0.5 * v @ v + (np.maximum(0, 1 - sign * (full @ v)) ** 2).sum()
    best = np.zeros(5)
    for _ in range(20_000):
        best -= 0.002 * (best - 2 * full.T @ (sign * np.maximum(0, 1 - sign * (full @ best))))
    assert loss(found) == pytest.approx(loss(best), rel=1e-4) and np.allclose(found, best, atol=1e-2)


def test_language_margins_and_votes_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.learn_languages(docs.where(~L.held_out(F.col("doc_id"))))
    texts = {r["doc_id"]: r["text"] for r in docs.limit(60).collect()}
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs, model).collect()}
    for i, text in texts.items():
        data = np.frombuffer((text or "").encode(), np.uint8)
        if not L.has_letter(data):
            assert got[i] == "und"
            continue
        x = L.vector(data).astype(float)
        dot = lambda w: sum(float(a) * b for a, b in zip(w[:-1], x.tolist()) if b) + float(w[-1])
        family = max(range(len(model.families)), key=lambda k: dot(model.family_weights[k]))
        members = [m for m in range(len(model.languages)) if L.family_of(model.languages[m]) == model.families[family]]
        wins = {m: [0, 0.0] for m in members}
        for (a, b), w in zip(model.pairs[model.families[family]], model.pair_weights[model.families[family]]):
            margin = dot(w)
            winner = a if margin > 0 else b
            wins[winner][0] += 1
            wins[a][1] += margin
            wins[b][1] -= margin
        assert got[i] == model.languages[max(members, key=lambda m: (wins[m][0], wins[m][1], -m))]


def test_rows_without_an_id_are_learnt_from_as_others(spark):
    texts = [("the cat sat on the mat and the dog ran " + str(i), "en") for i in range(40)] + [("der hund lief und die katze schlief " + str(i), "de") for i in range(40)]
    docs = spark.createDataFrame([(None, *t) for t in texts], "doc_id long, text string, lang string")
    model = L.learn_languages(docs)
    assert {(r["lang_pred"]) for r in L.identify(docs.where("lang = 'de'"), model).collect()} == {"de"}


def limits(ratio, n, wide):
    band = [b for b in (WIDE_BANDS if wide else BANDS) if b.least <= n][-1]
    return ratio < band.low or ratio > band.high


def test_ratios_and_verdicts_by_hand(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(120).collect()
    rules = CompressionRules()
    got = {r["doc_id"]: r for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pack = zstandard.ZstdCompressor(level=rules.level)
    for row in rows:
        data, wide = packed((row["text"] or "").encode())
        if not data:
            continue
        whole = len(pack.compress(data)) / len(data)
        starts = list(range(0, len(data), 4096))
        if len(starts) > 1 and len(data) - starts[-1] < 2048:
            starts.pop()
        chunks = [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]
        part = [(len(pack.compress(c)) / len(c), len(c)) for c in chunks] if len(chunks) > 1 else [(whole, len(data))]
        bad = sum(n for x, n in part if limits(x, n, wide)) / len(data)
        r = got[row["doc_id"]]
        assert r["ratio"] == pytest.approx(whole) and r["chunk_low"] == pytest.approx(min(x for x, _ in part)) and r["bad_share"] == pytest.approx(bad)
        assert r["kept"] == (not r["base_failed"] and not limits(whole, len(data), wide) and bad <= 0.25)


# Article 1 to 4 of the Universal Declaration of Human Rights, shortened: clean prose in scripts of two and three bytes a letter.
PROSE = {
    "ru": "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек должен обладать всеми правами и всеми свободами, провозглашёнными настоящей Декларацией, без какого бы то ни было различия, как то в отношении расы, цвета кожи, пола, языка, религии, политических или иных убеждений, национального или социального происхождения, имущественного, сословного или иного положения. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε άνθρωπος δικαιούται να επικαλείται όλα τα δικαιώματα και όλες τις ελευθερίες που προκηρύσσει η παρούσα Διακήρυξη, χωρίς καμία απολύτως διάκριση, ειδικότερα ως προς τη φυλή, το χρώμα, το φύλο, τη γλώσσα, τις θρησκείες, τις πολιτικές ή οποιεσδήποτε άλλες πεποιθήσεις, την εθνική ή κοινωνική καταγωγή.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। सभी को इस घोषणा में सन्निहित सभी अधिकारों और आज़ादियों को प्राप्त करने का हक़ है और इस मामले में जाति, वर्ण, लिंग, भाषा, धर्म, राजनीति या अन्य विचार प्रणाली, किसी देश या समाज विशेष में जन्म, सम्पत्ति या किसी प्रकार की अन्य मर्यादा आदि के कारण भेदभाव का विचार न किया जाएगा।",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق، وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. لكل إنسان حق التمتع بكافة الحقوق والحريات الواردة في هذا الإعلان، دون أي تمييز، كالتمييز بسبب العنصر أو اللون أو الجنس أو اللغة أو الدين أو الرأي السياسي أو أي رأي آخر، أو الأصل الوطني أو الاجتماعي أو الثروة أو الميلاد أو أي وضع آخر، دون أية تفرقة بين الرجال والنساء. لكل فرد الحق في الحياة والحرية وسلامة شخصه.",
    "zh": "人人 生而自由， 在尊严 和 权利 上 一律 平等。 他们 赋有 理性 和 良心， 并应 以 兄弟 关系 的 精神 相 对待。 人人 有 资格 享受 本 宣言 所载 的 一切 权利 和 自由， 不分 种族、 肤色、 性别、 语言、 宗教、 政治 或 其他 见解、 国籍 或 社会 出身、 财产、 出生 或 其他 身份 等 任何 区别。 并且 不得 因 一人 所属 的 国家 或 领土 的 政治 的、 行政 的 或者 国际 的 地位 之 不同 而 有所 区别。 人人 有权 享有 生命、 自由 和 人身 安全。",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 모든 사람은 인종, 피부색, 성, 언어, 종교, 정치적 또는 기타의 견해, 민족적 또는 사회적 출신, 재산, 출생 또는 기타의 신분과 같은 어떠한 종류의 차별이 없이, 이 선언에 규정된 모든 권리와 자유를 향유할 자격이 있다. 모든 사람은 생명과 신체의 자유와 안전에 대한 권리를 가진다. 어느 누구도 노예상태 또는 예속상태에 놓여지지 아니한다.",
}


def test_clean_prose_of_other_scripts_stays_and_loops_go(spark):
    texts = [*PROSE.values(), *(" ".join(t.split()[:40] + t.split()) for t in PROSE.values()), *((" ".join(t.split()[:5]) + " ") * 60 for t in PROSE.values())]
    got = [r for r in judge_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    n = len(PROSE)
    assert all(r["kept"] for r in got[:n]) and not any(r["kept"] for r in got[2 * n :])
    noise = random.Random(6)
    cyrillic = " ".join("".join(chr(0x430 + noise.randrange(32)) for _ in range(6)) for _ in range(600))
    assert not judge_quality(spark.createDataFrame([(1, cyrillic)], "doc_id long, text string")).first()["kept"]


def test_no_id_fills_a_cell_of_the_mix(spark, monkeypatch):
    """Most rows without an id, or with one and the same, and of one size: their numbers spread them over the cells, and reruns agree."""
    from veilspark.llm import mixing

    rows = [(None, "a b c d", "s1")] * 4000 + [(7, "a b c d", "s1")] * 1500 + [(i, "a b c d", "s1") for i in range(500)] + [(None, "x y", "s2")] * 300
    kept = {}
    write = mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, label: kept.setdefault(label, write(df, label)) if label == "cells" else write(df, label))
    monkeypatch.setattr(mixing, "CELL_ROWS", 200)
    monkeypatch.setattr(mixing, "RUN_ROWS", 700)
    results = []
    for parts in (2, 6):
        kept.clear()
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        found = mixing.mix_sources(docs)
        results.append(sorted(map(str, found.select("doc_id", "source", "size", "target", "taken").collect())))
        cells = [r["count"] for r in kept["cells"].groupBy("stratum", "part").count().collect()]
        assert sum(cells) == len(rows) and max(cells) < 300 and len(cells) >= 30
        taken = {r["source"]: r["n"] for r in found.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
        target = {r["source"]: r["target"] for r in found.select("source", "target").distinct().collect()}
        assert all(abs(taken[s] - target[s]) <= 8 for s in target)
    assert results[0] == results[1]


def test_rows_repeated_by_number(spark):
    from veilspark.llm import mixing

    got = mixing.numbered(spark.createDataFrame([("a", 3), ("b", 0), ("c", 25_001)], "x string, n long"), "n", "k")
    rows = sorted((r["x"], r["k"]) for r in got.collect())
    assert rows == [("a", 0), ("a", 1), ("a", 2), *[("c", k) for k in range(25_001)]]


def test_looked_up_with_hot_and_missing_keys(spark):
    from veilspark.llm.frames import heavy_keys, looked_up, row_key

    df = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 11 == 0, None).otherwise((F.col("id") % 40).cast("string")).alias("k"), "id")
    table = df.where("k IS NOT NULL AND k <> '7'").groupBy("k").agg(F.count("*").alias("n"))
    heavy = heavy_keys(table, "n")
    assert 0 < heavy.count() < 1024
    got = looked_up(df, "k", table, "k", heavy.where("k = 'hot'"), F.concat(F.lit("row"), F.col("id").cast("string")), n="n")
    known = {r["k"]: r["n"] for r in table.collect()}
    assert sorted((r["id"], r["n"]) for r in got.collect()) == sorted((r["id"], known.get(r["k"])) for r in df.collect())
    odd = spark.createDataFrame([(None, "a", 1), ("a", None, 1), ("", "a", 1), ("a", "", 1), ("a", "", 1)], "x string, y string, z int")
    assert odd.select(row_key(odd).alias("k")).distinct().count() == 4
