"""The pipeline stage by stage, and the queries against their SQL."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from suite.check import connect, normalised
from veilspark.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def test_stages_return_documents(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "mix", "encode"]
    for docs in stages[:-1]:
        assert docs.schema.simpleString() == stages[0].schema.simpleString()


def test_language_stage_keeps_texts_with_letters(stages):
    expected = {r["doc_id"] for r in stages[0].collect() if re.search(r"[^\W\d_]", r["text"] or "")}
    assert {r["doc_id"] for r in stages[1].collect()} == expected


def test_near_dedup_stage_keeps_one_of_each_group(stages):
    from tests.llm.test_operators import grouped

    before = sorted((r["doc_id"], r["text"]) for r in stages[1].collect())
    labels = grouped([t for _, t in before], 5, 80)
    expected = {i for k, (i, _) in enumerate(before) if labels[k][1] == k}
    assert {r["doc_id"] for r in stages[2].collect()} == expected


def test_pii_stage_leaves_no_address(stages):
    found = lambda df: {m for r in df.collect() for m in re.findall(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b[0-9a-f]{40}\b", r["text"])}
    assert found(stages[2]) and not found(stages[2]) & found(stages[3])
    assert stages[3].count() == stages[2].count()


def test_mix_stage_repeats_documents(stages):
    copies = {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert set(copies.values()) <= {1, 2} and set(copies) <= {r["doc_id"] for r in stages[3].collect()}


def test_encode_stage_and_run(spark, sf_dir, stages):
    assert stages[5].count() == stages[4].count()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages[5])


def test_stages_on_odd_rows(spark, sf_dir):
    data = [(1, "alpha beta gamma delta epsilon", "en", "a", 30), (1, "alpha beta gamma delta epsilon", "en", "a", 30), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "words without id", "fr", None, 16)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__kept", F.lit(1))
    for start in (docs, docs.limit(0)):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            at = corpus_pipeline.written(stage(spark, at, sf_dir), name)
            if name != "encode":
                assert at.columns == docs.columns


def test_copies_without_or_with_one_id_leave_one_row(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30", "other")
    rows = [(None, text, "en", "a")] * 40 + [(None, near, "en", "a")] * 3 + [(7, text, "en", "b")] * 2 + [(7, "something else entirely here", "en", "b"), (None, "another short text", "en", "a"), (None, "another short text", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.near_dedup(spark, docs.repartition(4), sf_dir).collect()
    assert sorted((str(r["doc_id"]), r["text"][:9]) for r in kept) == [("7", "something"), ("7", "w0 w1 w2 "), ("None", "another s")]


def test_mix_keeps_to_its_target_whatever_the_ids(spark, sf_dir):
    rows = [(None, " ".join(["w"] * (1200 + i % 100)), "en", "s1") for i in range(300)] + [(i % 5, "a b c", "en", "s2") for i in range(500)] + [(1, "q " * 50, "en", "s3")] * 700
    results = []
    for parts in (2, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(parts)
        taken = corpus_pipeline.mix(spark, docs, sf_dir)
        words = {r["source"]: r["n"] for r in taken.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
        total = sum(len(t.split()) for _, t, _, _ in rows) * 1.5
        size = {s: sum(len(t.split()) for *_, t, _, x in [(0, *r) for r in rows] if x == s) for s in ("s1", "s2", "s3")}
        assert abs(words["s1"] + words["s2"] + words["s3"] - min(total, sum(2 * n for n in size.values()))) < 3000
        assert all(words[s] <= 2 * size[s] for s in size)
        results.append(sorted(map(str, taken.collect())))
    assert results[0] == results[1]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    cursor = connect(sf_dir).execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(names)
    # Nulls, numbers and texts as the suite compares them.
    assert normalised(got.columns, got.collect()) == normalised(names, cursor.fetchall())


def test_every_operator_is_registered():
    import __spark_entry__ as driver

    names = driver.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(ORACLES) <= set(driver.oracle_sql())
