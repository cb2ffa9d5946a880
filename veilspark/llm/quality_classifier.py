"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader, scored as sparse dot products.

A word is a run of letters, digits and other bytes above 127, or a run of punctuation. Features are hashed words and pairs of
neighbours, with marks for a word or pair that was in the text before (so that loops show whatever words they repeat). A text's vector
is its counts over their number. About SAMPLE_ROWS labelled documents, chosen by hash, are learnt from as hashed counts of their whole
texts; SHARDS tasks learn from parts of them, and the weights are averaged. Every text is scored whole, with no other column than it.

Null and empty texts have no feature and get the score of the bias alone. Null labels are not learnt. Without a row to learn from all
weights are 0 and every score is 0.5. Repeated rows score alike. A document with several labels is learnt once for each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import words as W
from veilspark.llm.frames import drawn, per_batch, picked

BITS = 18
SAMPLE_ROWS = 16_000
SHARDS = 8
SCALE = 20.0

# Kinds of bytes: 0 space, 1 letters and digits, 2 punctuation.
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def tokens(s: W.Slice) -> W.Words:
    """Runs of one kind of byte, in a slice."""
    if not len(s.data):
        none = np.zeros(0, np.int64)
        return W.Words(none, none, none, np.zeros(0, np.uint64), np.zeros(s.rows + 1, np.int64))
    kind = _KIND[s.data]
    cut = np.ones(len(kind) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[s.bounds] = True
    edges = np.flatnonzero(cut)
    solid = kind[edges[:-1]] > 0
    begin, end = edges[:-1][solid], edges[1:][solid]
    row = np.searchsorted(s.bounds, begin, "right") - 1
    return W.Words(begin, end, row, W.span_hashes(s.data, begin, end), np.searchsorted(row, np.arange(s.rows + 1)))


def _again(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether a value was in its row before."""
    order = np.lexsort((value, row))
    same = (value[order][1:] == value[order][:-1]) & (row[order][1:] == row[order][:-1])
    out = np.zeros(len(value), bool)
    # lexsort is stable: the first of equals comes first.
    out[order[1:]] = same
    return out


def features(s: W.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Place and row of every feature of a slice, in order of rows."""
    t = tokens(s)
    pair, pair_row = W.shingles(t, 2, short=False)
    doubled = np.zeros(0, bool)
    if len(t.hash) > 1:
        start = np.arange(len(t.hash) - 1)
        start = start[t.row[start] == t.row[start + 1]]
        doubled = t.hash[start] == t.hash[start + 1]
    marks = W.numbers(3, 11)
    pair = np.where(_again(pair, pair_row), marks[0], pair)
    pair = np.where(doubled, marks[1], pair)
    value = np.concatenate([W.mix(t.hash ^ marks[2]), pair])
    row = np.concatenate([t.row, pair_row])
    order = np.argsort(row, kind="stable")
    return (value[order] >> np.uint64(64 - BITS)).astype(np.int64), row[order]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0) -> np.ndarray:
    """Per-coordinate FTRL-proximal; the last weight is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    weight = lambda at: np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))
    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[i]) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weight(np.arange(len(z)))


def _counted(frame: DataFrame) -> DataFrame:
    """Labelled texts as sparse counts."""

    def make(batch: pa.RecordBatch) -> dict:
        places, counts = [], []
        for s in W.slices(batch.column("text")):
            at, row = features(s)
            cuts = np.searchsorted(row, np.arange(s.rows + 1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                p, c = np.unique(at[a:b], return_counts=True)
                places.append(p.astype("<u4").tobytes())
                counts.append(c.astype("<u4").tobytes())
        return {"shard": batch.column("shard"), "label": batch.column("label"), "at": pa.array(places, pa.binary()), "count": pa.array(counts, pa.binary())}

    return per_batch(frame.select("shard", "label", "text"), "shard long, label int, at binary, count binary", make)


def _learn(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["label", "at", "count"], ignore_index=True)
    x = []
    for a, c in zip(rows["at"], rows["count"]):
        count = np.frombuffer(c, "<u4").astype(float)
        x.append((np.append(np.frombuffer(a, "<u4").astype(np.int64), 1 << BITS), np.append(count * (SCALE / max(1.0, count.sum())), 1.0)))
    w = ftrl(x, rows["label"].to_numpy(float))
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "rows": [len(rows)], "weights": [w.astype("<f4").tobytes()]})


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights from the documents that have a label."""
    marked = picked(labels, doc_id=id_col, label=label_col).where("label IS NOT NULL AND doc_id IS NOT NULL")
    many = max(1, marked.count())
    chosen = drawn("doc_id", "quality") < min(1.0, SAMPLE_ROWS / many)
    marked = marked.where(chosen).select("doc_id", F.col("label").cast("int").alias("label"))
    texts = picked(docs, doc_id=id_col, text=text_col).where(chosen)
    rows = texts.join(marked, "doc_id").withColumn("shard", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("shard")), F.lit(SHARDS)))
    found = _counted(rows).groupBy("shard").applyInPandas(_learn, "shard long, rows long, weights binary").collect()
    if not found:
        return np.zeros((1 << BITS) + 1, np.float32)
    return np.average([np.frombuffer(r["weights"], "<f4") for r in sorted(found)], axis=0, weights=[r["rows"] for r in sorted(found)])


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: score in 0..1, predicted."""
    frame = picked(docs, doc_id=id_col, text=text_col)
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def make(batch: pa.RecordBatch) -> dict:
        w, out = held.value, []
        for s in W.slices(batch.column("text")):
            at, row = features(s)
            total, n = np.bincount(row, w[at], minlength=s.rows), np.bincount(row, minlength=s.rows)
            out.append(1 / (1 + np.exp(-np.clip(SCALE * total / np.maximum(n, 1) + w[-1], -30, 30))))
        score = np.concatenate(out) if out else np.zeros(0)
        return {"doc_id": batch.column("doc_id"), "score": score, "predicted": (score >= 0.5).astype(np.int32)}

    return per_batch(frame, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, score double, predicted int", make)
