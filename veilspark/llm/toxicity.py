"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes, calibrated scores.

Examples are labelled documents, at most about `per_label` of each label, chosen by hash (a document of a label that is thinned out counts
as many times more); equal texts of a label are one. Terms are words, and beginnings of words of 4 to 6 characters (insults are inflected),
whose presence goes with label 1 in the examples: chi-square of at least `least_chi`, `least_lift` times as frequent as under label 0, in
`least_docs` examples or more. Prose shares many words with any other prose, and a cosine over all of them tells topics apart, not tone.
A term's inverse document frequency comes from all documents. A vector is (1 + ln tf) * idf, scaled to length 1.

Examples stand in blocks; for each term the index has its postings by block and the greatest weight of each block. A document's bound for
a block is the sum over its terms of weight times greatest weight. Blocks are opened in order of their bounds until the k-th best cosine is
above the next bound, so the k neighbours are exact; ties go to the smaller place in the index. Neighbours vote with weight
1 / (distance + SOFT) beside a prior of the base rate. Votes are calibrated by a logistic fit on the examples' own votes, each found without
itself. Documents that share no term with any example get the rate of such examples. Neighbours, cosines and terms are the evidence.

A word is a run of digits, a-z and characters above U+007F after lower-casing. Whole texts are read, in parts of PART_CHARS. Null and empty
texts have no term. Null labels and null ids are not learnt from. Without examples every score is 0. Repeated rows score alike; a document
with several labels is an example for each. Tables without rows give none. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.frames import drawn, per_batch, picked
from veilspark.llm.tables import written

PER_LABEL = 6_000
NEIGHBOURS = 15
BLOCK = 32
SOFT = 0.05
PRIOR = 0.5
PART_CHARS = 1 << 20
REMEMBERED = 50_000
REMEMBERED_WORDS = 300_000
BEGINNINGS = (4, 5, 6)
_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
_GAP = re.compile("[^0-9a-z\x80-\U0010ffff]")


def held_out(id_col: Column) -> Column:
    """Rows no label may be learnt from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _words(text: str | None) -> Iterator[list[str]]:
    """Words of a text, a part at a time."""
    text, at = (text or "").lower(), 0
    while at < len(text):
        gap = _GAP.search(text, at + PART_CHARS)
        end = gap.start() if gap else len(text)
        yield _WORD.findall(text, at, end)
        at = end


def _terms(word: str) -> list[str]:
    """What a word counts for: itself, and its beginnings with a mark that no word has."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


class Terms:
    """Numbers of the known terms, and a bounded memory of what words count for."""

    def __init__(self, terms: list[str]):
        self.ids = {t: k for k, t in enumerate(terms)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str | None) -> dict[int, int]:
        """Occurrences of the known terms of a text."""
        out: Counter = Counter()
        if not self.ids:
            return out
        for words in _words(text):
            if len(self.seen) > REMEMBERED_WORDS:
                self.seen.clear()
            for word, n in Counter(words).items():
                found = self.seen.get(word)
                if found is None:
                    found = self.seen[word] = tuple(self.ids[t] for t in _terms(word) if t in self.ids)
                for term in found:
                    out[term] += n
        return out


@dataclass
class Model:
    """Terms with their idf, the index of the examples, and what turns a vote into a score."""

    terms: list[str]
    known_terms: Terms
    idf: np.ndarray
    doc_ids: list
    labels: np.ndarray
    weights: np.ndarray
    # Postings by term, and in it by place: place, weight. Blocks of a term: number, greatest weight, first posting.
    place: np.ndarray
    value: np.ndarray
    block: np.ndarray
    most: np.ndarray
    first: np.ndarray
    blocks_of: np.ndarray
    base_rate: float
    bare_rate: float
    slope: float = 1.0
    shift: float = 0.0
    known: dict = field(default_factory=dict)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms in order, and their weights scaled to length 1."""
        at = np.array(sorted(counts), np.int64)
        x = np.array([1 + math.log(counts[t]) for t in at.tolist()]) * self.idf[at] if len(at) else np.zeros(0)
        size = math.sqrt(float(x @ x))
        return at, x / size if size else x

    def nearest(self, at: np.ndarray, x: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples, nearest first; `without` is a place to leave out."""
        spans = [(int(self.blocks_of[t]), int(self.blocks_of[t + 1])) for t in at.tolist()]
        number = np.concatenate([self.block[a:b] for a, b in spans]) if spans else np.zeros(0, np.int64)
        if not len(number):
            return np.zeros(0, np.int64), np.zeros(0)
        weight = np.repeat(x, [b - a for a, b in spans])
        bound = np.bincount(number, weight * np.concatenate([self.most[a:b] for a, b in spans]))
        entry = np.concatenate([np.arange(a, b) for a, b in spans])
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        best_place, best = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 4
        while at < len(order):
            # Sums are rounded, so a bound within 1e-9 of the k-th best may hide an equal one.
            if len(best) == k and bound[order[at]] < best[-1] - 1e-9:
                break
            opened = np.zeros(len(bound), bool)
            opened[order[at : at + step]] = True
            at, step = at + step, 2 * step
            some = np.flatnonzero(opened[number])
            low, size = self.first[entry[some]], self.first[entry[some] + 1] - self.first[entry[some]]
            posting = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            place = self.place[posting]
            score = np.bincount(place, np.repeat(weight[some], size) * self.value[posting])
            found = np.flatnonzero(np.bincount(place))
            found = found[found != without]
            places, scores = np.concatenate([best_place, found]), np.concatenate([best, score[found]])
            nearest = np.lexsort((places, -np.round(scores, 12)))[:k]
            best_place, best = places[nearest], scores[nearest]
        return best_place, np.minimum(best, 1.0)

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> float:
        weight = self.weights[place] / (1 - cosine + SOFT)
        return float((weight @ self.labels[place] + PRIOR * self.base_rate) / (weight.sum() + PRIOR))

    def calibrated(self, vote: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * _logit(vote) + self.shift))))

    def judged(self, text: str | None, k: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Score, neighbours, cosines and terms of a text; remembered by its counts."""
        if not len(self.labels):
            return self.bare_rate, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        counts = self.known_terms.counts(text)
        key = tuple(sorted(counts.items()))
        found = self.known.get(key)
        if found is None:
            at, x = self.vector(counts)
            place, cosine = self.nearest(at, x, k)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            score = self.calibrated(self.vote(place, cosine)) if len(place) else self.bare_rate
            found = self.known[key] = (score, place, cosine, at[np.argsort(-x, kind="stable")])
        return found


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _examples(docs: DataFrame, labels: DataFrame, label: str, per_label: int, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, float]]:
    """doc_id, label, text of the chosen examples, and how many documents one of each label stands for."""
    marked = picked(labels, doc_id=id_col, label=label).where("label IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("label").cast("int").alias("label"))
    marked = marked.where("label IN (0, 1)").distinct()
    share = {r["label"]: min(1.0, per_label / r["n"]) for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    limit = F.lit(0.0)
    for y, s in share.items():
        limit = F.when(F.col("label") == y, s).otherwise(limit)
    # About per_label rows of each label are broadcast, so the texts are not shuffled.
    chosen = written(picked(docs, doc_id=id_col, text=text_col).join(F.broadcast(marked.where(drawn("doc_id", "toxicity") < limit)), "doc_id"), "examples")
    many = chosen.count()
    if many > 4 * per_label:
        # Ids that many documents share bring more examples than were drawn.
        thinned = per_label / many
        tied = chosen.withColumn("__row", F.xxhash64("doc_id", "text", F.monotonically_increasing_id()))
        chosen = written(tied.where(drawn("__row", "toxicity") < 2 * thinned).drop("__row"), "examples")
    return written(chosen.dropDuplicates(["label", "text"]), "examples"), {y: 1 / s for y, s in share.items()}


def _chosen_terms(examples: DataFrame, sizes: dict[int, int], least_chi: float, least_lift: float, least_docs: int) -> list[str]:
    """Terms whose presence goes with label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Per batch: documents with each term, and those of label 1.
            docs: Counter = Counter()
            marked: Counter = Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found = {t for words in _words(text) for w in set(words) for t in _terms(w)}
                docs.update(found)
                if label:
                    marked.update(found)
            columns = [pa.array(list(docs), pa.string()), pa.array(docs.values(), pa.int64()), pa.array([marked[w] for w in docs], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "n", "p"])

    counted = examples.select("text", "label").mapInArrow(run, "term string, n long, p long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    ones, zeros = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    every, n, p = ones + zeros, F.col("n").cast("double"), F.col("p").cast("double")
    bottom = F.lit(ones * zeros) * n * (every - n)
    chi = F.when(bottom > 0, every * F.pow(p * (zeros - n + p) - (n - p) * (ones - p), F.lit(2.0)) / bottom)
    lift = (p + 0.5) * (zeros + 1) / ((n - p + 0.5) * (ones + 1))
    return sorted(r["term"] for r in counted.where((F.col("n") >= least_docs) & (chi >= least_chi) & (lift >= least_lift)).select("term").collect())


def _document_frequency(docs: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """Documents with each term, and all documents."""
    many = len(terms.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(many + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column("text"):
                found[list(terms.counts(text.as_py()))] += 1
        found[many] = rows
        met = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(found[met], pa.int64())], ["term", "n"])

    out = np.zeros(many + 1, np.int64)
    for row in docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out[:many], int(out[many])


def _indexed(terms: list[str], idf: np.ndarray, rows: list, stands_for: dict[int, float]) -> Model:
    """The index of examples: rows of doc_id, label, terms, counts. Alike examples stand together, so that blocks have tight bounds."""
    empty = np.zeros(0, np.int64)
    model = Model(terms, Terms(terms), idf, [], empty, empty, empty, empty, empty, empty, empty, empty, 0.0, 0.0)
    vectors = [(model.vector(dict(zip(r["at"], r["n"]))), r) for r in rows]
    full = [(at, x, r) for (at, x), r in vectors if len(at)]
    full.sort(key=lambda v: (int(v[0][np.argmax(v[1])]), -float(v[1].max()), v[0].tolist(), str(v[2]["doc_id"]), v[2]["label"]))
    rate = lambda some: (sum(stands_for[r["label"]] for r in some if r["label"]) + 0.5 * model.base_rate) / (sum(stands_for[r["label"]] for r in some) + 0.5) if some else model.base_rate
    model.base_rate = rate(rows)
    model.bare_rate = rate([r for (at, _), r in vectors if not len(at)])
    model.doc_ids = [r["doc_id"] for *_, r in full]
    model.labels = np.array([r["label"] for *_, r in full], float)
    model.weights = np.array([stands_for[r["label"]] for *_, r in full], float)
    term = np.concatenate([at for at, *_ in full]) if full else empty
    place = np.repeat(np.arange(len(full)), [len(at) for at, *_ in full]) if full else empty
    value = np.concatenate([x for _, x, _ in full]) if full else np.zeros(0)
    order = np.lexsort((place, term))
    term, model.place, model.value = term[order], place[order], value[order]
    block = model.place // BLOCK
    start = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else empty
    model.block, model.first = block[start], np.append(start, len(term))
    model.most = np.maximum.reduceat(model.value, start) if len(start) else np.zeros(0)
    model.blocks_of = np.searchsorted(term[start], np.arange(len(terms) + 1))
    return model


def _fitted(votes: list[tuple[float, int, float]]) -> tuple[float, float]:
    """Slope and shift of a logistic fit of labels on the logits of votes, by Newton's method with a weak pull to 1 and 0."""
    x = np.array([[_logit(v), 1.0] for v, _, _ in votes])
    y, weight = np.array([y for _, y, _ in votes], float), np.array([w for *_, w in votes])
    start = np.array([1.0, 0.0])
    at = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (weight * (p - y)) + (at - start)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(bend, slope)
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    # Votes keep their order.
    return (float(at[0]), float(at[1])) if at[0] > 0.05 else (1.0, 0.0)


def learn_toxicity(
    docs: DataFrame, learn_from: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = PER_LABEL, least_chi: float = 24.0, least_lift: float = 3.0, least_docs: int = 5, k: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """Model from the documents of `learn_from` that have a label; document frequencies are those of `docs`."""
    examples, stands_for = _examples(learn_from, labels, label, per_label, id_col, text_col)
    sizes = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    terms = _chosen_terms(examples, sizes, least_chi, least_lift, least_docs)
    known = Terms(terms)
    found, every = _document_frequency(picked(docs, text=text_col), known)
    idf = np.log((1 + every) / (1 + found)) + 1

    def make(batch: pa.RecordBatch) -> dict:
        counts = [known.counts(x.as_py()) for x in batch.column("text")]
        places = [sorted(c) for c in counts]
        return {
            "doc_id": batch.column("doc_id"), "label": batch.column("label"), "at": pa.array(places, pa.list_(pa.int32())),
            "n": pa.array([[c[t] for t in p] for c, p in zip(counts, places)], pa.list_(pa.int64())),
        }

    schema = f"doc_id {examples.schema['doc_id'].dataType.simpleString()}, label int, at array<int>, n array<long>"
    rows = per_batch(examples.select("doc_id", "label", "text"), schema, make).collect()
    model = _indexed(terms, idf, rows, stands_for)
    if len(model.labels):
        model.slope, model.shift = _fitted(_own_votes(examples, model, k, stands_for))
    return model


def _own_votes(examples: DataFrame, model: Model, k: int, stands_for: dict[int, float]) -> list[tuple[float, int, float]]:
    """For each example with terms the vote of its neighbours without itself, its label, and how many it stands for."""
    held = examples.sparkSession.sparkContext.broadcast(model)
    at_of = {(i, int(y)): p for p, (i, y) in enumerate(zip(model.doc_ids, model.labels.tolist()))}

    def make(batch: pa.RecordBatch) -> dict:
        model, votes = held.value, []
        for i, y, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text"))):
            at, x = model.vector(model.known_terms.counts(text))
            votes.append(model.vote(*model.nearest(at, x, k, at_of.get((i, y), -1))) if len(at) else None)
        return {"label": batch.column("label"), "vote": pa.array(votes, pa.float64())}

    found = per_batch(examples.select("doc_id", "label", "text"), "label int, vote double", make).where("vote IS NOT NULL").collect()
    return [(r["vote"], r["label"], stands_for[r["label"]]) for r in sorted(found)]


def score_toxicity(docs: DataFrame, model: Model, k: int = NEIGHBOURS, evidence: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score in 0..1, predicted, neighbours (the nearest examples: doc_id, label, cosine), terms (the heaviest)."""
    frame = picked(docs, doc_id=id_col, text=text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    id_type = frame.schema["doc_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> dict:
        model, scores, near, terms = held.value, [], [], []
        for text in batch.column("text"):
            score, place, cosine, at = model.judged(text.as_py(), k)
            scores.append(score)
            near.append([{"doc_id": model.doc_ids[p], "label": int(model.labels[p]), "cosine": c} for p, c in zip(place[:evidence].tolist(), cosine[:evidence].tolist())])
            terms.append([model.terms[t] for t in at[:evidence].tolist()])
        kind = pa.list_(pa.struct([("doc_id", batch.schema.field("doc_id").type), ("label", pa.int32()), ("cosine", pa.float64())]))
        return {
            "doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32()),
            "neighbours": pa.array(near, kind), "terms": pa.array(terms, pa.list_(pa.string())),
        }

    return per_batch(frame, f"doc_id {id_type}, score double, predicted int, neighbours array<struct<doc_id:{id_type},label:int,cosine:double>>, terms array<string>", make)
