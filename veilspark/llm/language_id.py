"""Language ID by hierarchical discrimination: family first, then one-versus-one linear support vector machines within it.

A text is its hashed byte 3-grams (A-Z lowered, other ASCII than letters taken as one space), counted and scaled to length 1. One
SVM per family (against the other families) picks the family; in it one SVM per pair of languages votes, ties by the sum of margins.
Each SVM is trained in a Spark task of its own on a bounded sample: about PER_LANGUAGE documents of each language, chosen by hash, as
vectors of at most DIMENSIONS entries. Texts are read whole, in learning and in scoring.

A null text, and one without a letter, is `und` with score 0. Languages are those of the learning rows; null languages are not learnt.
With one language everything with a letter is that language; with none, `und`. Repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm import words as W
from veilspark.llm.frames import drawn, per_batch, picked

DIMENSIONS = 1 << 14
PER_LANGUAGE = 1000
UNDETERMINED = "und"

# Families of ISO 639-1 languages. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}

_LETTER = re.compile(r"[^\W\d_]")
_FOLDED = np.full(256, 32, np.uint8)
_FOLDED[97:123] = np.arange(97, 123)
_FOLDED[65:91] = np.arange(97, 123)
_FOLDED[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    return next((family for family, members in FAMILIES.items() if lang in members), lang)


def held_out(id_col: Column) -> Column:
    """Rows no label may be learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(data: np.ndarray) -> np.ndarray:
    """Hashed 3-grams of a text with a space at both ends."""
    x = np.concatenate([[32], _FOLDED[data], [32]]).astype(np.uint32)
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
    code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 14)


def vector(data: np.ndarray) -> np.ndarray:
    """Square roots of the counts, scaled to length 1."""
    count = np.bincount(grams(data), minlength=DIMENSIONS).astype(np.float32) if len(data) else np.zeros(DIMENSIONS, np.float32)
    return np.sqrt(count / max(1.0, count.sum()))


def support_vectors(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: float = 10.0, passes: int = 12) -> np.ndarray:
    """Linear SVM (squared hinge loss) by dual coordinate descent over sparse rows; the last weight is the bias."""
    w = np.zeros(DIMENSIONS + 1)
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    order = np.random.default_rng(5)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            slope = sign[i] * (w[at] @ v + w[-1]) - 1 + alpha[i] / (2 * cost)
            new = max(0.0, alpha[i] - slope / (square[i] + 1 / (2 * cost)))
            if (step := (new - alpha[i]) * sign[i]) != 0:
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def vectors(frame: DataFrame) -> DataFrame:
    """The texts of lang, text as sparse vectors: places and values."""

    def make(batch: pa.RecordBatch) -> dict:
        rows = [vector(s.data[s.bounds[k] : s.bounds[k + 1]]) for s in W.slices(batch.column("text")) for k in range(s.rows)]
        places = [np.flatnonzero(x) for x in rows]
        return {
            "lang": batch.column("lang"),
            "at": pa.array([at.astype("<u2").tobytes() for at in places], pa.binary()),
            "value": pa.array([x[at].astype("<f4").tobytes() for x, at in zip(rows, places)], pa.binary()),
        }

    return per_batch(frame.select("lang", "text"), "lang string, at binary, value binary", make)


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    """One SVM: rows of one task, whose `sign` says on which side a row is. Their order does not depend on partitions."""
    rows = rows.sort_values(["sign", "at", "value"], ignore_index=True)
    x = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(v, "<f4")) for a, v in zip(rows["at"], rows["value"])]
    weights = support_vectors(x, rows["sign"].to_numpy(float))
    return pd.DataFrame({"task": [rows["task"].iloc[0]], "weights": [weights.astype("<f4").tobytes()]})


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[str]
    family_weights: np.ndarray
    pairs: dict[str, list[tuple[int, int]]]
    pair_weights: dict[str, np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language and score: the share of the family's margin times the winner's mean share against its relatives."""
        margins = self.family_weights[:, :-1] @ x + self.family_weights[:, -1]
        k = int(np.argmax(margins))
        family = self.families[k]
        score = 1.0 if len(self.families) == 1 else float(_share(margins[k] - np.delete(margins, k).max()))
        members = [i for i, lang in enumerate(self.languages) if family_of(lang) == family]
        if len(members) == 1:
            return self.languages[members[0]], score
        weights = self.pair_weights[family]
        margin = weights[:, :-1] @ x + weights[:, -1]
        votes = {i: [0, 0.0, 0.0] for i in members}
        for (a, b), m in zip(self.pairs[family], margin.tolist()):
            for lang, value in ((a, m), (b, -m)):
                votes[lang][0] += value > 0
                votes[lang][1] += value
                votes[lang][2] += float(_share(2 * value)) / (len(members) - 1)
        best = max(members, key=lambda i: (votes[i][0], votes[i][1], -i))
        return self.languages[best], score * votes[best][2]


def _share(margin: float) -> float:
    return 1 / (1 + np.exp(-2 * margin))


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """The model from rows whose language is known. About PER_LANGUAGE rows of each language, chosen by hash of id and text, are learnt from."""
    frame = picked(docs, doc_id=id_col, text=text_col, lang=lang_col).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in frame.groupBy("lang").count().collect()}
    languages = sorted(counts)
    families = sorted({family_of(x) for x in languages})
    if not languages:
        return LanguageModel([], [], np.zeros((0, DIMENSIONS + 1)), {}, {})
    shares = F.create_map(*[F.lit(x) for lang in languages for x in (lang, PER_LANGUAGE / counts[lang])])
    sample = vectors(frame.where(drawn("doc_id", "languages", "text") < shares[F.col("lang")]))
    # Tasks of a row: one for each family of the whole, and one for each pair with a relative.
    tasks = {lang: [(f"family {f}", 1.0 if family_of(lang) == f else -1.0) for f in families if len(families) > 1] for lang in languages}
    pairs: dict[str, list[tuple[int, int]]] = {f: [] for f in families}
    for i, a in enumerate(languages):
        for j in range(i + 1, len(languages)):
            if family_of(a) == family_of(languages[j]):
                pairs[family_of(a)].append((i, j))
                tasks[a].append((f"pair {i} {j}", 1.0))
                tasks[languages[j]].append((f"pair {i} {j}", -1.0))
    entries = [(lang, task, sign) for lang in languages for task, sign in tasks[lang]]
    trained = {}
    if entries:
        plan = docs.sparkSession.createDataFrame(entries, "lang string, task string, sign double")
        rows = sample.join(F.broadcast(plan), "lang")
        trained = {r["task"]: np.frombuffer(r["weights"], "<f4") for r in rows.groupBy("task").applyInPandas(_train, "task string, weights binary").collect()}
    none = np.zeros(DIMENSIONS + 1, np.float32)
    stack = lambda keys: np.stack([trained.get(k, none) for k in keys]) if keys else np.zeros((0, DIMENSIONS + 1), np.float32)
    pair_weights = {f: stack([f"pair {i} {j}" for i, j in pairs[f]]) for f in families}
    return LanguageModel(languages, families, stack([f"family {f}" for f in families]), pairs, pair_weights)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: lang_pred, score."""
    frame = picked(docs, doc_id=id_col, text=text_col)

    def make(batch: pa.RecordBatch) -> dict:
        found = [predicted(s.data[s.bounds[k] : s.bounds[k + 1]], model) for s in W.slices(batch.column("text")) for k in range(s.rows)]
        lang, score = zip(*found) if found else ((), ())
        return {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}

    return per_batch(frame, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double", make)


def recognised(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows whose language is told, with all their columns; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [predicted(s.data[s.bounds[k] : s.bounds[k + 1]], model)[0] != UNDETERMINED for s in W.slices(batch.column(text_col)) for k in range(s.rows)]
            yield batch.filter(pa.array(told, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predicted(data: np.ndarray, model: LanguageModel) -> tuple[str, float]:
    if not model.languages or not has_letter(data):
        return UNDETERMINED, 0.0
    return model.predict(vector(data))


def has_letter(data: np.ndarray) -> bool:
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    return bool(ascii_letter.any()) or bool((data >= 128).any()) and _LETTER.search(data.tobytes().decode("utf-8", "replace")) is not None
