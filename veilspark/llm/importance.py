"""Target-distribution importance resampling: hashed n-gram weights against a target corpus, then a Gumbel top-k draw.

Batch concatenation: the texts of a batch are joined with a separator sentinel, and one regex pass finds all words of all of them. A
search of the words' places in the offsets of the documents tells which document each belongs to; runs that reach over a border are
masked before features are counted by bucket. A joined text is handled in parts of about PART_BYTES, cut where no word is, so a very long
document needs no more memory than others; the last words of a part are carried into the next.

A word is a run of digits, a-z (A-Z are lowered first) and characters above U+007F; features are all runs of 1 to `longest` words, hashed
by CRC-32. The gain of a bucket compares its smoothed share in the target with that in the corpus; a document's weight is the floored
mean of its features' gains, its score adds Gumbel noise drawn from its id, and the highest scores are the sample. Counts cover all
rows; the only things that meet in one place are counts per bucket (`buckets` numbers) and rows per sorted part.

Null and empty texts have no feature and weigh 0; they are scored but, as all documents under `least_words` words, not drawn. Rows that
share an id share their noise; equal rows are told apart only by their rank. A null id hashes as the empty text and comes after others of
its score. Empty tables (corpus or target) count nothing. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.frames import per_batch, picked
from veilspark.llm.tables import written

BUCKETS = 10_000
PART_BYTES = 1 << 20
SENTINEL = b"\x00"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def _parts(data: bytes) -> Iterator[tuple[int, int]]:
    """Cuts of a joined text at bytes that belong to no word; a longer word makes a longer part."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + PART_BYTES)
        end = gap.start() if gap else len(data)
        yield at, end
        at = end


def features(texts: pa.Array, buckets: int, longest: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part of a batch: the bucket and row of every feature, and the row of every word."""
    raw = [x.encode() for x in texts.fill_null("").to_pylist()]
    if not raw:
        return
    # The offset at which each document begins in the joined text.
    offsets = np.cumsum([0, *(len(x) + len(SENTINEL) for x in raw[:-1])])
    data = SENTINEL.join(raw).lower()
    old_words: list[bytes] = []
    old_rows = np.zeros(0, np.int64)
    for begin, end in _parts(data):
        found = list(_WORD.finditer(data, begin, end))
        if not found:
            continue
        new_rows = np.searchsorted(offsets, np.fromiter((m.start() for m in found), np.int64, len(found)), "right") - 1
        known, words = len(old_words), old_words + [m.group() for m in found]
        row = np.concatenate([old_rows, new_rows])
        spaced = [b" " + w for w in words]
        hashes = list(map(crc32, words))
        out_bucket, out_row = [np.array(hashes[known:], np.int64) % buckets], [new_rows]
        for more in range(1, longest):
            # CRC-32 goes on where the run of one word less ended.
            hashes = list(map(crc32, spaced[more:], hashes))
            # Runs that end in a carried word were counted with the part before.
            first = max(0, known - more)
            inside = row[first : len(words) - more] == row[first + more :]
            out_bucket.append(np.array(hashes[first:], np.int64)[inside] % buckets)
            out_row.append(row[first + more :][inside])
        yield np.concatenate(out_bucket), np.concatenate(out_row), new_rows
        keep = min(longest - 1, len(words))
        old_words, old_rows = words[len(words) - keep :], row[len(words) - keep :]


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = 2) -> np.ndarray:
    """Features of all rows by bucket. Each task sends one row for each bucket that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, _, _ in features(batch.column("text"), buckets, longest):
                total += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    counted = picked(docs, text=text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares) for each bucket."""
    s_all, t_all, many = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + many) / ((s + 1) * (t_all + many)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id, seed: int) -> int:
    """Gumbel noise in thousandths, drawn from the id."""
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, seed: int = 7, longest: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score."""
    frame = picked(docs, doc_id=id_col, text=text_col)
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def make(batch: pa.RecordBatch) -> dict:
        n, gain = batch.num_rows, held.value
        words, count, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for bucket, row, of_words in features(batch.column("text"), len(gain), longest):
            words += np.bincount(of_words, minlength=n)
            count += np.bincount(row, minlength=n)
            # Sums stay exact: a part adds at most PART_BYTES gains of under 2**17.
            total += np.bincount(row, gain[bucket], minlength=n).astype(np.int64)
        weight = np.where(count > 0, total // np.maximum(count, 1), 0)
        drawn = np.fromiter(map(noise, batch.column("doc_id").to_pylist(), repeat(seed)), np.int64, n)
        return {"doc_id": batch.column("doc_id"), "n_words": words, "n_features": count, "weight": weight, "score": weight + drawn}

    return per_batch(frame, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long, score long", make)


def ranked(scored: DataFrame, percent: int = 25, least_words: int = 20) -> DataFrame:
    """The rows with `rank`: 1, 2, 3 ... over the highest scores, ties to the smaller doc_id, for `percent` of the documents that are
    long enough; null for the others.

    Rows are sorted in ranges and written; a row's rank is its place in its range and the rows of the ranges before. A range is cut within
    equal scores and ids too, by a hash of a number each row has, so no score or id has to fit one task.
    """
    long_enough = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight", "__tie"]
    tied = scored.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    tied = written(tied, "scored")
    candidates = tied.where(long_enough).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(candidates.withColumn("__at", F.monotonically_increasing_id()).drop("__tie"), "sorted")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    drawn = percent * before // 100
    starts = F.broadcast(scored.sparkSession.createDataFrame(offsets, "p long, before long"))
    rank = F.col("before") + place + 1
    of_candidates = placed.join(starts, part == F.col("p"), "left").withColumn("rank", F.when(rank <= drawn, rank)).drop("p", "before", "__at")
    return of_candidates.unionByName(tied.where(~long_enough).drop("__tie").withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, longest: int = 2, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score, rank (null: not drawn)."""
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    return ranked(weighed(docs, gain, seed, longest, id_col, text_col), percent, least_words)


def resampled_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents themselves, with all their columns. Rows that share an id go together if any of them is drawn."""
    drawn = resample(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(drawn, docs[id_col].eqNullSafe(F.col("__id")), "left_semi")
