"""Substring dedup: Rabin-Karp hashes of every window of `size` words, counted in Spark; repeated windows merge into removal intervals.

A window is repeated when its word sequence also starts anywhere else in the corpus, the same document included. Every word that a
repeated window covers goes; windows are judged on the input. Documents shorter than a window keep all words.

The texts are written once as packed chunks (one row: some documents of one task). Each chunk sends its distinct window hashes, sorted,
to hash buckets as packed byte planes; a bucket's task sorts them together and answers each chunk with one bit per hash, so what goes
back is a hundredth of what came. A window that is everywhere costs a bucket one number per chunk. Buckets follow the size of the
corpus, so a task holds BUCKET_BYTES of hashes at any size. Bucket and payload come from independent hashes: 58 + log2(buckets) bits decide
that two windows are equal, so by chance one window in 3e10 is taken for repeated, whatever the size of the corpus.

Null and empty texts keep nothing (no words). A table without rows gives none. Rows that share an id are rows of their own.
Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm import words as W
from veilspark.llm.frames import picked, text_bytes
from veilspark.llm.tables import written

CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 24 << 20
PAYLOAD_BITS = 58


def window_hashes(w: W.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window within a row: its first word, hash for the bucket, payload."""
    start = np.arange(max(0, len(w.hash) - size + 1))
    if len(start):
        start = start[w.row[start] == w.row[start + size - 1]]
    rolled = W.window_sums(w.hash, start, start + size, 0xA0761D6478BD642F)
    again = W.window_sums(W.mix(w.hash ^ np.uint64(0x2545F4914F6CDD1D)), start, start + size, 0xE7037ED1A0B428DB)
    return start, W.mix(rolled), W.mix(again) >> np.uint64(64 - PAYLOAD_BITS)


def pack(sorted_values: np.ndarray) -> bytes:
    """Ascending numbers as planes of the bytes of their differences."""
    steps = np.diff(sorted_values, prepend=np.uint64(0))
    planes = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([planes]) + steps.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    planes = packed[0]
    body = np.frombuffer(packed, np.uint8, offset=1).reshape(planes, -1)
    steps = np.zeros((body.shape[1], 8), np.uint8)
    steps[:, :planes] = body.T
    return np.cumsum(steps.view(np.uint64).ravel())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a task, packed: ids as an Arrow column, lengths, and the compressed bytes of the texts."""
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for s in W.slices(batch.column("text"), CHUNK_BYTES):
            ids = batch.column("doc_id").slice(s.first, s.rows)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", ids.type)])) as out:
                out.write_batch(pa.RecordBatch.from_arrays([ids], ["doc_id"]))
            row = [(task << 32) + number, sink.getvalue().to_pybytes(), s.bounds.astype("<i8").tobytes(), squeeze.compress(s.data.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *[pa.array([x], pa.binary()) for x in row[1:]]], ["chunk", "ids", "bounds", "texts"])
            number += 1


def _open(bounds: bytes, texts: bytes) -> W.Slice:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8)
    cuts = np.frombuffer(bounds, "<i8").astype(np.int64)
    return W.Slice(0, len(cuts) - 1, data, cuts)


def _parts(chunk: W.Slice) -> Iterator[W.Slice]:
    """A chunk's documents in slices that keep the arrays small."""
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), chunk.rows, [None, pa.py_buffer(chunk.bounds.tobytes()), pa.py_buffer(chunk.data.tobytes())])
    return W.slices(texts)


def _bucket_of(value: np.ndarray, buckets: int) -> np.ndarray:
    return ((value >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _sorted_windows(chunk: W.Slice, size: int, buckets: int):
    """Bucket and payload of all windows of a chunk in order of occurrence."""
    found = [window_hashes(W.words(s), size)[1:] for s in _parts(chunk)]
    bucket = np.concatenate([_bucket_of(a, buckets) for a, _ in found]) if found else np.zeros(0, np.int64)
    return bucket, np.concatenate([b for _, b in found]) if found else np.zeros(0, np.uint64)


def _distinct(bucket: np.ndarray, payload: np.ndarray):
    """Order by bucket and payload, and which of the ordered are the first of their kind."""
    order = np.lexsort((payload, bucket))
    b, p = bucket[order], payload[order]
    first = np.ones(len(b), bool)
    first[1:] = (b[1:] != b[:-1]) | (p[1:] != p[:-1])
    return order, b, p, first


def _send(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = _open(batch["bounds"][k].as_py(), batch["texts"][k].as_py())
                _, b, p, first = _distinct(*_sorted_windows(chunk, size, buckets))
                b, p = b[first], p[first]
                cuts = np.searchsorted(b, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                rows = [pack(p[cuts[i] : cuts[i + 1]]) for i in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array(np.full(len(full), batch["chunk"][k].as_py()), pa.int64()), pa.array(rows, pa.binary())], ["bucket", "chunk", "payload"]
                )

    return run


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for each chunk a bit per number, set where another chunk sent the same one."""
    parts = [unpack(x) for x in rows["payload"]]
    values = np.concatenate(parts)
    order = np.argsort(values)
    ordered = values[order]
    same = ordered[1:] == ordered[:-1]
    shared = np.zeros(len(values), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    cuts = np.cumsum([0, *map(len, parts)])
    bits = [np.packbits(shared[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "bits": bits})


def _remove(size: int, buckets: int):
    """Kept words of each document of a chunk, given the answers of all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = _open(batch["bounds"][k].as_py(), batch["texts"][k].as_py())
                order, b, p, first = _distinct(*_sorted_windows(chunk, size, buckets))
                group = np.cumsum(first) - 1
                repeated = np.bincount(group, minlength=group[-1] + 1)[group] > 1 if len(group) else np.zeros(0, bool)
                if len(group):
                    cuts = np.searchsorted(b[first], np.arange(buckets + 1))
                    shared = np.zeros(group[-1] + 1, bool)
                    for bucket, bits in zip(batch["buckets"][k].as_py() or [], batch["bits"][k].as_py() or []):
                        n = cuts[bucket + 1] - cuts[bucket]
                        shared[cuts[bucket] : cuts[bucket + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
                    repeated |= shared[group]
                flags = np.zeros(len(order), bool)
                flags[order] = repeated
                at, out = 0, []
                for s in _parts(chunk):
                    w = W.words(s)
                    start = window_starts(w, size)
                    cover = np.zeros(len(w.hash) + 1, np.int64)
                    hit = start[flags[at : at + len(start)]]
                    at += len(start)
                    cover[hit] += 1
                    cover[hit + size] -= 1
                    gone = np.cumsum(cover)[:-1] > 0
                    out += [kept_words(s, w, gone, row) for row in range(s.rows)]
                ids = pa.ipc.open_stream(batch["ids"][k].as_py()).read_all().column(0).combine_chunks()
                n_words, n_removed, texts = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"]
                )

    return run


def window_starts(w: W.Words, size: int) -> np.ndarray:
    start = np.arange(max(0, len(w.hash) - size + 1))
    return start[w.row[start] == w.row[start + size - 1]] if len(start) else start


def kept_words(s: W.Slice, w: W.Words, gone: np.ndarray, row: int) -> tuple[int, int, bytes]:
    a, b = w.bounds[row], w.bounds[row + 1]
    found = s.text(row).split()
    removed = gone[a:b]
    if removed.any():
        found = [x for x, r in zip(found, removed.tolist()) if not r]
    return int(b - a), int(removed.sum()), b" ".join(found)


def remove_repeats(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_removed, and the text of the kept words joined by one space."""
    frame = picked(docs, doc_id=id_col, text=text_col)
    chunks = written(frame.mapInArrow(_chunks, "chunk long, ids binary, bounds binary, texts binary"), "chunks")
    # A window takes about 6 bytes of hash, an average word and its space about 6 of text.
    buckets = max(64, math.ceil(text_bytes(frame, "text") / BUCKET_BYTES))
    sent = chunks.select("chunk", "bounds", "texts").mapInArrow(_send(size, buckets), "bucket long, chunk long, payload binary")
    answers = sent.groupBy("bucket").applyInPandas(_answer, "chunk long, bucket long, bits binary")
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("a"))
    by_chunk = by_chunk.select("chunk", F.col("a.bucket").alias("buckets"), F.col("a.bits").alias("bits"))
    id_type = frame.schema["doc_id"].dataType.simpleString()
    return chunks.join(by_chunk, "chunk", "left").mapInArrow(_remove(size, buckets), f"doc_id {id_type}, n_words long, n_removed long, text string")


def digest(column: str) -> Column:
    return F.sha2(F.encode(F.col(column), "UTF-8"), 256)
