"""Quality rules by compression: zstandard ratios of whole documents and of fixed chunks, against limits for their length.

Compressed bytes over bytes is low for repetitive text and near 1 for text without structure (keys, base64, noise). Short texts
compress badly whatever they hold, so each length has limits of its own. A document is kept when its whole text lies within the limits
and at most `chunk_share` of its chunks' bytes lie outside theirs.

The limits are those of letters of one byte. A text whose letters mostly take more bytes in UTF-8 is packed first, so that its script does
not count as repetition: where half of these letters or more are of one block of 128 (Cyrillic, Greek, Arabic, Devanagari ...), a letter of
that block is one byte and any other character two; else (Han, Hangul, kana) each is two, and WIDE_BANDS has the limits. Lengths and
chunks are those of the packed text.

Null and empty texts have no ratio (null) and no word, so the base rules reject them. Repeated rows are judged alike, an empty table
gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from veilspark.llm import words as W
from veilspark.llm.frames import per_batch, picked

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


@dataclass(frozen=True)
class Band:
    """Limits of the ratio for texts of `least` bytes and more, up to the next band."""

    least: int
    low: float
    high: float


# Low: the ratio that one in a thousand texts of clean prose is under when cut to the longest of the band (2,271 texts in four languages,
# labelled quality 1 and not held out). High: between the highest of clean prose cut to the shortest and the lowest of base64 in words of
# four letters. Up to 250 bytes these two meet, and the limit is that of the noise. Fewer than 99 bytes hold no 50 words. From 16,000 on
# there is little to cut from; the low limits fall, as longer prose repeats itself more, and the chunks decide.
BANDS = tuple(
    Band(*b)
    for b in (
        (0, 0.0, 9.0), (96, 0.70, 0.97), (128, 0.66, 0.94), (160, 0.64, 0.885), (200, 0.61, 0.845), (250, 0.59, 0.82), (300, 0.58, 0.79),
        (400, 0.565, 0.765), (500, 0.555, 0.74), (600, 0.528, 0.715), (750, 0.505, 0.69), (1000, 0.495, 0.66), (1250, 0.485, 0.64),
        (1500, 0.472, 0.63), (2000, 0.46, 0.62), (2500, 0.454, 0.61), (3000, 0.443, 0.60), (4000, 0.438, 0.59), (5000, 0.431, 0.59),
        (6000, 0.428, 0.58), (8000, 0.415, 0.575), (12000, 0.41, 0.57), (16000, 0.40, 0.57), (32000, 0.36, 0.57), (200000, 0.30, 0.57),
    )
)


# Letters of two bytes: clean Chinese and Korean prose lies at 0.98 (300 bytes) to 0.6, characters drawn evenly at 0.96 and above.
WIDE_BANDS = tuple(
    Band(*b) for b in ((0, 0.0, 9.0), (200, 0.58, 1.02), (500, 0.52, 1.0), (1000, 0.46, 0.96), (2000, 0.42, 0.94), (4000, 0.38, 0.92), (16000, 0.32, 0.90), (200000, 0.26, 0.90))
)


@dataclass(frozen=True)
class CompressionRules:
    level: int = 3
    chunk_bytes: int = 4096
    chunk_share: float = 0.25
    bands: tuple[Band, ...] = BANDS
    wide_bands: tuple[Band, ...] = WIDE_BANDS

    def outside(self, ratio: np.ndarray, length: np.ndarray, wide: bool = False) -> np.ndarray:
        bands = self.wide_bands if wide else self.bands
        band = np.searchsorted([b.least for b in bands], length, "right") - 1
        low, high = np.array([b.low for b in bands]), np.array([b.high for b in bands])
        return (ratio < low[band]) | (ratio > high[band])


def chunk_cuts(length: int, chunk: int) -> list[tuple[int, int]]:
    """Chunks of fixed size; a rest shorter than half a chunk belongs to the one before."""
    cuts = list(range(0, length, chunk)) or [0]
    if len(cuts) > 1 and length - cuts[-1] < chunk // 2:
        cuts.pop()
    return list(zip(cuts, [*cuts[1:], length]))


def packed(text: bytes) -> tuple[bytes, bool]:
    """The bytes to compress, and whether its letters are two bytes wide."""
    data = np.frombuffer(text, np.uint8)
    small = np.count_nonzero(((data | 32) >= 97) & ((data | 32) <= 122))
    if np.count_nonzero(data >= 0xC0) <= small:
        return text, False
    point = np.frombuffer(text.decode().encode("utf-32-le"), "<u4").astype(np.int64)
    block, many = np.unique(point[point >= 128] >> 7, return_counts=True)
    wide = 2 * many.max() < many.sum()
    own = (point >> 7 == block[many.argmax()]) & (not wide)
    size = np.where((point < 128) | own, 1, 2)
    end = np.cumsum(size)
    out = np.empty(end[-1], np.uint8)
    out[end - 1] = np.where(own, point & 127 | 128, point & 255)
    two = size == 2
    out[end[two] - 2] = point[two] >> 8 & 255
    return out.tobytes(), bool(wide)


def ratios(text: bytes, rules: CompressionRules, pack: zstandard.ZstdCompressor) -> tuple[float, float, float, float, bool]:
    """Ratio of the whole, lowest and highest of the chunks, share of bytes in bad chunks, verdict."""
    text, wide = packed(text)
    n = len(text)
    if not n:
        return np.nan, np.nan, np.nan, 0.0, True
    whole = len(pack.compress(text)) / n
    cuts = chunk_cuts(n, rules.chunk_bytes)
    sizes = np.array([b - a for a, b in cuts])
    part = np.array([len(pack.compress(text[a:b])) for a, b in cuts]) / sizes if len(cuts) > 1 else np.array([whole])
    bad = float(sizes[rules.outside(part, sizes, wide)].sum()) / n
    kept = not rules.outside(np.array([whole]), np.array([n]), wide)[0] and bad <= rules.chunk_share
    return whole, float(part.min()), float(part.max()), bad, kept


def repeated_words(w: W.Words, size: int = 3) -> np.ndarray:
    """For each word whether a window of `size` words that holds it is found twice or more in its row."""
    covered = np.zeros(len(w.hash) + 1, np.int64)
    value, row = W.shingles(w, size, short=False)
    if len(value):
        start = np.arange(len(w.hash) - size + 1)
        start = start[w.row[start] == w.row[start + size - 1]]
        order = np.lexsort((value, row))
        same = (value[order][1:] == value[order][:-1]) & (row[order][1:] == row[order][:-1])
        twice = np.zeros(len(value), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        np.add.at(covered, start[twice], 1)
        np.add.at(covered, start[twice] + size, -1)
    return np.cumsum(covered)[:-1] > 0


def repeated_lines(s: W.Slice, w: W.Words) -> np.ndarray:
    """For each row the lines with a word that equal an earlier line of it."""
    if not len(w.hash):
        return np.zeros(s.rows, np.int64)
    ends = np.flatnonzero(s.data == 10)
    cuts = np.union1d(s.bounds, ends + 1)
    # Lines are between cuts; the line break itself is left out.
    begin, end = cuts[:-1], cuts[1:]
    broken = np.zeros(len(s.data) + 1, bool)
    broken[ends + 1] = True
    end = end - broken[end]
    with_word = np.unique(np.searchsorted(begin, w.begin, "right") - 1)
    begin, end = begin[with_word], end[with_word]
    row = np.searchsorted(s.bounds, begin, "right") - 1
    value = W.span_hashes(s.data, begin, end)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    again = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][again], minlength=s.rows)


def base_counts(s: W.Slice) -> dict[str, np.ndarray]:
    w = W.words(s)
    n = s.rows
    upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    points = upto((s.data & 0xC0) != 0x80)
    repeated = repeated_words(w)
    symbols = upto(_SYMBOL[s.data])
    return {
        "n_words": np.diff(w.bounds),
        "word_chars": np.bincount(w.row, points[w.end] - points[w.begin], minlength=n).astype(np.int64) if len(w.row) else np.zeros(n, np.int64),
        "n_symbols": symbols[s.bounds[1:]] - symbols[s.bounds[:-1]],
        "n_dup_lines": repeated_lines(s, w),
        "n_repeat_words": np.bincount(w.row[repeated], minlength=n).astype(np.int64),
    }


def judge_quality(docs: DataFrame, rules: CompressionRules = CompressionRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, ratios, verdict of the base rules, kept."""
    frame = picked(docs, doc_id=id_col, text=text_col)
    id_type = frame.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "kept boolean, ratio double, chunk_low double, chunk_high double, bad_share double"
    )

    def make(batch: pa.RecordBatch) -> dict:
        pack = zstandard.ZstdCompressor(level=rules.level)
        counts: list[dict] = []
        found: list[tuple] = []
        for s in W.slices(batch.column("text")):
            counts.append(base_counts(s))
            found += [ratios(s.text(k), rules, pack) for k in range(s.rows)]
        out = {k: np.concatenate([c[k] for c in counts]).astype(np.int64) for k in counts[0]} if counts else {}
        if not counts:
            out = {k: np.zeros(0, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
        ratio, low, high, bad, kept = (np.array(x) for x in zip(*found)) if found else (np.zeros(0),) * 4 + (np.zeros(0, bool),)
        out |= {"doc_id": batch.column("doc_id"), "base_failed": failed, "kept": ~failed & kept.astype(bool), "bad_share": bad}
        out |= {k: pa.array(v, pa.float64(), from_pandas=True) for k, v in (("ratio", ratio), ("chunk_low", low), ("chunk_high", high))}
        return out

    return per_batch(frame, schema, make)
