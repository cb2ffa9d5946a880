"""Phrase collocations: suffix pointers routed by their leading words, sorted by multikey three-way quicksort, scored by their weakest cut.

A text with A-Z lowered is split at . , ; : ! ? and line breaks into pieces, a piece at spaces and tabs into words. All is per language:
a word's 64-bit hash depends on its language. Two words of one hash are found where words are counted, and another seed is taken (unless
they meet within one chunk: of a million different words two have one hash with a chance of 3e-8).

1. Words are counted. Those of fewer than `least` occurrences end a suffix, since no phrase with them is frequent. A bitmap of fixed size
   tells them apart (one that it wrongly takes for frequent costs time, not results).
2. Each chunk of texts makes its suffixes, up to `longest` words of a piece, and counts equal ones. They are dealt to buckets by their first
   word, so that a bucket holds all suffixes that begin alike. A word with more than a 2**-HOT_BITS part of all occurrences would fill its
   bucket: its suffixes go by two words and, once more, by all of them, each for the counts of that many words. Buckets follow the number
   of words, so each holds about BUCKET_WORDS.
3. In a bucket the pointers are sorted word by word: partitions smaller, equal and greater than a pivot word; equal ones go on to the next
   word. The size of an equal partition is a phrase's count; a partition of fewer than `least` occurrences is abandoned, whole.
   All partitions of a depth are divided at once, SORTED_WORDS pointers or so at a time.

Phrases are then joined with the counts of their parts; words with a hot share of occurrences are looked up in a broadcast list (at most
2**HOT_BITS of them), the others in a shuffle. Arithmetic is exact (decimals of 38 digits, counts below 10**15). Null languages are `und`,
null and empty texts have no words; repeated rows count again; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm import words as W
from veilspark.llm.frames import looked_up, picked, small_batches
from veilspark.llm.tables import written

CHUNK_BYTES = 4 << 20
# Bytes of a chunk that are split into words at once.
PART_BYTES = 1 << 18
BUCKET_WORDS = 1_000_000
# Suffixes that are sorted at once, of the bucket's, and bytes of an Arrow batch of packed ones.
SORTED_WORDS = 1 << 18
SENT_BYTES = 2 << 20
HOT_BITS = 17
FREQUENT_BITS = 26
_BREAK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\v\f\r", np.uint8))
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))


def _hash_of(text: str, seed: int) -> np.uint64:
    data = np.frombuffer(text.encode() + b"\x00", np.uint8)
    return W.mix(W.span_hashes(data, np.array([0]), np.array([len(data)])) + W.numbers(1, seed))[0]


@dataclass
class Tokens:
    """Words of a slice in order: begin and end, number of the piece, hash with the language."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    hash: np.ndarray
    row: np.ndarray


def tokens(s: W.Slice, salts: np.ndarray) -> Tokens:
    """`salts` has a number for the language of each row of the slice."""
    data = W.lowered(s.data)
    stop = _BREAK[data]
    solid = ~(stop | _SPACE[data])
    cut = np.zeros(len(data) + 1, bool)
    cut[s.bounds] = True
    before, after = np.concatenate([[False], solid[:-1]]), np.concatenate([solid[1:], [False]])
    begin = np.flatnonzero(solid & (~before | cut[:-1]))
    end = np.flatnonzero(solid & (~after | cut[1:])) + 1
    row = np.searchsorted(s.bounds, begin, "right") - 1
    # Breaks before a word, and its row, tell its piece.
    piece = np.cumsum(stop)[begin] + row if len(begin) else begin
    # 0 marks the end of a suffix, so no word has it.
    value = np.maximum(W.mix(W.span_hashes(data, begin, end) ^ salts[row]), np.uint64(1))
    return Tokens(data, begin, end, piece, value, row)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Texts and languages of about CHUNK_BYTES together."""
    held, size = [], 0
    for batch in batches:
        for s in W.slices(batch.column("text"), CHUNK_BYTES):
            held.append(batch.slice(s.first, s.rows))
            size += len(s.data)
            if size >= CHUNK_BYTES:
                yield _together(held)
                held, size = [], 0
    if held:
        yield _together(held)


def _together(held: list[pa.RecordBatch]) -> tuple[pa.Array, list[str]]:
    text = pa.concat_arrays([b.column("text").cast(pa.large_string()) for b in held])
    return text, [x for b in held for x in b.column("lang").to_pylist()]


def _tokenised(texts: pa.Array, langs: list[str], seed: int) -> Iterator[Tokens]:
    salt = {x: _hash_of(x, seed) for x in set(langs)}
    salts = np.array([salt[x] for x in langs], np.uint64)
    for s in W.slices(texts, PART_BYTES):
        yield tokens(s, salts[s.first : s.last])


def _first_of_each(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the place of one of each, how many there are."""
    order = np.argsort(value)
    ordered = value[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(value) else np.zeros(0, np.int64)
    return ordered[start], order[start], np.diff(np.append(start, len(value)))


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, h (hash as a signed number), f: every word with its occurrences. Chunks send each distinct word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in _chunks(batches):
            # Distinct words of the chunk so far, by hash, with their number among `words`.
            known, number, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            of, words = [], []
            base = 0
            for s, t in zip(W.slices(texts, PART_BYTES), _tokenised(texts, langs, seed)):
                value, place, count = _first_of_each(t.hash)
                at = np.searchsorted(known, value)
                old = at < len(known)
                old[old] = known[at[old]] == value[old]
                total[number[at[old]]] += count[old]
                place, new = place[~old], value[~old]
                raw = t.data.tobytes()
                words += [raw[b:e] for b, e in zip(t.begin[place].tolist(), t.end[place].tolist())]
                of += [langs[base + r] for r in t.row[place].tolist()]
                # Both are in order, so new ones go in where they belong.
                known = np.insert(known, at[~old], new)
                number = np.insert(number, at[~old], np.arange(len(total), len(words)))
                total = np.append(total, count[~old])
                base += s.rows
            h = np.empty(len(known), np.int64)
            h[number] = known.astype(np.int64)
            columns = [pa.array(of, pa.string()), pa.array(words, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(h), pa.array(total)], ["lang", "word", "h", "f"])

    return docs.mapInArrow(run, "lang string, word string, h long, f long").groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))


def frequent_bits(frequent: DataFrame) -> np.ndarray:
    """A bitmap of 2**FREQUENT_BITS bits with those of the words' hashes set: at most as many bytes come to the driver."""
    at = F.shiftrightunsigned("h", 64 - FREQUENT_BITS)
    blocks = frequent.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    # The function numbers its buckets from 1, except that 0 lies in the first as well.
    out = np.zeros(1 << (FREQUENT_BITS - 3), np.uint8)
    for row in blocks.collect():
        low = (row["block"] - 1) * 4096 if row["block"] else 0
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[low : low + len(part)] |= part
    return out


def positions(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set, laid out as Spark's bitmap functions do: position p is bit (p - 1) of the bucket that begins at 1."""
    p = (h >> np.uint64(64 - FREQUENT_BITS)).astype(np.int64)
    flat = np.where(p > 0, p - 1, 0)
    return bits[flat >> 3] >> (flat & 7).astype(np.uint8) & 1 > 0


def suffixes(t: Tokens, frequent: np.ndarray, longest: int) -> np.ndarray:
    """A row for each word that may start a phrase: its hash and those of the words after it, 0 from the end of the piece or a rare word on."""
    n = len(t.hash)
    key = np.where(frequent, t.hash, np.uint64(0))
    out = np.zeros((n, longest), np.uint64)
    out[:, 0] = key
    for k in range(1, longest):
        if n > k:
            same = (t.piece[k:] == t.piece[:-k]) & (out[:-k, k - 1] != 0)
            out[:-k, k] = np.where(same, key[k:], np.uint64(0))
    return out[(out[:, 0] != 0) & (out[:, 1] != 0)]


def _summed(keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows of keys as one, with their counts summed (or, rarely, as two where other rows share the hash they are sorted by)."""
    if not len(keys):
        return keys, count
    both = np.zeros(len(keys), np.uint64)
    for k, factor in enumerate(W.numbers(keys.shape[1], 53)):
        both += keys[:, k] * (factor | np.uint64(1))
    order = np.argsort(W.mix(both))
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    return keys[start], np.add.reduceat(count[order], start)


def three_way(key: np.ndarray, size: np.ndarray, segment: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Quicksort of segments by one word. `key`, `size` (occurrences) and `segment` (ascending) belong to pointers that stand together.

    Returns the pointers that ended in equal partitions of at least `least` occurrences, and the number of the partition of each, ascending.
    In each step all segments are divided by a pivot of their own into smaller, equal and greater; equal ones are done, the others are
    segments of the next step, but for those with too few occurrences, which are abandoned.
    """
    pointer = np.arange(len(key))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    many = 0
    while len(pointer):
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        length = np.diff(np.append(first, len(pointer)))
        number = np.repeat(np.arange(len(first)), length)
        pivot = key[pointer[first + length // 2]][number]
        here = key[pointer]
        side = (here > pivot).astype(np.int8) - (here < pivot).astype(np.int8)
        total = np.bincount(3 * number + side + 1, size[pointer], minlength=3 * len(first))
        enough = total[3 * number + side + 1] >= least
        equal = enough & (side == 0)
        done.append((pointer[equal], many + number[equal]))
        many += len(first)
        less, more = enough & (side < 0), enough & (side > 0)
        # Smaller before greater within each segment: a stable order by segment and side.
        rest = np.concatenate([np.flatnonzero(less), np.flatnonzero(more)])
        new = 2 * number[rest] + (side[rest] > 0)
        order = np.argsort(new, kind="stable")
        pointer, segment = pointer[rest][order], new[order]
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def phrases(keys: np.ndarray, count: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey quicksort of suffixes: for each number of words the phrases with at least `least` occurrences, and these."""
    if not len(keys):
        return
    # Parts by the first bits of the first word spare the first steps.
    route = (keys[:, 0] >> np.uint64(50)).astype(np.int64)
    pointer = np.argsort(route, kind="stable")
    segment = route[pointer]
    for depth in range(keys.shape[1]):
        there = keys[pointer, depth] != 0
        pointer, segment = pointer[there], segment[there]
        if not len(pointer):
            return
        at, segment = three_way(keys[pointer, depth], count[pointer], segment, least)
        pointer = pointer[at]
        if not len(pointer):
            return
        start = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        yield depth + 1, keys[pointer[start], : depth + 1], np.add.reduceat(count[pointer], start)


def _packed(keys: np.ndarray, count: np.ndarray) -> bytes:
    """Rows of keys and their counts, each first word once. Rows are sorted by it."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:, 0] != keys[:-1, 0]]))
    run = np.diff(np.append(start, len(keys))).astype("<u4")
    head = np.array([len(keys), len(start), keys.shape[1]], "<u4")
    small = np.minimum(count, 255).astype(np.uint8)
    return b"".join([head.tobytes(), run.tobytes(), keys[start, 0].astype("<u8").tobytes(), *(keys[:, k].astype("<u8").tobytes() for k in range(1, keys.shape[1])), small.tobytes(), count[small == 255].astype("<u8").tobytes()])


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, runs, width = np.frombuffer(blob, "<u4", 3).tolist()
    at = 12
    run = np.frombuffer(blob, "<u4", runs, at)
    at += 4 * runs
    keys = np.empty((n, width), np.uint64)
    keys[:, 0] = np.repeat(np.frombuffer(blob, "<u8", runs, at), run)
    at += 8 * runs
    for k in range(1, width):
        keys[:, k] = np.frombuffer(blob, "<u8", n, at)
        at += 8 * n
    count = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
    at += n
    large = count == 255
    count[large] = np.frombuffer(blob, "<u8", int(large.sum()), at)
    return keys, count


def _route(keys: np.ndarray, by: int) -> np.ndarray:
    """A number for the first `by` words of each row."""
    route = np.zeros(len(keys), np.uint64)
    for k, factor in enumerate(W.numbers(by, 59)):
        route += keys[:, k] * (factor | np.uint64(1))
    return W.mix(route)


def _dealt(keys: np.ndarray, count: np.ndarray, hot: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """kind, bucket, packed suffixes. Kind 0: all suffixes of a first word; of hot words kind k > 0: k words, dealt by all of them."""
    is_hot = np.isin(keys[:, 0], hot)
    for kind in (0, *range(2, keys.shape[1] + 1)):
        there = is_hot & (keys[:, kind - 1] != 0) if kind else ~is_hot
        some, n = keys[there], count[there]
        if kind:
            some[:, kind:] = 0
            some, n = _summed(some, n)
        if not len(some):
            continue
        bucket = (_route(some, max(kind, 1)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((some[:, 0], bucket))
        some, n, bucket = some[order], n[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield kind, int(bucket[a]), _packed(some[a:b], n[a:b])


def route_suffixes(docs: DataFrame, seed: int, bits: np.ndarray, hot: np.ndarray, buckets: int, longest: int) -> DataFrame:
    """kind, bucket, suffixes (packed)."""
    held = docs.sparkSession.sparkContext.broadcast((bits, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = held.value
        for texts, langs in _chunks(batches):
            parts = [_summed(found, np.ones(len(found), np.int64)) for found in (suffixes(t, positions(bits, t.hash), longest) for t in _tokenised(texts, langs, seed))]
            if not parts:
                continue
            keys, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            del parts
            keys, count = _summed(keys, count)
            for rows in _in_batches(_dealt(keys, count, hot, buckets)):
                kind, bucket, blob = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int64()), pa.array(blob, pa.binary())], ["kind", "bucket", "suffixes"])

    return docs.mapInArrow(run, "kind int, bucket long, suffixes binary")


def _in_batches(rows: Iterator[tuple], most: int = 1024) -> Iterator[list]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) == most or size >= SENT_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def bucket_phrases(kind: int, blobs: list, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """What `phrases` gives for all suffixes of a bucket, that are sorted in parts of about SORTED_WORDS. Suffixes that share the words by
    which they were dealt are in one part, so a part counts for itself."""
    size = [int(np.frombuffer(b, "<u4", 1)[0]) for b in blobs]
    width = int(np.frombuffer(blobs[0], "<u4", 3)[2])
    keys, count = np.empty((sum(size), width), np.uint64), np.empty(sum(size), np.int64)
    at = 0
    for blob, n in zip(blobs, size):
        keys[at : at + n], count[at : at + n] = _unpacked(blob)
        at += n
    parts = -(-len(keys) // SORTED_WORDS)
    # The low bits tell the bucket.
    part = ((_route(keys, max(kind, 1)) >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
    for p in range(parts):
        here = part == p
        for depth, found, n in phrases(keys[here], count[here], least):
            # A bucket has all suffixes of its first word (kind 0), or all phrases of as many words as its kind.
            if depth >= 2 and kind in (0, depth):
                yield depth, found, n


def count_phrases(routed: DataFrame, least: int, longest: int) -> DataFrame:
    """h1 .. h<longest> (null beyond the phrase) and a: phrases of two words and more with at least `least` occurrences."""
    names = [f"h{k}" for k in range(1, longest + 1)]
    kinds = pa.schema([(n, pa.int64()) for n in [*names, "a"]])

    def of_bucket(rows: pa.Table) -> pa.Table:
        blobs = [x.as_buffer() for x in rows.column("suffixes")]
        out = []
        for depth, found, n in bucket_phrases(rows.column("kind")[0].as_py(), blobs, least):
            cells = [pa.array(found[:, k].astype(np.int64)) if k < depth else pa.nulls(len(n), pa.int64()) for k in range(longest)]
            out.append(pa.RecordBatch.from_arrays([*cells, pa.array(n.astype(np.int64))], schema=kinds))
        return pa.Table.from_batches(out, kinds)

    return routed.groupBy("kind", "bucket").applyInArrow(of_bucket, ", ".join(f"{n} long" for n in kinds.names))


def _looked_up(df: DataFrame, key: str, words: DataFrame, hot: DataFrame, **columns: str) -> DataFrame:
    return looked_up(df, key, words, "h", hot, F.xxhash64("h1", "h2", "h3"), **columns)


def _score(left: str, right: str) -> Column:
    """floor(1000000 * a * a / (l * r)), exactly."""
    whole = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    return F.expr(f"({whole('a')} * {whole('a')} * CAST(1000000 AS DECIMAL(7, 0))) DIV ({whole(left)} * {whole(right)})")


def mine_phrases(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, text_col: str = "text", lang_col: str = "lang", longest: int = 3) -> DataFrame:
    """Per language its best phrases: lang, rank, phrase, a, l, r, n, score. A phrase that is inside a longer one with at least `share` percent
    of its occurrences is left out. `longest` is 2 or 3."""
    if longest not in (2, 3):
        raise ValueError("phrases have 2 or 3 words")
    small_batches(docs.sparkSession)
    frame = picked(docs, text=text_col, lang=lang_col).withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.lit("und")))
    seed = 61
    while True:
        words = written(count_words(frame, seed), "words")
        if words.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
        seed += 1
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    n = words.agg(F.sum("f")).first()[0] or 0
    frequent = written(words.where(F.col("f") >= least), "frequent")
    hot = frequent.where(F.col("f") > max(BUCKET_WORDS // 4, n >> HOT_BITS))
    hashes = np.array([r["h"] for r in hot.select("h").collect()], np.int64).astype(np.uint64)
    buckets = max(16, -(-n // BUCKET_WORDS))
    routed = route_suffixes(frame, seed, frequent_bits(frequent), hashes, buckets, longest)
    found = written(count_phrases(routed, least, longest), "phrases")
    return ranked(scored(found, frequent, hot, share), frequent, hot, totals, top)


def scored(found: DataFrame, frequent: DataFrame, hot: DataFrame, share: int) -> DataFrame:
    """The phrases that stay, with l and r of their weakest cut and its score."""
    last = F.col("h3") if "h3" in found.columns else F.lit(None).cast("long")
    found = found.select("h1", "h2", last.alias("h3"), "a")
    pairs, triples = found.where("h3 IS NULL"), found.where("h3 IS NOT NULL")
    # A pair is inside the triples it begins and those it ends.
    inside = triples.select("h1", "h2", "a").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))
    inside = inside.groupBy("h1", "h2").agg(F.max("a").alias("longer"))
    free = pairs.join(inside, ["h1", "h2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    free = _looked_up(_looked_up(free.select(*found.columns), "h1", frequent, hot, l="f"), "h2", frequent, hot, r="f")
    free = free.select(*found.columns, "l", "r", _score("l", "r").alias("score"))
    # A triple is cut after its first word, or after its second.
    part = lambda first, second, name: pairs.select(F.col("h1").alias(first), F.col("h2").alias(second), F.col("a").alias(name))
    triples = triples.join(part("h2", "h3", "r1"), ["h2", "h3"]).join(part("h1", "h2", "l2"), ["h1", "h2"]).select(*found.columns, "r1", "l2")
    triples = _looked_up(_looked_up(triples, "h1", frequent, hot, l1="f"), "h3", frequent, hot, r2="f")
    triples = triples.withColumns({"s1": _score("l1", "r1"), "s2": _score("l2", "r2")})
    pick = lambda one, two: F.when(F.col("s1") <= F.col("s2"), F.col(one)).otherwise(F.col(two))
    triples = triples.select(*found.columns, pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))
    return free.unionByName(triples)


def ranked(found: DataFrame, frequent: DataFrame, hot: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The best of each language with their words. A task keeps `top` rows of a language at most before they meet."""
    found = _looked_up(found, "h1", frequent, hot, w1="word", lang="lang")
    found = _looked_up(_looked_up(found, "h2", frequent, hot, w2="word"), "h3", frequent, hot, w3="word")
    found = found.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
