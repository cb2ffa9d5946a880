"""MinHash near-dedup with tensored banding: table keys are pairs of values from one small collection; candidates are verified on full sets.

A document's set is its distinct shingles. Equal sets are one class. Each class has m collection values, each of `rows` minhashes; the
table (i, j) has the key of values i and j, so m * rows minhashes serve m(m-1)/2 tables of 2 * rows rows. m is the least that lets a
pair at the threshold miss all tables with probability MISS.

Verification is exact, on the full sets, in two rounds, and emits no pairs within a group:
1. Every candidate is compared with one neighbour: the heaviest class (copies, then smallest) of a table it shares, the one it shares
   most tables with. Links make provisional components.
2. In tables that still hold several components, classes of different ones are compared by a 256-byte signature, in chunk pairs of at
   most CHUNK members, each pair of classes in the first table it shares. A class whose estimate reaches the threshold less 4.5 standard
   deviations for a class of another component is compared exactly with the whole block (at most about BLOCK classes) of that one.
   One link per class and block is kept: a block is connected already, so no link between components is lost.

Shingles are 64-bit hashes of word sequences; within a pair of sets a collision has a chance of about n*n/2**64. Classes are told
apart by 128 bits. Documents without words (null or empty texts) are linked with nothing. Documents of fewer words than a shingle have
their whole sequence as the only one. Rows that share an id and text share their class; null ids count as greater than any
other, so a group's id is null only if all are. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import words as W
from veilspark.llm.components import components
from veilspark.llm.frames import heavy_keys, looked_up, per_batch, picked, row_key, small_batches
from veilspark.llm.tables import written

MISS = 5e-5
SIGNATURE = 256
CHUNK = 1024
BLOCK = 128
COPIES = 128


def collection_size(threshold: float, rows: int, miss: float = MISS) -> int:
    """Least m for which at most one of m values agrees with probability `miss` or less, at similarity `threshold`."""
    p = threshold**rows
    m = 2
    while (1 - p) ** m + m * p * (1 - p) ** (m - 1) > miss:
        m += 1
    return m


def _sets(s: W.Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, and where each row begins. A-Z are lowered."""
    return W.distinct_per_row(*W.shingles(W.words(s, lower=True), size), s.rows)


def _minima(value: np.ndarray, bounds: np.ndarray, many: int, seed: int) -> np.ndarray:
    """A column of minima for each of `many` hash functions; rows without values have the greatest number."""
    out = np.empty((len(bounds) - 1, many), np.uint64)
    for k, factor in enumerate(W.numbers(many, seed)):
        x = value * (factor | np.uint64(1))
        x ^= x >> np.uint64(31)
        out[:, k] = W.at_starts(np.minimum, x * (factor >> np.uint64(7) | np.uint64(1)), bounds, np.uint64(2**64 - 1))
    return out


def _identity(value: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """16 bytes that tell sets apart."""
    halves = [W.at_starts(np.add, W.mix(value ^ c), bounds, np.uint64(0)) for c in W.numbers(2, 23)]
    both = np.stack([W.mix(h + np.diff(bounds).astype(np.uint64)) for h in halves], axis=1).astype(">u8")
    return [x.tobytes() for x in both]


def _described(docs: DataFrame, size: int, m: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set identity v, and the m collection values as packed 64-bit numbers."""

    def make(batch: pa.RecordBatch) -> dict:
        n, v, values = [], [], []
        for s in W.slices(batch.column("text")):
            value, bounds = _sets(s, size)
            low = _minima(value, bounds, m * rows, 31)
            packed = np.zeros((s.rows, m), np.uint64)
            for r, factor in enumerate(W.numbers(rows, 37)):
                packed += low[:, r::rows] * (factor | np.uint64(1))
            n.append(np.diff(bounds))
            v += _identity(value, bounds)
            values += [x.tobytes() for x in W.mix(packed).astype("<u8")]
        count = np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64)
        return {"doc_id": batch.column("doc_id"), "n_shingles": count, "v": pa.array(v, pa.binary()), "coll": pa.array(values, pa.binary())}

    return per_batch(docs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, v binary, coll binary", make)


def _values(classes: DataFrame) -> DataFrame:
    """i, value, and the class, for each collection value."""

    def make(batch: pa.RecordBatch) -> dict | None:
        if not batch.num_rows:
            return None
        all_values = np.frombuffer(b"".join(batch.column("coll").to_pylist()), "<i8").reshape(batch.num_rows, -1)
        m = all_values.shape[1]
        return {"v": batch.column("v").take(pa.array(np.repeat(np.arange(batch.num_rows), m))), "i": np.tile(np.arange(m, dtype=np.int32), batch.num_rows), "value": all_values.ravel()}

    return per_batch(classes.select("v", "coll"), "v binary, i int, value long", make)


def _keyed(shared: DataFrame) -> DataFrame:
    """key, i, j, v: the tables (i, j) of every class, of values that some other class has too."""
    own = shared.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("own")).where(F.size("own") > 1)
    first = own.select("v", "own", F.posexplode("own").alias("at", "a"))
    both = first.select("v", "a", F.explode(F.slice("own", F.col("at") + 2, F.size("own"))).alias("b"))
    return both.select(F.xxhash64("a.i", "b.i", "a.value", "b.value").alias("key"), F.col("a.i").alias("i"), F.col("b.i").alias("j"), "v")


def _set_table(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """v, set of the documents with these ids, sets as packed ascending 64-bit hashes."""

    def make(batch: pa.RecordBatch) -> dict:
        v, sets = [], []
        for s in W.slices(batch.column("text")):
            value, bounds = _sets(s, size)
            v += _identity(value, bounds)
            sets += [value[a:b].astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        return {"v": pa.array(v, pa.binary()), "set": pa.array(sets, pa.binary())}

    chosen = docs.join(ids.select(F.col("doc_id").alias("__id")), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return per_batch(chosen.select("text"), "v binary, set binary", make)


# Hashes of sets that are compared at once.
COMPARED = 1 << 19


def _runs(sets: list[bytes]) -> Iterator[tuple[int, int]]:
    """Consecutive sets of about COMPARED hashes together."""
    begin, size = 0, 0
    for k, x in enumerate(sets):
        if k > begin and size + len(x) > 8 * COMPARED:
            yield begin, k
            begin, size = k, 0
        size += len(x)
    if begin < len(sets):
        yield begin, len(sets)


def _overlaps(sets: list[bytes], others: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of all intersections (exact), and of the sets. Only shared hashes make columns, a bounded number at a time."""
    out = np.zeros((len(sets), len(others)), np.int64)
    for a, b in _runs(sets):
        for c, d in _runs(others):
            out[a:b, c:d] = _overlaps_of(sets[a:b], others[c:d])
    return out, np.array([len(x) // 8 for x in sets]), np.array([len(x) // 8 for x in others])


def _overlaps_of(sets: list[bytes], others: list[bytes]) -> np.ndarray:
    a, b = [np.frombuffer(x, "<u8") for x in sets], [np.frombuffer(x, "<u8") for x in others]
    if len(a) == 1 or len(b) == 1:
        # One set against others: look up each in it, or it in each.
        one, many = (a[0], b) if len(a) == 1 else (b[0], a)
        found = [np.count_nonzero(one[np.minimum(np.searchsorted(one, x), len(one) - 1)] == x) if len(one) else 0 for x in many]
        return np.array(found).reshape(len(a), len(b))
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    ua, ia = np.unique(np.concatenate(a), return_inverse=True)
    ub, ib = np.unique(np.concatenate(b), return_inverse=True)
    both, ca, cb = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    out = np.zeros((len(a), len(b)), np.float64)
    place_a, place_b = np.full(len(ua), -1), np.full(len(ub), -1)
    place_a[ca], place_b[cb] = np.arange(len(both)), np.arange(len(both))
    ra, rb = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    pa_, pb_ = place_a[ia], place_b[ib]
    for low in range(0, len(both), 4096):
        high = min(low + 4096, len(both))
        x, y = np.zeros((len(a), high - low), np.float32), np.zeros((len(b), high - low), np.float32)
        ka, kb = (pa_ >= low) & (pa_ < high), (pb_ >= low) & (pb_ < high)
        x[ra[ka], pa_[ka] - low] = 1
        y[rb[kb], pb_[kb] - low] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _similar(sets: list[bytes], others: list[bytes], percent: int) -> np.ndarray:
    both, na, nb = _overlaps(sets, others)
    return 100 * both >= percent * (na[:, None] + nb[None, :] - both)


def _first_round(percent: int):
    def verify(hub: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        """Members of one hub, a bounded part of them, that are similar to it."""
        if not len(hub) or not len(members):
            return pd.DataFrame({"a": [], "b": []})
        ok = _similar([hub["set"].iloc[0]], members["set"].tolist(), percent)[0]
        return pd.DataFrame({"a": [hub["hub"].iloc[0]] * int(ok.sum()), "b": members["v"][ok].tolist()})

    return verify


def _signed(sets: DataFrame) -> DataFrame:
    """v, sign: one byte of each of SIGNATURE minhashes."""

    def make(batch: pa.RecordBatch) -> dict:
        raw = batch.column("set").to_pylist()
        signs: list[bytes] = []
        for low, high in _runs(raw):
            part = [np.frombuffer(x, "<u8") for x in raw[low:high]]
            bounds = np.cumsum([0, *map(len, part)])
            signs += [x.tobytes() for x in (W.mix(_minima(np.concatenate(part), bounds, SIGNATURE, 41)) >> np.uint64(56)).astype(np.uint8)]
        return {"v": batch.column("v"), "sign": pa.array(signs, pa.binary())}

    return per_batch(sets, "v binary, sign binary", make)


def _wanted_blocks(percent: int):
    """For each chunk pair of a table, whose rows come together in a sorted partition: which class is to be compared with which block."""
    share = percent / 100
    least = share - 4.5 * math.sqrt(share * (1 - share) / SIGNATURE)
    agreeing = (least * 255 + 1) / 256 * SIGNATURE

    def of_group(i: int, j: int, left: np.ndarray, right: np.ndarray, coll: np.ndarray, sign: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of different components that look similar and share no earlier table."""
        apart = root[left][:, None] != root[right][None, :]
        if left is right:
            apart = np.triu(apart, 1)
        # This is the first table the two classes share if no other value below j agrees.
        for k in range(j):
            if k != i and apart.any():
                apart &= coll[left, k][:, None] != coll[right, k][None, :]
        x, y = np.nonzero(apart)
        near = [np.zeros(0, bool)]
        for low in range(0, len(x), 1 << 14):
            near.append((sign[left[x[low : low + (1 << 14)]]] == sign[right[y[low : low + (1 << 14)]]]).sum(axis=1) >= agreeing)
        ok = np.concatenate(near)
        return left[x[ok]], right[y[ok]]

    def of_batch(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        plain = {c: rows.column(c).to_numpy() for c in ("i", "j", "c1", "c2", "chunk", "weight")}
        unpack = lambda c, t: np.frombuffer(b"".join(rows.column(c).to_pylist()), t).reshape(rows.num_rows, -1)
        coll, sign = unpack("coll", "<i8"), unpack("sign", np.uint8)
        root = rows.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        v, blk = rows.column("v").to_pylist(), rows.column("blk").to_pylist()
        out = set()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a < 2 or (root[a:b] == root[a]).all():
                continue
            every = np.arange(a, b)
            if plain["c1"][a] == plain["c2"][a]:
                left = right = every
            else:
                left, right = every[plain["chunk"][a:b] == plain["c1"][a]], every[plain["chunk"][a:b] == plain["c2"][a]]
            for x, y in zip(*(z.tolist() for z in of_group(int(plain["i"][a]), int(plain["j"][a]), left, right, coll, sign, root))):
                small, large = (x, y) if (plain["weight"][x], v[x]) <= (plain["weight"][y], v[y]) else (y, x)
                out.add((v[small], blk[large]))
        pairs = sorted(out)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["v", "blk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j", "c1", "c2")])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            # The last group may go on in the next batch.
            if starts[-1]:
                yield of_batch(rows.slice(0, starts[-1]), starts)
            rest = rows.slice(starts[-1])
        if rest is not None:
            yield of_batch(rest, np.array([0, rest.num_rows]))

    return run


def _second_round(percent: int):
    def verify(block: pd.DataFrame, comers: pd.DataFrame) -> pd.DataFrame:
        """For each comer one class of the block that it is similar to, if there is any."""
        if not len(block) or not len(comers):
            return pd.DataFrame({"a": [], "b": []})
        block = block.sort_values("v", ignore_index=True)
        ok = _similar(comers["set"].tolist(), block["set"].tolist(), percent)
        hit = ok.any(axis=1)
        return pd.DataFrame({"a": comers["v"][hit].tolist(), "b": block["v"].to_numpy(object)[ok.argmax(axis=1)[hit]].tolist()})

    return verify


def _split(column: str, parts: str):
    return F.pmod(F.xxhash64(column), F.col(parts)).cast("int")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_shingles, component_id (smallest id linked with it, directly or through others), kept (it is that document)."""
    small_batches(docs.sparkSession)
    frame = picked(docs, doc_id=id_col, text=text_col)
    m = collection_size(percent / 100, rows)
    described = written(_described(frame, size, m, rows), "described")
    classes = written(described.where("n_shingles > 0").groupBy("v").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("coll").alias("coll")), "classes")

    # Tables (i, j) of classes that share values i and j with another class.
    values = _values(classes)
    common = values.groupBy("i", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    keyed = _keyed(values.join(common, ["i", "value"], "left_semi"))
    heavy = F.struct((-F.col("copies")).alias("c"), F.col("v").alias("v"))
    keyed = written(keyed.join(classes.select("v", "copies"), "v"), "tables")
    hubs = keyed.groupBy("key", "i", "j").agg(F.min(heavy).alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "i", "j", F.col("hub.v").alias("hub"), "n")
    tables = written(keyed.join(hubs, ["key", "i", "j"]), "shared")
    candidates = tables.select("v").distinct()
    ids = classes.join(candidates, "v", "left_semi").select(F.col("first_id").alias("doc_id"))
    sets = written(_set_table(frame, ids, size), "sets")

    # Round 1: one neighbour for each class.
    shared = tables.where("v <> hub").groupBy("v", "hub").agg(F.count("*").alias("n"))
    best = shared.groupBy("v").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))
    best = best.join(best.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(COPIES)).alias("parts")), "hub").withColumn("part", _split("v", "parts"))
    best = written(best, "best")
    members = best.join(sets, "v").select("hub", "part", "v", "set")
    heads = best.select(F.col("hub").alias("v"), F.col("part").alias("p")).distinct().join(sets, "v").select(F.col("v").alias("hub"), "p", F.col("set").alias("set"))
    found = heads.groupBy("hub", "p").cogroup(members.groupBy("hub", "part")).applyInPandas(_first_round(percent), "a binary, b binary")
    edges = written(found, "links")

    # Round 2: tables that hold several components.
    rooted = components(edges)
    rooted = written(tables.select("v").distinct().join(rooted, "v", "left").select("v", F.coalesce("root", "v").alias("root")), "rooted")
    weight = written(rooted.groupBy("root").agg(F.count("*").alias("weight")), "weights")
    rooted = looked_up(rooted, "root", weight, "root", heavy_keys(weight, "weight"), F.col("v"), weight="weight").withColumn("blocks", F.ceil(F.col("weight") / F.lit(BLOCK)))
    rooted = written(rooted.withColumn("blk", F.concat("root", F.lit(b"/"), _split("v", "blocks").cast("string").cast("binary"))).drop("blocks"), "rooted")
    placed = tables.select("key", "i", "j", "v", "n").join(rooted, "v")
    mixed = placed.groupBy("key", "i", "j").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "i", "j")
    open_rows = written(placed.join(mixed, ["key", "i", "j"], "left_semi"), "open")
    in_doubt = open_rows.select("v").distinct()
    signs = _signed(sets.join(in_doubt, "v", "left_semi")).join(classes.select("v", "coll"), "v")
    chunks = open_rows.withColumn("chunks", F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")).withColumn("chunk", _split("v", "chunks"))
    chunks = chunks.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    chunks = chunks.withColumns({"c1": F.least("chunk", "with"), "c2": F.greatest("chunk", "with")}).join(signs, "v")
    group = ["key", "i", "j", "c1", "c2"]
    chunks = chunks.select(*group, "v", "chunk", "root", "weight", "blk", "coll", "sign").repartition(*group).sortWithinPartitions(*group)
    wanted = written(chunks.mapInArrow(_wanted_blocks(percent), "v binary, blk binary").distinct(), "wanted")
    comers = wanted.join(wanted.groupBy("blk").agg(F.ceil(F.count("*") / F.lit(COPIES)).alias("parts")), "blk").withColumn("part", _split("v", "parts"))
    asked = comers.select(F.col("blk").alias("b"), F.col("part").alias("p")).distinct().join(rooted.select(F.col("blk").alias("b"), "v"), "b")
    asked = asked.join(sets, "v").select("b", "p", F.col("v").alias("v"), F.col("set").alias("set"))
    comers = comers.join(sets, "v").select("blk", "part", "v", "set")
    more = asked.groupBy("b", "p").cogroup(comers.groupBy("blk", "part")).applyInPandas(_second_round(percent), "a binary, b binary")
    more = written(more, "links")

    final = components(edges.unionByName(more))
    known = written(classes.select("v", "first_id", "copies").join(final, "v", "left").select("v", F.coalesce("root", "v").alias("root"), "first_id", "copies"), "known")
    smallest = written(known.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("classes")), "smallest")
    of_class = looked_up(known, "root", smallest, "root", heavy_keys(smallest, "classes"), F.col("v"), component_id="component_id")
    of_class = written(of_class.select("v", "component_id", "copies"), "components")
    any_class = F.concat(F.lit("row:").cast("binary"), F.monotonically_increasing_id().cast("string").cast("binary"))
    joined = looked_up(described, "v", of_class, "v", heavy_keys(of_class, "copies"), any_class, component_id="component_id")
    group = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", group.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without near duplicates: of each group the row with the smallest id (null last), of those the one with the smallest
    digest of all its columns, and of equal rows one. Equal rows are dropped before they meet, so a group may be of any size."""
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), row_key(docs).alias("row"))
    keyed = docs.withColumn("__key", key)
    found = near_duplicates(keyed, size, percent, id_col="__key", text_col=text_col, **options)
    kept = found.where("kept").select(F.col("doc_id.row").alias("__row")).distinct()
    once = keyed.withColumn("__row", F.col("__key.row")).drop("__key").dropDuplicates(["__row"])
    return once.join(kept, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
