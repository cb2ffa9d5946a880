"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Every vector is projected on `projections` random directions; each block of vectors keeps one sorted array per projection. For a query,
each array is opened in a window centred on the query's projection. A vector that stands within the windows of enough projections is a
candidate and is verified: its exact distance is computed. Virtual rehashing widens all windows by the factor `step` until the query has
k verified vectors within the radius the windows stand for. The window width and the threshold are set so that a vector within the
radius passes with probability 1 - `miss`; no bound stops a search earlier, so a block's nearest are found with that probability each.

Queries are a stated set. Vectors are dealt to blocks of about BLOCK_ROWS rows by hash, queries to groups of QUERY_ROWS; a task holds one
block and one group, finds the k nearest of each query in the block, and only these are shuffled to be merged. Memory is bounded by
the two sizes; the work is queries x blocks, each with sub-linear verification.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, as query or candidate. Vectors of different
lengths are not compared. Rows that share an id with the query are the query itself; other rows that share an id each count. Fewer than
k candidates: all of them. Equal distances go to the smaller id. Null ids take no part. Other columns are not read.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.frames import per_batch, picked
from veilspark.llm.tables import written

BLOCK_ROWS = 16_384
QUERY_ROWS = 16_384


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and the components as packed doubles, of vectors that take part."""

    def make(batch: pa.RecordBatch) -> dict:
        ids, packed, dims = [], [], []
        for vec_id, v in zip(batch.column("vec_id"), batch.column("v")):
            if not vec_id.is_valid or not v.is_valid or not len(v) or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all() and x.any():
                ids.append(vec_id.as_py())
                packed.append(x.astype("<f8").tobytes())
                dims.append(len(x))
        return {"vec_id": pa.array(ids, pa.int64()), "dim": pa.array(dims, pa.int32()), "x": pa.array(packed, pa.binary())}

    return per_batch(vectors, "vec_id long, dim int, x binary", make)


def within(width: float, projections: int, miss: float) -> int:
    """Collisions that a vector at distance 1 reaches with probability 1 - miss, for windows of half that width."""
    p = 2 * NormalDist().cdf(width / 2) - 1
    term = lambda n: math.comb(projections, n) * p**n * (1 - p) ** (projections - n)
    below, least = 0.0, 0
    while below + term(least) <= miss:
        below += term(least)
        least += 1
    return least


class Block:
    """Vectors of a block with a sorted array for each projection."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, directions: np.ndarray):
        self.x, self.ids = x, ids
        projected = (x @ directions).T
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)

    def nearest(self, q: np.ndarray, q_id: int, centre: np.ndarray, start: float, k: int, width: float, least: int, step: float) -> list[tuple[float, int]]:
        n = len(self.ids)
        counts, done, own = np.zeros(n, np.int64), np.zeros(n, bool), self.ids == q_id
        distance = np.full(n, np.inf)
        wanted = min(k, int((~own).sum()))
        # All windows of all radii, up to one that holds every array whole.
        reach = float(np.abs(self.sorted[:, [0, -1]] - centre[:, None]).max())
        rounds = max(1, math.ceil(math.log(max(2 * reach / width, start) / start, step)) + 2)
        radii = start * step ** np.arange(rounds)
        half = radii * width / 2
        low = np.array([np.searchsorted(row, c - half) for row, c in zip(self.sorted, centre)])
        high = np.array([np.searchsorted(row, c + half, "right") for row, c in zip(self.sorted, centre)])
        lows, highs = low.tolist(), high.tolist()
        for r, radius in enumerate(radii):
            parts = []
            for j, order in enumerate(self.order):
                if r == 0:
                    parts.append(order[lows[j][0] : highs[j][0]])
                    continue
                if lows[j][r] < lows[j][r - 1]:
                    parts.append(order[lows[j][r] : lows[j][r - 1]])
                if highs[j][r] > highs[j][r - 1]:
                    parts.append(order[highs[j][r - 1] : highs[j][r]])
            if parts:
                counts += np.bincount(np.concatenate(parts), minlength=n)
            new = np.flatnonzero((counts >= least) & ~done & ~own)
            if len(new):
                distance[new] = np.sqrt(((self.x[new] - q) ** 2).sum(axis=1))
                done[new] = True
            if (distance <= radius).sum() >= wanted:
                break
        found = np.flatnonzero(done)
        best = found[np.lexsort((self.ids[found], distance[found]))[:k]]
        return list(zip(distance[best].tolist(), self.ids[best].tolist()))


def directions(dim: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, projections))


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 10, projections: int = 64, width: float = 1.7, miss: float = 0.03, step: float = 1.15, seed: int = 17, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which `is_query` (of vec_id) holds, by Euclidean distance."""
    rows = written(usable(picked(vectors, vec_id=id_col, v=vector_col)), "vectors")
    queries = rows.where(is_query)
    count, asked = rows.count(), queries.count()
    blocks, groups = max(1, math.ceil(count / BLOCK_ROWS)), max(1, math.ceil(asked / QUERY_ROWS))
    hashed = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.withColumn("block", hashed(blocks, "block")).withColumn("part", every(groups))
    sought = queries.withColumn("part", hashed(groups, "part")).withColumn("block", every(blocks))
    least = within(width, projections, miss)

    def search(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(block) and len(wanted):
            dim = int(block["dim"].iloc[0])
            block, wanted = block.sort_values(["vec_id", "x"]), wanted.sort_values(["vec_id", "x"])
            unpack = lambda f: np.frombuffer(b"".join(f["x"]), "<f8").reshape(len(f), dim)
            along = directions(dim, projections, seed)
            here = Block(unpack(block), block["vec_id"].to_numpy(), along)
            q = unpack(wanted)
            # Windows start where about as many vectors as are wanted stand at random.
            spread = float(np.median(np.abs(here.sorted - np.median(here.sorted)))) or 1.0
            start = spread * min(1.0, 4 * k / len(block))
            for q_id, x, centre in zip(wanted["vec_id"].tolist(), q, q @ along):
                out += [(q_id, vec_id, score) for score, vec_id in here.nearest(x, q_id, centre, start, k, width, least, step)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["dim", "block", "part"]
    found = held.groupBy(*keys).cogroup(sought.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
