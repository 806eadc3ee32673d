"""Nearest neighbours by cosine with collision-counting hashing.

Each of ``m`` random projections keeps its vectors' values in one sorted array. A query looks at a window around its own
projection in each array and counts, for each vector, the windows that hold it (collisions). A vector at distance r collides
with a chance that depends on window / r alone, so for each radius r there is a number of collisions that it reaches with
probability ``1 - MISS``; these thresholds come from simulated directions of the same dimension. Vectors over the threshold are verified by their exact
cosine, for growing radii: by lower thresholds while the windows are wide enough for the radius, then by wider windows, of which only
the added ends are counted (virtual rehashing). A query ends when k verified vectors lie within the radius: each of its k nearest then
had that chance of being verified. Projections come in orthogonal sets, which makes collisions vary less.

The first windows suit the distances of the k nearest of ``SAMPLE`` vectors of the block; any other start would give right results, too,
only slower. Nothing is verified but what collides, in blocks of any size; what share that is depends on how much nearer the k nearest are
than others.

Plan. Equal vectors are grouped first; as they have equal scores, only the k + 1 smallest ids of each can be a result, so a vector that a third
of the rows hold is no hot spot. Vectors are dealt to blocks of bounded memory; a task gets a block's vectors and then the queries, builds the index
once and streams the queries past it. Where there are fewer blocks than cores, the queries of a block are dealt to several tasks. The k best of
every block are merged per query. All rows are indexed and searched. As the queries are a share of the table, the work is its square.

Cases. Vectors that are null, empty, zero, of another length than most or hold null or non-finite components take no part,
neither as queries nor as candidates. Fewer than k candidates: all are returned. Ties: smaller id first; equal
vectors have exactly equal scores. Rows that share an id count as one candidate, with its best score, and
never as a neighbour of that id; as a query, the smallest of their vectors stands for them. A null id takes no part. Extra columns are ignored.
Ids are cast to long; one that can't be is null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import whole_id

#: Projections; half a window for radius 1; the chance to miss a vector within the radius; bytes of a block and its index.
M, HALF, MISS, BLOCK_BYTES = 192, 1.6, 0.05, 128 << 20
#: Radii of one width of windows, as shares of the largest; how much wider the next windows are; vectors that the first width is taken from.
RADII, WIDER, SAMPLE = 0.96 ** np.arange(22, -1, -1), 1.5, 32


@lru_cache(maxsize=4)
def projections(m: int, d: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``m`` lines in sets of d orthogonal ones of length sqrt(d), and the collisions that vectors within each of ``RADII`` reach."""
    rng = np.random.default_rng(seed)
    sets = [np.linalg.qr(rng.standard_normal((d, d)))[0] * np.sqrt(d) for _ in range(-(-m // d))]
    lines = np.concatenate(sets)[:m]
    toward = rng.standard_normal((2000, d))
    seen = np.abs(toward @ lines.T) / np.sqrt((toward * toward).sum(axis=1, keepdims=True))
    reached = np.array([np.quantile((seen <= HALF / r).sum(axis=1), MISS, method="lower") for r in RADII])
    return lines, np.maximum(1, reached)


class CollisionIndex:
    """Sorted projections of unit vectors, and searches in them. ``verified`` counts what searches have verified."""

    def __init__(self, unit: np.ndarray, k: int = 5, m: int = M):
        self.unit, self.k, self.m, n = unit, k, m, len(unit)
        self.lines, self.reached = projections(m, unit.shape[1])
        values = self.lines @ unit.T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.order, axis=1)
        at = np.unique(np.linspace(0, n - 1, SAMPLE).astype(int))
        near = np.sort(self._away(unit[at] @ unit.T), axis=1)[:, : k + 1]
        self.start = max(1e-3, 1.1 * float(np.quantile(near[:, -1], 0.9)))
        self.verified = 0

    @staticmethod
    def _away(cosine: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * cosine))

    def _window(self, center: np.ndarray, reach: float) -> tuple[list[int], list[int]]:
        low, high = center - reach, center + reach
        return [int(v.searchsorted(x, "left")) for v, x in zip(self.values, low, strict=True)], [int(v.searchsorted(x, "right")) for v, x in zip(self.values, high, strict=True)]

    def _counted(self, *ranges: tuple[list[int], list[int]]) -> np.ndarray:
        """How often each vector lies in the given range of each sorted array."""
        parts = [o[x:y] for lo, hi in ranges for o, x, y in zip(self.order, lo, hi, strict=True) if y > x]
        return np.bincount(np.concatenate(parts), minlength=len(self.unit)) if parts else np.zeros(len(self.unit), np.int64)

    def search(self, query: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Positions verified for a unit query, those marked in ``skip`` left out, until k lie within the radius."""
        n, first, last = len(self.unit), [0] * self.m, [len(self.unit)] * self.m
        wanted = min(self.k, n - int(skip.sum()))
        if not wanted:
            return np.empty(0, np.int64)
        center, radius = self.lines @ query, self.start
        lo, hi = self._window(center, HALF * radius)
        if 2 * (sum(hi) - sum(lo)) <= n * self.m:
            counts = self._counted((lo, hi))
        else:
            counts = self.m - self._counted((first, lo), (hi, last))
        closed, found, away = skip.copy(), [], np.empty(0)
        while True:
            likely = np.flatnonzero((counts >= self.reached[-1]) & ~closed)
            likely = likely[np.argsort(-counts[likely], kind="stable")]
            ends = np.searchsorted(-counts[likely], -self.reached, "right")
            begin = 0
            for r, end in zip(radius * RADII, ends, strict=True):
                if end > begin:
                    fresh = likely[begin:end]
                    found.append(fresh)
                    closed[fresh] = True
                    away = np.sort(np.concatenate([away, self._away(self.unit[fresh] @ query)]))[:wanted]
                    begin = end
                if len(away) == wanted and away[-1] <= r:
                    break
            else:
                if radius <= 2:
                    radius *= WIDER
                    new_lo, new_hi = self._window(center, HALF * radius)
                    counts += self._counted((new_lo, lo), (hi, new_hi))
                    lo, hi = new_lo, new_hi
                    continue
                found.append(np.flatnonzero(~closed))  # no distance exceeds 2
            out = np.concatenate(found)
            self.verified += len(out)
            return out


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, row by row, so that equal rows give equal values."""
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


class Block:
    """The vectors of a block with their ids and their index."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.index = CollisionIndex(vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), k)

    def best(self, query_id: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates of a query, best first."""
        at = self.index.search(query / np.sqrt((query * query).sum()), self.ids == query_id)
        score = cosines(self.vectors[at], query)
        at = at[order := np.lexsort((self.ids[at], -score))]
        _, first = np.unique(self.ids[at], return_index=True)
        first.sort()
        return self.ids[at][first[: self.k]], score[order][first[: self.k]]


FOUND = "query_id long, vec_id long, score double"


def _search(batches: Iterator[pa.RecordBatch], k: int, d: int) -> Iterator[pa.RecordBatch]:
    """The best of a block for each query, from batches of (is_query, id, v): first the vectors, then the queries."""
    ids, vectors, block = [], [], None
    for batch in batches:
        is_query = batch.column(0).to_numpy(zero_copy_only=False)
        own_ids, own = batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().reshape(-1, d)
        if not is_query.all():
            ids.append(own_ids[~is_query].copy())
            vectors.append(own[~is_query].copy())
        if is_query.any() and ids:
            if block is None:
                block = Block(np.concatenate(ids), np.concatenate(vectors), k)
                vectors.clear()
            asked = own_ids[is_query]
            near = [block.best(int(q), v) for q, v in zip(asked, own[is_query], strict=True)]
            sizes = [len(x) for x, _ in near]
            yield pa.RecordBatch.from_arrays([np.repeat(asked, sizes), np.concatenate([x for x, _ in near]), np.concatenate([s for _, s in near])], names=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part: finite, not zero, of the most common length; that length."""
    v = F.col(f"`{vector_col}`")
    slim = vectors.select(whole_id(vectors, id_col).alias("id"), v.cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    sound = slim.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    length = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = length["d"] if length else 0
    return sound.where(F.size("v") == d), d


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, block_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    own, d = usable(vectors, id_col, vector_col)
    is_query = F.col("id") % every == 0
    total, queries = own.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    blocks = max(1, -(-total // (block_rows or max(1, BLOCK_BYTES // (16 * (d + M))))))
    shares = max(1, min(queries, -(-spark.sparkContext.defaultParallelism // blocks)))

    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    several = own.distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) * shares
    held = several.select(F.lit(False).alias("is_query"), "id", "v", F.explode(F.sequence(block, block + shares - 1)).alias("task"))
    single = own.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    asked = single.select(F.lit(True).alias("is_query"), "id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    asked = asked.select("is_query", "id", "v", (F.col("b") * shares + F.pmod(F.xxhash64("id"), F.lit(shares))).alias("task"))

    ship(spark)
    dealt = held.union(asked).repartitionById(blocks * shares, F.col("task").cast("int")).sortWithinPartitions("is_query")
    found = dealt.select("is_query", "id", "v").mapInArrow(lambda batches: _search(batches, k, d), FOUND)
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
