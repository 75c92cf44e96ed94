"""Nearest neighbours by collision counting over sorted single projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiweight.llm.shared import saved, ship
from lexiweight.llm.vectors import matrix, usable, with_vectors

# Projections, and how many standard deviations the collision threshold lies below the number that
# a vector at the search radius can expect: such a vector is found with a probability of 0.97.
PROJECTIONS, DEVIATIONS = 128, 1.9
# Growth of the radius from one virtual rehashing to the next.
GROWTH = 1.4
# Rows that one index covers, and queries that are put to it at once.
BLOCK, QUERIES = 8192, 256


def collision_threshold(projections: int = PROJECTIONS, deviations: float = DEVIATIONS) -> int:
    """Collisions from which a vector is verified. A window reaches as far as the radius to both
    sides, so a vector at the radius collides with the probability of one standard deviation."""
    p = math.erf(1 / math.sqrt(2))
    return max(1, math.floor(projections * p - deviations * math.sqrt(projections * p * (1 - p))))


class Index:
    """A sorted array of the vectors for each projection."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        self.vectors, self.ids = vectors, ids
        rng = np.random.default_rng(vectors.shape[1])
        self.axes = rng.standard_normal((vectors.shape[1], PROJECTIONS))
        places = (vectors @ self.axes).T
        self.order = np.argsort(places, axis=1, kind="stable")
        self.places = np.take_along_axis(places, self.order, axis=1)
        spread = float(np.median(self.places[:, -1] - self.places[:, 0])) if len(ids) else 0.0
        self.first_radius = max(spread / 32, np.finfo(np.float64).tiny)
        self.threshold = collision_threshold()

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest vectors found, other than ``own``: distances and numbers.

        Windows around the query's projections widen with the radius; collisions are counted for
        what each widening adds. The search ends when ``k`` verified vectors lie within the radius.
        """
        n = len(self.ids)
        centre = query @ self.axes
        low = np.array([np.searchsorted(p, c) for p, c in zip(self.places, centre, strict=True)])
        high = low.copy()
        counts = np.zeros(n, np.uint16)
        seen = self.ids == own
        left = n - int(seen.sum())
        distance, number = np.zeros(0), np.zeros(0, np.int64)
        radius = self.first_radius
        while left:
            for j in range(PROJECTIONS):
                places, order = self.places[j], self.order[j]
                a = places.searchsorted(centre[j] - radius, "left")
                b = places.searchsorted(centre[j] + radius, "right")
                # Rounding must not make a window shrink.
                a, b = min(a, low[j]), max(b, high[j])
                if a < low[j]:
                    counts[order[a : low[j]]] += 1
                if b > high[j]:
                    counts[order[high[j] : b]] += 1
                low[j], high[j] = a, b
            new = np.flatnonzero((counts >= self.threshold) & ~seen)
            if len(new):
                seen[new] = True
                left -= len(new)
                away = self.vectors[new] - query
                distance = np.append(distance, np.sqrt(np.einsum("ij,ij->i", away, away)))
                number = np.append(number, new)
                if len(number) > k:
                    best = np.lexsort((self.ids[number], distance))[:k]
                    distance, number = distance[best], number[best]
            if len(number) >= k:
                worst = distance.max()
                if worst <= radius:
                    break
                radius = min(radius * GROWTH, worst)
            else:
                radius *= GROWTH
        return distance, number


def _search(k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        asked = table.column("asked").to_numpy(zero_copy_only=False)
        ids = table.column("vec_id").to_numpy()
        x = matrix(table.column("vector"))
        out: list[tuple] = []
        if asked.any() and not asked.all():
            index = Index(x[~asked], ids[~asked])
            for query, own in zip(x[asked], ids[asked], strict=True):
                distance, number = index.search(query, own, k)
                out.append((np.full(len(number), own), index.ids[number], distance))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def nearest(table: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest other vectors of every query vector.

    ``table`` has ``vec_id`` and ``embedding``; ``queries`` is a condition on ``vec_id``.
    Nearness is the Euclidean distance in double precision; ties go to the smaller id, and ranks
    start at 1.

    Every vector is indexed: the vectors are dealt out to blocks, and each block keeps a sorted
    array for every projection. All queries are put to all blocks. Within a block, windows around
    the query widen until ``k`` verified vectors lie within the radius; a vector is verified by its
    exact distance once it collides in enough projections. A neighbour is missed only if it stays
    below that threshold at the final radius. A query with fewer than ``k`` candidates gets all.

    Rows with one id count once, with the smallest vector. Rows without id or a usable vector
    (null, zero, or with a null or non-finite component) take no part, nor do vectors of another
    length than the query's. Other columns are ignored.
    """
    spark = table.sparkSession
    ship(spark)
    rows = with_vectors(table)
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = saved(rows.withColumn("width", F.size("vector")), "vectors")
    asked = rows.filter(queries)
    n, n_asked = rows.count(), asked.count()
    blocks, portions = max(1, -(-n // BLOCK)), max(1, -(-n_asked // QUERIES))
    place = F.xxhash64("vec_id", F.lit(3))
    held = rows.select(
        "*",
        F.lit(False).alias("asked"),
        F.pmod(place, F.lit(blocks)).alias("block"),
        F.explode(_numbers(portions)).alias("portion"),
    )
    put = asked.select(
        "*",
        F.lit(True).alias("asked"),
        F.explode(_numbers(blocks)).alias("block"),
        F.pmod(place, F.lit(portions)).alias("portion"),
    )
    found = held.unionByName(put).groupBy("width", "block", "portion")
    found = found.applyInArrow(_search(k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours ``(query_id, vec_id)`` that were found."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi")
    return both.count() / max(1, exact.count())
