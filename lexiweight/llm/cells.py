"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweight.llm.graph import components
from lexiweight.llm.shared import saved, ship
from lexiweight.llm.vectors import matrix, unit, usable, with_vectors

# Cosine from which two vectors are linked.
COSINE = 0.95
# Cells at most (they are broadcast), vectors of the sample for each cell, rounds of k-means.
MAX_CELLS, SAMPLE_PER_CELL, ROUNDS = 4096, 24, 8
# What rounding may add to the distance of a vector from a border.
MARGIN = 1e-7
# Vectors of a block of products: smaller cells are grouped, larger groups are split.
BLOCK = 2048


def fit_cells(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of length 1: each the direction of the sum of the unit vectors nearest to it."""
    rng = np.random.default_rng(0)
    centres = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.sqrt((sums**2).sum(axis=1))
        full = length > 0
        centres[full] = sums[full] / length[full, None]
    return centres


def group_cells(centres: np.ndarray, groups: int) -> np.ndarray:
    """The group of each cell: cells of similar direction are one group."""
    if groups >= len(centres):
        return np.arange(len(centres))
    return np.argmax(centres @ fit_cells(centres, groups).T, axis=1)


def _assign(model, cosine: float):
    """Each vector in its own group of cells, and as a guest in the later groups that may hold its
    links: those with a cell to whose border it is close enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, group = model.value
        # The border of two cells is a plane through the origin. A vector of length 1 at a distance
        # of s from it has an angle of arcsin(s) or more with all vectors beyond it.
        reach = np.sqrt(max(1 - max(cosine, 0) ** 2, 0))
        apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
        order = np.argsort(group, kind="stable")
        groups, edges = np.unique(group[order], return_index=True)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                near = unit(matrix(part.column("vector"))) @ centres.T
                own = np.argmax(near, axis=1)
                gap = near[np.arange(len(own)), own][:, None] - near
                inside = np.logical_or.reduceat((gap <= reach * apart[own] + MARGIN)[:, order], edges, axis=1)
                inside &= groups >= group[own][:, None]
                row, place = np.nonzero(inside)
                cell = groups[place]
                for i in range(0, len(row), BLOCK):
                    rows, cells = row[i : i + BLOCK], cell[i : i + BLOCK]
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            taken.column("rep"),
                            taken.column("copies"),
                            taken.column("vector"),
                            pa.array(cells.astype(np.int32)),
                            pa.array(cells != group[own[rows]]),
                        ],
                        names=["rep", "copies", "vector", "cell", "guest"],
                    )

    return run


def _compare(cosine: float):
    """Links within one block, or between two blocks, of a cell: for each vector with any, the
    number of vectors it is linked to here and the smallest one it is connected to here."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        guest = table.column("guest").to_numpy(zero_copy_only=False)
        block = table.column("block").to_numpy()
        x = unit(matrix(table.column("vector")))
        a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
        links, pairs = np.zeros(len(rep), np.int64), []
        for i in range(0, len(a), 512):
            rows = a[i : i + 512]
            linked = x[rows] @ x[b].T >= cosine
            linked &= ~(guest[rows][:, None] & guest[b])
            if first == second:
                linked &= rows[:, None] != b
            links[rows] += linked @ copies[b]
            if first != second:
                links[b] += copies[rows] @ linked
            hit = np.flatnonzero(linked.any(axis=1))
            pairs.append((rows[hit], linked[hit]))
        least = rep.copy()
        changed = any(len(rows) for rows, _ in pairs)
        while changed:
            before = least.copy()
            for rows, linked in pairs:
                if len(rows):
                    low = np.where(linked, least[b], np.iinfo(np.int64).max)
                    least[rows] = np.minimum(least[rows], low.min(axis=1))
                    back = np.where(linked, least[rows][:, None], np.iinfo(np.int64).max).min(axis=0)
                    least[b] = np.minimum(least[b], back)
            changed = bool((least != before).any())
        some = links > 0
        return pa.table({"rep": rep[some], "links": links[some], "least": least[some]})

    return run


def near_vectors(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: a row for each row of ``table (vec_id, embedding)``.

    Two vectors are linked if their cosine, in double precision, is ``cosine`` or more.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id that
    links reach, and the row of that id is kept.

    Spherical k-means over a bounded sample (``SAMPLE_PER_CELL`` vectors a cell, about half as
    many cells as the root of the number of vectors, ``MAX_CELLS`` at most) divides the vectors
    into cells, and similar cells are grouped up to about ``BLOCK`` vectors. All vectors of a group
    are compared with each other and with its guests: the vectors of earlier groups that are so
    close to the border of one of its cells that a link may cross it. No link can cross from
    farther away, so all pairs are found. Vectors without clusters are guests nearly everywhere,
    which comes to comparing all with all. Equal vectors are one from the start, large groups are
    split into pairs of blocks, and a block hands on one row for each vector, so groups of any size
    are counted without listing their pairs.

    Rows without ``vec_id`` or a usable vector (null, zero, or with a null or non-finite component)
    are linked with nothing and kept, with their own id as component. Vectors of different length
    are never linked. Repeated rows are vectors of their own. Other columns are ignored.
    """
    spark = table.sparkSession
    ship(spark)
    rows = with_vectors(table)
    good = F.col("vec_id").isNotNull() & usable(F.col("vector"))
    distinct = rows.filter(good).groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    distinct = saved(distinct, "vectors")
    # Vectors of the most frequent length; the others, if any, get a cell for each length.
    widths = distinct.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    widest = widths.orderBy(F.desc("n"), "width").first()
    parts = []
    if widest is not None:
        main = distinct.filter(F.size("vector") == widest.width)
        k = max(1, min(MAX_CELLS, int(np.sqrt(widest.n) / 2)))
        sample = main.orderBy(F.xxhash64("rep"), "rep").limit(k * SAMPLE_PER_CELL).select("vector").toArrow()
        centres = fit_cells(unit(matrix(sample.column("vector"))), k)
        model = spark.sparkContext.broadcast((centres, group_cells(centres, -(-widest.n // BLOCK))))
        schema = "rep bigint, copies bigint, vector array<double>, cell int, guest boolean"
        parts.append(main.mapInArrow(_assign(model, cosine), schema))
        others = distinct.filter(F.size("vector") != widest.width)
        parts.append(others.select("rep", "copies", "vector", (-F.size("vector")).alias("cell"), F.lit(False).alias("guest")))
        placed = saved(parts[0].unionByName(parts[1]), "cells")
        size = lambda which: F.ceil(F.count_if(which) / BLOCK).cast("int")
        sizes = placed.groupBy("cell").agg(size(~F.col("guest")).alias("own"), size(F.col("guest")).alias("guests"))
        # One row for each group: MAX_CELLS at most, and the other lengths that vectors have.
        placed = placed.join(F.broadcast(sizes.filter("own > 0")), "cell")
        # The blocks of guests follow a group's own; guests are not compared with each other.
        place = F.xxhash64("rep")
        block = F.when(F.col("guest"), F.col("own") + F.pmod(place, "guests")).otherwise(F.pmod(place, "own"))
        last = F.when(F.col("guest"), F.col("own")).otherwise(F.col("own") + F.col("guests")) - 1
        placed = placed.withColumn("block", block.cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), last)))
        pairs = placed.select(
            "rep", "copies", "vector", "guest", "block", "cell",
            F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second"),
        )
        found = pairs.groupBy("cell", "first", "second").applyInArrow(_compare(cosine), "rep bigint, links bigint, least bigint")
        found = saved(found, "links")
        counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
        roots = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
        linked = distinct.join(counts, "rep", "left").join(roots.toDF("rep", "root"), "rep", "left")
        linked = linked.select(
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("root", "rep").alias("root"),
        )
    else:
        linked = distinct.select("vector", F.lit(0).cast("bigint").alias("links"), F.col("rep").alias("root"))
    known = rows.filter(good).join(linked, "vector").select("vec_id", F.col("links").alias("n_links"), F.col("root").alias("component_id"))
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = known.unionByName(alone)
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
