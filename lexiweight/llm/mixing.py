"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A mean above this is drawn as the sum of several Poisson numbers: e^-mean must not vanish.
MAX_MEAN = 256.0


def source_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights that add up to 1; negative, infinite and missing ones are refused."""
    if any(not math.isfinite(w) or w < 0 for w in weights.values()) or not sum(weights.values()) > 0:
        raise ValueError("weights must be finite, not negative, and not all zero")
    total = sum(weights.values())
    return {s: w / total for s, w in weights.items()}


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only: 52 bits of a hash of their text."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(13)), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _distribution(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), .. of a Poisson number, as far as a double tells them from 1."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(
        F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), F.array(F.exp(-mean)).alias("all")
    )

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), (state["below"] + p).alias("below"), F.concat(state["all"], F.array(state["below"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add)["all"]


def repetition_rates(docs: DataFrame, weights: dict[str, float], epochs: float = 1.0, refill: bool = False) -> DataFrame:
    """``(source, bytes, rate, parts, distribution)``: mean number of copies for each source.

    The bytes of a source's copies are expected to be its weight of ``epochs`` times the bytes of
    ``docs``. Sources that have no weight are one group with the key null; its weight is that of the
    key ``""``, and 0 if there is none. The share of a weight whose group has no bytes is left out of
    the output, or with ``refill`` goes to the other groups in proportion to theirs, so that all
    copies together have ``epochs`` times the bytes of ``docs``. The table has a row for each weight
    at most, whatever the data; frequent sources are summed up before the shuffle.
    """
    shares = source_weights(weights)
    listed = [s for s in shares if s != ""]
    rows = docs.select(_listed(listed).alias("source"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    sizes = rows.groupBy("source").agg(F.sum("bytes").alias("bytes"))
    total = rows.agg(F.sum("bytes")).scalar()
    share = F.coalesce(*(F.when(F.col("source") == s, F.lit(shares[s])) for s in listed), F.lit(shares.get("", 0.0)))
    if refill:
        # Sorted, as a sum of doubles depends on the order.
        present = sizes.agg(F.array_sort(F.collect_list(F.when(F.col("bytes") > 0, share))).alias("shares"))
        filled = present.select(F.aggregate("shares", F.lit(0.0), lambda a, b: a + b)).scalar()
        share = F.when(share > 0, share / filled).otherwise(F.lit(0.0))
    rate = F.when(F.col("bytes") > 0, F.lit(float(epochs)) * total * share / F.col("bytes")).otherwise(F.lit(float(epochs)))
    rates = sizes.withColumn("rate", rate)
    rates = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / MAX_MEAN), F.lit(1)).cast("int"))
    return rates.withColumn("distribution", _distribution(F.col("rate") / F.col("parts")))


def _listed(listed: list[str]) -> Column:
    return F.when(F.col("source").cast("string").isin(listed), F.col("source").cast("string"))


def mix(docs: DataFrame, weights: dict[str, float], epochs: float = 1.0, seed: int = 0, refill: bool = False) -> DataFrame:
    """``docs`` as often as the target weights of their sources ask for, in random order.

    Each document is copied a Poisson number of times; the mean is the target rate of its source
    (see ``repetition_rates``), and the number is the inverse of the distribution at a uniform
    hash of seed and ``doc_id``. All columns stay and ``copy`` (from 1) is added, replacing a
    column of that name. The copies are dealt out to partitions by a hash and sorted by another.

    Repeated rows get equal numbers, as do all rows without ``doc_id``. Null, unlisted and empty
    source names form the group of the weight ``""``. Null texts count no bytes; a source without
    any bytes gets ``epochs`` copies on average. An empty table stays empty. Weights without any
    bytes lower the output, unless ``refill`` gives their share to the others.
    """
    listed = [s for s in source_weights(weights) if s != ""]
    rates = repetition_rates(docs, weights, epochs, refill).select(
        F.coalesce("source", F.lit("")).alias("key"), F.struct("parts", "distribution").alias("target")
    )
    # One row for each given weight and one for the rest, so this is safe to broadcast.
    row = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(_listed(listed), F.lit("")).alias("key"))
    row = row.join(F.broadcast(rates), "key")
    name = F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))

    def draw(total: Column, part: Column) -> Column:
        u = uniform(F.lit(seed), name, part)
        return total + F.size(F.filter(F.col("target.distribution"), lambda below: below <= u))

    count = F.aggregate(F.sequence(F.lit(1), F.col("target.parts")), F.lit(0), draw)
    copies = row.withColumn("copies", count).filter("copies > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    copies = copies.withColumn("place", F.xxhash64(F.lit(seed), name, "copy", F.xxhash64("row")))
    shuffled = copies.select("row", "copy", "place").repartition(F.col("place")).sortWithinPartitions(F.xxhash64("place"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "copy"]
    return shuffled.select(*kept, "copy")
