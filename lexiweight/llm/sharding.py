"""Sharding by extendible hashing: only buckets that are too large split on another bit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweight.llm.shared import saved

# Bytes of a shard at most, and hash bits that one pass over the documents looks at.
SHARD_BYTES = 64 << 20
STEP = 12
# Bits of a key: 15 hexadecimal digits for each of the two hashes.
HASH_BITS = 60


def key_hash(*parts: Column) -> Column:
    """60 bits of a hash of the parts' text."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(HASH_BITS // 4)), 16, 10).cast("bigint")


def _prefix(value: Column, bits: Column | int) -> Column:
    """The leading bits of a hash."""
    shift = F.lit(HASH_BITS) - (F.lit(bits) if isinstance(bits, int) else bits)
    return F.call_function("shiftright", value, shift.cast("int"))


def _leaves(rows: DataFrame, depth: int, limit: int) -> DataFrame:
    """``(stem, prefix, depth, bytes, fits)``: the buckets after up to ``STEP`` more bits.

    ``rows`` are documents of buckets that are too large at ``depth``. Bytes are added up for the
    longest prefix only, before the shuffle; shorter prefixes add up those sums.
    """
    last = min(depth + STEP, HASH_BITS)
    sums = [F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")]
    finest = rows.withColumn("rows", F.lit(1)).groupBy("stem", _prefix(F.col("hash"), last).alias("finest")).agg(*sums)
    levels = finest.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(last))))
    up = (F.lit(last) - F.col("depth")).cast("int")
    sizes = levels.groupBy("stem", "depth", F.call_function("shiftright", "finest", up).alias("prefix")).agg(*sums)
    # A bucket exists if the one above it, of which it is a half, was too large.
    single = F.col("rows") == 1
    above = sizes.filter((F.col("bytes") > limit) & ~single).select(
        "stem", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above")
    )
    top = sizes.filter(F.col("depth") == depth)
    half = sizes.withColumn("above", F.call_function("shiftright", "prefix", F.lit(1)))
    buckets = top.unionByName(half.join(above, ["stem", "depth", "above"]).drop("above"))
    buckets = buckets.withColumn("fits", (F.col("bytes") <= limit) | single)
    return buckets.filter(F.col("fits") | (F.col("depth") == last)).drop("rows")


def _bits(prefix: Column, depth: Column) -> Column:
    return F.when(depth > 0, F.lpad(F.bin(prefix), depth, F.lit("0"))).otherwise(F.lit(""))


def _locate(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Each row with its bucket: that of its prefixes, of the lengths that buckets have, which is a bucket.

    The directory of the method has an entry for every longest prefix, far more than there are buckets if
    some of them are deep. It is not spelled out here: what rows are joined with is a row for each bucket.
    """
    buckets = leaves.select(
        "stem", F.col("depth").alias("own_depth"), F.col("prefix").alias("own_prefix"), F.col("bytes").alias("shard_bytes"), "fits"
    )
    lengths = leaves.agg(F.sort_array(F.collect_set("depth"))).scalar()
    tried = rows.withColumn("own_depth", F.explode(lengths))
    tried = tried.withColumn("own_prefix", _prefix(F.col("hash"), F.col("own_depth")))
    joined = tried.join(buckets, ["stem", "own_depth", "own_prefix"])
    return joined.select(
        *rows.columns,
        "fits",
        F.concat("stem", _bits(F.col("own_prefix"), F.col("own_depth"))).alias("shard"),
        (F.length("stem") + F.col("own_depth")).alias("depth"),
        "shard_bytes",
    )


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, carry: list[str] | None = None) -> DataFrame:
    """``(doc_id, bytes, shard, depth, shard_bytes, row)``: the shard of every document.

    The directory is indexed by the leading bits of a hash of ``doc_id`` and text; ``shard`` is
    the bits of its bucket. A bucket of more than ``limit`` bytes of UTF-8 text is split on the next
    bit, others are left alone. ``row`` is a struct of the columns named in ``carry``.

    The sizes of all prefixes of the next ``STEP`` bits take one pass; only documents of buckets
    that are still too large then are looked at again. Rows that repeat both id and text share
    all bits: if a bucket of nothing but them is too large, further bits come from their place in
    the table, which is written down first. A single document above the limit is a shard of its
    own. A null text has no bytes; a null ``doc_id`` is hashed like an empty one. An empty table
    has no shards.
    """
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("nothing"))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"),
        key_hash(F.col("doc_id"), F.col("text")).alias("hash"),
        carried.alias("row"),
        F.lit("").alias("stem"),
    )
    parts, depth = [], 0
    while True:
        leaves = saved(_leaves(rows, depth, limit), "directory")
        found = _locate(rows, leaves)
        parts.append(found.filter("fits").drop("hash", "stem", "fits"))
        if leaves.filter("not fits").isEmpty():
            return reduce(DataFrame.unionByName, parts).select("doc_id", "bytes", "shard", "depth", "shard_bytes", "row")
        rows = found.filter("not fits").select(*rows.columns)
        depth = min(depth + STEP, HASH_BITS)
        if depth == HASH_BITS:
            stem = F.concat("stem", _bits(F.col("hash"), F.lit(HASH_BITS)))
            place = key_hash(F.lit("place"), F.monotonically_increasing_id())
            rows = saved(rows.withColumns({"stem": stem, "hash": place}), "repeated")
            depth = 0


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Write every shard below ``path`` as a folder ``shard=<bits>`` of Parquet; the one bucket of
    depth 0 is named ``all``."""
    shards = assign_shards(docs, limit, docs.columns)
    name = F.when(F.col("shard") == "", F.lit("all")).otherwise(F.col("shard")).alias("shard")
    columns = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "shard"]
    shards.select(*columns, name).repartition("shard").write.partitionBy("shard").parquet(path)
