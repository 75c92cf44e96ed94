"""Joins of many rows with a table that has one row per key, safe under heavy keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pieces for each shuffle partition into which all rows would be cut if keys could be cut at will.
PIECES_PER_PARTITION = 16
# Shuffle partitions for each salt over which ``spread`` deals out the rows of any key.
PARTITIONS_PER_SALT = 2
# Salts of a key at most where there are many keys.
MOST_SALTS = 16
# Rows of a table at most that ``frequent_lookup`` sends to every task, and bytes of each as text.
MOST_FREQUENT, LONGEST_FREQUENT = 1 << 18, 128


def default_pieces(df: DataFrame) -> int:
    return PIECES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    weights: DataFrame,
    weight: str,
    pieces: int | None = None,
) -> DataFrame:
    """Inner equi-join of ``rows`` with ``table``, which is unique on ``keys``.

    ``weights`` has the keys and a column ``weight`` that bounds the number of rows of each key. A
    key with more than 1 / ``pieces`` of the total weight is heavy: its rows are dealt out over as
    many salts as it has such shares, and its table row is repeated for each of them. All other
    keys have one salt. By default there are a few pieces for each shuffle partition, so no task
    gets much more than its share, whatever the keys.

    The number of salts is looked up by a 64-bit hash of the key in a broadcast table of less than
    ``pieces`` rows of two numbers. Keys that share a hash share their salts, on both sides, which
    costs a little work and changes no result.
    """
    pieces = pieces or default_pieces(rows)
    key_hash = F.xxhash64(*keys).alias("key_hash")
    share = weights.agg(F.sum(weight)).scalar() / F.lit(float(pieces))
    heavy = weights.select(key_hash, F.ceil(F.col(weight) / share).alias("salts")).filter("salts > 1")
    salts = F.broadcast(heavy.groupBy("key_hash").agg(F.max("salts").alias("salts")))
    number = F.coalesce("salts", F.lit(1).cast("bigint"))

    def salted(side: DataFrame, salt: Column) -> DataFrame:
        known = side.withColumn("key_hash", F.xxhash64(*keys)).join(salts, "key_hash", "left")
        return known.select(*side.columns, salt.alias("salt"))

    others = [c for c in rows.columns if c not in keys]
    dealt = salted(rows, F.pmod(F.xxhash64(*others), number))
    repeated = salted(table, F.explode(F.sequence(F.lit(0).cast("bigint"), number - 1)))
    return dealt.join(repeated, [*keys, "salt"]).drop("salt")


def spread(
    rows: DataFrame, keys: list[str], salts: int | None = None, by: list[str] | None = None, most: int = MOST_SALTS
) -> DataFrame:
    """``rows`` with a column ``salt``, shuffled by ``keys`` and ``salt``, a hash of all other columns or of
    those named in ``by``.

    A key of any weight is dealt out over ``salts`` places, by default half as many as there are
    shuffle partitions; so no key needs to be known as heavy. Rows that are equal in all of these columns
    stay together. There are ``most`` salts at most, whatever is asked for and however many partitions there
    are: with a salt for each row of a key, the table of ``key_table`` would be as long as the rows.

    The filter lets every row pass. It makes each reader of this shuffle ask for all its columns, so
    that those that add up keys and those that go on with the rows read one and the same, and the source
    is not read once for each. Spark does not move it below the shuffle, as it holds the place of a row.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = min(salts or max(2, partitions // PARTITIONS_PER_SALT), most)
    others = by or [c for c in rows.columns if c not in keys]
    # The last value tells Spark that there always is a salt: a join would look for rows without one, and
    # no longer read the same shuffle as others do.
    salt = F.coalesce(F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int"), F.lit(0))
    dealt = rows.withColumn("salt", salt).repartition(*keys, "salt")
    return dealt.filter((F.monotonically_increasing_id() >= 0) | (F.xxhash64(*dealt.columns) == 0))


def key_table(dealt: DataFrame, keys: list[str], total: Column, name: str) -> DataFrame:
    """``(*keys, salt, <name>)`` of ``spread`` rows: for each key and each of its salts, the sum of
    ``total`` over all rows of the key.

    The rows are added up where they lie. What is shuffled then is a row for each key and salt that occur
    together: one for a key of one row, as many as there are salts at most.
    """
    places = dealt.groupBy(*keys, "salt").agg(F.sum(total).alias("part"))
    return places.select(*keys, "salt", F.sum("part").over(Window.partitionBy(*keys)).alias(name))


def join_spread(dealt: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join of ``spread`` rows with a table that has a row for each of their keys and salts. The
    rows stay where they are.

    The table is hashed: it has no more rows in a partition than those that it is joined with.
    """
    return dealt.join(table.hint("shuffle_hash"), [*keys, "salt"]).drop("salt")


def spread_join(
    rows: DataFrame, table: DataFrame, keys: list[str], salts: int | None = None, most: int = MOST_SALTS
) -> DataFrame:
    """Inner equi-join of ``rows`` with ``table``, which is unique on ``keys``; safe under heavy keys, and
    without a look at the weight of any."""
    dealt = spread(rows, keys, salts, most=most)
    places = key_table(dealt, keys, F.lit(1), "num_rows").drop("num_rows")
    return join_spread(dealt, places.join(table, keys), keys)


def broadcast_lookup(rows: DataFrame, table: DataFrame, keys: list[str], most_bytes: int = 64 << 20) -> DataFrame:
    """Inner equi-join of ``rows`` with ``table``, which is unique on ``keys``, by sending the whole table
    to every task: for callers who know that it is small.

    Nothing chooses this join by size. A table whose columns hold more than ``most_bytes`` as text
    fails the query, before any of it is sent.
    """
    length = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in table.columns), F.lit(0))
    total = F.coalesce(table.agg(F.sum(length)).scalar(), F.lit(0))
    message = F.concat(F.lit("the table of a broadcast lookup has "), total.cast("string"), F.lit(f" bytes, more than {most_bytes}"))
    small = F.when(total <= most_bytes, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return rows.join(F.broadcast(table.filter(small)), keys)


def frequent_lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner equi-join of ``rows`` with ``table``, which is unique on ``keys``: the rows of the table that
    most rows ask for are sent to every task by ``broadcast_lookup``, the others meet theirs by
    ``spread_join``. So a table of any length can be looked up.

    ``weight`` is the column of ``table`` with the number of rows of a key. A key is frequent with at least
    one in ``MOST_FREQUENT`` of all rows, and if its row is not long; so what is sent stays within the
    bound of ``broadcast_lookup`` whatever the data. A key that is null finds nothing.
    """
    length = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in table.columns), F.lit(0))
    total = table.agg(F.sum(weight)).scalar()
    often = F.coalesce((F.col(weight) * MOST_FREQUENT >= total) & (length <= LONGEST_FREQUENT), F.lit(False))
    frequent = table.filter(often)
    found = broadcast_lookup(rows, frequent, keys)
    rare = rows.join(F.broadcast(frequent.select(*keys)), keys, "left_anti")
    joined = spread_join(rare, table.filter(~often), keys)
    return found.unionByName(joined.select(*found.columns))
