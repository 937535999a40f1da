"""Blocks of a query set against blocks of all rows, and the best rows of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, staged


def finite(vector: str) -> Column:
    """Whether an array column is there and holds neither null nor non-finite components (an empty one holds none)."""
    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def scaled_ints(vector: str) -> Column:
    """floor(256 * x) of each component x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x).cast("int"))


def within(vector: str, bits: int) -> Column:
    """Whether floor(256 * x) of all components lies within plus or minus 2 to the power `bits`."""
    return F.forall(vector, lambda x: F.abs(x) < F.lit(2.0 ** (bits - 8)))


def pieces(queries: DataFrame, members: DataFrame, keys: list[str], query_rows: int, member_rows: int) -> DataFrame:
    """Every block of queries beside every block of members of the same keys, as rows of both (side 0 and 1) sorted by
    keys, pa and pb; a block holds about query_rows or member_rows rows, by a hash of rid. No pairs are made here: a row
    is repeated once for each block of the other side. A column that one side lacks is null there."""
    sizes = [t.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for t, n in ((queries, "na"), (members, "nb"))]
    parts = sizes[0].join(sizes[1], keys).select(*keys, F.ceil(F.col("na") / query_rows).alias("parts_a"), F.ceil(F.col("nb") / member_rows).alias("parts_b"))
    parts = small(staged(parts, "parts"))

    def side(rows: DataFrame, role: int, own: str, other: str) -> DataFrame:
        dealt = rows.join(parts, keys).withColumn(f"p{own}", F.pmod(F.xxhash64("rid"), F.col(f"parts_{own}")))
        dealt = dealt.withColumn(f"p{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"parts_{other}") - 1)))
        return dealt.drop("parts_a", "parts_b").withColumn("side", F.lit(role))

    both = side(queries, 0, "a", "b").unionByName(side(members, 1, "b", "a"), allowMissingColumns=True)
    return both.repartition(*keys, "pa", "pb").sortWithinPartitions(*keys, "pa", "pb", "side")


def best(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in the order given, numbered from 1. Ranks above k are cut before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
