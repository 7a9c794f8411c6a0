"""Lookups and top-k per key that hold when one key has most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salt_count(df: DataFrame) -> int:
    """How many ways to spread one key: a quarter of the shuffle width, 4 at least."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4, width // 4)


def _salt(spread_by: Column, salts: int) -> Column:
    # Never null, so that an inner join infers no extra filter on the hash.
    return F.coalesce(F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"), F.lit(0))


def lookup_join(
    fact: DataFrame,
    other: DataFrame,
    keys: list[str],
    how: str = "left",
    spread_nulls: Column | None = None,
) -> DataFrame:
    """Join a fact table with hot keys to a table with few rows per key.

    A plain join: Spark broadcasts ``other`` by its true size, and otherwise
    the adaptive skew join splits the shuffle partitions that a hot key fills
    (nothing is repeated but the few rows that such a split meets, and there is
    no ceiling on the number of splits). Rows with a null key meet nothing; in
    a left join they are spread by ``spread_nulls``, a unique id, so that they
    do not all wait in one task.
    """
    if how != "left" or spread_nulls is None:
        return fact.join(other, keys, how)
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    # An odd number where a key is null; the other side has 0, so such rows find no partner.
    spread = fact.withColumn("_none", F.when(no_key, F.xxhash64(spread_nulls).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("bigint")))
    filled = [F.coalesce(F.col(k), F.lit(0).cast(fact.schema[k].dataType)).alias(f"_k_{k}") for k in keys]
    left = spread.select("*", *filled)
    right = other.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(0).cast("bigint").alias("_none"), *[c for c in other.columns if c not in keys]
    )
    joined = left.join(right, [*[f"_k_{k}" for k in keys], "_none"], "left")
    return joined.drop("_none", *[f"_k_{k}" for k in keys])


def top_per_key(
    df: DataFrame,
    key: str,
    order: list[Column],
    n: int,
    rank: str,
    spread_by: Column,
    salts: int | None = None,
) -> DataFrame:
    """The first ``n`` rows of every key with their position in ``rank``.

    Spark cuts each input partition to ``n`` rows per group before it shuffles
    (window group limit). With very many input partitions that is still a lot
    for one hot key, so the key is first cut per salt and then as a whole: the
    last step gets at most n x salts rows of a key.
    """
    parts = salts or salt_count(df)
    spread = df.withColumn("_salt", _salt(spread_by, parts))
    within = Window.partitionBy(key, "_salt").orderBy(*order)
    cut = spread.withColumn(rank, F.row_number().over(within)).where(F.col(rank) <= n)
    whole = Window.partitionBy(key).orderBy(*order)
    return (
        cut.drop("_salt").withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n)
    )
