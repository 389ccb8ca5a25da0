"""Row positions and sliding frames that never need a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "pos") -> DataFrame:
    """Zero-based position of every row within its key.

    ``bucket`` must not decrease along ``order``. Rows are sorted per
    (key, bucket) only; a small table of bucket counts gives each bucket its
    offset, so a key that holds a large share of all rows is still spread out.
    """
    spread = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        spread.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        spread.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("long"))
        .drop("_offset", "_local", "_bucket")
    )


def with_halo(df: DataFrame, pos: str, size: int, halo: int) -> DataFrame:
    """Cut each series into chunks of ``size`` positions, repeating border rows.

    Adds ``chunk`` and ``owned``. A frame of at most ``halo`` rows to either
    side, computed per (key, chunk), is exact on the owned rows.
    """
    p = F.col(pos)
    own = F.floor(p / size)
    chunks = F.array_distinct(F.array(F.floor((p - halo) / size), own, F.floor((p + halo) / size)))
    return (
        df.withColumn("chunk", F.explode(F.filter(chunks, lambda c: c >= 0)))
        .withColumn("owned", F.col("chunk") == own)
    )


def short_key(text: Column) -> Column:
    """96 bits of a hash in 16 letters, for keys that are moved with every row: random letters do not pack."""
    return F.substring(F.base64(F.unhex(F.sha1(text))), 1, 16)


def by_key(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the requests: it meets the other by shuffle.

    Rows made by ``explode`` and compressed shuffles look small to the
    optimizer, and several such tables at once would fill the driver.
    """
    return df.hint("merge")


def spread_join(many: DataFrame, few: DataFrame, on: list[str], spread_by: str, salts: int = 16) -> DataFrame:
    """Equi join that splits every key of ``many`` over ``salts`` partitions.

    ``few`` is repeated once per salt. Used where one key may hold a large
    share of ``many`` and each of its rows meets several rows of ``few``.
    The optimizer sizes ``few`` as it was before the repeats, so it would send
    many times what it may through the driver: both sides shuffle.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    right = few.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)])))
    return left.join(by_key(right), [*on, "_salt"]).drop("_salt")
