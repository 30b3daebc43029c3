"""Ranks within groups of any size: a large group is dealt over shards, whose counts give each shard its first rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The least number of shards of a group, and the rows a shard holds about if one group has all rows.
SHARDS, ROWS = 64, 100_000


def ranked(df: DataFrame, groups: list[str], order: list[Column], shard_by: Column, name: str = "rank", shards: int | None = None, facts: DataFrame | None = None) -> DataFrame:
    """``df`` with a rank from 0 within each group, gapless, the same on every run.

    Ranks follow (shard, ``order``). The number of shards grows with the rows, so that no
    group, however large, makes a task of much more than ROWS rows; a table of offsets
    has a row for each group and shard. ``df`` is read three times and should be cheap to read.
    Group columns must not be null. ``facts``, a row for each group, is joined to the
    counts rather than to ``df``, which is then exchanged only once.
    """
    shards = shards or max(SHARDS, 1 << (df.count() // ROWS).bit_length())
    df = df.withColumn("_shard", F.pmod(shard_by, F.lit(shards)).cast("int"))
    counts = df.groupBy(*groups, "_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*groups, "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    if facts is not None:
        first = first.join(facts, groups, "left")
    own = Window.partitionBy(*groups, "_shard").orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(own))
        .join(first, [*groups, "_shard"])
        .withColumn(name, F.col("_first") + F.col("_row") - 1)
        .drop("_shard", "_row", "_first")
    )
