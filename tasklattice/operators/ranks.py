"""Places within groups of any size: no window holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Parts in which the rows of one key are ranked first.
SALTS = 64


def within_first(df: DataFrame, key: Column, order: list[str], n: int | str, name: str, unique: bool = False) -> DataFrame:
    """The rows with a boolean ``name``: whether a row is among the first ``n`` (a number or a column) of its key.

    The last place that counts is found first, from the key and order columns
    alone, and joined to the rows as a written table with a row per key. For it
    no key is ranked whole: if the order columns tell the rows apart
    (``unique``) and n is a number, every input partition keeps n rows of a key;
    else a key's rows are numbered in parts by a hash of the order columns and
    each part is cut at n. Rows with a null key are never among the first. Of
    rows with equal order columns any may be.
    """
    keyed = df.withColumn("_key", key)
    if unique and isinstance(n, int):
        ranked, place = keyed, F.struct(*[F.col(c) for c in order])
        slim = ranked.where(F.col("_key").isNotNull()).select("_key", place.alias("_place"))
        limit = n
    else:
        parts = Window.partitionBy("_key", F.pmod(F.xxhash64(*order), F.lit(SALTS))).orderBy(*order)
        ranked = keyed.withColumn("_rn", F.row_number().over(parts))
        place = F.struct(*[F.col(c) for c in order], F.col("_rn"))
        limit = F.lit(n) if isinstance(n, int) else F.col("_n")
        within = F.lit(n) if isinstance(n, int) else F.col(n)
        slim = ranked.where(F.col("_key").isNotNull() & (F.col("_rn") <= within)).select("_key", place.alias("_place"), within.alias("_n"))
    again = F.row_number().over(Window.partitionBy("_key").orderBy("_place"))
    last = slim.withColumn("_rank", again).where(F.col("_rank") <= limit).groupBy("_key").agg(F.max("_place").alias("_last"))
    last = Scratch(df.sparkSession, "last").write(last, "last")
    marked = ranked.join(last, "_key", "left").withColumn(name, F.coalesce(place <= F.col("_last"), F.lit(False)))
    return marked.select(*df.columns, name)


def running(df: DataFrame, key: str, order: list[str], weight: Column, name: str, descending: bool = False) -> DataFrame:
    """The rows of non-null keys with the sum ``name`` of the weights of their key up to and with their own, in order.

    Rows are range-partitioned by key and order; the sum has a part within the
    partition and one over the partitions before, from a table with a row per
    key and partition. Order columns should tell the rows of a key apart.
    """
    scratch = Scratch(df.sparkSession, "running")
    turn = (lambda c: F.col(c).desc()) if descending else F.col
    by = [F.col(key), *map(turn, order)]
    ranged = df.where(F.col(key).isNotNull()).withColumn("_w", weight).repartitionByRange(*by)
    ranged = scratch.write(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    within = F.sum("_w").over(Window.partitionBy(key, "_part").orderBy(*map(turn, order)).rowsBetween(Window.unboundedPreceding, 0))
    parts = ranged.groupBy(key, "_part").agg(F.sum("_w").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(key).orderBy("_part")) - F.col("_sum")
    parts = parts.select(key, "_part", before.alias("_before"))
    return ranged.withColumn("_within", within).join(parts, [key, "_part"]).select(*df.columns, (F.col("_within") + F.col("_before")).alias(name))
