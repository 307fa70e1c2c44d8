"""Leakage-free group folds, their report, and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running

#: Groups up to this number are assigned within one array (one row is faster than two range partitions), more in the distributed way.
IN_ARRAY = 5_000


def _fill(load: list[int], size: int, n: int) -> list[int]:
    """How many of ``n`` items of one size each fold gets, if every item goes to the lightest fold, the lowest on ties."""
    below = lambda t: [max(0, -(-(t - x) // size)) for x in load]
    lo, hi = min(load), max(load) + size * (n + 1)
    while lo < hi:
        middle = (lo + hi + 1) // 2
        lo, hi = (middle, hi) if sum(below(middle)) <= n else (lo, middle - 1)
    got = below(lo)
    for f, x in enumerate(load):
        if sum(got) < n and x <= lo and (lo - x) % size == 0:
            got[f] += 1
    return got


def _many_groups(sizes: DataFrame, group: str, k: int) -> DataFrame:
    """The greedy rule for any number of groups.

    Groups of one size fill the folds like water: the j-th item of a fold
    stands at its load plus j sizes, and items go to the places in the order of
    (load, fold). Only the number of groups of each size reaches the driver,
    fewer than the square root of twice the rows; places and groups are counted
    in range partitions and joined by size and place.
    """
    spark = sizes.sparkSession
    load, rows = [0] * k, []
    for r in sizes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():
        for f, n in enumerate(_fill(load, r["size"], r["n"])):
            if n:
                rows.append((r["size"], f, load[f], n))
                load[f] += n * r["size"]
    places = spark.createDataFrame(rows, "size long, fold int, load long, n long")
    places = places.select("size", "fold", F.explode(F.expr("sequence(0L, n - 1)")).alias("j"), "load").select("size", "fold", (F.col("load") + F.col("j") * F.col("size")).alias("load"))
    one = F.lit(1).cast("long")
    placed = running(places, "size", ["load", "fold"], one, "place").select("size", "place", "fold")
    return running(sizes, "size", [group], one, "place", descending=True).join(placed, ["size", "place"]).select(group, "size", "fold")


def group_folds(df: DataFrame, group: str, n_splits: int) -> DataFrame:
    """(group, size, fold): groups by size descending, then key descending, each to the lightest fold, the lowest on ties.

    Rows are counted where they are. Up to IN_ARRAY groups are folded over one
    sorted array; more are placed by size (``_many_groups``), with the same result.
    Raises ValueError for fewer than two groups. Rows with a null group are left out.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("size"))
    n = sizes.count()
    if n < 2:
        raise ValueError("two or more groups are needed")
    k = min(n_splits, n)
    if n > IN_ARRAY:
        return _many_groups(sizes, group, k)
    ordered = sizes.agg(F.sort_array(F.collect_list(F.struct("size", group)), asc=False).alias("groups"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), k).alias("load"), F.array().cast("array<int>").alias("folds"))

    def step(acc, g):
        to = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda x, i: F.when(i == to - 1, x + g["size"]).otherwise(x))
        return F.struct(load.alias("load"), F.concat(acc["folds"], F.array(to - 1)).alias("folds"))

    folded = ordered.select("groups", F.aggregate("groups", start, step)["folds"].alias("folds"))
    both = folded.select(F.explode(F.arrays_zip("groups", "folds")).alias("z"))
    return both.select(F.col(f"z.groups.{group}").alias(group), F.col("z.groups.size").alias("size"), F.col("z.folds").alias("fold"))


def fold_report(df: DataFrame, folds: DataFrame, group: str, family: str) -> DataFrame:
    """(fold, n_train, n_test, train_families, test_families) of every fold."""
    rows = df.join(folds.select(group, "fold"), group)
    by = rows.groupBy("fold", family).agg(F.count("*").alias("n"))
    k = folds.agg(F.max("fold")).first()[0] + 1
    every = F.sequence(F.lit(0), F.lit(k - 1))
    sides = by.select("*", F.explode(every).alias("k"))
    test = F.col("fold") == F.col("k")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col(family)))), ",")
    out = sides.groupBy("k").agg(F.coalesce(F.sum(F.when(~test, F.col("n"))), F.lit(0)).alias("n_train"), F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias("n_test"), names(~test).alias("train_families"), names(test).alias("test_families"))
    return out.where("n_test > 0").withColumnRenamed("k", "fold")


def leaked(df: DataFrame, fold_of: DataFrame, group: str, key: str) -> DataFrame:
    """(n_test, n_leaked): rows of fold 0 whose ``key`` also occurs in another fold."""
    return leaked_by_fold(df, fold_of, group, key).where("fold = 0").select("n_test", "n_leaked")


def leaked_by_fold(df: DataFrame, fold_of: DataFrame, group: str, key: str) -> DataFrame:
    """(fold, n_test, n_leaked) of every fold: its rows, and those whose ``key`` also occurs in another fold."""
    cells = df.join(fold_of.select(group, "fold"), group).groupBy("fold", key).agg(F.count("*").alias("n"))
    spread = cells.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_folds"))
    joined = cells.join(spread, key, "left")
    return joined.groupBy("fold").agg(F.sum("n").alias("n_test"), F.sum(F.when(F.col("_folds") > 1, F.col("n")).otherwise(0)).alias("n_leaked"))


def stride_sample(df: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """Per value of ``by`` every (count div most)-th row in order, ``most`` at most; all rows if there are no more. Rows with a null value are left out."""
    n = df.groupBy(by).agg(F.count("*").alias("_n"))
    ranked = running(df, by, [order], F.lit(1).cast("long"), "_k").join(n, by).withColumn("_k", F.col("_k") - 1)
    step = F.when(F.col("_n") > most, F.floor(F.col("_n") / most)).otherwise(1)
    return ranked.where((F.col("_k") % step == 0) & (F.col("_k") < step * most)).select(*df.columns)


def hashed_sample(df: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) in the order of a seeded hash (MD5 of seed and key), with their place as ``index``."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *key))
    top = df.withColumn("_h", h).orderBy("_h", *key).limit(n)
    return top.withColumn("index", F.row_number().over(Window.orderBy("_h", *key)) - 1).drop("_h")
