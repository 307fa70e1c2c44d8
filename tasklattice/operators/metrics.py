"""Rates, histograms, agreement, deltas and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running


def rate(c: Column, digits: int = 4) -> Column:
    """Share of rows for which the condition holds; null conditions count as false, no rows as 0."""
    return F.coalesce(F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), digits), F.lit(0.0))


def evaluation(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, pass@1 and the other rates of generations; writes count as unintended among failures only."""
    failed = ~F.coalesce("passed", F.lit(False))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        rate(F.col("passed")).alias("pass_at_1"),
        rate(F.col("forbidden")).alias("forbidden_rate"),
        rate(failed & F.col("wrote")).alias("unintended_write_rate"),
        rate(F.col("syntax_valid")).alias("syntax_valid_rate"),
        rate(F.col("is_one_line")).alias("one_line_rate"),
    )


def macro_mean(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Unweighted mean over a model's folds, with the sum of n and the number of folds."""
    return rows.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean_value"), F.sum("n").alias("n"), F.count("*").alias("folds"))


def base_vs_tuned(rows: DataFrame, model: str, variant: str, value: str, base: str, tuned: str) -> DataFrame:
    """(model, base, tuned, delta) of models that have both variants."""
    pick = lambda v: F.max(F.when(F.col(variant) == v, F.col(value)))
    both = rows.groupBy(model).agg(pick(base).alias("base"), pick(tuned).alias("tuned"))
    return both.where("base is not null and tuned is not null").withColumn("delta", F.round(F.col("tuned") - F.col("base"), 4))


def confusion(rows: DataFrame, by: str, judged: str, actual: str) -> DataFrame:
    """n, agree, false positives and negatives, and agreement per judge."""
    j, a = F.col(judged), F.col(actual)
    return rows.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(j == a).alias("agree"),
        F.count_if(j & ~a).alias("false_positive"),
        F.count_if(~j & a).alias("false_negative"),
        F.round(F.avg(F.when(j == a, 1.0).otherwise(0.0)), 3).alias("agreement"),
    )


def nearest_rank_by(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles per group without gathering a group; the rank p * (n - 1) is rounded half to even.

    Equal values are counted first; running counts over the distinct values,
    kept in range partitions, find the ranks.
    """
    cells = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    upto = running(cells, by, [value], F.col("_c"), "_upto")
    n = cells.groupBy(by).agg(F.sum("_c").alias("_n"))
    at = lambda p: F.bround(F.lit(p) * (F.col("_n") - 1)) + 1
    return upto.join(n, by).groupBy(by).agg(*[F.min(F.when(F.col("_upto") >= at(p), F.col(value))).alias(name) for name, p in shares.items()])


def latency(rows: DataFrame, by: str, seconds: str, tokens: str) -> DataFrame:
    """n, mean, p50, p95, tokens per second (ratio of sums) and mean tokens per group."""
    base = rows.groupBy(by).agg(
        F.count("*").alias("n"),
        F.round(F.avg(seconds), 6).alias("mean_value"),
        F.round(F.sum(tokens) / F.sum(seconds), 6).alias("tokens_per_unit"),
        F.round(F.avg(tokens), 6).alias("mean_tokens"),
    )
    return base.join(nearest_rank_by(rows, by, seconds, {"p50": 0.5, "p95": 0.95}), by, "left")


def evaluation_of_runs(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rates of ``evaluation`` from recorded executions.

    ``rows`` has passed, forbidden, syntax_valid, is_one_line, unchanged (what
    the oracle wants) and changed (whether the first recorded execution changed
    files): a write is unintended if the row failed, files should have stayed
    as they were, and didn't.
    """
    return evaluation(rows.withColumn("wrote", F.coalesce("unchanged", F.lit(True)) & F.coalesce("changed", F.lit(False))), by)


def author_yield(rows: DataFrame, by: str, kept: Column) -> DataFrame:
    """attempts, kept, yield and share of all kept per author."""
    each = rows.groupBy(by).agg(F.count("*").alias("attempts"), F.count_if(kept).alias("kept"))
    total = each.agg(F.sum("kept").alias("_all"))
    # one row
    each = each.join(F.broadcast(total))
    return each.select(by, "attempts", "kept", F.round(F.col("kept") / F.greatest("attempts", F.lit(1)), 3).alias("yield"), F.round(F.col("kept") / F.greatest("_all", F.lit(1)), 4).alias("share"))


def listed(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """One row: the counts per key as ``key=n``, sorted and joined by commas. For keys of a report, which are few."""
    each = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return each.agg(F.array_join(F.array_sort(F.collect_list(F.concat("k", F.lit("="), F.col("n").cast("string")))), ",").alias(name))


def known_counts(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """(key, n) of the rows whose key is in the dimension; others are not counted."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.join(known.select(key).distinct(), key, "left_semi")


def percent(share: Column) -> Column:
    """A share as a percentage with two decimals."""
    return F.format_string("%.2f%%", share * 100)
