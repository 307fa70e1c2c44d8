"""Admission: dedup by id and request, cap per shape, quota per author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import within_first


def first_per(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row per non-null key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_n_per(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """At most ``n`` rows per key in order; the limit is applied before the shuffle, too."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def shape_cap(n: int) -> int:
    """How many of ``n`` tasks may share a shape: a fiftieth, five at least."""
    return max(5, n // 50)


def admission(df: DataFrame, id_col: str, request: str, shape: str, order: list, cap: int, screened: Column | None = None, anchor: Column | None = None) -> DataFrame:
    """The rows with a ``reason``: the screen's, duplicate_task_id, duplicate_request, signature_capped or ok.

    Gates are sets and dedup precedes the cap: a row counts as a duplicate of an
    earlier one that passed the gates before, whether or not that one is capped.
    Rows with a null id are screened out as ``missing_id``; an empty request key
    joins nothing. Rows that are an ``anchor`` come before all others, are not
    capped though they count, and their requests make no other row a duplicate.

    No id, request or shape is ranked in one task, however many rows it has
    (``within_first``).
    """
    reason = F.when(F.col(id_col).isNull(), "missing_id")
    reason = F.coalesce(reason, screened) if screened is not None else reason
    fixed = F.coalesce(anchor, F.lit(False)) if anchor is not None else F.lit(False)
    df = df.withColumn("reason", reason).withColumn("_later", ~fixed)
    alive = F.col("reason").isNull()
    order = ["_later", *order]
    df = within_first(df, F.when(alive, F.col(id_col)), order, 1, "_first")
    df = df.withColumn("reason", F.coalesce("reason", F.when(~F.col("_first"), "duplicate_task_id"))).drop("_first")
    # the rows that are left have an id each
    order = order if id_col in order else [*order, id_col]
    asked = alive & F.col("_later") & (F.col(request) != "")
    df = within_first(df, F.when(asked, F.col(request)), order, 1, "_first", unique=True)
    df = df.withColumn("reason", F.coalesce("reason", F.when(asked & ~F.col("_first"), "duplicate_request"))).drop("_first")
    df = within_first(df, F.when(alive, F.coalesce(F.col(shape), F.lit(""))), order, cap, "_first", unique=True)
    return df.withColumn("reason", F.coalesce("reason", F.when(~F.col("_first") & F.col("_later"), "signature_capped"), F.lit("ok"))).drop("_first", "_later")


def admit_exact(df: DataFrame, id_col: str, request: str, shape: str, seq: str, cap: int) -> DataFrame:
    """(seq, id, reason) by the sequential rule: a capped row registers neither its id nor its request.

    A null or empty request key joins nothing, as in ``admission``.
    The rule depends on the whole order, so rows are folded in order in one
    task that holds the keys seen; it is meant for one writer's admission log,
    as the streaming sink feeds it, not for a corpus (``admission`` is).
    """

    def run(batches):
        ids, requests, shapes = set(), set(), {}
        for pdf in batches:
            out = []
            for i, r, s in zip(pdf[id_col], pdf[request], pdf[shape], strict=True):
                if i in ids:
                    out.append("duplicate_task_id")
                elif r is not None and r in requests:
                    out.append("duplicate_request")
                elif shapes.get(s, 0) >= cap:
                    out.append("signature_capped")
                else:
                    ids.add(i)
                    if r is not None:
                        requests.add(r)
                    shapes[s] = shapes.get(s, 0) + 1
                    out.append("ok")
            yield pdf[[seq, id_col]].assign(reason=out)

    slim = df.select(seq, id_col, F.when(F.col(request) != "", F.col(request)).alias(request), shape)
    kinds = dict(slim.dtypes)
    return slim.coalesce(1).sortWithinPartitions(seq).mapInPandas(run, f"`{seq}` {kinds[seq]}, `{id_col}` {kinds[id_col]}, reason string")


def shares(authors: DataFrame, author: str, total: int) -> DataFrame:
    """(author, quota): total div number of authors, the remainder going to the first authors by name. A row per author."""
    n = authors.select(author).distinct()
    ranked = n.withColumn("_place", F.row_number().over(Window.orderBy(author))).withColumn("_n", F.count("*").over(Window.partitionBy()))
    return ranked.select(author, (F.floor(F.lit(total) / F.col("_n")) + F.when(F.col("_place") <= F.lit(total) % F.col("_n"), 1).otherwise(0)).cast("long").alias("quota"))


def quota(df: DataFrame, author: str, order: list, total: int, authors: DataFrame) -> DataFrame:
    """Rows within each author's quota. Rows of a hot author are ranked in parts."""
    return within_first(df.join(shares(authors, author, total), author), F.col(author), order, "quota", "_in").where("_in").drop("_in")


def quota_with_ceiling(df: DataFrame, author: str, order: list, kept: Column, total: int, authors: DataFrame, per_quota: float, least: int) -> DataFrame:
    """Kept rows within each author's quota, sought among the author's first attempts only: ``per_quota`` times the quota, ``least`` at least."""
    share = shares(authors, author, total).withColumn("ceiling", F.greatest(F.floor(F.col("quota") * per_quota), F.lit(least)).cast("long"))
    tried = within_first(df.join(share, author), F.col(author), order, "ceiling", "_in").where("_in").drop("_in")
    return within_first(tried.where(kept), F.col(author), order, "quota", "_in").where("_in").drop("_in", "ceiling")
