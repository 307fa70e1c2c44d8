"""Top N rows of every group by secondary sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EDGES = r"(?U)^\s+|\s+$"


def normal_id(col):
    """Lower case without white space at either end."""
    return F.regexp_replace(F.lower(col), _EDGES, "")


def latest(df: DataFrame, key: str, at: str, cols: list[str]) -> DataFrame:
    """One row per non-null ``key``: the one with the latest ``at`` (null is earliest).

    Of rows with equal times the one with the greatest values is kept, so the
    result does not depend on the order of the input.
    """
    held = F.max(F.struct(F.col(at).alias("_at"), *[F.col(c) for c in cols])).alias("_row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(held).select(key, *[f"_row.{c}" for c in cols])


def _keep_first(n: int, group: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            keys = batch.column(batch.schema.get_field_index(group))
            change = np.zeros(size, bool)
            change[0] = keys[0].as_py() != last
            if size > 1:
                change[1:] = pc.not_equal(keys.slice(1), keys.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            at = np.arange(size)
            begins = np.where(change, at, -1)
            np.maximum.accumulate(begins, out=begins)
            rank = np.where(begins < 0, at + seen, at - begins)
            last, seen = keys[size - 1].as_py(), int(rank[-1]) + 1
            kept = np.flatnonzero(rank < n)
            if len(kept):
                yield batch.take(pa.array(kept))

    return run


def top_n(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each non-null ``group`` under ``order`` (columns, ties must be resolved by it).

    Secondary sort: rows are sorted by group and order within partitions and
    streamed as Arrow batches; a counter is all that is kept, so no group is
    ever held in memory. The pass runs first on the partitions as they come,
    which leaves at most ``n`` rows of a group per partition, and only those
    are hash-partitioned by group for the second pass: a group with a third of
    all rows costs its task no more than ``n`` rows per input partition.

    Rows with a null group are left out; an empty input gives an empty result.
    """
    keep = _keep_first(n, group)
    part = df.where(F.col(group).isNotNull()).sortWithinPartitions(F.col(group), *order).mapInArrow(keep, df.schema)
    return part.repartition(group).sortWithinPartitions(F.col(group), *order).mapInArrow(keep, df.schema)


def best_candidates(candidates: DataFrame, n: int = 3) -> DataFrame:
    """The best ``n`` candidates of each task: (task_id, candidate_id, rank order columns).

    No forbidden side effect comes first, then the higher exact fraction, then
    the smaller candidate_id. The latest delivery of a candidate holds.
    Candidates without id, task id, verdict or one of the two fields, or with
    a NaN fraction, are left out.
    """
    rows = candidates.select(
        "candidate_id",
        "recorded_at",
        normal_id(F.col("task_id")).alias("task_id"),
        F.col("verdict.forbidden_side_effect").alias("forbidden"),
        F.col("verdict.postconditions_passed").alias("fraction"),
    )
    rows = latest(rows, "candidate_id", "recorded_at", ["task_id", "forbidden", "fraction"])
    rows = rows.where(F.col("forbidden").isNotNull() & F.col("fraction").isNotNull() & ~F.isnan("fraction"))
    return top_n(rows, "task_id", [F.col("forbidden"), F.col("fraction").desc(), F.col("candidate_id")], n)
