"""Consensus labels, agreement and annotator reliability by iteratively reweighted voting."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.session import Scratch

from .topn import latest, normal_id

#: Up to so many annotators names and weights are sent to the tasks, as arrays of some 50 bytes an annotator; beyond it they are joined.
ANNOTATORS_SENT = 20_000


@dataclass
class Consensus:
    """items: one row per item with a vote; annotators: one row per annotator; overall: one row; rounds until the weights were stable (``converged``) or the last one allowed."""

    items: DataFrame
    annotators: DataFrame
    overall: DataFrame
    rounds: int
    converged: bool


def _encode(votes: list[str]):
    """Patterns with their votes as numbers: the place among the sorted ``votes``."""
    known = pa.array(votes, pa.string())

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            codes = pc.index_in(lists.flatten(), value_set=known).cast(pa.int64())
            offsets = lists.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([lists, batch.column(1), pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), codes)], names=["pattern", "copies", "votes"])

    return run


def _score(weights: np.ndarray):
    """Patterns with the sum of their votes' weights."""
    flat = weights.ravel()

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            score = np.bincount(row, flat[lists.flatten().to_numpy()], batch.num_rows) if len(row) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=["pattern", "copies", "votes", "score"])

    return run


def _count_votes(weights: np.ndarray):
    """Per batch of vote patterns: each annotator's votes against the consensus of the others.

    ``weights[j] = (weight of a false vote, weight of a true vote)``.
    """

    def run(batches):
        total = np.zeros((len(weights), 4))
        for batch in batches:
            if not batch.num_rows:
                continue
            votes = batch.column(0)
            offsets = votes.offsets.to_numpy()
            flat = votes.flatten().to_numpy(zero_copy_only=False) if len(votes.flatten()) else np.zeros(0, np.int64)
            offsets = offsets - offsets[0]
            copies = batch.column(1).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            who, said = flat >> 1, flat & 1
            own = weights[who, said]
            score = np.bincount(row, own, batch.num_rows)
            # tenths of a billionth: sums of the same weights in another order must tie alike
            others = np.round(score[row] - own, 10)
            sure = others != 0
            cell = who * 4 + 2 * (others > 0) + said
            total += np.bincount(cell[sure], copies[row][sure], 4 * len(weights)).reshape(-1, 4)
        n = len(weights)
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n)), *(pa.array(total[:, k]) for k in range(4))],
                names=["who", "n00", "n01", "n10", "n11"],
            )

    return run


def _weights(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Log-likelihood ratios of a false and a true vote from counts (c0v0, c0v1, c1v0, c1v1)."""
    c = counts + smoothing
    on_false, on_true = c[:, :2] / c[:, :2].sum(1, keepdims=True), c[:, 2:] / c[:, 2:].sum(1, keepdims=True)
    return np.log(on_true / on_false)


def _joined_counts(patterns: DataFrame, weights: DataFrame) -> DataFrame:
    """The same counts with the weights joined, for more annotators than can be sent."""
    long = patterns.select("pattern", "copies", F.explode("votes").alias("vote"))
    long = long.select("pattern", "copies", F.expr("vote div 2").alias("who"), (F.col("vote") % 2).alias("said")).join(weights, "who")
    own = F.when(F.col("said") == 1, F.col("w1")).otherwise(F.col("w0"))
    long = long.withColumn("own", own)
    score = long.groupBy("pattern").agg(F.sum("own").alias("score"))
    others = F.round(F.col("score") - F.col("own"), 10)
    long = long.join(score, "pattern").where(others != 0)
    cell = F.when(others > 0, 2).otherwise(0) + F.col("said")
    sums = [F.sum(F.when(cell == k, F.col("copies")).otherwise(0)).cast("double").alias(n) for k, n in enumerate(("n00", "n01", "n10", "n11"))]
    return long.groupBy("who").agg(*sums)


def consensus(
    votes: DataFrame,
    pattern: str = "pattern",
    smoothing: float = 1.0,
    tolerance: float = 1e-4,
    rounds: int = 60,
    annotators_sent: int = ANNOTATORS_SENT,
) -> Consensus:
    """Consensus by iteratively reweighted voting.

    ``votes`` has one row per item; ``pattern`` is an array of strings, each an
    annotator's name followed by ``=1`` or ``=0``, one per annotator, sorted.

    Weighted consensus and annotators' accuracies are computed in turn until
    the weights are stable. An accuracy is measured leave-one-out (a vote is
    compared with the weighted consensus of the item's other votes), per label
    (so that an annotator who always says yes gains nothing by it), and
    smoothed. A vote's weight is the logarithm of its likelihood ratio: near
    zero for noise, below zero for a vote that tells the opposite. The first
    round counts all votes alike. If the weights aren't stable after ``rounds``
    the last ones hold, and ``converged`` is false.

    Items with the same votes are counted once with their number, so a round
    reads the distinct patterns and shuffles a few numbers per annotator.
    An item whose weighted votes cancel gets a null label; an item without
    votes (an empty or null pattern) gets no row. Columns of ``votes`` named
    like a result are replaced by it. ``overall`` has Krippendorff's alpha for nominal labels
    over items with two or more ratings, which allows for missing ratings
    (null if there is no such item or no disagreement is possible).
    """
    spark = votes.sparkSession
    scratch = Scratch(spark, "consensus")
    votes = votes.where(F.size(pattern) > 0)
    names = scratch.write(votes.select(F.explode(pattern).alias("v")).select(F.expr("left(v, length(v) - 2)").alias("annotator")).distinct(), "names")
    n_names = names.count()
    counted = votes.groupBy(F.col(pattern).alias("pattern")).agg(F.count("*").alias("copies"))
    if n_names <= annotators_sent:
        known = sorted(r[0] for r in names.collect())
        coded = counted.mapInArrow(_encode([f"{k}={v}" for k in known for v in (0, 1)]), "pattern array<string>, copies long, votes array<bigint>")
        patterns = scratch.write(coded, "patterns")
        whos = spark.createDataFrame([(j, k) for j, k in enumerate(known)], "who long, annotator string")
    else:
        whos = scratch.write(names.select(F.xxhash64("annotator").bitwiseAND(F.lit((1 << 61) - 1)).alias("who"), "annotator"), "whos")
        said = counted.select("pattern", "copies", F.explode("pattern").alias("v"))
        said = said.select("pattern", "copies", F.expr("left(v, length(v) - 2)").alias("annotator"), F.expr("cast(right(v, 1) as long)").alias("said")).join(whos, "annotator")
        patterns = scratch.write(said.groupBy("pattern", "copies").agg(F.collect_list(F.col("who") * 2 + F.col("said")).alias("votes")), "patterns")

    done, converged = 0, not n_names
    if n_names <= annotators_sent:
        weights = np.tile([-1.0, 1.0], (max(1, len(known)), 1))
        counts = np.zeros((len(weights), 4))
        for done in range(1, 1 + rounds if known else 1):
            part = patterns.select("votes", "copies").mapInArrow(_count_votes(weights), "who long, n00 double, n01 double, n10 double, n11 double")
            got = part.groupBy("who").agg(*[F.sum(c).alias(c) for c in ("n00", "n01", "n10", "n11")]).collect()
            counts = np.zeros((len(weights), 4))
            for r in got:
                counts[r["who"]] = r[1:]
            new = _weights(counts, smoothing)
            moved = np.abs(new - weights).max()
            weights = new
            if moved < tolerance:
                converged = True
                break
        table = spark.createDataFrame(
            [(j, *map(float, counts[j]), *map(float, weights[j])) for j in range(len(known))],
            "who long, n00 double, n01 double, n10 double, n11 double, w0 double, w1 double",
        )
        scored = patterns.select("pattern", "copies", "votes").mapInArrow(_score(weights), "pattern array<string>, copies long, votes array<bigint>, score double")
    else:
        table = whos.select("who", *[F.lit(0.0).alias(c) for c in ("n00", "n01", "n10", "n11")], F.lit(-1.0).alias("w0"), F.lit(1.0).alias("w1"))
        for k in range(rounds):
            got = _joined_counts(patterns, table.select("who", "w0", "w1"))
            c = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in ("n00", "n01", "n10", "n11")}
            s = smoothing
            w1 = F.log(((c["n11"] + s) / (c["n10"] + c["n11"] + 2 * s)) / ((c["n01"] + s) / (c["n00"] + c["n01"] + 2 * s)))
            w0 = F.log(((c["n10"] + s) / (c["n10"] + c["n11"] + 2 * s)) / ((c["n00"] + s) / (c["n00"] + c["n01"] + 2 * s)))
            new = whos.select("who").join(got, "who", "left").select("who", *[c[n].alias(n) for n in c], w0.alias("w0"), w1.alias("w1"))
            new = scratch.write(new, f"weights{k}")
            old = table.select("who", F.col("w0").alias("o0"), F.col("w1").alias("o1"))
            moved = new.join(old, "who").agg(F.max(F.greatest(F.abs(F.col("w0") - F.col("o0")), F.abs(F.col("w1") - F.col("o1"))))).first()[0]
            table = new
            if k > 0:
                scratch.drop(f"weights{k - 1}")
            done = k + 1
            if moved is None or moved < tolerance:
                converged = True
                break
        long = patterns.select("pattern", "copies", "votes", F.explode("votes").alias("vote")).withColumn("who", F.expr("vote div 2"))
        long = long.join(table.select("who", "w0", "w1"), "who")
        own = F.when(F.col("vote") % 2 == 1, F.col("w1")).otherwise(F.col("w0"))
        scored = long.groupBy("pattern").agg(F.first("votes").alias("votes"), F.first("copies").alias("copies"), F.sum(own).alias("score"))

    m = F.size("votes")
    yes = F.aggregate("votes", F.lit(0), lambda acc, v: acc + (v % 2).cast("int"))
    scored = scored.select("pattern", "copies", F.round("score", 10).alias("score"), m.alias("n_votes"), yes.alias("n_yes"))
    scored = scratch.write(scored, "scored")
    no = F.col("n_votes") - F.col("n_yes")
    pairs = F.col("n_votes") * (F.col("n_votes") - 1)
    label = F.when(F.col("score") > 0, True).when(F.col("score") < 0, False)
    agreement = F.when(F.col("n_votes") > 1, (F.col("n_yes") * (F.col("n_yes") - 1) + no * (no - 1)) / pairs)
    labelled = scored.select("pattern", "n_votes", "n_yes", "score", label.alias("consensus"), agreement.alias("agreement"))
    own = [c for c in votes.columns if c == pattern or c not in labelled.columns]
    items = votes.select(*own).withColumnRenamed(pattern, "pattern").join(labelled, "pattern").drop("pattern")

    seen = table.select("n00", "n01", "n10", "n11", "who", "w0", "w1").join(whos, "who")
    smooth = lambda a, b: (F.col(a) + smoothing) / (F.col(a) + F.col(b) + 2 * smoothing)
    annotators = seen.select(
        "annotator",
        (F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")).cast("long").alias("n_compared"),
        smooth("n11", "n10").alias("accuracy_on_true"),
        smooth("n00", "n01").alias("accuracy_on_false"),
        ((smooth("n11", "n10") + smooth("n00", "n01")) / 2).alias("reliability"),
        F.col("w1").alias("weight_true"),
        F.col("w0").alias("weight_false"),
    )
    rated = scored.where("n_votes > 1").agg(
        F.sum(F.col("copies") * 2.0 * F.col("n_yes") * no / (F.col("n_votes") - 1)).alias("seen"),
        F.sum(F.col("copies") * F.col("n_yes")).alias("yes"),
        F.sum(F.col("copies") * no).alias("no"),
        F.sum("copies").alias("items"),
    )
    n = F.col("yes") + F.col("no")
    expected = F.lit(2.0) * F.col("yes") * F.col("no") / (n - 1)
    overall = rated.select(F.coalesce("items", F.lit(0)).alias("items"), n.alias("ratings"), F.when(expected > 0, 1 - F.col("seen") / expected).alias("alpha"))
    return Consensus(items, annotators, overall, done, converged)


def usable_votes(votes_map):
    """Array of ``judge=1`` / ``judge=0`` from a map of votes, sorted.

    Judges' names are trimmed and lower-cased; votes that are null or have a
    null ``semantically_correct`` are left out; a judge entered twice counts
    once, and not at all if the two entries contradict each other. A null map
    gives an empty array.
    """
    entries = F.filter(F.map_entries(votes_map), lambda e: e["value"]["semantically_correct"].isNotNull())
    said = F.array_distinct(F.transform(entries, lambda e: F.concat(normal_id(e["key"]), F.when(e["value"]["semantically_correct"], F.lit("=1")).otherwise(F.lit("=0")))))
    opposite = lambda v: F.concat(F.substring(v, F.lit(1), F.length(v) - 1), F.when(F.endswith(v, F.lit("1")), "0").otherwise("1"))
    clear = F.filter(said, lambda v: ~F.array_contains(said, opposite(v)))
    return F.coalesce(F.array_sort(clear), F.array().cast("array<string>"))


def judged(candidates: DataFrame) -> DataFrame:
    """One row per candidate_id, the latest delivery: (candidate_id, passed, judged pattern)."""
    rows = candidates.select(
        "candidate_id",
        "recorded_at",
        F.col("verdict.passed").alias("passed"),
        F.array_join(usable_votes(F.col("judge_votes")), "\n").alias("said"),
    )
    rows = latest(rows, "candidate_id", "recorded_at", ["passed", "said"])
    return rows.select("candidate_id", "passed", F.when(F.col("said") == "", F.array().cast("array<string>")).otherwise(F.split("said", "\n")).alias("pattern"))
