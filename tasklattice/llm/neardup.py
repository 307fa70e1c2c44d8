"""Near-duplicate groups by pigeonring filtering on word sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.session import Scratch

from . import boxes as bx
from . import words as ws

#: Boxes of the ring in which pairs with a rare word in common are compared: the words' hash range in equal parts.
RING = 16


def _check(order: bx.Order, budget: bx.Budget, tally: bool = False):
    """The pairs of a batch (a, b, boxes, starts, words of a, words of b) that keep to the budget: chains first, then the whole difference."""

    def rows(batch):
        (sa, ha), (sb, hb) = ws.flat(batch.column(4)), ws.flat(batch.column(5))
        na, nb = np.diff(sa), np.diff(sb)
        pair = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
        h = np.concatenate([ha, hb])
        place, mark = order.look(h)
        m = batch.column(2).to_numpy().astype(np.int64)
        rare = np.bincount(pair, place < 0, len(na)).astype(np.int64)
        ringed = m > 0
        left = budget.whole(na + nb) - np.where(ringed, budget.unit * rare, 0)
        # a row per pair and start; pairs that met at a rare word may start anywhere
        starts = batch.column(3)
        size = np.diff(starts.offsets.to_numpy())
        own = np.repeat(np.arange(len(na)), np.where(ringed, size, 1))
        first = np.flatnonzero(np.repeat(ringed, size))
        begin = np.zeros(len(own), np.int64)
        begin[ringed[own]] = starts.flatten().to_numpy()[first]
        rings = np.where(ringed, m, RING)
        box = np.where(ringed[pair], np.minimum((mark * rings[pair]).astype(np.int64), rings[pair] - 1), (h >> np.uint64(60)).astype(np.int64))
        seen = np.flatnonzero(~ringed[pair] | (place >= 0))
        seen = seen[np.argsort(pair[seen], kind="stable")]
        edge = np.searchsorted(pair[seen], np.arange(len(na) + 1))
        of, k = bx._ranges(edge[own], edge[own + 1])
        k = seen[k]
        held, compared = bx.chains(of, box[k], h[k], rings[own], begin, ~ringed[own], left[own], budget.unit)
        passed = np.zeros(len(na), bool)
        passed[own[held]] = True
        if tally:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (len(na), len(own), compared, int(passed.sum()))], names=["pairs", "starts", "compared", "passed"])
            return
        some = passed[pair]
        p, hh = pair[some], h[some]
        by = np.lexsort((hh, p))
        p, hh = p[by], hh[by]
        inter = np.bincount(p[1:][(p[1:] == p[:-1]) & (hh[1:] == hh[:-1])], minlength=len(na))
        good = np.flatnonzero(passed & ((na + nb - 2 * inter) * budget.unit <= budget.whole(na + nb)))
        if len(good):
            where = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(inter[good] / (na + nb - inter)[good])], names=["a", "b", "overlap"])

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                yield from rows(whole.slice(begin, 2048))

    return run


def candidates(sets: DataFrame, threshold: float, scratch: Scratch, least: int = bx.LEAST) -> tuple[DataFrame, bx.Order, bx.Budget]:
    """(a, b, boxes, starts, wa, wb) of the pairs that meet at a box and stay in budget on the chains of their sketches."""
    budget = bx.Budget.of(threshold)
    order = bx.word_order(sets, "words", scratch, least=least)
    kinds = bx.cells(sets, "words", order, budget)
    seen = bx.key_map(sets, "id", "words", order, kinds, budget, False, False)
    keys = lambda left: bx.key_rows(sets, "id", "words", order, kinds, budget, left, seen if left else None).drop("at").hint("merge")
    met = keys(True).alias("a").join(keys(False).alias("b"), bx.within("a", "b", budget) & (~F.col("a.alike") | (F.col("a.id") < F.col("b.id"))))
    a, b = F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")
    # a pair that shares a rare word needs no box of its frequent words
    pairs = met.groupBy(a, b).agg(F.min("a.boxes").alias("boxes"), F.collect_set("a.start").alias("starts"))
    pairs = scratch.write(pairs, "pairs")
    held = bx.of_pairs(sets.select("id", "words"), pairs)
    both = pairs.join(held.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(held.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    return both.select("a", "b", "boxes", "starts", "wa", "wb"), order, budget


def set_join(sets: DataFrame, threshold: float, scratch: Scratch, least: int = bx.LEAST) -> DataFrame:
    """(a, b, overlap), a < b, of all pairs of rows of ``sets`` (id long unique, words array<long> sorted) with Jaccard overlap >= threshold.

    With p/q the threshold, two sets of n and m words may differ in
    (q-p)/(q+p) * (n+m) words, the Hamming budget. Sets are rings of boxes:

    1. Boxes make the candidates. A rare word is a box of its own. Sets that
       share none have used up as much of the budget as they have rare words;
       for what is left, the slack, the frequent words are cut into more boxes
       than may differ, so that one box at least is equal (``key_rows``).
    2. From the equal box on, chains of consecutive boxes must stay within
       their share of the budget: in the join by a sketch of the ring turned to
       that box (``within``), then box by box with the exact differences; a
       chain is dropped at the first length that exceeds its share
       (``chains``). Pairs that met at a rare word may start at any box of a
       ring of all words, behind each chain that failed.
    3. What is left gets the full Hamming check on all words.

    No step drops a pair that is within the budget: of boxes whose differences
    sum to the budget or less, one starts a ring of chains that all hold. Empty
    sets have no partner. A word in ``least`` rows or fewer is rare; a rare word
    is in a bounded number of rows (``word_order``), other hot boxes are split
    by adaptive execution.
    """
    both, order, budget = candidates(sets.where(F.size("words") > 0), threshold, scratch, least)
    return scratch.write(both.mapInArrow(_check(order, budget), "a long, b long, overlap double"), "links")


def effort(sets: DataFrame, threshold: float, scratch: Scratch) -> dict[str, int]:
    """How many pairs the boxes gave, with how many starts, boxes compared before they were dropped or held, and pairs that were left for the full check."""
    both, order, budget = candidates(sets.where(F.size("words") > 0), threshold, scratch)
    total = both.mapInArrow(_check(order, budget, True), "pairs long, starts long, compared long, passed long")
    return total.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in total.columns]).first().asDict()


def task_sets(tasks: DataFrame) -> DataFrame:
    """(task_id, words) of every row: all words of request and accepted commands."""
    text = F.lower(F.concat_ws("\n", "user_request", "accepted_commands"))
    return ws.word_sets(tasks.select("task_id", text.alias("words")), ["task_id"], ["words"])


def near_tasks(tasks: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, overlap) between distinct word sets, members (task_id, id) of every task with words.

    Null or empty requests and commands count as no words; tasks without any
    words take no part. Every non-null task_id counts once.
    """
    scratch = Scratch(tasks.sparkSession, "neardup")
    reps, members = ws.set_classes(task_sets(tasks), "task_id", ["words"], scratch)
    return set_join(reps, threshold, scratch), members


def near_pairs(tasks: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(task_id_a, task_id_b), smaller first, of all pairs of tasks with overlap >= threshold, copies included."""
    links, members = near_tasks(tasks, threshold)
    a = members.select(F.col("task_id").alias("ta"), F.col("id").alias("a"))
    b = members.select(F.col("task_id").alias("tb"), F.col("id").alias("b"))
    across = links.select("a", "b").join(a, "a").join(b, "b")
    within = a.join(b, F.col("a") == F.col("b")).where("ta < tb")
    both = across.select("ta", "tb").union(within.select("ta", "tb"))
    return both.select(F.least("ta", "tb").alias("task_id_a"), F.greatest("ta", "tb").alias("task_id_b"))


def near_groups(tasks: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(task_id, group_id, class_id, n_links) of every task with words.

    A class holds the tasks with equal word sets and is named by the smallest
    task_id of them, a group the classes that chains of links join, named
    likewise; n_links counts a class's links to other classes.
    """
    from .splits import contract

    scratch = Scratch(tasks.sparkSession, "neargroups")
    links, members = near_tasks(tasks, threshold)
    members = scratch.write(members, "members")
    classes = scratch.write(members.groupBy("id").agg(F.min("task_id").alias("class_id")), "classes")
    ends = links.select(F.col("a").alias("id")).union(links.select("b"))
    degree = ends.groupBy("id").agg(F.count("*").alias("n_links"))
    roots = contract(links.select(F.col("a").alias("lo"), F.col("b").alias("hi")), scratch).roots.withColumnRenamed("node", "id")
    joined = classes.join(degree, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    joined = scratch.write(joined, "joined")
    smallest = joined.groupBy("root").agg(F.min("class_id").alias("group_id"))
    named = joined.join(smallest, "root").select("id", "group_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(named, "id").select("task_id", "group_id", "class_id", "n_links")
