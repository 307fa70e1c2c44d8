"""Same or near-same records across splits by an edit-distance segment join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.session import Scratch

from . import boxes as bx
from . import words as ws
from .splits import family_key

def banded_distance(sa, a, sb, b, most: np.ndarray) -> np.ndarray:
    """Insertions and deletions that turn row i of ``a`` into row i of ``b``, where they are ``most[i]`` or fewer, else a larger number.

    Dynamic programming over a band around the diagonal, all rows of the batch
    at once: a cell takes its upper neighbour plus one or, if the words agree,
    its diagonal neighbour; the way from the left is a running minimum.
    """
    na, nb = np.diff(sa), np.diff(sb)
    rows, k = len(na), int(max(most.max(initial=0), 0))
    big = np.int32(1 << 20)
    wide_a = int(na.max(initial=0))
    left = np.zeros((rows, wide_a), np.uint64)
    left[np.repeat(np.arange(rows), na), np.arange(len(a)) - np.repeat(sa[:-1], na)] = a
    right = np.zeros((rows, wide_a + 2 * k + 2), np.uint64)
    there = np.zeros(right.shape, bool)
    at = np.arange(len(b)) - np.repeat(sb[:-1], nb) + k
    owner = np.repeat(np.arange(rows), nb)
    fits = at < right.shape[1]
    right[owner[fits], at[fits]] = b[fits]
    there[owner[fits], at[fits]] = True
    offset = np.arange(2 * k + 1, dtype=np.int32)
    cost = np.where(offset - k >= 0, offset - k, big)[None].repeat(rows, 0).astype(np.int32)
    out = np.full(rows, big, np.int32)
    inside = np.abs(nb - na) <= k
    end = np.clip(nb - na + k, 0, 2 * k)
    for i in range(wide_a + 1):
        if i:
            j = i + offset - k
            window = slice(i - 1, i + 2 * k)
            equal = there[:, window] & (right[:, window] == left[:, i - 1 : i])
            up = np.concatenate([cost[:, 1:], np.full((rows, 1), big, np.int32)], 1) + 1
            step = np.minimum(up, np.where(equal, cost, big))
            step[:, j == 0] = i
            step[:, j < 0] = big
            cost = np.minimum(np.minimum.accumulate(step - offset, 1) + offset, big)
        done = inside & (na == i)
        out[done] = cost[done, end[done]]
    return out


def _verify(order: bx.Order, budget: bx.Budget):
    def near(batch, x, y):
        (sa, a), (sb, b) = ws.flat(batch.column(x)), ws.flat(batch.column(y))
        a, b = order.arrange(sa, a)[0], order.arrange(sb, b)[0]
        most = budget.whole(np.diff(sa) + np.diff(sb)) // budget.unit
        return banded_distance(sa, a, sb, b, most) <= most

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                good = np.flatnonzero(near(batch, 2, 3))
                if len(good):
                    batch = batch.take(pa.array(good))
                    good = np.flatnonzero(near(batch, 4, 5))
                if len(good):
                    batch = batch.take(pa.array(good))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])

    return run


def segment_join(reps: DataFrame, main: str, other: str, threshold: float, scratch: Scratch, least: int = bx.LEAST) -> DataFrame:
    """(a, b): ids of a held-out and a training class whose sets ``main`` and ``other`` both overlap by ``threshold`` or more.

    A set is read as a string of its words in one order for all strings, so
    that the edit distance (insertions and deletions) of two strings is the
    size of the difference of their sets. With p/q the threshold it may be
    k = (q-p)/(q+p) * (n+m).

    1. A held-out string is cut from end to end into segments, one more than k
       edits can destroy. Rare words stand first, each a segment of its own.
       Edits that insert or delete a rare word hit no other segment, so if no
       rare word is shared, those of both strings are off the budget and the
       rest is cut into one segment more than edits are left. Segments are of
       unequal length: the cuts are marks in the order of words at equal steps
       of information, so that none has common words only.
    2. A training string shows its substrings between the same marks, and its
       rare words. Segments and substrings meet in a join on their content, if
       the edit distance allows their places: p and p' must satisfy
       abs(p - p') + abs((n - p) - (m - p')) <= k; a sketch of the strings and
       of the stretches behind the segment must keep to the budget, too.
    3. Candidates are verified by banded dynamic programming on both strings.

    No step loses a pair within the thresholds. A segment of a rare word is in
    a bounded number of rows; other hot segments are split by adaptive execution.
    """
    budget = bx.Budget.of(threshold)
    order = bx.word_order(reps, main, scratch, least=least)
    kinds = bx.cells(reps, main, order, budget, both_ways=True)
    held = bx.key_rows(reps.where("held"), "id", main, order, kinds, budget, True).alias("a")
    seen = bx.key_map(reps.where("held"), "id", main, order, kinds, budget, True, True)
    train = bx.key_rows(reps.where("train"), "id", main, order, kinds, budget, False, seen, True).hint("merge").alias("b")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    shift = F.abs(a("at") - b("at")) + F.abs((a("n") - a("at")) - (b("n") - b("at")))
    allowed = shift * budget.unit <= budget.whole(a("n") + b("n"))
    met = held.join(train, bx.within("a", "b", budget) & (a("id") != b("id")) & allowed)
    pairs = scratch.write(met.select(a("id").alias("a"), b("id").alias("b")).distinct(), "pairs")
    met_reps = bx.of_pairs(reps.select("id", main, other), pairs)
    words = lambda name: met_reps.select(F.col("id").alias(name), F.col(main).alias(f"m{name}"), F.col(other).alias(f"o{name}"))
    both = pairs.join(words("a"), "a").join(words("b"), "b").select("a", "b", "ma", "mb", "oa", "ob")
    found = both.mapInArrow(_verify(order, budget), "a long, b long")
    same = reps.where("held and train").select(F.col("id").alias("a"), F.col("id").alias("b"))
    return scratch.write(found.union(same), "found")


def side(split):
    """True for training, False for any other split, null for null."""
    letters = F.regexp_replace(F.lower(split), r"[^a-z]+", "")
    return letters.isin("train", "training")


# Spellings of the two held-out splits.
_VALIDATION, _TEST = ["val", "valid", "validation", "dev"], ["test", "testing", "eval"]


def split_name(split):
    """train, validation or test for their usual spellings, else the letters in lower case."""
    letters = F.regexp_replace(F.lower(split), r"[^a-z]+", "")
    return F.when(side(split), "train").when(letters.isin(_VALIDATION), "validation").when(letters.isin(_TEST), "test").otherwise(letters)


def cross_split(tasks: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b) from held-out to training classes of equal texts, members (task_id, id, held, train).

    Words of all files' contents count together. Tasks with a null split or
    without words in the request or the files take no part. Every non-null
    task_id counts once.
    """
    scratch = Scratch(tasks.sparkSession, "overlap")
    train = side(F.col("split"))
    texts = tasks.where(F.col("split").isNotNull()).select(
        "task_id",
        train.alias("train"),
        (~train).alias("held"),
        F.lower(F.col("user_request")).alias("request"),
        F.lower(F.concat_ws("\n", F.map_values("setup_files"))).alias("files"),
    )
    sets = ws.word_sets(texts, ["task_id", "train", "held"], ["request", "files"])
    reps, members = ws.set_classes(sets, "task_id", ["request", "files"], scratch, ["train", "held"])
    return segment_join(reps, "files", "request", threshold, scratch), scratch.write(members, "members")


def cross_split_pairs(tasks: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(held, train): task ids of every held-out and training task whose requests and whose files overlap by ``threshold``, copies included."""
    links, members = cross_split(tasks, threshold)
    a = members.where("held").select(F.col("task_id").alias("held"), F.col("id").alias("a"))
    b = members.where("train").select(F.col("task_id").alias("train"), F.col("id").alias("b"))
    return links.join(a, "a").join(b, "b").select("held", "train")


def overlap_classes(tasks: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(task_id, class_id, held, n_links, n_tasks) of every task that takes part: overlaps without a row per pair.

    A class holds the tasks with equal words and is named by the smallest
    task_id. n_links counts the classes of the other side that overlap with it
    (its own, if it has tasks of both sides), n_tasks the tasks in them.
    """
    links, members = cross_split(tasks, threshold)
    sizes = members.groupBy("id").agg(F.min("task_id").alias("class_id"), F.count_if("held").alias("n_held"), F.count_if("train").alias("n_train"))
    sizes = Scratch(tasks.sparkSession, "overlapclasses").write(sizes, "sizes")
    counted = lambda own, far, n: links.join(sizes.select(F.col("id").alias(far), F.col(n).alias("n")), far).groupBy(F.col(own).alias("id")).agg(F.count("*").alias("n_links"), F.sum("n").alias("n_tasks"))
    sides = counted("a", "b", "n_train").withColumn("held", F.lit(True)).union(counted("b", "a", "n_held").withColumn("held", F.lit(False)))
    rows = members.join(sizes.select("id", "class_id"), "id").join(sides, ["id", "held"], "left")
    return rows.select("task_id", "class_id", "held", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"))


def overlap_report(tasks: DataFrame, sft: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(split, template_family, n_pairs, n_tasks): overlaps with training by held-out split and sft family, and the held-out tasks that have one.

    The family is that of the held-out task's sft records, letters and digits
    in lower case, the smallest if they disagree; ``none`` where there is no
    record or family. Pairs are counted from the sizes of classes.
    """
    found = overlap_classes(tasks, threshold).where("held and n_links > 0").select(F.col("task_id").alias("t"), "n_tasks")
    splits = tasks.where(F.col("task_id").isNotNull()).groupBy(F.col("task_id").alias("t")).agg(F.min(split_name(F.col("split"))).alias("split"))
    families = sft.where(F.col("task_id").isNotNull()).groupBy(F.col("task_id").alias("t")).agg(F.min(family_key(F.col("template_family"))).alias("template_family"))
    named = found.join(splits, "t").join(families, "t", "left")
    family = F.coalesce("template_family", F.lit("none")).alias("template_family")
    return named.groupBy("split", family).agg(F.sum("n_tasks").alias("n_pairs"), F.count("*").alias("n_tasks"))
