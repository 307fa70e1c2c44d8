"""Splits that keep related records together: a spanning forest, then systematic dealing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklattice.session import Scratch

# Families that join nothing, as letters and digits in lower case.
NO_FAMILY = ["", "llmauthored", "unknown", "none", "na"]


def family_key(family):
    """Letters and digits of a family in lower case; null where the family joins nothing."""
    key = F.regexp_replace(F.lower(family), r"[^\p{L}\p{Nd}]+", "")
    return F.when(~key.isin(NO_FAMILY), key)


def command_key(command):
    """What must agree for two commands to be equal; null where the command joins nothing.

    Lines that begin with three backticks or ``#`` go, then ``$`` and ``>``
    marks before a space at the start of a line, all white space, both quotes
    and the ``;`` at the end. What has no ``/`` left joins nothing.
    """
    kept = F.regexp_replace(command, r"(?Um)^\s*(?:```|#)[^\r\n]*$", "")
    kept = F.regexp_replace(kept, r"(?Um)^\s*(?:[$>]\s+)+", "")
    kept = F.regexp_replace(kept, r"""(?U)[\s'"]+""", "")
    kept = F.regexp_replace(kept, r";+$", "")
    return F.when(kept.contains("/"), kept)


@dataclass
class Groups:
    """roots: (node, root) of every node that has an edge; forest: (a, b, key, round), edges of the input, as many as nodes less groups."""

    roots: DataFrame
    forest: DataFrame


def contract(edges: DataFrame, scratch: Scratch) -> Groups:
    """Connected groups of the nodes of edges (lo, hi[, key]), by Borůvka's minimum-edge contraction.

    In each round every vertex picks its smallest edge (by smaller, then larger
    end), the picked edges join the forest, pointer jumping finds the root of
    each tree, and the edges are relabelled by root; what no longer joins two
    roots goes. The vertices of a component at least halve in each round. An
    edge carries the edge of the input it stands for, so the forest is one of
    the input. Forest and maps are tables in the shared folder: a lost executor
    costs one round at most.

    Joins on a hub are split by adaptive execution where a hub is hot; minima
    are combined before the shuffle. Edges from a node to itself join nothing.
    """
    spark = edges.sparkSession
    if "key" not in edges.columns:
        edges = edges.withColumn("key", F.lit(None).cast("string"))
    kind = edges.schema["lo"].dataType.simpleString()
    edges = edges.where("lo != hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"), F.struct("lo", "hi", "key").alias("e"))
    edges = scratch.write(edges.groupBy("lo", "hi").agg(F.min("e").alias("e")), "edges0")
    n_edges, k = edges.count(), 0
    forests, maps = [], []
    while n_edges:
        ends = edges.select(F.col("lo").alias("x"), F.col("hi").alias("y"), "e").union(edges.select("hi", "lo", "e"))
        picks = scratch.write(ends.groupBy("x").agg(F.min(F.struct("y", "e")).alias("p")).select("x", "p.y", "p.e"), f"picks{k}")
        other = picks.select(F.col("x").alias("y"), F.col("y").alias("back"))
        # a vertex smaller than all its neighbours is a root if its pick answers
        up = F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("y")
        tree = scratch.write(picks.join(other, "y").select("x", up, "e"), f"tree{k}")
        forests.append(tree.where("x != y").select(F.col("e.lo").alias("a"), F.col("e.hi").alias("b"), "e.key", F.lit(k).alias("round")))
        jumped, j = tree.select("x", "y"), 0
        while True:
            above = jumped.select(F.col("x").alias("y"), F.col("y").alias("z"))
            new = jumped.join(above, "y").select("x", F.col("z").alias("y"), (F.col("z") != F.col("y")).alias("moved"))
            new = scratch.write(new, f"jump{k}_{j}")
            moved = new.where("moved").limit(1).count()
            if j:
                scratch.drop(f"jump{k}_{j - 1}")
            jumped, j = new.select("x", "y"), j + 1
            if not moved:
                break
        maps.append(jumped)
        a = jumped.select(F.col("x").alias("lo"), F.col("y").alias("a"))
        b = jumped.select(F.col("x").alias("hi"), F.col("y").alias("b"))
        left = edges.join(a, "lo").join(b, "hi").where("a != b").groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("e").alias("e"))
        edges = scratch.write(left, f"edges{k + 1}")
        n_edges = edges.count()
        scratch.drop(f"edges{k}", f"picks{k}")
        k += 1
    forest = spark.createDataFrame([], f"a {kind}, b {kind}, key string, round int")
    for f in forests:
        forest = forest.union(f)
    roots = maps[0].select(F.col("x").alias("node"), F.col("y").alias("root")) if maps else spark.createDataFrame([], f"node {kind}, root {kind}")
    for m in maps[1:]:
        roots = roots.join(m.select(F.col("x").alias("root"), F.col("y").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return Groups(roots, forest)


def spanning_forest(links: DataFrame, node: str, key: str, scratch: Scratch | None = None) -> Groups:
    """Connected groups of nodes that share a key.

    Every key with two or more nodes becomes a star around its smallest node,
    so a key held by a third of all nodes gives one edge per node and no pairs;
    the stars are contracted. ``links`` rows with a null node or key are
    ignored. Nodes that share no key get no root.
    """
    scratch = scratch or Scratch(links.sparkSession, "forest")
    links = links.where(F.col(node).isNotNull() & F.col(key).isNotNull()).select(F.col(node).alias("u"), F.col(key).alias("k"))
    links = scratch.write(links, "links")
    hubs = links.groupBy("k").agg(F.min("u").alias("hub"), F.max("u").alias("_far")).where("hub < _far").select("k", "hub")
    named = F.lower(F.hex("k")) if dict(links.dtypes)["k"] == "binary" else F.col("k").cast("string")
    return contract(links.join(hubs, "k").where("u != hub").select(F.col("hub").alias("lo"), F.col("u").alias("hi"), named.alias("key")), scratch)


def deal(groups: DataFrame, group: str, size: str, splits: dict[str, float], seed: int = 0) -> DataFrame:
    """(group, split): groups stratified by size band and dealt systematically.

    Bands are powers of two of the group size and are dealt from the largest
    down. In a band the groups stand in the order of a hash, and a walk along
    their summed sizes deals them: to each split as much as it still lacks of
    its proportion of all that is dealt with this band. What was really dealt
    is summed up after each band, so a deviation by a large group is made up by
    smaller ones, and in the end a split is off by less than one group of the
    smallest band in which there was something left to deal. A group is never
    divided: one that is larger than a split's share takes it over.

    The running sum has two parts, one within a range partition of a band and
    one over the partitions (a table with a row per band and partition); no
    window holds a band. Per band, fewer than 64, a row per split reaches the
    driver.
    """
    spark = groups.sparkSession
    names = list(splits)
    scratch = Scratch(spark, "deal")
    band = F.floor(F.log2(F.col(size).cast("double"))).cast("int")
    ranged = groups.select(group, size, band.alias("band"), F.xxhash64(F.lit(seed), group).alias("h")).repartitionByRange(F.col("band").desc(), "h", group)
    ranged = scratch.write(ranged.select("*", F.spark_partition_id().alias("part")), "ranged")
    parts = ranged.groupBy("band", "part").agg(F.sum(size).alias("weight"))
    before = F.sum("weight").over(Window.partitionBy("band").orderBy("part")) - F.col("weight")
    within = F.sum(size).over(Window.partitionBy("band", "part").orderBy("h", group)) - F.col(size)
    placed = ranged.withColumn("within", within).join(parts.select("band", "part", before.alias("before")), ["band", "part"])
    placed = scratch.write(placed.select(group, size, "band", (F.col("within") + F.col("before") + F.col(size) / 2).alias("at")).sortWithinPartitions("band"), "placed")
    weights = {r["band"]: r["weight"] for r in placed.groupBy("band").agg(F.sum(size).alias("weight")).collect()}
    total, given, cuts = 0.0, dict.fromkeys(names, 0.0), {}
    for b in sorted(weights, reverse=True):
        total += weights[b]
        lack = [max(0.0, splits[s] * total - given[s]) for s in names]
        ends, upto = [], 0.0
        for x in lack:
            upto += x
            ends.append(upto * weights[b] / sum(lack) if sum(lack) else weights[b])
        cuts[b] = ends
        own = placed.where(F.col("band") == b).groupBy(_chosen(F.array(*map(F.lit, ends)), names).alias("split")).agg(F.sum(size).alias("n"))
        for r in own.collect():
            given[r["split"]] += r["n"]
    table = spark.createDataFrame(list(cuts.items()), "band int, ends array<double>")
    # fewer than 64 rows
    return placed.join(F.broadcast(table), "band").select(group, _chosen(F.col("ends"), names).alias("split"))


def _chosen(ends, names: list[str]):
    """The first split whose end lies beyond the place ``at``, the last one if none does."""
    return F.coalesce(*[F.when(F.col("at") < ends[k], name) for k, name in enumerate(names)], F.lit(names[-1]))


def task_links(tasks: DataFrame) -> DataFrame:
    """(task_id, key) of all families and commands that may join tasks; keys are digests of the compared text."""
    family = F.concat(F.lit("f:"), family_key(F.col("provenance.template_family")))
    commands = F.transform(F.coalesce("accepted_commands", F.array().cast("array<string>")), lambda c: F.concat(F.lit("c:"), command_key(c)))
    keys = F.array_compact(F.concat(F.array(family), commands))
    rows = tasks.where(F.col("task_id").isNotNull()).select("task_id", F.explode(keys).alias("key"))
    return rows.select("task_id", F.unhex(F.md5("key")).alias("key")).distinct()


def task_groups(tasks: DataFrame) -> DataFrame:
    """(task_id, group_id, group_size) of every non-null task_id; group_id is the group's smallest task_id."""
    groups = spanning_forest(task_links(tasks), "task_id", "key")
    scratch = Scratch(tasks.sparkSession, "groups")
    roots = scratch.write(groups.roots, "roots")
    sizes = roots.groupBy("root").agg(F.min("node").alias("group_id"), F.count("*").alias("group_size"))
    joined = roots.join(sizes, "root").select(F.col("node").alias("task_id"), "group_id", "group_size")
    every = tasks.where(F.col("task_id").isNotNull()).select("task_id").distinct()
    return every.join(joined, "task_id", "left").select("task_id", F.coalesce("group_id", "task_id").alias("group_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))


def grouped_pairs(tasks: DataFrame) -> DataFrame:
    """(group_id, task_id) of all groups of two or more tasks."""
    roots = Scratch(tasks.sparkSession, "groups").write(spanning_forest(task_links(tasks), "task_id", "key").roots, "roots")
    smallest = roots.groupBy("root").agg(F.min("node").alias("group_id"))
    return roots.join(smallest, "root").select("group_id", F.col("node").alias("task_id"))


def task_forest(tasks: DataFrame) -> DataFrame:
    """(task_id_a, task_id_b, key, round) of a spanning forest of the groups: pairs of tasks, smaller first, that share the family or command of that digest."""
    forest = spanning_forest(task_links(tasks), "task_id", "key").forest
    return forest.select(F.least("a", "b").alias("task_id_a"), F.greatest("a", "b").alias("task_id_b"), "key", "round")


def split_tasks(tasks: DataFrame, splits: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """(task_id, group_id, group_size, split): one split per task, whole groups together.

    Every non-null task_id comes out once. Null families, null or empty
    commands join nothing, and such a task is a group of its own.
    """
    splits = splits or {"train": 0.8, "validation": 0.1, "test": 0.1}
    rows = Scratch(tasks.sparkSession, "split").write(task_groups(tasks), "rows")
    groups = rows.groupBy("group_id").agg(F.max("group_size").alias("group_size"))
    return rows.join(deal(groups, "group_id", "group_size", splits, seed), "group_id").select("task_id", "group_id", "group_size", "split")
