"""Each problem's operator against brute force, and its invariants."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tasklattice.llm import boxes as bx
from tasklattice.llm import consensus as cs
from tasklattice.llm import leaks, neardup, overlap, packing, quality, queries, splits, topn
from tasklattice.llm import words as ws
from tasklattice.session import Scratch


def sets_frame(spark, rows):
    """(id, words) of sets of small numbers."""
    hashed = [(i, sorted(int(x) for x in ws.mix(np.array(sorted(s), np.uint64)).view(np.int64))) for i, s in rows]
    hashed = [(i, [int(v) for v in np.sort(np.array(h, np.int64).view(np.uint64)).view(np.int64)]) for i, h in hashed]
    return spark.createDataFrame(hashed, "id long, words array<bigint>")


def random_sets(rng, n, vocabulary, low, high):
    """Sets of words of very unequal frequency, with near copies."""
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            s = set(rng.choice(out))
            for _ in range(rng.randint(0, max(1, len(s) // 3))):
                if s and rng.random() < 0.5:
                    s.discard(rng.choice(sorted(s)))
                else:
                    s.add(int(vocabulary * rng.random() ** 3))
        else:
            s = {int(vocabulary * rng.random() ** 3) for _ in range(rng.randint(low, high))}
        out.append(s)
    return out


def similar(sets, t=(7, 10)):
    return {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and len(sets[a] & sets[b]) * t[1] >= t[0] * len(sets[a] | sets[b])}


@pytest.mark.parametrize("seed,least,vocabulary,large", [(1, 3, 60, 24), (2, 0, 40, 24), (3, 1, 60, 60), (4, 50, 2000, 24), (5, 0, 300, 700)])
def test_set_join_loses_nothing(spark, seed, least, vocabulary, large):
    sets = random_sets(random.Random(seed), 160, vocabulary, 1, large)
    sets = list(map(set, {frozenset(s) for s in sets}))
    got = neardup.set_join(sets_frame(spark, list(enumerate(sets))), 0.7, Scratch(spark, "t"), least).collect()
    assert {(r["a"], r["b"]) for r in got} == similar(sets) and len(got) == len(similar(sets))


@pytest.mark.parametrize("seed,least,vocabulary,large", [(5, 3, 60, 24), (6, 0, 40, 24), (7, 60, 500, 24), (8, 0, 300, 700)])
def test_segment_join_loses_nothing(spark, seed, least, vocabulary, large):
    rng = random.Random(seed)
    sets = list(map(set, {frozenset(s) for s in random_sets(rng, 160, vocabulary, 1, large)}))
    held = [rng.random() < 0.4 for _ in sets]
    df = sets_frame(spark, list(enumerate(sets)))
    flags = spark.createDataFrame([(i, h, not h) for i, h in enumerate(held)], "id long, held boolean, train boolean")
    reps = df.join(flags, "id").withColumn("other", F.col("words")).cache()
    got = {tuple(sorted(r)) for r in overlap.segment_join(reps, "words", "other", 0.7, Scratch(spark, "t"), least).collect()}
    assert got == {p for p in similar(sets) if held[p[0]] != held[p[1]]}


def ring_rows(rng, rows, m):
    """Random rings as (pair, box, hashes) of both sides, and the boxes' differences."""
    sides = rng.integers(0, 3, (rows, m, 12))
    pair, box, word = np.nonzero(sides[:, :, :] >= 1)
    twice = sides[pair, box, word] == 2
    h = (pair * m + box) * 12 + word
    both = lambda x: np.concatenate([x, x[twice]])
    return both(pair), both(box), both(h).astype(np.uint64), (sides == 1).sum(2)


def test_chains_hold_as_in_the_definition():
    rng = np.random.default_rng(0)
    for m in (1, 5, 16):
        pair, box, h, apart = ring_rows(rng, 300, m)
        boxes, left = np.full(300, m), rng.integers(0, 8 * m, 300)
        holds = np.array([[all(sum(np.roll(a, -i)[:k]) * m <= k * b for k in range(1, m + 1)) for i in range(m)] for a, b in zip(apart, left, strict=True)])
        got, compared = bx.chains(pair, box, h, boxes, np.zeros(300, np.int64), np.ones(300, bool), left, 1)
        assert set(got) == set(np.flatnonzero(holds.any(1))) == set(np.flatnonzero(apart.sum(1) <= left)) and 300 <= compared <= 600 * m
        start = rng.integers(0, m, 300)
        got, _ = bx.chains(pair, box, h, boxes, start, np.zeros(300, bool), left, 1)
        assert set(got) == set(np.flatnonzero(holds[np.arange(300), start]))


def test_turned_rings():
    rng = random.Random(1)
    for width in (1, 7, 63, 64, 65, 119, 128):
        rows = [(rng.getrandbits(width), rng.randrange(width)) for _ in range(40)]
        low, high = (np.array([v >> s & (1 << 64) - 1 for v, _ in rows], np.uint64) for s in (0, 64))
        a, b = bx.turned(low, high, np.array([t for _, t in rows]), width)
        assert [x | y << 64 for x, y in zip(a.tolist(), b.tolist(), strict=True)] == [(v >> t | v << (width - t)) & (1 << width) - 1 for v, t in rows]


def test_few_words_are_frequent(spark):
    sets = [(k, {k % 7, 100 + k % 50, 1000 + k}) for k in range(400)]
    order = bx.word_order(sets_frame(spark, sets), "words", Scratch(spark, "t"))
    assert order.limit == bx.LEAST and len(order.known) == 7
    assert bx.word_order(sets_frame(spark, sets), "words", Scratch(spark, "t"), frequent=16).limit == 75 and sorted(order.place) == list(range(7))


def test_banded_distance():
    rng = random.Random(3)
    a = [sorted(rng.sample(range(30), rng.randint(0, 15))) for _ in range(60)]
    b = [sorted(rng.sample(range(30), rng.randint(0, 15))) for _ in range(60)]
    flat = lambda rows: (np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.array([x for r in rows for x in r], np.uint64))
    most = np.array([rng.randint(0, 12) for _ in a])
    got = overlap.banded_distance(*flat(a), *flat(b), most)
    for x, y, k, d in zip(a, b, most, got, strict=True):
        true = len(set(x) ^ set(y))
        assert (d == true) if true <= k else d > k


TASK = "task_id string, split string, user_request string, setup_files map<string,string>, accepted_commands array<string>, provenance struct<template_family:string>, id long, words string, held string, d0 int"


def tasks(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], TASK)


LONG = " ".join(f"w{k}" for k in range(6000))
TASKS = [
    ("a", "train", "sort the log by date and time", {"f": "x1 x2 x3 x4 x5 x6 x7"}, ["sort ./f", None], ("Fam-A",)),
    ("a", "train", "sort the log by date and time", {"f": "x1 x2 x3 x4 x5 x6 x7"}, ["sort ./f", None], ("Fam-A",)),
    ("b", " TEST", "sort the log by date and time", {"g": "x7 x6 x5 x4 x3 x2", "h": "x1"}, ["$ sort './f' ;"], (None,)),
    ("c", "dev", "sort the log by date", {"g": "x1 x2 x3 x4 x5 x6 q"}, ["# note\n> sort  ./f"], ("unknown",)),
    ("d", "Training", None, None, None, None),
    ("e", None, "sort the log by date and time", {"f": "x1 x2 x3 x4 x5 x6 x7"}, [], ("fam a",)),
    (None, "train", "sort the log by date and time", {"f": "x1 x2 x3 x4 x5 x6 x7"}, [], ("fam a",)),
    ("f", "test", "", {}, ["ls"], ("N/A",)),
    ("g", "train", LONG, {"f": LONG}, ["x"], ("big",)),
    ("h", "test", LONG + " end", {"f": None, "g": LONG}, ["ls"], ("big",)),
]


def test_cross_split_pairs(spark, words_of):
    got = {tuple(r) for r in overlap.cross_split_pairs(tasks(spark, TASKS)).collect()}
    assert got == {("b", "a"), ("c", "a"), ("h", "g")}
    sft = spark.createDataFrame([("b", "Fam B"), ("b", None), (None, "x")], "task_id string, template_family string")
    report = {(r["split"], r["template_family"]): r["n_pairs"] for r in overlap.overlap_report(tasks(spark, TASKS), sft).collect()}
    assert report == {("test", "famb"): 1, ("validation", "none"): 1, ("test", "none"): 1}
    rows = overlap.overlap_classes(tasks(spark, TASKS)).collect()
    assert {r["task_id"]: (r["class_id"], r["held"], r["n_links"], r["n_tasks"]) for r in rows} == {"a": ("a", False, 2, 2), "b": ("a", True, 1, 1), "c": ("c", True, 1, 1), "g": ("g", False, 1, 1), "h": ("h", True, 1, 1)}


def test_near_pairs_and_groups(spark, words_of):
    once = {r[0]: r for r in TASKS if r[0]}
    sets = {t: words_of(r[2]) | set().union(*[words_of(c) for c in r[4] or []]) for t, r in once.items()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in neardup.near_pairs(tasks(spark, TASKS)).collect()} == want
    rows = neardup.near_groups(tasks(spark, TASKS)).collect()
    groups = {r["task_id"]: r["group_id"] for r in rows}
    assert {r["task_id"]: r["class_id"] for r in rows} == {t: min(x for x in sets if sets[x] == s) for t, s in sets.items() if s}
    assert {r["task_id"]: r["n_links"] for r in rows if r["task_id"] in "abc"} == {t: len({frozenset(sets[x]) for p in want if t in p for x in p if sets[x] != sets[t]}) for t in "abc"}
    assert set(groups) == {t for t, s in sets.items() if s}
    assert all(groups[a] == groups[b] for a, b in want) and groups["h"] == "g"


def components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for n, k in links:
        root[find("k" + k)] = find("n" + n)
    out = defaultdict(set)
    for n, _ in links:
        out[find("n" + n)].add(n)
    return {frozenset(v) for v in out.values() if len(v) > 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_spanning_forest(spark, seed):
    rng = random.Random(seed)
    links = [(f"{rng.randint(0, 150):03d}", f"{rng.randint(0, 120)}") for _ in range(170)] + [(f"{k:03d}", f"chain{k // 2}") for k in range(300, 340)] + [(f"{k:03d}", f"chain{(k + 1) // 2}") for k in range(300, 340)] + [(f"{k:03d}", "hot") for k in range(400, 480)]
    df = spark.createDataFrame(links + [(None, "hot"), ("400", None)], "node string, key string")
    got = splits.spanning_forest(df, "node", "key")
    groups = defaultdict(set)
    for r in got.roots.collect():
        groups[r["root"]].add(r["node"])
    assert {frozenset(v) for v in groups.values()} == components(links)
    forest = got.forest.collect()
    assert len(forest) == sum(len(v) - 1 for v in groups.values()) and len(components([(n, f"{k}") for k, r in enumerate(forest) for n in (r["a"], r["b"])])) == len(groups)
    own = set(links)
    assert all((r["a"], r["key"]) in own and (r["b"], r["key"]) in own for r in forest)


def test_splits_keep_groups_and_proportions(spark):
    rng = random.Random(5)
    sizes = [300, 120, 40] + [rng.choice([1, 1, 1, 2, 3, 5]) for _ in range(1500)]
    df = spark.createDataFrame([(f"g{k}", n) for k, n in enumerate(sizes)], "g string, n long")
    got = {r["g"]: r["split"] for r in splits.deal(df, "g", "n", {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert len(got) == len(sizes)
    share = Counter()
    for k, n in enumerate(sizes):
        share[got[f"g{k}"]] += n / sum(sizes)
    assert all(abs(share[s] - x) * sum(sizes) <= 1 for s, x in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
    again = {r["g"]: r["split"] for r in splits.deal(df.repartition(7), "g", "n", {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert Counter(again.values()) == Counter(got.values())


def test_task_groups(spark):
    got = {r["task_id"]: (r["group_id"], r["group_size"]) for r in splits.split_tasks(tasks(spark, TASKS)).collect()}
    assert got["a"] == got["b"] == got["c"] == got["e"] == ("a", 4)
    assert got["d"] == ("d", 1) and got["f"] == ("f", 1) and got["g"] == got["h"] == ("g", 2)
    of = defaultdict(set)
    for r in splits.split_tasks(tasks(spark, TASKS)).collect():
        of[r["group_id"]].add(r["split"])
    assert all(len(s) == 1 for s in of.values())


def test_command_key(spark):
    cases = {"$ $ ls ./a": "ls./a", "```bash\nls ./a\n```": "ls./a", " # x\nls './a' ;;": "ls./a", "echo a > ./a": "echoa>./a", "ls": None, None: None, "": None}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, c string")
    assert [r[0] for r in df.orderBy("i").select(splits.command_key(F.col("c"))).collect()] == list(cases.values())


VERDICT = "candidate_id long, task_id string, recorded_at timestamp_ntz, verdict struct<passed:boolean,forbidden_side_effect:boolean,postconditions_passed:double>, judge_votes map<string,struct<semantically_correct:boolean>>, rank string, said string"


def candidate_rows():
    from datetime import datetime

    at = datetime(2025, 1, 1)
    rng = random.Random(1)
    rows = []
    for k in range(400):
        task = rng.choice(["hot"] * 5 + [" HOT\t", "b", "c", None, f"t{k % 40}"])
        verdict = rng.choice([None, (True, None, 0.5), (True, False, float("nan"))] + [(True, rng.random() < 0.3, rng.choice([0.5, 1.0, 1 / 3]))] * 6)
        rows.append((k, task, at.replace(second=k % 60), verdict, None, "x", "y"))
        if k % 9 == 0:
            rows.append((k, task, at.replace(hour=1), (False, True, 0.1), None, "x", "y"))
        if k % 11 == 0:
            rows.append(rows[-1])
    rows.append((None, "b", at, (True, False, 1.0), None, "x", "y"))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_best_candidates(spark, parts):
    rows = candidate_rows()
    held = {}
    for r in rows:
        if r[0] is not None and (r[0] not in held or r[2] >= held[r[0]][2]):
            held[r[0]] = r
    by = defaultdict(list)
    for cid, task, _, v, *_ in held.values():
        if task is not None and v and v[1] is not None and not math.isnan(v[2]):
            by[task.strip().lower()].append((v[1], -v[2], cid))
    want = {(t, x[2]) for t, xs in by.items() for x in sorted(xs)[:3]}
    df = spark.createDataFrame(rows, VERDICT).repartition(parts)
    got = [(r["task_id"], r["candidate_id"]) for r in topn.best_candidates(df).collect()]
    assert set(got) == want and len(got) == len(want)


def votes_frame(spark, n=600, seed=2):
    rng = random.Random(seed)
    skill = {"good1": (0.95, 0.95), "good2": (0.9, 0.92), "good3": (0.9, 0.9), "yes": (0.97, 0.1), "no": (0.1, 0.97), "coin": (0.5, 0.5), "liar": (0.1, 0.1)}
    rows, truth = [], {}
    for k in range(n):
        truth[k] = rng.random() < 0.55
        voters = rng.sample(sorted(skill), rng.randint(3, 6))
        said = {j: (rng.random() < skill[j][0]) if truth[k] else (rng.random() >= skill[j][1]) for j in voters}
        rows.append((k, sorted(f"{j}={int(v)}" for j, v in said.items()), "clash"))
    return spark.createDataFrame(rows, "item long, pattern array<string>, score string"), truth


def test_consensus_finds_labels_and_reliability(spark):
    df, truth = votes_frame(spark)
    done = cs.consensus(df)
    items = done.items.collect()
    right = sum(r["consensus"] == truth[r["item"]] for r in items)
    majority = sum((r["n_yes"] * 2 > r["n_votes"]) == truth[r["item"]] for r in items)
    assert len(items) == len(truth) and right > 0.92 * len(truth) and right > majority
    weight = {r["annotator"]: r["reliability"] for r in done.annotators.collect()}
    assert weight["liar"] < 0.35 and abs(weight["coin"] - 0.5) < 0.12 and weight["good1"] > 0.8 and abs(weight["yes"] - 0.5) < 0.15
    assert done.converged and 1 < done.rounds < 60 and not cs.consensus(df, rounds=1).converged
    joined = cs.consensus(df, annotators_sent=3)
    assert joined.converged
    a, b = ({r["item"]: (r["consensus"], round(r["score"], 3)) for r in x.items.collect()} for x in (done, joined))
    assert a == b


def test_alpha(spark):
    rows = [(0, ["a=1", "b=1"]), (1, ["a=0", "b=0"]), (2, ["a=1", "b=0"]), (3, ["a=1"]), (4, [])]
    r = cs.consensus(spark.createDataFrame(rows, "item long, pattern array<string>")).overall.first()
    # three pairs: observed disagreement 2 of 6 ratings, expected 2*3*3/5
    assert r["items"] == 3 and r["alpha"] == pytest.approx(1 - 2 / (2 * 3 * 3 / 5))


def test_usable_votes(spark):
    df = spark.createDataFrame([({" Mica ": (True,), "mica": (True,), "tuff": (None,), "chert": (False,), "x": (True,), "X": (False,), "z": None},), (None,), ({},)], "v map<string,struct<semantically_correct:boolean>>")
    assert [r[0] for r in df.select(cs.usable_votes(F.col("v"))).collect()] == [["chert=0", "mica=1"], [], []]


def test_packing_limits_and_fill():
    rng = np.random.default_rng(4)
    need = np.stack([rng.integers(1, 900, 800), np.ones(800, int), rng.integers(0, 300, 800)], 1)
    capacity = np.array([1000, 6, 400])
    bins = packing.pack_block(need, capacity)
    used = np.zeros((bins.max() + 1, 3), int)
    np.add.at(used, bins, need)
    assert (used <= capacity).all() and len(used) <= 1.1 * max(np.ceil(need.sum(0) / capacity)) + 1


def test_pack_whole_items(spark):
    rows = [(k, n, n // 2) for k, n in enumerate([5, 10, 25, 30, 1, 0, 9, 9, 2])]
    got = packing.pack(spark.createDataFrame(rows, "k long, tokens long, loss long"), "k", 10, 3, 10).collect()
    by, of = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["sequence"]].append(r)
        of[r["k"]].append(r)
    assert all(sum(r["tokens"] for r in v) <= 10 and len(v) <= 3 for v in by.values())
    for k, n, loss in rows:
        assert sum(r["tokens"] for r in of[k]) == n and sum(r["loss"] for r in of[k]) == (loss if n else 0)
        assert len(of[k]) == (1 if 0 < n <= 10 else math.ceil(n / 10))


def test_all_limits_of_packing_bind(spark):
    """Records of three kinds, each short of another thing, fill bins up to each of the limits; buckets make the result the same on any partitioning."""
    rng = random.Random(6)
    rows = [(k, *rng.choice([(rng.randint(300, 900), 5), (rng.randint(5, 20), 2), (rng.randint(60, 120), 55)])) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, tokens long, loss long")
    got = packing.pack(df, "k", 1000, 12, 260).collect()
    used = defaultdict(lambda: np.zeros(3, int))
    for r in got:
        used[r["sequence"]] += [r["tokens"], 1, r["loss"]]
    used = np.array(list(used.values()))
    assert (used <= [1000, 12, 260]).all() and ((used >= [980, 12, 220]).sum(0) > 5).all()
    again = packing.pack(df.repartition(7), "k", 1000, 12, 260).collect()
    assert {(r["k"], r["sequence"]) for r in got} == {(r["k"], r["sequence"]) for r in again}


def test_packing_goes_on_over_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    monkeypatch.setattr(packing, "BUCKET", 400)
    rng = random.Random(7)
    rows = [(k, rng.randint(1, 90), 0) for k in range(2100)]
    got = packing.pack(spark.createDataFrame(rows, "k long, tokens long, loss long"), "k", 100, 50, 100).collect()
    used = Counter()
    for r in got:
        used[r["sequence"]] += r["tokens"]
    assert len(got) == len(rows) and max(used.values()) <= 100 and sum(v < 98 for v in used.values()) < 0.12 * len(used)
    assert len({s >> 33 for s in used}) == 6


def test_pack_documents(spark):
    rows = [(1, "one two three", "x"), (2, None, "x"), (3, "", "x"), (None, "text", "x"), (4, "word " * 3000, "x"), (1, "one two three", "x")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, tokens string"), 512).collect()
    of = Counter()
    for r in got:
        of[r["doc_id"]] += r["tokens"]
    assert set(of) == {1, 4} and of[4] > 2900


def brute_leaks(docs, items, k):
    import re

    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {(d, i) for d, t in docs for i, s in items if d is not None and i is not None and grams(words(t)) & grams(words(s))}


@pytest.mark.parametrize("sent", [1 << 20, 3])
def test_leaks(spark, sent):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(n))
    items = [(k, text(30)) for k in range(12)] + [(None, "x"), (90, None), (91, "few words")]
    docs = [(k, text(40) + "; " + " ".join(rng.choice(items[:12])[1].upper().split()[3 : 3 + rng.randint(6, 16)]) + "\n" + text(10)) for k in range(60)]
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, LONG + " " + items[1][1])]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i, 10, seeds_sent=sent).collect()}
    assert got == brute_leaks(docs, items, 10) and got


def test_report_finds_short_pieces_in_another_order(spark, tmp_path):
    item = [f"w{k}" for k in range(36)]
    pieces = [item[k : k + 6] for k in range(0, 36, 6)]
    whole, half, less = pieces[::-1], pieces[2::-1], pieces[1::-1]
    docs = [(k, " x y ".join(" ".join(p) for p in own)) for k, own in enumerate((whole, half, less))]
    docs.append((3, "z a b c d e f z " * 6))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(item)), (8, "a b c d e f " * 6)], "item_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    i.write.parquet(f"{tmp_path}/heldout_items.parquet")
    want = {(0, 7): (36, 6, 1.0), (1, 7): (18, 6, 0.5), (3, 8): (36, 6, 1.0)}
    for found in (queries.p7_report(spark, str(tmp_path)), leaks.leaks(d, i, 5, 0.5, seeds_sent=3)):
        assert {(r["doc_id"], r["item_id"]): (r["covered"], r["longest"], r["coverage"]) for r in found.collect()} == want


def test_tiles_catch_reordered_passages():
    test = np.arange(40, dtype=np.uint64)
    text = np.concatenate([[99], test[20:40], [98, 97], test[:20]]).astype(np.uint64)
    found = leaks.tiles(text, test, 5)
    assert sorted((y, n) for _, y, n in found) == [(0, 20), (20, 20)]
    assert leaks.tiles(text, np.arange(200, 240).astype(np.uint64), 5) == []
    assert leaks.tiles(text[:0], test, 5) == []


def test_hashed_words_agree_with_a_regex():
    import re

    texts = ["Ab  c1-d", None, "", "É naïve x", "a", "b a", "a" * 70000 + " z"]
    split, hashes = ws.hashed_words(pa.array([t.lower() if t else t for t in texts]))
    seen = {}
    for i, t in enumerate(texts):
        words = re.findall("[a-z0-9]+", (t or "").lower())
        own = hashes[split[i] : split[i + 1]]
        assert len(own) == len(words)
        for w, h in zip(words, own.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


PROSE = "It was the first time that any of them had seen the map, and the man who drew it was not in the room. She said that he would be back by the end of the week."


def test_quality(spark):
    common = [("en", w) for w in "a after all an and any are as at be before but by can could for from had has have he in into is it of on only or out she that the them then there they this to was were what when which who will with would".split()]
    prose = [PROSE.replace("map", f"map{k}") for k in range(60)]
    rng = random.Random(2)
    salad = " ".join(rng.choice([w for _, w in common] + ["pump", "valve", "crane", "belt"]) for _ in range(160)) + "."
    junk = {"list": "\n".join(f"- pump{k} valve crane" for k in range(30)), "table": "\n".join(f"{k} | {k * 7} | {k * 31}" for k in range(30)), "again": (PROSE.split(".")[0] + ". ") * 30, "symbols": "#%&/ ?? ++ **" * 20, "salad": salad}
    rows = list(enumerate(prose)) + [(1000 + k, t) for k, t in enumerate(junk.values())] + [(2000, None), (2001, " \n"), (2002, PROSE + "\n" + junk["list"]), (2003, (PROSE + "\n") * 4 + "a | b | 1")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, words string")
    got = {r["doc_id"]: r for r in quality.quality(docs, spark.createDataFrame(common + [(None, "x")], "lang string, word string")).collect()}
    assert all(got[k]["prose_share"] > 0.5 for k in range(60))
    for k, name in enumerate(junk):
        assert got[1000 + k]["prose_share"] < 0.5, name
    assert got[2000]["prose_share"] is None and got[2001]["profile"] == "blank" and got[2002]["prose_share"] < 0.5
    assert got[0]["words"] == len(prose[0].replace(",", "").replace(".", "").split()) and got[0]["language"] == "en"


def test_divergence_bounds():
    p, q = np.array([1.0, 0.0]), np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]])
    d = quality.divergence(p, q)
    assert d[0] == 0 and d[1] == pytest.approx(math.log(2)) and 0 < d[2] < d[1]


def test_common_words_late_in_a_long_list_count(spark):
    short = [("en", w) for w in "the and that was of in had it any them time week".split()] + [("de", w) for w in "der die das und".split()]
    long = short + [("en", f"aa{a}{b}") for a in "abcdefghijklmnop" for b in "abcdefghijklmnopqrst"]
    docs = spark.createDataFrame([(k, PROSE) for k in range(3)] + [(3, "der die das"), (4, None)], "doc_id long, text string")
    by = lambda rows: sorted(map(tuple, quality.quality(docs, spark.createDataFrame(rows, "lang string, word string")).collect()), key=str)
    assert by(long) == by(short)


def test_repetition_is_told_by_its_distance(spark):
    """One sentence or a long text over and over is no prose, however many different words it has; sentences that return now and then are."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    sentence = lambda: f"The {word()} of the {word()} was in the {word()} and it had a {word()} by the {word()}."
    pool = [sentence() for _ in range(40)]
    long = " ".join(sentence() for _ in range(30))
    texts = [pool[0] + " " + pool[1], (pool[0] + "\n") * 12, (long + " ") * 5, " ".join(rng.choice(pool) for _ in range(400)), long + " " + long]
    docs = spark.createDataFrame(list(enumerate(texts + [" ".join(rng.sample(pool, 9)) for _ in range(30)])), "doc_id long, text string")
    common = spark.createDataFrame([("en", w) for w in "the of was in and it had a by".split()], "lang string, word string")
    got = {r["doc_id"]: r["prose_share"] for r in quality.quality(docs, common).collect()}
    assert [got[k] < 0.5 for k in range(5)] == [False, True, True, False, False]


KINDS = {
    "list": lambda w: "\n".join(f"- {w()} {w()}" for _ in range(25)),
    "table": lambda w: "\n".join(f"{w():<15} {len(w()) * 377:>6} {w()}" for _ in range(25)),
    "pairs": lambda w: "\n".join(f"{w()}={len(w()) * 911}" for _ in range(25)),
    "log": lambda w: "\n".join(f"2025-01-{k + 1:02d}T10:{k:02d} INFO {w()}[{k * 131}] rc=0" for k in range(25)),
    "code": lambda w: "\n".join(f"if ({w()} != {k}) {{ {w()}[{k}] += {w()}; }}" for k in range(25)),
    "checksum": lambda w: "\n".join(f"{abs(hash(w())):032x}  {w()}" for _ in range(25)),
    "keywords": lambda w: ", ".join(w() for _ in range(80)),
    "symbols": lambda w: "#%& /?? ++* <>| ~^" * 20,
    "broken": lambda w: "".join("ÃŸ©° ™€" + w()[:2] for _ in range(60)),
}


def test_kinds_of_junk_on_held_out_texts(spark):
    """Profiles are fitted without labels; every kind must be found among prose in two languages."""
    rng = random.Random(11)
    common = {"en": "the of was in and it had a by that with for on not be".split(), "de": "der die das und nicht mit von zu den ein ist auf im dem war".split()}
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    follows = {lang: {w: rng.sample(own, 3) for w in own} for lang, own in common.items()}

    def prose(lang):
        out, last = [], rng.choice(common[lang])
        for k in range(110):
            out.append(last if k % 5 < 2 else word())
            last = rng.choice(follows[lang][last])
            if k % 11 == 10:
                out[-1] += "."
        return " ".join(out)

    salad = lambda lang: " ".join(rng.choice(common[lang]) if rng.random() < 0.4 else word() for _ in range(160)) + "."
    texts = [(prose("en"), None) for _ in range(60)] + [(prose("de"), None) for _ in range(40)]
    texts += [(make(word), kind) for kind, make in KINDS.items() for _ in range(6)] + [(salad(lang), "salad") for lang in common for _ in range(6)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    words = spark.createDataFrame([(lang, w) for lang, own in common.items() for w in own], "lang string, word string")
    got = {r["doc_id"]: r["prose_share"] < 0.5 for r in quality.quality(docs, words).collect()}
    recall = {kind: np.mean([got[k] for k, (_, x) in enumerate(texts) if x == kind]) for kind in [*KINDS, "salad"]}
    assert all(v == 1 for k, v in recall.items() if k != "salad") and recall["salad"] >= 0.9, recall
    assert np.mean([got[k] for k, (_, x) in enumerate(texts) if x is None]) <= 0.02
