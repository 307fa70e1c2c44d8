"""Screens, verification, admission, labels, folds, metrics on small fixtures."""

import hashlib
import json
import os
import random
import shutil
import subprocess
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tasklattice.operators import admit, folds, generate, labels, metrics, screen, verify
from tasklattice.sources import records
from tasklattice.streaming import stream


def test_screen_first_failure_wins(spark):
    ok = {"a.txt": "x"}
    rows = [
        (None, "a good request", ["ls", "ls -a"], "bad_setup_files"),
        ({f"f{k}": "x" for k in range(7)}, "a good request", ["ls", "ls -a"], "bad_setup_files"),
        ({"a": None}, "a good request", ["ls", "ls -a"], "bad_file_entry"),
        ({"/etc/x": "x"}, "short", ["ls", "ls -a"], "unsafe_path"),
        ({"a/../b": "x"}, "a good request", ["ls", "ls -a"], "unsafe_path"),
        ({"a": "x" * 20001}, "a good request", ["ls", "ls -a"], "file_too_large"),
        (ok, "x" * 9, ["ls", "ls -a"], "bad_request"),
        (ok, "x" * 401, ["ls", "ls -a"], "bad_request"),
        (ok, "x" * 400, ["ls", "ls -a"], None),
        (ok, "a good request", ["ls"], "needs_two_commands"),
        (ok, "a good request", ["ls", "$ ls"], "commands_not_distinct"),
        (ok, "a good request", ["ls", "sudo ls"], "dangerous_command"),
        (ok, "a good request", None, "needs_two_commands"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, files map<string,string>, request string, commands array<string>, want string")
    for r in df.withColumn("got", screen.task_screen(F.col("files"), F.col("request"), F.col("commands"))).collect():
        assert r["got"] == r["want"], r


def instances(spark, rows):
    return spark.createDataFrame([("t", k, *r) for k, r in enumerate(rows)], "task string, variant int, fraction double, forbidden boolean, reason string")


@pytest.mark.parametrize(
    "rows,passed,fraction,category",
    [
        ([(1.0, False, None)] * 4, True, 1.0, "none"),
        ([(1.0, False, None), (0.5, False, "stdout_mismatch"), (1.0, False, None), (1.0, False, None)], False, 0.875, "stdout_mismatch"),
        ([(0.5, False, "exit_code"), (0.5, False, "stdout_mismatch")], False, 0.5, "exit_code"),
        ([(0.5, False, "stdout_mismatch"), (1.0, True, None)], False, 0.75, "forbidden_side_effect"),
        ([(1.0, False, None), (0.0, False, None)], False, 0.5, "fixture_overfit"),
        ([(0.0, False, None), (0.5, False, "exit_code")], False, 0.25, "unknown"),
    ],
)
def test_verdict(spark, rows, passed, fraction, category):
    r = verify.reduce_verdicts(instances(spark, rows), ["task"], "variant").first()
    assert (r["passed"], r["postconditions_passed"], r["failure_category"]) == (passed, fraction, category)


EXECUTION = (
    "stdout string, exit_code int, timed_out boolean, files_added array<string>, files_removed array<string>, files_modified array<string>, observed_side_effects array<string>,"
    " forbidden_side_effects array<string>, file_hashes map<string,string>, oracle struct<stdout_exact:string,stdout_lines_unordered:array<string>,exit_code:int,filesystem_unchanged:boolean,expected_files:map<string,string>,absent_files:array<string>>"
)


def test_oracle_checks(spark):
    def row(stdout="a\n", code=0, late=False, modified=(), hashes=None, oracle=("a", None, 0, True, None, None), effects=()):
        return (stdout, code, late, [], [], list(modified), list(effects), ["network"], hashes or {}, oracle)

    cases = [
        (row(), 1.0, None, False),
        (row(stdout="b"), 2 / 3, "stdout_mismatch", False),
        (row(stdout="./y\nx\n", oracle=(None, ["x", "y"], 0, True, None, None)), 1.0, None, False),
        (row(code=1), 2 / 3, "exit_code", False),
        (row(late=True, code=None), 2 / 3, "timeout", False),
        (row(modified=["f"]), 2 / 3, "unexpected_filesystem_change", False),
        (row(modified=["f"], hashes={"f": "h"}, oracle=(None, None, 0, False, {"f": "h"}, ["g"])), 1.0, None, False),
        (row(hashes={"f": "other"}, oracle=(None, None, 0, False, {"f": "h"}, None)), 0.5, "wrong_file_content", False),
        (row(hashes={"f": "h", "e": "x"}, oracle=(None, None, 0, False, {"f": "h", "g": "h"}, ["d", "e"])), 3 / 5, "wrong_file_content", False),
        (row(stdout="b\r\n\t\n./a\u2028", oracle=(None, ["a", "b"], None, None, None, None)), 1.0, None, False),
        (row(hashes=None, oracle=(None, None, None, False, None, None)), 0.0, None, False),
        (row(hashes={"g": "h"}, oracle=(None, None, None, False, None, ["g"])), 0.0, "file_should_be_absent", False),
        (row(effects=["network"]), 1.0, None, True),
    ]
    df = spark.createDataFrame([c[0] for c in cases], EXECUTION).coalesce(1)
    for got, (_, fraction, reason, forbidden) in zip(verify.checked(df).collect(), cases, strict=True):
        assert got["fraction"] == pytest.approx(fraction) and got["reason"] == reason and got["forbidden"] == forbidden


def test_snapshot_diff(spark):
    before = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("d", None)], "path string, digest string")
    after = spark.createDataFrame([("b", "h3"), ("c", "h4"), ("d", None)], "path string, digest string")
    got = {r["path"]: r["change"] for r in verify.snapshot_diff(before, after, "path", "digest").collect()}
    assert got == {"a": "removed", "b": "modified", "c": "added"}


def test_derived_oracle_and_realised(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"})], "x map<string,string>, y map<string,string>")
    r = df.select(verify.derived_oracle(F.col("x"), F.col("y")).alias("o")).first()["o"]
    assert r["expected_files"] == {"b": "3", "c": "4"} and r["absent_files"] == ["a"]
    one = "struct<stdout:string,exit_code:int,timed_out:boolean,sandbox_error:string,files_added:array<string>,files_removed:array<string>,files_modified:array<string>,file_hashes:map<string,string>,observed_side_effects:array<string>>"
    run = lambda out="x", code=0, late=False, files=None: (out, code, late, None, [], [], [], files or {}, ["stdout"])
    cases = [(run(), run(), run(), None), (run(late=True), run(), run(), "primary_timeout_or_sandbox_error"), (run(code=1), run(), run(), "primary_nonzero_exit"), (run(out=" "), run(), run(), "primary_no_observable_effect"), (run(), run("y"), run(), "nondeterministic"), (run(), run(), run("y"), "commands_disagree_stdout"), (run(), run(), run(files={"f": "1"}), "commands_disagree_filesystem")]
    df = spark.createDataFrame(cases, f"a {one}, again {one}, b {one}, want string")
    for r in df.withColumn("got", verify.realised(F.col("a"), F.col("again"), F.col("b"), F.array(F.lit("network")))).collect():
        assert r["got"] == r["want"]


def test_execution_is_refused():
    with pytest.raises(RuntimeError):
        verify.execute("ls")


ADMIT = [(1, "a", "r1", "s1"), (2, "b", "r2", "s1"), (3, "c", "r2", "s2"), (4, "a", "r9", "s3")]


def test_admission_set_based_and_exact(spark):
    df = spark.createDataFrame(ADMIT, "seq int, id string, request string, shape string")
    by_set = {r["seq"]: r["reason"] for r in admit.admission(df, "id", "request", "shape", ["seq"], 1).collect()}
    assert by_set == {1: "ok", 2: "signature_capped", 3: "duplicate_request", 4: "duplicate_task_id"}
    exact = {r["seq"]: r["reason"] for r in admit.admit_exact(df, "id", "request", "shape", "seq", 1).collect()}
    assert exact == {1: "ok", 2: "signature_capped", 3: "ok", 4: "duplicate_task_id"}


def test_admission_edges(spark):
    df = spark.createDataFrame([(1, None, "r", "s"), (2, "a", None, None), (3, "b", None, None)], "seq int, id string, request string, shape string")
    got = {r["seq"]: r["reason"] for r in admit.admission(df, "id", "request", "shape", ["seq"], 5).collect()}
    assert got == {1: "missing_id", 2: "ok", 3: "ok"}
    assert admit.admission(df.limit(0), "id", "request", "shape", ["seq"], 5).count() == 0


def test_quota(spark):
    df = spark.createDataFrame([(a, k) for a in "xyz" for k in range(10)], "author string, k int")
    got = {r["author"]: r["count"] for r in admit.quota(df, "author", ["k"], 8, df).groupBy("author").count().collect()}
    assert got == {"x": 3, "y": 3, "z": 2}


CAND = "task_id string, candidate_id long, command string, passed boolean, fraction double, forbidden boolean"


def test_labels(spark):
    rows = [("t", 0, "123456789", True, 1.0, False), ("t", 1, "1234567", True, 1.0, False), ("t", 2, "7654321", True, 1.0, False), ("t", 3, "", False, 0.5, True), ("t", 4, "n1", False, 0.9, False), ("t", 5, "1234567", False, 0.8, False), ("t", 6, "n2", False, 0.7, False), ("u", 7, "n", False, 0.1, False)]
    df = spark.createDataFrame(rows, CAND)
    assert [r["chosen"] for r in labels.best_positive(df).collect()] == ["1234567"]
    assert [(r["candidate_id"], r["rejected"]) for r in labels.preference_pairs(df).collect()] == [(4, "n1")]
    assert [r["command"] for r in labels.shortest_distinct(df).orderBy("ordinal").collect()] == ["1234567", "7654321", "123456789"]


def test_sft_rows_keep_first_occurrence(spark):
    df = spark.createDataFrame([("t", "r", ["b", "a", "b", None], ("fam",))], "task_id string, user_request string, accepted_commands array<string>, provenance struct<template_family:string>")
    rows = labels.sft_rows(df).orderBy("position").collect()
    assert [r["command"] for r in rows] == ["b", "a"]
    assert [m["role"] for m in rows[0]["messages"]] == ["system", "user", "assistant"]
    back = labels.prompt_and_answer(labels.sft_rows(df), ["position"]).orderBy("position").collect()
    assert back[0]["answer"] == "b" and back[0]["prompt"].endswith("\nr")


def test_group_folds(spark, monkeypatch):
    sizes = [9, 7, 7, 5, 4, 4, 3, 2, 1, 1]
    df = spark.createDataFrame([(f"g{k}",) for k, n in enumerate(sizes) for _ in range(n)], "g string")
    got = folds.group_folds(df, "g", 3).collect()
    loads = [sum(r["size"] for r in got if r["fold"] == f) for f in range(3)]
    assert sorted(loads, reverse=True) == [15, 14, 14]
    rng = random.Random(3)
    many = spark.createDataFrame([(f"g{k:03d}",) for k in range(120) for _ in range(rng.choice([1, 1, 1, 2, 2, 5, 9]))], "g string")
    by = [{(r["g"], r["size"], r["fold"]) for r in folds.group_folds(x, "g", 4).collect()} for x in (df, many)]
    monkeypatch.setattr(folds, "IN_ARRAY", 1)
    assert by == [{(r["g"], r["size"], r["fold"]) for r in folds.group_folds(x, "g", 4).collect()} for x in (df, many)]
    two = spark.createDataFrame([("a",), ("b",)], "g string")
    assert {r["fold"] for r in folds.group_folds(two, "g", 5).collect()} == {0, 1}
    with pytest.raises(ValueError):
        folds.group_folds(two.where("g = 'a'"), "g", 2)


def test_no_leak_between_folds(spark):
    df = spark.createDataFrame([(f"g{k % 7}", "fam") for k in range(50)], "g string, family string")
    f = folds.group_folds(df, "g", 3)
    assert folds.leaked(df, f, "g", "g").first()["n_leaked"] == 0
    assert folds.leaked(df, f, "g", "family").first()["n_leaked"] > 0


@pytest.mark.parametrize("n,p50,p95", [(1, 1, 1), (2, 1, 2), (4, 3, 4), (20, 11, 19), (21, 11, 20)])
def test_nearest_rank(spark, n, p50, p95):
    df = spark.createDataFrame([("x", float(k)) for k in range(1, n + 1)], "g string, v double")
    assert tuple(metrics.nearest_rank_by(df, "g", "v", {"a": 0.5, "b": 0.95}).first())[1:] == (p50, p95)


def test_confusion_adds_up(spark):
    df = spark.createDataFrame([("j", True, True), ("j", True, False), ("j", False, True), ("j", False, False)], "judge string, a boolean, b boolean")
    r = metrics.confusion(df, "judge", "a", "b").first()
    assert (r["n"], r["agree"], r["false_positive"], r["false_negative"], r["agreement"]) == (4, 2, 1, 1, 0.5)


def test_generated_tasks_are_reproducible(spark):
    a = sorted(map(str, generate.generate_tasks(spark, 2, 3).collect()))
    b = sorted(map(str, generate.generate_tasks(spark, 2, 3).collect()))
    assert a == b and len(a) == 2 * 10 * 3
    turn = generate.round_robin(spark, 23).collect()
    assert len(turn) == 23 and sorted(Counter(r["family"] for r in turn).values()) == [2] * 7 + [3] * 3 and len({r["task_id"] for r in turn}) == 23


@pytest.mark.skipif(not all(map(shutil.which, ("bash", "awk", "sed", "find", "perl"))), reason="no shell tools")
def test_both_commands_of_generated_tasks_meet_the_oracle(spark, tmp_path):
    """The commands are this library's own; they run in a folder of their own."""
    rows = generate.generate_tasks(spark, 3, 2).collect()
    runs = []
    for k, r in enumerate(rows):
        for j, command in enumerate(r["accepted_commands"]):
            where = tmp_path / f"{k}-{j}"
            for path, content in r["setup_files"].items():
                (where / path).parent.mkdir(parents=True, exist_ok=True)
                (where / path).write_text(content)
            done = subprocess.run(["bash", "-c", command], cwd=where, capture_output=True, text=True, timeout=20, env={"PATH": os.environ["PATH"], "LC_ALL": "C"})
            changed = [p for p, c in r["setup_files"].items() if (where / p).read_text() != c]
            hashes = {p: hashlib.sha256((where / p).read_bytes()).hexdigest() for p in r["setup_files"]}
            runs.append((r["task_id"], j, done.stdout, done.returncode, False, [], [], changed, [], [], hashes, tuple(r["oracle"])))
    df = spark.createDataFrame(runs, "task_id string, position int, " + EXECUTION)
    verdicts = verify.reduce_verdicts(verify.checked(df), ["task_id", "position"], "position")
    bad = [r for r in verify.valid_tasks(verdicts).collect() if not r["valid"]]
    assert not bad and verdicts.count() == len(rows) * 2
    screened = generate.generate_tasks(spark, 3, 2).select(screen.task_screen(F.col("setup_files"), F.col("user_request"), F.col("accepted_commands")).alias("r"))
    assert screened.where("r is not null").count() == 0


def test_json_round_trip(spark, tmp_path):
    path = tmp_path / "tasks.jsonl"
    path.write_text(json.dumps({"task_id": "b", "user_request": "r", "setup_files": {"f": "x"}}) + "\n\n" + json.dumps({"task_id": "a", "risk_class": "local_write"}) + "\n")
    rows = {r["task_id"]: r for r in records.read_tasks(spark, str(path)).collect()}
    assert rows["b"]["setup_dirs"] == [] and rows["b"]["oracle"]["absent_files"] == [] and rows["b"]["oracle"]["filesystem_unchanged"] and rows["a"]["setup_files"] == {}
    assert rows["b"]["shell_profile"] == "bash" and rows["b"]["allowed_side_effects"] == ["stdout"] and rows["a"]["risk_class"] == "local_write"
    out = str(tmp_path / "out")
    records.write_jsonl(records.read_tasks(spark, str(path)), out)
    assert records.read_tasks(spark, out).count() == 2
    records.write_partitioned(records.read_tasks(spark, str(path)).select("task_id", "risk_class"), str(tmp_path / "parts"), "risk_class")
    assert {d for d in os.listdir(tmp_path / "parts") if "=" in d} == {"risk_class=read_only", "risk_class=local_write"}


def test_snapshot_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f").write_text("x")
    rows = records.snapshot(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["digest"] == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


def test_published_totals():
    kept = {"ok": 10739, "disagree": 3657, "nonzero": 885, "no_effect": 498, "unparseable": 158, "syntax": 106, "filesystem": 90, "timeout": 17, "nondeterministic": 16, "not_distinct": 5, "files": 4, "two": 4}
    assert sum(kept.values()) == 16179 and kept["ok"] == 9000 + 1678 + 61 and round(9000 / 16179, 3) == 0.556


def test_forms_of_admission_agree_on_empty_requests(spark, tmp_path):
    kinds = "id string, request string, shape string, seq string"
    first = [("a", None, "s", "1"), ("b", "", "s", "2"), ("c", None, "s", "3"), ("d", "", "t", "4"), ("e", "r", "t", "5")]
    second = [("f", None, "t", "6"), ("g", "", "t", "7"), ("h", "r", "t", "8"), ("a", "", "t", "9")]
    (tmp_path / "in").mkdir()
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{tmp_path}/{k}")
        part = next((tmp_path / str(k)).glob("part-*.parquet"))
        os.utime(part, (1000 + k, 1000 + k))
        part.rename(tmp_path / "in" / f"{k}.parquet")
    df = spark.createDataFrame(first + second, kinds)
    want = {"1": "ok", "2": "ok", "3": "ok", "4": "ok", "5": "ok", "6": "ok", "7": "ok", "8": "duplicate_request", "9": "duplicate_task_id"}
    assert {r["seq"]: r["reason"] for r in admit.admission(df, "id", "request", "shape", ["seq"], 9).collect()} == want
    assert {r["seq"]: r["reason"] for r in admit.admit_exact(df, "id", "request", "shape", "seq", 9).collect()} == want
    assert {r["seq"]: r["reason"] for r in stream.admitted(spark, f"{tmp_path}/in", kinds, "id", "request", "shape", ["seq"], 9).collect()} == want


def test_stream_goes_on_after_a_crash(spark, tmp_path):
    """Files come bit by bit, a run loses its last commit, and the outcome is that of one admission over all rows."""
    kinds = "id string, request string, shape string, seq string"
    rng = random.Random(4)
    rows = [(rng.choice([f"i{rng.randint(0, 99)}"] * 9 + [None]), rng.choice(["", None, f"r{rng.randint(0, 9)}", f"q{k}"]), rng.choice(["hot", "hot", None, f"s{k % 9}"]), f"{k:04d}") for k in range(90)]
    (tmp_path / "in").mkdir()

    def arrive(k):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], kinds).coalesce(1).write.parquet(f"{tmp_path}/{k}")
        part = next((tmp_path / str(k)).glob("part-*.parquet"))
        os.utime(part, (1000 + k, 1000 + k))
        part.rename(tmp_path / "in" / f"{k}.parquet")

    run = lambda: stream.admitted(spark, f"{tmp_path}/in", kinds, "id", "request", "shape", ["seq"], 12, work=f"{tmp_path}/work")
    arrive(0)
    run()
    for name in ("ids", "shapes"):
        commits = tmp_path / "work" / f"{name}-state" / "commits"
        last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
        (commits / str(last)).unlink()
        (commits / f".{last}.crc").unlink(missing_ok=True)
    arrive(1)
    run()
    arrive(2)
    got = {r["seq"]: r["reason"] for r in run().collect()}
    want = admit.admission(spark.createDataFrame(rows, kinds), "id", "request", "shape", ["seq"], 12)
    assert got == {r["seq"]: r["reason"] for r in want.collect()} and len(got) == len(rows) and len(set(got.values())) == 5


def test_windows_are_resumed_and_closed(spark, tmp_path):
    from datetime import datetime, timedelta

    at = datetime(2025, 1, 1)
    spark.createDataFrame([(at + timedelta(minutes=20 * k), 1, float(k)) for k in range(12)], "ts timestamp, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/e.parquet")
    open_ = stream.windowed(spark, f"{tmp_path}/e.parquet", "tumbling", f"{tmp_path}/open", close=False)
    assert {r["starts"][11:13]: r["n"] for r in open_.collect()} == {"00": 3, "01": 3}
    again = stream.windowed(spark, f"{tmp_path}/e.parquet", "tumbling", f"{tmp_path}/open", close=False)
    assert again.count() == 2
    closed = stream.windowed(spark, f"{tmp_path}/e.parquet", "tumbling", f"{tmp_path}/closed")
    assert {r["starts"][11:13]: r["n"] for r in closed.collect()} == {"00": 3, "01": 3, "02": 3, "03": 3}


def test_anchors_come_first(spark):
    rows = [(1, "a", "r", "s", False), (2, "b", "r", "s", True), (3, "c", "r2", "s", False), (4, "d", "r2", "t", True), (5, "e", "r3", "s", True), (6, "a", "r9", "t", True)]
    df = spark.createDataFrame(rows, "seq int, id string, request string, shape string, fixed boolean")
    got = {r["seq"]: r["reason"] for r in admit.admission(df, "id", "request", "shape", ["seq"], 2, None, F.col("fixed")).collect()}
    assert got == {1: "duplicate_task_id", 2: "ok", 3: "signature_capped", 4: "ok", 5: "ok", 6: "ok"}


def test_first_within_hot_groups_and_ties(spark):
    from tasklattice.operators import ranks

    rows = [("hot", k // 2) for k in range(400)] + [("x", 1), ("x", 1), (None, 0)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(5)
    got = ranks.within_first(df, F.col("g"), ["k"], 7, "in").where("in").collect()
    assert Counter((r["g"], r["k"]) for r in got) == Counter([("hot", 0)] * 2 + [("hot", 1)] * 2 + [("hot", 2)] * 2 + [("hot", 3), ("x", 1), ("x", 1)])
    named = df.withColumn("most", F.when(F.col("g") == "hot", 3).otherwise(1))
    assert Counter(r["g"] for r in ranks.within_first(named, F.col("g"), ["k"], "most", "in").where("in").collect()) == {"hot": 3, "x": 1}
    sums = ranks.running(df.dropDuplicates(), "g", ["k"], F.col("k").cast("long"), "upto").collect()
    assert all(r["upto"] == r["k"] * (r["k"] + 1) // 2 for r in sums) and len(sums) == 201
    assert ranks.within_first(df.limit(0), F.col("g"), ["k"], 1, "in").count() == 0


def test_quota_with_ceiling(spark):
    df = spark.createDataFrame([(a, k, k % 3 == 0) for a in "xy" for k in range(30)], "author string, k int, ok boolean")
    got = admit.quota_with_ceiling(df, "author", ["k"], F.col("ok"), 8, df, 2.0, 8).collect()
    assert sorted((r["author"], r["k"]) for r in got) == [(a, k) for a in "xy" for k in (0, 3, 6)]


def test_small_helpers(spark):
    from tasklattice.functions import text as tx

    assert tx.fold_numbers("all", 3) == [0, 1, 2] and tx.fold_numbers("0, 2", 3) == [0, 2]
    with pytest.raises(ValueError):
        tx.fold_numbers("3", 3)
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    with pytest.raises(ValueError, match="z"):
        screen.require_known(df, "k", spark.createDataFrame([("a",)], "k string"))
    assert screen.require_known(df, "k", df) is df
    one = spark.createDataFrame([(5, 9, 20), (0, 0, 0), (12, 40, 20)], "p long, n long, x int").select(labels.response_mask(F.col("p"), F.col("n"), 20, 8).alias("m")).collect()
    assert [(len(r["m"]), [k for k, x in enumerate(r["m"]) if x]) for r in one] == [(16, [5, 6, 7, 8]), (0, []), (24, list(range(12, 20)))]
    given = spark.createDataFrame([("```shell\nls a\n```",), ("# list\nls",), ("$ ls",), ("",)], "c string").select(tx.clean_command_as_given(F.col("c")).alias("c")).collect()
    assert [r["c"] for r in given] == ["ell", "list", "ls", ""]
    parsed = spark.createDataFrame([("ls | wc",), ("ls 'a",), (None,), (" ",), ("if x; then",)], "c string").select(screen.parses(F.col("c")).alias("p")).collect()
    assert [r["p"] for r in parsed] == [True, False, False, False, False]


def test_sinks_share_one_computation(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.rand(3))
    records.write_all(df, {f"{tmp_path}/a": lambda d: d.where("id < 2"), f"{tmp_path}/b": lambda d: d.groupBy().count()})
    assert spark.read.parquet(f"{tmp_path}/a").count() == 2 and spark.read.parquet(f"{tmp_path}/b").first()[0] == 5
    records.write_summary(spark.range(1).withColumn("m", F.create_map(F.lit("k"), F.lit(1))), f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s").first()["m"]["k"] == 1
    (tmp_path / "runs" / "a").mkdir(parents=True)
    (tmp_path / "runs" / "a" / "run_meta.json").write_text(json.dumps({"student": "m", "fold": 0, "n_train_rows": 3}))
    known = spark.createDataFrame([("m", 0), ("m", 1)], "student string, fold int")
    assert {(r["fold"], r["state"]) for r in records.finished_runs(spark, f"{tmp_path}/runs/*/run_meta.json", known).collect()} == {(0, "done"), (1, "missing")}
