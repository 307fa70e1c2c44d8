"""Every query of the core against its SQL on the smallest tables, and the shape of plans."""

import hashlib
import math
import os

import duckdb
import pytest

from tasklattice.plans import catalog, verdicts  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if type(v).__name__ == "Decimal":
        v = float(v) if v != int(v) else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()]
    if name not in catalog.SQL:
        assert rows
        return
    cur = duck.execute(catalog.SQL[name])
    names = [x[0] for x in cur.description]
    order = [names.index(k) for k in sorted(names)]
    assert sorted(names) == sorted(df.columns)
    assert sorted(rows) == sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["admission", "eval_metrics", "preference_pairs", "top_words", "clean_command"])
def test_no_python_in_hot_paths(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Cartesian" not in plan


HOT = ["source", "fold", "event_type", "signature", "request_key"]


@pytest.mark.parametrize("name", ["quota_per_author", "quota_with_ceiling", "stride_sample", "latency_summary", "admission"])
def test_no_window_holds_a_hot_key(spark, name):
    """A key is ranked whole only where its rows were cut before (a group limit); running sums are per partition."""
    import re

    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    for what, over in re.findall(r"Window \[(.*?)\], \[(.*?)\], \[", plan):
        # sums over the partitions have a row per key and partition
        assert "_sum" in what or not any(re.fullmatch(rf"{k}#\d+L?", over) for k in HOT), over


def test_shares_of_the_verdicts(spark):
    """A recorded verdict of one execution agrees with the one derived from it on the empty and the unparsed."""
    rows = catalog.QUERIES["verify_candidates"](spark, DATA).collect()
    assert all(r["seeds_total"] == 0 and not r["passed"] for r in rows if not r["syntax_valid"])
    assert all(r["passed"] == (r["failure_category"] == "none") for r in rows)


def test_expected_files_are_held_against_their_hashes(spark, tmp_path):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = {"same": sha("x"), "other": sha("y"), "unknown": None, "gone": sha("z")}
    rows = [("t", 1, 1, (expected, ["left", "away"]), {"same": "x", "other": "not y", "unknown": "u", "left": ""})]
    kinds = "task_id string, ingested_at int, created_at int, oracle struct<expected_files map<string, string>, absent_files array<string>>, setup_files map<string, string>"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/tasks.parquet")
    got = [r.asDict() for r in catalog.QUERIES["expected_vs_hashes"](spark, str(tmp_path)).collect()]
    assert got == [{"task_id": "t", "n_expected": 4, "n_missing": 1, "n_mismatched": 2, "n_present": 1}]


def test_benchmark_inside_reads_documents_and_requests(spark, duck, tmp_path):
    item = "Sort the log, by its first column."
    docs = [(1, f"Before.  {item.upper()} After"), (1, "other"), (2, "Sort the log by its last column"), (3, None), (None, item), (4, "xsort the log by its first columns"), (5, "Sort the log by\nits first column"), (6, "a grep -c here"), (7, "x y")]
    tasks = [("t", 1, 1, f"Please: {item}"), ("u", 1, 1, None), ("v", 1, 1, "grep c")]
    items = [(70, item), (71, item), (72, "grep c"), (73, "..."), (74, None), (None, "other"), (75, "x"), (76, "egrep   c and more")]
    kinds = {"documents": "doc_id long, text string", "tasks": "task_id string, ingested_at int, created_at int, user_request string", "heldout_items": "item_id long, text string"}
    c = duckdb.connect()
    for (name, kind), rows in zip(kinds.items(), (docs, tasks, items), strict=True):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = [tuple(r) for r in catalog.QUERIES["benchmark_inside"](spark, str(tmp_path)).collect()]
    assert {r for r in got if r[2] < 72} == {("document", "1", 70), ("document", "1", 71), ("document", "4", 70), ("document", "4", 71), ("task", "t", 70), ("task", "t", 71)}
    assert {r for r in got if r[2] == 72} == {("document", "6", 72), ("task", "v", 72)}
    assert sorted(got) == sorted(c.execute(catalog.SQL["benchmark_inside"]).fetchall())


@pytest.mark.parametrize(("n", "cap"), [(8, 5), (299, 5), (300, 6), (400, 8)])
def test_cap_grows_with_the_tasks(spark, tmp_path, n, cap):
    words = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    rows = [(f"{k:04d}", 1, 1, f"list the files of {words(k)}", ["ls a", "ls b"], {"a": "x"}) for k in range(n)] + [("0000", 2, 1, "again", ["ls"], {"a": "x"})]
    kinds = "task_id string, ingested_at int, created_at int, user_request string, accepted_commands array<string>, setup_files map<string, string>"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/tasks.parquet")
    got = catalog.QUERIES["admission_grown"](spark, str(tmp_path)).groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in got} == {"ok": cap, "signature_capped": n - cap}


def test_reformat_whole_maps_the_end_of_a_text(spark, tmp_path):
    text = "a" * 80 + " abcd\n" * 50
    spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["mapped"] for r in catalog.QUERIES["reformat_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: text.translate(str.maketrans("abc", "xyz")), 2: ""}
