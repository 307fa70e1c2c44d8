"""Edge cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from tasklattice.functions import text as tx


def values(spark, f, rows, kind="string"):
    df = spark.createDataFrame(list(enumerate(rows)), f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select("i", f(F.col("c")).alias("v")).select("v").collect()]


def test_clean_command(spark):
    cases = {
        "ls -l": "ls -l",
        "```bash\nls -l\n```": "ls -l",
        "```shell\nls\n```": "ls",
        "$ ls": "ls",
        "> ls": "ls",
        "# list files\nls": "ls",
        "#!/bin/bash\nls": "ls",
        "": "",
        "  \n ": "",
        "ls\nuser\nnext turn": "ls",
        "# only comment": "# only comment",
    }
    assert values(spark, tx.clean_command, list(cases)) == list(cases.values())


def test_one_line(spark):
    assert values(spark, tx.one_line, ["ls -l", "```bash\nls -l\n```", "ls\nuser", " ls \n", ""]) == [True, False, False, True, False]


def test_static_risk(spark):
    read = ["ls", "echo sudo", "suspend", "ncal", "sed s/a/b/ f | grep x"]
    high = ["sudo ls", "ls; sudo x", "cat a | CURL b", "echo $(wget x)", "rm -rf /"]
    write = ["rm -rf /tmp/x", "sed -i s/a/b/ f", "echo a > f", "chmod 600 f", "awk '$1 > 3' f"]
    assert values(spark, tx.static_risk, read + high + write) == ["read_only"] * 5 + ["high"] * 5 + ["write"] * 5


def test_signature(spark):
    cases = {"sort a.txt | uniq -c": "sort+uniq#1#1", "cat sort.txt": "cat+sort#0#1", "a || b": "#2#1", "grep 'a|b' f": "grep#1#1", "head-5 f": "#0#1", "": "#0#1"}
    assert values(spark, lambda c: tx.signature(c, F.lit(1)), list(cases)) == list(cases.values())


def test_request_key(spark):
    cases = {"How many .log files?": "how many log files", "How  many log files": "how  many log files", "Line1\nLine2": "line1line2", "naïve Café": "nave caf", " ok! ": "ok", None: None}
    assert values(spark, tx.request_key, list(cases)) == list(cases.values())


def test_embedded_json(spark):
    rows = ['{"k": 1}', 'so: {"k": 2} ok', "none", None, "{broken"]
    assert values(spark, lambda c: tx.embedded_json(c, "k bigint")["k"], rows) == [1, 2, None, None, None]


def test_truncation_and_lists(spark):
    assert values(spark, lambda c: tx.truncated_bytes(c, 3), ["abcd", "ab"]) == ["abc", "ab"]
    assert values(spark, tx.split_list, ["a, b,,c ", ""]) == [["a", "b", "c"], []]
    assert values(spark, lambda c: tx.spread_evenly(c, F.lit(3)), [7, 0], "int") == [[3, 2, 2], [0, 0, 0]]
    assert values(spark, tx.comparable_lines, ["./b\na\n\n", "a\nb"]) == [["a", "b"], ["a", "b"]]


def test_workspace_view(spark):
    df = spark.createDataFrame([({"b": "xyz ", "a": "123456"},), ({},)], "m map<string,string>")
    got = [r[0] for r in df.select(tx.workspace_view(F.col("m"), 4)).collect()]
    assert got == ["--- a\n1234...<truncated>\n--- b\nxyz", ""]


@pytest.mark.parametrize("family,expected", [("llm_authored", "sig:s"), (None, "sig:s"), ("count", "proc:count")])
def test_group_key(spark, family, expected):
    df = spark.createDataFrame([(family,)], "f string")
    assert df.select(tx.group_key(F.col("f"), F.lit("s"))).first()[0] == expected


def test_effects(spark):
    rows = [("x", "", ["f"], [], None), ("", None, None, ["g"], []), (None, "e", [], [], ["m"]), ("", "", [], [], [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, o string, e string, a array<string>, r array<string>, m array<string>")
    got = [r[0] for r in df.orderBy("i").select(tx.effects(*[F.col(c) for c in ("o", "e", "a", "r", "m")])).collect()]
    assert got == [["stdout", "filesystem_write"], ["filesystem_delete"], ["stderr", "filesystem_write"], []]
