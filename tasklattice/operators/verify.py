"""The oracle as column rules over recorded executions, and the reduction to a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import output_lines, strip
from .screen import first_failure


def stdout_checks(oracle: Column, stdout: Column, exit_code: Column, timed_out: Column) -> list[tuple[Column, Column, Column | str]]:
    """(number, number that hold, reason) of the checks on output and exit code."""
    exact, lines, code = oracle["stdout_exact"], oracle["stdout_lines_unordered"], oracle["exit_code"]
    wanted = F.array_sort(F.transform(lines, lambda x: F.regexp_replace(x, r"^\./", "")))
    one = lambda applies, holds: (applies.cast("int"), F.coalesce(applies & holds, F.lit(False)).cast("int"))
    return [
        (*one(exact.isNotNull(), (stdout == exact) | (strip(stdout) == strip(exact))), "stdout_mismatch"),
        (*one(lines.isNotNull(), output_lines(stdout) == wanted), "stdout_set_mismatch"),
        (*one(code.isNotNull(), (exit_code == code) & ~F.coalesce(timed_out, F.lit(False))), F.when(timed_out, "timeout").otherwise("exit_code")),
    ]


def filesystem_checks(oracle: Column, changed: Column, hashes: Column) -> list[tuple[Column, Column, str]]:
    """(number, number that hold, reason) of the checks on files: unchanged, one per expected hash, one per path that should be gone."""
    still = F.coalesce(oracle["filesystem_unchanged"], F.lit(True))
    expected = F.coalesce(oracle["expected_files"], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    absent = F.coalesce(oracle["absent_files"], F.array().cast("array<string>"))
    there = F.map_keys(F.coalesce(hashes, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    return [
        (still.cast("int"), (still & ~changed).cast("int"), "unexpected_filesystem_change"),
        (F.size(expected), F.size(F.map_filter(expected, lambda k, v: F.coalesce(F.element_at(hashes, k) == v, F.lit(False)))), "wrong_file_content"),
        (F.size(absent), F.size(F.filter(absent, lambda f: ~F.array_contains(there, f))), "file_should_be_absent"),
    ]


def changed_files(added: Column, removed: Column, modified: Column) -> Column:
    """Whether an execution added, removed or modified files."""
    return (F.coalesce(F.size(added), F.lit(0)) + F.coalesce(F.size(removed), F.lit(0)) + F.coalesce(F.size(modified), F.lit(0))) > 0


def state_after(files: Column, added: Column, removed: Column, modified: Column) -> Column:
    """(path, hash) of the workspace after an execution of which only the changed paths were recorded: the hash of a file that was added or modified is ''."""
    none = F.array().cast("array<string>")
    gone, new = F.array_union(F.coalesce(removed, none), F.coalesce(modified, none)), F.array_union(F.coalesce(added, none), F.coalesce(modified, none))
    kept = F.map_filter(files, lambda k, v: ~F.array_contains(gone, k))
    hashed = F.transform_values(kept, lambda k, v: F.coalesce(F.sha2(v, 256), F.lit("")))
    fresh = F.array_except(new, F.coalesce(F.map_keys(kept), none))
    return F.map_concat(F.coalesce(hashed, F.map_from_arrays(none, none)), F.map_from_arrays(fresh, F.transform(fresh, lambda _: F.lit(""))))


def checked(executions: DataFrame, oracle: str = "oracle") -> DataFrame:
    """Recorded executions with fraction, reason and forbidden; their effects are held against forbidden_side_effects.

    The fraction is the share of checks that hold, each expected and each
    absent path being one, 0 without checks. The reason is the first that fails.
    """
    o = F.col(oracle)
    changed = changed_files(F.col("files_added"), F.col("files_removed"), F.col("files_modified"))
    checks = stdout_checks(o, F.col("stdout"), F.col("exit_code"), F.col("timed_out")) + filesystem_checks(o, changed, F.col("file_hashes"))
    total, held = sum((n for n, _, _ in checks[1:]), checks[0][0]), sum((h for _, h, _ in checks[1:]), checks[0][1])
    return executions.withColumns(
        {
            "fraction": F.when(total > 0, held / total).otherwise(0.0),
            "reason": F.coalesce(*[F.when(h < n, r if isinstance(r, Column) else F.lit(r)) for n, h, r in checks]),
            "forbidden": F.coalesce(F.arrays_overlap("observed_side_effects", "forbidden_side_effects"), F.lit(False)),
        }
    )


def reduce_verdicts(instances: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One verdict per command from its instances (fraction, forbidden, reason).

    Passed if every instance has fraction 1 and none is forbidden. The category
    is forbidden_side_effect if any instance is, else the reason of the first
    instance that failed, else none. A failure without a reason is unknown, or
    fixture_overfit if some instance passed.
    """
    full = F.col("fraction") >= 1
    agg = instances.groupBy(*keys).agg(
        F.count_if(full & ~F.col("forbidden")).alias("seeds_passed"),
        F.count("*").alias("seeds_total"),
        F.avg("fraction").alias("postconditions_passed"),
        F.bool_or("forbidden").alias("forbidden_side_effect"),
        F.min(F.when(~full, F.struct(F.col(order).alias("o"), F.coalesce("reason", F.lit("unknown")).alias("r"))))["r"].alias("_first"),
    )
    passed = (F.col("seeds_passed") == F.col("seeds_total")) & ~F.col("forbidden_side_effect")
    unexplained = F.coalesce("_first", F.lit("unknown")) == "unknown"
    category = F.when(passed, "none").when(F.col("forbidden_side_effect"), "forbidden_side_effect").when(unexplained & (F.col("seeds_passed") > 0), "fixture_overfit").otherwise(F.coalesce("_first", F.lit("unknown")))
    return agg.withColumn("passed", passed).withColumn("failure_category", category).drop("_first")


def gated(verdicts: DataFrame, cleaned: Column, syntax_valid: Column) -> DataFrame:
    """Verdicts behind the two gates that no execution passes: an empty command and one that doesn't parse fail with nothing run."""
    gate = F.when(cleaned == "", "empty_output").when(~F.coalesce(syntax_valid, F.lit(True)), "syntax_error")
    zero = {"seeds_passed": F.lit(0), "seeds_total": F.lit(0), "postconditions_passed": F.lit(0.0), "forbidden_side_effect": F.lit(False), "passed": F.lit(False)}
    out = verdicts.withColumn("_gate", gate)
    out = out.withColumns({c: F.when(F.col("_gate").isNotNull(), v).otherwise(F.col(c)) for c, v in zero.items()})
    return out.withColumn("failure_category", F.coalesce("_gate", "failure_category")).withColumn("syntax_valid", F.col("_gate").isNull()).drop("_gate")


def valid_tasks(verdicts: DataFrame, task: str = "task_id", position: str = "position") -> DataFrame:
    """(task, n_commands, valid, reason): two or more accepted commands, all of which pass."""
    agg = verdicts.groupBy(task).agg(
        F.count("*").alias("n_commands"),
        F.bool_and("passed").alias("_all"),
        F.min(F.when(~F.col("passed"), F.struct(F.col(position).alias("o"), F.col("failure_category").alias("r"))))["r"].alias("_first"),
    )
    reason = F.when(F.col("n_commands") < 2, "needs_two_commands").otherwise(F.col("_first"))
    return agg.select(task, "n_commands", ((F.col("n_commands") >= 2) & F.col("_all")).alias("valid"), reason.alias("reason"))


def snapshot_diff(before: DataFrame, after: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, change): added, removed or modified between two snapshots."""
    b, a = before.select(path, F.col(digest).alias("_b"), F.lit(True).alias("_in_b")), after.select(path, F.col(digest).alias("_a"), F.lit(True).alias("_in_a"))
    both = b.join(a, path, "full_outer")
    change = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return both.select(path, change.alias("change")).where("change is not null")


def derived_oracle(baseline: Column, observed: Column) -> Column:
    """What an execution left behind as an oracle: changed or new files by hash, and files that are gone."""
    changed = F.map_filter(observed, lambda k, v: ~F.element_at(baseline, k).eqNullSafe(v))
    return F.struct(changed.alias("expected_files"), F.array_sort(F.array_except(F.map_keys(baseline), F.map_keys(observed))).alias("absent_files"))


def realised(a: Column, again: Column, b: Column, forbidden: Column) -> Column:
    """Reason to refuse an authored task from three recorded executions (a, a again, b), null if it stands."""
    nothing = (F.coalesce(F.length(F.trim(a["stdout"])), F.lit(0)) == 0) & (F.size(a["files_added"]) + F.size(a["files_removed"]) + F.size(a["files_modified"]) == 0)
    # The names of the reasons.
    return first_failure(
        (a["timed_out"] | a["sandbox_error"].isNotNull(), "primary_timeout_or_sandbox_error"),
        (~a["exit_code"].eqNullSafe(F.lit(0)), "primary_nonzero_exit"),
        (nothing, "primary_no_observable_effect"),
        (~a["stdout"].eqNullSafe(again["stdout"]) | ~F.to_json(a["file_hashes"]).eqNullSafe(F.to_json(again["file_hashes"])), "nondeterministic"),
        (~a["stdout"].eqNullSafe(b["stdout"]) | ~a["exit_code"].eqNullSafe(b["exit_code"]), "commands_disagree_stdout"),
        (~F.to_json(a["file_hashes"]).eqNullSafe(F.to_json(b["file_hashes"])), "commands_disagree_filesystem"),
        (F.arrays_overlap(a["observed_side_effects"], forbidden), "forbidden_side_effect"),
    )


def execute(*_args, **_kwargs):
    """Commands are data here and are never run; executions come in as recorded tables."""
    raise RuntimeError("no isolation is available: commands are not executed by this library")
