"""Chat rows, preference pairs and judge rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_id, strip

# Fixed value: the system prompt of a chat row.
SYSTEM = "You turn one request into one shell command. Answer with the command alone."


def messages(request: Column, answer: Column) -> Column:
    """System, user and assistant message."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(said("system", F.lit(SYSTEM)), said("user", request), said("assistant", answer))


def sft_rows(tasks: DataFrame) -> DataFrame:
    """(task_id, template_family, position, command, messages): a row per distinct accepted command, in order of first occurrence."""
    commands = F.array_distinct(F.filter("accepted_commands", lambda c: c.isNotNull()))
    rows = tasks.select("task_id", F.col("provenance.template_family").alias("template_family"), "user_request", F.posexplode(commands).alias("position", "command"))
    return rows.select("task_id", "template_family", "position", "command", messages(F.col("user_request"), F.col("command")).alias("messages"))


def prompt_and_answer(sft: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, prompt (all messages but the assistant's) and answer (the assistant's first; null without one)."""
    prompt = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] != "assistant"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    answer = F.get(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(0))["content"]
    return sft.select(*keep, prompt.alias("prompt"), answer.alias("answer"))


def best_positive(candidates: DataFrame, task: str = "task_id") -> DataFrame:
    """(task, chosen): the shortest passing command, the first candidate on ties."""
    ok = candidates.where(F.col("passed") & F.col("command").isNotNull())
    return ok.groupBy(task).agg(F.min(F.struct(F.length("command").alias("n"), "candidate_id", "command"))["command"].alias("chosen"))


def hard_negatives(candidates: DataFrame, n: int = 3, task: str = "task_id") -> DataFrame:
    """The first ``n`` failing candidates per task: forbidden effects first, then the highest fraction, then the smaller id."""
    w = Window.partitionBy(task).orderBy(F.desc("forbidden"), F.desc("fraction"), "candidate_id")
    return candidates.where(~F.col("passed")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def preference_pairs(candidates: DataFrame, n: int = 3, task: str = "task_id") -> DataFrame:
    """(task, candidate_id, chosen, rejected, rejected_unsafe): best positive against hard negatives; empty or equal ones go after the cut."""
    neg = hard_negatives(candidates, n, task).select(task, "candidate_id", F.col("command").alias("rejected"), F.col("forbidden").alias("rejected_unsafe"))
    pairs = neg.join(best_positive(candidates, task), task)
    return pairs.where((F.col("rejected") != "") & (F.col("rejected") != F.col("chosen"))).select(task, "candidate_id", "chosen", "rejected", "rejected_unsafe")


def shortest_distinct(candidates: DataFrame, task: str = "task_id") -> DataFrame:
    """(task, command, ordinal) of distinct passing commands per task, shortest first."""
    ok = candidates.where(F.col("passed") & F.col("command").isNotNull()).groupBy(task, "command").agg(F.min("candidate_id").alias("first_id"))
    w = Window.partitionBy(task).orderBy(F.length("command"), "first_id")
    return ok.select(task, "command", F.row_number().over(w).alias("ordinal"))


def judge_rows(candidates: DataFrame, judges: DataFrame) -> DataFrame:
    """(candidate_id, judge, judge_model, execution_passed, judge_correct, judge_safe, confidence): one row per usable vote of a known judge."""
    votes = candidates.select("candidate_id", F.col("verdict.passed").alias("execution_passed"), F.explode("judge_votes").alias("judge", "v"))
    votes = votes.where(F.col("v.semantically_correct").isNotNull() & F.col("execution_passed").isNotNull())
    votes = votes.withColumn("judge", plain_id(F.col("judge")))
    rows = votes.join(judges.select("judge", "judge_model"), "judge")
    return rows.select("candidate_id", "judge", "judge_model", "execution_passed", F.col("v.semantically_correct").alias("judge_correct"), F.coalesce("v.safe_under_constraints", F.lit(True)).alias("judge_safe"), F.col("v.confidence").alias("confidence"))


def current(candidates: DataFrame) -> DataFrame:
    """One flat row per candidate_id, the latest delivery: task, source, model, command and the verdict's fields."""
    held = F.max(
        F.struct("recorded_at", plain_id(F.col("task_id")).alias("task_id"), "source", "model", "command", F.col("verdict.passed").alias("passed"), F.col("verdict.postconditions_passed").alias("fraction"), F.col("verdict.forbidden_side_effect").alias("forbidden"), F.col("verdict.syntax_valid").alias("syntax_valid"), F.col("verdict.failure_category").alias("failure_category"))
    ).alias("r")
    return candidates.where("candidate_id is not null").groupBy("candidate_id").agg(held).select("candidate_id", "r.*").drop("recorded_at")


def evidence(run: Column) -> Column:
    """What a judge is shown of an execution: exit code, the first 800 characters of output and 400 of errors, changed files."""
    none = F.array().cast("array<string>")
    listed = lambda c: F.array_join(F.coalesce(run[c], none), ",")
    cut = lambda c, n: F.left(F.coalesce(run[c], F.lit("")), F.lit(n))
    exit_code = F.concat(F.lit("exit "), F.coalesce(run["exit_code"].cast("string"), F.lit("none")))
    files = F.concat(F.lit("added "), listed("files_added"), F.lit(" modified "), listed("files_modified"), F.lit(" removed "), listed("files_removed"))
    return F.concat_ws("\n", exit_code, cut("stdout", 800), cut("stderr", 400), files)


def candidate_fields(rows: DataFrame, key: str, parsed: str) -> DataFrame:
    """A candidate from the fields of a parsed answer: missing ones get defaults, the command is stripped, four assumptions are kept."""
    f = F.col(parsed)
    assumptions = F.array_join(F.slice(F.coalesce(f["assumptions"], F.array().cast("array<string>")), 1, 4), "|")
    return rows.select(key, F.coalesce(strip(f["command"]), F.lit("")).alias("command"), F.coalesce(f["risk"], F.lit("unknown")).alias("risk"), F.coalesce(f["requires_confirmation"], F.lit(False)).alias("requires_confirmation"), assumptions.alias("assumptions"))


def padded(n: Column, block: int) -> Column:
    """The next multiple of the block."""
    return (F.ceil(n / F.lit(float(block))) * block).cast("long")


def response_mask(n_prompt: Column, n: Column, most: int, block: int) -> Column:
    """True at the places of the response in a sequence that is cut at ``most`` places and padded to a multiple of the block."""
    kept = F.least(n, F.lit(most))
    width = padded(kept, block)
    places = F.when(width > 0, F.sequence(F.lit(0).cast("long"), width - 1)).otherwise(F.array().cast("array<long>"))
    return F.transform(places, lambda i: (i >= n_prompt) & (i < kept))
