"""Schemas, readers that fill defaults, sinks and in-code dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch

ORACLE = "stdout_exact:string,stdout_lines_unordered:array<string>,exit_code:int,filesystem_unchanged:boolean,expected_files:map<string,string>,absent_files:array<string>"
PROVENANCE = "generator:string,generator_version:string,template_family:string,seed:bigint,proposer_models:array<string>,human_review_status:string"
TASK = (
    "task_id string, shell_profile string, os_profile string, locale string, timezone string, setup_files map<string,string>, setup_dirs array<string>,"
    " setup_modes map<string,int>, user_request string, paraphrases array<string>, assumptions array<string>, ambiguity_label string, risk_class string,"
    f" allowed_side_effects array<string>, forbidden_side_effects array<string>, oracle struct<{ORACLE}>,"
    f" accepted_commands array<string>, difficulty_tags array<string>, provenance struct<{PROVENANCE}>"
)
SFT = "task_id string, template_family string, messages array<struct<role:string,content:string>>"

# What a missing field of a task stands for.
TASK_DEFAULTS = {
    "shell_profile": "bash",
    "os_profile": "linux-gnu",
    "locale": "C",
    "timezone": "UTC",
    "ambiguity_label": "unambiguous",
    "risk_class": "read_only",
    "allowed_side_effects": ["stdout"],
    "forbidden_side_effects": ["filesystem_delete", "network", "privilege_change"],
}
# The vocabularies of task recipes.
DIFFICULTIES = ["single_utility", "two_stage", "multi_stage"]
UTILITY_HINTS = ["grep", "awk", "sed", "sort", "uniq", "cut", "find", "wc", "head", "tail", "tr", "paste", "join", "comm", "diff", "xargs", "basename", "dirname", "du"]
DOMAINS = [
    "web server access logs", "application error logs", "CSV exports", "JSON-lines event streams", "configuration files", "source code trees",
    "backup archives", "package manifests", "CI build output", "test reports", "database dumps", "markdown documentation", "shell dotfiles",
    "systemd unit files", "cron schedules", "TSV data tables", "email mbox files", "firewall rules", "DNS zone files", "inventory lists",
    "git-style patch files", "YAML manifests", "INI settings", "log rotation dirs", "temperature sensor readings", "financial transaction records",
    "user account listings", "process snapshots", "disk usage reports", "translation string files",
]
SKILLS = [
    "filtering lines by a pattern", "counting matches", "extracting a column", "sorting numerically", "deduplicating values", "summing a numeric column",
    "finding files by name", "finding files by size", "computing a frequency ranking", "joining two files", "replacing text in place", "reformatting whitespace",
    "slicing a line range", "splitting on a delimiter", "case-insensitive search", "inverting a match", "extracting the last field", "counting words",
    "listing unique prefixes", "checking a file exists", "comparing two files", "renaming by pattern", "computing min and max", "grouping and counting",
    "stripping comments", "extracting a substring", "counting lines per file", "filtering by line length", "printing every Nth line", "reversing line order",
]
# The points of the sweep (steps, block size, new tokens).
SWEEP_GRID = [(8, 16, 32), (16, 16, 32), (32, 16, 32), (8, 32, 64), (16, 32, 64), (32, 32, 64), (64, 32, 64), (64, 64, 64)]


def _default(value) -> Column:
    return F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)


def _empty(kind: str) -> Column:
    return F.expr(f"cast({'map()' if kind.startswith('map') else 'array()'} as {kind})")


def with_defaults(tasks: DataFrame) -> DataFrame:
    """Nulls of defaulted fields replaced: by their values, by empty maps and lists, and within oracle and provenance."""
    columns = {c: F.coalesce(F.col(c), _default(v)) for c, v in TASK_DEFAULTS.items() if c in tasks.columns}
    for f in tasks.schema:
        kind = f.dataType.simpleString()
        if f.name not in columns and kind.startswith(("map", "array")):
            columns[f.name] = F.coalesce(F.col(f.name), _empty(kind))
    nested = {"oracle": {"filesystem_unchanged": F.lit(True)}, "provenance": {"template_family": F.lit("unknown"), "human_review_status": F.lit("unreviewed")}}
    for name, defaults in nested.items():
        if name in tasks.columns:
            inner = []
            for f in tasks.schema[name].dataType:
                kind, value = f.dataType.simpleString(), F.col(f"{name}.{f.name}")
                other = _empty(kind) if kind.startswith("map") or f.name in ("absent_files", "proposer_models") else defaults.get(f.name)
                inner.append((value if other is None else F.coalesce(value, other)).alias(f.name))
            columns[name] = F.struct(*inner)
    return tasks.withColumns(columns)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks from JSON lines under the declared schema; blank lines are skipped, malformed ones fail the read."""
    return with_defaults(spark.read.schema(TASK).option("mode", "FAILFAST").json(path))


def load_prompts(tasks: DataFrame, limit: int) -> DataFrame:
    """(task_id, user_request) of the first tasks by id."""
    return tasks.select("task_id", "user_request").orderBy("task_id").limit(limit)


def read_sft(spark: SparkSession, path: str) -> DataFrame:
    """Chat records from JSON lines."""
    return spark.read.schema(SFT).json(path)


def read_run_meta(spark: SparkSession, pattern: str) -> DataFrame:
    """(student, fold, path) of finished runs, one per metadata file."""
    return spark.read.option("multiLine", True).schema("student string, fold int, n_train_rows int").json(pattern).withColumn("path", F.col("_metadata.file_path"))


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, digest, length) of the files below a folder; kind is ``error``, with a null digest, for files whose content can't be had."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(folder)
    return files.select("path", F.when(F.col("content").isNull(), "error").otherwise("file").alias("kind"), F.sha2("content", 256).alias("digest"), "length")


def finished_runs(spark: SparkSession, pattern: str, known: DataFrame) -> DataFrame:
    """(student, fold, state) of the known runs: done if a metadata file says so, else missing."""
    done = read_run_meta(spark, pattern).select("student", "fold").distinct().withColumn("_done", F.lit(True))
    return known.join(done, ["student", "fold"], "left").select("student", "fold", F.when(F.col("_done"), "done").otherwise("missing").alias("state"))


def write_summary(row: DataFrame, path: str) -> None:
    """A summary of one row as one JSON file."""
    row.coalesce(1).write.mode("overwrite").json(path)


def write_jsonl(df: DataFrame, path: str, order: str = "task_id") -> None:
    """JSON lines in the order of a key, as many files as partitions."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Parquet with a folder per value; rows of a value are spread over tasks, so that a hot value isn't one task's."""
    df.repartition(by, F.pmod(F.xxhash64(*[c for c in df.columns if c != by][:1]), F.lit(16))).write.mode("overwrite").partitionBy(by).parquet(path)


def write_all(shared: DataFrame, sinks: dict[str, object]) -> None:
    """Several sinks of one computation, done once: ``shared`` is written to the shared folder, and each sink is a function of it, by path."""
    once = Scratch(shared.sparkSession, "sinks").write(shared, "shared")
    for path, view in sinks.items():
        view(once).write.mode("overwrite").parquet(path)


def exploded(spark: SparkSession, **values: list) -> DataFrame:
    """One row per combination of a few literal lists."""
    df = spark.range(1)
    for name, each in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in each])))
    return df.drop("id")
