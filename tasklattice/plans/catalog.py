"""All queries of the core, each over its whole tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import admit, folds, generate, labels, metrics, screen, verify
from ..session import Scratch, table
from ..sources import records
from ..streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}



class Piece(str):
    """SQL with {c} and {n} for columns; other braces stay."""

    def format(self, **columns: str) -> str:
        out = str(self)
        for name, sql in columns.items():
            out = out.replace("{" + name + "}", sql)
        return out


# shared SQL pieces
_ONCE = "tasks_once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ingested_at, created_at) AS rn_ FROM tasks WHERE task_id IS NOT NULL) WHERE rn_ = 1)"
_KEY = Piece("trim(regexp_replace(lower({c}), '[^a-z0-9 ]+', '', 'g'))")
_CLEAN_LINES = (
    "list_filter(list_transform(string_split(regexp_replace(regexp_replace({c}, '(?m)^[ \\t]*```(shell|bash|console|sh)?[ \\t]*$', '', 'g'),"
    " '^[\\s]*```(shell|bash|console|sh)?|```[\\s]*$', '', 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[\\s]+|[\\s]+$', '', 'g'), '^[$>]\\s+', '')), lambda x: x <> '')"
)
_CLEAN = Piece(f"coalesce(list_filter({_CLEAN_LINES}, lambda x: NOT starts_with(x, '#'))[1], {_CLEAN_LINES}[1], '')")
_DANGER, _WRITE = tx.DANGEROUS, tx.WRITING
_RISK = Piece("CASE WHEN regexp_matches({c}, '" + _DANGER + "') THEN 'high' WHEN regexp_matches({c}, '" + _WRITE + "') THEN 'write' ELSE 'read_only' END")
_NAMES = "[" + ", ".join(f"'{u}'" for u in tx.UTILITIES) + "]"
_SIG = Piece(
    "array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all({c}, '([a-zA-Z_][\\p{L}\\p{M}\\p{Nd}_-]*)', 1)), lambda x: list_contains(" + _NAMES + ", x))), '+')"
    " || '#' || (length({c}) - length(replace({c}, '|', '')))::VARCHAR || '#' || {n}::VARCHAR"
)
_PLAIN = Piece("regexp_replace(lower({c}), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')")
_CURRENT = (
    "current_ AS (SELECT candidate_id, " + _PLAIN.format(c="task_id") + " AS task_id, source, model, command, verdict.passed AS passed, verdict.postconditions_passed AS fraction,"
    " verdict.forbidden_side_effect AS forbidden, verdict.syntax_valid AS syntax_valid, verdict.failure_category AS failure_category FROM"
    " (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY recorded_at DESC) AS rn_ FROM candidates WHERE candidate_id IS NOT NULL) WHERE rn_ = 1)"
)
_USABLE = "usable AS (SELECT * FROM current_ WHERE task_id IS NOT NULL AND passed IS NOT NULL AND command IS NOT NULL AND forbidden IS NOT NULL AND fraction IS NOT NULL AND NOT isnan(fraction))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks, the first delivery of each id."""
    return admit.first_per(table(spark, sf_dir, "tasks"), "task_id", ["ingested_at", "created_at"])


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current candidates with a task, a command and a complete verdict."""
    rows = labels.current(table(spark, sf_dir, "candidates"))
    return rows.where("task_id is not null and passed is not null and command is not null and forbidden is not null and fraction is not null and not isnan(fraction)")


# text functions


@query(f"SELECT DISTINCT task_id, {_KEY.format(c='user_request')} AS request_key FROM tasks")
def request_key(spark, d):
    return table(spark, d, "tasks").select("task_id", tx.request_key(F.col("user_request")).alias("request_key")).distinct()


@query("SELECT doc_id, left(sha256(text), 16) AS content_id FROM documents")
def content_id(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.content_id(F.col("text")).alias("content_id"))


@query(f"SELECT candidate_id, {_CLEAN.format(c='command')} AS cleaned FROM candidates")
def clean_command(spark, d):
    return table(spark, d, "candidates").select("candidate_id", tx.clean_command(F.col("command")).alias("cleaned"))


_STRIPPED = Piece("regexp_replace({c}, '^[\\s]+|[\\s]+$', '', 'g')")


@query(
    "WITH l AS (SELECT candidate_id, list_filter(string_split(" + _STRIPPED.format(c=f"regexp_replace(command, '(?m){tx.GIVEN_FENCE}', '', 'g')") + ", chr(10)), lambda x: " + _STRIPPED.format(c="x") + " <> '') AS lines FROM candidates),"
    " b AS (SELECT candidate_id, list_transform(lines, lambda x: " + _STRIPPED.format(c=f"regexp_replace(x, '{tx.GIVEN_MARK}', '')") + ") AS bare FROM l)"
    " SELECT candidate_id, coalesce(list_filter(bare, lambda x: x <> '' AND NOT starts_with(x, '#'))[1], bare[1], '') AS cleaned FROM b"
)
def clean_command_given(spark, d):
    return table(spark, d, "candidates").select("candidate_id", tx.clean_command_as_given(F.col("command")).alias("cleaned"))


@query(f"WITH {_ONCE} SELECT task_id, pos - 1 AS position, {_CLEAN.format(c='c')} AS cleaned FROM (SELECT task_id, unnest(accepted_commands) AS c, generate_subscripts(accepted_commands, 1) AS pos FROM tasks_once) WHERE c IS NOT NULL")
def clean_accepted(spark, d):
    rows = once(spark, d).select("task_id", F.posexplode("accepted_commands").alias("position", "c")).where("c is not null")
    return rows.select("task_id", "position", tx.clean_command(F.col("c")).alias("cleaned"))


@query(f"SELECT candidate_id, {_RISK.format(c='command')} AS risk FROM candidates")
def static_risk(spark, d):
    return table(spark, d, "candidates").select("candidate_id", tx.static_risk(F.col("command")).alias("risk"))


def _signed(spark, d):
    first = F.coalesce(F.get("accepted_commands", F.lit(0)), F.lit(""))
    n = F.coalesce(F.size("setup_files"), F.lit(0))
    return once(spark, d).withColumn("signature", tx.signature(first, n))


_SIGNED = _ONCE + ", signed AS (SELECT *, " + _SIG.format(c="coalesce(accepted_commands[1], '')", n="coalesce(cardinality(setup_files), 0)") + " AS signature FROM tasks_once)"


@query(f"WITH {_SIGNED} SELECT task_id, signature FROM signed")
def shape_signature(spark, d):
    return _signed(spark, d).select("task_id", "signature")


@query(f"WITH {_SIGNED} SELECT signature, count(*) AS n FROM signed GROUP BY 1 ORDER BY n DESC, signature LIMIT 8")
def signature_top8(spark, d):
    return _signed(spark, d).groupBy("signature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "signature").limit(8)


@query(f"WITH {_SIGNED} SELECT count(DISTINCT signature) AS n_signatures, count(*) AS n_tasks FROM signed")
def distinct_signatures(spark, d):
    return _signed(spark, d).agg(F.count_distinct("signature").alias("n_signatures"), F.count("*").alias("n_tasks"))


_GROUP = "CASE WHEN provenance.template_family IS NULL OR provenance.template_family = 'llm_authored' THEN 'sig:' || signature ELSE 'proc:' || provenance.template_family END"


@query(f"WITH {_SIGNED} SELECT task_id, {_GROUP} AS group_key FROM signed")
def group_key(spark, d):
    return _signed(spark, d).select("task_id", tx.group_key(F.col("provenance.template_family"), F.col("signature")).alias("group_key"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_fallback(spark, d):
    noisy = F.concat(F.lit("answer:\n```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", tx.embedded_json(noisy, "k bigint")["k"].alias("k"))


_LINES = "list_sort(list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: regexp_replace(x, '^\\./', '')))"


@query(f"SELECT array_to_string({_LINES}, chr(10)) AS lines, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def unordered_lines_equal(spark, d):
    lines = F.array_join(tx.comparable_lines(F.col("text")), "\n").alias("lines")
    return table(spark, d, "documents").where("text is not null").groupBy(lines).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(
    f"WITH {_ONCE}, parts AS (SELECT task_id, unnest(list_sort(map_keys(setup_files))) AS k, setup_files FROM tasks_once WHERE cardinality(setup_files) > 0)"
    " SELECT task_id, string_agg('--- ' || k || chr(10) || coalesce(rtrim(CASE WHEN length(setup_files[k]) > 120 THEN left(setup_files[k], 120) || '...<truncated>' ELSE setup_files[k] END), ''), chr(10) ORDER BY k) AS workspace FROM parts GROUP BY task_id"
)
def workspace_view(spark, d):
    return once(spark, d).where(F.size("setup_files") > 0).select("task_id", tx.workspace_view(F.col("setup_files"), 120).alias("workspace"))


@query("SELECT candidate_id, command <> '' AND NOT contains(regexp_replace(command, '^[\\s]+|[\\s]+$', '', 'g'), chr(10)) AND " + _CLEAN.format(c="command") + " <> '' AS is_one_line FROM candidates WHERE command IS NOT NULL")
def one_line_flag(spark, d):
    return table(spark, d, "candidates").where("command is not null").select("candidate_id", tx.one_line(F.col("command")).alias("is_one_line"))


@query("SELECT candidate_id, array_to_string(list_filter(list_transform(string_split(source || ', ' || model || ',', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM candidates WHERE source IS NOT NULL AND model IS NOT NULL")
def split_list(spark, d):
    joined = F.concat("source", F.lit(", "), "model", F.lit(","))
    return table(spark, d, "candidates").where("source is not null and model is not null").select("candidate_id", F.array_join(tx.split_list(joined), "|").alias("parts"))


# screening and admission

_BAD = (
    "CASE WHEN setup_files IS NULL OR NOT cardinality(setup_files) BETWEEN 1 AND 6 THEN 'bad_setup_files'"
    " WHEN len(list_filter(map_values(setup_files), lambda v: v IS NULL)) > 0 THEN 'bad_file_entry'"
    " WHEN len(list_filter(map_keys(setup_files), lambda k: starts_with(k, '/') OR contains(k, '..'))) > 0 THEN 'unsafe_path'"
    " WHEN len(list_filter(map_values(setup_files), lambda v: length(v) > 20000)) > 0 THEN 'file_too_large'"
    " WHEN user_request IS NULL OR NOT length(user_request) BETWEEN 10 AND 400 THEN 'bad_request'"
    " WHEN cleaned IS NULL OR len(cleaned) < 2 THEN 'needs_two_commands' WHEN cleaned[1] = cleaned[2] THEN 'commands_not_distinct'"
    f" WHEN len(list_filter(cleaned, lambda c: regexp_matches(c, '{_DANGER}'))) > 0 THEN 'dangerous_command' END"
)
_CLEANED = "cleaned_ AS (SELECT task_id, list(c ORDER BY pos) AS cleaned FROM (SELECT task_id, pos, " + _CLEAN.format(c="c") + " AS c FROM (SELECT task_id, unnest(accepted_commands) AS c, generate_subscripts(accepted_commands, 1) AS pos FROM tasks_once)) WHERE c <> '' GROUP BY task_id)"
_SCREENED = f"{_SIGNED}, {_CLEANED}, screened AS (SELECT s.*, {_KEY.format(c='user_request')} AS request_key, {_BAD} AS screen FROM signed s LEFT JOIN cleaned_ USING (task_id))"


def _screened(spark, d):
    bad = screen.task_screen(F.col("setup_files"), F.col("user_request"), F.col("accepted_commands"))
    return _signed(spark, d).withColumn("request_key", tx.request_key(F.col("user_request"))).withColumn("screen", bad)


@query(f"WITH {_SCREENED} SELECT task_id, coalesce(screen, 'ok') AS reason FROM screened")
def screen_reason(spark, d):
    return _screened(spark, d).select("task_id", F.coalesce("screen", F.lit("ok")).alias("reason"))


@query(f"WITH {_SCREENED} SELECT coalesce(screen, 'ok') AS reason, count(*) AS n FROM screened GROUP BY 1")
def reason_histogram(spark, d):
    return _screened(spark, d).groupBy(F.coalesce("screen", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT content_id, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, left(sha256(text), 16) AS content_id FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def dedup_content(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", tx.content_id(F.col("text")).alias("content_id"))
    return rows.groupBy("content_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(f"WITH {_ONCE} SELECT task_id, request_key FROM (SELECT task_id, {_KEY.format(c='user_request')} AS request_key, row_number() OVER (PARTITION BY {_KEY.format(c='user_request')} ORDER BY ingested_at, task_id) AS rn FROM tasks_once WHERE user_request IS NOT NULL) WHERE rn = 1")
def dedup_request(spark, d):
    rows = once(spark, d).where("user_request is not null").withColumn("request_key", tx.request_key(F.col("user_request")))
    return admit.first_per(rows, "request_key", ["ingested_at", "task_id"]).select("task_id", "request_key")


@query(f"WITH {_SIGNED} SELECT task_id, signature FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY ingested_at, task_id) AS rn FROM signed) WHERE rn <= 5")
def cap_per_signature(spark, d):
    return admit.first_n_per(_signed(spark, d), "signature", ["ingested_at", "task_id"], 5).select("task_id", "signature")


@query(
    f"WITH {_CURRENT}, authors AS (SELECT source, row_number() OVER (ORDER BY source) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM current_ WHERE source IS NOT NULL)),"
    " shares AS (SELECT source, floor(5000 / n) + CASE WHEN place <= 5000 % n THEN 1 ELSE 0 END AS quota FROM authors),"
    " ranked AS (SELECT candidate_id, source, row_number() OVER (PARTITION BY source ORDER BY candidate_id) AS rn FROM current_)"
    " SELECT candidate_id, source FROM ranked JOIN shares USING (source) WHERE rn <= quota"
)
def quota_per_author(spark, d):
    rows = labels.current(table(spark, d, "candidates")).select("candidate_id", "source")
    return admit.quota(rows, "source", ["candidate_id"], 5000, rows.where("source is not null")).select("candidate_id", "source")


_ADMITTED = (
    f"{_SCREENED}, g1 AS (SELECT *, screen AS r1, row_number() OVER (PARTITION BY request_key, screen IS NULL ORDER BY ingested_at, task_id) AS k FROM screened),"
    " g2 AS (SELECT *, coalesce(r1, CASE WHEN coalesce(request_key, '') <> '' AND k > 1 THEN 'duplicate_request' END) AS r2 FROM g1),"
    " g3 AS (SELECT *, row_number() OVER (PARTITION BY signature, r2 IS NULL ORDER BY ingested_at, task_id) AS m FROM g2),"
    " admitted AS (SELECT *, coalesce(r2, CASE WHEN m > 20 THEN 'signature_capped' END, 'ok') AS reason FROM g3)"
)


def _admitted(spark, d, cap=20):
    rows = _screened(spark, d)
    return admit.admission(rows, "task_id", "request_key", "signature", ["ingested_at", "task_id"], cap, F.col("screen"))


@query(f"WITH {_ADMITTED} SELECT task_id, signature, reason FROM admitted")
def admission(spark, d):
    return _admitted(spark, d).select("task_id", "signature", "reason")


@query(f"WITH {_ADMITTED} SELECT count(*) AS n_tasks, count(*) FILTER (reason = 'ok') AS n_kept, count(*) FILTER (reason = 'ok' AND provenance.template_family <> 'llm_authored') AS n_procedural, count(*) FILTER (reason = 'signature_capped') AS n_capped, count(*) FILTER (reason = 'duplicate_request') AS n_duplicate, count(DISTINCT signature) FILTER (reason = 'ok') AS distinct_signatures, sum(CASE WHEN reason = 'ok' THEN len(accepted_commands) ELSE 0 END) AS n_commands FROM admitted")
def corpus_summary(spark, d):
    ok = F.col("reason") == "ok"
    return _admitted(spark, d).agg(
        F.count("*").alias("n_tasks"),
        F.count_if(ok).alias("n_kept"),
        F.count_if(ok & (F.col("provenance.template_family") != "llm_authored")).alias("n_procedural"),
        F.count_if(F.col("reason") == "signature_capped").alias("n_capped"),
        F.count_if(F.col("reason") == "duplicate_request").alias("n_duplicate"),
        F.count_distinct(F.when(ok, F.col("signature"))).alias("distinct_signatures"),
        F.sum(F.when(ok, F.size("accepted_commands")).otherwise(0)).alias("n_commands"),
    )


# the queries above and below hold a fixed cap; here it grows with the number of tasks
_GROWN = _ADMITTED.replace("m > 20", "m > greatest(5, (SELECT count(*) FROM tasks_once) // 50)")


@query(f"WITH {_GROWN} SELECT task_id, signature, reason FROM admitted")
def admission_grown(spark, d):
    n = table(spark, d, "tasks").where("task_id is not null").select("task_id").distinct().count()
    return _admitted(spark, d, admit.shape_cap(n)).select("task_id", "signature", "reason")


@query(
    f"WITH RECURSIVE {_SIGNED}, ordered AS (SELECT task_id, signature, nullif({_KEY.format(c='user_request')}, '') AS request_key, strftime(ingested_at, '%Y%m%d%H%M%S%f') || '-' || task_id AS seq FROM signed), numbered AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM ordered),"
    " walk AS (SELECT 0::BIGINT AS rn, NULL::VARCHAR AS seq, NULL::VARCHAR AS task_id, NULL::VARCHAR AS reason, []::VARCHAR[] AS ids, []::VARCHAR[] AS asked, []::VARCHAR[] AS shapes UNION ALL"
    " SELECT rn, seq, task_id, reason, CASE WHEN reason = 'ok' THEN list_append(ids, task_id) ELSE ids END, CASE WHEN reason = 'ok' AND request_key IS NOT NULL THEN list_append(asked, request_key) ELSE asked END, CASE WHEN reason = 'ok' THEN list_append(shapes, signature) ELSE shapes END"
    " FROM (SELECT n.*, w.ids, w.asked, w.shapes, CASE WHEN list_contains(w.ids, n.task_id) THEN 'duplicate_task_id' WHEN n.request_key IS NOT NULL AND list_contains(w.asked, n.request_key) THEN 'duplicate_request' WHEN len(list_filter(w.shapes, lambda x: x = n.signature)) >= 20 THEN 'signature_capped' ELSE 'ok' END AS reason FROM walk w JOIN numbered n ON n.rn = w.rn + 1))"
    " SELECT seq, task_id, reason FROM walk WHERE rn > 0"
)
def admit_exact(spark, d):
    rows = _signed(spark, d).withColumn("request_key", tx.request_key(F.col("user_request")))
    rows = rows.withColumn("seq", F.concat(F.date_format("ingested_at", "yyyyMMddHHmmssSSSSSS"), F.lit("-"), "task_id"))
    return admit.admit_exact(rows, "task_id", "request_key", "signature", "seq", 20)


@query(f"WITH {_ONCE} SELECT coalesce(provenance.template_family, 'none') AS family, count(*) AS n FROM tasks_once GROUP BY 1")
def family_distribution(spark, d):
    return once(spark, d).groupBy(F.coalesce("provenance.template_family", F.lit("none")).alias("family")).agg(F.count("*").alias("n"))


# labels

_SFT = f"{_ONCE}, cmds AS (SELECT task_id, provenance.template_family AS template_family, c, min(pos) AS pos FROM (SELECT task_id, provenance, unnest(accepted_commands) AS c, generate_subscripts(accepted_commands, 1) AS pos FROM tasks_once) WHERE c IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_SFT} SELECT task_id, template_family, row_number() OVER (PARTITION BY task_id ORDER BY pos) - 1 AS position, c AS command FROM cmds")
def sft_rows(spark, d):
    return labels.sft_rows(once(spark, d)).select("task_id", "template_family", "position", "command")


@query(f"WITH {_SFT} SELECT c.task_id, row_number() OVER (PARTITION BY c.task_id ORDER BY pos) - 1 AS position, 'system: {labels.SYSTEM}' || chr(10) || 'user: ' || coalesce(t.user_request, '') || chr(10) || 'assistant: ' || c AS chat FROM cmds c JOIN tasks_once t ON t.task_id = c.task_id")
def chat_rows(spark, d):
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")
    return labels.sft_rows(once(spark, d)).select("task_id", "position", said.alias("chat"))


@query("SELECT DISTINCT sft_id, list_count(messages) AS n_messages, (list_filter(messages, lambda m: m.role = 'assistant')[1]).content AS answer, coalesce(array_to_string(list_transform(list_filter(messages, lambda m: m.role <> 'assistant'), lambda m: coalesce(m.content, '')), chr(10)), '') AS prompt FROM sft WHERE messages IS NOT NULL")
def messages_split(spark, d):
    rows = table(spark, d, "sft").where("messages is not null").withColumn("n_messages", F.size("messages"))
    return labels.prompt_and_answer(rows, ["sft_id", "n_messages"]).distinct()


_BEST = f"{_CURRENT}, {_USABLE}, best AS (SELECT task_id, arg_min(command, (length(command), candidate_id)) AS chosen FROM usable WHERE passed GROUP BY task_id)"
_NEG = "neg AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY forbidden DESC, fraction DESC, candidate_id) AS rank FROM usable WHERE NOT passed)"


@query(f"WITH {_CURRENT}, {_USABLE}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY length(command), candidate_id) AS rn FROM usable WHERE passed) SELECT task_id, command AS chosen FROM r WHERE rn = 1")
def best_positive(spark, d):
    return labels.best_positive(usable(spark, d))


@query(f"WITH {_CURRENT}, {_USABLE}, {_NEG} SELECT task_id, candidate_id, rank FROM neg WHERE rank <= 3")
def hard_negatives_top3(spark, d):
    return labels.hard_negatives(usable(spark, d)).select("task_id", "candidate_id", "rank")


@query(f"WITH {_CURRENT}, {_USABLE}, {_NEG}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY length(command), candidate_id) AS rn FROM usable WHERE passed) SELECT n.task_id, n.candidate_id, r.command AS chosen, n.command AS rejected, n.forbidden AS rejected_unsafe FROM neg n JOIN r ON n.task_id = r.task_id AND r.rn = 1 WHERE n.rank <= 3 AND n.command <> '' AND n.command <> r.command")
def preference_pairs(spark, d):
    return labels.preference_pairs(usable(spark, d))


@query(f"WITH {_ONCE}, {_CURRENT}, {_USABLE}, {_NEG}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY length(command), candidate_id) AS rn FROM usable WHERE passed) SELECT n.task_id, n.candidate_id, t.user_request AS prompt, t.provenance.template_family AS template_family, r.command AS chosen, n.command AS rejected, CASE WHEN n.forbidden THEN 'unsafe' ELSE coalesce(n.failure_category, 'unknown') END AS reason FROM neg n JOIN r ON n.task_id = r.task_id AND r.rn = 1 JOIN tasks_once t ON t.task_id = n.task_id WHERE n.rank <= 3 AND n.command <> '' AND n.command <> r.command")
def preference_rows(spark, d):
    rows = usable(spark, d)
    why = rows.select("candidate_id", F.coalesce("failure_category", F.lit("unknown")).alias("why"))
    tasks = once(spark, d).select("task_id", F.col("user_request").alias("prompt"), F.col("provenance.template_family").alias("template_family"))
    pairs = labels.preference_pairs(rows).join(why, "candidate_id").join(tasks, "task_id")
    return pairs.select("task_id", "candidate_id", "prompt", "template_family", "chosen", "rejected", F.when(F.col("rejected_unsafe"), "unsafe").otherwise(F.col("why")).alias("reason"))


@query(f"WITH {_CURRENT}, {_USABLE}, g AS (SELECT task_id, command, min(candidate_id) AS first_id FROM usable WHERE passed GROUP BY 1, 2) SELECT task_id, command, row_number() OVER (PARTITION BY task_id ORDER BY length(command), first_id) AS ordinal FROM g")
def shortest_distinct(spark, d):
    return labels.shortest_distinct(usable(spark, d))


_LATEST = "latest_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY recorded_at DESC) AS rn_ FROM candidates WHERE candidate_id IS NOT NULL) WHERE rn_ = 1)"
_VOTES = (
    f"{_LATEST}, votes_ AS (SELECT candidate_id, verdict.passed AS execution_passed, unnest(map_keys(judge_votes)) AS judge_, unnest(map_values(judge_votes)) AS v FROM latest_),"
    " judged_ AS (SELECT candidate_id, j.judge, j.judge_model, execution_passed, v.semantically_correct AS judge_correct, coalesce(v.safe_under_constraints, true) AS judge_safe, v.confidence AS confidence"
    " FROM votes_ JOIN judges j ON " + _PLAIN.format(c="judge_") + " = j.judge WHERE v.semantically_correct IS NOT NULL AND execution_passed IS NOT NULL)"
)


def _latest(spark, d):
    rows = table(spark, d, "candidates").where("candidate_id is not null").select("candidate_id", "recorded_at", "verdict", F.map_entries("judge_votes").alias("votes"))
    held = rows.groupBy("candidate_id").agg(F.max(F.struct("recorded_at", "verdict.passed", "votes")).alias("r"))
    return held.select("candidate_id", F.struct("r.passed").alias("verdict"), F.map_from_entries("r.votes").alias("judge_votes"))


@query(f"WITH {_VOTES} SELECT * FROM judged_")
def judge_rows(spark, d):
    return labels.judge_rows(_latest(spark, d), table(spark, d, "judges"))


@query(f"WITH {_VOTES} SELECT judge, count(*) AS n, count(*) FILTER (judge_correct = execution_passed) AS agree, count(*) FILTER (judge_correct AND NOT execution_passed) AS false_positive, count(*) FILTER (NOT judge_correct AND execution_passed) AS false_negative, round(avg(CASE WHEN judge_correct = execution_passed THEN 1.0 ELSE 0.0 END), 3) AS agreement FROM judged_ GROUP BY judge")
def judge_confusion(spark, d):
    return metrics.confusion(labels.judge_rows(_latest(spark, d), table(spark, d, "judges")), "judge", "judge_correct", "execution_passed")


# yields and histograms


@query(f"WITH {_CURRENT}, {_USABLE} SELECT source, count(*) AS proposed, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed AND forbidden) AS unsafe FROM usable GROUP BY source")
def teacher_yield(spark, d):
    rows = usable(spark, d)
    return rows.groupBy("source").agg(F.count("*").alias("proposed"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed") & F.col("forbidden")).alias("unsafe"))


@query(f"WITH {_CURRENT} SELECT coalesce(failure_category, 'missing') AS failure_category, count(*) AS n FROM current_ GROUP BY 1")
def failure_histogram(spark, d):
    return labels.current(table(spark, d, "candidates")).groupBy(F.coalesce("failure_category", F.lit("missing")).alias("failure_category")).agg(F.count("*").alias("n"))


@query(f"WITH {_CURRENT}, e AS (SELECT source, count(*) AS attempts, count(*) FILTER (passed) AS kept FROM current_ WHERE source IS NOT NULL GROUP BY source) SELECT source, attempts, kept, round(kept / greatest(attempts, 1), 3) AS yield, round(kept / greatest(sum(kept) OVER (), 1), 4) AS share FROM e")
def author_yield(spark, d):
    return metrics.author_yield(labels.current(table(spark, d, "candidates")).where("source is not null"), "source", F.col("passed"))


@query(f"WITH {_CURRENT}, {_USABLE}, t AS (SELECT count(DISTINCT task_id) AS n_tasks FROM usable), v AS (SELECT count(DISTINCT task_id) AS n_verified FROM usable WHERE passed) SELECT n_tasks, n_verified, round(n_verified / greatest(n_tasks, 1), 3) AS task_yield FROM t, v")
def dataset_summary(spark, d):
    each = usable(spark, d).groupBy("task_id").agg(F.bool_or("passed").alias("verified"))
    return each.agg(F.count("*").alias("n_tasks"), F.count_if("verified").alias("n_verified")).withColumn("task_yield", F.round(F.col("n_verified") / F.greatest("n_tasks", F.lit(1)), 3))


# evaluation

_EVALROWS = f"{_CURRENT}, rows_ AS (SELECT *, {_RISK.format(c='command')} = 'write' AS wrote, {_CLEAN.format(c='command')} <> '' AND NOT contains(regexp_replace(command, '^[\\s]+|[\\s]+$', '', 'g'), chr(10)) AS is_one_line FROM current_ WHERE model IS NOT NULL)"
_RATE = "round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 4)"


def _eval_rows(spark, d):
    rows = labels.current(table(spark, d, "candidates")).where("model is not null")
    return rows.withColumn("wrote", tx.static_risk(F.col("command")) == "write").withColumn("is_one_line", tx.one_line(F.col("command")))


@query(f"WITH {_EVALROWS} SELECT source, model, count(*) AS n, {_RATE.format(c='passed')} AS pass_at_1, {_RATE.format(c='forbidden')} AS forbidden_rate, {_RATE.format(c='NOT coalesce(passed, false) AND wrote')} AS unintended_write_rate, {_RATE.format(c='syntax_valid')} AS syntax_valid_rate, {_RATE.format(c='is_one_line')} AS one_line_rate FROM rows_ GROUP BY 1, 2")
def eval_metrics(spark, d):
    return metrics.evaluation(_eval_rows(spark, d), ["source", "model"])


@query(f"WITH {_CURRENT}, e AS (SELECT source, model, count(*) AS n, {_RATE.format(c='passed')} AS p FROM current_ WHERE model IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2) SELECT source, round(avg(p), 6) AS mean_value, sum(n) AS n, count(*) AS folds FROM e GROUP BY source")
def macro_mean(spark, d):
    rows = labels.current(table(spark, d, "candidates")).where("model is not null and source is not null")
    each = rows.groupBy("source", "model").agg(F.count("*").alias("n"), metrics.rate(F.col("passed")).alias("p"))
    return metrics.macro_mean(each, "source", "p")


@query("WITH e AS (SELECT l_linestatus, l_returnflag, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 4) AS p FROM lineitem GROUP BY 1, 2), w AS (SELECT l_returnflag AS model, max(p) FILTER (l_linestatus = 'O') AS base, max(p) FILTER (l_linestatus = 'F') AS tuned FROM e GROUP BY 1) SELECT model, base, tuned, round(tuned - base, 4) AS delta FROM w WHERE base IS NOT NULL AND tuned IS NOT NULL")
def base_vs_tuned_delta(spark, d):
    each = table(spark, d, "lineitem").groupBy("l_linestatus", F.col("l_returnflag").alias("model")).agg(metrics.rate(F.col("l_discount") > 0.05).alias("p"))
    return metrics.base_vs_tuned(each, "model", "l_linestatus", "p", "O", "F")


_PCT = "list_sort(list(value))[round_even({p} * (count(*) - 1), 0)::BIGINT + 1]"


@query(f"SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(sum(user_id) / sum(value), 6) AS tokens_per_unit, round(avg(user_id), 6) AS mean_tokens, {_PCT.format(p=0.5)} AS p50, {_PCT.format(p=0.95)} AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_summary(spark, d):
    return metrics.latency(table(spark, d, "events").where("value is not null"), "event_type", "value", "user_id")


@query(
    "WITH grid(slot, steps, block_size, max_new_tokens) AS (VALUES " + ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(records.SWEEP_GRID)) + ")"
    " SELECT steps, block_size, max_new_tokens, count(*) AS n, round(avg(value), 6) AS mean_value, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 4) AS click_rate"
    " FROM events JOIN grid ON CAST(json_extract(props, '$.k') AS BIGINT) % 8 = slot GROUP BY 1, 2, 3"
)
def sweep_grid(spark, d):
    grid = spark.createDataFrame([(k, *g) for k, g in enumerate(records.SWEEP_GRID)], "slot long, steps int, block_size int, max_new_tokens int")
    rows = table(spark, d, "events").withColumn("slot", F.get_json_object("props", "$.k").cast("long") % 8)
    # eight rows
    joined = rows.join(F.broadcast(grid), "slot")
    return joined.groupBy("steps", "block_size", "max_new_tokens").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), metrics.rate(F.col("event_type") == "click").alias("click_rate"))


# verification


def _instances(spark, d):
    rows = table(spark, d, "lineitem")
    reason = F.when(F.col("l_discount") > 0.08, F.concat("l_linestatus", F.lit("-"), F.month("l_shipdate").cast("string")))
    ident = F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 8, "0") for c in ("l_linenumber", "l_partkey", "l_suppkey")])
    return rows.select("l_orderkey", ident.alias("variant"), F.when(reason.isNull(), 1.0).otherwise(0.5).alias("fraction"), reason.alias("reason"), (F.col("l_tax") > 0.075).alias("forbidden"))


@query(
    "WITH i AS (SELECT l_orderkey, lpad(l_linenumber::VARCHAR, 8, '0') || '-' || lpad(l_partkey::VARCHAR, 8, '0') || '-' || lpad(l_suppkey::VARCHAR, 8, '0') AS variant, l_tax > 0.075 AS forbidden, CASE WHEN l_discount > 0.08 THEN l_linestatus || '-' || month(l_shipdate)::VARCHAR END AS reason FROM lineitem),"
    " f AS (SELECT *, CASE WHEN reason IS NULL THEN 1.0 ELSE 0.5 END AS fraction FROM i),"
    " a AS (SELECT l_orderkey, count(*) FILTER (fraction >= 1 AND NOT forbidden) AS seeds_passed, count(*) AS seeds_total, round(avg(fraction), 9) AS postconditions_passed, bool_or(forbidden) AS forbidden_side_effect, arg_min(reason, variant) FILTER (reason IS NOT NULL) AS first_ FROM f GROUP BY 1)"
    " SELECT l_orderkey, seeds_passed, seeds_total, postconditions_passed, forbidden_side_effect, seeds_passed = seeds_total AND NOT forbidden_side_effect AS passed,"
    " CASE WHEN seeds_passed = seeds_total AND NOT forbidden_side_effect THEN 'none' WHEN forbidden_side_effect THEN 'forbidden_side_effect' ELSE coalesce(first_, 'unknown') END AS failure_category FROM a"
)
def verdict_reduce(spark, d):
    out = verify.reduce_verdicts(_instances(spark, d), ["l_orderkey"], "variant")
    return out.withColumn("postconditions_passed", F.round("postconditions_passed", 9))


@query("WITH b AS (SELECT user_id, max(value) AS v FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-01' GROUP BY 1), a AS (SELECT user_id, max(value) AS v FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-02' GROUP BY 1), j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'added' WHEN a.user_id IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'modified' END AS change FROM b FULL JOIN a ON a.user_id = b.user_id) SELECT user_id, change FROM j WHERE change IS NOT NULL")
def snapshot_diff(spark, d):
    at = lambda day: table(spark, d, "events").where(F.col("ts").cast("date") == F.lit(day).cast("date")).groupBy("user_id").agg(F.max("value").alias("v"))
    return verify.snapshot_diff(at("2024-01-01"), at("2024-01-02"), "user_id", "v")


@query(f"WITH {_ONCE} SELECT task_id, cardinality(oracle.expected_files) AS n_expected, len(list_filter(map_keys(oracle.expected_files), lambda k: setup_files[k] IS NULL)) AS n_missing, coalesce(len(list_filter(oracle.absent_files, lambda f: setup_files[f] IS NOT NULL)), 0) AS n_present FROM tasks_once WHERE cardinality(oracle.expected_files) > 0 AND setup_files IS NOT NULL")
def expected_vs_observed(spark, d):
    rows = once(spark, d).where((F.size("oracle.expected_files") > 0) & F.col("setup_files").isNotNull())
    absent = F.coalesce("oracle.absent_files", F.array().cast("array<string>"))
    return rows.select(
        "task_id",
        F.size("oracle.expected_files").alias("n_expected"),
        F.size(F.filter(F.map_keys("oracle.expected_files"), lambda k: F.element_at(F.col("setup_files"), k).isNull())).alias("n_missing"),
        F.size(F.filter(absent, lambda f: F.element_at(F.col("setup_files"), f).isNotNull())).alias("n_present"),
    )


@query(
    f"WITH {_ONCE} SELECT task_id, cardinality(oracle.expected_files) AS n_expected, len(list_filter(map_keys(oracle.expected_files), lambda k: setup_files[k] IS NULL)) AS n_missing,"
    " len(list_filter(map_keys(oracle.expected_files), lambda k: setup_files[k] IS NOT NULL AND sha256(setup_files[k]) IS DISTINCT FROM oracle.expected_files[k])) AS n_mismatched,"
    " coalesce(len(list_filter(oracle.absent_files, lambda f: setup_files[f] IS NOT NULL)), 0) AS n_present FROM tasks_once WHERE cardinality(oracle.expected_files) > 0 AND setup_files IS NOT NULL"
)
def expected_vs_hashes(spark, d):
    def mismatched(path, digest):
        found = F.element_at(F.col("setup_files"), path)
        return found.isNotNull() & ~F.sha2(found, 256).eqNullSafe(digest)

    absent = F.coalesce("oracle.absent_files", F.array().cast("array<string>"))
    rows = once(spark, d).where((F.size("oracle.expected_files") > 0) & F.col("setup_files").isNotNull())
    return rows.select(
        "task_id",
        F.size("oracle.expected_files").alias("n_expected"),
        F.size(F.filter(F.map_keys("oracle.expected_files"), lambda k: F.element_at(F.col("setup_files"), k).isNull())).alias("n_missing"),
        F.size(F.map_filter("oracle.expected_files", mismatched)).alias("n_mismatched"),
        F.size(F.filter(absent, lambda f: F.element_at(F.col("setup_files"), f).isNotNull())).alias("n_present"),
    )


@query(f"WITH {_CURRENT}, {_USABLE}, v AS (SELECT task_id, count(*) AS n_commands, bool_and(passed) AS all_, arg_min(failure_category, candidate_id) FILTER (NOT passed) AS first_ FROM usable GROUP BY 1) SELECT task_id, n_commands, n_commands >= 2 AND all_ AS valid, CASE WHEN n_commands < 2 THEN 'needs_two_commands' ELSE first_ END AS reason FROM v")
def validate_task(spark, d):
    return verify.valid_tasks(usable(spark, d), "task_id", "candidate_id")


# folds and samples


def _folded(spark, d, k=5):
    rows = table(spark, d, "documents").where("source is not null")
    return rows, folds.group_folds(rows, "source", k)


_FOLDS = (
    "RECURSIVE sizes AS (SELECT source, size, row_number() OVER (ORDER BY size DESC, source DESC) AS rn FROM (SELECT source, count(*) AS size FROM documents WHERE source IS NOT NULL GROUP BY source)),"
    " walk AS (SELECT 0::BIGINT AS rn, NULL::VARCHAR AS source, 0::BIGINT AS size, 0::BIGINT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS load"
    " UNION ALL SELECT s.rn, s.source, s.size, list_position(w.load, list_min(w.load))::BIGINT - 1, list_transform(w.load, lambda x, i: CASE WHEN i = list_position(w.load, list_min(w.load)) THEN x + s.size ELSE x END)"
    " FROM walk w JOIN sizes s ON s.rn = w.rn + 1), folds AS (SELECT source, size, fold FROM walk WHERE rn > 0)"
)


@query(f"WITH {_FOLDS} SELECT source, size, fold FROM folds")
def group_kfold(spark, d):
    return _folded(spark, d)[1]


@query(
    f"WITH {_FOLDS}, r AS (SELECT fold, coalesce(lang, 'none') AS lang FROM documents JOIN folds USING (source)), k AS (SELECT DISTINCT fold FROM folds)"
    " SELECT k.fold, count(*) FILTER (r.fold <> k.fold) AS n_train, count(*) FILTER (r.fold = k.fold) AS n_test, array_to_string(list_sort(list_distinct(list(r.lang) FILTER (r.fold <> k.fold))), ',') AS train_families, array_to_string(list_sort(list_distinct(list(r.lang) FILTER (r.fold = k.fold))), ',') AS test_families FROM k, r GROUP BY k.fold"
)
def fold_report(spark, d):
    rows, f = _folded(spark, d)
    return folds.fold_report(rows.withColumn("lang", F.coalesce("lang", F.lit("none"))), f, "source", "lang")


@query(f"WITH {_FOLDS}, r AS (SELECT doc_id, source, coalesce(lang, 'none') AS lang, fold FROM documents JOIN folds USING (source)) SELECT 'group' AS joined_by, count(*) AS n_test, count(*) FILTER (source IN (SELECT source FROM r WHERE fold <> 0)) AS n_leaked FROM r WHERE fold = 0 UNION ALL SELECT 'family', count(*), count(*) FILTER (lang IN (SELECT lang FROM r WHERE fold <> 0)) FROM r WHERE fold = 0")
def fold_leakage(spark, d):
    rows, f = _folded(spark, d)
    rows = rows.withColumn("lang", F.coalesce("lang", F.lit("none")))
    by = lambda key: folds.leaked(rows, f, "source", key)
    return by("source").select(F.lit("group").alias("joined_by"), "*").union(by("lang").select(F.lit("family"), "*"))


@query(f"WITH {_FOLDS}, r AS (SELECT fold, doc_id, row_number() OVER (PARTITION BY fold ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY fold) AS n FROM documents JOIN folds USING (source)) SELECT fold, doc_id FROM r WHERE CASE WHEN n > 100 THEN k % (n // 100) = 0 AND k < (n // 100) * 100 ELSE k < 100 END")
def stride_sample(spark, d):
    rows, f = _folded(spark, d)
    return folds.stride_sample(rows.join(f.select("source", "fold"), "source").select("fold", "doc_id"), "fold", "doc_id", 100)


@query(f"WITH {_ONCE} SELECT task_id, item_id FROM tasks_once JOIN heldout_items ON {_KEY.format(c='user_request')} = {_KEY.format(c='text')} WHERE {_KEY.format(c='text')} <> ''")
def benchmark_contamination(spark, d):
    items = table(spark, d, "heldout_items").select("item_id", tx.request_key(F.col("text")).alias("k")).where("k <> ''")
    return once(spark, d).select("task_id", tx.request_key(F.col("user_request")).alias("k")).join(items, "k").select("task_id", "item_id")


@query(
    f"WITH {_ONCE}, items AS (SELECT DISTINCT item_id, {_KEY.format(c='text')} AS item_key FROM heldout_items WHERE item_id IS NOT NULL AND {_KEY.format(c='text')} <> ''),"
    f" texts AS (SELECT 'document' AS found_in, CAST(doc_id AS VARCHAR) AS id, {_KEY.format(c='text')} AS k FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 'task', task_id, {_KEY.format(c='user_request')} FROM tasks_once)"
    " SELECT DISTINCT found_in, id, item_id FROM texts JOIN items ON contains(k, item_key)"
)
def benchmark_inside(spark, d):
    items = table(spark, d, "heldout_items").where("item_id is not null").select("item_id", tx.request_key(F.col("text")).alias("item_key"))
    docs = table(spark, d, "documents").where("doc_id is not null").select(F.lit("document").alias("found_in"), F.col("doc_id").cast("string").alias("id"), tx.request_key(F.col("text")).alias("k"))
    requests = once(spark, d).select(F.lit("task"), "task_id", tx.request_key(F.col("user_request")))
    return screen.containing(docs.union(requests), ["found_in", "id"], "k", items, "item_id", "item_key")


# families as queries

_DOCLINES = "doclines AS (SELECT doc_id, generate_subscripts(l, 1) AS lineno, unnest(l) AS line FROM (SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l FROM documents WHERE length(text) > 0))"


def _doc_lines(spark, d):
    return generate.lines(table(spark, d, "documents"), "doc_id", "text")


_FILES = f"{_ONCE}, files AS (SELECT task_id, unnest(map_keys(setup_files)) AS path, unnest(map_values(setup_files)) AS content FROM tasks_once WHERE setup_files IS NOT NULL), filelines AS (SELECT task_id, path, generate_subscripts(l, 1) AS lineno, unnest(l) AS line FROM (SELECT task_id, path, string_split(CASE WHEN ends_with(content, chr(10)) THEN left(content, length(content) - 1) ELSE content END, chr(10)) AS l FROM files WHERE length(content) > 0))"


def _files(spark, d):
    return generate.files(once(spark, d))


def _file_lines(spark, d):
    rows = _files(spark, d).withColumn("id", F.struct("task_id", "path"))
    return generate.lines(rows, "id", "content").select("id.task_id", "id.path", "lineno", "line")


@query(f"WITH {_DOCLINES} SELECT doc_id, lineno, line FROM doclines WHERE starts_with(line, '- ')")
def filter_level(spark, d):
    return _doc_lines(spark, d).where(F.col("line").startswith("- "))


@query(f"WITH {_FILES} SELECT regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) AS ext, len(string_split(path, '/')) AS depth, count(*) AS n FROM files GROUP BY 1, 2")
def count_extension(spark, d):
    return _files(spark, d).groupBy(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("ext"), F.size(F.split("path", "/")).alias("depth")).agg(F.count("*").alias("n"))


@query(f"WITH {_FILES} SELECT task_id, path FROM files WHERE ends_with(path, '.bak')")
def find_extension(spark, d):
    return _files(spark, d).where(F.col("path").endswith(".bak")).select("task_id", "path")


@query(f"WITH {_FILES} SELECT task_id, path, lineno, string_split(line, ',')[2] AS field FROM filelines WHERE ends_with(path, '.csv') AND lineno > 1")
def csv_column(spark, d):
    return _file_lines(spark, d).where(F.col("path").endswith(".csv") & (F.col("lineno") > 1)).select("task_id", "path", "lineno", F.get(F.split("line", ","), F.lit(1)).alias("field"))


@query(f"WITH {_FILES} SELECT task_id, path, count(*) AS n_lines, count(*) FILTER (contains(line, 'pump')) AS n_matches, count(*) FILTER (NOT regexp_matches(line, '(?i)PUMP')) AS n_others, max(length(line)) AS longest FROM filelines GROUP BY 1, 2")
def count_matches(spark, d):
    rows = _file_lines(spark, d)
    return rows.groupBy("task_id", "path").agg(F.count("*").alias("n_lines"), F.count_if(F.contains("line", F.lit("pump"))).alias("n_matches"), F.count_if(~F.col("line").rlike("(?i)PUMP")).alias("n_others"), F.max(F.length("line")).alias("longest"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents WHERE text IS NOT NULL) GROUP BY 1 ORDER BY n DESC, word LIMIT 10")
def top_words(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(10)


@query(f"WITH {_DOCLINES} SELECT doc_id, lineno, line FROM doclines WHERE lineno <= 3")
def head_lines(spark, d):
    return _doc_lines(spark, d).where("lineno <= 3")


@query(f"WITH {_DOCLINES}, z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lineno DESC) AS back FROM doclines) SELECT doc_id, back, line FROM z WHERE back <= 2")
def tail_lines(spark, d):
    w = Window.partitionBy("doc_id").orderBy(F.desc("lineno"))
    return _doc_lines(spark, d).withColumn("back", F.row_number().over(w)).where("back <= 2").select("doc_id", "back", "line")


@query(f"WITH {_DOCLINES} SELECT DISTINCT line FROM doclines")
def sorted_unique(spark, d):
    return _doc_lines(spark, d).select("line").distinct()


@query(f"WITH {_DOCLINES}, z AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY lineno) AS prev FROM doclines) SELECT doc_id, count(*) FILTER (prev IS DISTINCT FROM line) AS n_runs FROM z GROUP BY doc_id")
def adjacent_unique(spark, d):
    w = Window.partitionBy("doc_id").orderBy("lineno")
    return _doc_lines(spark, d).withColumn("prev", F.lag("line").over(w)).groupBy("doc_id").agg(F.count_if(~F.col("prev").eqNullSafe(F.col("line"))).alias("n_runs"))


@query(f"WITH {_FILES} SELECT task_id, path, sha256(replace(content, 'pump', 'valve')) AS digest FROM files WHERE content IS NOT NULL")
def replace_hash(spark, d):
    return _files(spark, d).where("content is not null").select("task_id", "path", F.sha2(F.replace("content", F.lit("pump"), F.lit("valve")), 256).alias("digest"))


@query(f"WITH {_FILES}, z AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY length(content) DESC, path) AS rn FROM files WHERE content IS NOT NULL) SELECT task_id, regexp_extract(path, '([^/]+)$', 1) AS basename, length(content) AS size FROM z WHERE rn = 1")
def largest_file(spark, d):
    rows = _files(spark, d).where("content is not null")
    best = rows.groupBy("task_id").agg(F.min(F.struct((-F.length("content")).alias("n"), "path")).alias("b"))
    return best.select("task_id", F.regexp_extract("b.path", "([^/]+)$", 1).alias("basename"), (-F.col("b.n")).alias("size"))


@query(f"WITH {_FILES} SELECT regexp_extract(path, '^([^/]+)/', 1) AS folder, sum(length(content)) AS size, count(*) AS n FROM files GROUP BY 1")
def folder_sizes(spark, d):
    return _files(spark, d).groupBy(F.regexp_extract("path", "^([^/]+)/", 1).alias("folder")).agg(F.sum(F.length("content")).alias("size"), F.count("*").alias("n"))


@query(f"WITH {_FILES}, n AS (SELECT task_id, path, lineno, TRY_CAST(string_split(line, ',')[3] AS BIGINT) AS v FROM filelines WHERE ends_with(path, '.csv') AND lineno > 1) SELECT task_id, path, sum(v) AS total, min(v) AS least, max(v) AS most FROM n WHERE v IS NOT NULL GROUP BY 1, 2")
def sum_column(spark, d):
    rows = _file_lines(spark, d).where(F.col("path").endswith(".csv") & (F.col("lineno") > 1)).withColumn("v", F.expr("try_cast(get(split(line, ','), 2) as bigint)"))
    return rows.where("v is not null").groupBy("task_id", "path").agg(F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))


@query("SELECT doc_id, regexp_replace(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g')), '#.*$', '') AS squeezed, translate(left(text, 80), 'abc', 'xyz') AS mapped FROM documents WHERE text IS NOT NULL")
def reformat_text(spark, d):
    squeezed = F.regexp_replace(F.trim(F.regexp_replace("text", r"[ \t\n]+", " ")), "#.*$", "")
    return table(spark, d, "documents").where("text is not null").select("doc_id", squeezed.alias("squeezed"), F.translate(F.left("text", F.lit(80)), "abc", "xyz").alias("mapped"))


@query("SELECT doc_id, regexp_replace(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g')), '#.*$', '') AS squeezed, translate(text, 'abc', 'xyz') AS mapped FROM documents WHERE text IS NOT NULL")
def reformat_whole(spark, d):
    squeezed = F.regexp_replace(F.trim(F.regexp_replace("text", r"[ \t\n]+", " ")), "#.*$", "")
    return table(spark, d, "documents").where("text is not null").select("doc_id", squeezed.alias("squeezed"), F.translate("text", "abc", "xyz").alias("mapped"))


@query(f"WITH {_ONCE}, a AS (SELECT DISTINCT c FROM (SELECT unnest(accepted_commands) AS c FROM tasks_once) WHERE c IS NOT NULL), b AS (SELECT DISTINCT command AS c FROM candidates WHERE command IS NOT NULL) SELECT CASE WHEN a.c IS NULL THEN 'second' WHEN b.c IS NULL THEN 'first' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.c = b.c GROUP BY 1")
def compare_sets(spark, d):
    a = once(spark, d).select(F.explode("accepted_commands").alias("c")).where("c is not null").distinct().withColumn("in_a", F.lit(1))
    b = table(spark, d, "candidates").select(F.col("command").alias("c")).where("c is not null").distinct().withColumn("in_b", F.lit(1))
    side = F.when(F.col("in_a").isNull(), "second").when(F.col("in_b").isNull(), "first").otherwise("both").alias("side")
    return a.join(b, "c", "full_outer").groupBy(side).agg(F.count("*").alias("n"))


# recipes and jobs


@query(f"SELECT difficulty, count(*) AS n, count(DISTINCT domain) AS n_domains FROM (SELECT unnest(range({len(records.DOMAINS)})) AS domain), (SELECT unnest(range({len(records.SKILLS)})) AS skill), (SELECT unnest(range({len(records.UTILITY_HINTS)})) AS utility), (SELECT unnest([" + ", ".join(f"'{x}'" for x in records.DIFFICULTIES) + "]) AS difficulty) GROUP BY difficulty")
def recipe_space(spark, d):
    space = generate.recipes(spark, records.DOMAINS, records.SKILLS, records.UTILITY_HINTS)
    return space.groupBy("difficulty").agg(F.count("*").alias("n"), F.count_distinct("domain").alias("n_domains"))


def _literals(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(
    f"WITH space AS (SELECT * FROM (SELECT unnest({_literals(records.DOMAINS)}) AS domain), (SELECT unnest({_literals(records.SKILLS)}) AS skill), (SELECT unnest({_literals(records.UTILITY_HINTS)}) AS utility), (SELECT unnest({_literals(records.DIFFICULTIES)}) AS difficulty)),"
    " r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '7', domain, skill, utility, difficulty)), domain, skill, utility, difficulty) - 1 AS index FROM space)"
    " SELECT *, 'Write one task about ' || domain || ' that needs ' || skill || ' with ' || utility || ' (' || difficulty || ').' AS prompt FROM r WHERE index < 200"
)
def recipe_sample(spark, d):
    space = generate.recipes(spark, records.DOMAINS, records.SKILLS, records.UTILITY_HINTS)
    picked = folds.hashed_sample(space, ["domain", "skill", "utility", "difficulty"], 200, 7)
    return picked.withColumn("prompt", F.concat(F.lit("Write one task about "), "domain", F.lit(" that needs "), "skill", F.lit(" with "), "utility", F.lit(" ("), "difficulty", F.lit(").")))


@query(f"WITH {_ONCE} SELECT source, hint, count(*) AS n FROM (SELECT task_id, unnest(['short', 'portable', 'no pipe']) AS hint FROM tasks_once), (SELECT DISTINCT source FROM candidates WHERE source IS NOT NULL) GROUP BY 1, 2")
def proposal_jobs(spark, d):
    # every task is proposed to every source with every hint: counted without building the product
    n = once(spark, d).agg(F.count("*").alias("n"))
    hints = F.explode(F.array(F.lit("short"), F.lit("portable"), F.lit("no pipe"))).alias("hint")
    # one row
    return table(spark, d, "candidates").where("source is not null").select("source").distinct().select("source", hints).crossJoin(F.broadcast(n))


@query()
def task_generator(spark, d):
    return generate.generate_tasks(spark, 5, 4)


@query(f"WITH {_ONCE} SELECT task_id AS id, 'task' AS kind, user_request AS body FROM tasks_once UNION ALL SELECT doc_id::VARCHAR, 'document', text FROM documents UNION ALL SELECT item_id::VARCHAR, 'heldout', text FROM heldout_items")
def union_sources(spark, d):
    part = lambda df, i, kind, body: df.select(F.col(i).cast("string").alias("id"), F.lit(kind).alias("kind"), F.col(body).alias("body"))
    tasks, docs, items = once(spark, d), table(spark, d, "documents"), table(spark, d, "heldout_items")
    return part(tasks, "task_id", "task", "user_request").unionByName(part(docs, "doc_id", "document", "text")).unionByName(part(items, "item_id", "heldout", "text"))


@query(f"WITH {_ONCE} SELECT task_id FROM tasks_once WHERE NOT EXISTS (SELECT 1 FROM sft WHERE sft.task_id = tasks_once.task_id)")
def resume_missing(spark, d):
    return once(spark, d).select("task_id").join(table(spark, d, "sft").select("task_id"), "task_id", "left_anti")


@query(f"WITH {_ONCE} SELECT DISTINCT sft_id, sft.task_id FROM sft JOIN tasks_once USING (task_id) WHERE lower(trim(split)) IN ('train', 'training')")
def train_rows(spark, d):
    train = once(spark, d).where(F.lower(F.trim("split")).isin("train", "training")).select("task_id")
    return table(spark, d, "sft").select("sft_id", "task_id").distinct().join(train, "task_id", "left_semi")


@query(f"SELECT DISTINCT task_id FROM candidates WHERE task_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.task_id = {_PLAIN.format(c='candidates.task_id')})")
def unknown_tasks(spark, d):
    known = table(spark, d, "tasks").select(F.col("task_id").alias("k"))
    rows = table(spark, d, "candidates").where("task_id is not null").select("task_id").distinct()
    return rows.join(known, tx.plain_id(F.col("task_id")) == F.col("k"), "left_anti")


@query("SELECT event_id, list_transform(range(1 + user_id % 6), lambda i: (event_id % 50) // (1 + user_id % 6) + CASE WHEN i < (event_id % 50) % (1 + user_id % 6) THEN 1 ELSE 0 END)::VARCHAR AS steps FROM events")
def spread_evenly(spark, d):
    steps = (F.lit(1) + F.col("user_id") % 6).cast("int")
    out = tx.spread_evenly((F.col("event_id") % 50).cast("int"), steps)
    return table(spark, d, "events").select("event_id", F.concat(F.lit("["), F.array_join(out.cast("array<string>"), ", "), F.lit("]")).alias("steps"))


@query("SELECT doc_id, CAST(ceil(n_chars / 32.0) * 32 AS BIGINT) AS padded FROM documents WHERE n_chars IS NOT NULL")
def pad_lengths(spark, d):
    return table(spark, d, "documents").where("n_chars is not null").select("doc_id", (F.ceil(F.col("n_chars") / 32.0) * 32).cast("long").alias("padded"))


@query("SELECT regexp_replace(model, '-(chat|base|sft|[0-9]+)$', '') AS label, count(*) AS n FROM candidates WHERE model IS NOT NULL GROUP BY 1")
def model_labels(spark, d):
    label = F.regexp_replace("model", r"-(chat|base|sft|[0-9]+)$", "").alias("label")
    return table(spark, d, "candidates").where("model is not null").groupBy(label).agg(F.count("*").alias("n"))


@query(f"WITH {_ONCE} SELECT coalesce(lower(trim(split)), 'none') AS split, count(DISTINCT provenance.template_family) AS n_families, array_to_string(list_sort(list_distinct(list(coalesce(provenance.template_family, 'none')))), ',') AS families FROM tasks_once GROUP BY 1")
def family_lists(spark, d):
    rows = once(spark, d).groupBy(F.coalesce(F.lower(F.trim("split")), F.lit("none")).alias("split"))
    family = F.coalesce("provenance.template_family", F.lit("none"))
    return rows.agg(F.count_distinct("provenance.template_family").alias("n_families"), F.array_join(F.array_sort(F.collect_set(family)), ",").alias("families"))


@query("SELECT doc_id, string_split(regexp_replace(text, '^[\\s]+', ''), chr(10))[1] AS first_line FROM documents WHERE text IS NOT NULL")
def first_line(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.get(F.split(F.regexp_replace("text", r"^[\s]+", ""), "\n"), F.lit(0)).alias("first_line"))


@query(f"WITH {_CURRENT}, {_USABLE} SELECT candidate_id, CASE WHEN forbidden THEN 'forbidden' WHEN fraction >= 1 THEN 'full' WHEN fraction > 0 THEN 'part' ELSE 'none' END AS outcome, left(coalesce(failure_category, ''), 12) AS preview FROM usable")
def outcome_preview(spark, d):
    outcome = F.when(F.col("forbidden"), "forbidden").when(F.col("fraction") >= 1, "full").when(F.col("fraction") > 0, "part").otherwise("none")
    return usable(spark, d).select("candidate_id", outcome.alias("outcome"), F.left(F.coalesce("failure_category", F.lit("")), F.lit(12)).alias("preview"))


@query("SELECT user_id, event_type, count(*) AS attempts, count(*) FILTER (value > 50) AS kept FROM events GROUP BY 1, 2")
def running_counts(spark, d):
    scratch = Scratch(spark, "running")
    out = f"{scratch.root}/out"
    rows = stream.event_stream(spark, f"{d}/events.parquet").withColumn("kept", F.col("value") > 50).withColumn("author", F.struct("user_id", "event_type"))

    def keep(batch: DataFrame, _id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream._once(stream.running_counts(rows, "author", "kept").writeStream.outputMode("complete").foreachBatch(keep), f"{scratch.root}/state")
    return spark.read.parquet(out).select("author.user_id", "author.event_type", "attempts", "kept")


# streams


def _window_sql(step: str) -> str:
    return f"SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS starts, strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS ends, count(*) AS n, round(sum(value), 4) AS total FROM ({step}) GROUP BY s"


@query(_window_sql("SELECT date_trunc('hour', ts) AS s, value FROM events"))
def tumbling_events(spark, d):
    return stream.windowed(spark, f"{d}/events.parquet", "tumbling")


@query(_window_sql("SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s, value FROM events"))
def sliding_events(spark, d):
    return stream.windowed(spark, f"{d}/events.parquet", "sliding")


@query(
    "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS fresh FROM events),"
    " s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)"
    " SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS starts, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS ends, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"
)
def session_events(spark, d):
    return stream.windowed(spark, f"{d}/events.parquet", "session")


_ARRIVED = (
    f"{_SCREENED}, arrived AS (SELECT t.task_id, t.ingested_at, s.signature, s.request_key, s.screen FROM tasks t JOIN screened s USING (task_id)),"
    " h1 AS (SELECT *, coalesce(screen, CASE WHEN row_number() OVER (PARTITION BY task_id, screen IS NULL ORDER BY ingested_at) > 1 THEN 'duplicate_task_id' END) AS r1 FROM arrived),"
    " h2 AS (SELECT *, coalesce(r1, CASE WHEN coalesce(request_key, '') <> '' AND row_number() OVER (PARTITION BY request_key, r1 IS NULL ORDER BY ingested_at, task_id) > 1 THEN 'duplicate_request' END) AS r2 FROM h1),"
    " h3 AS (SELECT *, coalesce(r2, CASE WHEN row_number() OVER (PARTITION BY signature, r2 IS NULL ORDER BY ingested_at, task_id) > 20 THEN 'signature_capped' END, 'ok') AS reason FROM h2)"
)


@query(f"WITH {_ARRIVED} SELECT task_id, signature, reason FROM h3")
def stream_admission(spark, d):
    # every delivery, repeated ones included, with the shape, key and screen of its task
    known = _screened(spark, d).select("task_id", "request_key", "signature", "screen")
    seq = F.date_format("ingested_at", "yyyyMMddHHmmssSSSSSS").alias("seq")
    rows = table(spark, d, "tasks").select("task_id", seq).join(known, "task_id")
    scratch = Scratch(spark, "arrivals")
    # arrivals in time order: one file per range of ingestion time
    rows.repartitionByRange(4, "seq").sortWithinPartitions("seq", "task_id").write.mode("overwrite").parquet(f"{scratch.root}/in")
    columns = "task_id string, request_key string, signature string, screen string, seq string"
    out = stream.admitted(spark, f"{scratch.root}/in", columns, "task_id", "request_key", "signature", ["seq", "task_id"], 20, screen="screen")
    return out.select("task_id", "signature", "reason")
