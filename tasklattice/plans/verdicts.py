"""Queries on recorded executions, evaluations and task folds, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import admit, folds, generate, labels, metrics, screen, verify
from ..session import table
from ..sources import records
from .catalog import _CLEAN, _CURRENT, _NEG, _USABLE, _GROUP, _LATEST, _ONCE, _PLAIN, _RISK, _SCREENED, _SIGNED, _screened, _signed, once, query, usable

# executions

_RUNS = (
    f"{_ONCE}, {_LATEST}, judged AS (SELECT c.candidate_id, {_PLAIN.format(c='c.task_id')} AS tid, c.verdict AS v, {_CLEAN.format(c='coalesce(c.command, chr(32))')} AS cleaned FROM latest_ c WHERE len(c.verdict.results) > 0),"
    " runs AS (SELECT candidate_id, tid, cleaned, v.syntax_valid AS syntax_valid, generate_subscripts(v.results, 1) - 1 AS variant, unnest(v.results) AS r FROM judged),"
    " joined AS (SELECT runs.*, t.setup_files AS files, t.oracle AS o, t.forbidden_side_effects AS forbids, coalesce(r.files_added, []) AS added, coalesce(r.files_removed, []) AS removed, coalesce(r.files_modified, []) AS modified FROM runs JOIN tasks_once t ON t.task_id = tid),"
    " counted AS (SELECT *, len(added) + len(removed) + len(modified) > 0 AS changed,"
    " list_sort(list_transform(list_filter(regexp_split_to_array(r.stdout, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda x: regexp_replace(x, '^[\\s]+|[\\s]+$', '', 'g') <> ''), lambda x: regexp_replace(x, '^\\./', ''))) AS got,"
    " list_sort(list_transform(o.stdout_lines_unordered, lambda x: regexp_replace(x, '^\\./', ''))) AS wanted,"
    " coalesce(len(list_filter(map_keys(o.expected_files), lambda k: sha256(files[k]) = o.expected_files[k] AND NOT list_contains(removed, k) AND NOT list_contains(modified, k))), 0) AS right_files,"
    " coalesce(cardinality(o.expected_files), 0) AS n_files, coalesce(len(o.absent_files), 0) AS n_absent,"
    " coalesce(len(list_filter(o.absent_files, lambda f: NOT ((list_contains(map_keys(files), f) AND NOT list_contains(removed, f)) OR list_contains(added, f) OR list_contains(modified, f)))), 0) AS gone FROM joined),"
    " checks AS (SELECT *, (o.stdout_exact IS NOT NULL)::INT AS n1, coalesce(r.stdout = o.stdout_exact OR regexp_replace(r.stdout, '^[\\s]+|[\\s]+$', '', 'g') = regexp_replace(o.stdout_exact, '^[\\s]+|[\\s]+$', '', 'g'), false)::INT AS h1,"
    " (wanted IS NOT NULL)::INT AS n2, coalesce(got = wanted, false)::INT AS h2, (o.exit_code IS NOT NULL)::INT AS n3, coalesce(r.exit_code = o.exit_code AND NOT coalesce(r.timed_out, false), false)::INT AS h3,"
    " coalesce(o.filesystem_unchanged, true)::INT AS n4, (coalesce(o.filesystem_unchanged, true) AND NOT changed)::INT AS h4 FROM counted),"
    " inst AS (SELECT *, n1 + n2 + n3 + n4 + n_files + n_absent AS total, h1 + h2 + h3 + h4 + right_files + gone AS held,"
    " CASE WHEN h1 < n1 THEN 'stdout_mismatch' WHEN h2 < n2 THEN 'stdout_set_mismatch' WHEN h3 < n3 THEN CASE WHEN r.timed_out THEN 'timeout' ELSE 'exit_code' END WHEN h4 < n4 THEN 'unexpected_filesystem_change'"
    " WHEN right_files < n_files THEN 'wrong_file_content' WHEN gone < n_absent THEN 'file_should_be_absent' END AS reason, coalesce(list_has_any(r.observed_side_effects, forbids), false) AS bad FROM checks),"
    " frac AS (SELECT *, CASE WHEN total > 0 THEN held / total ELSE 0 END AS fraction FROM inst)"
)
_VERDICTS = (
    f"{_RUNS}, agg AS (SELECT candidate_id, min(tid) AS tid, min(cleaned) AS cleaned, bool_and(coalesce(syntax_valid, true)) AS valid, count(*) FILTER (fraction >= 1 AND NOT bad) AS sp, count(*) AS st, avg(fraction) AS pp, bool_or(bad) AS fb, arg_min(coalesce(reason, 'unknown'), variant) FILTER (fraction < 1) AS first_ FROM frac GROUP BY candidate_id),"
    " red AS (SELECT *, sp = st AND NOT fb AS ok, CASE WHEN cleaned = '' THEN 'empty_output' WHEN NOT valid THEN 'syntax_error' END AS gate FROM agg),"
    " verdicts AS (SELECT candidate_id, tid AS task_id, CASE WHEN gate IS NULL THEN sp ELSE 0 END AS seeds_passed, CASE WHEN gate IS NULL THEN st ELSE 0 END AS seeds_total, CASE WHEN gate IS NULL THEN round(pp, 9) ELSE 0.0 END AS postconditions_passed,"
    " gate IS NULL AND fb AS forbidden_side_effect, gate IS NULL AND ok AS passed, gate IS NULL AS syntax_valid,"
    " coalesce(gate, CASE WHEN ok THEN 'none' WHEN fb THEN 'forbidden_side_effect' WHEN coalesce(first_, 'unknown') = 'unknown' AND sp > 0 THEN 'fixture_overfit' ELSE coalesce(first_, 'unknown') END) AS failure_category FROM red)"
)


def _recorded(spark, d):
    """The latest delivery of every candidate with recorded executions, by task."""
    rows = table(spark, d, "candidates").where("candidate_id is not null")
    held = F.max(F.struct("recorded_at", tx.plain_id(F.col("task_id")).alias("task_id"), "command", F.col("verdict.syntax_valid").alias("syntax_valid"), F.col("verdict.results").alias("results"))).alias("r")
    rows = rows.groupBy("candidate_id").agg(held).select("candidate_id", "r.task_id", "r.command", "r.syntax_valid", "r.results").where(F.size("results") > 0)
    return rows.withColumn("cleaned", tx.clean_command(F.coalesce("command", F.lit(" "))))


def _executions(spark, d):
    runs = _recorded(spark, d).select("candidate_id", "task_id", "cleaned", "syntax_valid", F.posexplode("results").alias("variant", "r")).select("candidate_id", "task_id", "cleaned", "syntax_valid", "variant", "r.*")
    tasks = once(spark, d).select("task_id", "setup_files", "oracle", "forbidden_side_effects")
    rows = runs.join(tasks, "task_id")
    return rows.withColumn("file_hashes", verify.state_after(F.col("setup_files"), F.col("files_added"), F.col("files_removed"), F.col("files_modified")))


def _verdicts(spark, d):
    keys = ["candidate_id", "task_id", "cleaned", "syntax_valid"]
    out = verify.reduce_verdicts(verify.checked(_executions(spark, d)), keys, "variant")
    out = verify.gated(out, F.col("cleaned"), F.col("syntax_valid"))
    return out.withColumn("postconditions_passed", F.round("postconditions_passed", 9))


@query(f"WITH {_RUNS} SELECT candidate_id, variant, round(fraction, 9) AS fraction, reason, bad AS forbidden FROM frac")
def check_executions(spark, d):
    rows = verify.checked(_executions(spark, d))
    return rows.select("candidate_id", "variant", F.round("fraction", 9).alias("fraction"), "reason", "forbidden")


@query(f"WITH {_VERDICTS} SELECT candidate_id, task_id, seeds_passed, seeds_total, postconditions_passed, forbidden_side_effect, passed, syntax_valid, failure_category FROM verdicts")
def verify_candidates(spark, d):
    return _verdicts(spark, d).select("candidate_id", "task_id", "seeds_passed", "seeds_total", "postconditions_passed", "forbidden_side_effect", "passed", "syntax_valid", "failure_category")


@query(f"WITH {_RUNS} SELECT candidate_id, variant, array_to_string(list_filter([CASE WHEN length(r.stdout) > 0 THEN 'stdout' END, CASE WHEN length(r.stderr) > 0 THEN 'stderr' END, CASE WHEN len(added) + len(modified) > 0 THEN 'filesystem_write' END, CASE WHEN len(removed) > 0 THEN 'filesystem_delete' END], lambda x: x IS NOT NULL), ',') AS effects FROM joined")
def observed_effects(spark, d):
    found = tx.effects(F.col("stdout"), F.col("stderr"), F.col("files_added"), F.col("files_removed"), F.col("files_modified"))
    return _executions(spark, d).select("candidate_id", "variant", F.array_join(found, ",").alias("effects"))


_FAILED = (
    f"{_CURRENT}, {_ONCE}, failed AS (SELECT c.*, {_CLEAN.format(c='coalesce(c.command, chr(32))')} AS generated FROM current_ c WHERE NOT c.passed),"
    f" shown AS (SELECT f.candidate_id, f.task_id, t.provenance.template_family AS template_family, t.user_request AS request, f.generated, t.accepted_commands[1] AS reference, f.failure_category, CASE WHEN isnan(f.fraction) THEN NULL ELSE round(f.fraction, 3) END AS postconditions_passed, CASE WHEN f.generated = '' THEN 'empty' ELSE {_RISK.format(c='f.generated')} END AS static_risk FROM failed f JOIN tasks_once t ON t.task_id = f.task_id)"
)


@query(f"WITH {_FAILED} SELECT * FROM shown")
def failure_rows(spark, d):
    rows = labels.current(table(spark, d, "candidates")).where("not passed").withColumn("generated", tx.clean_command(F.coalesce("command", F.lit(" "))))
    tasks = once(spark, d).select("task_id", F.col("provenance.template_family").alias("template_family"), F.col("user_request").alias("request"), F.get("accepted_commands", F.lit(0)).alias("reference"))
    risk = F.when(F.col("generated") == "", "empty").otherwise(tx.static_risk(F.col("generated")))
    share = F.when(~F.isnan("fraction"), F.round("fraction", 3)).alias("postconditions_passed")
    return rows.join(tasks, "task_id").select("candidate_id", "task_id", "template_family", "request", "generated", "reference", "failure_category", share, risk.alias("static_risk"))


_RATE = "round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 4)"
_EVALUATED = (
    f"{_ONCE}, {_LATEST}, ev AS (SELECT c.source, c.model, c.verdict.passed AS passed, c.verdict.forbidden_side_effect AS forbidden, c.verdict.syntax_valid AS syntax_valid,"
    f" c.command <> '' AND NOT contains(regexp_replace(c.command, '^[\\s]+|[\\s]+$', '', 'g'), chr(10)) AND {_CLEAN.format(c='c.command')} <> '' AS is_one_line, coalesce(t.oracle.filesystem_unchanged, true) AS still,"
    " coalesce(len(c.verdict.results[1].files_added), 0) + coalesce(len(c.verdict.results[1].files_removed), 0) + coalesce(len(c.verdict.results[1].files_modified), 0) > 0 AS changed"
    f" FROM latest_ c LEFT JOIN tasks_once t ON t.task_id = {_PLAIN.format(c='c.task_id')} WHERE c.model IS NOT NULL)"
)


@query(f"WITH {_EVALUATED} SELECT source, model, count(*) AS n, {_RATE.replace('{c}', 'passed')} AS pass_at_1, {_RATE.replace('{c}', 'forbidden')} AS forbidden_rate, {_RATE.replace('{c}', 'NOT coalesce(passed, false) AND still AND changed')} AS unintended_write_rate, {_RATE.replace('{c}', 'syntax_valid')} AS syntax_valid_rate, {_RATE.replace('{c}', 'is_one_line')} AS one_line_rate FROM ev GROUP BY 1, 2")
def evaluation_of_runs(spark, d):
    rows = table(spark, d, "candidates").where("candidate_id is not null")
    first = F.get("verdict.results", F.lit(0))
    v = F.col("verdict")
    held = F.max(
        F.struct(
            "recorded_at", tx.plain_id(F.col("task_id")).alias("task_id"), "source", "model", "command", v["passed"].alias("passed"), v["forbidden_side_effect"].alias("forbidden"), v["syntax_valid"].alias("syntax_valid"),
            verify.changed_files(first["files_added"], first["files_removed"], first["files_modified"]).alias("changed"),
        )
    ).alias("r")
    rows = rows.groupBy("candidate_id").agg(held).select("r.*").where("model is not null").withColumn("is_one_line", tx.one_line(F.col("command")))
    wanted = once(spark, d).select("task_id", F.col("oracle.filesystem_unchanged").alias("unchanged"))
    return metrics.evaluation_of_runs(rows.join(wanted, "task_id", "left"), ["source", "model"])


@query(
    f"WITH {_ONCE}, {_LATEST}, ex AS (SELECT c.candidate_id, generate_subscripts(c.verdict.results, 1) - 1 AS variant, unnest(c.verdict.results) AS r, {_PLAIN.format(c='c.task_id')} AS tid FROM latest_ c WHERE len(c.verdict.results) > 0)"
    " SELECT candidate_id, variant, coalesce(array_to_string(list_sort(list_filter(map_keys(t.setup_files), lambda k: list_contains(r.files_modified, k))), ','), '') AS rewritten, coalesce(array_to_string(list_sort(list_intersect(map_keys(t.setup_files), r.files_removed)), ','), '') AS absent FROM ex JOIN tasks_once t ON t.task_id = tid WHERE t.setup_files IS NOT NULL"
)
def derived_oracles(spark, d):
    rows = _executions(spark, d).where("setup_files is not null").withColumn("before", F.transform_values("setup_files", lambda k, v: F.coalesce(F.sha2(v, 256), F.lit("-"))))
    rows = rows.withColumn("o", verify.derived_oracle(F.col("before"), F.col("file_hashes")))
    known = F.filter(F.map_keys("o.expected_files"), lambda k: F.array_contains(F.map_keys("before"), k) & F.array_contains(F.coalesce("files_modified", F.array().cast("array<string>")), k))
    return rows.select("candidate_id", "variant", F.array_join(F.array_sort(known), ",").alias("rewritten"), F.array_join("o.absent_files", ",").alias("absent"))


_AGREE = "CASE WHEN n < 2 THEN 'single_command' WHEN n_out > 1 THEN 'commands_disagree_stdout' WHEN n_changes > 1 THEN 'commands_disagree_filesystem' ELSE 'agree' END"


@query(
    f"WITH {_LATEST}, ex AS (SELECT {_PLAIN.format(c='task_id')} AS task_id, verdict.results[1] AS r FROM latest_ WHERE len(verdict.results) > 0 AND task_id IS NOT NULL),"
    " g AS (SELECT task_id, count(DISTINCT r.command) AS n, count(DISTINCT coalesce(r.stdout, '') || '#' || coalesce(r.exit_code::VARCHAR, '')) AS n_out, count(DISTINCT array_to_string(list_sort(coalesce(r.files_added, [])), '/') || '#' || array_to_string(list_sort(coalesce(r.files_removed, [])), '/') || '#' || array_to_string(list_sort(coalesce(r.files_modified, [])), '/')) AS n_changes FROM ex GROUP BY task_id)"
    f" SELECT task_id, n AS n_commands, {_AGREE} AS outcome FROM g"
)
def command_agreement(spark, d):
    rows = _recorded(spark, d).where("task_id is not null").select("task_id", F.get("results", F.lit(0)).alias("r"))
    none = F.array().cast("array<string>")
    said = F.concat(F.coalesce("r.stdout", F.lit("")), F.lit("#"), F.coalesce(F.col("r.exit_code").cast("string"), F.lit("")))
    changes = F.concat_ws("#", *[F.array_join(F.array_sort(F.coalesce(f"r.{c}", none)), "/") for c in ("files_added", "files_removed", "files_modified")])
    g = rows.groupBy("task_id").agg(F.count_distinct("r.command").alias("n_commands"), F.count_distinct(said).alias("n_out"), F.count_distinct(changes).alias("n_changes"))
    outcome = F.when(F.col("n_commands") < 2, "single_command").when(F.col("n_out") > 1, "commands_disagree_stdout").when(F.col("n_changes") > 1, "commands_disagree_filesystem").otherwise("agree")
    return g.select("task_id", "n_commands", outcome.alias("outcome"))


@query(
    f"WITH {_LATEST} SELECT candidate_id, 'exit ' || coalesce(r.exit_code::VARCHAR, 'none') || chr(10) || left(coalesce(r.stdout, ''), 800) || chr(10) || left(coalesce(r.stderr, ''), 400) || chr(10) || 'added ' || coalesce(array_to_string(r.files_added, ','), '') || ' modified ' || coalesce(array_to_string(r.files_modified, ','), '') || ' removed ' || coalesce(array_to_string(r.files_removed, ','), '') AS evidence"
    " FROM (SELECT candidate_id, verdict.results[1] AS r FROM latest_ WHERE len(verdict.results) > 0)"
)
def judge_evidence(spark, d):
    return _recorded(spark, d).select("candidate_id", labels.evidence(F.get("results", F.lit(0))).alias("evidence"))


# admission, quotas and folds of tasks

_ANCHOR = "coalesce(provenance.template_family, 'llm_authored') <> 'llm_authored'"
_ANCHORED = (
    f"{_SCREENED}, a0 AS (SELECT *, {_ANCHOR} AS anchor FROM screened),"
    " a1 AS (SELECT *, row_number() OVER (PARTITION BY request_key, screen IS NULL AND NOT anchor ORDER BY ingested_at, task_id) AS k FROM a0),"
    " a2 AS (SELECT *, coalesce(screen, CASE WHEN NOT anchor AND coalesce(request_key, '') <> '' AND k > 1 THEN 'duplicate_request' END) AS r2 FROM a1),"
    " a3 AS (SELECT *, row_number() OVER (PARTITION BY signature, r2 IS NULL ORDER BY NOT anchor, ingested_at, task_id) AS m FROM a2),"
    " anchored AS (SELECT *, coalesce(r2, CASE WHEN NOT anchor AND m > greatest(5, (SELECT count(*) FROM tasks_once) // 50) THEN 'signature_capped' END, 'ok') AS reason FROM a3)"
)


def _anchored(spark, d):
    n = table(spark, d, "tasks").where("task_id is not null").select("task_id").distinct().count()
    anchor = F.coalesce("provenance.template_family", F.lit("llm_authored")) != "llm_authored"
    return admit.admission(_screened(spark, d), "task_id", "request_key", "signature", ["ingested_at", "task_id"], admit.shape_cap(n), F.col("screen"), anchor)


@query(f"WITH {_ANCHORED} SELECT task_id, signature, reason FROM anchored")
def admission_anchored(spark, d):
    return _anchored(spark, d).select("task_id", "signature", "reason")


_LISTED = "coalesce((SELECT array_to_string(list_sort(list(k || '=' || n::VARCHAR)), ',') FROM (SELECT {k} AS k, count(*) AS n FROM {t} GROUP BY 1)), '')"


@query(
    f"WITH {_ANCHORED}, kept AS (SELECT * FROM anchored WHERE reason = 'ok') SELECT (SELECT count(*) FROM kept) AS n_tasks, (SELECT coalesce(sum(len(list_distinct(list_filter(accepted_commands, lambda c: c IS NOT NULL)))), 0) FROM kept) AS n_sft_records,"
    " (SELECT count(*) FROM kept WHERE anchor) AS n_procedural, (SELECT count(*) FROM kept WHERE NOT anchor) AS n_llm_authored, (SELECT count(DISTINCT signature) FROM kept) AS distinct_signatures,"
    f" {_LISTED.format(k='reason', t='anchored')} AS rejection_reasons, {_LISTED.format(k=chr(99) + 'oalesce(provenance.template_family, ' + chr(39) + 'none' + chr(39) + ')', t='kept')} AS families,"
    " (SELECT array_to_string(list(signature || '=' || n::VARCHAR ORDER BY n DESC, signature), ',') FROM (SELECT signature, count(*) AS n FROM kept GROUP BY 1 ORDER BY n DESC, signature LIMIT 8)) AS top_signatures"
)
def corpus_report(spark, d):
    rows = _anchored(spark, d)
    kept = rows.where("reason = 'ok'")
    anchor = F.coalesce("provenance.template_family", F.lit("llm_authored")) != "llm_authored"
    commands = F.size(F.array_distinct(F.filter("accepted_commands", lambda c: c.isNotNull())))
    one = kept.agg(F.count("*").alias("n_tasks"), F.coalesce(F.sum(F.greatest(commands, F.lit(0))), F.lit(0)).alias("n_sft_records"), F.count_if(anchor).alias("n_procedural"), F.count_if(~anchor).alias("n_llm_authored"), F.count_distinct("signature").alias("distinct_signatures"))
    top = kept.groupBy("signature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "signature").limit(8)
    ranked = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "signature"))), lambda x: F.concat(x["signature"], F.lit("="), (-x["m"]).cast("string"))), ",")
    family = F.coalesce("provenance.template_family", F.lit("none"))
    # one row each
    return one.crossJoin(metrics.listed(rows, F.col("reason"), "rejection_reasons")).crossJoin(metrics.listed(kept, family, "families")).crossJoin(top.agg(ranked.alias("top_signatures")))


@query(
    f"WITH {_CURRENT}, authors AS (SELECT source, row_number() OVER (ORDER BY source) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM current_ WHERE source IS NOT NULL)),"
    " shares AS (SELECT source, floor(5000 / n) + CASE WHEN place <= 5000 % n THEN 1 ELSE 0 END AS quota FROM authors),"
    " tried AS (SELECT c.candidate_id, c.source, c.passed, s.quota, row_number() OVER (PARTITION BY c.source ORDER BY c.candidate_id) AS rn FROM current_ c JOIN shares s USING (source)),"
    " kept AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY candidate_id) AS k FROM tried WHERE passed AND rn <= greatest(floor(quota * 1.25), 8)) SELECT candidate_id, source FROM kept WHERE k <= quota"
)
def quota_with_ceiling(spark, d):
    rows = labels.current(table(spark, d, "candidates")).select("candidate_id", "source", "passed")
    authors = rows.where("source is not null")
    return admit.quota_with_ceiling(rows, "source", ["candidate_id"], F.col("passed"), 5000, authors, 1.25, 8).select("candidate_id", "source")


@query(
    f"WITH {_CURRENT}, {_USABLE}, {_NEG}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY length(command), candidate_id) AS rn FROM usable WHERE passed),"
    " dpo AS (SELECT n.candidate_id FROM neg n JOIN r ON n.task_id = r.task_id AND r.rn = 1 WHERE n.rank <= 3 AND n.command <> '' AND n.command <> r.command), fails AS (SELECT * FROM usable WHERE NOT passed)"
    " SELECT (SELECT count(DISTINCT task_id) FROM usable) AS n_tasks, (SELECT count(DISTINCT task_id) FROM usable WHERE passed) AS n_verified, (SELECT count(DISTINCT (task_id, command)) FROM usable WHERE passed) AS n_sft_records, (SELECT count(*) FROM dpo) AS n_dpo_pairs,"
    f" {_LISTED.format(k=chr(99) + 'oalesce(source, ' + chr(39) + 'none' + chr(39) + ')', t='usable')} AS per_teacher, {_LISTED.format(k=chr(99) + 'oalesce(failure_category, ' + chr(39) + 'missing' + chr(39) + ')', t='fails')} AS failure_categories"
)
def dataset_report(spark, d):
    rows = usable(spark, d)
    one = rows.groupBy("task_id").agg(F.bool_or("passed").alias("v")).agg(F.count("*").alias("n_tasks"), F.count_if("v").alias("n_verified"))
    sft = rows.where("passed").select("task_id", "command").distinct().agg(F.count("*").alias("n_sft_records"))
    dpo = labels.preference_pairs(rows).agg(F.count("*").alias("n_dpo_pairs"))
    teachers = metrics.listed(rows, F.coalesce("source", F.lit("none")), "per_teacher")
    failures = metrics.listed(rows.where("not passed"), F.coalesce("failure_category", F.lit("missing")), "failure_categories")
    # one row each
    return one.crossJoin(sft).crossJoin(dpo).crossJoin(teachers).crossJoin(failures)


_TASKFOLDS = (
    f"RECURSIVE {_SIGNED}, keyed AS (SELECT task_id, provenance.template_family AS family, {_GROUP} AS group_key FROM signed), sizes AS (SELECT group_key, size, row_number() OVER (ORDER BY size DESC, group_key DESC) AS rn FROM (SELECT group_key, count(*) AS size FROM keyed GROUP BY group_key)),"
    " walk AS (SELECT 0::BIGINT AS rn, NULL::VARCHAR AS group_key, 0::BIGINT AS size, 0::BIGINT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS load"
    " UNION ALL SELECT s.rn, s.group_key, s.size, list_position(w.load, list_min(w.load))::BIGINT - 1, list_transform(w.load, lambda x, i: CASE WHEN i = list_position(w.load, list_min(w.load)) THEN x + s.size ELSE x END)"
    " FROM walk w JOIN sizes s ON s.rn = w.rn + 1), folds AS (SELECT group_key, size, fold FROM walk WHERE rn > 0)"
)


def _keyed(spark, d):
    rows = _signed(spark, d)
    family = F.col("provenance.template_family")
    return rows.select("task_id", family.alias("family"), tx.group_key(family, F.col("signature")).alias("group_key"))


@query(f"WITH {_TASKFOLDS} SELECT group_key, size, fold FROM folds")
def task_folds(spark, d):
    return folds.group_folds(_keyed(spark, d), "group_key", 5)


@query(
    f"WITH {_TASKFOLDS}, r AS (SELECT k.*, f.fold FROM keyed k JOIN folds f USING (group_key)), g AS (SELECT group_key AS v, count(DISTINCT fold) AS c FROM r GROUP BY 1), m AS (SELECT family AS v, count(DISTINCT fold) AS c FROM r WHERE family IS NOT NULL GROUP BY 1)"
    " SELECT r.fold, 'group' AS joined_by, count(*) AS n_test, count(*) FILTER (g.c > 1) AS n_leaked FROM r LEFT JOIN g ON g.v = r.group_key GROUP BY 1 UNION ALL SELECT r.fold, 'family', count(*), count(*) FILTER (m.c > 1) FROM r LEFT JOIN m ON m.v = r.family GROUP BY 1"
)
def task_fold_leakage(spark, d):
    rows = _keyed(spark, d)
    fold_of = folds.group_folds(rows, "group_key", 5)
    by = lambda key, name: folds.leaked_by_fold(rows, fold_of, "group_key", key).select("fold", F.lit(name).alias("joined_by"), "n_test", "n_leaked")
    return by("group_key", "group").union(by("family", "family"))


@query(f"WITH {_TASKFOLDS} SELECT DISTINCT s.sft_id, s.task_id, k.fold AS held_fold FROM sft s JOIN (SELECT task_id, fold FROM keyed JOIN folds USING (group_key)) t USING (task_id) CROSS JOIN (SELECT DISTINCT fold FROM folds) k WHERE t.fold <> k.fold")
def fold_train_rows(spark, d):
    rows = _keyed(spark, d)
    fold_of = rows.join(folds.group_folds(rows, "group_key", 5), "group_key").select("task_id", "fold")
    # every record trains for all folds but its own
    others = F.array_remove(F.array(*[F.lit(k) for k in range(5)]), F.col("fold"))
    return table(spark, d, "sft").select("sft_id", "task_id").distinct().join(fold_of, "task_id").select("sft_id", "task_id", F.explode(others).alias("held_fold"))


# projections

_HINTS = ["short", "portable", "no pipe"]


@query(f"WITH {_ONCE}, src AS (SELECT DISTINCT provider AS source FROM judges WHERE provider IS NOT NULL) SELECT task_id, source, pos - 1 AS position, hint FROM tasks_once, src, (SELECT unnest(['short', 'portable', 'no pipe']) AS hint, unnest([1, 2, 3]) AS pos) WHERE pos <= 2")
def job_rows(spark, d):
    # the providers are a fixed dimension, as are the hints
    providers = sorted(r[0] for r in table(spark, d, "judges").where("provider is not null").select("provider").distinct().collect())
    each = F.explode(F.array(*map(F.lit, providers)).cast("array<string>")).alias("source")
    rows = once(spark, d).select("task_id", F.posexplode(F.slice(F.array(*map(F.lit, _HINTS)), 1, 2)).alias("position", "hint"))
    return rows.select("task_id", each, "position", "hint")


@query(f"WITH {_ONCE} SELECT task_id, user_request FROM tasks_once ORDER BY task_id LIMIT 20")
def first_prompts(spark, d):
    return records.load_prompts(once(spark, d), 20)


@query(f"WITH v AS (SELECT {_PLAIN.format(c='unnest(map_keys(judge_votes))')} AS judge FROM candidates) SELECT judge, count(*) AS n FROM v WHERE judge IN (SELECT judge FROM judges WHERE active) GROUP BY 1")
def known_judges(spark, d):
    named = table(spark, d, "candidates").select(F.explode(F.map_keys("judge_votes")).alias("j")).select(tx.plain_id(F.col("j")).alias("judge"))
    return metrics.known_counts(named, "judge", table(spark, d, "judges").where("active").select("judge"))


@query("SELECT judge, provider, count(DISTINCT judge_model) AS n_models, bool_or(active) AS active FROM judges GROUP BY 1, 2")
def provider_dims(spark, d):
    return table(spark, d, "judges").groupBy("judge", "provider").agg(F.count_distinct("judge_model").alias("n_models"), F.bool_or("active").alias("active"))


@query(
    f"WITH {_ONCE} SELECT task_id, CASE WHEN risk_class IN ('read_only', 'local_write') THEN risk_class ELSE 'read_only' END AS risk, CASE WHEN risk_class = 'local_write' THEN 'stdout,stderr,filesystem_write' ELSE 'stdout,stderr' END AS allowed,"
    " array_to_string(list_concat(list_slice(coalesce(difficulty_tags, []), 1, 4), ['multi_stage']), ',') AS tags FROM tasks_once"
)
def authored_defaults(spark, d):
    allowed, _ = screen.effects_of(F.col("risk_class"))
    tags = F.concat(F.slice(F.coalesce("difficulty_tags", F.array().cast("array<string>")), 1, 4), F.array(F.lit("multi_stage")))
    return once(spark, d).select("task_id", screen.risk_class(F.col("risk_class")).alias("risk"), F.array_join(allowed, ",").alias("allowed"), F.array_join(tags, ",").alias("tags"))


@query(
    "SELECT candidate_id, coalesce(regexp_replace(command, '^[\\s]+|[\\s]+$', '', 'g'), '') AS command, coalesce(risk, 'unknown') AS risk, coalesce(requires_confirmation, false) AS requires_confirmation, coalesce(array_to_string(list_slice(assumptions, 1, 4), '|'), '') AS assumptions FROM candidates"
)
def parsed_candidates(spark, d):
    # the answer as a model gives it, JSON within other text, and back
    fields = "command string, risk string, requires_confirmation boolean, assumptions array<string>"
    said = F.concat(F.lit("Here it is:\n"), F.to_json(F.struct("command", "risk", "requires_confirmation", "assumptions")), F.lit("\nDone."))
    rows = table(spark, d, "candidates").select("candidate_id", tx.embedded_json(said, fields).alias("j"))
    return labels.candidate_fields(rows, "candidate_id", "j")


@query("WITH s AS (SELECT DISTINCT sft_id, len(messages) AS n, list_sum(list_transform(messages, lambda m: length(coalesce(m.content, '')))) AS size FROM sft WHERE messages IS NOT NULL AND sft_id IS NOT NULL) SELECT sft_id, least(size, 256)::BIGINT AS kept, (ceil(least(size, 256) / 32.0) * 32)::BIGINT AS padded FROM s")
def truncated_lengths(spark, d):
    rows = table(spark, d, "sft").where("messages is not null and sft_id is not null")
    size = F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.length(F.coalesce(m["content"], F.lit(""))))
    return rows.select("sft_id", "messages", size.alias("size")).select("sft_id", F.size("messages").alias("n"), "size").distinct().select("sft_id", F.least("size", F.lit(256)).alias("kept"), labels.padded(F.least("size", F.lit(256)), 32).alias("padded"))


@query(
    "WITH s AS (SELECT DISTINCT sft_id, length(coalesce(array_to_string(list_transform(list_filter(messages, lambda m: m.role <> 'assistant'), lambda m: coalesce(m.content, '')), ''), ''))::BIGINT AS p, length(coalesce((list_filter(messages, lambda m: m.role = 'assistant')[1]).content, ''))::BIGINT AS a FROM sft WHERE messages IS NOT NULL AND sft_id IS NOT NULL)"
    " SELECT sft_id, greatest(least(p + a, 256) - least(p, 256), 0) AS n_response, least(p, 256) AS n_prompt FROM s"
)
def response_masks(spark, d):
    rows = table(spark, d, "sft").where("messages is not null and sft_id is not null")
    prompt = F.length(F.array_join(F.transform(F.filter("messages", lambda m: m["role"] != "assistant"), lambda m: F.coalesce(m["content"], F.lit(""))), ""))
    answer = F.length(F.coalesce(F.get(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(0))["content"], F.lit("")))
    sized = rows.select("sft_id", prompt.cast("long").alias("p"), answer.cast("long").alias("a")).distinct()
    mask = labels.response_mask(F.col("p"), F.col("p") + F.col("a"), 256, 32)
    return sized.select("sft_id", F.size(F.filter(mask, lambda x: x)).cast("long").alias("n_response"), F.least("p", F.lit(256)).alias("n_prompt"))


@query(f"WITH {_ONCE} SELECT coalesce(provenance.template_family, 'none') AS family, count(*) AS n, array_to_string(list(task_id ORDER BY task_id), ',') AS task_ids FROM tasks_once WHERE coalesce(provenance.template_family, 'none') <> 'llm_authored' GROUP BY 1")
def tasks_by_family(spark, d):
    family = F.coalesce("provenance.template_family", F.lit("none"))
    rows = once(spark, d).where(family != "llm_authored")
    return rows.groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("task_id")), ",").alias("task_ids"))


@query(f"WITH {_ONCE} SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS position, (row_number() OVER (ORDER BY task_id) - 1) // 32 AS batch FROM tasks_once")
def batch_numbers(spark, d):
    from ..operators.ranks import running

    rows = running(once(spark, d).select("task_id", F.lit(0).alias("_all")), "_all", ["task_id"], F.lit(1).cast("long"), "position")
    return rows.select("task_id", (F.col("position") - 1).alias("position"), F.floor((F.col("position") - 1) / 32).alias("batch"))


@query(f"WITH {_CURRENT}, e AS (SELECT source, count(*) AS n, count(*) FILTER (passed) AS k FROM current_ WHERE source IS NOT NULL GROUP BY 1) SELECT source, n, printf('%.2f%%', 100.0 * k / n) AS share FROM e")
def percent_report(spark, d):
    rows = labels.current(table(spark, d, "candidates")).where("source is not null")
    each = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if("passed").alias("k"))
    return each.orderBy(F.desc("k"), "source").select("source", "n", metrics.percent(F.col("k") / F.col("n")).alias("share"))


@query(f"WITH {_ONCE} SELECT task_id, CASE WHEN s.task_id IS NULL THEN 'missing' ELSE 'done' END AS state FROM tasks_once LEFT JOIN (SELECT DISTINCT task_id FROM sft) s USING (task_id)")
def completion_state(spark, d):
    done = table(spark, d, "sft").select("task_id").distinct().withColumn("_done", F.lit(True))
    return once(spark, d).select("task_id").join(done, "task_id", "left").select("task_id", F.when(F.col("_done"), "done").otherwise("missing").alias("state"))


@query(f"WITH {_ONCE} SELECT coalesce(nullif(left(array_to_string(list_sort(list(DISTINCT provenance.template_family)), '-'), 60), ''), 'run') AS tag FROM tasks_once WHERE provenance.template_family IS NOT NULL")
def run_tag(spark, d):
    # as many names as fill 60 characters are enough
    names = once(spark, d).select(F.col("provenance.template_family").alias("f")).where("f is not null").distinct().orderBy("f").limit(61)
    return names.agg(tx.name_tag(F.array_sort(F.collect_list("f")), 60).alias("tag"))


@query(f"WITH {_CURRENT}, m AS (SELECT regexp_replace(model, '-(sft|[0-9]+)$', '') AS name, CASE WHEN regexp_matches(model, '-(sft|[0-9]+)$') THEN 'tuned' ELSE 'base' END AS variant, passed FROM current_ WHERE model IS NOT NULL), e AS (SELECT name, variant, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 4) AS p FROM m GROUP BY 1, 2), w AS (SELECT name, max(p) FILTER (variant = 'base') AS base, max(p) FILTER (variant = 'tuned') AS tuned FROM e GROUP BY 1) SELECT name, base, tuned, round(tuned - base, 4) AS delta FROM w WHERE base IS NOT NULL AND tuned IS NOT NULL")
def suffix_delta(spark, d):
    # a model whose name has a suffix is set against the one without it
    rows = labels.current(table(spark, d, "candidates")).where("model is not null")
    suffix = "-(sft|[0-9]+)$"
    variant = F.when(F.col("model").rlike(suffix), "tuned").otherwise("base")
    each = rows.groupBy(F.regexp_replace("model", suffix, "").alias("name"), variant.alias("variant")).agg(metrics.rate(F.col("passed")).alias("p"))
    return metrics.base_vs_tuned(each, "name", "variant", "p", "base", "tuned")


@query()
def generated_valid(spark, d):
    # the tasks of all families and the self-check that can be made without running them
    rows = generate.generate_tasks(spark, 4, 3)
    return rows.select("family", "variant", "task_id", (F.size("accepted_commands") >= 2).alias("valid"), screen.task_screen(F.col("setup_files"), F.col("user_request"), F.col("accepted_commands")).alias("reason"))


@query()
def round_robin(spark, d):
    return generate.round_robin(spark, 37)


@query()
def syntax_check(spark, d):
    commands = once(spark, d).select(F.explode("accepted_commands").alias("c")).where("c is not null").select(tx.clean_command(F.col("c")).alias("command")).distinct()
    return commands.select("command", screen.parses(F.col("command")).alias("parses"))
