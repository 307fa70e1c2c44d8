"""The queries of the problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklattice.session import table

from . import consensus as cs
from . import leaks, neardup, overlap, packing, quality, splits, topn


def _consensus(spark: SparkSession, sf_dir: str) -> cs.Consensus:
    from tasklattice.session import Scratch

    rows = Scratch(spark, "judged").write(cs.judged(table(spark, sf_dir, "candidates")), "rows")
    return cs.consensus(rows)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with three or more usable votes whose consensus differs from the verdict."""
    items = _consensus(spark, sf_dir).items
    return items.where((F.col("n_votes") >= 3) & (F.col("consensus") != F.col("passed"))).select("candidate_id")


def p1_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One consensus label and agreement per candidate with a usable vote."""
    return _consensus(spark, sf_dir).items.select("candidate_id", "n_votes", "n_yes", "consensus", F.round("score", 6).alias("score"), F.round("agreement", 6).alias("agreement"), "passed")


def p1_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of each judge, beside the chance-corrected agreement of all and whether the weights were stable."""
    done = _consensus(spark, sf_dir)
    one = done.overall.select(F.col("alpha").alias("alpha_of_all"), F.lit(done.rounds).alias("rounds"), F.lit(done.converged).alias("converged"))
    return done.annotators.crossJoin(F.broadcast(one))


def p1_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, ratings and Krippendorff's alpha."""
    return _consensus(spark, sf_dir).overall.withColumn("alpha", F.round("alpha", 9))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups of two or more tasks that must stay in one split."""
    return splits.grouped_pairs(table(spark, sf_dir, "tasks"))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One split per task, 8:1:1."""
    return splits.split_tasks(table(spark, sf_dir, "tasks"))


def p2_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spanning forest of the groups, as pairs of tasks with the digest of the family or command they share."""
    return splits.task_forest(table(spark, sf_dir, "tasks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three candidates of every task."""
    return topn.best_candidates(table(spark, sf_dir, "candidates"), 3).select("task_id", "candidate_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a held-out and a training task that share 0.7 of the words of request and of files."""
    pairs = overlap.cross_split_pairs(table(spark, sf_dir, "tasks"), 0.7)
    return pairs.select(F.least("held", "train").alias("task_id_a"), F.greatest("held", "train").alias("task_id_b"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps with training by held-out split and family."""
    return overlap.overlap_report(table(spark, sf_dir, "tasks"), table(spark, sf_dir, "sft"), 0.7)


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every task and its number of overlaps with the other side, without a row per pair."""
    return overlap.overlap_classes(table(spark, sf_dir, "tasks"), 0.7)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tasks that share 0.7 of their words."""
    return neardup.near_pairs(table(spark, sf_dir, "tasks"), 0.7)


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and group of every task, and its number of links."""
    return neardup.near_groups(table(spark, sf_dir, "tasks"), 0.7)


def p6_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training sequence of 2048 tokens of every document."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p6_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training sequence of every instruction record, with a limit on loss-bearing tokens."""
    return packing.pack_messages(table(spark, sf_dir, "sft"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the held-out items they share ten consecutive words with."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"), 10).select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items half of whose words stand in a document in runs of five or more, in any order."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"), 5, 0.5)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with visible text most of which is no running prose."""
    stats = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))
    return stats.where("visible > 0 and prose_share < 0.5").select("doc_id")


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and the nearest structural profile of every document."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic counts per document, without a model: words, their mean length, lines and those that end a sentence."""
    return quality.counts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_consensus, p1_judges, p1_overall, p2_found, p2_splits, p2_forest, p3_found, p4_found, p4_classes, p4_report, p5_found, p5_groups, p6_sequences, p6_messages, p7_found, p7_report, p8_found, p8_stats, p8_counts)}

# SQL counterparts, over whole tables; where SQL is too slow or can't say it, tests hold the query against brute force.
_FAMILY = "regexp_replace(lower(provenance.template_family), '[^\\p{L}\\p{Nd}]+', '', 'g')"
_SP = "[\\s\\x0b\\x85\\p{Z}]"
_COMMAND = (
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '(?m)^{_SP}*(?:```|#)[^\\r\\n]*$', '', 'g'), '(?m)^{_SP}*(?:[$>]{_SP}+)+', '', 'g'), '(?:{_SP}|[''\"])+', '', 'g'), ';+$', '')"
)
_WORDS = "list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> '')"
_SETS = (
    "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id) AS rn_ FROM tasks WHERE task_id IS NOT NULL) WHERE rn_ = 1),"
    f" s AS (SELECT task_id, CASE WHEN regexp_replace(lower(split), '[^a-z]+', '', 'g') IN ('train', 'training') THEN 1 WHEN split IS NOT NULL THEN 0 END AS side,"
    f" list_distinct({_WORDS.replace('{c}', 'coalesce(user_request, chr(32))')}) AS req,"
    f" list_distinct({_WORDS.replace('{c}', 'coalesce(array_to_string(map_values(setup_files), chr(10)), chr(32))')}) AS files,"
    f" list_distinct({_WORDS.replace('{c}', 'coalesce(user_request, chr(32)) || chr(10) || coalesce(array_to_string(accepted_commands, chr(10)), chr(32))')}) AS both_ FROM t)"
)


def _pairs(words: str, alias: str, where: str) -> str:
    """Pairs with an overlap of 0.7 by counting shared words."""
    return (
        f"{alias} AS (SELECT a.task_id AS ta, b.task_id AS tb FROM (SELECT task_id, side, len({words}) AS n, unnest({words}) AS w FROM s) a JOIN (SELECT task_id, side, len({words}) AS n, unnest({words}) AS w FROM s) b"
        f" ON a.w = b.w AND a.task_id < b.task_id AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n) {where} GROUP BY 1, 2, a.n, b.n HAVING 10 * count(*) >= 7 * (a.n + b.n - count(*)))"
    )


_ACROSS = "AND a.side <> b.side"
_PAIRED_FILES = (
    f"{_pairs('req', 'pr', _ACROSS)}, {_pairs('files', 'pf', _ACROSS)}, pairs AS (SELECT CASE WHEN s.side = 0 THEN pr.ta ELSE pr.tb END AS held, CASE WHEN s.side = 0 THEN pr.tb ELSE pr.ta END AS train FROM pr JOIN pf ON pr.ta = pf.ta AND pr.tb = pf.tb JOIN s ON s.task_id = pr.ta)"
)
_CLASSES = "classes AS (SELECT task_id, side, min(task_id) OVER (PARTITION BY list_sort(req), list_sort(files)) AS class_id FROM s WHERE side IS NOT NULL AND len(req) > 0 AND len(files) > 0)"
_GRAMS = "SELECT DISTINCT {i} AS i, array_to_string(list_slice(w, k, k + 9), ' ') AS g FROM (SELECT {i}, w, unnest(range(1, len(w) - 8)) AS k FROM (SELECT {i}, " + _WORDS.replace("{c}", "text") + " AS w FROM {t} WHERE text IS NOT NULL))"

SQL: dict[str, str] = {
    "p2_found": (
        "WITH RECURSIVE t AS (SELECT DISTINCT ON (task_id) * FROM tasks WHERE task_id IS NOT NULL),"
        f" k AS (SELECT DISTINCT task_id, 'f:' || {_FAMILY} AS key FROM t WHERE {_FAMILY} NOT IN ('', 'llmauthored', 'unknown', 'none', 'na')"
        f" UNION SELECT DISTINCT task_id, 'c:' || n FROM (SELECT task_id, {_COMMAND} AS n FROM (SELECT task_id, unnest(accepted_commands) AS c FROM t)) WHERE contains(n, '/')),"
        " h AS (SELECT key, min(task_id) AS hub FROM k GROUP BY key), e AS (SELECT k.task_id AS a, h.hub AS b FROM k JOIN h USING (key) WHERE k.task_id <> h.hub),"
        " both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, c) AS (SELECT a, a FROM both_ UNION SELECT r.a, both_.b FROM r JOIN both_ ON r.c = both_.a)"
        " SELECT min(c) AS group_id, a AS task_id FROM r GROUP BY a"
    ),
    "p3_found": (
        "WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY recorded_at DESC NULLS LAST) AS rn FROM candidates WHERE candidate_id IS NOT NULL) WHERE rn = 1),"
        " v AS (SELECT regexp_replace(lower(task_id), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS task_id, candidate_id, verdict.forbidden_side_effect AS f, verdict.postconditions_passed AS p FROM c WHERE task_id IS NOT NULL),"
        " r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY f, p DESC, candidate_id) AS k FROM v WHERE f IS NOT NULL AND p IS NOT NULL AND NOT isnan(p)) SELECT task_id, candidate_id FROM r WHERE k <= 3"
    ),
    "p4_found": f"WITH {_SETS}, {_pairs('req', 'pr', _ACROSS)}, {_pairs('files', 'pf', _ACROSS)} SELECT pr.ta AS task_id_a, pr.tb AS task_id_b FROM pr JOIN pf ON pr.ta = pf.ta AND pr.tb = pf.tb",
    "p4_classes": f"WITH {_SETS}, {_PAIRED_FILES}, {_CLASSES}, links AS (SELECT held AS task_id, true AS held, train AS far FROM pairs UNION ALL SELECT train, false, held FROM pairs), n AS (SELECT l.task_id, count(DISTINCT c.class_id) AS n_links, count(*) AS n_tasks FROM links l JOIN classes c ON c.task_id = l.far GROUP BY 1) SELECT c.task_id, c.class_id, c.side = 0 AS held, coalesce(n_links, 0) AS n_links, coalesce(n_tasks, 0) AS n_tasks FROM classes c LEFT JOIN n USING (task_id)",
    "p4_report": (
        f"WITH {_SETS}, {_PAIRED_FILES}, names AS (SELECT task_id, min(CASE WHEN l IN ('train', 'training') THEN 'train' WHEN l IN ('val', 'valid', 'validation', 'dev') THEN 'validation' WHEN l IN ('test', 'testing', 'eval') THEN 'test' ELSE l END) AS split FROM (SELECT task_id, regexp_replace(lower(split), '[^a-z]+', '', 'g') AS l FROM tasks) GROUP BY 1),"
        " f AS (SELECT task_id, min(k) AS k FROM (SELECT task_id, regexp_replace(lower(template_family), '[^\\p{L}\\p{Nd}]+', '', 'g') AS k FROM sft) WHERE k NOT IN ('', 'llmauthored', 'unknown', 'none', 'na') GROUP BY 1)"
        " SELECT split, coalesce(k, 'none') AS template_family, count(*) AS n_pairs, count(DISTINCT held) AS n_tasks FROM pairs JOIN names ON names.task_id = held LEFT JOIN f ON f.task_id = held GROUP BY 1, 2"
    ),
    "p5_groups": (
        f"WITH RECURSIVE {_SETS}, {_pairs('both_', 'pb', '')}, classes AS (SELECT task_id, min(task_id) OVER (PARTITION BY list_sort(both_)) AS class_id FROM s WHERE len(both_) > 0), e AS (SELECT ta AS a, tb AS b FROM pb UNION SELECT tb, ta FROM pb),"
        " r(a, c) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.c = e.a), g AS (SELECT a AS task_id, min(c) AS group_id FROM r GROUP BY a),"
        " n AS (SELECT a AS task_id, count(DISTINCT y.class_id) AS n_links FROM e JOIN classes x ON x.task_id = a JOIN classes y ON y.task_id = b WHERE x.class_id <> y.class_id GROUP BY 1)"
        " SELECT task_id, coalesce(group_id, task_id) AS group_id, class_id, coalesce(n_links, 0) AS n_links FROM classes LEFT JOIN g USING (task_id) LEFT JOIN n USING (task_id)"
    ),
    "p5_found": f"WITH {_SETS}, {_pairs('both_', 'pb', '')} SELECT ta AS task_id_a, tb AS task_id_b FROM pb",
    "p7_found": f"SELECT DISTINCT d.i AS doc_id, h.i AS item_id FROM ({_GRAMS.replace('{i}', 'doc_id').replace('{t}', 'documents')}) d JOIN ({_GRAMS.replace('{i}', 'item_id').replace('{t}', 'heldout_items')}) h ON d.g = h.g",
    "p8_counts": (
        "WITH w AS (SELECT doc_id, " + _WORDS.replace("{c}", "coalesce(text, '')") + " AS w, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)"
        " SELECT doc_id, len(w) AS words, CASE WHEN len(w) > 0 THEN round(length(array_to_string(w, '')) / len(w), 6) END AS mean_word_length, len(l) AS lines,"
        " len(list_filter(l, lambda x: right(x, 1) IN ('.', '!', '?'))) AS ended FROM w"
    ),
    "p1_overall": (
        "WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY recorded_at DESC NULLS LAST) AS rn FROM candidates WHERE candidate_id IS NOT NULL) WHERE rn = 1),"
        " v AS (SELECT candidate_id, unnest(map_keys(judge_votes)) AS j, unnest(map_values(judge_votes)) AS v FROM c),"
        " o AS (SELECT candidate_id, regexp_replace(lower(j), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS j, min(v.semantically_correct::INT) AS a, max(v.semantically_correct::INT) AS b FROM v WHERE v.semantically_correct IS NOT NULL GROUP BY 1, 2),"
        " i AS (SELECT candidate_id, count(*) AS m, sum(a) AS y FROM o WHERE a = b GROUP BY 1 HAVING count(*) > 1),"
        " t AS (SELECT count(*) AS items, sum(m) AS ratings, sum(y) AS y, sum(2.0 * y * (m - y) / (m - 1)) AS seen FROM i)"
        " SELECT items, ratings, round(1 - seen / (2.0 * y * (ratings - y) / (ratings - 1)), 9) AS alpha FROM t"
    ),
}
