"""Task families as relational queries, seeded variants and recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..sources.records import DIFFICULTIES, ORACLE, exploded

# The procedural families in their registry's order.
FAMILIES = ["filter_level", "count_extension", "find_extension", "csv_column", "count_matches", "top_frequency", "head_lines", "sorted_unique", "replace_in_file", "largest_file"]


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lineno from 1, line) of a text column; a trailing line break adds no line."""
    body = F.regexp_replace(text, r"\n\z", "")
    return df.where(F.length(text) > 0).select(key, F.posexplode(F.split(body, "\n")).alias("_p", "line")).select(key, (F.col("_p") + 1).alias("lineno"), "line")


def files(tasks: DataFrame) -> DataFrame:
    """(task_id, path, content): one row per setup file."""
    return tasks.select("task_id", F.explode("setup_files").alias("path", "content"))


#: Columns of a generated task.
TASK_ROW = (
    "family string, seed int, variant int, task_id string, setup_files map<string,string>, user_request string,"
    f" oracle struct<{ORACLE}>, accepted_commands array<string>, allowed_side_effects array<string>"
)


def _drawn(*parts):
    """A random generator of its own for these parts."""
    import hashlib
    import random

    return random.Random(int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:16], 16))


def _fixture(family: str, seed: int, variant: int):
    """(files, request, kind of oracle, expected, commands) of one variant; the concept is drawn from the seed, the files from seed and variant."""
    import hashlib

    concept, r = _drawn(family, seed, "concept"), _drawn(family, seed, variant, "content")
    level, top = concept.choice(["ERROR", "WARN", "INFO"]), concept.randint(2, 4)
    old, new = concept.sample(["red", "green", "blue", "grey"], 2)
    name, folder, ext = f"data{r.randint(100, 999)}.txt", f"box{r.randint(10, 99)}", concept.choice(["log", "txt", "cfg"])
    words = [r.choice(["red", "green", "blue", "grey", "teal"]) for _ in range(r.randint(12, 30))]
    rows = [f"{r.choice(['ERROR', 'WARN', 'INFO'])} {w} {r.randint(1, 99)}" for w in words]
    text = lambda lines: "".join(x + "\n" for x in lines)
    # files of the folder: different sizes, other endings mixed in, one folder deeper
    sizes = r.sample(range(5, 400), 4)
    tree = {f"{folder}/{'' if k % 3 else 'deep/'}f{k}.{ext if k == 1 or r.random() < 0.5 else 'csv'}": "x" * n for k, n in enumerate(sizes)}
    flat = {f"{folder}/f{k}.{ext if r.random() < 0.6 else 'csv'}": "x" * n for k, n in enumerate(sizes)}
    base = lambda p: p.rsplit("/", 1)[-1]
    if family == "filter_level":
        return {name: text(rows)}, f"Print the {level} lines of {name}.", "out", text(x for x in rows if x.startswith(level + " ")), [f"sed -n '/^{level} /p' {name}", f"awk '$1==\"{level}\"' {name}"]
    if family == "count_matches":
        return {name: text(rows)}, f"How many lines of {name} contain {old}?", "out", f"{sum(old in x for x in rows)}\n", [f"grep {old} {name} | wc -l", f"awk '/{old}/{{n++}} END{{print n+0}}' {name}"]
    if family == "csv_column":
        return {name: text(["level,word,n", *(x.replace(" ", ",") for x in rows)])}, f"Print the word column of {name} without its header.", "out", text(words), [f"tail -n +2 {name} | cut -d, -f2", f"awk -F, 'NR>1{{print $2}}' {name}"]
    if family == "head_lines":
        return {name: text(rows)}, f"Print the first {top} lines of {name}.", "out", text(rows[:top]), [f"head -n {top} {name}", f"sed -n '1,{top}p' {name}"]
    if family == "sorted_unique":
        return {name: text(words)}, f"Print the different lines of {name} in order.", "out", text(sorted(set(words))), [f"sort -u {name}", f"sort {name} | uniq"]
    if family == "top_frequency":
        ranked = sorted(set(words), key=lambda w: (-words.count(w), w))[:top]
        return {name: text(words)}, f"Which {top} values are most frequent in {name}? Equals by name.", "out", text(ranked), [f"sort {name} | uniq -c | sort -k1,1nr -k2 | head -n {top} | awk '{{print $2}}'", f"awk '{{n[$0]++}} END{{for(w in n) print n[w], w}}' {name} | sort -k1,1nr -k2 | head -n {top} | cut -d' ' -f2"]
    if family == "replace_in_file":
        body = text(rows)
        return {name: body}, f"Replace {old} by {new} in {name}.", "file", {name: hashlib.sha256(body.replace(old, new).encode()).hexdigest()}, [f"sed -i 's/{old}/{new}/g' {name}", f"perl -pi -e 's/{old}/{new}/g' {name}"]
    if family == "count_extension":
        return flat, f"How many .{ext} files are directly in {folder}?", "out", f"{sum(p.endswith('.' + ext) for p in flat)}\n", [f"find {folder} -maxdepth 1 -type f -name '*.{ext}' | wc -l", f"ls {folder} | awk '/\\.{ext}$/{{n++}} END{{print n+0}}'"]
    if family == "find_extension":
        return tree, f"List all .{ext} files anywhere below {folder}.", "lines", sorted(p for p in tree if p.endswith("." + ext)), [f"find {folder} -type f -name '*.{ext}'", f"find {folder} -type f | sed -n '/\\.{ext}$/p'"]
    if family == "largest_file":
        return flat, f"What is the name of the largest file in {folder}?", "out", base(max(flat, key=lambda p: len(flat[p]))) + "\n", [f"ls -S {folder} | head -n 1", f"find {folder} -type f -printf '%s %f\\n' | sort -k1,1nr | head -n 1 | cut -d' ' -f2"]
    return None


@udtf(returnType=TASK_ROW)
class TaskGenerator:
    """Tasks of a family for a concept seed: variants 0 to count - 1, with files that don't matter, the oracle computed from the files, and two commands; no rows for an unknown family."""

    def eval(self, family: str, seed: int, count: int):
        import hashlib

        for variant in range(count):
            made = _fixture(family, seed, variant)
            if made is None:
                return
            files, request, kind, expected, commands = made
            r = _drawn(family, seed, variant, "distractors")
            files |= {f"old{k}{r.randint(100, 999)}.bak": f"{r.choice(['keep', 'drop', 'move'])} {r.randint(1, 9)}\n" for k in range(2)}
            oracle = (expected if kind == "out" else None, expected if kind == "lines" else None, 0, kind != "file", expected if kind == "file" else {}, [])
            ident = hashlib.sha256(f"{family}:{seed}:{variant}:{request}".encode()).hexdigest()[:16]
            yield family, seed, variant, ident, files, request, oracle, commands, ["stdout", "filesystem_write"] if kind == "file" else ["stdout"]


def _generated(spark: SparkSession, jobs: DataFrame) -> DataFrame:
    """The tasks of jobs (family, seed, count)."""
    spark.udtf.register("task_generator", TaskGenerator)
    jobs.createOrReplaceTempView("_generator_jobs")
    return spark.sql("SELECT g.* FROM _generator_jobs j, LATERAL task_generator(j.family, j.seed, j.count) g")


def generate_tasks(spark: SparkSession, n_seeds: int, variants: int = 4) -> DataFrame:
    """Tasks of all families for seeds 0 to n_seeds - 1; the same call gives the same rows on any partitioning."""
    families = F.explode(F.array(*[F.lit(f) for f in FAMILIES])).alias("family")
    return _generated(spark, spark.range(n_seeds).select(families, F.col("id").cast("int").alias("seed"), F.lit(variants).alias("count")))


def round_robin(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` tasks, one of each family in turn and then of the next seed, so that all families are as frequent as can be."""
    names = F.array(*[F.lit(f) for f in sorted(FAMILIES)])
    k = len(FAMILIES)
    turn = spark.range(n).select(F.get(names, (F.col("id") % k).cast("int")).alias("family"), (F.floor(F.col("id") / k) + seed).cast("int").alias("seed"), F.lit(1).alias("count"))
    return _generated(spark, turn)


def recipes(spark: SparkSession, domains: list[str], skills: list[str], utilities: list[str]) -> DataFrame:
    """The space of recipes: every domain, skill, utility and difficulty."""
    return exploded(spark, domain=domains, skill=skills, utility=utilities, difficulty=DIFFICULTIES)
