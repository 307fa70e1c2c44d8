"""Rule screens in which the first failure names the reason."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import clean_command, static_risk


def first_failure(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds, else null; a null condition doesn't hold."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in rules])


def task_screen(files: Column, request: Column, commands: Column, syntax_ok: Column | None = None) -> Column:
    """Reason for which a proposed task is refused, null if it is not."""
    n = F.coalesce(F.size(files), F.lit(0))
    clean = F.filter(F.transform(commands, clean_command), lambda c: c != "")
    long_enough = F.length(request).between(10, 400)
    rules = [
        (files.isNull() | ~n.between(1, 6), "bad_setup_files"),
        (F.exists(F.map_values(files), lambda v: v.isNull()), "bad_file_entry"),
        (F.exists(F.map_keys(files), lambda k: k.startswith("/") | F.contains(k, F.lit(".."))), "unsafe_path"),
        (F.exists(F.map_values(files), lambda v: F.length(v) > 20000), "file_too_large"),
        (request.isNull() | ~long_enough, "bad_request"),
        (commands.isNull() | (F.size(clean) < 2), "needs_two_commands"),
        (F.get(clean, F.lit(0)) == F.get(clean, F.lit(1)), "commands_not_distinct"),
    ]
    if syntax_ok is not None:
        rules.append((~syntax_ok, "syntax_error"))
    rules.append((F.exists(clean, lambda c: static_risk(c) == "high"), "dangerous_command"))
    return first_failure(*rules)


def require_known(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """The rows, if all their keys are in the dimension; else ValueError with up to ten that aren't."""
    strange = rows.select(key).distinct().join(known.select(key), key, "left_anti").limit(10).collect()
    if strange:
        raise ValueError(f"unknown {key}: " + ", ".join(sorted(str(r[0]) for r in strange)))
    return rows


def risk_class(given: Column) -> Column:
    """A known risk class, else read_only."""
    return F.when(given.isin("read_only", "local_write"), given).otherwise("read_only")


def effects_of(given: Column) -> tuple[Column, Column]:
    """(allowed, forbidden) side effects of a risk class."""
    writes = F.coalesce(given == "local_write", F.lit(False))
    array = lambda *names: F.array(*[F.lit(x) for x in names])
    allowed = F.when(writes, array("stdout", "stderr", "filesystem_write")).otherwise(array("stdout", "stderr"))
    return allowed, F.when(writes, array("network", "privilege_change")).otherwise(array("network", "privilege_change", "filesystem_delete"))


def parses(command: Column) -> Column:
    """Whether a shell reads the command without a syntax error; null and blank commands don't pass.

    ``bash -n`` reads and runs nothing; one process per distinct command of an
    Arrow batch, so apply it to distinct commands, after all other rules.
    """
    @pandas_udf("boolean")
    def check(commands: pd.Series) -> pd.Series:
        import subprocess
        from concurrent.futures import ThreadPoolExecutor

        def one(c: str | None) -> bool:
            if not c or not c.strip():
                return False
            return subprocess.run(["bash", "-n"], input=c.encode("utf-8", "replace"), capture_output=True, timeout=10, check=False).returncode == 0

        different = commands.dropna().unique().tolist()
        with ThreadPoolExecutor(4) as pool:
            known = dict(zip(different, pool.map(one, different), strict=True))
        return commands.map(lambda c: known.get(c, False)).astype(bool)

    return check(command)


def containing(texts: DataFrame, ids: list[str], text: str, items: DataFrame, item: str, key: str) -> DataFrame:
    """(ids, item) of the texts in which an item's whole key stands, at any place, both in the form of ``text.request_key``.

    The words of a key but its first and last stand as whole words in every
    text that contains it, so the one that fewest items have is its seed, the
    longest of equals: texts meet keys at seeds, then ``contains`` decides. Keys
    of one or two words have no seed and are sought in every text. The items
    are sent to the tasks. Empty keys are in no text; each pair comes once.
    """
    items = items.select(item, key).where(F.col(key) != "").distinct()
    keys = items.select(key).distinct()
    words = F.split(key, " ")
    inner = F.array_distinct(F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != ""))
    held = keys.select(key, F.explode(inner).alias("_word"))
    shared = held.groupBy("_word").agg(F.count("*").alias("_n"))
    rarest = F.min(F.struct("_n", (-F.length("_word")).alias("_length"), "_word"))["_word"].alias("_word")
    seeds = held.join(shared, "_word").groupBy(key).agg(rarest)
    met = texts.select(*ids, F.explode(F.array_distinct(F.split(text, " "))).alias("_word")).join(F.broadcast(seeds), "_word").select(*ids, key).distinct()
    found = texts.join(met, ids).where(F.contains(text, key)).select(*ids, key)
    short = keys.join(seeds, key, "left_anti")
    found = found.union(texts.join(F.broadcast(short), F.contains(text, key)).select(*ids, key))
    return found.join(F.broadcast(items), key).select(*ids, item).distinct()
