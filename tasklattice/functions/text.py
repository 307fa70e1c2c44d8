"""Column functions on requests, commands and recorded text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Utilities and builtins that make up a command's shape.
UTILITIES = [
    "awk", "basename", "cat", "comm", "cut", "diff", "dirname", "du", "echo", "find", "grep",
    "head", "join", "ls", "paste", "sed", "sort", "tail", "tr", "uniq", "wc", "xargs",
]

# Patterns of dangerous (any case) and of writing commands.
DANGEROUS = r"(?i)(?:^|[;&|`(]\s*)\s*(?:sudo|su\b|shutdown|reboot|mkfs|dd\s+if=|chown\s+-R\s+/|rm\s+-[a-zA-Z]*[rf][a-zA-Z]*\s+/(?:\s|$)|:\(\)\s*\{|curl|wget|nc\b|ssh\b)"
WRITING = r"\brm\b|\bmv\b|>\s*\S|\bsed\b[^|]*-i|\btruncate\b|\bchmod\b"

_SPACE = r"^[\s]+|[\s]+$"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, _SPACE, "")


def plain_id(c: Column) -> Column:
    """Lower case without white space at either end: how ids and judges' names are compared."""
    return F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")


def request_key(c: Column) -> Column:
    """Lower case, all but a-z, 0-9 and the space deleted, then trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", ""))


def clean_command(c: Column) -> Column:
    """The command in a model's answer: fences and blank lines dropped, one leading ``$`` or ``>`` mark removed, the first line that is no comment, else the first line.

    The names of fence languages are tried longest first, and ``#`` is no
    prompt mark, so that neither eats a part of the command. Empty input gives ''.
    """
    bare = F.regexp_replace(c, r"(?m)^[ \t]*```(shell|bash|console|sh)?[ \t]*$", "")
    bare = F.regexp_replace(bare, r"^[\s]*```(shell|bash|console|sh)?|```[\s]*$", "")
    lines = F.transform(F.split(bare, "\n"), lambda x: F.regexp_replace(strip(x), r"^[$>]\s+", ""))
    lines = F.filter(lines, lambda x: x != "")
    code = F.filter(lines, lambda x: ~x.startswith("#"))
    return F.coalesce(F.when(F.size(code) > 0, F.get(code, F.lit(0))), F.get(lines, F.lit(0)), F.lit(""))


# Fences and prompt marks as earlier tools took them.
GIVEN_FENCE = r"^\s*```(?:bash|sh|shell)?\s*|\s*```\s*$"
GIVEN_MARK = r"^\s*(?:\$|#|>)\s+"


def clean_command_as_given(c: Column) -> Column:
    """``clean_command`` with two slips of earlier tools, for corpora that were cleaned by them: the rest of a fence language behind ``sh`` stays, and one leading ``#`` is a prompt mark."""
    lines = F.filter(F.split(strip(F.regexp_replace(c, "(?md)" + GIVEN_FENCE, "")), "\n"), lambda x: strip(x) != "")
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(x, GIVEN_MARK, "")))
    code = F.filter(bare, lambda x: (x != "") & ~x.startswith("#"))
    return F.coalesce(F.get(code, F.lit(0)), F.get(bare, F.lit(0)), F.lit(""))


def static_risk(c: Column) -> Column:
    """high, write or read_only, by what the command's text says."""
    return F.when(c.rlike(DANGEROUS), "high").when(c.rlike(WRITING), "write").otherwise("read_only")


def one_line(raw: Column) -> Column:
    """True if a command comes out and the stripped answer has no line break."""
    return (clean_command(raw) != "") & ~F.contains(strip(raw), F.lit("\n"))


def signature(command: Column, n_files: Column) -> Column:
    """Shape of a command: its utilities, sorted and joined by +, then #pipes and #files."""
    names = F.regexp_extract_all(command, F.lit(r"([a-zA-Z_][\p{L}\p{M}\p{Nd}_-]*)"), F.lit(1))
    known = F.array(*[F.lit(u) for u in UTILITIES])
    used = F.array_sort(F.array_intersect(F.array_distinct(names), known))
    pipes = F.length(command) - F.length(F.replace(command, F.lit("|"), F.lit("")))
    return F.concat(F.array_join(used, "+"), F.lit("#"), pipes.cast("string"), F.lit("#"), n_files.cast("string"))


def group_key(family: Column, sig: Column) -> Column:
    """Records that must stay together: a family, or the shape where the family is the catch-all."""
    return F.when(family.isNull() | (family == "llm_authored"), F.concat(F.lit("sig:"), sig)).otherwise(F.concat(F.lit("proc:"), family))


def content_id(c: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the text."""
    return F.substring(F.sha2(c, 256), 1, 16)


def embedded_json(c: Column, schema: str) -> Column:
    """Fields of a JSON object: of the whole text, else of its widest braces; null if neither parses."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.when(strip(c).startswith("{"), F.from_json(c, schema)), F.from_json(F.nullif(inner, F.lit("")), schema))


def comparable_lines(c: Column) -> Column:
    """Non-empty lines without a leading ./, sorted: equal for outputs whose order doesn't count."""
    lines = F.filter(F.split(c, "\n"), lambda x: x != "")
    return F.array_sort(F.transform(lines, lambda x: F.regexp_replace(x, r"^\./", "")))


def output_lines(c: Column) -> Column:
    """The lines of an output that are not blank, at every kind of line break, without a leading ./, sorted."""
    lines = F.filter(F.split(c, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), lambda x: strip(x) != "")
    return F.array_sort(F.transform(lines, lambda x: F.regexp_replace(x, r"^\./", "")))


def workspace_view(files: Column, most: int) -> Column:
    """Paths in order with their content, cut after ``most`` characters."""
    cut = lambda v: F.when(F.length(v) > most, F.concat(F.left(v, F.lit(most)), F.lit("...<truncated>"))).otherwise(v)
    parts = F.transform(F.array_sort(F.map_keys(files)), lambda k: F.concat(F.lit("--- "), k, F.lit("\n"), F.coalesce(F.rtrim(cut(F.element_at(files, k))), F.lit(""))))
    return F.array_join(parts, "\n")


def truncated_bytes(c: Column, most: int) -> Column:
    """The first ``most`` bytes of the UTF-8 text; a divided character becomes a replacement character."""
    return F.decode(F.substring(F.encode(c, "utf-8"), 1, most), "utf-8")


def effects(stdout: Column, stderr: Column, added: Column, removed: Column, modified: Column) -> Column:
    """Observed side effects of a recorded execution."""
    some = lambda a: F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0
    return F.array_compact(
        F.array(
            F.when(F.length(stdout) > 0, "stdout"),
            F.when(F.length(stderr) > 0, "stderr"),
            F.when(some(added) | some(modified), "filesystem_write"),
            F.when(some(removed), "filesystem_delete"),
        )
    )


def spread_evenly(n: Column, steps: Column) -> Column:
    """n units over so many steps, the first ones getting one more."""
    return F.when(steps > 0, F.transform(F.sequence(F.lit(0), steps - 1), lambda i: (F.floor(n / steps) + F.when(i < n % steps, 1).otherwise(0)).cast("int"))).otherwise(F.array().cast("array<int>"))


def split_list(c: Column) -> Column:
    """Trimmed, non-empty parts of a comma-separated list."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def name_tag(names: Column, most: int) -> Column:
    """Names joined by -, cut at ``most`` characters; run without any."""
    return F.coalesce(F.nullif(F.left(F.array_join(names, "-"), F.lit(most)), F.lit("")), F.lit("run"))


def fold_numbers(text: str, n: int) -> list[int]:
    """The folds a user names: all of them, or a comma-separated list; ValueError for one that doesn't exist."""
    if text.strip() == "all":
        return list(range(n))
    out = [int(x) for x in text.split(",") if x.strip()]
    if any(not 0 <= x < n for x in out):
        raise ValueError(f"folds are 0 to {n - 1}")
    return out
