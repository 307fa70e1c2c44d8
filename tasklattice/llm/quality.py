"""Text statistics and structural profiles of documents by Jensen-Shannon divergence; all profiles are fitted to the collection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.session import Scratch, spread

from . import units as un

#: Steps of the grid on which units' distributions are counted for fitting: 50,388 cells a language at most.
GRID = 12
#: Structural profiles, and rounds in which they are moved to the middle of their units.
STRUCTURES, ROUNDS = 8, 8
#: Common words per language, the most frequent in the collection, whose neighbourhood is counted; shares and languages use all.
PAIRED = 200
#: Texts read at once.
TEXTS = 400

_N = len(un.CLASSES)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence (natural logarithm) of distributions in the last axis."""
    m = (p + q) / 2
    m = np.where(m > 0, m, 1)

    def part(x):
        return (x * np.log(np.where(x > 0, x, m) / m)).sum(-1)

    return (part(p) + part(q)) / 2


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(-1, keepdims=True), 1)


def _visible(counts: np.ndarray) -> np.ndarray:
    return counts.sum(-1) - counts[..., un.CLASSES.index("space")]


@dataclass
class Profiles:
    """Distributions over CLASSES: of each language's prose, then of the structures, with their names."""

    names: list[str]
    table: np.ndarray
    prose: int

    def nearest(self, counts: np.ndarray, language: np.ndarray) -> np.ndarray:
        """The nearest profile of each unit; of prose, that of the unit's language."""
        out = np.zeros(len(counts), np.int64)
        for begin in range(0, len(counts), 1 << 14):
            piece = slice(begin, begin + (1 << 14))
            far = divergence(_shares(counts[piece])[:, None], self.table[None])
            best = far.argmin(1)
            out[piece] = np.where(best < self.prose, language[piece], best)
        return out


def fit_profiles(language: np.ndarray, counts: np.ndarray, languages: list[str]) -> Profiles:
    """Profiles from the class counts of all units, added up in cells (language, counts).

    Prose has function words: Otsu's cut on their share of a unit's letters
    tells two kinds of units apart, and a unit with more than half of the mean
    share of the upper kind is taken for prose. Its mean is the profile of its
    language. Structures are sought among the rest: starting points are the
    cells farthest from all profiles so far, weighed by their characters, and
    they move to the mean of the cells nearest to them. A structure is named by
    the class it has most in excess of prose.
    """
    weight = _visible(counts).astype(float)
    some = weight > 0
    language, counts, weight = language[some], counts[some].astype(float), weight[some]
    shares = _shares(counts)
    letters = counts[:, :3].sum(1)
    function = np.where(letters > 0, counts[:, 0] / np.maximum(letters, 1), 0.0)
    order = np.argsort(function)
    below = np.cumsum(weight[order])
    mean = np.cumsum((weight * function)[order])
    total, whole = (below[-1], mean[-1]) if len(below) else (1.0, 0.0)
    share = np.clip(below / total, 1e-12, 1 - 1e-12)
    between = (whole / total * share - mean / total) ** 2 / (share * (1 - share))
    cut = function[order][between.argmax()] if len(order) else 0.0
    # units that are all alike have no upper kind
    upper = function > cut if (function > cut).any() else function > 0
    cut = np.average(function[upper], weights=weight[upper]) / 2 if upper.any() else cut
    prosaic = function > cut
    whole_prose = counts[prosaic].sum(0) if prosaic.any() else np.ones(_N)
    own = [counts[prosaic & (language == k)].sum(0) for k in range(max(1, len(languages)))]
    prose = np.array([_shares(x if x.sum() else whole_prose) for x in own])
    rest = np.flatnonzero(~prosaic)
    found: list[np.ndarray] = []
    far = divergence(shares[rest][:, None], prose[None]).min(1) if len(rest) else np.zeros(0)
    for _ in range(min(STRUCTURES, len(rest))):
        k = int((far * weight[rest]).argmax())
        if far[k] <= 0:
            break
        found.append(shares[rest[k]])
        far = np.minimum(far, divergence(shares[rest], found[-1][None]))
    structures = np.array(found).reshape(-1, _N)
    for _ in range(ROUNDS if len(structures) else 0):
        near = divergence(shares[:, None], np.concatenate([prose, structures])[None]).argmin(1)
        for k in range(len(structures)):
            mine = near == len(prose) + k
            if mine.any():
                structures[k] = _shares(counts[mine].sum(0))
    typical = _shares(whole_prose)
    names = [f"prose_{lang}" for lang in languages] or ["prose"]
    kinds = [un.CLASSES[int((x - typical).argmax())] for x in structures]
    names += [f"{kind}s_{kinds[:k].count(kind) + 1}" for k, kind in enumerate(kinds)]
    return Profiles(names, np.concatenate([prose, structures]), len(prose))


@dataclass
class Order:
    """Which function words stand next to each other: per language the pairs' numbers sorted, their counts in prose and their expectation by chance."""

    pairs: list[np.ndarray]
    count: list[np.ndarray]
    left: list[np.ndarray]
    right: list[np.ndarray]
    total: list[float]

    def prose_like(self, language: int, pairs: np.ndarray, own: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """Per text how much nearer its pairs (numbers and how often they stand in it) are to prose than to chance, in nats.

        The difference of their Kullback-Leibler divergences, times the pairs.
        The text itself is not counted as prose; one pair by chance is added to
        the counts. 0 without pairs.
        """
        words = len(self.left[language])
        by_chance = np.maximum(self.left[language][pairs // words] * self.right[language][pairs % words], 1e-12)
        known = self.pairs[language]
        at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
        seen = np.where(known[at] == pairs, self.count[language][at], 0.0) if len(known) else np.zeros(len(pairs))
        others = np.maximum(self.total[language] - np.bincount(text, own, texts), 0)[text] + 1
        return np.bincount(text, own * np.log((np.maximum(seen - own, 0) + by_chance) / others / by_chance), texts)


def _fit_order(rows: list[tuple[int, int, float]], words: int, languages: int) -> Order:
    out = Order([], [], [], [], [])
    table = np.array(rows, np.float64).reshape(-1, 3)
    for k in range(languages):
        own = table[table[:, 0] == k]
        pair, n = own[:, 1].astype(np.int64), own[:, 2]
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        total = float(n.sum())
        out.pairs.append(pair)
        out.count.append(n)
        out.total.append(total)
        out.left.append(np.bincount(pair // words, n, words) / max(total, 1e-12))
        out.right.append(np.bincount(pair % words, n, words) / max(total, 1e-12))
    return out


_STATS = ("words", "letters", "visible", "symbols", "size", "lines", "ended", "all_words", "common", "language")
_READ = "doc_id long, digest long, raw_visible long, " + ", ".join(f"{c} long" for c in _STATS) + ", repeated double, unit_language array<int>, unit_counts array<int>, pair_splits array<int>, pairs array<int>"


def _read(common: dict[str, list[str]]):
    lexicon = un.Lexicon(common)

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(begin, TEXTS)
                texts = batch.column(2).to_pylist()
                got = un.read(texts, lexicon)
                edge = np.searchsorted(got.text, np.arange(len(texts) + 1))
                lists = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)))
                # per text the ends of its units' pairs, counted from its own first pair
                ends = got.pair_splits[1:] - np.repeat(got.pair_splits[edge[:-1]], np.diff(edge))
                raw = np.array([len("".join(t.split())) if t else 0 for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(raw), *(pa.array(got.stats[c]) for c in _STATS), pa.array(got.stats["repeated"]), lists(edge, got.language), lists(edge * _N, got.counts.ravel()), lists(edge, ends), lists(got.pair_splits[edge], got.pairs)],
                    names=[c.split()[0] for c in _READ.split(", ")],
                )

    return run


def _units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, language, counts) of the units of a batch of read texts."""
    column = batch.column(batch.schema.get_field_index("unit_language"))
    size = np.diff(column.offsets.to_numpy())
    language = column.flatten().to_numpy().astype(np.int64)
    counts = batch.column(batch.schema.get_field_index("unit_counts")).flatten().to_numpy().reshape(-1, _N)
    return np.repeat(np.arange(len(size)), size), language, counts


def _cells(batches):
    """Units added up in cells of the grid."""
    for batch in batches:
        _, language, counts = _units(batch)
        some = _visible(counts) > 0
        language, counts = language[some], counts[some]
        step = np.floor(_shares(counts) * GRID + 0.5).astype(np.int64)
        code = (step * (GRID + 1) ** np.arange(_N)).sum(1) * 1024 + language
        cell, own = np.unique(code, return_inverse=True)
        sums = np.zeros((len(cell), _N), np.int64)
        np.add.at(sums, own.ravel(), counts)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array((cell % 1024).astype(np.int32)), *(pa.array(sums[:, k]) for k in range(_N))], names=["cell", "language", *(f"c{k}" for k in range(_N))])


def _prose_pairs(profiles: Profiles, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units (text, language, visible, nearest profile) and pairs within units of prose (unit, number)."""
    text, language, counts = _units(batch)
    near = profiles.nearest(counts, language)
    ends = batch.column(batch.schema.get_field_index("pair_splits")).flatten().to_numpy().astype(np.int64)
    column = batch.column(batch.schema.get_field_index("pairs"))
    first = column.offsets.to_numpy().astype(np.int64)
    ends = ends + (first[:-1] - first[0])[text]
    unit = np.searchsorted(ends, np.arange(int(first[-1] - first[0])), "right")
    number = column.flatten().to_numpy().astype(np.int64)
    prosaic = near[unit] < profiles.prose
    return text, language, _visible(counts), near, unit[prosaic], number[prosaic]


def _count_pairs(profiles: Profiles):
    def run(batches):
        for batch in batches:
            text, language, _, _, unit, number = _prose_pairs(profiles, batch)
            if not len(number):
                continue
            copies = batch.column(batch.schema.get_field_index("copies")).to_numpy()
            code, own = np.unique(language[unit] * (1 << 40) + number, return_inverse=True)
            n = np.bincount(own.ravel(), 1.0 / copies[text[unit]])
            yield pa.RecordBatch.from_arrays([pa.array((code >> 40).astype(np.int32)), pa.array(code & ((1 << 40) - 1)), pa.array(n)], names=["language", "pair", "n"])

    return run


_OUT = "words long, mean_word_length double, visible long, symbol_share double, lines long, ended_share double, common_share double, language string, prose_share double, profile string"


def _judge(profiles: Profiles, order: Order, kept: np.ndarray, languages: list[str]):
    names = profiles.names

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            text, language, visible, near, unit, number = _prose_pairs(profiles, batch)
            size = np.zeros((n, len(names) + 2))
            np.add.at(size, (text, near), visible)
            # texts whose function words stand as by chance are salad, language by language
            words = max(1, len(kept[0]) if len(kept) else 1)
            known = kept[language[unit], number // words] & kept[language[unit], number % words] if len(number) else np.zeros(0, bool)
            unit, number = unit[known], number[known]
            for k in range(profiles.prose):
                mine = language[unit] == k
                pair, own = np.unique(text[unit[mine]] * (1 << 40) + number[mine], return_counts=True)
                salad = order.prose_like(k, pair & ((1 << 40) - 1), own.astype(float), pair >> 40, n) < 0
                size[salad, len(names)] += size[salad, k]
                size[salad, k] = 0
            total = size.sum(1)
            repeated = batch.column(batch.schema.get_field_index("repeated")).to_numpy()
            size[:, len(names) + 1] = size[:, : profiles.prose].sum(1) * repeated
            size[:, : profiles.prose] *= 1 - repeated[:, None]
            good = size[:, : profiles.prose].sum(1)
            col = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (*_STATS, "raw_visible")}
            label = [*names, "salad", "repeated"]
            profile = ["blank" if not v else label[k] if t else "markup" for v, t, k in zip(col["raw_visible"], total, size.argmax(1), strict=True)]
            ratio = lambda a, b, when: pa.array(np.where(b > 0, a / np.maximum(b, 1), 0.0), pa.float64(), mask=~when)
            tongue = [languages[k] if c and languages else None for k, c in zip(col["language"], col["common"], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array(col["words"]),
                    ratio(col["letters"], col["words"], col["words"] > 0),
                    pa.array(col["raw_visible"]),
                    ratio(col["symbols"], col["size"], col["size"] > 0),
                    pa.array(col["lines"]),
                    ratio(col["ended"], col["lines"], col["lines"] > 0),
                    ratio(col["common"], col["all_words"], col["all_words"] > 0),
                    pa.array(tongue, pa.string()),
                    ratio(good, total, col["raw_visible"] > 0),
                    pa.array(profile, pa.string()),
                ],
                names=["doc_id", *(c.split()[0] for c in _OUT.split(", "))],
            )

    return run


def _paired(rows: DataFrame, words: int, languages: int) -> np.ndarray:
    """Per language, which words' neighbourhood counts: the PAIRED most frequent ones in pairs, of equals the first."""
    out = np.zeros((languages, words), bool)
    first = rows.groupBy("language", F.floor(F.col("pair") / words).cast("int").alias("word")).agg(F.sum("n").alias("n")).toArrow()
    lang, word, n = (first[c].to_numpy() for c in ("language", "word", "n"))
    for k in range(languages):
        own = np.flatnonzero(lang == k)
        top = own[np.lexsort((word[own], -np.round(n[own], 6)))[:PAIRED]]
        out[k, word[top]] = True
    return out


def quality(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row of statistics per document, with its nearest structural profile and the share of its visible characters that is prose.

    Words are runs of a-z and 0-9. A text is cut into units, lines or sentences
    without markup. Each unit's distribution of characters over letters of
    function words, other letters, accented letters, digits, spaces,
    punctuation, symbols and all else is compared with the profiles of prose in
    each language of ``common_words`` and with profiles of structures; the
    nearest by Jensen-Shannon divergence is the unit's. No profile is given:
    all are fitted to the counts of all units of all documents
    (``fit_profiles``). Then the neighbouring function words of a text's prose
    are compared with those of all prose and with chance: if chance is nearer,
    the text is word salad (each distinct text counts once). What repeats the
    text's own words over and over, at one distance, is no prose either.
    A document's profile is the one with most of its characters.

    Null and blank texts get the profile ``blank``, counts of 0 and null
    shares, texts of markup alone ``markup``. Rows are kept as they come,
    repeated ids included. Texts are read once; what is read of them, without
    the texts, is a table in the shared folder.
    """
    scratch = Scratch(documents.sparkSession, "quality")
    # a table of frequent words is small by its nature
    ranked = common_words.where("lang is not null and word is not null").select("lang", F.lower("word").alias("word")).distinct()
    common: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "word").collect():
        common.setdefault(r["lang"], []).append(r["word"])
    languages = sorted(common)
    words = max(1, len({w for own in common.values() for w in own}))
    rows = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text"))
    read = scratch.write(rows.mapInArrow(_read(common), _READ), "read")
    sums = ", ".join(f"c{k} long" for k in range(_N))
    cells = read.select("unit_language", "unit_counts").mapInArrow(_cells, f"cell long, language int, {sums}")
    cells = cells.groupBy("cell", "language").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(_N)]).orderBy("cell").toArrow()
    profiles = fit_profiles(cells["language"].to_numpy(), np.stack([cells[f"c{k}"].to_numpy() for k in range(_N)], 1), languages)
    copies = read.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    counted = read.join(copies, "digest", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    pairs = counted.select("copies", "unit_language", "unit_counts", "pair_splits", "pairs").mapInArrow(_count_pairs(profiles), "language int, pair long, n double")
    pairs = scratch.write(pairs.groupBy("language", "pair").agg(F.sum("n").alias("n")), "pairs")
    kept = _paired(pairs, words, max(1, len(languages)))
    found = pairs.toArrow() if kept.all(1).all() else _bounded(pairs, kept, words).toArrow()
    order = _fit_order(list(zip(found["language"].to_pylist(), found["pair"].to_pylist(), found["n"].to_pylist(), strict=True)), words, max(1, len(languages)))
    return read.mapInArrow(_judge(profiles, order, kept, languages), f"doc_id long, {_OUT}")


def _bounded(pairs: DataFrame, kept: np.ndarray, words: int) -> DataFrame:
    """The pairs of words that are kept: PAIRED squared a language at most."""
    spark = pairs.sparkSession
    few = spark.createDataFrame([(int(k), int(w)) for k, w in zip(*np.nonzero(kept), strict=True)], "language int, word int")
    split = pairs.withColumn("a", F.floor(F.col("pair") / words).cast("int")).withColumn("b", (F.col("pair") % words).cast("int"))
    for side in ("a", "b"):
        split = split.join(F.broadcast(few.withColumnRenamed("word", side)), ["language", side], "left_semi")
    return split.select("language", "pair", "n")


def counts(documents: DataFrame) -> DataFrame:
    """(doc_id, words, mean_word_length, lines, ended) of every row, by built-in functions alone.

    Words are runs of a-z and 0-9; lines are the non-blank ones; ended are
    those that end in . ! or ?. Null and empty texts count 0, their mean is null.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = documents.select("doc_id", words.alias("w"), lines.alias("l"))
    n = F.size("w")
    mean = F.when(n > 0, F.round(F.length(F.array_join("w", "")) / n, 6))
    ended = F.size(F.filter("l", lambda x: F.right(x, F.lit(1)).isin(".", "!", "?")))
    return rows.select("doc_id", n.alias("words"), mean.alias("mean_word_length"), F.size("l").alias("lines"), ended.alias("ended"))
