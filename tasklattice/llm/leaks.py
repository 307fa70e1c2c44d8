"""Evaluation passages inside a corpus, by greedy string tiling over Karp-Rabin hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.session import Scratch

from . import words as ws

#: Up to so many distinct seeds (8 bytes each) of evaluation texts are sent to the tasks; beyond it they are joined.
SEEDS_SENT = 1 << 20
#: Pairs of a document and an item that one task tiles.
PAIRS_A_TASK = 1000
_SEED_ROW = "id long, seed long, places long, words long"


def _seeds(splits: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``length`` words."""
    n = np.maximum(np.diff(splits) - length + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    begin = splits[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, ws.windows(hashes, begin, begin + length)


def _seed_rows(length: int, sent: np.ndarray | None):
    """(id, seed, places, words) of a table (id, lower-cased text), each seed once per row with the number of its places and of the text's words; only the seeds in ``sent`` if given."""

    def run(batches):
        for whole in batches:
            for batch in ws.slices(whole, 1):
                splits, hashes = ws.hashed_words(batch.column(1))
                words = np.diff(splits)
                row, seed = _seeds(splits, hashes, length)
                if sent is not None and len(sent):
                    hit = sent[np.minimum(np.searchsorted(sent, seed), len(sent) - 1)] == seed
                    row, seed = row[hit], seed[hit]
                elif sent is not None:
                    row, seed = row[:0], seed[:0]
                order = np.lexsort((seed, row))
                row, seed = row[order], seed[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (seed[1:] != seed[:-1])])[: len(row)])
                if len(first):
                    places = np.diff(np.append(first, len(row)))
                    row, seed = row[first], seed[first]
                    ids = batch.column(0).to_numpy()
                    columns = (ids[row], seed.view(np.int64), places.astype(np.int64), words[row].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "seed", "places", "words"])

    return run


def tiles(text: np.ndarray, test: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in text, place in test, length) of non-overlapping matches of ``least`` or more words.

    Runs of equal length are found by Karp-Rabin hashes: all windows of the
    test's unmarked stretches against those of the text. The length searched
    starts at the longest possible and is set by doubling and halving to the
    longest that matches; its matches are marked, then the next longest is
    sought. Of equal matches the first in the test, then in the text counts.
    """
    free_text, free_test = np.ones(len(text), bool), np.ones(len(test), bool)
    out: list[tuple[int, int, int]] = []

    def matches(length: int) -> tuple[np.ndarray, np.ndarray]:
        def unmarked(free):
            if len(free) < length:
                return np.zeros(0, np.int64)
            blocked = np.concatenate([[0], np.cumsum(~free)])
            return np.flatnonzero(blocked[length:] == blocked[:-length])

        a, b = unmarked(free_text), unmarked(free_test)
        if not len(a) or not len(b):
            return a[:0], b[:0]
        ha, hb = ws.windows(text, a, a + length), ws.windows(test, b, b + length)
        order = np.argsort(ha, kind="stable")
        at = np.searchsorted(ha[order], hb)
        hit = ha[order][np.minimum(at, len(a) - 1)] == hb
        # the first place in the text of each window of the test
        return a[order][at[hit]], b[hit]

    longest = min(len(text), len(test))
    while longest >= least:
        lo, hi = least, longest
        if not len(matches(lo)[0]):
            break
        while lo < hi:
            middle = (lo + hi + 1) // 2
            if len(matches(middle)[0]):
                lo = middle
            else:
                hi = middle - 1
        longest = lo
        a, b = matches(longest)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if free_text[x : x + longest].all() and free_test[y : y + longest].all():
                free_text[x : x + longest] = False
                free_test[y : y + longest] = False
                out.append((x, y, longest))
    return out


def _reach(text: np.ndarray, test: np.ndarray, least: int) -> int:
    """Words of the test within its runs of ``least`` words that the text has: no tiling covers more."""
    if min(len(text), len(test)) < least:
        return 0
    a, b = np.arange(len(text) - least + 1), np.arange(len(test) - least + 1)
    hit = b[np.isin(ws.windows(test, b, b + least), ws.windows(text, a, a + least))]
    reached = np.zeros(len(test) + 1, np.int64)
    np.add.at(reached, hit, 1)
    np.add.at(reached, hit + least, -1)
    return int((np.cumsum(reached[:-1]) > 0).sum())


def _tile(least: int, coverage: float):
    def run(batches):
        for whole in batches:
            for batch in ws.slices(whole, 2):
                yield from pieces(batch)

    def pieces(batch):
        (sd, docs), (si, items) = ws.hashed_words(batch.column(2)), ws.hashed_words(batch.column(3))
        ids, tests = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rows = []
        for k in range(batch.num_rows):
            text, test = docs[sd[k] : sd[k + 1]], items[si[k] : si[k + 1]]
            if not len(test) or _reach(text, test, least) / len(test) < coverage:
                continue
            found = tiles(text, test, least)
            if found:
                covered = sum(t[2] for t in found)
                rows.append((int(ids[k]), int(tests[k]), len(test), max(t[2] for t in found), len(found), covered, covered / len(test)))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows]) for k in range(7)],
                names=["doc_id", "item_id", "item_words", "longest", "n_tiles", "covered", "coverage"],
            )

    return run


def leaks(documents: DataFrame, items: DataFrame, least: int = 10, coverage: float = 0.0, seeds_sent: int = SEEDS_SENT) -> DataFrame:
    """(doc_id, item_id, item_words, longest, n_tiles, covered, coverage) of items with passages in a document.

    Seeds, the runs of ``least`` words of both sides, are joined by their
    hash, and tiles are runs of ``least`` or more words, so a pair with a tile
    can't be missed. A pair is kept if the tiles cover at least the share
    ``coverage`` of the item's words; tiles may stand in any order. A seed
    covers ``least`` words, so pairs with too few places of shared seeds for
    that share are left out before they are tiled.
    With few seeds the items' are sent to the tasks that read the documents and
    nothing else of the corpus is shuffled, with more both sides are joined.

    Whole texts are read. Null ids are left out; null, empty or shorter texts
    have no passages. Repeated rows of an id count once.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    docs = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("doc_text"))
    tests = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("item_text"))
    seeds = scratch.write(tests.mapInArrow(_seed_rows(least, None), _SEED_ROW), "seeds")
    seeds = seeds.select(F.col("id").alias("item_id"), "seed", "places", "words")
    distinct = seeds.select("seed").distinct()
    few = distinct.limit(seeds_sent + 1).count() <= seeds_sent
    if few:
        seeds = F.broadcast(seeds)
        sent = np.sort(distinct.toPandas()["seed"].to_numpy(np.int64).view(np.uint64))
        hits = docs.mapInArrow(_seed_rows(least, sent), _SEED_ROW)
    else:
        hits = docs.mapInArrow(_seed_rows(least, None), _SEED_ROW)
    hits = hits.select(F.col("id").alias("doc_id"), "seed")
    shared = hits.join(seeds, "seed").groupBy("doc_id", "item_id").agg(F.sum("places").alias("places"), F.min("words").alias("words"))
    pairs = scratch.write(shared.where(F.col("places") * least / F.col("words") >= coverage).select("doc_id", "item_id"), "pairs")
    # so many pairs a task, however small their texts are; rows that repeat an id are tiled each
    spread_out = pairs.repartition(max(1, -(-pairs.count() // PAIRS_A_TASK)), "doc_id")
    both = spread_out.join(docs, "doc_id").join(F.broadcast(tests.distinct()) if few else tests.distinct(), "item_id").select("doc_id", "item_id", "doc_text", "item_text")
    out = "doc_id long, item_id long, item_words long, longest long, n_tiles long, covered long, coverage double"
    tiled = both.mapInArrow(_tile(least, coverage), out).where(F.col("coverage") >= coverage)
    # an id with several texts has several results: the one that covers most holds
    best = F.max(F.struct("covered", "longest", "n_tiles", "item_words", "coverage")).alias("b")
    return tiled.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.item_words", "b.longest", "b.n_tiles", "b.covered", "b.coverage")
