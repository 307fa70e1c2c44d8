"""Hashed words of texts in Arrow batches, and word order by document frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text worked on at once; a single longer text is still taken whole.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 12), base % (1 << 64), np.uint64)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Karp-Rabin hashes of values[starts:ends]; equal runs have equal hashes wherever they stand."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(splits, hashes) of lower-cased texts: row i has the words hashes[splits[i]:splits[i+1]] in order."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = _WORD[raw]
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[offsets] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | fresh[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | fresh[1:])) + 1
    return np.searchsorted(starts, offsets), windows(raw.astype(np.uint64), starts, ends)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about SLICE_BYTES of the text column each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def lists(splits: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(splits.astype(np.int32)), pa.array(values))


def distinct_words(splits: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with each word once, sorted by hash."""
    row = np.repeat(np.arange(len(splits) - 1), np.diff(splits))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[keep], hashes[keep]
    return np.searchsorted(row, np.arange(len(splits))), hashes


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(splits, values) of a list column of longs."""
    splits = column.offsets.to_numpy().astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return splits - splits[0], values


def word_sets(df: DataFrame, keep: list[str], texts: list[str]) -> DataFrame:
    """``keep`` columns and, for each text column (lower-cased), the sorted hashes of its distinct words.

    Null texts give empty sets. Whole texts are read.
    """
    n = len(keep)
    kept = df.select(*keep, *texts)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:n]), *(f"`{t}` array<bigint>" for t in texts)])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, n):
                sets = [lists(s, h.view(np.int64)) for s, h in (distinct_words(*hashed_words(batch.column(n + k))) for k in range(len(texts)))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *sets], names=[*keep, *texts])

    return kept.mapInArrow(run, schema)


def set_classes(sets: DataFrame, key: str, cols: list[str], scratch, marks: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(representatives, members) of rows whose word sets ``cols`` are all equal; rows with an empty set are left out.

    representatives: (id long, cols, marks), one row per class, a boolean mark
    being true if it is for any member; members: (key, id, marks), one row per
    non-null key. Of several rows with one key the one with the smallest digest
    holds. Sets are compared by a digest of 128 bits. Only rows that repeat an
    earlier key or set enter a join, so the sets themselves aren't shuffled.
    """
    marks = marks or []
    filled = sets.where(F.col(key).isNotNull())
    for c in cols:
        filled = filled.where(F.size(c) > 0)
    rows = filled.select(F.monotonically_increasing_id().alias("id"), key, *marks, *cols, F.xxhash64(*cols).alias("d0"), F.xxhash64(F.lit(1), *cols).alias("d1"))
    rows = scratch.write(rows, "rows")
    slim = rows.select("id", key, *marks, "d0", "d1")
    held = slim.groupBy(key).agg(F.min(F.struct("d0", "d1", "id")).alias("m"), F.count("*").alias("n")).where("n > 1").select(key, F.col("m.id").alias("held"))
    again = scratch.write(slim.select("id", key).join(held, key).where("id != held").select("id"), "again")
    live = slim.join(again, "id", "left_anti")
    flags = [F.max(m).alias(f"any_{m}") for m in marks]
    first = live.groupBy("d0", "d1").agg(F.min("id").alias("first"), F.max("id").alias("last"), *flags).where("first < last").drop("last")
    copies = scratch.write(live.select("id", "d0", "d1").join(first, ["d0", "d1"]).drop("d0", "d1"), "copies")
    members = live.select("id", key, *marks).join(copies.select("id", "first"), "id", "left").select(key, *marks, F.coalesce("first", "id").alias("id"))
    reps = rows.select("id", *marks, *cols).join(again.union(copies.where("id != first").select("id")), "id", "left_anti")
    if marks:
        own = copies.where("id = first").drop("first")
        reps = reps.join(own, "id", "left").select("id", *cols, *[F.coalesce(f"any_{m}", m).alias(m) for m in marks])
    return reps, members
