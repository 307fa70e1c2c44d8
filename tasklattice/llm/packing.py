"""Filling training sequences: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.session import Scratch, spread

#: Items packed together; a step holds a block and what the one before left over (24 bytes an item).
BLOCK = 4096
#: Items of a bucket, on average. Buckets are packed each for itself, so sequences depend on the items and not on the cluster.
BUCKET = 8192

TOKENIZER = os.environ.get("TASKLATTICE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the split pattern that belongs to the vocabulary file (the public GPT-2 pattern).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict = {}


def encoding(path: str):
    """The tokenizer of a .tiktoken rank file that the session has been given, loaded once per Python worker."""
    if path not in _encodings:
        import base64

        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(df: DataFrame, keep: list[str], texts: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and, for each text column, its number of tokens (0 for null). Whole texts are read; the driver's tokenizer file goes to all executors."""
    df.sparkSession.sparkContext.addFile(tokenizer)
    kept = spread(df.select(*keep, *texts))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[: len(keep)]), *(f"`{t}` bigint" for t in texts)])

    def run(batches):
        enc = encoding(tokenizer)
        for batch in batches:
            cols = list(batch.columns[: len(keep)])
            for k in range(len(texts)):
                counts = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(len(keep) + k).to_pylist()]
                cols.append(pa.array(counts, pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *texts])

    return kept.mapInArrow(run, schema)


def pack_block(need: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The bin of each item. ``need`` (items x limits) must fit ``capacity`` row by row.

    A bin is opened with the largest item left and filled with the item whose
    needs, as shares of the capacity, have the largest dot product with what is
    still free, until none fits; ties fall to the earlier item. Items of equal
    needs are one kind with a count, so a step costs the number of kinds.
    """
    kinds, kind = np.unique(need, axis=0, return_inverse=True)
    kind = kind.ravel()
    order = np.argsort(kind, kind="stable")
    first = np.searchsorted(kind[order], np.arange(len(kinds)))
    left = np.bincount(kind, minlength=len(kinds))
    used = np.zeros(len(kinds), np.int64)
    share = kinds / np.maximum(capacity, 1)
    large = share.max(1)
    bins = np.empty(len(need), np.int64)
    bin_no, packed = 0, 0
    alive = np.arange(len(kinds))
    while packed < len(need):
        free = capacity.astype(np.int64).copy()
        alive = alive[left[alive] > 0]
        k = int(alive[np.argmax(large[alive])])
        while True:
            bins[order[first[k] + used[k]]] = bin_no
            used[k] += 1
            left[k] -= 1
            free -= kinds[k]
            packed += 1
            fits = alive[(left[alive] > 0) & (kinds[alive] <= free).all(1)]
            if not len(fits):
                break
            k = int(fits[np.argmax(share[fits] @ (free / np.maximum(capacity, 1)))])
        bin_no += 1
    return bins


def _pack_stream(capacity: np.ndarray, block: int, full: float):
    """Packs rows (bucket, item ..., tokens, segments, loss), sorted by bucket, block by block.

    What a block's bins below the share ``full`` hold is packed again with the
    next block of the bucket, so that only its last block leaves such bins. A
    bin of a block counts as full if any of its limits is.
    """

    def run(batches):
        bucket, next_bin, rest = None, 0, None

        def close(table: pa.Table, last: bool):
            """(packed rows with their sequence, rows to be packed again)."""
            nonlocal next_bin
            need = np.stack([table.column(c).to_numpy() for c in ("tokens", "segments", "loss")], 1).astype(np.int64)
            bins = pack_block(need, capacity)
            held = np.zeros((bins.max() + 1, 3), np.int64)
            np.add.at(held, bins, need)
            go = np.ones(len(held), bool) if last else (held >= full * capacity).any(1)
            if not go.any():
                go[:] = True
            number = np.cumsum(go) - 1 + next_bin
            next_bin += int(go.sum())
            done = np.flatnonzero(go[bins])
            out = table.take(pa.array(done)).append_column("sequence", pa.array((np.int64(bucket) << 33) + number[bins[done]]))
            return out.combine_chunks().to_batches(), table.take(pa.array(np.flatnonzero(~go[bins]))).combine_chunks()

        waiting: list[pa.Table] = []

        def drain(last: bool):
            nonlocal rest, waiting
            table = pa.concat_tables(waiting).combine_chunks() if waiting else None
            begin, size = 0, table.num_rows if table is not None else 0
            while size - begin >= block or (last and begin < size):
                piece = table.slice(begin, block)
                begin += piece.num_rows
                piece = pa.concat_tables([rest, piece]).combine_chunks() if rest is not None and rest.num_rows else piece
                out, rest = close(piece, last and begin >= size)
                yield from out
            waiting = [table.slice(begin)] if begin < size else []
            if last and rest is not None and rest.num_rows:
                out, rest = close(rest, True)
                yield from out

        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if own[a] != bucket:
                    yield from drain(True)
                    bucket, next_bin, rest = int(own[a]), 0, None
                waiting.append(pa.Table.from_batches([batch.slice(a, b - a)]))
                yield from drain(False)
        yield from drain(True)

    return run


def pack(items: DataFrame, key: str, capacity: int, segments: int, loss: int, seed: int = 0) -> DataFrame:
    """(key, piece, first_token, tokens, loss, sequence): the sequence of every piece of every item.

    ``items`` has ``key`` (unique, not null), ``tokens`` and ``loss``, the
    loss-bearing tokens. A sequence holds up to ``capacity`` tokens, ``segments``
    pieces and ``loss`` loss-bearing tokens at once. An item is divided only if
    it exceeds the capacity (or, alone, the limit of loss-bearing tokens): into
    full pieces and a rest, its loss-bearing tokens being counted from its end.
    Items without tokens get no sequence.

    Items are spread by a hash over buckets, as many as their number asks for,
    and sorted within them: the same items give the same sequences on any
    cluster and in any order. A block of a few thousand items and the leftover
    of the one before are all that is held.
    """
    if min(capacity, segments, loss) < 1:
        raise ValueError("capacity, segments and loss must be positive")
    scratch = Scratch(items.sparkSession, "pack")
    step = min(capacity, loss)
    items = scratch.write(items.select(key, "tokens", "loss"), "items")
    buckets = max(1, -(-items.count() // BUCKET))
    whole = (F.col("tokens") <= capacity) & (F.col("loss") <= loss)
    n = F.when(whole, 1).otherwise(F.ceil(F.col("tokens") / step)).cast("int")
    pieces = items.where(F.col("tokens") > 0).select(key, "tokens", F.least(F.coalesce("loss", F.lit(0)), "tokens").alias("all_loss"), whole.alias("whole"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    begin = F.when(F.col("whole"), 0).otherwise(F.col("piece") * step).cast("long")
    end = F.when(F.col("whole"), F.col("tokens")).otherwise(F.least(begin + step, F.col("tokens")))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(buckets)).cast("int").alias("bucket")
    pieces = pieces.select(
        bucket,
        key,
        "piece",
        begin.alias("first_token"),
        (end - begin).alias("tokens"),
        F.lit(1).cast("long").alias("segments"),
        F.greatest(F.lit(0), end - F.greatest(begin, F.col("tokens") - F.col("all_loss"))).cast("long").alias("loss"),
    )
    pieces = pieces.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", key, "piece")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence long"
    placed = pieces.mapInArrow(_pack_stream(np.array([capacity, segments, loss], np.int64), BLOCK, 0.98), schema)
    return scratch.write(placed.drop("bucket", "segments"), "placed")


def pack_documents(documents: DataFrame, capacity: int = 2048, segments: int = 64, tokenizer: str = TOKENIZER) -> DataFrame:
    """Sequences for documents: (doc_id, piece, first_token, tokens, loss, sequence).

    Sizes are tokens of the whole text; of a document all tokens but the first
    bear loss. Null ids are left out; null and empty texts have no tokens and
    no sequence; of rows with one doc_id the longest text counts.
    """
    rows = documents.where(F.col("doc_id").isNotNull())
    sized = token_counts(rows.select("doc_id", F.col("text").alias("tokens")), ["doc_id"], ["tokens"], tokenizer)
    items = sized.groupBy("doc_id").agg(F.max("tokens").alias("tokens")).withColumn("loss", F.greatest(F.col("tokens") - 1, F.lit(0)))
    return pack(items, "doc_id", capacity, segments, capacity)


def pack_messages(sft: DataFrame, capacity: int = 2048, segments: int = 16, loss: int = 640, tokenizer: str = TOKENIZER) -> DataFrame:
    """Sequences for instruction records: (sft_id, piece, first_token, tokens, loss, sequence); the assistant's tokens bear loss.

    Missing messages and contents count no tokens; an sft_id counts once, the
    record with the most tokens.
    """
    said = lambda role: F.concat_ws("\n", F.transform(F.filter("messages", lambda m: role(m["role"])), lambda m: m["content"]))
    rows = sft.where(F.col("sft_id").isNotNull()).select("sft_id", said(lambda r: r != "assistant").alias("prompt"), said(lambda r: r == "assistant").alias("answer"))
    sized = token_counts(rows, ["sft_id"], ["prompt", "answer"], tokenizer)
    held = F.max(F.struct((F.col("prompt") + F.col("answer")).alias("tokens"), F.col("answer").alias("loss"))).alias("m")
    items = sized.groupBy("sft_id").agg(held).select("sft_id", "m.tokens", "m.loss")
    return pack(items, "sft_id", capacity, segments, loss)
