"""Word sets cut into boxes: one order of all words, budgets by size, and the keys by which near sets meet."""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklattice.session import Scratch

from . import words as ws

#: A word is frequent if it makes up more than one in so many of all words; so there are fewer frequent words than this (16 bytes each).
FREQUENT = 1 << 18
#: A word in so many rows or fewer is never frequent.
LEAST = 8
#: Sizes from which a new band begins: BAND * 4**k.
BAND = 24
#: Shares of a band's rows at which its levels of slack are cut.
LEVELS = (0.4, 0.8, 0.97, 0.999)
#: Columns of a key row.
KEY_ROW = "key long, id long, n int, slack long, boxes int, start int, alike boolean, at int, s0 long, s1 long"
#: Bits of a sketch.
BITS = 128
#: Slots of a map of keys: 2**MAP bits, 4 MB. Two keys may share a slot, so a key that isn't there may seem to be, never the other way.
MAP = 25


@dataclass
class Order:
    """One order of all words: the rare ones by hash, then the frequent ones.

    ``known`` are the sorted hashes of the frequent words and ``place`` their
    places among themselves. Places follow the van der Corput sequence of the
    ranks by frequency, so that every stretch of the order mixes seldom and
    common words alike. ``mark`` is the share of the information (binary
    entropy of a word's presence) that stands before a word; boxes are cut at
    equal steps of it. ``limit`` is the number of rows a rare word can be in,
    ``shared`` a map of the rare words that are in more rows than one.
    """

    known: np.ndarray
    place: np.ndarray
    mark: np.ndarray
    limit: int
    shared: np.ndarray

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, mark) of words; place -1 for rare ones."""
        if not len(self.known) or not len(hashes):
            return np.full(len(hashes), -1, np.int64), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = self.known[at] == hashes
        return np.where(hit, self.place[at], -1), np.where(hit, self.mark[at], 0.0)

    def arrange(self, splits: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, place, mark) with the words of each row in this order."""
        place, mark = self.look(hashes)
        row = np.repeat(np.arange(len(splits) - 1), np.diff(splits))
        order = np.lexsort((hashes, place, row))
        return hashes[order], place[order], mark[order]


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(long, bit) of each key in a map."""
    return (keys >> np.uint64(70 - MAP)).astype(np.int64), np.uint64(1) << (keys >> np.uint64(64 - MAP) & np.uint64(63))


def _hit(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at, bit = _slots(keys)
    return known[at] & bit != 0


def _map_rows(keys_of):
    """(at, bits) of the map of the keys that ``keys_of`` gives for each batch."""

    def run(batches):
        own = np.zeros(1 << (MAP - 6), np.uint64)
        for batch in batches:
            for keys in keys_of(batch):
                np.bitwise_or.at(own, *_slots(keys))
        at = np.flatnonzero(own)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at].view(np.int64))], names=["at", "bits"])

    return run


def _key_map(rows: DataFrame) -> np.ndarray:
    """The map of rows (at, bits): at most 2**(MAP - 6) of them reach the driver, however many keys there are."""
    found = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP - 6), np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _id_keys(batch: pa.RecordBatch) -> np.ndarray:
    return ws.mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def of_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``sets`` (id first) that stand in some pair (a, b), by a map of the pairs' ids; a few others may be among them."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    known = _key_map(ids.mapInArrow(_map_rows(lambda batch: [_id_keys(batch)]), "at long, bits long"))

    def run(batches):
        for batch in batches:
            kept = np.flatnonzero(_hit(known, _id_keys(batch)))
            if len(kept):
                yield batch.take(pa.array(kept))

    return sets.mapInArrow(run, sets.schema)


def _alone(hashes: np.ndarray) -> np.ndarray:
    """Keys of rare words."""
    return ws.mix(hashes + np.uint64(1))


def word_order(sets: DataFrame, words: str, scratch: Scratch, frequent: int = FREQUENT, least: int = LEAST) -> Order:
    """The order of the words of ``sets``, from counts over all rows.

    A word in more than max(least, all words / frequent) rows is frequent:
    fewer than ``frequent`` words can be, so many reach the driver and the
    tasks, and a rare word is in no more rows than that.
    """
    total, rows = sets.agg(F.sum(F.size(words)), F.count("*")).first()
    limit = max(least, (total or 0) // frequent)
    counts = sets.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    counts = scratch.write(counts, "counts")
    met = counts.where(F.col("n") <= limit).select("w").mapInArrow(_map_rows(lambda b: [_alone(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))]), "at long, bits long")
    shared = _key_map(met)
    counts = counts.where(F.col("n") > limit).toArrow()
    hashes, n = counts["w"].to_numpy().view(np.uint64), counts["n"].to_numpy().astype(np.float64)
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((hashes, n))] = np.arange(len(n))
    turned, bits = np.zeros(len(n), np.int64), max(1, int(len(n)).bit_length())
    for b in range(bits):
        turned |= (rank >> b & 1) << (bits - 1 - b)
    by_place = np.argsort(turned)
    place = np.empty(len(n), np.int64)
    place[by_place] = np.arange(len(n))
    share = np.clip(n / max(1, rows), 1e-12, 1 - 1e-12)
    info = -(share * np.log(share) + (1 - share) * np.log(1 - share))
    before = np.cumsum(info[by_place]) - info[by_place] / 2
    mark = before[place] / max(info.sum(), 1e-300)
    known = np.argsort(hashes)
    return Order(hashes[known], place[known], mark[known], int(limit), shared)


@dataclass
class Budget:
    """How far two sets may differ: sets of n and m words with Jaccard overlap p/q differ in (q-p)/(p+q) * (n+m) words at most."""

    p: int
    q: int

    @staticmethod
    def of(threshold: float) -> Budget:
        share = Fraction(threshold).limit_denominator(1000)
        return Budget(share.numerator, share.denominator)

    @property
    def unit(self) -> int:
        return self.p + self.q

    def whole(self, n):
        """A set's part of the budget, in 1/unit words."""
        return (self.q - self.p) * n

    def slack(self, n, rare):
        """What is left of it if none of its rare words is shared."""
        return self.whole(n) - self.unit * rare

    def lost(self, n):
        """Words of a set of n that its partner can lack."""
        return n - -(-self.p * n // self.q)


def _band(n: np.ndarray) -> np.ndarray:
    return np.maximum(0, 1 + np.floor(np.log(np.maximum(n, 1) / BAND) / np.log(4)).astype(np.int64))


def _bucket(slack: np.ndarray, unit: int) -> np.ndarray:
    """Half words of slack; from 64 words on, sixteenths of an octave."""
    s = slack / unit
    wide = 128 + np.floor(16 * np.log2(np.maximum(s, 64) / 64)).astype(np.int64)
    return np.where(s < 64, np.maximum(np.floor(2 * s), -128).astype(np.int64), wide)


@dataclass
class Cells:
    """Kinds of sets by size and slack, and how many boxes two kinds are cut into when their sets are compared."""

    cuts: dict[int, np.ndarray]
    kinds: dict[tuple[int, int], tuple[int, int, int]]
    pairs: list[tuple[tuple[int, int], tuple[int, int], int]] = field(default_factory=list)

    def kind(self, n: np.ndarray, slack: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
        band, bucket = _band(n), _bucket(slack, unit)
        level = np.zeros(len(n), np.int64)
        for b, cuts in self.cuts.items():
            own = band == b
            level[own] = np.searchsorted(cuts, bucket[own], "left")
        return band, level


def cells(sets: DataFrame, words: str, order: Order, budget: Budget, both_ways: bool = False, levels: tuple = LEVELS) -> Cells:
    """The kinds of sets that occur, and their pairs (in both orders, if ``both_ways``). A few hundred rows reach the driver, whatever the number of sets."""

    def run(batches):
        for batch in batches:
            splits, hashes = ws.flat(batch.column(0))
            n = np.diff(splits)
            rare = np.bincount(np.repeat(np.arange(len(n)), n), order.look(hashes)[0] < 0, len(n)).astype(np.int64)
            slack = budget.slack(n, rare)
            code = np.stack([_band(n), _bucket(slack, budget.unit)], 1)
            kinds, own = np.unique(code, axis=0, return_inverse=True)
            own = own.ravel()
            most, lo, hi = np.full(len(kinds), -(1 << 60)), np.full(len(kinds), 1 << 60), np.zeros(len(kinds), np.int64)
            np.maximum.at(most, own, slack)
            np.minimum.at(lo, own, n)
            np.maximum.at(hi, own, n)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kinds[:, 0], kinds[:, 1], np.bincount(own, minlength=len(kinds)), most, lo, hi)], names=["band", "bucket", "n", "slack", "lo", "hi"])

    found = sets.select(words).mapInArrow(run, "band long, bucket long, n long, slack long, lo long, hi long")
    rows = found.groupBy("band", "bucket").agg(F.sum("n"), F.max("slack"), F.min("lo"), F.max("hi")).collect()
    rows = np.array(sorted(map(tuple, rows)), np.int64).reshape(-1, 6)
    cuts, kinds = {}, {}
    for band in np.unique(rows[:, 0]).tolist():
        own = rows[rows[:, 0] == band]
        near = own[own[:, 1] >= min(-own[:, 1].max() - 2, own[:, 1].max())]
        upto = np.cumsum(near[:, 2]) / near[:, 2].sum()
        cuts[band] = np.unique(near[np.minimum(np.searchsorted(upto, levels), len(near) - 1), 1])
        level = np.searchsorted(cuts[band], own[:, 1], "left")
        for k in np.unique(level).tolist():
            part = own[level == k]
            kinds[band, k] = (int(part[:, 3].max()), int(part[:, 4].min()), int(part[:, 5].max()))
    out = Cells(cuts, kinds)
    for a, (slack_a, lo_a, hi_a) in kinds.items():
        for b, (slack_b, lo_b, hi_b) in kinds.items():
            left = slack_a + slack_b
            if (both_ways or a <= b) and left >= 0 and lo_a * budget.p <= hi_b * budget.q and lo_b * budget.p <= hi_a * budget.q:
                out.pairs.append((a, b, left // budget.unit + 1))
    return out


def _bits(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two longs per row with the bits of its values, by sums over distinct (row, bit)."""
    code = np.unique(row * BITS + values)
    begin = np.searchsorted(code // BITS, np.arange(rows + 1))
    out = []
    for high in (False, True):
        bit = np.where((code % BITS >= 64) == high, np.uint64(1) << (code & 63).astype(np.uint64), np.uint64(0))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bit, dtype=np.uint64)])
        out.append(total[begin[1:]] - total[begin[:-1]])
    return out[0], out[1]


def _down(low: np.ndarray, high: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits shifted down by ``by`` places (0 to 128)."""
    for step in (64, 32, 16, 8, 4, 2, 1):
        much = by >= step
        by = np.where(much, by - step, by)
        s = np.uint64(step % 64)
        a, b = (high, np.zeros_like(high)) if step == 64 else (low >> s | high << np.uint64(64 - step), high >> s)
        low, high = np.where(much, a, low), np.where(much, b, high)
    return low, high


def turned(low: np.ndarray, high: np.ndarray, by: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A ring of ``width`` bits turned down by ``by`` places, less than its width."""
    a0, a1 = _down(low, high, by)
    b0, b1 = _up(low, high, np.where(by > 0, width - by, 0))
    m0, m1 = np.uint64((1 << min(width, 64)) - 1), np.uint64((1 << max(width - 64, 0)) - 1)
    return np.where(by > 0, (a0 | b0) & m0, low), np.where(by > 0, (a1 | b1) & m1, high)


def _up(low: np.ndarray, high: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits shifted up by ``by`` places (0 to 128)."""
    for step in (64, 32, 16, 8, 4, 2, 1):
        much = by >= step
        by = np.where(much, by - step, by)
        s = np.uint64(step % 64)
        a, b = (np.zeros_like(low), low) if step == 64 else (low << s, high << s | low >> np.uint64(64 - step))
        low, high = np.where(much, a, low), np.where(much, b, high)
    return low, high


def _keys(order: Order, kinds: Cells, budget: Budget, left_side: bool, seen: np.ndarray | None, alike_too: bool, just_keys: bool):
    def rows(batch):
        splits, hashes = ws.flat(batch.column(1))
        n = np.diff(splits)
        ids = batch.column(0).to_numpy()
        hashes, place, mark = order.arrange(splits, hashes)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - splits[row]
        rare = np.bincount(row, place < 0, len(n)).astype(np.int64)
        slack = budget.slack(n, rare)

        def out(key, own, left, boxes, start, alike, where, sketch):
            arrays = [key.view(np.int64), ids[own], n[own].astype(np.int32), left, np.full(len(own), boxes, np.int32), start.astype(np.int32), np.full(len(own), alike), where.astype(np.int32), *(x.view(np.int64) for x in sketch)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[c.split()[0] for c in KEY_ROW.split(", ")])

        alone = np.flatnonzero((place < 0) & (at <= budget.lost(n)[row]))
        alone = alone[_hit(order.shared, _alone(hashes[alone]))]
        if seen is not None and alike_too:
            alone = alone[_hit(seen, _alone(hashes[alone]))]
        if just_keys:
            if alike_too:
                yield _alone(hashes[alone])
        elif len(alone):
            own = row[alone]
            s0, s1 = _bits((hashes >> np.uint64(9) & np.uint64(BITS - 1)).astype(np.int64), row, len(n))
            yield out(_alone(hashes[alone]), own, budget.whole(n)[own], 0, np.full(len(own), -1), True, at[alone], (s0[own], s1[own]))
        common = np.flatnonzero(place >= 0)
        row_c, mark_c, hash_c = row[common], mark[common], hashes[common]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ws.mix(hash_c), dtype=np.uint64)])
        band, level = kinds.kind(n, slack, budget.unit)
        for number, (a, b, m) in enumerate(kinds.pairs):
            if just_keys and a == b and not alike_too:
                continue
            mine, (most, lo, hi) = (a, kinds.kinds[b]) if left_side else (b, kinds.kinds[a])
            takes = (band == mine[0]) & (level == mine[1]) & (slack + most >= 0) & (n * budget.p <= hi * budget.q) & (lo * budget.p <= n * budget.q)
            own = np.flatnonzero(takes)
            if not len(own):
                continue
            index = np.full(len(n), -1, np.int64)
            index[own] = np.arange(len(own))
            inside = np.flatnonzero(takes[row_c])
            box = np.minimum((mark_c[inside] * m).astype(np.int64), m - 1)
            # the words of a row stand in the order of their boxes
            edge = np.searchsorted(index[row_c[inside]] * m + box, np.arange(len(own) * m + 1))
            flat = np.append(inside, inside[-1] + 1 if len(inside) else 0)
            # an empty stretch has no words, wherever it is said to begin
            begin, end = flat[edge[:-1]], np.where(edge[1:] > edge[:-1], flat[np.maximum(edge[1:] - 1, 0)] + 1, flat[edge[:-1]])
            content = total[end] - total[begin]
            start = np.tile(np.arange(m), len(own))
            key = ws.mix(content + ws.mix(np.uint64((number + 1) << 32) + start.astype(np.uint64)))
            if just_keys:
                yield key
                continue
            kept = np.arange(len(key)) if seen is None or (a == b and not alike_too) else np.flatnonzero(_hit(seen, key))
            if not len(kept):
                continue
            wide = max(1, BITS // m)
            bit = box * wide + (hash_c[inside] >> np.uint64(9)).astype(np.int64) % wide if m <= BITS else box * BITS // m
            s0, s1 = (x[kept // m] for x in _bits(bit, index[row_c[inside]], len(own)))
            if m <= BITS:
                # so that the box of the key is the lowest
                s0, s1 = turned(s0, s1, start[kept] * wide, wide * m)
            repeated = own[kept // m]
            where = np.minimum(begin[kept], np.searchsorted(row_c, repeated, "right")) - np.searchsorted(row_c, repeated) + rare[repeated]
            yield out(key[kept], repeated, slack[repeated], m, start[kept], a == b, where, (s0, s1))

    def pieces(whole):
        for begin in range(0, whole.num_rows, 2048):
            yield from rows(whole.slice(begin, 2048))

    def run(batches):
        for whole in batches:
            yield from pieces(whole)

    return pieces if just_keys else run


def key_map(sets: DataFrame, id_col: str, words: str, order: Order, kinds: Cells, budget: Budget, left: bool, alike_too: bool) -> np.ndarray:
    """The map of one side's keys; without ``alike_too`` only of those between two kinds of sets.

    The other side need not show the keys that aren't in it.
    """
    keys = _keys(order, kinds, budget, left, None, alike_too, True)
    return _key_map(sets.select(F.col(id_col).cast("long"), words).mapInArrow(_map_rows(keys), "at long, bits long"))


def key_rows(sets: DataFrame, id_col: str, words: str, order: Order, kinds: Cells, budget: Budget, left: bool, seen: np.ndarray | None = None, alike_too: bool = False) -> DataFrame:
    """Rows (key, id, n, slack, boxes, start, alike, at, s0, s1): the keys by which sets within the budget meet, for the left or the right side of a join.

    A rare word is a box of its own: two sets that share one meet at it, and a
    set shows only those among its first ``lost + 1`` words (``boxes`` is 0).
    If two sets share no rare word, all their rare words are differences, and
    the frequent words may differ in no more than the sum of the two slacks.
    The frequent words are then cut into more boxes than that, so at least one
    box is equal: a key is a box with its whole content. How many boxes is
    fixed for each pair of kinds of sets; the left side shows the sets of the
    first kind, the right side those of the second (``alike`` if it is the same
    kind, so that a pair meets in both ways). ``at`` is the place at which the
    box begins, the sketch s0, s1 has the words of the set (for a box: its
    frequent words, from this box on) as bits. Rare words in one row only, and
    keys that are not in the map ``seen`` of the other side, are left out.
    """
    return sets.select(F.col(id_col).cast("long"), words).mapInArrow(_keys(order, kinds, budget, left, seen, alike_too, False), KEY_ROW)


def within(a: str, b: str, budget: Budget) -> Column:
    """Condition on two key rows with one key: sizes, whole sketch, and for boxes the chains from the common box on.

    Bits that differ are a lower bound of the words that do. A chain of l of
    the m boxes, from the common one, may differ in l/m of what the pair has
    left; chains of a quarter, a half and three quarters are held against it.
    """
    x, y = (lambda c: f"{a}.{c}"), (lambda c: f"{b}.{c}")
    left, m = f"({x('slack')} + {y('slack')})", x("boxes")
    low, high = f"({x('s0')} ^ {y('s0')})", f"({x('s1')} ^ {y('s1')})"
    half = (1 << 32) - 1
    chain = {32: f"bit_count({low} & {half}L)", 64: f"bit_count({low})", 96: f"(bit_count({low}) + bit_count({high} & {half}L))"}
    tests = [f"{x('n')} * {budget.p} <= {y('n')} * {budget.q}", f"{y('n')} * {budget.p} <= {x('n')} * {budget.q}", f"(bit_count({low}) + bit_count({high})) * {budget.unit} <= {left}"]
    for bits, apart in chain.items():
        length = f"(({bits} - 1) div ({BITS} div {m}) + 1)"
        tests.append(f"({m} = 0 or {m} > {BITS} or {apart} * {budget.unit} * {m} <= {length} * {left})")
    return (F.col(x("key")) == F.col(y("key"))) & F.expr(" and ".join(tests))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the concatenated ranges lo[i]..hi[i]-1."""
    size = hi - lo
    row = np.repeat(np.arange(len(lo)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size - lo, size)


def chains(pair: np.ndarray, box: np.ndarray, hashes: np.ndarray, boxes: np.ndarray, start: np.ndarray, any_start: np.ndarray, left: np.ndarray, unit: int) -> tuple[np.ndarray, int]:
    """(row numbers that stay in budget, boxes compared).

    Word k of either set of row pair[k] is in box[k] of the row's ring of
    boxes[row]. From start[row] on, box after box is compared exactly; the
    differences of the first l boxes may be l/boxes of ``left``/unit. At the
    first chain that exceeds it the row is dropped, or, where any start will
    do, the search goes on behind that chain, because no start inside it can
    hold either. Rows whose differences sum to the budget or less have a start
    that holds, so none of them is lost.
    """
    base = np.concatenate([[0], np.cumsum(boxes)])
    code = base[pair] + box
    order = np.argsort(code, kind="stable")
    hashes = hashes[order]
    edge = np.searchsorted(code[order], np.arange(base[-1] + 1))
    at, length, total = start.astype(np.int64).copy(), np.zeros(len(boxes), np.int64), np.zeros(len(boxes), np.int64)
    alive, done, compared = boxes > 0, np.zeros(len(boxes), bool), 0
    while alive.any():
        act = np.flatnonzero(alive)
        cell = base[act] + (at[act] + length[act]) % boxes[act]
        row, k = _ranges(edge[cell], edge[cell + 1])
        h = hashes[k]
        by = np.lexsort((h, row))
        row, h = row[by], h[by]
        both = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=len(act))
        total[act] += edge[cell + 1] - edge[cell] - 2 * both
        length[act] += 1
        compared += len(act)
        over = total[act] * boxes[act] * unit > length[act] * left[act]
        again = act[over & any_start[act]]
        at[again] += length[again]
        length[again] = total[again] = 0
        alive[act[over & ~any_start[act]]] = False
        alive[again[at[again] >= boxes[again]]] = False
        full = act[~over & (length[act] == boxes[act])]
        done[full], alive[full] = True, False
    return np.flatnonzero(done), compared
