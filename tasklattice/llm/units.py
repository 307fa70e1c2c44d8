"""Texts as units in Arrow batches: characters by class, function words, neighbouring function words, repetition."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from . import words as ws

#: Classes of characters in a unit's distribution.
CLASSES = ("function", "letter", "accented", "digit", "space", "stop", "symbol", "foreign")
#: A line longer than this is cut at its sentence ends; every unit is cut after so many words.
LONG_LINE, UNIT_WORDS = 160, 48
#: Words of a window that counts as repeated when it comes again.
REPEAT = 8

_TAG = re.compile(r"</?[A-Za-z][^<>]*>|&(?:#\d+|[a-z]+);")
_STOP = ".,;:!?'\"()…’“”«»¿¡-"
_ENDS = ".!?…"
_CLOSERS = ".!?…\"'»”"
_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_APOSTROPHES = "'’"


def _kind(ch: str) -> int:
    """Letters 1, accented Latin letters 2, digits 3, spaces 4, stops 5, symbols 6, all else 7."""
    if ch.isspace():
        return 4
    if ch in _STOP:
        return 5
    if ch < "\x80":
        return 1 if ch.isalpha() else 3 if ch.isdigit() else 6
    return 2 if ch < "ɐ" and ch.isalpha() else 7


_KINDS = np.array([_kind(chr(c)) for c in range(0x3001)], np.int8)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(0x3001, bool)
    out[[ord(c) for c in chars]] = True
    return out


_IS_END, _IS_CLOSER, _IS_BREAK, _IS_APOSTROPHE = map(_table, (_ENDS, _CLOSERS, _BREAKS, _APOSTROPHES))
_IS_SPACE = np.array([chr(c).isspace() for c in range(0x3001)])


def hash_word(word: str) -> np.uint64:
    code = np.frombuffer(word.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return ws.windows(code, np.zeros(1, np.int64), np.array([len(code)]))[0]


class Lexicon:
    """The common words of each language by hash, each with one number over all languages' words."""

    def __init__(self, common: dict[str, list[str]]):
        self.languages = sorted(common)
        every = sorted({w for words in common.values() for w in words})
        hashes = np.array([hash_word(w) for w in every], np.uint64)
        order = np.argsort(hashes)
        self.hashes, number = hashes[order], {w: k for k, w in enumerate(every)}
        self.number = order
        self.member = np.zeros((len(every), len(self.languages)), bool)
        for k, lang in enumerate(self.languages):
            self.member[[number[w] for w in common[lang]], k] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for words that aren't common."""
        if not len(self.hashes) or not len(hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.number[at], -1)


@dataclass
class Read:
    """What a batch of texts holds: per text its statistics, per unit its text, language, class counts, and pairs of neighbours (splits, values)."""

    stats: dict[str, np.ndarray]
    text: np.ndarray
    language: np.ndarray
    counts: np.ndarray
    pair_splits: np.ndarray
    pairs: np.ndarray


def _runs(mask: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of a mask; a run ends where ``fresh`` begins something new."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty(len(mask), bool), np.empty(len(mask), bool)
    before[0], before[1:] = False, mask[:-1] & ~fresh[1:]
    after[-1], after[:-1] = False, mask[1:] & ~fresh[1:]
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def _sum_by(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, n).astype(np.int64)


def read(texts: list, lexicon: Lexicon) -> Read:
    """Whole texts, null as empty. Words are runs of letters and digits, for the basic counts those of a-z and 0-9."""
    low = [(t or "").lower() for t in texts]
    low = [_TAG.sub(" ", t) if "<" in t or "&" in t else t for t in low]
    n = len(low)
    sizes = np.array([len(t) for t in low], np.int64)
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(code, 0x3000)
    kind = np.where(code < 0x3001, _KINDS[small], 7)
    first = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(n), sizes)
    fresh = np.zeros(len(code) + 1, bool)
    fresh[first] = True
    fresh = fresh[:-1]
    languages = max(1, len(lexicon.languages))

    # lines, then units: long lines are cut behind sentence ends, and all after UNIT_WORDS words
    breaks = _IS_BREAK[small] & (code < 0x3000)
    line = np.cumsum(fresh | np.concatenate([[False], breaks[:-1]])) - 1 if len(code) else np.zeros(0, np.int64)
    n_lines = int(line[-1]) + 1 if len(code) else 0
    width = np.bincount(line, minlength=n_lines)
    ended = _IS_END[small] & (code < 0x3000)
    behind = np.concatenate([[False], ended[:-1]]) & (kind == 4) & (width[line] > LONG_LINE) if len(code) else np.zeros(0, bool)
    cut = fresh | np.concatenate([[False], breaks[:-1]]) | behind if len(code) else np.zeros(0, bool)
    word_char = (kind >= 1) & (kind <= 3) | ((kind == 7) & (code >= 0x3000))
    starts, ends = _runs(word_char, cut)
    begun = np.zeros(len(code), np.int64)
    begun[starts] = 1
    begun = np.cumsum(begun)
    unit_at = np.flatnonzero(cut)
    unit = np.cumsum(cut) - 1 if len(code) else np.zeros(0, np.int64)
    within = begun - (begun[unit_at] - np.isin(unit_at, starts))[unit] if len(code) else np.zeros(0, np.int64)
    piece = np.maximum(within - 1, 0) // UNIT_WORDS
    more = np.concatenate([[False], (piece[1:] != piece[:-1]) & ~cut[1:]]) if len(code) else np.zeros(0, bool)
    unit = np.cumsum(cut | more) - 1 if len(code) else unit
    n_units = int(unit[-1]) + 1 if len(code) else 0
    unit_text = owner[np.flatnonzero(cut | more)]

    # words, their languages, and letters in function words
    hashes = ws.windows(code.astype(np.uint64), starts, ends)
    found, of = lexicon.find(hashes), unit[starts]
    known = np.flatnonzero(found >= 0)
    votes = np.zeros((n_units, languages), np.int64)
    if len(known):
        for k in range(languages):
            votes[:, k] = _sum_by(of[known], n_units, lexicon.member[found[known], k])
    language = votes.argmax(1)
    common = np.zeros(len(found), bool)
    common[known] = lexicon.member[found[known], language[of[known]]] if len(known) else False
    size = ends - starts
    # an article or pronoun elided before another word counts as one
    next_char = np.minimum(ends, len(code) - 1)
    elided = (size <= 2) & (ends < len(code) - 1) & _IS_APOSTROPHE[small[next_char]] & (kind[np.minimum(ends + 1, len(code) - 1)] <= 2) if len(code) else np.zeros(0, bool)
    function = _sum_by(of, n_units, size * (common | elided))
    by = np.bincount(unit * 8 + kind, minlength=n_units * 8).reshape(-1, 8).astype(np.int64)
    accented = _sum_by(of, n_units, (common | elided) * _between(kind == 2, starts, ends))
    counts = by.copy()
    counts[:, 0] = function
    counts[:, 1] -= function - accented
    counts[:, 2] -= accented
    counts[:, 1] = np.maximum(counts[:, 1], 0)

    # neighbouring function words within a unit, the earlier one's number first
    both = np.flatnonzero(common[:-1] & common[1:] & (of[:-1] == of[1:])) if len(found) > 1 else np.zeros(0, np.int64)
    pairs = found[both] * len(lexicon.hashes) + found[both + 1]
    pair_splits = np.searchsorted(of[both], np.arange(n_units + 1))

    # statistics of texts
    text_of = owner[starts] if len(starts) else np.zeros(0, np.int64)
    plain = ((code >= 97) & (code <= 122)) | ((code >= 48) & (code <= 57))
    p0, p1 = _runs(plain, fresh)
    plain_of = owner[p0] if len(p0) else np.zeros(0, np.int64)
    seen = kind != 4
    line_text = owner[np.flatnonzero(fresh | np.concatenate([[False], breaks[:-1]]))] if len(code) else np.zeros(0, np.int64)
    at = np.flatnonzero(seen)
    last = np.full(n_lines, -1, np.int64)
    last[line[at]] = at
    filled = last >= 0
    closed = np.zeros(n_lines, bool)
    closed[filled] = (_IS_CLOSER[small] & (code < 0x3000))[last[filled]]
    all_votes = np.zeros((n, languages), np.int64)
    if len(known):
        for k in range(languages):
            all_votes[:, k] = _sum_by(text_of[known], n, lexicon.member[found[known], k])
    words = _sum_by(text_of, n)
    stats = {
        "words": _sum_by(plain_of, n),
        "letters": _sum_by(plain_of, n, p1 - p0),
        "visible": _sum_by(owner, n, seen),
        "symbols": _sum_by(owner, n, (kind >= 5) & ~word_char),
        "size": sizes,
        "lines": _sum_by(line_text, n, filled),
        "ended": _sum_by(line_text, n, closed),
        "all_words": words,
        "common": all_votes.max(1),
        "language": all_votes.argmax(1),
        "repeated": _repeated(hashes, text_of, words),
    }
    return Read(stats, unit_text, language, counts, pair_splits, pairs)


def _between(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[ends] - total[starts]


def _repeated(hashes: np.ndarray, owner: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per text the share of its windows of REPEAT words that came before at the one distance at which most do.

    One sentence over and over repeats at its own length throughout; texts in
    which sentences return now and then repeat at many distances.
    """
    n = len(words)
    first = np.concatenate([[0], np.cumsum(words)])
    have = np.maximum(words - REPEAT + 1, 0)
    text = np.repeat(np.arange(n), have)
    if not len(text):
        return np.zeros(n)
    at = np.arange(len(text)) - np.repeat(np.cumsum(have) - have, have) + first[text]
    h = ws.windows(hashes, at, at + REPEAT)
    order = np.lexsort((at, h, text))
    t, h, at = text[order], h[order], at[order]
    again = np.flatnonzero((t[1:] == t[:-1]) & (h[1:] == h[:-1])) + 1
    if not len(again):
        return np.zeros(n)
    gap, of = at[again] - at[again - 1], t[again]
    code = np.sort(of * np.int64(1 << 32) + gap)
    begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, code[begin] >> 32, np.diff(np.append(begin, len(code))))
    return most / np.maximum(have, 1)
