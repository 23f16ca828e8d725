"""Suffix order of byte strings by prefix-free parsing.

A rolling hash over GRAM bytes marks triggers, by the gram's own bytes alone. Triggers cut every string into phrases, each of
which runs from a trigger to the end of the next one, so that neighbours overlap by a gram. The dictionary holds each distinct
phrase once; the parse writes every string as the ranks of its phrases. No suffix of a phrase, longer than a gram, begins
another one without being equal to it. A place in the text is therefore ordered by the suffix of its phrase, looked up in the
dictionary's suffix array, and among equal ones by where the parse goes on, looked up in the parse's suffix array.
"""

from __future__ import annotations

import numpy as np

from .hashing import ODD, mix, window_hash

GRAM = 16
#: One gram in TRIGGER is a trigger.
TRIGGER = 32
#: Bytes in the first key of a dictionary suffix, of 9 bits each, as the end of a phrase is a symbol too.
PACKED = 7

Levels = list[tuple[int, np.ndarray]]


def suffix_ranks(key: np.ndarray, left: np.ndarray, span: int, most: int) -> Levels:
    """Ranks (1 up) of all suffixes by their first `span` symbols, by twice as many, and so on until `most` or until all
    differ. key orders suffixes by their first span symbols; left: symbols up to the end of a suffix's own unit."""
    order = np.argsort(key, kind="stable")
    now = key[order]
    place = np.arange(len(key))
    fresh = np.concatenate([[True], now[1:] != now[:-1]])
    rank = np.empty(len(key), np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, place, 0)) + 1
    levels = [(span, rank)]
    tied = np.concatenate([~(fresh[1:] & fresh[:-1]), [not fresh[-1]]]) if len(key) else fresh
    rest = order[tied]
    while span < most and len(rest := rest[left[rest] >= span]):  # shorter ones are ranked to their end
        after = np.where(left[rest] > span, rank[np.minimum(rest + span, len(rank) - 1)], 0).astype(np.int64)
        both = rank[rest].astype(np.int64) << 32 | after
        by = np.argsort(both, kind="stable")
        rest, both = rest[by], both[by]
        group = both >> 32
        place = np.arange(len(rest))
        fresh = np.concatenate([[True], both[1:] != both[:-1]])
        first = np.concatenate([[True], group[1:] != group[:-1]])
        shift = np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        rank = rank.copy()
        rank[rest] = group + shift
        span *= 2
        levels.append((span, rank))
        rest = rest[np.concatenate([~(fresh[1:] & fresh[:-1]), [not fresh[-1]]])]
    return levels


def shared(levels: Levels, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols, in whole keys of the first level, that suffixes a and b begin with alike; at most up to the end of one."""
    n = np.zeros(len(a), np.int64)
    most = np.minimum(left[a], left[b])
    for span, rank in reversed(levels):
        open_ = np.flatnonzero(n < most)
        x, y = a[open_] + n[open_], b[open_] + n[open_]
        n[open_[rank[x] == rank[y]]] += span
    return np.minimum(n, most)


class Dictionary:
    """Distinct phrases, their bytes one after another, and the ranks of all their suffixes."""

    def __init__(self, phrases: list[bytes], most: int):
        size = np.fromiter(map(len, phrases), np.int64, len(phrases))
        self.starts = np.cumsum(size) - size
        self.codes = np.frombuffer(b"".join(phrases), np.uint8).astype(np.int64) + 1
        self.left = np.repeat(self.starts + size, size) - np.arange(len(self.codes))
        key = np.zeros(len(self.codes), np.int64)
        for j in range(PACKED):
            ahead = np.append(self.codes[j:], np.zeros(min(j, len(self.codes)), np.int64))
            key = key << 9 | np.where(self.left > j, ahead, 0)
        self.levels = suffix_ranks(key, self.left, PACKED, most)
        self.rank = self.levels[-1][1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that suffixes a and b begin with alike."""
        n = shared(self.levels, self.left, a, b)
        most = np.minimum(self.left[a], self.left[b])
        for _ in range(PACKED - 1):
            open_ = np.flatnonzero(n < most)
            same = self.codes[a[open_] + n[open_]] == self.codes[b[open_] + n[open_]]
            n[open_[same]] += 1
            most[open_[~same]] = 0
        return n


def cut(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the phrases of all strings begin and end, and whether each is its string's last."""
    begin = np.zeros(len(flat) + 1, bool)
    if len(flat) >= GRAM:
        begin[: len(flat) - GRAM + 1] = mix(window_hash(flat.astype(np.uint64), GRAM, ODD[0])) & np.uint64(TRIGGER - 1) == 0
    for e in ends:
        begin[max(0, e - GRAM + 1) : e] = False
    begin[np.concatenate([[0], ends[:-1]]).astype(np.int64)] = True
    starts = np.flatnonzero(begin[:-1])
    string = np.searchsorted(ends, starts, "right")
    last = np.concatenate([string[1:] != string[:-1], [True]])
    stops = np.where(last, ends[string], np.concatenate([starts[1:], [0]]) + GRAM)
    return starts, stops, last


def _range_least(values: np.ndarray):
    """A function (i, j) -> least of values[i + 1 .. j], i < j, by a sparse table."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half, now = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(now[:-half], now[half:]))

    def least(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        level = np.frexp(j - i)[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(table[k][i[at] + 1], table[k][j[at] - (1 << k) + 1])
        return out

    return least


def repeated(strings: list[bytes], window: int) -> np.ndarray:
    """For each byte of the strings, one after another: whether a window begins there that begins elsewhere in them too.

    The windows' suffixes are put in corpus order and those whose common prefix with a neighbour spans the window are marked.
    Strings are not empty, and windows stay within their string.
    """
    text = b"".join(strings)
    flat = np.frombuffer(text, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))
    starts, stops, last = cut(flat, ends)
    number: dict[bytes, int] = {}
    parse = np.fromiter((number.setdefault(text[s:e], len(number)) for s, e in zip(starts.tolist(), stops.tolist())), np.int64, len(starts))
    words = Dictionary(list(number), window)

    # the parse: its symbols in the order of the dictionary, its suffix array, and the bytes that neighbours share
    order = np.lexsort((np.arange(len(number)), words.rank[words.starts]))
    rank = np.empty(len(number), np.int64)
    rank[order] = np.arange(len(number))
    final = np.flatnonzero(last)
    owner = np.searchsorted(final, np.arange(len(parse)))
    left = final[owner] + 1 - np.arange(len(parse))
    levels = suffix_ranks(rank[parse], left, 1, window)
    array = np.argsort(levels[-1][1], kind="stable")
    place = np.empty(len(array), np.int64)
    place[array] = np.arange(len(array))
    a, b = array[:-1], array[1:]
    n = shared(levels, left, a, b)
    ended = (n >= left[a]) | (n >= left[b])
    x, y = np.where(ended, a, a + n), np.where(ended, b, b + n)
    bytes_ = np.where(ended, np.minimum(ends[owner[a]] - starts[a], ends[owner[b]] - starts[b]), starts[x] - starts[a])
    bytes_[~ended] += words.common(words.starts[parse[x[~ended]]], words.starts[parse[y[~ended]]])
    least = _range_least(np.concatenate([[0], bytes_]))

    # places where a window begins, in corpus order
    inside = np.ones(len(flat), bool)
    for e in ends:
        inside[max(0, e - window + 1) : e] = False
    at = np.flatnonzero(inside & (np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(flat)) >= window))
    if not len(at):
        return np.zeros(len(flat), bool)
    phrase = np.searchsorted(starts, at, "right") - 1
    suffix = words.starts[parse[phrase]] + at - starts[phrase]
    cls = words.rank[suffix].astype(np.int64)
    goes_on = np.where(last[phrase], 0, place[np.minimum(phrase + 1, len(parse) - 1)])
    by = np.argsort(cls << 32 | goes_on, kind="stable")
    p, q = by[:-1], by[1:]
    alike = np.zeros(len(p), bool)
    same = cls[p] == cls[q]
    length = words.left[suffix]
    whole = same & ((length[p] >= window) & (length[q] >= window))
    alike[whole] = True
    ask = np.flatnonzero(same & ~whole & ~last[phrase[p]])  # a last phrase shorter than the window holds none
    i, j = goes_on[p[ask]], goes_on[q[ask]]
    alike[ask] = length[p[ask]] - GRAM + least(i, j) >= window
    ask = np.flatnonzero(~same & (length[p] >= window) & (length[q] >= window))
    alike[ask] = words.common(suffix[p[ask]], suffix[q[ask]]) >= window
    marked = np.zeros(len(flat), bool)
    marked[at[p[alike]]] = True
    marked[at[q[alike]]] = True
    return marked
