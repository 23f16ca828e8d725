"""Words of UTF-8 buffers: a table of 256 entries finds their bounds, hashes group equal slices, bytes settle the groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash

#: Bytes whose arrays are worked on at once.
CHUNK = 1 << 20
#: Bytes that are compared at once.
COMPARED = 1 << 21


def lowered() -> np.ndarray:
    """A table that lower-cases A-Z and keeps every other byte."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def bounds(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of true values start and end."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def grouped(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """ids: for each slice of buf the number of its string; first: for each number the place of a slice that has it.

    Slices are grouped by their hash, and every slice is compared with its group's first one, byte by byte. Those that differ in
    spite of equal hashes get numbers of their own.
    """
    raw = buf.tobytes()
    hashes = np.fromiter((digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    ids = ids.ravel()
    size = ends - starts
    same = size == size[first[ids]]
    order = np.argsort(size, kind="stable")
    order = order[same[order]]
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        n = int(size[at[0]])
        rows = np.lib.stride_tricks.sliding_window_view(buf, n)
        for lo in range(0, len(at), COMPARED // n + 1):
            part = at[lo : lo + COMPARED // n + 1]
            same[part] = (rows[starts[part]] == rows[starts[first[ids[part]]]]).all(axis=1)
    if not same.all():
        more: dict[bytes, int] = {}
        extra = []
        for i in np.flatnonzero(~same).tolist():
            word = raw[starts[i] : ends[i]]
            if word not in more:
                more[word] = len(first) + len(extra)
                extra.append(i)
            ids[i] = more[word]
        first = np.concatenate([first, extra])
    return ids, first


def packed(texts: list[bytes], most: int = CHUNK) -> Iterator[list[int]]:
    """Numbers of consecutive texts that hold about `most` bytes together; a longer text comes alone."""
    now: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if now and size + len(text) > most:
            yield now
            now, size = [], 0
        now.append(i)
        size += len(text) + 1
    if now:
        yield now


def cut(text: bytes, stops: bytes, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive parts of a text of about `most` bytes; each but the last ends behind one of the bytes `stops`, however far
    off that is."""
    table = np.zeros(256, bool)
    table[list(stops)] = True
    at, step = 0, 1 << 12
    while len(text) - at > most:
        end = len(text)
        for lo in range(at + most - 1, len(text), step):
            found = np.flatnonzero(table[np.frombuffer(text[lo : lo + step], np.uint8)])
            if len(found):
                end = lo + int(found[0]) + 1
                break
        yield at, end
        at = end
    if at < len(text) or not text:
        yield at, len(text)
