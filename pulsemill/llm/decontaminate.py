"""Benchmark decontamination by pigeonhole edit matching.

An item of n words with a budget of k edits is cut into k + 1 pieces: a passage within k edits of it holds one piece
unchanged. Exact piece hits are found through the longest word of each piece and verified with Myers' bit-parallel
edit distance over words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed for each word of an item.
BUDGET = 0.15
#: Items, and characters of them, that travel to the tasks at once; a larger benchmark goes block by block. An item of more
#: characters is a block of its own.
ITEMS, CHARS = 20_000, 1 << 24
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Runs of letters, digits and underscores, in lower case: case, punctuation and spacing don't count."""
    return WORD.findall(text.lower())


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """k + 1 ranges that cover n words, as even as can be."""
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    return [(s, e) for s, e in zip(cuts, cuts[1:]) if s < e]


def best_match(pattern: list[str], text: list[str], most: int) -> tuple[int, int] | None:
    """Least edits between the pattern and a run of the text's words, and the end of the first such run, if at most `most`.

    Myers' bit vectors, one bit for each word of the pattern, in Python's unbounded integers.
    """
    n = len(pattern)
    at: dict[str, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    up, down, score, best = full, 0, n, None
    for j, w in enumerate(text):
        eq = at.get(w, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        more, less = down | (full & ~(diag | up)), up & diag
        score += 1 if more & top else -1 if less & top else 0
        more, less = more << 1 & full, less << 1 & full
        up, down = less | (full & ~(diag | more)), more & diag
        if score <= most and (best is None or score < best[0]):
            best = score, j + 1
    return best


class Matcher:
    """Finds items in texts."""

    def __init__(self, items: list[tuple[int, str]], budget: float):
        self.items: list[tuple[int, list[str], int]] = []
        self.anchors: dict[str, list[tuple[int, int, list[str], int]]] = {}
        for item_id, text in items:
            own = words(text)
            k = int(len(own) * budget)
            number = len(self.items)
            self.items.append((item_id, own, k))
            for s, e in pieces(len(own), k):
                rarest = max(range(s, e), key=lambda i: len(own[i]))
                self.anchors.setdefault(own[rarest], []).append((number, s, own[s:e], rarest - s))

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """item_id, edits, first and last word + 1 (words as in words()) of the best passage of each item."""
        own, anchors = words(text), self.anchors
        found: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for i in [i for i, w in enumerate(own) if w in anchors]:
            for number, s, piece, offset in anchors[own[i]]:
                at = i - offset
                if at < 0 or own[at : at + len(piece)] != piece or (number, at - s) in tried:
                    continue
                tried.add((number, at - s))
                item_id, pattern, k = self.items[number]
                lo = max(0, at - s - k)
                near = own[lo : at - s + len(pattern) + k]
                if best := best_match(pattern, near, k):
                    edits, end = best
                    back = best_match(pattern[::-1], near[:end][::-1], edits)
                    row = edits, lo + end - back[1], lo + end
                    found[item_id] = min(found.get(item_id, row), row)
        return [(item_id, *row) for item_id, row in sorted(found.items())]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct()
    items, chars = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    n = max(1, ceil(items / ITEMS), ceil((chars or 0) / CHARS))
    for block in range(n):
        mine = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block) if n > 1 else rows
        yield [(r.item_id, r.text) for r in mine.collect()]


def _search(docs: DataFrame, benchmark: DataFrame, budget: float):
    """For each block of the benchmark a function that gives a task its matcher."""
    for items in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Matcher(items, budget).__dict__)

        def matcher(shared=shared) -> Matcher:
            own = Matcher([], budget)
            own.__dict__.update(shared.value)
            return own

        yield matcher


def clean(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item of the benchmark as contaminated() finds them."""
    at = docs.columns.index("text")
    for matcher in _search(docs, benchmark, budget):

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            own = matcher()
            for batch in batches:
                yield batch.filter(pa.array([not (t and own.find(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """doc_id, item_id, edits, first_word, end_word: the closest passage of every item that a row of docs(doc_id, text)
    holds within int(budget * words) edits; benchmark has (item_id, text).

    Items and documents that are null or without words match nothing. Items of any length are matched whole. Rows that
    repeat a document repeat its matches; empty tables give an empty one; other columns are not read. Only a block of about ITEMS
    items and CHARS characters is at the driver and in tasks at once.
    """
    rows, out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), None
    for matcher in _search(docs, benchmark, budget):

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            own = matcher()
            for batch in batches:
                found = [(i, *m) for i, t in enumerate(batch.column("text").to_pylist()) if t for m in own.find(t)]
                row, item, edits, first, end = zip(*found) if found else ((),) * 5
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (item, edits, first, end))], ["doc_id", "item_id", "edits", "first_word", "end_word"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, edits long, first_word long, end_word long")
        out = part if out is None else out.union(part)
    return out
