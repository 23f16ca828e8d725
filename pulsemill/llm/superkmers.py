"""Repeated windows of symbols, found by super-k-mer partitioning.

A document is a row of symbols: words, or bytes. Its windows are all runs of `window` consecutive symbols. Each
window is named by a minimiser, the least order value of the grams inside it; equal windows have equal
minimisers. Consecutive windows that share one form a super-k-mer, which travels to the minimiser's bucket as one
packed string. A first pass without texts drops the minimisers that cannot hold a repeat, and settles the super-k-mers
that are the same string: of each string one goes on, and only where its bucket holds other strings too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, discard, materialize, same_doc
from .hashing import ODD, sliding_min, window_hash

#: Windows of one document that are looked at together; longer documents go in pieces.
SEGMENT = 1 << 19
#: Symbols gathered before the arrays of a batch are worked on.
FLAT = 1 << 18
#: A minimiser whose distinct strings hold more symbols than this goes window by window, by hash, not to one bucket task.
HOT = 1 << 21
#: Low bits of an order value that give way to the gram's place in the flat array.
PLACE = 20
#: Bytes of rows that a task of the last step works on together; with the arrays of their order a worker holds some hundred times that.
SLICE = 1_000_000
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Symbols:
    """window: symbols of a window. codes(text): an array with a uint64 for each symbol. order(codes): for each gram
    its order value, and gram: the symbols of one. cut(text): a function (s, e) -> the packed string of symbols s..e.
    width: the type that holds a code. other_doc: whether a repeat counts only from a smaller doc_id.
    repeats(strings, rank): symbols of each packed string, and for each symbol of all of them whether a repeated window
    begins there; rank orders the strings' documents, and strings of equal windows come in that order."""

    window: int
    gram: int
    codes: Callable[[bytes], np.ndarray]
    order: Callable[[np.ndarray], np.ndarray]
    cut: Callable[[bytes], Callable[[int, int], bytes]]
    width: type
    other_doc: bool
    repeats: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]


def _pieces(codes: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(codes) - window + 1, SEGMENT):
        yield at, codes[at : at + SEGMENT + window - 1]


def _runs(flat: np.ndarray, sizes: list[int], kind: Symbols) -> tuple[np.ndarray, ...]:
    """h, d, piece, first window, end of windows, again, for each run of windows of one piece that share a minimiser.

    d is a hash of the run's symbols. again: the minimiser's first place differs between the first and last window. Without that no window of the run
    equals another one of it, as equal windows hold the minimiser at the same offset.
    """
    value = kind.order(flat) >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(len(flat) - kind.gram + 1, dtype=np.uint64)
    placed = sliding_min(value, kind.window - kind.gram + 1)
    least = placed >> np.uint64(PLACE)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    inside = np.ones(len(least), bool)
    for e in ends[:-1]:
        inside[e - kind.window + 1 : e] = False
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    piece = np.searchsorted(starts, first, "right") - 1
    end = np.minimum(np.append(first[1:], len(flat)), ends[piece] - kind.window + 1)
    dense = memoryview(flat.astype(kind.width).tobytes())
    size, more, digest = np.dtype(kind.width).itemsize, kind.window - 1, xxhash.xxh3_64_intdigest
    d = np.fromiter((digest(dense[a * size : (b + more) * size]) for a, b in zip(first.tolist(), end.tolist())), np.uint64, len(first))
    return least[first].view(np.int64), d.view(np.int64), piece, first - starts[piece], end - starts[piece], placed[first] != placed[end - 1]


RUN = "h long, d long, doc_id long, th long, s long, e long, again boolean"


def _find(kind: Symbols):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column("doc_id"), batch.column("th")
            parts: list[np.ndarray] = []
            owner: list[tuple[int, int]] = []
            size = 0

            def done() -> pa.RecordBatch:
                h, d, piece, s, e, again = _runs(np.concatenate(parts), [len(p) for p in parts], kind)
                row, base = np.array(owner).T
                at = pa.array(row[piece])
                return pa.RecordBatch.from_arrays([pa.array(h), pa.array(d), ids.take(at), ths.take(at), pa.array(s + base[piece]), pa.array(e + base[piece]), pa.array(again)], ["h", "d", "doc_id", "th", "s", "e", "again"])

            for i, text in enumerate(binary(batch.column("text"))):
                for base, piece in _pieces(kind.codes(text), kind.window):
                    parts.append(piece)
                    owner.append((i, base))
                    size += len(piece)
                    if size >= FLAT:
                        yield done()
                        parts, owner, size = [], [], 0
            if parts:
                yield done()

    return run


def _pack(kind: Symbols):
    """From documents with their suspect runs: packed strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int | None, int]] = set()  # rows that repeat a document go once
        for batch in batches:
            ids, ths, spans = batch.column("doc_id"), batch.column("th"), batch.column("runs")
            names = list(zip(ids.to_pylist(), ths.to_pylist()))
            offsets = spans.offsets.to_numpy()
            h, s, e = (spans.values.field(c).to_numpy() for c in ("h", "s", "e"))
            row, own, strings = [], [], []
            for i, text in enumerate(binary(batch.column("text"))):
                if names[i] in seen:
                    continue
                seen.add(names[i])
                cut = kind.cut(text)
                for j in range(offsets[i], offsets[i + 1]):
                    row.append(i)
                    own.append(j)
                    strings.append(cut(s[j], e[j] + kind.window - 1))
            at, own = pa.array(row, pa.int64()), np.array(own, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[own]), ids.take(at), ths.take(at), pa.array(s[own]), pa.array(strings, pa.binary())], ["h", "doc_id", "th", "s", "packed"])

    return run


def _spread(kind: Symbols):
    """As _pack, but one row for each window. In one function with it: two in a row take two Python workers for each task."""
    pack = _pack(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pack(batches):
            ids, ths, begin = batch.column("doc_id"), batch.column("th"), batch.column("s").to_numpy()
            for i, packed in enumerate(binary(batch.column("packed"))):
                codes = kind.codes(packed)
                w1, w2 = (window_hash(codes, kind.window, b).view(np.int64) for b in ODD)
                at = pa.array(np.full(len(w1), i))
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), ids.take(at), ths.take(at), pa.array(begin[i] + np.arange(len(w1)))], ["w1", "w2", "doc_id", "th", "s"])

    return run


SPAN = "doc_id long, th long, s long, e long"


def _count(kind: Symbols):
    """Over rows sorted by bucket and doc_id: the spans of symbols that repeated windows cover."""

    def solve(ids: np.ndarray, empty: np.ndarray, ths: np.ndarray, begin: np.ndarray, packed: list[bytes]) -> pa.RecordBatch:
        sizes, marked = kind.repeats(packed, np.where(empty, NO_ID, ids))
        ends = np.cumsum(sizes)
        # spans: runs of marked windows of a row, widened to the symbols that they cover
        edge = np.diff(np.concatenate([[0], marked.view(np.int8), [0]]))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        r = np.searchsorted(ends, s, "right")
        base = (ends - sizes)[r]
        rows, s, e = r, s - base, e - base + kind.window - 1
        return pa.RecordBatch.from_arrays([pa.array(ids[rows], mask=empty[rows]), pa.array(ths[rows]), pa.array(begin[rows] + s), pa.array(begin[rows] + e)], ["doc_id", "th", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            t = pa.Table.from_batches(held).combine_chunks()
            bucket = t.column("h").to_numpy()
            cut = len(bucket) if last else int(np.searchsorted(-(bucket != bucket[-1]).astype(np.int8), 0))
            if cut:
                p = t.slice(0, cut)
                yield solve(p.column("doc_id").fill_null(0).to_numpy(), p.column("doc_id").is_null().to_numpy(), p.column("th").to_numpy(), p.column("s").to_numpy(), p.column("packed").to_pylist())
            # one copy: a slice would keep all of its table alive
            held = t.slice(cut).take(pa.array(range(len(bucket) - cut))).to_batches() if cut < len(bucket) else []
            size = sum(b.nbytes for b in held)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size >= SLICE:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


def repeated_spans(docs: DataFrame, kind: Symbols, label: str) -> DataFrame:
    """doc_id, th, s, e: spans of symbols that repeated windows cover, for the rows of keyed(docs)."""
    found = materialize(docs.mapInArrow(_find(kind), RUN), label)
    rank = F.coalesce("doc_id", F.lit(NO_ID))
    by = found.groupBy("h").agg(F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.count("*").alias("runs"), F.max("again").alias("again"))
    # what is joined is written first: an aggregate right above a join's exchange would keep Spark from splitting hot keys
    by = materialize(by.where("lo < hi" if kind.other_doc else "runs > 1 or again").select("h"), label)
    suspect = materialize(found.join(by, "h"), label)
    discard(found)
    discard(by)

    # by string: its least document, how often it is there, and the one that stands for it
    own = F.xxhash64("doc_id", "th", "s")
    size = F.col("e") - F.col("s") + kind.window - 1
    strings = suspect.groupBy("h", "d").agg(F.min(rank).alias("lo"), F.count("*").alias("n"), F.min(own).alias("first"), F.max(size).alias("size"), F.max("again").alias("again"))
    strings = materialize(strings, label)
    buckets = strings.groupBy("h").agg(F.count("*").alias("strings"), F.sum("size").alias("symbols"), F.max("again").alias("again"))
    buckets = materialize(buckets, label)
    more = (F.col("strings") > 1) if kind.other_doc else (F.col("strings") > 1) | F.col("b.again")
    marks = strings.alias("a").join(buckets.alias("b"), "h").select("h", "d", "lo", "n", "first", more.alias("more"), (F.col("symbols") > HOT).alias("hot"))
    whole = rank > F.col("lo") if kind.other_doc else F.col("n") > 1
    goes = F.col("more") & (rank == F.col("lo") if kind.other_doc else own == F.col("first"))
    tagged = suspect.join(marks, ["h", "d"]).select("h", "doc_id", "th", "s", "e", "hot", whole.alias("whole"), goes.alias("goes"))
    tagged = materialize(tagged.where("whole or goes"), label)
    for done in (suspect, strings, buckets):
        discard(done)

    spans = tagged.where("whole").select("doc_id", "th", "s", (F.col("e") + kind.window - 1).alias("e"))
    packed = _with_runs(docs, tagged.where("goes and not hot")).mapInArrow(_pack(kind), "h long, doc_id long, th long, s long, packed binary")
    spans = spans.union(packed.repartition("h").sortWithinPartitions("h", F.coalesce("doc_id", F.lit(NO_ID))).mapInArrow(_count(kind), SPAN))
    hot = tagged.where("goes and hot")
    if not hot.isEmpty():
        # not written first: in one plan with the rest the texts are shuffled once
        wide = _with_runs(docs, hot).mapInArrow(_spread(kind), "w1 long, w2 long, doc_id long, th long, s long")
        first = wide.groupBy("w1", "w2").agg(F.min(rank).alias("lo"), F.count("*").alias("n")).where("n > 1")
        met = wide.join(first, ["w1", "w2"]).where(rank > F.col("lo") if kind.other_doc else F.lit(True))
        spans = spans.union(met.select("doc_id", "th", "s", (F.col("s") + kind.window).alias("e")))
    return spans


def _with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents with the runs whose strings go on. Rows that repeat a document also repeat its runs, hence the set."""
    runs = runs.groupBy("doc_id", "th").agg(F.collect_set(F.struct("h", "s", "e")).alias("runs"))
    return docs.join(runs, same_doc(docs, runs)).select(docs["doc_id"], docs["th"], docs["text"], "runs")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text, spans for every row of keyed(docs). Rows that repeat a document found the same spans, hence the set."""
    got = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return docs.join(got, same_doc(docs, got), "left").select(docs["doc_id"], docs["text"], "spans")


def masks(batch: pa.RecordBatch, sizes: list[int]) -> Iterator[np.ndarray]:
    """For each row a mask of the symbols inside its spans."""
    spans = batch.column("spans")
    offsets, none = spans.offsets.to_numpy(), spans.is_null().to_numpy(zero_copy_only=False)
    s, e = spans.values.field("s").to_numpy(), spans.values.field("e").to_numpy()
    for i, n in enumerate(sizes):
        step = np.zeros(n + 1, np.int32)
        if not none[i]:
            own = slice(offsets[i], offsets[i + 1])
            np.add.at(step, s[own], 1)
            np.add.at(step, e[own], -1)
        yield np.cumsum(step[:-1]) > 0
