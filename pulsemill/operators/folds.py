"""Folds along recordings that keep or drop a row by what was kept before it, with a state of a few numbers.

Rows are dealt by recording and sorted within partitions; a task streams through them, batch by batch, and carries only the
fold's state, whatever a recording's length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Given the next values of a recording, which to keep; holds the fold's state.
Decide = Callable[[list], list[bool]]


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before; of the first row, not."""
    out = np.zeros(batch.num_rows, bool)
    for c in keys:
        x = batch.column(c)
        same = pc.fill_null(pc.equal(x[1:], x[:-1]), False)
        both = pc.and_(pc.is_null(x[1:]), pc.is_null(x[:-1]))
        out[1:] |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
    return out


def fold(rows: DataFrame, keys: list[str], order: list[str], value: str, start: Callable[[], Decide]) -> DataFrame:
    """The rows that a fold over `value`, in the order of the columns `order`, keeps of those with equal keys (nulls are equal);
    start() begins a fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, decide = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = [0, *np.flatnonzero(_changes(batch, keys)).tolist(), batch.num_rows]
            values, kept = batch.column(value).to_pylist(), []
            for a, b in zip(cuts, cuts[1:]):
                own = tuple(batch.column(c)[a].as_py() for c in keys)
                if decide is None or a or own != now:
                    now, decide = own, start()
                kept += decide(values[a:b])
            yield batch.filter(pa.array(kept, pa.bool_()))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, rows.schema)


def apart(gap: float) -> Callable[[], Decide]:
    """Keeps a value more than `gap` after the last one kept."""

    def start() -> Decide:
        last = None

        def decide(values: list) -> list[bool]:
            nonlocal last
            out = []
            for x in values:
                out.append(last is None or x - last > gap)
                if out[-1]:
                    last = x
            return out

        return decide

    return start


def steady(keep: int = 10, least: int = 3, most: float = 20.0) -> Callable[[], Decide]:
    """Once `least` are kept, keeps a value at most `most` from the mean of the last `keep` ones kept."""

    def start() -> Decide:
        recent: deque[float] = deque(maxlen=keep)

        def decide(values: list) -> list[bool]:
            out = []
            for x in values:
                ok = len(recent) < least or abs(x - sum(recent) / len(recent)) <= most
                if ok:
                    recent.append(x)
                out.append(ok)
            return out

        return decide

    return start
