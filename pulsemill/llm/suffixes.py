"""Suffix-array dedup by prefix-free parsing: bytes that repeated strings of 400 bytes cover go.

Spark deals the corpus out by rolling-hash triggers: the least trigger of each window of bytes cuts texts into strings that
overlap by a window less a byte, and equal windows meet under one trigger (see superkmers.py). Strings that occur twice are
settled by a dictionary of their counts. The rest of each partition is parsed into phrases; the suffix arrays of its dictionary
and its parse give the order of its windows, and windows that a neighbour shares whole are repeated (see phrases.py). Windows
of one trigger are all in one partition, so that the order of the whole corpus would show no other repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import binary, keyed
from .hashing import ODD, mix, window_hash
from .phrases import repeated
from .superkmers import Symbols, masks, repeated_spans, with_spans

WINDOW = 400
#: Long enough that unrelated texts of one language hardly ever share a gram.
GRAM = 40
#: One gram in TRIGGER comes before all others.
TRIGGER = 32


def _codes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8).astype(np.uint64)


def _order(codes: np.ndarray) -> np.ndarray:
    """Order values by which triggers come before all other grams."""
    x = mix(window_hash(codes, GRAM, ODD[0]))
    return (x >> np.uint64(1)) | ((x & np.uint64(TRIGGER - 1)) != 0).astype(np.uint64) << np.uint64(63)


def _cut(text: bytes):
    return lambda s, e: text[s:e]


def symbols(window: int = WINDOW) -> Symbols:
    def repeats(strings: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(map(len, strings), np.int64, len(strings)), repeated(strings, window)

    return Symbols(window, GRAM, _codes, _order, _cut, np.uint8, False, repeats)


def dedup_bytes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row of docs(doc_id, text).

    A byte of the UTF-8 text goes if it lies in a string of `window` bytes that also starts anywhere else in the
    table, in its own document too; all copies go. Strings never cross documents. n_spans counts the maximal
    removed runs. A null text has no bytes; rows that repeat a document count as copies; an empty table gives an
    empty one; other columns are not read.
    """
    docs = keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch.column("text"))
            gone, spans, kept = [], [], []
            for text, mask in zip(texts, masks(batch, list(map(len, texts)))):
                gone.append(int(mask.sum()))
                spans.append(int(np.count_nonzero(np.diff(np.concatenate([[0], mask.view(np.int8)])) == 1)))
                kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes() if gone[-1] else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    spans = repeated_spans(docs, symbols(window), "suffixes")
    return with_spans(docs, spans).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
