"""Substring dedup: windows of 50 words that an earlier document has go, found through super-k-mer buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, keyed
from .hashing import mix
from .phrases import suffix_ranks
from .superkmers import Symbols, masks, repeated_spans, with_spans

WINDOW = 50
#: Words; see suffixes.GRAM.
GRAM = 8


def _codes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _order(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - GRAM + 1
    return mix(sum(codes[i : i + n] * np.uint64(0xD6E8FEB86659FD93 + 2 * i * i) for i in range(GRAM)))


def _cut(text: bytes):
    words = text.split()
    return lambda s, e: b" ".join(words[s:e])


def words(window: int = WINDOW) -> Symbols:
    def repeats(strings: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorts the windows by their words, each word by its number in a list of all words, so that equal windows meet."""
        own = [s.split() for s in strings]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        number: dict[bytes, int] = {}
        flat = np.fromiter((number.setdefault(w, len(number)) for ws in own for w in ws), np.int64, int(sizes.sum()))
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
        span, now = suffix_ranks(flat, left, 1, (window + 1) // 2)[-1]  # the first and the last span words cover a window
        at = np.flatnonzero(left >= window)
        key = now[at].astype(np.int64) << 32 | now[at + window - span]
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        cls, document = np.cumsum(new) - 1, rank[np.repeat(np.arange(len(own)), sizes)[at[order]]]
        marked = np.zeros(len(flat), bool)
        marked[at[order[document > document[new][cls]]]] = True
        return sizes, marked

    return Symbols(window, GRAM, _codes, _order, _cut, np.uint64, True, repeats)


def dedup_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of docs(doc_id, text); kept is the remaining text.

    Words are runs of bytes other than space and \\t..\\r. A word goes if it lies in a window of that many words
    whose sequence also starts in a document of smaller doc_id; kept words are joined by one space. A null text has
    no words; a null doc_id counts as greater than all others; rows that share a doc_id never take from each other.
    An empty table gives an empty one; other columns are not read.
    """
    docs = keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.split() for t in binary(batch.column("text"))]
            gone, kept = [], []
            for own, mask in zip(texts, masks(batch, list(map(len, texts)))):
                gone.append(int(mask.sum()))
                kept.append(b" ".join([w for w, m in zip(own, mask.tolist()) if not m] if gone[-1] else own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    spans = repeated_spans(docs, words(window), "substrings")
    return with_spans(docs, spans).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
