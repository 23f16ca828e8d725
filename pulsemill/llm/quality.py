"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most: those of the least hash of their doc_id.
SAMPLE = 8_000
BUCKETS = 1 << 18
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
#: A text of few n-grams says little: this many are added to the count that its score is an average over.
PRIOR = 4
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
MEMO = 300_000


class Ids(dict):
    """Hash of a token; a word in capitals and a number also pass as such, by their first bits."""

    def __missing__(self, token: str) -> int:
        if token.isdigit():
            token = "<number>"
        elif len(token) > 1 and token.isupper():
            token = "<capitals>"
        got = xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace"))
        if len(self) >= MEMO:
            self.clear()
        self[token] = got
        return got


SAME = np.uint64(xxhash.xxh3_64_intdigest(b"<same>"))


def grams(text: str, ids: Ids) -> np.ndarray:
    """Buckets of a text's word unigrams and bigrams, repeats included. A token equal to the one before, or two
    before, counts as <same>: it is the repetition that tells."""
    found = TOKEN.findall(text)
    one = np.fromiter(map(ids.__getitem__, found), np.uint64, len(found))
    if not len(one):
        return np.zeros(0, np.int64)
    token = one.copy()
    token[1:][one[1:] == one[:-1]] = SAME
    token[2:][one[2:] == one[:-2]] = SAME
    two = token[1:] * np.uint64(0x9E3779B97F4A7C15) ^ token[:-1]
    two ^= two >> np.uint64(29)
    return (np.concatenate([token, two * np.uint64(0xBF58476D1CE4E5B9)]) >> np.uint64(64 - 18)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str, ids: Ids) -> float:
        at = grams(text, ids)
        margin = self.bias + self.weights[at].sum() / (len(at) + PRIOR) * SCALE
        return float(1 / (1 + np.exp(-np.clip(margin, -35, 35))))


SCALE = 20.0


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> Model:
    """FTRL-proximal, one text at a time, in the order given."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    ids = Ids()

    def weights(at: np.ndarray | slice) -> np.ndarray:
        over = np.abs(z[at]) > L1
        return np.where(over, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    ready = []
    for text, label in rows:
        at, count = np.unique(grams(text, ids), return_counts=True)
        x = count / (count.sum() + PRIOR) * SCALE
        ready.append((np.append(at, BUCKETS), np.append(x, 1.0), label))
    for _ in range(epochs):
        for at, x, label in ready:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(slice(None))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels(doc_id, quality), from at most `sample` labelled rows that are not held out.

    Rows without an id, a label or a document are not learned from. With none left every score is 0.5. The sample
    is trained on in one task; it and the weights, of fixed size, bound what reaches a task and the driver.
    """
    by = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).dropna().orderBy(*by, "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(*by, "quality", F.xxhash64("text")).limit(sample).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [(t, int(q > 0)) for b in batches for t, q in zip(b.column("text").to_pylist(), b.column("quality").to_pylist())]
        model = train(table)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], ["weights", "bias"])

    got = rows.select("text", "quality").mapInArrow(run, "weights binary, bias double").first()
    return Model(np.frombuffer(got.weights, np.float32), got.bias) if got else Model(np.zeros(BUCKETS, np.float32), 0.0)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: quality 1 likelier) for every row of docs(doc_id, text).

    A null or empty text gets the score of the bias. Repeated rows stay; an empty table gives an empty one; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids = Model(*shared.value), Ids()
        for batch in batches:
            got = [own.score(t or "", ids) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score at least `least`; null and empty texts too are judged."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids = Model(*shared.value), Ids()
        for batch in batches:
            yield batch.filter(pa.array([own.score(t or "", ids) >= least for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
