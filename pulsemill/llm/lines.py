"""Lines that many documents repeat, dropped from all but one.

Lines travel as hashes of 128 bits. One aggregate counts the documents of each; those of enough documents are dealt into shards,
and a shard becomes a minimal perfect hash with an array of fingerprints, one of counts and one of the last document. Documents
send what they hold, packed by shard, past the arrays: a task has one shard at a time and answers what streams by, and a shard that is
asked more often than others has several tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, discard, keyed, materialize, same_doc
from .hashing import mix
from .perfecthash import PerfectHash, build

#: Hashes of a shard, on average; there are at most MOST_SHARDS, whatever the table's size.
SHARD, MOST_SHARDS = 1 << 14, 1 << 16
#: Lines that one task asks about, at most on average.
ASKED = 1 << 20
#: Tasks for each shuffle partition, so that partitions come out even.
EVEN = 4
#: Lines in one row on their way to a task.
PACKED = 512
WHITE = b" \t\n\v\f\r"
ROW = ["slot", "kind", "data"]


def line_key(line: bytes, least: int) -> bytes | None:
    """A line without white space at its ends and with A-Z lower-cased; None if that has fewer characters than `least`."""
    line = line.strip(WHITE)
    if len(line) < least or not line.isascii() and len(line) - sum(0x80 <= x < 0xC0 for x in line) < least:
        return None
    return line.lower()


def hashed(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, th, n_lines, and, for the lines of docs = keyed(...) with keys of so many characters, hi and lo (the halves of the key's
    hash) and at (the line's number from 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            his, los, ats, n_lines = [], [], [], []
            for text in binary(batch.column("text")):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                keys = [(i, k) for i, x in enumerate(lines) if (k := line_key(x, least)) is not None]
                halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for _, k in keys]), ">i8").astype(np.int64).reshape(-1, 2)
                his.append(halves[:, 0])
                los.append(halves[:, 1])
                ats.append(np.array([i for i, _ in keys], np.int32))
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            columns = [batch.column("doc_id"), batch.column("th"), pa.array(n_lines, pa.int64()), pa.array(his, longs), pa.array(los, longs), pa.array(ats, ints)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n_lines", "hi", "lo", "at"])

    return docs.mapInArrow(run, "doc_id long, th long, n_lines long, hi array<long>, lo array<long>, at array<int>")


def repeated(lines: DataFrame, least_docs: int) -> DataFrame:
    """hi, lo, n (rows that hold it), last (greatest doc_id of these) for each hash in at least so many rows of lines."""
    own = lines.select("doc_id", F.explode(F.array_distinct(F.arrays_zip("hi", "lo"))).alias("x")).select("doc_id", "x.hi", "x.lo")
    return own.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= least_docs)


def shard_of(hi: np.ndarray, shards: int) -> np.ndarray:
    """Even over shards, and independent of what the perfect hash makes of hi."""
    return ((hi.view(np.uint64) >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


@dataclass(frozen=True)
class Index:
    """What a shard knows of its hashes: fingerprints (lo), counts (documents, as far as 32 bits go), and last, the greatest doc_id,
    or none where there is none, all by the slot that a perfect hash of (hi, lo) under `seed` gives."""

    slots: PerfectHash
    seed: int
    fingerprints: np.ndarray
    counts: np.ndarray
    last: np.ndarray
    none: np.ndarray

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 if it isn't here."""
        slot = self.slots.slots(_one_key(hi, lo, self.seed))
        return np.where((slot >= 0) & (self.fingerprints[slot] == lo), slot, -1)

    def dump(self) -> bytes:
        of = self.slots
        return pickle.dumps((of.words, of.before, of.sizes, of.rest, self.seed, self.fingerprints, self.counts, self.last, self.none))

    @staticmethod
    def load(data: bytes) -> Index:
        words, before, sizes, rest, *more = pickle.loads(data)
        return Index(PerfectHash(words, before, sizes, rest), *more)


def _one_key(hi: np.ndarray, lo: np.ndarray, seed: int) -> np.ndarray:
    return hi.view(np.uint64) + mix(lo.view(np.uint64) + np.uint64(seed))


def index(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, last: np.ndarray, none: np.ndarray) -> Index:
    """Of distinct hashes."""
    seed = 0
    while len(np.unique(keys := _one_key(hi, lo, seed))) < len(keys):
        seed += 1
    slots = build(keys)
    order = np.argsort(slots.slots(keys))
    counts = np.minimum(n, (1 << 32) - 1).astype(np.uint32)
    return Index(slots, seed, lo[order], counts[order], last[order], none[order])


def _sharded(first: np.ndarray):
    """Rows (slot, kind 0, data), one for each task of a shard, from rows (shard, hi, lo, n, last) sorted by shard; data is the Index of
    the shard. Tasks of shard s have the slots first[s] to first[s + 1]."""

    def made(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        hi, lo, n, last = (rows[c].combine_chunks() for c in ("hi", "lo", "n", "last"))
        none = last.is_null().to_numpy(zero_copy_only=False)
        found = index(hi.to_numpy(), lo.to_numpy(), n.to_numpy(), last.fill_null(0).to_numpy(), none)
        slots = np.arange(first[shard], first[shard + 1])
        return pa.RecordBatch.from_arrays([pa.array(slots), pa.array([0] * len(slots), pa.int32()), pa.array([found.dump()] * len(slots), pa.binary())], ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = -1
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and shard[a] != now:
                    yield made(now, held)
                    held = []
                now = int(shard[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield made(now, held)

    return run


def _asked(shards: int, first: np.ndarray):
    """Rows (slot, kind 1, data) that take the lines of rows = hashed(...) to the tasks of their shards in turn; data has, for
    up to PACKED lines, doc_id, whether it is null, th, hi, lo, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = None
        for batch in batches:
            hi, lo, at = (batch.column(c) for c in ("hi", "lo", "at"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(hi.offsets.to_numpy()))
            if not len(row):
                continue
            doc_id, th = batch.column("doc_id"), batch.column("th").to_numpy()
            if turn is None:  # tasks that ask begin at different ones
                turn = np.arange(shards) + (int(th[0]) & 0xFFFF)
            none = doc_id.is_null().to_numpy(zero_copy_only=False)
            asks = np.column_stack([doc_id.fill_null(0).to_numpy()[row], none[row], th[row], hi.flatten(), lo.flatten(), at.flatten()]).astype(np.int64)
            shard = shard_of(asks[:, 3], shards)
            order = np.argsort(shard, kind="stable")
            asks, shard = asks[order], shard[order]
            slots, data = [], []
            cuts = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                own = int(shard[a])
                for lo_ in range(a, b, PACKED):
                    slots.append(int(first[own] + turn[own] % (first[own + 1] - first[own])))
                    turn[own] += 1
                    data.append(asks[lo_ : min(b, lo_ + PACKED)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([1] * len(slots), pa.int32()), pa.array(data, pa.binary())], ROW)

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, th, at of the lines that go, from rows (slot, kind, data) sorted by slot and kind."""
    found: Index | None = None
    now = None
    for batch in batches:
        for slot, kind, data in zip(*(batch.column(c).to_pylist() for c in ROW)):
            if slot != now:
                now, found = slot, None
            if kind == 0:
                found = Index.load(data)
            elif found is not None:
                doc_id, none, th, hi, lo, at = np.frombuffer(data, np.int64).reshape(-1, 6).T.copy()
                own = found.find(hi, lo)
                stays = (found.none[own] == (none == 1)) & ((none == 1) | (found.last[own] == doc_id))
                go = (own >= 0) & ~stays
                ids = pa.array(doc_id[go], mask=none[go] == 1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(th[go]), pa.array(at[go].astype(np.int32))], ["doc_id", "th", "at"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, kept = [], []
        for text, gone in zip(binary(batch.column("text")), batch.column("gone").to_pylist()):
            lines, gone = text.split(b"\n"), set(gone or ())
            n.append(len(lines))
            kept.append(b"\n".join([x for i, x in enumerate(lines) if i not in gone]))
        dropped = [len(x or ()) for x in batch.column("gone").to_pylist()]
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept for every row of docs(doc_id, text).

    A line's key is the line without white space (space, \\t to \\r) at its ends, A-Z lower-cased. Lines whose keys have least_chars
    characters or more and are found in least_docs rows or more go, but for all of those in rows with the greatest doc_id that
    holds the key; a missing id is below all others. kept joins the lines that stay by \\n. A null text is an empty one, and that
    is one empty line. Rows that repeat a doc_id count each as a document and keep a row each; an empty table gives an empty one;
    other columns are not read. Keys are told apart by 128 bits.
    """
    spark = docs.sparkSession
    own = keyed(docs)
    rows = materialize(hashed(own, least_chars), "lines-hashed")
    again = materialize(repeated(rows, least_docs), "lines-repeated")
    n, held = again.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, min(MOST_SHARDS, -(-n // SHARD)))
    asked = rows.agg(F.coalesce(F.sum(F.size("hi")), F.lit(0))).first()[0]
    # of a shard the lines that are repeated are counted, the others are spread evenly
    again = again.withColumn("shard", F.shiftright(F.shiftrightunsigned("hi", 40) * shards, 24))
    load = np.full(shards, max(0, asked - held) / shards)
    for r in again.groupBy("shard").agg(F.sum("n").alias("n")).toLocalIterator():  # MOST_SHARDS rows at most
        load[r.shard] += r.n
    parts = EVEN * int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = np.maximum(1, np.ceil(load / max(1.0, min(ASKED, asked / parts)))).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(tasks)])
    schema = "slot long, kind int, data binary"
    arrays = again.repartition("shard").sortWithinPartitions("shard").mapInArrow(_sharded(first), schema)
    asks = rows.select("doc_id", "th", "hi", "lo", "at").mapInArrow(_asked(shards, first), schema)
    found = arrays.unionByName(asks).repartition("slot").sortWithinPartitions("slot", "kind").mapInArrow(_answers, "doc_id long, th long, at int")
    gone = materialize(found.groupBy("doc_id", "th").agg(F.collect_set("at").alias("gone")), "lines-gone")
    discard(rows)
    joined = own.join(gone, same_doc(own, gone), "left").select(own["doc_id"], own["text"], "gone")
    return joined.mapInArrow(_without, "doc_id long, n_lines long, n_dropped long, kept string")
