"""Phrases that occur more often than their parts let expect, mined level by level.

Texts are encoded once as rows of word numbers. Pass k reads these rows: it counts the phrases of k words exactly that can be frequent,
and throws those of k + 1 words into hash buckets, whose counts bound theirs. Before a phrase is counted, three bits are looked
up: whether both phrases of one word less are frequent (Apriori), and whether its own bucket is. The bits are bitmaps of a bounded
size, broadcast; a bit that two phrases share only makes a pass count more, as what is counted is told apart by its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import bounds, cut, grouped, lowered, packed
from .common import arrow_rows, binary, discard, materialize
from .hashing import ODD, mix

LONGEST = 4
#: Bytes of text in an encoded row, about.
ROW_BYTES = 1 << 20
#: A bitmap has 2**bits bits: one for about eight words of the corpus, and no more than 16 MB.
LEAST_BITS, MOST_BITS = 16, 27
#: Bucket counts that a task gathers before it hands them on, and buckets whose counts travel together.
HELD, BLOCK = 1 << 19, 1 << 12
#: Encoded rows that a Python worker is handed at once.
ROWS = 4
BREAKS, BLANKS = b".,;:!?\n\v\f\r", b" \t"
#: Groups that the phrases of a lang are dealt into before the first of each, and then of all, are taken.
SALTS = 64


def _table(of: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(of)] = True
    return table


LOWERED, BREAK, WORD = lowered(), _table(BREAKS), ~_table(BREAKS + BLANKS)


def encoded(raw: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a buffer, and their numbers in turn; those of a piece's first word are inverted (~)."""
    buf = LOWERED[np.frombuffer(raw, np.uint8)]
    s, e = bounds(WORD[buf])
    if not len(s):
        return [], np.zeros(0, np.int32)
    ids, first = grouped(buf, s, e)
    words = [buf[a:b].tobytes() for a, b in zip(s[first].tolist(), e[first].tolist())]
    piece = np.cumsum(BREAK[buf])[s]
    ids = np.where(np.diff(piece, prepend=-1) != 0, ~ids, ids)
    return words, ids.astype(np.int32)


def _before(text: bytes, at: int) -> int:
    """Where the last LONGEST - 1 words in front of place `at` begin, a place where a word ends, or the text's start."""
    step = 256
    while True:
        lo = max(0, at - step)
        s, _ = bounds(WORD[np.frombuffer(text[lo:at], np.uint8)])
        if len(s) >= LONGEST:  # the first of these may have begun before lo
            return lo + int(s[-(LONGEST - 1)])
        if not lo:
            return 0
        step *= 4


def encode(lang: str, texts: list[bytes], most: int = ROW_BYTES) -> Iterator[tuple[str, int, bytes, bytes, int]]:
    """Rows (lang, skip, words, ids, n): words joined by \\n, ids int32 as in encoded(), n words less skip. A longer text takes
    several rows: the first `skip` words of a row stand for the end of the row before."""
    for own in packed(texts, most):
        long = texts[own[0]] if len(texts[own[0]]) > most else None
        parts = [(_before(long, a), a, long[a:b]) for a, b in cut(long, BREAKS + BLANKS, most)] if long is not None else [(0, 0, b"\n".join([texts[i] for i in own]))]
        for back, a, raw in parts:
            ahead = long[back:a] if long is not None else b""
            words, ids = encoded(ahead + raw)
            skip = len(bounds(WORD[np.frombuffer(ahead, np.uint8)])[0]) if ahead else 0
            if len(ids) > skip:
                yield lang, skip, b"\n".join(words), ids.tobytes(), len(ids) - skip


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def rows(langs: list[str]) -> Iterator[pa.RecordBatch]:
        for lang in langs:
            size.pop(lang)
            for row in encode(lang, held.pop(lang)):
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], ["lang", "skip", "words", "ids", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), binary(batch.column("text"))):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= ROW_BYTES:
                yield from rows([lang])
        if sum(size.values()) > 8 * ROW_BYTES:
            yield from rows(list(held))
    yield from rows(list(held))


def encode_texts(docs: DataFrame) -> DataFrame:
    """Rows of encode() for docs(lang, text); a null lang is 'und'."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_encode, "lang string, skip long, words binary, ids binary, n long")


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def longer(grams: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all words but the last, and of the last."""
    return mix(grams * np.uint64(ODD[0]) + last)


def is_set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; the bitmap is an array of bytes of a power of two."""
    at = hashes >> np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def distinct(keys: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct row of the columns keys, of values below sizes, and how often it occurs."""
    while len(keys) > 1:  # two columns become one, numbered anew if more are to come
        now = keys[0].astype(np.int64) * sizes[1] + keys[1]
        if len(keys) > 2:
            seen, now = np.unique(now, return_inverse=True)
            now, sizes = now.ravel(), [len(seen), *sizes[2:]]
        keys = [now, *keys[2:]]
    _, at, n = np.unique(keys[0], return_index=True, return_counts=True)
    return at, n


def _pass(k: int, bits: int, apriori: Broadcast | None, buckets: Broadcast | None):
    """Rows (lang, phrase, n), the counts of phrases of k words, and (block, data), counts of buckets of phrases of k + 1 words: data has
    the places in a block of BLOCK buckets as uint16 and then their counts as uint32."""

    def of_row(lang: str, skip: int, words: list[bytes], ids: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Phrases, their counts, and the buckets of longer ones, repeats included."""
        begins, ids = ids < 0, np.where(ids < 0, ~ids, ids)
        grams = last = word_hashes(lang, words)[ids]
        whole = np.ones(len(ids), bool)  # whether a phrase lies in one piece
        for size in range(1, k):
            if size == k - 1:
                frequent = is_set(apriori.value, grams) & whole
                may = frequent[:-1] & frequent[1:]
            grams, whole = longer(grams[:-1], last[size:]), whole[:-1] & ~begins[size:]
        sure = whole & is_set(buckets.value, grams) & may if k > 1 else whole
        at = np.flatnonzero(sure[max(0, skip - k + 1) :]) + max(0, skip - k + 1)
        first, n = distinct([ids[at + i] for i in range(k)], [len(words)] * k) if len(at) else (at, at)
        phrases = [b" ".join([words[j] for j in row]) for row in zip(*(ids[at[first] + i].tolist() for i in range(k)))]
        if k == LONGEST:
            return phrases, n, np.zeros(0, np.uint64)
        more = sure[:-1] & sure[1:] & ~begins[k:]
        more[: max(0, skip - k)] = False
        return phrases, n, longer(grams[:-1], last[k:])[more] >> np.uint64(64 - bits)

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        at, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return at, np.bincount(back.ravel(), np.concatenate([n for _, n in held]), len(at)).astype(np.int64)

    def rows(lang: str | None, phrases: list[bytes], n: np.ndarray, block: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
        size = len(phrases) + len(data)
        columns = [pa.array([lang] * size, pa.string()), pa.array(phrases or [None] * size, pa.binary()).cast(pa.string()), pa.array(n if phrases else [None] * size, pa.int64()), pa.array(block if data else [None] * size, pa.int32()), pa.array(data or [None] * size, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n", "block", "data"])

    def bucket_rows(at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        block, place = (at // BLOCK).astype(np.int32), (at % BLOCK).astype(np.uint16)
        n = np.minimum(n, (1 << 32) - 1).astype(np.uint32)
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        data = [p.tobytes() + c.tobytes() for p, c in zip(np.split(place, cuts[1:]), np.split(n, cuts[1:]))]
        for lo in range(0, len(cuts), 1 << 12):
            yield rows(None, [], n, block[cuts[lo : lo + (1 << 12)]], data[lo : lo + (1 << 12)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                lang, skip, words, ids = (batch.column(c)[i].as_py() for c in ("lang", "skip", "words", "ids"))
                phrases, n, more = of_row(lang, skip, words.split(b"\n"), np.frombuffer(ids, np.int32))
                for lo in range(0, len(phrases), 1 << 14):
                    yield rows(lang, phrases[lo : lo + (1 << 14)], n[lo : lo + (1 << 14)], n, [])
                if len(more):
                    held.append(np.unique(more, return_counts=True))
                if sum(len(x) for x, _ in held) > HELD:
                    held = [summed(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield from bucket_rows(*held[0])
                        held = []
        if held:
            yield from bucket_rows(*summed(held))

    return run


def _full_buckets(least: int):
    """block, data: a bit for each bucket whose counts sum up to `least` or more, from rows sorted by block."""

    def made(block: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(counts >= least, bitorder="little").tobytes()], pa.binary())], ["block", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, np.zeros(BLOCK, np.int64)
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                if block != now:
                    if now is not None:
                        yield made(now, counts)
                    now, counts = block, np.zeros(BLOCK, np.int64)
                k = len(data) // 6
                counts[np.frombuffer(data, np.uint16, k)] += np.frombuffer(data, np.uint32, k, 2 * k)
        if now is not None:
            yield made(now, counts)

    return run


def _places(bits: int):
    """bucket: the place of each phrase of rows (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), binary(batch.column("phrase"))):
                hashes = word_hashes(lang, phrase.split(b" "))
                gram = hashes[:1]
                for i in range(1, len(hashes)):
                    gram = longer(gram, hashes[i : i + 1])
                out.append(gram[0])
            yield pa.RecordBatch.from_arrays([pa.array((np.array(out, np.uint64) >> np.uint64(64 - bits)).astype(np.int32))], ["bucket"])

    return run


def _apriori(spark: SparkSession, phrases: DataFrame, bits: int) -> Broadcast:
    """A bit for each of the phrases, broadcast: 2**bits bits, of which the words of 64 with any bit set come to the driver."""
    places = phrases.mapInArrow(_places(bits), "bucket int")
    words = places.groupBy(F.shiftright("bucket", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bucket & 63)")).alias("value")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("value").to_numpy()
    return spark.sparkContext.broadcast(out.view(np.uint8))


def _buckets(spark: SparkSession, counts: DataFrame, least: int, bits: int) -> Broadcast:
    """A bit for each full bucket, broadcast: 2**bits bits in blocks."""
    found = counts.repartition("block").sortWithinPartitions("block").mapInArrow(_full_buckets(least), "block int, data binary").toArrow()
    out = np.zeros(max(BLOCK, 1 << bits) // 8, np.uint8)
    for block, data in zip(found.column("block").to_pylist(), found.column("data").to_pylist()):
        out[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)] = np.frombuffer(data, np.uint8)
    return spark.sparkContext.broadcast(out[: (1 << bits) // 8])


def frequent_phrases(docs: DataFrame, least: int = 30, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """Written tables (lang, phrase, words, a) of all phrases of up to LONGEST words that occur `least` times or more, and (lang, n) of the
    words there are."""
    spark = docs.sparkSession
    rows = materialize(encode_texts(docs), "collocations-encoded")
    langs = materialize(rows.groupBy("lang").agg(F.sum("n").alias("n")), "collocations-langs")
    total = langs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(most_bits, max(LEAST_BITS, math.ceil(math.log2(max(1, total / 8)))))
    found, apriori, buckets = [], None, None
    for k in range(1, LONGEST + 1):
        with arrow_rows(spark, ROWS):
            counts = materialize(rows.mapInArrow(_pass(k, bits, apriori, buckets), "lang string, phrase string, n long, block int, data binary"), f"collocations-pass-{k}")
        sums = counts.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        level = materialize(sums, f"collocations-{k}")
        found.append(level.select("lang", "phrase", F.lit(k).alias("words"), "a"))
        if k < LONGEST:
            apriori = _apriori(spark, level.select("lang", "phrase"), bits)
            buckets = _buckets(spark, counts.where("block IS NOT NULL").select("block", "data"), least, bits)
        discard(counts)
    discard(rows)
    table = found[0]
    for level in found[1:]:
        table = table.unionByName(level)
    return table, langs


def _part(start: int | Column, size: int | Column) -> Column:
    """Words of the array w from a place, joined."""
    return F.array_join(F.slice("w", start, size), " ")


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of two to four words of each lang of docs(lang, text).

    Texts, A-Z lower-cased, are split at . , ; : ! ? and line ends into pieces, and these at spaces and tabs into words; phrases lie in
    one piece. a, l and r count a phrase, its first words and its other words, n all words of the lang, overlaps included. A
    phrase occurs `least` times or more. Its score is floor(2000000 a / (l + r)) at the cut of the lowest score, the first of several.
    A phrase goes if a longer one of at least `least` times that holds it has 0.8 times its occurrences or more. Order: score, a,
    greatest first, phrase.

    A null lang is 'und', a null text is empty. Each row counts, also if it repeats another's id or text. An empty table gives no
    rows. Other columns are not read.
    """
    facts, langs = frequent_phrases(docs, least, most_bits)
    known = facts.select("lang", "phrase", F.col("a").alias("f"))
    w = facts.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = [F.struct(F.lit(k).alias("k"), _part(1, k).alias("head"), _part(k + 1, LONGEST).alias("tail")) for k in range(1, LONGEST)]
    cut_at = w.select("lang", "phrase", "a", F.explode(F.filter(F.array(*cuts), lambda c: c["k"] < F.col("words"))).alias("c")).select("lang", "phrase", "a", "c.*")
    left = materialize(cut_at.join(known.toDF("lang", "head", "l"), ["lang", "head"]), "collocations-left")
    both = materialize(left.join(known.toDF("lang", "tail", "r"), ["lang", "tail"]), "collocations-cuts")
    score = F.expr("CAST(CAST(a AS DECIMAL(20,0)) * 2000000 DIV (CAST(l AS DECIMAL(20,0)) + r) AS LONG)")
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    inner = [(k, i, size) for k in range(3, LONGEST + 1) for size in range(2, k) for i in range(1, k - size + 2)]
    parts = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), _part(i, size).alias("phrase")) for k, i, size in inner]), lambda c: c["k"] == F.col("words"))
    held = w.where("words > 2").select("lang", F.col("a").alias("f"), F.explode(parts).alias("c")).groupBy("lang", F.col("c.phrase").alias("phrase")).agg(F.max("f").alias("longer"))
    stays = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * 80)).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = stays.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(langs, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
