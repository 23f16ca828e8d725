"""SimHash near-duplicates, linked through covering locality-sensitive hashing.

For a radius r the covering masks come from a random map of bit positions to vectors over GF(2) of r + 1
coordinates: mask v keeps the positions whose vector has an odd inner product with v. The positions in which
two fingerprints differ span at most r dimensions, so some non-zero v is orthogonal to all of them, and that
table's keys agree. 2**(r+1) - 1 tables thus find every pair within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, materialize
from .graph import components

BITS = 64
#: Columns that hold a fingerprint.
NARROW, WIDE = ("fp",), ("fp", "more")
#: A bucket of more distinct fingerprints than this is compared in blocks of half the size, pair by pair of blocks.
BLOCK = 2048
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def shingle_bounds(text: bytes, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """A text's words with single spaces, and where its shingles start and end there; see fingerprint()."""
    words = text.lower().split()
    if not words:
        return b"", [], []
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    n = max(1, len(words) - shingle + 1)
    return b" ".join(words), (end - size)[:n].tolist(), end[-n:].tolist()


def fingerprint(text: bytes, shingle: int = 3, wide: bool = False) -> bytes:
    """The 8 bytes, 16 if wide, most significant first, of the majority bits over a text's shingle hashes.

    A-Z are lower-cased; words are runs of bytes other than space and \\t..\\r. A text with fewer words than a
    shingle is one shingle; one without words has fingerprint zero. A bit is set if over half the hashes set it.
    """
    digest, size_of = (xxhash.xxh3_128_digest, 2 * BITS) if wide else (xxhash.xxh64_digest, BITS)
    joined, starts, ends = shingle_bounds(text, shingle)
    if not starts:
        return bytes(size_of // 8)
    n = len(starts)
    ones = np.zeros(size_of, np.int64)
    for at in range(0, n, CHUNK):
        part = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])])
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, size_of // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, wide: bool = False) -> DataFrame:
    """doc_id, fp (long) and, if wide, more (long, the other 64 bits) for every row of docs(doc_id, text); a null text
    has no words."""
    sides = WIDE if wide else NARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.frombuffer(b"".join(fingerprint(t, shingle, wide) for t in binary(batch.column("text"))), ">i8")
            fps = fps.astype(np.int64).reshape(-1, len(sides))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, fps.T.copy())], ["doc_id", *sides])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *sides)))


def covering_masks(radius: int, parts: int = 1, used: int = BITS, seed: int = 1) -> list[int]:
    """Bit masks such that words within the radius agree under one of them.

    With used < BITS the masks only look at so many positions; words that differ in more places, but in no more than the
    radius of these, agree under one of them too. With parts > 1 the positions are dealt into that many blocks; of radius r, some block holds r // parts
    differences at most, and each block gets the covering of that smaller radius.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(BITS)[:used]
    masks = []
    for block in np.array_split(order, parts):
        dims = radius // parts + 1
        # non-zero vectors, as even as can be, so that all masks keep about half of the block
        vectors = (np.arange(len(block)) % (2**dims - 1)) + 1
        rng.shuffle(vectors)
        for v in range(1, 2**dims):
            masks.append(sum(1 << int(p) for p, x in zip(block, vectors) if bin(int(x) & v).count("1") & 1))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _node(sides: tuple[str, ...]) -> Column:
    """What names a fingerprint in edges."""
    return F.col(sides[0]) if len(sides) == 1 else F.xxhash64(*sides)


def _near(x: np.ndarray, y: np.ndarray, most: int | np.ndarray) -> np.ndarray:
    """Whether rows of x and y, a column for each 64 bits, differ in at most so many bits."""
    return np.bitwise_count(x ^ y).sum(axis=-1) <= most


def _tree(fps: np.ndarray, most: int) -> tuple[list, list]:
    """A spanning forest of the links between the fingerprints of one bucket, grown breadth first."""
    left, right = [], []
    rest = fps
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = _near(rest, at, most)
            if near.any():
                found = rest[near]
                left.append(np.broadcast_to(at, found.shape))
                right.append(found)
                front += list(found)
                rest = rest[~near]
    return left, right


def _linker(most: int | tuple[int, ...], sides: tuple[str, ...]):
    names = [f"{end}{i}" for end in "ab" for i in range(len(sides))]
    limit = (lambda t: most) if isinstance(most, int) else (lambda t: np.array(most)[t])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            bounds = np.concatenate([[0], change, [len(rows)]])
            size = np.diff(bounds)
            fps = np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
            pair = bounds[:-1][size == 2]
            a, b = fps[pair], fps[pair + 1]
            near = _near(a, b, limit(rows[pair, 0]))
            left, right = [a[near]], [b[near]]
            for s, n in zip(bounds[:-1][size > 2], size[size > 2]):
                x, y = _tree(fps[s : s + n], limit(rows[s, 0]))
                left += x
                right += y
            ends = np.concatenate([np.concatenate(left), np.concatenate(right)], axis=1).view(np.int64)
            return pa.RecordBatch.from_arrays(list(map(pa.array, ends.T.copy())), names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([batch.column(c).to_numpy() for c in ("t", "k", "pair", *sides)])
            if held:
                rows = np.concatenate([*held, rows])
            same = (rows[:, :3] == rows[-1, :3]).all(axis=1)
            cut = len(rows) - int(same[::-1].argmin() if not same.all() else len(rows))
            held = [rows[cut:]]
            if cut:
                yield solve(rows[:cut])
        if held:
            yield solve(held[0])

    return run, ", ".join(f"{c} long" for c in names)


def block_pairs(of: Column) -> Column:
    """The pairs of blocks, by column blocks, that a row with hash `of` belongs to."""
    mine = F.pmod(of, F.col("blocks"))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.least(x, mine) * F.col("blocks") + F.greatest(x, mine))


def linked(rows: DataFrame, sides: tuple[str, ...], most: int | tuple[int, ...]) -> DataFrame:
    """Edges a, b as links() gives them between the fingerprints of rows (t, k, *sides) that share t and k and differ in
    at most so many bits, by t if there are several numbers."""
    # counted where the rows of a key have met: a count by itself would shuffle all keys once more
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("t", "k"))).where("n > 1")
    blocks = F.ceil(F.col("n") / (BLOCK // 2)).cast("long")
    rows = (
        rows.withColumn("blocks", F.when(F.col("n") > BLOCK, blocks).otherwise(F.lit(1).cast("long")))
        .withColumn("pair", F.explode(block_pairs(F.xxhash64(*sides)))).select("t", "k", "pair", *sides)
    )
    run, schema = _linker(most, sides)
    ends = rows.repartition("t", "k", "pair").sortWithinPartitions("t", "k", "pair", *sides).mapInArrow(run, schema)
    return ends.select(*[_node(tuple(f"{end}{i}" for i in range(len(sides)))).alias(end) for end in "ab"])


def links(fps: DataFrame, radius: int = 3, parts: int = 1, used: int = BITS, accept: int | None = None) -> DataFrame:
    """Edges a, b between distinct fingerprints that span the same components as all links within the radius. fps has
    fp (long), and more (long) if they are wide; an end of an edge is fp, or the hash of both.

    Wide fingerprints have a covering of the radius for either half: of a pair within 2 * radius + 1 bits, one half is
    within the radius.
    accept: link fingerprints that share a bucket up to this distance, beyond that up to which all are found.

    Buckets with one fingerprint go. A bucket of over BLOCK fingerprints is cut into blocks and each pair of blocks
    is compared by a task of its own, so that no task holds more than BLOCK or so; links are emitted as trees.
    """
    sides = WIDE if "more" in fps.columns else NARROW
    masks = [(side, m) for side in sides for m in covering_masks(radius, parts, used)]
    keys = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("t"), F.col(side).bitwiseAND(F.lit(_signed(m))).alias("k")) for i, (side, m) in enumerate(masks)]))
    # a partition of small rows grows by the number of tables, so their number is set before that
    dealt = fps.select(*sides).repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), *sides)
    rows = dealt.select(*sides, keys.alias("x")).select(*sides, "x.t", "x.k")
    most = len(sides) * (radius + 1) - 1 if accept is None else accept
    return linked(rows, sides, most)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, parts: int = 1, used: int = BITS, accept: int | None = None, wide: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hex digits, 32 if wide), component_id for every row of docs(doc_id, text).

    Documents whose fingerprints differ in at most radius bits, 2 * radius + 1 if wide, are linked (see links() for
    parts, used and accept); component_id is the least doc_id that can be reached, null only where no linked row has an
    id. Null and empty texts have fingerprint zero. Rows that repeat a doc_id keep one row each; an empty table gives an
    empty one; other columns are not read.
    """
    sides = WIDE if wide else NARROW
    fps = materialize(fingerprints(docs, shingle, wide), "simhash")
    nodes = fps.groupBy(*sides).agg(F.min("doc_id").alias("least"))
    roots = materialize(components(links(nodes.select(*sides), radius, parts, used, accept)), "simhash-roots")
    nodes = nodes.withColumn("own", _node(sides))
    placed = materialize(nodes.join(roots, F.col("own") == F.col("node"), "left").select(*sides, "least", F.coalesce("root", "own").alias("root")), "simhash-placed")
    # written first: an aggregate right above the join's exchange would keep Spark from splitting a large root
    named = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-named")
    ids = placed.join(named, "root").select(*sides, "component_id")
    digits = F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in sides])
    return fps.join(ids, list(sides)).select("doc_id", digits.alias("fingerprint"), "component_id")
