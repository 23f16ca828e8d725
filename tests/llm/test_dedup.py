import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pulsemill.llm import graph, hashing, phrases, simhash, substrings, suffixes, superkmers


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles)
        out |= (ones * 2 > len(shingles)) << bit
    return out


def components(fps, radius):
    """fps: row -> fingerprint. row -> least row of its component."""
    parent = {r: r for r in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    rows = list(fps)
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {r: find(r) for r in rows}


@pytest.mark.parametrize("radius,parts", [(3, 1), (7, 2), (0, 1)])
def test_near_duplicates(docs, texts, radius, parts):
    got = simhash.near_duplicates(docs, radius=radius, parts=parts).collect()
    assert len(got) == len(texts)
    fps = {i: plain_fingerprint(t) for i, (_, t) in enumerate(texts)}
    roots = components(fps, radius)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(texts):
        if d is not None and (least[roots[i]] is None or d < least[roots[i]]):
            least[roots[i]] = d
    want = Counter((d, f"{fps[i]:016x}", least[roots[i]]) for i, (d, _) in enumerate(texts))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_wide_near_duplicates(docs, texts):
    """All links within 2 * radius + 1 of 128 bits are found, and no others without accept."""
    got = simhash.near_duplicates(docs, radius=2, wide=True).collect()
    fps = {i: int.from_bytes(simhash.fingerprint((t or "").encode(), wide=True)) for i, (_, t) in enumerate(texts)}
    roots = components(fps, 5)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(texts):
        if d is not None and (least[roots[i]] is None or d < least[roots[i]]):
            least[roots[i]] = d
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((d, f"{fps[i]:032x}", least[roots[i]]) for i, (d, _) in enumerate(texts))


def test_wide_links_are_those_within_the_distance(spark):
    """Near groups around random centres: every link up to 2 * radius + 1 bits, none beyond accept."""
    rng = np.random.default_rng(8)
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(128, n, replace=False))
    centres = [int.from_bytes(rng.bytes(16)) for _ in range(60)]
    fps = sorted({x for c in centres for x in (c, flip(c, 7), flip(c, 20), flip(c, 45))})
    halves = [tuple(h - (1 << 64) if h >> 63 else h for h in (x >> 64, x & (1 << 64) - 1)) for x in fps]
    frame = spark.createDataFrame(halves, "fp long, more long")
    named = {r.n: x for r, x in zip(frame.selectExpr("xxhash64(fp, more) as n").collect(), fps)}
    found = simhash.links(frame, radius=3, accept=24).collect()
    roots = {r.node: r.root for r in graph.components(simhash.links(frame, radius=3, accept=24)).collect()}
    assert found and all((named[r.a] ^ named[r.b]).bit_count() <= 24 for r in found)
    own = {x: n for n, x in named.items()}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 7:
                assert roots[own[a]] == roots[own[b]]


def test_near_duplicates_of_nothing(no_docs):
    assert simhash.near_duplicates(no_docs, wide=True).count() == 0
    found = simhash.near_duplicates(no_docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"] and found.count() == 0


@pytest.mark.parametrize("radius,parts", [(3, 1), (7, 2)])
def test_covering_masks_cover(radius, parts):
    rng = np.random.default_rng(5)
    masks = simhash.covering_masks(radius, parts)
    for _ in range(3000):
        flipped = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert any(not flipped & m for m in masks)


def test_links_beyond_the_radius(spark):
    """With fewer bits in the keys all links within the radius are found, and none beyond the distance accepted."""
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 150)]
    fps = sorted({x ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for x in fps for k in (0, 3, 8)})
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 3, 1, 40, 8)
    edges = {frozenset((r.a, r.b)) for r in found.collect()}
    roots = {r.node: r.root for r in graph.components(found).collect()}
    near = lambda d: {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= d}
    assert edges <= near(8) and len(edges) > len(near(3))
    assert all(len({roots[x] for x in pair}) == 1 for pair in near(3))


def test_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    """Fingerprints of one bucket beyond the block size: same components, and links only as trees."""
    monkeypatch.setattr(simhash, "BLOCK", 32)
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 63))
    fps = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(300)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    want = components(dict(zip(signed, fps)), 3)
    groups = lambda of: {frozenset(k for k in signed if of(k) == r) for r in {of(k) for k in signed}}
    assert groups(lambda k: roots.get(k, k)) == groups(want.get)


def test_components_of_long_paths_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7), (None, 3), (1000, 999)]
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(201)}, 500: 400, 400: 400, 1000: 999, 999: 999}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_windows(texts, window):
    rank = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in texts:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, float("inf")), rank(d))
    out = Counter()
    for d, t in texts:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < rank(d):
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def plain_bytes(texts, window):
    count = Counter()
    for _, t in texts:
        b = (t or "").encode()
        count.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = Counter()
    for d, t in texts:
        b = (t or "").encode()
        mask = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                mask[i + 1 : i + 1 + window] = True
        kept = bytes(x for x, m in zip(b, mask[1:-1]) if not m)
        out[d, len(b), int(mask.sum()), int((np.diff(mask.astype(int)) == 1).sum()), kept] += 1
    return out


@pytest.mark.parametrize("hot", [1 << 22, 300])
@pytest.mark.parametrize("window", [50, 12])
def test_substring_windows(docs, texts, window, hot, monkeypatch):
    monkeypatch.setattr(superkmers, "HOT", hot)
    got = substrings.digest(substrings.dedup_windows(docs, window)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_windows(texts, window)


@pytest.mark.parametrize("hot", [1 << 22, 3000])
@pytest.mark.parametrize("window", [400, 64])
def test_repeated_bytes(docs, texts, window, hot, monkeypatch):
    monkeypatch.setattr(superkmers, "HOT", hot)
    got = suffixes.dedup_bytes(docs, window).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == plain_bytes(texts, window)


def test_small_segments(docs, texts, monkeypatch):
    monkeypatch.setattr(superkmers, "SEGMENT", 700)
    monkeypatch.setattr(superkmers, "FLAT", 2000)
    got = suffixes.dedup_bytes(docs, 64).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == plain_bytes(texts, 64)


def repeated_starts(strings, window):
    count = Counter(s[i : i + window] for s in strings for i in range(len(s) - window + 1))
    return [i + window <= len(s) and count[s[i : i + window]] > 1 for s in strings for i in range(len(s))]


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abcd", bytes(range(256))])
@pytest.mark.parametrize("gram,trigger", [(2, 4), (8, 32), (16, 256)])
def test_parsing_gives_the_order_of_windows(letters, gram, trigger, monkeypatch):
    """Windows that a neighbour in corpus order shares are those that repeat, whatever the triggers."""
    monkeypatch.setattr(phrases, "GRAM", gram)
    monkeypatch.setattr(phrases, "TRIGGER", trigger)
    rng = random.Random(gram)
    for _ in range(12):
        base = [bytes(rng.choice(letters) for _ in range(rng.randrange(1, 900))) for _ in range(4)]
        part = lambda b, i: b[i : i + rng.randrange(1, 900)]
        strings = [b"".join(part(b, rng.randrange(len(b))) for b in rng.choices(base, k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 8))]
        for window in (5, 64, 400):
            assert phrases.repeated(strings, window).tolist() == repeated_starts(strings, window)


@pytest.mark.parametrize("ids", ["null", "same", "other"])
def test_thousands_of_equal_rows(spark, ids):
    """5,000 rows of one text, with null, equal or different ids, and one earlier copy: every row is whole, nothing grows with the square."""
    text = " ".join(f"word{i * 7919 % 1500}" for i in range(1500))
    docs = spark.range(5000).select({"null": F.lit(None).cast("long"), "same": F.lit(5).cast("long"), "other": F.col("id") + 5}[ids].alias("doc_id"), F.lit(text).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(1, text)], "doc_id long, text string")).repartition(4)
    found = suffixes.dedup_bytes(docs).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    assert [tuple(r) for r in found] == [(len(text), len(text), 1, 5001)]
    found = substrings.dedup_windows(docs).groupBy("n_words", "n_removed").count().collect()
    assert sorted(map(tuple, found)) == [(1500, 0, 1), (1500, 1500, 5000)]


def test_windows_of_nothing(no_docs):
    assert substrings.dedup_windows(no_docs).count() == 0 and suffixes.dedup_bytes(no_docs).count() == 0


def test_window_hash_and_sliding_min():
    x = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    for w in (1, 2, 3, 50, 400):
        h = hashing.window_hash(x, w, hashing.ODD[0])
        want = [sum(int(v) * pow(hashing.ODD[0], j, 1 << 64) for j, v in enumerate(x[i : i + w])) % (1 << 64) for i in range(len(x) - w + 1)]
        assert h.tolist() == want
        assert hashing.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]
