"""Phrases, divergences of sources and repeated lines against plain Python, with nulls, ties, repeats and long texts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import CLASH
from pyspark.sql import functions as F

from pulsemill.llm import bytewords, collocations, divergence, lines, perfecthash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- bytes and words


def test_equal_hashes_are_told_apart_by_bytes():
    raw = b"ab cd ab efg cd ab efg x"
    s, e = bytewords.bounds(np.frombuffer(raw, np.uint8) != 32)
    for digest in (bytewords.xxhash.xxh64_intdigest, lambda x: 1, len):
        ids, first = bytewords.grouped(np.frombuffer(raw, np.uint8), s, e, digest)
        words = [raw[a:b] for a, b in zip(s, e)]
        assert [words[first[i]] for i in ids] == words
        assert len(first) == 4 and len(set(ids.tolist())) == 4


@pytest.mark.parametrize("text", [b"", b"a", b"a b c d e f", b"x" * 50, b"x" * 9 + b" " + b"y" * 30])
def test_cuts_keep_words_whole(text):
    parts = list(bytewords.cut(text, b" ", 4))
    assert b"".join(text[a:b] for a, b in parts) == text
    assert all(text[b - 1 : b] == b" " for _, b in parts[:-1])


def test_packs_hold_every_text_once():
    texts = [b"x" * n for n in (3, 0, 50, 2, 2, 2, 9)]
    packs = list(bytewords.packed(texts, 8))
    assert [i for p in packs for i in p] == list(range(7)) and [2] in packs


# --- perfect hash


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_slots_are_minimal_and_perfect(n):
    keys = np.random.default_rng(n).permutation(np.arange(n, dtype=np.uint64) * np.uint64(7919))
    found = perfecthash.build(keys)
    assert sorted(found.slots(keys).tolist()) == list(range(n))
    other = found.slots(np.arange(1 << 40, (1 << 40) + 100, dtype=np.uint64))
    assert ((other >= -1) & (other < max(n, 1))).all()


def test_keys_left_over_after_the_last_level(monkeypatch):
    monkeypatch.setattr(perfecthash, "LEVELS", 1)
    keys = np.arange(1000, dtype=np.uint64)
    found = perfecthash.build(keys)
    assert len(found.rest) and sorted(found.slots(keys).tolist()) == list(range(1000))


def test_index_finds_its_hashes_only():
    rng = np.random.default_rng(3)
    hi, lo = (rng.integers(-(1 << 62), 1 << 62, 500) for _ in range(2))
    hi[:2], lo[:2] = 5, (1, 2)  # equal halves
    n, last = np.arange(500) + (1 << 33) * (np.arange(500) == 7), np.arange(500) * 3
    found = lines.Index.load(lines.index(hi, lo, n, last, np.arange(500) % 2 == 0).dump())
    at = found.find(hi, lo)
    assert sorted(at.tolist()) == list(range(500)) and (found.last[at] == last).all() and found.counts[at[7]] == (1 << 32) - 1
    assert (found.find(lo, hi) == -1).all()


# --- lines


def brute_lines(rows, least=40, most=5):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(UPPER)
    held = defaultdict(list)
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k].append(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if not (len(k := key(x)) >= least and len(held[k]) >= most and max(held[k]) != (-1 if doc_id is None else doc_id))]
        out.append((doc_id, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(5)
    line = lambda n: "".join(rng.choice("abcdé fG") for _ in range(n))
    common = [line(n) for n in (39, 40, 41, 60, 200)]
    rows = []
    for i in range(60):
        own = [rng.choice(common) if rng.random() < 0.5 else line(rng.choice((0, 20, 45))) for _ in range(rng.randrange(1, 12))]
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.2 else f" \t{x}\r" if rng.random() < 0.2 else x for x in own)))
    e40, e39 = "é" * 40, "é" * 39
    rows += [(i, f"{e40}\n{e39}\nÉ{e40}") for i in range(100, 106)]  # code points, not bytes; é is no A-Z
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, " \t"), (None, e40), (None, e40), (None, common[3]), (7, common[3]), (7, common[3]), (300, common[4] + "\n" + common[4])]
    rows += [(301, "\n".join(common[3] if i % 2 else f"line {i} " + "x" * 40 for i in range(4000)))]
    return rows


def got_lines(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=str)


def test_repeated_lines(spark, no_docs):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in (*CLASH, "hi", "lo", "at", "gone", "slot")})
    assert got_lines(lines.dedup_lines(docs)) == brute_lines(rows)
    assert lines.dedup_lines(no_docs).collect() == []


def test_repeated_lines_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD", 1)
    monkeypatch.setattr(lines, "ASKED", 3)
    monkeypatch.setattr(lines, "PACKED", 2)
    rows = line_rows()[:70]
    assert got_lines(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 10, 3)) == brute_lines(rows, 10, 3)


def test_lines_that_only_rows_without_id_hold(spark):
    rows = [(None, "a" * 40 + f"\n{i}") for i in range(6)]
    assert got_lines(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_lines(rows)


# --- divergence


def brute_divergence(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [[t.translate(UPPER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)] for _, _, text in rows]
    docs, counts, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for (lang, source, _), own in zip(rows, terms):
        docs[lang].update(set(own))
        counts[lang, source].update(own)
        whole[lang].update(own)
    out = []
    shares = lambda c, kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        q = shares(whole[lang], kept)
        p = {s: shares(c, kept) for (g, s), c in counts.items() if g == lang}
        for s in p:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s]
            more = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, n in (("pair", pairs, len(pairs)), ("term", more, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:n], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def source_rows():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("wa", "Éa", "日", "zz", "Q") for b in "abcdefghij"] + ["ties", "tied"]
    rows = []
    for lang in ("en", "de", None, "few"):
        for i in range(3 if lang == "few" else 60):
            words = [vocabulary[min(int(rng.expovariate(0.08)), len(vocabulary) - 1)] for _ in range(rng.randrange(0, 60))]
            rows.append((lang, rng.choice(("s1", "s2", "src10", None)), rng.choice((" ", "\n", "-", "[1]", "_")).join(words)))
    rows += [("en", "none", None), ("en", "blank", " 1_2\x00"), ("alone", "s", "a b c"), ("de", "long", "wa waa " * 5000), rows[3], rows[3]]
    return rows


def got_divergence(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("least, small", [(10, False), (3, True), (10_000, False)])
def test_divergence_of_sources(spark, monkeypatch, least, small):
    if small:  # many shards, blocks of rows, texts in parts
        monkeypatch.setattr(divergence, "LEAST", 4)
        monkeypatch.setattr(divergence, "MOST", 4)
        monkeypatch.setattr(divergence, "ROWS", 2)
        monkeypatch.setattr(divergence, "HELD", 5)
    rows = source_rows()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3).withColumns({c: F.lit("x") for c in (*CLASH, "n", "term", "shard", "kept")})
    assert got_divergence(divergence.source_divergence(docs, least, 7)) == brute_divergence(rows, least, 7)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_texts_in_parts_count_once():
    for most in (3, 7, 1 << 20):
        found = defaultdict(lambda: [0, 0])
        for g, term, n, d in divergence.counted([b"aa bb aa cc aa", b"", b"aa Bb", "éé ".encode() * 4], np.array([0, 0, 1, 0]), most):
            found[g, term][0] += n
            found[g, term][1] += d
        assert dict(found) == {(0, b"aa"): [3, 1], (0, b"bb"): [1, 1], (0, b"cc"): [1, 1], (1, b"aa"): [1, 1], (1, b"bb"): [1, 1], (0, "éé".encode()): [4, 1]}


def test_shares_of_large_counts_are_exact():
    rng = random.Random(1)
    total = [rng.randrange(1, 1 << 58) for _ in range(500)] + [1, 7]
    count = [rng.randrange(1, t + 1) for t in total[:-2]] + [1, 7]
    want = [1 + 10**9 * c // t for c, t in zip(count, total)]
    assert divergence.share(np.array(count), np.array(total)).tolist() == want


# --- phrases


def brute_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang in f:
        own = {p: a for p, a in f[lang].items() if a >= least}
        rows_ = []
        for p, a in own.items():
            if len(p) < 2:
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if not any(100 * b >= 80 * a for q, b in own.items() if len(q) > len(p) and inside(q)):
                rows_.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(2)
    rows = []
    for lang in ("en", None, "de"):
        words = [f"{lang}{i}" for i in range(6)] + ["The", "été", "日本", "a'b", "\x01"]
        for _ in range(50):
            text = ""
            while rng.random() < 0.95:
                text += " ".join(rng.choice((["one two", "new york city", "The", "of the same kind"], words)[rng.random() < 0.5]) for _ in range(rng.randrange(1, 9))) + rng.choice((". ", ",", "\n", " ! ?", "\t", "\x0b", ""))
            rows.append((lang, text))
    rows += [("en", None), ("en", ""), ("none", None), ("en", " \t.,\n"), ("x", "w " * 3000), ("x", "w. " * 50), rows[0], rows[0], ("de", "é日 " * 500 + "one two, " * 200)]
    return rows


def got_phrases(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least, top, small", [(30, 2000, False), (5, 12, True)])
def test_phrases(spark, monkeypatch, least, top, small):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumns({c: F.lit("x") for c in (*CLASH, "phrase", "words", "bucket", "n")})
    bits = collocations.MOST_BITS
    if small:  # few bits that many phrases share, and little that is held
        monkeypatch.setattr(collocations, "LEAST_BITS", 6)
        monkeypatch.setattr(collocations, "HELD", 20)
        monkeypatch.setattr(collocations, "BLOCK", 16)
        bits = 7
    assert got_phrases(collocations.collocations(docs, least, top, bits)) == brute_phrases(rows, least, top)


def test_phrases_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_phrases_across_the_parts_of_a_long_text():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(("a", "bb", "ccc", " ", " ", ".", "\t", "é")) for _ in range(rng.randrange(200))).encode()
        want, got = Counter(), Counter()
        for k in range(1, 5):
            for piece in re.split(rb"[.,;:!?\x0A-\x0D]", text):
                w = piece.split()
                want.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            for _, skip, words, ids, n in collocations.encode("x", [text], rng.randrange(1, 20)):
                words, ids = words.split(b"\n"), np.frombuffer(ids, np.int32)
                assert n == len(ids) - skip
                for i in range(len(ids) - k + 1):
                    if i + k - 1 >= skip and (ids[i + 1 : i + k] >= 0).all():
                        got[tuple(words[j if j >= 0 else ~j] for j in ids[i : i + k])] += 1
        assert got == want, text


def test_counts_beyond_64_bits(spark):
    a, part = 9 * 10**17, 9 * 10**18
    row = spark.sql(f"SELECT CAST(CAST({a}L AS DECIMAL(20,0)) * 2000000 DIV (CAST({part}L AS DECIMAL(20,0)) + {part}L) AS LONG) AS s").first()
    assert row.s == 2_000_000 * a // (2 * part)


def test_terms_leave_a_task_summed_up():
    """Texts of many batches give one row for each lang, source and term, and terms are told apart by Arrow, not word by word."""
    batch = pa.record_batch({"lang": ["a", "a", "b"], "source": ["s", "s", "s"], "text": ["xx yy xx", "XX éé", "xx"]})
    found = [tuple(r.values()) for b in divergence._count(iter([batch] * 3)) for r in b.to_pylist()]
    want = {("a", "s", "xx"): (9, 6), ("a", "s", "yy"): (3, 3), ("a", "s", "éé"): (3, 3), ("b", "s", "xx"): (3, 3), ("a", "s", ""): (0, 0), ("b", "s", ""): (0, 0)}
    assert len(found) == len(want) and {r[:3]: r[3:] for r in found} == want
    assert isinstance(divergence._terms(b"aa bb aa")[2], pa.Array)
