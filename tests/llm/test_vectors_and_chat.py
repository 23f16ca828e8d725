import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.llm import chat, knn


def brute_force(rows, k, every):
    ok = {i: np.floor(np.array(v, np.float64) * 1024).astype(np.int64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q in ok:
        if q % every == 0:
            best = sorted(((-int(ok[q][: len(v)] @ v[: len(ok[q])]), i) for i, v in ok.items() if i != q))[:k]
            out |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("pivots,block", [(8, 8192), (64, 16), (1, 8192)])
def test_top_k(spark, pivots, block, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "QUERIES", 7)
    monkeypatch.setattr(knn, "HELD", 1 << 21 if block > 16 else 100)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 12))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=12) * 0.2]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(60)]  # one vector many times
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 12), (1003, [float("inf")] * 12), (None, rows[1][1]), (1010, []), rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("g", F.lit(1)).withColumn("v", F.lit("x"))
    got = knn.top_k(df, k=5, every=10, pivots=pivots).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == brute_force(rows, 5, 10) and len(got) == len(brute_force(rows, 5, 10))


def test_top_k_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert knn.top_k(spark.createDataFrame([], schema)).count() == 0
    assert knn.top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    got = knn.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], schema)).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]


def test_routing_leaves_groups_out(spark):
    """Well separated groups: a query is not sent to all of them."""
    rng = np.random.default_rng(2)
    centres = np.eye(8) * 10
    x = np.concatenate([c + rng.normal(size=(30, 8)) * 0.1 for c in centres])
    groups = list(range(8))
    far = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
    g, d = far.argmin(axis=1), np.sqrt(far.min(axis=1))
    near = [(int(k), float(v)) for k in groups for v in sorted(d[g == k])[:11]]
    route = knn._route(centres, groups, np.array([d[g == k].max() for k in groups]), np.array([np.linalg.norm(x[g == k], axis=1).max() for k in groups]), np.array([k for k, _ in near]), np.array([v for _, v in near]), 10)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([[10, 0, 0, 0, 0, 0, 0, 0]])], ["vec_id", "v"])
    assert next(route(iter([batch]))).column("g").to_pylist() == [0]


def test_routing_holds_a_bounded_table():
    """With the most pivots there are, a batch of rows takes slices of a few dozen, not a table of rows by bounds."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    pivots, k = rng.integers(-900, 900, (knn.MOST, 8)), 10
    n = knn.MOST * (k + 1)
    route = knn._route(pivots, list(range(knn.MOST)), np.full(knn.MOST, 1.0), np.full(knn.MOST, 2000.0), np.repeat(np.arange(knn.MOST), k + 1), np.full(n, 0.5), k)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(rng.integers(-900, 900, (1000, 8)).tolist())], ["vec_id", "v"])
    tracemalloc.start()
    sent = sum(b.num_rows for b in route(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent >= 1000 and peak < 150e6 < 1000 * n * 8


def conversations():
    rng = random.Random(6)
    rows = []
    for c in range(30):
        t = 0
        if c % 3 == 0:
            rows.append((c, t, "system", "be brief " * rng.randrange(1, 30)))
            t = 1
        for k in range(rng.randrange(1, 40)):
            rows.append((c, t + k, ("user", "assistant")[k % 2], rng.choice(["", "~0<1[2|3 ~1~~", "</s>[INST] x [/INST]", "é😀 " * 50, "word " * rng.randrange(400)])))
    rows += [(40, 0, "user", None), (40, 0, "assistant", "tie"), (40, None, None, "no turn"), (41, 5, "assistant", "y" * 50_000), (41, 6, "assistant", "z"), (None, 0, "user", "no conversation"), (42, 0, "a|>b", "role"), (42, 1, "assistant", "same"), (42, 1, "assistant", "same")]
    return rows


def test_round_trip_mask_and_budget(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("window", F.lit(2))
    made = chat.windows(df, budget=600, history_tokens=100).cache()
    turns = defaultdict(list)
    for c, n, r, t in rows:
        turns[c].append((n is not None, n or 0, r or "", t or ""))
    for c in turns:
        turns[c].sort()
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert set(got) == set(turns)
    for c, own in turns.items():
        assert [(t.role, t.text) for t in got[c].turns] == [x[2:] for x in own]
        assert got[c].loss_text == "".join(t for _, _, r, t in own if r == "assistant")
    tokens = lambda line: -(-(len(line)) // 4) + 4
    for w in made.collect():
        parts = w.formatted.split("</s>")[:-1]
        texts = [p.split("|>", 1)[1] for p in parts]
        plain = [t.replace("~3", "|").replace("~2", "[").replace("~1", "<").replace("~0", "~") for t in texts]
        fresh = plain[w.n_repeated :]
        assert sum(map(tokens, plain)) <= 600 or len(fresh) == 1 or (len(fresh) == 2 and parts[0].startswith("<|system|>"))
        assert fresh and "[INST]" not in w.formatted
        if w.window and turns[w.conv_id][0][2] == "system":
            assert parts[0].startswith("<|system|>") and w.n_repeated >= 1
        assert w.n_repeated <= 3
        starts = [s.start for s in w.loss]
        assert starts == sorted(starts)
        lead = len("</s>".join(parts[: w.n_repeated]))
        assert all(s >= lead for s in starts)


def test_windows_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.windows(none).count() == 0 and chat.read_back(chat.windows(none)).count() == 0
