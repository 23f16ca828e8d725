"""Planted passages through the registered queries that remove repeats: which documents lose them, and which are left alone."""

import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pulsemill.llm import queries


def words(rng, n, letters):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=letters)) for _ in range(n))


@pytest.mark.parametrize("size", [399, 400, 900])
def test_planted_passages(spark, tmp_path, size):
    """Operator 9 takes a passage of 400 bytes from every document that holds it, the first one too; operator 2 leaves the first one
    alone. A passage of over 50 words and under 400 bytes is a repeat for operator 2 only."""
    rng = random.Random(size)
    passage = "\n" + (words(rng, 20, 7) + " " + words(rng, 200, 3))[: size - 3] + "z\n"
    holders = {3, 8, 11}
    own = {d: chr(ord("A") + d) for d in range(20)}  # next to the passage another letter in each document
    texts = {d: f"{words(rng, 40, 7)} {c}{passage if d in holders else ' '}{c} {words(rng, 40, 7)}" for d, c in own.items()}
    pq.write_table(pa.table({"doc_id": list(texts), "text": list(texts.values())}), f"{tmp_path}/documents.parquet")

    got = {r.doc_id: r for r in queries.op9_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        hit = size >= 400 and d in holders
        kept = text.replace(passage, "") if hit else text
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans) == (len(text), size * hit, int(hit))
        assert got[d].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()

    n = len(passage.split())
    assert len(passage) == size and n > 50
    lost = {r.doc_id: r.n_removed for r in queries.op2_substring_dedup(spark, str(tmp_path)).collect()}
    assert lost == {d: n * (d in holders - {3}) for d in texts}
