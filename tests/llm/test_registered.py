"""The registered queries themselves on the smallest tables, against the libraries and plain Python."""

import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import pyarrow.parquet as pq
import public_tokenizers
import pytest
import sentencepiece
from test_dedup import components, plain_fingerprint
from test_text import base, levenshtein_best
from tokenizers import Tokenizer

from pulsemill.llm import decontaminate, queries, stages

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the small tables are not here")
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def read(name, *columns):
    t = pq.read_table(f"{DATA}/{name}.parquet")
    return list(zip(*(t.column(c).to_pylist() for c in columns)))


@pytest.fixture(scope="module")
def documents():
    return read("documents", "doc_id", "text")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_fingerprints_and_components(spark, documents):
    fps = {d: plain_fingerprint(t) for d, t in documents}
    roots = components(fps, 3)
    got = rows(queries.op1_simhash_near_dedup(spark, DATA), "doc_id", "fingerprint", "component_id")
    assert got == sorted((d, f"{fps[d]:016x}", roots[d]) for d, _ in documents)


def test_benchmark_passages(spark, documents):
    want = set()
    items = [(i, decontaminate.words(t)) for i, t in read("benchmark", "item_id", "text")]
    for d, t in documents:
        own = decontaminate.words(t or "")
        held = set(own)
        for i, p in items:
            if p and len(held & set(p)) >= 0.6 * len(set(p)) and (best := levenshtein_best(p, own)) <= int(0.15 * len(p)):
                want.add((d, i, best))
    assert set(rows(queries.op3_benchmark_decontamination(spark, DATA), "doc_id", "item_id", "edits")) == want


def test_round_trip_digests(spark, documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d, t in documents:
        ids = [*sp.encode(t or ""), sp.eos_id()]
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    assert rows(queries.op5_sentencepiece_round_trip(spark, DATA), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_token_counts(spark, documents):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_padding()
    tok.no_truncation()
    n = {d: len(tok.encode(t or "", add_special_tokens=False).ids) for d, t in documents}
    want = sorted((d, len((t or "").encode()), n[d], n[d] > 2048) for d, t in documents)
    assert rows(queries.op6_token_counts(spark, DATA), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_secret_digests(spark, documents):
    want = []
    for d, t in documents:
        own = base(t or "")
        kinds = ("assign", "access", "hex")
        want.append((d, *(sum(k == i for _, k, _ in own) for i in range(3)), sha(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in own))))
    got = queries.op7_secret_scan(spark, DATA)
    assert rows(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want)
    for r in got.collect():
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert sha(",".join(":".join(x) for x in spans if x[0] != "random")) == r.base_sha256


def test_quality_columns(spark, documents):
    got = {r.doc_id: r for r in queries.op8_quality_classifier(spark, DATA).collect()}
    assert got.keys() == {d for d, _ in documents}
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    labels = [(q, got[d]) for d, q in read("labels", "doc_id", "quality") if d in got]
    assert sum(r.predicted == q for q, r in labels) >= 0.9 * len(labels)


def test_chat_digests(spark):
    talks = defaultdict(list)
    for c, turn, role, text in read("conversations", "conv_id", "turn", "role", "text"):
        talks[c].append((turn, role, text or ""))
    talks[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    want = []
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        want.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    got = queries.op10_chat_formatting(spark, DATA)
    assert rows(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want)
    assert all(r.formatted_chars > r.loss_chars for r in got.collect())


def test_stages_keep_clashing_columns(spark, documents):
    """Extra columns named as the operators' own pass through the filtering stages."""
    from conftest import CLASH

    docs = spark.createDataFrame([(d, t, *["x"] * len(CLASH)) for d, t in documents[:60]], ", ".join(["doc_id long", "text string", *(f"{c} string" for c in CLASH)]))
    for name, stage in stages.STAGES[:-1]:
        found = stage(spark, docs, DATA)
        assert found.columns == docs.columns, name
        assert all(r[c] == "x" for r in found.collect() for c in CLASH), name
