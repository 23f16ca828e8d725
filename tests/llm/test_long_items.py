import random

from test_text import levenshtein_best

from pulsemill.llm import decontaminate


def test_long_items_are_matched_whole(spark):
    """Items around 512 words: found within int(0.15 n) edits of all their words, and not by a part of them."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(n, [word() for _ in range(n)]) for n in (511, 512, 513, 520, 1100)]
    docs = []

    def add(own):
        docs.append((len(docs), [word() for _ in range(20)] + own + [word() for _ in range(15)]))

    for n, own in items:
        k = int(0.15 * n)
        for edits in (0, k, k + 1):
            new = list(own)
            for at in rng.sample(range(n), edits):
                new[at] = "zzz"
            add(new)
        add(own[512:])
        add(own[:512])
        add(own[: n - k])
        add(own[: n - k - 1])
    want = set()
    for d, t in docs:
        for i, p in items:
            if set(p[::7]) & set(t) and (best := levenshtein_best(p, t)) <= int(0.15 * len(p)):
                want.add((d, i, best))
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in items], "item_id long, text string")
    table = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(table, bench).collect()} == want
    assert len(want) >= 15
    assert {r.doc_id for r in decontaminate.clean(table, bench).collect()} == {d for d, _ in docs} - {d for d, _, _ in want}
