import random

import pytest
from pyspark.sql import functions as F

#: Columns whose names clash with those the operators make themselves.
CLASH = ("fp", "th", "s", "h", "spans", "base", "dense", "row", "ids", "n_words", "score", "label", "item_id", "v", "g", "rank")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """doc_id, text: copies, near copies, shared passages, nulls, empty, white, odd and long texts."""
    rng = random.Random(7)
    passage = " ".join(words(rng, 70))
    rows, base = [], [words(rng, rng.randrange(5, 300)) for _ in range(40)]
    for i, w in enumerate(base):
        rows.append((i, " ".join(w)))
    for i in range(40, 60):  # near copies and copies
        w = list(base[i - 40])
        if i % 2:
            w[len(w) // 2] = "changed"
        rows.append((i, " ".join(w)))
    for i in range(60, 75):  # a passage between other words
        rows.append((i, " ".join(words(rng, 20)) + "\n" + passage + "\t" + " ".join(words(rng, 20))))
    rows += [(80, None), (81, ""), (82, " \n\t "), (83, "one"), (84, "ONE"), (85, "é日本😀 ▁x\x00y  z"), (86, "ab " * 3000), (87, "a" * 2500), (88, " ".join(words(rng, 20_000, 5000)))]
    rows += [(None, "no id here at all"), (None, rows[3][1]), (89, rows[70][1]), (89, rows[70][1])]  # no id; repeated rows
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
