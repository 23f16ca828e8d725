"""Means that are cut to whole numbers, against the SQL twin."""

import random

from test_round3 import both, events


def test_means_of_values_finer_than_cents(spark, tmp_path):
    rng = random.Random(4)
    # a mean of 9.996 is under ten, one of 45.004 is over 45; doubles with all their digits; no reference; large values
    sides = {1: ([9.996] * 2, [9.0, 9.0]), 2: ([10.0], [9.996]), 3: ([49.0], [45.004, 45.004]), 4: ([0.996], [0.5, 0.5]), 6: ([3.0], []), 7: ([3e12], [3e12, 2.9e12]), 8: ([-0.5], [0.25]), 9: ([-1.0, -2.0], [2.5])}
    for u in range(10, 60):
        r = rng.uniform(5, 60)
        sides[u] = ([r * rng.uniform(0.75, 1.25) for _ in range(3)], [r, r * 1.01, r * 0.98])
    rows = [(u, k, v) for u, ab in sides.items() for k, vs in zip(("view", "click"), ab) for v in vs]
    got, want = both(spark, tmp_path, "agg11_record_score", events=events(rows))
    assert got == want and len({r[-1] for r in got}) == 5
