import math
import random

import numpy as np
from pyspark.sql import functions as F

from barfold.llm import hard_negatives as hn

DDL = "vec_id long, embedding array<float>, label int, score string"


def _brute(rows, is_anchor, k=5):
    """Plain lists: (anchor, positive, positive rank, rank, negative, scores)."""
    known = []
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            known.append((i, label, tuple(math.floor(256 * float(np.float32(c))) for c in v)))
    out = []
    for a, label, x in sorted(set(r for r in known if is_anchor(r[0]))):
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, m) for i, m, y in known if i != a and len(y) == len(x))
        for place, (s, p, _) in enumerate([r for r in scored if r[2] == label][:k], 1):
            hard = [(t, i) for t, i, m in scored if m != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, place, n, i, -s, -t) for n, (t, i) in enumerate(hard, 1)]
    return sorted(out)


def _mined(spark, rows, **kw):
    found = hn.mine(spark.createDataFrame(rows, DDL), F.col("vec_id") % 4 == 0, **kw)
    return sorted(tuple(r) for r in found.collect())


def test_scores_are_inner_products():
    rnd = np.random.default_rng(1)
    for dims, reach in ((1, 3), (8, 200), (13, 1 << 20), (64, 160), (5, 0)):
        a, x = rnd.integers(-reach - 1, reach + 1, (7, dims)), rnd.integers(-reach - 1, reach + 1, (5000, dims))
        assert np.array_equal(hn.scores(a, hn.bit_planes(x)), a @ x.T)


def test_first_of_puts_ties_in_order():
    score = np.array([[3, 5, 5, 1, 5], [0, 0, 0, 0, 0]])
    usable = np.array([[True, False, True, True, True], [False] * 5])
    rows, columns = hn.first_of(score, usable, 2)
    assert rows.tolist() == [0, 0] and sorted(columns.tolist()) == [2, 4]
    wide = score.astype(np.int64) << 59
    rows, columns = hn.first_of(wide, usable, 2)
    assert sorted(columns.tolist()) == [2, 4]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "GROUP", 10)
    rnd = random.Random(5)
    center = [[rnd.gauss(0, 0.2) for _ in range(10)] for _ in range(3)]
    rows = [(i, [c + rnd.gauss(0, 0.08) for c in center[rnd.randrange(3)]], rnd.randrange(3), "x") for i in range(260)]
    rows += [(1000 + i, rows[i][1], rows[i][2], "x") for i in range(0, 40)]  # equal vectors, other ids
    got = _mined(spark, rows)
    assert got == _brute(rows, lambda i: i % 4 == 0) and len(got) > 300


def test_rows_of_every_kind(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5], 1, "a"), (0, [0.5, 0.5], 1, "a"), (1, [0.5, 0.25], 1, "a"), (2, [0.5, 0.2], 2, "a"), (2, [0.5, 0.2], 2, "a"),
            (3, None, 2, "a"), (4, [0.5, None], 2, "a"), (5, [nan, 0.5], 2, "a"), (6, [inf, 0.5], 2, "a"), (7, [0.5, 0.24], None, "a"),
            (None, [0.5, 0.24], 2, "a"), (8, [1.0], 1, "a"), (9, [1.0], 3, "a"), (10, [1.0], 1, "a"), (12, [-0.5, -0.5], 7, "a"),
            (16, [0.0, 0.0], 1, None), (20, [], 5, "a"), (21, [], 5, "a"), (22, [], 6, "a")]
    got = _mined(spark, rows)
    assert got == _brute(rows, lambda i: i % 4 == 0)
    assert [r for r in got if r[0] == 8] == [(8, 10, 1, 1, 9, 65536, 65536)]
    assert (20, 21, 1, 1, 22, 0, 0) in got
    assert _mined(spark, []) == [] and _mined(spark, [(1, [0.5], 1, "a")]) == []


def test_one_label_holds_most_rows(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.uniform(0, 1) for _ in range(4)], 9 if i % 5 else i % 3, "x") for i in range(300)]
    assert _mined(spark, rows) == _brute(rows, lambda i: i % 4 == 0)
