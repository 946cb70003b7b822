import numpy as np
import pytest
from pyspark.sql import functions as F

from barfold.llm import permutation_index as pi


def _exact(ids, v, key, k):
    score = (v * v[ids.index(key)]).sum(axis=1)
    order = sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != key)
    return [i for _, i in order[:k]]


@pytest.mark.parametrize("unit", [True, False])
def test_recall_against_brute_force(spark, monkeypatch, unit):
    monkeypatch.setattr(pi, "BLOCK", 500)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True) if unit else 1.0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for r in pi.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert len(got) == 75 and all([r.rank for r in x] == list(range(1, 21)) for x in got.values())
    hits = 0
    for key, rows in got.items():
        hits += len({r.vec_id for r in rows} & set(_exact(list(range(1500)), v, key, 20)))
        assert all(abs(r.score - v[key] @ v[r.vec_id]) < 1e-12 for r in rows)
    assert hits >= 0.9 * 75 * 20


def test_ties_and_rows_of_every_kind(spark):
    same, nan = [0.6, 0.8], float("nan")
    rows = [(i, same) for i in range(60)] + [(0, same), (100, None), (101, [0.0, 0.0]), (102, [nan, 1.0]),
            (103, [None, 1.0]), (104, [float("inf"), 1.0]), (None, same), (105, [1.0, 2.0, 3.0]), (120, [-0.6, -0.8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = pi.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == list(range(1, 21))
    assert [r.vec_id for r in got if r.query_id == 20] == list(range(20))
    assert {r.query_id for r in got} == {0, 20, 40, 120}
    few = df.where("vec_id in (20, 120)")
    assert [(r.query_id, r.rank, r.vec_id) for r in pi.nearest(few, F.col("vec_id") % 20 == 0).orderBy("query_id").collect()] == [
        (20, 1, 120), (120, 1, 20)
    ]
    assert pi.nearest(df.limit(0), F.lit(True)).count() == 0


def test_each_length_is_searched_apart(spark, monkeypatch):
    monkeypatch.setattr(pi, "BLOCK", 100)
    rng = np.random.default_rng(2)
    rows = {i: rng.normal(size=(2, 3, 8)[i % 3]).tolist() for i in range(600)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for r in pi.nearest(df, F.col("vec_id") % 20 == 0, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 600, 20))
    for key, found in got.items():
        ids = [i for i in rows if len(rows[i]) == len(rows[key])]
        assert found == _exact(ids, np.array([rows[i] for i in ids]), key, 20)


def test_a_very_common_vector_does_not_crowd_out_the_others():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[1000:2500] = v[1000]
    ids, top = np.arange(3000), 1.0
    mask = pi.first_copies(v, 3)
    assert mask[1000:1003].all() and not mask[1003:2500].any() and mask.sum() == 1503
    centres = pi.lifted(v[rng.choice(1000, 64, replace=False)], top)
    near = v[1000] + rng.normal(size=(20, 16)) * 0.15
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    keys = np.arange(10_000, 10_020)
    query, found, _ = pi.search_block(ids, v, keys, near, centres, top, 20, 64, 32, 0.1)
    hits = 0
    for key, q in zip(keys, near, strict=True):
        score = (v * q).sum(axis=1)
        hits += len(set(found[query == key].tolist()) & set(np.lexsort((ids, -score))[:20].tolist()))
    assert hits >= 0.9 * 400
