import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barfold.operators.metrics import backtest_rows, rank_ic_by_date, sign_backtest
from barfold.operators.ranking import (
    average_ranks, exact_quantiles, magnitude_bucket, position_by_hash, position_by_isin,
)


@pytest.fixture(scope="module")
def crowded(spark):
    """One date with a third of all rows and one value with half of that date."""
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        d = "hot" if i % 3 == 0 else f"d{i % 7}"
        v = 0.25 if i % 6 == 0 else rnd.choice([rnd.gauss(0, 0.02), round(rnd.gauss(0, 1), 1), 0.0, -0.0])
        rows.append((i, d, float(v)))
    pdf = pd.DataFrame(rows, columns=["i", "d", "v"])
    return pdf, spark.createDataFrame(rows, "i int, d string, v double")


def test_bucket_never_falls_as_the_value_rises(spark):
    values = sorted({s * 10.0 ** e * m for s in (-1, 1) for e in range(-12, 6) for m in (1, 1.003, 3, 9.99)}
                    | {0.0, 5e-324, -5e-324})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r["b"] for r in df.orderBy("v").select(magnitude_bucket(F.col("v")).alias("b")).collect()]
    assert got == sorted(got)


def test_average_ranks_match_pandas(crowded):
    pdf, df = crowded
    got = average_ranks(df, ["d"], ["v"]).toPandas().set_index("i")["v_rank"]
    want = (pdf.v + 0.0).groupby(pdf.d).rank(method="average")
    assert np.array_equal(got.sort_index().to_numpy(), want.to_numpy())


def test_missing_values_have_no_rank_and_dates_with_gaps_no_ic(spark):
    nan = float("nan")
    rows = [("a", v, float(i)) for i, v in enumerate([-2.0, -1.0, 0.5, 3.0])] + [
        ("b", v, float(i)) for i, v in enumerate([-2.0, -1.0, 0.5, 3.0, nan])] + [
        ("c", v, float(i)) for i, v in enumerate([1.0, None, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "date string, pred double, actual double")
    ranks = average_ranks(df, ["date"], ["pred", "actual"]).collect()
    assert [r.pred_rank for r in ranks if r.date == "b" and r.actual == 4.0] == [None]
    assert sorted(r.pred_rank for r in ranks if r.date == "b" and r.pred_rank) == [1, 2, 3, 4]
    assert {r.date: r.ic for r in rank_ic_by_date(df, ["date"]).collect()} == {"a": pytest.approx(1.0)}
    dropped = rank_ic_by_date(df, ["date"], incomplete="drop_rows").collect()
    assert {r.date: (r.ic, r.n_names) for r in dropped} == {"a": (pytest.approx(1.0), 4), "b": (pytest.approx(1.0), 4), "c": (pytest.approx(1.0), 3)}


@pytest.mark.parametrize("light_rows", [0, 5, 400])
def test_heavy_cells_get_the_same_ranks(crowded, light_rows):
    pdf, df = crowded
    got = average_ranks(df, ["d"], ["v"], light_rows=light_rows).toPandas().set_index("i")["v_rank"]
    want = (pdf.v + 0.0).groupby(pdf.d).rank(method="average")
    assert np.array_equal(got.sort_index().to_numpy(), want.to_numpy())


def test_missing_values_beside_heavy_cells(spark):
    rows = [("a", i, 1.0 if i % 3 else float("nan") if i % 2 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "d string, i int, v double")
    got = {(r.v is None or r.v != r.v, r.v_rank) for r in average_ranks(df, ["d"], ["v"], light_rows=10).collect()}
    assert got == {(True, None), (False, 20.5)}
    assert average_ranks(df.limit(0), ["d"], ["v"]).count() == 0


def test_rows_move_once_per_ranked_column_and_nothing_runs_early(spark, crowded, tmp_path):
    _, df = crowded
    df.select("*", (-F.col("v")).alias("w"), F.lit("carried").alias("payload")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    spark.sparkContext.setJobGroup("ranks", "")
    ranked = average_ranks(rows, ["d"], ["v", "w"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("ranks")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "hashpartitioning(d#" in line and "_share#" in line]
    assert len(moved) <= 4  # per column the rows, and the short list of cells that meets them
    assert ranked.count() == 3000


def test_gaps_take_no_position(spark):
    rows = [("f", i, p, a) for i, (p, a) in enumerate([(1.0, 1.0), (-1.0, -2.0), (float("nan"), 1.0), (None, 1.0)])]
    df = spark.createDataFrame(rows, "fold string, k int, pred double, actual double").withColumns(
        {"isin": F.col("k").cast("string"), "date": F.current_date()})
    got = sign_backtest(df).first()
    assert (got.hit_rate, got.mean_abs_position, got.n) == (1.0, 0.5, 4)


def test_exact_quantiles_match_numpy(crowded):
    pdf, df = crowded
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for r in exact_quantiles(df, ["d"], "v", probs).collect():
        want = np.quantile(pdf.v[pdf.d == r["d"]], probs)
        assert r["quantiles"] == pytest.approx(list(want), abs=1e-12)


def test_global_positions(spark):
    rows = [(f"INE{k:03d}{c}", t) for k in range(25) for c in "AB" for t in range(k % 5 + 1)]
    df = spark.createDataFrame(rows, "isin string, t int").withColumn("h", F.md5(F.concat_ws("|", "isin", "t")))
    got = position_by_isin(position_by_hash(df, "h", ["isin", "t"], "by_hash"), ["t"], "by_isin").toPandas()
    by_isin = got.sort_values(["isin", "t"]).by_isin.to_list()
    by_hash = got.sort_values(["h"]).by_hash.to_list()
    assert by_isin == by_hash == list(range(len(rows)))


def test_pooled_book_is_one_series(spark):
    rnd = random.Random(1)
    rows = [(f, f"{p}{k:02d}", pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=t), rnd.uniform(-1, 1), 0.01)
            for f in ("x", "y") for p in ("AAAAAA", "AAAAAB", "ZZ", "M") for k in range(3) for t in range(4)]
    df = spark.createDataFrame(rows, "fold string, isin string, date date, pred double, actual double")
    got = backtest_rows(df, book="pooled", deadzone=0.3).toPandas().sort_values(["fold", "isin", "date"])
    for _, g in got.groupby("fold"):
        position = np.where(g.pred.abs() > 0.3, np.sign(g.pred), 0.0)
        previous = np.concatenate([[0.0], position[:-1]])
        assert np.array_equal(g.position, position) and np.array_equal(g.prev_position, previous)
        assert np.allclose(g.net_pnl, position * g.actual - np.abs(position - previous) * 1e-3)
