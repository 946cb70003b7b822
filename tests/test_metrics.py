import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barfold.functions.arrays import patchify
from barfold.operators.metrics import (
    collapse_check, hit_rate, mse_loss, overall_net_sharpe, pinball_by_quantile, pinball_loss,
    quantile_crossing, rank_ic_by_date, rank_ic_summary, sharpe_ratio, sign_backtest, signal_gate,
)

D1, D2 = dt.date(2020, 1, 1), dt.date(2020, 1, 2)


def preds(spark, rows):
    """rows of (date, pred, actual), one name each."""
    return spark.createDataFrame(
        [("f", f"N{i}", d, p, a) for i, (d, p, a) in enumerate(rows)],
        "fold string, isin string, date date, pred double, actual double")


def days(spark, *groups):
    return preds(spark, [(d, float(p), float(a)) for d, ps, acts in groups for p, a in zip(ps, acts)])


def test_rank_ic_extremes_and_skips(spark):
    df = days(spark, (D1, [1, 2, 3, 4, 5], [10, 20, 30, 40, 50]), (D2, [1, 2, 3, 4, 5], [5, 4, 3, 2, 1]),
              (dt.date(2020, 1, 3), [1, 2], [1, 2]), (dt.date(2020, 1, 4), [1, 1, 1, 1], [1, 2, 3, 4]))
    got = {r["date"]: r["ic"] for r in rank_ic_by_date(df).collect()}
    assert got == pytest.approx({D1: 1.0, D2: -1.0})


def test_rank_ic_is_within_days(spark):
    df = days(spark, (D1, [1, 2, 3], [-30, -20, -10]), (D2, [1, 2, 3], [10, 20, 30]))
    s = rank_ic_summary(df).first()
    assert (s["mean_ic"], s["ic_ir"], s["pct_positive_days"], s["n_days"]) == (pytest.approx(1.0), 0.0, 1.0, 2)


def test_tied_ranks(spark):
    df = days(spark, (D1, [1, 1, 2, 3], [4, 2, 2, 9]))
    # ranks 1.5 1.5 3 4 against 3 1.5 1.5 4
    assert rank_ic_by_date(df).first()["ic"] == pytest.approx(2.25 / 4.5)


def test_collapsed_fold_is_flagged(spark):
    flat = days(spark, (D1, [1, 1, 1], [1, 2, 3]))
    got = collapse_check(flat, rank_ic_summary(flat)).first()
    assert got["collapsed"] and got["n_days"] == 0 and got["pred_std"] == 0.0
    assert rank_ic_summary(flat).first()["mean_ic"] is None
    gate = signal_gate(rank_ic_summary(flat)).first()
    assert not gate["gate_pass"] and not gate["stable_sign"]


def test_gate(spark):
    def gate(*ics):
        return signal_gate(spark.createDataFrame(
            [(str(i), x) for i, x in enumerate(ics)], "fold string, mean_ic double")).first()

    assert gate(0.03, 0.02, None)["gate_pass"]
    assert not gate(0.09, -0.01)["gate_pass"]
    assert gate(-0.03, -0.02)["stable_sign"] and not gate(-0.03, -0.02)["gate_pass"]


def test_sharpe_and_hit_rate(spark):
    df = days(spark, (D1, [1, -1, 0.5, 0], [0.01, 0.02, 0.03, 0.01]))
    assert hit_rate(df).first()["hit_rate"] == pytest.approx(2 / 3)
    assert hit_rate(df, deadzone=5.0).first()["hit_rate"] is None
    x = [0.01, 0.02, 0.03, 0.01]
    mean = sum(x) / 4
    sd = math.sqrt(sum((v - mean) ** 2 for v in x) / 3)
    assert sharpe_ratio(df, "actual").first()["sharpe"] == pytest.approx(math.sqrt(252) * mean / sd)
    assert sharpe_ratio(df.limit(1), "actual").first()["sharpe"] == 0.0
    assert mse_loss(df).first()["mse"] == pytest.approx((0.99**2 + 1.02**2 + 0.47**2 + 0.01**2) / 4)


def test_sign_backtest_costs(spark):
    df = spark.createDataFrame(
        [("f", "A", D1, 1.0, 0.02), ("f", "A", D2, -1.0, 0.02), ("f", "B", D1, 1.0, 0.01)],
        "fold string, isin string, date date, pred double, actual double")
    r = sign_backtest(df).first()
    assert r["n"] == 3 and r["mean_abs_position"] == 1.0
    assert r["avg_turnover_per_day"] == pytest.approx(4 / 3)
    assert r["hit_rate"] == pytest.approx(2 / 3)
    from barfold.operators.metrics import backtest_rows
    o = overall_net_sharpe(backtest_rows(df)).first()
    assert o["n_rows"] == 3 and o["mean_net_pnl"] == pytest.approx((0.02 - 0.02 + 0.01 - 0.004) / 3)


def test_pinball(spark):
    df = spark.createDataFrame([("f", [0.0], 1.0)], "fold string, pred array<double>, actual double")
    assert pinball_loss(df, quantiles=[0.5]).first()["pinball"] == pytest.approx(0.5)
    assert pinball_loss(df, quantiles=[0.9]).first()["pinball"] == pytest.approx(0.9)
    over = df.withColumn("actual", F.lit(-1.0))
    assert pinball_loss(over, quantiles=[0.9]).first()["pinball"] == pytest.approx(0.1)
    two = spark.createDataFrame([("f", [0.0, 2.0], 1.0)], "fold string, pred array<double>, actual double")
    got = {r["quantile"]: r["pinball"] for r in pinball_by_quantile(two, quantiles=[0.5, 0.9]).collect()}
    assert got == pytest.approx({0.5: 0.5, 0.9: 0.1})


def test_quantile_crossing(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [1.0, 3.0, 2.0])], "fold string, pred array<double>")
    assert [r["fold"] for r in quantile_crossing(df, 3).collect()] == ["b"]


def test_patchify_pads_the_past(spark):
    window = [[float(2 * i + 1), float(2 * i + 2)] for i in range(7)]
    df = spark.createDataFrame([(window,)], "w array<array<double>>")
    patches = df.select(patchify(F.col("w"), 7, 2, 3).alias("p")).first()["p"]
    assert [sum(p) for p in patches] == [3.0, 33.0, 69.0]
    whole = df.select(patchify(F.col("w"), 7, 2, 7).alias("p")).first()["p"]
    assert len(whole) == 1 and len(whole[0]) == 14
