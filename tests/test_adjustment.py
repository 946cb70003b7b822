import datetime as dt

import pytest
from pyspark.sql import functions as F

from barfold.functions.corporate_actions import action_multiplier
from barfold.operators.adjust import (
    adjustment_factors, apply_adjustment, apply_adjustment_scan, unparsed_actions,
)
from tests.helpers import bar, bars, day, same_rows

ACTIONS = "isin string, symbol string, series string, ex_date date, subject string"
SPLIT_10_TO_2 = "Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 2/- Per Share"

# Real subject lines and the factor each stands for.
GOLDEN = [
    ("Bonus 1:1", 1 / 2),
    ("Bonus 1 : 1", 1 / 2),
    ("Bonus 1: 2", 2 / 3),
    ("Bonus 10:1", 1 / 11),
    ("Bonus 2:1", 1 / 3),
    ("Bonus 1 : 1250", 1250 / 1251),
    ("Annual General Meeting / Dividend - Rs 3/- Per Share / Bonus - 1:2", 2 / 3),
    ("Face Value Split (Sub-Division) - From Rs 10/- Per Share To Re 1/- Per Share", 1 / 10),
    (SPLIT_10_TO_2, 2 / 10),
    ("Face Value Split (Sub-Division) - From Rs 10 Per Share To Rs 5  Per Share", 5 / 10),
    ("Face Value Split From Rs 10 To Re 1", 1 / 10),
    ("Face Value Split From Rs 2 To Re 1", 1 / 2),
    ("Face Valus Split (Sub-Division) - From Rs 10/- Per To Rs 2/- Per Share", 2 / 10),
    ("Bonus 1:1/" + SPLIT_10_TO_2, 0.5 * 0.2),
    ("Bonus 1:1 / Face Value Split - From Rs 10/- Per Share To Rs 5/- Per Share", 0.5 * 0.5),
    ("Bonus 4:1/Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 5/- Per Share",
     0.2 * 0.5),
    ("Interim Dividend - Rs 1.50/- Per Share / Face Value Split - From Rs 10/- Per Share "
     "To Rs 5/- Per Share (Purpose Revised)", 0.5),
    ("Scheme Of Arrangement - Bonus Debentures 1:1", None),
    ("Scheme Of Arangement- Bonus - 1 Debenture For 1 Equity Share Held", None),
    ("Demerger", None),
    ("Merger/Demerger", None),
    ("Scheme Of Demerger", None),
    ("Scheme Of Arrangement In The Nature Of Demerger", None),
    ("Interim Dividend - Rs 6 Per Share", None),
    ("Annual General Meeting", None),
    ("", None),
    (None, None),
]


def test_subject_lines(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(GOLDEN)], "i int, s string")
    got = {r["i"]: r["m"] for r in df.select("i", action_multiplier(F.col("s")).alias("m")).collect()}
    for i, (subject, expected) in enumerate(GOLDEN):
        if expected is None:
            assert got[i] is None, subject
        else:
            assert got[i] == pytest.approx(expected), subject


def test_review_queue_holds_named_but_unreadable_events(spark):
    rows = [("A", "A", s, day(1), t) for s, t in [
        ("EQ", "Bonus issue"), ("EQ", "Consolidation From Re 1 To Rs 10"), ("EQ", "Bonus 1:1"),
        ("EQ", "Interim Dividend - Rs 6 Per Share"), ("BE", "Bonus issue")]]
    got = unparsed_actions(spark.createDataFrame(rows, ACTIONS))
    assert sorted(r["subject"] for r in got.collect()) == [
        "Bonus issue", "Consolidation From Re 1 To Rs 10"]


def _closes(df):
    return [r["close_adj"] for r in df.orderBy("date").collect()]


@pytest.mark.parametrize("apply", [apply_adjustment, apply_adjustment_scan])
def test_only_rows_before_the_ex_date_change(spark, apply):
    prices = bars(spark, [bar("A", day(i)) for i in range(20)])
    actions = spark.createDataFrame(
        [("A", "A", "EQ", day(5), "Bonus 1:1"), ("A", "A", "EQ", day(15), SPLIT_10_TO_2)], ACTIONS)
    got = _closes(apply(prices, adjustment_factors(actions)))
    assert got == pytest.approx([10.0] * 5 + [20.0] * 10 + [100.0] * 5)


@pytest.mark.parametrize("apply", [apply_adjustment, apply_adjustment_scan])
def test_actions_on_one_date_all_count(spark, apply):
    prices = bars(spark, [bar("A", day(i)) for i in range(4)])
    actions = spark.createDataFrame(
        [("A", "A", "EQ", day(2), "Bonus 1:1"), ("A", "A", "EQ", day(2), "Bonus 1:2"),
         ("A", "A", "BE", day(2), "Bonus 9:1")], ACTIONS)
    factors = adjustment_factors(actions)
    assert factors.count() == 1
    assert _closes(apply(prices, factors)) == pytest.approx([100 / 3, 100 / 3, 100, 100])


def test_interval_join_and_scan_match_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows = [bar(f"I{k}", day(d), close=rnd.uniform(1, 50)) for k in range(12) for d in range(0, 200, 3)]
    cuts = {(f"I{k}", day(rnd.randrange(210))): rnd.uniform(0.1, 1) for k in range(9) for _ in range(25)}
    factors = spark.createDataFrame(
        [(i, d, f) for (i, d), f in cuts.items()], "isin string, ex_date date, cum_factor double")
    prices = bars(spark, rows)
    a, b = apply_adjustment(prices, factors), apply_adjustment_scan(prices, factors)
    assert a.columns == b.columns and same_rows(a, b)
    for r in a.collect():
        later = sorted(d for i, d in cuts if i == r["isin"] and d > r["date"])
        want = cuts[(r["isin"], later[0])] if later else 1.0
        assert r["adj_factor"] == want and r["close_adj"] == r["close"] * want


def test_no_factors_keeps_prices_and_columns(spark):
    prices = bars(spark, [bar("A", dt.date(2020, 1, 1))])
    empty = spark.createDataFrame([], "isin string, ex_date date, cum_factor double")
    row = apply_adjustment(prices, empty).first()
    assert row["adj_factor"] == 1.0 and row["close_adj"] == row["close"]
    assert apply_adjustment(prices, empty).columns == apply_adjustment_scan(prices, empty).columns


def test_subjects_are_read_once_behind_the_only_exchange(spark):
    rows = [("A", "A", "EQ", day(i % 3), t) for i, t in enumerate(["Bonus 1:1", SPLIT_10_TO_2, "Demerger", "Bonus 1:1", None])]
    factors = adjustment_factors(spark.createDataFrame(rows, ACTIONS))
    plan = factors._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("regexp_extract") < plan.index("Exchange hashpartitioning")  # parents come first in the text
    assert {(r.ex_date, round(r.cum_factor, 9)) for r in factors.collect()} == {(day(0), 0.05), (day(1), 0.2)}
