"""Functions of whole panels, streamed, and rolling statistics."""

import datetime as dt

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from barfold.operators.features import compute_features, volume_baseline
from barfold.operators.panels import score_whole_panels
from barfold.operators.rolling import RollingDeviation, RollingMedian
from tests.helpers import adjusted, weekdays


def _softmax_summary(key, batches):
    top, total = -np.inf, 0.0
    for batch in batches:
        x = batch.column("x").to_numpy()
        high = max(top, x.max())
        total, top = total * np.exp(top - high) + np.exp(x - high).sum(), high
    return top, total


def _softmax(key, summary, batches):
    for batch in batches:
        yield np.exp(batch.column("x").to_numpy() - summary[0]) / summary[1]


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _rows(spark, sizes):
    panels = spark.createDataFrame([(dt.date(2020, 1, d), n) for d, n in enumerate(sizes, 1)], "date date, n int")
    names = panels.select("date", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    return names.select("date", F.format_string("N%07d", "i").alias("isin"), (F.pmod(F.xxhash64("date", "i"), F.lit(1000)) / 100.0).alias("x"))


def test_every_score_sees_its_whole_panel(spark, small_batches):
    rows = _rows(spark, [3, 1, 1200, 499, 500, 501])
    got = score_whole_panels(rows, _softmax, ["date"], summarize=_softmax_summary).toPandas()
    assert len(got) == rows.count()
    for _, panel in got.groupby("date"):
        want = np.exp(panel.x - panel.x.max())
        assert np.allclose(panel.pred, want / want.sum()) and panel.pred.sum() == pytest.approx(1)


def test_order_and_reading_ahead(spark, small_batches):
    """Ranks over rows that come sorted; a function that asks for all batches before it answers."""
    rows = _rows(spark, [700, 40, 1501])

    def place(key, summary, batches):
        seen = 0
        for batch in batches:
            yield np.arange(seen, seen + batch.num_rows, dtype=float)
            seen += batch.num_rows

    def gathered(key, summary, batches):
        held = [b.column("x").to_numpy() for b in batches]
        mean = np.concatenate(held).mean()
        yield from (x - mean for x in held)

    ranked = score_whole_panels(rows, place, ["date"], order=[F.desc("x"), "isin"]).toPandas()
    for _, panel in ranked.groupby("date"):
        assert panel.sort_values("pred").x.is_monotonic_decreasing and sorted(panel.pred) == list(range(len(panel)))
    centred = score_whole_panels(rows, gathered, ["date"]).groupBy("date").agg(F.sum("pred").alias("s")).collect()
    assert all(abs(r.s) < 1e-8 for r in centred)


def test_one_shuffle_and_no_further_sort(spark):
    plan = score_whole_panels(_rows(spark, [5]), _softmax, ["date"], summarize=_softmax_summary)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_memory_does_not_follow_the_largest_panel(spark):
    """A panel 100 times the median: batches stay small and the worker's memory flat."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    try:
        rows = _rows(spark, [4000] * 9 + [400_000]).withColumn("weight", F.array_repeat(F.col("x"), 60))  # 200 MB in one panel

        def resident():
            with open("/proc/self/statm") as f:
                return int(f.read().split()[1]) * 4096 / 1e6

        def summary(key, batches):
            return sum(b.num_rows for b in batches)

        def grown(key, n, batches):
            start = peak = None
            for batch in batches:
                now = resident()
                start, peak = start or now, max(peak or now, now)
                yield np.full(batch.num_rows, peak - start if batch.num_rows <= 2000 else 1e9)

        got = score_whole_panels(rows, grown, ["date"], summarize=summary).groupBy("date").agg(F.max("pred").alias("mb"), F.count("*").alias("n"))
        largest = max(got.collect(), key=lambda r: r.n)
        assert largest.n == 400_000 and largest.mb < 60
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_of_every_kind(spark):
    rows = spark.createDataFrame([(None, "A", 1.0), (None, "B", 2.0), (dt.date(2020, 1, 1), "A", None)], "date date, isin string, x double")

    def score(key, summary, batches):
        for batch in batches:
            yield pc.add(batch.column("x"), 1.0) if key[0] is None else np.full(batch.num_rows, np.nan)

    got = {(r.date, r.isin): r.pred for r in score_whole_panels(rows, score, ["date"]).collect()}
    assert got == {(None, "A"): 2.0, (None, "B"): 3.0, (dt.date(2020, 1, 1), "A"): None}
    assert score_whole_panels(rows.limit(0), score, ["date"]).count() == 0
    with pytest.raises(ValueError, match="in use"):
        score_whole_panels(rows.withColumn("pred", F.lit(1)), score, ["date"])
    for wrong in (lambda k, s, b: iter(()), lambda k, s, b: (np.zeros(9) for _ in b)):
        with pytest.raises(Exception, match="scores"):
            score_whole_panels(rows, wrong, ["date"]).collect()


# ---- rolling statistics

def _plain(values, window, least):
    out = []
    for i in range(len(values)):
        own = values[max(0, i - window + 1) : i + 1]
        own = own[~np.isnan(own)]
        out.append((np.median(own) if len(own) >= least else np.nan, own.std(ddof=1) if len(own) >= max(least, 2) else np.nan))
    return np.array(out)


@pytest.mark.parametrize("window,least", [(1, 1), (7, 2), (252, 63)])
def test_rolling_statistics_in_pieces(window, least):
    rng = np.random.default_rng(window)
    values = np.concatenate([rng.normal(9, 1, 900), np.full(400, 3.25), rng.integers(0, 3, 500).astype(float)])
    values[rng.random(len(values)) < 0.1] = np.nan
    want = _plain(values, window, least)
    median, deviation = RollingMedian(window, least), RollingDeviation(window, least)
    cuts = np.split(values, [0, 1, 5, 700, 701, 1500])
    assert np.allclose(np.concatenate([median.of(c) for c in cuts]), want[:, 0], equal_nan=True, atol=1e-12)
    assert np.allclose(np.concatenate([deviation.of(c) for c in cuts]), want[:, 1], equal_nan=True, atol=1e-12)


def test_volume_baseline_streams_each_security(spark, small_batches):
    dates = weekdays(900, dt.date(2015, 1, 1))
    prices = adjusted(spark, {k: [(d, 100.0) for d in dates[:n]] for k, n in (("A", 900), ("B", 70), ("C", 1))})
    prices = prices.withColumn("volume", F.when(F.col("close_adj") > 0, F.pmod(F.xxhash64("isin", "date"), F.lit(10_000)).cast("double")))
    prices = prices.withColumn("volume", F.when(F.dayofmonth("date") != 3, F.col("volume")))
    got = volume_baseline(prices.repartition(3)).toPandas().sort_values(["isin", "date"])
    for _, own in got.groupby("isin"):
        want = _plain(own.log_vol.to_numpy(dtype=float), 252, 63)
        assert np.allclose(own.log_vol_baseline.to_numpy(dtype=float), want[:, 0], equal_nan=True)
        assert np.allclose(own.log_vol_std.to_numpy(dtype=float), want[:, 1], equal_nan=True)
    assert len(got) == 971


def test_features_need_one_exchange_and_one_sort(spark):
    prices = adjusted(spark, {"A": [(d, 100.0) for d in weekdays(5, dt.date(2015, 1, 1))]})
    plan = compute_features(prices)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert compute_features(prices).columns[-2:] == ["fwd_ret_1", "has_sufficient_history"]
