"""Fits from nested counts against the same fits on multiplied rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barfold.operators import nested
from barfold.operators.signals import fit_ar1, fit_predict_ar1, fit_predict_quantiles
from barfold.operators.walkforward import Fold, assign_splits, fold_counts, training_cutoffs, yearly_folds
from tests.helpers import same_rows

FOLDS = [*yearly_folds([2016, 2017, 2018]), Fold("2017b", dt.date(2017, 1, 1), dt.date(2017, 6, 30)), Fold("empty", dt.date(2010, 1, 1), dt.date(2010, 12, 31))]


@pytest.fixture(scope="module")
def samples(spark):
    """Four years of two dozen names; a third of all labels are one value, some are NaN or null, and one day holds a third of the rows."""
    rnd = random.Random(3)
    rows = []
    for i in range(6000):
        day = dt.date(2015, 1, 1) + dt.timedelta(days=700 if i % 3 == 0 else rnd.randrange(1400))
        x = rnd.gauss(0, 0.02)
        y = 0.0 if i % 3 == 1 else rnd.choice([0.3 * x + rnd.gauss(0, 0.01), round(rnd.gauss(0, 0.02), 2)])
        x, y = (None if i % 97 == 5 else x), (float("nan") if i % 101 == 7 else None if i % 103 == 8 else y)
        rows.append((f"N{i % 24}", day, day + dt.timedelta(days=1), x, y))
    return spark.createDataFrame(rows, "isin string, feature_end_date date, label_date date, ret_1 double, fwd_ret_1 double").cache()


def test_ar1(samples):
    want = {r.fold: r for r in fit_ar1(assign_splits(samples, FOLDS)).collect()}
    got = {r.fold: r for r in nested.fit_ar1_nested(samples, training_cutoffs(FOLDS)).collect()}
    assert got.keys() == want.keys() and "empty" not in got
    for f, r in got.items():
        assert r.slope == pytest.approx(want[f].slope, abs=1e-9) and r.intercept == pytest.approx(want[f].intercept, abs=1e-9)
    keys = ("fold", "isin", "date", "actual")
    a, b = (df.filter("actual = actual").orderBy(*keys, "pred").toPandas() for df in (
        fit_predict_ar1(assign_splits(samples, FOLDS)), nested.walk_forward_ar1(samples, FOLDS)))
    assert len(a) == len(b) and np.allclose(a.pred.fillna(9), b.pred.fillna(9), atol=1e-9)


def test_quantiles(samples):
    pdf = samples.filter("fwd_ret_1 is not null and not isnan(fwd_ret_1)").toPandas()
    probs = (0.0, 0.1, 0.5, 0.77, 1.0)
    got = {r.fold: r.pred for r in nested.fit_quantiles_nested(samples, training_cutoffs(FOLDS), quantiles=probs).collect()}
    assert got.keys() == {"2016", "2017", "2017b", "2018"}
    for f, cutoff in training_cutoffs(FOLDS).items():
        if f in got:
            assert got[f] == pytest.approx(list(np.quantile(pdf.fwd_ret_1[pdf.label_date < cutoff], probs)), abs=1e-15)
    a, b = fit_predict_quantiles(assign_splits(samples, FOLDS)), nested.walk_forward_quantiles(samples, FOLDS)
    rounded = lambda df: df.select("fold", "isin", "date", F.nanvl("actual", F.lit(9.0)).alias("actual"), F.transform("pred", lambda q: F.round(q, 12)).alias("pred"))
    assert same_rows(rounded(a), rounded(b))


def test_counts(samples):
    assert same_rows(fold_counts(assign_splits(samples, FOLDS), 900, 300), nested.fold_counts_nested(samples, FOLDS, min_train=900, min_test=300))
    calendar = samples.select(F.col("label_date").alias("date")).distinct()
    assert same_rows(
        fold_counts(assign_splits(samples, FOLDS, 5, "sessions", calendar)), nested.fold_counts_nested(samples, FOLDS, 5, "sessions", calendar))


def test_the_fit_reads_each_sample_once_or_twice_and_multiplies_none(spark, samples, tmp_path):
    samples.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    many = [Fold(str(i), dt.date(2015, 6, 1) + dt.timedelta(days=i), dt.date(2018, 1, 1)) for i in range(200)]
    for fit, scans in ((nested.fit_ar1_nested, 1), (nested.fit_quantiles_nested, 2)):
        df = fit(stored, training_cutoffs(many))
        assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == scans
        assert df.count() == 200


def test_no_rows(samples):
    none = samples.limit(0)
    for df in (nested.walk_forward_ar1(none, FOLDS), nested.walk_forward_quantiles(none, FOLDS), nested.fold_counts_nested(none, FOLDS)):
        assert df.count() == 0
