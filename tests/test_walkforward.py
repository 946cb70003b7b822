import datetime as dt
import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from barfold.operators.features import compute_features
from barfold.operators.metrics import overall_net_sharpe, backtest_rows
from barfold.operators.samples import sample_index
from barfold.operators.signals import (
    fit_ar1, fit_predict_ar1, fit_predict_quantiles, score_panels, score_panels_by,
)
from barfold.operators.walkforward import (
    Fold, assert_no_leakage, assign_splits, filter_split, fold_counts, folds_frame,
    guarded, leakage_guard, pending_folds, session_cutoffs, shuffle_labels, yearly_folds,
)
from barfold.plans import evaluation
from barfold.plans.evaluation import median_forecasts, run_evaluation
from barfold.plans.fingerprint import digest
from tests.helpers import adjusted, weekdays

FOLD = Fold("t", dt.date(2016, 6, 1), dt.date(2016, 12, 31))


@pytest.fixture(scope="module")
def linear(spark):
    dates = weekdays(500, dt.date(2015, 1, 1))
    return adjusted(spark, {"A": [(d, 100 + 0.1 * i) for i, d in enumerate(dates)]})


@pytest.fixture(scope="module")
def samples(linear):
    return sample_index(compute_features(linear), 10, keep=["ret_1", "fwd_ret_1"]).cache()


def test_splits_respect_embargo_and_fold(samples):
    rows = assign_splits(samples, [FOLD], embargo_days=15).cache()
    train, test = filter_split(rows, "train"), filter_split(rows, "test")
    assert train.count() > 0 and test.count() > 0
    assert train.filter(F.col("label_date") >= F.lit(dt.date(2016, 5, 17))).isEmpty()
    assert test.filter((F.col("feature_end_date") < F.lit(FOLD.test_start))
                       | (F.col("label_date") > F.lit(FOLD.test_end))).isEmpty()
    assert rows.groupBy("isin", "feature_end_date").count().filter("count > 1").isEmpty()
    assert rows.count() < samples.count()  # the embargo gap is in neither


def test_guard_is_independent(spark, samples):
    train = filter_split(assign_splits(samples, [FOLD], embargo_days=15), "train")
    assert_no_leakage(train, [FOLD], embargo_days=15)
    bad = train.limit(1).withColumn("label_date", F.lit(dt.date(2016, 5, 31)))
    assert leakage_guard(bad, [FOLD], 15).count() == 1
    with pytest.raises(AssertionError, match="leakage"):
        assert_no_leakage(train.unionByName(bad), [FOLD], embargo_days=15)


def test_session_embargo(spark, samples, linear):
    cut = session_cutoffs(linear, [FOLD], 10)["t"]
    assert cut == sorted(d for d in weekdays(500, dt.date(2015, 1, 1)) if d < FOLD.test_start)[-10]
    rows = filter_split(assign_splits(samples, [FOLD], 10, "sessions", linear), "train")
    assert rows.agg(F.max("label_date")).first()[0] < cut
    with pytest.raises(ValueError):
        assign_splits(samples, [FOLD], 10, "weeks")


def test_folds(spark, samples):
    folds = yearly_folds([2015, 2016])
    assert folds[1] == Fold("2016", dt.date(2016, 1, 1), dt.date(2016, 12, 31))
    counts = {r["fold"]: r for r in fold_counts(assign_splits(samples, folds), 100, 100).collect()}
    assert not counts["2015"]["usable"] and counts["2016"]["usable"]
    done = spark.createDataFrame([("2015", 1), ("2015", 2)], "fold string, x int")
    assert [r["fold"] for r in pending_folds(folds_frame(spark, folds), done).collect()] == ["2016"]


def test_quantile_fit_modes(spark):
    rows = [("f", "train", "A", dt.date(2020, 1, 1), 0.0, float(v)) for v in range(101)]
    rows += [("f", "test", "A", dt.date(2021, 1, 1), 0.0, 1.0)]
    df = spark.createDataFrame(rows, "fold string, split string, isin string, label_date date, ret_1 double, fwd_ret_1 double")
    for approximate in (False, True):
        got = fit_predict_quantiles(df, approximate=approximate).first()["pred"]
        assert got == pytest.approx([10.0 * i for i in range(1, 10)])


def test_panel_scores_native_and_python_agree(spark):
    rows = [("f", f"N{i}", dt.date(2020, 1, d), float(i * i % 7)) for d in (1, 2, 3) for i in range(6)]
    df = spark.createDataFrame(rows, "fold string, isin string, date date, ret_1 double")
    native = score_panels(df, {"_m": F.avg("ret_1"), "_s": F.stddev_samp("ret_1")},
                          (F.col("ret_1") - F.col("_m")) / F.col("_s"))
    python = score_panels_by(df, {"_m": F.avg("ret_1"), "_s": F.stddev_samp("ret_1")},
                             lambda x, m, sd: (x - m) / sd, ["ret_1", "_m", "_s"])
    a = {(r["isin"], r["date"]): r["pred"] for r in native.collect()}
    b = {(r["isin"], r["date"]): r["pred"] for r in python.collect()}
    assert a == pytest.approx(b) and len(a) == 18


def test_guard_fails_closed(spark):
    folds = [Fold("2020", dt.date(2020, 1, 1), dt.date(2020, 12, 31))]
    rows = [("2020", dt.date(2019, 12, 1)), ("2020", dt.date(2019, 12, 28)), ("2020", None), ("1066", dt.date(2000, 1, 1)),
            (None, dt.date(2000, 1, 1))]
    train = spark.createDataFrame(rows, "fold string, label_date date")
    assert leakage_guard(train, folds).count() == 4
    calendar = spark.createDataFrame([(dt.date(2019, 12, d),) for d in (1, 20, 27, 28, 30)], "date date")
    found = leakage_guard(train, folds, 2, embargo_unit="sessions", calendar=calendar).filter("fold = '2020'")
    assert {r.embargo_cutoff for r in found.collect()} == {dt.date(2019, 12, 28)}


# ---- statistical controls over autocorrelated returns, 8 names x 320 days

@pytest.fixture(scope="module")
def ar_samples(spark):
    rng = np.random.default_rng(0)
    dates = weekdays(320, dt.date(2018, 1, 1))
    series = {}
    for k in range(8):
        r, prev = [], 0.0
        for _ in dates:
            prev = 0.6 * prev + rng.normal(0, 0.01)
            r.append(prev)
        series[f"K{k}"] = list(zip(dates, 100 * np.exp(np.cumsum(r)).astype(float).tolist()))
        series[f"K{k}"] = [(d, float(c)) for d, c in series[f"K{k}"]]
    prices = adjusted(spark, series)
    return prices, sample_index(compute_features(prices), 20, keep=["ret_1", "fwd_ret_1"]).cache()


CONTROL = [Fold("c", dt.date(2018, 10, 1), dt.date(2019, 12, 31))]


def _net_sharpe(samples, target):
    assigned = assign_splits(samples, CONTROL)
    book = backtest_rows(fit_predict_ar1(assigned, y=target))
    return overall_net_sharpe(book).first()["overall_net_sharpe"]


def test_real_structure_is_found(ar_samples):
    prices, samples = ar_samples
    assert _net_sharpe(samples, "fwd_ret_1") > 1
    slope = fit_ar1(assign_splits(samples, CONTROL)).first()["slope"]
    assert 0.4 < slope < 0.8


def test_shuffled_labels_destroy_it(ar_samples):
    _, samples = ar_samples
    shuffled = shuffle_labels(samples, seed=1).cache()
    assert shuffled.count() == samples.count()
    a = sorted(r[0] for r in samples.select("fwd_ret_1").collect())
    b = sorted(r[0] for r in shuffled.select("shuffled_target").collect())
    assert a == b
    assert shuffled.filter("fwd_ret_1 <> shuffled_target").count() > 0.9 * samples.count()
    assert abs(_net_sharpe(shuffled, "shuffled_target")) < 2.5


def test_whole_evaluation(ar_samples, spark, tmp_path):
    prices, _ = ar_samples
    root = str(tmp_path / "run")
    row = run_evaluation(prices, CONTROL, root, seq_len=20).first()
    assert row["fold"] == "c" and row["mean_ic"] > 0.2 and row["gate_pass"]
    assert row["n"] > 200 and row["net_sharpe"] > 1
    assert spark.read.json(f"{root}/report").first()["fold"] == "c"
    few = spark.createDataFrame([("K1",), ("K2",), ("K3",), ("K4",)], "isin string")
    part = run_evaluation(prices, CONTROL, str(tmp_path / "few"), seq_len=20, universe=few, forecasts=median_forecasts).first()
    assert 0 < part["n"] < row["n"] and part["mean_ic"] is None


def test_leaking_rows_stop_a_run(ar_samples):
    _, samples = ar_samples
    with pytest.raises(AssertionError, match="leakage"):
        assert_no_leakage(filter_split(assign_splits(samples, CONTROL, 0), "train"), CONTROL, embargo_days=10)


def test_gaps_do_not_reach_the_fits(spark):
    nan = float("nan")
    rows = [("f", "train", "A", dt.date(2020, 1, 1), x, y) for x, y in zip(
        [0.1, 0.2, 0.3, 0.4, nan, 0.2, None], [1.0, 2.0, 3.0, 4.0, 9.0, nan, 5.0])]
    rows += [("f", "test", "A", dt.date(2021, 1, 1), 0.5, 1.0)]
    df = spark.createDataFrame(rows, "fold string, split string, isin string, label_date date, ret_1 double, fwd_ret_1 double")
    fitted = fit_ar1(df).first()
    assert (fitted.slope, fitted.intercept) == (pytest.approx(10.0), pytest.approx(0.0))
    known = [1.0, 2.0, 3.0, 4.0, 5.0, 9.0]
    for approximate in (False, True):
        got = fit_predict_quantiles(df, quantiles=(0.0, 0.5, 1.0), approximate=approximate).first()["pred"]
        assert got == pytest.approx([1.0, np.median(known) if not approximate else 3.0, 9.0])


# ---- stored folds: reused only for the same inputs

def _scores(report):
    return sorted(tuple(r) for r in report.collect())


def _files(root):
    return sorted((p.relative_to(root).as_posix(), p.stat().st_mtime_ns) for p in root.glob("folds/**/*.parquet"))


def test_stored_folds_are_reused_only_for_the_same_inputs(ar_samples, tmp_path, monkeypatch):
    prices, _ = ar_samples
    prices = prices.cache()
    root = tmp_path / "run"

    def run(**changed):
        given = {"seq_len": 20} | changed
        return _scores(run_evaluation(changed.pop("prices", prices), given.pop("folds", CONTROL), str(root), **{k: v for k, v in given.items() if k != "prices"}))

    first = run()
    stored = _files(root)
    assert run() == first and _files(root) == stored  # nothing was written again
    changes = [
        {"seq_len": 60}, {"forecasts": median_forecasts}, {"prices": prices.filter("isin <> 'K1'")},
        {"folds": [Fold("c", dt.date(2018, 10, 1), dt.date(2018, 12, 31))]},
    ]
    for n, change in enumerate(changes, 2):
        assert len(run(**change)) == 1
        assert len(_files(root)) == n  # a result of its own for each
    assert run(seq_len=60) != first and run(forecasts=median_forecasts) != first
    fresh = _scores(run_evaluation(prices, CONTROL, str(tmp_path / "fresh"), seq_len=60, forecasts=median_forecasts, book="pooled"))
    assert run(seq_len=60, forecasts=median_forecasts, book="pooled") == fresh


def test_forecasts_are_told_apart_by_their_code():
    def scaled(k):
        return lambda df: df.withColumn("pred", F.col("pred") * k)

    assert digest(scaled(1)) == digest(scaled(1)) != digest(scaled(2))
    assert digest(functools.partial(max, key=len)) != digest(functools.partial(max, key=abs))


def test_a_run_that_breaks_off_leaves_no_fold_twice(ar_samples, tmp_path, monkeypatch):
    prices, _ = ar_samples
    folds = [Fold("a", dt.date(2018, 7, 1), dt.date(2018, 9, 30)), CONTROL[0], Fold("late", dt.date(2030, 1, 1), dt.date(2030, 12, 31))]
    root = tmp_path / "run"

    def broken(*_):
        raise OSError("no space left")

    monkeypatch.setattr(evaluation, "write_report", broken)
    with pytest.raises(OSError):
        run_evaluation(prices, folds[:1], str(root), seq_len=20)
    stored = _files(root)
    monkeypatch.undo()
    report = run_evaluation(prices, folds, str(root), seq_len=20)
    assert sorted(r.fold for r in report.collect()) == ["a", "c"]  # the fold without samples has no scores
    assert set(stored) <= set(_files(root)) and len(_files(root)) == 3
    again = _files(root)
    run_evaluation(prices, folds, str(root), seq_len=20)
    assert _files(root) == again  # the empty fold is not tried again either
    # Two runs of the same fold at once: the later one replaces the earlier one's partition.
    run = next(p.name.removeprefix("run=") for p in (root / "folds").glob("run=*"))
    results = evaluation.stored_folds(prices.sparkSession, str(root), run).filter("fold like 'a@%'").cache()
    name = results.first()["fold"]
    evaluation.store_folds(results, [Fold(name, folds[0].test_start, folds[0].test_end)], str(root), run)
    assert evaluation.stored_folds(prices.sparkSession, str(root), run).groupBy("fold").count().filter("count > 1").isEmpty()


def test_panel_run_purges_by_the_date_a_target_is_known(ar_samples, tmp_path):
    """K0 skips the days around the cutoff: its last targets before the gap are known long after their panels' label dates."""
    prices, _ = ar_samples
    gap = (F.col("isin") == "K0") & F.col("date").between("2018-09-10", "2018-11-15")
    prices = prices.filter(~gap).cache()
    universe = prices.select("isin").distinct()
    rows = evaluation.labelled_panels(prices, universe, 20).cache()
    late = rows.filter("isin = 'K0' and label_date < '2018-09-21' and target_date > '2018-11-01'")
    assert late.count() == 1
    plain, purged = (filter_split(assign_splits(rows, CONTROL, realized_column=c), "train") for c in (None, "target_date"))
    assert plain.exceptAll(purged).select("isin").collect() == late.select("isin").collect()
    with pytest.raises(AssertionError, match="leakage"):
        assert_no_leakage(plain, CONTROL, realized_column="target_date")
    report = run_evaluation(prices, CONTROL, str(tmp_path / "p"), seq_len=20, universe=universe, panels=True).first()
    assert report["mean_ic"] > 0.2 and report["n"] > 200
    with pytest.raises(ValueError, match="universe"):
        run_evaluation(prices, CONTROL, str(tmp_path / "p"), panels=True)


def test_the_guard_in_the_plan_stops_a_fit_without_a_job_of_its_own(spark, ar_samples):
    _, samples = ar_samples
    clean = assign_splits(samples, CONTROL)
    assert guarded(clean, CONTROL).exceptAll(clean).isEmpty() and guarded(clean, CONTROL).count() == clean.count()
    plan = fit_ar1(guarded(clean, CONTROL))._jdf.queryExecution().executedPlan().toString()
    assert "raise_error" in plan and plan.count("InMemoryTableScan") == 1
    for leaking in (assign_splits(samples, CONTROL, 0), clean.withColumn("fold", F.lit("unknown")),
                    clean.withColumn("label_date", F.lit(None).cast("date")), clean.withColumn("split", F.lit(None).cast("string"))):
        if leaking.filter("split = 'train' or split is null").isEmpty():
            continue
        with pytest.raises(Exception, match="leakage: "):
            filter_split(guarded(leaking, CONTROL), "train").agg(F.sum("ret_1")).collect()
    with pytest.raises(Exception, match="leakage: "):
        fit_predict_ar1(guarded(assign_splits(samples, CONTROL, 0), CONTROL)).collect()
