"""Walk-forward fits without multiplying samples by folds.

A fold trains on everything whose label is known before its cutoff, so training sets are nested, and what a fit needs of
them can be counted once: as sums per label date, or as counts per value cell and slice of time between two cutoffs. Only
these small tables meet the folds. Each fit gives what it gives on rows multiplied by ``assign_splits``.
"""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barfold.operators.ranking import holding_cells, interpolated_quantiles, magnitude_bucket, missing
from barfold.operators.walkforward import (
    EMBARGO_DAYS, MIN_TEST, MIN_TRAIN, Fold, assign_splits, filter_split, training_cutoffs,
)
from barfold.schemas import QUANTILES, TARGET_COLUMN

#: Value cells per e-fold of size: about 200,000 in all, each with a few of every 10,000 returns.
CELLS_PER_E_FOLD = 4_096


def _folds_after(cutoffs: dict[str, dt.date], label_date: Column) -> Column:
    """Array of the folds that a label date is known in time for."""
    limits = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(d).alias("cutoff")) for f, d in cutoffs.items()])
    return F.transform(F.filter(limits, lambda m: label_date < m["cutoff"]), lambda m: F.struct(m["fold"].alias("fold")))


def fit_ar1_nested(samples: DataFrame, cutoffs: dict[str, dt.date], x: str = "ret_1", y: str = TARGET_COLUMN) -> DataFrame:
    """(fold, slope, intercept) from sums per label date; rows where either value is null or NaN do not count."""
    whole = samples.filter(~missing(F.col(x)) & ~missing(F.col(y)))
    daily = whole.groupBy("label_date").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"),
        F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"))
    sums = daily.select(F.inline(_folds_after(cutoffs, F.col("label_date"))), "n", "x", "y", "xx", "xy").groupBy("fold").agg(
        *[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "xy")])
    n = F.col("n")
    slope = F.try_divide(n * F.col("xy") - F.col("x") * F.col("y"), n * F.col("xx") - F.col("x") * F.col("x"))
    return sums.select("fold", slope.alias("slope"), ((F.col("y") - slope * F.col("x")) / n).alias("intercept"))


def fit_quantiles_nested(
    samples: DataFrame, cutoffs: dict[str, dt.date], y: str = TARGET_COLUMN, quantiles: Sequence[float] = QUANTILES
) -> DataFrame:
    """(fold, pred): exact interpolated quantiles of each fold's training labels; null and NaN labels do not count.

    One pass counts labels per value cell and slice of time. Summed up over a fold's slices the counts tell the few cells
    that hold its wanted positions; a second pass looks at the labels in those cells only.
    """
    ordered = sorted(set(cutoffs.values()))
    part = sum((F.when(F.col("label_date") >= F.lit(d), 1).otherwise(0) for d in ordered), F.lit(0))
    # A fold takes the slices up to its cutoff's place.
    folds = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(ordered.index(d)).alias("upto")) for f, d in cutoffs.items()])
    rows = samples.filter(~missing(F.col(y)) & F.col("label_date").isNotNull()).select(
        part.alias("_part"), magnitude_bucket(F.col(y), CELLS_PER_E_FOLD).alias("_cell"), F.col(y).cast("double").alias("_value"))
    counted = rows.groupBy("_part", "_cell").agg(F.count(F.lit(1)).alias("_count"))
    taken = counted.select("_part", "_cell", "_count", F.inline(folds)).filter(F.col("_part") <= F.col("upto"))
    cells = taken.groupBy("fold", "upto", "_cell").agg(F.sum("_count").alias("_count")).withColumns({
        "_start": F.lit(0), "_n": F.sum("_count").over(Window.partitionBy("fold"))})
    kept = holding_cells(cells, ["fold"], "_cell", quantiles).select(
        "fold", "upto", "_cell", "_n", F.col("_before").alias("_start"))
    # At most two cells per quantile and fold: the broadcast is bounded, and so is what it multiplies.
    near = rows.join(F.broadcast(kept), "_cell").filter(F.col("_part") <= F.col("upto")).groupBy(
        "fold", "_cell", "_n", "_start", "_value").agg(F.count(F.lit(1)).alias("_count"))
    return interpolated_quantiles(holding_cells(near, ["fold", "_cell"], "_value", quantiles), ["fold"], "_value", quantiles, "pred")


def _test_rows(samples: DataFrame, folds: Sequence[Fold], y: str, embargo: tuple, *extra: str) -> DataFrame:
    return filter_split(assign_splits(samples, folds, *embargo), "test").select(
        "fold", "isin", F.col("label_date").alias("date"), F.col(y).alias("actual"), *extra)


def walk_forward_ar1(
    samples: DataFrame, folds: Sequence[Fold], embargo_days: int = EMBARGO_DAYS, embargo_unit: str = "days",
    calendar: DataFrame | None = None, x: str = "ret_1", y: str = TARGET_COLUMN,
) -> DataFrame:
    """(fold, isin, date, pred, actual) on test rows, as ``fit_predict_ar1`` gives them; ``samples`` is read twice."""
    fitted = fit_ar1_nested(samples, training_cutoffs(folds, embargo_days, embargo_unit, calendar), x, y)
    rows = _test_rows(samples, folds, y, (embargo_days, embargo_unit, calendar), x)
    return rows.join(F.broadcast(fitted), "fold").select(  # one row per fold
        "fold", "isin", "date", (F.col("intercept") + F.col("slope") * F.col(x)).alias("pred"), "actual")


def walk_forward_quantiles(
    samples: DataFrame, folds: Sequence[Fold], embargo_days: int = EMBARGO_DAYS, embargo_unit: str = "days",
    calendar: DataFrame | None = None, y: str = TARGET_COLUMN, quantiles: Sequence[float] = QUANTILES,
) -> DataFrame:
    """(fold, isin, date, pred, actual) on test rows, as ``fit_predict_quantiles`` gives them; ``samples`` is read three times."""
    fitted = fit_quantiles_nested(samples, training_cutoffs(folds, embargo_days, embargo_unit, calendar), y, quantiles)
    rows = _test_rows(samples, folds, y, (embargo_days, embargo_unit, calendar))
    return rows.join(F.broadcast(fitted), "fold").select("fold", "isin", "date", "pred", "actual")  # one row per fold


def fold_counts_nested(
    samples: DataFrame, folds: Sequence[Fold], embargo_days: int = EMBARGO_DAYS, embargo_unit: str = "days",
    calendar: DataFrame | None = None, min_train: int = MIN_TRAIN, min_test: int = MIN_TEST,
) -> DataFrame:
    """``fold_counts`` from one count per pair of dates: the pairs are assigned to folds, not the samples."""
    pairs = samples.groupBy("feature_end_date", "label_date").agg(F.count(F.lit(1)).alias("n"))
    sizes = assign_splits(pairs, folds, embargo_days, embargo_unit, calendar).groupBy("fold").agg(*[
        F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}") for s in ("train", "test")])
    return sizes.withColumn("usable", (F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))
