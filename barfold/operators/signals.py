"""Baseline forecasts fitted on training rows and applied to test rows."""

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barfold.operators.ranking import exact_quantiles, missing
from barfold.operators.walkforward import filter_split
from barfold.schemas import QUANTILES, TARGET_COLUMN

def fit_ar1(assigned: DataFrame, x: str = "ret_1", y: str = TARGET_COLUMN) -> DataFrame:
    """(fold, slope, intercept) of the next return on the current one; rows where either is null or NaN do not count."""
    whole = filter_split(assigned, "train").filter(~missing(F.col(x)) & ~missing(F.col(y)))
    return whole.groupBy("fold").agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def _test_rows(assigned: DataFrame, y: str, *extra: str) -> DataFrame:
    return filter_split(assigned, "test").select(
        "fold", "isin", F.col("label_date").alias("date"), F.col(y).alias("actual"), *extra)


def fit_predict_ar1(assigned: DataFrame, x: str = "ret_1", y: str = TARGET_COLUMN) -> DataFrame:
    """(fold, isin, date, pred, actual) on test rows.

    The fit is one partially aggregated pass; its result has one row per fold,
    which is what makes broadcasting it safe.
    """
    fitted = F.broadcast(fit_ar1(assigned, x, y))
    return _test_rows(assigned, y, x).join(fitted, "fold").select(
        "fold", "isin", "date",
        (F.col("intercept") + F.col("slope") * F.col(x)).alias("pred"), "actual")


def fit_predict_quantiles(
    assigned: DataFrame,
    y: str = TARGET_COLUMN,
    quantiles: Sequence[float] = QUANTILES,
    approximate: bool = False,
) -> DataFrame:
    """Training quantiles of the label as the (unconditional) forecast array."""
    train = filter_split(assigned, "train").select("fold", y).filter(~missing(F.col(y)))
    if approximate:
        fitted = train.groupBy("fold").agg(
            F.percentile_approx(y, [float(q) for q in quantiles], 100_000).alias("pred"))
    else:
        fitted = exact_quantiles(train, ["fold"], y, quantiles, "pred")
    return _test_rows(assigned, y).join(F.broadcast(fitted), "fold").select(
        "fold", "isin", "date", "pred", "actual")


def median_forecast(quantile_preds: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Point forecasts from quantile ones: the 0.5 quantile as ``pred``."""
    return quantile_preds.withColumn("pred", F.col("pred")[list(quantiles).index(0.5)])


def score_panels(
    rows: DataFrame,
    statistics: dict[str, Column],
    score: Column,
    by: Sequence[str] = ("fold", "date"),
    out: str = "pred",
) -> DataFrame:
    """Score every name against its whole panel.

    ``statistics`` are aggregates over the panel, ``score`` an expression over
    the row and those aggregates. The panel itself is never gathered: its
    statistics are combined on the map side and joined back.
    """
    keys = list(by)
    panel = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in statistics.items()])
    return rows.join(panel, keys).select(*rows.columns, score.alias(out))


def score_panels_by(
    rows: DataFrame,
    statistics: dict[str, Column],
    fn: Callable[..., pd.Series],
    columns: Sequence[str],
    by: Sequence[str] = ("fold", "date"),
    out: str = "pred",
) -> DataFrame:
    """``score_panels`` with a Python function (a trained model, say) in the expression's place.

    ``fn`` gets ``columns`` (of the row or of ``statistics``) as series of any rows, in batches, and
    returns their scores. What a score needs of the rest of its panel comes as a statistic, so
    panels of any size are scored without gathering one.
    """
    scorer = F.pandas_udf(lambda *values: fn(*values), "double")
    return score_panels(rows, statistics, scorer(*columns), by, out)
