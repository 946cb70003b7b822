"""Forecast scoring: rank IC, Sharpe, sign backtest and losses.

Every function takes prediction rows (fold, isin, date, pred, actual) and the
grouping columns; all reductions are partial aggregates.
"""

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barfold.functions.arrays import array_mean, pinball_terms, quantiles_cross
from barfold.functions.scalars import hit_share, sharpe, signum_deadzone
from barfold.operators.ranking import ISIN_PREFIX, average_ranks, missing
from barfold.schemas import QUANTILES

TRADING_DAYS = 252
COST_BPS = 10.0
MIN_NAMES = 3
IC_THRESHOLD = 0.02


def sharpe_ratio(
    rows: DataFrame, returns: str, by: Sequence[str] = (), periods_per_year: int = TRADING_DAYS
) -> DataFrame:
    return rows.groupBy(*by).agg(sharpe(F.col(returns), periods_per_year).alias("sharpe"))


def hit_rate(preds: DataFrame, by: Sequence[str] = (), deadzone: float = 0.0) -> DataFrame:
    return preds.groupBy(*by).agg(
        hit_share(F.col("pred"), F.col("actual"), deadzone).alias("hit_rate"))


def _previous_position(rows: DataFrame, keys: list[str], book: str) -> DataFrame:
    by_date = Window.partitionBy(*keys, "isin").orderBy("date")
    if book == "per_symbol":
        return rows.withColumn(
            "prev_position", F.lag("position", 1, 0.0).over(by_date))
    if book != "pooled":
        raise ValueError(f"unknown book {book!r}")
    # One continuous book in (isin, date) order: a security opens with the closing
    # position of the security before it. That predecessor is looked up on
    # per-security rows, first inside an isin-prefix bucket, then across buckets.
    closing = rows.groupBy(*keys, "isin").agg(F.max_by("position", "date").alias("_close"))
    closing = closing.withColumn("_bucket", F.substring("isin", 1, ISIN_PREFIX))
    bucket_close = closing.groupBy(*keys, "_bucket").agg(
        F.max_by("_close", "isin").alias("_close"))
    carried = bucket_close.select(
        *keys, "_bucket",
        F.lag("_close", 1, 0.0).over(
            Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry"))
    opening = (
        closing.withColumn("_own", F.lag("_close").over(
            Window.partitionBy(*keys, "_bucket").orderBy("isin")))
        .join(carried, [*keys, "_bucket"])
        .select(*keys, "isin", F.coalesce("_own", "_carry").alias("_open"))
    )
    return (
        rows.withColumn("_lag", F.lag("position").over(by_date))
        .join(opening, [*keys, "isin"])
        .withColumn("prev_position", F.coalesce("_lag", "_open"))
        .drop("_lag", "_open")
    )


def backtest_rows(
    preds: DataFrame,
    by: Sequence[str] = ("fold",),
    cost_bps: float = COST_BPS,
    deadzone: float = 0.0,
    book: str = "per_symbol",
) -> DataFrame:
    """Position, turnover, gross, cost and net result of the sign policy per row."""
    rows = preds.withColumn("position", signum_deadzone(F.col("pred"), deadzone))
    return (
        _previous_position(rows, list(by), book)
        .withColumn("turnover", F.abs(F.col("position") - F.col("prev_position")))
        .withColumn("gross_pnl", F.col("position") * F.col("actual"))
        .withColumn("cost", F.col("turnover") * (cost_bps / 1e4))
        .withColumn("net_pnl", F.col("gross_pnl") - F.col("cost"))
    )


def sign_backtest(
    preds: DataFrame,
    by: Sequence[str] = ("fold",),
    cost_bps: float = COST_BPS,
    deadzone: float = 0.0,
    book: str = "per_symbol",
) -> DataFrame:
    rows = backtest_rows(preds, by, cost_bps, deadzone, book)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        sharpe(F.col("gross_pnl")).alias("gross_sharpe"),
        sharpe(F.col("net_pnl")).alias("net_sharpe"),
        hit_share(F.col("pred"), F.col("actual"), deadzone).alias("hit_rate"),
        F.avg(F.abs("position")).alias("mean_abs_position"),
        F.avg("turnover").alias("avg_turnover_per_day"),
    )


def overall_net_sharpe(backtest: DataFrame) -> DataFrame:
    """Net results of all folds as one series of (name, day) rows."""
    mean, spread = F.avg("net_pnl"), F.stddev_samp("net_pnl")
    return backtest.agg(
        (F.lit(math.sqrt(TRADING_DAYS)) * mean / (spread + 1e-12)).alias("overall_net_sharpe"),
        F.count("net_pnl").alias("n_rows"),
        mean.alias("mean_net_pnl"),
    )


def rank_ic_by_date(
    preds: DataFrame,
    by: Sequence[str] = ("fold", "date"),
    min_names: int = MIN_NAMES,
    keep_skipped: bool = False,
    incomplete: str = "skip",
) -> DataFrame:
    """Spearman correlation of forecast and outcome across each date's names.

    Dates with too few names or with a constant side have no IC; they are
    dropped, or kept with a null one if ``keep_skipped``. A null or NaN forecast or outcome
    makes its date incomplete: it has no IC, or with ``incomplete="drop_rows"`` the IC of the other
    names.
    """
    if incomplete not in ("skip", "drop_rows"):
        raise ValueError(f"unknown treatment of incomplete dates {incomplete!r}")
    keys = list(by)
    rows = preds.select(*keys, "pred", "actual")
    gap = missing(F.col("pred")) | missing(F.col("actual"))
    if incomplete == "drop_rows":
        rows = rows.filter(~gap)
    ranked = average_ranks(rows, keys, ["pred", "actual"])
    varies = (F.min("pred") < F.max("pred")) & (F.min("actual") < F.max("actual"))
    # Average ranks always sum to n(n+1)/2, so plain sums of products are enough. Ranks are
    # multiples of one half: the sums are exact and do not depend on the merge order.
    n = F.count(F.lit(1)).cast("double")
    centre = n * (n + 1) * (n + 1) / 4
    cross = F.sum(F.col("pred_rank") * F.col("actual_rank")) - centre
    own = [F.sum(F.col(c) * F.col(c)) - centre for c in ("pred_rank", "actual_rank")]
    ic = F.try_divide(cross, F.sqrt(own[0]) * F.sqrt(own[1]))
    scored = (F.count(F.lit(1)) >= min_names) & varies & (F.count_if(gap) == 0)
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_names"), F.when(scored, ic).alias("ic"))
    return out if keep_skipped else out.filter(F.col("ic").isNotNull())


def rank_ic_summary(
    preds: DataFrame,
    by: Sequence[str] = ("fold",),
    date: str = "date",
    min_names: int = MIN_NAMES,
) -> DataFrame:
    """Mean IC, IC-IR, share of positive days and number of scored days."""
    daily = rank_ic_by_date(preds, [*by, date], min_names, keep_skipped=True)
    return summarize_ic(daily, by)


def summarize_ic(daily: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    mean, spread = F.avg("ic"), F.stddev_samp("ic")
    stable = F.when(spread > 0, mean / spread).when(F.count("ic") > 0, F.lit(0.0))
    return daily.groupBy(*by).agg(
        mean.alias("mean_ic"),
        stable.alias("ic_ir"),
        F.avg((F.col("ic") > 0).cast("double")).alias("pct_positive_days"),
        F.count("ic").alias("n_days"),
    )


def signal_gate(summary: DataFrame, threshold: float = IC_THRESHOLD) -> DataFrame:
    """Pass iff the mean of the folds' ICs clears the bar and all share one sign."""
    ic = F.col("mean_ic")
    overall = F.avg(ic)
    stable = F.coalesce(F.bool_and(ic > 0) | F.bool_and(ic < 0), F.lit(False))
    return summary.agg(
        overall.alias("overall_mean_ic"),
        stable.alias("stable_sign"),
        (F.coalesce(overall > threshold, F.lit(False)) & stable).alias("gate_pass"),
    )


def collapse_check(preds: DataFrame, summary: DataFrame) -> DataFrame:
    """Flag folds in which no date had a valid IC; report the forecast spread."""
    spread = preds.groupBy("fold").agg(F.stddev_pop("pred").alias("pred_std"))
    return spread.join(summary.select("fold", "n_days"), "fold", "left").select(
        "fold", "pred_std", F.coalesce("n_days", F.lit(0)).cast("long").alias("n_days"),
        (F.coalesce("n_days", F.lit(0)) == 0).alias("collapsed"))


def mse_loss(preds: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    err = F.col("pred") - F.col("actual")
    return preds.groupBy(*by).agg(F.avg(err * err).alias("mse"))


def pinball_loss(
    preds: DataFrame, by: Sequence[str] = ("fold",), quantiles: Sequence[float] = QUANTILES
) -> DataFrame:
    """Mean pinball loss over rows and quantile levels."""
    terms = pinball_terms(F.col("pred"), F.col("actual"), quantiles)
    return preds.groupBy(*by).agg(F.avg(array_mean(terms)).alias("pinball"))


def pinball_by_quantile(
    preds: DataFrame, by: Sequence[str] = ("fold",), quantiles: Sequence[float] = QUANTILES
) -> DataFrame:
    terms = pinball_terms(F.col("pred"), F.col("actual"), quantiles)
    levels = F.array(*[F.lit(float(q)) for q in quantiles])
    return (
        preds.select(*by, F.posexplode(terms).alias("_i", "_loss"))
        .groupBy(*by, levels[F.col("_i")].alias("quantile"))
        .agg(F.avg("_loss").alias("pinball"))
    )


def quantile_crossing(preds: DataFrame, n_quantiles: int = len(QUANTILES)) -> DataFrame:
    """Prediction rows whose quantile forecasts are not in order."""
    return preds.filter(quantiles_cross(F.col("pred"), n_quantiles))
