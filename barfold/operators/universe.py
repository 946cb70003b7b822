"""Liquidity-based, point-in-time universe selection."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALENDAR_PADDING = 1.6  # calendar days kept per look-back session


def _as_date(value: dt.date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def liquid_universe(
    prices: DataFrame,
    as_of_date: dt.date | Column,
    lookback_days: int = 60,
    min_adv: float = 5e7,
    min_sessions: int | None = None,
) -> DataFrame:
    """Securities with enough trailing turnover and sessions on ``as_of_date``.

    Only rows in (as_of - 1.6 * lookback, as_of] are read, so nothing later can
    leak in. ``as_of_date`` may be a literal or a scalar-subquery column.
    """
    as_of = _as_date(as_of_date)
    span = int(lookback_days * CALENDAR_PADDING)
    enough = lookback_days // 2 if min_sessions is None else min_sessions
    recent = prices.filter(
        (F.col("date") <= as_of)
        & (F.col("date") > F.date_sub(as_of, span))
        & (F.col("series") == "EQ")
    )
    return (
        recent.groupBy("isin").agg(
            F.avg("turnover").alias("adv_inr"),
            F.max_by("symbol", F.struct("date", "symbol")).alias("symbol"),
            F.count("date").alias("n_sessions"),
        )
        .filter((F.col("adv_inr") > min_adv) & (F.col("n_sessions") >= enough))
        .withColumn("as_of_date", as_of)
    )


def top_liquid(
    prices: DataFrame,
    n_symbols: int,
    lookback_days: int = 365,
    min_adv: float = 1e7,
    min_sessions: int | None = None,
) -> DataFrame:
    """The ``n_symbols`` most traded securities as of the last date in ``prices``."""
    as_of = prices.select(F.max("date")).scalar()
    liquid = liquid_universe(prices, as_of, lookback_days, min_adv, min_sessions)
    return liquid.orderBy(F.col("adv_inr").desc(), "isin").limit(n_symbols)


def restrict_to_universe(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows whose isin belongs to the universe (broadcast only if it measures small)."""
    return rows.join(universe.select("isin").distinct(), "isin", "left_semi")
