"""Row selection, security-id repair, de-duplication and listing ranges.

Raw rows carry no uniqueness guarantee, so a single symbol or security may hold
a large share of them. Everything here therefore aggregates (or limits) on the
map side before it shuffles; once ``dedupe_bars`` has run there is at most one
row per (isin, date), which bounds a security's rows by the calendar and makes
the per-security windows downstream safe.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SERIES = ("EQ",)
FALLBACK_PREFIX = "SYM:"

_TIE_BREAK = ("symbol", "series", "open", "high", "low", "close", "prev_close", "last",
              "volume", "turnover", "n_trades")


def select_equity_rows(bars: DataFrame, series: Sequence[str] = DEFAULT_SERIES) -> DataFrame:
    """Rows of the wanted series that have a close and a symbol."""
    return bars.filter(
        F.col("series").isin(list(series))
        & F.col("close").isNotNull()
        & F.col("symbol").isNotNull()
        & (F.col("symbol") != "")
    )


def symbol_isin_map(bars: DataFrame) -> DataFrame:
    """symbol -> most frequent real isin (ties: smallest isin)."""
    seen = (
        bars.filter(F.col("isin") != "")
        .groupBy("symbol", "isin").agg(F.count(F.lit(1)).alias("_n"))
    )
    return seen.groupBy("symbol").agg(
        F.min_by("isin", F.struct(-F.col("_n"), F.col("isin"))).alias("_known_isin")
    )


def backfill_isin(bars: DataFrame) -> DataFrame:
    """Fill missing isins from the symbol's known one, else a ``SYM:`` id.

    Only rows without an isin are looked up and move for it. The lookup side carries no broadcast hint: its size is that
    of the symbol list, so the planner (and AQE at run time) broadcasts it only while it is under the configured threshold and
    otherwise splits skewed symbols.
    """
    given = F.coalesce(F.col("isin") != "", F.lit(False))
    looked_up = bars.filter(~given).join(symbol_isin_map(bars), "symbol", "left").withColumn(
        "isin", F.coalesce("_known_isin", F.concat(F.lit(FALLBACK_PREFIX), F.col("symbol"))))
    return bars.filter(given).unionByName(looked_up.select(*bars.columns)).withColumn(
        "isin_is_symbol_fallback", F.col("isin").startswith(FALLBACK_PREFIX))


def dedupe_bars(bars: DataFrame) -> DataFrame:
    """Exactly one row per (isin, date), chosen by a total order.

    The rank filter lets Spark limit each group to one row per map task before
    the exchange, so heavily duplicated keys never travel whole.
    """
    order = [F.col(c).asc_nulls_first() for c in _TIE_BREAK if c in bars.columns]
    pick = F.row_number().over(Window.partitionBy("isin", "date").orderBy(*order))
    return bars.withColumn("_pick", pick).filter(F.col("_pick") == 1).drop("_pick")


def tradable_range(bars: DataFrame) -> DataFrame:
    """Listing span of every security, from what actually traded.

    Dates and symbols are collected as sets on the map side, so even undeduplicated input
    moves once, with each security as one row per task that holds no more than the calendar.
    """
    spans = [
        F.max_by("symbol", F.struct("date", "symbol")).alias("last_symbol"),
        F.sort_array(F.collect_set("symbol")).alias("symbols_seen"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.size(F.collect_set("date")).cast("long").alias("n_sessions"),
    ]
    if "isin_is_symbol_fallback" in bars.columns:
        spans.append(F.bool_or("isin_is_symbol_fallback").alias("isin_is_symbol_fallback"))
    return bars.groupBy("isin").agg(*spans)


def trading_calendar(bars: DataFrame) -> DataFrame:
    """Distinct dates on which any security traded."""
    return bars.select("date").distinct()
