"""Split/bonus factors and the strictly-forward as-of price adjustment."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barfold.functions.corporate_actions import action_multiplier, needs_review

PRICE_COLUMNS = ("open", "high", "low", "close")
#: Tasks that read the subject lines of a feed: a small feed in bytes is much work, so its size must not decide.
FEED_TASKS = 64


def unparsed_actions(actions: DataFrame) -> DataFrame:
    """EQ actions that name a share-count event but give no usable ratio."""
    return actions.filter((F.col("series") == "EQ") & needs_review(F.col("subject")))


def adjustment_factors(actions: DataFrame, tasks: int = FEED_TASKS) -> DataFrame:
    """(isin, ex_date, cum_factor): product of this and every later multiplier.

    Actions sharing an ex-date are multiplied together first, so the running
    product sees one row per (isin, ex_date). The subject lines are read after the one
    exchange, so that a feed in few files is not read by few tasks, and only once each. Prices dealt by isin into as many
    parts as ``tasks`` join the factors as both lie.
    """
    per_day = (
        actions.filter(F.col("series") == "EQ").select("isin", "ex_date", "subject").repartition(tasks, "isin")
        .groupBy("isin", "ex_date").agg(F.product(action_multiplier(F.col("subject"))).alias("multiplier"))
        .filter(F.col("multiplier").isNotNull())
    )
    newest_first = (
        Window.partitionBy("isin").orderBy(F.col("ex_date").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return per_day.select(
        "isin", "ex_date", F.product("multiplier").over(newest_first).alias("cum_factor")
    )


def factor_intervals(factors: DataFrame) -> DataFrame:
    """The step function as half-open intervals [valid_from, valid_to)."""
    by_date = Window.partitionBy("isin").orderBy("ex_date")
    return factors.select(
        "isin",
        F.lag("ex_date").over(by_date).alias("valid_from"),
        F.col("ex_date").alias("valid_to"),
        "cum_factor",
    )


def _adjusted(prices: DataFrame, factor, keep: list[str]) -> DataFrame:
    return prices.withColumn("adj_factor", F.coalesce(factor, F.lit(1.0))).select(
        *keep, "adj_factor",
        *[(F.col(c) * F.col("adj_factor")).alias(f"{c}_adj") for c in PRICE_COLUMNS],
    )


def apply_adjustment(prices: DataFrame, factors: DataFrame) -> DataFrame:
    """Attach the factor of the first ex-date after each row, as an interval join.

    The isin equality drives the join and the date range is a residual, so the
    engine picks broadcast-hash while the interval table is small and a
    sort-merge join (with AQE skew splitting of the price side) beyond that.
    """
    i = factor_intervals(factors).alias("i")
    p = prices.alias("p")
    hit = (
        (F.col("p.isin") == F.col("i.isin"))
        & (F.col("p.date") < F.col("i.valid_to"))
        & (F.col("i.valid_from").isNull() | (F.col("p.date") >= F.col("i.valid_from")))
    )
    joined = p.join(i, hit, "left").select("p.*", F.col("i.cum_factor").alias("_factor"))
    return _adjusted(joined, F.col("_factor"), prices.columns)


def apply_adjustment_scan(prices: DataFrame, factors: DataFrame) -> DataFrame:
    """Same result in one pass per security, for long factor histories.

    Prices and factors are interleaved newest-first; on equal dates the price
    row comes first, so an action dated on the row itself does not touch it.
    """
    events = prices.withColumn("_is_factor", F.lit(0)).unionByName(
        factors.select("isin", F.col("ex_date").alias("date"), "cum_factor",
                       F.lit(1).alias("_is_factor")),
        allowMissingColumns=True,
    )
    newest_first = (
        Window.partitionBy("isin").orderBy(F.col("date").desc(), "_is_factor")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = events.withColumn("_factor", F.last("cum_factor", ignorenulls=True).over(newest_first))
    return _adjusted(seen.filter(F.col("_is_factor") == 0), F.col("_factor"), prices.columns)
