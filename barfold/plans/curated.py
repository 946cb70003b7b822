"""The whole curation chain, and the quality report over its result."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barfold.operators.adjust import FEED_TASKS, adjustment_factors, apply_adjustment, unparsed_actions
from barfold.operators.curate import (
    DEFAULT_SERIES, backfill_isin, dedupe_bars, select_equity_rows, tradable_range,
    trading_calendar,
)
from barfold.operators.quality import quality_failing, quality_gate, quality_per_isin
from barfold.schemas import CURATED
from barfold.session import stage_table
from barfold.sources.bars import load_bars, write_by_year
from barfold.sources.sinks import write_review_queue


def clean_bars(raw: DataFrame, series: Sequence[str] = DEFAULT_SERIES) -> DataFrame:
    """Equity rows with repaired ids, one per (isin, date)."""
    return dedupe_bars(backfill_isin(select_equity_rows(raw, series)))


def curate(
    raw: DataFrame, actions: DataFrame | None, series: Sequence[str] = DEFAULT_SERIES, parts: int | None = None
) -> DataFrame:
    """Clean bars with adjusted prices; no actions means a factor of one.

    With ``parts`` the clean bars, and the factors, are dealt by isin into that many parts, once, with no more columns than
    are asked for: the join of both, however it is planned, the features after it and a store in as many buckets take them as they lie.
    """
    bars = clean_bars(raw, series)
    if parts is not None:
        bars = bars.repartition(parts, "isin")
    if actions is None:
        factors = bars.sparkSession.createDataFrame(
            [], "isin string, ex_date date, cum_factor double")
    else:
        factors = adjustment_factors(actions, parts or FEED_TASKS)
    adjusted = apply_adjustment(bars, factors)
    return adjusted.select(*[f.name for f in CURATED.fields])


@dataclass(frozen=True)
class CuratedStore:
    prices: str
    tradable_range: str
    actions: str
    factors: str
    unparsed: str

    @classmethod
    def at(cls, root: str) -> "CuratedStore":
        return cls(f"{root}/prices", f"{root}/universe/tradable_range",
                   f"{root}/corporate_actions/raw_actions",
                   f"{root}/corporate_actions/adjustment_factors",
                   f"{root}/corporate_actions/unparsed_actions")


def build_curated(
    raw: DataFrame,
    actions: DataFrame | None,
    root: str,
    series: Sequence[str] = DEFAULT_SERIES,
) -> DataFrame:
    """Run the chain, write every product below ``root``, return one stats row.

    Clean bars are stored once and read by the range and the price branch; the
    statistics are computed from the stored results.
    """
    spark = raw.sparkSession
    store = CuratedStore.at(root)
    bars = stage_table(clean_bars(raw, series), "clean-bars")
    tradable_range(bars).orderBy("first_date", "isin").write.mode("overwrite").parquet(store.tradable_range)
    if actions is None:
        factors = spark.createDataFrame([], "isin string, ex_date date, cum_factor double")
    else:
        actions.write.mode("overwrite").parquet(store.actions)
        actions = spark.read.schema(actions.schema).parquet(store.actions)
        write_review_queue(unparsed_actions(actions), store.unparsed)
        factors = adjustment_factors(actions)
    factors = stage_table(factors, "factors", store.factors)
    adjusted = apply_adjustment(bars, factors).select(*[f.name for f in CURATED.fields])
    write_by_year(adjusted, store.prices)
    return curated_stats(spark, root)


def curated_stats(spark: SparkSession, root: str) -> DataFrame:
    """rows, isins, years and adjustment events of a built store, as one row."""
    store = CuratedStore.at(root)
    prices = spark.read.parquet(store.prices)
    count = F.count(F.lit(1))
    return prices.agg(count.alias("rows"), F.count_distinct("year").alias("years")).select(
        "rows", "years",
        spark.read.parquet(store.tradable_range).select(count).scalar().alias("isins"),
        spark.read.parquet(store.factors).select(count).scalar().alias("n_adjustment_events"),
    )


def load_curated(spark: SparkSession, root: str) -> DataFrame:
    return load_bars(spark, CuratedStore.at(root).prices, CURATED)


def quality_report(curated: DataFrame, out: str) -> DataFrame:
    """Write the per-security report, the failing list and the verdict; return the verdict."""
    calendar = stage_table(trading_calendar(curated), "calendar", f"{out}/calendar")
    per_isin = stage_table(quality_per_isin(curated, calendar), "quality", f"{out}/per_isin_report")
    write_review_queue(quality_failing(per_isin), f"{out}/failing_isins")
    gate = quality_gate(per_isin, calendar)
    return stage_table(gate, "gate", f"{out}/summary")
