"""Every operator as a query over the whole test tables.

Each query takes (spark, sf_dir). Doubles that come from logarithms or sums are
rounded here, for the comparison with SQL only; the operators never round.
"""

import datetime as dt
from collections.abc import Callable, Sequence
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barfold.functions.arrays import patchify
from barfold.functions.corporate_actions import action_multiplier
from barfold.functions.scalars import signum_deadzone
from barfold.operators import (
    adjust, curate, features, long_histories, metrics, nested, panels, quality, samples, signals, universe, walkforward,
)
from barfold.operators.ranking import average_ranks
from barfold.plans import curated as curated_plan
from barfold.plans import evaluation
from barfold.schemas import FEATURE_COLUMNS, QUANTILES, TARGET_COLUMN
from barfold.session import keep_table, kept_table, scratch_path, stage_table, stored_bytes
from barfold.sources import bars as bar_files
from barfold.sources import day_file_source, reference_data, sinks
from barfold.streaming import ingest
from workload import fixtures

SEQ_LEN = 120
PATCH = 7  # does not divide the window: the first patch is padded
TEST_YEARS = (1998, 1999, 2000, 2001)
FOLDS = walkforward.yearly_folds(TEST_YEARS)
LIQUIDITY = {"lookback_days": 365, "min_adv": 3e4, "min_sessions": 60}
AS_OF = dt.date(2001, 12, 31)
DONE_FOLDS = ("1998", "1999")

# Trades of a part, in bytes of the input: what a task holds to sort then stays the same at any size of the whole.
PART_BYTES = 4 << 20

# What the feature steps read of the curated rows: the others would travel through every exchange.
_PRICES = ("isin", "date", "open_adj", "high_adj", "low_adj", "close_adj", "volume")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Inputs:
    """The frames the queries start from.

    The pipeline's own hand-over points (raw bars, curated prices, features,
    samples, predictions) are stored tables, built on first use; everything
    else is a lazy plan over them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _kept(self, name: str, build: Callable[[], DataFrame], **buckets) -> DataFrame:
        return keep_table(f"{self.sf_dir}/{name}", self.spark, build, self.sf_dir, **buckets)

    @cached_property
    def parts(self) -> int:
        """Into how many parts trades and bars are dealt."""
        needed = -(-stored_bytes(self.spark, f"{self.sf_dir}/lineitem.parquet") // PART_BYTES)
        return max(needed, self.spark.sparkContext.defaultParallelism)

    @cached_property
    def bars_raw(self) -> DataFrame:
        return fixtures.with_repeated(self._kept("raw-bars", lambda: fixtures.bars_raw(
            self.spark, self.sf_dir, self.parts).drop(*fixtures.REPEATED)))

    @cached_property
    def raw(self) -> DataFrame:
        return self.bars_raw.drop("k")

    @cached_property
    def bars(self) -> DataFrame:
        """Clean bars, stored: many queries start from them."""
        return self._kept("clean-bars", lambda: curated_plan.clean_bars(self.raw))

    @cached_property
    def calendar(self) -> DataFrame:
        return self._kept("calendar", lambda: curate.trading_calendar(self.bars))

    @cached_property
    def actions(self) -> DataFrame:
        return reference_data.parse_actions(fixtures.actions_raw(self.spark, self.sf_dir))

    @cached_property
    def factors(self) -> DataFrame:
        return adjust.adjustment_factors(self.actions)

    @cached_property
    def curated(self) -> DataFrame:
        return self._kept("curated", self._curate, by="isin", buckets=self.parts)

    def _curate(self) -> DataFrame:
        return curated_plan.curate(self.raw, self.actions, parts=self.parts)

    @cached_property
    def prices(self) -> DataFrame:
        """What features read: of the curated table if it is stored, else as a step on the way, which nothing else asks to be stored."""
        stored = kept_table(f"{self.sf_dir}/curated", self.spark, self.sf_dir)
        return (self._curate() if stored is None else stored).select(*_PRICES)

    @cached_property
    def features(self) -> DataFrame:
        """What later steps read of the features; prices and half-way columns are not stored a second time."""
        return self._kept("features", lambda: features.compute_features(self.prices).select(
            "isin", "date", *FEATURE_COLUMNS, TARGET_COLUMN, "has_sufficient_history"), by="isin", buckets=self.parts)

    @cached_property
    def liquid(self) -> DataFrame:
        """From the curated rows or clean bars if they are stored, else from raw bars: curation keeps the rows and columns that are read."""
        stored = [kept_table(f"{self.sf_dir}/{name}", self.spark, self.sf_dir) for name in ("curated", "clean-bars")]
        rows = next((t for t in stored if t is not None), None)
        rows = curated_plan.clean_bars(self.raw) if rows is None else rows
        as_of = curate.select_equity_rows(self.raw).select(F.max("date")).scalar()  # of two rows of a day one stays
        return universe.liquid_universe(rows, as_of, **LIQUIDITY)

    @cached_property
    def universe(self) -> DataFrame:
        """The ``liquid`` securities, one row each, stored: panels look at them several times."""
        return self._kept("universe", lambda: self.liquid)

    @cached_property
    def samples(self) -> DataFrame:
        return self._kept("samples", lambda: samples.sample_index(
            self.features, SEQ_LEN, keep=["ret_1", TARGET_COLUMN]))

    @cached_property
    def assigned(self) -> DataFrame:
        return walkforward.assign_splits(self.samples, FOLDS)

    @cached_property
    def preds(self) -> DataFrame:
        """Forecasts, rounded so that both engines see the same ties."""
        return self._kept("predictions", lambda: signals.fit_predict_ar1(
            self.assigned).withColumns({c: F.round(c, 10) for c in ("pred", "actual")}))

    @cached_property
    def quantile_preds(self) -> DataFrame:
        return self._kept("quantiles", lambda: signals.fit_predict_quantiles(self.assigned))


STORED_INPUTS = ("bars_raw", "bars", "calendar", "curated", "features", "samples", "preds", "quantile_preds")


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[fn.__name__.removesuffix("_query")] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
    return fn


def rounded(df: DataFrame, *columns: str, dp: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, dp) for c in columns})


def digest(values: Column) -> Column:
    """Hash of an array of doubles in millionths."""
    return F.md5(F.array_join(F.transform(values, lambda x: F.round(x * 1e6).cast("long")), ","))


def row_text(columns: Sequence[str]) -> Column:
    """A row's part of the ``digest`` of a window it is in: made once a row, not once for each window."""
    return F.concat_ws(",", *[F.round(F.col(c) * 1e6).cast("long") for c in columns])


# ------------------------------------------------------------------ sources and sinks

@query
def read_bars(x: Inputs) -> DataFrame:
    files = fixtures.day_files(x.spark, x.bars_raw)
    return bar_files.good_bars(bar_files.parse_day_files(files))


@query
def read_bars_csv(x: Inputs) -> DataFrame:
    """Unpacked day files written to shared storage and read back by header group."""
    path = scratch_path(x.spark, "day-csv")
    for layout, cells in fixtures.layout_cells(x.bars_raw).items():
        # One directory per day; a very large day becomes several files.
        cells.drop("k").repartition("day").write.partitionBy("day").options(
            header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
            maxRecordsPerFile=1_000_000).csv(f"{path}/{layout}")
    return bar_files.read_bars_csv(x.spark, path)


def _land_day_files(x: Inputs, lines: DataFrame, path: str) -> None:
    """Zips of a day's lines, one per block of keys, below ``path``."""
    block = F.expr(f"k div {fixtures.ROWS_PER_FILE_KEYS}")
    day_file_source.write_day_files(lines.select(
        F.concat_ws("", F.col("day").cast("string"), F.lit("_"), block, F.lit(".zip")).alias("file"), "header", "line"), path)


@query
def read_bars_zips(x: Inputs) -> DataFrame:
    """Real zips written to shared storage and read back, both through the data source."""
    path = scratch_path(x.spark, "day-zips")
    _land_day_files(x, fixtures.csv_lines(x.bars_raw), path)
    return day_file_source.read_bars_from_source(x.spark, path)


@query
def read_bars_zip_stream(x: Inputs) -> DataFrame:
    """Two landings of zips through the source's stream: each file once."""
    root = scratch_path(x.spark, "zip-stream")
    landing, bars, checkpoint = (f"{root}/{p}" for p in ("landing", "bars", "checkpoint"))
    lines = stage_table(fixtures.csv_lines(x.bars_raw), "day-lines")
    early = F.year("day") < 1998
    for part in (early, ~early, F.lit(False)):
        _land_day_files(x, lines.filter(part), landing)
        stream = day_file_source.day_file_line_stream(x.spark, landing, f"{root}/found")
        parsed = bar_files.good_bars(bar_files.parse_lines(stream))
        parsed.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(bars).awaitTermination()
    return x.spark.read.parquet(bars)


@query
def quarantine_bad_files(x: Inputs) -> DataFrame:
    parsed = bar_files.parse_day_files(fixtures.day_files(x.spark, x.bars_raw))
    return bar_files.quarantined_files(parsed).select(
        "file", F.col("error").isNotNull().alias("has_error"))


@query
def ingest_stats(x: Inputs) -> DataFrame:
    return bar_files.ingest_stats(x.raw)


@query
def write_by_year(x: Inputs) -> DataFrame:
    path = scratch_path(x.spark, "by-year")
    bar_files.write_by_year(x.raw, path)
    stored = x.spark.read.parquet(path)
    return stored.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.round(F.sum("turnover"), 2).alias("turnover"))


@query
def load_bars(x: Inputs) -> DataFrame:
    path = scratch_path(x.spark, "bar-store")
    bar_files.write_by_year(x.raw, path)
    return bar_files.load_bars(x.spark, path)


@query
def scan_curated(x: Inputs) -> DataFrame:
    path = scratch_path(x.spark, "curated-store")
    bar_files.write_by_year(x.curated, path)
    rows = bar_files.scan_curated(
        x.spark, path, start=dt.date(1997, 3, 1), end=dt.date(1999, 9, 30), series=["EQ"])
    return rows.select("isin", "date", "close", "close_adj", "adj_factor")


@query
def read_actions(x: Inputs) -> DataFrame:
    path = scratch_path(x.spark, "actions-json")
    fixtures.actions_raw(x.spark, x.sf_dir).write.json(path)
    return reference_data.read_actions(x.spark, path)


def _landed_index_lists(x: Inputs) -> dict[str, str]:
    path = scratch_path(x.spark, "index-csv")
    lists = fixtures.index_lists(x.spark, x.sf_dir)
    lists.write.partitionBy("index").option("header", True).option(
        "ignoreLeadingWhiteSpace", False).csv(path)
    names = [r["index"] for r in lists.select("index").distinct().collect()]  # index names only
    return {n: f"{path}/index={n}" for n in sorted(names)}


@query
def read_index_membership(x: Inputs) -> DataFrame:
    return reference_data.read_index_membership(x.spark, _landed_index_lists(x), AS_OF)


@query
def union_frames(x: Inputs) -> DataFrame:
    """Two separately read halves of the action feed, stacked."""
    is_eq = F.col("series") == "EQ"
    return reference_data.union_frames(x.actions.filter(is_eq), x.actions.filter(~is_eq))


@query
def pending_sessions(x: Inputs) -> DataFrame:
    return reference_data.pending_sessions(*fixtures.session_inputs(x.spark, x.sf_dir))


@query
def session_status_counts(x: Inputs) -> DataFrame:
    plan = reference_data.session_plan(*fixtures.session_inputs(x.spark, x.sf_dir))
    return reference_data.status_counts(plan)


@query
def fetch_log_status(x: Inputs) -> DataFrame:
    return reference_data.fetch_log_status(fixtures.fetch_log(x.spark, x.sf_dir))


@query
def ingest_incremental(x: Inputs) -> DataFrame:
    """Two landings and an idle run through the streaming path; all bars once."""
    root = scratch_path(x.spark, "incremental")
    landing, target, checkpoint = (f"{root}/{p}" for p in ("landing", "bars", "checkpoint"))
    schema = T.StructType([
        T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])

    def run() -> None:
        stream = x.spark.readStream.schema(schema).parquet(landing)
        ingest.ingest_incremental(stream, target, checkpoint)

    early = F.year("date") < 1998
    for part in (early, ~early):
        fixtures.day_files(x.spark, x.bars_raw.filter(part)).write.mode("append").parquet(landing)
        run()
    run()
    return ingest.load_ingested(x.spark, target)


@query
def write_review_queue(x: Inputs) -> DataFrame:
    path = scratch_path(x.spark, "review")
    sinks.write_review_queue(adjust.unparsed_actions(x.actions), path)
    return x.spark.read.option("header", True).schema(
        "isin string, symbol string, series string, ex_date date, subject string").csv(path)


# ------------------------------------------------------------------ curation

@query
def select_equity_rows(x: Inputs) -> DataFrame:
    return curate.select_equity_rows(x.raw)


@query
def backfill_isin(x: Inputs) -> DataFrame:
    return curate.backfill_isin(curate.select_equity_rows(x.raw))


@query
def dedupe_bars(x: Inputs) -> DataFrame:
    return curated_plan.clean_bars(x.raw)


@query
def tradable_range(x: Inputs) -> DataFrame:
    return curate.tradable_range(x.bars).withColumn(
        "symbols_seen", F.array_join("symbols_seen", ","))


@query
def trading_calendar(x: Inputs) -> DataFrame:
    return curate.trading_calendar(x.bars)


@query
def action_multiplier_query(x: Inputs) -> DataFrame:
    return fixtures.actions_raw(x.spark, x.sf_dir).select(
        "isin", "exDate", "series", "subject", action_multiplier(F.col("subject")).alias("multiplier"))


@query
def unparsed_actions(x: Inputs) -> DataFrame:
    return adjust.unparsed_actions(x.actions)


@query
def adjustment_factors(x: Inputs) -> DataFrame:
    return x.factors


_ADJUSTED = ("isin", "date", "adj_factor", "open_adj", "high_adj", "low_adj", "close_adj")


@query
def apply_adjustment(x: Inputs) -> DataFrame:
    return adjust.apply_adjustment(x.bars, x.factors).select(*_ADJUSTED)


@query
def apply_adjustment_scan(x: Inputs) -> DataFrame:
    return adjust.apply_adjustment_scan(x.bars, x.factors).select(*_ADJUSTED)


@query
def build_curated(x: Inputs) -> DataFrame:
    root = scratch_path(x.spark, "curated")
    curated_plan.build_curated(x.raw, x.actions, root)
    return curated_plan.load_curated(x.spark, root)


@query
def build_curated_stats(x: Inputs) -> DataFrame:
    return curated_plan.build_curated(x.raw, x.actions, scratch_path(x.spark, "curated"))


# ------------------------------------------------------------------ quality

@query
def ohlc_violations(x: Inputs) -> DataFrame:
    return quality.ohlc_violations(x.bars).select("isin", "date", "open", "high", "low", "close")


@query
def stale_streaks(x: Inputs) -> DataFrame:
    return quality.stale_streaks(x.bars)


@query
def expected_sessions(x: Inputs) -> DataFrame:
    return quality.expected_sessions(x.bars, x.calendar)


@query
def quality_per_isin(x: Inputs) -> DataFrame:
    return rounded(quality.quality_per_isin(x.bars, x.calendar), "zero_volume_fraction", dp=9)


@query
def quality_left_joins(x: Inputs) -> DataFrame:
    """Only the zero-filled per-security counts."""
    return quality.quality_per_isin(x.bars, x.calendar).select("isin", "n_ohlc_violations", "max_stale_streak")


@query
def quality_failing(x: Inputs) -> DataFrame:
    return rounded(quality.quality_failing(quality.quality_per_isin(x.bars, x.calendar)),
                   "zero_volume_fraction", dp=9)


@query
def quality_gate(x: Inputs) -> DataFrame:
    return quality.quality_gate(
        quality.quality_per_isin(x.bars, x.calendar), x.calendar)


# ------------------------------------------------------------------ universe

@query
def liquid_universe(x: Inputs) -> DataFrame:
    return rounded(x.liquid, "adv_inr", dp=4)


@query
def top_liquid(x: Inputs) -> DataFrame:
    return rounded(universe.top_liquid(x.curated, 40, **LIQUIDITY), "adv_inr", dp=4)


@query
def restrict_to_universe(x: Inputs) -> DataFrame:
    return universe.restrict_to_universe(x.curated, x.liquid).select("isin", "date", "close_adj")


# ------------------------------------------------------------------ features

_RETURNS = ("ret_1", "ret_o", "ret_h", "ret_l")


@query
def log_returns(x: Inputs) -> DataFrame:
    return rounded(features.log_returns(x.curated.select(*_PRICES)).select("isin", "date", *_RETURNS), *_RETURNS)


@query
def realized_vol(x: Inputs) -> DataFrame:
    rows = features.realized_vol(features.log_returns(x.curated.select(*_PRICES)))
    return rounded(rows.select("isin", "date", "realized_vol_20"), "realized_vol_20")


@query
def volume_baseline(x: Inputs) -> DataFrame:
    cols = ("log_vol", "log_vol_baseline", "log_vol_std")
    return rounded(features.volume_baseline(x.curated.select(*_PRICES)).select("isin", "date", *cols), *cols)


@query
def scaled_features(x: Inputs) -> DataFrame:
    rows = features.scaled_features(features.volume_baseline(
        features.realized_vol(features.log_returns(x.curated.select(*_PRICES)))))
    return rounded(rows.select("isin", "date", "ret_1_volscaled", "vol_z"),
                   "ret_1_volscaled", "vol_z")


@query
def forward_return(x: Inputs) -> DataFrame:
    return rounded(features.forward_return(x.curated.select(*_PRICES)).select("isin", "date", "fwd_ret_1"),
                   "fwd_ret_1")


@query
def history_flag(x: Inputs) -> DataFrame:
    return features.history_flag(x.curated.select(*_PRICES)).select("isin", "date", "has_sufficient_history")


@query
def calendar_encoding(x: Inputs) -> DataFrame:
    cols = FEATURE_COLUMNS[6:]
    return rounded(features.calendar_encoding(x.bars).select("isin", "date", *cols), *cols)


@query
def compute_features(x: Inputs) -> DataFrame:
    cols = (*FEATURE_COLUMNS, "fwd_ret_1")
    rows = features.compute_features(x.curated.select(*_PRICES))
    return rounded(rows.select("isin", "date", *cols, "has_sufficient_history"), *cols)


@query
def compute_features_long(x: Inputs) -> DataFrame:
    """The same features, quarters of a security put together to window partitions of some thousand rows."""
    cols = (*FEATURE_COLUMNS, "fwd_ret_1")
    rows = long_histories.compute_features_long(x.curated.select(*_PRICES), F.trunc("date", "quarter"))
    return rounded(rows.select("isin", "date", *cols, "has_sufficient_history"), *cols)


# ------------------------------------------------------------------ samples and panels

@query
def sample_index(x: Inputs) -> DataFrame:
    return samples.sample_index(x.features, SEQ_LEN)


@query
def sample_windows(x: Inputs) -> DataFrame:
    rows = samples.sample_windows(x.features, SEQ_LEN, cell=row_text(FEATURE_COLUMNS))
    return rounded(rows.withColumns({
        "n_rows": F.size("window"), "window": F.md5(F.array_join("window", ","))}), "target")


@query
def patchify_query(x: Inputs) -> DataFrame:
    rows = samples.sample_windows(x.features, SEQ_LEN)
    patches = patchify(F.col("window"), SEQ_LEN, len(FEATURE_COLUMNS), PATCH)
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    return rounded(rows.withColumn("p", patches).select(
        "isin", "feature_end_date", F.size("p").alias("n_patches"),
        F.size(F.element_at("p", 1)).alias("patch_len"),
        total(F.element_at("p", 1)).alias("first_sum"),
        total(F.element_at("p", -1)).alias("last_sum")), "first_sum", "last_sum")


@query
def next_market_date(x: Inputs) -> DataFrame:
    return samples.next_market_date(x.bars)


@query
def panel_index(x: Inputs) -> DataFrame:
    return rounded(samples.panel_index(x.features, x.universe, SEQ_LEN), "target")


@query
def panel_tensors(x: Inputs) -> DataFrame:
    rows = samples.panel_tensors(x.features, x.universe, SEQ_LEN, cell=row_text(FEATURE_COLUMNS))
    return rows.select(
        "feature_end_date", "label_date", "n_names", "shard",
        F.array_join("isins", ",").alias("isins"),
        F.md5(F.array_join(F.flatten("windows"), ",")).alias("windows"),
        digest(F.col("targets")).alias("targets"))


# ------------------------------------------------------------------ walk-forward

@query
def yearly_folds(x: Inputs) -> DataFrame:
    return walkforward.yearly_folds_of(curate.trading_calendar(x.bars))


@query
def pending_folds(x: Inputs) -> DataFrame:
    folds = walkforward.yearly_folds_of(curate.trading_calendar(x.bars))
    return walkforward.pending_folds(folds, x.preds.filter(F.col("fold").isin(*DONE_FOLDS)))


@query
def assign_splits(x: Inputs) -> DataFrame:
    return x.assigned.select("fold", "split", "isin", "feature_end_date", "label_date")


@query
def assign_splits_sessions(x: Inputs) -> DataFrame:
    # Features have the dates of the curated rows, row by row.
    rows = walkforward.assign_splits(
        x.samples, FOLDS, 10, embargo_unit="sessions",
        calendar=curate.trading_calendar(x.features))
    return rows.select("fold", "split", "isin", "feature_end_date", "label_date")


@query
def filter_split(x: Inputs) -> DataFrame:
    rows = walkforward.filter_split(x.assigned, "train", "1999")
    return rows.select("fold", "isin", "feature_end_date", "label_date")


@query
def fold_counts(x: Inputs) -> DataFrame:
    return walkforward.fold_counts(x.assigned)


@query
def panel_fold_counts(x: Inputs) -> DataFrame:
    return walkforward.panel_fold_counts(x.assigned)


@query
def leakage_guard(x: Inputs) -> DataFrame:
    """Training rows assembled with a 10-day embargo, audited against 30 days."""
    train = walkforward.filter_split(x.assigned, "train")
    return walkforward.leakage_guard(train, FOLDS, 30).select(
        "fold", "isin", "feature_end_date", "label_date", "embargo_cutoff")


@query
def shuffle_labels(x: Inputs) -> DataFrame:
    rows = walkforward.shuffle_labels(x.samples, seed=7)
    return rounded(rows.select("isin", "feature_end_date", "fwd_ret_1", "shuffled_target"),
                   "fwd_ret_1", "shuffled_target")


# ------------------------------------------------------------------ signals and metrics

def _nan_labels(assigned: DataFrame) -> DataFrame:
    """NaN labels on the 5th of a month, no labels on the 6th."""
    day = F.dayofmonth("feature_end_date")
    label = F.when(day == 5, F.lit(float("nan"))).when(day != 6, F.col(TARGET_COLUMN))
    return assigned.withColumn(TARGET_COLUMN, label)


@query
def walk_forward_ar1(x: Inputs) -> DataFrame:
    """The autoregressive forecasts from sums per date: samples are not multiplied by folds for the fit."""
    return rounded(nested.walk_forward_ar1(x.samples, FOLDS), "pred", "actual")


@query
def walk_forward_quantiles(x: Inputs) -> DataFrame:
    rows = nested.walk_forward_quantiles(_nan_labels(x.samples), FOLDS)
    return rounded(rows.select(
        "fold", "isin", "date", F.nanvl("actual", F.lit(None)).alias("actual"),
        *[F.col("pred")[i].alias(f"q{i + 1}") for i in range(len(QUANTILES))]),
        "actual", *[f"q{i + 1}" for i in range(len(QUANTILES))])


@query
def fold_counts_nested(x: Inputs) -> DataFrame:
    return nested.fold_counts_nested(x.samples, FOLDS)


@query
def panel_forecasts(x: Inputs) -> DataFrame:
    """The panel run of the chain up to its forecasts: purged by the date each target is known, guarded by the same."""
    panels_ = samples.panel_index(x.features, x.universe, SEQ_LEN, keep=["ret_1"]).withColumnRenamed("target", TARGET_COLUMN)
    made = evaluation.walk_forward_predictions(stage_table(panels_, "panels"), FOLDS, panels=True)
    return rounded(made, "pred", "actual")


@query
def fit_gaps(x: Inputs) -> DataFrame:
    """Both fits over labels with gaps, as one row per fold."""
    gapped = _nan_labels(x.assigned)
    levels = signals.fit_predict_quantiles(gapped).groupBy("fold").agg(F.first("pred").alias("pred"))
    fitted = signals.fit_ar1(gapped).join(levels, "fold")
    return rounded(fitted.select("fold", "slope", "intercept", F.col("pred")[0].alias("q1"), F.col("pred")[4].alias("q5")),
                   "slope", "intercept", "q1", "q5")


@query
def fit_predict_ar1(x: Inputs) -> DataFrame:
    return rounded(signals.fit_predict_ar1(x.assigned), "pred", "actual")


@query
def fit_predict_quantiles(x: Inputs) -> DataFrame:
    rows = signals.fit_predict_quantiles(x.assigned)
    return rounded(rows.select(
        "fold", "isin", "date", "actual",
        *[F.col("pred")[i].alias(f"q{i + 1}") for i in range(len(QUANTILES))]),
        "actual", *[f"q{i + 1}" for i in range(len(QUANTILES))])


@query
def score_panels(x: Inputs) -> DataFrame:
    rows = walkforward.filter_split(x.assigned, "test").select(
        "fold", "isin", F.col("label_date").alias("date"), "ret_1")
    scored = signals.score_panels(
        rows, {"_mean": F.avg("ret_1"), "_sd": F.stddev_samp("ret_1")},
        F.try_divide(F.col("ret_1") - F.col("_mean"), F.col("_sd")))
    return rounded(scored.select("fold", "isin", "date", "pred"), "pred")


@query
def score_panels_by(x: Inputs) -> DataFrame:
    """The same scores by a Python function over rows joined with their panel's statistics."""
    rows = walkforward.filter_split(x.assigned, "test").select(
        "fold", "isin", F.col("label_date").alias("date"), "ret_1")
    scored = signals.score_panels_by(
        rows, {"_mean": F.avg("ret_1"), "_sd": F.stddev_samp("ret_1")},
        lambda ret, mean, sd: (ret - mean) / sd.where(sd > 0), ["ret_1", "_mean", "_sd"])
    return rounded(scored.select("fold", "isin", "date", F.nanvl("pred", F.lit(None)).alias("pred")), "pred")


def _softmax_sum(key, batches):
    top, total = float("-inf"), 0.0
    for batch in batches:
        ret = batch.column("ret_1").to_numpy()
        high = max(top, ret.max())
        total, top = total * np.exp(top - high) + np.exp(ret - high).sum(), high
    return top, total


def _softmax(key, seen, batches):
    top, total = seen
    return (np.exp(batch.column("ret_1").to_numpy() - top) / total for batch in batches)


def _rank_share(key, n, batches):
    """Place of each name in its panel, ties at their first place; the rows come sorted."""
    row, place, last = 0, 0, None
    for batch in batches:
        out = []
        for value in batch.column("ret_1").to_pylist():
            row += 1
            if value != last:
                place, last = row, value
            out.append((place - 0.5) / n)
        yield out


def _panel_rows(x: Inputs) -> DataFrame:
    return walkforward.filter_split(x.assigned, "test").select(
        "fold", "isin", F.col("label_date").alias("date"), F.round("ret_1", 10).alias("ret_1"))


@query
def score_panels_softmax(x: Inputs) -> DataFrame:
    """A function of all names of a date: their softmax, each panel streamed twice."""
    scored = panels.score_whole_panels(_panel_rows(x), _softmax, summarize=_softmax_sum)
    return rounded(scored.select("fold", "isin", "date", "pred"), "pred", dp=9)


@query
def score_panels_rank(x: Inputs) -> DataFrame:
    """The share of a date's names below each, over rows that stream in order of their return."""
    def size(key, batches):
        return sum(b.num_rows for b in batches)

    scored = panels.score_whole_panels(_panel_rows(x), _rank_share, order=["ret_1", "isin"], summarize=size)
    return rounded(scored.select("fold", "isin", "date", "pred"), "pred", dp=9)


def _with_gaps(preds: DataFrame) -> DataFrame:
    """Forecasts with NaN on some days of the year and null on others."""
    day = F.dayofyear("date")
    return preds.withColumn("pred", F.when(day % 7 == 3, F.lit(float("nan"))).when(
        day % 11 != 5, F.col("pred")))


@query
def sign_backtest_gaps(x: Inputs) -> DataFrame:
    return rounded(metrics.sign_backtest(_with_gaps(x.preds), deadzone=0.002), *_BACKTEST)


@query
def sign_backtest_median(x: Inputs) -> DataFrame:
    """Backtest of the median of the quantile forecasts."""
    return rounded(metrics.sign_backtest(signals.median_forecast(x.quantile_preds)), *_BACKTEST)


@query
def quality_report(x: Inputs) -> DataFrame:
    return curated_plan.quality_report(x.bars, scratch_path(x.spark, "quality-report"))


@query
def index_snapshot(x: Inputs) -> DataFrame:
    path = scratch_path(x.spark, "snapshots")
    listed = reference_data.read_index_membership(x.spark, _landed_index_lists(x), AS_OF)
    reference_data.write_index_snapshot(listed, path)
    return x.spark.read.parquet(path).select(*listed.columns)


@query
def rank_ic_gaps(x: Inputs) -> DataFrame:
    return rounded(metrics.rank_ic_by_date(_with_gaps(x.preds)), "ic")


@query
def signum_deadzone_query(x: Inputs) -> DataFrame:
    return x.preds.select("fold", "isin", "date",
                          signum_deadzone(F.col("pred"), 0.002).alias("position"))


_BOOK = ("fold", "isin", "date", "position", "prev_position", "turnover", "gross_pnl", "cost",
         "net_pnl")


@query
def backtest_rows(x: Inputs) -> DataFrame:
    return metrics.backtest_rows(x.preds, deadzone=0.002).select(*_BOOK)


@query
def backtest_rows_pooled(x: Inputs) -> DataFrame:
    return metrics.backtest_rows(x.preds, deadzone=0.002, book="pooled").select(*_BOOK)


_BACKTEST = ("gross_sharpe", "net_sharpe", "hit_rate", "mean_abs_position", "avg_turnover_per_day")


@query
def sign_backtest(x: Inputs) -> DataFrame:
    return rounded(metrics.sign_backtest(x.preds, deadzone=0.002), *_BACKTEST)


@query
def sharpe_ratio(x: Inputs) -> DataFrame:
    return rounded(metrics.sharpe_ratio(x.preds, "actual", ["fold", "isin"]), "sharpe")


@query
def hit_rate(x: Inputs) -> DataFrame:
    return rounded(metrics.hit_rate(x.preds, ["fold", "isin"], deadzone=0.001), "hit_rate")


@query
def overall_net_sharpe(x: Inputs) -> DataFrame:
    rows = metrics.overall_net_sharpe(metrics.backtest_rows(x.preds))
    return rounded(rounded(rows, "overall_net_sharpe"), "mean_net_pnl", dp=9)


@query
def average_ranks_query(x: Inputs) -> DataFrame:
    return average_ranks(x.preds, ["fold", "date"], ["pred", "actual"]).select(
        "fold", "date", "isin", "pred_rank", "actual_rank")


@query
def rank_ic_by_date(x: Inputs) -> DataFrame:
    return rounded(metrics.rank_ic_by_date(x.preds), "ic")


_SUMMARY = ("mean_ic", "ic_ir", "pct_positive_days")


@query
def rank_ic_summary(x: Inputs) -> DataFrame:
    return rounded(metrics.rank_ic_summary(x.preds), *_SUMMARY)


@query
def signal_gate(x: Inputs) -> DataFrame:
    return rounded(metrics.signal_gate(metrics.rank_ic_summary(x.preds)), "overall_mean_ic")


@query
def collapse_check(x: Inputs) -> DataFrame:
    """Real forecasts for two folds, a constant forecast for the others."""
    flat = x.preds.withColumn(
        "pred", F.when(F.col("fold") >= "2000", F.lit(0.001)).otherwise(F.col("pred")))
    return rounded(metrics.collapse_check(flat, metrics.rank_ic_summary(flat)), "pred_std", dp=9)


@query
def mse_loss(x: Inputs) -> DataFrame:
    return rounded(metrics.mse_loss(x.preds), "mse", dp=9)


@query
def pinball_loss(x: Inputs) -> DataFrame:
    return rounded(metrics.pinball_loss(x.quantile_preds), "pinball", dp=9)


@query
def pinball_by_quantile(x: Inputs) -> DataFrame:
    return rounded(metrics.pinball_by_quantile(x.quantile_preds), "pinball", dp=9)


@query
def quantile_crossing(x: Inputs) -> DataFrame:
    """Fitted quantiles, their middle levels swapped where the actual is negative."""
    q = F.col("pred")
    swapped = F.array(q[0], q[1], q[2], q[4], q[3], *[q[i] for i in range(5, 9)])
    rows = x.quantile_preds.withColumn("pred", F.when(F.col("actual") < 0, swapped).otherwise(q))
    return metrics.quantile_crossing(rows).select("fold", "isin", "date")


@query
def evaluation_report(x: Inputs) -> DataFrame:
    path = scratch_path(x.spark, "report")
    report = rounded(rounded(evaluation.evaluation_report(x.preds), *_SUMMARY, *_BACKTEST,
                             "overall_mean_ic"), "mse", dp=9)
    sinks.write_report(report, path)
    return x.spark.read.schema(report.schema).json(path)


# ------------------------------------------------------------------ flagship

@query
def flagship_rank_ic(x: Inputs) -> DataFrame:
    """Bars to daily rank IC of the plain one-day return, summarised per year."""
    rows = x.features.filter(F.col("ret_1").isNotNull() & F.col("fwd_ret_1").isNotNull()).select(
        F.year("date").alias("year"), "date",
        F.round("ret_1", 10).alias("pred"), F.round("fwd_ret_1", 10).alias("actual"))
    daily = metrics.rank_ic_by_date(rows, ["year", "date"])
    return rounded(metrics.summarize_ic(daily, ["year"]), *_SUMMARY)
