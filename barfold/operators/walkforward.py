"""Purged, embargoed walk-forward splits and their controls."""

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barfold.operators.ranking import position_by_hash, position_by_isin

EMBARGO_DAYS = 10
MIN_TRAIN, MIN_TEST = 200, 20
MIN_TRAIN_PANELS, MIN_TEST_PANELS = 50, 5


@dataclass(frozen=True)
class Fold:
    label: str
    test_start: dt.date
    test_end: dt.date


def yearly_folds(years: Sequence[int]) -> list[Fold]:
    """One fold per test year; training is everything before it."""
    return [Fold(str(y), dt.date(y, 1, 1), dt.date(y, 12, 31)) for y in years]


def folds_frame(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    return spark.createDataFrame(
        [(f.label, f.test_start, f.test_end) for f in folds],
        "fold string, test_start date, test_end date",
    )


def yearly_folds_of(rows: DataFrame) -> DataFrame:
    """The same folds for every calendar year that occurs in ``rows``."""
    years = rows.select(F.year("date").alias("y")).distinct()
    return years.select(
        F.col("y").cast("string").alias("fold"),
        F.make_date("y", F.lit(1), F.lit(1)).alias("test_start"),
        F.make_date("y", F.lit(12), F.lit(31)).alias("test_end"),
    )


def session_cutoffs(
    calendar: DataFrame, folds: Sequence[Fold], embargo_sessions: int
) -> dict[str, dt.date]:
    """Per fold, the date ``embargo_sessions`` market days before its test start.

    One aggregate over the market days (a calendar) for all folds; one row comes back.
    """
    days = F.sort_array(F.collect_set("date"))

    def cutoff(f: Fold) -> Column:
        before = F.filter("days", lambda d: d < F.lit(f.test_start))
        return F.get(before, F.greatest(F.size(before) - embargo_sessions, F.lit(0)))

    row = calendar.agg(days.alias("days")).select(*[
        cutoff(f).alias(f"c{i}") for i, f in enumerate(folds)]).first()
    return {f.label: row[i] or f.test_start for i, f in enumerate(folds)}


def _cutoff(fold: Fold, embargo_days: int, cutoffs: dict[str, dt.date] | None) -> dt.date:
    if cutoffs is not None:
        return cutoffs[fold.label]
    return fold.test_start - dt.timedelta(days=embargo_days)


def _embargo_cutoffs(
    folds: Sequence[Fold], embargo_days: int, unit: str, calendar: DataFrame | None
) -> dict[str, dt.date] | None:
    """Cutoffs by market days; none if the embargo counts calendar days."""
    if unit == "days":
        return None
    if unit != "sessions":
        raise ValueError(f"unknown embargo unit {unit!r}")
    if calendar is None:
        raise ValueError("a session embargo needs the market calendar")
    return session_cutoffs(calendar, folds, embargo_days)


def training_cutoffs(
    folds: Sequence[Fold], embargo_days: int = EMBARGO_DAYS, embargo_unit: str = "days", calendar: DataFrame | None = None
) -> dict[str, dt.date]:
    """Per fold the date before which a label must be known to train on it."""
    cutoffs = _embargo_cutoffs(folds, embargo_days, embargo_unit, calendar)
    return {f.label: _cutoff(f, embargo_days, cutoffs) for f in folds}


def assign_splits(
    samples: DataFrame,
    folds: Sequence[Fold],
    embargo_days: int = EMBARGO_DAYS,
    embargo_unit: str = "days",
    calendar: DataFrame | None = None,
    realized_column: str | None = None,
) -> DataFrame:
    """Rows (fold, split, sample) for every fold a sample takes part in.

    ``train``: the label is known before the embargo; ``test``: window end and
    label both inside the fold. The short fold list travels as a literal array,
    so this is a narrow map: no join, no shuffle. Samples in the embargo gap or
    after the fold give no row for it. With ``embargo_unit="sessions"`` the
    embargo counts days of ``calendar``. ``realized_column`` is the date on which the target is really known (a panel's
    ``target_date``): training then needs both dates before the embargo, and a row without one does not train.
    """
    cutoffs = _embargo_cutoffs(folds, embargo_days, embargo_unit, calendar)
    known = F.col("label_date")
    if realized_column is not None:
        known = F.when(F.col(realized_column).isNotNull(), F.greatest("label_date", realized_column))

    def membership(f: Fold) -> Column:
        split = F.when(known < F.lit(_cutoff(f, embargo_days, cutoffs)), "train").when(
            (F.col("feature_end_date") >= F.lit(f.test_start))
            & (F.col("label_date") <= F.lit(f.test_end)), "test")
        return F.struct(F.lit(f.label).alias("fold"), split.alias("split"))

    taken = F.filter(F.array(*map(membership, folds)), lambda m: m["split"].isNotNull())
    return samples.select(F.inline(taken), *samples.columns)


def filter_split(assigned: DataFrame, split: str, fold: str | None = None) -> DataFrame:
    rows = assigned.filter(F.col("split") == split)
    return rows if fold is None else rows.filter(F.col("fold") == fold)


def fold_counts(
    assigned: DataFrame, min_train: int = MIN_TRAIN, min_test: int = MIN_TEST
) -> DataFrame:
    """Train/test size per fold and whether the fold is large enough to use."""
    sizes = assigned.groupBy("fold").agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
    )
    usable = (F.col("n_train") >= min_train) & (F.col("n_test") >= min_test)
    return sizes.withColumn("usable", usable)


def panel_fold_counts(
    assigned: DataFrame, min_train: int = MIN_TRAIN_PANELS, min_test: int = MIN_TEST_PANELS
) -> DataFrame:
    """``fold_counts`` of panel dates instead of names: each (fold, split, date) counts once."""
    panels = assigned.select("fold", "split", "feature_end_date").distinct()
    return fold_counts(panels, min_train, min_test)


def leakage_guard(
    train: DataFrame,
    folds: Sequence[Fold],
    embargo_days: int = EMBARGO_DAYS,
    realized_column: str = "label_date",
    embargo_unit: str = "days",
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Training rows whose label resolves on or after their fold's embargo cutoff.

    Independent of ``assign_splits``: it looks only at the assembled rows. A row of an unknown
    or null fold, or without a label date, is a violation too. Pass
    ``realized_column="target_date"`` to check when a panel target really became
    known rather than its nominal label date; ``embargo_unit`` and ``calendar`` are those of
    ``assign_splits``.
    """
    cutoff = _guard_cutoff(folds, embargo_days, embargo_unit, calendar)
    return train.withColumn("embargo_cutoff", cutoff).filter(~_safe(realized_column, F.col("embargo_cutoff")))


def _guard_cutoff(folds: Sequence[Fold], embargo_days: int, embargo_unit: str, calendar: DataFrame | None) -> Column:
    cutoffs = _embargo_cutoffs(folds, embargo_days, embargo_unit, calendar)
    limits = F.create_map(*[
        F.lit(x) for f in folds for x in (f.label, _cutoff(f, embargo_days, cutoffs))])
    return F.try_element_at(limits, F.col("fold"))


def _safe(realized_column: str, cutoff: Column) -> Column:
    return F.coalesce(F.col(realized_column) < cutoff, F.lit(False))


def guarded(
    assigned: DataFrame,
    folds: Sequence[Fold],
    embargo_days: int = EMBARGO_DAYS,
    realized_column: str = "label_date",
    embargo_unit: str = "days",
    calendar: DataFrame | None = None,
) -> DataFrame:
    """``assigned``, whose training rows are checked as they are read: one that leaks fails the job that reads it.

    The check is that of ``leakage_guard``, made where ``split`` is read: fitting and guarding share one scan, and what
    selects training rows can't go by the guard. A row that is in no known split counts as a training row.
    """
    cutoff = _guard_cutoff(folds, embargo_days, embargo_unit, calendar)
    told = F.concat_ws(" ", F.lit("leakage:"), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (
        "fold", "isin", "label_date", realized_column)])
    fine = F.coalesce(F.col("split") == "test", F.lit(False)) | _safe(realized_column, cutoff)
    # In the value of the column and not as a filter, which the optimizer may move before the one on the split.
    return assigned.withColumn("split", F.when(fine, F.col("split")).otherwise(F.raise_error(told).cast("string")))


def assert_no_leakage(train: DataFrame, folds: Sequence[Fold], **guard) -> None:
    """Raise if the guard finds any row."""
    leaks = leakage_guard(train, folds, **guard).take(1)
    if leaks:
        raise AssertionError(f"leakage: {leaks[0].asDict()}")


def shuffle_labels(
    samples: DataFrame, target: str = "fwd_ret_1", seed: int = 0, out: str = "shuffled_target"
) -> DataFrame:
    """A seeded permutation of the targets over the same samples.

    The i-th sample in (isin, date) order receives the target of the i-th
    sample in the order of a seeded hash. Both positions are found through
    buckets, so no step orders all samples in one task.
    """
    mixed = F.md5(F.concat_ws("|", "isin", "feature_end_date", F.lit(str(seed))))
    givers = position_by_hash(
        samples.select("isin", "feature_end_date", F.col(target).alias(out), mixed.alias("_h")),
        "_h", ["isin", "feature_end_date"], "_pos").select("_pos", out)
    takers = position_by_isin(samples, ["feature_end_date"], "_pos")
    return takers.join(givers, "_pos").select(*samples.columns, out)


def pending_folds(folds: DataFrame, results: DataFrame) -> DataFrame:
    """Folds without a stored result."""
    return folds.join(results.select("fold").distinct(), "fold", "left_anti")
