"""Curated bars to walk-forward report, as one chain of stored steps."""

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barfold.operators.features import compute_features
from barfold.operators.metrics import (
    IC_THRESHOLD, mse_loss, rank_ic_summary, sign_backtest,
)
from barfold.operators.samples import panel_index, sample_index
from barfold.operators.signals import fit_predict_ar1, fit_predict_quantiles, median_forecast
from barfold.operators.universe import restrict_to_universe
from barfold.operators.walkforward import (
    EMBARGO_DAYS, Fold, assign_splits, fold_counts, folds_frame, guarded, panel_fold_counts, pending_folds,
)
from barfold.plans.fingerprint import digest, of_table
from barfold.schemas import TARGET_COLUMN
from barfold.session import stage_table
from barfold.sources.sinks import write_report


def labelled_samples(curated: DataFrame, seq_len: int = 120) -> DataFrame:
    """Valid samples with the narrow columns the baselines need."""
    return sample_index(compute_features(curated), seq_len, keep=["ret_1", TARGET_COLUMN])


def labelled_panels(curated: DataFrame, universe: DataFrame, seq_len: int = 120, min_names: int = 5) -> DataFrame:
    """Names of every panel of the universe with the columns the baselines need.

    ``label_date`` is the panel's, the next market day; ``target_date`` says when the name's own target is known.
    """
    features = stage_table(compute_features(curated), "panel-features")
    panels = panel_index(features, universe, seq_len, min_names, keep=["ret_1"])
    return panels.withColumnRenamed("target", TARGET_COLUMN)


def usable_folds(assigned: DataFrame, by_panel: bool = False, **limits: int) -> DataFrame:
    """Rows of the folds that are large enough to fit and score, in names or in panel dates."""
    counts = panel_fold_counts if by_panel else fold_counts
    keep = counts(assigned, **limits).filter("usable").select("fold")
    return assigned.join(F.broadcast(keep), "fold", "left_semi")  # one row per fold


def ar1_forecasts(assigned: DataFrame) -> DataFrame:
    return fit_predict_ar1(assigned)


def median_forecasts(assigned: DataFrame) -> DataFrame:
    """The fitted 0.5 quantile as forecast."""
    return median_forecast(fit_predict_quantiles(assigned))


def walk_forward_predictions(
    samples: DataFrame, folds: Sequence[Fold], embargo_days: int = EMBARGO_DAYS,
    forecasts: Callable[[DataFrame], DataFrame] = ar1_forecasts, panels: bool = False,
) -> DataFrame:
    """Forecasts for every usable fold; a training row that leaks fails the job that fits on it.

    Fold membership multiplies rows, and counting, fitting and predicting each
    need them, so ``samples`` should be a stored, narrow table. With ``panels`` they are those of ``labelled_panels``:
    a name whose own next row comes after the embargo does not train, though its panel's label date would let it.
    """
    realized = "target_date" if panels else "label_date"
    assigned = usable_folds(
        assign_splits(samples, folds, embargo_days, realized_column=realized if panels else None), panels)
    return forecasts(guarded(assigned, folds, embargo_days, realized))


def fold_results(preds: DataFrame, book: str = "per_symbol") -> DataFrame:
    """Per-fold rank IC, backtest and loss. ``preds`` is read by three reductions; pass a stored table."""
    return (
        rank_ic_summary(preds).join(sign_backtest(preds, book=book), "fold")
        .join(mse_loss(preds), "fold")
    )


def with_verdict(results: DataFrame) -> DataFrame:
    """The overall verdict on each fold's row."""
    every = Window.partitionBy()  # one row per fold
    ic = F.col("mean_ic")
    overall = F.avg(ic).over(every)
    stable = F.coalesce(F.bool_and(ic > 0).over(every) | F.bool_and(ic < 0).over(every),
                        F.lit(False))
    return results.withColumns({
        "overall_mean_ic": overall,
        "stable_sign": stable,
        "gate_pass": F.coalesce(overall > IC_THRESHOLD, F.lit(False)) & stable,
    })


def evaluation_report(preds: DataFrame, book: str = "per_symbol") -> DataFrame:
    return with_verdict(fold_results(preds, book))


_FOLD_KEY = "run string, fold string"


def stored_folds(spark: SparkSession, root: str, run: str) -> DataFrame:
    """(fold, scores) of every fold that was run below ``root`` from the same inputs; no scores for a fold too small to use."""
    try:
        return spark.read.parquet(f"{root}/folds").filter(F.col("run") == run).drop("run")
    except AnalysisException:
        return spark.createDataFrame([], _FOLD_KEY).drop("run")


def store_folds(results: DataFrame, folds: Sequence[Fold], root: str, run: str) -> None:
    """Each fold's result in a partition of its own, which replaces what is there: writing twice leaves one."""
    every = folds_frame(results.sparkSession, folds).select("fold").join(results, "fold", "left")
    every.withColumn("run", F.lit(run)).repartition(1).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run", "fold").parquet(f"{root}/folds")


def run_evaluation(
    curated: DataFrame, folds: Sequence[Fold], root: str, seq_len: int = 120,
    embargo_days: int = EMBARGO_DAYS, book: str = "per_symbol", universe: DataFrame | None = None,
    forecasts: Callable[[DataFrame], DataFrame] = ar1_forecasts, version: str = "", panels: bool = False,
    min_names: int = 5,
) -> DataFrame:
    """Universe, features, samples, guarded fits and scores; the report is written below ``root`` and returned.

    A fold's result is stored under the fingerprint of all it was made from: the rows of ``curated`` and ``universe``, the
    parameters, the code of ``forecasts`` (with its closure and defaults) and ``version``, which the caller changes
    when something else matters. Folds that are stored under the same fingerprint are not run again; anything different is
    a run of its own beside the others. Folds that are too small are stored without scores and stay out of the report. Only
    securities of ``universe`` take part, if one is given. With ``panels`` the samples are the names of every date's panel
    of ``min_names`` or more (which needs a universe), purged by the date their own target is known.

    The inputs are hashed by one scan before anything else is done. A run that breaks off leaves its stored folds to be
    reused, and one that is repeated replaces partitions, so no fold is ever there twice.
    """
    spark = curated.sparkSession
    if panels and universe is None:
        raise ValueError("panels need a universe")
    members = None if universe is None else universe.select("isin").distinct()
    run = "run-" + digest(of_table(curated), of_table(members), seq_len, embargo_days, book, forecasts, version, panels and min_names)
    # A fold's own dates belong to its name in the store: the same label over other dates is another fold.
    named = {f"{f.label}@{f.test_start}..{f.test_end}": f for f in folds}
    asked = [Fold(name, f.test_start, f.test_end) for name, f in named.items()]
    todo = {r["fold"] for r in pending_folds(folds_frame(spark, asked), stored_folds(spark, root, run)).collect()}  # one per fold
    pending = [f for f in asked if f.label in todo]
    if pending:
        rows = curated if universe is None else restrict_to_universe(curated, universe)
        made = labelled_panels(rows, universe, seq_len, min_names) if panels else labelled_samples(rows, seq_len)
        samples = stage_table(made, "samples")
        preds = stage_table(walk_forward_predictions(samples, pending, embargo_days, forecasts, panels), "predictions")
        store_folds(fold_results(preds, book), pending, root, run)
    done = stored_folds(spark, root, run).filter(F.col("fold").isin([f.label for f in asked]) & F.col("n").isNotNull())
    labels = F.create_map(*[F.lit(x) for name, f in named.items() for x in (name, f.label)])
    ordered = ["fold", *[c for c in done.columns if c != "fold"]]
    report = with_verdict(done.withColumn("fold", labels[F.col("fold")]).select(*ordered))
    write_report(report, f"{root}/report")
    return report
