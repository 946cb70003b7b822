"""Causal features and the one forward-looking label.

Precondition: at most one row per (isin, date) — run ``dedupe_bars`` first.
That uniqueness bounds a window partition by the calendar (a few thousand
rows per security), so partitioning by isin cannot produce a hot task, and
one exchange plus one sort on (isin, date) serves every frame below.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barfold.functions.scalars import calendar_columns
from barfold.operators.rolling import RollingDeviation, RollingMedian
from barfold.schemas import TARGET_COLUMN

VOL_WINDOW = 20
VOLUME_WINDOW = 252
VOLUME_MIN_ROWS = VOLUME_WINDOW // 4
MIN_HISTORY = 60
EPS = 1e-8


def by_date() -> WindowSpec:
    return Window.partitionBy("isin").orderBy("date")


def trailing(rows: int) -> WindowSpec:
    return by_date().rowsBetween(1 - rows, Window.currentRow)


def log_returns(prices: DataFrame) -> DataFrame:
    """ret_1, ret_o, ret_h, ret_l against the previous adjusted close.

    A price of zero or below has no logarithm here and gives null.
    """
    prev = F.ln(F.lag("close_adj").over(by_date()))
    sources = {"ret_1": "close_adj", "ret_o": "open_adj", "ret_h": "high_adj", "ret_l": "low_adj"}
    return prices.withColumns({out: F.ln(src) - prev for out, src in sources.items()})


def _guarded(value, column: str, rows: int, least: int):
    """A trailing aggregate that stays null until ``least`` non-null inputs exist."""
    frame = trailing(rows)
    return F.when(F.count(column).over(frame) >= least, value.over(frame))


def realized_vol(rows: DataFrame, window: int = VOL_WINDOW) -> DataFrame:
    """Trailing sample deviation of ret_1, once a full window is present."""
    return rows.withColumn(
        "realized_vol_20", _guarded(F.stddev_samp("ret_1"), "ret_1", window, window)
    )


def volume_baseline(
    rows: DataFrame, window: int = VOLUME_WINDOW, min_rows: int = VOLUME_MIN_ROWS
) -> DataFrame:
    """Trailing exact median and deviation of log volume, once ``min_rows`` values are there.

    A security's rows stream in date order through a sorted window (an Arrow map), which costs a search per row where a
    window function orders the whole frame again for each. The exchange and sort are those of the other features' windows.
    """
    logged = rows.withColumns({"log_vol": F.ln(F.col("volume") + 1), "_place": F.row_number().over(by_date())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        median, deviation, seen = RollingMedian(window, min_rows), RollingDeviation(window, min_rows), 0
        for batch in batches:
            place = np.asarray(batch.column("_place"))
            if not np.array_equal(place, np.arange(seen + 1, seen + 1 + len(place))):
                raise RuntimeError("a security's rows did not arrive in date order")
            seen += len(place)
            values = batch.column("log_vol").to_numpy(zero_copy_only=False)
            out = batch.drop_columns(["_place"])
            for name, statistic in (("log_vol_baseline", median), ("log_vol_std", deviation)):
                out = out.append_column(name, pa.array(statistic.of(values), pa.float64(), from_pandas=True))
            yield out

    schema = T.StructType([
        *logged.drop("_place").schema.fields,
        *(T.StructField(c, T.DoubleType()) for c in ("log_vol_baseline", "log_vol_std"))])
    return logged.groupBy("isin").applyInArrow(run, schema)


def scaled_features(rows: DataFrame) -> DataFrame:
    """Volatility-scaled return and volume z-score."""
    return rows.withColumns({
        "ret_1_volscaled": F.col("ret_1") / (F.col("realized_vol_20") + EPS),
        "vol_z": (F.col("log_vol") - F.col("log_vol_baseline")) / (F.col("log_vol_std") + EPS),
    })


def calendar_encoding(rows: DataFrame) -> DataFrame:
    return rows.withColumns(calendar_columns(F.col("date")))


def forward_return(prices: DataFrame) -> DataFrame:
    """fwd_ret_1: the next session's log return. A label, never an input."""
    return prices.withColumn(
        "fwd_ret_1", F.ln(F.lead("close_adj").over(by_date())) - F.ln("close_adj")
    )


def history_flag(rows: DataFrame, min_history: int = MIN_HISTORY) -> DataFrame:
    return rows.withColumn(
        "has_sufficient_history", F.row_number().over(by_date()) > min_history
    )


def compute_features(prices: DataFrame) -> DataFrame:
    """All feature columns, the label and the history flag, rows unchanged.

    Every window function comes before the Arrow map of ``volume_baseline`` and everything after it is row by row: one
    exchange and one sort in all.
    """
    out = prices
    for step in (log_returns, realized_vol, forward_return, history_flag, volume_baseline, scaled_features,
                 calendar_encoding):
        out = step(out)
    last = [TARGET_COLUMN, "has_sufficient_history"]
    return out.select(*[c for c in out.columns if c not in last], *last)
