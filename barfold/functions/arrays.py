"""Column expressions over feature windows and quantile forecasts."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from barfold.schemas import QUANTILES


def patchify(window: Column, seq_len: int, n_features: int, patch_size: int) -> Column:
    """Cut a ``seq_len x n_features`` window into flattened patches.

    When ``patch_size`` does not divide ``seq_len`` the past side is filled
    with zero rows, so the newest patch always holds real rows only.
    """
    missing = -seq_len % patch_size
    # Only the first patch is filled: the others are cut from the window itself, without a padded copy of it for each.
    whole = patch_size - missing if missing else 0
    patches = []
    if missing:
        zero_rows = F.array_repeat(F.array_repeat(F.lit(0.0), n_features), missing)
        patches.append(F.array(F.flatten(F.concat(zero_rows, F.slice(window, 1, whole)))))
    if whole < seq_len:
        starts = F.sequence(F.lit(whole + 1), F.lit(seq_len), F.lit(patch_size))
        patches.append(F.transform(starts, lambda s: F.flatten(F.slice(window, s, patch_size))))
    return F.concat(*patches) if len(patches) > 1 else patches[0]


def pinball_terms(
    pred: Column, actual: Column, quantiles: Sequence[float] = QUANTILES
) -> Column:
    """Per-quantile loss array: q*e for an under-forecast, (q-1)*e for an over-forecast."""
    levels = F.array(*[F.lit(float(q)) for q in quantiles])
    return F.zip_with(
        pred, levels, lambda p, q: F.greatest((q - 1) * (actual - p), q * (actual - p))
    )


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)


def quantiles_cross(pred: Column, n_quantiles: int = len(QUANTILES)) -> Column:
    """True where some forecast quantile lies above the next higher one."""
    return F.exists(
        F.sequence(F.lit(0), F.lit(n_quantiles - 2)), lambda i: pred[i] > pred[i + 1]
    )
