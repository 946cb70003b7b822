"""Small numeric and calendar expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def signum_deadzone(pred: Column, deadzone: float = 0.0) -> Column:
    """-1, 0 or +1; zero inside the dead zone and for a null or NaN forecast."""
    return F.when(is_active(pred, deadzone), F.signum(pred)).otherwise(0.0)


def is_active(pred: Column, deadzone: float = 0.0) -> Column:
    """Whether a forecast takes a position; null and NaN do not."""
    return F.coalesce((F.abs(pred) > deadzone) & ~F.isnan(pred), F.lit(False))


def cyclical(position: Column, period: int) -> tuple[Column, Column]:
    angle = position.cast("double") * F.lit(2 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def calendar_columns(date: Column) -> dict[str, Column]:
    """Cyclical weekday (Monday = 1), day-of-month and month encodings."""
    out: dict[str, Column] = {}
    for name, position, period in (
        ("dow", F.weekday(date) + 1, 7),
        ("dom", F.day(date), 31),
        ("month", F.month(date), 12),
    ):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclical(position, period)
    return out


def sharpe(returns: Column, periods_per_year: int = 252) -> Column:
    """Aggregate: annualised mean over sample deviation, 0 where undefined."""
    clean = F.when(~F.isnan(returns), returns)
    spread = F.stddev_samp(clean)
    return F.when(
        (F.count(clean) >= 2) & (spread > 0),
        F.lit(math.sqrt(periods_per_year)) * F.avg(clean) / spread,
    ).otherwise(0.0)


def hit_share(pred: Column, actual: Column, deadzone: float = 0.0) -> Column:
    """Aggregate: share of active rows whose sign is right; null if none is active."""
    right = (F.signum(pred) == F.signum(actual)).cast("double")
    return F.avg(F.when(is_active(pred, deadzone), right))
