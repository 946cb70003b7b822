"""Ranks, order statistics and global positions without a one-task window.

A date's cross-section, a fold or the whole table can hold a large share of
all rows, so none of them may be one window partition. The pattern used here:

1. where one value may be repeated many times, collapse equal values with a
   partially aggregated count;
2. cut the value axis into buckets with a fixed monotone function, so equal
   values share a bucket and every re-run of a lost task agrees;
3. order inside (group, bucket), and add the number of rows in lower buckets,
   which is a running sum over the short bucket list.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS_PER_E_FOLD = 256
CELLS_PER_E_FOLD = 2  # of a rank's coarse grid
LIGHT_ROWS = 1_000_000  # most rows of a cell that a window orders
SPREAD = 64  # shares of a heavier cell
QUANTILE_GRIDS = (256, 1 << 20)  # buckets per e-fold, coarse then fine
ISIN_PREFIX = 8  # leading characters of an isin that form its bucket: four of the symbol in a fallback
HASH_DIGITS = 4  # leading hex digits of a hash that form its bucket


def magnitude_bucket(value: Column, per_e_fold: int = BUCKETS_PER_E_FOLD) -> Column:
    """Monotone integer bucket of a double: a logarithmic grid on both signs."""
    size = F.floor((F.ln(F.abs(value)) + 800.0) * per_e_fold)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0))


def _running(keys: Sequence[str], *order) -> Window:
    return (
        Window.partitionBy(*keys).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def add_offsets(
    rows: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], count: str, out: str
) -> DataFrame:
    """``out`` = total ``count`` of all rows ordered before this one within ``keys``.

    ``bucket`` must be non-decreasing in ``order``.
    """
    keys = list(keys)
    totals = rows.groupBy(*keys, bucket).agg(F.sum(count).alias("_total"))
    below = totals.select(
        *keys, bucket,
        (F.sum("_total").over(_running(keys, bucket)) - F.col("_total")).alias("_below"))
    inside = F.sum(count).over(_running([*keys, bucket], *order)) - F.col(count)
    return (
        rows.withColumn("_inside", inside)
        .join(below, [*keys, bucket])
        .withColumn(out, F.col("_below") + F.col("_inside"))
        .drop("_below", "_inside")
    )


def missing(value: Column) -> Column:
    """Null and NaN alike."""
    return value.isNull() | F.isnan(value)


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per distinct value: how often it occurs and how many rows lie below it."""
    counts = df.filter(~missing(F.col(value))).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n_equal"))
    bucketed = counts.withColumn("_bucket", magnitude_bucket(F.col(value)))
    return add_offsets(bucketed, keys, "_bucket", [value], "n_equal", "n_below").drop("_bucket")


def average_ranks(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], suffix: str = "_rank",
    light_rows: int = LIGHT_ROWS,
) -> DataFrame:
    """Tie-averaged 1-based rank of each (double) value column within ``keys``.

    A rank is the number of rows in lower cells of a coarse grid, from one partially aggregated
    count, and the place inside the own cell, from a window: one exchange of the rows per
    column. Cells of more than ``light_rows`` rows, say one value repeated many times, are never
    a window partition: their rows are spread, and take the position of their value instead, from counts
    of distinct values. Nothing runs before the result is asked for. Null and NaN have no rank
    and do not count; they are spread as well.
    """
    keys = list(keys)
    stacked = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(v).alias("_column"), F.col(v).cast("double").alias("_value")) for v in values
    ]))).filter(~missing(F.col("_value"))).withColumn("_cell", _cell(F.col("_value")))
    counts = stacked.groupBy(*keys, "_column", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    below = F.sum("_n").over(_running([*keys, "_column"], "_cell")) - F.col("_n")
    cells = counts.withColumns({"_below": below, "_heavy": F.col("_n") > light_rows})
    # At most one row per ``light_rows`` rows of the input: the broadcast is bounded.
    heavy = F.broadcast(counts.filter(F.col("_n") > light_rows).select(*keys, "_column", "_cell", F.lit(True).alias("_hot")))
    in_heavy = stacked.join(heavy, [*keys, "_column", "_cell"])
    placed = value_positions(in_heavy, [*keys, "_column", "_cell"], "_value").select(
        *keys, "_column", "_cell", "_value", (F.col("n_below") + (F.col("n_equal") + 1) / 2).alias("_heavy_rank"))

    out = df
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
    spread = F.pmod(F.xxhash64(*hashable), F.lit(SPREAD)).cast("int")
    for v in values:
        value = F.col(v).cast("double")
        own = [t.filter(F.col("_column") == v).drop("_column") for t in (heavy, cells, placed)]
        shares = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
        offsets = own[1].select(*keys, "_cell", "_below", F.explode(shares).alias("_share"))
        order = Window.partitionBy(*keys, "_cell", "_share").orderBy("_value")
        # Both ends of a run of equal values from frames that keep no rows in memory.
        first, last = F.rank().over(order), F.count("_value").over(
            order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        out = (
            out.withColumns({"_value": F.when(~missing(value), F.when(value == 0, F.lit(0.0)).otherwise(value))})
            .withColumn("_cell", _cell(F.col("_value")))
            .join(own[0], [*keys, "_cell"], "left")
            .withColumn("_share", F.when(F.col("_hot") | F.col("_value").isNull(), spread).otherwise(0))
            .withColumn("_inside", F.when(F.col("_hot").isNull() & F.col("_value").isNotNull(), (first + last) / 2))
            .join(offsets, [*keys, "_cell", "_share"], "left")
            .join(own[2], [*keys, "_cell", "_value"], "left")
            .withColumn(v + suffix, F.col("_below") + F.coalesce("_heavy_rank", "_inside"))
            .drop("_value", "_cell", "_hot", "_share", "_inside", "_below", "_heavy_rank")
        )
    return out.select(*df.columns, *[v + suffix for v in values])


def _cell(value: Column) -> Column:
    return magnitude_bucket(value, CELLS_PER_E_FOLD)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
    out: str = "quantiles",
) -> DataFrame:
    """Interpolated exact quantiles per group, as an array.

    Counting rows per coarse bucket, combined on the map side, tells which few
    buckets hold a wanted position; the same count on a much finer grid is then
    made inside those buckets only, and the values themselves are looked at
    inside the few fine buckets that remain. Every row is counted, but no more
    than a sliver of the values is ever shuffled. Meant for few groups (folds) of
    any size. Null and NaN are missing and do not count.
    """
    keys = list(keys)
    rows = df.filter(~missing(F.col(value))).select(*keys, value)
    coarse, fine = (magnitude_bucket(F.col(value), g) for g in QUANTILE_GRIDS)
    first = (
        rows.groupBy(*keys, coarse.alias("_coarse")).agg(F.count(F.lit(1)).alias("_count"))
        .withColumn("_start", F.lit(0))
        .withColumn("_n", F.sum("_count").over(Window.partitionBy(*keys)))
    )
    kept = holding_cells(first, keys, "_coarse", probs).select(*keys, "_coarse", "_n", F.col("_before").alias("_start"))
    # At most two cells per level and group (a fold) pass each filter: the broadcasts are bounded.
    second = (
        rows.withColumn("_coarse", coarse).join(F.broadcast(kept), [*keys, "_coarse"])
        .groupBy(*keys, "_coarse", "_n", "_start", fine.alias("_fine"))
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    kept = holding_cells(second, [*keys, "_coarse"], "_fine", probs).select(
        *keys, "_fine", "_n", F.col("_before").alias("_start"))
    third = (
        rows.withColumn("_fine", fine).join(F.broadcast(kept), [*keys, "_fine"])
        .groupBy(*keys, "_fine", "_n", "_start", value).agg(F.count(F.lit(1)).alias("_count"))
    )
    return interpolated_quantiles(holding_cells(third, [*keys, "_fine"], value, probs), keys, value, probs, out)


def _positions(probs: Sequence[float]) -> Column:
    return F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: p * (F.col("_n") - 1))


def holding_cells(counts: DataFrame, within: Sequence[str], order: str, probs: Sequence[float]) -> DataFrame:
    """Of cells with ``_count`` rows those that hold a wanted position of their group's ``_n``, with ``_before`` rows before.

    ``_start`` is the count before the enclosing cell ``within`` which they are ordered.
    """
    needed = F.array_distinct(F.concat(
        F.transform(_positions(probs), lambda p: F.floor(p)), F.transform(_positions(probs), lambda p: F.ceil(p))))
    inside = F.sum("_count").over(_running(within, order)) - F.col("_count")
    return counts.withColumn("_before", F.col("_start") + inside).filter(
        F.exists(needed, lambda p: (F.col("_before") <= p) & (p < F.col("_before") + F.col("_count"))))


def interpolated_quantiles(
    near: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str
) -> DataFrame:
    """Quantiles of each group from the values (``_before``, ``_count``) at their positions: two per quantile at most."""
    packed = near.groupBy(*keys).agg(
        F.collect_list(F.struct("_before", "_count", F.col(value).alias("v"))).alias("_near"),
        F.max("_n").alias("_n"))

    def value_at(pos: Column) -> Column:
        hit = F.filter("_near", lambda s: (s["_before"] <= pos)
                       & (pos < s["_before"] + s["_count"]))
        return hit[0]["v"]

    def interpolated(p: Column) -> Column:
        lo, hi = F.floor(p), F.ceil(p)
        return value_at(lo) + (value_at(hi) - value_at(lo)) * (p - lo)

    return packed.select(*keys, F.transform(_positions(probs), interpolated).alias(out))


def position_by_hash(df: DataFrame, hashed: str, ties: Sequence[str], out: str) -> DataFrame:
    """0-based position in the order of a hex hash column (then ``ties``)."""
    bucketed = df.withColumn("_bucket", F.substring(hashed, 1, HASH_DIGITS)).withColumn(
        "_one", F.lit(1))
    return add_offsets(bucketed, [], "_bucket", [hashed, *ties], "_one", out).drop(
        "_bucket", "_one")


def position_by_isin(df: DataFrame, within: Sequence[str], out: str) -> DataFrame:
    """0-based position in (isin, ``within``) order.

    Rows are numbered inside their security; securities get their offset from
    per-security counts, themselves placed through a bucket of the isin.
    """
    sizes = df.groupBy("isin").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_bucket", F.substring("isin", 1, ISIN_PREFIX))
    starts = add_offsets(sizes, [], "_bucket", ["isin"], "_n", "_start").select("isin", "_start")
    inside = F.row_number().over(Window.partitionBy("isin").orderBy(*within)) - 1
    return (
        df.withColumn("_inside", inside).join(starts, "isin")
        .withColumn(out, F.col("_start") + F.col("_inside")).drop("_start", "_inside")
    )
