"""Features over histories too long for one window partition (minute bars): buckets of time with a halo.

A security's rows are cut into buckets of time. Every bucket also gets the rows before it that its windows reach back to and the
one after it that its label needs, and is then a security of its own to the feature steps. Which buckets a row goes to follows
from the row counts per bucket alone, so no step ever holds a whole history.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barfold.operators.features import MIN_HISTORY, VOLUME_WINDOW, compute_features

#: Rows before a bucket that its first row's features reach: the longest window, or one more for a lagged price in the shorter one.
REACH = VOLUME_WINDOW
#: Rows within which buckets are put together: the halo adds a quarter to a long history, and nothing to a shorter one.
LEAST = 4 * (REACH + 1)


def _deals(counts: DataFrame, reach: int, least: int) -> DataFrame:
    """(isin, bucket, start, target, target_start, target_end): which parts a bucket's rows may go to, from (isin, bucket, n).

    A part is one bucket, or several that follow each other and begin within the same ``least`` rows; its ``target`` is its first
    bucket. A security's list of buckets is one row; a part, not a security, is what its rows are bounded by.
    """
    in_order = Window.partitionBy("isin").orderBy("bucket")
    placed = counts.withColumn("start", F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["start"])
    listed = placed.groupBy("isin").agg(F.sort_array(F.collect_list(F.struct("start", "bucket", "n"))).alias("b"))

    def of_part(i: Column) -> Column:
        return F.floor(F.get("b", i)["start"] / least)

    firsts = F.filter(F.sequence(F.lit(0), F.size("b") - 1), lambda i: (i == 0) | (of_part(i) > of_part(i - 1)))
    ends = F.concat(F.slice("p", 2, F.size("p")), F.array(F.size("b")))
    parts = F.zip_with("p", ends, lambda first, end: F.named_struct(
        F.lit("target"), F.get("b", first)["bucket"], F.lit("target_start"), F.get("b", first)["start"],
        F.lit("target_end"), F.get("b", end - 1)["start"] + F.get("b", end - 1)["n"]))
    each = listed.withColumn("p", firsts).select("isin", parts.alias("parts"), F.inline("b"))
    taken = F.filter("parts", lambda t: (
        F.col("start") <= t["target_end"]) & (F.col("start") + F.col("n") > t["target_start"] - reach))
    return each.select("isin", "bucket", "start", F.inline(taken))


def with_halo(rows: DataFrame, bucket: Column, reach: int = REACH, least: int = 1) -> DataFrame:
    """``rows`` with ``_bucket``, ``_target`` and ``_at`` (0-based in the security): each row once in every part that needs it.

    ``_own`` marks the one part that a row belongs to. With ``least`` small buckets are put together, so that the halo, which is
    ``reach`` rows whatever the part's size, stays a small share of all rows: at most (``reach`` + 1) / ``least``.
    """
    marked = rows.withColumn("_bucket", bucket).withColumn("_of", F.struct("isin", "_bucket"))
    counts = marked.groupBy("isin", F.col("_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    deals = _deals(counts, reach, least).select(
        F.struct("isin", F.col("bucket").alias("_bucket")).alias("_of"), "start", F.col("target").alias("_target"), "target_start", "target_end")
    # One key (a struct is never null) for the numbering and the join: the rows move once for both.
    inside = F.row_number().over(Window.partitionBy("_of").orderBy("date")) - 1
    dealt = marked.withColumn("_inside", inside).join(deals, "_of").withColumn("_at", F.col("start") + F.col("_inside"))
    own = (F.col("_at") >= F.col("target_start")) & (F.col("_at") < F.col("target_end"))
    near = (F.col("_at") >= F.col("target_start") - reach) & (F.col("_at") <= F.col("target_end"))
    return dealt.filter(near).withColumn("_own", own).drop("_of", "start", "target_start", "target_end", "_inside")


def compute_features_long(prices: DataFrame, bucket: Column | None = None, least: int = LEAST) -> DataFrame:
    """The rows of ``compute_features``, with no window partition longer than a bucket, ``least`` rows and their halo.

    ``bucket`` is a column that never falls as the date rises (by default the month); the same rows come out whatever it is.
    Buckets that begin within the same ``least`` rows of a security are one partition.
    """
    dealt = with_halo(prices, F.trunc("date", "month") if bucket is None else bucket, least=least)
    apart = dealt.withColumns({"_isin": F.col("isin"), "isin": F.struct("isin", "_target")})
    made = compute_features(apart).filter("_own")
    columns = [c for c in made.columns if c not in ("_isin", "_bucket", "_target", "_at", "_own")]
    values = {"isin": F.col("_isin"), "has_sufficient_history": F.col("_at") >= MIN_HISTORY}
    return made.select(*[values.get(c, F.col(c)).alias(c) for c in columns])
