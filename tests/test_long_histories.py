"""Features by buckets of time with a halo against features by whole securities."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barfold.operators.features import compute_features
from barfold.operators.long_histories import REACH, compute_features_long, with_halo
from tests.helpers import adjusted, same_rows


@pytest.fixture(scope="module")
def prices(spark):
    """A long history, one with gaps of months, one with very uneven months, short ones, one without isin."""
    rnd = random.Random(4)
    days = [dt.date(2012, 1, 1) + dt.timedelta(days=d) for d in range(1500)]
    series = {
        "LONG": days, "GAPS": [d for d in days if d.month in (1, 2, 7)], "THIN": [d for d in days if d.day == 5 or d.month == 3],
        "ONE": days[:1], "TWO": [days[0], days[-1]], None: days[:300]}
    made = adjusted(spark, {k: [(d, rnd.uniform(50, 150)) for d in v] for k, v in series.items()})
    made = made.withColumn("volume", F.when(F.dayofmonth("date") != 9, F.pmod(F.xxhash64("isin", "date"), F.lit(9000)).cast("double")))
    return made.cache()


@pytest.mark.parametrize("unit", ["month", "year", "week"])
def test_same_features_whatever_the_bucket(prices, unit):
    def told(df):
        doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
        return df.withColumns({c: F.round(c, 9) for c in doubles})

    whole, parts = told(compute_features(prices)), told(compute_features_long(prices, F.trunc("date", unit)))
    assert whole.columns == parts.columns
    assert same_rows(whole, parts)


def test_no_partition_is_longer_than_a_bucket_and_its_halo(prices):
    dealt = with_halo(prices, F.trunc("date", "month"))
    largest = dealt.groupBy("isin", "_target").count().agg(F.max("count")).first()[0]
    assert largest <= 31 + REACH + 1
    assert dealt.filter(F.col("_bucket").eqNullSafe(F.col("_target"))).count() == prices.count()


def test_no_rows(prices):
    assert compute_features_long(prices.limit(0)).count() == 0


def test_small_buckets_are_put_together(prices):
    """A halo for every bucket would be some ten times the rows; a history below ``least`` rows has none at all."""
    dealt = with_halo(prices, F.trunc("date", "month"), least=400)
    n = prices.count()
    assert dealt.count() <= n + (REACH + 1) * (n // 400)
    assert dealt.filter("_own").count() == n
    assert dealt.filter(F.col("isin").isin("THIN", "TWO", "ONE")).filter("not _own").isEmpty()
    assert dealt.groupBy("isin", "_target").count().agg(F.max("count")).first()[0] <= 400 + 31 + REACH + 1


@pytest.mark.parametrize("least", [1, 7, 300])
def test_same_features_however_buckets_are_put_together(prices, least):
    def told(df):
        doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
        return df.withColumns({c: F.round(c, 9) for c in doubles})

    assert same_rows(told(compute_features(prices)), told(compute_features_long(prices, F.trunc("date", "week"), least)))
