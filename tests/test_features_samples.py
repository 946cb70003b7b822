import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barfold.functions.arrays import patchify
from barfold.operators import samples
from barfold.operators.features import compute_features
from barfold.operators.samples import panel_index, panel_tensors, sample_index, sample_windows
from barfold.schemas import FEATURE_COLUMNS
from tests.helpers import adjusted, same_rows, weekdays


@pytest.fixture(scope="module")
def prices(spark):
    rnd = random.Random(11)
    dates = weekdays(330, dt.date(2015, 1, 1))
    series = {}
    for k in "ABC":
        level = 100.0
        series[k] = []
        for i, d in enumerate(dates):
            if k == "C" and i % 5 == 0:
                continue  # trades on fewer days
            level *= math.exp(rnd.gauss(0, 0.02))
            series[k].append((d, level))
    df = adjusted(spark, series).withColumn("volume", F.abs(F.hash("isin", "date")) % 1000 + 1.0)
    return df.cache()


def test_features_match_pandas(prices):
    got = compute_features(prices).toPandas().sort_values(["isin", "date"])
    for _, g in got.groupby("isin"):
        r = np.log(g.close_adj).diff()
        lv = np.log(g.volume + 1)
        assert np.allclose(g.ret_1, r, equal_nan=True)
        assert np.allclose(g.ret_h, np.log(g.high_adj) - np.log(g.close_adj.shift()), equal_nan=True)
        rv = r.rolling(20, min_periods=20).std()
        assert np.allclose(g.ret_1_volscaled, r / (rv + 1e-8), equal_nan=True)
        base = lv.rolling(252, min_periods=63)
        assert np.allclose(g.vol_z, (lv - base.median()) / (base.std() + 1e-8), equal_nan=True)
        assert np.allclose(g.fwd_ret_1, r.shift(-1), equal_nan=True)
        assert list(g.has_sufficient_history) == [i >= 60 for i in range(len(g))]
        dow = pd.to_datetime(g.date).dt.dayofweek + 1
        assert np.allclose(g.dow_sin, np.sin(2 * np.pi * dow / 7))


def test_features_are_causal(prices):
    """Features up to T do not change when the rows after T are removed."""
    cut = dt.date(2015, 12, 1)
    cols = ["isin", "date", *FEATURE_COLUMNS, "has_sufficient_history"]
    full = compute_features(prices).filter(F.col("date") <= F.lit(cut)).select(*cols)
    past = compute_features(prices.filter(F.col("date") <= F.lit(cut))).select(*cols)
    assert full.count() > 500 and same_rows(full, past)


def test_nonpositive_prices_invalidate_windows(spark, prices):
    bad = prices.withColumn("open_adj", F.when(
        (F.col("isin") == "A") & (F.col("date") == F.lit(dt.date(2016, 1, 4))), 0.0).otherwise(F.col("open_adj")))
    a = sample_index(compute_features(prices), 10).filter("isin = 'A'").count()
    b = sample_index(compute_features(bad), 10).filter("isin = 'A'").count()
    assert a - b == 10


def test_sample_index_matches_brute_force(prices):
    seq = 10
    pdf = compute_features(prices).toPandas().sort_values(["isin", "date"])
    want = set()
    for isin, g in pdf.groupby("isin"):
        feats, y = g[list(FEATURE_COLUMNS)].to_numpy(float), g.fwd_ret_1.to_numpy(float)
        for e in range(seq - 1, len(g) - 1):
            if g.has_sufficient_history.iloc[e] and not np.isnan(feats[e - seq + 1:e + 1]).any() and not np.isnan(y[e]):
                want.add((isin, g.date.iloc[e], g.date.iloc[e + 1], e))
    got = {tuple(r) for r in sample_index(compute_features(prices), seq).collect()}
    assert got == want and len(want) > 500


def test_windows_hold_the_trailing_rows(prices):
    seq = 5
    feats = compute_features(prices)
    pdf = feats.toPandas().sort_values(["isin", "date"])
    by_isin = {k: g[list(FEATURE_COLUMNS)].to_numpy(float) for k, g in pdf.groupby("isin")}
    for r in sample_windows(feats, seq).filter("isin = 'C'").collect():
        e = r["array_idx"]
        assert np.allclose(np.array(r["window"]), by_isin["C"][e - seq + 1:e + 1])
    assert sample_windows(feats, seq, as_float=True).schema["window"].dataType.simpleString() == "array<array<float>>"


def test_windows_of_what_each_row_gives(prices):
    """A cell is worked out once a row: windows of row texts are the texts of the windows' rows."""
    feats = compute_features(prices)
    text = F.concat_ws(",", *[F.round(F.col(c) * 1e6).cast("long") for c in FEATURE_COLUMNS])
    keys = ["isin", "feature_end_date", "label_date", "array_idx", "target"]
    told = sample_windows(feats, 5, cell=text).withColumn("window", F.array_join("window", ","))
    whole = sample_windows(feats, 5).withColumn("window", F.array_join(F.transform(
        F.flatten("window"), lambda x: F.round(x * 1e6).cast("long")), ","))
    assert told.count() > 500 and same_rows(told.select(*keys, "window"), whole.select(*keys, "window"))
    with pytest.raises(ValueError):
        sample_windows(feats, 5, as_float=True, cell=text)


@pytest.mark.parametrize("seq, patch", [(120, 7), (6, 3), (5, 9), (4, 4), (7, 1)])
def test_patches_are_cut_from_the_window_itself(spark, seq, patch):
    rows = [[float(i), float(-i)] for i in range(1, seq + 1)]
    window = F.col("w")
    made = spark.createDataFrame([(rows,)], "w array<array<double>>").select(patchify(window, seq, 2, patch).alias("p"))
    missing = -seq % patch
    padded = [[0.0, 0.0]] * missing + rows
    assert made.first()["p"] == [sum(padded[i:i + patch], []) for i in range(0, seq + missing, patch)]
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("concat(") <= 2  # none inside the function that is run for each patch
    assert "slice(concat" not in plan


def _panel_features(spark, names, n_days, history_from=3):
    start = dt.date(2020, 1, 1)
    rows = []
    for k in names:
        for i in range(n_days):
            rows.append((k, start + dt.timedelta(days=i), *[float(i)] * 12,
                         0.02 if i < n_days - 1 else None, i >= history_from))
    cols = ", ".join(f"{c} double" for c in (*FEATURE_COLUMNS, "fwd_ret_1"))
    return spark.createDataFrame(rows, f"isin string, date date, {cols}, has_sufficient_history boolean")


def test_panels(spark):
    feats = _panel_features(spark, "ABCDE", 10)
    universe = spark.createDataFrame([(k,) for k in "ABCDE"], "isin string")
    rows = panel_tensors(feats, universe, seq_len=4, min_symbols_per_date=3, shards=1).orderBy("feature_end_date").collect()
    assert [r["feature_end_date"].day for r in rows] == [4, 5, 6, 7, 8, 9]
    for r in rows:
        assert r["isins"] == list("ABCDE") and r["n_names"] == 5
        assert r["label_date"] == r["feature_end_date"] + dt.timedelta(days=1)
        # the newest row of every window is the anchor day itself
        assert all(w[-1][0] == r["feature_end_date"].day - 1 and len(w) == 4 for w in r["windows"])
    assert panel_index(feats, universe, 4, min_symbols_per_date=6).count() == 0
    two = panel_index(feats, universe.filter("isin < 'C'"), 4, min_symbols_per_date=2)
    assert {r["isin"] for r in two.collect()} == {"A", "B"}


def test_large_panels_are_spread_not_cut(spark):
    names = [f"N{i:02d}" for i in range(20)]
    feats = _panel_features(spark, names, 6)
    universe = spark.createDataFrame([(k,) for k in names], "isin string")
    rows = panel_tensors(feats, universe, 4, 3, shards=4).collect()
    assert {r["shard"] for r in rows} == {0, 1, 2, 3}
    for d in {r["feature_end_date"] for r in rows}:
        assert sorted(n for r in rows if r["feature_end_date"] == d for n in r["isins"]) == names


def test_panels_are_cut_from_rows_not_from_moved_windows(spark, prices):
    """The names' windows in panels are those of the samples, across years, and no window is moved or sorted."""
    feats = compute_features(prices).cache()
    universe = feats.select("isin").distinct()
    made = panel_tensors(feats, universe, 30, 2)
    got = {(r["feature_end_date"], k): (w, t) for r in made.collect() for k, w, t in zip(r["isins"], r["windows"], r["targets"])}
    want = {(r["feature_end_date"], r["isin"]): (r["window"], r["target"]) for r in sample_windows(feats, 30).collect()}
    listed = {(r["feature_end_date"], r["isin"]) for r in panel_index(feats, universe, 30, 2).collect()}
    assert len(listed) > 400 and len({d.year for d, _ in listed}) == 2
    assert got.keys() == listed and all(got[k] == want[k] for k in listed)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_panels_move_the_rows_that_windows_need_and_sort_none(spark):
    """Rows before the first window stay where they are, and records of a shard and year are cut as they come."""
    feats = _panel_features(spark, ["N1", "N2", "N3"], 900, history_from=500)
    made = panel_tensors(feats, feats.select("isin").distinct(), 20, 2)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Sort [shard" not in plan and "REPARTITION" in plan
    rows = feats.orderBy("isin", "date").select(
        "isin", "date", (F.col("has_sufficient_history") & F.col("fwd_ret_1").isNotNull()).alias("_usable"),
        F.col("fwd_ret_1").alias("target"), F.col("ret_1").cast("long").cast("string").alias("cell")).toArrow()
    packed = [r for b in samples._packed(iter(rows.to_batches(70)), 20) for r in b.to_pylist()]
    cells = [samples._from_bytes(pa.scalar(r["cells"])).to_pylist() for r in packed]
    days = lambda a, b: [str(i) for i in range(a, b + 1)]
    assert [(r["isin"], r["_year"]) for r in packed] == [(k, y) for k in ("N1", "N2", "N3") for y in (2021, 2022)]
    assert cells == [days(481, 730), days(712, 898)] * 3  # 2022 begins at row 731
    assert [len(r["at"]) for r in packed] == [231, 168] * 3 and [r["at"][0] for r in packed] == [19] * 6


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_panels_do_not_depend_on_how_records_come(spark, size):
    """Names in any order and any number of batches, years that share a partition: each panel has its names in order."""
    names = [f"N{i:02d}" for i in range(12)]
    day = lambda i: dt.date(1990, 12, 25) + dt.timedelta(days=i + (i > 9) * 365 * 32)
    rows = pa.table({
        "isin": [k for k in names for _ in range(20)], "date": [day(i) for _ in names for i in range(20)],
        "_usable": [i >= 4 for _ in names for i in range(20)], "target": [float(i) for _ in names for i in range(20)],
        "cell": [f"{k}.{i}" for k in names for i in range(20)]})
    records = [b for x in rows.to_batches() for b in samples._packed(iter([x]), 3)]
    table = pa.Table.from_batches(records)
    table = table.append_column("shard", pa.array([0] * table.num_rows, pa.int32()))
    mixed = table.take(pa.array([(7 * i) % table.num_rows for i in range(table.num_rows)]))
    got = {r["feature_end_date"]: r for b in samples._cut(iter(mixed.combine_chunks().to_batches(size)), 3) for r in b.to_pylist()}
    assert sorted(got) == [day(i) for i in range(4, 20)]
    for i in range(4, 20):
        assert got[day(i)]["isins"] == names and got[day(i)]["targets"] == [float(i)] * 12
        assert got[day(i)]["windows"] == [[f"{k}.{j}" for j in (i - 2, i - 1, i)] for k in names]


def test_panel_target_date_can_pass_the_label_date(spark, prices):
    feats = compute_features(prices).cache()
    universe = spark.createDataFrame([("A",), ("B",), ("C",)], "isin string")
    late = panel_index(feats, universe, 5, 1).filter("target_date > label_date")
    assert late.count() > 0 and {r["isin"] for r in late.select("isin").distinct().collect()} == {"C"}
