import datetime as dt
import re

from barfold.operators.curate import (
    backfill_isin, dedupe_bars, select_equity_rows, tradable_range,
)
from barfold.operators.quality import quality_failing, quality_gate, quality_per_isin, stale_streaks
from barfold.operators.universe import liquid_universe, top_liquid
from barfold.plans.curated import build_curated, load_curated, quality_report
from barfold.session import scratch_path
from tests.helpers import bar, bars, day, same_rows


def test_select_equity_rows(spark):
    rows = bars(spark, [bar("A", day(0)), bar("B", day(0), series="BE"), bar("C", day(0), close=None),
                        bar("D", day(0), symbol=""), bar("E", day(0), symbol=None)])
    assert [r["isin"] for r in select_equity_rows(rows).collect()] == ["A"]


def test_backfill_prefers_the_most_frequent_then_smallest_isin(spark):
    rows = [bar(None, day(0), symbol="X"), bar("", day(1), symbol="X")]
    rows += [bar("INE2", day(i), symbol="X") for i in (2, 3)] + [bar("INE1", day(4), symbol="X")]
    rows += [bar(None, day(0), symbol="Y"), bar("INE9", day(1), symbol="Y"), bar("INE8", day(2), symbol="Y")]
    rows += [bar(None, day(0), symbol="Z")]
    got = {(r["symbol"], r["date"]): (r["isin"], r["isin_is_symbol_fallback"])
           for r in backfill_isin(bars(spark, rows)).collect()}
    assert got[("X", day(0))] == got[("X", day(1))] == ("INE2", False)
    assert got[("X", day(4))] == ("INE1", False)
    assert got[("Y", day(0))] == ("INE8", False)
    assert got[("Z", day(0))] == ("SYM:Z", True)


def test_dedupe_is_total_and_repeatable(spark):
    rows = [bar("A", day(0), close=c, symbol=s) for c, s in ((3.0, "B"), (2.0, "A"), (1.0, "A"))]
    for order in (rows, rows[::-1]):
        got = dedupe_bars(bars(spark, order)).collect()
        assert len(got) == 1 and (got[0]["symbol"], got[0]["close"]) == ("A", 1.0)


def test_range_ends_at_the_last_real_session(spark):
    rows = [bar("A", dt.date(y, 1, 1), symbol=s) for y, s in ((2010, "OLD"), (2020, "NEW"), (2026, "NEW"))]
    rows += [bar("B", d) for d in (dt.date(2010, 1, 1), dt.date(2015, 6, 1), dt.date(2012, 1, 1))]
    got = {r["isin"]: r for r in tradable_range(bars(spark, rows)).collect()}
    assert got["B"]["last_date"] == dt.date(2015, 6, 1) and got["B"]["n_sessions"] == 3
    assert got["A"]["last_symbol"] == "NEW" and got["A"]["symbols_seen"] == ["NEW", "OLD"]


def test_quality_rules(spark):
    rows = []
    for i in range(40):
        rows.append(bar("GOOD", day(i), close=100.0 + i))
        rows.append(bar("STALE", day(i), close=5.0 if i < 20 else 6.0 + i))
        rows.append(bar("ZERO", day(i), close=50.0 + i, volume=0.0 if i % 8 == 0 else 1.0))
        if i < 10:
            rows.append(bar("SHORT", day(i), close=1.0))
        if i % 2 == 0:
            rows.append(bar("GAPS", day(i), close=10.0 + i))
    rows.append(bar("BADHL", day(3), close=5.0, high=4.0))
    df = bars(spark, rows)
    per = quality_per_isin(df)
    got = {r["isin"]: r for r in per.collect()}
    assert got["STALE"]["max_stale_streak"] == 20
    assert got["ZERO"]["n_zero_volume"] == 5 and got["ZERO"]["zero_volume_fraction"] == 0.125
    assert got["GAPS"]["expected_sessions"] == 39 and got["GAPS"]["missing_sessions"] == 19
    assert got["BADHL"]["n_ohlc_violations"] == 1
    assert {r["isin"] for r in quality_failing(per).collect()} == {"STALE", "ZERO"}
    gate = quality_gate(per, df).first()
    assert (gate["n_isins_judged"], gate["n_isins_failing"], gate["gate"]) == (4, 2, "RED")
    assert gate["pct_isins_failing"] == 50.0 and gate["n_trading_days_in_calendar"] == 40
    streaks = {r["isin"]: r["max_stale_streak"] for r in stale_streaks(df).collect()}
    assert streaks == {k: r["max_stale_streak"] for k, r in got.items()}


AS_OF = dt.date(2020, 6, 30)


def _liquid_rows():
    back = [AS_OF - dt.timedelta(days=i) for i in range(60)]
    return (
        [bar("A", d, turnover=1e8) for d in back] + [bar("B", d, turnover=1e5) for d in back]
        + [bar("C", d, turnover=1e8, series="BE") for d in back]
        + [bar("D", d, turnover=1e8) for d in back[:5]]
        + [bar("A", AS_OF + dt.timedelta(days=5), turnover=1e12)])


def test_universe_filters_and_ignores_the_future(spark):
    got = liquid_universe(bars(spark, _liquid_rows()), AS_OF).collect()
    assert [r["isin"] for r in got] == ["A"]
    assert got[0]["adv_inr"] == 1e8 and got[0]["n_sessions"] == 60


def test_top_liquid_uses_the_last_date_and_orders(spark):
    rows = [bar(k, AS_OF - dt.timedelta(days=i), turnover=t)
            for k, t in (("A", 2e7), ("B", 3e7), ("C", 3e7), ("D", 5e6)) for i in range(200)]
    got = top_liquid(bars(spark, rows), 2).collect()
    assert [r["isin"] for r in got] == ["B", "C"] and got[0]["as_of_date"] == AS_OF


def test_build_curated_store(spark, tmp_path):
    rows = [bar("A", dt.date(2019, 12, 30)), bar("A", dt.date(2020, 1, 2)),
            bar("A", dt.date(2020, 1, 2)), bar("B", dt.date(2020, 1, 2), series="BE")]
    actions = spark.createDataFrame(
        [("A", "T", "EQ", dt.date(2020, 1, 1), "Bonus 1:1"), ("A", "T", "EQ", dt.date(2020, 1, 9), "Bonus issue")],
        "isin string, symbol string, series string, ex_date date, subject string")
    root = scratch_path(spark, "store")
    stats = build_curated(bars(spark, rows), actions, root).first()
    assert stats.asDict() == {"rows": 2, "years": 2, "isins": 1, "n_adjustment_events": 1}
    got = load_curated(spark, root).orderBy("date").collect()
    assert [r["close_adj"] for r in got] == [50.0, 100.0]
    assert spark.read.option("header", True).csv(f"{root}/corporate_actions/unparsed_actions").count() == 1
    assert quality_report(load_curated(spark, root), f"{root}/quality").first()["gate"] == "GREEN"
    no_actions = build_curated(bars(spark, rows), None, scratch_path(spark, "store")).first()
    assert no_actions["n_adjustment_events"] == 0


def test_only_rows_without_an_isin_are_looked_up(spark):
    """Rows that have one would all move by symbol for nothing."""
    rows = bars(spark, [bar("INE1", day(0), symbol="A"), bar("INE1", day(1), symbol="A"), bar(None, day(2), symbol="A"),
                        bar("", day(3), symbol="A"), bar(None, day(4), symbol="B"), bar("", day(5), symbol="")])
    got = backfill_isin(rows)
    assert sorted((r.date, r.isin, r.isin_is_symbol_fallback) for r in got.collect()) == [
        (day(0), "INE1", False), (day(1), "INE1", False), (day(2), "INE1", False), (day(3), "INE1", False),
        (day(4), "SYM:B", True), (day(5), "SYM:", True)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    top = plan.splitlines()[0]
    assert top.startswith("Union") and "Join LeftOuter" in plan


def test_trades_move_once_and_are_not_combined_before(spark):
    from workload import fixtures

    plan = fixtures.bars_raw(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_stored_features_have_no_prices(spark):
    from barfold.schemas import FEATURE_COLUMNS, TARGET_COLUMN
    from workload.queries import Inputs

    stored = Inputs(spark, "/root/testdata/sf0.001").features
    assert stored.columns == ["isin", "date", *FEATURE_COLUMNS, TARGET_COLUMN, "has_sufficient_history"]


def test_ranges_move_each_security_once(spark):
    rows = bars(spark, [bar("A", day(i % 3), symbol=f"S{i % 2}") for i in range(6)] + [bar("B", day(5)), bar("B", None)])
    ranges = tradable_range(rows)
    assert ranges._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert dict(ranges.dtypes)["n_sessions"] == "bigint"
    assert {r.isin: r.n_sessions for r in ranges.collect()} == {"A": 3, "B": 1}


def test_curated_rows_move_once_more_whatever_the_join(spark):
    from barfold.operators.features import compute_features
    from barfold.plans.curated import curate
    from workload.queries import Inputs, _PRICES

    x = Inputs(spark, "/root/testdata/sf0.001")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plans = {}
    try:
        for size in (limit, "-1"):  # a factor table of any size: broadcast, and too large for that
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
            rows = compute_features(curate(x.raw, x.actions, parts=5).select(*_PRICES))
            plans[size] = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plans["-1"]
    for plan in plans.values():
        # The bars and the factors, each once, and neither again for the join, the windows or the Arrow map.
        moves = re.findall(r"Exchange hashpartitioning\(isin#\d+, (\d+)\), (\w+)", plan)
        assert moves == [("5", "REPARTITION_BY_NUM")] * 2


def test_session_embargo_stores_no_curated_rows(spark, tmp_path):
    import shutil

    from barfold.operators.samples import sample_index
    from barfold.session import kept_table
    from workload.queries import QUERIES, Inputs

    source = str(tmp_path / "sf")  # a folder of its own: nothing is built for it yet
    shutil.copytree("/root/testdata/sf0.001", source)
    got = QUERIES["assign_splits_sessions"](spark, source)
    assert kept_table(f"{source}/samples", spark, source) is not None
    assert kept_table(f"{source}/curated", spark, source) is None
    x = Inputs(spark, source)
    assert "Exchange" not in sample_index(x.features)._jdf.queryExecution().executedPlan().toString()
    on_the_way = x.prices
    x.curated  # from now on features are made of the stored rows
    stored = Inputs(spark, source).prices
    assert same_rows(stored, on_the_way) and got.count() > 0
    assert x.bars_raw.filter("prev_close <=> close AND last <=> close").count() == x.bars_raw.count()
