import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from barfold.schemas import BARS, NEW_LAYOUT, OLD_LAYOUT
from barfold.sources import bars as src
from barfold.sources.reference_data import (
    action_records, fetch_log_status, quarantined_actions, pending_sessions, read_actions, read_index_membership, session_plan, status_counts,
)
from barfold.sources.sinks import write_report, write_review_queue
from barfold.streaming.ingest import (
    failed_files, ingest_incremental, landed_zip_stream, load_ingested, load_ingested_latest, retry_failed,
)
from barfold.operators.features import compute_features
from tests.helpers import adjusted, bar, bars, same_rows

EARLY = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP\n" \
        "ACME , EQ,10,11,9,10.5,10.4, ,1000,10500.5,02-JAN-1998\nBOND,BE,x,1,1,1,1,1,1,1,02-JAN-1998\n"
OLD = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN\n" \
      "ACME,EQ,10,11,9,10.5,10.4,10.1,1000,10500.5,01-JAN-2024,12, INE001 \n"
NEW = "TradDt, FinInstrmTp ,ISIN,TckrSymb,SctySrs,ClsPric,OpnPric,HghPric,LwPric,LastPric,PrvsClsgPric,TtlTrfVal,TtlTradgVol,TtlNbOfTxsExctd\n" \
      "2026-08-27,STK,INE001,ACME,EQ,10.5,10,11,9,10.4,10.1,10500.5,1000,12.0\n" \
      "2026-08-27,GSEC,IN9,TBILL,GS,1,1,1,1,1,1,1,1,1\n"
DAYS = {"1998-01-02": EARLY, "2024-01-01": OLD, "2026-08-27": NEW}


def land(root, name, text):
    folder = root / name[:4]
    folder.mkdir(exist_ok=True, parents=True)
    with zipfile.ZipFile(folder / f"{name}.zip", "w") as z:
        z.writestr("bhav.csv", text)


@pytest.fixture
def landed(tmp_path):
    for name, text in DAYS.items():
        land(tmp_path, name, text)
    (tmp_path / "2024" / "2024-01-02.zip").write_bytes(b"not a zip")
    land(tmp_path, "2024-01-03", "a,b\n1,2\n")
    return tmp_path


def _check(df):
    assert df.schema.simpleString() == BARS.simpleString()
    got = {(r["date"].year, r["symbol"]): r for r in df.collect()}
    assert set(got) == {(1998, "ACME"), (1998, "BOND"), (2024, "ACME"), (2026, "ACME")}
    early, old, new = got[1998, "ACME"], got[2024, "ACME"], got[2026, "ACME"]
    assert early["isin"] is None and early["n_trades"] is None and early["prev_close"] is None
    assert early["series"] == "EQ" and early["turnover"] == 10500.5
    assert got[1998, "BOND"]["open"] is None
    assert old["isin"] == new["isin"] == "INE001" and old["n_trades"] == new["n_trades"] == 12
    assert old.asDict() | {"date": 0} == new.asDict() | {"date": 0}
    assert new["date"] == dt.date(2026, 8, 27)


def test_zipped_layouts(spark, landed):
    _check(src.read_bars(spark, str(landed)))


def test_bad_files_are_set_aside(spark, landed):
    parsed = src.parse_day_files(src.read_zip_files(spark, str(landed))).cache()
    bad = {r["file"]: r["error"] for r in src.quarantined_files(parsed).collect()}
    assert set(bad) == {"2024-01-02.zip", "2024-01-03.zip"} and "BadZipFile" in bad["2024-01-02.zip"]
    stats = src.ingest_stats(src.good_bars(parsed)).first()
    assert stats.asDict() == {"years": 3, "days": 3, "rows": 4}


def test_unpacked_layouts(spark, tmp_path):
    for name, text in DAYS.items():
        (tmp_path / f"{name}.csv").write_text(text)
    _check(src.read_bars_csv(spark, str(tmp_path)))
    # A row that looks like a header is a row; a file without a known header is set aside, not lost.
    (tmp_path / "2024-02-01.csv").write_text(OLD + OLD.splitlines()[1].replace("ACME", "SYMBOL") + "\n")
    (tmp_path / "2024-02-02.csv").write_text("a,b\n1,2\n")
    parsed = src.parse_day_files(src.read_files(spark, str(tmp_path), "*.csv"))
    assert {r["symbol"] for r in src.good_bars(parsed).filter("date = date'2024-02-01'").collect()} == {"ACME", "SYMBOL"}
    assert [tuple(r) for r in src.quarantined_files(parsed).collect()] == [("2024-02-02.csv", "no known day-file header")]


def test_layout_maps_cover_the_bar_columns():
    want = {f.name for f in BARS.fields} - {"date"}
    assert set(OLD_LAYOUT.values()) == want and set(NEW_LAYOUT.values()) == want | {"instrument_type"}


def test_year_store_replaces_only_its_years(spark, tmp_path):
    path = str(tmp_path / "store")
    first = bars(spark, [bar("A", dt.date(2019, 1, 1)), bar("A", dt.date(2020, 1, 1))])
    src.write_by_year(first, path)
    src.write_by_year(bars(spark, [bar("A", dt.date(2020, 1, 1), close=7.0)]), path)
    got = {r["date"].year: r["close"] for r in src.load_bars(spark, path).collect()}
    assert got == {2019: 100.0, 2020: 7.0}
    (tmp_path / "void").mkdir()
    with pytest.raises(FileNotFoundError):
        src.load_bars(spark, str(tmp_path / "void"))


def test_scan_prunes_years_and_pushes_filters(spark, tmp_path):
    path = str(tmp_path / "store")
    src.write_by_year(bars(spark, [bar(k, dt.date(y, 6, 1)) for k in "AB" for y in (2018, 2019, 2020)]), path)
    df = src.scan_curated(spark, path, isins=["A"], start=dt.date(2019, 1, 1), end=dt.date(2019, 12, 31)).select("isin", "date")
    assert df.count() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [" in plan
    assert "GreaterThanOrEqual(date,2019-01-01)" in plan and "LessThanOrEqual(date,2019" in plan
    assert "ReadSchema: struct<date:date,isin:string>" in plan


def _rows_scanned(df):
    """Rows that the scans of an executed plan gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scans = plan.collectLeaves().mkString("|") and plan.collectLeaves()
    return sum(scans.apply(i).metrics().get("numOutputRows").get().value() for i in range(scans.size()))


def test_a_list_of_securities_skips_row_groups(spark, tmp_path):
    """Isins of one range in turn in every row group: ranges skip nothing, bloom filters do."""
    names = [f"INE{k:04d}" for k in range(400)]
    rows = spark.createDataFrame([(n, dt.date(2019, 1, 1) + dt.timedelta(days=d)) for n in names for d in range(50)], "isin string, date date")
    spread = rows.withColumn("year", F.year("date")).withColumn("part", F.pmod(F.xxhash64("isin"), F.lit(16)))
    for part in range(16):
        src._store_writer(spread.filter(F.col("part") == part).drop("part").coalesce(1)).mode("append").partitionBy("year").parquet(str(tmp_path / "s"))
    asked = src.scan_curated(spark, str(tmp_path / "s"), isins=names[7:9]).select("isin", "date")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert asked.count() == 100
        assert _rows_scanned(src.scan_curated(spark, str(tmp_path / "s"), isins=names[7:9]).select("isin", "date")) < rows.count() / 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_table_by_security_needs_no_exchange(spark, tmp_path):
    prices = adjusted(spark, {f"INE{k:03d}": [(dt.date(2019, 1, 1) + dt.timedelta(days=d), 100.0 + d) for d in range(80)] for k in range(20)})
    src.write_by_security(prices, "prices_by_security", str(tmp_path / "t"), buckets=8)
    try:
        stored = spark.table("prices_by_security")
        plan = compute_features(stored)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        keys = ["isin", "date"]
        assert same_rows(compute_features(stored).select(*keys, "ret_1", "vol_z"), compute_features(prices).select(*keys, "ret_1", "vol_z"))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert _rows_scanned(stored.filter("isin = 'INE007'")) < prices.count() / 3  # only its bucket
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        src.write_by_security(prices.filter("isin > 'INE010'"), "prices_by_security", str(tmp_path / "t"), buckets=8)
        assert spark.table("prices_by_security").select("isin").distinct().count() == 9
    finally:
        spark.sql("DROP TABLE IF EXISTS prices_by_security")


def test_incremental_reads_each_file_once(spark, landed, tmp_path_factory):
    out = tmp_path_factory.mktemp("inc")
    target, checkpoint = str(out / "bars"), str(out / "cp")

    def run():
        ingest_incremental(landed_zip_stream(spark, str(landed)), target, checkpoint)
        return load_ingested(spark, target)

    assert run().count() == 4
    assert run().count() == 4
    land(landed, "2024-01-04", OLD)
    got = run()
    assert got.count() == 5 and same_rows(got, src.read_bars(spark, str(landed)))
    land(landed, "2024-01-04-restated", OLD.replace("10.5,", "99.0,"))
    assert run().filter("date = date'2024-01-04'").count() == 2
    assert load_ingested_latest(spark, target).filter("date = date'2024-01-04'").count() == 1


def test_failed_files_are_kept_and_read_again(spark, landed, tmp_path_factory):
    out = tmp_path_factory.mktemp("retry")
    target, checkpoint = str(out / "bars"), str(out / "cp")

    def run():
        ingest_incremental(landed_zip_stream(spark, str(landed)), target, checkpoint)
        return {r["path"].rsplit("/", 1)[1] for r in failed_files(spark, target).collect()}

    assert run() == {"2024-01-02.zip", "2024-01-03.zip"}
    land(landed, "2024-01-02", OLD)
    assert run() == {"2024-01-03.zip"} and load_ingested(spark, target).count() == 5
    (landed / "2024" / "2024-01-03.zip").unlink()
    assert run() == {"2024-01-03.zip"} and load_ingested(spark, target).count() == 5


def test_files_that_stay_broken_hold_no_place(spark, tmp_path):
    landing, target = tmp_path / "in", str(tmp_path / "bars")
    days = [f"2024-01-0{n}" for n in (2, 3, 4, 5)]
    for day in days:
        land(landing, day, OLD)
    zips = [next(landing.rglob(f"{day}.zip")) for day in days]
    for path in zips:
        path.write_bytes(b"no zip")
    ingest_incremental(landed_zip_stream(spark, str(landing)), target, str(tmp_path / "cp"))
    assert failed_files(spark, target).count() == 4
    zips[0].unlink()
    land(landing, days[3], OLD)
    retry_failed(spark, target, at_most=2)
    assert {r["path"][-14:-4] for r in failed_files(spark, target).collect()} == set(days[:3])
    assert load_ingested(spark, target).count() == len(OLD.splitlines()) - 1


def test_latest_restatement_keeps_rows_without_isin(spark, tmp_path):
    landing, target, checkpoint = tmp_path / "in", str(tmp_path / "bars"), str(tmp_path / "cp")
    early = DAYS[next(n for n in DAYS if n.startswith("1998"))]
    for day in ("1998-01-05", "2024-01-05", "2024-01-06"):
        land(landing, day, early if day < "2000" else OLD)
    ingest_incremental(landed_zip_stream(spark, str(landing)), target, checkpoint)
    land(landing, "2024-01-05-again", OLD.replace("10.5,", "99.0,"))
    land(landing, "2024-01-06-again", OLD.replace("10.5,", "1.0,"))
    ingest_incremental(landed_zip_stream(spark, str(landing)), target, checkpoint)
    got = load_ingested_latest(spark, target).collect()
    assert len([r for r in got if r["date"].year == 1998]) == len(early.splitlines()) - 1
    again = {r["date"].day: r for r in got if r["date"].year == 2024}
    assert len(got) == len(early.splitlines()) + 1
    assert 99.0 in again[5].asDict().values() and 1.0 in again[6].asDict().values()


def test_actions_feed(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(
        '{"isin":"I","symbol":"S","series":"EQ","exDate":"%s","subject":"Bonus 1:1","other":1}' % d
        for d in ("06-Jan-2020", "6-JAN-2020", " 07-jan-2020 ", "-", "junk", "31-Feb-2020")))
    got = read_actions(spark, str(tmp_path))
    assert got.columns == ["isin", "symbol", "series", "ex_date", "subject"]
    assert sorted(r["ex_date"].day for r in got.collect()) == [6, 6, 7]
    (tmp_path / "b.json").write_text('[\n {"isin": "J",\n  "exDate": "06-Jan-2020"},\n {"isin": "K", "exDate": "07-Jan-2020"}\n]\n')
    (tmp_path / "c.json").write_text('[{"isin": "L", \n')
    (tmp_path / "d.json").write_text('{"isin": "M", "exDate": "08-Jan-2020"}\nno json\n')
    assert {r["isin"] for r in read_actions(spark, str(tmp_path)).collect()} == {"I", "J", "K", "M"}
    bad = quarantined_actions(action_records(spark, str(tmp_path))).collect()
    assert sorted((r["file"][-6:], r["text"][:7]) for r in bad) == [("c.json", '[{"isin'), ("d.json", "no json")]
    (tmp_path / "none").mkdir()
    assert read_actions(spark, str(tmp_path / "none")).schema == got.schema


def test_action_feed_is_read_in_splits(spark, tmp_path):
    rows = [{"isin": f"I{i}", "symbol": "S", "series": "EQ", "exDate": "06-Jan-2020", "subject": "x" * (i % 50)} for i in range(3000)]
    (tmp_path / "lines.json").write_text("\n\n" + "\n".join(map(json.dumps, rows)) + "\n[no record\n")
    (tmp_path / "array.json").write_text("\n \n" + json.dumps(rows, indent=1))
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, 1 << 15)
    try:
        records = action_records(spark, str(tmp_path))
        got = records.groupBy(F.element_at(F.split("_file", "/"), -1)).agg(
            F.count("isin"), F.count_distinct("isin"), F.count("_corrupt")).collect()
        splits = spark.read.text(str(tmp_path / "lines.json")).rdd.getNumPartitions()
    finally:
        spark.conf.set(size, before)
    assert splits > 3
    assert {tuple(r) for r in got} == {("lines.json", 3000, 3000, 1), ("array.json", 3000, 3000, 0)}


def test_index_lists(spark, tmp_path):
    for name in ("BIG", "SMALL"):
        (tmp_path / f"{name}.csv").write_text(" Company Name ,Industry,Symbol,Series,ISIN Code\nAcme Ltd,Tools,ACME,EQ,INE1\n")
    got = read_index_membership(spark, {n: str(tmp_path / f"{n}.csv") for n in ("BIG", "SMALL")}, dt.date(2024, 1, 1))
    assert got.columns == ["as_of_date", "index", "symbol", "isin", "company_name", "industry", "series"]
    assert sorted(r["index"] for r in got.collect()) == ["BIG", "SMALL"]


def test_session_planning(spark):
    d = lambda n: dt.date(2024, 1, n)  # noqa: E731  (Monday the 1st)
    dates = lambda *n: spark.createDataFrame([(d(i),) for i in n], "date date")
    bounds = spark.createDataFrame([(d(1), d(9))], "start date, end date")
    args = bounds, dates(1, 2, 2), dates(2, 3)
    assert sorted(r["date"].day for r in pending_sessions(*args).collect()) == [4, 5, 8, 9]
    assert {r["status"]: r["n"] for r in status_counts(session_plan(*args)).collect()} == {
        "skipped_existing": 2, "skipped_holiday": 1, "pending": 4}


def test_fetch_log(spark):
    rows = [("2024-01-01", "error", 1), ("2024-01-01", "holiday", 2), ("2024-01-01", "error", 3),
            ("2024-01-02", "error", 1), ("2024-01-03", "error", 1), ("2024-01-03", "ok", 2)]
    log = spark.createDataFrame(rows, "date string, status string, attempt_ts int").withColumn("date", F.col("date").cast("date"))
    got = {r["date"].day: (r["status"], r["n_attempts"], r["pending"]) for r in fetch_log_status(log).collect()}
    assert got == {1: ("holiday", 3, False), 2: ("error", 1, True), 3: ("ok", 2, False)}


def test_sinks(spark, tmp_path):
    rows = bars(spark, [bar("A", dt.date(2020, 1, 1))])
    write_review_queue(rows, str(tmp_path / "q"))
    assert spark.read.option("header", True).csv(str(tmp_path / "q")).first()["isin"] == "A"
    write_report(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1


def test_only_quoted_lines_meet_the_csv_parser(spark):
    titles = src._BETWEEN.join(t.strip() for t in OLD.splitlines()[0].split(","))
    plain, cells = " ACME\t, EQ ,10,11,9,x,NaN,,1000,5e3,,12, INE001 ,more", "ACME EQ 10 11 9 x NaN  1000 5e3  12 INE001 more".split(" ")
    rows = [("/l/2024-01-01.zip", titles, line, None) for line in (plain, ",".join(f'"{c}"' for c in cells), "ACME,EQ", "")]
    parsed = src.parse_lines(spark.createDataFrame(rows, src.LINES))
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_csv(") == 1 and 'CASE WHEN Contains(line' in plan.split("from_csv(")[0].splitlines()[-1]
    first, second, short, empty = parsed.collect()
    assert first == second and (first.isin, first.open, first.close, first.last, first.n_trades) == ("INE001", 10.0, None, None, 12)
    assert (short.symbol, short.series, short.isin, empty.symbol) == ("ACME", "EQ", None, None)


def test_day_files_are_packed_once(spark):
    from workload import fixtures
    raw = fixtures.bars_raw(spark, "/root/testdata/sf0.001")
    files = fixtures.day_files(spark, raw)
    assert files._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.path: bytes(r.content) for r in files.collect()}
    bad = {p: c for p, c in got.items() if p.endswith("_bad.zip")}
    years = {r.y for r in raw.select(F.year("date").alias("y")).distinct().collect()}
    assert {int(p.split("/")[2]) for p in bad} == years and len(bad) == len(years)
    for path, content in bad.items():
        whole = path.replace("_bad.zip", ".zip")
        assert whole == min(p for p in got if p.split("/")[2] == path.split("/")[2]) and content == got[whole][:20]
