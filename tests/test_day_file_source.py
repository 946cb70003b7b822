"""Zipped day files through the data source: batch, stream and writer."""

import datetime as dt
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from barfold.sources import bars as src
from barfold.sources import day_file_source as ds
from tests.helpers import same_rows
from tests.test_sources import DAYS, OLD, land


@pytest.fixture
def landed(tmp_path):
    for name, text in DAYS.items():
        land(tmp_path, name, text)
    (tmp_path / "2024" / "2024-01-02.zip").write_bytes(b"not a zip")
    return tmp_path


def test_same_bars_as_from_contents(spark, landed):
    assert same_rows(ds.read_bars_from_source(spark, str(landed)), src.read_bars(spark, str(landed)))
    parsed = src.parse_lines(ds.day_file_lines(spark, f"file:{landed}"))
    assert [r.file for r in src.quarantined_files(parsed).collect()] == ["2024-01-02.zip"]
    assert ds.read_bars_from_source(spark, str(landed / "nothing")).count() == 0


def test_bounds_open_no_other_file(spark, landed):
    got = src.parse_lines(ds.day_file_lines(spark, str(landed), dt.date(2024, 1, 1), dt.date(2024, 1, 1)))
    assert {r._file for r in got.collect()} == {"2024-01-01.zip"}
    assert src.quarantined_files(got).isEmpty()


def test_files_are_dealt_by_size(monkeypatch):
    monkeypatch.setattr(ds, "TASK_BYTES", 100)
    monkeypatch.setattr(ds, "TASK_FILES", 3)
    files = [(f"f{i}", 60 if i < 3 else 10) for i in range(10)]
    assert [p.paths for p in ds._dealt(files)] == [["f0"], ["f1"], ["f2", "f3", "f4"], ["f5", "f6", "f7"], ["f8", "f9"]]


def test_stream_finds_each_file_once_whatever_its_time(spark, landed, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")

    def run():
        stream = ds.day_file_line_stream(spark, str(landed), str(out / "found"))
        query = src.good_bars(src.parse_lines(stream)).writeStream.trigger(availableNow=True)
        query.option("checkpointLocation", str(out / "cp")).format("parquet").start(str(out / "bars")).awaitTermination()
        return spark.read.parquet(str(out / "bars"))

    assert run().count() == 4 and run().count() == 4
    land(landed, "2023-05-05", OLD)
    os.utime(landed / "2023" / "2023-05-05.zip", (1, 1))  # lands late with an old time
    assert run().count() == 5
    assert same_rows(run(), src.read_bars(spark, str(landed)))
    with pytest.raises(Exception, match="log"):
        spark.readStream.format(ds.FORMAT).load(str(landed)).writeStream.format("noop").start().awaitTermination()


def test_written_files_are_read_back(spark, tmp_path):
    rows = [(f"{day}.zip", text.splitlines()[0], line) for day, text in DAYS.items() for line in text.splitlines()[1:]]
    lines = spark.createDataFrame(rows, ds.FILE_LINES)
    ds.write_day_files(lines.repartition(5), str(tmp_path / "out"))
    assert sorted(p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out").rglob("*.*")) == [
        "1998/1998-01-02.zip", "2024/2024-01-01.zip", "2026/2026-08-27.zip"]
    with zipfile.ZipFile(tmp_path / "out" / "2024" / "2024-01-01.zip") as z:
        assert z.read("day.csv").decode() == OLD.rstrip("\n")
    for day, text in DAYS.items():
        land(tmp_path / "in", day, text)
    assert same_rows(ds.read_bars_from_source(spark, str(tmp_path / "out")), src.read_bars(spark, str(tmp_path / "in")))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    lines = spark.createDataFrame([("2024-01-01.zip", "H", "a"), ("2024-01-02.zip", "H", "b")], ds.FILE_LINES)
    failing = lines.withColumn("line", F.when(F.col("line") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        ds.write_day_files(failing, str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]


def test_quotes_and_wide_headers(spark, tmp_path):
    header, row = OLD.splitlines()
    quoted = ",".join(f'" {t}"' for t in header.split(","))
    land(tmp_path, "2024-01-01", f'{quoted}\n"AC\nME",EQ{row[7:]}\n"SAY ""HI""",EQ{row[7:]}\nO"NE,EQ{row[7:]}\n')
    wide = ",".join([*header.split(","), *(f"X{i}" for i in range(60))])
    land(tmp_path, "2024-01-02", f"{wide}\n{row}\n")
    land(tmp_path, "2024-01-03", f'{header}\n{row}\n"never closed\n')
    for parsed in (src.parse_day_files(src.read_zip_files(spark, str(tmp_path))), src.parse_lines(ds.day_file_lines(spark, str(tmp_path)))):
        assert sorted(r.symbol for r in src.good_bars(parsed).collect()) == ["AC\nME", 'O"NE', 'SAY "HI"']
        assert {r.close for r in src.good_bars(parsed).collect()} == {10.5}
        assert {r.file: r.error.split(":")[0] for r in src.quarantined_files(parsed).collect()} == {
            "2024-01-02.zip": "ValueError", "2024-01-03.zip": "ValueError"}
