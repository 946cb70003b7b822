"""Day files in, normalised bars out, and the year-partitioned bar store."""

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barfold.schemas import (
    BARS, CURATED, EQUITY_INSTRUMENT, NEW_LAYOUT, NEW_LAYOUT_MARKER, OLD_LAYOUT,
)
from barfold.session import ship_by_value

ship_by_value(__name__)

DATE_IN_NAME = r"(\d{4}-\d{2}-\d{2})(?!.*\d{4}-\d{2}-\d{2})"  # last one in the path
OLD_LAYOUT_MARKER = next(t for t, c in OLD_LAYOUT.items() if c == "symbol")
LINES_PER_BATCH = 8192
MAX_COLUMNS = 64  # columns of a day file; the layouts have 34 at most, and a file with more is set aside
LINES = "_path string, titles string, line string, _error string"
_BETWEEN = "\x1f"  # titles of a header, once read
_QUOTED = re.compile(r'(?:^|,)"')
_BLANKS = " \t\r\n\v\f\u00a0"


def _one_row(*columns: Column) -> Column:
    """Columns through a generator of one row: what is built on them does not compute them again."""
    return F.inline(F.array(F.struct(*columns)))


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _typed(field: T.StructField, text: Column) -> Column:
    """A bar column from its trimmed text cell: blank and unreadable become null."""
    if field.dataType == T.StringType():
        return F.when(text != "", text)
    number = F.nanvl(F.when(text != "", text).try_cast("double"), F.lit(None).cast("double"))
    return number.try_cast("long") if field.dataType == T.LongType() else number


# ---------------------------------------------------------------- day files

def _records(path: str, opened: BinaryIO) -> Iterator[str]:
    """Records of a day file, of a zip its first member's, unpacked as they are read; a quoted line break stays in its record."""
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(opened) as archive, archive.open(archive.infolist()[0]) as raw:
            yield from _whole(io.TextIOWrapper(raw, "utf-8-sig", newline=None))
    else:
        yield from _whole(io.TextIOWrapper(opened, "utf-8-sig", newline=None))


def _whole(lines: Iterator[str]) -> Iterator[str]:
    """Lines, joined where a cell that begins with a quote goes on; a quote inside a cell is a character like others."""
    held = ""
    for line in lines:
        held += line
        if held.count('"') % 2 == 0 or not _QUOTED.search(held):
            yield held.rstrip("\n")
            held = ""
    if held:
        raise ValueError("a quote is not closed")


def _titles(header: str) -> str:
    """A header's titles, read like any record."""
    titles = [t.strip(_BLANKS) for t in next(csv.reader([header]), [])]
    if len(titles) > MAX_COLUMNS:
        raise ValueError(f"{len(titles)} columns, more than {MAX_COLUMNS}")
    return _BETWEEN.join(titles)


def file_lines(path: str, opened: Callable[[], BinaryIO]) -> Iterator[pa.RecordBatch]:
    """(path, titles, line) of every record below a file's first one, as Arrow batches; one error row for a broken file."""
    def batch_of(titles: str | None, lines: pa.Array, error: str | None = None) -> pa.RecordBatch:
        same = [pa.repeat(pa.scalar(x, pa.string()), len(lines)) for x in (path, titles, error)]
        return pa.RecordBatch.from_arrays([*same[:2], lines, same[2]], names=["_path", "titles", "line", "_error"])

    nothing = pa.nulls(1, pa.string())

    held, good = [], []
    try:
        with opened() as content:
            lines = _records(path, content)
            titles = _titles(next(lines, ""))
            for line in lines:
                if line.strip():
                    held.append(line)
                if len(held) == LINES_PER_BATCH:
                    good.append(pa.array(held, pa.string()))
                    held = []
        # Rows leave only when the whole file was readable: a cut-off day is an error, not a short day.
        for part in (*good, pa.array(held, pa.string())):
            yield batch_of(titles, part)
        if not good and not held:
            yield batch_of(titles, nothing)
    except Exception as exc:  # one bad day must not stop the others
        yield batch_of(None, nothing, f"{type(exc).__name__}: {exc}")


def _unpack(batches: Iterator[pa.RecordBatch], carry: Sequence[str] = ()) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            path, content = (batch.column(c)[i].as_py() for c in ("path", "content"))
            for lines in file_lines(path, lambda c=content: io.BytesIO(c)):
                for c in carry:
                    lines = lines.append_column(c, pa.repeat(batch.column(c)[i], lines.num_rows))
                yield lines


def parse_day_files(files: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Bars plus ``_path`` / ``_file`` / ``_error`` from (path, content) rows of day files, zipped or plain.

    One file is one exchange day and the natural task unit. Python only unpacks lines. Works on batch and streaming frames.
    Each row has its file's columns ``carry`` too.
    """
    files = files.select("path", "content", *carry)
    schema = T.StructType([*T.StructType.fromDDL(LINES).fields, *files.select(*carry).schema.fields])
    return parse_lines(files.mapInArrow(lambda batches: _unpack(batches, carry), schema))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Bars plus ``_path`` / ``_file`` / ``_error`` from the lines of day files (``LINES``).

    Layout, selection and typing are column expressions, the same for all layouts and containers. The header is a file's
    first record, read like any other: quoted titles are known too. A file that cannot be read, has no
    date in its name, no known header or more than ``MAX_COLUMNS`` columns gives rows with ``_error``, and no bars. Columns besides
    ``LINES`` go along.
    """
    own = [f.name for f in T.StructType.fromDDL(LINES).fields]
    carry = [c for c in lines.columns if c not in own]
    between = F.concat(F.lit(_BETWEEN), F.col("titles"), F.lit(_BETWEEN))
    marked = lines.select("_path", "_error", "line", F.split("titles", _BETWEEN).alias("_titles"), *carry, *(
        between.contains(f"{_BETWEEN}{marker}{_BETWEEN}").alias(c) for c, marker in (("_new", NEW_LAYOUT_MARKER), ("_old", OLD_LAYOUT_MARKER))))
    # Only a line with a quote needs the CSV parser. A title that is not there has position 0 and no cell.
    whole = F.from_csv("line", ", ".join(f"c{i} string" for i in range(MAX_COLUMNS)), {
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "escape": '"'})
    quoted = F.get(F.transform(F.array(whole), lambda c: F.array(*[c[f"c{i}"] for i in range(MAX_COLUMNS)])), F.lit(0))
    cells = F.when(F.col("line").contains('"'), quoted).otherwise(F.split("line", ","))
    names = [*(f.name for f in BARS.fields if f.name != "date"), "instrument_type"]

    def place(name: str) -> Column:
        """Position of the title that a cell has in the row's layout."""
        old, new = (next((t for t, c in layout.items() if c == name), None) for layout in (OLD_LAYOUT, NEW_LAYOUT))
        title = F.lit(new) if old is None else F.when(F.col("_new"), new).otherwise(old)
        return F.array_position("_titles", title).cast("int")

    placed = marked.withColumn("_places", F.array(*[place(n) for n in names]))
    # One small function for every cell: written out for each of them, the generated method outgrows the 8,000 bytes of code
    # that Java compiles, and is interpreted byte by byte. A line is split once for all of its cells, which are not stored in between.
    texts = F.get(F.transform(F.array(cells), lambda own: F.transform("_places", lambda p: _trimmed(F.get(own, p - 1)))), F.lit(0))
    read = placed.select("_path", "_error", F.col("line").isNotNull().alias("_is_line"), "_new", "_old", *carry, _one_row(texts.alias("_texts")))
    read = read.withColumn("date", F.try_to_date(F.regexp_extract("_path", DATE_IN_NAME, 1)))
    text = {n: F.get("_texts", F.lit(i)) for i, n in enumerate(names)}
    known = F.coalesce(F.col("_new") | F.col("_old"), F.lit(False))
    error = F.coalesce(
        "_error", F.when(F.col("date").isNull(), "no date in file name"), F.when(~known, "no known day-file header"))
    equity = ~F.col("_new") | F.coalesce(text["instrument_type"] == EQUITY_INSTRUMENT, F.lit(False))
    parsed = read.withColumn("_error", error).filter(F.col("_error").isNotNull() | (F.col("_is_line") & equity))
    return parsed.select(
        *(F.col("date") if f.name == "date" else _typed(f, text[f.name]).alias(f.name) for f in BARS.fields),
        "_path", F.substring_index("_path", "/", -1).alias("_file"), "_error", *carry)


def read_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, content) of every file below ``path`` that matches ``pattern``."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(path).select("path", "content")
    )


def read_zip_files(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, "*.zip")


def good_bars(parsed: DataFrame) -> DataFrame:
    """The normalised bars of the files that parsed."""
    return parsed.filter(F.col("_error").isNull()).drop("_path", "_file", "_error")


def quarantined_files(parsed: DataFrame) -> DataFrame:
    """(file, error) of the files that did not parse."""
    return parsed.filter(F.col("_error").isNotNull()).select(
        F.col("_file").alias("file"), F.col("_error").alias("error")).distinct()


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Normalised bars of every zipped day file below ``path``."""
    return good_bars(parse_day_files(read_zip_files(spark, path)))


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Normalised bars of every unpacked day file below ``path``."""
    return good_bars(parse_day_files(read_files(spark, path, "*.csv")))


# ---------------------------------------------------------------- the stored bar table

def ingest_stats(bars: DataFrame) -> DataFrame:
    """Years, days and rows of what was parsed, via one row per day."""
    per_day = bars.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    return per_day.agg(
        F.count_distinct(F.year("date")).alias("years"),
        F.count("date").alias("days"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
    )


#: Distinct securities that a file's bloom filter is laid out for (about 12 KB a row group).
BLOOM_SECURITIES = 10_000


def _store_writer(rows: DataFrame) -> DataFrameWriter:
    """Filters on isin skip row groups by their range and, within it, by a bloom filter."""
    return rows.write.options(**{
        "parquet.bloom.filter.enabled#isin": "true", "parquet.bloom.filter.expected.ndv#isin": str(BLOOM_SECURITIES)})


def write_by_year(bars: DataFrame, path: str) -> None:
    """Rebuildable store, one directory per year; only years present are replaced.

    Rows are dealt out by year, large years to several tasks, and ordered by security, so that a
    year has few files and a filter on isin skips row groups.
    """
    dealt = bars.withColumn("year", F.year("date")).hint("rebalance", F.col("year")).sortWithinPartitions("year", "isin", "date")
    _store_writer(dealt).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def write_by_security(bars: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """A catalog table in buckets of securities below ``path``, replaced as a whole.

    Steps that follow a security over time (features, windows, streaks) then read their rows already dealt by isin, without
    an exchange, and a list of isins reads only its own buckets. The number of buckets is the parallelism of those
    steps: a few for each core, files of some hundred MB.
    """
    dealt = bars.repartition(buckets, "isin").sortWithinPartitions("isin", "date")
    _store_writer(dealt).mode("overwrite").bucketBy(buckets, "isin").sortBy("isin", "date").option("path", path).saveAsTable(table)


def load_bars(spark: SparkSession, path: str, schema: T.StructType = BARS) -> DataFrame:
    """Every year of a bar store; an empty store is an error."""
    stored = T.StructType(list(schema.fields) + [T.StructField("year", T.IntegerType())])
    bars = spark.read.schema(stored).parquet(path)
    if not bars.take(1):
        raise FileNotFoundError(f"no bars found in {path}")
    return bars.drop("year")


def scan_curated(
    spark: SparkSession,
    path: str,
    isins: list[str] | None = None,
    start=None,
    end=None,
    series: list[str] | None = None,
) -> DataFrame:
    """Lazy scan whose filters reach the files.

    Date bounds are repeated on the partition column, so years outside them are
    not listed at all; isin and series filters are pushed to the row groups.
    """
    stored = T.StructType(list(CURATED.fields) + [T.StructField("year", T.IntegerType())])
    rows = spark.read.schema(stored).parquet(path)
    if start is not None:
        rows = rows.filter((F.col("date") >= F.lit(start)) & (F.col("year") >= start.year))
    if end is not None:
        rows = rows.filter((F.col("date") <= F.lit(end)) & (F.col("year") <= end.year))
    if isins is not None:
        rows = rows.filter(F.col("isin").isin(isins))
    if series is not None:
        rows = rows.filter(F.col("series").isin(series))
    return rows.drop("year")
