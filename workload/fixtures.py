"""Adapters from the TPC-H-like test tables to the engine's input schemas.

Integer and date logic only, so the same definition exists once here and once
as SQL in ``workload.oracle``.
"""

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barfold.schemas import NEW_LAYOUT, OLD_LAYOUT
from barfold.session import ship_by_value

ship_by_value(__name__)

FIRST_ISIN_DATE = "1996-07-01"
NEW_LAYOUT_DATE = "1998-01-01"
ROWS_PER_FILE_KEYS = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(prefix: str, k) -> Column:
    return F.format_string(prefix + "%06d", k)


#: Columns of the raw bars that repeat the close; a store can leave them out.
REPEATED = ("prev_close", "last")


def with_repeated(bars: DataFrame) -> DataFrame:
    """Raw bars stored without their ``REPEATED`` columns, whole again."""
    after = bars.columns.index("close") + 1
    return bars.select(*bars.columns[:after], *[F.col("close").alias(c) for c in REPEATED], *bars.columns[after:])


def bars_raw(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Raw bars, one per (supplier, ship date, line status), with key ``k``; the trades move in ``parts``, if given."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    k, date, close = F.col("k"), F.col("date"), F.col("_close")
    # A day has few trades, so combining before the exchange would save nothing and cost a sort of every fat buffer: the
    # trades move once as they are, by supplier and year, which also leaves the stored bars of a security together.
    trades = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("date"), F.col("l_linestatus").alias("status"),
        F.year("l_shipdate").alias("_year"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    day = (
        trades.repartition(*([] if parts is None else [parts]), "k", "_year").groupBy("k", "_year", "date", "status")
        .agg(
            F.min_by(px, order).alias("_open"), F.max_by(px, order).alias("_close"),
            F.max(px).alias("_high"), F.min(px).alias("_low"),
            F.sum("l_quantity").alias("_volume"),
            F.round(F.sum("l_extendedprice"), 2).alias("turnover"),
            F.count(F.lit(1)).alias("n_trades"),
        )
    )
    artifact = (k % 25 == 4) & (F.year(date) == 1995)
    stale = (k % 25 == 7) & (F.year(date) == 1997)
    zero = F.lit(0.0)
    five = F.lit(500.0)
    close = F.when(stale, five).otherwise(F.col("_close"))
    known = (date >= F.lit(FIRST_ISIN_DATE).cast("date")) & (k % 10 != 9)
    rival = (k % 7 == 0) & (F.month(date) == 1)
    return day.select(
        "k", "date",
        F.when(known, F.when(rival, _code("INX", k)).otherwise(_code("INE", k))).alias("isin"),
        F.when(F.col("status") == "O", _code("S", k)).otherwise(_code("T", k)).alias("symbol"),
        F.when(k % 20 == 13, "BE").otherwise("EQ").alias("series"),
        F.when(artifact, zero).otherwise(F.col("_open")).alias("open"),
        F.when(artifact, zero).when(stale, F.greatest("_high", five))
        .otherwise(F.col("_high")).alias("high"),
        F.when(artifact, zero).when(stale, F.least("_low", five))
        .otherwise(F.col("_low")).alias("low"),
        close.alias("close"), close.alias("prev_close"), close.alias("last"),
        F.when((k % 5 == 2) & ((k + F.dayofyear(date)) % 8 == 0), zero)
        .otherwise(F.col("_volume")).alias("volume"),
        "turnover", "n_trades",
    )


def actions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw corporate-action feed rows with ``exDate`` as text."""
    n = table(spark, sf_dir, "supplier").select(F.count(F.lit(1))).scalar()
    i, key = F.col("i"), F.col("p_partkey")
    base = (
        table(spark, sf_dir, "part").select("p_partkey", "p_size", key.alias("i"))
        .withColumn("k", i % n)
        .withColumn("_day", F.date_add(F.lit("1995-03-01").cast("date"),
                                       (key * 37 % 2300).cast("int")))
    )
    ex_date = F.when(i % 23 == 0, "-").when(i % 29 == 0, "junk").otherwise(
        F.date_format("_day", "dd-MMM-yyyy"))
    subjects = F.array(*[F.lit(s) for s in SUBJECTS])
    main = base.select(
        "i", _code("INE", F.col("k")).alias("isin"), _code("S", F.col("k")).alias("symbol"),
        F.when(F.col("p_size") % 10 == 0, "BE").otherwise("EQ").alias("series"),
        ex_date.alias("exDate"), subjects[(i % 9).cast("int")].alias("subject"),
    )
    same_day = main.filter(i % 6 == 0).withColumns(
        {"series": F.lit("EQ"), "subject": F.lit("Bonus 1:2")})
    return main.unionByName(same_day).drop("i")


SUBJECTS = (
    "Bonus 1:1",
    "Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 2/- Per Share",
    "Interim Dividend - Rs 6 Per Share",
    "Scheme Of Arrangement - Bonus Debentures 1:1",
    "Bonus issue",
    "Bonus 1:1/Face Value Split - From Rs 10/- Per Share To Rs 5/- Per Share",
    "Annual General Meeting / Dividend - Rs 3/- Per Share / Bonus - 1:2",
    "Consolidation From Re 1 To Rs 10",
    "Demerger",
)


# ------------------------------------------------------------------ raw day files

# The published column order of the three file generations, as cells; their titles are the schemas'.
_ORDER = {
    "earliest": "symbol series open high low close last prev_close volume turnover date",
    "old": "symbol series open high low close last prev_close volume turnover date n_trades isin",
    "new": "date kind isin symbol series close open high low last prev_close turnover volume n_trades",
}
_DATE_TITLES = {"old": "TIMESTAMP", "new": "TradDt"}


def _titles(generation: str) -> dict[str, str]:
    era = "new" if generation == "new" else "old"
    layout = {c: t for t, c in (NEW_LAYOUT if era == "new" else OLD_LAYOUT).items()}
    layout |= {"date": _DATE_TITLES[era], "kind": layout.get("instrument_type")}
    return {layout[c]: c for c in _ORDER[generation].split()}


TITLES = {generation: _titles(generation) for generation in _ORDER}


def raw_cells(bars: DataFrame) -> DataFrame:
    """Bars as padded text cells, with blanks, junk and non-equity rows mixed in.

    ``prev_close`` is blank for k % 11 = 5 and ``last`` is 'N/A' for k % 13 = 6;
    days in the new layout repeat the rows of k % 10 = 3 as bonds.
    """
    def text(c: str) -> Column:
        return F.concat(F.lit(" "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(" "))

    is_new = F.col("date") >= F.lit(NEW_LAYOUT_DATE).cast("date")
    kinds = F.when(is_new & (F.col("k") % 10 == 3), F.array(F.lit("STK"), F.lit("GSEC"))).otherwise(
        F.array(F.lit("STK")))
    return bars.select(
        "k", "date", is_new.alias("is_new"), F.explode(kinds).alias("kind"),
        *[text(c).alias(c) for c in ("isin", "symbol", "series", "open", "high", "low", "close",
                                     "volume", "turnover", "n_trades")],
        F.when(F.col("k") % 13 == 6, "N/A").otherwise(text("last")).alias("last"),
        F.when(F.col("k") % 11 == 5, "").otherwise(text("prev_close")).alias("prev_close"),
    )


def layout_of(date: Column) -> Column:
    return (
        F.when(date >= F.lit(NEW_LAYOUT_DATE).cast("date"), "new")
        .when(date >= F.lit(FIRST_ISIN_DATE).cast("date"), "old")
        .otherwise("earliest")
    )


def layout_cells(bars: DataFrame) -> dict[str, DataFrame]:
    """Per file generation: (k, day, the titled text cells)."""
    cells = raw_cells(bars).withColumn("layout", layout_of(F.col("date")))
    return {
        layout: cells.filter(F.col("layout") == layout).select(
            "k", F.col("date").alias("day"),
            *[F.col(cell).cast("string").alias(title) for title, cell in titles.items()])
        for layout, titles in TITLES.items()
    }


def csv_lines(bars: DataFrame) -> DataFrame:
    """(k, day, header, line) of the raw day files: one pass over the bars, each line in the layout of its day."""
    layout = layout_of(F.col("date"))

    def in_layout(value: Callable[[str], Column]) -> Column:
        return F.coalesce(*[F.when(layout == generation, value(generation)) for generation in TITLES])

    return raw_cells(bars).select(
        "k", F.col("date").alias("day"), in_layout(lambda g: F.lit(" ,".join(TITLES[g]))).alias("header"),
        in_layout(lambda g: F.concat_ws(",", *[F.col(c).cast("string") for c in TITLES[g].values()])).alias("line"))


@F.pandas_udf(T.BinaryType())
def _zipped(text: pd.Series) -> pd.Series:
    def pack(body: str) -> bytes:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("day.csv", body)
        return buffer.getvalue()

    return text.map(pack)


def day_files(spark: SparkSession, bars: DataFrame) -> DataFrame:
    """(path, content) of one zip per day and block of keys, and one broken file."""
    block = F.expr(f"k div {ROWS_PER_FILE_KEYS}")
    path = F.concat(F.lit("/landed/"), F.year("day"), F.lit("/"), F.col("day").cast("string"),
                    F.lit("_"), F.col("block"), F.lit(".zip"))
    files = (
        csv_lines(bars).groupBy("day", "header", block.alias("block"))
        .agg(F.sort_array(F.collect_list("line")).alias("lines"))
        .select(path.alias("path"), _zipped(F.concat_ws("\n", "header", "lines")).alias("content"))
    )
    # A broken copy per year, derived from the data: the first name plus "bad", cut short. The names follow from days and
    # keys alone, so nothing is packed a second time to find them; they are one per year.
    first = bars.groupBy(F.year("date")).agg(F.min(F.struct(F.col("date").alias("day"), block.cast("string").alias("block"))).alias("_first"))
    first = first.select("_first.*").select(path.alias("path"), F.lit(True).alias("first"))
    whole = F.struct("path", "content")
    broken = F.struct(F.regexp_replace("path", r"\.zip$", "_bad.zip").alias("path"), F.substring("content", 1, 20).alias("content"))
    return files.join(F.broadcast(first), "path", "left").select(
        F.inline(F.when(F.col("first"), F.array(whole, broken)).otherwise(F.array(whole))))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "error").when(
        F.col("event_type") == "view", "holiday").otherwise("ok")
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("date"), status.alias("status"), F.col("ts").alias("attempt_ts"))


def session_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bounds, days on disk, known holidays)."""
    ordered = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    shipped = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    bounds = ordered.agg(F.min("date").alias("start"), F.max("date").alias("end"))
    on_disk = shipped.filter(F.day("date") % 3 == 0).distinct()
    holidays = ordered.filter(F.day("date") % 7 == 0).distinct()
    return bounds, on_disk, holidays


def index_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constituents in the published column titles, plus the index they belong to."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("index"),
        F.col("c_name").alias(" Company Name "),
        F.col("c_nationkey").cast("string").alias("Industry"),
        F.col("c_name").alias("Symbol"),
        F.lit("EQ").alias("Series"),
        _code("INE", F.col("c_custkey")).alias("ISIN Code"),
    )
