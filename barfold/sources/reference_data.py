"""Landed corporate-action feeds, index membership lists and fetch bookkeeping."""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barfold.schemas import MEMBERSHIP_COLUMNS, RAW_ACTIONS

# Column titles of the index constituent lists.
MEMBERSHIP_TITLES = {
    "Company Name": "company_name",
    "Industry": "industry",
    "Symbol": "symbol",
    "Series": "series",
    "ISIN Code": "isin",
}


def parse_actions(raw: DataFrame) -> DataFrame:
    """Typed actions from raw feed rows; undated and undatable rows drop."""
    text = F.trim(F.col("exDate"))
    dated = F.coalesce(F.try_to_date(text, "dd-MMM-yyyy"), F.try_to_date(text, "d-MMM-yyyy"))
    return raw.withColumn("ex_date", dated).filter(F.col("ex_date").isNotNull()).select(
        "isin", "symbol", "series", "ex_date", "subject")


def action_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw feed rows with ``_file`` and ``_corrupt``: what a row says that is no record, else null.

    A landed file is a JSON array in any layout, or one object per line; its first line with
    anything in it tells which. Files are read in splits: lines are records wherever they lie, so such a
    file may have any size. Only the lines of an array are put together again, in one row of
    2 GB at most. A broken array is one corrupt row.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), at.alias("_at"), "value").filter(
        F.col("value").rlike(r"\S"))
    arrays = lines.groupBy("_file").agg(F.min_by("value", "_at").alias("head")).filter(
        F.col("head").rlike(r"^\s*\[")).select("_file")
    whole = lines.join(arrays, "_file").groupBy("_file").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), "\n").alias("value"))
    listed = F.coalesce(F.from_json("value", "array<string>"), F.array("value"))
    texts = lines.join(arrays, "_file", "left_anti").select("_file", F.col("value").alias("text")).unionByName(
        whole.select("_file", F.explode(listed).alias("text")))
    schema = T.StructType([*RAW_ACTIONS.fields, T.StructField("_bad", T.StringType())])
    record = F.from_json("text", schema, {"columnNameOfCorruptRecord": "_bad"})
    parsed = texts.select("_file", "text", F.inline(F.array(F.struct(record.alias("r")))))
    return parsed.select("_file", *[F.col(f"r.{f.name}") for f in RAW_ACTIONS.fields],
                         F.when(F.col("r").isNull(), F.col("text")).otherwise(F.col("r._bad")).alias("_corrupt"))


def quarantined_actions(records: DataFrame) -> DataFrame:
    """(file, text) of what the feed holds besides records."""
    return records.filter(F.col("_corrupt").isNotNull()).select(
        F.col("_file").alias("file"), F.col("_corrupt").alias("text"))


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """Actions from landed JSON; no rows gives an empty frame of the same schema.

    What cannot be read is not here but in ``quarantined_actions(action_records(...))``.
    """
    records = action_records(spark, path)
    return parse_actions(records.filter(F.col("_corrupt").isNull()).drop("_file", "_corrupt"))


def write_index_snapshot(membership: DataFrame, path: str) -> None:
    """A dated snapshot beside the earlier ones; the same day written again replaces itself."""
    membership.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of_date").parquet(path)


def read_index_membership(
    spark: SparkSession, paths: dict[str, str], as_of_date: dt.date
) -> DataFrame:
    """Constituent lists of several indices as one dated snapshot.

    ``paths`` maps an index name to its landed CSV; the snapshot date is a
    parameter because the lists only ever describe the day they were taken.
    """
    out = None
    for index, path in paths.items():
        listed = spark.read.option("header", True).csv(path)
        listed = listed.toDF(*[c.strip() for c in listed.columns])
        rows = listed.withColumnsRenamed(MEMBERSHIP_TITLES).select(
            F.lit(as_of_date).cast("date").alias("as_of_date"), F.lit(index).alias("index"),
            *MEMBERSHIP_COLUMNS[2:])
        out = rows if out is None else out.unionByName(rows)
    return out


def union_frames(*frames: DataFrame) -> DataFrame:
    """Vertical concatenation by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def session_plan(bounds: DataFrame, on_disk: DataFrame, holidays: DataFrame) -> DataFrame:
    """(date, status) for each weekday between ``bounds`` (start, end).

    Status is skipped_existing, skipped_holiday or pending. All three inputs are
    day lists, so their sizes are bounded by the calendar.
    """
    days = bounds.select(F.explode(F.sequence("start", "end")).alias("date")).filter(
        F.weekday("date") < 5)
    have = on_disk.select("date", F.lit(True).alias("_have")).distinct()
    shut = holidays.select("date", F.lit(True).alias("_shut")).distinct()
    status = (
        F.when(F.col("_have"), "skipped_existing")
        .when(F.col("_shut"), "skipped_holiday")
        .otherwise("pending")
    )
    return days.join(F.broadcast(have), "date", "left").join(
        F.broadcast(shut), "date", "left").select("date", status.alias("status"))


def pending_sessions(bounds: DataFrame, on_disk: DataFrame, holidays: DataFrame) -> DataFrame:
    """Days still to fetch."""
    return session_plan(bounds, on_disk, holidays).filter(F.col("status") == "pending").select("date")


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def fetch_log_status(log: DataFrame) -> DataFrame:
    """Fold (date, status, attempt_ts) into one status per day.

    The first ``ok`` or ``holiday`` settles a day, because a settled day is never
    requested again; a day with errors only stays pending.
    """
    settles = F.col("status").isin("ok", "holiday")
    first = F.min(F.when(settles, F.struct("attempt_ts", "status")))
    return log.groupBy("date").agg(
        F.coalesce(first["status"], F.lit("error")).alias("status"),
        F.count(F.lit(1)).alias("n_attempts"),
        F.count_if(F.col("status") == "error").alias("n_errors"),
    ).withColumn("pending", F.col("status") == "error")
