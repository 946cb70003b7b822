"""Incremental, restartable ingestion of newly landed day files.

Three stored tables side by side, all of them only ever added to:

* bars, by (year, attempt): what an attempt read from the files that parsed, and, without a year, the errors of the others;
* files, by attempt: each file's outcome, with its error if it has one;
* commits: one row per attempt that is complete.

An attempt is a batch of the stream, a second look at files that failed, or a compaction. Readers see the attempts in the
commits and nothing else, so a batch's bars and outcomes appear together, and what a broken-off attempt left behind never
shows. Nothing stored is written again but by ``compact``.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barfold.schemas import BARS
from barfold.session import stage_table
from barfold.sources.bars import parse_day_files

_LANDED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])
_ORIGIN = "batch long, path string, modified timestamp"
_STORED = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BARS.fields) + f", {_ORIGIN}, attempt string, year int"
_PARSED = f"{_STORED}, length long, error string"  # as a batch is stored
_FILES = f"{_ORIGIN}, length long, error string, attempt string"
_COMMITS = "attempt string, batch long, replaces array<string>"


def landed_zip_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of zipped day files as they land below ``path``."""
    return (
        spark.readStream.format("binaryFile").schema(_LANDED)
        .option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    )


def _beside(target: str, name: str) -> str:
    return f"{target.rstrip('/')}-{name}"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def commits(spark: SparkSession, target: str) -> DataFrame:
    """(attempt, batch) of what readers see: committed, not replaced by a compaction, one attempt per batch."""
    every = _read(spark, _beside(target, "commits"), _COMMITS)
    replaced = every.select(F.explode("replaces").alias("attempt"))
    seen = every.join(replaced, "attempt", "left_anti").select("attempt", "batch")
    # The same batch committed by two drivers at once: the lesser name is the one that counts.
    once = seen.filter(F.col("batch").isNotNull()).groupBy("batch").agg(F.min("attempt").alias("attempt"))
    return once.select("attempt", "batch").unionByName(seen.filter(F.col("batch").isNull()))


def _batch_is_stored(spark: SparkSession, target: str, batch: int) -> bool:
    every = _read(spark, _beside(target, "commits"), _COMMITS)  # compactions replace batches, they don't undo them
    return not every.filter(F.col("batch") == batch).isEmpty()


def _visible(rows: DataFrame, target: str) -> DataFrame:
    return rows.join(commits(rows.sparkSession, target).select("attempt"), "attempt", "left_semi")


def _bars(spark: SparkSession, target: str) -> DataFrame:
    return _visible(_read(spark, target, _STORED).filter(F.col("year").isNotNull()), target)


def _store(
    bars: DataFrame, files: DataFrame | None, target: str, name: str, batch: int | None = None, replaces: list[str] | None = None
) -> None:
    """Bars and outcomes under a new attempt, then its commit. Without ``files`` the bars hold the errors too, and outcomes are read from what is stored."""
    spark, attempt = bars.sparkSession, f"{name}-{uuid.uuid4().hex}"
    year = F.year("date") if files is not None else F.when(F.col("error").isNull(), F.year("date"))
    bars.withColumns({"year": year, "attempt": F.lit(attempt)}).write.mode("append").partitionBy("year", "attempt").parquet(target)
    if files is None:
        files = _outcomes(_read(spark, target, _PARSED).filter(F.col("attempt") == attempt))
    files.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt").parquet(_beside(target, "files"))
    spark.createDataFrame([(attempt, batch, replaces or [])], _COMMITS).repartition(1).write.mode("append").parquet(
        _beside(target, "commits"))


#: Parts that a batch's files are dealt into, for each core: a split of packed files is ten times as large once they are read.
PARTS_PER_CORE = 8


def _or_null(files: DataFrame, column: str, kind: str) -> Column:
    return (F.col(column) if column in files.columns else F.lit(None)).cast(kind)


def _outcomes(parsed: DataFrame) -> DataFrame:
    return parsed.select("batch", "path", "modified", "length", "error").distinct()


def _parse(files: DataFrame, batch: Column) -> DataFrame:
    """Bars of the files, or the error of those that don't parse, each with its file's origin.

    The origin goes along through the parse, so that no bar is joined or moved for it; only packed files move.
    """
    parts = PARTS_PER_CORE * files.sparkSession.sparkContext.defaultParallelism
    dealt = files.select(
        "path", "content", _or_null(files, "modificationTime", "timestamp").alias("modified"),
        _or_null(files, "length", "long").alias("length"), batch.cast("long").alias("batch")).repartition(parts, "path")
    parsed = parse_day_files(dealt, ("batch", "modified", "length"))
    return parsed.select(*BARS.names, "batch", F.col("_path").alias("path"), "modified", "length", F.col("_error").alias("error"))


def _parsed(files: DataFrame, batch: Column) -> tuple[DataFrame, DataFrame]:
    """(bars of the files that parsed, outcome of every file), each with its origin, read from one stored parse."""
    parsed = stage_table(_parse(files, batch), "parsed")
    return parsed.filter(F.col("error").isNull()).drop("length", "error"), _outcomes(parsed)


def landed_files(spark: SparkSession, target: str) -> DataFrame:
    """(path, error, batch, modified, length) of every file read so far; ``error`` is null where its bars are stored.

    A file that was read more than once has its last outcome, and a good one for good.
    """
    last = F.struct(F.col("error").isNull(), "batch", "modified")
    return _visible(_read(spark, _beside(target, "files"), _FILES), target).groupBy("path").agg(*(
        F.max_by(c, last).alias(c) for c in ("error", "batch", "modified", "length")))


def failed_files(spark: SparkSession, target: str) -> DataFrame:
    return landed_files(spark, target).filter(F.col("error").isNotNull())


def _present(spark: SparkSession, folders: list[str]) -> DataFrame | None:
    """(path, modificationTime, length) of the files in those of the folders that exist; contents are not read."""
    found = []
    for folder in folders:
        try:
            found.append(spark.read.format("binaryFile").load(folder).select("path", "modificationTime", "length"))
        except AnalysisException:
            continue
    out = None
    for files in found:
        out = files if out is None else out.unionByName(files)
    return out


def retry_failed(spark: SparkSession, target: str, at_most: int = 1000) -> None:
    """Read the failed files again that were replaced since, in blocks of ``at_most`` paths.

    A file that is as it was (same time and length) is not read. Of those that are read only the ones that now parse are
    stored, as one attempt that adds their bars (under the batch they landed in) and outcomes; for the others nothing
    is written. Files whose time is not known are read each time.
    """
    failed = failed_files(spark, target)
    folders = failed.select(F.regexp_extract("path", "^(.*)/", 1).alias("f")).distinct().collect()  # landing folders
    present = _present(spark, sorted(r.f for r in folders if r.f))
    if present is None:
        return
    same = failed["modified"].eqNullSafe(present["modificationTime"]) & failed["length"].eqNullSafe(present["length"])
    changed = stage_table(failed.join(present, "path").filter(~same).select("path", "batch"), "changed")
    last = ""
    while block := changed.filter(F.col("path") > last).orderBy("path").limit(at_most).collect():  # bounded by at_most
        last = block[-1].path
        files = spark.read.format("binaryFile").load([r.path for r in block]).join(changed, "path")
        bars, outcomes = _parsed(files, F.col("batch"))
        repaired = outcomes.filter(F.col("error").isNull())
        if not repaired.isEmpty():
            _store(bars, repaired, target, "retry")


def _ingest(batch: DataFrame, number: int, target: str) -> None:
    if not _batch_is_stored(batch.sparkSession, target, number):
        _store(_parse(batch, F.lit(number)), None, target, f"batch{number}", number)


def ingest_incremental(files: DataFrame, target: str, checkpoint: str) -> None:
    """Store everything that landed since the last call, then stop.

    Files that failed before and were replaced are read again first. The checkpoint remembers which files were read, so
    a second call re-reads nothing else. Every landed file is either in the bars or in the outcomes with its error.
    ``foreachBatch`` may repeat a batch after a failure: one that is committed is not stored again.
    """
    retry_failed(files.sparkSession, target)
    query = (
        files.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: _ingest(batch, number, target)).start()
    )
    query.awaitTermination()


def compact(spark: SparkSession, target: str) -> None:
    """All visible attempts as one, with one set of files per year; what it replaces stays on disk until ``clear_replaced``."""
    names = sorted(r.attempt for r in commits(spark, target).collect())  # one per batch, retry or compaction since the last one
    if len(names) < 2:
        return
    bars = stage_table(_bars(spark, target).drop("attempt"), "compacted").hint("rebalance", F.col("year"))
    files = stage_table(landed_files(spark, target), "outcomes")
    _store(bars.sortWithinPartitions("date", "isin"), files.repartition(1), target, "compact", None, names)


def clear_replaced(spark: SparkSession, target: str) -> int:
    """Delete the folders of attempts that a committed compaction replaces; returns how many folders went."""
    every = _read(spark, _beside(target, "commits"), _COMMITS)
    replaced = [r.attempt for r in every.select(F.explode("replaces").alias("attempt")).distinct().collect()]
    jvm, conf, gone = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for attempt in replaced:
        for pattern in (f"{target}/year=*/attempt={attempt}", f"{_beside(target, 'files')}/attempt={attempt}"):
            path = jvm.org.apache.hadoop.fs.Path(pattern)
            system = path.getFileSystem(conf)
            for found in system.globStatus(path) or ():
                gone += bool(system.delete(found.getPath(), True))
    return gone


def load_ingested(spark: SparkSession, target: str) -> DataFrame:
    """All ingested bars."""
    return _bars(spark, target).select(*BARS.names)


def load_ingested_latest(spark: SparkSession, target: str) -> DataFrame:
    """The bars of each date as its last file states them: a restated day replaces the day before it.

    The last file is that of the last batch, within a batch the one landed last, then the one last by path. Rows are
    not merged, whatever their isin; a date's files are its only key.
    """
    rows = _bars(spark, target).withColumn("_origin", F.struct("batch", "modified", "path"))
    last = rows.groupBy("date").agg(F.max("_origin").alias("_origin"))
    return rows.join(last, ["date", "_origin"], "left_semi").select(*BARS.names)
