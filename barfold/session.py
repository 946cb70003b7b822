"""Session set-up and the shared scratch folder.

Operators never start a session or touch local disk themselves. Anything that
has to be written between two stages goes to the folder the cluster names in
``spark.checkpoint.dir``, so a lost executor can re-read it.
"""

import atexit
import shutil
import sys
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, app: str = "barfold", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_by_value(module_name: str) -> None:
    """Send a module's functions to Python workers inside the task itself.

    Workers then need no copy of this package on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a throw-away one only for local masters."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="spark-barfold-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set(CHECKPOINT_CONF, path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, run-unique path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored table.

    Used where several branches of one plan need the same expensive rows: each
    branch then reads (a pruned, filtered part of) the stored table instead of
    recomputing the windows, and recovery after an executor loss restarts here.
    """
    spark = df.sparkSession
    target = path or scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def stage_by_key(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """``stage_table`` in ``buckets`` of ``key``: steps that group or order by it read their rows already dealt, without an exchange.

    Rows are written where they lie, one file per task and bucket met there, so they should come dealt by ``key`` into as
    many parts: each task then writes one file.
    """
    spark = df.sparkSession
    target = path or scratch_path(spark, name)
    df.write.bucketBy(buckets, key).option("path", target).option("compression", "zstd").saveAsTable(_table_name(target))
    return spark.table(_table_name(target))


def _table_name(path: str) -> str:
    """Catalog name of the table in a folder of ``scratch_path``: its last part is unique."""
    return path.rsplit("/", 1)[-1].replace("-", "_")


_kept: dict[tuple[str, str], tuple[tuple, str, bool]] = {}
_kept_lock = threading.RLock()


def folder_state(spark: SparkSession, path: str) -> tuple:
    """What a folder holds: each entry's name, time, bytes and number of files, from the file system's own summaries."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(at):
        return ()
    totals = ((s, system.getContentSummary(s.getPath())) for s in system.listStatus(at))
    return tuple(sorted(
        (s.getPath().getName(), s.getModificationTime(), t.getLength(), t.getFileCount()) for s, t in totals))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    return sum(entry[2] for entry in folder_state(spark, path))


def kept_table(key: str, spark: SparkSession, source: str | None = None) -> DataFrame | None:
    """The table that ``keep_table`` has stored under ``key``; none if it is not built, is missing or has an older source."""
    with _kept_lock:
        state, path, bucketed = _kept.get((spark.sparkContext.applicationId, key), (None, "", False))
        if state is None or state != (folder_state(spark, source) if source else ()):
            return None
        try:
            stored = spark.read.parquet(path)
            return spark.table(_table_name(path)) if bucketed else stored
        except AnalysisException:
            return None


def keep_table(
    key: str, spark: SparkSession, build: Callable[[], DataFrame], source: str | None = None, by: str | None = None,
    buckets: int = 1,
) -> DataFrame:
    """A table built once per application and stored in the shared folder, in ``buckets`` of the column ``by`` if given.

    Steps hand over through stored tables, so later queries of the same
    application read the result instead of repeating the chain. It is built anew where the
    stored folder is missing, and where an entry of the folder ``source`` was replaced since.
    """
    state = folder_state(spark, source) if source else ()
    with _kept_lock:
        stored = kept_table(key, spark, source)
        if stored is not None:
            return stored
        name = key.rsplit("/", 1)[-1]
        path = scratch_path(spark, name)
        if by is None:
            made = stage_table(build(), name, path)
        else:
            made = stage_by_key(build(), name, by, buckets, path)
        _kept[(spark.sparkContext.applicationId, key)] = (state, path, by is not None)
        return made
