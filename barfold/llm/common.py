"""Small helpers that the operators of this package share."""

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barfold.session import shared_dir


CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table.

    This cuts the lineage: a lost executor costs a read of the files, not the
    work that made them. The shuffle files of the work go when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, function: Callable[..., Iterable[tuple]], schema: str, rows: int = 512) -> DataFrame:
    """Run ``function(*columns of one row) -> rows`` over Arrow batches.

    At most ``rows`` results are held before they are handed back.
    """
    names = df.columns
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                for values in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                    out += function(*values)
                    if len(out) >= rows:
                        yield _batch(out, arrow)
                        out = []
            if out:
                yield _batch(out, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones can't clash with an operator's own."""
    return df.select(*names)


def empty_if_null(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))
