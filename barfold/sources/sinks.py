"""Small human-readable sinks: review queues and reports."""

from pyspark.sql import DataFrame


def write_review_queue(rows: DataFrame, path: str) -> None:
    """Rows for manual review as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A report table as JSON lines."""
    rows.write.mode("overwrite").json(path)
