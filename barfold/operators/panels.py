"""A caller's function over whole panels, each streamed through it in batches.

A panel is all rows of one key (a fold and date, say). Spark brings its rows together in a given order, spilling as
it needs; the function gets them as an iterator of Arrow batches and never as one table, so the memory of an executor
does not follow the size of its largest panel.
"""

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Batches = Iterator[pa.RecordBatch]
_ROUND = "_round"


class _Rounds:
    """The batches of a panel that comes twice, as two iterators that are read one after the other."""

    def __init__(self, batches: Batches):
        self._batches, self._second = batches, None

    def _own(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.drop_columns([_ROUND])

    def first(self) -> Batches:
        for batch in self._batches:
            n = batch.num_rows - pa.compute.sum(batch.column(_ROUND)).as_py()
            if n:
                yield self._own(batch.slice(0, n))
            if n < batch.num_rows:
                self._second = batch.slice(n)
                return

    def second(self) -> Batches:
        if self._second is not None:
            yield self._own(self._second)
        for batch in self._batches:
            yield self._own(batch)


def _scored(batches: Batches, score: Callable[[Batches], Iterator], kind: pa.DataType, out: str) -> Batches:
    """Each batch with the scores that ``score`` yields for it; it may read ahead of what it yields."""
    waiting: deque[pa.RecordBatch] = deque()

    def given() -> Batches:
        for batch in batches:
            waiting.append(batch)
            yield batch

    for values in score(given()):
        if not waiting:
            raise ValueError("more arrays of scores than batches")
        batch = waiting.popleft()
        if len(values) != batch.num_rows:
            raise ValueError(f"{len(values)} scores for a batch of {batch.num_rows} rows")
        yield batch.append_column(out, pa.array(values, kind, from_pandas=True))
    if waiting or next(batches, None) is not None:
        raise ValueError("batches without scores")


def score_whole_panels(
    rows: DataFrame,
    score: Callable[[tuple, Any, Batches], Iterator],
    by: Sequence[str] = ("fold", "date"),
    order: Sequence[str | Column] = ("isin",),
    summarize: Callable[[tuple, Batches], Any] | None = None,
    out: str = "pred",
) -> DataFrame:
    """``rows`` with the (double) scores that a function of the whole panel gives its names.

    ``score(key, summary, batches)`` gets a panel's rows in ``order`` and yields, for every batch in turn, one array with a
    score per row; null and NaN become null. With ``summarize(key, batches)`` each panel is read once before, in the same
    order, and what that returns is the ``summary`` (a maximum and a sum, a count, fitted weights): a function that needs
    all names before it can score the first one then needs no more memory than one that doesn't.

    One shuffle on the panel's key, the rows twice with ``summarize``. A panel is one task's work, since any row's score
    may depend on any other. A null key is a panel like any other; without rows there is nothing to score.
    """
    keys = list(by)
    columns = rows.columns
    if clash := {out, _ROUND} & set(columns):
        raise ValueError(f"columns {sorted(clash)} are in use")
    sent = rows
    if summarize is not None:
        sent = rows.withColumn(_ROUND, F.explode(F.array(F.lit(0), F.lit(1))))
        order = (_ROUND, *order)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panel = tuple(k.as_py() for k in key)
        summary, own = None, batches
        if summarize is not None:
            rounds = _Rounds(batches)
            first = rounds.first()
            summary = summarize(panel, first)
            for _ in first:  # whatever the summary did not look at
                pass
            own = rounds.second()
        yield from _scored(own, lambda given: score(panel, summary, given), pa.float64(), out)

    schema = T.StructType([*rows.select(*columns).schema.fields, T.StructField(out, T.DoubleType())])
    # The rows arrive dealt and sorted, so the grouping adds neither a shuffle nor a sort of its own.
    dealt = sent.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.groupBy(*keys).applyInArrow(run, schema)
