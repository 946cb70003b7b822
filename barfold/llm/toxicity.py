"""Toxicity by class-conditional Kneser-Ney models over bytes, toxic against ordinary.

* An expression is ``ORDER`` bytes of the lower-cased text (Unicode rules), white space as blanks, with blanks before its
  start. Inflected and rare forms of a word share most of their expressions.
* Each class has its own counts of whole expressions. What a class has not seen falls back to one shared model of shorter
  expressions: Kneser-Ney continuation counts (how many different bytes precede an expression) over both classes together,
  interpolated order by order down to an even spread over all bytes.
* The log ratio of the two classes' probabilities depends on the expression alone, or on its context alone where neither
  class has seen the expression. All ratios are computed once, by grouped counts and joins, and looked up in one pass
  over the texts, without a shuffle.
* A text's evidence is its mean log ratio a byte. A logistic curve, fitted on labelled rows that the counts have not
  seen, turns it into a score.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barfold.llm.common import stored

#: Bytes of an expression: the last one is predicted from those before it. Longer ones were measured to tell the classes
#: apart less well: most of what they count is chance.
ORDER = 4
#: Absolute discount of every order.
DISCOUNT = 0.95
#: Labelled rows of each class that the model is fitted on, at most (those of least id hash).
FIT_ROWS = 10_000
#: One in so many of them is kept from the counts and fits the logistic curve.
CALIBRATION = 4
#: Bytes of text that are looked at in one go.
CHUNK = 1 << 21
_CONTEXT = 1 << (8 * ORDER)  # set in the key of a context
_BLANK = np.array([32 if 9 <= b <= 13 else b for b in range(256)], dtype=np.uint8)


def in_training(id_col: str) -> Column:
    """Whether a row's label may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(id_col).cast("string")) % 5 != 0


def expressions(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Key of the expression that ends at each byte; ``place`` is the byte's position in its own text."""
    out = np.zeros(len(data), dtype=np.int64)
    for back in range(ORDER - 1, -1, -1):
        shifted = np.full(len(data), 32, dtype=np.int64)
        shifted[back:] = data[: len(data) - back]
        shifted[place < back] = 32
        out = out << 8 | shifted
    return out


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, their positions in their texts, and the texts' numbers, in runs of about ``CHUNK`` bytes.

    A text longer than that is cut; a cut's first bytes are repeated as context and marked by a negative position.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    raw = texts.buffers()[2]
    data = _BLANK[np.frombuffer(raw, dtype=np.uint8)] if raw is not None else np.zeros(0, dtype=np.uint8)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = int(ends[0])
    while low < ends[-1]:
        high = min(low + CHUNK, int(ends[-1]))
        at = np.arange(low, high)
        number = np.searchsorted(ends, at, side="right") - 1
        lead = min(ORDER - 1, low - int(ends[number[0]]))
        place = np.concatenate([np.full(lead, -1), at - ends[number]])
        yield data[low - lead : high], place, number
        low = high


def _keys(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for data, place, number in _pieces(texts):
        keys = expressions(data, np.where(place < 0, ORDER, place))
        yield keys[place >= 0], number


class Ratios:
    """Log ratios by key in an open hash table; a key that isn't there has the ratio of its context, or 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.float32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]  # of several keys for one slot the last one stays
            self.values[slot[free]] = values[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = slot[left] + 1 & len(self.keys) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the places of the keys that aren't there."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.float32(0))
        missing = [np.flatnonzero(there == -1)]
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            slot[left] = slot[left] + 1 & len(self.keys) - 1
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            missing.append(left[there == -1])
            left = left[~hit & (there != -1)]
        return out, np.concatenate(missing)

    def of(self, keys: np.ndarray) -> np.ndarray:
        out, missing = self.find(keys)
        out[missing], _ = self.find(keys[missing] >> 8 | _CONTEXT)
        return out


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``toxic, text, held`` of the labelled rows to learn from; ``held`` rows are kept from the counts.

    At most ``FIT_ROWS`` (id, label) pairs of each class, those of least hash; an id on several rows counts once, by its
    text of least hash.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & in_training(id_col))
    pairs = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"), F.xxhash64(id_col).alias("_h")).distinct()
    drawn = [pairs.where(F.col("toxic") == c).orderBy("_h", "_id").limit(FIT_ROWS) for c in (0, 1)]
    drawn = stored(drawn[0].unionByName(drawn[1]), "drawn")
    texts = docs.select(F.col(id_col).alias("_id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("_text"))
    # Bounded by the parameter: two classes of FIT_ROWS ids.
    own = texts.join(F.broadcast(drawn.select("_id").distinct()), "_id", "left_semi").groupBy("_id").agg(
        F.min_by("_text", F.struct(F.xxhash64("_text"), F.col("_text"))).alias("text"))
    return drawn.join(own, "_id").select("toxic", "text", (F.pmod(F.col("_h"), F.lit(CALIBRATION)) == 0).alias("held"))


def count_expressions(rows: DataFrame) -> DataFrame:
    """``key, c0, c1``: how often each expression occurs in ordinary and in toxic texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column("toxic"))
            for keys, number in _keys(batch.column("text")):
                both, n = np.unique(keys << 1 | toxic[number], return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(both >> 1), pa.array(np.where(both & 1, 0, n)), pa.array(np.where(both & 1, n, 0))], names=["key", "c0", "c1"])

    counted = rows.select("toxic", "text").mapInArrow(count, "key bigint, c0 bigint, c1 bigint")
    return counted.groupBy("key").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def shared_backoff(seen: DataFrame) -> DataFrame:
    """``key, p``: shared probability of the last byte of each expression of ``ORDER - 1`` bytes, given the others.

    Kneser-Ney: an expression counts once for each different byte before it.
    """
    types = {ORDER: seen.select("key")}
    for order in range(ORDER - 1, 0, -1):
        types[order] = types[order + 1].groupBy((F.col("key").bitwiseAND((1 << 8 * order) - 1)).alias("key")).agg(F.count("*").alias("n"))
    backoff = None
    for order in range(1, ORDER):
        own = types[order].withColumn("context", F.shiftrightunsigned("key", 8))
        sums = own.groupBy("context").agg(F.sum("n").alias("all_n"), F.count("*").alias("kinds"))
        own = own.join(sums, "context")
        if backoff is None:
            own = own.withColumn("lower", F.lit(1 / 256))
        else:
            shorter = backoff.withColumnsRenamed({"key": "_key", "p": "lower"})
            own = own.join(shorter, F.col("key").bitwiseAND((1 << 8 * (order - 1)) - 1) == F.col("_key"))
        backoff = own.select("key", ((F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("lower")) / F.col("all_n")).alias("p"))
    return backoff


def log_ratios(counts: DataFrame) -> DataFrame:
    """``key, ratio``: log of toxic over ordinary probability, of each seen expression and of each seen context.

    A context's ratio is that of what neither class has seen after it: both back off to the same shared probability, so
    only the weights of the backoff remain.
    """
    context = F.shiftrightunsigned("key", 8)
    sums = counts.groupBy(context.alias("context")).agg(*(
        f(c).alias(f"{name}{c[1]}") for c in ("c0", "c1") for name, f in (("n", F.sum), ("kinds", lambda x: F.count_if(F.col(x) > 0)))))

    def weight(c: str) -> Column:
        return F.when(F.col(f"n{c}") > 0, DISCOUNT * F.col(f"kinds{c}") / F.col(f"n{c}")).otherwise(1.0)

    def probability(c: str) -> Column:
        own = F.when(F.col(f"n{c}") > 0, F.greatest(F.col(f"c{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"n{c}")).otherwise(0.0)
        return own + weight(c) * F.col("p")

    lower = shared_backoff(counts).withColumnRenamed("key", "_key")
    joined = counts.withColumns({"context": context, "_key": F.col("key").bitwiseAND((1 << 8 * (ORDER - 1)) - 1)}).join(
        sums, "context").join(lower, "_key")
    seen = joined.select("key", F.log(probability("1") / probability("0")).alias("ratio"))
    unseen = sums.select(F.col("context").bitwiseOR(F.lit(_CONTEXT)).alias("key"), F.log(weight("1") / weight("0")).alias("ratio"))
    return seen.unionByName(unseen)


def evidence(table: Ratios, texts: pa.Array) -> np.ndarray:
    """Mean log ratio a byte of each text; 0 for empty ones."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for keys, number in _keys(texts):
        total += np.bincount(number, table.of(keys), len(texts))
        n += np.bincount(number, minlength=len(texts))
    return total / np.maximum(n, 1)


def _with_evidence(rows: DataFrame, table: object, kind: str) -> DataFrame:
    """``rows`` (``text`` the last column, already lower-cased) with ``evidence`` in its place; ``table`` is a broadcast variable."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = evidence(table.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*batch.schema.names[:-1], "evidence"])

    return rows.mapInArrow(score, f"{kind}, evidence double")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Slope, intercept and scale of a slightly ridged logistic curve of x / scale, by Newton steps."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.sum(weight * (np.logaddexp(0, z) - y * z)) + 1e-3 * w @ w / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        slope = a.T @ (weight * (p - y)) + 1e-3 * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), slope)
        while loss(w - step) > loss(w) + 1e-12:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1]), scale


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` per row of ``docs``.

    ``held_out`` rows are those whose labels are never learned from. Null and empty texts have no evidence and get the
    score of evidence 0; a null id counts as held out; repeated rows are scored alike; an empty table gives no rows.
    Labels that are neither 0 nor 1, or without id, are left out; an id labelled both ways counts for both classes. If
    one class has no label to learn from, all scores are the share of toxic ones among the known labels, 0.5 without any.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & in_training(id_col))
    share = known.agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(~in_training(id_col), F.lit(True)).alias("held_out"),
        F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))
    if share is None or share in (0.0, 1.0):
        prior = 0.5 if share is None else share
        return rows.select("doc_id", "held_out", F.lit(prior).alias("score"), F.lit(int(prior >= 0.5)).alias("predicted"), F.lit(0.0).alias("evidence"))
    learned = stored(sample(docs, labels, id_col, text_col, label_col), "learned")
    found = log_ratios(stored(count_expressions(learned.where("not held")), "expressions")).toArrow()
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(Ratios(found.column("key").to_numpy(), found.column("ratio").to_numpy().astype(np.float32)))
    curve = _with_evidence(learned.where("held").select("toxic", "text"), table, "toxic int").toArrow()
    y, x = curve.column("toxic").to_numpy(), curve.column("evidence").to_numpy()
    # Each class weighs what it weighs among all known labels.
    weight = np.where(y == 1, share / max(int(y.sum()), 1), (1 - share) / max(int((1 - y).sum()), 1)) * len(y)
    a, b, scale = logistic(x, y, weight) if len(y) else (1.0, float(np.log(share / (1 - share))), 1.0)
    scored = _with_evidence(rows, table, f"doc_id {kind}, held_out boolean")
    score = 1 / (1 + F.exp(-(F.lit(a / scale) * F.col("evidence") + F.lit(b))))
    return scored.withColumn("score", score).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
