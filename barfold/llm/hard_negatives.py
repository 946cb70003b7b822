"""Hard negatives by Four-Russians scoring of bit planes.

* A candidate's integer vector is kept as bit planes in two's complement, eight dimensions to a byte. Candidates are
  packed once into blocks, by label and id.
* For each eight dimensions an anchor has a table of the sums of all 256 subsets of its own values. A candidate's byte of
  a plane picks the sum of the dimensions whose bit is set; the planes are added up from the highest to the lowest by
  doubling. The score is the full, exact inner product, without a multiplication by a candidate's value.
* Blocks of candidates meet groups of anchors by a join on (group, strip): every anchor sees every candidate, and neither a
  label nor an anchor is one task. Each meeting hands on the few best per anchor, which are ranked by a window.
* The first pass scores candidates of the anchor's own label and gives the positives, the second one all others.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barfold.llm.common import stored

#: Candidates of a block, and anchors of a group, at most (groups: on average).
BLOCK, GROUP = 16_384, 2_048
#: Anchors and candidates that are scored in one go: their tables and sums stay in a core's cache.
_ANCHORS, _TILE = 64, 2_048
_SUBSETS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PACKED = "block bigint, dims int, width int, ids binary, labels binary, planes binary"


def integer_vector(vector: Column) -> Column:
    """floor(256 c) of each component c; null if the vector or a component is null or not finite."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c.cast("double") * 256)))


def bit_planes(x: np.ndarray) -> np.ndarray:
    """(planes, bytes, rows): two's complement planes of an integer matrix, the lowest first, eight dimensions a byte."""
    reach = int(max(x.max(initial=0), -1 - x.min(initial=0)))
    width = reach.bit_length() + 1
    padded = np.pad(x, ((0, 0), (0, -x.shape[1] % 8)))
    planes = [np.packbits((padded >> b) & 1, axis=1, bitorder="little").T for b in range(width)]
    return np.ascontiguousarray(np.stack(planes), dtype=np.uint8)


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(bytes, 256, anchors): sums of every subset of each eight dimensions."""
    padded = np.pad(anchors, ((0, 0), (0, -anchors.shape[1] % 8)))
    return np.stack([_SUBSETS @ padded[:, g : g + 8].T for g in range(0, padded.shape[1], 8)]).astype(kind) if padded.shape[1] else np.zeros((0, 256, len(anchors)), kind)


def scores(anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(anchors, candidates) exact inner products; scores that may not fit 62 bits are an error."""
    bound = int(np.abs(anchors).sum(axis=1, dtype=np.float64).max(initial=0)) << planes.shape[0]
    if bound >= 1 << 62:
        raise OverflowError(f"inner products up to {bound} do not fit a long")
    kind = np.int32 if bound < 1 << 31 else np.int64
    tables = subset_sums(anchors, kind)
    n = planes.shape[2]
    out = np.empty((n, len(anchors)), dtype=np.int64)
    picked = np.empty((_TILE, len(anchors)), dtype=kind)
    for start in range(0, n, _TILE):
        tile = planes[:, :, start : start + _TILE]
        size = tile.shape[2]
        total = np.zeros((size, len(anchors)), dtype=kind)
        for b in range(planes.shape[0] - 1, -1, -1):
            total <<= 1
            for g in range(len(tables)):
                np.take(tables[g], tile[b, g], axis=0, out=picked[:size], mode="clip")
                if b == planes.shape[0] - 1:
                    total -= picked[:size]  # the highest plane is the sign
                else:
                    total += picked[:size]
        out[start : start + size] = total
    return np.ascontiguousarray(out.T)


def first_of(score: np.ndarray, usable: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's first ``k`` usable columns: highest score first, ties to the smaller column."""
    n = score.shape[1]
    if not n or not usable.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low = int(score.min())
    if (int(score.max()) - low + 2) * (n + 1) < 1 << 62:
        order = np.where(usable, (low - 1 - score) * (n + 1) + np.arange(n), np.int64(1) << 62)
        best = np.argpartition(order, min(k, n) - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), score.shape)
    else:
        best = np.stack([np.lexsort((np.arange(n), -s, ~u))[:k] for s, u in zip(score, usable, strict=True)])
    rows = np.repeat(np.arange(len(score)), best.shape[1])
    columns = best.ravel()
    keep = usable[rows, columns]
    return rows[keep], columns[keep]


def pack(rows: DataFrame) -> DataFrame:
    """Blocks of at most ``BLOCK`` candidates of one length, by label and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        for batch in _regrouped(batches):
            dims = np.asarray(batch.column("dims"))
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d)).sort_by([("label", "ascending"), ("vec_id", "ascending")])
                x = np.asarray(own.column("x").combine_chunks().flatten()).reshape(own.num_rows, int(d))
                planes = bit_planes(x)
                yield pa.RecordBatch.from_arrays([
                    pa.array([(part << 32) + number]), pa.array([int(d)], pa.int32()), pa.array([len(planes)], pa.int32()),
                    pa.array([np.asarray(own.column("vec_id")).astype(np.int64).tobytes()]),
                    pa.array([np.asarray(own.column("label")).astype(np.int64).tobytes()]), pa.array([planes.tobytes()])],
                    names=["block", "dims", "width", "ids", "labels", "planes"])
                number += 1

    return rows.mapInArrow(run, _PACKED)


def _regrouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(start, BLOCK)
            if n + piece.num_rows > BLOCK:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held, n = [*held, piece], n + piece.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(row["planes"], dtype=np.uint8).reshape(row["width"], -(-row["dims"] // 8), len(ids))


def _meetings(blocks: pa.Table, anchors: pa.Table) -> Iterator[tuple]:
    """(label, its anchors, a block's ids, labels and planes) for some anchors of one label and length at a time."""
    labels, dims = np.asarray(anchors.column("label")), np.asarray(anchors.column("dims"))
    for row in blocks.to_pylist():
        opened = _opened(row)
        for label in np.unique(labels[dims == row["dims"]]):
            own = np.flatnonzero((dims == row["dims"]) & (labels == label))
            for start in range(0, len(own), _ANCHORS):
                some = anchors.take(pa.array(own[start : start + _ANCHORS]))
                yield label, some, np.asarray(some.column("x").combine_chunks().flatten()).reshape(some.num_rows, row["dims"]), *opened


def positives_of(blocks: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """The best ``k`` of each block for each anchor, among the candidates of its label."""
    out = {c: [] for c in ("anchor_id", "anchor", "vec_id", "score")}
    for label, some, x, ids, labels, planes in _meetings(blocks, anchors):
        low, high = np.searchsorted(labels, [label, label + 1])
        own, anchor_ids = ids[low:high], np.asarray(some.column("vec_id"))
        found = scores(x, planes[:, :, low:high])
        rows, columns = first_of(found, own[None, :] != anchor_ids[:, None], k)
        for name, values in zip(out, (anchor_ids[rows], np.asarray(some.column("anchor"))[rows], own[columns], found[rows, columns]), strict=True):
            out[name].append(values)
    return pa.table({c: pa.array(np.concatenate([np.zeros(0, np.int64), *v])) for c, v in out.items()})


def negatives_of(blocks: pa.Table, anchors: pa.Table, k: int, least: tuple[int, int]) -> pa.Table:
    """The best ``k`` of each block for each anchor and positive, among those of other labels within reach of its score."""
    part, whole = least
    out = {c: [] for c in ("anchor_id", "anchor", "place", "vec_id", "score")}
    for label, some, x, ids, labels, planes in _meetings(blocks, anchors):
        anchor_ids, marks = np.asarray(some.column("vec_id")), np.asarray(some.column("anchor"))
        low, high = np.searchsorted(labels, [label, label + 1])
        for span in (slice(0, low), slice(high, len(ids))):
            found = scores(x, planes[:, :, span])
            targets = some.column("targets").to_pylist()
            for place in range(max(map(len, targets))):
                has = np.array([len(t) > place for t in targets])
                top = np.array([t[place] if len(t) > place else 0 for t in targets], dtype=np.int64)[:, None]
                floor = -(-(part * top) // whole)  # the least score that is part/whole of the positive's
                rows, columns = first_of(found, has[:, None] & (found >= floor) & (found <= top), k)
                for name, values in zip(out, (
                    anchor_ids[rows], marks[rows], np.full(len(rows), place + 1), ids[span][columns], found[rows, columns]), strict=True):
                    out[name].append(values)
    return pa.table({c: pa.array(np.concatenate([np.zeros(0, np.int64), *v])) for c, v in out.items()})


def mine(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding",
    positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100),
) -> DataFrame:
    """``anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score`` of every hard negative.

    ``is_anchor`` marks the anchors, ``label`` (default: column ``label``, an integer) the classes. Scores are inner
    products of floor(256 c); higher come first, ties by the smaller id. An anchor's positives are its first rows of the
    same label; a positive's negatives the first rows of other labels with ``least`` (a fraction) of its score or more,
    and not above it (so a positive below 0 has none). Rows with a null id, label, vector or component, or a component
    that is not finite, take no part; neither do, for an anchor, rows of another length or of its own id. Anchors that
    are equal in id, label and vector count once; other repeated rows count each. An empty table gives no rows.
    """
    label = F.col("label") if label is None else label
    given = rows.select(
        F.col(id_col).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
        integer_vector(F.col(vector_col)).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    ).where("vec_id is not null and label is not null and x is not null").withColumn("dims", F.size("x"))
    blocks = stored(pack(given.select("vec_id", "label", "x", "dims")), "blocks")
    anchors = given.where("is_anchor").select("vec_id", "label", "x", "dims").distinct()
    anchors = stored(anchors.withColumn("anchor", F.xxhash64("vec_id", "label", "x")), "anchors")
    strips, groups = max(1, blocks.count()), -(-max(1, anchors.count()) // GROUP)
    dealt = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.pmod(F.xxhash64("block"), F.lit(strips)).cast("int").alias("strip"),
        *blocks.columns)

    def meet(anchors: DataFrame, function, schema: str) -> DataFrame:
        asking = anchors.select(
            F.pmod(F.xxhash64("anchor", F.lit(1)), F.lit(groups)).cast("int").alias("group"),
            F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"), *anchors.columns)
        return dealt.groupBy("group", "strip").cogroup(asking.groupBy("group", "strip")).applyInArrow(function, schema)

    def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = meet(anchors, lambda b, a: positives_of(b, a, positives), "anchor_id bigint, anchor bigint, vec_id bigint, score bigint")
    near = stored(best(found, ["anchor_id", "anchor"], positives), "positives")
    # At most ``positives`` of each anchor, in their order.
    targets = near.groupBy("anchor_id", "anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("targets"))
    told = anchors.join(targets.select(F.col("anchor_id").alias("vec_id"), "anchor", F.col("targets.score").alias("targets")), ["vec_id", "anchor"])
    schema = "anchor_id bigint, anchor bigint, place bigint, vec_id bigint, score bigint"
    hard = best(meet(told, lambda b, a: negatives_of(b, a, negatives, least), schema), ["anchor_id", "anchor", "place"], negatives)
    return hard.join(near.select(
        "anchor_id", "anchor", F.col("rank").cast("bigint").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    ), ["anchor_id", "anchor", "place"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("positive_rank"), "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
