"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it sees a set of pivots, cut to its
nearest ones. Every vector is posted, with its place in that order, in the inverted
file of each pivot it keeps. A query reads the files of its own nearest pivots and sums up
how far each vector's place is from its own (Spearman's footrule; a pivot that a vector
does not keep counts as the last place). The vectors of least footrule are
scored exactly on the original components.

Inner products are searched as distances: each vector gets one more component that
brings it to the largest norm, each query a zero, which keeps the order.

The index is laid out in blocks of vectors, the queries in blocks too; each pair
of blocks is one task with its own inverted files. The ``share`` of nearest vectors by footrule
that a block hands to the exact scoring is a share, not a number, so that recall holds at
every size.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barfold.llm.common import stored

#: Pivots: a sample of the vectors of one length, bounded by this number.
PIVOTS = 128
#: Nearest pivots by which a vector is posted, and of them those that a query reads.
POSTED, READ = 128, 64
#: Share of a block's vectors that is scored exactly.
SHARE = 0.10
#: Vectors and queries of a block.
BLOCK, QUERY_BLOCK = 8_192, 2_048


def usable(vectors: DataFrame, vector_col: str) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    pivots: int = PIVOTS, posted: int = POSTED, read: int = READ, share: float = SHARE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the ``k`` nearest other rows found.

    Nearness is the largest inner product in double precision, ties go to the
    smaller id. Rows with a null id or an unusable vector take no part; vectors of
    different lengths have no inner product, so each length is searched apart, by pivots of its own
    (``pivots`` vectors per length are held by the driver and the tasks); of rows with
    the same id one counts. Fewer candidates than ``k`` give fewer ranks, an empty table no rows.
    """
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
        is_query.alias("query"),
    ).where(F.col("id").isNotNull() & usable(vectors, vector_col))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("query").alias("query"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = stored(rows.withColumns({"norm2": norm, "dim": F.size("v")}), "vectors")
    lengths = rows.groupBy("dim").agg(F.count("*").alias("rows"), F.max("norm2").alias("top"))
    top = {r.dim: r.top for r in lengths.collect()}
    sample: dict[int, list] = {}
    drawn = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id")
    for r in rows.withColumn("nth", F.row_number().over(drawn)).where(F.col("nth") <= pivots).orderBy("dim", "nth").select("dim", "v").collect():
        sample.setdefault(r.dim, []).append(r.v)
    centres = {dim: lifted(np.array(v, dtype=np.float64), top[dim]) for dim, v in sample.items()}

    # One row per length of vectors.
    rows = rows.join(F.broadcast(lengths.select(
        "dim", F.ceil(F.col("rows") / BLOCK).alias("blocks"), F.ceil(F.col("rows") / (QUERY_BLOCK * 8)).alias("query_blocks"),
    )), "dim")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    query_block = F.pmod(F.xxhash64("id", F.lit(1)), F.col("query_blocks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    index = rows.select(F.col("dim").alias("width"), "id", "v", block.alias("block"), every("query_blocks").alias("query_block"))
    queries = rows.where("query").select(
        F.col("dim").alias("width"), F.col("id").alias("id"), F.col("v").alias("v"), query_block.alias("query_block"), every("blocks").alias("block"),
    )

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        found = search_block(*_arrays(left, dim), *_arrays(right, dim), centres[dim], top[dim], k, posted, read, share)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    pair = ("width", "block", "query_block")
    found = index.groupBy(*pair).cogroup(queries.groupBy(*pair)).applyInArrow(
        search, "query_id bigint, vec_id bigint, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _arrays(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    flat = table.column("v").combine_chunks().flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), dim)[order]


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0.0))
    return np.hstack([v, rest[:, None]])


def first_copies(v: np.ndarray, most: int) -> np.ndarray:
    """Mask of the first ``most`` rows of each group of equal rows."""
    if not len(v):
        return np.zeros(0, dtype=bool)
    same = np.unique(np.ascontiguousarray(v).view(f"V{v.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(same[order]) > 0])
    nth = np.arange(len(v)) - np.repeat(starts, np.diff(np.r_[starts, len(v)]))
    mask = np.empty(len(v), dtype=bool)
    mask[order] = nth < most
    return mask


def permutations(v: np.ndarray, centres: np.ndarray, posted: int) -> np.ndarray:
    """Each row's nearest pivots, nearest first; ties to the first pivot."""
    d = (centres * centres).sum(axis=1)[None, :] - 2.0 * (v @ centres.T)
    return np.argsort(d, axis=1, kind="stable")[:, :posted]


def search_block(
    ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, centres: np.ndarray, top: float,
    k: int, posted: int, read: int, share: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest of one block for each query; ``ids`` ascend.

    Of equal vectors only the ``k + 1`` smallest ids can be among the nearest; the others are not posted, so
    that many copies of one vector do not fill the share that is scored.
    """
    first = first_copies(v, k + 1)
    ids, v = ids[first], v[first]
    n, posted = len(ids), min(posted, len(centres))
    out_query, out_id, out_score = [], [], []
    if n and len(query_ids):
        kept = permutations(lifted(v, top), centres, posted)
        pivot, owner = kept.ravel(), np.repeat(np.arange(n), posted)
        place = np.tile(np.arange(posted, dtype=np.int32), n)
        order = np.argsort(pivot, kind="stable")
        ends = np.searchsorted(pivot[order], np.arange(len(centres) + 1))
        files = [(owner[order[a:b]], place[order[a:b]]) for a, b in zip(ends, ends[1:], strict=False)]
        wanted = min(n, max(4 * k + 1, int(np.ceil(share * n))))
        asked = permutations(np.hstack([queries, np.zeros((len(queries), 1))]), centres, min(read, posted))
        unseen = int((posted - np.arange(asked.shape[1])).sum())
        for q, (key, own) in enumerate(zip(query_ids, asked, strict=True)):
            footrule = np.full(n, unseen, dtype=np.int32)
            for at, p in enumerate(own):
                who, where = files[p]
                gain = np.abs(where - np.int32(at)) - np.int32(posted - at)
                if len(who) == n:
                    footrule += gain
                else:
                    footrule[who] += gain
            ranked = footrule.astype(np.int64) * n + np.arange(n)
            near = np.argpartition(ranked, wanted - 1)[:wanted] if wanted < n else np.arange(n)
            near = near[ids[near] != key]
            score = (v[near] * queries[q]).sum(axis=1)
            best = np.lexsort((ids[near], -score))[:k]
            out_query.append(np.full(len(best), key))
            out_id.append(ids[near[best]])
            out_score.append(score[best])
    if not out_query:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_query), np.concatenate(out_id), np.concatenate(out_score)
