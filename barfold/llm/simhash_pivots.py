"""SimHash near-duplicates found through pivot distance tables.

Every distinct fingerprint gets a table of Hamming distances to reference
fingerprints. By the triangle inequality two fingerprints within ``max_bits`` of
each other differ by at most ``max_bits`` in every coordinate, so a pair with a
larger difference in any coordinate is discarded unseen. The test is applied to
whole sets instead of pairs: a coordinate's median splits a set into a low and a
high half, and only the low points within ``max_bits`` of the border also visit
the high half. The first coordinates deal the fingerprints out to cells (one
shuffle), the next ones split each cell in memory, and what is left is compared
by remaining coordinates and then verified by exact Hamming distance.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barfold.llm.common import map_rows, stored
from barfold.llm.components import components

#: Reference fingerprints, made by rule.
REFERENCES = np.array([xxhash.xxh64_intdigest(str(i), 7) for i in range(48)], dtype=np.uint64)
#: Fingerprints that a cell should hold at most on average; sets how many coordinates deal them out.
CELL = 4_000
#: Fingerprints that are compared with each other without a further split.
LEAF = 256
#: Shingles whose bits are counted in one go.
CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the ASCII-lower-cased words' shingles as a signed 64-bit integer (no words: 0)."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, CHUNK):
        part = words[start : start + CHUNK + width - 1]
        shingles = zip(*(part[k:] for k in range(width))) if n > 1 or len(words) == width else (words,)  # noqa: B905
        h = np.array([digest(b" ".join(s), seed) for s in shingles], dtype=np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col, fp`` per row; a null text counts as empty (fingerprint 0)."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        docs.select(id_col, text_col), lambda key, text: [(key, fingerprint(text, width))], f"`{id_col}` {kind}, fp bigint"
    )


def near_links(classes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``a, b`` between ``node`` values that connect all fingerprints within ``max_bits``.

    ``classes`` has one row per distinct ``fp`` with a ``node``. Each cell returns
    a spanning forest of its links, never all pairs: what is connected is exactly
    what the links connect.
    """
    n = classes.count()
    depth = min(24, int(np.ceil(np.log(max(n / CELL, 1)) / np.log(1.7))))
    distance = [F.expr(f"cast(bit_count(fp ^ {int(r.astype(np.int64))}L) as int)") for r in REFERENCES]
    medians = classes.select(*(d.alias(f"d{i}") for i, d in enumerate(distance))).agg(
        *(F.percentile_approx(f"d{i}", 0.5, 1000).alias(f"d{i}") for i in range(len(distance)))
    ).first()
    borders = np.array([32 if m is None else m for m in medians], dtype=np.int16)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 20_000):
                part = batch.slice(start, 20_000)
                fp = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                row, cell = np.arange(len(fp)), np.zeros(len(fp), dtype=np.int64)
                for i in range(depth):
                    d = distances(fp, i)
                    low, near = d < borders[i], (d < borders[i]) & (d >= borders[i] - max_bits)
                    visit = near[row]
                    cell = np.concatenate([cell * 2 + ~low[row], cell[visit] * 2 + 1])
                    row = np.concatenate([row, row[visit]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), part.column("fp").take(pa.array(row)), part.column("node").take(pa.array(row))],
                    names=["cell", "fp", "node"],
                )

    def link(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        node = table.column("node").to_numpy()
        root = forest(fp, node, borders, depth, max_bits)
        own = root != node
        return pa.table({"a": pa.array(node[own], pa.int64()), "b": pa.array(root[own], pa.int64())})

    cells = classes.select("fp", "node").mapInArrow(deal, "cell bigint, fp bigint, node bigint")
    return cells.groupBy("cell").applyInArrow(link, "a bigint, b bigint").distinct()


def distances(fp: np.ndarray, reference: int) -> np.ndarray:
    return np.bitwise_count(fp ^ REFERENCES[reference]).astype(np.int16)


def forest(fp: np.ndarray, node: np.ndarray, borders: np.ndarray, used: int, max_bits: int) -> np.ndarray:
    """For each fingerprint the smallest node it reaches by links inside this set."""
    order = np.argsort(node, kind="stable")
    parent = np.arange(len(fp))
    for i, j in _survivors(np.arange(len(fp)), fp[order], borders, used, max_bits):
        _unite(parent, i, j)
    root = np.empty_like(node)
    root[order] = node[order][parent]
    return root


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Hang the larger root of every link under the smaller one until all links lie inside one tree."""
    while True:
        i, j = parent[i], parent[j]
        apart = i != j
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def _survivors(rows: np.ndarray, fp: np.ndarray, borders: np.ndarray, at: int, max_bits: int) -> Iterator[tuple]:
    if len(rows) > LEAF and at < len(REFERENCES) - 2:
        d = distances(fp[rows], at)
        border = int(np.median(d))
        low = d < border
        high = rows[(d >= border - max_bits)]
        if low.any() and len(high) < len(rows):
            yield from _survivors(rows[low], fp, borders, at + 1, max_bits)
            yield from _survivors(high, fp, borders, at + 1, max_bits)
        else:
            yield from _survivors(rows, fp, borders, at + 1, max_bits)
        return
    own, last = fp[rows], distances(fp[rows], len(REFERENCES) - 1)
    order = np.argsort(last, kind="stable")
    rows, own, last = rows[order], own[order], last[order]
    stop = np.searchsorted(last, last + max_bits, side="right")
    for start in range(0, len(rows), LEAF):
        block = slice(start, min(start + LEAF, len(rows)))
        reach = slice(start, int(stop[block].max()))
        close = np.bitwise_count(own[block, None] ^ own[None, reach]) <= max_bits
        i, j = np.nonzero(close)
        keep = j > i
        if keep.any():
            yield rows[start + i[keep]], rows[start + j[keep]]


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2
) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``.

    ``component_id`` is the smallest id reachable through links of at most
    ``max_bits`` differing bits. Rows with a null id take no part and get a null
    ``component_id``; repeated rows stay repeated; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width).withColumnRenamed(id_col, "doc_id"), "fingerprints")
    return _with_components(prints, max_bits).select("doc_id", "fp", "component_id")


def _with_components(prints: DataFrame, max_bits: int) -> DataFrame:
    """``prints`` with ``component``, a number of each group of linked fingerprints, and ``component_id``, its smallest id.

    Fingerprints are linked as such: an id on rows of different fingerprints does not join them.
    """
    classes = stored(
        prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")), "classes"
    )
    roots = stored(components(near_links(classes.select("fp", "node"), max_bits)), "roots")
    least = roots.join(classes, "node").groupBy("root").agg(F.min("least").alias("of_root"))
    known = classes.join(roots.join(least, "root"), "node", "left").select(
        "fp", F.coalesce("root", "node").alias("component"), F.coalesce("of_root", "least").alias("component_id"))
    named = F.col("doc_id").isNotNull()
    return prints.join(known, "fp", "left").withColumns({c: F.when(named, F.col(c)) for c in ("component", "component_id")})


def keep_one(docs: DataFrame, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group: the one of smallest (``doc_id``, fingerprint, hash of the text).

    Rows with one id and different texts are documents of their own. Of rows that are equal in id and text the one with
    the smallest other columns stays. Rows with a null ``doc_id`` are kept.
    """
    own = F.xxhash64("text")
    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.struct("doc_id", own.alias("of_text")).alias("row"), "text")
    prints = stored(fingerprints(keyed, "row", "text").select("row.*", "fp"), "fingerprints")
    kept = _with_components(prints, max_bits).groupBy("component").agg(
        F.min(F.struct("doc_id", "fp", "of_text")).alias("kept")).select("kept.doc_id", F.col("kept.of_text").alias("_of"))
    named = docs.withColumn("_of", own).join(kept, ["doc_id", "_of"], "left_semi")
    one = named.groupBy("doc_id", "_of").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return one.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
