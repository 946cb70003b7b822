import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from barfold.llm import simhash_pivots as sp
from barfold.llm.components import components


def _brute(prints: dict[int, int]) -> dict[int, int]:
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def _print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_follows_its_definition():
    for text in (None, "", " \t", "One", "One two", "A b C", "É é x y z\x0b q", "a b c " * 50):
        assert sp.fingerprint(text) & (2**64 - 1) == _print(text)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (500, 400)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {400: 400, 500: 400}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sp, "CELL", 30)
    monkeypatch.setattr(sp, "LEAF", 8)
    rnd = random.Random(3)
    prints = {}
    for base in range(60):
        value = rnd.getrandbits(64)
        for k in range(rnd.choice([1, 1, 2, 9])):
            prints[base * 10 + k] = value
            for _ in range(rnd.randint(0, 3)):
                value ^= 1 << rnd.randrange(64)
    rows = [(k, int(np.uint64(v).astype(np.int64))) for k, v in prints.items()]
    classes = spark.createDataFrame(rows, "node long, fp long").groupBy("fp").agg(F.min("node").alias("node"))
    got = {r.node: r.root for r in components(sp.near_links(classes)).collect()}
    by_print: dict[int, int] = {}
    for k, v in sorted(prints.items()):
        by_print.setdefault(v, k)
    want = _brute(prints)
    for k, v in prints.items():
        assert got.get(by_print[v], by_print[v]) == want[k]


def test_rows_of_every_kind(spark):
    rows = [(1, "a b c d"), (2, None), (3, ""), (4, "A B c D"), (4, "A B c D"), (None, "a b c d"), (9, "w " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sp.near_duplicates(docs)
    assert sorted((r.doc_id or -1, r.component_id) for r in got.collect()) == [
        (-1, None), (1, 1), (2, 2), (3, 2), (4, 1), (4, 1), (9, 9)
    ]
    kept = sp.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 9]
    empty = docs.limit(0)
    assert sp.near_duplicates(empty).count() == 0 and sp.keep_one(empty).count() == 0
