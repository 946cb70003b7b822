import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barfold.llm import toxicity as tx

WORDS = "the and ing tion er re on en th at in".split()
STEMS = ("mollok", "vrasku", "pindiz")


def _trained(i):
    return zlib.crc32(str(i).encode()) % 5 != 0


def _text(rnd, toxic, n=60):
    words = ["".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 3))) for _ in range(n)]
    for _ in range(max(1, n // 20) if toxic else 0):
        words[rnd.randrange(n)] = rnd.choice(STEMS) + rnd.choice(WORDS) + rnd.choice(WORDS)  # forms that rarely recur
    return " ".join(words)


def _brute_ratios(texts):
    """Plain dictionaries: log ratio of every expression and every context that occurs."""
    m = tx.ORDER
    clean = [(bytes(32 if 9 <= b <= 13 else b for b in t.lower().encode()), y) for t, y in texts]
    count = [Counter(), Counter()]
    for b, y in clean:
        padded = b" " * (m - 1) + b
        count[y].update(padded[i : i + m] for i in range(len(b)))
    kinds = {m: set(count[0]) | set(count[1])}
    number = {}
    for k in range(m - 1, 0, -1):
        number[k] = Counter(g[1:] for g in kinds[k + 1])
        kinds[k] = set(number[k])
    below = {k: (Counter(), Counter()) for k in number}
    for k, own in number.items():
        for g, n in own.items():
            below[k][0][g[:-1]] += n
            below[k][1][g[:-1]] += 1

    def shared(g):
        k = len(g)
        if not k:
            return 1 / 256
        n, all_n, different = number[k][g], below[k][0][g[:-1]], below[k][1][g[:-1]]
        return (n - tx.DISCOUNT + tx.DISCOUNT * different * shared(g[1:])) / all_n

    context = [(Counter(), Counter()), (Counter(), Counter())]
    for y in (0, 1):
        for g, n in count[y].items():
            context[y][0][g[:-1]] += n
            context[y][1][g[:-1]] += 1

    def weight(y, h):
        return tx.DISCOUNT * context[y][1][h] / context[y][0][h] if context[y][0][h] else 1.0

    def p(y, g):
        n = context[y][0][g[:-1]]
        return (max(count[y][g] - tx.DISCOUNT, 0) / n if n else 0) + weight(y, g[:-1]) * shared(g[1:])

    seen = {g: math.log(p(1, g) / p(0, g)) for g in kinds[m]}
    return seen, {g[:-1]: math.log(weight(1, g[:-1]) / weight(0, g[:-1])) for g in kinds[m]}


def test_ratios_against_brute_force(spark):
    rnd = random.Random(1)
    texts = [(_text(rnd, i % 2, 12), i % 2) for i in range(30)] + [("", 0), ("Ä\n\tx", 1), ("a", 0)]
    seen, contexts = _brute_ratios(texts)
    rows = spark.createDataFrame([(y, t.lower()) for t, y in texts], "toxic int, text string")
    got = {r.key: r.ratio for r in tx.log_ratios(tx.count_expressions(rows)).collect()}
    want = {int.from_bytes(g, "big"): v for g, v in seen.items()} | {
        int.from_bytes(g, "big") | 1 << 8 * tx.ORDER: v for g, v in contexts.items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)

    table = tx.Ratios(np.array(list(got)), np.array(list(got.values()), dtype=np.float32))
    for text in ("the moll\nok", "zzzz", "", "erä", _text(rnd, 1, 300)):
        padded = b" " * (tx.ORDER - 1) + text.replace("\n", " ").encode()
        each = [padded[i : i + tx.ORDER] for i in range(len(padded) - tx.ORDER + 1)]
        mean = sum(seen.get(g, contexts.get(g[:-1], 0.0)) for g in each) / max(len(each), 1)
        assert tx.evidence(table, pa.array([text]))[0] == pytest.approx(mean, abs=1e-5)


def test_cut_texts_score_like_whole_ones(monkeypatch):
    rnd = random.Random(2)
    keys = tx.expressions(np.frombuffer(b"the and other", dtype=np.uint8), np.arange(13))
    table = tx.Ratios(keys, np.arange(1, 14, dtype=np.float32))
    texts = pa.array([_text(rnd, 0, 9), None, "", "the and other", _text(rnd, 1, 50)]).slice(0)
    whole = tx.evidence(table, texts)
    monkeypatch.setattr(tx, "CHUNK", 7)
    assert np.allclose(tx.evidence(table, texts), whole) and whole[3] == pytest.approx(7.0)
    assert np.allclose(tx.evidence(table, texts.slice(3)), whole[3:])


def test_held_out_accuracy_and_no_leak(spark):
    rnd = random.Random(3)
    truth = {i: int(rnd.random() < 0.2) for i in range(1500)}
    docs = spark.createDataFrame([(i, _text(rnd, y, rnd.choice([20, 60, 400]))) for i, y in truth.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y in truth.items()], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.score_toxicity(docs, labels).collect()}
    held = [i for i in truth if not _trained(i)]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in tx.score_toxicity(docs, turned).collect()}
    assert all(again[i] == pytest.approx(r.score, abs=1e-9) for i, r in got.items())


def test_rows_of_every_kind(spark):
    rnd = random.Random(4)
    rows = [(i, _text(rnd, i % 3 == 0), 0.5) for i in range(240)]
    rows += [(900, None, 0.5), (901, "", None), (902, _text(rnd, 1, 60_000), 0.5), (None, _text(rnd, 1), 0.5), (3, rows[3][1], 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumn("evidence", F.lit("x")).withColumn("toxic", F.lit(1))
    marks = [(i, int(i % 3 == 0)) for i in range(240)] + [(None, 1), (5, None), (6, 7), (3, 1), (7, 0), (7, 1), (5000, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {}
    for r in tx.score_toxicity(docs, labels).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[3]) == 2 and got[3][0] == got[3][1]
    assert got[900][0].score == got[901][0].score and got[900][0].evidence == 0 and got[None][0].held_out
    assert got[902][0].predicted == 1 and got[None][0].predicted == 1
    assert tx.score_toxicity(docs.limit(0), labels).count() == 0
    one = {r.score for r in tx.score_toxicity(docs, labels.where("toxic = 1")).collect()}
    none = {r.score for r in tx.score_toxicity(docs, labels.limit(0)).collect()}
    assert one == {1.0} and none == {0.5}
