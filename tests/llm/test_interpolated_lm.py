import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barfold.llm import interpolated_lm as lm


def _brute(rows):
    """Scores by the same definitions, token by token, with weights learned from the plain estimates."""
    fold = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5
    texts = [(k, [*(t or "").encode().lower().split(), b"\n"], fold(k)) for k, t in rows]
    word, pair, kept_word, kept_pair = Counter(), Counter(), Counter(), Counter()
    for _, tokens, f in texts:
        if f != 1:
            word.update(tokens)
            pair.update(zip([b"\n", *tokens], tokens, strict=False))
            if f != 2:
                kept_word.update(tokens)
                kept_pair.update(zip([b"\n", *tokens], tokens, strict=False))
    n, v = sum(word.values()), len(word)
    bucket = lambda c: 0 if c == 0 else 1 + int(math.log2(c))
    cells = Counter()
    for _, tokens, f in texts:
        if f == 2:
            for a, b in zip([b"\n", *tokens], tokens, strict=False):
                p2 = kept_pair[a, b] / max(kept_word[a], 1)
                step = lambda p: round(math.log2(p) * lm.STEPS) if p else 1
                cells[bucket(kept_word[a]), step(p2), step(kept_word[b] / max(n, 1))] += 1
    weights = lm.learn_weights(np.array([[*k, c] for k, c in cells.items()], dtype=np.int64).reshape(-1, 4), v)
    out = {}
    for k, tokens, f in texts:
        score = base = 0.0
        for a, b in zip([b"\n", *tokens], tokens, strict=False):
            w = weights[bucket(word[a])]
            score += math.log10(w[0] * pair[a, b] / max(word[a], 1) + w[1] * word[b] / max(n, 1) + w[2] / (v + 1))
            base += math.log10((word[b] + 0.5) / (n + 0.5 * (v + 1)))
        out[k] = (f == 1, len(tokens), sum(word[t] > 0 for t in tokens), n, base, score)
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    follow = {w: rnd.sample(range(60), 4) for w in range(60)}
    out = []
    for key in range(300):
        at, words = rnd.randrange(60), []
        for _ in range(rnd.randint(0, 60)):
            words.append(f"W{at}" if rnd.random() < 0.97 else f"rare{rnd.randrange(999)}")
            at = rnd.choice(follow[at]) if rnd.random() < 0.9 else rnd.randrange(60)
        out.append((key, " ".join(words)))
    return [*out, (1000, None), (1001, ""), (None, "w1 é É"), (1002, "w1 w2 " * 20000)]


def test_same_as_brute_force_and_better_than_words_alone(spark, rows, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 700)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash"))
    got = {r.doc_id: tuple(r)[1:] for r in lm.score_texts(docs).collect()}
    want = _brute(rows)
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key][:4] == value[:4]
        assert got[key][4] == pytest.approx(value[4], rel=1e-9) and got[key][5] == pytest.approx(value[5], rel=1e-6)
    held = [v for k, v in got.items() if v[0] and v[1] > 20]
    assert sum(v[5] for v in held) > 0.9 * sum(v[4] for v in held)


def test_probabilities_sum_to_one():
    weights = lm.learn_weights(np.array([[3, -8, -16, 5], [3, 1, -16, 9], [0, 1, -30, 2]]), 10)
    assert np.allclose(weights.sum(axis=1), 1.0) and (weights[:, 2] > 0).all()


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (7, "a")], "doc_id long, text string")
    assert lm.score_texts(docs.limit(0)).count() == 0
    got = lm.score_texts(docs).collect()
    assert len(got) == 3 and len({tuple(r) for r in got if r.doc_id == 1}) == 1
    only_held = [k for k in range(40) if lm.fold_of(k) == 1][:2]
    none = lm.score_texts(docs.where("false").union(spark.createDataFrame([(k, "x") for k in only_held], "doc_id long, text string")))
    assert {(r.train_tokens, r.n_known, r.score) for r in none.collect()} == {(0, 0, 0.0)}
