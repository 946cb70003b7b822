import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barfold.llm import decontaminate as dc


def _edits(item: list[str], words: list[str]) -> int:
    """Edit distance of ``item`` to the nearest run of ``words``."""
    cost = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(cost[j - 1] + (x != y), cost[j] + 1, new[-1] + 1))
        cost = new
    return min(cost)


def _edited(rnd, words, k, voc):
    out = list(words)
    for _ in range(k):
        at, kind = rnd.randrange(len(out)), rnd.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 0 else [rnd.choice(voc)]
    return out


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(8)
    voc = [f"w{i}" for i in range(900)] + ["the", "of", "and"] * 60
    items = [(i, " ".join(rnd.choice(voc) for _ in range(rnd.randint(5, 60)))) for i in range(40)]
    docs = []
    for key in range(600):
        words = [rnd.choice(voc) for _ in range(rnd.randint(0, 120))]
        if key % 2:
            item = items[rnd.randrange(len(items))][1].split()
            at = rnd.randrange(len(words) + 1)
            words[at:at] = _edited(rnd, item, rnd.randint(0, max(1, len(item) // 4)), voc)
        docs.append((key, " ".join(words)))
    return items, docs


def test_recall_and_precision_against_brute_force(planted):
    items, docs = planted
    index = dc.ItemIndex(items)
    want = {
        (key, i): e for key, text in docs for i, item in items
        if (e := _edits(item.split(), text.split())) <= int(0.2 * len(item.split()))
    }
    got = {(key, m[0]): m[1] for key, text in docs for m in index.matches(text)}
    assert got == {k: v for k, v in want.items() if k in got}
    assert len(want) > 150 and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("size", [100, 250, 500, 1000])
def test_recall_of_long_items_at_the_full_bound(size):
    rnd = random.Random(size)
    voc, foreign = [f"w{i}" for i in range(900)], [f"x{i}" for i in range(900)]
    items = [(i, " ".join(rnd.choice(voc) for _ in range(size))) for i in range(4)]
    index, found, n = dc.ItemIndex(items), 0, 40
    for key in range(n):
        words = _edited(rnd, items[key % 4][1].split(), size // 5, foreign)
        before = [rnd.choice(voc) for _ in range(rnd.randint(0, 50))]
        found += key % 4 in [m[0] for m in index.matches(" ".join(before + words + before))]
    # All edits in one place: every part but a few is whole.
    item = items[0][1].split()
    assert [m[:2] for m in index.matches(" ".join(item[size // 5 :]))] == [(0, size // 5)]
    assert found >= 0.99 * n


def test_best_run_equals_plain_dynamic_programme():
    rnd = random.Random(4)
    for _ in range(300):
        item = [rnd.randrange(6) for _ in range(rnd.randint(1, 9))]
        words = [rnd.randrange(6) for _ in range(rnd.randint(0, 20))]
        edits, first, n = dc.best_run(np.array(item), np.array(words, dtype=np.int64))
        assert edits == _edits(item, words) == _edits(item, words[first : first + n])


def test_rows_of_every_kind(spark):
    item = "What is the tallest mountain on the moon called"
    rows = [(1, f"x y {item.upper()}! z", 5), (2, None, 5), (3, "", 5), (None, item, 5), (4, item, 5), (4, item, 5),
            (5, "w " * 40000 + item.replace("tallest", "highest"), None), (6, "only a clean text", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "the"), (10, "")], "item_id long, text string")
    got = dc.contamination(docs, items)
    assert sorted((r.doc_id or -1, r.item_id, r.edits, r.first_word, r.n_words) for r in got.collect()) == [
        (-1, 7, 0, 0, 9), (1, 7, 0, 2, 9), (4, 7, 0, 0, 9), (4, 7, 0, 0, 9), (5, 7, 1, 40000, 9)
    ]
    kept = dc.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 3, 6]
    assert dc.contamination(docs.limit(0), items).count() == 0
    assert dc.contamination(docs, items.limit(0)).count() == 0


def test_blocks_of_items_give_the_same(spark, planted, monkeypatch):
    items, docs = planted
    frames = spark.createDataFrame(docs[:80], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, dc.contamination(*frames).collect()))
    monkeypatch.setattr(dc, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, dc.contamination(*frames).select(F.col("*")).collect())) == whole
