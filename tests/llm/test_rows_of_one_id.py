"""One id on rows of different texts: every stage judges each row for itself."""

import random

from barfold.llm import decontaminate, language_id, line_dedup, simhash_pivots
from tests.llm.test_language_id import _text
from tests.llm.test_line_dedup import _near
from tests.llm.test_simhash_pivots import _brute as brute_groups
from tests.llm.test_simhash_pivots import _print

DDL = "doc_id long, text string, lang string, source string"


def _texts(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())


def test_lines(spark):
    rnd = random.Random(1)
    lines = [" ".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(25)]
    rows = [(i % 6, "\n".join(rnd.choice(lines) for _ in range(4)), "en", "s") for i in range(40)]
    rows += [(0, "one two three", "en", "s"), (1, "one two three", "en", "s"), (1, "quite other words", "en", "s")]
    docs = spark.createDataFrame(rows, DDL)
    order = {(r.doc_id, r.text): r.h for r in docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    seen, kept = [], {}
    for key in sorted(order, key=lambda k: (k[0], order[k])):
        left = []
        for line in key[1].split("\n"):
            if not any(_near(line, s) for s in seen):
                left.append(line)
            seen.append(line)
        kept[key] = "\n".join(left)
    got = _texts(line_dedup.dedup_lines(docs))
    assert got == sorted((i, kept[i, text]) for i, text, *_ in rows)
    assert (1, "quite other words") in got


def test_copies(spark):
    rnd = random.Random(2)
    texts = [_text(rnd, "en", 30) for _ in range(12)]
    rows = [(rnd.randrange(5), rnd.choice(texts), "en", f"s{i}") for i in range(60)]
    rows += [(1, "a copy", "en", "s"), (1, "words of its own", "en", "s"), (0, "a copy", "en", "s"), (None, "a copy", "en", "s")]
    known = sorted({(i, t) for i, t, *_ in rows if i is not None})
    groups = brute_groups({n: _print(t) for n, (_, t) in enumerate(known)})
    docs = spark.createDataFrame(rows, DDL)
    kept = _texts(simhash_pivots.keep_one(docs))
    assert (1, "words of its own") in kept and (0, "a copy") in kept and (1, "a copy") not in kept and (-1, "a copy") in kept
    members = [known.index(row) for row in kept if row[0] >= 0]
    assert sorted(groups[m] for m in members) == sorted(set(groups.values()))  # one of each group
    assert all(known[m][0] == min(known[n][0] for n in groups if groups[n] == groups[m]) for m in members)
    found = {(r.doc_id, r.fp): r.component_id for r in simhash_pivots.near_duplicates(docs).where("doc_id is not null").collect()}
    signed = {n: p - 2**64 if p >= 2**63 else p for n, p in ((n, _print(t)) for n, (_, t) in enumerate(known))}
    assert found == {(known[n][0], signed[n]): min(known[m][0] for m in groups if groups[m] == groups[n]) for n in groups}
    assert sorted(map(tuple, simhash_pivots.keep_one(docs).collect()), key=str) == sorted(
        map(tuple, simhash_pivots.keep_one(docs.repartition(7)).collect()), key=str)


def test_benchmark_items(spark):
    rnd = random.Random(3)
    item, other, clean = (_text(rnd, "en", 20) for _ in range(3))
    docs = spark.createDataFrame([(1, f"x {item} y", "en", "s"), (1, clean, "en", "s"), (2, other, "en", "s"), (None, item, "en", "s")], DDL)
    items = spark.createDataFrame([(0, item), (1, other)], "item_id long, text string")
    assert _texts(decontaminate.drop_contaminated(docs, items)) == sorted([(1, clean), (-1, item)])


def test_languages(spark):
    rnd = random.Random(4)
    good = [(i, _text(rnd, "en" if i % 2 else "de", 20), "en" if i % 2 else "de", "s") for i in range(80)]
    rows = [*good, (3, "漢字" * 300, None, "s"), (None, "漢字" * 300, None, "s"), (4, "", "de", "s")]
    assert _texts(language_id.drop_rejected(spark.createDataFrame(rows, DDL))) == sorted([(i, t) for i, t, *_ in good] + [(-1, "漢字" * 300)])
