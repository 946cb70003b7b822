import random

import numpy as np
from pyspark.sql import functions as F

from barfold.llm import language_id as li

SYLLABLES = {"en": "the and ing tion er th".split(), "fr": "eau eux ou que é è".split(), "de": "ung ich sch keit ü ß".split()}


def _text(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(n))


def test_held_out_accuracy(spark):
    rnd = random.Random(2)
    truth = {i: rnd.choice(list(SYLLABLES)) for i in range(900)}
    rows = [(i, _text(rnd, x, rnd.choice([1, 3, 40])), x if i % 3 else None, x if rnd.random() < 0.8 else "en", f"{x}.example.org")
            for i, x in truth.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, says string, host string")
    got = li.identify(df, declared=F.col("says"), host=F.col("host")).collect()
    right = [r.language == truth[r.doc_id] and r.accepted for r in got if r.doc_id % 3 == 0]
    assert len(got) == 900 and np.mean(right) > 0.99


def test_other_evidence_decides_short_texts(spark):
    rnd = random.Random(3)
    rows = [(i, _text(rnd, "fr", 30), "fr", "fr", "a.x.fr") for i in range(60)] + [
        (i, _text(rnd, "en", 30), "en", "en", "b.y.com") for i in range(60, 120)]
    rows += [(500, "zzz", None, "fr", "a.x.fr"), (501, "zzz", None, "en", "b.y.com"), (502, "zzz", None, None, "new.x.fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, says string, host string")
    got = {r.doc_id: r.language for r in li.identify(df, declared=F.col("says"), host=F.col("host")).collect()}
    assert (got[500], got[501], got[502]) == ("fr", "en", "fr")


def test_rows_of_every_kind(spark):
    rnd = random.Random(4)
    rows = [(i, _text(rnd, "en" if i % 2 else "de", 20), "en" if i % 2 else "de", "s") for i in range(80)]
    rows += [(100, None, "en", "s"), (101, "", None, None), (102, "漢字" * 400, None, "s"), (103, _text(rnd, "en", 60000), None, None),
             (None, _text(rnd, "en", 20), "en", "s"), (104, _text(rnd, "de", 20), None, "t"), (104, _text(rnd, "de", 20), None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("x"))
    got = {}
    for r in li.identify_documents(docs).collect():
        got.setdefault(r.doc_id, []).append((r.language, r.accepted))
    assert got[100] == got[101] == [("und", False)] and got[102] == [("und", False)]
    assert got[103] == [("en", True)] and got[104] == [("de", True)] * 2 and got[None] == [("en", True)]
    kept = li.drop_rejected(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert li.identify_documents(docs.limit(0)).count() == 0
    assert {r.accepted for r in li.identify_documents(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {False}


def test_rare_labels_have_a_class(spark, monkeypatch):
    """More rows than the sample holds: three of French among 1,500 are still known."""
    monkeypatch.setattr(li, "SAMPLE_ROWS", 60)
    rnd = random.Random(6)
    truth = {i: "fr" if i % 500 == 7 else "de" if i % 9 == 0 else "en" for i in range(1500)}
    rows = [(i, _text(rnd, x, 20), x, "s") for i, x in truth.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: (r.language, r.accepted) for r in li.identify_documents(docs).collect()}
    assert found == {i: (x, True) for i, x in truth.items()}
    assert li.fit(docs.withColumn("doc_id", F.lit(None).cast("long")), "text", "lang", "doc_id")[0] == ["de", "en", "fr"]


def test_quotas():
    assert li.quotas({"a": 1, "b": 5000, "c": 9000}) == {"a": 1, "b": 1999, "c": 2000}
    assert li.quotas({"a": 7, "b": 9}) == {"a": 7, "b": 9}
