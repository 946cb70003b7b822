import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from barfold.llm import byte_bpe
from barfold.llm.queries import bpe_digests

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
UNITS = ["a", "b", "the", "  ", "\n", " ", "'s", "'re", "é", "ß", "²", "½", "\x1c", "\x85", "\xa0", "1", "23", "!", "\t", "aaaa", "---"]
WIDE = [*UNITS, "日本", "🙂", "٣", " "]


@pytest.fixture(scope="module")
def codecs():
    own = byte_bpe.ByteBpe(byte_bpe.load(PATH, PATTERN).ranks, PATTERN)
    return own, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@pytest.mark.parametrize("sizes", [(20, 3, 12), (16_384, 6, 64)])
def test_same_as_the_tokenizer_library(codecs, monkeypatch, sizes):
    own, library = codecs
    for name, value in zip(("LEAF_CHARS", "LEAF_BYTES", "SHORT_BYTES"), sizes, strict=True):
        monkeypatch.setattr(byte_bpe, name, value)
    for memo in (own._pieces, own._merged, own._stable):
        memo.clear()
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(rnd.choice((UNITS, WIDE))) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rnd.choice("abcdeéx") for _ in range(3000)) for _ in range(20)]
    texts += ["a" * 5000, "ab" * 3000, " " * 2000 + "x", "é" * 3000, "<|endoftext|>", "x" * 20 + " " * 40000 + "y'r" + "e" * 30]
    for text in texts:
        ids = own.encode(text)
        assert list(ids) == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_join_is_associative(codecs):
    own, _ = codecs
    rnd = random.Random(9)
    for _ in range(300):
        a, b, c = ("".join(rnd.choice("abthe é") for _ in range(rnd.randint(1, 30))).encode() for _ in range(3))
        x, y, z = own.piece(a), own.piece(b), own.piece(c)
        assert own.join(own.join(x, y), z) == own.join(x, own.join(y, z)) == own.piece(a + b + c)


def test_rows_of_every_kind(spark, codecs):
    own, library = codecs
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "x"), (4, "wörd " * 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    back = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded).decode()) for r in back) == sorted(
        (k or 0, len(library.encode_ordinary(t or "")), t or "") for k, t in rows)
    assert byte_bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0


def test_round_trip_takes_one_pass(spark, codecs):
    own, library = codecs
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "x"), (4, "wörd " * 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    back = byte_bpe.round_trip(docs, PATH, PATTERN)
    assert sorted(map(str, back.collect())) == sorted(map(str, byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()))
    assert sorted((r.doc_id or 0, bytes(r.ids), bytes(r.decoded).decode()) for r in back.collect()) == sorted(
        (k or 0, b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(t or "")), t or "") for k, t in rows)
    # Chained maps would have a Python worker each, at the same time, with a vocabulary and memos of its own.
    assert bpe_digests(docs)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_memos_stay_bounded(codecs):
    _, library = codecs
    own = byte_bpe.ByteBpe(codecs[0].ranks, PATTERN)
    rnd = random.Random(3)
    held = 0
    for _ in range(100):
        text = "".join(" " + "".join(rnd.choices("abdeghiklmnoprstuvwyz", k=8)) for _ in range(1_800))
        assert list(own.encode(text)) == library.encode_ordinary(text)
        held = max(held, len(own._pieces), len(own._merged), len(own._stable))
    assert 100_000 < held <= 150_000
