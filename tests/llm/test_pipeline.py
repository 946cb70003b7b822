import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from barfold.llm import byte_bpe
from tests.llm.test_decontaminate import _edits
from tests.llm.test_language_id import SYLLABLES, _text
from tests.llm.test_line_dedup import _brute as brute_lines
from tests.llm.test_simhash_pivots import _brute as brute_groups
from tests.llm.test_simhash_pivots import _print


def _tiktoken():
    ranks = byte_bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rnd = random.Random(6)
    item = _text(rnd, "en", 20)
    docs = []
    for i in range(120):
        lang = list(SYLLABLES)[i % 3]
        docs.append((i, "\n".join(_text(rnd, lang, 12) for _ in range(6)), lang, f"src{i % 4}"))
    docs += [(200, docs[3][1], "en", "src0"), (201, docs[4][1] + "\nmore", "fr", "src0"), (202, "漢字" * 900, None, "src1"),
             (203, docs[0][1][:20] + "\n" + item, "en", "src1"), (204, None, "en", "src1"), (205, "", None, None)]
    path = str(tmp_path_factory.mktemp("spark-pipeline"))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    frame.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("fp", F.lit(0)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, item


def test_stages_against_brute_force(spark, folder):
    path, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, texts = docs.columns, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            docs.write.mode("overwrite").parquet(f"{path}/stage{n}")
            docs = spark.read.parquet(f"{path}/stage{n}")
            texts.append({r.doc_id: r.text for r in docs.collect()})
    after_language, after_lines, after_copies, after_benchmark = texts
    assert set(after_language) == {*range(120), 200, 201, 203}
    want = brute_lines([(k, v) for k, v in after_language.items()])
    assert after_lines == {k: v for k, v in want.items() if v.strip(" \n")}
    groups = brute_groups({k: _print(v) for k, v in after_lines.items()})
    assert after_copies == {k: v for k, v in after_lines.items() if groups[k] == k}
    bound = int(0.2 * len(item.split()))
    assert set(after_benchmark) == {k for k, v in after_copies.items() if _edits(item.split(), v.lower().split()) > bound}
    assert 203 not in after_benchmark
    codec = _tiktoken()
    assert {r.doc_id: r.n_tokens for r in docs.collect()} == {k: len(codec.encode_ordinary(v)) for k, v in after_benchmark.items()}


def test_run_gives_the_last_stage(spark, folder):
    path, _ = folder
    assert corpus_pipeline.run(spark, path).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
