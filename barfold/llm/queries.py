"""The registered queries of this package: each applies one operator to its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barfold.llm import (
    byte_bpe, chat_format, decontaminate, hard_negatives, interpolated_lm, language_id, line_dedup, permutation_index,
    simhash_pivots, site_style_tree, toxicity, warc, whitening,
)
from barfold.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Encode, decode, and digest both sides of the round trip."""
    return byte_bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], talks.schema)
    made = chat_format.examples(talks.unionByName(extra)).withColumn("loss", chat_format.trained_text())
    per_talk = made.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    read = per_talk.select(
        "conv_id", "formatted_chars", chat_format.turns_of(F.col("whole")).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op8_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_style_tree.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op9_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score_texts(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages carry no time: they count as captured one second after the other."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)))
    return warc.capture_histories(table(spark, sf_dir, "pages"), at).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is moved on by one, so that labels don't follow from the vectors alone."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_permutation_index": op1_permutation_index,
    "op2_simhash_pivots": op2_simhash_pivots,
    "op3_chat_format": op3_chat_format,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_site_style_tree": op8_site_style_tree,
    "op9_interpolated_lm": op9_interpolated_lm,
    "op10_warc": op10_warc,
    "op11_toxicity": op11_toxicity,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        c AS (SELECT page_id, strlen(html) AS bytes, hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, bytes AS payload_bytes,
            array_to_string(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda b:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * i + 1)::INT, 5))::INT >> b) & 31) + 1, 1)),
                'string_agg', '')), '') AS payload_digest,
            CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id > first THEN first END AS refers_to
        FROM c
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
        ), a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, list_inner_product(a.x, v.x)::BIGINT AS score
            FROM a JOIN v ON v.vec_id <> a.vec_id AND len(v.x) = len(a.x)
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id,
            row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5
    """,
    "op3_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), placed AS (
            SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS all_n,
                sum(22 + length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'))) OVER w
                    AS chars
            FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(chars) FILTER (role = 'assistant' OR n = all_n)::BIGINT AS formatted_chars
        FROM placed GROUP BY conv_id
    """,
    "op6_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, h, i - 1 AS line_no, x[i] AS raw, trim(x[i]) AS line
            FROM (SELECT doc_id, md5(text) AS h, string_split(text, chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS t(i)
        ), firsts AS (
            SELECT line, min({'d': doc_id, 'h': h, 'n': line_no}) AS f FROM lines WHERE line <> '' GROUP BY line
        ), worded AS (
            SELECT line, f, list_filter(string_split(line, ' '), lambda w: w <> '') AS ws
            FROM firsts
        ), gaps AS (
            SELECT line, f, i AS gap, array_to_string(ws[1:i - 1] || ws[i + 1:], ' ') AS k
            FROM worded, unnest(range(1, len(ws) + 1)) AS t(i) WHERE len(ws) >= 5
        ), wholes AS (
            SELECT line, f, array_to_string(ws, ' ') AS k FROM worded WHERE len(ws) >= 5
        ), near AS (
            SELECT line FROM (SELECT line, f, min(f) OVER (PARTITION BY k, gap) AS e FROM gaps) WHERE e < f
            UNION SELECT line FROM (SELECT line, f, min(f) OVER (PARTITION BY k) AS e FROM wholes) WHERE e < f
            UNION SELECT g.line FROM gaps g JOIN wholes w USING (k) WHERE w.f < g.f
            UNION SELECT w.line FROM gaps g JOIN wholes w USING (k) WHERE g.f < w.f
        ), kept AS (
            SELECT l.*, l.line = '' OR ({'d': doc_id, 'h': h, 'n': line_no} = firsts.f AND near.line IS NULL) AS stays
            FROM lines l LEFT JOIN firsts USING (line) LEFT JOIN near USING (line)
        )
        SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (stays), '') AS text,
            count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped
        FROM kept GROUP BY doc_id, h
    """,
}
