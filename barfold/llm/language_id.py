"""Language identification by Bayesian fusion of text, markup, address and host evidence.

* Text: a naive Bayes model over hashed byte trigrams. All labels of the table are its classes (256 KB each);
  it is fitted on a bounded sample of their rows, drawn per label. Its log likelihoods are tempered, since trigrams overlap. One more class, ``und``,
  spreads evenly over all trigrams and takes texts that look like no known language.
* Declared language and address suffix: how often each value goes with each language,
  counted over all rows by the text's own verdict and smoothed.
* Host: the share of each language among a host's rows, smoothed towards the share in the
  host's domain, which is smoothed towards the share of all rows. All counts are grouped
  aggregations; only their small results are joined to the rows.
"""

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barfold.llm.common import map_rows, stored

#: Labelled rows that the text model is fitted on, about; of every label one at least.
SAMPLE_ROWS = 4_000
#: Hashed trigrams.
BUCKETS = 1 << 16
#: Weight of a trigram's log likelihood.
TEMPER = 0.3
#: Pseudo-counts: of a trigram, of a declared or suffix value, of a parent's share.
TRIGRAM_PRIOR, VALUE_PRIOR, PARENT_PRIOR = 0.05, 1.0, 20.0
#: Share of texts expected to be in no known language.
UNKNOWN_SHARE = 0.01
#: Least posterior with which a row is accepted.
ACCEPT = 0.5
#: Hosts or values (about 100 bytes each) up to which their shares are broadcast; beyond, they are joined by a shuffle.
BROADCAST_VALUES = 200_000
UNKNOWN = "und"
_CHUNK = 1 << 20


def trigrams(text: str | None) -> "np.ndarray":
    """Hashed byte trigrams of the lower-cased text, white space runs as one blank."""
    raw = np.frombuffer(" ".join((text or "").lower().split()).encode("utf-8"), dtype=np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, dtype=np.int64)
    mixed = raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA77) ^ raw[2:] * np.uint32(0xC2B2AE3D)
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)


def quotas(counts: dict[str, int]) -> dict[str, int]:
    """Rows to draw of each label: ``SAMPLE_ROWS`` in equal parts; what a rare label can't fill goes to the others."""
    out, left = {}, SAMPLE_ROWS
    for place, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[label] = min(n, max(1, left // (len(counts) - place)))
        left = max(0, left - out[label])
    return out


def fit(rows: DataFrame, text_col: str, label_col: str, id_col: str) -> tuple[list[str], np.ndarray]:
    """Languages and the (buckets, languages + 1) log likelihoods; the last column is ``und``."""
    labelled = rows.where((F.col(label_col) != "") & (F.length(text_col) > 2)).select(
        F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.xxhash64(id_col, text_col).alias("h")
    ).withColumn("draw", F.shiftrightunsigned("h", 33))
    seen = labelled.groupBy("label").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()
    if not seen:
        return [], np.zeros((BUCKETS, 1), dtype=np.float32)
    quota = quotas({r.label: r.n for r in seen})
    # The row of least draw is always among them, so that each label has a class.
    limits = {r.label: max(quota[r.label] * (1 << 31) // r.n, r.least) for r in seen}
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    # A row repeated under its id is drawn once.
    sample = labelled.where(F.col("draw") <= limit[F.col("label")]).dropDuplicates(["label", "h"]).select("text", "label")

    def count(text, label):
        bucket, n = np.unique(trigrams(text), return_counts=True)
        return zip([label] * len(n), bucket.tolist(), n.tolist(), strict=True)

    counted = map_rows(sample, count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    languages = sorted(found["label"].unique().tolist())
    table = np.zeros((BUCKETS, len(languages) + 1))
    for i, language in enumerate(languages):
        own = found[found["label"] == language]
        table[own["bucket"].to_numpy(), i] = own["n"].to_numpy()
    table[:, :-1] += TRIGRAM_PRIOR
    table[:, -1] = 1.0
    return languages, np.log(table / table.sum(axis=0)).astype(np.float32)


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))


def identify(
    rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
    declared: Column | None = None, host: Column | None = None, suffix: Column | None = None,
) -> DataFrame:
    """``doc_id, text_language, language, posterior, accepted`` per row.

    ``label_col`` holds the labels that the text model is fitted on; ``declared``, ``host`` and
    ``suffix`` are columns of evidence (null: none). ``language`` has the largest
    posterior, ties go to the first in alphabetic order; ``accepted`` is whether it is a known
    language with a posterior of ``ACCEPT`` or more. Null and empty texts give no text
    evidence and are not accepted (language ``und``, posterior 1). Repeated rows stay, rows
    with a null id are judged like others, an empty table gives no rows; without any labelled row
    nothing is accepted.
    """
    none = F.lit(None).cast("string")
    host = (none if host is None else host).cast("string")
    languages, model = fit(rows, text_col, label_col, id_col)
    if not languages:
        return rows.select(
            F.col(id_col).alias("doc_id"), F.lit(UNKNOWN).alias("text_language"), F.lit(UNKNOWN).alias("language"),
            F.lit(1.0).alias("posterior"), F.lit(False).alias("accepted"),
        )
    classes = [*languages, UNKNOWN]

    def judge(key, text, *evidence):
        found = trigrams(text)
        score = np.zeros(len(classes))
        for start in range(0, len(found), _CHUNK):
            score += model[found[start : start + _CHUNK]].sum(axis=0, dtype=np.float64)
        return [(key, len(found) > 0, (TEMPER * score).tolist(), *evidence)]

    kind = rows.schema[id_col].dataType.simpleString()
    given = rows.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        (none if declared is None else declared.cast("string")).alias("declared"),
        host.alias("host"), (suffix_of(host) if suffix is None else suffix.cast("string")).alias("suffix"),
    )
    judged = stored(map_rows(
        given, judge, f"doc_id {kind}, has_text boolean, score array<double>, declared string, host string, suffix string"
    ), "judged")
    names = F.array(*map(F.lit, classes))
    place = F.array_position("score", F.array_max("score")).cast("int")
    judged = judged.withColumns({"domain": domain_of(F.col("host")), "verdict": place - 1})

    shares = _with_shares(judged, languages)
    total = reduce(lambda a, b: a + b, [F.exp(F.col("log_p")[i] - F.array_max("log_p")) for i in range(len(classes))])
    best = F.array_position("log_p", F.array_max("log_p")).cast("int")
    out = shares.select(
        "doc_id", "has_text", F.element_at(names, place).alias("text_language"),
        F.element_at(names, best).alias("language"), (1.0 / total).alias("posterior"),
    )
    known = F.col("has_text")
    return out.select(
        "doc_id",
        F.when(known, F.col("text_language")).otherwise(UNKNOWN).alias("text_language"),
        F.when(known, F.col("language")).otherwise(UNKNOWN).alias("language"),
        F.when(known, F.col("posterior")).otherwise(1.0).alias("posterior"),
        (known & (F.col("language") != UNKNOWN) & (F.col("posterior") >= ACCEPT)).alias("accepted"),
    )


def _with_shares(judged: DataFrame, languages: list[str]) -> DataFrame:
    """Rows with ``log_p``: log likelihoods of all evidence and the host's prior, per class."""
    n, voting = len(languages), judged.where("has_text").where(F.col("verdict") < len(languages))
    counts = [F.count(F.when(F.col("verdict") == i, True)).cast("double").alias(f"n{i}") for i in range(n)]
    everyone = voting.agg(*counts).first()
    share = [(seen + 1.0) / (sum(everyone) + n) for seen in everyone]

    def array_of(make) -> Column:
        return F.array(*(make(i) for i in range(n)))

    def sum_of() -> Column:
        return reduce(lambda a, b: a + b, [F.col(f"n{i}") for i in range(n)])

    domains = voting.where("domain is not null").groupBy("domain").agg(*counts)
    domains = domains.select("domain", array_of(
        lambda i: (F.col(f"n{i}") + PARENT_PRIOR * share[i]) / (sum_of() + PARENT_PRIOR)).alias("of_domain"))
    hosts = voting.where("host is not null").groupBy("host").agg(F.min("domain").alias("domain"), *counts)
    hosts = hosts.join(domains, "domain", "left").select("host", array_of(
        lambda i: (F.col(f"n{i}") + PARENT_PRIOR * F.col("of_domain")[i]) / (sum_of() + PARENT_PRIOR)).alias("of_host"))
    out = judged.join(_small(domains, "domains"), "domain", "left").join(_small(hosts, "hosts"), "host", "left")
    for value in ("declared", "suffix"):
        seen = voting.where(F.col(value).isNotNull()).groupBy(value).agg(*counts)
        kinds = seen.agg(F.count("*").alias("k"), *(F.sum(f"n{i}").alias(f"n{i}") for i in range(n))).first()
        # A language's share of this value; for the unknown language all values are alike.
        table = seen.select(value, array_of(
            lambda i, k=kinds: F.log((F.col(f"n{i}") + VALUE_PRIOR) / ((k[f"n{i}"] or 0.0) + VALUE_PRIOR * (k["k"] + 1)))
        ).alias(f"of_{value}"))
        table = table.withColumn(f"of_{value}", F.concat(f"of_{value}", F.array(F.lit(-float(np.log(kinds["k"] + 1))))))
        out = out.join(_small(table, value), value, "left")
    prior = F.coalesce("of_host", "of_domain", F.array(*map(F.lit, share)))
    logs = F.concat(
        F.transform(prior, lambda p: F.log(p * (1 - UNKNOWN_SHARE))), F.array(F.lit(float(np.log(UNKNOWN_SHARE))))
    )
    for more in ("score", "of_declared", "of_suffix"):
        logs = F.zip_with(logs, F.coalesce(more, F.array_repeat(F.lit(0.0), n + 1)), lambda a, b: a + b)
    return out.withColumn("log_p", logs)


def _small(table: DataFrame, name: str) -> DataFrame:
    """The stored table, to be broadcast if its counted size allows it."""
    table = stored(table, name)
    return F.broadcast(table) if table.count() <= BROADCAST_VALUES else table


def drop_rejected(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language isn't accepted; ``lang`` is label and declaration.

    Rows with one id that differ in text, ``lang`` or ``source`` are judged apart. Rows with a null id stay.
    """
    own = F.xxhash64("text", "lang", "source")
    found = identify_documents(docs.select(F.struct("doc_id", own.alias("_of")).alias("row"), "text", "lang", "source"), "row")
    bad = found.where(~F.col("accepted")).select("doc_id.*").distinct()
    return docs.withColumn("_of", own).join(bad, ["doc_id", "_of"], "left_anti").select(*docs.columns)


def identify_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return identify(docs, id_col, declared=F.col("lang"), host=F.col("source"))
