import base64
import hashlib
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from barfold.llm import warc

def AT():
    return F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.col("page_id"), F.lit(0)))


def _want(rows, least=0):
    first: dict[bytes, int] = {}
    for key, _, html in rows:
        raw = (html or "").encode()
        if key is not None and len(raw) >= least:
            first[raw] = min(first.get(raw, key), key)
    out = []
    for key, _, html in rows:
        raw = (html or "").encode()
        again = key is not None and first.get(raw, key) != key
        out.append((key, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if again else "response", first[raw] if again else None))
    return sorted(out, key=str)


def test_loser_tree_merges_any_number_of_runs():
    rnd = random.Random(1)
    for k in range(0, 12):
        runs = [sorted(((f"r{i}", rnd.choice("abc"), "t", None, rnd.randrange(9), *[None] * 4, j) for j in range(rnd.randint(0, 9))),
                       key=warc._order) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted((x for r in runs for x in r), key=warc._order)


def test_round_trip_of_rows_of_every_kind(spark):
    evil = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nContent-Length: 5\r\n\r\nx\n"
    rows = [(5, "http://a.org/x", evil), (3, "http://a.org/y", evil), (4, None, None), (7, "http://b.org", ""), (8, "http://a.org/x", "é🙂"),
            (8, "http://a.org/x", "é🙂"), (None, "ht tp://\r\nbad[", "é🙂"), (9, "http://c.org", "w " * 400000), (10, "http://a.org/x", "é🙂")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.capture_histories(df, AT()).collect()
    assert all(r.intact for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == _want(rows)
    assert [warc._order(tuple(r)) for r in got] == sorted(warc._order(tuple(r)) for r in got)
    assert warc.capture_histories(df.limit(0), AT()).count() == 0
    small = {r.page_id: r.record_type for r in warc.capture_histories(df, AT(), min_payload=5).where("page_id is not null").collect()}
    assert small[4] == small[7] == "response" and small[5] == small[10] == "revisit"


def test_given_pages_round_trip_over_many_files(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    rows = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(path).to_pylist()]
    folder = warc.write_archives(spark.read.parquet(path), AT(), records_per_file=20)
    index = warc.index_runs(spark, folder)
    assert index.select("run").distinct().count() > 2
    got = warc.merge_runs(index).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == _want(rows)
    kept = {r.page_id: r.html for r in warc.payloads(spark, folder).collect()}
    assert kept == {r.page_id: next(h for k, _, h in rows if k == r.page_id) for r in got if r.record_type == "response"}
