"""WARC archives: written and read as files, indexed by an external merge of sorted runs.

Records are built as strings in the JVM and written by Spark's text writer, whose line
separator is the empty line that ends a WARC record. A capture whose payload an earlier
one already holds becomes a ``revisit`` record without payload. Reading gives back one row per record.

Every archive file's captures, sorted by URL key and time, are one run of the index. The runs are dealt
out by ranges of (URL key, time, id), so one address with very many captures is split
over ranges, and in each range a loser tree merges the pieces of the runs. The ranges in order
are the capture history of every address.
"""

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barfold.llm.common import map_rows, stored
from barfold.session import shared_dir

#: Records of an archive file.
RECORDS_PER_FILE = 1_000
#: Payloads of fewer bytes are always written in full.
MIN_PAYLOAD = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "run string, url_key string, captured_at string, url string, page_id bigint, record_type string, "
    "payload_digest string, payload_bytes bigint, refers_to bigint, offset bigint, length bigint, intact boolean"
)
CRLF = "\r\n"


def base32_sha1(text: Column) -> Column:
    """Upper-case base 32 of the SHA-1 of a string's UTF-8 bytes, in built-in functions."""
    digits = F.array(*(
        F.lpad(F.conv(F.substring(F.sha1(text), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ))
    return F.translate(F.array_join(digits, ""), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(
    pages: DataFrame, captured_at: Column, path: str | None = None, min_payload: int = MIN_PAYLOAD,
    records_per_file: int = RECORDS_PER_FILE,
) -> str:
    """Write a record per row of ``pages(page_id, url, html)`` and return the folder.

    Of equal payloads of ``min_payload`` bytes or more the one with the smallest page id is
    written as ``response``, the others as ``revisit``. A null html is an empty payload, a null
    or broken address is left out of the record; rows with a null id are always responses.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/llm/warc-{uuid.uuid4().hex}"
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
        F.date_format(captured_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
    ).withColumns({"digest": base32_sha1(F.col("html")), "bytes": F.octet_length("html")})
    known = rows.select("page_id", "digest", "bytes").where(F.col("page_id").isNotNull() & (F.col("bytes") >= min_payload))
    first = known.groupBy("digest").agg(F.min("page_id").alias("first"))
    again = known.join(first, "digest").where(F.col("page_id") > F.col("first")).select("page_id", "digest", "first").distinct()
    rows = rows.join(again, ["page_id", "digest"], "left")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    revisit = F.col("first").isNotNull()
    bare = F.regexp_replace("url", r"\s", "")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(CRLF + CRLF),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Target-URI", F.when(bare != "", bare)),
        line("WARC-Date", F.col("at")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("first")))),
        line("WARC-Profile", F.when(revisit, PROFILE)),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file
    ).text(path)
    return path


def _record_id(page_id: Column) -> Column:
    return F.when(page_id.isNotNull(), F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))).otherwise("<urn:page:>")


def records(packed: Iterable[bytes]) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of every record of a compressed archive, one at a time."""
    unpack, have, offset = zlib.decompressobj(wbits=47), bytearray(), 0
    source = iter(packed)

    def fill(size: int) -> bool:
        nonlocal unpack
        while len(have) < size:
            raw = next(source, None)
            if raw is None:
                return False
            have.extend(unpack.decompress(raw))
            while unpack.eof and unpack.unused_data:
                rest, unpack = unpack.unused_data, zlib.decompressobj(wbits=47)
                have.extend(unpack.decompress(rest))
        return True

    while fill(1):
        while (end := have.find(b"\r\n\r\n")) < 0:
            if not fill(len(have) + 1):
                raise ValueError("a record's header is cut off")
        head = have[:end].decode("utf-8").split(CRLF)
        headers = {k.lower(): v.strip() for k, _, v in (h.partition(":") for h in head[1:])}
        size = int(headers["content-length"])
        length = end + 4 + size + 4
        if not fill(length) or have[length - 4 : length] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield offset, length, headers, bytes(have[end + 4 : end + 4 + size])
        del have[:length]
        offset += length


def url_key(url: str | None) -> str:
    """Host labels from last to first, then path and query, in lower case; scheme, port and fragment go."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname or ""
    except ValueError:
        return (url or "").lower()
    labels = [x for x in host.split(".") if x]
    if labels and labels[0] == "www":
        labels = labels[1:]
    query = f"?{parts.query}" if parts.query else ""
    return (",".join(reversed(labels)) + ")" + (parts.path or "/") + query).lower()


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``, columns ``INDEX``; each file's rows are one sorted run.

    ``intact`` says whether a response's payload has the length and digest its headers state.
    """
    def run_of(path: str, content: bytes) -> Iterator[tuple]:
        found = []
        for offset, length, headers, block in records(content[i : i + (1 << 16)] for i in range(0, len(content), 1 << 16)):
            http, _, payload = block.partition(b"\r\n\r\n")
            stated = int(re.search(rb"content-length: *(\d+)", http, re.IGNORECASE)[1])
            digest = headers["warc-payload-digest"].partition(":")[2]
            full = headers["warc-type"] == "response"
            intact = not full or (
                len(payload) == stated and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
            )
            url = headers.get("warc-target-uri")
            found.append((
                path, url_key(url), headers.get("warc-date") or "", url, _page(headers.get("warc-record-id")),
                headers["warc-type"], digest, stated, _page(headers.get("warc-refers-to")), offset, length, intact,
            ))
        return iter(sorted(found, key=_order))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return map_rows(files, run_of, INDEX)


def _page(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def _order(row: tuple) -> tuple:
    """URL key, time, id (none first), then file and place."""
    return row[1], row[2], row[4] is not None, row[4] or 0, row[0], row[9]


class LoserTree:
    """Merges sorted sequences: each inner node remembers the loser of its match, the root's winner comes out."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, k = runs, len(runs)
        self.heads = [self._next(i) for i in range(k)]
        self.losers = [-1] * max(k, 1)
        for i in range(k):
            self._play(i, building=True)

    def _next(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (_order(row), row)

    def _before(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return a is not None
        return (a[0], i) < (b[0], j)

    def _play(self, winner: int, building: bool = False) -> None:
        """Send a run's head up from its leaf; the slot 0 holds the overall winner."""
        node = (winner + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = winner
                return
            if other >= 0 and self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (head := self.heads[top := self.losers[0]]) is not None:
            yield head[1]
            self.heads[top] = self._next(top)
            self._play(top)


def merge_runs(index: DataFrame) -> DataFrame:
    """``index`` in one global order of (url_key, captured_at, page_id), over ranges of it.

    A task holds the index rows (no payloads) of its own range.
    """
    schema = index.schema
    at = [schema.names.index(c) for c in INDEX.replace(",", "").split()[::2]]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        arrow = None
        for batch in batches:
            arrow = batch.schema
            for row in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                runs.setdefault(row[0], []).append(row)
        if arrow is None:
            return
        pieces = [iter(sorted(rows, key=_order)) for rows in runs.values()]
        out: list[tuple] = []
        for row in LoserTree(pieces):
            out.append(row)
            if len(out) == 4096:
                yield _to_batch(out, arrow)
                out = []
        if out:
            yield _to_batch(out, arrow)

    kept = stored(index, "runs").select(*INDEX.replace(",", "").split()[::2])
    return kept.repartitionByRange("url_key", "captured_at", "page_id", "run", "offset").mapInArrow(merge, INDEX)


def _to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=arrow.names
    )


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, html`` of all response records under ``path``."""
    def read(content: bytes) -> Iterator[tuple]:
        for _, _, headers, block in records(content[i : i + (1 << 16)] for i in range(0, len(content), 1 << 16)):
            if headers["warc-type"] == "response":
                yield _page(headers.get("warc-record-id")), headers.get("warc-target-uri"), block.partition(b"\r\n\r\n")[2].decode()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return map_rows(files, read, "page_id bigint, url string, html string", rows=64)


def capture_histories(pages: DataFrame, captured_at: Column, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write archives, read them back, and return the merged index (columns ``INDEX``).

    One row per row of ``pages``, repeats included; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = write_archives(pages, captured_at, min_payload=min_payload)
    return merge_runs(index_runs(spark, path))
