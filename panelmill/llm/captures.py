"""WARC archives of pages, and their capture index merged into global order."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.llm.common import stored, table
from panelmill.llm.registry import query
from panelmill.session import work_folder

REVISIT_BYTES = 1000
RECORDS = 4000  # after which an archive is closed
EPOCH = 1_704_067_200  # the pages carry no time: page n was captured n seconds after 2024-01-01
END = "\r\n\r\n"


def classified(pages: DataFrame) -> DataFrame:
    """`page_id, url, payload` with payload_bytes, payload_digest, record_type, refers_to.

    Payloads are told apart by SHA-1 and length. The holder of a payload is found by partial
    aggregation, and the join on the digest can be split where a third of the pages are copies.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    seen = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
                        F.sha1(payload).alias("payload_digest"))
    holders = seen.where(f"payload_bytes >= {REVISIT_BYTES}").groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("holder"))
    revisit = F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id"))
    return (seen.join(holders, ["payload_digest", "payload_bytes"], "left")
            .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(revisit, F.col("holder"))).drop("holder"))


def _records(seen: DataFrame) -> DataFrame:
    """One WARC 1.1 record per row as text, without the two line ends that close it."""
    def urn(number):
        return F.concat(F.lit("<urn:x-page:"), F.coalesce(number.cast("string"), F.lit("none")), F.lit(">"))
    time = F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0)))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.regexp_replace(F.coalesce("url", F.lit("urn:x-page:unknown")), r"[\x00-\x20\x7f]", "%20")
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return seen.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, records: int = RECORDS) -> str:
    """Write WARC files to the shared folder; the path of their folder.

    Spark's text writer puts the record end between records, so any file system that Spark
    writes to will do. Each file is gzipped as a whole.
    """
    path = work_folder(pages.sparkSession, "archives")
    _records(classified(pages)).write.option("lineSep", END).option("maxRecordsPerFile", records).text(
        path, compression="gzip")
    return path


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Headers, block and offset of every record; lengths, never separators, delimit the blocks."""
    at, view = 0, memoryview(data)
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = bytes(view[at:stop]).decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        begin = stop + 4
        end = begin + int(headers["content-length"])
        yield headers, bytes(view[begin:end]), at
        at = end + 4


def url_key(url: str) -> str:
    """The URL for sorting: host labels reversed, no scheme, port 80/443, `www.` or fragment, lower case."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    labels = ",".join(reversed(host.split("."))) + port
    return f"{labels}){parts.path.lower() or '/'}" + (f"?{parts.query.lower()}" if parts.query else "")


INDEX = ("urlkey string, captured long, page_id long, payload_bytes long, payload_digest string, record_type string, "
         "refers_to long, archive string, offset long, ordinal long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted capture run of each archive."""
    import calendar
    import time

    names = [c.split()[0] for c in INDEX.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in INDEX.split(", ")]
    for batch in batches:
        for archive, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            run = []
            for headers, block, offset in parse_archive(gzip.decompress(data)):
                head, _, payload = block.partition(b"\r\n\r\n")
                kind = headers["warc-type"]
                own = re.search(r":(\d+|-\d+|none)>", headers["warc-record-id"])[1]
                stated = headers["warc-payload-digest"].removeprefix("sha1:")
                length = int(re.search(rb"Content-Length: (\d+)", head)[1])
                if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != stated):
                    raise ValueError(f"damaged record at byte {offset} of {archive}")
                other = headers.get("warc-refers-to")
                run.append((url_key(headers["warc-target-uri"]),
                            calendar.timegm(time.strptime(headers["warc-date"], "%Y-%m-%dT%H:%M:%SZ")),
                            None if own == "none" else int(own), length, stated, kind,
                            int(re.search(r":(-?\d+)>", other)[1]) if other else None, archive.rsplit("/", 1)[-1], offset))
            run.sort(key=_capture)
            columns = list(zip(*((*r, i) for i, r in enumerate(run)))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _capture(row: Sequence) -> tuple:
    """Order of captures: URL key, time, page (none first), place."""
    return (row[0].encode(), row[1], -2**63 if row[2] is None else row[2], row[7], row[8])


class LoserTree:
    """Merges k sorted sequences; each row costs one match per level, against the loser stored there."""

    def __init__(self, runs: Sequence[Sequence], key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))] or [None]
        self.losers = [-1] * self.k
        self.winner = -1
        for i in range(self.k):
            self._play(i)

    def _next(self, i):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        """An empty place (while building) beats all, an exhausted run none."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _play(self, i: int) -> None:
        at = (i + self.k) // 2
        while at > 0:
            if self._beats(self.losers[at], i):
                i, self.losers[at] = self.losers[at], i
            if i < 0:
                return
            at //= 2
        self.winner = i

    def __iter__(self):
        while self.winner >= 0 and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][2]
            self.heads[i] = self._next(i)
            self._play(i)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices that a range has of the runs, merged; rows arrive by run, in its order."""
    from pyspark import TaskContext

    number, runs, schema, last = TaskContext.get().partitionId(), [], None, None
    for batch in batches:
        schema = batch.schema
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[7] != last:
                last = row[7]
                runs.append([])
            runs[-1].append(row)
    if schema is None:
        return
    rows, at = [], 0
    for row in LoserTree(runs, _capture):
        rows.append((*row, number, at))
        at += 1
        if len(rows) == 10_000:
            yield _batch(rows, schema)
            rows = []
    if rows:
        yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    kinds = [*schema.types, pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*schema.names, "range", "place"])


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under a path in global order, `capture_seq` counting from 0.

    Every archive gives a run sorted by URL key and time. Ranges of (key, time, page) take a
    slice of every run, so that a URL captured very often spreads over ranges, and a loser
    tree merges the slices; ranges are in order among themselves.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = stored(files.mapInArrow(_runs, INDEX), "capture-runs")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartitionByRange(parts, "urlkey", "captured", "page_id").sortWithinPartitions("archive", "ordinal")
    merged = stored(dealt.mapInArrow(_merged, INDEX + ", range int, place long"), "captures")
    sizes = merged.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return merged.join(sizes, "range").withColumn("capture_seq", F.col("before") + F.col("place")).drop(
        "range", "place", "before", "ordinal")


@query("op3_capture_index", f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, payload_bytes, max(page_id) AS holder FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY 1, 2)
SELECT page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM p LEFT JOIN h ON h.payload_digest = p.payload_digest AND h.payload_bytes = p.payload_bytes
""")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Per page what its archive holds: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; a null url or page_id gets a stand-in name in the record,
    the latter comes back as null. Rows with equal page_id are records of their own.
    """
    path = write_archives(table(spark, sf, "pages"))
    return capture_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
