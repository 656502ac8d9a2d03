"""WARC archives with an external index merge.

Captures are written as gzip members into one archive a task. Each archive's
index, sorted by URL key and timestamp, is a run. Runs are dealt by key range
and merged in each range by a loser tree into globally ordered capture
histories, and the archives are read back through that index.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.session import fresh_path, materialise

INDEX_SCHEMA = "run string, url_key string, ts string, page_id long, digest string, offset long, length long"
CRLF = b"\r\n"
#: Captures that a task merges at most, but for the evenness of the ranges; rows it yields at a time.
RANGE_ROWS, OUT_ROWS = 100_000, 10_000


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then port and path; scheme, user and "www." go, case of the host too."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url or "", re.S)
    host, port, rest = m[1].lower(), m[2] or "", m[3] or "/"
    labels = [x for x in host.split(".") if x]
    labels = labels[1:] if len(labels) > 2 and labels[0] == "www" else labels
    return ",".join(reversed(labels)) + port + ")" + rest


class LoserTree:
    """Merges sorted iterables: each next item costs one replay from leaf to root."""

    def __init__(self, runs: Iterable[Iterable]):
        self._runs = [iter(r) for r in runs]
        self._heads = [next(r, None) for r in self._runs]
        k = self._k = max(1, len(self._runs))
        self._heads += [None] * (k - len(self._heads))
        self._losers = [-1] * k
        winner = [0] * (2 * k)
        winner[k:] = range(k)
        for node in range(k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self._losers[node] = (a, b) if self._first(a, b) else (b, a)
        self._winner = winner[1] if k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; a used-up run comes last, ties go to the lower run."""
        x, y = self._heads[a], self._heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def __iter__(self) -> Iterator:
        while self._runs and (head := self._heads[w := self._winner]) is not None:
            yield head
            self._heads[w] = next(self._runs[w], None)
            node = (w + self._k) // 2
            while node:
                other = self._losers[node]
                if self._first(other, w):
                    self._losers[node], w = w, other
                node //= 2
            self._winner = w


def _record(kind: str, url: str, date: str, page_id: str, payload: bytes, digest: str, refers: str | None) -> bytes:
    """A WARC/1.1 record. Both kinds keep the HTTP head, with the payload's length; only a response keeps the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of an unzipped record."""
    head, _, rest = raw.partition(CRLF * 2)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF * 2)
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _store(folder: str):
    """The file system of a folder and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds payload (UTF-8, null html is empty), digest and refers_to.

    Of equal payloads of at least ``least_bytes`` bytes the smallest page_id
    stays a response (null refers_to), as does a row without a page_id. First ids are found by a partial
    aggregate; only digests that occur again join back, so a payload with a
    third of all pages is one row on that side.
    """
    small = pages.select("page_id", "url", "ts", F.coalesce("html", F.lit("")).alias("html"))
    small = small.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    firsts = small.filter(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    refers = small.select("page_id", "digest").join(firsts, "digest").filter("page_id > first_id").groupBy("page_id", "digest").agg(F.min("first_id").alias("refers_to"))
    return small.join(refers, ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, folder: str, level: int = 6, least_bytes: int = 0) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html, ts) and returns the index (``INDEX_SCHEMA``), itself written.

    One archive a task, named by a fresh id: a task that runs again writes
    another file, and the index holds the files of tasks that counted. Records
    of an archive stand in the order of its index, by URL key, timestamp,
    page_id and digest. Rows without a page_id are kept, under the record id "none" and
    before the others; rows that repeat are a record each; null urls are
    empty. Ids are text on the way, so that those beside nulls stay exact.
    """

    def run(batches):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name, out, at, index = f"{uuid.uuid4().hex}.warc.gz", None, 0, []
        for pdf in batches:
            for page_id, url, ts, key, html, b32, refers in zip(pdf["page_id"], pdf["url"], pdf["ts"], pdf["url_key"], pdf["html"], pdf["b32"], pdf["refers_to"]):
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                kind = "response" if refers is None else "revisit"
                data = _gzip(_record(kind, re.sub(r"[\r\n]", " ", url), ts, page_id or "none", html.encode(), b32, refers), level)
                out.write(data)
                index.append((name, key, ts, page_id and int(page_id), b32, at, len(data)))
                at += len(data)
        if out:
            out.close()
        yield pd.DataFrame(index, columns=["run", "url_key", "ts", "page_id", "digest", "offset", "length"]).astype({"page_id": "Int64"})

    marked = mark_revisits(pages, least_bytes).withColumn("url", F.coalesce("url", F.lit(""))).withColumn("url_key", _key_column()("url")).withColumn("b32", _base32()("digest")).sortWithinPartitions("url_key", "ts", "page_id", "b32")
    marked = marked.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return materialise(marked.mapInPandas(run, INDEX_SCHEMA), "warc-index")


def _key_column():
    @F.pandas_udf("string")
    def keys(urls: pd.Series) -> pd.Series:
        return urls.map(url_key)

    return keys


def _base32():
    @F.pandas_udf("string")
    def coded(digests: pd.Series) -> pd.Series:
        return digests.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode())

    return coded


def merge_indexes(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """Capture histories: the runs of the index merged by URL key, timestamp, page_id and digest.

    Ranges of the key, as many as keep each near ``RANGE_ROWS`` captures, are
    dealt to tasks; in a task the slices of the runs, each sorted, go through a
    loser tree. Ranges split inside a URL too, so a host with a third of all
    captures spreads over tasks. Adds ``range`` and ``place``: the place, from
    1, in the order of all captures, which is what the merges of the ranges
    before and of its own give. A written table.
    """
    keys = ["url_key", "ts", "page_id", "digest", "run", "offset"]
    least = -(-index.count() // RANGE_ROWS)
    partitions = partitions or max(least, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = index.repartitionByRange(partitions, *keys).withColumn("range", F.spark_partition_id()).sortWithinPartitions("run", *keys)
    columns = ["url_key", "ts", "page_id", "digest", "run", "offset", "length", "range"]

    def run(batches):
        runs: dict[str, list] = {}
        for pdf in batches:
            for key, ts, page_id, *rest in zip(*(pdf[c] for c in columns)):
                runs.setdefault(rest[0], []).append((key, ts, (page_id is not None, int(page_id or 0)), *rest))  # no id comes first
        merged, place = iter(LoserTree(runs.values())), 1
        while part := list(islice(merged, OUT_ROWS)):
            out = pd.DataFrame(part, columns=columns).assign(place=range(place, place + len(part)))
            yield out.assign(page_id=pd.array([i if there else None for there, i in out["page_id"]], "Int64"))
            place += len(part)

    schema = "url_key string, ts string, page_id long, digest string, run string, offset long, length long, range int, place long"
    merged = materialise(dealt.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(run, schema), "warc-merged")
    counts = merged.groupBy("range").agg(F.count("*").alias("n"))  # a row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return merged.join(counts.select("range", before.alias("before")), "range").withColumn("place", F.col("place") + F.col("before")).drop("before")


def read_archives(histories: DataFrame, folder: str) -> DataFrame:
    """Reads each record of the histories, in the order in which it lies in its archive: its place in them, its headers, and the payload if it has one."""

    def run(batches):
        store, root = _store(folder)
        for pdf in batches:
            rows = []
            for name, part in pdf.sort_values(["run", "offset"]).groupby("run", sort=False):
                with store.open_input_file(f"{root}/{name}") as f:
                    for offset, length, *at in zip(part["offset"], part["length"], part["range"], part["place"]):
                        f.seek(int(offset))
                        fields, http, payload = parse_record(zlib.decompress(f.read(int(length)), 31))
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"][5:]
                        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                        refers = fields.get("WARC-Refers-To")
                        rows.append((None if (own := fields["WARC-Record-ID"][10:-1]) == "none" else int(own), fields["WARC-Target-URI"], fields["WARC-Date"], kind, int(http["Content-Length"]), digest, refers and int(refers[10:-1]), payload if kind == "response" else None, *at))
            yield pd.DataFrame(rows, columns=["page_id", "url", "ts", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "range", "place"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return histories.mapInPandas(run, "page_id long, url string, ts string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, range int, place long")


def capture_time(page_id="page_id", start: str = "2024-01-01T00:00:00Z"):
    """A capture time for tables that have none: ``start`` plus as many seconds as the id says, within a day."""
    base = int(dt.datetime.fromisoformat(start.replace("Z", "+00:00")).timestamp())
    return F.date_format(F.timestamp_seconds(F.lit(base) + F.coalesce(F.col(page_id), F.lit(0)) % 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages archived and read back, each with its place in the capture histories. Rows that repeat a page_id and its html are each a response or each a revisit."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").withColumn("ts", capture_time())
    folder = fresh_path(spark, "warc")
    index = write_archives(pages, folder)
    records = read_archives(merge_indexes(index), folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("ts").alias("capture_ts"), F.col("place").alias("history_place"))


#: Base32 of a digest: its bits in fives. 20 bytes are 32 characters, without padding. The place in the histories is by URL key, time, id and digest.
OP7_SQL = r"""
WITH hashed AS MATERIALIZED (
  SELECT row_number() OVER () AS row, page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         regexp_extract(coalesce(url, ''), '(?s)^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)', ['host', 'port', 'rest']) AS u,
         strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(coalesce(page_id, 0) % 86400), '%Y-%m-%dT%H:%M:%SZ') AS capture_ts FROM pages),
named AS (
  SELECT row, capture_ts, u, list_filter(string_split(lower(u.host), '.'), lambda x: x <> '') AS labels FROM hashed),
keyed AS (
  SELECT row, capture_ts, array_to_string(list_reverse(CASE WHEN len(labels) > 2 AND labels[1] = 'www' THEN labels[2:] ELSE labels END), ',')
         || u.port || ')' || CASE WHEN u.rest = '' THEN '/' ELSE u.rest END AS url_key FROM named),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM hashed),
nibbles AS (
  SELECT row, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(hex, CAST(i + 1 AS BIGINT), 1)) - 1) AS n FROM firsts),
coded AS (
  SELECT row, array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
      CASE k % 4
        WHEN 0 THEN n[k // 4 * 5 + 1] * 2 + n[k // 4 * 5 + 2] // 8
        WHEN 1 THEN n[k // 4 * 5 + 2] % 8 * 4 + n[k // 4 * 5 + 3] // 4
        WHEN 2 THEN n[k // 4 * 5 + 3] % 4 * 8 + n[k // 4 * 5 + 4] // 2
        ELSE n[k // 4 * 5 + 4] % 2 * 16 + n[k // 4 * 5 + 5] END) AS BIGINT), 1)), '') AS payload_digest
  FROM nibbles)
SELECT f.page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN f.page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.page_id > first_id THEN first_id END AS refers_to, k.capture_ts,
       row_number() OVER (ORDER BY url_key, k.capture_ts, f.page_id NULLS FIRST, payload_digest) AS history_place
FROM firsts f JOIN coded c ON f.row = c.row JOIN keyed k ON f.row = k.row
"""
