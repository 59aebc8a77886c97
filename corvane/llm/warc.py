"""WARC archives with a globally ordered capture index.

Writing: every task appends gzip members, one a record, to archive files in the shared folder and
returns its capture entries as a locally sorted run. Records whose payload was captured elsewhere
become revisit records, which carry no payload.
Indexing: entries are dealt by ranges of (URL key, timestamp, page), so each task owns a stretch of
the global order however hot a host is, and merges the runs in its stretch with a loser tree. The
number of stretches grows with the entries, so a stretch holds about STRETCH of them at any size.
Reading: every archive is read once from front to back, at the offsets of the merged index; `place`
is an entry's position in the global order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import materialise, new_path

EPOCH = 1_700_000_000  # capture time of page 0; page n is captured n seconds later, if no time column is given
FIRST, LAST = -62_135_596_800, 253_402_300_799  # seconds that a WARC-Date can show: years 1 to 9999; times beyond are held there
ARCHIVE_BYTES = 256 << 20
STRETCH = 200_000  # entries that one task merges, about


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query, in lower case; '' for a missing URL."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host = parts.hostname or ""
    except ValueError:
        return (url or "").lower()
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (parts.path.rstrip("/") or "/") + (f"?{parts.query}" if parts.query else "") if host else (url or "").lower()


def record_id(page: int | None) -> str:
    """The id that names a page, or a random one for a record without a page."""
    return f"<urn:uuid:{uuid.uuid4() if page is None else uuid.UUID(int=(0xC0 << 120) | (page & (2**64 - 1)))}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if n >> 64 != 0xC0 << 56:
        return None
    n &= 2**64 - 1
    return n - 2**64 if n >= 2**63 else n


def _stamp(seconds: int) -> str:
    import datetime as dt

    return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=max(FIRST, min(LAST, seconds)))).strftime("%Y-%m-%dT%H:%M:%SZ").zfill(20)


def record_bytes(page: int | None, url: str, seconds: int, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {_stamp(seconds)}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url), f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, payload) of one record; the payload of a revisit is empty."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return fs, path


_ENTRY = pa.schema([("run", pa.string()), ("seq", pa.int64()), ("urlkey", pa.string()), ("seconds", pa.int64()), ("page", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_ENTRY_SQL = "run string, seq long, urlkey string, seconds long, page long, file string, offset long, length long"


def _write(folder: str):
    """Rows (page, url, seconds, payload, refers) -> archive files and sorted runs of entries."""

    def run(batches):
        fs, top = open_store(folder)
        fs.create_dir(top, recursive=True)
        out, name, at, entries = None, "", 0, []

        def close():
            nonlocal out, entries
            if out is not None:
                out.close()
            rows = sorted(entries, key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0, e[3]))
            out, entries = None, []
            if rows:
                key, seconds, page, offset, length = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([name] * len(rows), range(len(rows)), key, seconds, page, [name] * len(rows), offset, length), _ENTRY, strict=True)], schema=_ENTRY)

        for batch in batches:
            for page, url, seconds, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "seconds", "html", "digest", "refers")), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0  # a task that is run again writes other files; only those of its result are read
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                member = gzip.compress(record_bytes(page, url, seconds, html.encode("utf-8", "surrogatepass"), bytes.fromhex(digest), refers), 5, mtime=0)
                out.write(member)
                entries.append((url_key(url), seconds, page, at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    yield from close()
        yield from close()

    return run


class LoserTree:
    """k-way merge: inner nodes keep the loser of each match, so one path from leaf to root replays per item."""

    def __init__(self, runs: list[Iterator]):
        self.runs, k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.k, self.losers = k, [-1] * k
        self.winner = self._play(1) if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self):
        while self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node >= 1:
                if not self._before(w, self.losers[node]):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def _run_keys(rows: pa.Table, start: int, end: int) -> Iterator[tuple]:
    """(key, row) of one run's rows, made a thousand at a time."""
    for at in range(start, end, 1024):
        part = rows.slice(at, min(1024, end - at))
        cols = [part.column(c).to_pylist() for c in ("urlkey", "seconds", "page", "file", "offset")]
        for i, (key, seconds, page, file, offset) in enumerate(zip(*cols, strict=True)):
            yield (key, seconds, page is not None, page or 0, file, offset), at + i


def _merge(batches):
    """Rows of one stretch, run after run in their own order -> one globally ordered stretch, with its places.

    The rows lie in Arrow columns; of the runs only their heads are Python objects.
    """
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    rows = pa.Table.from_batches(tables)
    run = rows.column("run").to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
    merged = LoserTree([_run_keys(rows, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    order = np.fromiter((i for _, i in merged), np.int64, len(run))
    first = TaskContext.get().partitionId() << 40
    out = rows.take(pa.array(order)).append_column("place", pa.array(first + np.arange(len(run)), pa.int64()))
    yield from out.combine_chunks().to_batches(max_chunksize=8192)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", seconds_col: str | None = None,
                   revisit_bytes: int = 1000) -> tuple[DataFrame, str]:
    """(entries, folder): one WARC record for every row of pages, and the locally sorted runs of entries.

    A null payload or URL is empty. Of rows with equal payloads of at least revisit_bytes the one with the
    largest id is the response and all others revisit it; rows that repeat that id are responses too. A
    null id stays null: such a row revisits a page that has an id, and is a response where there is none.
    Capture times outside the years 1 to 9999 are held at the ends of that range; ids may be any 64-bit number.
    An empty table makes no archive.
    """
    spark = pages.sparkSession
    page = F.col(id_col).cast("long")
    given = F.col(seconds_col).cast("long") if seconds_col else F.lit(EPOCH) + F.greatest(F.lit(FIRST), F.least(F.lit(LAST), page))
    seconds = F.greatest(F.lit(FIRST), F.least(F.lit(LAST), F.coalesce(given, F.lit(EPOCH))))
    rows = pages.select(page.alias("page"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), seconds.alias("seconds"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    size = F.octet_length("html")
    # payloads stay where they are: only digests are grouped, and only the rows that revisit something come back
    light = rows.select("page", digest.alias("digest"), size.alias("size")).filter(F.col("size") >= revisit_bytes)
    groups = (light.groupBy("digest").agg(F.max("page").alias("last"), F.min("page").alias("first"), F.count_if(F.col("page").isNull()).alias("nameless"))
              .filter("first < last or (nameless > 0 and last is not null)"))
    folder = new_path(spark, "warc")
    refers = groups.select(F.col("digest").alias("of"), "last")
    joined = (rows.withColumn("digest", digest).join(refers, (F.col("digest") == F.col("of")) & (F.octet_length("html") >= revisit_bytes), "left")
              .select("page", "url", "seconds", "html", "digest", F.when(~F.col("last").eqNullSafe(F.col("page")), F.col("last")).alias("refers")))
    entries, _ = materialise(joined.mapInArrow(_write(folder), _ENTRY_SQL), "warc-runs")
    return entries, folder


def capture_index(entries: DataFrame) -> DataFrame:
    """The entries in global order of (URL key, timestamp, page), by loser-tree merges of the sorted runs; null pages come first.

    `place` grows along that order. Rows come back to the order of their run by number after the
    dealing; their keys are compared only by the merge.
    """
    parts = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // STRETCH))
    return (entries.repartitionByRange(parts, "urlkey", "seconds", "page").sortWithinPartitions("run", "seq")
            .mapInArrow(_merge, _ENTRY_SQL + ", place long"))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(place, page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every index entry, read from the archives.

    payload_bytes and payload_digest are those of the full payload; the payload column of a revisit is null.
    Records come in the order of the archives; `place` has their position in the index.
    """
    schema = pa.schema([("place", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        fs, top = open_store(folder)
        handle, opened = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, got = whole.slice(at, 512), []
                for place, name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("place", "file", "offset", "length")), strict=True):
                    if name != opened:
                        if handle is not None:
                            handle.close()
                        handle, opened = fs.open_input_file(f"{top}/{name}"), name
                    fields, payload = parse_record(zlib.decompress(handle.read_at(length, offset), 31))
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind = fields["warc-type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{name}:{offset}: payload and digest differ")
                    got.append((place, page_of(fields["warc-record-id"]), fields["warc-target-uri"], payload if kind == "response" else None, int(fields["x-payload-length"]), digest, kind,
                                page_of(fields["warc-refers-to"]) if kind == "revisit" else None))
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*got, strict=True)), strict=True)), schema)
        if handle is not None:
            handle.close()

    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = index.select("place", "file", "offset", "length").repartition(parts, "file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "place long, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
