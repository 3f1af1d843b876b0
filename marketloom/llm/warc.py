"""WARC archives of captured pages: written, read back, and put together as transactions.

Each page becomes a response record, or a revisit record if another page with the same payload is the
response, and a request and a metadata record that name it as concurrent. Records are UTF-8 text that ends
in two line breaks of two bytes, so Spark's text writer writes them with this as its line separator: files
are committed like any other output and may lie in any store that Spark reaches. Each file is one gzip
member of whole records.

Every record has a name of its own, the page id and the row's place in the table, so pages that repeat an id, or have
none, stay apart. Reading loads each file as it is stored (``RECORDS`` bounds its records), unpacks it a piece at a time
and walks its records by their declared lengths; a worker holds the packed file, one record and one batch of
at most ``BATCH`` bytes (or one record, if that is longer). The records then meet again by shuffles on their identifiers: requests and metadata
join the capture that they are concurrent to, which gives one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import fresh_path, written

RECORDS = 3_000
#: Bytes of unpacked data that are read at a time, and of records that are passed on together.
PIECE, BATCH = 1 << 18, 1 << 23
BREAK = "\r\n"
#: Date of all records: the pages carry none, and reruns give the same archive.
DATE = "2001-01-01T00:00:00Z"
#: Digits of base 32, by value: as SQL writes them and as digests are written.
_SQL_DIGITS, _DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_RECORD = (
    "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_bytes long, payload_digest string, http string, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: every five hexadecimal digits are four of base 32."""
    hexadecimal = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), _SQL_DIGITS, _DIGITS)


def _name(id_: Column, place: Column, part: str = "") -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(id_.cast("string"), F.lit("none")), F.lit(":"), place.cast("string"), F.lit(f"{part}>"))


def _record(kind: Column | str, headers: dict[str, Column], content_type: str, block: Column) -> Column:
    """Text of a record without the closing breaks; headers with NULL values are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers.items()]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(BREAK, *lines), F.lit(BREAK * 2), block)


def write_archive(df: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = 0, records_per_file: int | None = None) -> None:
    """Write three records per row of ``df`` below ``path``.

    Of rows whose payloads are equal and have at least ``least`` bytes, the one with the largest id is the
    response and the others revisit it; rows that tie for it are all responses, and the others name one of them. A NULL id
    is smaller than any other. Smaller payloads are all responses. A NULL payload is empty; control characters and spaces of
    a URL are percent-encoded, a NULL URL has no header. Payloads are
    equal when size and SHA-256 are. Other columns are ignored; an empty table gives an archive without records.
    Files have at most ``records_per_file`` records (``RECORDS``): fewer suit tables of very long pages, since a reader loads a packed file.
    """
    rows = df.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(payload_column).cast("string"), F.lit("")).alias("payload"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = rows.select("*", F.sha2(F.col("payload").cast("binary"), 256).alias("content"), F.octet_length("payload").alias("bytes"))
    leaders = rows.where(F.col("bytes") >= least).groupBy("content", "bytes").agg(F.max(F.struct("id", "place")).alias("leader"))
    rows = rows.join(leaders, ["content", "bytes"], "left")
    revisits = (F.col("bytes") >= least) & ~F.col("id").eqNullSafe(F.col("leader.id"))
    uri = F.col("url")
    for code in [*range(33), 127]:
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    own = _name(F.col("id"), F.col("place"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(BREAK * 2),
    )
    digest = F.concat(F.lit("sha1:"), base32_sha1(F.col("payload").cast("binary")))
    capture = _record(
        F.when(revisits, "revisit").otherwise("response"),
        {
            "WARC-Record-ID": own,
            "WARC-Target-URI": uri,
            "WARC-Payload-Digest": digest,
            "WARC-Profile": F.when(revisits, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            "WARC-Refers-To": F.when(revisits, _name(F.col("leader.id"), F.col("leader.place"))),
        },
        "application/http;msgtype=response",
        F.when(revisits, http).otherwise(F.concat(http, F.col("payload"))),
    )
    asked = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("*")), F.lit(f" HTTP/1.1{BREAK * 2}"))
    names = {"WARC-Target-URI": uri, "WARC-Concurrent-To": own}
    request = _record("request", {"WARC-Record-ID": _name(F.col("id"), F.col("place"), ":request"), **names}, "application/http;msgtype=request", asked)
    noted = F.concat(F.lit("contentBytes: "), F.col("bytes").cast("string"), F.lit(BREAK))
    metadata = _record("metadata", {"WARC-Record-ID": _name(F.col("id"), F.col("place"), ":metadata"), **names}, "application/warc-fields", noted)
    records = rows.select(F.explode(F.array(capture, request, metadata)).alias("value"))
    records.write.option("lineSep", BREAK * 2).option("maxRecordsPerFile", records_per_file or RECORDS).option("compression", "gzip").text(path)


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(b"\r\n")[1:])
    return {name.decode().lower(): value.decode().strip() for name, _, value in pairs}


def _unpacked(data: bytes) -> Iterator[bytes]:
    """The content of a file of any number of gzip members, or of a plain one, a piece at a time."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(view[k : k + PIECE]) for k in range(0, len(view), PIECE))
        return
    member, at = zlib.decompressobj(31), 0
    while at < len(view) or member.unconsumed_tail:
        given = member.unconsumed_tail
        if not given:
            given = view[at : at + PIECE]
            at += len(given)
        yield member.decompress(given, PIECE)
        if member.eof:
            at -= len(member.unused_data)
            member = zlib.decompressobj(31)
    yield member.flush()


class _Stream:
    """Content that comes in pieces, taken by length or up to a mark."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at, self.passed = pieces, bytearray(), 0, 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            if self.at > PIECE:
                del self.held[: self.at]
                self.passed += self.at
                self.at = 0
            self.held += piece
        return piece is not None

    def take(self, size: int) -> bytes:
        """The next ``size`` bytes, fewer at the end."""
        while len(self.held) - self.at < size and self._more():
            pass
        found = bytes(memoryview(self.held)[self.at : self.at + size])
        self.at += len(found)
        return found

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the next ``mark``, which is passed over; None without one."""
        looked = 0
        while (end := self.held.find(mark, self.at + looked)) < 0:
            looked = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self._more():
                return None
        found = bytes(memoryview(self.held)[self.at : end])
        self.at = end + len(mark)
        return found

    def ended(self) -> bool:
        while self.at == len(self.held):
            if not self._more():
                return True
        return False


def _records(stream: _Stream, payloads: bool) -> Iterator[tuple]:
    """The records of a file by their declared lengths."""
    while not stream.ended():
        at = stream.passed + stream.at
        lines = stream.until(b"\r\n\r\n")
        if lines is None or not lines.startswith(b"WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        head = _fields(lines)
        block = stream.take(int(head["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        kind, http, payload = head["warc-type"], None, None
        size = digest = None
        if kind in ("response", "revisit"):
            cut = block.find(b"\r\n\r\n")
            answer, body = (block[:cut], memoryview(block)[cut + 4 :]) if cut >= 0 else (block, b"")
            http = answer.decode()
            if kind == "response":
                size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                payload = bytes(body) if payloads else None
            else:  # what the record says about the payload it leaves out
                size = int(_fields(answer).get("content-length", -1))
                digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
        links = (head.get(f"warc-{x}") for x in ("record-id", "concurrent-to", "refers-to", "target-uri", "date"))
        yield (kind, *links, size, digest, http, payload)


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of the files below ``path``. Digests and sizes of responses are taken from the
    payloads read; a broken record is an error. ``payloads=False`` leaves the payloads out."""
    names = [c.split()[0] for c in _RECORD.split(", ")]
    types = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in _records(_Stream(_unpacked(content.as_py())), payloads):
                    rows.append(row)
                    held += 1_000 + len(row[-1] or b"")
                    if held >= BATCH:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parsed, _RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``response`` (or revisit) with all its fields, ``request`` and
    ``metadata`` (NULL without one).

    Requests and metadata join the capture that their concurrent-to identifier names; those that name none
    are left out. Of records that repeat an identifier, one is taken: the largest by its fields.
    """
    whole = F.struct(*[F.col(c) for c in records.columns])
    of = lambda *kinds: records.where(F.col("kind").isin(*kinds))
    answers = of("response", "revisit").groupBy(F.col("record_id").alias("capture_id")).agg(F.max(whole).alias("response"))
    sides = [of(k).groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.max(whole).alias(k)) for k in ("request", "metadata")]
    return answers.join(sides[0], "capture_id", "left").join(sides[1], "capture_id", "left")


def page_of(name: Column) -> Column:
    """The page id in a capture's name; NULL for ``none``."""
    return F.regexp_extract(name, r"^<urn:x-page:(-?\d+):\d+>$", 1).try_cast("long")


def round_trip(df: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = 0) -> DataFrame:
    """Write an archive of ``df`` to the shared folder, read it back, and return a row per capture: one for each row of
    ``df``, also for rows that repeat an id or have none."""
    spark = df.sparkSession
    path = fresh_path(spark, "archive")
    write_archive(df, path, id_column, url_column, payload_column, least)
    found = captures(written(read_archive(spark, path, payloads=False), "records"))
    return found.select(
        page_of(F.col("capture_id")).alias(id_column),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        page_of(F.col("response.refers_to")).alias("refers_to"),
        F.col("request.record_id").isNotNull().alias("has_request"),
        F.col("metadata.record_id").isNotNull().alias("has_metadata"),
    )
