"""WARC archives: written record by record, read back, and assembled to captures.

Every page is a transaction of three records: a request, its response (or a
revisit, where another page's payload is equal) and a metadata record, which
name the response by ``WARC-Concurrent-To``.  The archives are plain WARC 1.1
files, written by Spark's text writer with ``CRLF CRLF`` between records, so
any file system that Spark writes to and its commit protocol will do.

Reading cuts the files at ``CRLF CRLF WARC/1.1 CRLF`` with Spark's splittable
text reader, and a record's ``Content-Length`` decides: a piece that holds
several records is taken apart, and a file in which some record is longer than
its piece (a payload that holds the separator itself) is read again as a
whole, by lengths alone.  Payload digests are verified.

Assembly: the records of a transaction are joined through concurrent-to
identifiers, in either direction and over one record between (metadata that
names the request, which names the response), and each capture is one nested
row.  A revisit gets its payload's size and digest from the record it refers to.

At scale: the writer decides about copies by digests (a page's payload is
shuffled only if the repeated digests are too many to broadcast), the reader
is map-only, and assembly shuffles headers, not payloads.  Of several requests
or metadata records of one capture the smallest id is given, with their
number, so no row grows without bound.

Defined results: a null payload is empty; a null url has no target; control
characters and spaces of a url are percent-encoded; null page ids are written
without one, never refer and are never referred to; of rows that repeat the
smallest page id of a payload, the first in the table's order is the response
(``pages`` is scanned twice, so it must give its rows in the same order, as
files do); records without a response or revisit make no capture; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import common
from evalspark.operators.joins import lookup_join

MIN_SHARED_BYTES = 100        # smaller payloads are never revisited
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 200_000, 32 << 20       # of repeated digests; beyond, the join shuffles
STAGE_COMPRESSION = "zstd"    # of staged headers: identifiers and digests are hexadecimal, which Parquet's usual codec leaves as it is
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_VERSION = "WARC/1.1\r\n"
_END = "\r\n\r\n"
_CONTROLS = "".join(map(chr, range(33))) + "\x7f"


def _record_id(*parts: Column) -> Column:
    """A uuid-shaped identifier fixed by its parts."""
    h = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(kind: str | Column, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the end that the writer puts behind it; headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in
             [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(DATE)),
              *headers, ("Content-Length", F.octet_length(block).cast("string"))]]
    return F.concat(F.lit(_VERSION), F.concat_ws("\r\n", *lines), F.lit(_END), block)


def _target(url: Column) -> Column:
    for c in _CONTROLS:
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return url


def _rows(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))


def transactions(pages: DataFrame, min_shared: int = MIN_SHARED_BYTES) -> DataFrame:
    """``value``: the records of every page, request first."""
    rows = _rows(pages)
    place = F.struct("page_id", "row")
    shared = rows.filter((F.col("n_bytes") >= min_shared) & F.col("page_id").isNotNull()).groupBy("digest").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    joined = lookup_join(rows, common.staged(shared, "shared-payloads"), "digest", "left", MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES)
    is_first = F.col("first").isNotNull() & (place == F.col("first"))
    is_revisit = F.col("first").isNotNull() & F.col("page_id").isNotNull() & ~is_first
    shared_id = _record_id(F.lit("response"), F.col("digest"))
    main = F.when(is_first, shared_id).when(is_revisit, _record_id(F.lit("revisit"), F.col("page_id"), F.col("row"))).otherwise(
        _record_id(F.lit("response"), F.col("page_id"), F.col("row")))
    named = joined.select("page_id", "payload", "digest", "n_bytes", "row", _target(F.col("url")).alias("target"),
                          is_revisit.alias("is_revisit"), F.when(is_revisit, shared_id).alias("refers_to"), main.alias("main"))
    target = ("WARC-Target-URI", F.col("target"))
    concurrent = ("WARC-Concurrent-To", F.col("main"))
    host = F.regexp_extract("target", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract("target", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)),
                     F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(_END))
    request = _record("request", _record_id(F.lit("request"), F.col("main")),
                      [target, concurrent, ("Content-Type", F.lit("application/http;msgtype=request"))], F.coalesce(asked, F.lit("")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n_bytes").cast("string"), F.lit(_END))
    answer = _record(F.when(F.col("is_revisit"), F.lit("revisit")).otherwise(F.lit("response")), F.col("main"),
                     [target, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
                      ("WARC-Refers-To", F.col("refers_to")),
                      ("WARC-Profile", F.when(F.col("is_revisit"), F.lit(REVISIT_PROFILE))),
                      ("Content-Type", F.lit("application/http;msgtype=response"))],
                     F.when(F.col("is_revisit"), head).otherwise(F.concat(head, F.col("payload"))))
    about = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = _record("metadata", _record_id(F.lit("metadata"), F.col("main")),
                       [target, concurrent, ("Content-Type", F.lit("application/warc-fields"))], about)
    return named.select(F.explode(F.array(request, answer, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (``page_id, url, html``) as WARC files under ``path``."""
    transactions(pages).write.option("lineSep", _END).text(path)


Header = dict[str, list[str]]


def _head(data: memoryview, at: int) -> tuple[Header, int] | None:
    """Named fields from ``at`` on, and where the block begins."""
    end = bytes(data[at:at + 65_536]).find(b"\r\n\r\n")
    if end < 0:
        return None
    fields: Header = {}
    for line in bytes(data[at:at + end]).decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields.setdefault(name.strip().lower(), []).append(value.strip())
    return fields, at + end + 4


def records(data: memoryview) -> Iterator[tuple[Header, memoryview] | None]:
    """Records of a piece that begins behind a version line; None where it breaks off, which ends the piece."""
    version, at = _VERSION.encode(), 0
    while True:
        head = _head(data, at)
        try:
            size = int(head[0]["content-length"][0]) if head else -1
        except (KeyError, ValueError):
            size = -1
        if size < 0 or head[1] + size > len(data):
            yield None
            return
        end = head[1] + size
        yield head[0], data[head[1]:end]
        rest = bytes(data[end:end + 4 + len(version)])
        if rest in (b"", b"\r\n\r\n"):
            return
        if rest != b"\r\n\r\n" + version:
            yield None
            return
        at = end + len(rest)


def _payload(fields: Header, block: memoryview) -> memoryview:
    """The block behind its HTTP header, if it has one."""
    if not fields.get("content-type", [""])[0].startswith("application/http"):
        return block
    end = bytes(block).find(b"\r\n\r\n")
    return block[end + 4:] if end >= 0 else block[len(block):]


_MAIN = ("response", "revisit")
_FIELDS = {"target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}        # of responses and revisits
RECORD = ("file string, whole boolean, record_type string, record_id string, target_uri string, date string, refers_to string, "
          "altered boolean, concurrent_to array<string>, payload_bytes long, payload_digest binary, info string, payload binary")


def _declared(fields: Header) -> bytes | None:
    """The SHA-256 of the payload that the header gives, if it gives one."""
    name, _, value = fields.get("warc-payload-digest", [""])[0].partition(":")
    try:
        return bytes.fromhex(value) if name.lower() == "sha256" else None
    except ValueError:
        return b""                                           # equal to no digest


def _parsed(with_payload: bool, leading: int):
    """A partition function over ``file, value``: a row per record, or a row that is not ``whole``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in common.slices(batch, 100)):
            rows = []
            for file, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                data = memoryview(value.as_buffer())
                if bytes(data[:len(_VERSION)]) == _VERSION.encode():         # the first piece of a file
                    data = data[len(_VERSION):]
                elif leading or not len(data):
                    if len(data):
                        rows.append({"file": file, "whole": False})
                    continue
                for found in records(data):
                    if found is None:
                        rows.append({"file": file, "whole": False})
                        continue
                    fields, block = found
                    kind = fields.get("warc-type", [None])[0]
                    row = {"file": file, "whole": True, "record_type": kind, "record_id": fields.get("warc-record-id", [None])[0],
                           "concurrent_to": fields.get("warc-concurrent-to", [])}
                    if kind in _MAIN:
                        payload = _payload(fields, block)
                        row |= {c: fields.get(n, [None])[0] for c, n in _FIELDS.items()}
                        declared = _declared(fields)
                        # A revisit has the digest of the payload that it refers to.
                        digest = declared if kind == "revisit" else hashlib.sha256(payload).digest()
                        row |= {"payload_bytes": len(payload), "payload_digest": digest, "altered": declared not in (None, digest)}
                        if with_payload and kind == "response":
                            row["payload"] = bytes(payload)
                    elif kind in ("metadata", "request"):
                        row["info"] = bytes(block[:65_536]).decode("utf-8", "replace")
                    rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("file", pa.string()), ("whole", pa.bool_()), *[(c, pa.string()) for c in ("record_type", "record_id", *_FIELDS)],
                     ("altered", pa.bool_()), ("concurrent_to", pa.list_(pa.string())), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.binary()), ("info", pa.string()), ("payload", pa.binary())])


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives under ``path`` (see ``RECORD``); payloads of responses if asked for."""
    pieces = spark.read.option("lineSep", _END + _VERSION).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    found = common.staged(pieces.mapInArrow(common.releasing(_parsed(with_payload, 0)), RECORD), "warc-records", STAGE_COMPRESSION)
    broken = common.staged(found.filter(~F.col("whole")).select("file").distinct(), "warc-broken-files")
    if broken.isEmpty():
        return found.drop("whole", "file")
    whole = spark.read.format("binaryFile").load(path).select("_metadata.file_path", "content").toDF("file", "value")
    again = whole.join(broken, "file", "left_semi").mapInArrow(common.releasing(_parsed(with_payload, 1)), RECORD)
    again = again.withColumn("whole", F.when(~F.col("whole"), F.raise_error(F.concat(F.lit("not a WARC file: "), F.col("file")))).otherwise(
        F.lit(True)))
    return found.join(broken, "file", "left_anti").unionByName(common.staged(again, "warc-whole-files", STAGE_COMPRESSION)).drop("whole", "file")


def _of_kind(kind: str) -> Column:
    """Of a capture's records of a kind the one of the smallest id."""
    own = F.col("record_type") == kind
    return F.min(F.when(own, F.struct("record_id", "info")))


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, and through concurrent-to identifiers its request and metadata."""
    is_main = F.col("record_type").isin(*_MAIN)
    mains = found.filter(is_main)
    others = found.filter(F.col("record_type").isin("request", "metadata")).select(
        "record_type", "record_id", "info", "concurrent_to")
    # Identifiers that lead to a capture: its own, and those that it names itself.
    named = mains.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("at"))
    known = mains.select(F.col("record_id").alias("capture"), F.col("record_id").alias("at")).unionByName(named).distinct()
    ways = others.select("record_type", "record_id", "info", F.explode(F.array_union("concurrent_to", F.array("record_id"))).alias("at"))
    direct = common.staged(ways.join(known, "at").select("capture", "record_type", "record_id", "info").distinct(), "warc-links", STAGE_COMPRESSION)
    # Over one record between: what names a record that belongs to a capture.
    left = ways.join(direct.select("record_id").distinct(), "record_id", "left_anti")
    between = left.join(direct.select("capture", F.col("record_id").alias("at")), "at").select("capture", "record_type", "record_id", "info").distinct()
    joined = direct.unionByName(between).groupBy("capture").agg(
        _of_kind("request").alias("request"), _of_kind("metadata").alias("metadata"),
        F.count_if(F.col("record_type") == "request").alias("n_requests"), F.count_if(F.col("record_type") == "metadata").alias("n_metadata"))
    full = mains.drop("concurrent_to", "info").withColumnRenamed("record_id", "capture").join(joined, "capture", "left")
    page = F.regexp_extract("metadata.info", r"(?:^|\n)page-id: (-?[0-9]+)", 1)
    return full.withColumn("page_id", F.when(page != "", page.cast("long")))


def resolved(captured: DataFrame) -> DataFrame:
    """``captured`` with ``refers_to_page``, and with the size and digest of the payload that a revisit refers to.

    Fails where a payload is not that of its declared digest, or a revisit refers to nothing."""
    target = captured.filter(F.col("record_type") == "response").select(
        F.col("capture").alias("refers_to"), F.col("page_id").alias("refers_to_page"), F.col("payload_bytes").alias("full_bytes"),
        F.col("payload_digest").alias("full_digest"))
    revisit = F.col("record_type") == "revisit"
    # Only revisits are joined: the others have no reference, and would all meet in one task.
    referring = captured.filter(revisit).join(target, "refers_to", "left").withColumns(
        {"payload_bytes": F.col("full_bytes"), "altered": F.coalesce(F.col("payload_digest") != F.col("full_digest"), F.lit(False)),
         "payload_digest": F.coalesce("full_digest", F.raise_error(F.concat(F.lit("revisit of nothing: "), F.col("capture"))))}).drop(
        "full_bytes", "full_digest")
    every = captured.filter(~revisit).withColumn("refers_to_page", F.lit(None).cast("long")).unionByName(referring)
    wrong = F.raise_error(F.concat(F.lit("payload does not fit its digest: "), F.col("capture")))
    return every.withColumn("payload_digest", F.when(F.col("altered"), wrong).otherwise(F.lower(F.hex("payload_digest")))).drop("altered")


def read_captures(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    return resolved(common.staged(captures(read_records(spark, path, with_payload)), "warc-captures", STAGE_COMPRESSION))
