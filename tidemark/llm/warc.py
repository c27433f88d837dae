"""Legacy archives (ARC, versions 1 and 2) to WARC 1.1, and readers of both.

1. *Index.*  Archives are read whole, a file at a time, and walked record by
   record: the version block names the fields of the header lines, whose last one
   declares the record's length; nothing is guessed from contents.  What comes out
   is one small row per record: archive, offset, header, digests.
2. *Types.*  Of records with equal payloads (by SHA-256 and length) of at least
   ``least`` bytes the one with the largest key is a response and the others revisit
   it.  Digests are counted before they meet, hot ones are joined apart.
3. *Conversion.*  Archives are read again, records meet their decisions, and WARC
   records are written as text files of Spark's own writer, compressed; a file is
   one hash range of records, of some ``file_mb`` of content.  Identifiers are made
   from archive and offset, so that a second try makes the same.

A record's payload is what follows the HTTP header; the header keeps the key
(``X-Record-Key``) and the length of the payload, which a revisit leaves out.
Records that are no HTTP response (such as DNS answers) become resources.

Null payloads are empty ones, null URLs are written ``-``; null keys stay null and
are the smallest; repeated keys and rows are records of their own, of which the
last in (archive, offset) is the response.  Texts of any length are one record.
Line breaks and blanks in a URL are percent-encoded.  An archive that is cut off,
or of another version, is an error that names it.  An empty table gives archives
without records and no rows.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop, join_skewed, stage

#: The fields of header lines by version, fixed by the format.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
CRLF = b"\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, key long, payload_bytes long, payload_sha1 string, payload_sha256 string, uri string, date string, record_id string, http boolean"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def clean_url(url: bytes | None) -> bytes:
    """A URL without white space, which would break a header line."""
    return b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes([c]) for c in url) if url else b"-"


def arc_line(version: int, url: bytes, ip: str, date: str, mime: str, length: int, status: int = 200, checksum: str = "-", offset: int = 0, name: str = "-") -> bytes:
    """One header line."""
    middle = [] if version == 1 else [str(status), checksum, "-", str(offset), name]
    return b" ".join([url, *(x.encode() for x in (ip, date, mime, *middle, str(length)))]) + b"\n"


def arc_head(version: int, name: str, date: str) -> bytes:
    """The record that opens an archive: its name, version and fields."""
    block = f"{version} 0 tidemark\n{' '.join(FIELDS[version])}\n".encode()
    return arc_line(version, f"filedesc://{name}".encode(), "0.0.0.0", date, "text/plain", len(block), name=name) + block


def http_head(key, length: int) -> bytes:
    own = b"" if key is None else b"X-Record-Key: %d\r\n" % key
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % length


def split_http(content: bytes) -> tuple[bytes, bytes] | None:
    """Header (with its empty line) and payload of an HTTP response, else None."""
    if not content.startswith(b"HTTP/"):
        return None
    at = content.find(b"\r\n\r\n")
    return (content[: at + 4], content[at + 4 :]) if at >= 0 else (content, b"")


def http_field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower():
            return value.strip().decode("latin-1")
    return None


def _opened(content: bytes) -> io.BufferedIOBase:
    """A file's bytes, unpacked as they are read where they are compressed."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _exactly(f, n: int, what: str) -> bytes:
    got = f.read(n)
    if len(got) != n:
        raise ValueError(f"{what}: {n} bytes are declared and {len(got)} are there")
    return got


def arc_records(content: bytes, what: str = "archive") -> Iterator[dict]:
    """The records of an ARC file: archive (its own name), offset, header fields
    and content.  Header lines are taken apart from the right, since old URLs may
    hold blanks."""
    f, at = _opened(content), 0

    def header(n: int) -> tuple[list[bytes] | None, int]:
        nonlocal at
        while line := f.readline():
            start, at = at, at + len(line)
            if line.strip():
                parts = line.rstrip(b"\r\n").rsplit(b" ", n - 1)
                if len(parts) != n or not parts[-1].isdigit():
                    raise ValueError(f"{what}, byte {start}: {line[:80]!r} is no header line of {n} fields")
                return parts, start
        return None, at

    line = f.readline()
    at = len(line)
    if not line:
        return
    if not line.startswith(b"filedesc://"):
        raise ValueError(f"{what}: it doesn't begin with filedesc://")
    block = _exactly(f, int(line.rsplit(b" ", 1)[-1]), what)
    at += len(block)
    version = int(block.split(b" ", 1)[0])
    if version not in FIELDS:
        raise ValueError(f"{what}: version {version} of the format is unknown")
    names = tuple(block.split(b"\n")[1].decode().split())
    if names != FIELDS[version]:
        raise ValueError(f"{what}: version {version} has other fields: {names}")
    name = line[len(b"filedesc://") :].split(b" ", 1)[0].decode()
    while True:
        parts, start = header(len(names))
        if parts is None:
            return
        own = dict(zip(names, (p.decode("utf-8", "replace") for p in parts), strict=True))
        body = _exactly(f, int(parts[-1]), f"{what}, byte {start}")
        at += len(body)
        yield {"archive": name, "offset": start, "version": version, "content": body} | own


def warc_date(date: str) -> str:
    """An ARC date (of 14 digits, older ones of 12) as WARC writes it."""
    d = (date if date.isdigit() else "19700101000000").ljust(14, "0")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{archive}#{offset}')}>"


def warc_record(kind: str, ident: str, date: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record, without the two line ends after it."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + CRLF + block


def warc_records(content: bytes, what: str = "archive") -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of a WARC file, by declared lengths."""
    f = _opened(content)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"{what}: {line[:80]!r} begins no record")
        head: dict[str, str] = {}
        while (line := f.readline()) and line.strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, _exactly(f, int(head["content-length"]), what)


def _to_batches(rows: Iterator[tuple], names: list[str], types: list, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of some ``most`` bytes (or one row)."""
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += 200 + sum(len(x) for x in r if isinstance(x, bytes | str))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """One row per archive: path and content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("path", "content")


def _each_file(batches, read) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            yield from read(b.column(1)[i].as_py(), b.column(0)[i].as_py())


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "20000101000000", file_mb: int = 16) -> None:
    """Write rows as ARC files, compressed, of version 1 and 2 by turns.  Rows stay
    where they are read; a file has as many as make some ``file_mb`` of payloads."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("binary").alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    size = pages.agg(F.sum(F.octet_length(F.coalesce(F.col(payload), F.lit("")))).alias("total"), F.count("*").alias("n")).first()
    # the writer begins a file at every so many values, of which the first opens the archive
    each = 1 + max(1, (size["n"] * (file_mb << 20)) // max(1, size["total"] or 0))

    def write(batches):
        task = TaskContext.get().partitionId()

        def records():
            at = 0
            for b in batches:
                for k, u, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if at % each == 0:
                        version, name = 1 + (task + at // each) % 2, f"tidemark-{task:06d}-{at // each:06d}.arc"
                        yield (arc_head(version, name, date),)
                        at += 1
                    head = http_head(k, len(p))
                    line = arc_line(version, clean_url(u), "0.0.0.0", date, "text/html", len(head) + len(p), name=name)
                    yield (line + head + p,)
                    at += 1

        yield from _to_batches(records(), ["value"], [pa.binary()])

    _write_text(rows.mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value")), path, "\n", each)


def _write_text(values: DataFrame, path: str, end: str, each: int = 0) -> None:
    """Values with ``end`` after each, a file per partition, or for every ``each``
    values of it; few rows at a time go through Python."""
    spark, option = values.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(option)
    spark.conf.set(option, "200")
    try:
        out = values.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
        out.option("maxRecordsPerFile", each).text(path)
    finally:
        spark.conf.set(option, before)


def index_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the ARC files below ``path``, with digests of its
    payload; staged."""

    def read(content: bytes, what: str):
        for r in arc_records(content, what):
            parts = split_http(r["content"])
            head, payload = parts or (b"", r["content"])
            key = http_field(head, b"X-Record-Key")
            yield (
                r["archive"], r["offset"], None if key is None else int(key), len(payload), base32_sha1(payload), hashlib.sha256(payload).hexdigest(), r["URL"],
                warc_date(r["Archive-date"]), record_id(r["archive"], r["offset"]), parts is not None
            )

    def index(batches):
        names = [x.split()[0] for x in INDEX.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.bool_()]
        yield from _to_batches(_each_file(batches, read), names, types)

    return stage(_files(spark, path).mapInArrow(index, INDEX), "arc-index", rows_at_once=1)


def decide(index: DataFrame, least: int = 0) -> DataFrame:
    """Per record: archive, offset, and for revisits the record that holds the
    payload (refers_to, its URI and date); staged."""
    enough = index.filter((F.col("payload_bytes") >= least) & F.col("http"))
    place = F.struct("key", "archive", "offset", "record_id", "uri", "date")
    groups = enough.groupBy("payload_sha256", "payload_bytes").agg(F.max(place).alias("first"), F.count("*").alias("_n")).filter("_n > 1")
    groups = stage(groups.select(F.concat_ws(":", "payload_sha256", "payload_bytes").alias("_same"), "first", "_n"), "equal-payloads")
    same = F.when((F.col("payload_bytes") >= least) & F.col("http"), F.concat_ws(":", "payload_sha256", "payload_bytes"))
    met = join_skewed(index.select("archive", "offset", same.alias("_same"), "record_id"), groups, "_same", "_n", most=100_000)
    other = F.col("first.record_id") != F.col("record_id")
    out = met.select("archive", "offset", *[F.when(other, F.col(f"first.{c}")).alias(f"of_{c}") for c in ("record_id", "uri", "date")])
    out = stage(out, "decisions")
    drop(groups)
    return out


def convert(spark: SparkSession, arc: str, warc: str, least: int = 0, file_mb: int = 16) -> None:
    """Convert the ARC files below ``arc`` to WARC files in ``warc``."""
    index = index_arc(spark, arc)
    decided = decide(index, least)
    total = index.agg(F.sum("payload_bytes")).first()[0] or 0
    parts = max(1, -(-total // (file_mb << 20)))
    kinds = [("archive", pa.string()), ("offset", pa.int64()), ("uri", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("content", pa.binary())]

    def read(content: bytes, what: str):
        for r in arc_records(content, what):
            yield r["archive"], r["offset"], r["URL"], r["IP-address"], warc_date(r["Archive-date"]), r["Content-type"], r["content"]

    def rows(batches):
        yield from _to_batches(_each_file(batches, read), [k for k, _ in kinds], [t for _, t in kinds])

    schema = "archive string, offset long, uri string, ip string, date string, mime string, content binary"
    records = _files(spark, arc).mapInArrow(rows, schema)

    def write(batches):
        def made():
            opened = False
            for b in batches:
                for r in b.to_pylist():
                    if not opened:
                        opened, ident = True, f"{r['archive']}#info"
                        yield (_info(ident, r["date"]),)
                    yield (_converted(r),)

        yield from _to_batches(made(), ["value"], [pa.binary()])

    met = records.repartition(parts, "archive", "offset").join(decided.repartition(parts, "archive", "offset"), ["archive", "offset"])
    _write_text(met.mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value")), warc, "\r\n\r\n")
    drop(index, decided)


def _info(name: str, date: str) -> bytes:
    block = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
    return warc_record("warcinfo", record_id(name, -1), date, [("Content-Type", "application/warc-fields")], block)


def _converted(r: dict) -> bytes:
    """One ARC record as WARC."""
    ident, parts = record_id(r["archive"], r["offset"]), split_http(r["content"])
    fields = [("WARC-Target-URI", r["uri"]), ("WARC-IP-Address", r["ip"])]
    if parts is None:
        fields += [("WARC-Block-Digest", "sha1:" + base32_sha1(r["content"])), ("Content-Type", r["mime"])]
        return warc_record("resource", ident, r["date"], fields, r["content"])
    head, payload = parts
    kind, block = ("response", r["content"]) if r["of_record_id"] is None else ("revisit", head)
    fields += [("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("WARC-Block-Digest", "sha1:" + base32_sha1(block))]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", r["of_record_id"]), ("WARC-Refers-To-Target-URI", r["of_uri"]), ("WARC-Refers-To-Date", r["of_date"])]
    return warc_record(kind, ident, r["date"], [*fields, ("Content-Type", "application/http; msgtype=response")], block)


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The responses and revisits of the WARC files below ``path``: key, uri, date,
    record_type, payload_bytes and payload_digest (of the full payload), record_id,
    refers_id, and the payload itself on request (null for revisits).  A block or
    payload that doesn't have its record's digest is an error."""

    def read(content: bytes, what: str):
        for head, block in warc_records(content, what):
            if head["warc-type"] not in ("response", "revisit"):
                continue
            ident = head["warc-record-id"]
            http, body = split_http(block) or (b"", block)
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            whole = head["warc-type"] == "response"
            if head["warc-block-digest"] != "sha1:" + base32_sha1(block) or whole and base32_sha1(body) != digest:
                raise ValueError(f"{what}: {ident} doesn't have its digest")
            key, size = http_field(http, b"X-Record-Key"), http_field(http, b"Content-Length")
            out = (
                None if key is None else int(key), head.get("warc-target-uri"), head["warc-date"], head["warc-type"], len(body) if whole else int(size), digest,
                ident, head.get("warc-refers-to")
            )
            yield (*out, body if whole else None) if payload else out

    names = ["key", "uri", "date", "record_type", "payload_bytes", "payload_digest", "record_id", "refers_id"] + ["payload"] * payload
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 3] + [pa.binary()] * payload

    def rows(batches):
        yield from _to_batches(_each_file(batches, read), names, types)

    schema = "key long, uri string, date string, record_type string, payload_bytes long, payload_digest string, record_id string, refers_id string" + ", payload binary" * payload
    return stage(_files(spark, path).mapInArrow(rows, schema), "warc-rows", rows_at_once=1)


def with_referred(rows: DataFrame, key: str = "refers_to") -> DataFrame:
    """``read_warc``'s rows with the key of the record that a revisit refers to."""
    times = rows.filter("refers_id IS NOT NULL").groupBy("refers_id").agg(F.count("*").alias("_n"))
    held = rows.select(F.col("record_id").alias("refers_id"), F.col("key").alias(key))
    named = stage(times.join(held, "refers_id"), "referred")
    return join_skewed(rows, named, "refers_id", "_n", most=100_000)


def round_trip(pages: DataFrame, arc: str, warc: str, least: int = 0, key: str = "page_id", url: str = "url", payload: str = "html", file_mb: int = 16) -> DataFrame:
    """``pages`` as legacy archives, those converted, and what the converted ones say."""
    spark = pages.sparkSession
    write_arc(pages, arc, key, url, payload, file_mb=file_mb)
    convert(spark, arc, warc, least, file_mb)
    return with_referred(read_warc(spark, warc))

