"""Legacy ARC archives, their conversion to WARC, and both formats' readers."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.shared import delete, discard, join_by_class, map_frames, materialize, new_path

#: Names of the fields of a record's header line, of each version of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """date: of the captures, 14 digits. bytes: compressed, from which a file is closed. least: bytes from which equal payloads are told apart."""

    date: str = "20240101000000"
    bytes: int = 64_000_000
    least: int = 100
    level: int = 5
    #: Bytes of payloads that a reader hands on at once.
    at_once: int = 8_000_000


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme, as Arrow's file systems (local, HDFS, S3, GCS) open it on any machine."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return str(where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString())


def _write(values: DataFrame, path: str, ending: str, heads: dict[int, bytes], end: bytes, archive: Archive) -> DataFrame:
    """Write values(version, value) into files of one gzip member for each record, and return the table of their names.

    Each file starts with the head of its version. A file is named for the attempt that writes it, and only files of
    attempts that ended well are in the table, which is written last; so a lost executor leaves none that are read.
    """
    root = qualified(values.sparkSession, path)
    member = lambda data: (made := zlib.compressobj(archive.level, zlib.DEFLATED, 31)).compress(data) + made.flush()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        attempt, file, done, size = uuid.uuid4().hex, None, [], 0
        for pdf in batches:
            for version, value in zip(pdf["version"], pdf["value"], strict=True):
                if file is None:
                    done.append(f"{root}/{attempt}-{len(done):05d}{ending}")
                    file, size = fs.open_output_stream(f"{base}/{done[-1].rpartition('/')[2]}", compression=None), 0
                    file.write(member(heads[version]))
                data = member(value.encode() + end)
                file.write(data)
                size += len(data)
                if size >= archive.bytes:
                    file.close()
                    file = None
        if file is not None:
            file.close()
        yield pd.DataFrame({"path": done})

    return materialize(map_frames(values.select("version", "value"), run, "path string"), "files")


def _each_file(files: DataFrame, read, schema: str, archive: Archive) -> DataFrame:
    """The rows that read(stream) gives, with the bytes that each holds, of every file; a task holds a record and a batch at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                out, held = [], 0
                with fs.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row, size in read(stream):
                        out.append(row)
                        held += size
                        if held >= archive.at_once or len(out) >= 5000:
                            yield pd.DataFrame(out, columns=names, dtype=object)
                            out, held = [], 0
                yield pd.DataFrame(out, columns=names, dtype=object)

    tasks = max(1, min(files.count(), 10_000))
    return map_frames(files.repartition(tasks, "path"), run, schema)


def write_arc(pages: DataFrame, path: str, archive: Archive) -> DataFrame:
    """Write a record of each row of pages(page_id, url, html) into ARC files, of version 1 and 2 by turns of partitions; their names.

    A record's document is a stored HTTP response; its header carries the page_id. Each file starts with a version block.
    """
    html = F.coalesce("html", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    url = F.regexp_replace(F.coalesce("url", F.lit("http://unknown.invalid/")), r"[\x00-\x20\x7f]", "%20")
    rows = pages.select(url.alias("url"), http.alias("http"), html.alias("html"), (F.spark_partition_id() % 2 + 1).alias("version"))
    length = (F.octet_length("http") + F.octet_length("html")).cast("string")
    line = F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit(archive.date), F.lit("text/html"), F.when(F.col("version") == 2, F.lit("200 - - 0 -")), length)
    values = rows.select("version", F.concat(line, F.lit("\n"), "http", "html").alias("value"))
    blocks = {v: f"{v} 0 tessella\n{names}\n" for v, names in ARC_FIELDS.items()}
    heads = {v: f"filedesc://tessella.arc 0.0.0.0 {archive.date} text/plain {'200 - - 0 - ' if v == 2 else ''}{len(b)}\n{b}\n".encode() for v, b in blocks.items()}
    return _write(values, path, ".arc.gz", heads, b"\n", archive)


def arc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, document) of each record of an ARC file but the version block, whose definition line names the fields.

    A header line is divided from its right end, by the number of fields that the version has; the document is as
    long as the line declares, whatever it contains. Raises ValueError at a broken line or a short document.
    """
    names = None
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        if not line.endswith(b"\n"):
            raise ValueError("ARC header line without an end")
        line = line.rstrip(b"\r\n").decode("utf-8", "replace")
        length = int(line.rpartition(" ")[2])
        document = stream.read(length)
        if len(document) < length:
            raise ValueError(f"ARC record declares {length} bytes and has {len(document)}: {line[:200]}")
        if names is None:
            names = document.split(b"\n")[1].decode().split()
            if int(document.split(b" ")[0]) not in ARC_FIELDS or names[-1] != "Archive-length":
                raise ValueError("unknown version of the ARC format")
            continue
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names):
            raise ValueError(f"ARC header line of {len(parts)} fields: {line[:200]}")
        yield dict(zip(names, parts, strict=True)), document


def http_parts(document: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields by lower-case name, the header with its blank line, and the payload of a stored HTTP response."""
    head, blank, payload = document.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, head + blank, payload


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def read_arc(files: DataFrame, archive: Archive, payload: bool = True) -> DataFrame:
    """(page_id, url, ip, date, content_type, digest, n, http, payload) of each record of the ARC files(path)."""

    def read(stream: BinaryIO) -> Iterator[tuple[tuple, int]]:
        for f, document in arc_records(stream):
            fields, head, body = http_parts(document)
            row = (_number(fields.get("x-page-id")), f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], hashlib.sha256(body).hexdigest(), len(body))
            yield row + ((head.decode(), body.decode()) if payload else (None, None)), len(body) if payload else 0

    return _each_file(files, read, "page_id long, url string, ip string, date string, content_type string, digest string, n long, http string, payload string", archive)


def _urn(page_id: Column, digest: Column) -> Column:
    """A record's identifier, from the page and its payload alone, in the form of a UUID."""
    h = F.sha2(F.concat_ws(":", F.lit("record"), F.coalesce(page_id.cast("string"), F.lit("")), digest).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)), F.lit(">"))


def warc_values(records: DataFrame) -> DataFrame:
    """(value): the text of a WARC record without its end, from read_arc() rows with `first`, the page that has the payload first."""
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    date = F.regexp_replace("date", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    fields = {
        "WARC-Type": F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        "WARC-Record-ID": _urn(F.col("page_id"), F.col("digest")),
        "WARC-Date": date,
        "WARC-Target-URI": F.col("url"),
        "WARC-IP-Address": F.col("ip"),
        "WARC-Payload-Digest": F.concat(F.lit("sha256:"), "digest"),
        "WARC-Identified-Payload-Type": F.col("content_type"),
        "WARC-Profile": F.when(revisit, F.lit(REVISIT_PROFILE)),
        "WARC-Refers-To": F.when(revisit, _urn(F.col("first"), F.col("digest"))),
        "X-Refers-To-Page": F.when(revisit, F.col("first").cast("string")),
        "X-Page-Id": F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        "X-Payload-Length": F.col("n").cast("string"),
        "Content-Type": F.lit("application/http; msgtype=response"),
        "Content-Length": F.octet_length("block").cast("string"),
    }
    lines = F.concat_ws("", F.lit("WARC/1.0\r\n"), *[F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in fields.items()], F.lit("\r\n"))
    return records.withColumn("block", block).select(F.concat(lines, "block").alias("value"))


def warcinfo(archive: Archive) -> bytes:
    """The record at the start of each WARC file: its software and format."""
    body = b"software: tessella\r\nformat: WARC File Format 1.0\r\n"
    d = archive.date
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    return f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'tessella ' + d)}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def convert(arc: DataFrame, warc_path: str, archive: Archive) -> DataFrame:
    """Convert the ARC files arc(path) to WARC files below warc_path; their names.

    Identifiers come from page and payload, timestamps from the 14 digits, types from the comparison of digests, and
    digests from the payloads. Of equal payloads of `archive.least` bytes or more, the record of the smallest page_id
    is a response and the others are revisits of it; only digests are grouped.
    """
    small = read_arc(arc, archive, payload=False).select("page_id", "digest", "n")
    first = materialize(small.groupBy("digest", F.col("n").alias("bytes")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "payloads")
    total = first.agg(F.sum("n")).first()[0] or 0
    several = first.where((F.col("bytes") >= archive.least) & (F.col("n") > 1)).select("digest", "first", "n")
    records = join_by_class(read_arc(arc, archive).withColumnRenamed("n", "bytes"), several, ["digest"], total).withColumnRenamed("bytes", "n")
    files = _write(warc_values(records).withColumn("version", F.lit(1)), warc_path, ".warc.gz", {1: warcinfo(archive)}, b"\r\n\r\n", archive)
    discard(first)
    return files


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of a WARC file, by declared lengths."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the WARC record {fields.get('warc-record-id')} does not end where it declares")
        yield fields, block


def read_warc(files: DataFrame, archive: Archive) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each response and revisit of the WARC files(path).

    The payloads of responses are hashed again and must have the digest that their header declares.
    """

    def read(stream: BinaryIO) -> Iterator[tuple[tuple, int]]:
        for f, block in warc_records(stream):
            if f["warc-type"] == "warcinfo":
                continue
            digest, n = f["warc-payload-digest"].removeprefix("sha256:"), int(f["x-payload-length"])
            if f["warc-type"] == "response":
                payload = http_parts(block)[2]
                n = len(payload)
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {f['warc-record-id']} has another digest")
            yield (_number(f.get("x-page-id")), n, digest, f["warc-type"], _number(f.get("x-refers-to-page"))), 0

    return _each_file(files, read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", archive)


def archive_pages(pages: DataFrame, archive: Archive | None = None, keep: str | None = None) -> DataFrame:
    """Write pages(page_id, url, html) as ARC, convert the archives to WARC, and read these: a row for each page.

    The WARC files stay in the folder `keep`; without one they are deleted when they have been read. A null html is an
    empty payload, a null url a placeholder, and whitespace in a url is escaped. A null page_id stays null and is never
    the first of equal payloads while another has an id; rows that repeat the smallest page_id with its payload are all
    responses. An empty table gives an empty result. Other columns are ignored.
    """
    archive, spark = archive or Archive(), pages.sparkSession
    arc, warc = new_path(spark, "arc"), keep or new_path(spark, "warc")
    written = write_arc(pages, arc, archive)
    files = convert(written, warc, archive)
    out = materialize(read_warc(files, archive), "pages")
    delete(spark, arc)
    if not keep:
        delete(spark, warc)
    return out
