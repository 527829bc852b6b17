"""Legacy archives (ARC 1 and 2) turned into WARC, and WARC written and read by a cluster.

An ARC file opens with a version block, whose last line names the fields of all header lines; each record
is a header line, as many bytes as its last field says, and a line end. The converter makes of each a WARC
record with an identifier, a timestamp, a type and digests. Archives are written through Spark's text
writer (a record a row, with the blank lines that end a WARC record as line separator), so they can go
to any store, survive lost executors, and are ordinary gzip files of WARC records (a gzip stream a file, not a
member a record). Identifiers of records depend on the task, the file in it and the place in the file, so they are
unique, rows that repeat others included, and a task that runs again writes the same.

Nulls: a null html is an empty payload, a null url is written as "-". Records with equal payloads:
the largest page_id is the response and the others revisit it; a null page_id is smaller than any other.
Rows that repeat a page_id with the same payload are alike: all responses or all revisits. Empty tables give
no record. A page's number travels percent-encoded, so any string may be one. Other columns aren't carried, whatever
their names. Very long pages are taken whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, small, written

#: The fields of header lines by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = b"\r\n\r\n"
#: Bytes of html that go into one ARC file, and uncompressed bytes of an archive on average.
ARC_BYTES, ARCHIVE_BYTES = 4 << 20, 32 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(data: bytes) -> str:
    """The digest as WARC has it: upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


@dataclass
class ArcRecord:
    """A record of an ARC file: the header line's fields by name, and the declared bytes."""

    fields: dict[str, str]
    body: bytes


def _one_line(text: str) -> str:
    return text.replace("\n", "%0A").replace("\r", "%0D")


def write_arc(records: list[ArcRecord], version: int, name: str = "pages.arc", date: str = "19960101000000") -> bytes:
    """An ARC file of the version; fields that a record lacks are "-"."""
    names = ARC_FIELDS[version].split()
    block = f"{version} 0 corpusloom\n{ARC_FIELDS[version]}\n".encode()
    head = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200"}
    out = []
    for r in (ArcRecord(head, block), *records):
        fields = {**{n: "-" for n in names}, **r.fields, "Archive-length": str(len(r.body))}
        out += [" ".join(_one_line(fields[n]) for n in names).encode(), b"\n", r.body, b"\n"]
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, the version block first. The header's names decide how its lines are cut."""
    names, at = None, 0
    while at < len(data):
        if data[at] in b"\r\n":  # what separates records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at byte {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        try:
            size = int(line.rsplit(" ", 1)[-1])
        except ValueError:
            raise ValueError(f"no declared length at byte {at}: {line[:80]}") from None
        body = data[end + 1 : end + 1 + size]
        if len(body) != size:
            raise ValueError(f"{size} bytes are declared at byte {at}, {len(body)} are left")
        if names is None:
            lines = body.decode("utf-8", "replace").splitlines()
            if not line.startswith("filedesc://") or len(lines) < 2 or lines[0].split(" ")[0] not in ("1", "2"):
                raise ValueError("not an ARC file")
            names = lines[1].split()
        values = line.rsplit(" ", len(names) - 1)  # a URL may have spaces
        if len(values) != len(names):
            raise ValueError(f"{len(names)} fields are named, {len(values)} are at byte {at}")
        yield ArcRecord(dict(zip(names, values, strict=True)), body)
        at = end + 1 + size


@dataclass
class WarcRecord:
    """A WARC record: its type, named fields and block."""

    kind: str
    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def dump(self) -> bytes:
        """The record without the blank lines at its end."""
        head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": self.kind, **self.fields, "Content-Length": str(len(self.block))}.items())
        return f"WARC/1.0\r\n{head}\r\n".encode() + self.block


def record_id(*parts: object) -> str:
    """An identifier that depends on the parts alone, so that a task run twice writes the same."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(map(str, parts)))}>"


def iso_date(digits: str) -> str:
    """YYYY-MM-DDThh:mm:ssZ from up to 14 digits; what is missing is the first of its kind."""
    d = re.sub(r"\D", "", digits)[:14]
    d += "19960101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_payload(block: bytes) -> bytes:
    """What follows the head of an HTTP message."""
    return block.partition(END)[2]


def convert(record: ArcRecord, first: bool, place: str) -> WarcRecord:
    """The WARC record of an ARC record: warcinfo for the version block, which is first, response for HTTP, resource for the rest.

    place: of the record among all records, for its identifier.
    """
    f = record.fields
    url, date = f["URL"], iso_date(f["Archive-date"])
    if first:
        info = f"software: corpusloom\r\nformat: WARC File Format 1.0\r\nsource: {url[11:]}\r\n".encode()
        return WarcRecord("warcinfo", {"WARC-Record-ID": record_id(place, url, date), "WARC-Date": date, "Content-Type": "application/warc-fields"}, info)
    http = record.body.startswith(b"HTTP/")
    payload = http_payload(record.body) if http else record.body
    fields = {
        "WARC-Record-ID": record_id(place, url, date, base32_sha1(record.body)),
        "WARC-Target-URI": url,
        "WARC-Date": date,
        "WARC-IP-Address": f["IP-address"],
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(record.body)}",
        "Content-Type": "application/http; msgtype=response" if http else f["Content-type"],
    }
    return WarcRecord("response" if http else "resource", fields, record.body)


def as_revisit(record: WarcRecord, refers_to: object, url: str | None) -> WarcRecord:
    """The record without its payload, as a revisit of the page with equal payload, which has the url and the same date."""
    head = record.block.partition(END)[0] + END
    fields = record.fields | {
        "WARC-Block-Digest": f"sha1:{base32_sha1(head)}",
        "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
        "WARC-Refers-To-Target-URI": _one_line(url or "-"),
        "WARC-Refers-To-Date": record.fields["WARC-Date"],
        "Refers-To-Page": quote(str(refers_to), safe=""),
    }
    return WarcRecord("revisit", fields, head)


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """The records of an archive, by their declared lengths; gzip members are opened."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            one = zlib.decompressobj(31)
            parts += [one.decompress(data), one.flush()]
            data = one.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        cut = data.find(END, at)
        if cut < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:cut].decode().split("\r\n")[1:]
        fields = {k: v for k, _, v in (x.partition(": ") for x in lines)}
        size, begin = int(fields.pop("Content-Length")), cut + len(END)
        block = data[begin : begin + size]
        if len(block) != size or data[begin + size : begin + size + 4] != END:
            raise ValueError(f"the record at byte {at} is cut off")
        yield WarcRecord(fields.pop("WARC-Type"), fields, block)
        at = begin + size + len(END)


def _page(page_id: object, url: str | None, html: bytes) -> ArcRecord:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page: {'' if page_id is None else quote(str(page_id), safe='')}\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    return ArcRecord({"URL": url or "-", "IP-address": "0.0.0.0", "Archive-date": "19960101000000", "Content-type": "text/html", "Result-code": "200"}, head + html)


def _converted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages become ARC files of bounded size, these become WARC records."""
    version, task, files = 1, TaskContext.get().partitionId(), 0
    for part in parts:
        ids, urls, refers, refer_urls = (part.column(i).to_pylist() for i in (0, 1, 3, 4))
        html = part.column(2).cast(pa.binary())
        at = 0
        while at < len(ids):
            arc, size, first = [], 0, at
            while at < len(ids) and (size < ARC_BYTES or at == first):
                body = html[at].as_py() or b""
                arc.append(_page(ids[at], urls[at], body))
                size += len(body)
                at += 1
            out, files = [], files + 1
            for i, r in enumerate(read_arc(write_arc(arc, version, f"pages-{task}-{files}.arc"))):
                w = convert(r, not i, f"{task}/{files}/{i}")
                if i and refers[first + i - 1] is not None:
                    w = as_revisit(w, refers[first + i - 1], refer_urls[first + i - 1])
                out.append(w.dump())
            version = 3 - version
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    for part in parts:
        for data in part.column(0):
            rows: list[list] = [[] for _ in names]
            for r in read_warc(data.as_py()):
                if r.kind == "warcinfo":
                    continue
                head, _, payload = r.block.partition(END)
                http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                size, digest = len(payload), r.fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if r.kind == "revisit":
                    size = int(http["Content-Length"])
                elif base32_sha1(payload) != digest:
                    raise ValueError(f"the payload of {r.fields['WARC-Record-ID']} differs from its digest")
                url, refers = r.fields["WARC-Target-URI"], r.fields.get("Refers-To-Page")
                for column, x in zip(rows, (unquote(http["X-Page"]) or None, size, digest, r.kind, refers and unquote(refers), None if url == "-" else url), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)


def revisits(pages: DataFrame) -> DataFrame:
    """payload_sha1, response (the largest page_id) and response_url of the payloads that several rows have."""
    top = F.max(F.struct("page_id", "url"))
    return (
        pages.select("page_id", "url", F.sha1(F.coalesce("html", F.lit(""))).alias("payload_sha1"))
        .groupBy("payload_sha1").agg(top.alias("top"), F.count("*").alias("n"))
        .where("n > 1").select("payload_sha1", F.col("top.page_id").alias("response"), F.col("top.url").alias("response_url"))
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes a WARC record for each page to gzip archives of bounded size under a path.

    Only payloads that come several times are joined; where they are few they are broadcast, and the pages aren't shuffled.
    """
    pages = pages.select("page_id", "url", "html")
    size = pages.select(F.avg(F.coalesce(F.octet_length("html"), F.lit(0))).alias("n")).first()["n"] or 0
    same = small(written(revisits(pages), "revisits"))
    refers = F.when(F.col("response").eqNullSafe(F.col("page_id")), F.lit(None)).otherwise(F.col("response")).alias("refers_to")
    rows = pages.withColumn("payload_sha1", F.sha1(F.coalesce("html", F.lit("")))).join(same, "payload_sha1", "left").select("page_id", "url", "html", refers, "response_url")
    records = rows.mapInArrow(_converted, "record binary")
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", int(max(50, ARCHIVE_BYTES // (size + 600))))
        .text(path)
    )


def read_archives(spark: SparkSession, path: str, page_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of each record under a path."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = rows.mapInArrow(_read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")
    return found.withColumns({c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, pages.schema["page_id"].dataType.simpleString())
