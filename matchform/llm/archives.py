"""Web archives: ARC files of either version are converted to WARC, with revisits for repeated payloads.

An ARC file opens with a version block: a ``filedesc`` header line, a line with the version, and a line that names
the fields of the header lines that follow. Each record has such a line, with the declared length of its document
last, and the document. Every record is a gzip member of its own, in ARC and in WARC, so files are read and written
record by record. What ARC lacks is synthesised: record ids by hash of the record's own fields, timestamps from the
14 digits, types from the URL and content type, digests from block and payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from matchform.llm.texts import NO_ID, column_of
from matchform.session import checkpointed, ensure_checkpoint_dir

# The field lines of the two versions of ARC.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
# An archive is closed when it holds this many bytes.
ARCHIVE_BYTES = 64 << 20
LEVEL = 4


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(path: str):
    """The file system of a path, whatever its scheme, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def members(path: str) -> Iterator[bytes]:
    """The contents of a file's gzip members, one at a time."""
    system, place = _open(path)
    with system.open_input_stream(place, compression=None) as stream:
        rest, unpack, parts = b"", zlib.decompressobj(31), []
        while rest or (rest := stream.read(1 << 20)):
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []
        if any(parts):
            raise ValueError(f"{path} ends inside a record")


class Writer:
    """Archives of bounded size in a folder; names are the attempt's own, so a repeated task overwrites nothing."""

    def __init__(self, folder: str, ending: str, opening: Callable[[str], bytes]):
        task = TaskContext.get()
        self.stem = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}"
        self.ending, self.opening, self.number, self.size, self.stream = ending, opening, 0, 0, None

    def add(self, record: bytes) -> tuple[str, int]:
        """Append a record; its file and place in it."""
        if self.stream is None or self.size > ARCHIVE_BYTES:
            self.close()
            self.path = f"{self.stem}-{self.number}.{self.ending}"
            system, place = _open(self.path)
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
            self.stream, self.size, self.place = system.open_output_stream(place, compression=None), 0, 0
            self.number += 1
            self._write(self.opening(self.path))
        self._write(record)
        self.place += 1
        return self.path, self.place - 1

    def _write(self, record: bytes) -> None:
        pack = zlib.compressobj(LEVEL, wbits=31)
        data = pack.compress(record) + pack.flush()
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    document: bytes

    @property
    def record_id(self) -> str:
        content = hashlib.sha1(self.document).hexdigest()
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((self.url, self.date, content)))}>"

    @property
    def parts(self) -> tuple[bytes, bytes]:
        """The HTTP head with its empty line, and the payload; a document without a head is all payload."""
        if not self.document.startswith(b"HTTP/"):
            return b"", self.document
        head, gap, body = self.document.partition(b"\r\n\r\n")
        return head + gap, body


def arc_opening(version: int, path: str) -> bytes:
    name = path.rsplit("/", 1)[1]
    block = f"{version} 0 matchform\n{ARC_FIELDS[version]}\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 20100101000000 text/plain{extra} {len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, content_type: str, document: bytes, name: str = "-") -> bytes:
    extra = f" 200 {base32_sha1(document)} - 0 {name}" if version == 2 else ""
    return f"{url} {ip} {date} {content_type}{extra} {len(document)}\n".encode() + document + b"\n"


def read_arc(path: str) -> Iterator[ArcRecord]:
    """The records of an ARC file; the version block's field line says how header lines are read."""
    names = None
    for member in members(path):
        line, _, rest = member.lstrip(b"\n").partition(b"\n")
        if names is None:
            _, fields, *_ = rest.split(b"\n")
            names = fields.decode().split()
            if " ".join(names) not in ARC_FIELDS.values() or not line.startswith(b"filedesc://"):
                raise ValueError(f"{path} is no ARC file of version 1 or 2")
            continue
        # A URL may hold spaces; the other fields hold none.
        values = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        field = dict(zip(names, values))
        length = int(field["Archive-length"])
        if len(values) != len(names) or len(rest) < length:
            raise ValueError(f"{path}: a record does not have its declared length")
        yield ArcRecord(field["URL"], field["IP-address"], field["Archive-date"], field["Content-type"], rest[:length])


def iso_date(digits: str) -> str:
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(record: ArcRecord, refers: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record; a revisit of the record with the id, URL and date given keeps the HTTP head only."""
    head, payload = record.parts
    http = bool(head)
    block = record.document if refers is None else head
    kind = "revisit" if refers is not None else "response" if http or not record.url.startswith("dns:") else "resource"
    lines = [
        "WARC/1.0",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record.record_id}",
        f"WARC-Date: {iso_date(record.date)}",
        f"WARC-Target-URI: {record.url}",
        f"WARC-IP-Address: {record.ip}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Type: {'application/http; msgtype=response' if http else record.content_type}",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        names = ("WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date")
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", *(f"{n}: {v}" for n, v in zip(names, refers))]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_opening(path: str) -> bytes:
    body = b"software: matchform\r\nformat: WARC File Format 1.0\r\n"
    name = path.rsplit("/", 1)[1]
    lines = ["WARC/1.0", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date: 2010-01-01T00:00:00Z",
             f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_warc(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of a WARC file."""
    for member in members(path):
        head, _, rest = member.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        length = int(fields["Content-Length"])
        if not first.startswith("WARC/") or len(rest) < length:
            raise ValueError(f"{path}: a record does not have its declared length")
        yield fields, rest[:length]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list]]:
    for batch in batches:
        more = column_of(batch, "revisits").to_pylist() if "revisits" in batch.schema.names else [None] * batch.num_rows
        yield from zip(column_of(batch, "path").to_pylist(), more)


def _one_each(paths: DataFrame) -> DataFrame:
    """Archives dealt out over the tasks."""
    return paths.repartition(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/archives-{uuid.uuid4()}"


def write_arc(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ARC files, by turns of either version; ``path`` and ``records`` of each.

    A document is an HTTP response whose head carries the page id. Null html is an empty payload, a null
    URL is ``urn:page:`` and the id, spaces and controls in it are percent-encoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1 + TaskContext.get().partitionId() % 2
        writer, counts = Writer(folder, "arc.gz", lambda path: arc_opening(version, path)), {}
        for batch in batches:
            columns = [column_of(batch, n).to_pylist() for n in ("page_id", "url", "date", "ip")] + [column_of(batch, "html").cast(pa.binary()).to_pylist()]
            for page, url, date, ip, html in zip(*columns):
                html = html or b""
                url = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or f"urn:page:{page}")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(html)}\r\n\r\n"
                path, _ = writer.add(arc_record(version, url, ip, date, "text/html", head.encode() + html))
                counts[path] = counts.get(path, 0) + 1
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["path", "records"])

    # The pages tell no time or address: a page's id counts the seconds from a fixed day.
    second = F.timestamp_seconds(F.lit(1262304000) + F.coalesce(F.pmod("page_id", F.lit(10**9)), F.lit(0)))
    source = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"),
        F.date_format(second, "yyyyMMddHHmmss").alias("date"), F.lit("0.0.0.0").alias("ip"),
    )
    return checkpointed(source.mapInArrow(run, "path string, records long"))


def _page_id(head: bytes) -> int | None:
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b": ")
        if name == b"X-Page-Id" and value:
            return int(value)
    return None


RECORDS = "path string, place long, page_id long, payload_bytes long, digest string, record_id string, url string, date string"


def arc_records(paths: DataFrame) -> DataFrame:
    """What conversion needs to know of every record of the ARC files before it writes any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, _ in _paths(batches):
            rows = []
            for place, record in enumerate(read_arc(path)):
                head, payload = record.parts
                rows.append((path, place, _page_id(head), len(payload), base32_sha1(payload), record.record_id, record.url, iso_date(record.date)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in RECORDS.split(", ")])

    return checkpointed(_one_each(paths.select("path")).mapInArrow(run, RECORDS))


def convert(paths: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Convert ARC files (``path``) to WARC files in ``folder``; their ``path`` and ``records``.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest page id is
    a response (of equal ids the first by path and place; without an id the last), and the others revisit it.
    """
    records = arc_records(paths)
    order = F.struct(F.coalesce("page_id", F.lit(NO_ID)).alias("id"), "path", "place", "record_id", "url", "date")
    firsts = records.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "payload_bytes").agg(F.min(order).alias("of"), F.count(F.lit(1)).alias("times"))
    # Written first, so that the join reads two plain shuffles and a payload that many records have can be split.
    firsts = checkpointed(firsts.where("times > 1").select("digest", "payload_bytes", "of"))
    revisits = (
        records.select("path", "place", "digest", "payload_bytes").join(firsts, ["digest", "payload_bytes"])
        .where("path != of.path or place != of.place")
        .groupBy("path").agg(F.collect_list(F.struct("place", "of.record_id", "of.url", "of.date")).alias("revisits"))
    )
    # An archive's own revisits are bounded by its size. Written, so that the files are dealt out anew and not as the join left them.
    todo = checkpointed(paths.select("path").join(revisits, "path", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, counts = Writer(folder, "warc.gz", warc_opening), {}
        for path, revisits in _paths(batches):
            refers = {r["place"]: (r["record_id"], r["url"], r["date"]) for r in revisits or []}
            for place, record in enumerate(read_arc(path)):
                target, _ = writer.add(warc_record(record, refers.get(place)))
                counts[target] = counts.get(target, 0) + 1
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["path", "records"])

    return checkpointed(_one_each(todo).mapInArrow(run, "path string, records long"))


def pages_in(paths: DataFrame) -> DataFrame:
    """A row for each response and revisit of the WARC files; ``refers_to`` is the response's page id.

    A response's digest and length are taken from its payload and must agree with its header; a revisit's
    come from its headers, which describe the full payload.
    """
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "record_id": pa.string(), "refers": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, _ in _paths(batches):
            rows = []
            for fields, block in read_warc(path):
                if fields["WARC-Type"] not in ("response", "revisit"):
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                size, digest = len(payload), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "revisit":
                    size = int(next(line for line in head.split(b"\r\n") if line.startswith(b"Content-Length: ")).split()[1])
                elif base32_sha1(payload) != digest:
                    raise ValueError(f"{path}: a payload does not have its digest")
                rows.append((_page_id(head), size, digest, fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To")))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))

    names = {pa.int64(): "long", pa.string(): "string"}
    found = checkpointed(_one_each(paths.select("path")).mapInArrow(run, ", ".join(f"{n} {names[k]}" for n, k in kinds.items())))
    wanted = found.where("refers is not null").select(F.col("refers").alias("record_id")).distinct()
    target = found.where("record_type = 'response'").select("record_id", "page_id").join(wanted, "record_id")
    target = checkpointed(target.groupBy(F.col("record_id").alias("refers")).agg(F.min("page_id").alias("refers_to")))
    return found.join(target, "refers", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archived(pages: DataFrame) -> DataFrame:
    """Pages through ARC and WARC files and back: a row for each page.

    Repeated rows are records of their own, and all but one of equal payloads are revisits; ids may be
    null; an empty table gives an empty result; other columns are ignored. The files stay in the shared
    checkpoint folder.
    """
    folder = work_folder(pages.sparkSession)
    return pages_in(convert(write_arc(pages, f"{folder}/arc"), f"{folder}/warc"))
