"""Legacy archives: pages as ARC files, ARC to WARC conversion, and reading WARC back.

An ARC file opens with a version block whose last line names the fields of the header lines (five in version 1, ten in
version 2); each record is a header line and as many bytes as its last field declares. The converter reads those, and
gives each record a WARC identifier (UUID of archive name and offset), timestamp, type and digests.

Files are gzip members, one per record. Tasks write them to a shared folder under names of their own attempt and report
what they finished, so a lost task leaves only unlisted files behind.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import cut, free, partitions, remove, scratch

#: The field lines of the two ARC versions and the revisit profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CRAWLED = "20240101000000"
FILE_BYTES = 16 << 20
_SPACE = re.compile(r"[\x00-\x20\x7f]")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member; a plain file is one member."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        yield 0, data
        return
    while at < len(view):
        z, parts, to = zlib.decompressobj(31), [], at
        while not z.eof:
            if to >= len(view):
                raise ValueError(f"the member at byte {at} is cut short")
            parts.append(z.decompress(view[to : to + 16384]))
            to += min(16384, len(view) - to)
        to -= len(z.unused_data)
        yield at, b"".join(parts)
        at = to


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _read(path: str) -> bytes:
    system, inner = _fs(path)
    with system.open_input_stream(inner) as f:
        return f.read()


class _Files:
    """Members written one after another to files of bounded size."""

    def __init__(self, folder: str, suffix: str):
        from pyspark import TaskContext

        c = TaskContext.get()
        self.stem = f"{folder}/{c.partitionId():06d}-{c.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        self.suffix, self.number, self.out, self.done, self.size = suffix, 0, None, [], 0

    def open(self) -> str:
        name = f"{self.stem}-{self.number:04d}{self.suffix}"
        system, inner = _fs(name)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out, self.size, self.number = system.open_output_stream(inner, compression=None), 0, self.number + 1
        self.done.append(name)
        return name

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _manifest(names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])


# ---- ARC


def arc_opening(name: str, version: int, date: str = CRAWLED) -> bytes:
    body = f"{version} 0 tidewire\n{ARC_FIELDS[version]}\n\n"
    rest = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {rest}{len(body)}\n{body}".encode()


def arc_record(url: str, content: bytes, version: int, offset: int, name: str, date: str = CRAWLED) -> bytes:
    rest = "" if version == 1 else f"200 {hashlib.md5(content).hexdigest()} - {offset} {name} "
    return f"{url} 0.0.0.0 {date} text/html {rest}{len(content)}\n".encode() + content + b"\n"


def parse_arc(data: bytes, name: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, content) of each record but the version block, by the fields that the block names."""
    fields: list[str] | None = None
    for start, block in members(data):
        at = 0
        while at < len(block):
            line_end = block.index(b"\n", at)
            line = block[at:line_end].decode("utf-8", "replace")
            if not line.strip():  # the line between records
                at = line_end + 1
                continue
            if fields is None:  # the version block: its header has the fields of its own version
                length = int(line.rsplit(" ", 1)[1])
                body = block[line_end + 1 : line_end + 1 + length].decode("utf-8", "replace").split("\n")
                if not line.startswith("filedesc:") or len(body) < 2:
                    raise ValueError(f"{name} has no version block")
                fields = body[1].split(" ")
            else:
                values = line.rsplit(" ", len(fields) - 1)
                if len(values) != len(fields):
                    raise ValueError(f"{name}: the header line at byte {start + at} has {len(values)} of {len(fields)} fields")
                header = dict(zip(fields, values, strict=True))
                length = int(header["Archive-length"])
                content = block[line_end + 1 : line_end + 1 + length]
                if len(content) != length:
                    raise ValueError(f"{name}: the record at byte {start + at} is cut short")
                yield start + at, header, content
            at = line_end + 1 + length


def http_response(page_id: int | None, payload: bytes) -> bytes:
    named = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def split_http(content: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head, header fields in lower case, payload."""
    head, _, payload = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return head + b"\r\n\r\n", {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def write_arc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages as ARC files below folder, even partitions in version 1, odd ones in version 2 -> (file).

    The page's key goes into the HTTP head. Null html is empty, a null url is "-"; white space in urls is escaped.
    """
    wanted = pages.select(F.col(key).cast("long").alias("k"), F.col(url).alias("u"), F.col(html).alias("h"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2
        files = _Files(folder, ".arc.gz")
        name = ""
        for batch in it:
            for k, u, h in zip(*batch.columns, strict=True):
                if files.out is None or files.size > FILE_BYTES:
                    files.close()
                    name = files.open().rpartition("/")[2]
                    files.write(member(arc_opening(name, version)))
                link = _SPACE.sub(lambda m: f"%{ord(m[0]):02X}", u.as_py() or "") or "-"
                content = http_response(k.as_py(), (h.as_py() or "").encode())
                files.write(member(arc_record(link, content, version, files.size, name)))
        files.close()
        if files.done:
            yield _manifest(files.done)

    return cut(wanted.mapInArrow(run, "file string"), "arc-files")


def index_arc(files: DataFrame) -> DataFrame:
    """(file) -> (file, offset, page_id, payload_bytes, payload_digest) of each record."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name in batch.column(0).to_pylist():
                rows = []
                for offset, _, content in parse_arc(_read(name), name):
                    _, head, payload = split_http(content)
                    rows.append((name, offset, int(head["x-page-id"]) if "x-page-id" in head else None, len(payload), sha1_base32(payload)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "offset", "page_id", "payload_bytes", "payload_digest"])

    n = partitions(files.sparkSession)
    return files.repartition(n, "file").mapInArrow(run, "file string, offset long, page_id long, payload_bytes long, payload_digest string")


def choose_originals(index: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Adds of_file and of_offset: the record that this one revisits, null for responses.

    Of records with equal payloads of at least revisit_from bytes, that of the largest page_id (then file and offset) is
    the response. Records without a page_id come last.
    """
    rank = F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "file", "offset")
    best = index.where(F.col("payload_bytes") >= revisit_from).groupBy("payload_digest", "payload_bytes").agg(F.max(rank).alias("best"), F.count("*").alias("n")).where("n > 1")
    joined = index.join(best, ["payload_digest", "payload_bytes"], "left")
    other = F.col("best").isNotNull() & ~((F.col("best.file") == F.col("file")) & (F.col("best.offset") == F.col("offset")))
    return joined.select("file", "offset", F.when(other, F.col("best.file")).alias("of_file"), F.when(other, F.col("best.offset")).alias("of_offset"))


# ---- WARC


def record_id(file: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file.rpartition("/")[2]}#{offset}')}>"


def warc_date(arc_date: str) -> str:
    """ARC dates have 14 digits, old ones 12 or 8."""
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def convert_record(file: str, offset: int, header: dict[str, str], content: bytes, original: str | None) -> bytes:
    head, _, payload = split_http(content)
    fields = [
        ("WARC-Type", "revisit" if original else "response"), ("WARC-Record-ID", record_id(file, offset)), ("WARC-Date", warc_date(header["Archive-date"])),
        ("WARC-Target-URI", header["URL"]), ("WARC-IP-Address", header["IP-address"]), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if original:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", original)]
    return warc_record(fields, head if original else content)


def convert_arc(chosen: DataFrame, folder: str) -> DataFrame:
    """(file, offset, of_file, of_offset) for every record of the ARC files -> WARC files below folder (file)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, ".warc.gz")
        now, wanted = None, {}

        def flush():
            if now is None:
                return
            if files.out is None or files.size > FILE_BYTES:
                files.close()
                name = files.open().rpartition("/")[2]
                info = f"software: tidewire\r\nformat: WARC File Format 1.0\r\nfilename: {name}\r\n".encode()
                files.write(member(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, 0)), ("WARC-Date", warc_date(CRAWLED)), ("Content-Type", "application/warc-fields")], info)))
            for offset, header, content in parse_arc(_read(now), now):
                files.write(member(convert_record(now, offset, header, content, wanted[offset])))

        for batch in it:
            for file, offset, of_file, of_offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != now:
                    flush()
                    now, wanted = file, {}
                wanted[offset] = None if of_file is None else record_id(of_file, of_offset)
        flush()
        files.close()
        if files.done:
            yield _manifest(files.done)

    n = partitions(chosen.sparkSession)
    return cut(chosen.select("file", "offset", "of_file", "of_offset").repartition(n, "file").sortWithinPartitions("file", "offset").mapInArrow(run, "file string"), "warc-files")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for _, block in members(data):
        at = 0
        while at < len(block):
            end = block.index(b"\r\n\r\n", at)
            lines = block[at:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no WARC record here")
            header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = int(header["content-length"])
            yield header, block[end + 4 : end + 4 + length]
            at = end + 4 + length + 4


def read_warc(files: DataFrame) -> DataFrame:
    """(file) -> record_id, record_type, url, page_id, payload_bytes, payload_digest, refers_to_id, html of responses and revisits.

    A revisit's html is null. Digests of blocks and of whole payloads are checked; a wrong one is an error.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("html", pa.string())]
        schema = pa.schema(kinds)
        for batch in it:
            for name in batch.column(0).to_pylist():
                rows = []
                for h, block in parse_warc(_read(name)):
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    _, head, payload = split_http(block)
                    digest, whole = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"] == "response"
                    if h["warc-block-digest"] != f"sha1:{sha1_base32(block)}" or whole and digest != sha1_base32(payload):
                        raise ValueError(f"{name}: {h['warc-record-id']} has another digest than its header says")
                    rows.append((h["warc-record-id"], h["warc-type"], h["warc-target-uri"], int(head["x-page-id"]) if "x-page-id" in head else None, len(payload) if whole else int(head["content-length"]), digest, h.get("warc-refers-to"), payload.decode("utf-8", "replace") if whole else None))
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    n = partitions(files.sparkSession)
    return files.repartition(n, "file").mapInArrow(run, "record_id string, record_type string, url string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, html string")


def archive(spark: SparkSession, pages: DataFrame, revisit_from: int = 0, folder: str | None = None) -> DataFrame:
    """Pages -> ARC -> WARC files below folder, else below a scratch folder (file); the ARC files are deleted once they are converted.

    Repeated rows, null keys and empty payloads get records of their own; a null url is "-"; other columns of the pages
    are not archived, whatever their names; an empty table gives no files.
    """
    legacy = scratch(spark, "arc")
    files = write_arc(pages, legacy)
    index = cut(index_arc(files), "arc-index")
    out = convert_arc(choose_originals(index, revisit_from), folder or scratch(spark, "warc"))
    free(files, index)
    remove(spark, legacy)
    return out


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Every page by way of ARC and WARC files, which are deleted once they are read back.

    Null html has an empty payload; a null page_id stays null and is revisited only where all equal payloads have none.
    Rows that repeat revisit one of them. Payloads of any length are read record by record.
    """
    folder = scratch(spark, "warc")
    files = archive(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), folder=folder)
    records = cut(read_warc(files).drop("html", "url"), "records")
    free(files)
    remove(spark, folder)
    originals = records.where("record_type = 'response'")
    # only revisits are joined, so that no null key gathers all responses
    revisits = records.where("record_type = 'revisit'").join(originals.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")), "refers_to_id", "left")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return originals.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionAll(revisits.select(*columns))
