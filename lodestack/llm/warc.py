"""WARC records in ZIP archives: a writer with revisits, and a reader by range reads without extraction.

An archive is a ZIP whose members are stored, not deflated: `archive/*.warc.gz` (a gzip member a record) or
`archive/*.warc`, `indexes/*.cdxj` (a line a record: sort key of the URL, time, and JSON with offset, length and
filename; gzipped or not) and `datapackage.json`. The reader finds members by the central directory, that of ZIP64
too, reads the indexes in parts, deals the records they name out by archive and offset, and fetches each run of
neighbouring records by one range read. Archives of other writers are read alike.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import freeing, in_small_batches, lookup, new_folder, pieces_of, stored

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Date of the records; the tables have none.
DATE = "2024-01-01T00:00:00Z"
#: Bytes of an index that one task reads.
INDEX_SPAN = 8 << 20
#: Bytes fetched at a time, and bytes of an archive that are read by one task in a row.
SPAN, REGION = 4 << 20, 64 << 20
#: Longest line of an index that is looked for at a time.
LINE = 64 << 10

# Fixed values of the ZIP format: signatures, extra field and layouts.
END, END64_LOCATOR, END64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\7", b"PK\6\6", b"PK\1\2", b"PK\3\4"
END_LAYOUT = struct.Struct("<4s4H2LH")
LOCATOR_LAYOUT = struct.Struct("<4sLQL")
END64_LAYOUT = struct.Struct("<4sQ2H2L4Q")
CENTRAL_LAYOUT = struct.Struct("<4s6H3L5H2L")
LOCAL_LAYOUT = struct.Struct("<4s5H3L2H")
EXTRA_ZIP64 = 1
STORED, DEFLATED = 0, 8
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


# ---------------------------------------------------------------- ZIP directory


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


class Archive:
    """The members of a ZIP archive, read by ranges of a random-access source."""

    def __init__(self, source) -> None:
        self.source = source
        self.members = {m.name: m for m in self.directory()}

    def at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def directory(self) -> Iterator[Member]:
        size = self.source.size()
        tail_at = max(0, size - END_LAYOUT.size - FULL16)  # a comment of up to 65,535 bytes may follow
        tail = self.at(tail_at, size - tail_at)
        found = tail.rfind(END)
        if found < 0:
            raise ValueError("not a ZIP archive: no end of central directory")
        *_, count, length, offset, _ = END_LAYOUT.unpack_from(tail, found)
        end = tail_at + found
        if FULL16 == count or FULL32 in (length, offset):
            signature, _, where, _ = LOCATOR_LAYOUT.unpack(self.at(end - LOCATOR_LAYOUT.size, LOCATOR_LAYOUT.size))
            if signature != END64_LOCATOR:
                raise ValueError("no ZIP64 locator")
            signature, *_, count, length, offset = END64_LAYOUT.unpack(self.at(where, END64_LAYOUT.size))
            if signature != END64:
                raise ValueError("no ZIP64 end of central directory")
        data, k = self.at(offset, length), 0
        for _ in range(count):
            signature, _, _, _, method, _, _, _, packed, plain, n, e, c, _, _, _, header = CENTRAL_LAYOUT.unpack_from(data, k)
            if signature != CENTRAL:
                raise ValueError("broken central directory")
            k += CENTRAL_LAYOUT.size
            name, extra = data[k : k + n].decode(), data[k + n : k + n + e]
            k += n + e + c
            while len(extra) >= 4:
                tag, m = struct.unpack_from("<2H", extra)
                if tag == EXTRA_ZIP64:  # holds only those numbers that don't fit above, in this order
                    wide = iter(struct.unpack_from(f"<{m // 8}Q", extra, 4))
                    plain = next(wide) if plain == FULL32 else plain
                    packed = next(wide) if packed == FULL32 else packed
                    header = next(wide) if header == FULL32 else header
                extra = extra[4 + m :]
            yield Member(name, method, packed, header)

    def begin(self, name: str, method: int = STORED) -> int:
        """Where a stored member's bytes begin."""
        m = self.members[name]
        if m.method != method:
            raise ValueError(f"{name} isn't stored")
        signature, *_, n, e = LOCAL_LAYOUT.unpack(self.at(m.header, LOCAL_LAYOUT.size))
        if signature != LOCAL:
            raise ValueError(f"{name}: broken local header")
        return m.header + LOCAL_LAYOUT.size + n + e

    def read(self, name: str) -> bytes:
        """A whole member; small ones may be deflated."""
        m = self.members[name]
        data = self.at(self.begin(name, DEFLATED if m.method == DEFLATED else STORED), m.size)
        return zlib.decompress(data, -15) if m.method == DEFLATED else data

    def lines(self, name: str, first: int, end: int) -> Iterator[bytes]:
        """Lines of a stored member that begin from first (included) to end (not included)."""
        begin, size = self.begin(name), self.members[name].size
        at = first
        if first:  # a line begins after a line break
            data = self.at(begin + first - 1, min(size, first + LINE) - first + 1)
            while b"\n" not in data and first - 1 + len(data) < size:
                data += self.at(begin + first - 1 + len(data), min(LINE, size - first + 1 - len(data)))
            if b"\n" not in data:
                return
            at = first + data.index(b"\n")
        if at >= end:
            return
        data = self.at(begin + at, end - at)
        while not data.endswith(b"\n") and at + len(data) < size:
            more = self.at(begin + at + len(data), min(LINE, size - at - len(data)))
            cut = more.find(b"\n")
            data += more if cut < 0 else more[: cut + 1]
        yield from data.splitlines()


# ---------------------------------------------------------------- records


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    """The page of a record that write_archives made; null for others."""
    found = re.fullmatch(r"<urn:page:(-?\d*)>", value or "")
    return int(found[1]) if found and found[1] else None


def sort_key(url: str) -> str:
    """The URL as indexes sort it: the host's parts from the last to the first, then path and query, in lower case."""
    found = re.match(r"(?i)https?://(?:www\d*\.)?([^/?#:]+)(:\d+)?([^#]*)", url)
    if not found:
        return url.lower()
    path = found[3] if found[3].startswith("/") else f"/{found[3]}"
    return f"{','.join(found[1].split('.')[::-1])}{found[2] or ''}){path}".lower()


def target_of(page_id: int | None, url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or urn(page_id)[1:-1])


def index_line(page_id: int | None, url: str | None, payload: bytes, revisit: bool, offset: int, length: int) -> bytes:
    target = target_of(page_id, url)
    about = {"url": target, "mime": "warc/revisit" if revisit else "text/html", "status": "200", "digest": f"sha1:{digest_of(payload)}"}
    about |= {"length": str(length), "offset": str(offset), "filename": DATA.rpartition("/")[2]}
    time = re.sub(r"\D", "", DATE)
    return f"{sort_key(target)} {time} {json.dumps(about, ensure_ascii=False)}\n".encode()


def headers(first: str, pairs: dict[str, str]) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in pairs.items()), "\r\n"]).encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the payload, or, if it refers to another page, a revisit with its HTTP headers only."""
    revisit = refers_to is not None
    block = headers("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))})
    block += b"" if revisit else payload
    about = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": urn(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": target_of(page_id, url),
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        about["WARC-Refers-To"] = urn(refers_to)
        about["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return headers("WARC/1.1", about | {"Content-Length": str(len(block))}) + block + b"\r\n\r\n"


def parsed(data: bytes, strict: bool = True) -> dict:
    """A record's fields. If strict, a response's payload must agree with its SHA-1 and its HTTP length, where it has them.

    digest_ok tells whether the payload has the record's SHA-1; null for other digests and for records without payload.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    about = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    block = rest[: int(about["content-length"])]
    revisit = about["warc-type"] == "revisit"
    http, payload = b"", block
    if about.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length: *(\d+)", http)
    length = (int(told[1]) if told else None) if revisit else len(payload)
    digest = about.get("warc-payload-digest")
    sha1 = bool(digest) and digest.lower().startswith("sha1:") and not revisit
    ok = digest_of(payload) == digest[5:].upper() if sha1 else None
    if strict and (ok is False or (sha1 and told and int(told[1]) != length)):
        raise ValueError(f"{about.get('warc-record-id')}: payload differs from its digest or length")
    return {
        "record_id": about.get("warc-record-id"),
        "page_id": page_of(about.get("warc-record-id")),
        "date": about.get("warc-date"),
        "payload_bytes": length,
        "payload_digest": re.sub("(?i)^sha1:", "", digest) if digest else None,
        "digest_ok": ok,
        "record_type": about["warc-type"],
        "refers_to_id": about.get("warc-refers-to"),
        "refers_to": page_of(about.get("warc-refers-to")),
        "url": about.get("warc-target-uri", "").strip("<>") or None,
        "payload": None if revisit else payload,
    }


# ---------------------------------------------------------------- writing


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload another page of a larger id has too."""
    keys = stored(
        pages.select("page_id", payload_key().alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes")),
        "payloads",
    )
    groups = keys.where(F.col("bytes") >= min_bytes).groupBy("digest")
    groups = groups.agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    found = lookup(keys.select("page_id", "digest"), groups, "digest", "n")
    found = found.where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return stored(found.select("page_id", "digest", "refers_to").distinct(), "revisits")


def payload_key():
    return F.unhex(F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes an archive a partition and returns the manifest: uri, records.

    Of pages with equal payloads of at least min_bytes, that with the largest page_id is a response and the others
    are revisits of it; rows that share payload and page_id have the same type. An archive has a name of its own for
    each attempt of a task, and the manifest names those that count.
    """
    old = revisits(pages, min_bytes)
    # The planner knows the stored table's size: a small one is broadcast, else both sides are shuffled.
    left = pages.select("page_id", "url", "html", payload_key().alias("key"))
    joined = left.join(
        old.withColumnRenamed("page_id", "old_id"),
        left["page_id"].eqNullSafe(F.col("old_id")) & (left["key"] == F.col("digest")),
        "left",
    ).select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, zipped, data, index, at = f"{folder}/{uuid.uuid4().hex}.wacz", None, None, None, [], 0
        for batch in batches:
            for piece in pieces_of(batch, "html"):
                if out is None:
                    files, path = fs.FileSystem.from_uri(uri)
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(path, compression=None)
                    zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    data = zipped.open(DATA, "w", force_zip64=True)
                columns = (piece.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))
                for page_id, url, html, refers_to in zip(*columns, strict=True):
                    packed = gzip.compress(record(page_id, url, (html or "").encode(), refers_to), 6, mtime=0)
                    data.write(packed)
                    index.append(index_line(page_id, url, (html or "").encode(), refers_to is not None, at, len(packed)))
                    at += len(packed)
        if out is not None:
            data.close()
            zipped.writestr(INDEX, b"".join(sorted(index)))
            zipped.writestr(PACKAGE, json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
            zipped.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(index)], pa.int64())], ["uri", "records"])

    return stored(in_small_batches(joined).mapInArrow(write, "uri string, records long"), "archives")


# ---------------------------------------------------------------- reading


RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("date", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("digest_ok", pa.bool_()),
        ("record_type", pa.string()),
        ("refers_to_id", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
    ]
)
RECORD_SQL = (
    "record_id string, page_id long, date string, payload_bytes long, payload_digest string, digest_ok boolean, "
    "record_type string, refers_to_id string, refers_to long, url string"
)


def index_parts(archives: DataFrame) -> DataFrame:
    """uri, member, first, end: the archives' indexes in parts of INDEX_SPAN bytes; packed ones whole, with an end of -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri in batch.column("uri").to_pylist():
                files, path = fs.FileSystem.from_uri(uri)
                with files.open_input_file(path) as source:
                    for m in Archive(source).members.values():
                        if not re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", m.name):
                            continue
                        if m.name.endswith(".gz") or m.method != STORED:
                            rows.append((uri, m.name, 0, -1))
                        else:
                            rows += [(uri, m.name, a, min(a + INDEX_SPAN, m.size)) for a in range(0, m.size, INDEX_SPAN)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["uri", "member", "first", "end"])

    tasks = archives.sparkSession.sparkContext.defaultParallelism * 4
    return archives.select("uri").repartition(tasks, "uri").mapInArrow(run, "uri string, member string, first long, end long")


def index_entries(archives: DataFrame) -> DataFrame:
    """uri, filename, offset, length: a row a line of the archives' indexes, each place once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                files, path = fs.FileSystem.from_uri(part["uri"])
                with files.open_input_file(path) as source:
                    archive = Archive(source)
                    if part["end"] >= 0:
                        lines = archive.lines(part["member"], part["first"], part["end"])
                    else:
                        data = archive.read(part["member"])
                        lines = gzip.GzipFile(fileobj=io.BytesIO(data)) if part["member"].endswith(".gz") else data.splitlines()
                    rows = []
                    for line in lines:
                        fields = line.strip().split(b" ", 2)
                        if len(fields) == 3 and fields[2].startswith(b"{"):
                            about = json.loads(fields[2])
                            rows.append((part["uri"], about["filename"], int(about["offset"]), int(about["length"])))
                    columns = list(zip(*rows, strict=True)) or [[]] * 4
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["uri", "filename", "offset", "length"])

    tasks = archives.sparkSession.sparkContext.defaultParallelism * 4
    parts = index_parts(archives).repartition(tasks, "uri", "member", "first")
    return parts.mapInArrow(run, "uri string, filename string, offset long, length long").distinct()


def read_archives(archives: DataFrame, payloads: bool = True, strict: bool = True) -> DataFrame:
    """One row per record that the indexes of the archives (uri) name: see RECORD, and payload if asked for.

    Records are dealt out by archive file and region of REGION bytes, so an archive of any size is read by many tasks,
    and sorted by offset, so neighbours are fetched together. A revisit's payload is null; its length is what its HTTP
    headers say of the payload that it refers to, or null. page_id and refers_to are of records that write_archives made.
    strict: a payload that differs from its SHA-1 fails the job instead of making digest_ok false.
    """
    kind = RECORD.append(pa.field("payload", pa.binary())) if payloads else RECORD

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, Archive] | None = None
        for batch in batches:
            todo, k = batch.to_pylist(), 0
            while k < len(todo):
                first, to = todo[k], k + 1
                same = lambda x: (x["uri"], x["filename"]) == (first["uri"], first["filename"])  # noqa: B023, E731
                while to < len(todo) and same(todo[to]) and todo[to]["offset"] + todo[to]["length"] - first["offset"] <= SPAN:
                    to += 1
                if held is None or held[0] != first["uri"]:
                    if held:
                        held[1].source.close()
                    files, path = fs.FileSystem.from_uri(first["uri"])
                    held = first["uri"], Archive(files.open_input_file(path))
                archive, low = held[1], first["offset"]
                member = first["filename"] if first["filename"].startswith("archive/") else f"archive/{first['filename']}"
                data = archive.at(archive.begin(member) + low, max(x["offset"] + x["length"] for x in todo[k:to]) - low)
                rows = []
                for x in todo[k:to]:
                    one = data[x["offset"] - low : x["offset"] - low + x["length"]]
                    made = parsed(zlib.decompress(one, 31) if member.endswith(".gz") else one, strict)
                    rows.append({n: made[n] for n in kind.names})
                yield pa.RecordBatch.from_pylist(rows, kind)
                k = to
        if held:
            held[1].source.close()

    # A number of partitions that adaptive execution leaves as it is: the rows are few, what they name is not.
    tasks = archives.sparkSession.sparkContext.defaultParallelism * 4
    region = F.floor(F.col("offset") / REGION)
    spread = index_entries(archives).repartition(tasks, "uri", "filename", region).sortWithinPartitions("uri", "filename", "offset")
    return spread.mapInArrow(freeing(read), RECORD_SQL + ", payload binary" * payloads)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) to archives and returns what reading them back gives, without payloads.

    A null html is an empty payload, a null url the record's own id, and a null page_id stays null (such a page is
    never referred to unless all ids of its payload are null, and then all are responses). An empty table gives no
    archive and no row.
    """
    return read_archives(write_archives(pages, new_folder(spark, "warc"), min_bytes), payloads=False)
