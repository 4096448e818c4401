"""WARC in ZIP packages: a writer, and a reader that range-reads records without extraction.

A package is a ZIP file with two stored (uncompressed) members: archive/data.warc.gz, where each WARC/1.1 record is a
gzip member of its own, and indexes/index.jsonl with offset and length of each record in it. The reader finds the end of
the central directory (or its ZIP64 form), locates the members, reads the index and then only ranges of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import frequent
from .shared import file_system, prepare, publish, stored

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Signatures and fields of the ZIP format (fixed values).
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    value = record.strip("<>").rpartition(":")[2]
    return None if value == "none" else int(value)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC record: response with its payload, or revisit with the HTTP head only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header (names in lower case) and payload."""
    def fields(raw: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def gzip_member(data: bytes, level: int = 4) -> bytes:
    c = zlib.compressobj(level, wbits=31)
    return c.compress(data) + c.flush()


def read_range(f, offset: int, length: int) -> bytes:
    f.seek(offset)
    data = f.read(length)
    if len(data) != length:
        raise ValueError("a range lies outside the package")
    return data


def central_directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Members by name: method, offset of the local header, stored size. Reads the tail and the directory only."""
    tail_at = max(0, size - 22 - FULL16)
    tail = read_range(f, tail_at, size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("not a ZIP package")
    count, length, begin = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == count or FULL32 in (length, begin):
        if at < 20 or tail[at - 20 : at - 16] != LOCATOR64:
            raise ValueError("the ZIP64 locator is missing")
        end = read_range(f, struct.unpack_from("<Q", tail, at - 12)[0], 56)
        if end[:4] != END64:
            raise ValueError("the ZIP64 end of directory is missing")
        count, length, begin = struct.unpack_from("<QQQ", end, 32)
    directory, members, at = read_range(f, begin, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", directory, at + 20)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:  # ZIP64 extra: the fields that are full above, in this order
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == FULL32 else plain
                packed = wide.pop(0) if packed == FULL32 else packed
                local = wide.pop(0) if local == FULL32 else local
            extra = extra[4 + n :]
        members[name] = (method, local, packed)
        at += 46 + name_n + extra_n + comment_n
    return members


def member_range(f, member: tuple[int, int, int]) -> tuple[int, int]:
    """Where the bytes of a stored member begin in the package, and how many there are."""
    method, local, length = member
    if method:
        raise ValueError("the member is compressed; only stored members can be range-read")
    head = read_range(f, local, 30)
    if head[:4] != LOCAL:
        raise ValueError("a local header is damaged")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    return local + 30 + name_n + extra_n, length


def records(f, size: int, most: int = 4 << 20):
    """(offset, record bytes) of a package's archive, read in ranges of neighbouring records."""
    members = central_directory(f, size)
    index = [json.loads(x) for x in read_range(f, *member_range(f, members[INDEX])).splitlines()]
    base, _ = member_range(f, members[ARCHIVE])
    i = 0
    while i < len(index):
        j, end = i, index[i]["offset"]
        while j < len(index) and index[j]["offset"] == end and (j == i or end + index[j]["length"] - index[i]["offset"] <= most):
            end += index[j]["length"]
            j += 1
        data = read_range(f, base + index[i]["offset"], end - index[i]["offset"])
        for entry in index[i:j]:
            a = entry["offset"] - index[i]["offset"]
            yield entry["offset"], zlib.decompress(data[a : a + entry["length"]], wbits=31)
        i = j


def write_packages(pages: DataFrame, out_dir: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[str]:
    """Write one record per row; returns the packages' paths, one per task.

    Of equal payloads of at least min_bytes bytes, the rows with the smallest id are responses and the others revisit
    them; smaller payloads are all responses. A null html is an empty payload; a null url is left out; a row without an
    id revisits the smallest id, and is a response if its group has no id at all. Repeated rows give repeated records.
    """
    spark = pages.sparkSession
    prepare(spark)
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    plain = plain.withColumn("digest", F.unhex(F.sha1("html")))
    narrow = stored(plain.select("page_id", "digest"), "payloads")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    if hot := frequent(narrow, "digest"):
        names = [F.lit(x) for x in hot]
        is_hot = F.col("digest").isin(names)
        known = narrow.where(~is_hot).join(first, "digest").unionByName(narrow.where(is_hot).join(F.broadcast(first.where(is_hot)), "digest"))
    else:
        known = narrow.join(first, "digest")
    known = known.select(F.col("page_id").alias("id2"), F.col("digest").alias("digest2"), "first_id").distinct()
    rows = plain.join(known, F.col("page_id").eqNullSafe(F.col("id2")) & (F.col("digest") == F.col("digest2"))).select("page_id", "url", "html", "first_id")

    def write(batches):
        path = f"{out_dir}/part-{TaskContext.get().partitionId():07d}.zip"
        count = 0

        def fill(out):
            nonlocal count
            lines, at = [], 0
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                with z.open(ARCHIVE, "w", force_zip64=True) as archive:
                    for batch in batches:
                        for page_id, url, html, first_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                            payload = html.encode()
                            revisit = len(payload) >= min_bytes and first_id is not None and page_id != first_id
                            data = gzip_member(make_record(page_id, url, payload, first_id, revisit))
                            archive.write(data)
                            lines.append(json.dumps({"offset": at, "length": len(data), "id": page_id}))
                            at += len(data)
                            count += 1
                z.writestr(INDEX, "\n".join(lines))

        publish(path, fill)
        yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})

    return sorted(r[0] for r in rows.mapInArrow(write, "path string, records long").collect() if r[1])


def read_packages(spark: SparkSession, paths: list[str], batch: int = 512) -> DataFrame:
    """Read all records: page_id, payload_bytes, payload_digest, record_type, refers_to, url, package, offset.

    The payload digest of a response is computed from what was read and must equal the header's.
    """
    prepare(spark)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("package", pa.string()), ("offset", pa.int64())])

    def read(batches):
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            files, path = file_system(paths[k])
            rows = []
            with files.open_input_file(path) as f:
                for offset, data in records(f, f.size()):
                    warc, http, payload = parse_record(data)
                    digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
                    if kind == "response" and base32_sha1(payload) != digest:
                        raise ValueError("a payload fails its digest")
                    refers = page_of(warc["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((page_of(warc["warc-record-id"]), int(http["content-length"]), digest, kind, refers, path.rpartition("/")[2], offset))
                    if len(rows) >= batch:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, package string, offset long"
    return spark.range(0, len(paths), 1, max(1, len(paths))).mapInArrow(read, kinds)
