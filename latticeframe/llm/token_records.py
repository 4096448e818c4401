"""Token-ID output: length-delimited binary records with masked checksums, and a separate offset index.

A shard is a file of records
    length u64 | masked crc of the length u32 | payload | masked crc of the payload u32        (little-endian)
with the payload
    width of an id in bytes, plus 128 if the document has no id: u8 | document id i64 | ids, width bytes each.
The index file beside it has one entry of three i64 per record: document id, offset of the record, ids in it, so that a
shuffled reader seeks to any record without a scan. The checksum is CRC-32 under the usual mask (rotate right by 15
bits, add a constant); ids take two bytes where the vocabulary fits, else four.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system, partitions, prepare, publish_all
from .tokens import encoder, slices

MASK_DELTA = 0xA282EAD8
NO_ID = -(1 << 63)
HEAD, PAYLOAD = "<QI", "<Bq"
HEAD_SIZE, PAYLOAD_SIZE = struct.calcsize(HEAD), struct.calcsize(PAYLOAD)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def pack_payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack(PAYLOAD, width + (128 if doc_id is None else 0), 0 if doc_id is None else doc_id) + ids.astype(f"<u{width}", copy=False).tobytes()


def unpack_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from(PAYLOAD, payload)
    return None if flags & 128 else doc_id, np.frombuffer(payload, f"<u{flags & 127}", offset=PAYLOAD_SIZE)


def read_frame(stream) -> bytes | None:
    """The next payload, None at the end; a torn or altered record raises."""
    if not (head := stream.read(HEAD_SIZE)):
        return None
    length, check = struct.unpack(HEAD, head)
    if masked(head[:8]) != check:
        raise ValueError("the length of a record fails its checksum")
    body = stream.read(length + 4)
    if len(body) != length + 4 or masked(body[:length]) != struct.unpack("<I", body[length:])[0]:
        raise ValueError("a record fails its checksum")
    return body[:length]


def read_at(path: str, offset: int) -> tuple[int | None, np.ndarray]:
    """Random access to one record through the offset of its index entry."""
    files, at = file_system(path)
    with files.open_input_file(at) as f:
        f.seek(offset)
        return unpack_payload(read_frame(f))


def read_index(path: str) -> np.ndarray:
    """Rows of (document id, offset, ids) of a shard's index; a null document id reads as the smallest i64."""
    files, at = file_system(path)
    with files.open_input_stream(at) as f:
        return np.frombuffer(f.read(), "<i8").reshape(-1, 3)


def write_records(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list[dict]:
    """Write shards in ascending id order (null ids first, equal ids by a hash of the text); returns a row for each shard.

    A null text is written as an empty one. Only id and text are read. The rows are one per shard file, of which there
    are as many as shuffle partitions, whatever the number of documents.
    """
    spark = docs.sparkSession
    prepare(spark)

    def write(batches):
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        width = 2 if max(enc.vocab_size, end_id + 1) <= 1 << 16 else 4
        path, docs, tokens, size = f"{out_dir}/shard-{shard:07d}", 0, 0, 0

        def fill(out, index):
            nonlocal docs, tokens, size
            for part in (s for batch in batches for s in slices(batch, 1)):
                ids, bounds = enc.encode_array(part.column(1), end_id)
                ids, rows = ids.astype(f"<u{width}"), np.empty((part.num_rows, 3), "<i8")
                framed = []
                for k, (doc_id, a, b) in enumerate(zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    framed.append(frame(pack_payload(doc_id, ids[a:b], width)))
                    rows[k] = NO_ID if doc_id is None else doc_id, size, b - a
                    size += len(framed[-1])
                out.write(b"".join(framed))
                index.write(rows.tobytes())
                docs, tokens = docs + len(rows), tokens + len(ids)

        publish_all((f"{path}.rec", f"{path}.idx"), fill)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "docs": [docs], "tokens": [tokens], "bytes": [size]})

    parts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = parts.repartitionByRange(shards or partitions(spark), F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    rows = parts.mapInArrow(write, "shard long, path string, docs long, tokens long, bytes long").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["shard"])


def read_records(spark: SparkSession, manifest: list[dict], batch: int = 2048) -> DataFrame:
    """Read the shards back: id, start (ids before it over all shards), n_tokens, ids_crc32, shard, offset.

    Every record's checksums are verified. start comes from the shards' totals, which the manifest has.
    """
    prepare(spark)
    totals = np.cumsum([0, *(m["tokens"] for m in manifest)]).tolist()
    plan = [(m["shard"], m["path"], base) for m, base in zip(manifest, totals, strict=False)]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64())])

    def read(batches):
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            shard, path, start = plan[k]
            files, at = file_system(f"{path}.rec")
            rows, offset = [], 0
            with files.open_input_stream(at, buffer_size=4 << 20) as f:
                while (payload := read_frame(f)) is not None:
                    doc_id, ids = unpack_payload(payload)
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard, offset))
                    start += len(ids)
                    offset += len(payload) + HEAD_SIZE + 4
                    if len(rows) >= batch:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return spark.range(0, len(plan), 1, max(1, len(plan))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, offset long")
