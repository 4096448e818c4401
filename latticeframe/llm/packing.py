"""Pattern packing by non-negative least squares.

Only the histogram of piece lengths is planned on, so the plan costs the same for a thousand or a trillion documents:
1. cut documents into pieces of at most max_len tokens and count pieces by length (at most max_len counts);
2. enumerate patterns of up to three length bins that fill a sequence, and fit how often each repeats to the histogram
   by non-negative least squares; round down;
3. realise each pattern with exact lengths (its last slot takes the longest length that still fits);
4. pack what is left, best fit and longest first, into the gaps of those sequences and then into new ones;
5. give every piece its rank among the pieces of its length; the rank selects sequence and offset from the plan.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import gathered, partitions, prepare, stored_by_workers
from .tokens import encoder, slices

BINS = 128


def cut(docs: DataFrame, tokenizer: str, max_len: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each document, append end_id and cut it into pieces of max_len tokens; a null text is an empty one.

    Stored; columns id, piece, start, length, ids_crc32 and, if with_ids, ids (little-endian u32 bytes).
    """
    prepare(docs.sparkSession)
    schema = pa.schema([(id_col, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def encode(batches):
        enc = encoder(tokenizer)
        for part in (s for batch in batches for s in slices(batch, 1)):
            ids, bounds = enc.encode_array(part.column(1), end_id)
            data = ids.astype("<u4").data.cast("B")
            many = -(-np.diff(bounds) // max_len)
            doc = np.repeat(np.arange(part.num_rows), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            begin = bounds[doc] + piece * max_len
            end = np.minimum(begin + max_len, bounds[doc + 1])
            raw = [data[4 * a : 4 * b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            columns = [part.column(0).take(pa.array(doc)), piece, piece * max_len, end - begin, list(map(zlib.crc32, raw)), list(map(bytes, raw)) if with_ids else ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if i else c for i, (c, t) in enumerate(zip(columns, schema.types, strict=False))], schema=schema)

    kinds = f"`{id_col}` long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return stored_by_workers(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), encode, kinds, "pieces")


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-8, most: int = 600) -> np.ndarray:
    """Lawson and Hanson's active-set method for min |a x - b| with x >= 0."""
    x, passive, gram, right = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool), a.T @ a, a.T @ b
    limit = tol * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(most):
        gradient = np.where(passive, -np.inf, right - gram @ x)
        if gradient.max(initial=-np.inf) <= limit:
            break
        passive[int(gradient.argmax())] = True
        while True:
            own = np.flatnonzero(passive)
            trial = np.linalg.lstsq(gram[np.ix_(own, own)], right[own], rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[own] = trial
                break
            low = trial <= 0
            ratio = x[own][low] / np.maximum(x[own][low] - trial[low], 1e-300)
            x[own] += float(ratio.min()) * (trial - x[own])
            passive[own[low][ratio <= ratio.min()]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def patterns(bins: int) -> list[tuple[int, ...]]:
    """All ways to fill `bins` units with one, two or three parts."""
    two = [(a, bins - a) for a in range((bins + 1) // 2, bins)]
    three = [(a, b, bins - a - b) for a in range(1, bins) for b in range(1, a + 1) if 0 < bins - a - b <= b]
    return [(bins,), *two, *three]


def plan(histogram: dict[int, int], max_len: int, bins: int = BINS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Groups of equal sequences: their slots as runs of (length, repeats), and how many sequences there are."""
    left = np.zeros(max_len + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    whole = int(left[max_len])
    left[max_len] = 0
    bins = min(bins, max_len)
    unit = math.ceil(max_len / bins)
    lengths = np.arange(max_len + 1)
    of_bin = np.minimum((lengths + unit - 1) // unit, bins)
    counts = np.bincount(of_bin, left, bins + 1)[1:]
    groups: list[list] = [[[(max_len, 1)], max_len, whole]] if whole else []  # slots, tokens, sequences
    ways = patterns(bins)
    matrix = np.zeros((bins, len(ways)))
    for k, way in enumerate(ways):
        for b in way:
            matrix[b - 1, k] += 1
    weight = 1 + np.arange(bins) / bins  # short lengths left over still fill gaps
    repeats = np.floor(nnls(matrix * weight[:, None], counts * weight) + 1e-6).astype(np.int64) if counts.any() else np.zeros(len(ways), np.int64)

    def longest(low: int, high: int) -> int:
        """The longest length in (low, high] that has pieces left; 0 if none."""
        found = np.flatnonzero(left[low + 1 : high + 1])
        return int(low + 1 + found[-1]) if len(found) else 0

    for k in np.argsort([-max(w) for w in ways], kind="stable"):
        todo = int(repeats[k])
        while todo > 0:
            slots: list[int] = []
            for i, b in enumerate(ways[k]):
                room = max_len - sum(slots)
                high = room if i + 1 == len(ways[k]) else min(b * unit, room)
                if not (pick := longest((b - 1) * unit, min(high, (b + 2) * unit))):
                    break
                slots.append(pick)
                left[pick] -= 1
            for pick in slots:
                left[pick] += 1
            if len(slots) < len(ways[k]):
                break
            runs = [(x, slots.count(x)) for x in dict.fromkeys(slots)]
            n = min(todo, *(int(left[x]) // r for x, r in runs))
            if not n:
                break
            for x, r in runs:
                left[x] -= n * r
            groups.append([runs, sum(slots), n])
            todo -= n

    gaps: dict[int, list[list]] = {}  # by the room that is left
    for g in groups:
        gaps.setdefault(max_len - g[1], []).append(g)
    rooms = sorted(gaps)

    def put(room: int, group: list) -> None:
        if room not in gaps:
            gaps[room] = []
            insort(rooms, room)
        gaps[room].append(group)

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                fit = max_len // length
                if n // fit:
                    put(max_len - fit * length, [[(length, fit)], fit * length, n // fit])
                if n % fit:
                    put(max_len - n % fit * length, [[(length, n % fit)], n % fit * length, 1])
                n = 0
                continue
            room = rooms[i]
            runs, tokens, many = group = gaps[room][-1]
            fit = min(room // length, max(1, n // many))
            take = min(many, n // fit)
            if take == many:
                gaps[room].pop()
                if not gaps[room]:
                    del gaps[room], rooms[i]
            else:
                group[2] = many - take
            put(room - fit * length, [[*runs, (length, fit)], tokens + fit * length, take])
            n -= take * fit
    return [(tuple(runs), many) for groups in gaps.values() for runs, _, many in groups]


def intervals(groups: list, max_len: int) -> dict[str, np.ndarray]:
    """The plan by length and rank: ranks from `first` on go, `repeats` to a sequence, to `sequence` onwards at `offset`."""
    used, rows, sequence = np.zeros(max_len + 1, np.int64), [], 0
    for runs, many in groups:
        offset = 0
        for length, repeats in runs:
            rows.append((length, int(used[length]), sequence, repeats, offset))
            used[length] += many * repeats
            offset += length * repeats
        sequence += many
    table = np.asarray(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "repeats", "offset"), table.T.copy(), strict=True))


def assign(pieces: DataFrame, max_len: int = 4096, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """pieces (with a length column, 1 to max_len) and their sequence_id and offset.

    pieces is read three times; give a stored table. Lengths with many pieces are ranked in salted parts. The driver
    holds the histogram, a count for each salted part (at most max_len + 4 a partition) and the plan.
    """
    spark = pieces.sparkSession
    prepare(spark)
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    table = intervals(plan(histogram, max_len), max_len)
    aim = max(1000, sum(histogram.values()) // (4 * partitions(spark)))
    parts = {length: -(-n // aim) for length, n in histogram.items() if n > aim}
    salt = F.lit(0)
    if parts:
        many = F.element_at(F.create_map(*(F.lit(x) for kv in parts.items() for x in kv)), F.col("length").cast("int"))
        salt = F.coalesce(F.pmod(F.xxhash64(*order), many), F.lit(0)).cast("int")
    salted = pieces.withColumn("__salt", salt)
    base: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    if parts:
        for r in sorted(salted.where(F.col("length").isin(list(parts))).groupBy("length", "__salt").count().collect()):
            base[r[0], r[1]] = seen.get(r[0], 0)
            seen[r[0]] = base[r[0], r[1]] + r[2]
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)))
    key = table["length"] << 40 | table["first"]

    def place(batches):
        for batch in batches:
            length, salted_by, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__salt", "__rank"))
            at = rank.astype(np.int64) - 1
            if base:
                at = at + np.fromiter((base.get(k, 0) for k in zip(length.tolist(), salted_by.tolist(), strict=True)), np.int64, len(at))
            i = np.searchsorted(key, length.astype(np.int64) << 40 | at, "right") - 1
            at = at - table["first"][i]
            sequence, offset = table["sequence"][i] + at // table["repeats"][i], table["offset"][i] + at % table["repeats"][i] * length
            keep = [n for n in batch.schema.names if n not in ("__salt", "__rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in keep), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*keep, "sequence_id", "offset"])

    out = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return gathered(ranked, sum(histogram.values())).mapInArrow(place, out)


def pack(docs: DataFrame, tokenizer: str, max_len: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of every document: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    No sequence is longer than max_len and offsets have no gaps. Only documents longer than max_len are cut. An empty
    table gives no rows; repeated rows are packed each for itself; other columns are not read.
    """
    pieces = cut(docs, tokenizer, max_len, end_id, id_col, text_col, with_ids)
    return assign(pieces, max_len, (id_col, "piece", "ids_crc32"))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pack(..., with_ids=True): sequence_id, its tokens and ids (u32 bytes). A group is at most max_len tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x.length).alias("tokens"),
        F.aggregate("p", F.unhex(F.lit("")), lambda b, x: F.concat(b, x.ids)).alias("ids"),
    )
