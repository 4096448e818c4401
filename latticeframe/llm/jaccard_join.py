"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sorted-array intersection.

1. One scan turns each text into its set of word shingles: set key, size, bitmap signature, sorted array. Within a task
   only the first copy of a set keeps its array.
2. A fixed-size table of shingle counts over all sets orders shingles from rare to frequent. Two sets that reach the
   threshold share a shingle among the first n - ceil(t n) + 1 of each, so only those prefixes are brought together.
3. Sets that share a prefix shingle form a list; equal lists are kept once. Long lists are cut into tiles by size band
   (sizes within the ratio t meet in one band or in neighbouring ones). In a tile, the bit counts of the signatures
   bound each overlap from above; what passes is kept as a spanning forest, never as all pairs. A shingle that more than
   HUGE sets hold has no list: its sets join one group for each size band by a star around the least key.
4. Groups of sets that are still connected get their arrays, read from the stored table by file and row, and exact
   intersections decide. Pairs already connected are skipped. A group is cut into blocks of about BLOCK sets (fewer if
   they are long); after the blocks and a few members of each have been compared, the sets outside of the group's
   largest component meet all others.

Sets are told apart by 128 bits of their shingles; where two share the 64-bit key they get other keys. Shingles are
compared by 48 bits of their hash: a pair of sets of n and m shingles is judged wrong with a probability under
n m / 2^48, and only if the colliding shingle decides (two sets of 1,000 shingles: 4e-9).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches
from .arrow import Forest, column, numbers, whole_groups
from .components import components
from .shared import drop, file_system, gathered, kept, partitions, prepare, stored, stored_by_workers
from .words import ascii_words, hashes, mix, shingles

U64 = np.uint64
COUNTERS = 1 << 20
CHUNKS = 64
LONG_LIST = 1024
HUGE = 1 << 14
BLOCK = 256
TILE = 16  # blocks of a group that is still open make a tile
LOAD = 4096  # a set counts in a block as one for each LOAD shingles, so that blocks are bounded in bytes too
MOST_BITS = 1 << 17
#: Bytes of prefix entries that a task takes, where the table asks for more tasks than shuffle partitions.
TASK_BYTES = 32 << 20


def need(a, b, num: int, den: int):
    """Smallest overlap of sets of a and b elements with overlap / union >= num / den."""
    return -(-(num * (a + b)) // (num + den))


def pack48(h: np.ndarray) -> bytes:
    return h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(U64).ravel()


def signature_bits(n: int, roomy: int = 4096) -> int:
    """Twice the size of the set up to `roomy` bits, beyond them at least its size: a signature with less than 0.75 bits
    a shingle is so full that its bound lets unrelated sets pass. Up to MOST_BITS."""
    return min(MOST_BITS, max(64, min(roomy, 1 << (2 * n - 1).bit_length()), 1 << (n - 1).bit_length()))


def bitmap(h: np.ndarray, bits: int = 0) -> np.ndarray:
    """Signature, by default of signature_bits()."""
    bits = bits or signature_bits(len(h))
    flags = np.zeros(bits, np.uint8)
    flags[(h & U64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(U64)


def fold(words: np.ndarray, to: int) -> np.ndarray:
    while len(words) > to:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def shingle_table(docs: DataFrame, id_col: str, text_col: str, width: int, key_bytes: int = 8) -> DataFrame:
    """Stored: doc_id, text_hash, n, sid (set key; null for an empty set), digest, bits, elements (null in later copies of a set within a task)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("digest", pa.binary()), ("bits", pa.binary()), ("elements", pa.binary())])

    def sets(batches):
        caches.only("words")
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for doc_id, text, text_hash in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = shingles(hashes(ascii_words(text)), width)
                if not len(full) or doc_id is None:
                    rows.append((doc_id, text_hash, len(full), None, None, None, None))
                    continue
                h = np.unique(full >> U64(16))
                digest = xxhash.xxh3_128_digest(full.tobytes())
                first = digest not in seen
                if first:
                    seen.add(digest)
                rows.append((doc_id, text_hash, len(full), int.from_bytes(digest[:key_bytes], "little", signed=True), digest, bitmap(h).tobytes() if first else None, pack48(h) if first else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return stored_by_workers(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.xxhash64(F.col(text_col).cast("string"))), sets, "doc_id long, text_hash long, n long, sid long, digest binary, bits binary, elements binary", "shingles")


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """Counts of all shingles in COUNTERS buckets: a table of fixed size, summed in CHUNKS parts."""
    size = COUNTERS // CHUNKS

    def count(batches):
        caches.only("none")
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            held = [unpack48(x) for x in column(batch, "elements").to_pylist()]
            if held:
                total += np.bincount((np.concatenate(held) >> U64(28)).astype(np.int64), minlength=COUNTERS)
        for k in range(CHUNKS):
            part = total[k * size : (k + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "part": [np.minimum(part, 0xFFFFFFFF).astype("<u4").tobytes()]})

    def add(batches):
        for batch, bounds in whole_groups(batches, "k"):
            parts = column(batch, "part")
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                total = np.zeros(size, np.int64)
                for i in range(a, b):
                    total += np.frombuffer(parts[i].as_py(), "<u4")
                yield pa.RecordBatch.from_pydict({"k": pa.array([column(batch, "k")[a].as_py()], pa.int32()), "part": [total.tobytes()]})

    parts = sets.where("elements is not null").select("elements").mapInArrow(count, "k int, part binary")
    out = np.zeros(COUNTERS, np.int64)
    for k, part in parts.repartition("k").sortWithinPartitions("k").mapInArrow(add, "k int, part binary").collect():
        out[k * size : (k + 1) * size] = np.frombuffer(part, np.int64)
    return out


def distinct_keys(sets: DataFrame, rounds: int = 8) -> DataFrame:
    """sets, with other keys for sets that share theirs with one of another digest (the least digest keeps it)."""
    for turn in range(rounds):
        named = sets.where("digest is not null").groupBy("sid").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
        shared = stored_by_workers(named.where("low <> high").select("sid", "low"), iter, "sid long, low binary", "shared-keys")
        if not shared._rows:
            return sets
        other = F.when(F.col("low").isNull() | (F.col("digest") == F.col("low")), F.col("sid")).otherwise(F.xxhash64("digest", F.lit(turn)))
        rows = sets._rows
        sets = stored(sets.join(shared, "sid", "left").withColumn("sid", other).select(*sets.columns), "shingles")
        sets._rows = rows
    raise ValueError("set keys still collide")


def prefix_lists(sets: DataFrame, num: int, den: int, huge: int) -> DataFrame:
    """sig, size, members (set keys, distinct, sorted): the distinct lists of sets that share a prefix shingle. A
    shingle that more than `huge` sets may hold has parts of its list instead: sig is the shingle, size is -1."""
    spark, counts = sets.sparkSession, shingle_counts(sets)
    rank = np.floor(np.log2(np.maximum(1, counts / (2 * counts.mean() + 32)))).astype(np.uint8)  # frequency class of a bucket
    ranks = spark.sparkContext.broadcast(rank | (counts > huge).astype(np.uint8) << 7)  # COUNTERS bytes; the top bit marks buckets over `huge`
    entries = sets.where("elements is not null").agg(F.sum(F.ceil(F.col("n") * (den - num) / den) + 1)).first()[0] or 0
    tasks = max(partitions(spark), 14 * entries // TASK_BYTES)
    buckets = U64(max(16, 16 * tasks))

    def deal(batches):
        for batch in batches:
            keys, owners, hot_keys, hot_owners = [], [], [], []
            for sid, data in zip(column(batch, "sid").to_pylist(), column(batch, "elements").to_pylist(), strict=True):
                h = unpack48(data)
                n = len(h)
                take = n - -(-num * n // den) + 1
                cls = ranks.value[(h >> U64(28)).astype(np.int64)]
                if cls.any():
                    order = np.argsort(cls, kind="stable")
                    h, cls = h[order], cls[order]
                    hot = h[:take][cls[:take] >= 128]
                    hot_keys.append(hot)
                    hot_owners.append(np.full(len(hot), sid, np.int64))
                    h = h[: take - len(hot)]
                keys.append(h[:take])
                owners.append(np.full(len(keys[-1]), sid, np.int64))
            for hot, k, o in ((False, keys, owners), (True, hot_keys, hot_owners)):
                if not sum(map(len, k)):
                    continue
                k, o = np.concatenate(k), np.concatenate(o)
                # prefixes hold the least hashes: another hash deals them; entries of frequent shingles are dealt by their set
                bucket = (mix(o.view(U64) if hot else k) % buckets).astype(np.int64)
                order = np.lexsort((k, bucket))
                k, o, bucket = k[order], o[order], bucket[order]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(bucket[cuts[:-1]], pa.int32()), "hot": pa.array([hot] * (len(cuts) - 1)),
                    "keys": [pack48(k[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                    "owners": [o[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                })

    def gather(batches):
        for batch, bounds in whole_groups(batches, "bucket", "hot"):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part = batch.slice(int(a), int(b - a))
                hot = column(part, "hot")[0].as_py()
                keys = np.concatenate([unpack48(x) for x in column(part, "keys").to_pylist()])
                owners = np.concatenate([np.frombuffer(x, np.int64) for x in column(part, "owners").to_pylist()])
                order = np.lexsort((owners, keys))
                keys, owners = keys[order], owners[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])  # copies of a set held by several tasks
                keys, owners = keys[new], owners[new]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
                if hot:
                    offsets = pa.array(cuts.astype(np.int32))
                    yield pa.RecordBatch.from_pydict({"sig": pa.array(keys[cuts[:-1]].view(np.int64)), "size": pa.array([-1] * (len(cuts) - 1), pa.int32()), "members": pa.ListArray.from_arrays(offsets, pa.array(owners))})
                    continue
                lists = dict.fromkeys(owners[cuts[i] : cuts[i + 1]].tobytes() for i in np.flatnonzero(np.diff(cuts) > 1))
                if not lists:
                    continue
                items = [(xxhash.xxh3_64_intdigest(x) - (1 << 63), np.frombuffer(x, np.int64)) for x in lists]
                for at in range(0, len(items), 4096):
                    sigs, members = zip(*items[at : at + 4096], strict=True)
                    offsets = np.cumsum([0, *map(len, members)]).astype(np.int32)
                    yield pa.RecordBatch.from_pydict({"sig": pa.array(sigs, pa.int64()), "size": pa.array(np.diff(offsets), pa.int32()), "members": pa.ListArray.from_arrays(offsets, np.concatenate(members))})

    dealt = sets.where("elements is not null").select("sid", "elements").mapInArrow(deal, "bucket int, hot boolean, keys binary, owners binary")
    lists = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "hot").mapInArrow(gather, "sig long, size int, members array<long>")
    return lists.groupBy("sig", "members").agg(F.first("size").alias("size")).select("sig", "size", "members")  # by the members themselves, so no list is lost


def band_of(n, num: int, den: int):
    """Size band: sizes within the ratio num / den are in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / (float(np.log(den / num)) * (1 - 1e-9))).cast("int")


def star_edges(hot: DataFrame, narrow: DataFrame, num: int, den: int) -> DataFrame:
    """Stored: a, b: the sets of a frequent shingle and a size band (or the one below), each with the least key among them."""
    rows = hot.distinct().join(narrow.select("sid", "n"), "sid")
    rows = rows.select("key", "sid", F.explode(F.array(band_of(F.col("n"), num, den), band_of(F.col("n"), num, den) + 1)).alias("band"))
    least = stored_by_workers(rows.groupBy("key", "band").agg(F.min("sid").alias("b")), iter, "key long, band int, b long", "stars")
    least = F.broadcast(least) if least._rows <= 100_000 else least
    edges = rows.join(least, ["key", "band"]).where("sid <> b").select(F.col("sid").alias("a"), "b").distinct()
    return stored_by_workers(edges, iter, "a long, b long", "star-edges")


def candidate_edges(lists: DataFrame, narrow: DataFrame, num: int, den: int) -> DataFrame:
    """Stored: a, b: a spanning forest, for each list or tile, of the pairs that the bounds let pass."""
    band = band_of(F.col("n"), num, den)
    long = F.col("size") > LONG_LIST
    rows = lists.select("sig", "size", F.explode("members").alias("sid")).join(narrow.select("sid", "n", "bits"), "sid")
    tiles = F.when(long, F.array(band, band + 1)).otherwise(F.array(F.lit(-1)))  # a member is a guest in the next band's tile
    rows = rows.select("sig", "sid", "n", "bits", F.explode(tiles).alias("band"))

    def tile(batches):
        for batch, bounds in whole_groups(batches, "sig", "band"):
            sid, n = numbers(batch, "sid"), numbers(batch, "n").astype(np.int64)
            raw = column(batch, "bits").to_pylist()
            a_out, b_out = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                size, bits = n[lo:hi], [np.frombuffer(x, U64) for x in raw[lo:hi]]  # sorted by size
                forest, stacks = Forest(hi - lo), {}
                for i in range(hi - lo - 1):
                    last = int(np.searchsorted(size, size[i] * den // num, "right"))
                    if last <= i + 1:
                        continue
                    width = len(bits[i])
                    if hi - lo > 8:  # one folded matrix for each width
                        if width not in stacks:
                            stacks[width] = np.stack([fold(x, width) if len(x) >= width else np.zeros(width, U64) for x in bits])
                        other = stacks[width][i + 1 : last]
                    else:
                        other = np.stack([fold(x, width) for x in bits[i + 1 : last]])
                    bound = (size[i] + size[i + 1 : last] - np.bitwise_count(other ^ bits[i]).sum(axis=1).astype(np.int64)) // 2
                    for j in np.flatnonzero(bound >= need(size[i], size[i + 1 : last], num, den)).tolist():
                        if forest.join(i, i + 1 + j):
                            a_out.append(sid[lo + i])
                            b_out.append(sid[lo + i + 1 + j])
            if a_out:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return stored_by_workers(rows.repartition("sig", "band").sortWithinPartitions("sig", "band", "n", "sid"), tile, "a long, b long", "candidates")


def fetch(places: DataFrame) -> DataFrame:
    """places (file, row, grp, part, sid) -> stored: grp, part, sid, n, elements: arrays read from the stored table by position."""
    def read(batches):
        for batch, bounds in whole_groups(batches, "file"):
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                files, path = file_system(column(batch, "file")[lo].as_py())
                rows = numbers(batch, "row")[lo:hi]
                rest = batch.select(["grp", "part", "sid"]).slice(lo, hi - lo)
                with files.open_input_file(path) as f:
                    at = done = 0
                    for chunk in pq.ParquetFile(f).iter_batches(2048, columns=["elements"]):
                        end = int(np.searchsorted(rows, at + chunk.num_rows))
                        if end > done:
                            data = chunk.column(0).take(pa.array(rows[done:end] - at))
                            cut = rest.slice(done, end - done)
                            lengths = pa.array([len(x) // 6 for x in data.to_pylist()], pa.int64())
                            yield pa.RecordBatch.from_arrays([*cut.columns, lengths, data.cast(pa.binary())], names=["grp", "part", "sid", "n", "elements"])
                        at, done = at + chunk.num_rows, end

    ordered = places.select("file", "row", "grp", "part", "sid").repartition(partitions(places.sparkSession), "file").sortWithinPartitions("file", "row")
    return stored_by_workers(ordered, read, "grp long, part int, sid long, n long, elements binary", "arrays")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def exact_edges(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows (grp, part, sid, n, elements, comp) -> stored: a, b: verified links that span each group's part.

    Sets with equal comp count as linked. A pair is intersected only while its sets are not yet connected.
    """
    def verify(batches):
        for batch, bounds in whole_groups(batches, "grp", "part"):
            sid, n, comp = numbers(batch, "sid"), numbers(batch, "n").astype(np.int64), numbers(batch, "comp")
            raw = column(batch, "elements")
            a_out, b_out = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                size, sets = n[lo:hi], [unpack48(raw[i].as_py()) for i in range(lo, hi)]
                linked = comp[lo:hi].copy()  # the component of each set, as known so far
                width = signature_bits(int(size[-1]), 8192)
                bits = np.stack([bitmap(x, width) for x in sets]) if hi - lo > 2 else None
                for i in range(hi - lo - 1):
                    last = int(np.searchsorted(size, size[i] * den // num, "right"))
                    js = np.flatnonzero(linked[i + 1 : last] != linked[i]) + i + 1
                    if bits is not None and len(js):
                        differ = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1).astype(np.int64)
                        js = js[(size[i] + size[js] - differ) // 2 >= need(size[i], size[js], num, den)]
                    for j in js.tolist():
                        if linked[i] != linked[j] and overlap(sets[i], sets[j]) >= need(int(size[i]), int(size[j]), num, den):
                            linked[linked == linked[j]] = linked[i]
                            a_out.append(sid[lo + i])
                            b_out.append(sid[lo + j])
            if a_out:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return stored_by_workers(rows.repartition("grp", "part").sortWithinPartitions("grp", "part", "n", "sid"), verify, "a long, b long", "links")


def load_of(n: str):
    """How many places a set of n shingles takes in its block."""
    return F.ceil(F.col(n) / LOAD)


def link_sets(sets: DataFrame, num: int, den: int, block: int = BLOCK, huge: int = HUGE) -> DataFrame:
    """node, comp over set keys with at least one link to another set. sets: a stored shingle table of distinct_keys()."""
    lists = kept(prefix_lists(sets, num, den, huge), "lists", 4 * sets._rows)
    hot = lists.where("size = -1").select(F.col("sig").alias("key"), F.explode("members").alias("sid"))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    held = sets.where("elements is not null").select("sid", "n", "bits", place.alias("place"))
    narrow = kept(held.groupBy("sid").agg(F.min("n").alias("n"), F.min_by("bits", "place").alias("bits"), F.min("place").alias("place")), "sets", sets._rows)
    edges = candidate_edges(lists.where("size > 0"), narrow, num, den)
    if hot.limit(1).count():
        edges = edges.unionByName(star_edges(hot, narrow, num, den))
    groups = components(edges)
    placed = groups.select(F.col("node").alias("sid"), F.col("comp").alias("grp")).join(narrow.select("sid", "n", "place.file", "place.row"), "sid")
    placed = kept(placed, "placed", sets._rows)
    where = placed.join(placed.groupBy("grp").agg(F.ceil(F.sum(load_of("n")) / block).cast("int").alias("blocks")), "grp")
    part = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    arrays = fetch(where.withColumn("part", part))
    links = exact_edges(arrays.withColumn("comp", F.col("sid")), num, den)
    large = where.where("blocks > 1").select("grp", "blocks").distinct()
    if large.limit(1).count():
        links = _between_blocks(arrays, links, stored(large, "large"), num, den, block)
    found = components(links)
    drop(lists, arrays)
    return found


def _between_blocks(arrays: DataFrame, links: DataFrame, large: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Links between the blocks of large groups. First one member of every block's components, in bundles of 16 blocks.
    Then, where a group still has several components, the sets outside of its largest one meet all of the group, in
    tiles of TILE blocks; sets of the largest component need no comparison with each other."""
    rows = arrays.select("grp", "part", "sid", load_of("n").alias("load")).join(F.broadcast(large) if large.count() <= 100_000 else large, "grp")

    def labelled(links):  # narrow: the arrays are read again for the sets that are compared
        comp = components(links)
        found = rows.join(comp.withColumnRenamed("node", "sid"), "sid", "left")
        return stored_by_workers(found.select("grp", "part", "sid", "load", "blocks", F.coalesce("comp", "sid").alias("comp")), iter, "grp long, part int, sid long, load long, blocks int, comp long", "labelled")

    def with_arrays(wanted):
        wanted = stored_by_workers(wanted, iter, wanted.schema, "wanted")
        wanted = F.broadcast(wanted) if wanted._rows <= 100_000 else wanted
        return arrays.select("sid", "n", "elements").join(wanted, "sid")

    labels = labelled(links)
    one = labels.groupBy("grp", "part", "comp").agg(F.min_by("sid", F.xxhash64("sid")).alias("sid"), F.first("blocks").alias("blocks"))
    some = one.select("grp", F.pmod(F.xxhash64("comp"), F.greatest(F.lit(1), F.col("blocks") / 16).cast("int")).cast("int").alias("part"), "sid", "comp")
    links = links.unionByName(exact_edges(with_arrays(some), num, den))
    labels = labelled(links)
    parts = labels.groupBy("grp", "comp").agg(F.sum("load").alias("size")).groupBy("grp").agg(F.max_by("comp", "size").alias("main"), (F.sum("size") - F.max("size")).alias("others"), F.sum("size").alias("size"))
    cut = lambda n: F.ceil(F.col(n) / (TILE * block)).cast("int")
    opened = labels.join(parts.where("others > 0").select("grp", "main", cut("others").alias("guests"), cut("size").alias("hosts")), "grp")
    deal = lambda turn, n: F.pmod(F.xxhash64("sid", F.lit(turn)), F.col(n)).cast("int")
    tile = (F.col("host").cast("long") * F.col("guests") + F.col("guest")).alias("part")
    hosts = opened.select("grp", "sid", "comp", deal(2, "hosts").alias("host"), F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("guest"), "guests")
    outside = opened.where("comp <> main").select("grp", "sid", "comp", F.explode(F.sequence(F.lit(0), F.col("hosts") - 1)).alias("host"), deal(1, "guests").alias("guest"), "guests")
    tiles = hosts.unionByName(outside).select("grp", tile, "sid", "comp").distinct()
    return links.unionByName(exact_edges(with_arrays(tiles), num, den))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 3, den: int = 4, block: int = BLOCK, huge: int = HUGE, key_bytes: int = 8) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links with overlap / union >= num / den),
    text_hash (xxhash64 of the text, to tell rows of one id apart).

    A null, empty or blank text has no shingles and links with nothing; its component is itself. A row with a null id
    has a null component. Rows that share an id are judged each by its own text; they need not share a component. An
    empty table gives no rows; other columns are not read. block and huge bound what a task holds and change no result;
    key_bytes is for tests. Links between equal sets are implied by their common set key, so copies never meet as pairs.
    """
    spark = docs.sparkSession
    prepare(spark)
    sets = distinct_keys(shingle_table(docs, id_col, text_col, width, key_bytes))
    found = link_sets(sets, num, den, block, huge)
    mine = sets.select("doc_id", "text_hash", "n", "sid")
    keyed = mine.where("sid is not null")
    frequent = keyed.select(F.expr("approx_top_k(sid, 64, 4096)").alias("top")).select(F.explode("top").alias("top")).where("top.count > 1000").select("top.item").limit(64)
    hot = [r[0] for r in frequent.collect()]  # set keys with many copies, at most 64: settled by broadcast
    is_hot = F.col("sid").isin(hot) if hot else F.lit(False)
    lowest = lambda part: part.groupBy("sid").agg(F.min("doc_id").alias("low"))
    label = kept(lowest(keyed).join(found.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "low", F.coalesce("comp", "sid").alias("comp")), "set-labels", sets._rows)
    comp_low = label.groupBy("comp").agg(F.min("low").alias("component_id"))
    label = kept(label.join(comp_low, "comp").select("sid", "component_id"), "set-components", sets._rows)
    cold = mine.where(~is_hot | F.col("sid").isNull()).join(label, "sid", "left")
    out = cold if not hot else cold.unionByName(mine.where(is_hot).join(F.broadcast(label.where(is_hot)), "sid"))
    return gathered(out, sets._rows).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")
