"""Sharding by extendible hashing.

A shard is a hash prefix of some depth. Starting from one bucket, only buckets over the byte limit split on the next bit.
Because splitting depends on byte sums of prefixes alone, the directory is made from sums by prefix: a shard is the
shortest prefix that fits. Sums come level by level from a histogram that holds a small multiple of the shards, not the
rows; buckets still too large at its finest level go on to deeper levels, which read the rows of those buckets only.
Rows of one key that alone exceed the limit share all bits of the key's hash; those buckets split on by bits of a hash
of the row, and identical rows beyond that stay together in one shard marked as oversized.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

BITS = 60  # of the key's hash
STEP = 6  # levels that a histogram looks beyond the depth that even buckets would need


def hash60(value: Column) -> Column:
    """The first 60 bits of the md5 of the value's text."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(depth: int | Column) -> Column:
    """hash's leading bits: of the key's hash up to BITS, then of the row's hash."""
    if isinstance(depth, int):
        if depth <= BITS:
            return F.concat(F.lpad(F.conv(F.shiftright("hash", BITS - depth).cast("string"), 10, 2), depth, "0")) if depth else F.lit("")
        return F.concat(F.lpad(F.conv(F.col("hash").cast("string"), 10, 2), BITS, "0"), F.substring(F.lpad(F.conv(F.col("row_hash").cast("string"), 10, 2), BITS, "0"), 1, depth - BITS))
    raise TypeError(depth)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """prefix (bits as text), depth, bytes, rows: the shards of rows (hash, row_hash, bytes), a stored table."""
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    top = max(1, math.ceil(math.log2(max(1.0, total[0] / limit)))) + STEP
    begin, live, found = 0, rows, None
    while True:
        end = min(2 * BITS, top)
        full = live.withColumn("prefix", _prefix(end)).groupBy("prefix").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        full = stored(full, "histogram")
        depths = F.explode(F.sequence(F.lit(begin), F.lit(end))).alias("depth")
        nodes = full.select(depths, "prefix", "bytes", "rows").groupBy("depth", F.expr("substring(prefix, 1, depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        nodes = stored(nodes, "nodes")
        over = nodes.select((F.col("depth") + 1).alias("depth"), "prefix", (F.col("bytes") > limit).alias("over"))
        up = nodes.withColumn("up", F.when(F.col("depth") > 0, F.expr("substring(prefix, 1, depth - 1)")))
        split = up.join(over.withColumnRenamed("prefix", "up"), ["depth", "up"], "left").where(F.col("over") | (F.col("depth") == begin))
        last = end == 2 * BITS
        leaves = split.where((F.col("bytes") <= limit) | F.lit(last) & (F.col("depth") == end)).select("prefix", "depth", "bytes", "rows")
        found = leaves if found is None else found.unionByName(leaves)
        deep = full.where(F.col("bytes") > limit).select("prefix")
        if last or not deep.limit(1).count():
            return stored(found, "directory")
        live = stored(live.withColumn("prefix", _prefix(end)).join(deep, "prefix", "left_semi").drop("prefix"), "oversized")
        begin, top = end, end + 2 * STEP


def shard(docs: DataFrame, limit: int, key: Column | None = None, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, shard (the prefix's bits; empty for a single shard), depth, shard_bytes, shard_rows, oversized.

    key is what is hashed (default the id), size its bytes (default the UTF-8 bytes of the text; null counts 0). Every
    shard has at most limit bytes unless a single row, or identical rows, exceed it (oversized). Rows of null keys hash
    as empty text. An empty table gives no rows.
    """
    key = F.col(id_col) if key is None else key
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") if size is None else size
    row_hash = hash60(F.concat_ws("\x1f", F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    rows = stored(docs.select(F.col(id_col).alias("__id"), hash60(key).alias("hash"), row_hash.alias("row_hash"), size.alias("bytes")), "hashed")
    shards = directory(rows, limit)
    depths = [r[0] for r in shards.select("depth").distinct().collect()]  # at most 121 depths
    table = shards.select(F.col("prefix").alias("shard"), "depth", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))
    full = rows.withColumn("bits", _prefix(2 * BITS))
    own = full.select("__id", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.substring("bits", 1, d).alias("shard")) for d in sorted(depths)))).alias("at")).select("__id", "at.depth", "at.shard") if depths else full.select("__id", F.lit(0).alias("depth"), F.lit("").alias("shard"))
    return own.join(table, ["depth", "shard"]).select(F.col("__id").alias(id_col), "shard", "depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, assigned: DataFrame, out_dir: str, id_col: str = "doc_id") -> None:
    """Write the rows as Parquet, one folder per shard; ids are expected to be unique. A shard is at most a limit of bytes, so one task writes it."""
    docs.join(assigned.select(id_col, F.concat(F.lit("p"), "shard").alias("shard")), id_col).repartition("shard").write.partitionBy("shard").parquet(out_dir)
