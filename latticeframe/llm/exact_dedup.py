"""Exact dedup by a heavy-hitter split, in DataFrame and SQL functions only.

A frequent-items sketch (the mergeable Misra-Gries summary behind Spark's approx_top_k, a bounded number of counters a
partition) names digests that may be frequent. One exact map-side aggregation verifies them; the few winners are
broadcast and their copies settled without a shuffle. All other digests are grouped and joined by ordinary shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, without

DIGEST = "__digest"


def frequent(table: DataFrame, col: str, heavy: int = 64, counters: int = 4096, min_copies: int = 50) -> list[bytes]:
    """At most `heavy` values of a binary column that a frequent-items sketch takes for frequent."""
    top = table.select(F.expr(f"approx_top_k(hex({col}), {heavy}, {counters})").alias("top")).select(F.explode("top").alias("top"))
    return [bytes(r[0]) for r in top.where(F.col("top.count") >= min_copies).select(F.unhex("top.item")).limit(heavy).collect()]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, heavy: int = 64, counters: int = 4096, min_copies: int = 50) -> DataFrame:
    """One row per input row: id, keep_id (largest id of the equal texts), group_size, kept, text_sha256.

    text: the normalised text; null counts as empty. Equal means the same SHA-256 of the UTF-8 text. Other columns of
    docs are not read. Repeated rows that share the winning id are all kept; a null id is never the largest unless all
    ids of the group are null (then keep_id is null and its rows are kept). An empty table gives no rows.
    heavy bounds the broadcast rows; counters bounds the sketch of each task. A digest past the heavy-th is grouped by the
    ordinary shuffle, where partial sums meet; its join is left to adaptive skew handling.
    """
    text = F.col("text") if text is None else text
    table = stored(docs.select(F.col(id_col).alias("__id"), F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)).alias(DIGEST)), "digests")
    found = frequent(table, DIGEST, heavy, counters, min_copies)
    group = [F.max("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    if found:
        names = [F.lit(x) for x in found]
        winners = table.where(F.col(DIGEST).isin(names)).groupBy(DIGEST).agg(*group)
        hot = table.where(F.col(DIGEST).isin(names)).join(F.broadcast(winners), DIGEST)
        rest = table.where(~F.col(DIGEST).isin(names))
    else:
        hot, rest = None, table
    cold = rest.join(rest.groupBy(DIGEST).agg(*group), DIGEST)
    return (cold if hot is None else cold.unionByName(hot)).select(
        F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(DIGEST)).alias("text_sha256")
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows are told apart by id and text, so of rows that share an id
    only those go whose own text has a larger id elsewhere; rows with a null id stay."""
    text = F.col("text") if text is None else text
    own = F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)
    return without(docs, exact_dedup(docs, id_col, text).where(~F.col("kept")), id_col, native=True, mark="text_sha256", mark_of=own)
