"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of the target (a bounded sample of documents labelled clean) and one of
the raw table (all documents), give each document an importance weight: the mean log ratio of its n-grams, taken for a
text of UNIT n-grams so that long and short documents compare. Gumbel noise, keyed by the id, turns the k largest sums
of log weight and noise into a sample without replacement in proportion to the weights. k is the number of documents
whose weight reaches the level that best parts clean from other labelled documents.

n-grams: words (lower case, marks at the ends stripped), pairs of words, and pairs of word shapes (capitals, symbols,
digits, repetition of the word before).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches
from .arrow import column
from .shared import kept, prepare, stored_by_workers
from .words import PLACE, mix

U64 = np.uint64
BUCKETS = 1 << 16
SHAPES = 16
SIZE = BUCKETS + SHAPES * SHAPES
UNIT = 100
SMOOTH = 0.1
MARKS = b".,;:!?\"'()[]{}*#$%&|-_/\\<>=+~^@"


class Words(dict):
    """word -> hash of its normal form (marks at the ends stripped, lower case), with its shape in the lowest bits; of bounded size."""

    def __missing__(self, word: bytes) -> int:
        core = word.strip(MARKS)
        if core.isascii():
            low, capital = core.lower(), len(core) > 1 and core.isupper()
            digit = not core.isalpha() and any(48 <= c <= 57 for c in core)
        else:
            letters = core.decode("utf-8", "replace")
            low, capital = letters.lower().encode(), len(letters) > 1 and letters.isupper()
            digit = not letters.isalpha() and any(c.isdigit() for c in letters)
        symbol = len(core) < len(word) and (word.rstrip(b".,;:!?\"')") != core and word.rstrip(b".,").lstrip(b"(\"'") != core)
        value = xxhash.xxh3_64_intdigest(low) & ~7 | capital | symbol << 1 | digit << 2
        if len(word) <= 48:
            if len(self) > 250_000:
                self.clear()
            self[word] = value
        return value


_WORDS = Words()
caches.register("normal words", _WORDS.clear)


def grams(text: str | None) -> np.ndarray:
    """Bucket of every n-gram of a text."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_WORDS.__getitem__, words), U64, len(words))
    shape, word = (h & U64(7)).astype(np.int64), h >> U64(3)
    again = np.zeros(len(h), np.int64)
    again[1:] = word[1:] == word[:-1]
    shape += 8 * again
    one = mix(word * PLACE[0]) % U64(BUCKETS)
    two = mix(word[:-1] * PLACE[1] + word[1:] * PLACE[2]) % U64(BUCKETS)
    pairs = BUCKETS + np.concatenate(([0], shape[:-1])) * SHAPES + shape
    return np.concatenate((one.astype(np.int64), two.astype(np.int64), pairs))


def _model_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of all rows and of the rows marked as target; docs: text, target (boolean). Fixed size per task."""
    def count(batches):
        caches.only("normal words")
        total = np.zeros((2, SIZE), np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.bincount(grams(text), minlength=SIZE)
                total[0] += own
                if target:
                    total[1] += own
        yield pa.RecordBatch.from_pydict({"one": pa.array([0], pa.int32()), "part": [total.tobytes()]})

    def add(batches):
        total = np.zeros(2 * SIZE, np.int64)
        for batch in batches:
            for x in column(batch, "part").to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_pydict({"one": pa.array([0], pa.int32()), "part": [total.tobytes()]})

    parts = docs.select("text", "target").mapInArrow(count, "one int, part binary")
    n = max(1, int(math.sqrt(max(1, parts.rdd.getNumPartitions()))))  # two levels of sums
    sums = parts.repartition(n).mapInArrow(add, "one int, part binary").collect()
    total = np.sum([np.frombuffer(r[1], np.int64) for r in sums], axis=0).reshape(2, SIZE) if sums else np.zeros((2, SIZE), np.int64)
    return total[0], total[1]


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the target and raw models, bucket by bucket; zeros if there is no target text. The target model is
    smoothed towards the raw one, so an n-gram that the target sample happens to lack costs a bounded amount."""
    if not target.any():
        return np.zeros(SIZE)
    p_raw = (raw + 1) / (raw + 1).sum()
    return np.log((target / target.sum() + SMOOTH * p_raw) / (1 + SMOOTH) / p_raw)


def best_level(weights: np.ndarray, clean: np.ndarray) -> float:
    """The level with the least sum of error rates, in the middle of its gap; minus infinity without rejected labels."""
    if not len(weights) or clean.all() or not clean.any():
        return -math.inf
    order = np.argsort(weights, kind="stable")
    w, c = weights[order], clean[order]
    lost = np.concatenate(([0], np.cumsum(c))) / c.sum()
    passed = 1 - np.concatenate(([0], np.cumsum(~c))) / (~c).sum()
    edge = np.concatenate(([w[0] - 1], (w[1:] + w[:-1]) / 2, [w[-1] + 1]))
    gap = np.concatenate(([1.0], np.diff(w), [1.0]))
    cost = lost + passed
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(edge[best[gap[best].argmax()]])


def kth_largest(table: DataFrame, k: int, small: int = 4096) -> tuple[float, int | None]:
    """(key, id) of the k-th row by key descending, id ascending; table: stored, with key and id. Refines a histogram
    until the bin that holds the row has few rows; the driver sees bin counts and that bin only."""
    low, high = table.agg(F.min("key"), F.max("key")).first()
    before = 0
    for _ in range(64):
        inside = table.where(F.col("key").between(low, high))
        n = inside.count()
        if n <= small or low == high:
            rows = inside.select("key", "id").orderBy(F.desc("key"), F.asc_nulls_first("id")).limit(k - before).collect() if n <= small else inside.orderBy(F.asc_nulls_first("id")).limit(k - before).agg(F.lit(low), F.max("id")).collect()
            return rows[-1][0], rows[-1][1]
        width = (high - low) / 1024
        bins = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(1023))).agg(F.count(F.lit(1)), F.min("key"), F.max("key")).collect()}
        for b in sorted(bins, reverse=True):
            if before + bins[b][0] >= k:
                low, high = bins[b][1], bins[b][2]
                break
            before += bins[b][0]
    raise ValueError("keys are not finite")


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labels: int = 20_000, seed: int = 7) -> DataFrame:
    """One row per document: id, log_weight, sample_key (log weight plus Gumbel noise), selected, text_hash (xxhash64).

    labels: id, quality (1 is good), toxic (1 is toxic); clean means quality 1 and toxic 0. At most most_labels labelled
    rows are used (those with the smallest hash of the id): clean ones of one half are the target; the level parts
    clean from quality 0 in the other half. The raw
    model counts every document, and every document is scored. A null or empty text has weight 0. Without labels of
    both kinds everything is selected. Repeated rows share key and decision. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = labels.select(F.col(id_col).alias("id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("clean"), (F.col("quality") == 1).alias("good")).where("id is not null and clean is not null")
    known = known.groupBy("id").agg(F.min("clean").alias("clean"), F.min("good").alias("good")).withColumn("half", F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(2))).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most_labels)
    known = kept(known, "labelled", most_labels)  # at most most_labels rows
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = plain.join(F.broadcast(known), "id", "left").select("text", F.coalesce(F.col("clean") & (F.col("half") == 0), F.lit(False)).alias("target"))
    ratios = log_ratios(*_model_counts(marked))

    def score(batches):
        caches.only("normal words")
        for batch in batches:
            found = [grams(t) for t in batch.column(1).to_pylist()]
            weight = [round(float(ratios[g].mean()) * UNIT, 6) if len(g) else 0.0 for g in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(weight, pa.float64())], names=["id", "text_hash", "weight"])

    uniform = (F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))
    table = stored_by_workers(plain.withColumn("text_hash", F.xxhash64("text")), score, "id long, text_hash long, weight double", "scores").withColumn("key", F.col("weight") - F.log(-F.log(uniform)))
    judged = table.join(F.broadcast(known.where("half = 1 and (clean or not good)")), "id").select("weight", "clean").collect() if known.limit(1).count() else []  # the labelled sample
    level = best_level(np.array([r[0] for r in judged]), np.array([r[1] for r in judged], bool))
    k = table.where(F.col("weight") >= F.lit(level)).count()
    chosen = F.lit(False)
    if k:
        key, last = kth_largest(table, k)
        tie = F.col("id").isNull() if last is None else F.coalesce(F.col("id") <= last, F.lit(True))
        chosen = (F.col("key") > key) | ((F.col("key") == key) & tie)
    return table.select(F.col("id").alias(id_col), F.col("weight").alias("log_weight"), F.col("key").alias("sample_key"), chosen.alias("selected"), "text_hash")
