"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are words (lower case, marks at the ends stripped). An item matches a document if some stretch of it is within
tolerance(words of the item) word edits of the item.
1. Windows as long as an item, at every word of every document. A window with too few of the item's own rare words
   (those in few items) cannot be within the tolerance and is passed over; this bound loses nothing. Items with too few
   rare words for that use the same bound on words of any item.
2. The CGK random walk copies each word of a sequence a random number of times, steered by hash bits of word and step,
   so that few edits become few differing places (Hamming distance).
3. Repeated samples of a few places are hashed; windows and items that agree in one are candidates. The number of
   samples follows from the agreement of simulated edits of the items at the full tolerance and the target recall.
4. An alignment of the item against the window and its margins gives the exact edit distance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches
from .quality import _WORDS
from .shared import prepare
from .tokens import chunks
from .words import mix

U64 = np.uint64
WALKS, PLACES = 8, 3
SKETCH = 1 << 20
RARE = 8
PAD = U64(0xFFFFFFFFFFFFFFFF)


def tolerance(words: int) -> int:
    """Allowed word edits: a quarter of the words; none for items of fewer than eight."""
    return words // 4 if words >= 8 else 0


def normal(text: str | None) -> np.ndarray:
    """Hashes of the words; tokens of marks only are left out."""
    words = (text or "").encode().split()
    h = np.fromiter(map(_WORDS.__getitem__, words), U64, len(words)) >> U64(3)
    return h[h != U64(_WORDS[b""] >> 3)]


def embed(seqs: np.ndarray) -> np.ndarray:
    """CGK: rows of n word hashes become, for each of WALKS random walks, rows of 3 n places."""
    m, length = seqs.shape
    padded = np.concatenate((seqs, np.full((m, 1), PAD)), axis=1).ravel()
    begin = np.arange(m) * (length + 1)
    at, out = np.zeros((WALKS, m), np.int64), np.empty((3 * length, WALKS, m), U64)
    salts = mix(np.arange(WALKS * 3 * length, dtype=U64)).reshape(3 * length, WALKS, 1)
    for step in range(3 * length):
        np.take(padded, begin + at, out=out[step])
        at += (((out[step] ^ salts[step]) * U64(0x9E3779B97F4A7C15)) >> U64(63)).astype(np.int64)
        np.minimum(at, length, out=at)
    return out


def sample_keys(places: np.ndarray, lengths: np.ndarray, walk: int, sample: np.ndarray) -> np.ndarray:
    """One key per row: the places at the sampled fractions of three times its length, and the length."""
    key, rows = mix(lengths.astype(U64)), np.arange(len(lengths))
    for fraction in sample:
        at = (fraction * (3 * lengths)).astype(np.int64)
        key = mix(key ^ places[at, walk, rows] + at.astype(U64))
    return key


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least word edits between item and any stretch of text, and where that stretch ends."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class Matcher:
    """The benchmark items, ready for search; built on the driver from a bounded block of items."""

    def __init__(self, items: list[tuple[int, str]], recall: float = 0.98, seed: int = 3):
        self.items = [(i, h) for i, t in items if len(h := normal(t))]
        self.lengths = sorted({len(h) for _, h in self.items})
        self.sketch, self.rare_sketch = np.zeros(SKETCH, bool), np.zeros(SKETCH, bool)
        postings: dict[int, list[int]] = {}
        for k, (_, h) in enumerate(self.items):
            self.sketch[(h & U64(SKETCH - 1)).astype(np.int64)] = True
            for w in set(h.tolist()):
                postings.setdefault(w, []).append(k)
        rare = {w: ks for w, ks in postings.items() if len(ks) <= RARE}
        self.words = np.array(sorted(rare), U64)
        self.rare_sketch[(self.words & U64(SKETCH - 1)).astype(np.int64)] = True
        owners = [rare[w] for w in self.words.tolist()]
        self.starts = np.cumsum([0, *map(len, owners)])
        self.owners = np.array([k for ks in owners for k in ks], np.int64)
        self.sizes = np.array([len(h) for _, h in self.items], np.int64)
        self.spare = np.array([tolerance(n) for n in self.sizes.tolist()], np.int64)
        #: How many of an item's rare words any match must hold.
        self.least = np.array([sum(w in rare for w in h.tolist()) for _, h in self.items], np.int64) - self.spare
        self.plain = sorted({len(h) for (_, h), n in zip(self.items, self.least, strict=True) if n < 1})
        self.agreement = self._agreement(np.random.default_rng(seed))
        hit = self.agreement**PLACES
        self.samples = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        self.samples = max(WALKS, -(-self.samples // WALKS) * WALKS)
        rng = np.random.default_rng(seed + 1)
        self.draws = [(k % WALKS, rng.random(PLACES)) for k in range(self.samples)]
        self.index = []
        if self.items:
            matrix = np.full((len(self.items), max(self.lengths)), PAD)
            for row, (_, h) in zip(matrix, self.items, strict=True):
                row[: len(h)] = h
            places = embed(matrix)
            for walk, sample in self.draws:
                keys = sample_keys(places, self.sizes, walk, sample)
                order = np.argsort(keys, kind="stable")
                self.index.append((keys[order], order))

    def _agreement(self, rng) -> float:
        """Share of equal places between items and copies with as many random edits as tolerated: a low quantile."""
        found = []
        for _, h in self.items[:: max(1, len(self.items) // 200)]:
            k = tolerance(len(h))
            if not k:
                continue
            words = h.tolist()
            for _ in range(k):
                at, kind = int(rng.integers(0, len(words))), int(rng.integers(0, 3))
                words[at : at + (kind != 1)] = [] if kind == 2 else [int(rng.integers(1, 1 << 60))]
            words = (words + [1] * len(h))[: len(h)]
            pair = np.stack([h, np.asarray(words, U64)])
            places = embed(pair)
            found.append((places[:, :, 0] == places[:, :, 1]).mean())
        return max(0.05, float(np.quantile(found, 0.2))) if found else 1.0

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, first word) of every match: the least edits of each pair."""
        hashed = [normal(t) for t in texts]
        sizes = np.array([len(h) for h in hashed], np.int64)
        ends = np.cumsum(sizes)
        if not self.items or not len(ends) or not ends[-1]:
            return []
        words = np.concatenate(hashed)
        owner = np.repeat(np.arange(len(texts)), sizes)
        regions = self._regions(words)
        count = np.concatenate(([0], np.cumsum(self.sketch[(words & U64(SKETCH - 1)).astype(np.int64)], dtype=np.int32))) if self.plain else None
        most = max(self.lengths)
        padded = np.concatenate((words, np.full(most, PAD)))
        first = ends - sizes
        windows: list[tuple[np.ndarray, np.ndarray]] = []  # first word and length
        for length in self.lengths:
            spare = tolerance(length)
            at = regions.get(length, np.zeros(0, np.int64))
            if length in self.plain and len(words) >= length:
                at = np.union1d(at, np.flatnonzero(count[length:] - count[:-length] >= length - spare))
            at = at[(at >= 0) & (at + length <= len(words))]
            at = at[owner[at] == owner[at + length - 1]]
            at = np.concatenate((at, first[(sizes < length) & (sizes >= length - spare) & (sizes > 0)]))
            windows.append((at, np.full(len(at), length)))
        at, length = (np.concatenate(x) for x in zip(*windows, strict=True))
        odd = mix(np.arange(1, most + 1, dtype=U64)) | U64(1)
        pairs: dict[tuple[int, int], list[int]] = {}
        for a in range(0, len(at), 4096):
            some, long = at[a : a + 4096], length[a : a + 4096]
            seqs = padded[some[:, None] + np.arange(most)]
            inside = np.minimum(long, ends[owner[some]] - some)  # texts shorter than the item end before the window does
            seqs[np.arange(most) >= inside[:, None]] = PAD
            _, once = np.unique(mix(seqs * odd).sum(axis=1, dtype=U64) + mix(owner[some].astype(U64) << U64(32) | long.astype(U64)), return_index=True)
            self._candidates(some[once], long[once], seqs[once], owner, pairs)
        best = []
        for (t, k), starts in pairs.items():
            item, n, spare = self.items[k][1], int(self.sizes[k]), int(self.spare[k])
            lo, hi = max(min(starts) - spare, int(first[t])), min(max(starts) + n + spare, int(ends[t]))
            text = words[lo:hi]
            if int(np.isin(text, item).sum()) < n - spare:
                continue
            edits, end = edit_distance(item, text)
            if edits <= spare:
                best.append((t, k, edits, max(0, lo + end - n - int(first[t]))))
        return best

    def _regions(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """By length, the first words of all windows that may hold enough rare words of an item of that length."""
        at = np.flatnonzero(self.rare_sketch[(words & U64(SKETCH - 1)).astype(np.int64)])
        if not len(at) or not len(self.words):
            return {}
        k = np.minimum(np.searchsorted(self.words, words[at]), len(self.words) - 1)
        true = self.words[k] == words[at]
        at, k = at[true], k[true]
        many = self.starts[k + 1] - self.starts[k]
        place = np.repeat(at, many)
        item = self.owners[np.repeat(self.starts[k] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        use = self.least[item] >= 1
        place, item = place[use], item[use]
        order = np.lexsort((place, item))
        place, item = place[order], item[order]
        last = np.arange(len(item)) + self.least[item] - 1  # enough words from i to last, all of one item
        ok = last < len(item)
        i, last = np.flatnonzero(ok), last[ok]
        span = self.sizes[item[i]] + self.spare[item[i]]
        near = (item[last] == item[i]) & (place[last] - place[i] < span)
        i, last, span = i[near], last[near], span[near]
        out: dict[int, list] = {}
        for p, q, n, k in zip(place[i].tolist(), place[last].tolist(), span.tolist(), item[i].tolist(), strict=True):
            out.setdefault(int(self.sizes[k]), []).append(np.arange(q - n + 1, p + 1 + int(self.spare[k])))
        return {n: np.unique(np.concatenate(x)) for n, x in out.items()}

    def _candidates(self, at, long, seqs, owner, pairs) -> None:
        """Windows and items that agree in a sample, as starts by (text, item)."""
        places, seen = embed(seqs), []
        for (walk, sample), (keys, own) in zip(self.draws, self.index, strict=True):
            mine = sample_keys(places, long, walk, sample)
            lo, hi = np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right")
            for more in range(int((hi - lo).max(initial=0))):
                r = np.flatnonzero(hi - lo > more)
                seen.append(r * len(self.items) + own[lo[r] + more])
        for code in np.unique(np.concatenate(seen)).tolist() if seen else ():
            r, k = divmod(code, len(self.items))
            pairs.setdefault((int(owner[at[r]]), k), []).append(int(at[r]))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", recall: float = 0.98, most_items: int = 20_000) -> DataFrame:
    """One row for each document and benchmark item that match: id, item, edits, item_words, position (first word), text_hash.

    Every window of every whole text is searched. The benchmark is taken in blocks of about most_items items, one scan
    of the documents each, so what a task holds is bounded. Items without words match nothing; null and empty texts
    match nothing; rows with a null id are returned with it; repeated rows give repeated matches.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias(item_col), F.col(item_text).cast("string").alias(item_text)).distinct()
    blocks = max(1, -(-items.count() // most_items))
    schema = pa.schema([(id_col, pa.int64()), (item_col, pa.int64()), ("edits", pa.int32()), ("item_words", pa.int32()), ("position", pa.int64()), ("text_hash", pa.int64())])
    plain = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.xxhash64(F.col(text_col).cast("string")))
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64(item_col, item_text), F.lit(blocks)) == b)  # distinct rows: a hash deals them evenly
        matcher = spark.sparkContext.broadcast(Matcher([tuple(r) for r in part.collect()], recall))

        def search(batches, matcher=matcher):
            caches.only("normal words")
            m = matcher.value
            for batch in batches:
                ids, texts, marks = (c.to_pylist() for c in batch.columns)
                for lo, hi in chunks(texts, 512, 3_000_000):
                    rows = [(ids[lo + t], m.items[k][0], e, len(m.items[k][1]), p, marks[lo + t]) for t, k, e, p in m.search(texts[lo:hi])]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        found = plain.mapInArrow(search, f"`{id_col}` long, `{item_col}` long, edits int, item_words int, position long, text_hash long")
        out = found if out is None else out.unionByName(found)
    return out
