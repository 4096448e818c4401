import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from latticeframe.llm import exact_dedup, jaccard_join
from latticeframe.llm.components import components


def test_exact_dedup(odd):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(odd).collect()}
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    for doc_id, text in texts:
        r = got[doc_id, hashlib.sha256(text.encode()).hexdigest()]
        same = [i for i, t in texts if t == text]
        keep = max((i for i in same if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), doc_id == keep)
    assert exact_dedup.exact_dedup(odd).count() == len(texts)


def test_heavy_hitters(spark):
    """One text a third of all rows, many of medium size, and singles: with and without the broadcast path."""
    rows = [(i, "hot" if i % 3 == 0 else f"m{i % 50}" if i % 3 == 1 else f"s{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    assert out == {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, min_copies=10**9).collect()}
    assert out[0] == (2997, 1000) and out[2] == (2, 1) and len(out) == 3000
    assert exact_dedup.survivors(docs).count() == len({t for _, t in rows})


def test_dedup_plan_is_native(documents):
    plan = exact_dedup.exact_dedup(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_dedup_empty(odd):
    assert exact_dedup.exact_dedup(odd.where("false")).count() == 0


def brute(rows, width=5, num=3, den=4):
    sets, up = {}, {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        up[i] = i

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * x >= num * (len(sets[a]) + len(sets[b]) - x):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return {i: (len(s), root(i)) for i, s in sets.items()}


def result(df, **kwargs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, **kwargs).collect()}


def test_jaccard_join(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert result(documents) == brute(rows)


@pytest.mark.parametrize("block,huge,key_bytes", [(4096, 1 << 14, 8), (16, 10, 1)])
def test_jaccard_near_copies(spark, block, huge, key_bytes, monkeypatch):
    """A large group of near copies, a passage shared by many texts, borderline pairs and short texts; also in small
    blocks and tiles, with frequent shingles as stars, and with set keys of one byte, most of which collide."""
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 20)
    rng = random.Random(1)
    word = lambda: f"v{rng.randrange(4000)}"
    base, passage = [word() for _ in range(60)], [word() for _ in range(60)]
    texts = []
    for k in range(60):
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(5, 200))]) for _ in range(60)]
    texts += [" ".join(base[:k]) for k in range(0, 60)] + ["One two", "one TWO", "one", "", None]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), block=block, huge=huge, key_bytes=key_bytes) == brute(rows)


def test_jaccard_odd(odd):
    got = jaccard_join.jaccard_components(odd).collect()
    assert len(got) == odd.count()
    out = {r.doc_id: r for r in got}
    assert out[None].component_id is None and out[2].component_id == 1 and out[7].component_id == 6 and out[3].n_shingles == out[4].n_shingles == out[5].n_shingles == 0
    assert [out[i].component_id for i in (3, 4, 5)] == [3, 4, 5] and out[8].n_shingles == 1
    assert jaccard_join.jaccard_components(odd.where("false")).count() == 0


def test_rows_that_share_an_id(spark):
    """A row goes by its own text: none is lost because another row of its id goes."""
    docs = spark.createDataFrame([(2, "x"), (2, "y"), (3, "x"), (None, "x"), (None, "z"), (4, None), (5, ""), (5, "")], "doc_id long, text string")
    stays = sorted(((r.doc_id, r.text) for r in exact_dedup.survivors(docs).collect()), key=str)
    assert stays == sorted([(2, "y"), (3, "x"), (None, "x"), (None, "z"), (5, ""), (5, "")], key=str)
    texts = [f"w{k} a b c d e f g" for k in range(3)]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[1])]
    got = {(r.doc_id, r.text_hash): r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted((k[0], v) for k, v in got.items()) == [(1, 1), (2, 1), (2, 2), (3, 2)]


def test_need_and_bounds():
    for a in range(1, 40):
        for b in range(a, 60):
            n = jaccard_join.need(a, b, 3, 4)
            assert 4 * n >= 3 * (a + b - n) and 4 * (n - 1) < 3 * (a + b - n + 1)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)] + [(5000, 5000)]
    up = {}
    root = lambda i: i if up.setdefault(i, i) == i else root(up[i])
    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up if i != 5000 and any(i in e and e[0] != e[1] for e in edges)}


def test_signatures_of_long_sets_still_reject():
    """Unrelated sets of one size do not pass the bound of their signatures, however long; equal ones always do."""
    rng = np.random.default_rng(3)
    for n in (5, 100, 3_000, 6_000, 20_000, 100_000):
        a, b = (np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64)) for _ in range(2))
        x, y = jaccard_join.bitmap(a), jaccard_join.bitmap(b)
        bound = lambda p, q: (len(a) + len(b) - int(np.bitwise_count(p ^ q).sum())) // 2
        assert bound(x, y) < jaccard_join.need(len(a), len(b), 3, 4) <= bound(x, x)


def test_blocks_are_bounded_by_length(spark, monkeypatch):
    """Long texts that share a passage, in blocks and tiles of few shingles, link as in one block."""
    rng = np.random.default_rng(4)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for k in range(12):
        own = [f"w{v}" for v in rng.integers(0, 1 << 40, 400)]
        rows += [(3 * k, " ".join(shared + own)), (3 * k + 1, " ".join(shared + own[:-20])), (3 * k + 2, " ".join(own[:200] + shared))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert all(whole[3 * k + 1] == 3 * k and whole[3 * k + 2] == 3 * k + 2 for k in range(12))
    monkeypatch.setattr(jaccard_join, "LOAD", 64)
    monkeypatch.setattr(jaccard_join, "TILE", 1)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, block=4).collect()} == whole
