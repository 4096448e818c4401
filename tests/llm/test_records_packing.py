import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from latticeframe.llm import packing, token_records, tokens
from latticeframe.llm.queries import tokenizer
from latticeframe.llm.shared import file_system, new_dir
from latticeframe.llm.tokens import TextEncoder

BYTES, WORDS = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")


def reference(path, texts):
    t = Tokenizer.from_file(path)  # nothing else set
    return [np.asarray(e.ids, "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(path, documents):
    texts = [r[0] for r in documents.select("text").collect()]
    texts += ["", " ", "a  b", "a ", "x\n\ny", "x \n y", "it's 'tis we'll", "日本語 テ。\nは", "<|endoftext|> a", "word.,!\nÉcole 3.5", "á b ́c", "ΣΑΣ. ß", "a\r\nb", "a b c　d", "A|B | C |\nD"]
    for most in (50, 400_000):
        e = TextEncoder(path, most)
        for at in range(0, len(texts), 40):
            assert e.encode(texts[at : at + 40]) == [x.tobytes() for x in reference(path, texts[at : at + 40])]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_markers_as_the_library_finds_them(path):
    plain = Tokenizer.from_file(path)  # nothing else set
    texts = ["a <|endoftext|> b", "<|endoftext|>", "one two<|endoftext|>three four", "x  <|endoftext|> ", "a <|ENDOFTEXT|> b", "<|startoftext|> a\nb <|endof text|>", "a b, c"]
    assert tokens.encoder(path).encode(texts) == [np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_operators_keep_markers(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    records = token_records.read_records(spark, token_records.write_records(docs, new_dir(spark, "t"), BYTES)).collect()
    packed = packing.pack(docs, WORDS, 64).collect()
    assert [r.ids_crc32 for r in records] == [zlib.crc32(np.asarray([64, 220, 50256, 275, 0], "<u4").tobytes())]
    assert [r.ids_crc32 for r in packed] == [zlib.crc32(np.asarray([320, 49407, 321, 1], "<u4").tobytes())]


ENCODERS = {p: TextEncoder(p, 200) for p in (BYTES, WORDS)}
TOKENIZERS = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'!aAbBzéÉßñΣя1×\0ɏɐ"), st.characters(codec="utf-8")), max_size=60))
def test_encoder_on_any_text(text):
    for path, e in ENCODERS.items():
        assert e.encode([text])[0] == np.asarray(TOKENIZERS[path].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_records_round_trip(spark, odd):
    manifest = token_records.write_records(odd, new_dir(spark, "t"), BYTES)
    got = sorted(token_records.read_records(spark, manifest).collect(), key=lambda r: r.start)
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    start = 0
    for g, (_, text), ids in zip(got, rows, reference(BYTES, [r[1] for r in rows]), strict=True):
        ids = np.append(ids, 0).astype("<u4")
        assert (g.start, g.n_tokens) == (start, len(ids))
        if g.doc_id != 2:
            assert g.ids_crc32 == zlib.crc32(ids.tobytes()), text
        start += len(ids)


def test_record_index_and_damage(spark, documents):
    manifest = token_records.write_records(documents.limit(20), new_dir(spark, "t"), BYTES, shards=2)
    for m in manifest:
        index = token_records.read_index(m["path"] + ".idx")
        assert len(index) == m["docs"] and index[:, 2].sum() == m["tokens"]
        for doc_id, offset, n in index[::-1]:  # in any order
            got, ids = token_records.read_at(m["path"] + ".rec", int(offset))
            assert got == doc_id and len(ids) == n
    files, path = file_system(manifest[0]["path"] + ".rec")
    data = bytearray(files.open_input_stream(path).read())
    data[30] ^= 1
    import io

    with pytest.raises(ValueError, match="checksum"):
        token_records.read_frame(io.BytesIO(bytes(data)))
    with pytest.raises(ValueError, match="checksum"):
        token_records.read_frame(io.BytesIO(bytes(data[:20])))


def test_mask():
    import struct

    crc = zlib.crc32(b"abc")
    assert token_records.masked(b"abc") == (((crc >> 15) | (crc << 17 & 0xFFFFFFFF)) + 0xA282EAD8) % (1 << 32)
    assert struct.unpack("<Q", token_records.frame(b"abc")[:8])[0] == 3


def test_empty_tables(spark, odd):
    none = odd.where("false")
    assert token_records.read_records(spark, token_records.write_records(none, new_dir(spark, "t"), BYTES)).count() == 0
    assert packing.pack(none, WORDS).count() == 0


def check_packing(rows, max_len):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_len
    return len(seqs)


@pytest.mark.parametrize("max_len", [64, 512, 4096])
def test_packing(spark, odd, documents, max_len):
    docs = documents.select("doc_id", "text").unionByName(odd.select((1000 + odd.doc_id).alias("doc_id"), "text"))
    rows = packing.pack(docs, WORDS, max_len).collect()
    n = check_packing(rows, max_len)
    total = sum(r.length for r in rows)
    assert n <= 1.02 * -(-total // max_len) + 2
    texts = {r[0]: r[1] for r in docs.where("doc_id is not null and doc_id <> 1002").collect()}
    ids = dict(zip(texts, reference(WORDS, texts.values()), strict=True))
    for r in rows:
        if r.doc_id in ids:
            own = np.append(ids[r.doc_id], 1).astype("<u4")[r.start : r.start + max_len]
            assert r.start == r.piece * max_len and r.length == len(own) and r.ids_crc32 == zlib.crc32(own.tobytes())
    assert sum(r.doc_id == 1002 for r in rows) == 2 * sum(r.doc_id == 1001 for r in rows)


def best_fit(histogram, most):
    """Sequences that best fit by decreasing length takes, one piece at a time."""
    rooms = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        at = bisect_left(rooms, n)
        rest = (rooms.pop(at) if at < len(rooms) else most) - n
        insort(rooms, rest)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 500), max_size=40))
def test_plan_covers_the_histogram(histogram):
    groups = packing.plan(histogram, 100, 32)
    seen = {}
    for runs, many in groups:
        assert many > 0 and sum(n * r for n, r in runs) <= 100
        for n, r in runs:
            seen[n] = seen.get(n, 0) + r * many
    assert seen == histogram
    assert sum(m for _, m in groups) <= 1.05 * best_fit(histogram, 100) + 2


def test_nnls():
    rng = np.random.default_rng(0)
    a, x = rng.random((30, 12)), np.maximum(0, rng.standard_normal(12))
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    y = packing.nnls(a, -np.ones(30))
    assert (y == 0).all()


def test_sequences(spark, documents):
    packed = packing.pack(documents.limit(30), WORDS, 512, with_ids=True)
    out = packing.sequences(packed).collect()
    assert all(4 * r.tokens == len(r.ids) and r.tokens <= 512 for r in out) and sum(r.tokens for r in out) == packed.agg({"length": "sum"}).first()[0]


def test_salted_ranks(spark):
    rows = [(i, 0, 0, 10 if i % 3 else 7, i) for i in range(9000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.assign(pieces, 64).collect()
    assert len(out) == 9000 and check_packing(out, 64) <= 1.05 * best_fit(Counter(r[3] for r in rows), 64) + 2
