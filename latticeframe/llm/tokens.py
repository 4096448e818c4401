"""Whole-text encoding with public tokenizer files, by tokens of bytes that a worker remembers.

Both known pre-tokenizers begin a new word at a single space between other characters, and inside such a piece they cut
between runs of letters, digits and marks and at a single line feed. So a text's ids are those of its tokens (a run with
the space before it), one after the other. numpy finds the tokens of a chunk of texts and looks their bytes up in a hash
table that holds whole keys, so equal means equal bytes; the library encodes each new token once.

Pieces with other characters (apostrophes, other white space, letters past ɏ, ...) are one token. Texts with runs of
spaces, a space at the end or an added token's marker are one token as a whole, as are all texts if a file's
pre-tokenizer is not one of the two.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import caches
from .words import mix

U64 = np.uint64
LETTER, DIGIT, MARK, LINE, SPACE, ODD = range(6)
SHORT = 16  # bytes of a token that is a key of the table
CHUNK = 2 << 20


def _classes() -> np.ndarray:
    """Class of each byte of UTF-8. Lead bytes C3 to C9 begin U+00C0 to U+027F, letters but for two signs."""
    out = np.full(256, ODD, np.uint8)
    out[0x21:0x7F] = MARK
    out[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = LETTER
    out[[ord(c) for c in "0123456789"]] = DIGIT
    out[0x80:0xC0] = out[0xC3:0xCA] = LETTER
    out[ord("'")], out[ord("\n")], out[ord(" ")] = ODD, LINE, SPACE
    return out


CLASS = _classes()


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}, 0xFF: " "}  # FF is in no text: it parts tokens


LETTERS = _byte_letters()
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] numbers), then those from begin[1] on, and so forth."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Table:
    """Open addressing over 16-byte keys; a row is low half, high half, value + 1 (0: free)."""

    def __init__(self, bits: int = 12):
        self.bits, self.rows, self.size = bits, np.zeros((1 << bits, 3), U64), 0

    def _slot(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (mix(lo ^ hi * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 for those not held."""
        out, slot, todo = np.full(len(lo), -1, np.int64), self._slot(lo, hi), None
        while len(lo):
            row = self.rows.take(slot, axis=0)
            held = row[:, 2].astype(np.int64)
            hit = (row[:, 0] == lo) & (row[:, 1] == hi) & (held > 0)
            if todo is None:
                out[hit] = held[hit] - 1
            else:
                out[todo[hit]] = held[hit] - 1
            on = np.flatnonzero((held > 0) & ~hit)
            todo = on if todo is None else todo[on]
            lo, hi, slot = lo[on], hi[on], slot[on] + 1 & (1 << self.bits) - 1
        return out

    def add(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> None:
        """Distinct keys that are not held yet."""
        self.size += len(lo)
        if 2 * self.size > len(self.rows):
            old = self.rows[self.rows[:, 2] > 0]
            self.bits = max(self.bits + 1, (2 * self.size).bit_length())
            self.rows = np.zeros((1 << self.bits, 3), U64)
            self._put(old[:, 0], old[:, 1], old[:, 2])
        self._put(lo, hi, (value + 1).astype(U64))

    def _put(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> None:
        slot = self._slot(lo, hi)
        while len(lo):
            free = np.flatnonzero(self.rows[slot, 2] == 0)
            at, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.rows[at] = np.stack((lo[won], hi[won], value[won]), axis=1)
            rest = np.ones(len(lo), bool)
            rest[won] = False
            lo, hi, value, slot = lo[rest], hi[rest], value[rest], slot[rest] + 1 & (1 << self.bits) - 1


class TextEncoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).

    What is remembered is bounded: at most `most` tokens, then all are forgotten. markers_as_text takes the markers of
    added tokens for plain text; by default they become their tokens, as in the library.
    """

    def __init__(self, path: str, most: int = 1_000_000, markers_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = markers_as_text
        added = [] if markers_as_text else self.tokenizer.get_added_tokens_decoder().values()
        self.markers = [x.content for x in added]
        self.vocab_size, self.most = self.tokenizer.get_vocab_size(), most
        self.kind = self._kind(json.loads(self.tokenizer.to_str()))
        if any(x.normalized or x.single_word or x.lstrip or x.rstrip for x in added):
            self.kind = ""  # such a marker may reach beyond itself
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.line, self.edge = names.get("Ċ", -1), np.zeros(1 + max(names.values()), bool)  # edge: ids that begin (byte) or end (word) a word
        self.edge[[i for x, i in names.items() if (x.startswith("Ġ") if self.kind == "byte" else x.endswith("</w>"))]] = True
        self.direct = Tokenizer(self.tokenizer.model)  # for runs of one class, already in byte letters
        self.direct.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._forget()

    @staticmethod
    def _kind(config: dict) -> str:
        """byte or word: a byte-level or lower-casing word pipeline whose cuts are known; empty: unknown."""
        model, pre, norm = config["model"], config["pre_tokenizer"] or {}, config["normalizer"] or {}
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            return ""
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not norm:
            return "byte"
        steps = [x["type"] for x in norm.get("normalizers", [])], [x["type"] for x in pre.get("pretokenizers", [])]
        if steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and "\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in pre["pretokenizers"][0]["pattern"].get("Regex", ""):
            return "word"
        return ""

    def _forget(self) -> None:
        self.table, self.long = Table(), {}
        self.ids, self.at, self.used, self.n = np.zeros(1 << 14, np.uint32), np.zeros(1 << 12, np.int64), 0, 0  # ids of all tokens; where each begins

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after the other, and how many each text has."""
        found = [np.asarray(e.ids, np.uint32) for i in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _joint(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of one class: many in one call, in byte letters, past the pre-tokenizer. The vocabulary
        marks where words end (word) or begin (byte); runs without a space before them are parted by line feeds."""
        ids, sizes = [], []
        for i in range(0, len(tokens), 4096):
            some = tokens[i : i + 4096]
            raw = b"\xff".join(some)
            spaced = self.kind == "byte" and raw.count(b" ") == len(some)
            if self.kind == "word":
                raw = b"\xff".join(raw.replace(b" ", b"").replace(b"\xff", b"\n").decode().lower().encode().split(b"\n"))
            elif not spaced:
                raw = raw.replace(b"\xff", b"\xff\n\xff")
            found = np.asarray(self.direct.encode_batch_fast([raw.decode("latin-1").translate(LETTERS)], add_special_tokens=False)[0].ids, np.uint32)
            if spaced:
                ends = np.append(np.flatnonzero(self.edge[found])[1:], len(found))
            elif self.kind == "word":
                ends = np.flatnonzero(self.edge[found]) + 1
            else:
                stop = np.append(np.flatnonzero(found == self.line), len(found))
                ends = stop - np.arange(len(stop))
                found = found[found != self.line]
            if len(ends) != len(some):
                raise ValueError("the tokenizer cuts words in an unknown way")
            ids.append(found)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)

    def _push(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new tokens."""
        new, first = len(sizes), self.n
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while first + new + 1 > len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[first + 1 : first + new + 1] = self.used + np.cumsum(sizes)
        self.used, self.n = self.used + len(ids), first + new
        return np.arange(first, first + new)

    def _cuts(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where tokens begin, and whether each is a run of one class; first, last: of non-empty texts, whole: texts to leave whole."""
        kinds = CLASS[data]
        pair = np.flatnonzero((data[1:] == 0x97) | (data[1:] == 0xB7)) + 1  # the multiplication and division signs
        kinds[pair[data[pair - 1] == 0xC3]] = ODD
        cut = np.ones(len(data), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=cut[1:])
        space = np.flatnonzero(kinds == SPACE)
        cut[space[space + 1 < len(cut)] + 1] = False
        cut[space] = True
        cut[first] = True
        line = np.flatnonzero(kinds == LINE)
        before = kinds[np.maximum(line - 1, 0)]
        odd = np.concatenate((np.flatnonzero(kinds == ODD), line[(line > 0) & ((before == LINE) | (before == SPACE))]))
        spans = []
        if len(odd):
            pieces = np.union1d(space, first)
            k = np.unique(np.searchsorted(pieces, odd, "right") - 1)
            spans.append((pieces[k], np.append(pieces, len(data))[k + 1]))
        if whole.any():
            spans.append((first[whole], last[whole]))
        run = np.ones(len(data), bool) if spans else None
        for begin, end in spans:
            cut[_ranges(begin, end - begin)] = False
            cut[begin] = True
            run[begin] = False
        starts = np.flatnonzero(cut)
        return starts, np.ones(len(starts), bool) if run is None else run[starts]

    def encode_array(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each followed by end_id if given, and the bounds of each text's ids."""
        if self.table.size + len(self.long) > self.most:
            self._forget()
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        base, raw = int(offsets[0]), texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8, int(offsets[-1]) - base, base) if raw is not None and offsets[-1] > base else np.zeros(0, np.uint8)
        offsets = offsets - base
        keep = offsets[1:] > offsets[:-1]
        if not keep.any():
            return self._bounded(np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64), end_id)
        if self.kind:
            whole = pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " "))
            for m in self.markers:
                whole = pc.or_(whole, pc.match_substring(texts, m))
            whole = whole.to_numpy(zero_copy_only=False)
        else:
            whole = np.ones(len(texts), bool)
        starts, run = self._cuts(data, offsets[:-1][keep], offsets[1:][keep], whole[keep])
        sizes = np.diff(starts, append=len(data))
        short = sizes <= SHORT
        if len(nul := np.flatnonzero(data == 0)):
            short[np.searchsorted(starts, nul, "right") - 1] = False
        padded = np.concatenate((data, np.zeros(SHORT, np.uint8)))
        eight = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))
        lo = eight[starts] & MASKS[np.minimum(sizes, 8)]
        hi = eight[starts + 8 - np.where(sizes > 8, 0, 8)] & MASKS[np.clip(sizes - 8, 0, 8)]
        value = np.full(len(starts), -1, np.int64)
        value[short] = self.table.find(lo[short], hi[short])
        new = np.flatnonzero(short & (value < 0))
        if len(new):
            value[new] = self._learn(data, starts, sizes, run, lo, hi, new)
        n, used = self.n, self.used
        if not short.all():
            n, used = self._long(data, starts, sizes, value, np.flatnonzero(~short))
        begin, count = self.at[value], self.at[value + 1] - self.at[value]
        ids = self.ids[_ranges(begin, count)]
        self.n, self.used = n, used  # drops the texts and tokens that are not remembered
        done = np.concatenate(([0], np.cumsum(count)))
        return self._bounded(ids, done[np.searchsorted(starts, offsets)], end_id)

    @staticmethod
    def _bounded(ids: np.ndarray, bounds: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if end_id is None:
            return ids, bounds
        return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))

    def _learn(self, data, starts, sizes, run, lo, hi, new) -> np.ndarray:
        """Encode and remember the distinct short tokens among those at `new`; returns the numbers of all of them."""
        order = np.lexsort((hi[new], lo[new]))
        a, b = lo[new][order], hi[new][order]
        fresh = np.ones(len(new), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        one = new[order[fresh]]
        text = data.tobytes()
        tokens = [text[x:y] for x, y in zip(starts[one].tolist(), (starts[one] + sizes[one]).tolist(), strict=True)]
        kinds = CLASS[data[starts[one] + sizes[one] - 1]]
        joint = run[one] & ((kinds == LETTER) | (kinds == MARK) | ((kinds == DIGIT) & (self.kind == "byte")))
        spaced = data[starts[one]] == ord(" ")
        number = np.empty(len(one), np.int64)
        for some, make in ((joint & spaced, self._joint), (joint & ~spaced, self._joint), (~joint, lambda x: self._library([t.decode() for t in x]))):
            at = np.flatnonzero(some)
            number[at] = self._push(*make([tokens[i] for i in at.tolist()]))
        self.table.add(lo[one], hi[one], number)
        out = np.empty(len(new), np.int64)
        out[order] = number[np.cumsum(fresh) - 1]
        return out

    def _long(self, data, starts, sizes, value, at) -> tuple[int, int]:
        """Fill in the numbers of long tokens; those past 64 bytes are not remembered. Returns what is to be kept."""
        keys = [data[x:y].tobytes() for x, y in zip(starts[at].tolist(), (starts[at] + sizes[at]).tolist(), strict=True)]
        new = list(dict.fromkeys(k for k in keys if len(k) <= 64 and k not in self.long))
        self.long.update(zip(new, self._push(*self._library([k.decode() for k in new])).tolist(), strict=True))
        n, used = self.n, self.used
        rest = list(dict.fromkeys(k for k in keys if len(k) > 64))
        here = dict(zip(rest, self._push(*self._library([k.decode() for k in rest])).tolist(), strict=True))
        value[at] = [self.long[k] if len(k) <= 64 else here[k] for k in keys]
        return n, used

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        ids, bounds = self.encode_array(pa.array(texts, pa.string()))
        data = ids.astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_LOADED: dict[str, TextEncoder] = {}
caches.register("tokens", _LOADED.clear)


def encoder(path: str) -> TextEncoder:
    """One encoder for each tokenizer file and worker."""
    caches.only("tokens")
    if path not in _LOADED:
        _LOADED[path] = TextEncoder(path)
    return _LOADED[path]


def slices(batch: pa.RecordBatch, col: int, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, at least one row."""
    size = pc.binary_length(batch.column(col)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // most
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def chunks(texts: list, most: int = 400_000, chars: int = 1_000_000):
    """Slices of bounded length and size."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if i + 1 - begin >= most or size >= chars or i + 1 == len(texts):
            yield begin, i + 1
            begin, size = i + 1, 0
