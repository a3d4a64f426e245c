"""Byte-pair encoding and decoding of whole texts.

Byte vocabulary: two neighbouring bytes that stand together in no vocabulary token can never end up in one token, so a
text may be cut there for certain. Texts are cut at all such places at once (one table lookup a byte), the fragments
are encoded independently and memoised, and their ids are concatenated.

Word vocabulary (lower-cased, white space dropped, word ends marked): white space is the certain boundary.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import numpy as np
import xxhash
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_steps
from .vector import LOWERED, span_hashes, words

#: The pre-tokenising pattern of the byte vocabulary, and of the word vocabulary.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
SUFFIX = "</w>"
#: Spans that a worker remembers (about 100 bytes each).
MEMO = 1_000_000


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else 256 onwards in order."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def vocabulary(path: str) -> bytes:
    """The file's bytes, read by the driver; executors get them from it and never open a path."""
    with open(path, "rb") as f:
        return f.read()


def ragged(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[start : start + length] of every pair, one after the other."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    at = np.arange(ends[-1], dtype=np.int64)
    at += np.repeat(start - (ends - length), length)
    return pool[at]


#: Spans of more bytes than this are hashed one by one.
LONG_SPAN = 256


class SpanMemo:
    """Ids of spans of bytes, remembered under a 64-bit hash of their bytes and length; open addressing over arrays.

    encode(bytes) gives the ids of a span that is not yet known. Beyond MEMO spans the memory starts anew.
    """

    def __init__(self, encode, decimals: bool = False):
        self.encode, self.decimals = encode, decimals
        self.reset(MEMO)

    def reset(self, room: int) -> None:
        self.bits = int(2 * room).bit_length()
        self.room, self.n = room, 0
        self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.start, self.length = np.zeros(room, np.int64), np.zeros(room, np.int32)
        self.pool, self.used = np.zeros(4 * room, np.uint32), 0
        self.text = np.full(room, b"", object) if self.decimals else None

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 if unknown."""
        out = np.full(len(h), -1, np.int32)
        left, slot = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            k = self.keys[slot]
            hit = k == h[left]
            out[left[hit]] = self.slots[slot[hit]]
            go = ~hit & (k != 0)
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray, spans: list[bytes]) -> None:
        got = [self.encode(s) for s in spans]
        n, size = len(got), np.fromiter(map(len, got), np.int64, len(got))
        need = self.used + int(size.sum())
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(need, np.uint32)])
        self.pool[self.used : need] = np.fromiter((i for x in got for i in x), np.uint32, int(size.sum()))
        entry = np.arange(self.n, self.n + n)
        self.start[entry], self.length[entry] = self.used + np.cumsum(size) - size, size
        if self.text is not None:
            self.text[entry] = [("%d," * len(x) % tuple(x)).encode() for x in got]
        self.n, self.used = self.n + n, need
        left, slot = np.arange(n), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            at, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[at], self.slots[at] = h[left[won]], entry[left[won]]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, slot = left[stay], slot[stay]
            taken = self.keys[slot] != 0
            slot = np.where(taken, (slot + 1) & ((1 << self.bits) - 1), slot)

    def entries(self, data: bytes, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = span_hashes(buf, starts, ends)
        for i in np.flatnonzero(ends - starts > LONG_SPAN).tolist():  # a polynomial has known collisions of long spans
            h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
        h |= np.uint64(1)
        found = self.find(h)
        if len(new := np.flatnonzero(found < 0)):
            keys, first = np.unique(h[new], return_index=True)
            if self.n + len(keys) > self.room:
                self.reset(max(MEMO, 2 * len(h)))
                new = np.arange(len(h))
                keys, first = np.unique(h, return_index=True)
            at = new[first]
            self.add(keys, [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            found[new] = self.find(h[new])
        return found

    def ids(self, entries: np.ndarray) -> np.ndarray:
        return ragged(self.pool, self.start[entries], self.length[entries])


class Encoded:
    """Ids of a run of texts: row r has ids[off[r] : off[r + 1]]."""

    def __init__(self, ids: np.ndarray, off: np.ndarray, decimals: list[bytes] | None = None):
        self.ids, self.off, self.decimals = ids, off, decimals


class ByteCodec:
    def __init__(self, spec: dict, decimals: bool):
        back = {c: b for b, c in enumerate(byte_chars())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        every = [*vocab.items(), *((s.encode(), i) for s, i in self.special.items())]
        size = max(i for _, i in every) + 1
        self.start, self.length = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.bytes = np.frombuffer(b"".join(t for t, _ in every), np.uint8)
        self.length[[i for _, i in every]] = [len(t) for t, _ in every]
        self.start[[i for _, i in every]] = np.cumsum([0, *(len(t) for t, _ in every)])[:-1]
        inside = np.zeros((256, 256), bool)
        for t in vocab:
            a = np.frombuffer(t, np.uint8)
            inside[a[:-1], a[1:]] = True
        #: certain cuts as a function of the byte before and the byte after. Kept whole besides: white space with what
        #: follows it, what an apostrophe starts, and the bytes of one character; there the pattern looks further.
        cut = ~inside
        for t in (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d"):
            cut[list(t[:-1]), list(t[1:])] = False
        cut[[*range(0x09, 0x0E), *range(0x1C, 0x21)], :] = False
        cut[:, 0x80:0xC0] = False
        cut[:, 0x27] = False
        self.cut = cut.ravel()
        self.near = np.isin(np.arange(256), [0xE1, 0xE2, 0xE3, 0xEF])  # first bytes of three-byte white space
        self.core = tiktoken.Encoding("byte", pat_str=BYTE_PATTERN, mergeable_ranks=vocab, special_tokens={})._core_bpe
        self.pattern = regex.compile(BYTE_PATTERN)
        self.split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.memo = SpanMemo(self.fragment, decimals)

    def cuts(self, b: np.ndarray) -> np.ndarray:
        """Positions in b before which a cut is certain."""
        if len(b) < 2:
            return np.zeros(0, np.int64)
        ok = self.cut[(b[:-1].astype(np.uint16) << 8) | b[1:]]
        wide = b[:-1] >= 0x80
        if len(b) > 2:
            wide[1:] &= (b[:-2] == 0xC2) | np.concatenate([[False], self.near[b[:-3]]])
        return np.flatnonzero(ok & ~wide) + 1

    def fragment(self, f: bytes) -> list[int]:
        if f[f[:1] == b" " :].isalpha():  # one piece: ASCII letters after a space at most
            return self.core.encode_single_piece(f)
        w = f.decode()
        if w[w[:1] == " " :].isalpha():
            return self.core.encode_single_piece(f)
        ids: list[int] = []
        for piece in self.pattern.findall(w):
            ids += self.core.encode_single_piece(piece.encode())
        return ids

    def plain(self, data: bytes, buf: np.ndarray, off: np.ndarray) -> Encoded:
        edge = np.zeros(len(buf) + 1, bool)
        edge[self.cuts(buf)] = True
        edge[off] = True
        at = np.flatnonzero(edge)
        entries = self.memo.entries(data, buf, at[:-1], at[1:])
        first = np.searchsorted(at, off)
        ends = np.concatenate([[0], np.cumsum(self.memo.length[entries])])[first]
        decimals = None
        if self.memo.text is not None:
            text = self.memo.text[entries]
            decimals = [b"".join(text[a:b].tolist())[:-1] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return Encoded(self.memo.ids(entries), ends, decimals)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> Encoded:
        """The ids of every row; special tokens count as such wherever their text occurs, as the library has it."""
        data = buf.tobytes()
        if self.split is None or not any(s.encode() in data for s in self.special):
            return self.plain(data, buf, off)
        ids, ends, decimals = [], [0], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            text, row, at = data[a:b].decode(), [], 0
            for m in [*self.split.finditer(text), None]:
                if part := text[at : m.start() if m else None].encode():
                    row.append(self.plain(part, np.frombuffer(part, np.uint8), np.array([0, len(part)])).ids)
                if m:
                    at = m.end()
                    row.append(np.array([self.special[m[0]]], np.uint32))
            ids.append(np.concatenate(row) if row else np.zeros(0, np.uint32))
            ends.append(ends[-1] + len(ids[-1]))
            decimals.append(",".join(map(str, ids[-1].tolist())).encode())
        return Encoded(np.concatenate(ids), np.array(ends), decimals)

    def decode(self, ids: np.ndarray) -> str:
        return ragged(self.bytes, self.start[ids], self.length[ids]).tobytes().decode("utf-8", "replace")


_LETTER, _SIGN, _DIGIT = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = _SIGN
_KIND[48:58] = _DIGIT
_PARTS = np.zeros((4, 4), bool)
for _a, _b in ((_LETTER, _SIGN), (_LETTER, _DIGIT), (_SIGN, _DIGIT)):
    _PARTS[_a, _b] = _PARTS[_b, _a] = True
_PARTS[_DIGIT, _DIGIT] = True


class WordCodec:
    """Ids of the word vocabulary. Letters, the bulk of any text, go through a merge core over one-byte symbols."""

    def __init__(self, spec: dict, raw: bytes):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_str(raw.decode())
        self.exact.no_truncation()
        self.exact.no_padding()
        self.model = self.exact.model
        self.chars = byte_chars()
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special_bytes = [t.encode() for t in specials]
        # one byte for every symbol that a lower-case word can hold: letters and bytes of UTF-8, last in a word or not
        usual = [*range(97, 123), *range(0x80, 0xC0), *range(0xC2, 0xF5)]
        ends = [*range(97, 123), *range(0x80, 0xC0)]
        symbol = {b: i for i, b in enumerate(usual)}
        last = {b: len(usual) + i for i, b in enumerate(ends)}
        back = {c: b for b, c in enumerate(self.chars)}
        ranks = {}
        for t, i in spec["model"]["vocab"].items():
            ended = t.endswith(SUFFIX)
            body = [back.get(c, -1) for c in (t[: -len(SUFFIX)] if ended else t)]
            if not body or t in specials:
                continue
            code = [symbol.get(b, -1) for b in body]
            if ended:
                code[-1] = last.get(body[-1], -1)
            if min(code) >= 0:
                ranks[bytes(code)] = i
        self.core = tiktoken.Encoding("word", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.translate = bytes(symbol.get(b, 0) for b in range(256))
        self.end = {b: bytes([i]) for b, i in last.items()}
        self.pattern = regex.compile(WORD_PATTERN)
        self.letters = regex.compile(r"\p{L}")
        self.pieces: dict[str, list[int]] = {}
        # what the library's normaliser or its special tokens could treat otherwise goes to the library itself
        self.odd = regex.compile(r"[\x1c-\x1f\u03A3\u0130\u0085\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]|" + "|".join(map(re.escape, specials)))
        self.memo = SpanMemo(self.word)

    def word(self, raw: bytes) -> list[int]:
        if raw.isalpha():  # ASCII letters, folded by the caller
            return self.core.encode_single_piece(raw[:-1].translate(self.translate) + self.end[raw[-1]])
        w = raw.decode()
        if w.isalpha() and "\u03a3" not in w and "\u0130" not in w:
            return self.piece(unicodedata.normalize("NFC", w).lower(), False)
        if self.odd.search(w):
            return self.exact.encode(w, add_special_tokens=False).ids
        ids: list[int] = []
        for p in self.pattern.findall(w.lower() if w.isascii() else unicodedata.normalize("NFC", w).lower()):
            ids += self.pieces.get(p) or self.piece(p)
        return ids

    def piece(self, p: str, keep: bool = True) -> list[int]:
        raw = p.encode()
        if not keep or self.letters.match(p):
            ids = self.core.encode_single_piece(raw[:-1].translate(self.translate) + self.end[raw[-1]])
        else:
            ids = [t.id for t in self.model.tokenize("".join([self.chars[b] for b in raw]))]
        if keep:
            if len(self.pieces) >= 100_000:
                self.pieces.clear()
            self.pieces[p] = ids
        return ids

    def cuts(self, b: np.ndarray) -> np.ndarray:
        """Positions inside words before which a piece certainly ends: between letters, digits and other signs of
        ASCII (or Latin-1 letters), never beside an apostrophe or another non-ASCII character."""
        if len(b) < 2:
            return np.zeros(0, np.int64)
        kind = _KIND[b]
        accent = (b[:-1] == 0xC3) & (b[1:] != 0x97) & (b[1:] != 0xB7)
        kind[:-1][accent] = _LETTER
        kind[1:][accent] = _LETTER
        ok = _PARTS[kind[:-1], kind[1:]]
        ok[accent] = False
        return np.flatnonzero(ok) + 1

    def encode(self, buf: np.ndarray, off: np.ndarray) -> Encoded:
        """The ids of every row, span by span: white space is dropped, and case is folded before spans are looked up."""
        data = buf.tobytes()
        starts, ends, woff = words(buf, off)
        if not any(t in data for t in self.special_bytes):
            cuts = self.cuts(buf)
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
            woff = np.searchsorted(starts, off)
        buf = LOWERED[buf]
        entries = self.memo.entries(buf.tobytes(), buf, starts, ends)
        return Encoded(self.memo.ids(entries), np.concatenate([[0], np.cumsum(self.memo.length[entries])])[woff])


@functools.lru_cache(4)
def _codec(kind: str, raw: bytes):
    spec = json.loads(raw)
    return WordCodec(spec, raw) if kind == "word" else ByteCodec(spec, kind == "byte+decimals")


class Shared:
    """A codec that executors build once each from the vocabulary bytes the driver broadcast (1 to 2 MB, fixed)."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "byte"):
        self.kind, self.raw = kind, spark.sparkContext.broadcast(vocabulary(path))

    def __reduce__(self):
        return (_reopen, (self.kind, self.raw))

    def __call__(self) -> ByteCodec | WordCodec:
        return _codec(self.kind, self.raw.value)


def _reopen(kind, raw):
    shared = Shared.__new__(Shared)
    shared.kind, shared.raw = kind, raw
    return shared


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the byte vocabulary's ids of every whole text. Null and empty texts have no ids."""
    codec = Shared(docs.sparkSession, path)

    def run(batches):
        c = codec()
        for b in batches:
            for a, e, buf, off in text_steps(b.column(1)):
                got = c.encode(buf, off)
                ids = pa.ListArray.from_arrays(got.off.astype(np.int32), pa.array(got.ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), ids], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the inverse of encode, for any ids; bytes that are not UTF-8 become U+FFFD. Null ids read as none."""
    codec = Shared(encoded.sparkSession, path)

    def run(batches):
        c = codec()
        for b in batches:
            texts = [c.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long"), ids_col).mapInArrow(run, "doc_id long, text string")


def encode_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and then decoded from its ids alone.

    Null texts count as empty; rows that repeat an id are encoded one by one; other columns are never read.
    """
    codec = Shared(docs.sparkSession, path, "byte+decimals")

    def run(batches):
        c = codec()
        for b in batches:
            for a, e, buf, off in text_steps(b.column(1)):
                got = c.encode(buf, off)
                rows = list(zip(got.off[:-1].tolist(), got.off[1:].tolist(), strict=True))
                one = [hashlib.sha256(x).hexdigest() for x in got.decimals]
                two = [hashlib.sha256(c.decode(got.ids[s:t]).encode()).hexdigest() for s, t in rows]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), pa.array(np.diff(got.off), pa.int64()), pa.array(one), pa.array(two)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
