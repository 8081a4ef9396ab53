"""BPE encoding and decoding with a published vocabulary file.

Encoding keeps a doubly linked list of symbols and a priority queue of merge
ranks for each distinct word, skipping queue entries that have gone stale.
Decoding concatenates vocabulary strings. Results equal the public
``tokenizers`` library's for files of this kind: NFC, white space to one
blank, lower case, a word pattern, byte-level symbols and a word-end suffix.

Defined results: null text is the empty text, with no tokens; strings of the
file's special tokens inside a text become those tokens; a word of any length
is encoded whole; equal texts give equal rows; extra columns are ignored.
Memory in a worker is bounded by ``CACHE`` words and one batch.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import base_columns
from .textkit import segments, slices

CACHE = 250_000
#: White space that str.split() knows and the vocabulary's pattern does not.
_ODD = re.compile("[\x1c-\x1f]")
# Ranges of letters and numbers that the ``regex`` package knows and the tokenizers library does not.
UNKNOWN = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
# First and last capital of a range and the small letter of the first, which the library knows and Python's tables may not.
CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
_SMALL = {c: low + c - a for a, b, low in CAPITALS for c in range(a, b + 1)}
_NEWER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNKNOWN) + "".join(map(chr, _SMALL)) + "]")
_UNKNOWN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNKNOWN) + "]")
#: Unassigned for good, so in no class of any version of the tables.
_UNASSIGNED = "\u0378"
_loaded: dict[str, "BpeCodec"] = {}


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest counts up from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return [chr(b) if b in plain else chr(256 + sum(1 for x in range(b) if x not in plain)) for b in range(256)]


class BpeCodec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int, int]] = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), len(self.parts))
            self.parts.append((vocab[a], vocab[b], vocab[a + b]))
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + self.suffix) for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> "BpeCodec":
        """Once in each worker process."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one word's bytes."""
        ids = [self.inner[b] for b in piece[:-1]]
        ids.append(self.last[piece[-1]])
        ids = [i for i in ids if i is not None]
        n, rank_of, parts = len(ids), self.merges, self.parts
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for at in range(n - 1):
            rank = rank_of.get((ids[at], ids[at + 1]))
            if rank is not None:
                queue.append(rank << 32 | at)
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            at = top & 0xFFFFFFFF
            a, b, whole = parts[top >> 32]
            right = after[at]
            if ids[at] != a or right >= n or ids[right] != b:
                continue  # stale: one of the two symbols has been merged since
            ids[at], ids[right] = whole, -1
            far = after[right]
            after[at] = far
            if far < n:
                before[far] = at
                rank = rank_of.get((whole, ids[far]))
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | at)
            left = before[at]
            if left >= 0:
                rank = rank_of.get((ids[left], whole))
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | left)
        return [i for i in ids if i >= 0]

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of a text without white space (or of any normalised text)."""
        low = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()
        out = array("I")
        if _NEWER.search(low):  # as the library's tables have them
            low = low.translate(_SMALL)
            spans = (m.span() for m in self.pattern.finditer(_UNKNOWN.sub(_UNASSIGNED, low)))
            pieces = [low[a:b] for a, b in spans]
        else:
            pieces = self.pattern.findall(low)
        for piece in pieces:
            out.extend(self.merge(piece.encode("utf-8", "surrogatepass")))
        return out.tobytes()

    def _cached(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self.encode_chunk(chunk)
        if len(chunk) <= 64:
            if len(self.young) >= CACHE // 2:
                self.old, self.young = self.young, {}
            self.young[chunk] = found
        return found

    def _plain(self, text: str) -> bytes:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if _ODD.search(text):
            return self.encode_chunk(text)
        young, slow = self.young, self._cached
        return b"".join([young.get(c) or slow(c) for c in text.split()])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        parts = []
        for part in self.specials.split(text):
            known = self.special.get(part)
            parts.append(self._plain(part) if known is None else known.to_bytes(4, "little"))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids; this kind of file has no decoder, so blanks part them."""
        strings = self.strings
        return " ".join([strings[i] for i in memoryview(ids).cast("I")])


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (binary, little-endian unsigned 32-bit) of every whole text."""
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec.load(vocabulary)
        for batch in batches:
            for part in slices(batch, text_col):
                ids = [codec.encode(t or "") for t in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(id_col).cast(pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return base_columns(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` long, ids binary")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, decoded string of encode()'s rows."""
    schema = pa.schema([(id_col, pa.int64()), ("decoded", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec.load(vocabulary)
        for batch in batches:
            texts = [codec.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], schema=schema)

    return base_columns(encoded, id_col, "ids").mapInArrow(run, f"`{id_col}` long, decoded string")


def encode_rows(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), ids_sha256, decoded_sha256: encode, then decode the ids, in one pass over the texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec.load(vocabulary)
        sha = hashlib.sha256
        for batch in batches:
            for part in slices(batch):
                packed, enc, dec = [], [], []
                for text in part.column("text").to_pylist():
                    ids = codec.encode(text or "")
                    packed.append(ids)
                    enc.append(sha(ids).hexdigest())
                    dec.append(sha(codec.decode(ids).encode()).hexdigest())
                sizes = np.array([len(x) // 4 for x in packed], np.int64)
                flat = pa.array(np.frombuffer(b"".join(packed), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(segments(sizes).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), lists, pa.array(enc), pa.array(dec)], schema=schema)

    return base_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids, in one pass over the texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec.load(vocabulary)
        sha = hashlib.sha256
        for batch in batches:
            for part in slices(batch):
                n, enc, dec = [], [], []
                for text in part.column("text").to_pylist():
                    ids = codec.encode(text or "")
                    n.append(len(ids) // 4)
                    enc.append(sha(ids).hexdigest())
                    dec.append(sha(codec.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(enc), pa.array(dec)], schema=schema)

    return base_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
