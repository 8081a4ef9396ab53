"""Alignment of two tokenizations of one text by bitsets of token ends.

Tokenizer A (a ``tokenizers`` file with byte-level symbols) and tokenizer B (a
``sentencepiece`` model with byte fallback) both encode a blank and the text.
The last byte of each token is a bit; the AND of both bitsets gives the shared
cuts, ranks by population counts map byte places to token numbers, and each A
token expands to its links, the B tokens whose bytes overlap its own. Corpus
counts of linked id pairs then tell which links are the most frequent of their
B id.

A blank between two characters that are no white space ends a token of both
(no symbol of B holds a blank behind another character; this is checked on
loading), so a text is cut there and each distinct unit of a chunk of documents
is encoded and aligned once. What a document has is made up from its units; a
text without such blanks is one unit.

Counting takes no table of all pairs anywhere: a chunk of ``CHUNK_BYTES`` of
text (or one longer document) has one row of its distinct pairs, chunks' rows
are summed by pair, and the sums join back to the chunks' pairs. The highest
count of each B id is broadcast: a row for each id of B's vocabulary at most.
A pair or word of any frequency is one row for each chunk.

Defined results: null and empty texts have no tokens, nor have texts whose
tokens' bytes are not a blank and the text (zeros, and '' for the digest);
strings of special tokens are ordinary text; rows may repeat, null doc_ids stay;
texts of any length are whole; an empty table gives no rows; extra columns are
ignored. Ids and byte offsets of long texts are 64-bit. Memory in a worker grows
with a chunk's text only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .shared import base_columns, materialize
from .textkit import segments, slices

CHUNK_BYTES = 16 << 20
#: Space of B's ids inside a packed pair.
B_BITS = 20
#: Two blanks or other white space beside a blank: then a text is cut with more care.
_ODD = re.compile(r"^ | $|\s | \s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[tuple[str, str], "TokenPair"] = {}


def units_of(text: str) -> list[str]:
    """The text's units, each without the blank that stands before it."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class Bitset:
    """Bits packed in 64-bit words, with ranks by population counts."""

    def __init__(self, places: np.ndarray, size: int):
        self.words = np.zeros((size >> 6) + 1, np.uint64)
        np.bitwise_or.at(self.words, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
        self._count()

    def _count(self) -> None:
        self.before = segments(np.bitwise_count(self.words).astype(np.int64))

    def __and__(self, other: "Bitset") -> "Bitset":
        out = object.__new__(Bitset)
        out.words = self.words & other.words
        out._count()
        return out

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Bits set before each place."""
        low = self.words[places >> 6] & ((np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[places >> 6] + np.bitwise_count(low)

    def select(self) -> np.ndarray:
        """Places of all bits that are set."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Alignment:
    """Tokens, groups and links of consecutive texts; token and byte places count through all of them."""

    def __init__(self, a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray, text_ends: np.ndarray):
        self.a_ids, self.b_ids = a_ids, b_ids
        size = int(text_ends[-1]) if len(text_ends) else 0
        a, b = Bitset(a_ends - 1, size), Bitset(b_ends - 1, size)
        cuts = (a & b).select()
        # of groups: the tokens before each one's end, and the bytes
        self.a_upto, self.b_upto, self.cuts = a.rank(cuts) + 1, b.rank(cuts) + 1, cuts + 1
        of_text = lambda upto: np.diff(np.searchsorted(upto, text_ends, side="right"), prepend=0)
        self.n_a, self.n_b, self.n_groups = of_text(a_ends), of_text(b_ends), of_text(self.cuts)
        # links: an A token meets the B tokens from the one that holds its first byte to the one that holds its last
        first = b.rank(np.concatenate([[0], a_ends[:-1]]).astype(np.int64)[: len(a_ends)])
        self.linked = b.rank(a_ends - 1) - first + 1
        self.link_a = np.repeat(np.arange(len(a_ends)), self.linked)
        start = segments(self.linked)
        self.link_b = np.arange(start[-1]) - np.repeat(start[:-1] - first, self.linked)
        self.links_upto = start[segments(self.n_a)]  # of texts, from 0

    def packed_links(self) -> np.ndarray:
        return self.a_ids[self.link_a].astype(np.int64) << B_BITS | self.b_ids[self.link_b]

    def group_texts(self) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2;`` of all groups as bytes, and where each text's begin."""
        n_a, n_b = len(self.a_ids), len(self.b_ids)
        a_size, b_size = np.diff(self.a_upto, prepend=0), np.diff(self.b_upto, prepend=0)
        ids, mark = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        at_a = np.arange(n_a) + np.repeat(self.b_upto - b_size, a_size)
        at_b = np.arange(n_b) + np.repeat(self.a_upto, b_size)
        ids[at_a], ids[at_b] = self.a_ids, self.b_ids
        mark[at_a[self.a_upto - 1]], mark[at_b[self.b_upto - 1]] = ord("|"), ord(";")
        digits = np.zeros((len(ids), 8), np.uint8)
        digits[:, 7] = mark
        rest = ids.copy()
        for k in range(6, -1, -1):
            digits[:, k] = np.where((rest > 0) | (k == 6), rest % 10 + 48, 0)
            rest //= 10
        filled = digits != 0
        sizes = segments(filled.sum(1))
        return digits[filled], sizes[segments(self.n_a + self.n_b)]


class TokenPair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {s: i for i, s in enumerate(byte_symbols())}
        names = self.a.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for s, i in names.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(pieces) >= 1 << B_BITS or len(self.a_bytes) >= 10**7:
            raise ValueError("vocabulary too large")
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("B has symbols over word ends, so texts can't be cut there")
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)

    @classmethod
    def load(cls, a_path: str, b_path: str) -> "TokenPair":
        """Once in each worker process."""
        if (a_path, b_path) not in _loaded:
            _loaded[a_path, b_path] = cls(a_path, b_path)
        return _loaded[a_path, b_path]

    def align(self, units: list[str]) -> tuple[Alignment, np.ndarray]:
        """The alignment of a blank and each unit, and which units' tokens spell it; the others have no tokens."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        want = [b" " + u.encode() for u in units]
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        ok = np.fromiter((b"".join([a_bytes[i] for i in x]) == w == b"".join([b_bytes[i] for i in y]) for x, y, w in zip(a, b, want, strict=True)), bool, len(units))
        flat = lambda lists: np.array([i for x, good in zip(lists, ok.tolist(), strict=True) if good for i in x], np.int64)
        a_ids, b_ids = flat(a), flat(b)
        ends = np.cumsum(np.where(ok, [len(w) for w in want], 0))
        return Alignment(a_ids, np.cumsum(self.a_size[a_ids]), b_ids, np.cumsum(self.b_size[b_ids]), ends), ok


def ragged(values: np.ndarray, starts: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``picks`` of values, one behind the other, and their offsets."""
    size = np.diff(starts)[picks]
    at = segments(size)
    return values[np.arange(at[-1]) - np.repeat(at[:-1] - starts[:-1][picks], size)], at


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.diff(segments(values)[starts])


class Chunk:
    """Documents whose units are numbered together; each distinct unit is aligned once."""

    #: Units that are aligned at a time.
    STEP = 50_000

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.doc_ids: list[int | None] = []
        self.units: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        codes = self.codes
        own = [codes.setdefault(u, len(codes)) for u in units_of(text)] if text else []
        self.doc_ids.append(doc_id)
        self.units.append(np.array(own, np.int32))
        self.bytes += len(text or "") + 16

    def aligned(self, pair: TokenPair) -> Iterator[tuple[Alignment, np.ndarray]]:
        names = list(self.codes)
        lo = 0
        while lo < len(names):
            hi, size = lo, 0
            while hi < len(names) and hi - lo < self.STEP and (hi == lo or size < 4 << 20):
                size += len(names[hi])
                hi += 1
            yield pair.align(names[lo:hi])
            lo = hi

    def rows(self, pair: TokenPair, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row for each document, then one for the chunk."""
        parts = list(self.aligned(pair))
        joined = lambda arrays: np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
        n_a, n_b, n_groups = (joined([getattr(p, name) for p, _ in parts]) for name in ("n_a", "n_b", "n_groups"))
        ok = joined([good for _, good in parts]).astype(bool)
        links = joined([p.packed_links() for p, _ in parts])
        starts = segments(joined([np.diff(p.links_upto) for p, _ in parts]))
        texts = [p.group_texts() for p, _ in parts]
        strings = [t[a:b].tobytes() for t, at in texts for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        del parts, texts
        at = segments(np.array([len(u) for u in self.units], np.int64))
        flat = np.concatenate(self.units) if self.units else np.zeros(0, np.int32)
        good = sums((~ok[flat]).astype(np.int64), at) == 0
        good &= np.diff(at) > 0
        flat = flat[np.repeat(good, np.diff(at))]
        at = segments(np.where(good, np.diff(at), 0))
        digests, packed = [], []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = flat[lo:hi]
            digests.append(hashlib.sha256(b"".join([strings[u] for u in own.tolist()])[:-1]).hexdigest() if hi > lo else "")
            packed.append(np.diff(np.sort(own), prepend=0).astype(np.int32).tobytes())
        per_doc = [sums(x[flat], at) for x in (n_a, n_b, n_groups, np.diff(starts))]
        n = len(self.doc_ids)
        none = pa.nulls(n, pa.list_(pa.int64()))
        columns = [pa.array(np.full(n, number, np.int64)), pa.array(self.doc_ids, pa.int64()), *(pa.array(x.astype(np.int64)) for x in per_doc), pa.array(digests), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, none, none, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=schema)
        times = np.bincount(flat, minlength=len(n_a))
        pairs, own = np.unique(links, return_inverse=True)
        counts = np.bincount(own, weights=np.repeat(times, np.diff(starts)), minlength=len(pairs)).astype(np.int64)
        blank = [pa.nulls(1, schema.field(k).type) for k in range(1, 8)]
        last = [pa.array([number]), *blank, pa.array([pairs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([starts.astype(np.int64).tobytes()], pa.binary()), pa.array([own.astype(np.int32).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(last, schema=schema)


CHUNK_SCHEMA = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, pairs array<long>, counts array<long>, starts binary, links binary"
_CHUNK = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("units", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("starts", pa.binary()), ("links", pa.binary())])


def align_chunks(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of documents (what they have by themselves, and their sorted units) and of chunks (distinct pairs, counts and the units' links)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = TokenPair.load(a_path, b_path)
        # the same number in every attempt of a task
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk()
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    chunk.add(doc_id, text)
                    if chunk.bytes >= chunk_bytes:
                        yield from chunk.rows(pair, number, _CHUNK)
                        number, chunk = number + 1, Chunk()
        if chunk.doc_ids:
            yield from chunk.rows(pair, number, _CHUNK)

    return base_columns(docs, "doc_id", "text").mapInArrow(run, CHUNK_SCHEMA)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair (packed), n and best (whether no pair of the B id has more) of the whole corpus."""
    each = chunks.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.pairs", "x.counts")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


SUM_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_SUMS = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def sum_documents(docs: pa.Table, known: pa.Table) -> pa.Table:
    """A chunk's documents with the counts of its pairs (code, n, best)."""
    whole = docs.filter(pc.is_valid(docs["pairs"]))
    rows = docs.filter(pc.is_null(docs["pairs"])).combine_chunks()
    starts = np.frombuffer(whole["starts"][0].as_py(), np.int64)
    links = np.frombuffer(whole["links"][0].as_py(), np.int32)
    n, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, np.int64)
    code = known["code"].to_numpy()
    n[code], best[code] = known["n"].to_numpy(), known["best"].to_numpy().astype(np.int64)
    unit_n, unit_best = sums(n[links], starts), sums(best[links], starts)
    packed = rows["units"].to_pylist()
    at = segments(np.array([len(x) // 4 for x in packed], np.int64))
    delta = np.frombuffer(b"".join(packed), np.int32).astype(np.int64)
    level = segments(delta)
    unit = level[1:] - np.repeat(level[at[:-1]], np.diff(at))
    out = [rows[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.Table.from_arrays([*out, pa.array(sums(unit_best[unit], at)), pa.array(sums(unit_n[unit], at)), rows["groups_sha256"]], schema=_SUMS)


def alignment_digests(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    chunks = materialize(align_chunks(docs, a_path, b_path, chunk_bytes), "alignment", compression="zstd")
    each = chunks.where("pairs IS NOT NULL").select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("code", "pair"))
    known = each.join(pair_counts(chunks), "pair").select("of", "code", "n", "best")
    return chunks.drop("counts").groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(sum_documents, SUM_SCHEMA)


ROWS_SCHEMA = "doc_id long, a_ids array<int>, b_ids array<int>, groups array<struct<a_upto:long,b_upto:long,byte_upto:long>>, links array<struct<a:long,b:long>>"


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, the ids of both tokenizers, groups (tokens and bytes before each one's end) and links (numbers of an A and a B token) of each row."""
    group, link = pa.struct([("a_upto", pa.int64()), ("b_upto", pa.int64()), ("byte_upto", pa.int64())]), pa.struct([("a", pa.int64()), ("b", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("groups", pa.list_(group)), ("links", pa.list_(link))])

    def lists(at: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = TokenPair.load(a_path, b_path)
        for batch in batches:
            for part in slices(batch):
                units = [units_of(t) if t else [] for t in part.column("text").to_pylist()]
                x, ok = pair.align([u for own in units for u in own])
                doc = segments(np.array([len(u) for u in units], np.int64))
                bad = sums((~ok).astype(np.int64), doc) > 0
                upto = lambda per_unit: segments(per_unit)[doc]
                a, b, g, k = upto(x.n_a), upto(x.n_b), upto(x.n_groups), x.links_upto[doc]
                byte = np.concatenate([[0], x.cuts])[g]
                # a text with a bad unit has no tokens at all
                keep = lambda at: np.repeat(~bad, np.diff(at))
                rel = lambda values, base, at: (values - np.repeat(base[:-1], np.diff(at)))[keep(at)]
                shrunk = lambda at: segments(np.where(bad, 0, np.diff(at)))
                groups = pa.StructArray.from_arrays([pa.array(rel(x.a_upto, a, g)), pa.array(rel(x.b_upto, b, g)), pa.array(rel(x.cuts, byte, g))], fields=list(group))
                links = pa.StructArray.from_arrays([pa.array(rel(x.link_a, a, k)), pa.array(rel(x.link_b, b, k))], fields=list(link))
                ids = [lists(shrunk(at), pa.array(v.astype(np.int32)[keep(at)])) for at, v in ((a, x.a_ids), (b, x.b_ids))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *ids, lists(shrunk(g), groups), lists(shrunk(k), links)], schema=schema)

    return base_columns(docs, "doc_id", "text").mapInArrow(run, ROWS_SCHEMA)
