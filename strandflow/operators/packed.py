"""Counts of reads' events, made where the reads lie: numpy expands a batch's CIGARs, and each task hands on counts, not events.

A row of the exchange is a part of a contig (``BUCKET`` positions) with the
sorted keys and counts of a task's events there, in bytes; after it, a task
adds up one bucket at a time. Results equal those of reads.expand() and a
grouping. Reads have a contig and a position; symbols outside ASCII count as
``?``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import AMBIGUITY_FROM, AMBIGUITY_TO, WIDTH

#: Positions of a row of the exchange.
BUCKET = 1 << 14
#: Events that are expanded at once, and those that a task holds before it counts them.
CHUNK, HELD = 1 << 20, 1 << 21
KINDS = ["M", "I", "D"]
_OTHER = 7


def _set(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text.encode())] = True
    return out


_DIGIT, _LETTER = _set("0123456789"), _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ=")
_ON_REF, _ON_QUERY, _SHOWN = _set("M=XD"), _set("M=XIS"), _set("M=XID")
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
#: Place of a symbol in reads.SYMBOLS, and of a base in ACGT (N is A there); 7 and 4 for others.
_SYMBOL, _ROW = np.full(256, _OTHER, np.int64), np.full(256, 4, np.int64)
for _from, _to in zip("ACGT" + AMBIGUITY_FROM, "ACGT" + AMBIGUITY_TO, strict=True):
    _SYMBOL[ord(_from)] = _ROW[ord(_from)] = "ACGT".index(_to)
_SYMBOL[ord("N")], _ROW[ord("N")] = 6, 0


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; null is empty, a character outside ASCII is ?."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    found = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    if len(found) and found.max() > 127:
        return _bytes(pa.array([x.encode("ascii", "replace").decode() for x in column.to_pylist()], pa.large_string()))
    return found, at - at[0]


@dataclass
class Events:
    """As reads.expand(): read (its place in the batch), r, kind (place in KINDS), k, base (upper case; 0: none), first, begun."""

    read: np.ndarray
    r: np.ndarray
    kind: np.ndarray
    k: np.ndarray
    base: np.ndarray
    first: np.ndarray
    begun: np.ndarray


def events_of(batch: pa.RecordBatch, soft_clip: bool) -> Iterator[Events]:
    """Events of a batch (pos0, cigar, seq), some CHUNK at a time; soft_clip: only of reads that reads.clipped_share_ok() keeps."""
    data, at = _bytes(batch.column("cigar"))
    seq, seq_at = _bytes(batch.column("seq"))
    pos0 = batch.column("pos0").to_numpy()
    ends = np.flatnonzero(_LETTER[data])
    own = np.searchsorted(at, ends, side="right") - 1
    numbered = ends > at[own]
    numbered[numbered] = _DIGIT[data[ends[numbered] - 1]]
    ends, own = ends[numbered], own[numbered]
    size, unit, left, p = np.zeros(len(ends), np.int64), 1, np.arange(len(ends)), ends - 1
    while len(left):
        size[left] += (data[p].astype(np.int64) - 48) * unit
        if unit > 10**10 or size.max() > 2**31 - 1:
            raise ValueError("a CIGAR's length is beyond 32 bits")
        unit, p = unit * 10, p - 1
        more = p >= at[own[left]]
        more[more] = _DIGIT[data[p[more]]]
        left, p = left[more], p[more]
    op = data[ends]
    starts = np.searchsorted(own, np.arange(batch.num_rows))  # each read's first operation

    def before(steps: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(steps)])
        return total[:-1] - total[starts[own]]

    at_ref, at_query = before(np.where(_ON_REF[op], size, 0)), before(np.where(_ON_QUERY[op], size, 0))
    shown = _SHOWN[op] & (size > 0)
    if soft_clip:
        clipped = np.bincount(own[op == ord("S")], size[op == ord("S")], batch.num_rows)
        whole = np.bincount(own, size, batch.num_rows)
        shown &= (1.0 - clipped / (whole + 1) >= 0.55)[own]
    own, size, op, at_ref, at_query = own[shown], size[shown], op[shown], at_ref[shown], at_query[shown]
    upto = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + CHUNK, side="right")) - 1)
        n = size[lo:hi]
        j = np.repeat(np.arange(lo, hi), n)
        k = np.arange(upto[lo], upto[hi]) - upto[j]
        kind = np.where(op == ord("I"), 1, np.where(op == ord("D"), 2, 0))[j]
        read, q = own[j], at_query[j] + k
        has = (kind != 2) & (q < np.diff(seq_at)[read])
        base = np.zeros(len(j), np.uint8)
        base[has] = _UPPER[seq[seq_at[read[has]] + q[has]]]
        along = np.where(kind == 1, 0, k)
        yield Events(read, pos0[read] + at_ref[j] + along, kind, k, base, (kind != 1) & (at_ref[j] + k == 0), at_ref[j] > 0)
        lo = hi


def _planes(values: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on: what compresses well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n[order], first) if len(keys) else n


#: Of a batch's events: which count, where and as what (a number under ``codes``).
Code = Callable[[Events, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
PARTS = "contig string, bucket long, keys binary, n binary"


def parts_of(reads: DataFrame, code: Code, codes: int, min_mapq: int = 0, soft_clip: bool = False) -> DataFrame:
    """PARTS: each task's counts by bucket; a key is the position in the bucket times ``codes`` plus the code."""
    from .reads import DROPPED_FLAGS

    names = [f.split()[0] for f in PARTS.split(", ")]

    def counted(held: list[tuple[str, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows = []
        for contig in dict.fromkeys(c for c, _, _ in held):
            own = [(at, number) for c, at, number in held if c == contig]
            at, number = (np.concatenate(x) for x in zip(*own, strict=True))
            buckets = at // BUCKET
            order = np.argsort(buckets, kind="stable")
            edges = np.flatnonzero(np.diff(buckets[order], prepend=buckets[order][0] - 1))
            for lo, hi in zip(edges, [*edges[1:], len(order)], strict=True):
                mine = order[lo:hi]
                bucket = int(buckets[mine[0]])
                keys, n = np.unique((at[mine] - bucket * BUCKET) * codes + number[mine], return_counts=True)
                rows.append((contig, bucket, _planes(np.diff(keys, prepend=0)), _planes(n.astype(np.uint32))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            contigs = batch.column("contig").dictionary_encode()
            of = contigs.indices.to_numpy()
            reverse = batch.column("flag").to_numpy() & 16 > 0
            for events in events_of(batch, soft_clip):
                kept, at, number = code(events, reverse)
                at, number, where = at[kept].astype(np.int64), number[kept].astype(np.int64), of[events.read[kept]]
                for c, name in enumerate(contigs.dictionary.to_pylist()):
                    mine = where == c
                    if mine.any():
                        held.append((name, at[mine], number[mine]))
                size += len(at)
                if size >= HELD:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    ok = (F.col("flag").bitwiseAND(DROPPED_FLAGS) == 0) & (F.col("mapq") >= min_mapq) & (F.col("cigar") != "*")
    rows = reads.where(ok).where("contig IS NOT NULL AND pos0 IS NOT NULL")
    return rows.select("contig", F.col("pos0").cast("long").alias("pos0"), F.col("flag").cast("int").alias("flag"), "cigar", "seq").mapInArrow(run, PARTS)


def summed(parts: DataFrame, codes: int, finish: Callable[[str, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``finish`` of each bucket's contig, positions, codes and counts, as rows of ``schema``; a task holds one bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            keys, n = _added(*(np.concatenate(x) for x in zip(*held, strict=True)))
            cuts = [int(np.searchsorted(keys, keys[x] // codes * codes)) for x in range(0, len(keys), CHUNK)]  # a position's keys stay together
            for lo, hi in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if hi > lo:
                    yield finish(last[0], last[1] * BUCKET + keys[lo:hi] // codes, keys[lo:hi] % codes, n[lo:hi])

        for batch in batches:
            for contig, bucket, keys, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (contig, bucket) != last:
                    if held:
                        yield from done()
                    last, held, size = (contig, bucket), [], 0
                held.append(unpacked(keys, n))
                size += len(held[-1][0])
                if size > 2 * HELD and len(held) > 1:
                    held = [_added(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
        if held:
            yield from done()

    return parts.repartition("contig", "bucket").sortWithinPartitions("contig", "bucket").mapInArrow(run, schema)


#: Codes of a pileup: the places in reads.SYMBOLS, and others.
SHOWN = _OTHER + 1


def pileup_parts(reads: DataFrame, min_mapq: int = 0, soft_clip: bool = True) -> DataFrame:
    """PARTS of a pileup, of SHOWN codes."""
    return parts_of(reads, _pileup_code, SHOWN, min_mapq, soft_clip)


def _pileup_code(e: Events, reverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    aligned = e.kind == 0
    return aligned | (e.k == 0), np.where(aligned, e.r, e.r - 1), np.where(aligned, _SYMBOL[e.base], 3 + e.kind)


def pileup_counts(reads: DataFrame, min_mapq: int = 0, soft_clip: bool = True) -> DataFrame:
    """reads.pileup_counts() of the reads that reads.filter_reads() keeps."""
    from .reads import SYMBOLS

    def finish(contig: str, at: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        places, row = np.unique(at, return_inverse=True)
        counts = np.zeros((len(places), SHOWN), np.int64)
        counts[row, code] = n
        return pa.RecordBatch.from_arrays([pa.array([contig] * len(places), pa.string()), pa.array(places), *(pa.array(counts[:, i]) for i in range(len(SYMBOLS)))], names=["contig", "pos0", *SYMBOLS])

    return summed(pileup_parts(reads, min_mapq, soft_clip), SHOWN, finish, "contig string, pos0 long, " + ", ".join(f"{s} long" for s in SYMBOLS))


#: Sizes of the parts of a number that tells events apart at a position: see tensors.position_counts().
FIELDS = [WIDTH + 1, len(KINDS), 5, 2, 2, 2]


def _window_code(e: Events, reverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = np.zeros(len(e.r), np.int64)
    for field, size in zip((np.where(e.kind == 1, np.minimum(e.k, WIDTH), 0), e.kind, _ROW[e.base], e.first, e.begun, reverse[e.read]), FIELDS, strict=True):
        code = code * size + field
    return np.ones(len(code), bool), e.r, code


def position_codes(reads: DataFrame, min_mapq: int = 0, soft_clip: bool = False) -> DataFrame:
    """contig, r, code, n: events of filtered reads by position and FIELDS."""

    def finish(contig: str, at: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([contig] * len(at), pa.string()), pa.array(at), pa.array(code.astype(np.int32)), pa.array(n)], names=["contig", "r", "code", "n"])

    codes = int(np.prod(FIELDS))
    return summed(parts_of(reads, _window_code, codes, min_mapq, soft_clip), codes, finish, "contig string, r long, code int, n long")


def position_lists(reads: DataFrame, min_mapq: int = 0, soft_clip: bool = False) -> DataFrame:
    """contig, r and counts (code, n): the same of each task's reads alone, a row for each position; for streams."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for contig, bucket, keys, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                keys, n = unpacked(keys, n)
                places, first = np.unique(keys // codes, return_index=True)
                inner = pa.StructArray.from_arrays([pa.array((keys % codes).astype(np.int32)), pa.array(n)], ["code", "n"])
                lists = pa.ListArray.from_arrays(pa.array([*first, len(keys)], pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([pa.array([contig] * len(places), pa.string()), pa.array(bucket * BUCKET + places), lists], names=["contig", "r", "counts"])

    codes = int(np.prod(FIELDS))
    return parts_of(reads, _window_code, codes, min_mapq, soft_clip).mapInArrow(run, "contig string, r long, counts array<struct<code: int, n: long>>")


def unpacked(keys: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a row of PARTS."""
    return np.cumsum(_numbers(keys, np.int64)), _numbers(n, np.uint32).astype(np.int64)


def _event_code(e: Events, reverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.ones(len(e.r), bool), e.r, ((e.k * len(KINDS) + e.kind) * 256 + e.base) * 2 + reverse[e.read]


def event_counts(reads: DataFrame, min_mapq: int = 0, soft_clip: bool = True) -> DataFrame:
    """contig, r, kind, k, base, reverse, n: equal events of filtered reads, see reads.expand()."""
    symbols = pa.array(["", *(chr(i) for i in range(1, 256))])

    def finish(contig: str, at: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        base, kind = code // 2 % 256, code // 512 % len(KINDS)
        shown = pa.array(base.astype(np.int16), mask=kind == 2)
        columns = [pa.array([contig] * len(at), pa.string()), pa.array(at), pa.array(KINDS).take(pa.array(kind)), pa.array((code // 512 // len(KINDS)).astype(np.int32)), symbols.take(shown), pa.array(code % 2 == 1), pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, names=["contig", "r", "kind", "k", "base", "reverse", "n"])

    codes = (1 << 31) * len(KINDS) * 512
    return summed(parts_of(reads, _event_code, codes, min_mapq, soft_clip), codes, finish, "contig string, r long, kind string, k int, base string, reverse boolean, n long")
