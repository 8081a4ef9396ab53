"""BAM files as a Spark data source: range scans by index, and a sorted, indexed sink.

``read_bam`` gives the columns of read_sam(). With an index beside the file
(``.bai``) a scan reads the members of the contigs and positions that its
options or pushed filters ask for, cut at known row starts so that large files
spread over many tasks. Without one, tasks take byte ranges: each finds the
first member and the first row that begins in its range by itself.

``write_bam`` sorts by contig, position and ord; each task writes whole members
and the index of its rows, and the commit joins the parts to one file.

A read's ord is its virtual offset, so it rises in file order. Reads without a
contig or a position have null there. CIGARs of over 65,535 operations are read
from the tag that holds them. Plain counts bound memory: a task holds a batch of
rows and some members.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..operators.reads import touching
from . import bgzf

SCHEMA = "ord long, contig string, pos0 long, mapq int, flag int, cigar string, seq string"
_ARROW = pa.schema([("ord", pa.int64()), ("contig", pa.string()), ("pos0", pa.int64()), ("mapq", pa.int32()), ("flag", pa.int32()), ("cigar", pa.string()), ("seq", pa.string())])
# Symbols by their codes in the format.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_PAIRS = np.array([list(f"{a}{b}".encode()) for a in BASES for b in BASES], np.uint8)
_FIXED = np.dtype([("size", "<i4"), ("contig", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("bases", "<i4"), ("mate_contig", "<i4"), ("mate_pos", "<i4"), ("template", "<i4")])
#: Rows of a batch, at most.
BATCH = 8192
TARGET = 16 << 20


def read_header(members: bgzf.Members) -> tuple[list[tuple[str, int]], int]:
    """Contigs with their lengths in order, and the virtual offset of the first row."""
    buffer = bgzf.Buffered(members.stream(0, members.size << 16, 1 << 16))

    def need(n: int) -> None:
        while len(buffer.data) < n and buffer.more():
            pass
        if len(buffer.data) < n:
            raise ValueError("not a BAM file, or its header is cut off")

    need(8)
    if buffer.data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", buffer.data, 4)[0]
    need(at + 4)
    (n,), at = struct.unpack_from("<i", buffer.data, at), at + 4
    contigs = []
    for _ in range(n):
        need(at + 4)
        size = struct.unpack_from("<i", buffer.data, at)[0]
        need(at + 8 + size)
        contigs.append((buffer.data[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", buffer.data, at + 4 + size)[0]))
        at += 8 + size
    buffer.more()  # a first row may begin in the next member
    return contigs, buffer.offsets([at])[0]


def read_index(path: str) -> list[bgzf.ContigIndex] | None:
    for name in (f"{path}.bai", re.sub(r"\.bam$", ".bai", path)):
        data = bgzf.read_all(name) if name != path else None
        if data is not None:
            (n,), at, out = struct.unpack_from("<i", data, 4), 8, []
            for _ in range(n):
                one, at = bgzf.ContigIndex.unpack(data, at)
                out.append(one)
            return out
    return None


def row_ends(data: bytes) -> list[int]:
    """0, and the end of each whole row of the buffer."""
    ends, at, n = [0], 0, len(data)
    while at + 4 <= n:
        at += 4 + int.from_bytes(data[at : at + 4], "little")
        if at > n:
            break
        ends.append(at)
    return ends


def plausible(data: bytes, at: int, n_contigs: int) -> int:
    """The end of a row at this place, 0 if what stands there can be none."""
    if at + 36 > len(data):
        return 0
    r = np.frombuffer(data, _FIXED, 1, at)[0]
    size, name, ops, bases = int(r["size"]), int(r["name"]), int(r["ops"]), int(r["bases"])
    ok = size >= 32 + name + 4 * ops + (bases + 1) // 2 + bases and name >= 1 and bases >= 0
    ok = ok and all(-1 <= int(r[c]) < n_contigs for c in ("contig", "mate_contig")) and all(int(r[p]) >= -1 for p in ("pos", "mate_pos"))
    end = at + 36 + name
    return at + 4 + size if ok and end <= len(data) and data[end - 1] == 0 and 0 not in data[at + 36 : end - 1] and all(33 <= c <= 126 for c in data[at + 36 : end - 1]) else 0


def first_row(buffer: bgzf.Buffered, n_contigs: int, chain: int = 8) -> int | None:
    """Place of the first row of the buffer: where ``chain`` plausible rows, or all up to the file's end, follow one another."""
    place = 0
    while True:
        at, count, short = place, 0, False
        while count < chain:
            while at + (1 << 16) > len(buffer.data) and buffer.more():
                pass
            if at == len(buffer.data):
                break  # the file ends behind a row
            end = plausible(buffer.data, at, n_contigs)
            if not end:
                short = True
                break
            while end > len(buffer.data) and buffer.more():
                pass
            at, count = end, count + 1
        if not short:
            return place if place < len(buffer.data) else None
        place += 1


def cigar_text(codes: np.ndarray) -> str:
    return "".join(f"{c >> 4}{OPS[c & 15]}" for c in codes.tolist()) or "*"


def long_cigar(data: bytes, at: int, end: int) -> np.ndarray | None:
    """Operations in the CG tag between two places."""
    sizes = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
    while at + 3 <= end:
        tag, kind = data[at : at + 2], data[at + 2 : at + 3]
        at += 3
        if kind in b"ZH":
            at = data.index(b"\0", at) + 1
        elif kind == b"B":
            n = struct.unpack_from("<i", data, at + 1)[0]
            if tag == b"CG":
                return np.frombuffer(data, "<u4", n, at + 5)
            at += 5 + n * sizes[data[at : at + 1]]
        else:
            at += sizes[kind]
    return None


def decode(data: bytes, starts: list[int], ords: list[int], names: list[str], keep) -> pa.RecordBatch:
    """Columns of the rows at ``starts``, those that ``keep`` (of the fixed fields) takes."""
    every = np.array(starts, np.int64)
    raw = np.frombuffer(data, np.uint8)
    fixed = raw[every[:, None] + np.arange(36)].view(_FIXED)[:, 0]
    taken = np.flatnonzero(keep(fixed))
    fixed, every = fixed[taken], every[taken]
    op_at = every + 36 + fixed["name"]
    cigars, seqs = [], []
    for at, first, ops, bases, size in zip(every.tolist(), op_at.tolist(), fixed["ops"].tolist(), fixed["bases"].tolist(), fixed["size"].tolist(), strict=True):
        codes = np.frombuffer(data, "<u4", ops, first)
        half = (bases + 1) // 2
        if ops == 2 and codes[0] & 15 == 4 and codes[0] >> 4 == bases and codes[1] & 15 == 3:
            found = long_cigar(data, first + 8 + half + bases, at + 4 + size)
            codes = codes if found is None else found
        cigars.append(cigar_text(codes))
        packed = raw[first + 4 * ops : first + 4 * ops + half]
        seqs.append(_PAIRS[packed].tobytes()[:bases].decode() or "*")
    contig = pa.array(fixed["contig"], mask=fixed["contig"] < 0)
    pos = fixed["pos"].astype(np.int64)
    named = pa.array(names, pa.string()).take(contig)
    columns = [pa.array(np.array(ords, np.int64)[taken]), named, pa.array(pos, mask=pos < 0), pa.array(fixed["mapq"].astype(np.int32)), pa.array(fixed["flag"].astype(np.int32)), pa.array(cigars, pa.string()), pa.array(seqs, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


@dataclass
class BamRange(InputPartition):
    """Rows that begin at virtual offsets start to end (of an indexed file), or in members that begin in these bytes."""

    start: int
    end: int
    indexed: bool
    first: int


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.target = int(options.get("target_bytes", TARGET))
        self.contigs: set[str] | None = {options["contig"]} if "contig" in options else None
        #: Reads over positions low to high - 1 (from 0) are wanted.
        self.low, self.high = int(options.get("low", 0)), int(options.get("high", 1 << 60))
        self.min_mapq, self.without_flags = int(options.get("min_mapq", 0)), int(options.get("without_flags", 0))
        self.first_start, self.last_start = 0, 1 << 60

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and ranges of contig, pos0 and mapq narrow the scan; a test of flag's bits is no filter that Spark hands on, so there is an option for it."""
        for f in filters:
            column = getattr(f, "attribute", None)
            value = getattr(f, "value", None)
            if column == ("contig",) and isinstance(f, (EqualTo, In)):
                asked = {value} if isinstance(f, EqualTo) else set(value)
                self.contigs = asked if self.contigs is None else self.contigs & asked
            elif column == ("pos0",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first_start = max(self.first_start, value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.last_start = min(self.last_start, value - isinstance(f, LessThan))
            elif column == ("mapq",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.min_mapq = max(self.min_mapq, value + isinstance(f, GreaterThan))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        f, size = bgzf.open_file(self.path)
        with f:
            names, first = read_header(bgzf.Members(f, size))
        index = read_index(self.path)
        if index is None:
            return [BamRange(max(at, first >> 16), min(at + self.target, size), False, first) for at in range(0, size, self.target) if at + self.target > first >> 16]
        low, high = max(self.low, self.first_start), min(self.high, self.last_start + 1)
        out: list[BamRange] = []
        for (name, length), own in zip(names, index, strict=False):
            if self.contigs is not None and name not in self.contigs or low >= high:
                continue
            ranges = own.ranges(low, min(high, max(length, low + 1) + 1)) if low > 0 or high < length else own.ranges(0, 1 << 29)
            out += [BamRange(s, e, True, first) for s, e in bgzf.split_ranges(ranges, own.starts(), self.target)]
        if self.contigs is None and low <= 0 and high >= 1 << 59:  # reads of no contig stand behind all others
            last = max([first, *(e for own in index for r in own.bins.values() for _, e in r)])
            out.append(BamRange(last, size << 16, True, first))
        return out

    def read(self, partition: BamRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are none
            return
        f, size = bgzf.open_file(self.path)
        with f:
            yield from self.rows(partition, bgzf.Members(f, size))

    def rows(self, partition: BamRange, members: bgzf.Members) -> Iterator[pa.RecordBatch]:
        names = [c for c, _ in read_header(members)[0]]
        wanted = np.array([self.contigs is None or c in self.contigs for c in names] + [self.contigs is None], bool)
        last_start, end = min(self.last_start, self.high - 1), partition.end

        def keep(r: np.ndarray) -> np.ndarray:
            return wanted[r["contig"]] & (r["pos"] <= last_start) & (r["pos"] >= self.first_start - (self.first_start == 0)) & (r["mapq"] >= self.min_mapq) & (r["flag"] & self.without_flags == 0)

        if partition.indexed:
            buffer = bgzf.Buffered(members.stream(partition.start, end))
        else:
            begin = members.first_from(partition.start)
            if begin >= end:
                return
            at_head = begin == partition.first >> 16 or partition.start == partition.first >> 16
            buffer = bgzf.Buffered(members.stream(partition.first if at_head else begin << 16, members.size << 16))
            if not at_head:
                place = first_row(buffer, len(names))
                if place is None:
                    return
                buffer.drop(place)
            end <<= 16
        more = True
        while more:
            more = buffer.more()
            ends = row_ends(buffer.data)
            if more and len(ends) <= BATCH and len(buffer.data) < 4 << 20:
                continue
            for k in range(0, len(ends) - 1, BATCH):
                starts = ends[k : min(k + BATCH, len(ends) - 1)]
                ords = buffer.offsets(starts)
                if not partition.indexed and ords[-1] >= end:  # rows of members that begin in the next range
                    starts = [s for s, o in zip(starts, ords, strict=True) if o < end]
                    ords, more = ords[: len(starts)], False
                if starts:
                    yield decode(buffer.data, starts, ords, names, keep)
                # an indexed range lies in one contig, sorted by position
                behind = partition.indexed and starts and struct.unpack_from("<i", buffer.data, starts[-1] + 8)[0] > last_start
                if behind or not partition.indexed and not more:
                    return
            buffer.drop(ends[-1])


@dataclass
class BamPart(WriterCommitMessage):
    order: int
    path: str
    size: int
    index: dict


def encode(row: dict, contig: int) -> tuple[bytes, int]:
    """A row in the format, and how many positions it covers."""
    cigar = [(int(n), OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    seq = "" if row["seq"] in (None, "*") else row["seq"].upper()
    codes = [BASES.index(c) if c in BASES else 15 for c in seq] + [0] * (len(seq) % 2)
    span = sum(n for n, o in cigar if OPS[o] in "MDN=X")
    pos = -1 if row["pos0"] is None else row["pos0"]
    packed = struct.pack(f"<{len(cigar)}I", *(n << 4 | o for n, o in cigar))
    tags = b""
    if len(cigar) > 65_535:
        tags, packed = b"CGBI" + struct.pack("<i", len(cigar)) + packed, struct.pack("<II", len(seq) << 4 | 4, span << 4 | 3)
    name = (row.get("name") or "r").encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", contig, pos, len(name), row["mapq"] or 0, bgzf.bin_of(max(pos, 0), max(pos, 0) + max(span, 1)), len(packed) // 4, row["flag"] or 0, len(seq), -1, -1, 0)
    body += name + packed + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body, span


class BamWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.run = options["path"], uuid.uuid4().hex
        self.contigs = [(c, int(n)) for c, _, n in (x.rpartition(":") for x in options["contigs"].split(",") if x)]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> BamPart:
        context, number = TaskContext.get(), {c: i for i, (c, _) in enumerate(self.contigs)}
        # a name for each attempt, so a second one cannot change the file of the first
        part = bgzf.PartWriter(f"{self.path}.part-{self.run}-{context.partitionId()}-{context.taskAttemptId()}")
        for batch in iterator:
            for row in batch.to_pylist():
                contig = number[row["contig"]] if row["contig"] not in (None, "*") else -1
                data, span = encode(row, contig)
                placed = contig >= 0 and row["pos0"] is not None and row["pos0"] >= 0
                part.add(data, contig if placed else None, row["pos0"] or 0, (row["pos0"] or 0) + span)
        return BamPart(context.partitionId(), part.path, part.close(), part.index)

    def commit(self, messages: list[BamPart | None]) -> None:
        text = "".join(["@HD\tVN:1.6\tSO:coordinate\n", *(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in self.contigs)]).encode()
        head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.contigs))
        head += b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in self.contigs)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.order)
        whole = bgzf.join_parts(self.path, head, [(m.path, m.size, m.index) for m in parts])
        fs, where = bgzf.file_system(f"{self.path}.bai")
        with fs.open_output_stream(where) as out:
            out.write(b"BAI\1" + struct.pack("<i", len(self.contigs)) + b"".join(whole.get(i, bgzf.ContigIndex()).pack() for i in range(len(self.contigs))))

    def abort(self, messages: list[BamPart | None]) -> None:
        for m in messages:
            if m is not None:
                fs, where = bgzf.file_system(m.path)
                fs.delete_file(where)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(dict(self.options))


def read_bam(spark: SparkSession, path: str, contig: str | None = None, start: int | None = None, end: int | None = None, widen: int = 0, min_mapq: int = 0, without_flags: int = 0, target_bytes: int = TARGET) -> DataFrame:
    """read_sam()'s columns of a BAM file; of a contig and of reads over 1-based positions start to end, widened by ``widen``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    asked = {"target_bytes": target_bytes, "min_mapq": min_mapq, "without_flags": without_flags}
    if contig is not None:
        asked["contig"] = contig
    if start is not None and end is not None:
        asked |= {"low": max(start - widen, 1) - 1, "high": end + widen}
    return touching(spark.read.format("bam").options(**asked).load(path), start, end, widen)


def write_bam(reads: DataFrame, contigs: list[tuple[str, int]], path: str) -> None:
    """Reads (contig, pos0, mapq, flag, cigar, seq, and ord for ties) as one sorted BAM file with its index; those of no contig or position come last."""
    spark = reads.sparkSession
    spark.dataSource.register(BamSource)
    rank = F.array_position(F.array(*(F.lit(c) for c, _ in contigs)), F.col("contig")) if contigs else F.lit(None).cast("long")
    placed = rank.isNotNull() & (rank > 0) & F.col("pos0").isNotNull()
    rows = reads.orderBy(F.when(placed, rank).otherwise(len(contigs) + 1), "pos0", "ord").select("ord", "contig", "pos0", "mapq", "flag", "cigar", "seq")
    rows.write.format("bam").mode("append").options(contigs=",".join(f"{c}:{n}" for c, n in contigs)).save(path)
