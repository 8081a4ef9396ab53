"""Blocked gzip text as a Spark data source: region scans by tabix index, and one sorted, indexed file as a sink.

A scan gives ord (a line's virtual offset) and value. With an index (``.tbi``)
and a region it reads the members that can hold the region's lines; otherwise
tasks take byte ranges, and a line belongs to the range in which it begins. The
sink's tasks write whole members and the index of their lines, and the commit
joins the parts to one file behind the header.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import bgzf

_ARROW = pa.schema([("ord", pa.int64()), ("value", pa.string())])
TARGET = 16 << 20
# Format number of VCF, columns of contig, start and end, and the comment sign, as the index has them.
VCF_COLUMNS = (2, 1, 2, 0, ord("#"), 0)


def read_index(path: str) -> dict[str, bgzf.ContigIndex] | None:
    packed = bgzf.read_all(f"{path}.tbi")
    if packed is None:
        return None
    members = bgzf.Members(pa.BufferReader(packed), len(packed))
    data = b"".join(d for _, d in members.stream(0, len(packed) << 16))
    n = struct.unpack_from("<i", data, 4)[0]
    size = struct.unpack_from("<i", data, 32)[0]
    names, at, out = data[36 : 36 + size].split(b"\0")[:n], 36 + size, {}
    for name in names:
        out[name.decode()], at = bgzf.ContigIndex.unpack(data, at)
    return out


def pack_index(index: dict[str, bgzf.ContigIndex]) -> bytes:
    names = b"".join(n.encode() + b"\0" for n in index)
    data = b"TBI\1" + struct.pack("<8i", len(index), *VCF_COLUMNS, len(names)) + names + b"".join(own.pack() for own in index.values())
    return b"".join(bgzf.deflate(data[k : k + bgzf.MEMBER]) for k in range(0, len(data), bgzf.MEMBER)) + bgzf.END


@dataclass
class LineRange(InputPartition):
    start: int
    end: int
    indexed: bool


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.target = options["path"], int(options.get("target_bytes", TARGET))
        self.contig = options.get("contig")
        self.low, self.high = int(options.get("low", 0)), int(options.get("high", 1 << 29))

    def partitions(self) -> Sequence[InputPartition]:
        index = read_index(self.path) if self.contig is not None else None
        if index is not None:
            own = index.get(self.contig)
            ranges = own.ranges(self.low, self.high) if own else []
            return [LineRange(s, e, True) for s, e in bgzf.split_ranges(ranges, own.starts() if own else [], self.target)]
        f, size = bgzf.open_file(self.path)
        f.close()
        return [LineRange(at, min(at + self.target, size), False) for at in range(0, size, self.target)]

    def read(self, partition: LineRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are none
            return
        f, size = bgzf.open_file(self.path)
        with f:
            yield from self.rows(partition, bgzf.Members(f, size))

    def rows(self, partition: LineRange, members: bgzf.Members) -> Iterator[pa.RecordBatch]:
        end, whole = partition.end, True
        if partition.indexed:
            buffer = bgzf.Buffered(members.stream(partition.start, end))
        else:
            begin = members.first_from(partition.start)
            if begin >= end:
                return
            buffer, whole, end = bgzf.Buffered(members.stream(begin << 16, members.size << 16)), begin == 0, end << 16
        more = True
        while more:
            more = buffer.more()
            if not more and not buffer.data:
                return
            if not whole:  # a line begun before goes on here, unless it ended with the member before
                cut = buffer.data.find(b"\n") + 1
                if not cut and more:
                    continue
                if self._begins_line(members, partition.start):
                    cut = 0
                elif not cut:
                    return
                buffer.drop(cut)
                whole = True
            cut = buffer.data.rfind(b"\n") + 1 if more else len(buffer.data)
            if more and cut < 1 << 18 and not self._past(buffer, end, partition):
                continue
            starts, lines, at = [], [], 0
            for line in buffer.data[:cut].split(b"\n")[: None if not more and not buffer.data[:cut].endswith(b"\n") else -1]:
                starts.append(at)
                lines.append(line)
                at += len(line) + 1
            ords = buffer.offsets(starts)
            taken = sum(o < end for o in ords) if not partition.indexed else len(ords)
            if taken:
                text = [x.decode().removesuffix("\r") for x in lines[:taken]]
                yield pa.RecordBatch.from_arrays([pa.array(ords[:taken], pa.int64()), pa.array(text, pa.string())], schema=_ARROW)
            if taken < len(ords):
                return
            buffer.drop(cut)

    @staticmethod
    def _past(buffer: bgzf.Buffered, end: int, partition: LineRange) -> bool:
        return not partition.indexed and bool(buffer.starts) and buffer.starts[-1][1] >= end

    @staticmethod
    def _begins_line(members: bgzf.Members, at: int) -> bool:
        """Whether the member before the first one from ``at`` ends with a line."""
        first = members.first_from(at)
        back = max(0, first - (1 << 17))
        place, last = members.first_from(back), b""
        while place < first:
            data, place = members.member(place)
            last = data[-1:] or last
        return last == b"\n"


@dataclass
class LinePart(WriterCommitMessage):
    order: int
    path: str
    size: int
    index: dict


class LineWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.head, self.indexed, self.run = options["path"], options.get("head", ""), options.get("indexed") == "true", uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> LinePart:
        context = TaskContext.get()
        part = bgzf.PartWriter(f"{self.path}.part-{self.run}-{context.partitionId()}-{context.taskAttemptId()}")
        for batch in iterator:
            for contig, start, end, value in zip(*(batch.column(c).to_pylist() for c in ("contig", "start", "end", "value")), strict=True):
                part.add(value.encode() + b"\n", contig if self.indexed else None, start, end)
        return LinePart(context.partitionId(), part.path, part.close(), part.index)

    def commit(self, messages: list[LinePart | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.order)
        whole = bgzf.join_parts(self.path, self.head.encode(), [(m.path, m.size, m.index) for m in parts])
        if self.indexed:
            fs, where = bgzf.file_system(f"{self.path}.tbi")
            with fs.open_output_stream(where) as out:
                out.write(pack_index(whole))

    def abort(self, messages: list[LinePart | None]) -> None:
        for m in messages:
            if m is not None:
                fs, where = bgzf.file_system(m.path)
                fs.delete_file(where)


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bgzf_lines"

    def schema(self) -> str:
        return "ord long, value string"

    def reader(self, schema) -> LineReader:
        return LineReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(dict(self.options))


def read_lines(spark: SparkSession, path: str, contig: str | None = None, start: int | None = None, end: int | None = None, target_bytes: int = TARGET) -> DataFrame:
    """ord and value of a blocked gzip file; with an index and a contig, of the members that can hold its lines of 1-based positions start to end."""
    spark.dataSource.register(LineSource)
    asked = {"target_bytes": target_bytes}
    if contig is not None:
        asked["contig"] = contig
        if start is not None and end is not None:
            asked |= {"low": max(start, 1) - 1, "high": end}
    return spark.read.format("bgzf_lines").options(**asked).load(path)


def write_lines(rows: DataFrame, line: Column, path: str, head: str = "", order: tuple[Column | str, ...] = ("contig", "pos"), span: Column | None = None) -> None:
    """One blocked gzip file of ``line`` in the order of ``order`` (contig and 1-based pos among the columns); with ``span``, the positions that a line covers, also its index."""
    rows.sparkSession.dataSource.register(LineSource)
    start = F.col("pos").cast("long") - 1
    keyed = rows.orderBy(*order).select("contig", start.alias("start"), (start + (F.lit(1) if span is None else F.greatest(span, F.lit(1)))).cast("long").alias("end"), line.alias("value"))
    keyed.write.format("bgzf_lines").mode("append").options(head=head, indexed=str(span is not None).lower()).save(path)
