"""Blocked gzip files and their bin indexes, for scans and sinks that work by ranges.

A file is a row of gzip members of 64 KB of data at most, so any member can be
read on its own. A virtual offset is the member's place in the file times
65,536 plus a place in its data. An index knows for each contig the ranges of
virtual offsets by bin (of 16 KB to 512 MB of positions) and, for each 16 KB of
positions, the least virtual offset of a row that reaches it.

Scans plan their ranges on the driver from the index alone, or from the file's
size where there is none; tasks read the bytes of their own ranges. Sinks write
whole members in each task and join the parts in order when all are there.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow.fs

from .shared import file_system

#: Data of a member, at most, as writers cut it.
MEMBER = 65_280
# The empty member that ends a file, and the head of every member up to its size.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
HEAD = bytes.fromhex("1f8b08040000000000ff060042430200")
#: Bits of the smallest bin's positions, and the number of levels.
SHIFT, LEVELS = 14, 6
#: Bytes that a scan reads at a time.
READ = 1 << 20


def deflate(data: bytes, level: int = 6) -> bytes:
    """One member."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return HEAD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def member_size(head: bytes) -> int:
    """Size of the member that ``head`` begins, 0 if none begins there."""
    if len(head) < 18 or head[:4] != HEAD[:4]:
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head) - 2):
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def inflate(member: bytes) -> bytes:
    at = 12 + struct.unpack_from("<H", member, 10)[0]
    return zlib.decompress(member[at:-8], -15)


class Members:
    """Reads members of an open file; ``read`` counts the bytes that were fetched."""

    def __init__(self, f: pyarrow.fs.FileSystem, size: int):
        self.file, self.size, self.read = f, size, 0
        self._at, self._held = 0, b""

    def _bytes(self, at: int, n: int, ahead: int) -> bytes:
        if not self._at <= at <= at + n <= self._at + len(self._held):
            self._at, self._held = at, self.file.read_at(min(max(n, ahead), self.size - at), at)
            self.read += len(self._held)
        return self._held[at - self._at : at - self._at + n]

    def member(self, at: int, ahead: int = READ) -> tuple[bytes, int]:
        """Data of the member at ``at`` and the place of the next one."""
        size = member_size(self._bytes(at, min(64, self.size - at), ahead))
        if not size:
            raise ValueError(f"no blocked gzip member at byte {at}")
        return inflate(self._bytes(at, size, ahead)), at + size

    def first_from(self, at: int) -> int:
        """Place of the first member that begins at ``at`` or later; the size if none does."""
        while at < self.size:
            window = self._bytes(at, min(1 << 17, self.size - at), 1 << 17)
            k = window.find(HEAD[:4])
            while k >= 0:
                size = member_size(window[k : k + 64])
                # a chance match is followed by no second member
                if size and (at + k + size == self.size or at + k + size < self.size and member_size(self._bytes(at + k + size, min(64, self.size - at - k - size), 64))):
                    return at + k
                k = window.find(HEAD[:4], k + 1)
            at += max(1, len(window) - 64)
        return self.size

    def stream(self, start: int, end: int, ahead: int = READ) -> Iterator[tuple[int, bytes]]:
        """Place and data of the members from virtual offset ``start`` to ``end``; the first's data begins at start, the last's ends at end."""
        at, skip = start >> 16, start & 0xFFFF
        while at < self.size and at << 16 < end:
            data, after = self.member(at, min(ahead, max(64, (end >> 16) + (1 << 16) - at)))
            last = len(data) if at < end >> 16 else end & 0xFFFF
            if data[skip:last]:
                yield at << 16 | skip, data[skip:last]
            at, skip = after, 0


class Buffered:
    """Members' data as one buffer that knows the virtual offset of each place."""

    def __init__(self, parts: Iterable[tuple[int, bytes]]):
        self.parts, self.data, self.starts = iter(parts), b"", []

    def more(self) -> bool:
        """Adds the next member; False at the end."""
        got = next(self.parts, None)
        if got is None:
            return False
        self.starts.append((len(self.data), got[0]))
        self.data += got[1]
        return True

    def drop(self, n: int) -> None:
        """Forgets the first n bytes."""
        self.data = self.data[n:]
        moved = [(at - n, v) for at, v in self.starts]
        first = max((i for i, (at, _) in enumerate(moved) if at <= 0), default=0)
        self.starts = [(at, v) if at >= 0 else (0, v - at) for at, v in moved[first:]]

    def offsets(self, places: list[int]) -> list[int]:
        """Virtual offset of each of the ascending places."""
        out, k = [], 0
        for p in places:
            while k + 1 < len(self.starts) and self.starts[k + 1][0] <= p:
                k += 1
            out.append(self.starts[k][1] + p - self.starts[k][0])
        return out


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds positions start to end - 1."""
    end -= 1
    for level in range(LEVELS - 1, 0, -1):
        shift = SHIFT + 3 * (LEVELS - 1 - level)
        if start >> shift == end >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def bins_over(start: int, end: int) -> list[range]:
    """The bins of each level that touch positions start to end - 1."""
    out = []
    for level in range(LEVELS):
        shift, first = SHIFT + 3 * (LEVELS - 1 - level), ((1 << 3 * level) - 1) // 7
        out.append(range(first + (start >> shift), first + (max(start, end - 1) >> shift) + 1))
    return out


@dataclass
class ContigIndex:
    """Ranges of virtual offsets by bin, and the least offset by 16 KB window."""

    bins: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    windows: dict[int, int] = field(default_factory=dict)
    last: int = -1

    def add(self, start: int, end: int, begin: int, after: int) -> None:
        """A row over positions start to end - 1 at virtual offsets begin to after; rows come in file order."""
        end = max(end, start + 1)
        ranges = self.bins[bin_of(start, end)]
        if ranges and ranges[-1][1] == self.last:  # the row before this one is in the bin, too
            ranges[-1] = (ranges[-1][0], after)
        else:
            ranges.append((begin, after))
        self.last = after
        for w in range(start >> SHIFT, (end - 1 >> SHIFT) + 1):
            self.windows.setdefault(w, begin)

    def shift(self, by: int) -> "ContigIndex":
        """The same for a part that stands ``by`` bytes further on in a file."""
        move = by << 16
        return ContigIndex({b: [(s + move, e + move) for s, e in r] for b, r in self.bins.items()}, {w: v + move for w, v in self.windows.items()})

    def merge(self, later: "ContigIndex") -> None:
        for b, ranges in later.bins.items():
            self.bins.setdefault(b, []).extend(ranges)
        for w, v in later.windows.items():
            self.windows.setdefault(w, v)

    def ranges(self, start: int, end: int) -> list[tuple[int, int]]:
        """Ranges that can hold rows over positions start to end - 1, joined where a member or less lies between."""
        # rows are sorted by start, so none before the first that reaches this window or a later one is needed
        least = min((v for w, v in self.windows.items() if w >= start >> SHIFT), default=None)
        if least is None:
            return []
        found = sorted((max(s, least), e) for group in bins_over(start, end) for b, r in self.bins.items() if b in group for s, e in r if e > least)
        out: list[tuple[int, int]] = []
        for s, e in found:
            if out and (s >> 16) - (out[-1][1] >> 16) <= 1 << 16:
                out[-1] = (out[-1][0], max(e, out[-1][1]))
            else:
                out.append((s, e))
        return out

    def starts(self) -> list[int]:
        """Virtual offsets at which a row begins, ascending."""
        return sorted({s for r in self.bins.values() for s, _ in r} | set(self.windows.values()))

    def pack(self) -> bytes:
        parts = [struct.pack("<i", len(self.bins))]
        for b, ranges in sorted(self.bins.items()):
            parts.append(struct.pack("<Ii", b, len(ranges)) + b"".join(struct.pack("<QQ", *r) for r in ranges))
        n = max(self.windows, default=-1) + 1
        parts.append(struct.pack("<i", n))
        # a window that no row reaches takes the offset of the one before it
        last, slots = 0, []
        for w in range(n):
            last = self.windows.get(w, last)
            slots.append(last)
        return b"".join([*parts, struct.pack(f"<{n}Q", *slots)])

    @classmethod
    def unpack(cls, data: bytes, at: int) -> tuple["ContigIndex", int]:
        out = cls()
        (n_bins,), at = struct.unpack_from("<i", data, at), at + 4
        for _ in range(n_bins):
            b, n = struct.unpack_from("<Ii", data, at)
            at += 8
            if b < (1 << 3 * LEVELS) // 7:  # beyond are counts of rows
                out.bins[b] = [struct.unpack_from("<QQ", data, at + 16 * k) for k in range(n)]
            at += 16 * n
        (n,), at = struct.unpack_from("<i", data, at), at + 4
        out.windows = {w: v for w, v in enumerate(struct.unpack_from(f"<{n}Q", data, at)) if v}
        return out, at + 8 * n


def split_ranges(ranges: list[tuple[int, int]], starts: list[int], target: int) -> list[tuple[int, int]]:
    """Ranges cut at known row starts into pieces of about ``target`` compressed bytes."""
    out = []
    for s, e in ranges:
        begin = s
        for v in starts:
            if begin < v < e and (v >> 16) - (begin >> 16) >= target:
                out.append((begin, v))
                begin = v
        out.append((begin, e))
    return out


def open_file(path: str):
    """An open file and its size."""
    fs, where = file_system(path)
    return fs.open_input_file(where), fs.get_file_info(where).size


def read_all(path: str) -> bytes | None:
    """A small file's bytes; None if there is none."""
    fs, where = file_system(path)
    if fs.get_file_info(where).type != pyarrow.fs.FileType.File:
        return None
    with fs.open_input_file(where) as f:
        return f.read()


class PartWriter:
    """A sink's part: whole members, and the index of its rows as if the part stood at byte 0."""

    def __init__(self, path: str):
        fs, where = file_system(path)
        self.path, self.out = path, fs.open_output_stream(where)
        self.held, self.at, self.index = bytearray(), 0, {}

    def _flush(self) -> None:
        member = deflate(bytes(self.held))
        self.out.write(member)
        self.at += len(member)
        self.held.clear()

    def add(self, row: bytes, contig: int | str | None = None, start: int = 0, end: int = 0) -> None:
        """A row, begun in a new member if the open one has no room for it; longer ones go on in the next."""
        if self.held and len(self.held) + len(row) > MEMBER:
            self._flush()
        begin, left = self.at << 16 | len(self.held), memoryview(row)
        while len(self.held) + len(left) > MEMBER:
            room = MEMBER - len(self.held)
            self.held += left[:room]
            left = left[room:]
            self._flush()
        self.held += left
        if len(self.held) == MEMBER:
            self._flush()
        if contig is not None:
            self.index.setdefault(contig, ContigIndex()).add(start, end, begin, self.at << 16 | len(self.held))

    def close(self) -> int:
        if self.held:
            self._flush()
        self.out.close()
        return self.at


def join_parts(path: str, head: bytes, parts: list[tuple[str, int, dict]]) -> dict:
    """One file of the head's members, the parts in order and the end; the index of the whole. Parts stream through in pieces, then go."""
    fs, where = file_system(path)
    whole: dict = {}
    with fs.open_output_stream(f"{where}.joining") as out:
        at = 0
        for k in range(0, len(head), MEMBER):
            member = deflate(head[k : k + MEMBER])
            out.write(member)
            at += len(member)
        for part, size, index in parts:
            part_fs, part_where = file_system(part)
            with part_fs.open_input_stream(part_where) as f:
                while piece := f.read(READ):
                    out.write(piece)
            for contig, own in index.items():
                whole.setdefault(contig, ContigIndex()).merge(own.shift(at))
            at += size
        out.write(END)
    fs.move(f"{where}.joining", where)
    for part, *_ in parts:
        part_fs, part_where = file_system(part)
        part_fs.delete_file(part_where)
    return whole
