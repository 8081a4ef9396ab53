"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the 16-word grams in every window of 35 words,
the one of least hash. Equal windows choose equal anchors, so documents are
joined on anchors that occur more than once; only windows around such anchors
can repeat. Each occurrence is then extended both ways: the hashes of all
windows that chose the anchor travel in one row, and those met again at
another occurrence are repeated. Overlapping repeated windows make up the
maximal repeats, whose words are removed.

An anchor with more than ``HOT`` occurrences is split by window (the result
is the same, the rows are shorter): windows that repeat within one part of the
input are settled there, those that repeat within one of ``SALTS`` groups of
parts are settled next, and each group sends one row on. So no task gathers
more than HOT occurrences of an anchor, a SALTS-th of the parts' rows of a
window, or SALTS rows of it. Windows are compared by 64-bit hashes; among n
windows around joined anchors, about n*n/2**65 pairs are expected to agree by
chance.

Defined results: null text has no words; texts shorter than a window stay
whole; repeated rows (equal doc_id and text) repeat each other; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions
from .textkit import Words, gram_hashes, segments, slices

WINDOW, GRAM, HOT = 35, 16, 2_000
#: Windows in one row at most; their marks fit a long.
RUN = 60


def sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best() of each w values in a row, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


class Windows:
    """All windows of a text column: document, first word, hash, anchor hash."""

    def __init__(self, column: pa.Array, window: int = WINDOW, gram: int = GRAM):
        words = Words(column)
        self.counts = np.maximum(words.counts - window + 1, 0)
        h, first = words.hashes(), words.doc_words[:-1]
        n = int(self.counts.sum())
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        offsets = segments(self.counts)
        self.start = np.arange(n) - offsets[:-1][self.doc]
        self.place = self.start + first[self.doc]
        self.window = window
        self._words = h
        if n:
            grams = gram_hashes(h, gram)
            self.grams, self.reach = grams, window - gram + 1
            self.low = sliding(grams, self.reach, np.minimum)
            self.anchor = self.low[self.place]
            edge = np.ones(n, bool)
            edge[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
            run = np.flatnonzero(edge)
            long = np.diff(np.append(run, n))
            if long.max() > RUN:
                parts = -(-long // RUN)
                run = np.repeat(run, parts) + (np.arange(parts.sum()) - np.repeat(segments(parts)[:-1], parts)) * RUN
            self.run = run
        else:
            self.anchor, self.run = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def hashes(self) -> np.ndarray:
        return gram_hashes(self._words, self.window)[self.place]

    def occurrences(self) -> np.ndarray:
        """How often each run's anchor lies in the words of the run's windows."""
        chosen = np.zeros(len(self.grams), bool)
        last = np.append(self.run[1:], len(self.doc)) - 1
        lo, hi = self.place[self.run], self.place[last] + self.reach
        for d in range(self.reach):  # a gram is chosen if it is the least of a window it lies in
            chosen[d : d + len(self.low)] |= self.grams[d : d + len(self.low)] == self.low
        at = np.flatnonzero(chosen)
        a, b = np.searchsorted(at, lo), np.searchsorted(at, hi)
        n = b - a
        pair = np.repeat(a - segments(n)[:-1], n) + np.arange(n.sum())
        same = self.grams[at[pair]] == np.repeat(self.anchor[self.run], n)
        return np.add.reduceat(same, segments(n)[:-1], dtype=np.int64)


def _anchors(window: int, gram: int):
    schema = pa.schema([("anchor", pa.int64()), ("doc_key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Windows(part.column("text"), window, gram)
                if not len(w.run):
                    continue
                # a row for each document and anchor
                anchor, doc, n = w.anchor[w.run], w.doc[w.run], w.occurrences()
                order = np.lexsort((anchor, doc))
                anchor, doc, n = anchor[order], doc[order], n[order]
                edge = np.ones(len(doc), bool)
                edge[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(edge)
                n = np.add.reduceat(n, at)
                key = part.column("doc_key").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at].view(np.int64)), pa.array(key[doc[at]]), pa.array(n)], schema=schema)

    return run


#: Groups of parts of the input that a hot window's rows are dealt over.
SALTS = 256
EXTEND = "key long, salt int, doc_key long, first int, known boolean, marks long, hashes binary"
_SETTLED = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("doc_key", pa.int64()), ("first", pa.int32()), ("known", pa.bool_()), ("marks", pa.int64()), ("hashes", pa.binary())])


def _extend(window: int, gram: int):
    def batch_of(key, doc_key, first, known, marks, sizes, packed, salt=None) -> pa.RecordBatch:
        at = segments(sizes * 8).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(packed))])
        salt = np.zeros(len(key), np.int32) if salt is None else salt.astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt), pa.array(doc_key), pa.array(first.astype(np.int32)), pa.array(known), pa.array(marks.astype(np.int64)), binary], schema=_SETTLED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            for part in slices(batch):
                w = Windows(part.column("text"), window, gram)
                if not len(w.run):
                    continue
                keys = part.column("doc_key").to_numpy()
                hits = part.column("hits")
                sizes = np.diff(hits.offsets.to_numpy())
                flat = hits.flatten()
                of_doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) * salt
                found = flat.field("anchor").to_numpy().view(np.uint64) ^ of_doc
                hot = found[flat.field("hot").to_numpy(zero_copy_only=False)]
                own = w.anchor[w.run] ^ (w.doc[w.run].astype(np.uint64) * salt)
                end = np.append(w.run[1:], len(w.doc))
                h = w.hashes()
                heated = np.isin(own, hot)
                usual = np.isin(own, found) & ~heated
                if usual.any():
                    lo, n = w.run[usual], (end - w.run)[usual]
                    at = np.repeat(lo - segments(n)[:-1], n) + np.arange(n.sum())
                    yield batch_of(w.anchor[lo], keys[w.doc[lo]], w.start[lo], np.zeros(len(lo), bool), np.zeros(len(lo)), n, h[at])
                if heated.any():
                    lo, n = w.run[heated], (end - w.run)[heated]
                    at = np.repeat(lo - segments(n)[:-1], n) + np.arange(n.sum())
                    _, first, back, times = np.unique(h[at], return_index=True, return_inverse=True, return_counts=True)
                    here = at[times[back] > 1]  # settled: met twice in this part
                    none = np.zeros(len(here), np.int64)
                    if len(here):
                        yield batch_of(keys[w.doc[here]].view(np.uint64), keys[w.doc[here]], w.start[here], none.astype(bool), none + 1, none, h[:0])
                    one = at[first]  # for the other parts, one row for each window
                    yield batch_of(h[one], keys[w.doc[one]], w.start[one], times > 1, np.zeros(len(one)), np.ones(len(one), np.int64), h[one], 1 + keys[w.doc[one]] % SALTS)

    return run


def _settle(last: bool):
    """Rows sorted by key and salt: marks the windows whose hash another row of the key and salt has, too.

    Gives the marked rows, without hashes, and, if not ``last``, one row of
    each salted key for the next level, ``known`` if it is met again.
    """

    def marked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        column = rows.column("hashes").combine_chunks() if isinstance(rows.column("hashes"), pa.ChunkedArray) else rows.column("hashes")
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        h = data[offsets[0] : offsets[-1]].view(np.uint64) if offsets[-1] > offsets[0] else np.zeros(0, np.uint64)
        at = (offsets - offsets[0]) // 8
        n = np.diff(at)
        key, salt, doc_key, first, known, marks = (rows.column(c).to_numpy() for c in _SETTLED.names[:-1])
        marks = marks.copy()
        if len(h):
            # one row of a salted key has one window, its key; other rows of equal hash lie under the same key
            group = np.repeat(salt, n).astype(np.uint64)
            with np.errstate(over="ignore"):
                _, back, times = np.unique(h ^ group * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
            again = np.zeros(len(times), bool)
            again[back[np.repeat(known, n)]] = True
            again |= times > 1
            bit = np.left_shift(1, np.arange(len(h)) - np.repeat(at[:-1], n))
            bit[~again[back]] = 0
            full = n > 0
            marks[full] |= np.bitwise_or.reduceat(bit, at[:-1][full])
        none = np.zeros(len(marks), np.int64)
        yield settled(doc_key, none, doc_key, first, none.astype(bool), marks, None, marks != 0)
        if not last:
            on = salt > 0
            on[1:] &= (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            yield settled(key, none, doc_key, first, marks != 0, none, column, on)

    def settled(key, salt, doc_key, first, known, marks, hashes, keep) -> pa.RecordBatch:
        left = pa.array([b""] * int(keep.sum()), pa.binary()) if hashes is None else hashes.filter(pa.array(keep))
        return pa.RecordBatch.from_arrays([*(pa.array(c[keep], f.type) for c, f in zip((key, salt, doc_key, first, known, marks), _SETTLED, strict=False)), left], schema=_SETTLED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column("key").to_numpy()
            if not len(key):
                continue
            cut = len(key) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
            if kept and kept[-1].column("key")[len(kept[-1]) - 1].as_py() != key[0]:
                yield from marked(pa.Table.from_batches(kept))
                kept = []
            if cut:
                yield from marked(pa.Table.from_batches([*kept, batch.slice(0, cut)]))
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield from marked(pa.Table.from_batches(kept))

    return run


def covered_words(n_words: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words the windows from these first words on cover: the union of the maximal repeats."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:-1]) > 0


def repeated_windows(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_key, first, marks: bit i set if the window from word first + i on starts elsewhere, too. ``keyed`` has doc_id, text, doc_key, dealt by doc_key."""
    n = partitions(keyed.sparkSession)
    anchors = keyed.select("text", "doc_key").mapInArrow(_anchors(window, gram), "anchor long, doc_key long, n long")
    joined = anchors.groupBy("anchor").agg(F.sum("n").alias("times")).where("times > 1")
    # sets: repeated rows give the same anchors, and each of them gets the array
    hits = anchors.join(joined, "anchor").groupBy("doc_key").agg(F.collect_set(F.struct("anchor", (F.col("times") > hot).alias("hot"))).alias("hits"))
    near = keyed.repartition(n, "doc_key").join(hits.hint("shuffle_hash"), "doc_key").select("doc_id", "text", "doc_key", "hits")
    rows = near.mapInArrow(_extend(window, gram), EXTEND)
    near = rows.repartition(n, "key", "salt").sortWithinPartitions("key", "salt").mapInArrow(_settle(False), EXTEND)
    # marks pass through, and what is left of salted keys meets
    last = near.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_settle(True), EXTEND)
    return last.select("doc_key", "first", "marks")


def keyed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc_key: a key of whole rows, so that ties in doc_id and null ids do no harm."""
    return docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text")).withColumn("doc_key", F.xxhash64("doc_id", "text"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept: the words no repeated window covers, joined by one space."""
    keyed = keyed_documents(docs)
    n = partitions(docs.sparkSession)
    marks = repeated_windows(keyed, window, gram, hot).groupBy("doc_key").agg(F.collect_set(F.struct("first", "marks")).alias("found"))
    full = keyed.repartition(n, "doc_key").join(marks.hint("shuffle_hash"), "doc_key", "left").select("doc_id", "text", "doc_key", "found")
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * with_text
    schema = pa.schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                found = part.column("found")
                for i, (doc_id, text) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)):
                    words = (text or "").encode().split()
                    kept, cut = words, 0
                    if found[i].is_valid:
                        spans = found[i].values
                        first, marks = spans.field("first").to_numpy(), spans.field("marks").to_numpy()
                        hit = np.flatnonzero((marks[:, None] >> np.arange(RUN)) & 1)
                        gone = covered_words(len(words), first[hit // RUN] + hit % RUN, window)
                        kept, cut = list(compress(words, ~gone)), int(gone.sum())
                    left = b" ".join(kept)
                    rows.append((doc_id, len(words), cut, hashlib.sha256(left).hexdigest(), *([left.decode()] * with_text)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return full.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
