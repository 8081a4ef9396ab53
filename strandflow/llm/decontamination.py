"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document holds an item if some stretch of its words is within
floor((1 - SIMILARITY) * n) word edits of the item's n words, letters A-Z
lower-cased. An item within that distance keeps one of distance-plus-one
segments whole, so item-sized windows are taken wherever the first words of a
segment turn up. Each window goes through the CGK random walk, which maps edit
to Hamming distance: a repetition emits the current word for 3n steps and
moves on or stays by a random bit of that word and step. Sampled coordinates
make the bucket; windows are joined with the items of their bucket in any of
the repetitions, whose number reaches ``RECALL`` for pairs that agree in half
of the coordinates. Joined pairs are verified by exact bit-parallel edit
distance against every stretch around the window.

Items travel to the tasks in blocks of about ``BLOCK`` items and
``BLOCK_BYTES`` of text; a larger benchmark takes one pass of the documents for
each block. Windows around seeds are made and searched ``AROUND`` at a time, so
seeds of frequent words cost time, not memory.

Defined results: null or blank texts and items hold nothing; equal items all
match, and an item without an id is one like any other, its item_id null;
texts are whole; repeated rows give repeated rows; empty tables give no
rows; extra columns are ignored by leaks() and kept by decontaminate().
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import base_columns
from .textkit import Words, gram_hashes, slices

SIMILARITY, RECALL, SAMPLED = 0.8, 0.999, 2
BLOCK, BLOCK_BYTES = 20_000, 32 << 20
SEED_WORDS, AROUND = 4, 400_000


def repetitions(recall: float = RECALL, sampled: int = SAMPLED, agree: float = 0.5) -> int:
    """Runs after which a pair that agrees in the share ``agree`` of coordinates has met with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**sampled))


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    return math.floor((1 - similarity) * n + 1e-9)


def search(pattern: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """Least edits between the pattern and any stretch of the text, and the end of the first such stretch; None if over ``most``. Bit-parallel over pattern words."""
    m = len(pattern)
    where: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = mask, 0, m, (m, 0)
    for j, w in enumerate(text):
        match = where.get(w, 0)
        across = match | minus
        diag = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | ~(diag | plus)
        down = plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & mask, (down << 1) & mask
        plus, minus = (down | ~(across | up)) & mask, up & across & mask
        if score < best[0]:
            best = score, j + 1
    return best if best[0] <= most else None


class ItemIndex:
    """Seeds and bucket keys of one block of items."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float = SIMILARITY, recall: float = RECALL, sampled: int = SAMPLED):
        column = pa.array([t or "" for _, t in items], pa.string())
        words = Words(column, lower=True)
        hashes, at = words.hashes(), words.doc_words
        self.ids = [i for i, _ in items]
        self.words = [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.most = [allowed(len(w), similarity) for w in self.words]
        seeds: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item, w in enumerate(self.words):
            n, parts = len(w), self.most[item] + 1
            for p in range(parts if n else 0):
                lo, hi = n * p // parts, n * (p + 1) // parts
                k = min(SEED_WORDS, hi - lo)
                seeds[k].append((int(gram_hashes(w[lo : lo + k], k)[0]), item, lo))
        self.seeds = {}
        for k, rows in seeds.items():
            rows.sort()
            key = np.array([r[0] for r in rows], np.uint64)
            bits = np.zeros(1 << 22, bool)
            bits[(key >> np.uint64(42)).astype(np.int64)] = True
            self.seeds[k] = key, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), bits
        rng = np.random.RandomState(77)
        self.runs, self.sampled = repetitions(recall, sampled), sampled
        longest = max([1, *map(len, self.words)])
        self.factors = rng.randint(0, 1 << 62, (3 * longest, self.runs)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.where = rng.random_sample((self.runs, sampled))
        full = [i for i, w in enumerate(self.words) if len(w)]
        flat = np.concatenate([self.words[i] for i in full]) if full else np.zeros(0, np.uint64)
        n = np.array([len(self.words[i]) for i in full], np.int64)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if full else n
        keys = self.buckets(flat, starts, n)
        table: dict[int, list[int]] = defaultdict(list)
        for row, item in zip(keys.T.tolist(), full, strict=True):
            for key in row:
                table[key].append(item)
        self.table = dict(table)
        self.known = np.sort(np.array(list(self.table), np.uint64))

    def buckets(self, flat: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Bucket key of each repetition and window (n words of ``flat`` from ``starts`` on): hash of the sampled coordinates of its embedding."""
        w = len(starts)
        if not w:
            return np.zeros((self.runs, 0), np.uint64)
        at = np.zeros((self.runs, w), np.int64)
        want = np.floor(self.where[:, :, None] * (3 * n)).astype(np.int64)
        got = np.zeros((self.runs, self.sampled, w), np.uint64)
        end = len(flat) - 1
        with np.errstate(over="ignore"):
            for j in range(int(3 * n.max())):
                word = flat[np.minimum(starts + at, end)]
                inside = at < n
                out = np.where(inside, word, np.uint64(0))
                for t in range(self.sampled):
                    np.copyto(got[:, t], out, where=want[:, t] == j)
                at += inside & ((word * self.factors[j][:, None]) >> np.uint64(63)).astype(bool)
            key = np.arange(1, self.runs + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) ^ (n.astype(np.uint64) << np.uint64(48))
            for t in range(self.sampled):
                key = (key ^ got[:, t]) * np.uint64(0xC2B2AE3D27D4EB4F)
                key ^= key >> np.uint64(29)
        return key

    def windows(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First word and size of the item-sized windows that begin around seeds, inside the seed's document; about AROUND at a time, those distinct."""
        doc = words.doc_of_word()
        sizes, shifts = np.array([len(w) for w in self.words], np.int64), np.array(self.most, np.int64)
        seeds = max(1, AROUND // (2 * int(shifts.max(initial=0)) + 1))
        for k, (keys, items, offsets, bits) in self.seeds.items():
            grams = gram_hashes(hashes, k)
            hit = np.flatnonzero(bits[(grams >> np.uint64(42)).astype(np.int64)])
            hit = hit[doc[hit] == doc[hit + k - 1]]
            lo, hi = np.searchsorted(keys, grams[hit], "left"), np.searchsorted(keys, grams[hit], "right")
            met = hi > lo
            hit, lo, hi = hit[met], lo[met], hi[met]
            # windows that each place gives: the sum of 2 * shift + 1 over its seeds
            upto = np.concatenate([[0], np.cumsum(2 * shifts[items] + 1)])
            cost = np.cumsum(upto[hi] - upto[lo])
            a = 0
            while a < len(hit):
                b = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + AROUND, "right")))
                # one place of more seeds than that goes by a part of its seeds
                for first in range(int(lo[a]), int(hi[a]), seeds) if b == a + 1 else [None]:
                    low, high = (lo[a:b], hi[a:b]) if first is None else (np.array([first]), np.minimum(hi[a:b], first + seeds))
                    count = high - low
                    place = np.repeat(hit[a:b], count)
                    row = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    n, shift = sizes[items[row]], shifts[items[row]]
                    around = np.repeat(np.arange(len(row)), 2 * shift + 1)
                    step = np.arange(len(around)) - np.repeat(np.cumsum(2 * shift + 1) - 2 * shift - 1, 2 * shift + 1)
                    own = doc[place][around]
                    start = np.clip((place - offsets[row])[around] - shift[around] + step, words.doc_words[own], None)
                    keep = start < words.doc_words[own + 1]
                    every = np.unique(np.stack([start[keep], n[around][keep]]), axis=1)
                    yield every[0], every[1]
                a = b

    def matches(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(document, item, edits, first word) of the best stretch for each document and item, in order."""
        words = Words(column, lower=True)
        if not len(words.starts) or not self.table:
            return []
        hashes, doc = words.hashes(), words.doc_of_word()
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for starts, n in self.windows(words, hashes):
            tried: set[tuple[int, int]] = set()
            for a in range(0, len(starts), 2000):
                s, size = starts[a : a + 2000], n[a : a + 2000]
                keys = self.buckets(hashes, s, size)
                for run, w in zip(*np.nonzero(np.isin(keys, self.known)), strict=True):
                    start, d = int(s[w]), int(doc[s[w]])
                    for item in self.table[int(keys[run, w])]:
                        if (start, item) in tried:
                            continue
                        tried.add((start, item))
                        most, m = self.most[item], len(self.words[item])
                        lo, hi = max(int(words.doc_words[d]), start - most), min(int(words.doc_words[d + 1]), start + m + 2 * most)
                        seen = search(self.words[item].tolist(), hashes[lo:hi].tolist(), most)
                        if seen:
                            first = max(lo, lo + seen[1] - m) - int(words.doc_words[d])
                            best[d, item] = min(best.get((d, item), (m, 0)), (seen[0], first))
        return sorted((d, item, edits, first) for (d, item), (edits, first) in best.items())


def item_blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[ItemIndex]:
    """Indexes of about ``block`` items and BLOCK_BYTES of their text each, dealt by hash."""
    items = base_columns(benchmark, "item_id", "text").where("text IS NOT NULL")
    total = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    blocks = max(1, math.ceil(total.n / block), math.ceil((total.size or 0) / BLOCK_BYTES))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield ItemIndex(sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, edits, first_word, item_words: the best stretch for each document and item it holds."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("first_word", pa.int64()), ("item_words", pa.int64())])

    def one(index) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                for part in slices(batch):
                    ids = part.column("doc_id").to_pylist()
                    rows = [(ids[d], own.ids[i], e, f, len(own.words[i])) for d, i, e, f in own.matches(part.column("text"))]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        return base_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, item_id long, edits long, first_word long, item_words long")

    sc = docs.sparkSession.sparkContext
    return reduce(DataFrame.unionByName, [one(sc.broadcast(x)) for x in item_blocks(benchmark, block)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    sc = docs.sparkSession.sparkContext
    for index in item_blocks(benchmark, block):
        own = sc.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    held = {d for d, *_ in own.value.matches(part.column("text"))}
                    yield part.filter(pa.array([i not in held for i in range(part.num_rows)])) if held else part

        docs = docs.mapInArrow(run, docs.schema)
    return docs
