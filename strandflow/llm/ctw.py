"""LM scoring by context-tree weighting over bytes, and the word-count base score.

A byte is decomposed into eight binary decisions, each with a context tree of
its own over the ``DEPTH`` bytes before it. A node's Krichevsky-Trofimov
estimate is mixed, half and half, with the product of its children's weighted
probabilities, from the deepest contexts up to the empty one; the code length
of a byte follows from the resulting posterior weights along its context path.

The corpus is gathered in bounded pieces. Documents are dealt into chunks of
about ``CHUNK_BYTES``; a chunk sends each of its distinct words and byte grams
once, with its training count. Words are sharded by hash, grams by the two
bytes nearest to the coded one. Counts are summed by key in levels of
``GROUP`` rows each, so a task sums GROUP rows of a shard at most; the trees
below two context bytes are weighted shard by shard, and a sum by decision and
nearest byte merges them into the two levels above (65,536 nodes at most, the
only thing that the driver sees besides three totals). Each chunk gets back
the values of its own keys only. A shard with many questions is answered by
several tasks, each with a copy of its model; a copy answers ``ANSWERS`` keys,
or four times as many as its model has, so copies stay under a quarter of the
questions.

Defined results: null text is empty, one end token and one end symbol (byte
0); texts of any length are whole; repeated rows count as often as they occur;
an empty table gives no rows; extra columns are ignored. A context that
training never met has probability one half for each bit.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, partitions
from .textkit import _LOWER, Words, segments, slices, utf8

DEPTH = 5
CHUNK_BYTES = 8 << 20
#: Rows of a shard that one task sums.
GROUP = 64
#: Keys that one copy of a shard's model answers, at least.
ANSWERS = 4_000_000
#: Most shards of words, and of grams (as many as two bytes have values).
WORD_SHARDS, GRAM_SHARDS = 4096, 1 << 16
END_WORD = np.uint64(0x00E17D0C0FFEE001)
WORD, GRAM = 0, 1
HALF = math.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x >= 0.5: recurrence up to 8, then Stirling's series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] -= np.log(y[low])
        y[low] += 1
    r = 1 / y
    series = r / 12 - r**3 / 360 + r**5 / 1260 - r**7 / 1680
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - math.log(math.pi) - log_gamma(n0 + n1 + 1.0)


class Subtree:
    """The weighted trees of one decision (bit ``k`` of a byte) below contexts of two bytes.

    keys: the context bytes, the nearest in the second byte from below, and
    the coded byte in the lowest; counts: training counts, zero allowed.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, k: int):
        self.depth = depth
        byte = (keys & np.uint64(255)).astype(np.int64)
        z = (1 << k) | (byte >> (8 - k))
        self.bit = (byte >> (7 - k)) & 1
        levels = range(depth, 1, -1)
        self.back: dict[int, np.ndarray] = {}
        self.counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        node = (keys & ~np.uint64(255)) | z.astype(np.uint64)
        n0, n1 = counts * (1 - self.bit), counts * self.bit
        for d in levels:
            node, self.back[d] = np.unique(node & np.uint64((1 << (8 * d + 8)) - 1), return_inverse=True)
            n0, n1 = (np.bincount(self.back[d], n, len(node)) for n in (n0, n1))
            self.counts[d] = n0, n1
        self.near = (node & np.uint64(0xFFFF)).astype(np.int64)  # nearest byte and decision
        self.stop: dict[int, np.ndarray] = {}
        below = None
        for d in levels:
            block = kt_block(*self.counts[d])
            if below is None:
                self.weighted = block
                self.stop[d] = np.ones(len(block))
            else:
                product = np.bincount(below, self.weighted, len(block))
                self.weighted = np.logaddexp(HALF + block, HALF + product)
                self.stop[d] = np.exp(HALF + block - self.weighted)
            below = self.back[d - 1] if d > 2 else None

    def top(self) -> np.ndarray:
        """Nearest byte and decision, zeros, ones and the product of weighted probabilities (ln) below them, as rows."""
        near, place = np.unique(self.near, return_inverse=True)
        return np.stack([near, *(np.bincount(place, x, len(near)) for x in (*self.counts[2], self.weighted))])

    def below_top(self) -> np.ndarray:
        """Probability of each gram's bit, mixed over the depths from 2 on."""
        places = {}
        at = np.arange(len(self.bit))
        for d in range(self.depth, 1, -1):
            at = places[d] = self.back[d][at]
        q = np.zeros(len(self.bit))
        for d in range(self.depth, 1, -1):
            at = places[d]
            n0, n1 = self.counts[d][0][at], self.counts[d][1][at]
            stop = self.stop[d][at]
            q = stop * (np.where(self.bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1) + (1 - stop) * q
        return q


class Top:
    """The nodes of one context byte and of none, for each decision."""

    def __init__(self, near: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        """near: nearest byte times 256 plus decision, each once."""
        sums = np.zeros((3, 1 << 16))
        sums[:, near] = zeros, ones, below
        self.stop1, self.kt1, weighted = self._mixed(*sums)
        over = [np.bincount(near & 255, x, 256) for x in (zeros, ones, weighted[near])]
        self.stop0, self.kt0, _ = self._mixed(*over)

    @staticmethod
    def _mixed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        block = kt_block(zeros, ones)
        weighted = np.logaddexp(HALF + block, HALF + below)
        return np.exp(HALF + block - weighted), np.stack([zeros + 0.5, ones + 0.5]) / (zeros + ones + 1), weighted

    def log10(self, keys: np.ndarray, q: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte in its context."""
        near, k = (keys & np.uint64(0xFFFF)).astype(np.int64)[:, None], np.arange(8)
        byte = near & 255
        z, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
        at = (near & ~255) | z
        p = self.stop1[at] * self.kt1[bit, at] + (1 - self.stop1[at]) * q
        p = self.stop0[z] * self.kt0[bit, z] + (1 - self.stop0[z]) * p
        return np.log10(p).sum(axis=1)


def byte_grams(column: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the lower-cased texts and each text's end symbol: the coded byte and the bytes before it.

    The second array has, for each document, its first key and the key behind
    its last; between documents lie keys of padding.
    """
    if column.null_count:
        column = column.fill_null("")
    framed = pc.binary_join_element_wise(column.cast(pa.binary()), pa.scalar(b"\0" * (depth + 1)), pa.scalar(b""))
    data, at = utf8(framed)
    buffer = np.zeros(len(data) + 7, np.uint8)
    buffer[7:] = _LOWER[data]
    eight = np.ndarray((len(data),), ">u8", buffer, 0, (1,))
    keys = eight.astype(np.uint64) & np.uint64((1 << (8 * depth + 8)) - 1)
    return keys, np.stack([at[:-1], at[1:] - depth], axis=1).ravel()


def word_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's words and, last, its end token; each document's first key and the key behind its last."""
    words = Words(column, lower=True)
    at = segments(words.counts + 1)
    out = np.full(at[-1], END_WORD, np.uint64)
    doc = words.doc_of_word()
    out[np.arange(len(doc)) + doc] = words.hashes()
    return out, np.repeat(at, 2)[1:-1]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order of first occurrence, and each key's place among them."""
    coded = pa.array(keys.view(np.int64)).dictionary_encode()
    return coded.dictionary.to_numpy().view(np.uint64), coded.indices.to_numpy()


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys as deflated byte planes of their differences."""
    step = np.diff(keys, prepend=np.uint64(0))
    return zlib.compress(step.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys of several parts, and the sums of their counts."""
    keys = np.concatenate([k for k, _ in parts])
    own, place = np.unique(keys, return_inverse=True)
    return own, np.bincount(place, np.concatenate([n for _, n in parts]), len(own)).astype(np.int64)


def _text_slices(table: pa.Table, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    for batch in table.to_batches():
        yield from slices(batch, "text", most)


def shard_of(keys: np.ndarray, kind: int, shards: int) -> np.ndarray:
    """Words by hash, grams by the two nearest context bytes."""
    if kind == WORD:
        return ((keys >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
    near = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((near * np.uint64(40503) & np.uint64(0xFFFF)) * np.uint64(shards) >> np.uint64(16)).astype(np.int64)


DICTIONARY = "kind int, shard int, chunk int, n long, keys binary, counts binary"


def _chunk_keys(depth: int, shards: dict[int, int]):
    """Rows sorted by chunk: each chunk's distinct keys by kind and shard, with training counts."""

    schema = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("chunk", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def sums(store: list, keys: np.ndarray, at: np.ndarray, train: np.ndarray) -> None:
        own, place = distinct(keys)
        each = np.zeros(len(at), np.int64)  # lengths of documents and of the padding between
        each[:-1] = np.diff(at)
        each[-1] = len(keys) - at[-1]
        weight = np.zeros(len(at), np.int64)
        weight[::2] = train
        store.append((own, np.bincount(place, np.repeat(weight, each), len(own)).astype(np.int64)))
        if len(store) > 8:
            store[:] = [merged(store)]

    def flush(chunk: int, words: list, grams: list) -> Iterator[pa.RecordBatch]:
        for kind, store in ((WORD, words), (GRAM, grams)):
            keys, n = merged(store)
            shard = shard_of(keys, kind, shards[kind])
            order = np.argsort(shard, kind="stable")
            keys, n, shard = keys[order], n[order], shard[order]
            cuts = np.flatnonzero(np.diff(shard)) + 1
            rows = [(kind, int(s[0]), chunk, len(k), pack(k), zlib.compress(c.astype(np.int64).tobytes(), 1)) for s, k, c in zip(np.split(shard, cuts), np.split(keys, cuts), np.split(n, cuts), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, words, grams = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if chunk is not None and ids[lo] != chunk:
                    yield from flush(chunk, words, grams)
                    words, grams = [], []
                chunk = int(ids[lo])
                for part in _text_slices(pa.Table.from_batches([batch.slice(lo, hi - lo)])):
                    train = (~part.column("held_out").to_numpy(zero_copy_only=False)).astype(np.int64)
                    sums(words, *word_keys(part.column("text")), train)
                    sums(grams, *byte_grams(part.column("text"), depth), train)
        if chunk is not None:
            yield from flush(chunk, words, grams)

    return run


MODEL = "kind int, shard int, group int, n long, keys binary, values binary, top binary"


def _weigh(depth: int, final: bool):
    """Rows sorted by kind, shard and group: sums the counts of each as they stream by, and gives the shard's model or, if not ``final``, the sums."""

    schema = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("group", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("values", pa.binary()), ("top", pa.binary())])

    def model(kind: int, shard: int, group: int, parts: list) -> pa.RecordBatch:
        keys, n = merged(parts)
        if not final:
            values, top = zlib.compress(n.tobytes(), 1), None
        elif kind == WORD:
            values, top = n.tobytes(), b""
        else:
            trees = (Subtree(keys, n, depth, k) for k in range(8))
            done = [(t.below_top().astype(np.float32), t.top()) for t in trees]
            values, top = np.stack([q for q, _ in done], axis=1).tobytes(), np.concatenate([t for _, t in done], axis=1).tobytes()
        row = (kind, shard, group, len(keys), pack(keys), values, top)
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, held = None, [], 0
        for batch in batches:
            for kind, shard, group, keys, n in zip(*(batch.column(c) for c in ("kind", "shard", "group", "keys", "counts")), strict=True):
                here = kind.as_py(), shard.as_py(), group.as_py()
                if last is not None and here != last:
                    yield model(*last, parts)
                    parts, held = [], 0
                last = here
                parts.append((unpack(keys.as_py()), np.frombuffer(zlib.decompress(n.as_py()), np.int64)))
                held += len(parts[-1][0])
                if held > 2 * len(parts[0][0]) + (1 << 20):
                    parts = [merged(parts)]
                    held = len(parts[0][0])
        if last is not None:
            yield model(*last, parts)

    return run


def _top_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by nearest byte and decision; for words, near = -1 carries distinct and all training tokens."""
    for batch in batches:
        for kind, values, top in zip(*(batch.column(k).to_pylist() for k in ("kind", "values", "top")), strict=True):
            if kind == WORD:
                n = np.frombuffer(values, np.int64)
                near, a, b, c = np.array([[-1], [(n > 0).sum()], [n.sum()], [0]], float)
            else:
                near, a, b, c = np.frombuffer(top, float).reshape(4, -1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int64)), pa.array(a), pa.array(b), pa.array(c)], names=["near", "n0", "n1", "w"])


def _answers(top):
    """Model rows and chunk rows of a shard, the model first: each chunk's values in the order of its keys."""

    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = values = None
        own = top.value
        for batch in batches:
            for kind, chunk, k, v in zip(*(batch.column(c) for c in ("kind", "chunk", "keys", "values")), strict=True):
                kind, chunk, k = kind.as_py(), chunk.as_py(), k.as_py()
                if chunk < 0:
                    keys = unpack(k)
                    if kind == WORD:
                        values = np.frombuffer(v.as_py(), np.int64)
                    else:
                        q = np.frombuffer(v.as_py(), np.float32).reshape(-1, 8)
                        values = np.concatenate([own.log10(keys[i : i + 65536], q[i : i + 65536].astype(float)) for i in range(0, len(keys), 65536)])
                    continue
                found = values[np.searchsorted(keys, unpack(k))]
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([chunk], pa.int32()), pa.array([k], pa.binary()), pa.array([zlib.compress(found.tobytes(), 1) if kind == WORD else found.astype(np.float32).tobytes()], pa.binary())], schema=schema)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, score double, n_bytes long"


def _scores(depth: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("known_log", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])

    def lookup(rows: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
        kept = [(unpack(k.as_py()), v.as_py()) for i, k, v in zip(rows.column("kind").to_pylist(), rows.column("keys"), rows.column("values"), strict=True) if i == kind]
        read = (lambda v: np.frombuffer(zlib.decompress(v), np.int64)) if kind == WORD else (lambda v: np.frombuffer(v, np.float32))
        keys, values = np.concatenate([k for k, _ in kept]), np.concatenate([read(v) for _, v in kept])
        order = np.argsort(keys)
        return keys[order], values[order].astype(float)

    def per_key(keys: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        own, place = distinct(keys)
        return model[1][np.searchsorted(model[0], own)][place]

    def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(values, 0), at)[::2]

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        words, grams = lookup(found, WORD), lookup(found, GRAM)
        out = []
        for part in _text_slices(docs):
            keys, at = word_keys(part.column("text"))
            c = per_key(keys, words)
            g_keys, g_at = byte_grams(part.column("text"), depth)
            g = per_key(g_keys, grams)
            out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(np.diff(at)[::2]), pa.array(sums((c > 0).astype(np.int64), at)), pa.array(sums(np.log10(c + 1), at)), pa.array(sums(g, g_at)), pa.array(np.diff(g_at)[::2] - 1)], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return run


def score_documents(docs: DataFrame, depth: int = DEPTH, modulus: int = 7, held: int = 2, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (the code length)."""
    if not 2 <= depth <= 7:
        raise ValueError("2 to 7 context bytes")
    spark = docs.sparkSession
    plain = docs.select(F.col("`doc_id`").alias("doc_id"), F.coalesce(F.col("`text`"), F.lit("")).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(total / chunk_bytes))
    shards = {WORD: min(WORD_SHARDS, max(16, chunks)), GRAM: min(GRAM_SHARDS, max(256, 4 * chunks))}
    n = partitions(spark)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    keyed = plain.select("doc_id", "text", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == held, F.lit(False)).alias("held_out"), chunk.alias("chunk"))
    dealt = keyed.repartition(max(n, chunks), "chunk")
    sent = materialize(dealt.sortWithinPartitions("chunk").mapInArrow(_chunk_keys(depth, shards), DICTIONARY), "ctw-keys")

    # counts by key, GROUP rows of a shard at a time
    level, groups = sent.select("kind", "shard", F.col("chunk").alias("at"), "keys", "counts"), chunks
    while True:
        groups = math.ceil(groups / GROUP)
        rows = level.select("kind", "shard", F.pmod("at", F.lit(groups)).cast("int").alias("group"), "keys", "counts")
        rows = rows.repartition(n, "kind", "shard", "group").sortWithinPartitions("kind", "shard", "group")
        if groups == 1:
            break
        summed = materialize(rows.mapInArrow(_weigh(depth, False), MODEL).drop("top"), "ctw-sums")
        level = summed.select("kind", "shard", F.col("group").alias("at"), "keys", F.col("values").alias("counts"))
    model = materialize(rows.mapInArrow(_weigh(depth, True), MODEL), "ctw-model")

    tops = model.mapInArrow(_top_rows, "near long, n0 double, n1 double, w double").groupBy("near").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "w"))).toPandas()  # 65,537 rows at most
    of_words = tops[tops["near"] < 0]
    types, tokens = int(of_words["n0"].sum()), int(of_words["n1"].sum())
    tops = tops[tops["near"] >= 0]
    top = spark.sparkContext.broadcast(Top(*(tops[c].to_numpy() for c in ("near", "n0", "n1", "w"))))

    # the chunks' own keys; how many tasks answer for a shard follows from its questions and its model: a row for each shard
    sizes = sent.groupBy("kind", "shard").agg(F.sum("n").alias("asked")).join(model.select("kind", "shard", F.col("n").alias("known")), ["kind", "shard"])
    copies = F.greatest(F.lit(1), F.ceil(F.col("asked") / F.greatest(F.lit(ANSWERS), 4 * F.col("known"))))
    sizes = F.broadcast(sizes.select("kind", "shard", copies.cast("int").alias("copies")))
    asked = sent.join(sizes, ["kind", "shard"]).select("kind", "shard", F.pmod("chunk", "copies").alias("group"), "chunk", "keys", F.lit(None).cast("binary").alias("values"))
    told = model.join(sizes, ["kind", "shard"]).select("kind", "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("group"), F.lit(-1).alias("chunk"), "keys", "values")
    both = asked.unionByName(told).repartition(n, "kind", "shard", "group").sortWithinPartitions("kind", "shard", "group", "chunk")
    found = both.mapInArrow(_answers(top), "kind int, chunk int, keys binary, values binary")
    scored = dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_scores(depth), SCORES)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("known_log") - F.col("n_tokens") * math.log10(max(tokens + types + 1, 1))).alias("base_score"),
        "score", (-F.col("score") / math.log10(2) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
