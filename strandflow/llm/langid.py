"""Language ID by a linear-chain conditional random field over words.

A word's features are its affixes of one to four bytes, its byte n-grams of one
to four, the word itself and the languages whose lexicon has it, hashed into
``BUCKETS`` rows of weights; transitions between the labels of neighbouring
words are learned with them. Forward-backward gives each word's label
distribution, so stretches of another language inside a text show; a text's
language is the label of the largest mean over its words with letters.

Training takes a bounded sample: of the ``MOST_LANGS`` languages with most
labelled documents, ``PER_LANG`` distinct texts and ``LANG_BYTES`` each, by
hash, so that every run takes the same ones. One half gives the lexicons, and
the other is cut into pieces that are joined across languages, so that the
transitions see code-switching.

Texts are cut into segments of ``SEGMENT`` words, or as many as there are
languages, whose transfer matrices are multiplied in parallel. That keeps the
cost of long texts linear in their words, and the memory of a slice at a number
for each word and language; with more than FEW_LANGS languages slices are
smaller, but a text is always whole.

Defined results: null texts and texts without a letter are ``und`` with score
0; without any labelled text all are; texts are whole; equal texts have equal
results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import base_columns, bounded_sample
from .textkit import BYTE_TABLE, RangeHash, Words, mix, segments, slices

PER_LANG, LANG_BYTES, MOST_LANGS, FEW_LANGS = 300, 4 << 20, 200, 8
BUCKETS, SEGMENT = 1 << 18, 32
STEPS, BATCH, LENGTH, RATE, DECAY = 200, 160, 48, 0.1, 1e-6
_SALTS = np.random.RandomState(9).randint(0, 1 << 62, 16).astype(np.uint64)


def _bucket(h: np.ndarray, family: int) -> np.ndarray:
    return (mix(h ^ _SALTS[family]) >> np.uint64(46)).astype(np.int64)


def word_features(ranges: RangeHash, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the words at these byte ranges, and the number of each feature's word."""
    sizes = ends - starts
    number = np.arange(len(starts))
    found, of = [_bucket(ranges.of(starts, ends), 0)], [number]
    for n in (1, 2, 3, 4):
        full = sizes >= n
        found += [_bucket(ranges.of(starts[full], starts[full] + n), n), _bucket(ranges.of(ends[full] - n, ends[full]), 4 + n)]
        of += [number[full]] * 2
        count = np.maximum(sizes - n + 1, 0)
        at = np.repeat(starts - segments(count)[:-1], count) + np.arange(count.sum())
        found.append(_bucket(ranges.of(at, at + n), 8 + n))
        of.append(np.repeat(number, count))
    return np.concatenate(found), np.concatenate(of)


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null("") if column.null_count else column)


class CrfTagger:
    """Labels, weights, transitions and lexicons; tags the words of texts."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.weights = np.zeros((BUCKETS, k), np.float32)
        self.lexical = np.zeros((k, k), np.float32)
        self.moves = np.zeros((k, k))
        self.lexicon = np.zeros(0, np.uint64)
        self.member = np.zeros((0, k), np.float32)

    def _in_lexicon(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros((len(hashes), len(self.labels)), np.float32)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return self.member[at] * (self.lexicon[at] == hashes)[:, None]

    def emissions(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of distinct words by label, and each word's place among them."""
        coded = pa.array(hashes.view(np.int64)).dictionary_encode()
        code = coded.indices.to_numpy()
        n = len(coded.dictionary)
        pick = np.zeros(n, np.int64)
        pick[code[::-1]] = np.arange(len(code))[::-1]
        out = np.zeros((n, len(self.labels)), np.float32)
        ranges = RangeHash(BYTE_TABLE[words.data])
        for lo in range(0, n, 20_000):
            part = pick[lo : lo + 20_000]
            bucket, of = word_features(ranges, words.starts[part], words.ends[part])
            rows = self.weights[bucket]
            for label in range(len(self.labels)):
                out[lo : lo + len(part), label] = np.bincount(of, rows[:, label], len(part))
        out += self._in_lexicon(hashes[pick]) @ self.lexical
        return out, code

    # training

    def fit(self, texts: list[tuple[str, str]], seed: int = 3) -> "CrfTagger":
        """texts: (text, label) pairs of the bounded sample."""
        number = {label: i for i, label in enumerate(self.labels)}
        words = Words(_lower(pa.array([t for t, _ in texts], pa.string())))
        hashes = words.hashes()
        if not len(hashes):
            return self
        label = np.array([number[x] for _, x in texts])[words.doc_of_word()]
        own_half = words.doc_of_word() % 2 == 0
        known, code = np.unique(hashes[own_half], return_inverse=True)
        k = len(self.labels)
        met = np.stack([np.bincount(code, label[own_half] == i, len(known)) for i in range(k)], axis=1) >= 2
        self.lexicon, self.member = known[met.any(axis=1)], met[met.any(axis=1)].astype(np.float32)
        rng = np.random.RandomState(seed)
        usable = [np.flatnonzero((label == i) & ~own_half) for i in range(k)]
        usable = [(u if len(u) else np.flatnonzero(label == i)) for i, u in enumerate(usable)]
        squares, lex_squares, move_squares = np.full((BUCKETS, k), 1e-4, np.float32), np.full((k, k), 1e-4), np.full((k, k), 1e-4)
        langs = [i for i in range(k) if len(usable[i])]
        # features of all distinct words, word by word
        key, first, place_of = np.unique(hashes, return_index=True, return_inverse=True)
        bucket_of, word_of = word_features(RangeHash(BYTE_TABLE[words.data]), words.starts[first], words.ends[first])
        bucket_of = bucket_of[np.argsort(word_of, kind="stable")]
        feature_at = segments(np.bincount(word_of, minlength=len(key)))
        for _ in range(STEPS):
            place = np.zeros((BATCH, LENGTH), np.int64)
            for row in range(BATCH):
                t = 0
                while t < LENGTH:
                    own = usable[langs[rng.randint(len(langs))]]
                    size = min(LENGTH - t, int(rng.randint(6, 40)), len(own))
                    at = rng.randint(len(own) - size + 1)
                    place[row, t : t + size] = own[at : at + size]
                    t += size
            pick, code = np.unique(place_of[place.ravel()], return_inverse=True)
            size = feature_at[pick + 1] - feature_at[pick]
            of = np.repeat(np.arange(len(pick)), size)
            bucket = bucket_of[np.arange(len(of)) + np.repeat(feature_at[pick] - segments(size)[:-1], size)]
            rows = self.weights[bucket]
            lexical = self._in_lexicon(key[pick])
            score = np.stack([np.bincount(of, rows[:, i], len(pick)) for i in range(k)], axis=1) + lexical @ self.lexical
            truth = np.eye(k)[label[place]]
            marginal, pairs = self._expected(score[code].reshape(BATCH, LENGTH, k))
            error = (truth - marginal).reshape(-1, k) / BATCH
            by_word = np.stack([np.bincount(code, error[:, i], len(pick)) for i in range(k)], axis=1)
            touched, back = np.unique(bucket, return_inverse=True)
            slope = np.stack([np.bincount(back, by_word[of, i], len(touched)) for i in range(k)], axis=1).astype(np.float32)
            squares[touched] += slope**2
            self.weights[touched] += RATE * slope / np.sqrt(squares[touched]) - DECAY * self.weights[touched]
            slope = lexical.T @ by_word
            lex_squares += slope**2
            self.lexical += (RATE * slope / np.sqrt(lex_squares)).astype(np.float32)
            seen = np.einsum("bti,btj->ij", truth[:, :-1], truth[:, 1:])
            slope = (seen - pairs) / BATCH
            move_squares += slope**2
            self.moves += RATE * slope / np.sqrt(move_squares)
        return self

    def _expected(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals of sequences of equal length, and expected transition counts."""
        b, n, k = score.shape
        e = np.exp(score - score.max(axis=2, keepdims=True))
        a = np.exp(self.moves)
        alpha, beta = np.empty((n, b, k)), np.ones((n, b, k))
        alpha[0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, n):
            x = (alpha[t - 1] @ a) * e[:, t]
            alpha[t] = x / x.sum(axis=1, keepdims=True)
        for t in range(n - 2, -1, -1):
            x = (e[:, t + 1] * beta[t + 1]) @ a.T
            beta[t] = x / x.sum(axis=1, keepdims=True)
        marginal = alpha * beta
        marginal /= marginal.sum(axis=2, keepdims=True)
        right = e[:, 1:].swapaxes(0, 1) * beta[1:]
        # a pair's weight is before * a * after; summed over all places without a matrix for each
        before, after = alpha[:-1].reshape(-1, k), right.reshape(-1, k)
        total = ((before @ a) * after).sum(axis=1, keepdims=True)
        return marginal.swapaxes(0, 1), a * (before.T @ (after / total))

    # tagging

    def marginals(self, column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
        """The words of lower-cased texts, each one's label distribution, and whether it has a letter."""
        words = Words(_lower(column))
        hashes = words.hashes()
        k = len(self.labels)
        if not len(hashes):
            return words, np.zeros((0, k)), np.zeros(0, bool)
        score, code = self.emissions(words, hashes)
        letter = np.zeros(256, bool)
        letter[97:123] = letter[128:] = True
        total = np.concatenate([[0], np.cumsum(letter[words.data])])
        lettered = total[words.ends] > total[words.starts]
        e = np.exp(score - score.max(axis=1, keepdims=True)).astype(float)[code]
        e[~lettered] = 1
        return words, forward_backward(e, words.doc_words, np.exp(self.moves)), lettered


def forward_backward(e: np.ndarray, at: np.ndarray, a: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Label marginals of each word; e: potentials by word and label, at: offsets of the sequences, a: transition potentials.

    Segments have as many words as there are labels, ``segment`` at least, so
    transfer matrices take no more room than the potentials.
    """
    k = e.shape[1]
    segment = max(segment, k)
    counts = np.diff(at)
    parts = -(-counts // segment)
    n = int(parts.sum())
    first_part = segments(parts)
    doc = np.repeat(np.arange(len(counts)), parts)
    number = np.arange(n) - first_part[doc]
    begin = at[doc] + number * segment
    size = np.minimum(segment, at[doc + 1] - begin)
    place = np.minimum(begin[:, None] + np.arange(segment), len(e) - 1)
    inside = np.arange(segment) < size[:, None]
    steps = [(e[place[:, t]], inside[:, t, None]) for t in range(segment)]
    # transfer matrix of each segment: from the label before it to its last label
    transfer = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for v, keep in steps:
        new = (transfer.reshape(-1, k) @ a).reshape(n, k, k) * v[:, None, :]
        new /= new.sum(axis=(1, 2), keepdims=True)
        transfer = np.where(keep[:, :, None], new, transfer)
    # what enters each segment from the left and from the right
    left, right = np.full((n, k), 1 / k), np.full((n, k), 1 / k)
    order = np.argsort(-parts, kind="stable")
    alive = np.searchsorted(-parts[order], -np.arange(1, (parts.max() if n else 0) + 1), side="right")
    for j in range(1, len(alive)):
        rows = first_part[order[: alive[j]]] + j
        before = left[rows - 1]
        x = np.einsum("nk,nkl->nl", before, transfer[rows - 1]) if j > 1 else _start(transfer, rows - 1, a)
        left[rows] = x / x.sum(axis=1, keepdims=True)
    for j in range(len(alive) - 1, 0, -1):
        rows = first_part[order[: alive[j]]] + j
        x = np.einsum("nkl,nl->nk", transfer[rows], right[rows])
        right[rows - 1] = x / x.sum(axis=1, keepdims=True)
    # inside the segments
    alpha = np.empty((segment, n, k))
    x = left
    opening = (number == 0)[:, None]
    for t, (v, keep) in enumerate(steps):
        new = np.where(opening, v, (x @ a) * v) if t == 0 else (x @ a) * v
        x = np.where(keep, new / new.sum(axis=1, keepdims=True), x)
        alpha[t] = x
    out = np.empty_like(e)
    y = right
    for t in range(segment - 1, -1, -1):
        v, keep = steps[t]
        both = alpha[t] * y
        rows = keep[:, 0]
        out[place[rows, t]] = both[rows] / both[rows].sum(axis=1, keepdims=True)
        new = (v * y) @ a.T
        y = np.where(keep, new / new.sum(axis=1, keepdims=True), y)
    return out


def _start(transfer: np.ndarray, rows: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Label weights after a sequence's first segment: no transition leads into its first word."""
    return np.einsum("k,nkl->nl", np.linalg.solve(a.T, np.ones(len(a))), transfer[rows])


def train(docs: DataFrame, per_lang: int = PER_LANG) -> CrfTagger | None:
    """Fits on the bounded sample; docs: doc_id, text, lang of the documents to learn from."""
    rows = base_columns(docs, "doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    labels = sorted(r.lang for r in counts.collect())  # MOST_LANGS rows at most
    if not labels:
        return None
    sample = bounded_sample(rows.where(F.col("lang").isin(labels)), "lang", per_lang, LANG_BYTES)
    texts = sorted((r.text, r.g) for r in sample.collect())  # bounded in documents and bytes
    return CrfTagger(labels).fit(sorted(texts, key=lambda x: x[1])) if texts else None


def predict(docs: DataFrame, tagger: CrfTagger | None) -> DataFrame:
    """doc_id, lang_pred, score, n_words, n_switches (changes of the best label between neighbouring words)."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("n_switches", pa.int64())])
    model = docs.sparkSession.sparkContext.broadcast(tagger)  # BUCKETS rows, and the sample's lexicon

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            # a slice's words by labels stay as many as with FEW_LANGS languages
            for part in slices(batch, "text", (2 << 20) * FEW_LANGS // max(FEW_LANGS, len(own.labels) if own else 0)):
                n = part.num_rows
                label, score, switches, counts = ["und"] * n, np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
                if own is not None:
                    words, p, lettered = own.marginals(part.column("text"))
                    counts = words.counts
                    k = len(own.labels)
                    doc = words.doc_of_word()
                    mass = np.stack([np.bincount(doc, p[:, i] * lettered, n) for i in range(k)], axis=1)
                    weight = np.bincount(doc, lettered, n)
                    best = p.argmax(axis=1)
                    switches = np.bincount(doc[1:], (best[1:] != best[:-1]) & (doc[1:] == doc[:-1]), n).astype(np.int64) if len(doc) else switches
                    ascii_letter = np.zeros(256, bool)
                    ascii_letter[97:123] = True
                    total = np.concatenate([[0], np.cumsum(ascii_letter[words.data])])
                    plain = total[words.doc_bytes[1:]] > total[words.doc_bytes[:-1]]
                    for i in np.flatnonzero(weight):
                        if plain[i] or any(c.isalpha() for c in part.column("text")[i].as_py()):
                            j = int(mass[i].argmax())
                            label[i], score[i] = own.labels[j], min(1.0, mass[i, j] / weight[i])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(label), pa.array(score), pa.array(counts), pa.array(switches)], schema=schema)

    return base_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long, n_switches long")


def identify(docs: DataFrame, per_lang: int = PER_LANG, modulus: int = 4, held: int = 2) -> DataFrame:
    """predict() for all documents with held_out, learning from those of which crc32(doc_id) mod ``modulus`` is not ``held``."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))
    tagger = train(docs.where(rest != held), per_lang)
    return predict(docs, tagger).select("doc_id", F.coalesce(rest == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
