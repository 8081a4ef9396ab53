"""N-gram Jaccard join by chosen paths.

A document is the set of its runs of ``SHINGLE`` words (fewer words: all of
them as one). Documents of equal sets are one node, so copies are joined
before any search. Nodes are embedded into ``COORDINATES`` min-hash tokens.
Each run walks a tree: at a node of the tree every coordinate is drawn with
probability 1 / (SIMILARITY * COORDINATES), sets that agree on a drawn token
go down together, buckets of one set end, and buckets of up to ``BRUTE`` are
compared by brute force. The number of runs gives a pair at the threshold the
chance ``RECALL`` to share a leaf within ``DEPTH`` steps. A bucket that is
larger after these is split on, however deep that goes, unless its sets agree
in the share ``DENSE`` of their tokens on average: a step leaves 1 /
SIMILARITY times that share of a bucket's comparisons and asks for more runs,
so it no longer pays, and the bucket is compared by brute force as well, in
blocks. Sets whose buckets went deeper take as many more runs as their depth
asks for.

Leaves of equal members are searched once. Min-hash tokens first drop sets
without a partner in a leaf, then exact intersections of the sets decide. A
pair that shares several leaves counts in the least of them, so no table of
pairs is made: a task sends link counts by set and a spanning forest of its
links, from which connected components follow. A leaf of m sets is cut into
blocks for the memory of a task and, up to sqrt(2 * partitions) of them, for
parallel work; a set's row travels once for each block. So a dense bucket's
rows grow with its square up to ``TILE`` sets times that root, then in
proportion up to ``BLOCK_SETS`` times it; its comparisons, which the number of
links needs, grow with its square.

Defined results: class_id is the least doc_id of a component, n_links the
number of other documents of similarity SIMILARITY or more, copies included;
null or blank texts link to nothing; repeated rows are copies; texts are
whole; an empty table gives no rows; extra columns are ignored by
link_documents() and kept by one_of_each().
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import MOST_KEYS, free_name, materialize, packed, partitions, stream_groups, without
from .textkit import Words, gram_hashes, gram_places, mix, segments, slices

SHINGLE, SIMILARITY, COORDINATES = 5, 0.8, 64
RECALL, DEPTH, BRUTE = 0.995, 3, 512
#: Sets and their shingles in a block at most, and rows compared at a time.
BLOCK_SETS, BLOCK_SHINGLES, TILE = 4096, 2_000_000, 512
#: Mean agreement of a dense bucket, and the coordinates that tell it.
DENSE, PROBED = 0.5, 16
#: A pair at the threshold agrees in fewer tokens than this with a chance of about 1 in 100,000.
TOKEN_SLACK = 4.3

_rng = np.random.RandomState(41)
_FACTORS = _rng.randint(0, 1 << 62, COORDINATES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.randint(0, 1 << 62, COORDINATES).astype(np.uint64)
#: A coordinate's number on a path, and what its draw has to stay below.
_STEPS, _FEW = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)), np.uint64(int((1 << 64) / (SIMILARITY * COORDINATES)))


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold shares a path of ``depth`` steps with this chance: each step goes on with a Poisson number of mean 1."""
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(lost - 1)
    return math.ceil(math.log(1 - recall) / math.log(lost))


def shingles(column: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text."""
    words = Words(column, lower=False)
    h = words.hashes()
    grams = gram_hashes(h, n)
    place, counts = gram_places(words.doc_words, n)
    at = segments(counts)
    out = []
    for d in range(len(counts)):
        if counts[d]:
            out.append(np.unique(grams[place[at[d] : at[d + 1]]]))
        else:
            lo, hi = words.doc_words[d], words.doc_words[d + 1]
            out.append(gram_hashes(h[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """A 64-bit key of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64) ^ np.uint64(len(s))]))[0].view(np.int64))


def tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash tokens of non-empty sets, a row of COORDINATES 32-bit numbers for each."""
    flat = np.concatenate(sets)
    at = segments(np.array([len(s) for s in sets]))[:-1]
    out = np.empty((len(sets), COORDINATES), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(COORDINATES):
            out[:, k] = np.minimum.reduceat(((flat * _FACTORS[k] + _TERMS[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = shingles(part.column("text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            node, sig = np.zeros(len(sets), np.int64), [None] * len(sets)
            size = np.array([len(s) for s in sets], np.int64)
            if full:
                rows = tokens([sets[i] for i in full])
                for i, row in zip(full, rows, strict=True):
                    node[i], sig[i] = set_key(sets[i]), row.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("doc_key"), pa.array(node), pa.array(size), pa.array(sig, pa.binary())], names=["doc_id", "doc_key", "node", "size", "sig"])


def _tokens_of(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _step(row: np.ndarray, path: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``sig`` and their paths (or one path for all) at the next level: a place for each drawn coordinate."""
    drawn = mix(path[:, None] ^ _STEPS) < _FEW
    at, k = np.nonzero(np.broadcast_to(drawn, (len(row), COORDINATES)))
    row, path = row[at], np.broadcast_to(path, len(row))[at]
    return row, mix(path ^ (_STEPS[k] + sig[row, k]))


def _places(batches: Iterable[pa.RecordBatch], roots: range, through: list[np.ndarray] | None) -> Iterator[tuple[np.ndarray, ...]]:
    """node, size and tokens of sets, with the numbers and paths of those in a bucket.

    Each run of ``roots`` is walked again, on level d into the buckets
    ``through[d - 1]`` only (ascending); none: rows have their path.
    """
    for batch in batches:
        for lo in range(0, batch.num_rows, 8192):
            part = batch.slice(lo, 8192)
            node, size, sig = part.column("node").to_numpy(), part.column("size").to_numpy(), _tokens_of(part)
            every = np.arange(len(node))
            if through is None:
                yield node, size, sig, every, part.column("path").to_numpy().view(np.uint64)
                continue
            for r in roots:
                row, path = every, mix(np.array([r + 1], np.uint64))
                for buckets in through:
                    row, path = _step(row, path, sig)
                    inside = buckets[np.minimum(np.searchsorted(buckets, path), len(buckets) - 1)] == path
                    row, path = row[inside], path[inside]
                    if not len(row):
                        break
                else:
                    yield node, size, sig, row, path


def _descend(*where):
    """Sets in buckets, as of _places(), to the next level: a row for each drawn coordinate."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, size, sig, row, path in _places(batches, *where):
            row, path = _step(row, path, sig)
            yield pa.RecordBatch.from_arrays([pa.array(node[row]), pa.array(size[row]), pa.array(path.view(np.int64))], names=["node", "size", "path"])

    return run


def _token_counts(*where):
    """path, token, n: how often each of the first PROBED tokens is met in a part of a bucket, as of _places()."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sig, row, path in _places(batches, *where):
            token = (sig[row, :PROBED].astype(np.int64) * PROBED + np.arange(PROBED)).ravel()
            both, n = np.unique(np.stack([np.repeat(path.view(np.int64), PROBED), token]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(n)], names=["path", "token", "n"])

    return run


def _members(*where):
    """node of each set in a bucket, as of _places()."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, _, _, row, _ in _places(batches, *where):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(node[row]))], names=["node"])

    return run


def grow_trees(nodes: DataFrame, roots: range, brute: int, planned: int) -> tuple[DataFrame, DataFrame, DataFrame | None, int]:
    """Leaves (path, members, total, print), the rows (path, node) of all levels, those of leaves among them, the nodes still in large buckets after ``planned`` steps, and the depth reached.

    A large bucket's members are not looked up by its path: their tokens tell
    the way, so a walk from the roots through the buckets that are split finds
    them wherever the nodes lie. More buckets than MOST_KEYS / 8 on a level are
    joined instead, with the same rows.
    """
    nodes = nodes.select("node", "size", "sig")

    def reach(paths: DataFrame, n: int) -> tuple[DataFrame, list[np.ndarray] | None]:
        if through is None or n > MOST_KEYS // 8:
            return level.join(paths.select("path"), "path").join(nodes.select("node", "sig"), "node"), None
        return nodes, [*through, np.sort(np.array([r.path for r in paths.select("path").collect()], np.int64).view(np.uint64))]

    leaves = rows = deep = None
    through, depth = [], 1
    level = nodes.mapInArrow(_descend(roots, through), "node long, size long, path long")
    while True:
        level = materialize(level, "level")
        sizes = level.groupBy("path").agg(F.count("*").alias("members"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("node")).alias("print")).where("members > 1")
        sizes = materialize(packed(sizes, level.count()), "buckets")
        large = sizes.where(F.col("members") > brute).select("path", "members")
        n_split, n_inside = large.agg(F.count("*"), F.sum("members")).first()
        ended, split = sizes, large
        if n_split and depth < planned:
            ended = sizes.where(F.col("members") <= brute)
        elif n_split:
            inside, via = reach(large, n_split)
            met = inside.mapInArrow(_token_counts(roots, via), "path long, token long, n long").groupBy("path", "token").agg(F.sum("n").alias("n"))
            square = met.groupBy("path").agg(F.sum(F.col("n") * F.col("n")).alias("agree"))
            large = F.broadcast(large) if n_split <= MOST_KEYS // 8 else large
            sparse = square.join(large, "path").where(F.col("agree") < DENSE * PROBED * F.col("members") * F.col("members")).select("path")
            split = materialize(packed(sparse, n_split), "sparse")
            ended = sizes.join(split, "path", "left_anti")
            n_split = split.count()
        own = level.select("path", "node")
        leaves = ended if leaves is None else leaves.unionByName(ended)
        rows = own if rows is None else rows.unionByName(own)
        if not n_split:
            return leaves, rows, deep, depth
        inside, through = reach(split, n_split)
        if depth == planned:
            deep = materialize(packed(inside.mapInArrow(_members(roots, through), "node long").distinct(), n_inside), "deep")
        level = inside.mapInArrow(_descend(roots, through), "node long, size long, path long")
        depth += 1


UNIT = ("path", "i", "j")


def _block_units(leaves: DataFrame, parallel: int) -> DataFrame:
    """path, i, j, node: leaves are cut into blocks, each pair of blocks a unit of its own."""
    ceil = lambda x, n: F.ceil(F.col(x) / n)
    wished = F.least(ceil("members", TILE), F.lit(math.ceil(math.sqrt(2 * parallel))))
    blocks = F.greatest(wished, ceil("members", BLOCK_SETS), ceil("total", BLOCK_SHINGLES)).cast("int")
    rows = leaves.withColumn("blocks", F.least(blocks, F.col("members").cast("int")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", "path"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("path", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")


def _tiles(own: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers to compare, TILE at a time: all pairs of the unit if i = j, otherwise those of two blocks."""
    cut = lambda rows: [rows[k : k + TILE] for k in range(0, len(rows), TILE)]
    a, b = cut(np.flatnonzero(own == i)), cut(np.flatnonzero(own == j))
    for x in range(len(a)):
        for y in range(x if i == j else 0, len(b)):
            yield a[x], b[y]


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units with tokens, sorted: the rows that agree with another of the unit in enough tokens."""
    least = COORDINATES * SIMILARITY - TOKEN_SLACK * math.sqrt(COORDINATES * SIMILARITY * (1 - SIMILARITY))
    for unit in stream_groups(batches, *UNIT):
        sig = _tokens_of(unit)
        i, j = unit.column("i")[0].as_py(), unit.column("j")[0].as_py()
        keep = np.zeros(len(sig), bool)
        for a, b in _tiles(unit.column("own").to_numpy(), i, j):
            if keep[a].all() and keep[b].all():
                continue
            same = np.zeros((len(a), len(b)), np.uint8)
            for k in range(COORDINATES):
                same += sig[a, k][:, None] == sig[b, k]
            near = (same >= least) & (a[:, None] != b)
            keep[a] |= near.any(axis=1)
            keep[b] |= near.any(axis=0)
        if keep.any():
            yield from unit.select(["path", "i", "j", "own", "node"]).filter(pa.array(keep)).combine_chunks().to_batches()


def intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the sets of ``a`` with those of ``b``, by products of incidence matrices ``width`` elements wide."""
    flat = np.concatenate(a + b)
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in a + b])
    _, col = np.unique(flat, return_inverse=True)
    first = row < len(a)
    in_a, in_b = (np.bincount(col[x], minlength=len(col) and col.max() + 1) > 0 for x in (first, ~first))
    shared = in_a & in_b
    number = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(a), len(b)), np.float32)
    total = int(shared.sum())
    for lo in range(0, total, width):
        p, q = np.searchsorted(col, [lo, lo + width])
        x = np.zeros((len(a) + len(b), min(width, total - lo)), np.float32)
        x[row[p:q], col[p:q] - lo] = 1
        out += x[: len(a)] @ x[len(a) :].T
    return out


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index that each of n rows is linked to, over any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _link(similarity: float):
    """Units with sets and leaves, sorted: link counts by node, and each node's root in the unit's forest."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("linked", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in stream_groups(batches, *UNIT):
            m = unit.num_rows
            if m < 2:
                continue
            path, i, j = (unit.column(k)[0].as_py() for k in UNIT)
            own, node, copies = (unit.column(k).to_numpy() for k in ("own", "node", "copies"))
            sets = [np.frombuffer(s, np.uint64) for s in unit.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets], float)
            # a pair counts here unless the two share a lesser leaf
            lesser = np.array([(r, x) for r, leaves in enumerate(unit.column("paths").to_pylist()) for x in leaves if x < path], np.int64).reshape(-1, 2)
            _, column = np.unique(lesser[:, 1], return_inverse=True)
            linked, root, touched = np.zeros(m, np.int64), np.arange(m), np.zeros(m, bool)
            for a, b in _tiles(own, i, j):
                both = intersections([sets[r] for r in a], [sets[r] for r in b])
                # in whole numbers: both >= similarity * union
                near = both * (1 + similarity) >= similarity * (size[a][:, None] + size[b]) - 1e-6
                if i == j:
                    near &= a[:, None] < b
                x, y = np.nonzero(near)
                if not len(x):
                    continue
                has = np.zeros((m, column.max(initial=0) + 1), np.float32)
                has[lesser[:, 0], column] = 1
                first = (has[a] @ has[b].T)[x, y] == 0
                x, y = a[x], b[y]
                np.add.at(linked, x[first], copies[y[first]])
                np.add.at(linked, y[first], copies[x[first]])
                root = _forest(np.concatenate([x, np.arange(m)]), np.concatenate([y, root]), m)
                touched[x] = touched[y] = True
            if touched.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[touched]), pa.array(node[root[touched]]), pa.array(linked[touched])], schema=schema)

    return run


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = shingles(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component of edges (a, b); labels spread to neighbours and jump."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    n = 2 * edges.count()
    both = materialize(packed(both, n), "edges")
    label = materialize(packed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), n), "labels")
    while True:
        spread = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = label.join(spread, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = new.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        new = materialize(packed(new, n), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        label = new.select("node", "label")


def link_documents(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, brute: int = BRUTE, planned: int = DEPTH) -> DataFrame:
    """doc_id, doc_key, class_id, n_links, n_copies, label of each document (doc_key: hash of doc_id and text).

    class_id is the least doc_id of the class; classes of rows with one doc_id
    can share it, so label tells classes apart (null without words).
    """
    n = partitions(docs.sparkSession)
    keyed = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text")).withColumn("doc_key", F.xxhash64("doc_id", "text"))
    known = materialize(keyed.mapInArrow(_signatures, "doc_id long, doc_key long, node long, size long, sig binary"), "signatures")
    filled = known.where("sig IS NOT NULL")
    nodes = filled.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min("doc_key").alias("doc_key"), F.min("size").alias("size"), F.min("sig").alias("sig"))
    nodes = materialize(packed(nodes, known.count()), "nodes")

    # the trees, run after run until the recall is reached at the depth that was needed
    runs = runs_needed(recall, planned)
    leaves, rows, deep, depth = grow_trees(nodes, range(runs), brute, planned)
    while deep is not None and runs < (more := runs_needed(recall, depth)):
        again = materialize(packed(nodes.join(deep, "node", "left_semi"), deep.count()), "again")
        other_leaves, other_rows, _, other_depth = grow_trees(again, range(runs, more), brute, depth)
        leaves, rows = leaves.unionByName(other_leaves), rows.unionByName(other_rows)
        runs, depth = more, max(depth, other_depth)
    single = leaves.groupBy("members", "print").agg(F.min("path").alias("path"), F.min("total").alias("total"))
    # a path is one bucket of one level, so all levels' rows can meet the chosen leaves at once
    leaf_rows = materialize(packed(rows.join(single, "path"), rows.count()).select("path", "node", "members", "total"), "leaves")

    # what the tokens leave
    units = _block_units(leaf_rows, n).join(nodes.select("node", "sig"), "node")
    order = [*UNIT, "node"]
    alike = units.repartition(n, *UNIT).sortWithinPartitions(*order).mapInArrow(_alike, "path long, i int, j int, own int, node long")
    alike = materialize(alike, "alike")

    # exact links
    paths = alike.groupBy("node").agg(F.collect_set("path").alias("paths"))
    wanted = paths.join(nodes.select("node", "doc_key", "copies"), "node")
    texts = keyed.select("doc_key", "text").join(wanted.select("doc_key", "node").hint("shuffle_hash"), "doc_key").select("node", "text")
    sets = texts.mapInArrow(_sets, "node long, shingles binary").dropDuplicates(["node"])
    rows = alike.join(wanted.select("node", "paths", "copies"), "node").join(sets, "node").select(*UNIT, "own", "node", "copies", "paths", "shingles")
    links = rows.repartition(n, *UNIT).sortWithinPartitions(*order).mapInArrow(_link(similarity), "node long, root long, linked long")
    links = materialize(links, "links")
    labels = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    result = nodes.select("node", "copies", "least").join(linked, "node", "left").join(labels, "node", "left")
    result = result.withColumn("label", F.coalesce("label", "node"))
    classes = result.groupBy("label").agg(F.min("least").alias("class_id"))
    result = result.join(classes, "label").select("node", "label", "class_id", F.col("copies").alias("n_copies"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = filled.select("doc_id", "doc_key", "node").join(result, "node").select("doc_id", "doc_key", "class_id", "n_links", "n_copies", "label")
    blank = known.where("sig IS NULL").select("doc_id", "doc_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(None).cast("long").alias("label"))
    return out.unionByName(blank)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document of least doc_id of each class, with all its columns."""
    names = docs.columns
    links = materialize(link_documents(docs), "classes")
    # documents without words have no label and all stay
    kept = links.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc_id", "doc_key")).alias("first"))
    kept = kept.select("first.doc_key")
    blank = links.where("n_copies = 1 AND n_links = 0").select("doc_key")
    key = free_name("__doc_key", names)
    keys = links.groupBy(F.col("doc_key").alias(key)).agg(F.count("*").alias("rows"))
    gone = materialize(keys.join(kept.unionByName(blank).withColumnRenamed("doc_key", key), key, "left_anti").select(key), "gone")
    repeated = materialize(keys.where("rows > 1").select(key), "repeated")
    own = without(docs.withColumn(key, F.xxhash64("doc_id", "text")), gone, key)
    once = without(own, repeated, key).unionByName(without(own, repeated, key, negate=True).dropDuplicates([key]))
    return once.select(*[F.col(f"`{c}`") for c in names])
