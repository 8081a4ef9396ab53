"""Each operator against a plain loop over a small corpus of hard cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from strandflow.llm import chat, ctw, decontamination, langid, lines, media, near_duplicates, quality, shared, substrings

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPLIT.findall(text or "")


# 1


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("brute", [256, 2])
def test_links(docs, corpus, brute):
    sets = [shingle_set(t) for _, t, *_ in corpus]
    near = [[j for j, b in enumerate(sets) if i != j and a and len(a & b) >= 0.8 * len(a | b) - 1e-9] for i, a in enumerate(sets)]
    label = list(range(len(sets)))
    for _ in sets:
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(sets))]
    ids = defaultdict(list)
    for i, r in enumerate(corpus):
        ids[label[i]].append(r[0])
    least = {k: min([x for x in v if x is not None], default=None) for k, v in ids.items()}
    want = Counter((r[0], least[label[i]], len(near[i])) for i, r in enumerate(corpus))
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in near_duplicates.link_documents(docs, brute=brute).collect())
    assert got == want


def test_one_of_each(docs, corpus, empty):
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[0] == 1 and not ids[100] and not ids[101] and not ids[103] and ids[7] == 1 and ids[106] == 1 and ids[107] == 1
    assert near_duplicates.one_of_each(empty).count() == 0


def test_classes_that_share_a_doc_id(spark):
    """Two classes whose least doc_id is the same row id, and a third row of it."""
    rng = np.random.RandomState(9)
    a, b, c = ([f"w{x}" for x in rng.randint(0, 10**6, 200)] for _ in range(3))
    near = lambda w: " ".join(w[:100] + ["changed"] + w[101:])
    rows = [(5, " ".join(a)), (9, near(a)), (5, " ".join(b)), (10, near(b)), (11, " ".join(c)), (None, " ".join(c) + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = near_duplicates.link_documents(docs).collect()
    assert len({r.label for r in links}) == 3 and len({(r.class_id, r.label) for r in links}) == 3
    kept = near_duplicates.one_of_each(docs).collect()
    assert len(kept) == 3 and {r.text for r in kept} >= {" ".join(a), " ".join(b)}


def test_runs_reach_the_recall():
    assert near_duplicates.runs_needed(0.995, 1) == 6 and near_duplicates.runs_needed(0.995, 3) == 12


def test_recall_at_the_threshold(spark):
    """Pairs of Jaccard similarity 0.80 to 0.82, with the constants as shipped."""
    rng = np.random.RandomState(3)
    rows, pairs = [], []
    while len(pairs) < 300:
        base = [f"w{x}" for x in rng.randint(0, 5000, rng.randint(150, 260))]
        other = list(base)
        for at in rng.choice(len(base), rng.randint(2, 6), replace=False):
            other[at] = f"v{rng.randint(5000)}"
        a, b = shingle_set(" ".join(base)), shingle_set(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.82:
            pairs.append((2 * len(pairs), 2 * len(pairs) + 1))
            rows += [(pairs[-1][0], " ".join(base)), (pairs[-1][1], " ".join(other))]
    got = {r.doc_id: r.class_id for r in near_duplicates.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[b] == a for a, b in pairs) >= 0.97 * len(pairs)


def test_deep_and_dense_buckets(spark, monkeypatch):
    """A large group of near copies, and many sets that share half of their shingles: none of them gets lost."""
    monkeypatch.setattr(near_duplicates, "BLOCK_SETS", 16)
    monkeypatch.setattr(near_duplicates, "TILE", 8)
    rng = np.random.RandomState(4)
    base = [f"w{x}" for x in rng.randint(0, 5000, 120)]
    texts = []
    for _ in range(60):
        own = list(base)
        own[rng.randint(120)] = f"v{rng.randint(10**6)}"
        texts.append(" ".join(own))
    half = base[:70]
    texts += [" ".join([*half, *(f"u{x}" for x in rng.randint(0, 10**6, 60))]) for _ in range(60)]
    texts += texts[60:64]
    sets = [shingle_set(t) for t in texts]
    near = [sum(i != j and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in near_duplicates.link_documents(docs, brute=10).collect()}
    assert got == dict(enumerate(near))


def test_small_tables_are_few_files(spark, corpus, monkeypatch):
    """The number of tasks that write a table follows its rows, whatever the number of shuffle partitions."""
    files = Counter()

    def counted(df, label, compression=None):
        out = shared.materialize(df, label, compression)
        files[label] = max(files[label], len(out.inputFiles()))
        return out

    monkeypatch.setattr(near_duplicates, "materialize", counted)
    rows = [(r[0], r[1]) for r in corpus] + [(1000 + i, f"{corpus[i % 40][1]} more{i // 40}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = lambda: sorted(map(str, near_duplicates.link_documents(docs, brute=4).drop("doc_key").collect()))
    few = links()
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(kept, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        files.clear()
        assert links() == few
        cores = spark.sparkContext.defaultParallelism
        assert all(files[x] <= cores for x in ("nodes", "buckets", "level", "leaves", "edges", "labels")), files
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def rows_joined(spark, column, since):
    """Rows that joins on ``column`` have made in the executions from number ``since`` on, and the next number."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    total, after, found = 0, since, store.executionsList()
    for i in range(found.size()):
        number = found.apply(i).executionId()
        if number < since:
            continue
        after = max(after, number + 1)
        values, graph = store.executionMetrics(number), store.planGraph(number).allNodes()
        for k in range(graph.size()):
            node = graph.apply(k)
            if not re.match(rf"\w+Join \[{column}#", node.desc()):
                continue
            for m in range(node.metrics().size()):
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total, after


def near_copies(n):
    """Texts of one group: all of them share more than half of their tokens, so their buckets are dense."""
    rng = np.random.RandomState(6)
    base, texts = [f"w{x}" for x in rng.randint(0, 5000, 120)], []
    for _ in range(n):
        own = list(base)
        for at in rng.randint(0, 120, 3):
            own[at] = f"v{rng.randint(10**6)}"
        texts.append(" ".join(own))
    return list(enumerate(texts))


def test_large_groups_are_not_joined_by_path(spark, monkeypatch):
    """Joins on paths make the rows of the leaves and one for a bucket, not those of large buckets on every level."""
    tables = {}

    def kept(df, label, compression=None):
        tables.setdefault(label, []).append(out := shared.materialize(df, label, compression))
        return out

    monkeypatch.setattr(near_duplicates, "materialize", kept)
    docs = spark.createDataFrame(near_copies(150), "doc_id long, text string")
    _, since = rows_joined(spark, "path", 0)
    assert near_duplicates.link_documents(docs, brute=20).count() == 150
    made, _ = rows_joined(spark, "path", since)
    leaves, buckets = sum(t.count() for t in tables["leaves"]), sum(t.count() for t in tables["buckets"])
    assert 150 < leaves <= made <= leaves + buckets


def test_many_large_buckets_are_joined(spark, monkeypatch):
    """Beyond the buckets that a walk may take along, a join finds the same leaves; from any level on."""
    rows = near_copies(80)
    rows += [(1000 + i, " ".join([t.split()[0], *(f"u{i} u{j}" for j in range(40)), *t.split()[:60]])) for i, t in rows]
    nodes = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_key", F.col("doc_id"))
    nodes = nodes.mapInArrow(near_duplicates._signatures, "doc_id long, doc_key long, node long, size long, sig binary").cache()
    found = []
    for most in (2_000_000, 8 * 20, 0):
        monkeypatch.setattr(near_duplicates, "MOST_KEYS", most)
        leaves, rows, deep, depth = near_duplicates.grow_trees(nodes, range(4), 10, 2)
        rows = rows.join(leaves, "path").groupBy("path").agg(F.count("*").alias("n"), F.min("node"), F.max("node"))
        found.append((depth, sorted(map(str, leaves.collect())), sorted(map(str, rows.collect())), deep and sorted(r.node for r in deep.collect())))
    assert found[0] == found[1] == found[2] and found[0][0] > 2 and found[0][3]


# 2


def test_quality(spark, docs, empty):
    rng = np.random.RandomState(0)
    vocabulary = [f"{a}{b}" for a in ("an", "the", "or", "in", "st", "ly") for b in ("ed", "ing", "on", "er", "al", "ou")]
    odds = 1 / np.arange(1, len(vocabulary) + 1) ** 1.5
    odds /= odds.sum()
    good = [(i, " ".join(rng.choice(vocabulary, 80, p=odds)), "en") for i in range(400)]
    junk = [(1000 + i, " ".join(f"Q{rng.randint(10**6)}###" for _ in range(80)), "en") for i in range(20)]
    runs = [(2000 + i, " ".join(w for w in rng.choice(vocabulary, 6, replace=False) for _ in range(40)), "en") for i in range(20)]
    odd = [(3000, None, "en"), (3001, "", None), (3002, good[0][1], None), (None, good[1][1], "fr")]
    table = spark.createDataFrame(good + junk + runs + odd, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(1000, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {(r.doc_id) for r in quality.judge(table, labels, 100).where("keep").collect()}
    assert len(kept & set(range(400))) >= 396 and 3002 in kept and None in kept
    assert not kept & {1000 + i for i in range(20)} and not kept & {3000, 3001}
    assert len(kept & {2000 + i for i in range(20)}) <= 2
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(empty, labels).count() == 0


def plain_kneser_ney(texts):
    """log10 P of a document by interpolated modified Kneser-Ney trigrams, from the definition."""
    docs = [["<s>", *words(t), "</s>"] for t in texts]
    three = Counter(tuple(d[i : i + 3]) for d in docs for i in range(len(d) - 2))
    pairs = Counter(tuple(d[i : i + 2]) for d in docs for i in range(len(d) - 1))
    left = defaultdict(set)
    for a, b, c in three:
        left[b, c].add(a)
    two = {p: n if p[0] == "<s>" else len(left[p]) for p, n in pairs.items()}
    before = defaultdict(set)
    for a, b in two:
        before[b].add(a)
    one = {(w,): len(v) for w, v in before.items()}

    def discounts(counts):
        t = [sum(n == i for n in counts.values()) for i in (1, 2, 3, 4)]
        y = t[0] / max(t[0] + 2 * t[1], 1)
        d = [min(max(i - (i + 1) * y * t[i] / max(t[i - 1], 1), 0.1), i - 0.1) for i in (1, 2, 3)]
        return lambda n: d[min(n, 3) - 1]

    cut = {1: discounts(one), 2: discounts(two), 3: discounts(three)}
    mass = [sum(c(n) for n in counts.values()) / sum(counts.values()) for c, counts in ((cut[1], one),)][0]
    rest = mass / (len(one) + 1)
    p1 = lambda w: rest + (max(one[w,] - cut[1](one[w,]), 0) / sum(one.values()) if (w,) in one else 0)

    def higher(counts, d, ctx, w, lower):
        own = {k: n for k, n in counts.items() if k[:-1] == ctx}
        if not own:
            return lower
        total = sum(own.values())
        share = (own[(*ctx, w)] - d(own[(*ctx, w)])) / total if (*ctx, w) in own else 0
        return share + sum(d(n) for n in own.values()) / total * lower

    def log(t):
        d = ["<s>", *words(t), "</s>"]
        total = 0.0
        for i in range(1, len(d)):
            p = higher(two, cut[2], (d[i - 1],), d[i], p1(d[i]))
            total += math.log10(higher(three, cut[3], tuple(d[i - 2 : i]), d[i], p) if i > 1 else p)
        return total / (len(d) - 1)

    return log


def test_perplexity_equals_the_definition(spark):
    rng = np.random.RandomState(1)
    vocabulary = [f"v{i}" for i in range(12)]
    texts = [" ".join(rng.choice(vocabulary, rng.randint(3, 25))) for _ in range(24)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(90, "v1 unseen v2", "en"), (91, "unseen", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(24)], "doc_id long, quality int, toxic int")
    chosen = {r.doc_id for r in quality.training_ids(labels, 10).collect()}
    assert len(chosen) == 10
    log = plain_kneser_ney([texts[i] for i in sorted(chosen)])
    keys = {r.doc_key: (r.doc_id, r.text) for r in quality.keyed_texts(docs).collect()}
    for r in quality.perplexities(docs, labels, 10).collect():
        doc_id, text = keys[r.doc_key]
        assert r.log_ppl == pytest.approx(-log(text), abs=2e-3), (doc_id, text)


def test_quality_brings_no_table_to_the_driver(spark, docs, monkeypatch):
    """The words' values come as one row, and the documents are joined with their scores once, not once for each limit."""
    met = []
    frame = type(docs)
    for name in ("collect", "toPandas", "toArrow"):

        def counted(self, *a, f=getattr(frame, name), **b):
            out = f(self, *a, **b)
            met.append(len(out))
            return out

        monkeypatch.setattr(frame, name, counted)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    judged = quality.judge(docs.select("doc_id", "text", "lang"), labels)
    assert met and max(met) <= 4
    assert judged._jdf.queryExecution().analyzed().toString().count("xxhash64(doc_id") == 1


def test_kneser_ney_sums_to_one(spark):
    sample = spark.createDataFrame([("a b a c",), ("a b b",), ("c a b",)], "text string")
    model = quality.TrustedModel(sample)
    types = 4  # a, b, c and the end
    total = sum(10.0 ** model.lp[i] for i in range(len(model.keys)) if model.keys[i] != quality.BEGIN)
    assert len(model.keys) == types + 1
    assert total + 10.0**model.unknown == pytest.approx(1, abs=1e-5)
    values = {r.key: r.value for r in model.values.collect()}
    vocabulary = {w: h for w, h in zip("abc", (int(x) for x in quality.Words(pa.array(["a b c"])).hashes()), strict=True)}
    lp = dict(zip(model.keys.tolist(), model.lp.tolist(), strict=True))
    bow = dict(zip(model.keys.tolist(), model.bow.tolist(), strict=True))
    after_a = [*vocabulary.values(), int(quality.END)]
    mass = 10.0 ** (bow[vocabulary["a"]] + model.unknown)
    for w in after_a:
        key = int(quality.gram_hashes(np.array([vocabulary["a"], w], np.uint64), 2)[0].view(np.int64))
        base = lp[w] + bow[vocabulary["a"]]
        contexts = 0.0
        if key in values:  # a bigram's value holds its back-off weight as a context, too
            rows = {r.key: r.delta for r in spark.read.parquet(*_latest(spark, "kn-two-values")).collect()}
            contexts = rows[key]
        mass += 10.0 ** (base + contexts)
    assert mass == pytest.approx(1, abs=1e-4)


def _latest(spark, label):
    import glob
    import os

    from strandflow.llm.shared import shared_dir

    found = glob.glob(f"{shared_dir(spark).removeprefix('file://')}/strandflow/{label}-*")
    return ["file://" + max(found, key=os.path.getmtime)]


# 3


def kept_words(rows, size=35):
    seen = Counter(tuple(w[i : i + size]) for _, t, *_ in rows for w in [words(t)] for i in range(len(w) - size + 1))
    out = []
    for doc_id, t, *_ in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), left))
    return out


@pytest.mark.parametrize(("hot", "salts"), [(substrings.HOT, substrings.SALTS), (1, substrings.SALTS), (1, 1), (1, 3)])
def test_substrings(docs, corpus, empty, hot, salts, monkeypatch):
    monkeypatch.setattr(substrings, "SALTS", salts)
    got = Counter(tuple(r) for r in substrings.remove_repeats(docs, hot=hot).collect())
    assert got == Counter(kept_words(corpus))
    assert substrings.remove_repeats(empty).count() == 0


def test_many_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(7, text)] * 400 + [(8, text + " more"), (9, "alone " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in substrings.remove_repeats(docs).collect())
    assert got == Counter(kept_words(rows))


# 4


def test_media(docs, corpus, empty):
    rows = media.media_digests(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == len(corpus)
    for doc_id, text, *_ in corpus:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        image = media.to_png(payload)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest())
        assert want in {(r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in by[doc_id]}
        assert media.from_png(image) == payload
    assert len({(r.payload_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})
    assert media.media_digests(empty).count() == 0


def test_shards_are_tar_files_and_headers_suffice(docs):
    index, uri = media.store(docs)
    fs, root = pa.fs.FileSystem.from_uri(uri)
    for r in media.header_columns(index, uri).collect():
        data = fs.open_input_file(f"{root}/{r.shard}").read()
        member = next(m for m in media.open_tar(data) if m.offset_data == r.offset)
        assert member.name == f"{r.digest}.png" and member.size == r.length
        assert hashlib.sha256(data[r.offset : r.offset + r.length]).hexdigest() == r.digest
        assert (r.width, r.bit_depth, r.color_type) == (192, 8, 0)


def test_addresses_as_hadoop_writes_them():
    seen = [media.arrow_address(uri) for uri in ("s3a://bucket/a", "s3n://bucket/a", "file:/tmp/a", "file:///tmp/a", "hdfs://host/a")]
    assert seen == ["s3://bucket/a", "s3://bucket/a", "file:///tmp/a", "file:///tmp/a", "hdfs://host/a"]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from strandflow.llm import shared

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(session("yarn", None))
    assert shared.shared_dir(session("yarn", "hdfs://a/b/")) == "hdfs://a/b"


def test_release_removes_tables(spark):
    import os

    from strandflow.llm import shared

    since = shared.mark()
    a, b = (shared.materialize(spark.range(3), "t") for _ in range(2))
    shared.release(spark, since, keep=[b])
    assert not os.path.exists(a.written_at.removeprefix("file://")) and b.count() == 3 and shared.mark() == since + 1


def test_png_rejects_damage():
    image = bytearray(media.to_png(b"a" * 192))
    image[-20] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(image))


# 6


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_search_equals_the_table():
    rng = np.random.RandomState(2)
    for _ in range(500):
        p, t = rng.randint(0, 4, rng.randint(1, 10)).tolist(), rng.randint(0, 4, rng.randint(0, 20)).tolist()
        assert decontamination.search(p, t, 99)[0] == edit_distance(p, t)


def test_leaks(spark, docs, corpus, empty):
    item = words(corpus[8][1])[20:45]
    changed = item[:7] + ["new"] + item[8:15] + item[16:]
    items = [(1, " ".join(item)), (2, " ".join(changed).upper()), (3, None), (4, ""), (5, "nowhere to be found at all here or there"), (6, "short TEXT"), (6, "short text")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontamination.leaks(docs, benchmark).collect()}
    want = set()
    for doc_id, text, *_ in corpus:
        for item_id, t in items:
            p, w = words((t or "").lower()), words((text or "").lower())
            if p and w and len(w) < 5000 and (d := edit_distance(p, w)) <= decontamination.allowed(len(p)):
                want.add((doc_id, item_id, d))
    assert got == want and (8, 2, 2) in got
    blocks = {(r.doc_id, r.item_id, r.edits) for r in decontamination.leaks(docs, benchmark, block=2).collect()}
    assert blocks == want
    clean = decontamination.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(r[0] not in {x[0] for x in want} for r in corpus)
    assert decontamination.decontaminate(empty, benchmark).count() == 0
    assert decontamination.leaks(docs, benchmark.limit(0)).count() == 0


def test_recall_at_the_permitted_edits(spark):
    rng = np.random.RandomState(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    items, texts = [], []
    for i in range(160):
        n = [8, 12, 20, 30, 50][i % 5]
        item = list(rng.choice(vocabulary, n))
        copy = list(item)
        for e in range(decontamination.allowed(n)):
            at = rng.randint(1, len(copy) - 1)
            copy[at : at + rng.randint(2)] = [f"new{e}"] * rng.randint(1, 2)
        items.append((i, " ".join(item)))
        texts.append((i, " ".join([*rng.choice(vocabulary, 40), *copy, *rng.choice(vocabulary, 40)])))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, i) for i, (_, t) in enumerate(texts) if edit_distance(items[i][1].split(), t.split()) <= decontamination.allowed(len(items[i][1].split()))}
    assert len(want) >= 150 and len(found & want) >= 0.99 * len(want)


def test_frequent_seeds_and_null_items(spark, monkeypatch):
    text = "of the " * 40
    docs = spark.createDataFrame([(1, text), (2, "of the " * 3 + "end"), (3, None)], "doc_id long, text string")
    items = [(None, "of the of the of"), (None, "the of the of the of the"), (2, "of the end"), (3, "of the of the of the of the of the x")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for d, t in ((1, text), (2, "of the " * 3 + "end")):
        for i, item in items:
            if (e := edit_distance(item.split(), t.split())) <= decontamination.allowed(len(item.split())):
                want[d, i, e] += 1
    for around in (400_000, 7):
        monkeypatch.setattr(decontamination, "AROUND", around)
        index = next(decontamination.item_blocks(benchmark))
        got = Counter((d + 1, index.ids[i], e) for d, i, e, _ in index.matches(pa.array([text, "of the " * 3 + "end", None])))
        assert got == want
    assert Counter((r.doc_id, r.item_id, r.edits) for r in decontamination.leaks(docs, benchmark).collect()) == want


# 7


def test_forward_backward_equals_the_sum_over_paths():
    import itertools

    rng = np.random.RandomState(0)
    counts = [1, 4, 0, 6]
    at = np.concatenate([[0], np.cumsum(counts)])
    e, a = rng.rand(at[-1], 3) + 0.1, rng.rand(3, 3) + 0.1
    got = langid.forward_backward(e, at, a, segment=2)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        total = np.zeros((hi - lo, 3))
        for path in itertools.product(range(3), repeat=hi - lo):
            p = np.prod([e[lo + t, y] for t, y in enumerate(path)]) * np.prod([a[x, y] for x, y in zip(path, path[1:])])
            for t, y in enumerate(path):
                total[t, y] += p
        if hi > lo:
            assert np.allclose(got[lo:hi], total / total.sum(axis=1, keepdims=True))


def test_many_languages():
    k, rng = 150, np.random.RandomState(4)
    e, a = rng.rand(700, k) + 0.01, np.exp(rng.randn(k, k))
    at = np.array([0, 1, 1, 420, 700])
    got = langid.forward_backward(e, at, a)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        forward, backward = e[lo:hi].copy(), np.ones((hi - lo, k))
        for t in range(1, hi - lo):
            forward[t] *= forward[t - 1] @ a
            forward[t] /= forward[t].sum()
        for t in range(hi - lo - 2, -1, -1):
            backward[t] = a @ (e[lo + t + 1] * backward[t + 1])
            backward[t] /= backward[t].sum()
        want = forward * backward
        assert np.allclose(got[lo:hi], want / want.sum(axis=1, keepdims=True))
    tagger = langid.CrfTagger([f"l{i}" for i in range(5)])
    tagger.moves = rng.randn(5, 5)
    score = rng.randn(2, 4, 5)
    _, pairs = tagger._expected(score)
    paths = np.array(np.meshgrid(*[range(5)] * 4)).reshape(4, -1)
    want = np.zeros((5, 5))
    for row in score:
        weight = np.exp(sum(row[t, paths[t]] for t in range(4)) + sum(tagger.moves[paths[t], paths[t + 1]] for t in range(3)))
        for t in range(3):
            np.add.at(want, (paths[t], paths[t + 1]), weight / weight.sum())
    assert np.allclose(pairs, want)


def test_language(spark, empty):
    import random

    from made_text import prose

    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(20, 90), lang), lang) for i, lang in enumerate(["en", "de"] * 150)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 456 — …", None), (None, rows[0][1], None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(table, per_lang=60).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(got[r[0]].held_out for r in held) and not got[None].held_out
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[1000].score == 0
    assert got[None].lang_pred == got[0].lang_pred and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(empty).count() == 0


def test_the_sample_is_ordered_and_bounded(spark):
    from strandflow.llm.shared import bounded_sample

    rows = [(i % 900, f"text {i % 900}", "en" if i % 3 else "de") for i in range(3000)] + [(None, "x" * 500, "en"), (5, None, "en"), (6, "y", None)] + [(7, "same", "en")] * 2000
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (sorted(map(tuple, bounded_sample(t, "lang", 40, 300).collect())) for t in (table, table.repartition(7)))
    assert one == two and len({r[1] for r in one}) == len(one)
    for lang in ("de", "en"):
        own = [r for r in one if r[0] == lang]
        assert 1 <= len(own) <= 40 and (sum(len(r[3]) for r in own) <= 300 or len(own) == 1)
    every = {r[1] for r in bounded_sample(table, "lang", 10_000, 10**9).collect()}
    assert len(every) == len({(r[0], r[1]) for r in rows if r[1] is not None and r[2] is not None})


def test_language_on_hard_rows(spark):
    import random

    from made_text import prose

    rng = random.Random(5)
    rows = [(i, prose(rng, 30, lang), lang, "x", 1) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(500, prose(rng, 30_000, "de"), None, "x", 1), rows[0], rows[0], rows[0]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, lang_pred int")
    got = langid.identify(table, per_lang=40).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id == 500} == {"de"}
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 0}) == 1


def test_code_switching_shows():
    import random

    from made_text import prose

    rng = random.Random(4)
    model = langid.CrfTagger(["de", "en"]).fit([(prose(rng, 80, lang), lang) for lang in ["de", "en"] * 60])
    _, p, _ = model.marginals(pa.array([prose(rng, 40, "en") + " " + prose(rng, 40, "de")]))
    best = p.argmax(axis=1)
    assert best[:35].mean() > 0.9 and best[45:].mean() < 0.1


# 8


def test_chat(spark):
    odd = "a<|turn|>\\ <|end|> \\|<| </s>[INST]"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 1, "assistant", "b"), (2, 0, "system", None), (3, 0, None, "x"), (None, 0, "user", "q"), (4, 0, "user", "t"), (4, 0, "user", "t"), (5, 0, "user", "u" * 100_000)]
    table = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, seg string")
    segments = chat.format_conversations(table)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: got[c].valid for c in (1, 2, 3, 4, 5)} == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert chat.read_back(chat.format_conversations(table.limit(0))).count() == 0


# 9


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines(spark, empty):
    base = "a line of text that is long enough to count é"
    near = [base[:3] + base[4:], base[:9] + "ZZ" + base[11:], base + "!!", "x" + base[:-1], base[1:] + "yy", base.replace("é", "𝄞")]
    far = ["b" + base[:20] + base[24:], base[::-1]]
    rows = [(2, f"{near[0]}\nshort\n{far[0]}\nshort"), (1, f"{base}\n\n{near[1]}\n{base}"), (3, "\n".join(near[2:] + far)), (4, None), (5, ""), (None, far[1]), (6, "\n".join(near[2:] + far)), (6, "\n".join(near[2:] + far)), (7, base + "\n" + "w" * 30_000)]
    table = spark.createDataFrame([(*r, "o", 1) for r in rows], "doc_id long, text string, gone string, own int")
    places = sorted({(-1 if d is None else d, i, line) for d, t in rows for i, line in enumerate((t or "").split("\n")) if len(line) >= 24})
    gone = {p[:2] for p in places if any(q[:2] < p[:2] and abs(len(q[2]) - len(p[2])) <= 2 and distance(q[2], p[2]) <= 2 for q in places)}
    want = Counter()
    for d, t in rows:
        kept = None if t is None else "\n".join(line for i, line in enumerate(t.split("\n")) if (-1 if d is None else d, i) not in gone)
        want[d, kept] += 1
    done = lines.remove_lines(table)
    assert Counter((r.doc_id, r.text) for r in done.collect()) == want
    assert lines.dedup_lines(table).columns == table.columns
    assert lines.dedup_lines(empty).count() == 0


def test_hidden_names_do_not_clash(spark):
    rows = [(1, "same line\nother", "k", 7, "g"), (2, "same line\nthird", "l", 8, "h")]
    table = spark.createDataFrame(rows, "doc_id long, text string, __doc_key string, __n_lines int, __GONE string")
    assert Counter(map(tuple, lines.dedup_lines(table).collect())) == Counter([rows[0], (2, "third", "l", 8, "h")])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    with_lang = table.selectExpr("*", "'en' as lang")
    assert {r["__doc_key"] for r in quality.keep_good(with_lang, labels.limit(0)).collect()} == {"k", "l"}
    assert {r["__doc_key"] for r in near_duplicates.one_of_each(table).collect()} == {"k", "l"}


def test_short_repeats(spark):
    long = "a line of text that is long enough to count"
    rows = [(1, f"Les.\n\n{long}\nLes."), (2, "Les.\nLet.\n \n"), (3, f"x\n{long}!\nLet.\n\n "), (4, "x"), (5, None), (6, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: f"Les.\n\n{long}", 2: "Let.\n \n", 3: "x\n", 5: None, 6: ""}
    assert {r.doc_id: r.text for r in lines.dedup_lines(table).collect()} == want


def test_lines_are_prepared_once(spark):
    """Both sides of the join on segments read one exchange."""
    base = "a line of text that is long enough to count"
    table = spark.createDataFrame([(i, f"{base} {i}\n{base[i:]} other") for i in range(12)], "doc_id long, text string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        done = lines.line_digests(table)
        done.collect()
        plan = done._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert sum("Exchange hashpartitioning(key#" in x and "ReusedExchange" not in x for x in plan) == 1


def test_lines_are_verified_once(spark):
    """Each pair is verified in one place of the plan, whose two uses would double the plan that the driver holds; both ways of a pair count."""
    base = "a line of text that is long enough to count"
    table = spark.createDataFrame([(2, f"{base}xx"), (1, f"{base}x\nkept as it is alone here and long"), (3, f"y{base}x")], "doc_id long, text string")
    done = lines.line_digests(table)
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in done.collect()} == {1: (2, 0), 2: (1, 1), 3: (1, 1)}
    assert done._jdf.queryExecution().optimizedPlan().toString().count("levenshtein(") == 1


# 10


def brute_ctw(texts, train, depth):
    """log10 probabilities by the recursive definition, on dictionaries."""
    frame = lambda t: bytes(depth) + bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()) + b"\0"
    counts = defaultdict(lambda: [0, 0])
    grams = [[(s[i - depth : i], s[i]) for i in range(depth, len(s))] for s in map(frame, texts)]
    children = defaultdict(set)
    for own, use in zip(grams, train, strict=True):
        for ctx, byte in own:
            for k in range(8):
                z, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
                for d in range(depth + 1):
                    counts[z, ctx[depth - d :]][bit] += use
                    if d:
                        children[z, ctx[depth - d + 1 :]].add(ctx[depth - d :])
    lg = math.lgamma
    block = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - math.log(math.pi) - lg(a + b + 1)
    memo = {}

    def weighted(z, ctx):
        if (z, ctx) not in memo:
            own = block(*counts[z, ctx])
            if len(ctx) < depth:
                own = np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(weighted(z, c) for c in children[z, ctx]))
            memo[z, ctx] = own
        return memo[z, ctx]

    def p(z, bit, ctx, d):
        a = counts[z, ctx[depth - d :]]
        kt = (a[bit] + 0.5) / (sum(a) + 1)
        if d == depth:
            return kt
        stop = math.exp(math.log(0.5) + block(*a) - weighted(z, ctx[depth - d :]))
        return stop * kt + (1 - stop) * p(z, bit, ctx, d + 1)

    return [sum(math.log10(p((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1, ctx, 0)) for ctx, byte in own for k in range(8)) for own in grams]


def test_ctw(docs, corpus, empty, monkeypatch):
    small = [r for r in corpus if len(r[1] or "") < 1500]
    table = docs.where("coalesce(length(text), 0) < 1500")
    train = [r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in small]
    want = brute_ctw([r[1] for r in small], train, 3)
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    c = Counter()
    for r, use in zip(small, train, strict=True):
        c.update(words(lower(r[1])) + ["\0"] if use else [])
    n, v = sum(c.values()), len(c)
    expected = Counter()
    for r, use, s in zip(small, train, want, strict=True):
        tokens = [*words(lower(r[1])), "\0"]
        expected[r[0], not use, len(tokens), sum(c[t] > 0 for t in tokens), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens), 6), round(s, 2)] += 1
    for group, answers in ((64, 4_000_000), (2, 1)):
        monkeypatch.setattr(ctw, "GROUP", group)
        monkeypatch.setattr(ctw, "ANSWERS", answers)
        rows = ctw.score_documents(table, depth=3, chunk_bytes=6000).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 2)) for r in rows) == expected
    assert ctw.score_documents(empty).count() == 0


def test_ctw_counts_are_wide():
    many = np.array([5_000_000_000, 1])
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 0], pa.int32()), pa.array([0, 0, 0], pa.int32()), pa.array([0, 0, 0], pa.int32()), pa.array([ctw.pack(np.array([7, 9], np.uint64))] * 3), pa.array([zlib.compress(many.tobytes())] * 3)], names=["kind", "shard", "group", "keys", "counts"])
    (model,) = ctw._weigh(3, True)([batch])
    told = pa.RecordBatch.from_arrays([model.column("kind"), pa.array([-1], pa.int32()), model.column("keys"), model.column("values")], names=["kind", "chunk", "keys", "values"])
    asked = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([4], pa.int32()), pa.array([ctw.pack(np.array([9, 7], np.uint64)[::-1])]), pa.array([None], pa.binary())], names=["kind", "chunk", "keys", "values"])

    class Held:
        value = None

    (answer,) = ctw._answers(Held)([told, asked])
    assert np.frombuffer(zlib.decompress(answer.column("values")[0].as_py()), np.int64).tolist() == [15_000_000_000, 3]


def test_quality_learns_from_half_of_all_trusted_texts(spark, monkeypatch):
    """However many there are; rows of equal doc_id and text count once."""
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.training_ids(labels).count() == 2000
    monkeypatch.setattr(quality, "FEW_IDS", 100)
    ids = {r.doc_id for r in quality.training_ids(labels).collect()}
    assert 1850 < len(ids) < 2150
    docs = labels.select("doc_id", F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("text"))
    texts = [r.text for r in quality.training_texts(docs.unionByName(docs.where("doc_id < 50")), labels).collect()]
    assert sorted(texts) == sorted(f"w{i}" for i in ids)


def test_quality_words_beyond_the_head(spark, monkeypatch):
    """Words whose values are not on the driver give the same sums by document and by block."""
    rng = np.random.RandomState(5)
    texts = [" ".join(f"v{min(rng.zipf(1.4), 60)}" for _ in range(rng.randint(3, 90))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, *texts[:5]])] + [(0, texts[0], "en"), (90, "v1 unseen v2", "en"), (91, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    whole = sorted(map(tuple, quality.perplexities(docs, labels).collect()))
    monkeypatch.setattr(quality, "HEAD_WORDS", 6)
    parted = sorted(map(tuple, quality.perplexities(docs, labels).collect()))
    assert len({r[3] for r in whole}) > 10 and [r[:2] for r in parted] == [r[:2] for r in whole]
    assert np.allclose([r[2:] for r in parted], [r[2:] for r in whole], atol=1.1e-3)
