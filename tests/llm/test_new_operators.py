"""Tokenizer alignment, fill-in-middle and exact dedup against plain loops over hard cases."""

import ast
import hashlib
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from made_text import prose
from strandflow.llm import alignment, exact, infill, queries
from tokenizers import Tokenizer

A, B = public_tokenizers.path(queries.BYTE_LEVEL), public_tokenizers.path(queries.PIECES)
SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def as_text(rows):
    return sorted(str(tuple(r)) for r in rows)


# 11


HARD = ["", None, " ", "  a", "a  ", " \n\t", "a \nb", "a\n b", "a\xa0 b", "a▁b x", "<|endoftext|> <s> </s> ok", "é💥 " * 20, "x" * 3000, "中文测试 文本。", "\x00a b", "a  b   c", "don't we'll", "é ﬁ　z", " lead", "\x1c x"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "a b")] + [(100 + i, prose(rng, rng.randrange(1, 200), rng.choice(["en", "de"]))) for i in range(60)]
    rows += [rows[30]] * 3
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, chunk string, pairs int").repartition(3)


def aligned_by_loops(rows):
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    byte_of = {s: i for i, s in enumerate(alignment.byte_symbols())}
    a_name = {i: s for s, i in a_lib.get_vocab().items()}

    def spans(ids, bytes_of):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(bytes_of(i))))
            at = out[-1][2]
        return out

    def a_bytes(i):
        return bytes(byte_of[c] for c in a_name[i])

    def b_bytes(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    for doc_id, text in rows:
        a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, a)) != want or b"".join(map(b_bytes, b)) != want:
            yield doc_id, [], [], [], []
            continue
        sa, sb = spans(a, a_bytes), spans(b, b_bytes)
        cuts = sorted({x[2] for x in sa} & {x[2] for x in sb})
        groups = [([i for i, s, e in sa if lo <= s and e <= hi], [i for i, s, e in sb if lo <= s and e <= hi]) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        links = [(x, y) for x, (_, s, e) in enumerate(sa) for y, (_, t, f) in enumerate(sb) if s < f and t < e]
        yield doc_id, a, b, groups, links


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 1500])
def test_alignment(texts, chunk_bytes):
    rows, docs = texts
    known = list(aligned_by_loops(rows))
    pairs = Counter((a[x], b[y]) for _, a, b, _, links in known for x, y in links)
    top = defaultdict(int)
    for (_, b), n in pairs.items():
        top[b] = max(top[b], n)
    want = []
    for doc_id, a, b, groups, links in known:
        ids = [(a[x], b[y]) for x, y in links]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want.append((doc_id, len(a), len(b), len(groups), len(links), sum(pairs[p] == top[p[1]] for p in ids), sum(pairs[p] for p in ids), sha(text) if a else ""))
    got = alignment.alignment_digests(docs, A, B, chunk_bytes)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert as_text(got.collect()) == as_text(want)


def test_aligned_documents(texts):
    rows, docs = texts
    want = []
    for doc_id, a, b, groups, links in aligned_by_loops(rows):
        upto = np.cumsum([(len(x), len(y)) for x, y in groups], axis=0).tolist() if groups else []
        want.append((doc_id, a, b, upto, links))
    got = [(r.doc_id, r.a_ids, r.b_ids, [[g.a_upto, g.b_upto] for g in r.groups], [(k.a, k.b) for k in r.links]) for r in alignment.align_documents(docs, A, B).collect()]
    assert as_text(got) == as_text(want)
    for r in alignment.align_documents(docs, A, B).where("size(groups) > 0").collect():
        assert r.groups[-1].byte_upto == 1 + len(dict(rows)[r.doc_id].encode())


def test_bitset():
    rng = np.random.RandomState(1)
    places = np.unique(rng.randint(0, 5000, 700))
    bits = alignment.Bitset(places, 5000)
    asked = rng.randint(0, 5001, 300)
    assert bits.rank(asked).tolist() == [int((places < x).sum()) for x in asked]
    assert bits.select().tolist() == places.tolist()
    other = np.unique(rng.randint(0, 5000, 700))
    assert (bits & alignment.Bitset(other, 5000)).select().tolist() == np.intersect1d(places, other).tolist()


def test_alignment_of_nothing(empty):
    assert alignment.alignment_digests(empty, A, B).count() == 0 and alignment.align_documents(empty, A, B).count() == 0


ALONE = """
import sys
import pyarrow as pa
from strandflow.llm import alignment
rows, known = (pa.ipc.open_file(path).read_all() for path in sys.argv[1:])
print(alignment.sum_documents(rows, known).select(["doc_id", "n_links", "n_best"]).to_pylist())
"""


def test_sums_need_no_module_that_others_import(tmp_path):
    """The process that sums may have imported nothing else of pyarrow."""
    chunk = alignment.Chunk()
    for doc_id, text in [(1, "a b a"), (2, None)]:
        chunk.add(doc_id, text)
    rows = pa.Table.from_batches(chunk.rows(alignment.TokenPair.load(A, B), 0, alignment._CHUNK))
    n = len(rows["pairs"][2])
    for name, table in (("rows", rows), ("known", pa.table({"code": np.arange(n), "n": np.arange(n) + 1, "best": np.ones(n, bool)}))):
        with pa.OSFile(f"{tmp_path}/{name}", "wb") as sink, pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table)
    done = subprocess.run([sys.executable, "-c", ALONE, f"{tmp_path}/rows", f"{tmp_path}/known"], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert ast.literal_eval(done.stdout) == [{"doc_id": 1, "n_links": 3, "n_best": 3}, {"doc_id": 2, "n_links": 0, "n_best": 0}]


# 12


def infill_by_loops(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill(spark, docs, corpus):
    shapes = ["", None, " ", "  a", "a  ", " \n\t", "w " * 64, "w " * 63 + "w", "w " * 65, "w " * 64 + "\n", "w" * 300, "é💥 " * 200, "a<P>b", "x " * 60_000, "   " * 1000, "a < P> <<S <M", "<" * 9 + " S>"]
    rows = [(i + 40 * k, t) for k in range(4) for i, t in enumerate(shapes)] + [(None, "a b c"), (-1, "a b c")] + [r[:2] for r in corpus]
    both = docs.select("doc_id", "text", F_row()).unionByName(spark.createDataFrame([(*r, 1) for r in rows[: -len(corpus)]], "doc_id long, text string, row int"))
    want = [infill_by_loops(*r) for r in rows]
    assert as_text(infill.infill(both).drop("text").collect()) == as_text(want)
    texts = [r[1] or "" for r in rows]
    digests = [(*w[:5], sha(w[5]), sha(t)) for w, t in zip(want, texts, strict=True)]
    assert as_text(infill.infill_digests(both).collect()) == as_text(digests)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}


def F_row():
    from pyspark.sql import functions as F

    return F.lit(1).alias("row")  # a column of a name that the operator uses


def test_infill_moves_documents_once(spark):
    done = infill.infill_digests(spark.read.parquet(f"{SF}/documents.parquet"))
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", plan)) - len(re.findall(r"ReusedExchange", plan)) <= 1


def test_infill_of_nothing(empty):
    assert infill.infill_digests(empty).count() == 0


# 13


@pytest.mark.parametrize("bits", [64, 5])
def test_exact_copies(spark, docs, corpus, bits):
    long = prose(random.Random(3), 9000)
    extra = [(None, "a b"), (None, "a\n\tb"), (-1, None), (-2, ""), (-2, " "), (200, long), (201, long.replace(" ", "\n")), (202, long + " more"), (203, "x" * 50_000), (204, "x" * 50_000), (205, "x" * 49_999)]
    rows = [r[:2] for r in corpus] + extra
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (doc_id, _), t in zip(rows, norm, strict=True):
        groups[t].append(doc_id)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact.mark_copies(both, bits).collect()
    assert as_text((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == as_text((r[0], least[t], len(groups[t]), sha(t)) for r, t in zip(rows, norm, strict=True))
    stay = Counter(r.text_sha256 for r in got if r.kept)
    assert set(stay.values()) == {1} and len(stay) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_copies(docs, corpus, empty):
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in corpus})
    assert exact.drop_copies(empty).count() == 0 and exact.mark_copies(empty).count() == 0


def test_many_copies(spark):
    """10,000 rows of one text of several chunks."""
    text = prose(random.Random(4), 400)
    rows = spark.range(10_000).selectExpr("id AS doc_id", f"'{text}' AS text").unionByName(spark.createDataFrame([(-5, text + " ")], "doc_id long, text string"))
    r = exact.mark_copies(rows).groupBy("keep_id", "group_size").count().collect()
    assert sorted(map(tuple, r)) == [(-5, 1, 1), (0, 10_000, 10_000)]


def test_chunks_follow_content(spark):
    """A passage put before a text leaves most of its chunks as they are."""
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(20_000))
    rows = spark.createDataFrame([(1, text), (2, prose(rng, 57) + " " + text)], "doc_id long, text string")
    a, b = (set(r.recipe) for r in sorted(exact.recipes(rows).collect(), key=lambda r: r.doc_id))
    assert len(a & b) >= 0.8 * len(a)
    assert all("ython" not in line and "Arrow" not in line for line in exact.mark_copies(rows)._jdf.queryExecution().executedPlan().toString().splitlines())


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_exact_dedup"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert as_text(got.select(*order).collect()) == as_text(tuple(r[k] for k in at) for r in want.fetchall())
