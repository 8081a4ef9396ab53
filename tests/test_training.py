"""Gradients against finite differences, loops and checkpoints, permutations, and the network against a loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandflow.functions import bases
from strandflow.operators import metrics, network, training


@pytest.fixture(scope="module")
def small():
    return network.random_weights(3, hidden=4, slices=3, dense=7, head=5)


def made(n, seed=0):
    """Tensors whose labels follow from one of their numbers."""
    rng = np.random.RandomState(seed)
    x, y = rng.normal(0, 0.3, (n, 1056)), np.zeros((n, 90))
    kind = rng.randint(0, 2, n)
    x[np.arange(n), 500 + kind] += 3
    for at, size in ((0, 21), (21, 3), (24, 33), (57, 33)):
        y[np.arange(n), at + kind * (size - 1)] = 1
    return x, y


@pytest.mark.parametrize("loss", ["focal", "cross_entropy"])
def test_gradients_equal_differences(small, loss):
    x, y = made(3)
    _, got = training.loss_and_gradients(x, y, small, loss)
    rng = np.random.RandomState(1)
    for k, w in small.items():
        for _ in range(4):
            at = tuple(rng.randint(0, s) for s in w.shape)
            ends = []
            for d in (1e-5, -1e-5):
                moved = {**small, k: w.copy()}
                moved[k][at] += d
                ends.append(training.loss_and_gradients(x, y, moved, loss, False)[0].sum())
            assert got[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_losses_equal_the_columns(spark, small):
    rng = np.random.RandomState(2)
    logits, y = rng.normal(size=(5, 21)), np.eye(21)[rng.randint(0, 21, 5)]
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(logits, y, strict=True))], "i int, logits array<double>, y array<double>")
    want = [r[0] for r in rows.orderBy("i").select(bases.focal_loss(F.col("logits"), F.col("y"))).collect()]
    assert training.focal(logits, y)[0] == pytest.approx(want)


def test_network_equals_a_loop(small):
    """Every cell of the two-layer bidirectional network by scalars."""
    x, _ = made(2, 5)
    sig = lambda v: 1 / (1 + math.exp(-v))
    unit = lambda v: 1.0507009873554805 * (v if v > 0 else 1.6732632423543772 * (math.exp(v) - 1))

    def direction(seq, w, b):
        size, h, c, out = len(b) // 4, [0.0] * (len(b) // 4), [0.0] * (len(b) // 4), []
        for v in seq:
            z = [sum(a * w[r][g] for r, a in enumerate([*v, *h])) + b[g] for g in range(4 * size)]
            c = [sig(z[2 * size + k] + 1) * c[k] + sig(z[k]) * math.tanh(z[size + k]) for k in range(size)]
            h = [sig(z[3 * size + k]) * math.tanh(c[k]) for k in range(size)]
            out.append(h)
        return out

    got = network.forward(x, small)
    for n in range(2):
        seq = x[n].reshape(33, 32).tolist()
        for name in ("lstm1", "lstm2"):
            fw = direction(seq, small[f"{name}/fw/w"].tolist(), small[f"{name}/fw/b"].tolist())
            bw = direction(seq[::-1], small[f"{name}/bw/w"].tolist(), small[f"{name}/bw/b"].tolist())[::-1]
            seq = [a + b for a, b in zip(fw, bw, strict=True)]
        w = small["slice/w"]
        flat = [unit(sum(seq[t][f] * w[f, t, s] for t in range(33)) + small["slice/b"][f, s]) for f in range(8) for s in range(3)]
        layer = lambda v, k: [unit(sum(a * small[f"{k}/w"][r, c] for r, a in enumerate(v)) + small[f"{k}/b"][c]) for c in range(len(small[f"{k}/b"]))]
        dense = layer(flat, "dense")
        for head in network.HEADS:
            e = [math.exp(v) for v in layer(layer(dense, f"{head}/hidden"), head)]
            assert got[head][n] == pytest.approx([v / sum(e) for v in e])


def test_optimizers_and_clipping():
    p, g = {"a/w": np.array([1.0, 2.0])}, {"a/w": np.array([30.0, 40.0])}
    assert training.clipped(g)["a/w"] == pytest.approx([3.0, 4.0]) and training.clipped({"a/w": np.array([0.3, 0.4])})["a/w"] == pytest.approx([0.3, 0.4])
    m = training.Optimizer("momentum")
    q = m.move(m.move(p, {"a/w": np.array([1.0, 0.0])}, 0.1), {"a/w": np.array([1.0, 0.0])}, 0.1)
    assert q["a/w"] == pytest.approx([1 - 0.1 - 0.19, 2.0])
    a = training.Optimizer()
    assert a.move(p, {"a/w": np.array([0.5, -7.0])}, 0.01)["a/w"] == pytest.approx([0.99, 2.01], abs=1e-6)


def test_rates_equal_the_columns(spark):
    for mode in ("tri", "tri2", "exp"):
        got = [training.triangular_rate(s, 3, 0.1, 0.9, mode) for s in range(20)]
        want = [r[0] for r in spark.range(20).orderBy("id").select(bases.triangular_lr(F.col("id"), 3, 0.1, 0.9, mode)).collect()]
        assert got == pytest.approx(want)


def test_decay_equals_the_columns(spark):
    rng = np.random.RandomState(7)
    runs = [[1.0, *rng.uniform(0.5, 1.5, 25).tolist()], [0.1, *([0.5, 0.9] * 12)], [0.1 * k for k in range(1, 27)], [5.0 - 0.1 * k for k in range(26)]]
    history = spark.createDataFrame([(r, e, v) for r, h in enumerate(runs) for e, v in enumerate(h, 1)], "run long, epoch long, loss double")
    want = {(r.run, r.epoch): (r.switched, r.stopped) for r in metrics.adaptive_rates(metrics.loss_flags(history)).collect()}
    for r, losses in enumerate(runs):
        since, left = 0, 3
        for e in range(1, len(losses) + 1):
            since += 1
            called = training.wants_decay(losses[:e], since)
            left -= called
            assert want[r, e] == (called, left == 0)
            since = 0 if called else since
            if left == 0:
                break


@pytest.mark.parametrize("n", [1, 2, 10, 97, 1000])
def test_permutations(spark, n):
    orders = []
    for key in (1, 2):
        there = [training.permuted(i, n, key) for i in range(n)]
        assert sorted(there) == list(range(n)) and [training.permuted(j, n, key, back=True) for j in there] == list(range(n))
        assert [r[0] for r in spark.range(n).orderBy("id").select(training.permuted_column(F.col("id"), n, key)).collect()] == there
        orders.append(there)
    assert n < 10 or orders[0] != orders[1]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    x, y = made(160, 9)
    rows = spark.createDataFrame([(i // 20, a.tolist(), b.astype(int).tolist(), "train" if i < 120 else "validation") for i, (a, b) in enumerate(zip(x, y, strict=True))], "block long, x array<float>, y array<int>, split string")
    path = str(tmp_path_factory.mktemp("blocks") / "t")
    training.write_blocks(rows, path)
    return spark.read.parquet(path)


def test_sums_equal_one_batch(table, small):
    rows = table.where("split = 'train'").repartition(5)
    x, y = (np.array([r[c] for r in rows.collect()], float) for c in ("x", "y"))
    n, sums, gradients = training.table_sums(rows, small, batch=7)
    want_sums, want = training.loss_and_gradients(x, y, small)
    assert n == 120 and sums == pytest.approx(want_sums, rel=1e-6)
    assert all(gradients[k] == pytest.approx(want[k], rel=1e-5, abs=1e-7) for k in want)
    assert training.table_sums(rows.limit(0), small)[0] == 0


def test_training_learns_and_goes_on(table, small, tmp_path):
    """The loss falls, and a run that stopped after one epoch ends where the unbroken one does."""
    start = lambda: training.Progress(rate=0.02, l2=1e-4)
    whole, history = training.train(table, small, str(tmp_path / "a"), 3, start(), blocks_a_step=3)
    assert history.epoch == 3 and history.validation[-1] < history.validation[0] and history.training[-1] < history.training[0]
    training.train(table, small, str(tmp_path / "b"), 1, start(), blocks_a_step=3)
    again, other = training.train(table, small, str(tmp_path / "b"), 3, blocks_a_step=3, resume=1)
    assert other == history and all(again[k] == pytest.approx(whole[k], rel=1e-6, abs=1e-9) for k in whole)


def test_cyclical_training(table, small, tmp_path):
    _, history = training.train(table, small, str(tmp_path / "c"), 1, training.Progress(l2=0.0), training.Optimizer("momentum"), 3, cyclical=(2, 1e-4, 1e-2, "tri2"))
    assert history.epoch == 1 and len(history.validation) == 1 and np.isfinite(history.validation[0])


def test_sweep_equals_a_loop(table, small):
    rows = table.where("split = 'train'")
    got = training.rate_sweep(rows, small, [1e-4, 1e-2], steps=3).orderBy("lr", "step").collect()
    assert [(r.lr, r.step) for r in got] == [(lr, s) for lr in (1e-4, 1e-2) for s in range(3)]
    x, y = (np.array([r[c] for r in rows.collect()], np.float32) for c in ("x", "y"))
    for lr in (1e-4, 1e-2):
        p, opt = small, training.Optimizer()
        for r in (r for r in got if r.lr == lr):
            sums, gradients = training.loss_and_gradients(x, y, p)
            assert r.loss == pytest.approx(sums.sum() / len(x), rel=1e-5) and 0 <= r.accuracy <= 1
            p = opt.move(p, training.clipped(gradients), lr)
