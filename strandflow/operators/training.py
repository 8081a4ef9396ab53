"""Training of the scoring network: synchronous gradient descent over a table of labelled tensors.

A step's rows lie in some blocks of the table, chosen by a keyed permutation
that is new in each epoch. Tasks sum losses and gradients of their rows, the
sums meet in groups of tasks and then on the driver, which clips them by their
global norm and moves the weights. Only sums of the weights' size travel, a few
times the square root of the number of tasks. Each epoch ends with the
validation loss and a checkpoint, from which a run goes on as if it had not
stopped. Dropout is not applied.

Tables are written by ``write_blocks`` in the order of their blocks, so a step
reads the row groups of its own blocks.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import WIDTH
from ..sources.bgzf import read_all
from ..sources.shared import file_system
from .network import HEADS, SELU_ALPHA, SELU_SCALE, _sigmoid, selu, softmax

Weights = dict[str, np.ndarray]
#: First place of each task's labels in the 90 numbers.
LABEL_AT = {"g": 0, "z": 21, "u": 24, "v": 57}
ROUNDS = 6


# a keyed permutation


def _sides(n: int) -> tuple[int, int]:
    a = max(1, int(np.ceil(np.sqrt(n))))
    return a, max(1, -(-n // a))


def _mixed(value: int, key: int, step: int) -> int:
    """Spark's xxhash64 of three longs."""
    seed = 42
    for x in (value, key, step):
        seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def permuted(i: int, n: int, key: int, back: bool = False) -> int:
    """Where a keyed permutation of 0 to n - 1 takes i; ``back``: what it takes to i."""
    a, b = _sides(n)
    while True:
        left, right = i // b, i % b
        for step in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            way = -1 if back else 1
            if step % 2:
                right = (right + way * _mixed(left, key, step)) % b
            else:
                left = (left + way * _mixed(right, key, step)) % a
        i = left * b + right
        if i < n:
            return i


def permuted_column(i: Column, n: int, key: int, walks: int = 40) -> Column:
    """The same of a column. A walk ends outside with a chance of some 2 / sqrt(n); the chance of ``walks`` in a row raises rather than to give a wrong place."""
    a, b = _sides(n)

    def walk(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), F.pmod(x, F.lit(b)).cast("long")
        for step in range(ROUNDS):
            if step % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(key).cast("long"), F.lit(step).cast("long")), F.lit(b)), F.lit(b))
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(key).cast("long"), F.lit(step).cast("long")), F.lit(a)), F.lit(a))
        return left * b + right

    end = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), F.lit(-1).cast("long"), lambda s, k: F.when((k > 1) & (s < n), s).otherwise(walk(F.when(k == 1, i.cast("long")).otherwise(s))))
    return F.when(end < n, end).otherwise(F.raise_error(F.lit("the permutation did not end")).cast("long"))


# gradients


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    size = w.shape[1] // 4
    h = c = np.zeros((len(x), size))
    out, kept = [], []
    for t in range(x.shape[1]):
        joined = np.concatenate([x[:, t], h], axis=1)
        i, j, f, o = np.split(joined @ w + b, 4, axis=1)
        i, j, f, o, before = _sigmoid(i), np.tanh(j), _sigmoid(f + 1), _sigmoid(o), c
        c = f * before + i * j
        h = o * np.tanh(c)
        out.append(h)
        kept.append((joined, i, j, f, o, before, np.tanh(c)))
    return np.stack(out, axis=1), (kept, w)


def _lstm_back(d: np.ndarray, memory: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the input, w and b."""
    kept, w = memory
    size = w.shape[1] // 4
    n_in = w.shape[0] - size
    dw, db, dx = np.zeros_like(w), np.zeros(w.shape[1]), np.zeros((*d.shape[:2], n_in))
    dh = dc = np.zeros((len(d), size))
    for t in range(d.shape[1] - 1, -1, -1):
        joined, i, j, f, o, before, squashed = kept[t]
        dh = dh + d[:, t]
        dc = dc + dh * o * (1 - squashed**2)
        gates = np.concatenate([dc * j * i * (1 - i), dc * i * (1 - j**2), dc * before * f * (1 - f), dh * squashed * o * (1 - o)], axis=1)
        dw += joined.T @ gates
        db += gates.sum(0)
        back = gates @ w.T
        dx[:, t], dh, dc = back[:, :n_in], back[:, n_in:], dc * f
    return dx, dw, db


def _selu_slope(y: np.ndarray) -> np.ndarray:
    """The slope of selu from its value."""
    return np.where(y > 0, SELU_SCALE, y + SELU_SCALE * SELU_ALPHA)


def focal(logits: np.ndarray, y: np.ndarray, gamma: float = 2.0, floor: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """The focal loss of each row and its gradient by the logits."""
    p = softmax(logits)
    log = lambda q: np.log(np.clip(q, floor, 1.0))
    own, other = np.maximum(y - p, 0), p
    loss = np.where(y > 0, -(own**gamma) * log(p), -(other**gamma) * log(1 - p)).sum(1)
    slope = np.where(
        y > 0,
        gamma * own ** (gamma - 1) * log(p) - np.where(p > floor, own**gamma / np.maximum(p, floor), 0),
        -gamma * other ** (gamma - 1) * log(1 - p) + np.where(1 - p > floor, other**gamma / np.maximum(1 - p, floor), 0),
    )
    return loss, p * (slope - (slope * p).sum(1, keepdims=True))


def cross_entropy(logits: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cross-entropy of each row and its gradient by the logits."""
    p = softmax(logits)
    terms = -y / (p + 1e-10)
    return (-y * np.log(p + 1e-10)).sum(1), p * (terms - (terms * p).sum(1, keepdims=True))


LOSSES: dict[str, Callable] = {"focal": focal, "cross_entropy": cross_entropy}


def loss_and_gradients(x: np.ndarray, y: np.ndarray, p: Weights, loss: str = "focal", gradients: bool = True) -> tuple[np.ndarray, Weights]:
    """The batch's four task losses, summed, and the gradients of their sum; x (batch, 1056), y (batch, 90)."""
    n = len(x)
    first = x.reshape(n, WIDTH, -1).astype(float)
    layers, seen = [first], {}
    for name in ("lstm1", "lstm2"):
        ways = [_lstm(layers[-1] if way == "fw" else layers[-1][:, ::-1], p[f"{name}/{way}/w"], p[f"{name}/{way}/b"]) for way in ("fw", "bw")]
        seen[name] = [m for _, m in ways]
        layers.append(np.concatenate([ways[0][0], ways[1][0][:, ::-1]], axis=2))
    sliced = selu(np.einsum("btf,fts->bfs", layers[-1], p["slice/w"]) + p["slice/b"])
    flat = sliced.reshape(n, -1)
    dense = selu(flat @ p["dense/w"] + p["dense/b"])
    sums, out, d_dense = np.zeros(4), {}, np.zeros_like(dense)
    for k, (head, size) in enumerate(HEADS.items()):
        hidden = selu(dense @ p[f"{head}/hidden/w"] + p[f"{head}/hidden/b"])
        logits = selu(hidden @ p[f"{head}/w"] + p[f"{head}/b"])
        at = LABEL_AT[head]
        each, d = LOSSES[loss](logits, y[:, at : at + size].astype(float))
        sums[k] = each.sum()
        if gradients:
            d = d * _selu_slope(logits)
            out[f"{head}/w"], out[f"{head}/b"] = hidden.T @ d, d.sum(0)
            d = (d @ p[f"{head}/w"].T) * _selu_slope(hidden)
            out[f"{head}/hidden/w"], out[f"{head}/hidden/b"] = dense.T @ d, d.sum(0)
            d_dense += d @ p[f"{head}/hidden/w"].T
    if not gradients:
        return sums, {}
    d = d_dense * _selu_slope(dense)
    out["dense/w"], out["dense/b"] = flat.T @ d, d.sum(0)
    d = (d @ p["dense/w"].T).reshape(sliced.shape) * _selu_slope(sliced)
    out["slice/w"], out["slice/b"] = np.einsum("btf,bfs->fts", layers[-1], d), d.sum(0)
    d = np.einsum("bfs,fts->btf", d, p["slice/w"])
    for name in ("lstm2", "lstm1"):
        half = d.shape[2] // 2
        forward = _lstm_back(d[:, :, :half], seen[name][0])
        backward = _lstm_back(d[:, ::-1, half:], seen[name][1])
        for way, (_, dw, db) in (("fw", forward), ("bw", backward)):
            out[f"{name}/{way}/w"], out[f"{name}/{way}/b"] = dw, db
        d = forward[0] + backward[0][:, ::-1]
    return sums, {k: out[k] for k in p}


def penalty(p: Weights) -> float:
    """Half the sum of squares of all weights, biases aside."""
    return float(sum((w**2).sum() for k, w in p.items() if not k.endswith("/b")) / 2)


# sums over a table


def _flat(p: Weights) -> np.ndarray:
    return np.concatenate([w.ravel() for w in p.values()])


def _shaped(flat: np.ndarray, like: Weights) -> Weights:
    at = np.cumsum([0, *(w.size for w in like.values())])
    return {k: flat[a:b].reshape(w.shape) for (k, w), a, b in zip(like.items(), at[:-1], at[1:], strict=True)}


def _summed(rows: pa.Table) -> pa.Table:
    """One sum, in the order of the tasks, so that equal runs give equal weights."""
    rows = rows.sort_by("part")
    total = sum(np.frombuffer(b, np.float64) for b in rows["sums"].to_pylist())
    return pa.table({"part": rows["part"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def table_sums(rows: DataFrame, weights: Weights, loss: str = "focal", gradients: bool = True, batch: int = 512) -> tuple[int, np.ndarray, Weights]:
    """Rows, task losses and gradients of the whole table (x, y), summed over tasks in two levels."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                x, y = (np.stack([np.asarray(v, float) for v in part.column(c).to_pylist()]) for c in ("x", "y"))
                sums, grads = loss_and_gradients(x, y, shared.value, loss, gradients)
                one = np.concatenate([[len(x)], sums, *([_flat(grads)] if gradients else [])])
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    parts = rows.select("x", "y").mapInArrow(run, "part long, sums binary")
    groups = max(1, int(np.sqrt(max(rows.rdd.getNumPartitions(), 1))))
    met = parts.groupBy(F.pmod("part", F.lit(groups)).alias("of")).applyInArrow(_summed, "part long, sums binary").collect()  # a row for each group
    shared.destroy()
    if not met:
        return 0, np.zeros(4), {k: np.zeros_like(w) for k, w in weights.items()} if gradients else {}
    total = sum(np.frombuffer(r.sums, np.float64) for r in sorted(met, key=lambda r: r.part))
    return int(total[0]), total[1:5], _shaped(total[5:], weights) if gradients else {}


# optimizers


def clipped(gradients: Weights, most: float = 5.0) -> Weights:
    """Gradients scaled down to a global norm of ``most``."""
    norm = float(np.sqrt(sum((g**2).sum() for g in gradients.values())))
    return {k: g * (most / max(norm, most)) for k, g in gradients.items()}


@dataclass
class Optimizer:
    """Adam, or descent with momentum; slots holds what it remembers of earlier steps."""

    kind: str = "adam"
    momentum: float = 0.9
    steps: int = 0
    slots: dict[str, Weights] = field(default_factory=dict)

    def move(self, p: Weights, gradients: Weights, rate: float) -> Weights:
        self.steps += 1
        slot = lambda name: self.slots.setdefault(name, {k: np.zeros_like(w) for k, w in p.items()})
        if self.kind == "momentum":
            v = slot("v")
            for k, g in gradients.items():
                v[k] = self.momentum * v[k] + g
            return {k: w - rate * v[k] for k, w in p.items()}
        m, s = slot("m"), slot("s")
        size = rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, g in gradients.items():
            m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g**2
        return {k: w - size * m[k] / (np.sqrt(s[k]) + 1e-8) for k, w in p.items()}


# the loops


@dataclass
class Progress:
    """What a run knows at the end of an epoch, besides weights and the optimizer's memory."""

    epoch: int = 0
    rate: float = 1e-3
    l2: float = 0.005
    since: int = 0
    switches: int = 3
    stopped: bool = False
    training: list[float] = field(default_factory=list)
    validation: list[float] = field(default_factory=list)


def wants_decay(losses: list[float], since: int) -> bool:
    """Whether a history of validation losses calls for a lower rate after ``since`` epochs at the current one (see loss_flags())."""
    five, six = losses[-5:], losses[-6:]
    steps = np.sign(np.diff(six))
    approaches = len(losses) <= 5 or min(five) == min(losses)
    turns = len(losses) > 6 and bool((steps[1:] * steps[:-1] < 0).all())
    rises = len(losses) > 6 and min(five) > min(losses)
    return (since >= 6 and not approaches and turns) or (since >= 8 and rises)


def triangular_rate(step: int, half: int, low: float, high: float, mode: str = "tri", gamma: float = 0.95) -> float:
    """The cyclical rate of a step from 0 (see triangular_lr())."""
    cycle, x = (step + 1) // (2 * half + 1), (step + 1) % (2 * half + 1) / half
    top = high * {"tri": 1.0, "tri2": 0.5**cycle, "exp": gamma**cycle}[mode]
    return low + (top - low) * max(0.0, x if x <= 1 else 2 - x)


def write_blocks(rows: DataFrame, path: str) -> None:
    """Training rows (block, x, y, split) in the order of their blocks."""
    rows.repartitionByRange("block").sortWithinPartitions("block").write.mode("overwrite").partitionBy("split").parquet(path)


def save(path: str, p: Weights, optimizer: Optimizer, progress: Progress) -> None:
    data = io.BytesIO()
    memory = {f"slot:{name}:{k}": w for name, slot in optimizer.slots.items() for k, w in slot.items()}
    about = json.dumps({"progress": asdict(progress), "kind": optimizer.kind, "momentum": optimizer.momentum, "steps": optimizer.steps})
    np.savez(data, about=np.array(about), **{f"weight:{k}": w for k, w in p.items()}, **memory)
    fs, where = file_system(path)
    fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(f"{where}.new") as out:
        out.write(data.getvalue())
    fs.move(f"{where}.new", where)


def load(path: str) -> tuple[Weights, Optimizer, Progress] | None:
    data = read_all(path)
    if data is None:
        return None
    found = np.load(io.BytesIO(data), allow_pickle=False)
    about = json.loads(str(found["about"]))
    optimizer = Optimizer(about["kind"], about["momentum"], about["steps"])
    for name in found.files:
        if name.startswith("slot:"):
            _, slot, k = name.split(":", 2)
            optimizer.slots.setdefault(slot, {})[k] = found[name]
    return {n.split(":", 1)[1]: found[n] for n in found.files if n.startswith("weight:")}, optimizer, Progress(**about["progress"])


def checkpoint_path(prefix: str, epoch: int) -> str:
    return f"{prefix}-{epoch:06d}.npz"


def train(
    table: DataFrame, weights: Weights, prefix: str, epochs: int, start: Progress | None = None, optimizer: Optimizer | None = None, blocks_a_step: int = 20,
    loss: str = "focal", cyclical: tuple[int, float, float, str] | None = None, decay: float = 0.1, l2_decay: float = 1.0, seed: int = 0, resume: int | None = None,
) -> tuple[Weights, Progress]:
    """Weights and history after ``epochs`` epochs, or after the last switch of the rate.

    table: block, x, y, split (train, validation), read from write_blocks().
    cyclical: half a cycle in steps, lowest and highest rate, and mode, in place
    of the adaptive rate. resume: the epoch whose checkpoint the run goes on from.
    """
    progress, optimizer = start or Progress(), optimizer or Optimizer()
    if resume is not None:
        weights, optimizer, progress = load(checkpoint_path(prefix, resume))
    training, validation = table.where("split = 'train'"), table.where("split = 'validation'")
    n_blocks = (training.agg(F.max("block")).first()[0] or 0) + 1  # one row
    n_train = training.count()
    while progress.epoch < epochs and not progress.stopped:
        progress.epoch += 1
        total, n_steps = 0.0, -(-n_blocks // blocks_a_step)
        for step in range(n_steps):
            places = range(step * blocks_a_step, min((step + 1) * blocks_a_step, n_blocks))
            chosen = [permuted(i, n_blocks, seed * 1_000_003 + progress.epoch, back=True) for i in places]
            own = F.lit(False)
            for b in chosen:  # equalities, which the scan tests on each row group
                own = own | (F.col("block") == b)
            _, sums, gradients = table_sums(training.where(own), weights, loss)
            total += sums.sum() + progress.l2 * penalty(weights)
            gradients = {k: g if k.endswith("/b") else g + progress.l2 * weights[k] for k, g in gradients.items()}
            rate = progress.rate if cyclical is None else triangular_rate((progress.epoch - 1) * n_steps + step, *cyclical)
            weights = optimizer.move(weights, clipped(gradients), rate)
        n, sums, _ = table_sums(validation, weights, loss, gradients=False)
        progress.training.append(total / max(n_train, 1))
        progress.validation.append(float(sums.sum()) / max(n, 1))
        progress.since += 1
        if cyclical is None and wants_decay(progress.validation, progress.since):
            progress.switches -= 1
            progress.stopped = progress.switches == 0
            if not progress.stopped:
                progress.rate, progress.l2, progress.since = progress.rate * decay, progress.l2 * l2_decay, 0
        save(checkpoint_path(prefix, progress.epoch), weights, optimizer, progress)
    return weights, progress


def rate_sweep(table: DataFrame, weights: Weights, rates: list[float], steps: int = 20, most: int = 2000, loss: str = "focal", optimizer: str = "adam", seed: int = 0) -> DataFrame:
    """lr, step, loss (by row) and accuracy (of genotype bases) of short trainings, one for each rate, each a task.

    All train on one bounded sample of the table, ``most`` rows by hash.
    """
    spark = table.sparkSession
    sample = table.select("x", "y").orderBy(F.xxhash64("x", "y", F.lit(seed))).limit(most).collect()
    shared = spark.sparkContext.broadcast((np.array([r.x for r in sample], np.float32), np.array([r.y for r in sample], np.float32), weights))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .network import forward

        x, y, first = shared.value
        for frame in frames:
            for rate in frame["lr"]:
                p, opt, out = first, Optimizer(optimizer), []
                for step in range(steps):
                    sums, gradients = loss_and_gradients(x, y, p, loss)
                    accuracy = float((forward(x, p)["g"].argmax(1) == y[:, :21].argmax(1)).mean())
                    out.append((rate, step, float(sums.sum() / len(x)), accuracy))
                    p = opt.move(p, clipped(gradients), rate)
                yield pd.DataFrame(out, columns=["lr", "step", "loss", "accuracy"])

    grid = spark.createDataFrame([(r,) for r in rates], "lr double").repartition(len(rates), "lr")
    return grid.mapInPandas(run, "lr double, step long, loss double, accuracy double")
