"""Evaluation and training-history operators on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import argmax

TINY = 1e-15


def confusion(rows: DataFrame, task: str = "task") -> DataFrame:
    """task, truth, pred, n."""
    return rows.groupBy(task, "truth", "pred").agg(F.count("*").alias("n"))


def sorted_lengths(rows: DataFrame) -> DataFrame:
    """Truth and prediction pairs of lengths, each sorted, as two tasks: t1, t2, p1, p2 in."""
    pair = lambda name, f: F.struct(F.lit(name).alias("task"), f("t1", "t2").alias("truth"), f("p1", "p2").alias("pred"))
    return rows.select(F.explode(F.array(pair("length_1", F.least), pair("length_2", F.greatest))).alias("x")).select("x.*")


def f1_by_class(matrix: DataFrame) -> DataFrame:
    """task, cls, precision, recall, f1 of each class of a long confusion matrix."""
    sides = lambda c: matrix.groupBy("task", F.col(c).alias("cls"))
    row, col = sides("truth").agg(F.sum("n").alias("in_truth")), sides("pred").agg(F.sum("n").alias("in_pred"))
    hit = matrix.where("truth = pred").select("task", F.col("truth").alias("cls"), F.col("n").alias("hit"))
    rows = row.join(col, ["task", "cls"], "full").join(hit, ["task", "cls"], "left").na.fill(0)
    rows = rows.withColumn("precision", F.col("hit") / (F.col("in_pred") + F.lit(TINY))).withColumn("recall", F.col("hit") / (F.col("in_truth") + F.lit(TINY)))
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(TINY))
    return rows.select("task", "cls", "precision", "recall", f1.alias("f1"))


def top_k(rows: DataFrame, k: int = 2) -> DataFrame:
    """top1, topk accuracy of rows with truth and the array scores; equal scores rank by class."""
    ranks = F.transform(F.array_sort(F.transform("scores", lambda s, i: F.struct((-s).alias("m"), i.alias("i")))), lambda x: x["i"])
    hit = lambda n: F.avg(F.array_contains(F.slice("ranks", 1, n), F.col("truth")).cast("double"))
    return rows.withColumn("ranks", ranks).agg(F.count("*").alias("n"), hit(1).alias("top1"), hit(k).alias("topk"))


def mean_task_accuracy(rows: DataFrame) -> DataFrame:
    """Mean over tasks of each task's accuracy, by step: step, task, truth, pred in."""
    each = rows.groupBy("step", "task").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"))
    return each.groupBy("step").agg(F.avg("accuracy").alias("accuracy"))


def accuracy_steps(history: DataFrame, run: str = "run") -> DataFrame:
    """run, step, lr, accuracy, diff to the run's step before."""
    return history.withColumn("diff", F.col("accuracy") - F.lag("accuracy").over(Window.partitionBy(run).orderBy("step")))


def learning_rate_bounds(steps: DataFrame, run: str = "run") -> DataFrame:
    """run, low_lr, high_lr: rates of the largest rise and fall of accuracy, the first of equal ones, in ascending order."""
    by = lambda step: F.when(F.col("diff").isNotNull(), F.struct("diff", step.alias("at")))
    found = steps.groupBy(run).agg(F.max_by("lr", by(-F.col("step"))).alias("a"), F.min_by("lr", by(F.col("step"))).alias("b"))
    return found.select(run, F.least("a", "b").alias("low_lr"), F.greatest("a", "b").alias("high_lr"))


def epoch_losses(batches: DataFrame) -> DataFrame:
    """run, epoch, phase, loss by example, and examples; batches: run, epoch, phase, loss (a batch's sum), examples."""
    return batches.groupBy("run", "epoch", "phase").agg((F.sum("loss") / F.sum("examples")).alias("loss"), F.sum("examples").alias("examples"))


def loss_flags(history: DataFrame, run: str = "run") -> DataFrame:
    """run, epoch, loss and what the history up to each epoch shows.

    approaches: the least loss is among the last five, or there are five at
    most. oscillates: the last six turn at every step. rises: the last five are
    all above the least loss; both need more than six epochs.
    """
    w = Window.partitionBy(run).orderBy("epoch")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    n, least = F.count("*").over(upto), F.min("loss").over(upto)
    back = [F.lag("loss", i).over(w) for i in range(6)]
    five = F.min("loss").over(w.rowsBetween(-4, 0))
    ways = [F.signum(back[i] - back[i + 1]) for i in range(5)]
    turns = F.lit(True)
    for a, b in zip(ways, ways[1:], strict=False):
        turns = turns & (a * b < 0)
    long = n > 6
    return history.select(run, "epoch", "loss", ((n <= 5) | (five == least)).alias("approaches"), (long & F.coalesce(turns, F.lit(False))).alias("oscillates"), (long & (five > least)).alias("rises"))


def adaptive_rates(flags: DataFrame, run: str = "run", rate: float = 1e-3, decay: float = 0.1, switches: int = 3) -> DataFrame:
    """run, epoch, rate (in use in that epoch), switched, stopped: the rate decays after epochs that call for it, and the last switch stops the run.

    An epoch calls for it if six epochs or more went by at the current rate,
    losses oscillate and no longer approach the minimum, or eight did and they
    rise. flags: what loss_flags() gives; one run's epochs are folded in one
    array, some hundred of them.
    """
    each = F.array_sort(F.collect_list(F.struct("epoch", "approaches", "oscillates", "rises")))
    start = F.struct(F.lit(0).alias("since"), F.lit(switches).alias("left"), F.lit(rate).alias("rate"), F.array().cast("array<struct<epoch:bigint,rate:double,switched:boolean,stopped:boolean>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        since = state["since"] + 1
        called = ((since >= 6) & ~x["approaches"] & x["oscillates"]) | ((since >= 8) & x["rises"])
        left = state["left"] - called.cast("int")
        row = F.struct(x["epoch"].cast("long").alias("epoch"), state["rate"].alias("rate"), called.alias("switched"), (left == 0).alias("stopped"))
        done = state["left"] == 0
        return F.struct(
            F.when(called, 0).otherwise(since).alias("since"), F.when(done, 0).otherwise(left).alias("left"),
            F.when(called & (left > 0), state["rate"] * decay).otherwise(state["rate"]).alias("rate"), F.when(done, state["out"]).otherwise(F.concat(state["out"], F.array(row))).alias("out"),
        )

    folded = flags.groupBy(run).agg(each.alias("epochs")).select(run, F.aggregate("epochs", start, step, lambda x: x["out"]).alias("out"))
    return folded.select(run, F.inline("out"))


def total_loss(losses: DataFrame, task_weights: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0, 1.0), squares: float = 0.0, l2: float = 0.0) -> DataFrame:
    """batch, total: the weighted sum of a batch's four task losses and of the weights' penalty; losses: batch and g, z, u, v by example.

    squares: half the sum of squares of the network's weights, biases aside.
    """
    tasks = sum((F.sum(k) * w for k, w in zip(("g", "z", "u", "v"), task_weights, strict=False)), F.lit(0.0))
    return losses.groupBy("batch").agg((tasks + F.lit(task_weights[4] * squares * l2)).alias("total"))


def evaluate(rows: DataFrame) -> DataFrame:
    """task, metric, truth, pred, value of predictions against labels, long.

    rows: gt21, zyg, len1, len2 (labels) and arrays g, z, u, v of probabilities.
    Metrics: n (confusion counts), precision, recall and f1 by class (truth),
    and for the genotype bases all, top1 and top2 counts. Lengths are compared
    as ascending pairs.
    """
    best = rows.select("gt21", "zyg", F.col("len1").alias("t1"), F.col("len2").alias("t2"), *(argmax(F.col(k)).alias(k) for k in "gzuv"))
    pair = lambda name, truth, pred: F.struct(F.lit(name).alias("task"), truth.cast("int").alias("truth"), pred.cast("int").alias("pred"))
    tasks = F.array(
        pair("gt21", F.col("gt21"), F.col("g")), pair("zyg", F.col("zyg"), F.col("z")),
        pair("length_1", F.least("t1", "t2"), F.least("u", "v")), pair("length_2", F.greatest("t1", "t2"), F.greatest("u", "v")),
    )
    matrix = confusion(best.select(F.inline(tasks)))
    none = F.lit(None).cast("int")
    counts = matrix.select("task", F.lit("n").alias("metric"), "truth", "pred", F.col("n").cast("double").alias("value"))
    scores = f1_by_class(matrix).select("task", F.expr("stack(3, 'precision', precision, 'recall', recall, 'f1', f1) as (metric, value)"), "cls")
    scores = scores.select("task", "metric", F.col("cls").alias("truth"), none.alias("pred"), "value")
    # of equal probabilities the later class ranks first here
    place = F.size(F.filter(F.transform("g", lambda p, i: (p > F.get("g", F.col("gt21"))) | ((p == F.get("g", F.col("gt21"))) & (i > F.col("gt21")))), lambda x: x))
    hits = rows.agg(F.count("*").alias("all"), F.count_if(place == 0).alias("top1"), F.count_if(place <= 1).alias("top2"))
    hits = hits.select(F.lit("gt21").alias("task"), F.expr("stack(3, 'all', all, 'top1', top1, 'top2', top2) as (metric, value)"))
    return counts.unionByName(scores).unionByName(hits.select("task", "metric", none.alias("truth"), none.alias("pred"), F.col("value").cast("double").alias("value")))


def best_epoch(history: DataFrame, run: str = "run") -> DataFrame:
    """Each run's epoch of least loss, the earlier of equal ones."""
    return history.groupBy(run).agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("epoch"), F.min("loss").alias("loss"))
