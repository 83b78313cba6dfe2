"""Elastic-net multinomial paths of many models in shared passes.

All models of a search (groups of training rows x alphas x held-out folds) are
columns of one matrix.  A pass over the rows is one Spark job: every task
multiplies its rows with the coefficients of all models that still run and sums
up each model's loss, gradient, class curvature and the hits on the fold that
it leaves out.  Rows never move; what returns is as large as the coefficients,
whatever the number of rows.

Between passes tasks take one step per model: the free coefficients' exact
minimum of a quadratic model of the loss plus the penalty, with a check of the
optimality conditions over all columns that decides whether more become free.  The quadratic model's Hessian is that of the (group,
alpha)'s model on all rows, summed up anew every ``REFRESH`` passes, shared by
the models that leave a fold out (a slow one gets its own) and corrected by what
each model's last ``PAIRS`` moves did to its gradient; where it is wider than ``HESSIAN_BYTES`` in
all, the class curvature times the Gramian of the model's rows stands in for
it, minimised by coordinate descent on the driver.  A step that raises the objective is taken back with a stiffer model, so
every accepted step lowers it.  A model whose exact gradient meets the
optimality conditions within ``tol`` records its result and starts the next,
smaller lambda from where it is.  A model that needs one step a lambda takes the
steps for up to ``AHEAD`` lambdas at once: the same pass sums up the exact
gradient at each of them, and one counts where all before it are recorded.

Results go to a ledger as they come (:class:`Ledger`): a search that is
killed, or asked for again by another application, goes on from there.

The objective is Spark ML's: weighted mean log-loss + lambda * ((1 - alpha)/2 *
||B||^2 + alpha * ||B||_1) over standardised columns, free intercepts.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.session import python_workers

#: Part of a row outside the group, of a row the group is validated on.
OUTSIDE, VALIDATION = -2, -1
#: Held-out fold of a model that trains on all rows of its group.
NO_FOLD = -9
#: Rows of a batch that a task multiplies at a time, and numbers of them at most that it holds for each class and model.
CHUNK, CACHED = 1 << 14, 1 << 17
#: Rows that a task multiplies at a time for Hessians, and logits beyond which a row's are taken less the largest.
BLOCK, LARGE = 512, {np.float32: 80.0, np.float64: 600.0}
#: Tolerance from which on rows are multiplied in single precision.
SINGLE = 1e-6
#: Bytes of partial sums that go straight to the driver; more are first added up by tasks, in slices of so many numbers.
STRAIGHT, SLICE = 8 << 20, 1 << 16
#: Tasks whose sums of a slice are added up at once; those of more are added in two steps.
STEP = 64
#: Passes for which a Hessian serves, and bytes of all Hessians together.
REFRESH, HESSIAN_BYTES = 8, 128 << 20
#: Passes at one lambda after which a model gets a Hessian of its own, summed up anew every OFTEN passes while it is that slow.
SLOW, OFTEN = 6, 2
#: Where no more models than this still run, each has one of its own.
FEW = 40
#: Lambdas in a row that a model tries in one pass at most.
AHEAD = 4
#: Last moves of a model that correct its Hessian.
PAIRS = 6


@dataclass
class Group:
    """Training rows of a set of models: one outer fold's, or all.  ``scale``
    and ``shift`` turn the shared columns into the group's standardised ones
    (both 0: column not in the group's design)."""
    scale: np.ndarray
    shift: np.ndarray
    weights: np.ndarray         # by class
    folds: int                  # inner folds
    alphas: Sequence[float]


@dataclass
class Found:
    """Path of one (group, alpha): accuracies have one row per inner fold."""
    lambdas: list[float]
    accuracy: np.ndarray
    coefficients: list[np.ndarray] = field(default_factory=list)    # (1 + columns) x classes, standardised columns

    def curve(self) -> list[tuple[float, float, float]]:
        """(lambda, mean accuracy, sd over the folds)."""
        return [(lam, float(m), float(s)) for lam, m, s in
                zip(self.lambdas, self.accuracy.mean(axis=0), self.accuracy.std(axis=0))]

    def best(self) -> int:
        """Index of the largest lambda with the highest mean accuracy."""
        return int(np.argmax(self.accuracy.mean(axis=0)))


LEDGER = "model string, step int, lambda double, accuracy double, loss double, passes int, coefficients array<double>"


class Ledger:
    """Results of a search in a table partitioned by the search's hash, one
    row for each model and lambda.  Rows are only ever appended; of a row
    written twice (a killed run wrote it, the next one again) either serves."""

    def __init__(self, spark: SparkSession, path: str, search: str):
        self.spark, self.path, self.search = spark, path, search
        self.rows: list[dict] = []
        self.written = time.time()

    def add(self, **row) -> None:
        self.rows.append(row)

    def flush(self, seconds: float = 0.0) -> None:
        """Append what was added, at most every so many seconds."""
        if not self.rows or time.time() - self.written < seconds:
            return
        table = pa.table({n: pa.array([r[n] for r in self.rows], t) for n, t in (
            ("model", pa.string()), ("step", pa.int32()), ("lambda", pa.float64()), ("accuracy", pa.float64()),
            ("loss", pa.float64()), ("passes", pa.int32()), ("coefficients", pa.list_(pa.float64())))})
        self.spark.createDataFrame(table, LEDGER).coalesce(1).withColumn("search", F.lit(self.search)) \
            .write.mode("append").partitionBy("search").parquet(self.path)
        self.rows, self.written = [], time.time()

    def read(self) -> DataFrame | None:
        """This search's rows, None where nothing was written."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/search={self.search}")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return None
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/search={self.search}").dropDuplicates(["model", "step"])


def rows_of(df: DataFrame, id_col: str, label: Column, parts: Sequence[Column], columns: Sequence[Column]) -> DataFrame:
    """What the passes read: id, class index, part of each group (inner fold,
    ``VALIDATION`` or ``OUTSIDE``) and the shared columns."""
    return df.select(F.col(id_col).alias("id"), label.cast("int").alias("y"),
                     F.array(*[p.cast("int") for p in parts]).alias("parts"),
                     F.array(*[c.cast("double") for c in columns]).alias("x"))


def _matrices(batch: pa.RecordBatch, n_groups: int, n_columns: int):
    """(classes, parts, columns with a leading 1) of a batch, in chunks."""
    y = batch.column("y").to_numpy(zero_copy_only=False)
    parts = batch.column("parts").flatten().to_numpy(zero_copy_only=False).reshape(len(y), n_groups)
    flat = batch.column("x").flatten()
    if flat.null_count or np.isnan(x := flat.to_numpy(zero_copy_only=False).reshape(len(y), n_columns)).any():
        raise ValueError("a null in a design column: impute first")
    x = np.concatenate([np.ones((len(y), 1)), x], axis=1)
    for i in range(0, len(y), CHUNK):
        yield y[i:i + CHUNK], parts[i:i + CHUNK], x[i:i + CHUNK]


def _summed(rows: DataFrame, work, length: int) -> np.ndarray:
    """Sum over all tasks of the vector that ``work(batches)`` returns."""
    def run(batches):
        out, task = work(batches), TaskContext.get().partitionId()
        for i in range(0, length, SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([task], pa.int32()),
                                              pa.array([out[i:i + SLICE].tobytes()], pa.binary())], names=["slice", "task", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py()) for v in table["sums"])
        return table.slice(0, 1).set_column(2, "sums", pa.array([total.tobytes()], pa.binary()))

    schema = "slice int, task int, sums binary"
    sums, n = rows.mapInArrow(run, schema), rows.rdd.getNumPartitions()
    if n * length * 8 > STRAIGHT:
        if n > STEP:
            sums = sums.withColumn("task", F.col("task") % int(n ** 0.5)).groupBy("slice", "task").applyInArrow(add, schema)
        sums = sums.groupBy("slice").applyInArrow(add, schema)
    total = np.zeros(length)
    got = sums.toArrow()
    for i, v in zip(got["slice"].to_pylist(), got["sums"]):
        total[i * SLICE:(i + 1) * SLICE] += np.frombuffer(v.as_py())
    return total


def gramians(rows: DataFrame, groups: Sequence[Group], n_columns: int, n_classes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group and each inner fold: weighted Gramian of the shared
    columns (with the leading 1) and weight of each class, from one pass."""
    weights, folds = [g.weights for g in groups], [g.folds for g in groups]
    size = (n_columns + 1) ** 2 + n_classes

    def work(batches):
        total = [np.zeros((f, size)) for f in folds]
        for batch in batches:
            for y, parts, x in _matrices(batch, len(folds), n_columns):
                for g, w in enumerate(weights):
                    for f in range(folds[g]):
                        at = parts[:, g] == f
                        if at.any():
                            wy = w[y[at]]
                            total[g][f, :-n_classes] += ((x[at] * wy[:, None]).T @ x[at]).ravel()
                            total[g][f, -n_classes:] += np.bincount(y[at], wy, n_classes)
        return np.concatenate([t.ravel() for t in total])

    flat, out = _summed(rows, work, size * sum(folds)), []
    for f in folds:
        part, flat = flat[:f * size].reshape(f, size), flat[f * size:]
        out.append((part[:, :-n_classes].reshape(f, n_columns + 1, n_columns + 1), part[:, -n_classes:]))
    return out


def against_first(c: np.ndarray, kind: type) -> np.ndarray:
    """Coefficients (models x (1 + columns) x classes) less the first class's:
    (classes - 1) x models x (1 + columns).  The probabilities are the same, and
    what is summed up for the first class follows from the others."""
    return np.ascontiguousarray((c[:, :, 1:] - c[:, :, :1]).transpose(2, 0, 1), kind)


def one_pass(rows: DataFrame, asked: Sequence[tuple[int, np.ndarray, np.ndarray, np.ndarray]], n_groups: int, n_columns: int,
             n_classes: int, curved: bool = True, single: bool = False) -> list[tuple[np.ndarray, ...]]:
    """Sums for the models of each asked group.  ``asked``: (group, class
    weights, held-out fold of each model, coefficients models x (1 + columns) x
    classes, of the shared columns).  Returns per group: loss, hits on the held-out
    fold (both weighted), gradient, class curvature (zeros unless ``curved``).
    ``single``: a row's logits and probabilities have 24 bits; blocks of rows are
    added up in 53 bits, so that the means are off by some 1e-8."""
    sc, p, others, kind = rows.sparkSession.sparkContext, n_columns + 1, n_classes - 1, np.float32 if single else np.float64
    of_model = 2 + p * others + (others ** 2 if curved else 0)
    # bounded by models x design, not by rows
    told = sc.broadcast([(g, w, hold, against_first(c, kind)) for g, w, hold, c in asked])

    def work(batches):
        total = [(np.zeros(len(hold)), np.zeros(len(hold)), np.zeros((others, len(hold), p)),
                  np.zeros((len(hold) if curved else 0, others, others))) for _, _, hold, _ in told.value]
        # by group and fold: the models that leave the fold out, those that train on it, their own sums, the columns' by class
        split = {}
        for batch in batches:
            for y_all, parts, x_all in _matrices(batch, n_groups, n_columns):
                order = np.argsort(y_all, kind="stable")
                y_all, parts, x_all = y_all[order], np.ascontiguousarray(parts[order].T), x_all.astype(kind, copy=False)[order]
                for (g, w, hold, c), (loss, hits, gradient, curvature) in zip(told.value, total):
                    weights = w.astype(kind)[y_all]
                    size = max(128, CACHED // (n_classes * len(hold)))
                    for f in range(parts[g].max() + 1):
                        inside = np.flatnonzero(parts[g] == f)
                        if not len(inside):
                            continue
                        if (g, f) not in split:
                            out, own = np.flatnonzero(hold == f), np.flatnonzero(hold != f)
                            split[g, f] = (out, c[:, out].reshape(-1, p), own, c[:, own].reshape(-1, p), np.zeros(len(own)),
                                           np.zeros((others, len(own), p)), np.zeros((n_classes, p)))
                        out, c_out, own, c_own, own_loss, own_gradient, by_class = split[g, f]
                        x_in, w_in, ends = x_all[inside], weights[inside], np.searchsorted(y_all[inside], np.arange(n_classes + 1))
                        there = np.flatnonzero(np.diff(ends)).tolist()
                        by_class[there] += w[there, None] * np.add.reduceat(x_in, ends[there], axis=0, dtype=float)
                        if len(out):
                            z = (c_out @ x_in.T).reshape(others, len(out), -1)
                            for k in there:                 # ties go to the first class, whose logit is 0
                                of = z[:, :, ends[k]:ends[k + 1]]
                                hit = (of[k:] <= (of[k - 1] if k else 0.0)).all(axis=0)
                                if k:
                                    hit &= (of[k - 1] > 0) & (of[:k - 1] < of[k - 1]).all(axis=0)
                                hits[out] += w[k] * np.count_nonzero(hit, axis=1)
                        for at in range(0, len(inside) if len(own) else 0, size):
                            x, weight = x_in[at:at + size], w_in[at:at + size]
                            z = (c_own @ x.T).reshape(others, len(own), -1)
                            first = 1.0
                            if z.max(initial=0.0) > LARGE[kind]:
                                top = np.maximum(z.max(axis=0), 0)
                                z -= top
                                first = np.exp(-top)
                                own_loss += top @ weight
                            np.exp(z, out=z)
                            s = z.sum(axis=0)
                            s += first
                            own_loss += np.log(s) @ weight
                            if curved:
                                z /= s
                                zw = z * weight
                                of_class = -np.matmul(zw.transpose(1, 0, 2), z.transpose(1, 2, 0))
                                of_class[:, np.arange(others), np.arange(others)] += zw.sum(axis=2).T
                                curvature[own] += of_class
                            else:
                                zw = z
                                zw *= weight / s
                            own_gradient += (zw.reshape(-1, len(x)) @ x).reshape(own_gradient.shape)
        at_group = {g: t for (g, _, _, _), t in zip(told.value, total)}
        for (g, _), (_, _, own, c, own_loss, own_gradient, by_class) in split.items():
            loss, _, gradient, _ = at_group[g]
            loss[own] += own_loss - np.einsum("kmp,kp->m", c.reshape(own_gradient.shape).astype(float), by_class[1:])
            gradient[:, own] += own_gradient - by_class[1:, None]
        return np.concatenate([np.concatenate([a.ravel() for a in t]) for t in total])

    flat, out = _summed(rows, work, sum(len(hold) * of_model for _, _, hold, _ in asked)), []
    told.destroy()
    for _, _, hold, _ in asked:
        m = len(hold)
        part, flat = flat[:m * of_model], flat[m * of_model:]
        gradient, curvature = np.zeros((m, p, n_classes)), np.zeros((m, n_classes, n_classes))
        gradient[:, :, 1:] = part[2 * m:][:m * p * others].reshape(others, m, p).transpose(1, 2, 0)
        gradient[:, :, 0] = -gradient.sum(axis=2)
        if curved:
            curvature[:, 1:, 1:] = part[m * (2 + p * others):].reshape(m, others, others)
            curvature[:, 0, 1:] = -curvature.sum(axis=1)[:, 1:]
            curvature[:, :, 0] = -curvature.sum(axis=2)
        out.append((part[:m], part[m:2 * m], gradient, curvature))
    return out


def shrink(v: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - by, 0.0)


def penalty(b: np.ndarray, lam: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    b = b[:, 1:]
    return lam * ((1 - alpha) / 2 * (b ** 2).sum(axis=(1, 2)) + alpha * np.abs(b).sum(axis=(1, 2)))


def residual(b: np.ndarray, gradient: np.ndarray, lam: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """How far each model is from the optimality conditions: the longest
    move of a proximal gradient step of length 1."""
    l1, l2 = (lam * alpha)[:, None, None], (lam * (1 - alpha))[:, None, None]
    move = shrink(b - gradient, l1) / (1 + l2) - b
    move[:, 0] = gradient[:, 0]
    # a ridge of great weight shortens the move, not the distance from the optimum
    return np.abs(move * np.concatenate([np.ones_like(l2), np.broadcast_to(1 + l2, (len(b), b.shape[1] - 1, 1))], axis=1)).max(axis=(1, 2))


def hessians(rows: DataFrame, asked: Sequence[tuple[int, np.ndarray, np.ndarray, np.ndarray]], n_groups: int, n_columns: int,
             n_classes: int, single: bool = False) -> list[np.ndarray]:
    """Hessian of the loss of each asked model, (group, class weights, held-out
    folds, coefficients models x (1 + columns) x classes), summed over the rows
    that it trains on: models x (1 + columns) x classes x (1 + columns) x classes.
    ``single`` as in :func:`one_pass`."""
    p, others, kind = n_columns + 1, n_classes - 1, np.float32 if single else np.float64
    sc = rows.sparkSession.sparkContext
    told = sc.broadcast([(g, w, hold, against_first(c, kind)) for g, w, hold, c in asked])
    # pairs of columns and of classes: a block of two classes is the rows' products of columns, weighted
    (i, j), (k, l) = np.triu_indices(p), np.triu_indices(others)
    shapes = [(len(k), len(hold), len(i)) for _, _, hold, _ in asked]

    def work(batches):
        total = [np.zeros(shape) for shape in shapes]
        for batch in batches:
            for y_all, parts, x_all in _matrices(batch, n_groups, n_columns):
                for (g, w, hold, c), h in zip(told.value, total):
                    inside = np.flatnonzero(parts[:, g] >= 0)
                    for at in (inside[r:r + BLOCK] for r in range(0, len(inside), BLOCK)):
                        x = np.ascontiguousarray(x_all[at].T, kind)
                        z = (c.reshape(-1, p) @ x).reshape(others, len(hold), -1)
                        top = z.max(axis=0, initial=0.0)
                        z = np.exp(z - top)
                        z /= np.exp(-top) + z.sum(axis=0)
                        zw = z * (w[y_all[at]] * (parts[at, g] != hold[:, None])).astype(kind)
                        v = np.empty((len(k), *z.shape[1:]), kind)
                        for out, one, other in zip(v, k, l):
                            np.multiply(zw[one], -z[other] if one != other else 1 - z[one], out=out)
                        h += (v.reshape(-1, len(at)) @ (x[i] * x[j]).T).reshape(h.shape)
        return np.concatenate([h.ravel() for h in total])

    flat, out = _summed(rows, work, sum(int(np.prod(shape)) for shape in shapes)), []
    told.destroy()
    for shape in shapes:
        part, flat = flat[:int(np.prod(shape))].reshape(shape), flat[int(np.prod(shape)):]
        h = np.zeros((shape[1], n_classes, p, n_classes, p))
        for one, other, block in zip(k + 1, l + 1, part):
            own = np.zeros((shape[1], p, p))
            own[:, i, j] = own[:, j, i] = block
            h[:, one, :, other] = h[:, other, :, one] = own
        h[:, 0] = -h.sum(axis=1)
        h[:, :, :, 0] = -h.sum(axis=3)
        out.append(h.transpose(0, 2, 1, 4, 3))
    return out


def step(b: np.ndarray, gradient: np.ndarray, lam: np.ndarray, alpha: np.ndarray, stiff: np.ndarray, until: np.ndarray,
         bound, pull, sweeps: int = 25) -> np.ndarray:
    """Minimum of the quadratic model plus penalty for each model, by
    coordinate descent (all classes of a column at a time) over active columns;
    columns that violate the optimality conditions join until none does.  A model
    whose moves fall below ``until`` is left as it is.  ``bound(models, j)`` is the
    curvature of column j, ``pull(models, j, delta)`` what a move adds to the
    gradient."""
    l1, l2 = (lam * alpha)[:, None], (lam * (1 - alpha))[:, None]
    new, q = b.copy(), gradient.copy()
    live = np.arange(len(b))
    active = np.abs(b).max(axis=(0, 2)) > 0
    active[0] = True
    for _ in range(sweeps):
        slack = np.abs(shrink(q[live, 1:] + l2[live, None] * new[live, 1:], l1[live, None])).max(axis=2)
        still = (new[live, 1:] == 0).all(axis=2)
        active[1:] |= (still & (slack > until[live, None])).any(axis=0)
        largest = np.zeros(len(live))
        for j in np.flatnonzero(active):
            h = stiff[live, None] * bound(live, j)
            at = new[live, j]
            if j:
                to = shrink(h * at - q[live, j], l1[live]) / np.maximum(h + l2[live], 1e-300)
                to[h <= 0] = 0.0
                move = np.abs(to - at) * (h + l2[live])
            else:
                to = at - q[live, j] / np.maximum(h, 1e-300)
                move = np.abs(to - at) * h
            move = move.max(axis=1)
            if not move.any():
                continue
            largest = np.maximum(largest, move)
            new[live, j] = to
            q[live] += stiff[live, None, None] * pull(live, j, to - at)
        live = live[largest > until[live]]
        if not len(live):
            break
    return new


def newton(b: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, lam: float, alpha: float, until: float, rounds: int = 100) -> np.ndarray:
    """Minimum of one model's quadratic model plus penalty: the free
    coefficients are solved for exactly on the signs that they have, up to signs
    that would change (those become zero); then the zeros that violate the
    optimality conditions become free, until none does (one at a time where
    several make up for each other).  Each round lowers the objective, so that
    collinear columns don't slow it down."""
    k = b.shape[1]
    x, q, h = b.ravel().copy(), gradient.ravel().copy(), hessian
    l1, l2 = np.full(x.size, lam * alpha), np.full(x.size, lam * (1 - alpha))
    l1[:k] = l2[:k] = 0.0
    # above the rounding of a float32 Hessian, whose flat directions (all classes of a column) would else seem curved downwards
    ridge = l2 + 5e-7 * np.abs(np.diag(h)).max() + 1e-15
    sign = np.sign(x)
    free = (x != 0) | (l1 == 0)
    solved, single = False, False
    for _ in range(rounds):
        slope = q + l2 * x
        left = np.abs((slope + l1 * sign)[free]).max()
        if left <= until and (solved or not single):
            over = ~free & (np.abs(slope) > l1 + until)
            if not over.any():
                break
            if single:
                over &= np.abs(slope) - l1 >= (np.abs(slope) - l1)[over].max()
            free |= over
            sign[over] = -np.sign(slope[over])
        at = np.flatnonzero(free)
        own = h[np.ix_(at, at)]
        own[np.arange(len(at)), np.arange(len(at))] += ridge[at]
        d = -np.linalg.solve(own, (slope + l1 * sign)[at])
        crossed = (l1[at] > 0) & (sign[at] * (x[at] + d) < 0)
        wrong = crossed & (x[at] == 0)
        if wrong.any():                                     # became free together with another that makes up for it
            # the others are solved for first, to the last digit; from then on the worst zero becomes free by itself
            free[at[wrong]], sign[at[wrong]] = False, 0.0
            solved, single = False, True
            continue
        solved = not crossed.any()
        if crossed.any():
            # all that cross become zero where that lowers the objective, else the first of them
            all_zero = np.where(crossed, -x[at], d)
            gain = (slope + l1 * sign)[at] @ all_zero + 0.5 * all_zero @ own @ all_zero
            if gain < 0:
                d, gone = all_zero, at[crossed]
            else:
                until_zero = np.where(crossed, -x[at] / np.where(crossed, d, 1.0), 1.0)
                t = until_zero.min()
                d, gone = d * t, at[until_zero == t]
            x[at] += d
            x[gone], sign[gone], free[gone] = 0.0, 0.0, False
        else:
            x[at] += d
        q += d @ h[at]
    return x.reshape(b.shape)


def corrected(hessian: np.ndarray, pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The Hessian, changed so that it tells what the model's last moves (move,
    change of the gradient) did: BFGS updates, oldest first, which keep it
    positive definite."""
    h = hessian.copy()
    for s, y in pairs:
        hs = h @ s
        sy, shs = s @ y, s @ hs
        if sy > 1e-8 * np.sqrt((s @ s) * (y @ y)) and shs > 0:
            h += np.outer(y / sy, y) - np.outer(hs / shs, hs)
    return h


def bounded(blocks: np.ndarray) -> np.ndarray:
    """Diagonal that no curvature among the classes of a column exceeds."""
    return np.minimum(np.abs(blocks).sum(axis=-1), 2 * np.einsum("...kk->...k", blocks)) + 1e-12


def search(rows: DataFrame, groups: Sequence[Group], n_columns: int, n_classes: int, n_lambdas: int, lambda_ratio: float,
           *, tol: float = 1e-5, ledger: Ledger | None = None, flush_seconds: float = 20.0,
           log: list | None = None) -> list[dict[float, Found]]:
    """Paths of all (group, alpha, held-out fold), and of each (group, alpha)
    on all its rows.  The lambdas of a group and alpha go down from the
    smallest one with all coefficients zero on all rows of the group."""
    python_workers(rows.sparkSession)
    single = tol >= SINGLE
    gram_of, class_of = zip(*gramians(rows, groups, n_columns, n_classes))
    keys = [(g, a, f) for g, group in enumerate(groups) for a in group.alphas for f in (NO_FOLD, *range(group.folds))]
    of = np.array([g for g, _, _ in keys])
    alpha = np.array([a for _, a, _ in keys], float)
    hold = np.array([f for _, _, f in keys])
    total, gram, start = [], [], []
    for g, _, f in keys:
        u, v = np.concatenate([[1.0], groups[g].scale]), np.concatenate([[0.0], groups[g].shift])
        left = [k for k in range(groups[g].folds) if k != f]
        weight = class_of[g][left].sum(axis=0)
        m = gram_of[g][left].sum(axis=0) / max(weight.sum(), 1e-300)
        # standardised column = u * shared column + v (the leading 1 stays)
        t = np.diag(u)
        t[0, 1:] = v[1:]
        t[0, 0] = 1.0
        m = t.T @ m @ t
        total.append(max(weight.sum(), 1e-300))
        gram.append(m)
        share = np.log(np.maximum(weight / total[-1], 1e-10))
        start.append(share - share.mean())
    total, gram = np.array(total), np.array(gram)
    u, v = np.stack([g.scale for g in groups])[of], np.stack([g.shift for g in groups])[of]
    held = np.array([class_of[g][f].sum() if f >= 0 else 0.0 for g, _, f in keys])

    b = np.zeros((len(keys), n_columns + 1, n_classes))
    b[:, 0] = np.array(start)

    passes = np.zeros(len(keys), int)
    whole = {(g, a): m for m, (g, a, f) in enumerate(keys) if f == NO_FOLD}
    place = {ga: i for i, ga in enumerate(whole)}
    slot, owner = np.array([place[g, a] for g, a, _ in keys]), list(whole.values())
    exact = len(whole) * ((n_columns + 1) * n_classes) ** 2 * 8 <= HESSIAN_BYTES

    def evaluate(models: np.ndarray, at: np.ndarray):
        """Loss, accuracy on the held-out fold, gradient and curvature."""
        shared = at.copy()
        shared[:, 0] += np.einsum("mj,mjk->mk", v[models], at[:, 1:])
        shared[:, 1:] *= u[models][:, :, None]
        asked = [(int(g), groups[g].weights, hold[models[of[models] == g]], shared[of[models] == g]) for g in np.unique(of[models])]
        parts = one_pass(rows, asked, len(groups), n_columns, n_classes, not exact, single)
        loss, hits, gradient, curvature = (np.concatenate(c) for c in zip(*parts))
        w = total[models]
        gradient = gradient / w[:, None, None]
        gradient[:, 1:] = u[models][:, :, None] * gradient[:, 1:] + v[models][:, :, None] * gradient[:, :1]
        return loss / w, hits / np.maximum(held[models], 1e-300), gradient, curvature / w[:, None, None]

    names = [f"{g}:{a!r}:{f}" for g, a, f in keys]
    everyone = np.arange(len(keys))
    loss, accuracy, gradient, curvature = evaluate(everyone, b)
    top = {}
    for m, (g, a, f) in enumerate(keys):
        if f == NO_FOLD:
            top[g, a] = float(np.abs(gradient[m, 1:]).max() / max(a, 1e-3))
    grid = [[top[g, a] * (lambda_ratio ** (i / (n_lambdas - 1)) if n_lambdas > 1 else 1.0) for i in range(n_lambdas)]
            for g, a, _ in keys]
    found = [{a: Found(grid[keys.index((g, a, NO_FOLD))], np.zeros((group.folds, n_lambdas)), [None] * n_lambdas)
              for a in group.alphas} for g, group in enumerate(groups)]
    at_step = np.zeros(len(keys), int)

    def keep(m: int, k: int, acc: float, coefficients: np.ndarray) -> None:
        g, a, f = keys[m]
        if f == NO_FOLD:
            found[g][a].coefficients[k] = coefficients
        else:
            found[g][a].accuracy[f, k] = acc

    known = ledger.read() if ledger is not None else None
    if known is not None:
        by_name = {n: m for m, n in enumerate(names)}
        for r in known.orderBy("model", "step").toLocalIterator():
            m = by_name.get(r["model"])
            if m is not None and r["step"] == at_step[m]:
                b[m] = np.array(r["coefficients"]).reshape(b[m].shape)
                keep(m, r["step"], r["accuracy"], b[m].copy())
                at_step[m] += 1
        resumed = np.flatnonzero((at_step > 0) & (at_step < n_lambdas))
        if len(resumed):
            loss[resumed], accuracy[resumed], gradient[resumed], curvature[resumed] = evaluate(resumed, b[resumed])
    sc, size = rows.sparkSession.sparkContext, ((n_columns + 1) * n_classes) ** 2 * 8
    told, every_sent = {}, []                               # by slot: what its Hessian was sent with

    def refresh(models: np.ndarray, shared: bool) -> None:
        """Hessians that the models use, over standardised columns, each at its
        owner's coefficients: the ``shared`` ones and those of slow models.  A model
        that is slow on the one it shares (its own rows differ too much) gets one
        of its own, as long as there is room."""
        slow = models[passes[models] >= (1 if len(models) <= FEW else SLOW)]
        for m in slow:
            if owner[slot[m]] != m and (len(owner) + 1) * size <= HESSIAN_BYTES:
                owner.append(int(m))
                slot[m] = len(owner) - 1
        # a model's own one stays as it is while the model gets along with it
        used = set(slot[slow].tolist()) | ({i for i in slot[models].tolist() if i < len(whole)} if shared else set())
        if not used:
            return
        asked = []
        for g in np.unique(of[[owner[i] for i in used]]).tolist():
            slots = sorted(i for i in used if of[owner[i]] == g)
            m = np.array([owner[i] for i in slots])
            c = b[m].copy()
            c[:, 0] += np.einsum("mj,mjk->mk", v[m], b[m][:, 1:])
            c[:, 1:] *= u[m][:, :, None]
            asked.append((g, groups[g].weights, hold[m], c, slots))
        new = {}
        for (g, _, _, _, slots), found_h in zip(asked, hessians(rows, [a[:4] for a in asked], len(groups), n_columns, n_classes, single)):
            t = np.diag(np.concatenate([[1.0], groups[g].scale]))
            t[0, 1:] = groups[g].shift
            for i, h in zip(slots, found_h):
                # T' H T for each pair of classes
                h = np.tensordot(np.tensordot(t, h, (0, 0)), t, (2, 0)).transpose(0, 1, 3, 2) / total[owner[i]]
                h = h.reshape((n_columns + 1) * n_classes, -1)
                # the loss doesn't change with a shift of all intercepts: the steps shall not make one
                h[:n_classes, :n_classes] += np.diag(h)[:n_classes].mean() + 1e-12
                new[i] = h.astype(np.float32)               # it guides the steps only
        sent = sc.broadcast(new)                            # no more than HESSIAN_BYTES
        told.update(dict.fromkeys(new, sent))
        for old in [x for x in every_sent if not any(x is y for y in told.values())]:
            every_sent.remove(old)
            old.destroy()
        every_sent.append(sent)

    def move(models: np.ndarray, n_ahead: np.ndarray) -> np.ndarray:
        """Next coefficients of the models, from the quadratic models; of each model
        for as many lambdas in a row, one after the other."""
        far = residual(b[models], gradient[models], lam[models], alpha[models])
        if exact:
            # models of one Hessian go to one task, as far as the tasks are dealt evenly
            order, tasks = np.argsort(slot[models], kind="stable"), min(len(models), sc.defaultParallelism)
            until = np.maximum(1e-3 * far, 0.1 * tol)
            by_task = [[(int(slot[m]), b[m], gradient[m], grid[m][at_step[m]:at_step[m] + n_ahead[i]], float(alpha[m]), float(stiff[m]),
                         float(until[i]), list(pairs[m])) for i, m in zip(at, models[at])] for at in np.array_split(order, tasks)]
            sent = dict(told)

            def solve(asked):
                out = []
                for i, x, g, lams, a, s, u, moved in asked:
                    h = s * corrected(sent[i].value[i].astype(float), moved)
                    for one in lams:
                        new = newton(x, g, h, one, a, u)
                        x, g, u = new, g + (h @ (new - x).ravel()).reshape(g.shape), 0.1 * tol
                        out.append(new)
                return out

            got = iter([x for part in sc.parallelize(by_task, tasks).map(solve).collect() for x in part])   # as large as the coefficients
            new = [None] * len(models)
            for i in order:
                new[i] = [next(got) for _ in range(n_ahead[i])]
            return np.array([x for own in new for x in own])
        g_, c_ = gram[models], curvature[models]
        of_class = bounded(c_)

        def bound(live, j):
            return g_[live, j, j][:, None] * of_class[live]

        def pull(live, j, delta):
            return g_[live, :, j][:, :, None] * np.einsum("mkl,ml->mk", c_[live], delta)[:, None, :]
        return step(b[models], gradient[models], lam[models], alpha[models], stiff[models], np.maximum(0.03 * far, 0.1 * tol), bound, pull)

    stiff = np.ones(len(keys))
    pairs = [deque(maxlen=PAIRS) for _ in keys]
    lam = np.array([grid[m][min(at_step[m], n_lambdas - 1)] for m in everyone])
    running = at_step < n_lambdas
    # lambdas that a model's next pass tries and could try, passes in a row that went all the way, and how many raise the first
    ahead, could, streak, need = np.ones(len(keys), int), np.ones(len(keys)), np.zeros(len(keys), int), np.ones(len(keys), int)

    def record(models: np.ndarray) -> None:
        """Results that meet the optimality conditions are recorded; the same
        coefficients may serve several lambdas."""
        while len(models):
            models = models[residual(b[models], gradient[models], lam[models], alpha[models]) <= tol]
            for m in models:
                keep(m, at_step[m], accuracy[m], b[m].copy())
                if ledger is not None:
                    ledger.add(model=names[m], step=int(at_step[m]), accuracy=float(accuracy[m]), loss=float(loss[m]),
                               passes=int(passes[m]), coefficients=b[m].ravel(), **{"lambda": float(lam[m])})
                passes[m] = 0
                at_step[m] += 1
                if at_step[m] < n_lambdas:
                    lam[m] = grid[m][at_step[m]]
                else:
                    running[m] = False
            models = models[running[models]]

    def accept(models: np.ndarray, k: int, trial: np.ndarray, t_loss: np.ndarray, t_accuracy: np.ndarray, t_gradient: np.ndarray,
               t_curvature: np.ndarray) -> np.ndarray:
        """Take the steps (for the lambda after ``k`` others) that lower the objective; which don't."""
        # what the quadratic models leave grows with the square of the lambdas gone
        far = residual(trial, t_gradient, lam[models], alpha[models])
        could[models] = np.minimum((k + 1) * np.sqrt(0.8 * tol / np.maximum(far, 1e-300)), AHEAD if exact else 1)
        if exact:
            for i, m in enumerate(models):
                pairs[m].append(((trial[i] - b[m]).ravel(), (t_gradient[i] - gradient[m]).ravel()))
        before = loss[models] + penalty(b[models], lam[models], alpha[models])
        after = t_loss + penalty(trial, lam[models], alpha[models])
        if single:
            # of a short move the gradients at both ends tell the rise, which the rounding of the sums would hide
            short = np.abs(t_loss - loss[models]) < 1e-3 * np.abs(loss[models])
            rise = (0.5 * (t_gradient + gradient[models]) * (trial - b[models])).sum(axis=(1, 2))
            after[short] += (loss[models] + rise - t_loss)[short]
        # rounding may hide the last gains: then the gradient decides
        worse = after > before + (1e-9 if single else 1e-12) * np.abs(before)
        worse &= stiff[models] < 1e6
        good = models[~worse]
        b[good], loss[good], accuracy[good] = trial[~worse], t_loss[~worse], t_accuracy[~worse]
        gradient[good], curvature[good] = t_gradient[~worse], t_curvature[~worse]
        return worse

    record(everyone[running])
    n_passes = 0
    while True:
        if ledger is not None:
            ledger.flush(flush_seconds if running.any() else 0.0)
        models = np.flatnonzero(running)
        if not len(models):
            break
        if exact and n_passes % OFTEN == 0:
            refresh(models, n_passes % REFRESH == 0)
        n_ahead, first = np.minimum(ahead[models], n_lambdas - at_step[models]), at_step[models]
        trial = move(models, n_ahead)
        tried = evaluate(np.repeat(models, n_ahead), trial)
        n_passes += 1
        passes[models] += 1
        at = np.cumsum(n_ahead) - n_ahead                   # a model's first trial
        worse = accept(models, 0, trial[at], *(x[at] for x in tried))
        good = models[~worse]
        stiff[good] = np.maximum(stiff[good] * 0.8, 1.0)
        stiff[models[worse]] *= 2.0
        record(good)
        # a trial for a later lambda counts where all before it are recorded
        useful = np.where(worse, 1, n_ahead)
        for k in range(1, n_ahead.max()):
            there = np.flatnonzero((useful > k) & running[models])
            useful[there[at_step[models[there]] < first[there] + k]] = k
            there = there[at_step[models[there]] == first[there] + k]
            if len(there):
                failed = accept(models[there], k, trial[at[there] + k], *(x[at[there] + k] for x in tried))
                useful[there[failed]] = k
                record(models[there[~failed]])
        gone = at_step[models] - first
        all_the_way = gone >= n_ahead
        streak[models] = np.where(all_the_way, streak[models] + 1, 0)
        need[models] = np.where(all_the_way, np.maximum(need[models] // np.where(n_ahead > 1, 2, 1), 1), np.minimum(2 * need[models], 8))
        more = all_the_way & (streak[models] >= need[models]) & (could[models] >= n_ahead + 1)
        ahead[models] = np.where(all_the_way, np.minimum(n_ahead + more, AHEAD), np.maximum(gone, 1))
        streak[models[more]] = 0
        if log is not None:
            log.append((len(trial), int(worse.sum()), int(at_step.min())))
    for sent in every_sent:
        sent.destroy()
    return found


def predictions(rows: DataFrame, chosen: Sequence[tuple[int, float, np.ndarray]], classes: Sequence[str], n_groups: int,
                n_columns: int, id_type: str) -> DataFrame:
    """(group, alpha, id, actual, predicted) of each chosen model on its group's
    validation rows; ``chosen`` has coefficients of the shared columns."""
    named = pa.array(list(classes), pa.string())

    def run(batches):
        for batch in batches:
            at = 0
            for y, parts, x in _matrices(batch, n_groups, n_columns):
                for g, alpha, c in chosen:
                    rows_ = np.flatnonzero(parts[:, g] == VALIDATION)
                    if len(rows_):
                        best = (x[rows_] @ c).argmax(axis=1)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows_), g, np.int32)), pa.array(np.full(len(rows_), alpha)),
                             batch.column("id").take(pa.array(rows_ + at)), named.take(pa.array(y[rows_])), named.take(pa.array(best))],
                            names=["group", "alpha", "id", "actual", "predicted"])
                at += len(y)

    return rows.mapInArrow(run, f"group int, alpha double, id {id_type}, actual string, predicted string")


def shared_coefficients(group: Group, b: np.ndarray) -> np.ndarray:
    """Coefficients of the shared columns from those of the standardised."""
    c = b.copy()
    c[0] += group.shift @ b[1:]
    c[1:] *= group.scale[:, None]
    return c
