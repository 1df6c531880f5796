"""Many models in shared passes: every (feature set, held-out fold, class) problem is fitted by the same few jobs.

All models are linear in some features with an L2 penalty (half the squared weights against C times the summed loss, the
constant unpenalised) and are fitted by damped Newton steps. One step of *all* problems is one aggregate over the rows:
a task adds up loss, gradient and Hessian of every problem in numpy, the sums are added by problem, and the driver solves the
small systems. The number of jobs is the number of steps, whatever the number of configurations, folds and classes.

Losses: logistic, hinge (support vector classification), epsilon-insensitive (support vector regression) and squared.
The two kinks are rounded by a parabola of width ``delta``, narrowed in stages with warm starts; the optimum of the rounded
problem is within n C delta / 2 of the exact one. ``Fit.gradient`` is the certificate: the largest gradient entry per unit of
C n, zero at the optimum.

Features are scaled with the training rows' mean and population deviation. A radial (RBF) kernel is added by landmarks
(Nystrom): rows with the smallest hash of their key stand for the kernel's span; with at least as many landmarks as
training rows the map is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import stable_hash
from ..functions.sizing import TooLargeError, collect_bounded
from ..functions.vectors import vector_sum

#: Largest gradient entry, per unit of C times rows, at which a problem counts as solved.
TOLERANCE = 1e-8
#: The same for the stages that only give a start.
START_TOLERANCE = 1e-3
MAX_STEPS = 200
#: Doubles that all problems' sums may take together on the driver.
MAX_CELLS = 40_000_000
#: Widths of the rounded kinks, in order. A wide first stage gives the narrow one a start.
DELTAS = (1.0, 0.2, 0.05)
#: Shares of a step whose losses a pass gives along with the whole step's.
SHARES = (0.7, 0.5, 0.35, 0.25, 0.12, 0.06, 0.03, 0.01, 0.003)
#: Rows of a fold, and doubles of all fits' rows, over which a kernel machine's descent finds its start.
START_ROWS, START_CELLS = 1024, 2_000_000
#: Rows handed to numpy at a time.
BLOCK = 2048


@dataclass(frozen=True)
class Loss:
    """value, first and second derivative by the score z; ``kinked`` losses are rounded by delta."""

    name: str
    c: float = 1.0
    epsilon: float = 0.1

    @property
    def kinked(self) -> bool:
        return self.name in ("hinge", "insensitive")

    @property
    def regression(self) -> bool:
        return self.name in ("squared", "insensitive")

    def at(self, z: np.ndarray, y: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.name == "logistic":
            m = y * z
            p = 0.5 * (1.0 - np.tanh(0.5 * m))  # of the wrong side, without overflow
            return np.logaddexp(0.0, -m), -y * p, p * (1.0 - p)
        if self.name == "squared":
            r = z - y
            return 0.5 * r * r, r, np.ones_like(r)
        if self.name == "hinge":
            u, sign = 1.0 - y * z, -y
        elif self.name == "insensitive":
            r = z - y
            u, sign = np.abs(r) - self.epsilon, np.sign(r)
        else:
            raise ValueError(self.name)
        inside = (u > 0) & (u < delta)
        value = np.where(u <= 0, 0.0, np.where(inside, u * u / (2 * delta), u - delta / 2))
        return value, sign * np.where(u <= 0, 0.0, np.where(inside, u / delta, 1.0)), inside / delta


@dataclass
class Fit:
    """One feature set under one held-out fold: scaling, kernel map, and the weights of its problems (constant last)."""

    features: str
    held: int
    n_train: int
    mean: np.ndarray
    scale: np.ndarray
    target_mean: float = 0.0
    landmarks: np.ndarray | None = None
    kernel_root: np.ndarray | None = None
    gamma: float = 0.0
    sides: list[tuple[int, int | None]] = field(default_factory=list)  # (class, rest or other class); empty for regression
    weights: np.ndarray | None = None  # problems x (features + 1)
    gradient: float = float("inf")
    loss: float = 0.0

    def map(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) / self.scale
        if self.landmarks is not None:
            x = radial(x, self.landmarks, self.gamma) @ self.kernel_root
        return np.hstack([x, np.ones((len(x), 1))])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Class numbers (one class against the rest: highest score; pairs: most votes; ties to the lower class) or values."""
        z = self.map(x) @ self.weights.T
        if not self.sides:
            return z[:, 0]
        classes = 1 + max(max(a, b or 0) for a, b in self.sides)
        if self.sides[0][1] is None:
            scores = np.full((len(x), classes), -np.inf)
            scores[:, [a for a, _ in self.sides]] = z
            return scores.argmax(axis=1).astype(float)
        votes = np.zeros((len(x), classes))
        for k, (a, b) in enumerate(self.sides):
            np.add.at(votes, (np.arange(len(x)), np.where(z[:, k] > 0, a, b)), 1)
        return votes.argmax(axis=1).astype(float)


def radial(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2.0 * (x @ z.T)
    return np.exp(-gamma * np.clip(d2, 0.0, None))


def _blocks(batches, sets: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """(features by set, targets, folds) of blocks of rows, as matrices."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            b = whole.slice(at, BLOCK)
            n = b.num_rows
            x = {s: np.asarray(b.column(s).flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) for s in sets}
            yield x, b.column("_y").to_numpy(zero_copy_only=False), b.column("_fold").to_numpy(zero_copy_only=False)


def _scalings(rows: DataFrame, sets: list[str], held: list[int], scale: bool) -> list[Fit]:
    """Mean and population deviation of every set's training rows, from one aggregate per fold; merged on the driver."""
    stats = Summarizer.metrics("count", "mean", "variance")
    per_fold = rows.groupBy("_fold").agg(F.count("*").alias("n"), F.avg("_y").alias("y"), *[stats.summary(array_to_vector(s)).alias(s) for s in sets])
    parts = collect_bounded(per_fold, 10_000, "fold moments")
    out = []
    for s in sets:
        for h in held:
            n, m, m2, y = 0, 0.0, 0.0, 0.0
            for p in parts:
                if p["_fold"] == h:
                    continue
                k, mean, var = p["n"], p[s]["mean"].toArray(), p[s]["variance"].toArray()
                gap = mean - m
                m2 = m2 + var * max(k - 1, 0) + gap * gap * n * k / (n + k)
                m, y, n = m + gap * k / (n + k), y + (p["y"] - y) * k / (n + k), n + k
            if not n:
                raise ValueError(f"no training rows for fold {h}")
            sd = np.sqrt(m2 / n)
            sd = np.where(sd > 0, sd, 1.0) if scale else np.ones_like(sd)
            out.append(Fit(s, h, n, m if scale else np.zeros_like(sd), sd, y))
    return out


def _add_kernel(rows: DataFrame, fits: list[Fit], landmarks: int, seed: int) -> list:
    """Landmarks of every fit: the ``landmarks`` training rows with the smallest key hash. Returns the rows fetched, in that order.

    Of every fold so many are fetched, or more, up to ``START_ROWS``, for ``_start``.
    """
    sets = sorted({f.features for f in fits})
    order = [stable_hash("_key", seed), F.col("_key")]
    most = max(landmarks, min(START_ROWS, START_CELLS // sum(len(f.mean) for f in fits)))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_fold").orderBy(*order))).filter(F.col("_rank") <= most)
    found = collect_bounded(ranked.select("_fold", "_y", order[0].alias("_h"), "_key", *sets), 1_000_000, "landmark candidates")
    found.sort(key=lambda r: (r["_h"], r["_key"]))
    for f in fits:
        z = np.array([r[f.features] for r in found if r["_fold"] != f.held][:landmarks], float)
        z = (z - f.mean) / f.scale
        spread = float(np.var(z)) or 1.0
        f.gamma = 1.0 / (z.shape[1] * spread)
        f.landmarks = z
        value, vector = np.linalg.eigh(radial(z, z, f.gamma))
        keep = value > value.max() * 1e-10
        f.kernel_root = vector[:, keep] / np.sqrt(value[keep])
    return found


def _signs(y: np.ndarray, sides: list[tuple[int, int | None]]) -> np.ndarray:
    """+1 / -1 per row and problem, 0 where a row takes no part."""
    return np.stack([np.where(y == a, 1.0, -1.0 if b is None else np.where(y == b, -1.0, 0.0)) for a, b in sides], axis=1)


def _add_sums(at: np.ndarray, phi: np.ndarray, target: np.ndarray, sides: list[tuple[int, int | None]], points: np.ndarray, loss: Loss, delta: float) -> None:
    """Add the rows' sums to ``at``: per problem the losses between its points, then loss, gradient and upper Hessian at the second.

    ``points`` is problems x 2 x features: the best weights and the trial weights.
    """
    d = phi.shape[1]
    signs = _signs(target, sides) if sides else target[:, None]
    part = signs != 0 if sides else np.ones(signs.shape, bool)
    own = signs[part]  # a row meets only the problems it takes part in
    base, end = (phi @ points[:, i].T for i in (0, 1))
    base, end = base[part], end[part]
    whole = np.zeros(signs.shape)
    for i, share in enumerate(SHARES):
        whole[part] = loss.at(base + share * (end - base), own, delta)[0]
        at[:, i] += whole.sum(axis=0)
    value, first, second = (np.zeros(signs.shape) for _ in range(3))
    value[part], first[part], second[part] = loss.at(end, own, delta)
    at[:, len(SHARES)] += value.sum(axis=0)
    at[:, len(SHARES) + 1 : len(SHARES) + 1 + d] += first.T @ phi
    upper = np.triu_indices(d)
    for j in range(len(points)):
        weighted = second[:, j] > 0
        p = phi[weighted]
        at[j, len(SHARES) + 1 + d :] += ((p.T * second[weighted, j]) @ p)[upper]


def _pass(rows: DataFrame, fits: list[Fit], points: dict[int, np.ndarray], open_: dict[int, list[int]], loss: Loss, delta: float) -> dict[int, np.ndarray]:
    """The sums of the open problems of every fit (see ``_add_sums``): one job."""
    sets = sorted({fits[k].features for k in open_})
    slim = {k: replace(fits[k], weights=None) for k in open_}
    shared = rows.sparkSession.sparkContext.broadcast((slim, points))

    def run(batches):
        fits, points = shared.value
        sums: dict[int, np.ndarray] = {}
        for x, y, fold in _blocks(batches, sets):
            for k, f in fits.items():
                use = fold != f.held
                if not use.any():
                    continue
                phi = f.map(x[f.features][use])
                d = phi.shape[1]
                at = sums.setdefault(k, np.zeros((len(points[k]), len(SHARES) + 1 + d + d * (d + 1) // 2)))
                sides = [f.sides[j] for j in open_[k]] if f.sides else []
                _add_sums(at, phi, y[use] if f.sides else y[use] - f.target_mean, sides, points[k], loss, delta)
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.ravel()], pa.list_(pa.float64()))], names=["k", "v"])

    added = rows.select("_y", "_fold", *sets).mapInArrow(run, "k int, v array<double>").groupBy("k").agg(vector_sum("v").alias("v"))
    found = added.toArrow()  # one row a fit, sized by MAX_CELLS
    out = {k: np.asarray(v.values).reshape(len(open_[k]), -1) for k, v in zip(found["k"].to_pylist(), found["v"], strict=True)}
    shared.unpersist()
    return out


class _Problem:
    """One problem's descent: the best weights with their gradient and Hessian, the step from there and a damping.

    A pass gives the loss at several shares of the step. Where a share does clearly better than the whole step, the step is cut to it;
    where none does better than the best weights, the damping grows.
    """

    def __init__(self, weights: np.ndarray, penalty: np.ndarray, unit: float):
        self.best, self.trial, self.penalty, self.unit = weights.copy(), weights.copy(), penalty, unit
        self.value, self.worst, self.damping, self.cut = np.inf, np.inf, 0.0, False

    def points(self) -> np.ndarray:
        return np.stack([self.best, self.trial])

    def take(self, sums: np.ndarray, c: float) -> None:
        """Judge the trial weights by their sums (losses of the shares, loss, gradient, upper Hessian) and set the next trial."""
        w, d, n = self.trial, len(self.trial), len(SHARES)
        objective = lambda at, v: c * at + 0.5 * (self.penalty * v) @ v
        now = objective(sums[n], w)
        ways = [objective(at, self.best + share * (w - self.best)) for at, share in zip(sums, SHARES, strict=False)]
        least = int(np.argmin(ways))
        noise = 1e-13 * abs(now)
        fell = now <= self.value + noise
        if not self.cut and ways[least] < self.value - noise and not (fell and (self.value - now >= 0.5 * (self.value - ways[least]) or now <= ways[least] + noise)):
            self.trial, self.cut = self.best + SHARES[least] * (w - self.best), True
            return
        self.cut = False
        if fell:
            hess = np.zeros((d, d))
            hess[np.triu_indices(d)] = c * sums[n + 1 + d :]
            self.hess = hess + np.triu(hess, 1).T + np.diag(self.penalty)
            self.grad = c * sums[n + 1 : n + 1 + d] + self.penalty * w
            self.best, self.value = w, now
            self.worst = np.abs(self.grad).max() / self.unit
            self.damping = self.damping / 10 if self.damping > 1e-9 * self.unit else 0.0
        else:
            self.damping = max(10 * self.damping, 1e-6 * self.unit)
        damped = self.hess + self.damping * np.eye(d)
        try:
            step = np.linalg.solve(damped, self.grad)
        except np.linalg.LinAlgError:
            step = np.linalg.lstsq(damped, self.grad, rcond=1e-12)[0]
        self.trial = self.best - step


def _problems(f: Fit, loss: Loss) -> list[_Problem]:
    penalty = np.full(f.weights.shape[1], 0.0 if loss.name == "squared" else 1.0)
    penalty[-1] = 0.0
    return [_Problem(w, penalty, loss.c * f.n_train) for w in f.weights]


def _start(rows: DataFrame, found: list, fits: list[Fit], loss: Loss, most: int = 8) -> None:
    """First weights of every problem: its solution over the fetched rows alone, some problems a task.

    Only where the descent over all rows begins; that ends at the same weights from anywhere.
    """
    sets = sorted({f.features for f in fits})
    fold, y = np.array([r["_fold"] for r in found]), np.array([r["_y"] for r in found], float)
    x = {s: np.array([r[s] for r in found], float) for s in sets}
    parts = [(k, j, min(j + most, len(f.weights))) for k, f in enumerate(fits) for j in range(0, len(f.weights), most)]
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((fits, parts, x, y, fold))

    def run(batches):
        fits, parts, x, y, fold = shared.value
        for b in batches:
            for part in b.column(0).to_pylist():
                k, lo, hi = parts[part]
                f = fits[k]
                use = fold != f.held
                phi, target = f.map(x[f.features][use]), y[use] if f.sides else y[use] - f.target_mean
                c = loss.c * f.n_train / len(phi)  # the rows stand for all training rows
                work = _problems(f, loss)[lo:hi]
                for delta in DELTAS:
                    work = [_Problem(p.best, p.penalty, p.unit) for p in work]
                    for _ in range(MAX_STEPS):
                        left = [j for j, p in enumerate(work) if p.worst > (TOLERANCE if delta == DELTAS[-1] else START_TOLERANCE)]
                        if not left:
                            break
                        sums = np.zeros((len(left), len(SHARES) + 1 + phi.shape[1] + phi.shape[1] * (phi.shape[1] + 1) // 2))
                        _add_sums(sums, phi, target, [f.sides[lo + j] for j in left] if f.sides else [], np.stack([work[j].points() for j in left]), loss, delta)
                        for j, row in zip(left, sums, strict=True):
                            work[j].take(row, c)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.concatenate([p.best for p in work])], pa.list_(pa.float64()))], names=["part", "w"])

    # one row a task: every part has its own
    solved = spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, "part int, w array<double>").toArrow()
    for part, w in zip(solved["part"].to_pylist(), solved["w"], strict=True):
        k, lo, hi = parts[part]
        fits[k].weights[lo:hi] = np.asarray(w.values).reshape(hi - lo, -1)
    shared.unpersist()


def _solve(rows: DataFrame, fits: list[Fit], loss: Loss, delta: float, tolerance: float = TOLERANCE) -> int:
    """Damped Newton steps of all fits until each problem's gradient is within ``tolerance``; returns the passes used."""
    work = [_problems(f, loss) for f in fits]
    open_ = {k: list(range(len(ps))) for k, ps in enumerate(work)}
    for passes in range(1, MAX_STEPS + 1):
        sums = _pass(rows, fits, {k: np.stack([work[k][j].points() for j in js]) for k, js in open_.items()}, open_, loss, delta)
        for k, js in open_.items():
            for j, row in zip(js, sums[k], strict=True):
                work[k][j].take(row, loss.c)
            fits[k].weights = np.stack([p.best for p in work[k]])
            fits[k].gradient, fits[k].loss = float(max(p.worst for p in work[k])), float(sum(p.value for p in work[k]))
        # a solved problem takes no part in later passes; a quadratic is solved by one step, what is left of its gradient is rounding
        open_ = {k: left for k, js in open_.items() if (left := [j for j in js if work[k][j].worst > tolerance])}
        if loss.name == "squared" and passes >= 3:
            open_ = {}
        if not open_:
            return passes
    raise RuntimeError(f"{len(open_)} fits are not solved after {MAX_STEPS} steps")


def fit_many(df: DataFrame, sets: list[str], target: str, fold: str, held: list[int], loss: Loss, key: str | None = None, classes: int = 0,
             pairs: bool = False, scale: bool = True, landmarks: int = 0, seed: int = 11) -> tuple[DataFrame, list[Fit]]:
    """(prepared rows, one ``Fit`` per feature set and held-out fold). ``target`` is a class number 0..classes-1 or a value.

    A fit's training rows are those of the other folds; fold -1 is never held out. Rows with a null target, fold or feature
    array take no part. ``pairs``: one problem per pair of classes instead of one per class.
    """
    known = F.lit(True)
    for c in (target, fold, *sets):
        known = known & F.col(c).isNotNull()
    rows = df.filter(known).select(
        *([F.col(key).alias("_key")] if key else []), F.col(target).cast("double").alias("_y"), F.col(fold).cast("int").alias("_fold"),
        *[F.col(s).cast(T.ArrayType(T.DoubleType())).alias(s) for s in sets]).persist(StorageLevel.MEMORY_AND_DISK)
    fits = _scalings(rows, sets, held, scale)
    found = _add_kernel(rows, fits, landmarks, seed) if landmarks else []
    sides = list(combinations(range(classes), 2)) if pairs else [(k, None) for k in range(classes)]
    cells = 0
    for f in fits:
        f.sides = [] if loss.regression else sides
        d = (len(f.mean) if f.landmarks is None else f.kernel_root.shape[1]) + 1
        f.weights = np.zeros((max(1, len(f.sides)), d))
        cells += len(f.weights) * (len(SHARES) + 1 + d + d * (d + 1) // 2)
    if cells > MAX_CELLS:
        raise TooLargeError(f"the problems take {cells} sums, more than {MAX_CELLS}; fit fewer sets or folds at a time")
    if found and loss.kinked:
        _start(rows, found, fits, loss)
    stages = DELTAS if loss.kinked and not found else DELTAS[-1:]
    for delta in stages:
        _solve(rows, fits, loss, delta, TOLERANCE if delta == stages[-1] else START_TOLERANCE)
    return rows, fits


def held_out_scores(rows: DataFrame, fits: list[Fit]) -> list[dict]:
    """Per fit: accuracy, or R2 and RMSE, of the rows of its held-out fold; one job for all fits."""
    sets = sorted({f.features for f in fits})
    shared = rows.sparkSession.sparkContext.broadcast(fits)

    def run(batches):
        fits = shared.value
        sums = np.zeros((len(fits), 5))
        for x, y, fold in _blocks(batches, sets):
            for k, f in enumerate(fits):
                use = fold == f.held
                if use.any():
                    d = y[use] - f.target_mean
                    p = f.predict(x[f.features][use])
                    miss = p - d if not f.sides else p - y[use]
                    sums[k] += [use.sum(), (miss == 0).sum(), (miss * miss).sum(), d.sum(), (d * d).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(fits)), pa.int32()), *[pa.array(c) for c in sums.T]], names=["k", *"nabcd"])

    added = rows.select("_y", "_fold", *sets).mapInArrow(run, "k int, n double, a double, b double, c double, d double")
    found = {r["k"]: r for r in added.groupBy("k").agg(*[F.sum(c).alias(c) for c in "nabcd"]).collect()}  # one row a fit
    shared.unpersist()
    out = []
    for k, f in enumerate(fits):
        r = found.get(k)
        n = int(r["n"]) if r else 0
        row = {"features": f.features, "fold": f.held, "n_train": f.n_train, "n_test": n, "gradient": f.gradient}
        if f.sides:
            row["accuracy"] = r["a"] / n if n else None
        else:
            spread = r["d"] - r["c"] ** 2 / n if n else 0.0
            row |= {"rmse": (r["b"] / n) ** 0.5 if n else None, "r2": 1 - r["b"] / spread if spread > 0 else None}
        out.append(row)
    return out


def evaluate_many(df: DataFrame, sets: list[str], target: str, fold: str, held: list[int], loss: Loss, **how) -> DataFrame:
    """(features, fold, n_train, n_test, gradient, scores...): fit everything in shared passes and score the held-out folds."""
    rows, fits = fit_many(df, sets, target, fold, held, loss, **how)
    try:
        found = held_out_scores(rows, fits)
    finally:
        rows.unpersist()
    scores = "rmse double, r2 double" if loss.regression else "accuracy double"
    schema = f"features string, fold int, n_train long, n_test long, gradient double, {scores}"
    names = [c.split()[0] for c in schema.split(", ")]
    return df.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in found], schema)
