"""Vectors whitened on their leading principal components, found by Jacobi-Davidson without forming the covariance.

The covariance is met only through products with a few vectors at a time: each is one pass over the table, in which a task
centres its vectors and sums ``x (x . q)``, and Spark sums the tasks' parts. The search space, some dozens of vectors of one
dimension each, lies on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import kept

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries from here on are taken as not finite: their squares have no exact sums.
LARGEST = float(2**30)
#: Vectors are laid in blocks of about so many bytes.
BLOCK_BYTES = 1 << 22
#: A pair is found when its residual, by the largest eigenvalue, is this small: some rounding errors of a sum.
RESIDUAL = 64 * np.finfo(float).eps
#: A pair whose residual has come to this and falls no more has come to the rounding errors of the sums.
ROUNDED = 1e-11
#: Vectors beyond those asked for, vectors of the search space, inner steps and rounds.
GUARD, MOST_BASIS, INNER, MOST_OUTER = 8, 96, 4, 300

Product = Callable[[np.ndarray], np.ndarray]


class Model(NamedTuple):
    """``n`` vectors of exact per-dimension sums, and components by falling eigenvalue, as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    residual: float
    identity_error: float


def minres(b: np.ndarray, steps: int, tol: float) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """Least-residual solution of ``M x = b`` for a symmetric M that may be indefinite: yields v, is sent ``M v``."""
    x, w, w_old, v_old = (np.zeros_like(b) for _ in range(4))
    beta = eta = least = float(np.linalg.norm(b))
    if beta == 0:
        return x
    v = b / beta
    c = c_old = 1.0
    s = s_old = 0.0
    for _ in range(steps):
        p = yield v
        alpha = float(v @ p)
        p = p - alpha * v - beta * v_old
        after = float(np.linalg.norm(p))
        delta = c * alpha - c_old * s * beta
        rho = float(np.hypot(delta, after))
        if rho == 0:
            break
        w, w_old = (v - s_old * beta * w_old - (s * alpha + c_old * c * beta) * w) / rho, w
        c_old, s_old, c, s = c, s, delta / rho, after / rho
        x = x + c * eta * w
        eta = -s * eta
        if abs(eta) <= tol * least or after <= 1e-14 * abs(alpha):
            break
        v_old, v, beta = v, p / after, after
    return x


def corrections(product: Product, locked: np.ndarray, theta: np.ndarray, u: np.ndarray, r: np.ndarray, tol: float) -> np.ndarray:
    """Solutions of the projected equations ``(I - QQ')(V - theta I)(I - QQ') t = -r`` with Q the locked vectors and u.

    All targets' solvers move in step, so that one pass over the table serves a step of each.
    """

    def project(i: int, t: np.ndarray) -> np.ndarray:
        q = np.column_stack([locked, u[:, i]])
        t = t - q @ (q.T @ t)
        return t - q @ (q.T @ t)

    solvers = {i: minres(project(i, -r[:, i]), INNER, tol) for i in range(len(theta))}
    found = np.zeros_like(u)
    asked: dict[int, np.ndarray] = {}
    answers: dict[int, np.ndarray | None] = dict.fromkeys(solvers)
    while solvers:
        for i, solver in list(solvers.items()):
            try:
                asked[i] = solver.send(answers[i])
            except StopIteration as end:
                found[:, i] = project(i, end.value)
                del solvers[i]
                asked.pop(i, None)
        if asked:
            columns = sorted(asked)
            made = product(np.column_stack([asked[i] for i in columns]))
            answers = {i: project(i, made[:, k] - theta[i] * asked[i]) for k, i in enumerate(columns)}
    return found


def orthonormal(t: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """The columns of ``t`` that are new to the others and to each other, as unit vectors."""
    out = np.column_stack([*others, np.zeros((len(t), 0))])
    held = out.shape[1]
    for column in t.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            column = column - out @ (out.T @ column)
        if size > 0 and np.linalg.norm(column) > 1e-10 * size:
            out = np.column_stack([out, column / np.linalg.norm(column)])
    return out[:, held:]


def jacobi_davidson(product: Product, dimension: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """``(values, vectors, residual)`` of the ``count`` largest eigenpairs; the residual is the largest of a last product with
    the vectors, by the largest value.

    Each round projects the matrix on the search space (Rayleigh-Ritz), locks the leading pairs whose residuals are at
    double precision, and widens the space by the corrections of the others. One pair more than asked for is
    followed loosely, so that a value overlooked would show.
    """
    count = min(count, dimension)
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((dimension, 0)), []
    basis = orthonormal(rng.standard_normal((dimension, min(dimension, count + GUARD))))
    image = product(basis)
    scale, history = 0.0, []
    for outer in range(MOST_OUTER):
        projected = basis.T @ image
        theta, y = np.linalg.eigh((projected + projected.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        basis, image = basis @ y, image @ y
        scale = max(scale, *np.abs(theta), *values) if len(theta) else scale
        wanted = min(count - len(values), len(theta))
        residuals = image - basis * theta
        sizes = np.linalg.norm(residuals, axis=0)
        history.append((len(values), float(sizes[0]) if len(sizes) else 0.0))
        stalled = [size for at, size in history[-4:] if at == len(values)]
        at_floor = len(stalled) == 4 and min(stalled[1:]) > stalled[0] / 2 and max(stalled) <= ROUNDED * scale
        full = basis.shape[1] + len(values) == dimension
        done = 0
        while done < wanted and (sizes[done] <= RESIDUAL * scale or full or (done == 0 and at_floor)):
            done += 1
        locked, values = np.column_stack([locked, basis[:, :done]]), values + list(theta[:done])
        basis, image, theta, residuals, sizes = basis[:, done:], image[:, done:], theta[done:], residuals[:, done:], sizes[done:]
        left = count - len(values)
        next_known = not len(theta) or full or sizes[0] <= 1e-5 * scale or theta[0] + sizes[0] < min(values, default=0.0)
        if not left and next_known:
            break
        targets = min(left + 1, len(theta))
        if basis.shape[1] + targets > MOST_BASIS:
            basis, image = basis[:, : targets + GUARD], image[:, : targets + GUARD]
        active = [i for i in range(targets) if i < left or left == 0]
        t = corrections(product, locked, theta[active], basis[:, active], residuals[:, active], max(2.0 ** -(outer + 1), 1e-3))
        new = orthonormal(t, locked, basis)
        if not new.shape[1]:
            new = orthonormal(rng.standard_normal((dimension, 1)), locked, basis)
        if new.shape[1]:
            basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
    rest = count - len(values)  # none, unless the rounds have run out: then the residual tells
    locked = np.column_stack([locked, basis[:, :rest]])
    made = product(locked)
    projected = locked.T @ made
    theta, y = np.linalg.eigh((projected + projected.T) / 2)
    theta, y = theta[::-1], y[:, ::-1]
    locked, made = locked @ y, made @ y
    residual = np.linalg.norm(made - locked * theta, axis=0).max(initial=0.0) / (scale or 1.0)
    locked = locked * np.where(locked[np.abs(locked).argmax(0), range(len(theta))] < 0, -1.0, 1.0)
    return theta, locked, float(residual)


def blocks_of(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``ids (array), data (bytes of x as longs, row by row)`` of the usable vectors, and their dimension."""
    entries = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("embedding"))
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    rows = rows.filter(F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0))
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    if not d:
        return rows, 0

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(BLOCK_BYTES // (8 * d), 1)
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                x = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False) * SCALE).astype(np.int64) + SHIFT
                ids = pa.array([part.column(0).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()])], ["ids", "data"])

    return kept(rows.filter(F.size("embedding") == d).mapInArrow(lay, "ids array<long>, data binary"), "vectors"), d


def summed(blocks: DataFrame, dimension: int, width: int, work: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all blocks of ``work(x)``, a table of ``width`` columns; a task adds up its own blocks first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0):
                part = work(np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dimension))
                total = part if total is None else total + part
        if total is not None:
            columns = [pa.array(range(len(total)), pa.int64()), *(pa.array(np.ascontiguousarray(total[:, k])) for k in range(width))]
            yield pa.RecordBatch.from_arrays(columns, ["j", *(f"c{k}" for k in range(width))])

    parts = blocks.select("data").mapInArrow(add, "j long, " + ", ".join(f"c{k} {kind}" for k in range(width)))
    as_sum = "decimal(38,0)" if kind == "long" else kind
    rows = parts.groupBy("j").agg(*[F.sum(F.col(f"c{k}").cast(as_sum)).alias(f"c{k}") for k in range(width)]).collect()
    found = {r["j"]: r[1:] for r in rows}
    return np.array([found[j] for j in sorted(found)], object if kind == "long" else float)


def exact_sums(blocks: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension."""
    low = (1 << 21) - 1

    def work(x: np.ndarray) -> np.ndarray:
        return np.stack([(x >> 21).sum(0), (x & low).sum(0), np.full(d, len(x))], 1)

    total = summed(blocks, d, 3, work, "long")
    return int(total[0, 2]), [(int(high) << 21) + int(rest) for high, rest in total[:, :2]]


def centred(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """x less its mean in double precision: whole numbers first, then the fraction."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - base).astype(float) - rest


def fit(blocks: DataFrame, d: int, count: int = COMPONENTS, seed: int = 17) -> Model:
    """The leading components of the vectors in ``blocks``; those whose eigenvalue is rounding error are left out."""
    n, sums = exact_sums(blocks, d)
    centre = centred(n, sums)

    def product(q: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return c.T @ (c @ q)

        return summed(blocks, d, q.shape[1], work) / n

    trace = float(summed(blocks, d, 1, lambda x: (centre(x) ** 2).sum(0)[:, None]).sum()) / n
    if trace == 0:
        return Model(n, sums, np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0.0, 0.0)
    values, vectors, residual = jacobi_davidson(product, d, count, seed)
    real = values > 1e-13 * values[0] * d
    values, vectors = values[real], vectors[:, real]
    whitener = vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centre(x) @ whitener
        return np.column_stack([w.T @ w, w.sum(0)])

    second = summed(blocks, d, len(values) + 1, moments) / n
    covariance = second[:, :-1] - np.outer(second[:, -1], second[:, -1])
    error = float(np.abs(covariance - np.eye(len(values))).max())
    return Model(n, sums, values, vectors, values / trace, residual, error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """``sum of (n x - S)^2`` per row, exactly: squares and products are summed in parts of 21 bits."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    low = (1 << 21) - 1
    y = x - base
    a, b = y >> 21, y & low
    r = np.stack([rest >> 21, rest & low], 1)
    squares = ((a * a).sum(1).astype(object) << 42) + ((a * b).sum(1).astype(object) << 22) + (b * b).sum(1).astype(object)
    ar, br = (a @ r).astype(object), (b @ r).astype(object)
    mixed = (ar[:, 0] << 42) + ((ar[:, 1] + br[:, 0]) << 21) + br[:, 1]
    constant = sum(int(v) ** 2 for v in rest)
    return list(n * n * squares - 2 * n * mixed + constant)


def whiten(vectors: DataFrame, count: int = COMPONENTS, seed: int = 17) -> tuple[DataFrame, Model | None]:
    """``(rows, model)`` for ``vectors`` (``vec_id, embedding``): ``rows`` are ``vec_id, n, deviation (decimal), whitened (array)``.

    An entry c becomes ``x = floor(1024 c) + 100000``. ``whitened`` is ``x`` less its mean, projected on each component and divided by the root of its
    eigenvalue; ``deviation`` the exact sum of ``(n x - S)^2`` (null from 10^38 on). Covariances have divisor n.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are those with entries of 2^30 and more and those
    of another dimension than most rows have (the larger of two as frequent ones). Repeated rows count each time; a
    null vec_id stays null; other columns are ignored. Components that are rounding error (fewer vectors than dimensions, equal vectors)
    are left out, so ``whitened`` may be shorter than ``count`` or empty. A table without usable vectors gives no
    rows and no model.
    """
    spark = vectors.sparkSession
    blocks, d = blocks_of(vectors)
    schema = "vec_id long, n long, deviation decimal(38,0), whitened array<double>"
    if not d:
        return spark.createDataFrame([], schema), None
    model = fit(blocks, d, count, seed)
    n, sums = model.n, model.sums
    centre = centred(n, sums)
    whitener = model.components / np.sqrt(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column(0), batch.column(1)):
                x = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, d)
                w = centre(x) @ whitener
                total = [Decimal(v) if v < 10**38 else None for v in deviations(x, n, sums)]
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
                columns = [ids.values, pa.array(np.full(len(x), n)), pa.array(total, pa.decimal128(38, 0)), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "n", "deviation", "whitened"])

    return blocks.mapInArrow(project, schema), model
