"""Whitening of embeddings on their leading components, found by slicing the spectrum.

Entries become whole numbers, floor(scale * c), and the fit runs over each distinct vector once.
Sums and the covariance are added up as whole numbers (of vectors moved by the rounded mean before
they are multiplied), so they do not depend on how the rows are dealt to tasks.

The number of eigenvalues above a value s is the number of positive pivots of V - s (LDL^T with
1x1 and 2x2 pivots; inertia does not change under congruence). Halving by these counts isolates
each leading eigenvalue in an interval of its own; Rayleigh quotient iteration then converges
cubically inside it, and two more counts, just below and just above the result, certify that it has
the number it was given. Eigenvalues that double precision can't tell apart keep one interval, and
get any orthonormal basis of their common space.

Vectors that are null or hold null or non-finite entries are left out, and so are those whose
scaled entries exceed 2**61. Vectors of different lengths are different sets, each whitened by
itself; an empty vector has no component. A component without variance (all vectors alike, or of
too few dimensions) has null ``whitened``. ``deviation`` is null where it exceeds a long. Null and
repeated ids are passed on; an empty table gives no rows; other columns are ignored, whatever their
names. The fitted models (their size is checked: lengths x components) go to all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancy_spark.llm._shared import stored

SCALE = 256
COMPONENTS = 4
MODEL_BYTES = 64 << 20  # most that fitted models may take in every task
LIMB = 20  # bits of a number that are multiplied at once
BATCH_ROWS = 4096  # 2**12 products of 2 * 20 bits add up exactly in a double
EPS = np.finfo(float).eps
WHITE = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
         "identity_error double")


# -- whole-number vectors ---------------------------------------------------------------------

def _scaled(vectors: pa.ListArray, scale: float):
    """For each length of vector: the rows that have it and their whole numbers (rows, length)."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        with np.errstate(over="ignore"):
            x = np.floor(scale * flat[starts[rows, None] + np.arange(d)])
        fits = (np.abs(x) <= 2.0**61).all(1)
        yield d, rows[fits], x[fits].astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes a number (1, 2, 4 or 8): equal vectors give equal bytes."""
    most = np.maximum(x.max(1, initial=0), -1 - x.min(1, initial=0))
    width = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
    out = [b""] * len(x)
    for k in np.unique(width).tolist():
        at = np.flatnonzero(width == k)
        data, size = x[at].astype(f"<i{k}").tobytes(), k * x.shape[1]
        for j, i in enumerate(at.tolist()):
            out[i] = data[j * size:(j + 1) * size]
    return out


def _unpacked(dims: np.ndarray, packed: list[bytes]):
    """(length, rows, whole numbers) of the rows of a batch."""
    width = np.array([len(b) for b in packed]) // np.maximum(dims, 1)
    for d, k in sorted({(int(a), int(b)) for a, b in zip(dims, width) if a}):
        rows = np.flatnonzero((dims == d) & (width == k))
        data = np.frombuffer(b"".join(packed[i] for i in rows), f"<i{k}")
        yield d, rows, data.astype(np.int64).reshape(len(rows), d)


def _exact_product(y: np.ndarray) -> np.ndarray:
    """y.T @ y in whole numbers of any size, by limbs whose products a double holds exactly."""
    d, bits = y.shape[1], int(np.abs(y).max(initial=0)).bit_length()
    limbs, rest = [], y
    for _ in range(max(1, -(-bits // LIMB)) - 1):
        limbs.append((rest & ((1 << LIMB) - 1)).astype(float))
        rest = rest >> LIMB
    limbs.append(rest.astype(float))
    total = np.zeros((d, d), np.int64 if len(limbs) == 1 else object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            part = (a.T @ b).astype(np.int64)
            total = total + (part if not i + j else part.astype(object) << (LIMB * (i + j)))
    return total


def distinct_vectors(vectors: DataFrame, vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """dims, x: each distinct vector of whole numbers once, packed, as a written table."""
    schema = pa.schema([("dims", pa.int32()), ("x", pa.binary())])

    def run(batches):
        for b in batches:
            for d, _, x in _scaled(b.column(0), scale):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), d, np.int32)), pa.array(_packed(x), pa.binary())], schema=schema)

    rows = _valid(vectors, vector_col).select(F.col(vector_col).cast("array<double>"))
    return stored(rows.mapInArrow(run, "dims int, x binary").distinct(), "distinct-vectors")


def _valid(vectors: DataFrame, vector_col: str) -> DataFrame:
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x.cast("double"))
                   | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & ~bad)


def _added(distinct: DataFrame, per_batch) -> DataFrame:
    """dims, cell, value: whole numbers, ``per_batch(length, x)`` (an array) added up over all vectors."""
    schema = pa.schema([("dims", pa.int32()), ("cell", pa.int64()), ("value", pa.decimal128(38, 0))])

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _unpacked(b.column(0).to_numpy(), b.column(1).to_pylist()):
                for i in range(0, len(x), BATCH_ROWS):
                    part = per_batch(d, x[i:i + BATCH_ROWS]).astype(object)
                    total[d] = total[d] + part if d in total else part
        for d, values in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), d, np.int32)), pa.array(np.arange(len(values))),
                 pa.array([int(v) for v in values], pa.decimal128(38, 0))], schema=schema)

    cells = distinct.mapInArrow(run, "dims int, cell long, value decimal(38,0)")
    return cells.groupBy("dims", "cell").agg(F.sum("value").cast("decimal(38,0)").alias("value"))


# -- eigenvectors -------------------------------------------------------------------------------

def positive_pivots(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` lie above ``shift``: LDL^T of v - shift with
    symmetric interchanges and 1x1 or 2x2 pivots (Bunch and Kaufman's choice)."""
    a = v - shift * np.eye(len(v))
    n, k, above, alpha = len(a), 0, 0, (1 + 17**0.5) / 8
    while k < n:
        column = np.abs(a[k + 1:, k])
        r = k + 1 + int(column.argmax()) if len(column) else k
        low = column.max(initial=0.0)
        size = 1
        if low and abs(a[k, k]) < alpha * low:
            other = np.abs(a[r, k:])
            other[r - k] = 0
            high = other.max()
            if abs(a[k, k]) * high >= alpha * low**2:
                pass
            elif abs(a[r, r]) >= alpha * high:
                _swap(a, k, r)
            else:
                _swap(a, k + 1, r)
                size = 2
        if size == 1:
            pivot = a[k, k]
            above += pivot > 0
            if pivot:
                a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k + 1:, k] / pivot)
        else:
            pivot = a[k:k + 2, k:k + 2].copy()
            above += int((np.linalg.eigvalsh(pivot) > 0).sum())
            a[k + 2:, k + 2:] -= a[k + 2:, k:k + 2] @ np.linalg.solve(pivot, a[k + 2:, k:k + 2].T)
        k += size
    return int(above)


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


class NotCertified(ArithmeticError):
    """The counts contradict the eigenvalue that was found."""


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the symmetric ``v``, falling, and their unit vectors as columns."""
    d = len(v)
    k = min(k, d)
    size = float(np.abs(v).sum(1).max(initial=0.0))  # no eigenvalue is larger in size
    if not size:
        return np.zeros(k), np.eye(d)[:, :k]
    v = v / size
    tie = 8 * d * EPS  # closer than this, eigenvalues are one
    counts: dict[float, int] = {-1.0 - tie: d, 1.0 + tie: 0}

    def above(s: float) -> int:
        if s not in counts:
            counts[s] = positive_pivots(v, s)
        return counts[s]

    rng = np.random.default_rng(7)
    values, vectors = np.zeros(k), np.zeros((d, k))
    found = 0
    while found < k:
        low = max(s for s, c in counts.items() if c > found)
        high = min(s for s, c in counts.items() if c <= found)
        while high - low > tie and (above(low) > found + 1 or above(high) < found):
            mid = (low + high) / 2
            low, high = (mid, high) if above(mid) > found else (low, mid)
        many = min(max(1, above(low) - found), k - found)  # more than one: a tie
        space = vectors[:, :found]
        if many == 1 and high - low > tie:
            value, vector = _rayleigh(v, space, low, high, found, above, tie, rng)
            values[found], vectors[:, found] = value, vector
            slack = max(tie, 4 * float(np.linalg.norm(v @ vector - value * vector)))
            if above(value - slack) <= found or above(value + slack) > found:
                raise NotCertified(f"component {found + 1}")
        else:
            block = _common(v, (low + high) / 2, space, rng.standard_normal((d, many)))
            values[found:found + many] = np.einsum("ij,ij->j", block, v @ block)
            vectors[:, found:found + many] = block
        found += many
    return values * size, vectors


def _shifted_solve(v: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    for step in EPS * 2.0 ** np.arange(-1, 60):
        try:
            out = np.linalg.solve(v - shift * np.eye(len(v)), x)
            if np.isfinite(out).all():
                return out
        except np.linalg.LinAlgError:
            pass
        shift += step  # exactly an eigenvalue: next to it does as well
    raise np.linalg.LinAlgError("no solvable shift")


def _without(space: np.ndarray, x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = x - space @ (space.T @ x)
    return x


def _rayleigh(v, space, low, high, number, above, tie, rng) -> tuple[float, np.ndarray]:
    """The eigenvalue alone in (low, high) and its vector. The interval is halved on, by counts,
    whenever the iteration leaves it."""
    while True:
        x = _without(space, rng.standard_normal(len(v)))
        x = _without(space, _shifted_solve(v, (low + high) / 2, x / np.linalg.norm(x)))
        x /= np.linalg.norm(x)
        value, best = float(x @ v @ x), np.inf
        for _ in range(30):
            if not low - tie <= value <= high + tie:
                break
            rest = float(np.linalg.norm(v @ x - value * x))
            if rest >= best / 2 and rest <= 64 * len(v) * EPS:
                return value, x
            best = min(best, rest)
            x = _without(space, _shifted_solve(v, value, x))
            x /= np.linalg.norm(x)
            value = float(x @ v @ x)
        mid = (low + high) / 2
        if not low < mid < high:
            raise NotCertified(f"component {number + 1}")
        low, high = (mid, high) if above(mid) > number else (low, mid)


def _common(v, shift, space, x) -> np.ndarray:
    """An orthonormal basis of the space of the eigenvalues next to ``shift``."""
    for _ in range(4):
        x = np.linalg.qr(_without(space, _shifted_solve(v, shift, x)))[0]
    return np.linalg.qr(_without(space, x))[0]


# -- the fit --------------------------------------------------------------------------------------

@dataclass
class Model:
    """What was fitted to the vectors of one length."""

    n: int  # distinct vectors
    sums: list[int]  # of their whole numbers
    values: np.ndarray  # leading eigenvalues of the covariance, falling; 0 where there is no variance
    vectors: np.ndarray  # their unit vectors, as columns
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, without losing the digits of large numbers."""
        whole = [s // self.n for s in self.sums]
        return (x - np.array(whole, np.int64)) - np.array([s % self.n / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column for each component with a variance."""
        some = self.values > 0
        return self.centred(x) @ self.vectors[:, some] / np.sqrt(self.values[some])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - sums)**2, exact; null above a long."""
        most = max((abs(s) for s in self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if most**2 * max(1, x.shape[1]) < 1 << 63:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(1).tolist()
        y = self.n * x.astype(object) - np.array(self.sums, object)
        return [int(t) if t < 1 << 63 else None for t in (y * y).sum(1)]


def _sums(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length: number of distinct vectors and their sums."""
    def part(d, x):
        high, low = x >> 31, x & ((1 << 31) - 1)  # each adds up in a long
        return np.append([len(x)], (high.sum(0).astype(object) << 31) + low.sum(0))

    lengths = [r.dims for r in distinct.select("dims").distinct().where("dims > 0")
               .limit(MODEL_BYTES // 8 + 1).collect()]
    _checked(lengths)
    out = {d: [0] * (d + 1) for d in lengths}
    for r in _added(distinct, part).toLocalIterator():
        out[r.dims][r.cell] = int(r.value)
    return {d: (v[0], v[1:]) for d, v in out.items()}


def _checked(lengths: list[int], k: int = COMPONENTS) -> None:
    if sum(lengths) * 8 * (k + 3) > MODEL_BYTES:
        raise ValueError(f"{len(lengths)} lengths of vectors: their models exceed {MODEL_BYTES} bytes")


def _solved(sums: dict, cells: DataFrame, k: int) -> dict[int, Model]:
    """Covariances from the sums of products, and their leading components, one length a task."""
    def solve(key, table):
        d = key[0].as_py()
        n, total = sums[d]
        rest = np.array([s - n * _middle(s, n) for s in total], object)
        product = np.zeros(d * (d + 1) // 2, object)
        product[table["cell"].to_numpy()] = [int(x) for x in table["value"].to_pylist()]
        i, j = np.triu_indices(d)
        v = np.zeros((d, d))
        v[i, j] = v[j, i] = [(n * p - rest[a] * rest[b]) / n**2 for p, a, b in zip(product, i, j)]
        trace = sum(n * int(p) - int(rest[a])**2 for p, a, b in zip(product, i, j) if a == b) / n**2
        values, vectors = leading(v, k)
        values[values <= d * EPS * trace] = 0
        return pa.table({"dims": pa.array([d], pa.int32()), "found": pa.array([values], pa.list_(pa.float64())),
                         "vectors": pa.array([vectors.ravel()], pa.list_(pa.float64())), "trace": [trace]})

    rows = (cells.groupBy("dims").applyInArrow(
        solve, "dims int, found array<double>, vectors array<double>, trace double").collect())
    return {r.dims: Model(*sums[r.dims], np.array(r.found), np.array(r.vectors).reshape(r.dims, -1), r.trace)
            for r in rows}


def _middle(total: int, n: int) -> int:
    """The rounded mean."""
    return (2 * total + n) // (2 * n)


def fit(distinct: DataFrame, k: int = COMPONENTS) -> dict[int, Model]:
    """The model of each length of vector of ``distinct_vectors``."""
    sums = _sums(distinct)
    _checked(list(sums), k)
    middle = {d: np.array([_middle(s, n) for s in total], np.int64) for d, (n, total) in sums.items()}

    def products(d, x):
        return _exact_product(x - middle[d])[np.triu_indices(d)]

    models = _solved(sums, _added(distinct, products), k)

    def moments(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _unpacked(b.column(0).to_numpy(), b.column(1).to_pylist()):
                w = models[d].whitened(x)
                total[d] = total.get(d, 0) + np.append(w.sum(0), (w.T @ w).ravel())
        for d, x in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x), d, np.int32)), pa.array(np.arange(len(x))), pa.array(x)],
                ["dims", "cell", "value"])

    rows = (distinct.mapInArrow(moments, "dims int, cell long, value double")
            .groupBy("dims", "cell").agg(F.sum("value").alias("value")).collect())
    for d, m in models.items():
        c = int((m.values > 0).sum())
        x = np.zeros(c * (c + 1))
        for r in rows:
            if r.dims == d:
                x[r.cell] = r.value / m.n
        # the vectors were centred; what rounding left of a mean is taken off
        cov = x[c:].reshape(c, c) - np.outer(x[:c], x[:c])
        m.identity_error = float(np.abs(cov - np.eye(c)).max(initial=0.0))
    return models


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: float = SCALE, id_col: str = "vec_id",
           vector_col: str = "embedding", models: dict[int, Model] | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each vector
    and leading component. ``models`` are those of ``fit``; without them they are fitted to
    ``vectors`` here (that runs jobs)."""
    models = fit(distinct_vectors(vectors, vector_col, scale), k) if models is None else models

    def run(batches):
        for b in batches:
            for d, rows, x in _scaled(b.column(1), scale):
                m = models.get(d)
                c = len(m.values) if m else 0
                if not c or not len(rows):
                    continue
                w = np.full((len(x), c), np.nan)
                w[:, m.values > 0] = m.whitened(x)
                ids = b.column(0).take(pa.array(np.repeat(rows, c)))
                repeat = lambda v, kind: pa.array(np.tile(v, len(x)), kind)
                yield pa.RecordBatch.from_arrays([
                    ids, repeat(np.arange(1, c + 1), pa.int32()), repeat(np.full(c, m.n), pa.int64()),
                    pa.array([t for t in m.deviations(x) for _ in range(c)], pa.int64()),
                    pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel())),
                    repeat(m.values / m.trace if m.trace else np.zeros(c), pa.float64()),
                    repeat(np.full(c, m.identity_error), pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = _valid(vectors, vector_col).select(F.col(id_col).cast("long").alias("vec_id"),
                                              F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, WHITE)


def op11_spectrum_whitening(spark, sf_dir: str) -> DataFrame:
    """The four leading components of all embeddings."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
