"""Whitening of embeddings on leading principal components found by Jacobi-Davidson.

Entries become whole numbers, x = floor(scale * c). The fit list holds every distinct x vector once; it is stored as
packed blocks. Sums and sums of squares over it are exact integers. The covariance matrix is never formed:
all that is asked of it is its product with a few vectors, (1/n) sum (x - S/n) ((x - S/n) . w), one Spark job
in which every task multiplies its blocks and the partial products (as many numbers as there are entries in w, whatever the number of
rows) are summed by position.

Jacobi-Davidson, for all wanted pairs at once: Rayleigh-Ritz on the search space; residuals of the leading Ritz
pairs; pairs at double precision are locked, in order; for the others the projected correction equation
(I - QQ')(V - theta I)(I - QQ') t = -r is solved by a few steps of MINRES, whose products are distributed and
shared by all right-hand sides; the corrections widen the search space, which is restarted from its best Ritz
vectors when full. It ends when all wanted pairs are locked. Residuals are recomputed from products of the Ritz
vectors themselves, not from the recurrences.

Defined cases: vectors that are null, or hold null or non-finite entries, have no rows; vectors of each length
are fitted on their own; an empty vector and a component without variance (rank below `components`) have no rows;
repeated rows and rows without vec_id stay rows; n and deviation are exact, deviation is null where it exceeds 64
bits; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelgauge.llm.common import ship
from duelgauge.runtime import cut_lineage

COMPONENTS = 4
SCALE = 256.0
BLOCK_ROWS = 4_096
GUARD = 2  # pairs followed beyond the wanted ones, so that close eigenvalues are told apart
INNER_STEPS = 3
SPACE = 64
PRECISION = 4e-15  # of the largest eigenvalue, times the square root of the length
MAX_ROUNDS = 400

Product = Callable[[np.ndarray], np.ndarray]


def scaled_rows(embeddings: DataFrame, scale: float) -> DataFrame:
    """vec_id and x (whole numbers) of the rows that take part."""
    value = F.col("embedding").cast("array<double>")
    rows = embeddings.select("vec_id", value.alias("v")).filter(F.size("v") > 0)
    rows = rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(scale)).cast("long")).alias("x"))


def matrix_of(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def narrow(x: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if len(x) == 0 or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def fit_blocks(rows: DataFrame) -> DataFrame:
    """Every distinct x once, in stored blocks of at most BLOCK_ROWS rows of one length: length, width, block."""
    ship(__name__)
    distinct = rows.select("x").groupBy("x").agg(F.lit(0).alias("one")).drop("one")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def block(length: int) -> pa.RecordBatch:
            x = narrow(np.concatenate(held.pop(length)))
            return pa.RecordBatch.from_pydict({"length": pa.array([length], pa.int32()), "width": pa.array([x.itemsize], pa.int32()), "block": pa.array([x.tobytes()], pa.binary())})

        for batch in batches:
            column = batch.column("x")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                x = matrix_of(column.filter(pa.array(lengths == length)), length)
                for at in range(0, len(x), BLOCK_ROWS):
                    held.setdefault(length, []).append(x[at : at + BLOCK_ROWS])
                    if sum(map(len, held[length])) >= BLOCK_ROWS:
                        yield block(length)
        for length in list(held):
            yield block(length)

    parts = max(1, -(-rows.count() // BLOCK_ROWS))  # full blocks, however many partitions the shuffle has
    return cut_lineage(distinct.coalesce(parts).mapInArrow(pack, "length int, width int, block binary"))


def blocks_in(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    kinds = {2: np.int16, 4: np.int32, 8: np.int64}
    for batch in batches:
        for k in range(batch.num_rows):
            length, width, raw = (batch.column(c)[k].as_py() for c in ("length", "width", "block"))
            yield length, np.frombuffer(raw, kinds[width]).reshape(-1, length)


class Moments(NamedTuple):
    n: int
    sums: list[int]
    trace: float  # of the covariance
    mean: np.ndarray


def moments(blocks: DataFrame) -> dict[int, Moments]:
    """Exact first and second sums of every vector length."""
    ship(__name__)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, x in blocks_in(batches):
            most = int(np.abs(x.astype(object)).max()) if x.dtype == np.int64 else int(np.abs(x.astype(np.int64)).max())
            wide = x.astype(np.int64) if len(x) * most * most < 1 << 62 else x.astype(object)
            s, q = wide.sum(0), (wide * wide).sum(0)
            out = {"length": [length] * length, "place": list(range(length)), "n": [len(x)] * length, "s": [str(v) for v in s], "q": [str(v) for v in q]}
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("length", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("s", pa.string()), ("q", pa.string())]))

    parts = blocks.mapInArrow(sums, "length int, place int, n long, s string, q string")
    wide = "decimal(38,0)"
    total = parts.groupBy("length", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(wide)).alias("s"), F.sum(F.col("q").cast(wide)).alias("q"))
    found: dict[int, Moments] = {}
    rows = total.collect()  # one row per entry of a vector
    for length in sorted({r["length"] for r in rows}):
        mine = sorted((r for r in rows if r["length"] == length), key=lambda r: r["place"])
        n, s, q = mine[0]["n"], [int(r["s"]) for r in mine], [int(r["q"]) for r in mine]
        found[length] = Moments(n, s, sum(n * b - a * a for a, b in zip(s, q)) / n**2, np.array([a / n for a in s]))
    return found


def covariance_product(blocks: DataFrame, length: int, fit: Moments) -> Product:
    """w -> V w for a matrix w of a few columns; one job over the stored blocks."""
    mine = blocks.filter(F.col("length") == length)

    def multiply(w: np.ndarray) -> np.ndarray:
        mean, shape = fit.mean, w.shape

        def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for _, x in blocks_in(batches):
                centred = x - mean
                total += centred.T @ (centred @ w)
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(total.size), pa.int32()), "value": pa.array(total.ravel())})

        parts = mine.mapInArrow(partial, "place int, value double")
        rows = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()  # as many as w has entries
        out = np.zeros(w.size)
        out[[r["place"] for r in rows]] = [r["value"] for r in rows]
        return out.reshape(shape) / fit.n

    return multiply


# --- Jacobi-Davidson -------------------------------------------------------------------------------


def orthonormal(v: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns of v made orthonormal and orthogonal to `against`; those that vanish are left out."""
    kept: list[np.ndarray] = []
    for column in v.T:
        size = np.linalg.norm(column)
        if size == 0:
            continue
        u = column / size
        for _ in range(2):
            u = u - against @ (against.T @ u)
            for k in kept:
                u = u - k * (k @ u)
        left = np.linalg.norm(u)
        if left > 1e-8:
            kept.append(u / left)
            kept[-1] = kept[-1] - against @ (against.T @ kept[-1])
            kept[-1] /= np.linalg.norm(kept[-1])
    return np.stack(kept, 1) if kept else np.zeros((len(v), 0))


def minres(multiply: Product, shifts: np.ndarray, project: np.ndarray, right: np.ndarray, steps: int) -> np.ndarray:
    """`steps` of MINRES for (I - QQ')(V - shift I)(I - QQ') t = right, all columns in step; Q = project."""

    def clean(v: np.ndarray) -> np.ndarray:
        return v - project @ (project.T @ v)

    b = clean(right)
    columns = b.shape[1]
    beta = np.linalg.norm(b, axis=0)
    v = b / np.where(beta > 0, beta, 1)
    v_old, t = np.zeros_like(b), np.zeros_like(b)
    d1, d2 = np.zeros_like(b), np.zeros_like(b)
    cosine, sine, cosine_old, sine_old = np.ones(columns), np.zeros(columns), np.ones(columns), np.zeros(columns)
    eta, coupling = beta.copy(), np.zeros(columns)
    for _ in range(steps):
        p = clean(multiply(v)) - shifts * v
        alpha = (v * p).sum(0)
        p = clean(p - alpha * v - coupling * v_old)
        following = np.linalg.norm(p, axis=0)
        r3 = sine_old * coupling
        r2 = cosine_old * cosine * coupling + sine * alpha
        r1_bar = cosine * alpha - cosine_old * sine * coupling
        r1 = np.hypot(r1_bar, following)
        alive = r1 > 1e-300
        safe = np.where(alive, r1, 1)
        cosine_new, sine_new = np.where(alive, r1_bar / safe, 1), np.where(alive, following / safe, 0)
        d = np.where(alive, (v - r2 * d1 - r3 * d2) / safe, 0)
        t = t + cosine_new * eta * d
        eta = -sine_new * eta
        d1, d2 = d, d1
        v_old, v = v, np.where(following > 0, p / np.where(following > 0, following, 1), 0)
        cosine_old, sine_old, cosine, sine, coupling = cosine, sine, cosine_new, sine_new, following
    return clean(t)


def leading_pairs(multiply: Product, length: int, wanted: int, trace: float, inner: int = INNER_STEPS, space: int = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; eigenvectors) of the `wanted` largest pairs."""
    wanted = min(wanted, length)
    follow = min(wanted + GUARD, length)
    space = min(max(space, 3 * follow), length)
    start = np.random.default_rng(length).standard_normal((length, follow))
    basis = orthonormal(start, np.zeros((length, 0)))
    images = multiply(basis)
    locked, values = np.zeros((length, 0)), []
    for _ in range(MAX_ROUNDS):
        projected = basis.T @ images
        theta, mix = np.linalg.eigh((projected + projected.T) / 2)
        theta, mix = theta[::-1], mix[:, ::-1]
        count = min(follow - locked.shape[1], len(theta))
        ritz, ritz_images = basis @ mix[:, :count], images @ mix[:, :count]
        residual = ritz_images - theta[:count] * ritz
        residual -= locked @ (locked.T @ residual)
        limit = PRECISION * np.sqrt(length) * max(trace / length, theta[0] if not values else values[0])
        small = np.linalg.norm(residual, axis=0) <= limit
        done = int(np.argmin(small)) if not small.all() else count
        done = min(done, wanted - locked.shape[1])
        full = locked.shape[1] + basis.shape[1] >= length  # the space is everything: Ritz pairs are eigenpairs
        if done or full:
            fresh = ritz[:, : wanted - locked.shape[1]] if full else ritz[:, :done]
            true = multiply(fresh)  # the residual proper, not that of the recurrences
            held = np.linalg.norm(true - theta[: fresh.shape[1]] * fresh, axis=0) <= 4 * limit
            stop = fresh.shape[1] if full or held.all() else int(np.argmin(held))
            values += theta[:stop].tolist()
            locked = np.concatenate([locked, fresh[:, :stop]], 1)
            if locked.shape[1] >= wanted:
                return np.array(values), locked
            if stop:  # the rest of the search space, orthogonal to what is locked
                rest = orthonormal(basis @ mix[:, stop:], locked)
                basis, images = rest, multiply(rest)
                continue
            basis = orthonormal(basis @ mix[:, :space], locked)
            images = multiply(basis)
        if basis.shape[1] + count > space - locked.shape[1]:
            keep = min(2 * count, basis.shape[1])
            basis = orthonormal(basis @ mix[:, :keep], locked)
            images = multiply(basis)
        correction = minres(multiply, theta[:count], np.concatenate([locked, ritz], 1), -residual, inner)
        fresh = orthonormal(correction, np.concatenate([locked, basis], 1))
        if not fresh.shape[1]:
            fresh = orthonormal(np.random.default_rng(basis.shape[1]).standard_normal((length, 1)), np.concatenate([locked, basis], 1))
        basis, images = np.concatenate([basis, fresh], 1), np.concatenate([images, multiply(fresh)], 1)
    raise RuntimeError(f"no convergence to double precision in {MAX_ROUNDS} rounds")


class Fit(NamedTuple):
    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float


def identity_error(blocks: DataFrame, length: int, fit: Moments, values: np.ndarray, vectors: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, less the identity; one job."""
    mine, mean, turn = blocks.filter(F.col("length") == length), fit.mean, vectors / np.sqrt(values)
    k = len(values)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for _, x in blocks_in(batches):
            w = (x - mean) @ turn
            total += np.concatenate([w.sum(0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(total)), pa.int32()), "value": pa.array(total)})

    parts = mine.mapInArrow(partial, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros(k + k * k)
    for r in parts.collect():  # k + k * k rows
        total[r["place"]] = r["value"]
    means = total[:k] / fit.n
    return float(np.abs(total[k:].reshape(k, k) / fit.n - np.outer(means, means) - np.eye(k)).max())


def fitted(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """By vector length: sums, eigenvalues and eigenvectors of the distinct x, as far as they have variance."""
    ship(__name__)
    blocks = fit_blocks(rows)
    out = {}
    for length, fit in moments(blocks).items():
        values, vectors = np.zeros(0), np.zeros((length, 0))
        if fit.trace > 0:
            values, vectors = leading_pairs(covariance_product(blocks, length, fit), length, components, fit.trace)
            real = values > 1e-12 * values[0]
            values, vectors = values[real], vectors[:, real]
        error = identity_error(blocks, length, fit, values, vectors) if len(values) else 0.0
        out[length] = Fit(fit, values, vectors, error)
    return out


def deviations(x: np.ndarray, fit: Moments) -> list[int | None]:
    """Exact sums over entries of (n x - S)^2; None above 64 bits."""
    most = fit.n * int(max(abs(int(x.min())), abs(int(x.max())))) + max(abs(s) for s in fit.sums)
    if most * most * len(fit.sums) < 1 << 63:
        apart = fit.n * x.astype(np.int64) - np.array(fit.sums, np.int64)
        return (apart * apart).sum(1).tolist()
    exact = ((fit.n * x.astype(object) - np.array(fit.sums, object)) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def whitened(embeddings: DataFrame, components: int = COMPONENTS, scale: float = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per usable row and component."""
    ship(__name__)
    rows = scaled_rows(embeddings, scale)
    fits = fitted(rows, components)
    schema = T.StructType(
        [rows.schema["vec_id"], *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double").fields]
    )

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                mine = pa.array(lengths == length)
                fit = fits[length]
                k = len(fit.values)
                if not k:
                    continue
                ids, x = batch.column("vec_id").filter(mine), matrix_of(batch.column("x").filter(mine), length)
                w = (x - fit.moments.mean) @ (fit.vectors / np.sqrt(fit.values))
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                        pa.array(np.full(k * len(x), fit.moments.n), pa.int64()),
                        pa.array(deviations(x, fit.moments), pa.int64()).take(pa.array(each)),
                        pa.array(w.ravel()),
                        pa.array(np.tile(fit.values / fit.moments.trace, len(x))),
                        pa.array(np.full(k * len(x), fit.identity_error)),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(project, schema)
