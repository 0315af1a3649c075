"""Whitening of embeddings by a one-sided Jacobi SVD.

Entries become whole numbers x = floor(64 * c) + 1000000. The fit list is each distinct x vector once. Its rows,
centred exactly (n * x - S in whole numbers, then over n), are compressed to R blockwise: each task turns blocks of
rows and the R before into one triangle, triangles are merged sixteen at a time, and the last few meet on the
driver, where a triangle is as large as the number of dimensions squared and the rows no longer matter. Plane
rotations make R's columns orthogonal; the accumulated rotations are the components and the columns' lengths
their standard deviations, so no covariance is ever squared together.

Left out: null and empty vectors, those with a null, NaN or infinite entry, and those of another length than most
vectors have (ties: the longer). Entries beyond +-2^46 count as that much. Repeated vectors and ids: each row has its own
result. A component without variance (fewer different vectors than dimensions, or equal entries; a deviation under 1e-13
of the largest is one of rounding) has no whitened value and an explained share of 0, and identity_error looks at the others; without variance at all explained is null. A
deviation that a long can't hold is null. Components have their largest entry (the first of equals) positive.
Null ids stay. Extra columns are ignored. A table without such vectors gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read
from .texts import arrow_batches, batch_of, release

SCALE, SHIFT, MOST_ENTRY = 64, 1_000_000, float(1 << 46)
#: Components of the result.
TOP = 16
#: Rows that a task makes one triangle of at once, states merged by one task, and states that the driver merges.
BLOCK, FAN, DRIVER = 4096, 16, 64
#: Columns count as orthogonal below this cosine; sweeps over all pairs, at most.
ORTHOGONAL, SWEEPS = 1e-15, 60


# ---- the fit list -----------------------------------------------------------------------------


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x array<long>) of the vectors that aren't left out."""
    c = F.col("v")
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.coalesce(finite & (F.size("v") > 0), F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count()
    best = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    bound = lambda e: F.greatest(F.lit(-MOST_ENTRY), F.least(F.lit(MOST_ENTRY), e))
    x = F.transform("v", lambda e: F.floor(bound(e) * SCALE).cast("long") + SHIFT)
    return rows.where(F.size("v") == (best["d"] if best else 0)).select("key", x.alias("x"))


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A list column of one length as rows."""
    a = batch.column(batch.schema.get_field_index(name))
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1) if len(a) else np.zeros((0, 0), np.int64)


def scaled(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - S, exact: in longs, or in Python's integers where they might not do."""
    most = max((abs(int(v)) for v in (x.max(initial=0), x.min(initial=0))), default=0)
    if n * most + max((abs(int(s)) for s in total), default=0) < 1 << 62:
        return x * n - np.array(total, np.int64)
    return x.astype(object) * n - np.array([int(s) for s in total], object)


def deviations(a: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows of n * x - S; None where a long can't hold it."""
    out: list[int | None] = [None] * len(a)
    big = np.abs(a).max(1, initial=0) if len(a) else np.zeros(0)
    fits = np.array([int(b) ** 2 * a.shape[1] < 1 << 63 for b in big], bool)
    small = a[fits].astype(np.int64)
    for i, v in zip(np.flatnonzero(fits).tolist(), (small * small).sum(1).tolist(), strict=True):
        out[i] = v
    for i in np.flatnonzero(~fits).tolist():
        v = sum(int(c) ** 2 for c in a[i])
        out[i] = v if v < 1 << 63 else None
    return out


# ---- states of tasks, merged in a tree -----------------------------------------------------------


def tree(ws: Workspace, rows: DataFrame, start: Callable, merge: Callable, tag: str, driver: int = DRIVER) -> list[np.ndarray]:
    """start(batches) makes a state (array of doubles) of each task's rows, merge(states) one of several. States
    are merged FAN at a time until at most `driver` are left: these are returned."""

    def first(batches):
        state = start(batches)
        if state is not None:
            from pyspark import TaskContext

            yield batch_of(at=[TaskContext.get().partitionId()], state=pa.array([state.ravel().tolist()], pa.list_(pa.float64())))
        release()

    def again(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("at")
        state = merge([np.array(s) for s in ordered.column("state").to_pylist()])
        return pa.table({"at": pa.array([ordered.column("at")[0].as_py() // FAN], pa.int64()), "state": pa.array([state.ravel().tolist()], pa.list_(pa.float64()))})

    now, level = ws.table(rows.mapInArrow(first, "at long, state array<double>"), f"{tag}-0"), 0
    while now.count() > driver:
        level += 1
        now = ws.table(now.groupBy(F.expr(f"at div {FAN}").alias("to")).applyInArrow(again, "at long, state array<double>"), f"{tag}-{level}")
        ws.drop(f"{tag}-{level - 1}")
    return [np.array(r["state"]) for r in now.orderBy("at").collect()]


def triangle(ws: Workspace, fit: DataFrame, n: int, total: list[int], driver: int = DRIVER) -> np.ndarray:
    """R of the centred fit list."""
    d = len(total)

    def start(batches):
        r = None
        for batch in batches:
            x = matrix(batch, "x")
            for lo in range(0, len(x), BLOCK):
                a = scaled(x[lo : lo + BLOCK], n, total).astype(np.float64) / n
                r = np.linalg.qr(a if r is None else np.vstack([r, a]), mode="r")
        return None if r is None else np.vstack([r, np.zeros((d - len(r), d))])

    def merge(states):
        r = np.linalg.qr(np.vstack([s.reshape(d, d) for s in states]), mode="r")
        return np.vstack([r, np.zeros((d - len(r), d))])

    return merge(tree(ws, fit, start, merge, "triangles", driver))


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths falling, components as columns) of R's columns made orthogonal. Each round rotates every column
    with one partner; as many rounds as columns meet all pairs once."""
    d = r.shape[1]
    even = d + d % 2
    a, v = np.zeros((len(r), even)), np.eye(even)
    a[:, :d] = r
    seats = np.arange(even)
    nothing = (1e-16 * np.sqrt((a * a).sum(0).max(initial=0))) ** 2  # columns of rounding errors aren't turned
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(max(1, even - 1)):
            i, j = seats[: even // 2], seats[even // 2 :][::-1]
            ai, aj = a[:, i], a[:, j]
            p, q, c = (ai * ai).sum(0), (aj * aj).sum(0), (ai * aj).sum(0)
            size = np.where((p > nothing) & (q > nothing), np.sqrt(p) * np.sqrt(q), np.inf)
            turn = np.abs(c) > ORTHOGONAL * size
            worst = max(worst, float((np.abs(c[turn]) / size[turn]).max(initial=0)))
            z = np.where(turn, (q - p) / (2 * np.where(turn, c, 1)), 1)
            t = np.where(turn, np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1, z)), 0)
            cos = 1 / np.hypot(1, t)
            sin = cos * t
            a[:, i], a[:, j] = cos * ai - sin * aj, sin * ai + cos * aj
            vi, vj = v[:, i].copy(), v[:, j].copy()
            v[:, i], v[:, j] = cos * vi - sin * vj, sin * vi + cos * vj
            seats[1:] = np.roll(seats[1:], 1)
        if worst <= 8 * ORTHOGONAL:
            break
    v, length = v[:d, :d], np.sqrt((a * a).sum(0))[:d]
    order = np.argsort(-length, kind="stable")
    length, v = length[order], v[:, order]
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(d)])
    return length, v * np.where(sign == 0, 1, sign)


# ---- the model and its use -----------------------------------------------------------------------


def moments(ws: Workspace, fit: DataFrame, n: int, total: list[int], directions: np.ndarray, driver: int = DRIVER) -> np.ndarray:
    """Covariance (divisor n, centred) of the fit list along the directions: count, means and products of each
    block are centred within it and merged."""
    k = directions.shape[1]

    def join(a, b):
        na, nb = a[0], b[0]
        step, m = b[1 : k + 1] - a[1 : k + 1], na + nb
        return np.concatenate([[m], a[1 : k + 1] + step * nb / m, a[k + 1 :] + b[k + 1 :] + (np.outer(step, step) * (na * nb / m)).ravel()])

    def start(batches):
        state = None
        for batch in batches:
            x = matrix(batch, "x")
            for lo in range(0, len(x), BLOCK):
                w = (scaled(x[lo : lo + BLOCK], n, total).astype(np.float64) / n) @ directions
                m = w.mean(0)
                part = np.concatenate([[len(w)], m, ((w - m).T @ (w - m)).ravel()])
                state = part if state is None else join(state, part)
        return state

    def merge(states):
        out = states[0]
        for s in states[1:]:
            out = join(out, s)
        return out

    return merge(tree(ws, fit, start, merge, "moments", driver))[k + 1 :].reshape(k, k) / n


def whiten(ws: Workspace, df: DataFrame, top: int = TOP, key: str = "vec_id", vector: str = "embedding", driver: int = DRIVER) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): `top` rows of every vector that isn't
    left out, fewer if it has fewer dimensions."""
    rows = usable(df, key, vector)
    fit = ws.table(rows.select("x").distinct(), "fit")
    n = fit.count()
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    sums = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    total = [int(r["s"]) for r in sums.orderBy("i").collect()]
    length, v = jacobi(triangle(ws, fit, n, total, driver))
    e = length * length / n
    k, trace = min(top, len(total)), float(e.sum())
    live = length[:k] > length[0] * 1e-13
    along = v[:, :k] / np.where(live, np.sqrt(e[:k]), 1)
    share = e[:k] / trace if trace > 0 else np.full(k, np.nan)
    error = float(np.abs(moments(ws, fit, n, total, along[:, live], driver) - np.eye(int(live.sum()))).max(initial=0)) if live.any() else None
    shares = [float(s) if s == s else None for s in np.where(live | (trace <= 0), share, 0.0)]

    def run(batches):
        for batch in batches:
            x, keys = matrix(batch, "x"), batch.column(0)
            for lo in range(0, len(x), BLOCK):
                a = scaled(x[lo : lo + BLOCK], n, total)
                m = len(a)
                white = (a.astype(np.float64) / n) @ along
                place = pa.array(np.repeat(np.arange(m), k))
                dead = np.tile(~live, m)
                yield pa.RecordBatch.from_arrays(
                    [keys[lo : lo + BLOCK].take(place), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(deviations(a), pa.int64()).take(place), pa.array(white.ravel(), mask=dead), pa.array(shares * m, pa.float64()), pa.array([error] * (m * k), pa.float64())],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
        release()

    arrow_batches(df.sparkSession)
    return rows.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(Workspace(spark, "whitening"), read(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
