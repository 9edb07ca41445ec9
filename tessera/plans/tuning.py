"""Fitting decision offsets by coordinate ascent, with the data left where it is.

Moving one class's offset changes a row's prediction only between that class
and the best of the others, and only once along the grid. So one aggregate -
rows by gold label, best other class and number of grid points at which the
class wins - tells the scores of all grid points for a coordinate. It has at
most classes x classes x grid points rows, however many rows there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The grid, the rounds, decimals kept, repeats of the transfer estimate and its least rows.
OFFSET_MAX, OFFSET_STEP, ROUNDS, DECIMALS, REPEATS, LEAST_ROWS = 6.0, 0.25, 3, 4, 5, 200


def offset_grid(largest: float = OFFSET_MAX, step: float = OFFSET_STEP) -> np.ndarray:
    """Multiples of the step from -largest to largest, zero exactly among them."""
    if largest <= 0 or not 0 < step <= largest:
        raise ValueError(f"no grid of step {step} up to {largest}")
    n = int(round(largest / step))
    return np.round(np.arange(-n, n + 1) * float(step), 6)


def f1_per_class(matrix: np.ndarray) -> np.ndarray:
    """From a confusion matrix (gold by predicted); 0 where a class is neither."""
    tp, both = np.diag(matrix).astype(float), matrix.sum(0) + matrix.sum(1)
    return np.divide(2 * tp, both, out=np.zeros(len(tp)), where=both > 0)


def _sweep(rows: DataFrame, offsets: np.ndarray, c: int, grid: np.ndarray) -> np.ndarray:
    """Confusion matrices at every grid point of class c's offset: [grid, gold, predicted]."""
    k = len(offsets)
    others = F.array(*[F.lit(float("-inf")) if i == c else F.get("scores", F.lit(i)) - float(o) for i, o in enumerate(offsets)])
    top = rows.select("gold", F.get("scores", F.lit(c)).alias("s"), others.alias("x")).select("gold", "s", F.array_max("x").alias("m"), (F.array_position("x", F.array_max("x")) - 1).alias("j"))
    wins = lambda g: (F.col("s") - g > F.col("m")) | ((F.col("s") - g == F.col("m")) & (F.col("j") > c))
    won = F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), wins))
    out = np.zeros((len(grid), k, k), np.int64)
    for gold, j, w, n in top.groupBy("gold", "j", won.alias("w")).count().collect():
        out[:w, gold, c] += n
        out[w:, gold, j] += n
    return out


def _matrix(rows: DataFrame, offsets: np.ndarray) -> np.ndarray:
    return _sweep(rows, offsets, 0, np.array([offsets[0]]))[0]


def tune_offsets(rows: DataFrame, k: int, grid: np.ndarray | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, dict]:
    """Offsets for rows (gold int, scores array<double>), and how they were found; zeros if they don't help."""
    rows = rows.select("gold", "scores").persist()  # some thirty passes over gold labels and scores
    try:
        return _tuned(rows, k, np.sort(offset_grid() if grid is None else np.asarray(grid, float)), rounds)
    finally:
        rows.unpersist()


def _tuned(rows: DataFrame, k: int, grid: np.ndarray, rounds: int) -> tuple[np.ndarray, dict]:
    tried = np.argsort(np.abs(grid), kind="stable")
    offsets = np.zeros(k)
    plain = f1_per_class(_matrix(rows, offsets)).mean()
    best, history = plain, [("argmax", round(float(plain), 4))]
    for r in range(rounds):
        for c in range(k):
            f1 = np.array([f1_per_class(m) for m in _sweep(rows, offsets, c, grid)])
            value = f1[:, c] if r == 0 else f1.mean(1)
            # the first of the best, small offsets first
            offsets[c] = grid[tried[np.argmax(value[tried])]]
        macro = f1_per_class(_matrix(rows, offsets)).mean()
        history.append(("macro_f1" if r else "per_class_f1", round(float(macro), 4)))
        if r and macro <= best + 1e-6:
            break
        best = max(best, macro)
    stuck = np.flatnonzero(np.abs(offsets) >= np.abs(grid).max() - 1e-9).tolist()
    offsets = np.round(offsets - offsets.mean(), DECIMALS)
    tuned = f1_per_class(_matrix(rows, offsets)).mean()
    if tuned < plain:
        offsets, tuned, stuck = np.zeros(k), plain, []
    return offsets, {"history": history, "argmax": round(float(plain), 4), "tuned": round(float(tuned), 4), "saturated": stuck}


def transfer_estimate(rows: DataFrame, k: int, grid: np.ndarray | None = None, repeats: int = REPEATS, id_col: str = "row_id") -> dict | None:
    """How much of the gain holds on the half that wasn't tuned on; None for too few rows."""
    n = rows.count()
    if repeats <= 0 or n < LEAST_ROWS:
        return None
    gains: list[list[float]] = [[], []]
    for seed in range(repeats):
        side = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(2))
        halves = [rows.where(side == s).select("gold", "scores").persist() for s in (0, 1)]
        offsets, _ = tune_offsets(halves[0], k, grid)
        for to, half in zip(gains, halves, strict=True):
            to.append(float(f1_per_class(_matrix(half, offsets)).mean() - f1_per_class(_matrix(half, np.zeros(k))).mean()))
            half.unpersist()
    inside, outside = map(np.array, gains)
    return {"repeats": repeats, "in_sample": round(inside.mean(), 4), "held_out": round(outside.mean(), 4), "held_out_sd": round(outside.std(), 4), "optimism": round(inside.mean() - outside.mean(), 4)}


def guarded(offsets: np.ndarray, estimate: dict | None) -> np.ndarray:
    """The offsets, or zeros if they lose on held-out halves."""
    return np.zeros(len(offsets)) if estimate and estimate["held_out"] < 0 else offsets
