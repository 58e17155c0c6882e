"""Minimising smooth functions whose values and gradients a caller computes, by one aggregation of a table for instance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass(frozen=True)
class Stop:
    """When to stop: gradient and step below these, or so many rounds."""

    gradient: float = 1e-9
    step: float = 1e-7
    rounds: int = 100


#: The two constants of the strong Wolfe conditions.
DECREASE, CURVATURE = 1e-4, 0.3


def _cubic_minimum(a: float, fa: float, da: float, b: float, fb: float, db: float) -> float:
    """Where the cubic through two values and slopes is least; NaN where it has no minimum."""
    bend = da + db - 3 * (fa - fb) / (a - b)
    inner = bend * bend - da * db
    if inner < 0:
        return float("nan")
    root = float(np.copysign(np.sqrt(inner), b - a))
    below = db - da + 2 * root
    return b - (b - a) * (db + root - bend) / below if below else float("nan")


def line_search(objective: Objective, x: np.ndarray, direction: np.ndarray, first: float = 1.0, tries: int = 60) -> float:
    """A step that meets the strong Wolfe conditions, after Nocedal and Wright (2006), algorithms 3.5 and 3.6; 1 uphill.

    An interval opens at 0 and has no end yet. A trial that is too high becomes its end; one that is lower but still
    steep becomes the end that counts as best, and the other end stays where the slope points to. Without an end
    steps go on by a factor; with one the next trial is the least point of the cubic through both, kept off the ends.
    After ``tries`` trials, or where the interval is too short to tell, the best step is good enough.
    """
    x, direction = np.asarray(x, float), np.asarray(direction, float)

    def trial(step: float) -> tuple[float, float, float]:
        value, gradient = objective(x + step * direction)
        return step, float(value), float(direction @ np.asarray(gradient, float))

    _, start, slope = best = trial(0.0)
    if slope >= 0:
        return 1.0
    other, step = None, first
    for _ in range(tries):
        step, value, steep = now = trial(step)
        if not value <= start + DECREASE * step * slope or (best[0] > 0 and value >= best[1]):
            other = now
        elif abs(steep) <= CURVATURE * -slope:
            return step
        else:
            # Lower than the best one so far: the minimum lies to the side that the slope falls to.
            if steep * ((other[0] if other else np.inf) - step) >= 0:
                other = best
            best = now
        if other is None:
            step = 2.5 * step
            continue
        width = other[0] - best[0]
        if abs(width) <= 1e-12 * max(1.0, abs(best[0])):
            break
        step = _cubic_minimum(*best, *other)
        if not 0.1 <= (step - best[0]) / width <= 0.9:
            step = best[0] + width / 2
    return best[0] or step


def bfgs(objective: Objective, x: np.ndarray, stop: Stop = Stop()) -> np.ndarray:
    """The minimum by quasi-Newton steps (Nocedal and Wright, algorithm 6.1).

    The inverse Hessian starts as the identity, scaled by the first step's curvature before its first update. Pairs
    without positive curvature leave it as it is.
    """
    x = np.asarray(x, float)
    gradient = np.asarray(objective(x)[1], float)
    inverse, scaled, done = np.eye(len(x)), False, 0
    while np.linalg.norm(gradient) >= stop.gradient and done < stop.rounds:
        step = line_search(objective, x, -inverse @ gradient) * (-inverse @ gradient)
        x, done = x + step, done + 1
        change = -gradient
        gradient = np.asarray(objective(x)[1], float)
        change += gradient
        if np.linalg.norm(step) < stop.step:
            break
        curvature = float(change @ step)
        if curvature <= 0:
            continue
        if not scaled:
            inverse, scaled = curvature / float(change @ change) * inverse, True
        # The rank-two update, multiplied out so that it takes no product of matrices.
        moved = inverse @ change
        across = np.outer(step, moved)
        inverse = inverse - (across + across.T) / curvature + (1 + float(change @ moved) / curvature) / curvature * np.outer(step, step)
    return x


def least_squares(df: DataFrame, features: list[str], target: str) -> np.ndarray:
    """Weights and, last, the constant of a linear fit, by ``bfgs`` on moments that one pass over the table gives."""
    columns = [*(F.col(c).cast("double") for c in features), F.lit(1.0), F.col(target).cast("double")]
    n = len(columns)
    sums = df.agg(*(F.avg(columns[a] * columns[b]).alias(f"m{a}_{b}") for a in range(n) for b in range(a, n))).first()
    m = np.array([[sums[f"m{min(a, b)}_{max(a, b)}"] for b in range(n)] for a in range(n)])
    left, right = m[:-1, :-1], m[:-1, -1]
    scale = np.sqrt(np.diag(left))
    left, right = left / np.outer(scale, scale), right / scale

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        return float(w @ left @ w / 2 - right @ w), left @ w - right

    return bfgs(objective, np.zeros(n - 1), Stop(1e-12, 1e-14, 400)) / scale
