"""Gradient training over a stored table: one pass of Spark tasks a step, one row a partition back.

A step broadcasts the parameters, lets every partition add up its loss and gradient in numpy, and adds
the partitions' rows on the driver. Nothing is shuffled; the driver holds as many numbers as there are
parameters, times the partitions of the table and the few pairs the quasi-Newton step remembers. The
table should be written before (a lost executor then costs a re-read).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A partition's loss and gradient from its Arrow batches and the parameters.
LocalGradient = Callable[[Iterator[pa.RecordBatch], np.ndarray], tuple[float, np.ndarray]]


def summed_gradient(rows: DataFrame, local: LocalGradient,
                    most_tasks: int | None = None) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """A function of the parameters: the loss and its gradient, added up over the partitions of ``rows``.

    ``most_tasks`` bounds the gradients that a step returns, for tables of bounded size but many files.
    """
    if most_tasks is not None:
        rows = rows.coalesce(most_tasks)
    sc = rows.sparkSession.sparkContext

    def at(parameters: np.ndarray) -> tuple[float, np.ndarray]:
        shared = sc.broadcast(parameters)

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, gradient = local(batches, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([float(loss)]), pa.array([gradient.astype(np.float64).tobytes()])],
                                             names=["loss", "gradient"])

        loss, gradient = 0.0, np.zeros(len(parameters))
        # in the order of the partitions; as Arrow, which passes through the driver's JVM without rows made of it
        got = rows.mapInArrow(one, "loss double, gradient binary").toArrow()
        for own, part in zip(got.column("loss").to_pylist(), got.column("gradient")):
            loss += own
            gradient += np.frombuffer(part.as_buffer())
        shared.destroy()
        return loss, gradient

    return at


def minimise(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, tolerance: float = 1e-5,
             memory: int = 8, after_step: Callable[[int, np.ndarray, float], bool] | None = None) -> np.ndarray:
    """Limited-memory quasi-Newton with a backtracking line search, until the gradient is small.

    The end: a gradient whose largest part is at most ``tolerance``, a line search that finds no
    descent any more (rounding), or ``after_step(step, parameters, loss)`` that returns true (early
    stopping on other rows). There is no cap on the steps.
    """
    x = np.array(start, dtype=np.float64)
    loss, gradient = objective(x)
    pairs: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=memory)
    step = 0
    while np.abs(gradient).max(initial=0.0) > tolerance:
        direction = -_inverse_hessian_times(gradient, pairs)
        slope = float(direction @ gradient)
        if slope >= 0:                                   # no descent: start again from the gradient
            pairs.clear()
            direction, slope = -gradient, -float(gradient @ gradient)
        length = 1.0 if pairs else 1.0 / max(1.0, float(np.abs(gradient).sum()))
        while True:
            ahead = x + length * direction
            new_loss, new_gradient = objective(ahead)
            if new_loss <= loss + 1e-4 * length * slope:
                break
            length *= 0.5 if not np.isfinite(new_loss) else min(0.5, max(0.1, -slope * length / (
                2 * (new_loss - loss - slope * length))))
            if length * np.abs(direction).max() <= 1e-14 * max(1.0, np.abs(x).max()):
                return x
        moved, turned = ahead - x, new_gradient - gradient
        curved = float(moved @ turned)
        if curved > 1e-12 * float(np.linalg.norm(moved) * np.linalg.norm(turned)):
            pairs.append((moved, turned, curved))
        x, loss, gradient = ahead, new_loss, new_gradient
        step += 1
        if after_step is not None and after_step(step, x, loss):
            break
    return x


def _inverse_hessian_times(gradient: np.ndarray, pairs: deque) -> np.ndarray:
    """The two-loop product of the remembered inverse Hessian with ``gradient``."""
    out, shares = gradient.copy(), []
    for moved, turned, curved in reversed(pairs):
        a = float(moved @ out) / curved
        shares.append(a)
        out -= a * turned
    if pairs:
        _, turned, curved = pairs[-1]
        out *= curved / float(turned @ turned)
    for (moved, turned, curved), a in zip(pairs, reversed(shares)):
        out += (a - float(turned @ out) / curved) * moved
    return out
