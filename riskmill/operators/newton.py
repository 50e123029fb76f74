"""Penalised logistic regression by Newton steps, each of them one pass over the rows.

A pass adds up loss, gradient and Hessian at one point; every task returns one row of these sums, some hundred numbers, so
what meets on the driver depends on features and partitions only. The next point minimises the quadratic that the sums
describe, with its penalty, and is halved back while the loss itself does not fall. A dozen or two passes reach the
minimum, where first-order methods need a thousand on features that nearly repeat each other.

Rows are turned into matrices of one batch each before the first pass, so that a pass only multiplies. Fits of the same rows
with different penalties go side by side: a pass adds up at the points of all that have not ended.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, Row

# A predicted fall of the mean loss below this ends the fit.
LEAST_FALL = 1e-15
HALVINGS = 40
INNER_ROUNDS, CHECKED_ROUNDS = 20_000, 200
# OpenBLAS multiplies matrices and vectors of more elements with threads of its own. Tasks fill the cores already, and threads
# that wait for each other there made a pass seven times as long.
MATRIX_WORK, VECTOR_WORK = 1 << 18, 9_000


@dataclass(frozen=True)
class Sums:
    """Mean loss, its gradient and its Hessian; the intercept is the last coordinate."""

    loss: float
    gradient: np.ndarray
    hessian: np.ndarray


Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def packed(rows: DataFrame, width: int) -> RDD[Row]:
    """The rows' ``x`` (array of ``width`` doubles) with a one for the intercept, ``label`` (0 or 1) and ``weight`` as the bytes of
    a matrix and two vectors per batch of an Arrow stream, in the rows' partitions. To be persisted: in this form it costs a
    task no Python process beside that of the pass."""
    return rows.select("x", "label", "weight").mapInArrow(_packer(width + 1), "block binary").rdd


def blocks(stored: RDD[Row], width: int) -> RDD[Block]:
    """The matrices and vectors of ``packed`` rows."""
    return stored.map(_unpacker(width + 1))


def fit(stored: RDD[Block], width: int, penalties: Sequence[tuple[float, float]], max_rounds: int) -> list[tuple[np.ndarray, float]]:
    """For each (l2, l1): coefficients and intercept that minimise the weighted mean loss plus ``l2 / 2 * |b|^2 + l1 * |b|``.

    ``stored`` are ``blocks``, read once per round for all penalties, so what they are made of should be persisted. The intercept is
    not penalised. Of features that repeat each other the coefficients stay alike.
    """
    searches = [_search(width, l2, l1, max_rounds) for l2, l1 in penalties]
    found: dict[int, tuple[np.ndarray, float]] = {}
    asked = {place: next(search) for place, search in enumerate(searches)}
    while asked:
        for place, sums in zip(list(asked), sums_at(stored, list(asked.values()))):
            try:
                asked[place] = searches[place].send(sums)
            except StopIteration as end:
                found[place] = end.value
                del asked[place]
    return [found[place] for place in range(len(searches))]


def _search(width: int, l2: float, l1: float, max_rounds: int) -> Generator[np.ndarray, Sums, tuple[np.ndarray, float]]:
    """The steps of one fit: gives the points at which it needs sums, and in the end coefficients and intercept."""
    free = np.append(np.ones(width), 0.0)

    def penalty(at: np.ndarray) -> float:
        return float(l2 / 2 * (free * at * at).sum() + l1 * (free * np.abs(at)).sum())

    at = np.zeros(width + 1)
    sums = yield at
    for _ in range(max_rounds):
        gradient, hessian = sums.gradient + l2 * free * at, sums.hessian + l2 * np.diag(free)
        step = _least(hessian, gradient, at, l1 * free) - at
        fall = float(gradient @ step + l1 * (free * (np.abs(at + step) - np.abs(at))).sum())
        if fall > -LEAST_FALL:
            at = at + step
            break
        now = sums.loss + penalty(at)
        for halving in range(HALVINGS):
            share = 0.5 ** halving
            tried = at + share * step
            sums = yield tried
            if sums.loss + penalty(tried) <= now + 1e-4 * share * fall:
                break
        else:
            break
        at = tried
    return at[:-1], float(at[-1])


def sums_at(stored: RDD[Block], points: Sequence[np.ndarray]) -> list[Sums]:
    """One pass for all points. The sums of the tasks are added in the order of their partitions, so equal passes give equal
    sums."""
    side = len(points[0])
    total = np.zeros((len(points), 2 + side + side * side))
    for part in stored.mapPartitions(_adder(points)).collect():
        total += part
    total = total / total[:, :1]
    return [Sums(float(one[1]), one[2:2 + side], one[2 + side:].reshape(side, side)) for one in total]


def _adder(points: Sequence[np.ndarray]) -> Callable[[Iterator[Block]], Iterator[np.ndarray]]:
    def add(parts: Iterator[Block]) -> Iterator[np.ndarray]:
        side = len(points[0])
        sums = np.zeros((len(points), 2 + side + side * side))
        for x, label, weight in _pieces(parts, max(1, min(MATRIX_WORK // side ** 2, VECTOR_WORK // side))):
            for at, into in zip(points, sums):
                margin = x @ at
                chance = 0.5 * (1.0 + np.tanh(0.5 * margin))
                into[0] += weight.sum()
                into[1] += (weight * (np.logaddexp(0.0, margin) - label * margin)).sum()
                into[2:2 + side] += (weight * (chance - label)) @ x
                into[2 + side:] += ((x * (weight * chance * (1.0 - chance))[:, None]).T @ x).ravel()
        yield sums
    return add


def _pieces(parts: Iterator[Block], rows: int) -> Iterator[Block]:
    for x, label, weight in parts:
        for start in range(0, len(x), rows):
            yield x[start:start + rows], label[start:start + rows], weight[start:start + rows]


def _packer(side: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, side - 1)
            label, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            joined = np.concatenate([np.hstack([x, np.ones((batch.num_rows, 1))]).ravel(), label, weight])
            yield pa.RecordBatch.from_pydict({"block": pa.array([joined.tobytes()], pa.binary())})
    return pack


def _unpacker(side: int) -> Callable[[Row], Block]:
    def unpack(row: Row) -> Block:
        values = np.frombuffer(row.block)
        rows = len(values) // (side + 2)
        return values[:rows * side].reshape(rows, side), values[rows * side:rows * (side + 1)], values[rows * (side + 1):]
    return unpack


def _least(hessian: np.ndarray, gradient: np.ndarray, at: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """Where ``gradient * (b - at) + (b - at) * hessian * (b - at) / 2 + sum(l1 * |b|)`` is least.

    With an absolute penalty: accelerated soft-thresholding on scaled coordinates finds which coefficients are not zero and
    their signs, for which the rest is linear.
    """
    if not l1.any():
        return at - np.linalg.lstsq(hessian, gradient, rcond=1e-14)[0]
    scale = 1.0 / np.sqrt(np.maximum(np.diag(hessian), 1e-300))
    scaled = hessian * np.outer(scale, scale)
    pull, steep = l1 * scale, 1.0 / np.linalg.eigvalsh(scaled)[-1]
    here = ahead = start = at / scale
    slope, pace = gradient * scale, 1.0
    for number in range(1, INNER_ROUNDS + 1):
        moved = ahead - steep * (slope + scaled @ (ahead - start))
        there = np.sign(moved) * np.maximum(np.abs(moved) - steep * pull, 0.0)
        if (ahead - there) @ (there - here) > 0:
            pace = 1.0  # overshot: the momentum starts anew
        faster = (1.0 + np.sqrt(1.0 + 4.0 * pace * pace)) / 2.0
        ahead, here, pace = there + (pace - 1.0) / faster * (there - here), there, faster
        if number % CHECKED_ROUNDS == 0:
            exact = _with_signs_of(here * scale, hessian, gradient, at, l1)
            if exact is not None:
                return exact
    return here * scale


def _with_signs_of(near: np.ndarray, hessian: np.ndarray, gradient: np.ndarray, at: np.ndarray, l1: np.ndarray) -> np.ndarray | None:
    """The minimum if its coefficients have the signs of ``near``, else nothing."""
    kept, signs = (near != 0) | (l1 == 0), np.sign(near)
    off = (gradient + hessian @ (near - at) + l1 * signs)[kept]
    exact = near.copy()
    exact[kept] -= np.linalg.lstsq(hessian[np.ix_(kept, kept)], off, rcond=1e-14)[0]
    rest = np.abs(gradient + hessian @ (exact - at))[~kept]
    right = (rest <= l1[~kept] * (1 + 1e-9)).all() and (np.sign(exact) == signs)[kept & (l1 > 0)].all()
    return exact if right else None
