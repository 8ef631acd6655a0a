"""Whitening of embeddings on their leading components, by Chebyshev-filtered subspace iteration.

Each step multiplies the covariance of the fit list with a block of a few columns in one
distributed pass over the centred vectors, Xᵀ(XQ). A polynomial recurrence of such
passes damps the spectrum below the block, then QR and a Rayleigh-Ritz step give new
estimates, until their residuals certify them. The covariance itself is never formed.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.scratch import Scratch

COMPONENTS = 4
SCALE = 256
#: Columns of the block for each component sought; the block grows where the spectrum is flat.
BLOCK = 8
#: Rows of one packed block of vectors.
PACK_ROWS = 4096
#: The filter strengthens the first column against the damped ones by this at most in one round.
GAIN = 1e8
MAX_DEGREE = 24
#: Where more passes than this are foreseen, the block grows.
FORESEEN = 80
MAX_ROUNDS = 100
#: Residual against the gap to the next eigenvalue, and against the largest one.
AGAINST_GAP, AGAINST_FIRST = 1e-11, 1e-14
#: Components of less variance than this share of the first are not whitened.
LEAST_SHARE = 1e-12

log = logging.getLogger(__name__)


def _finite(vector: Column) -> Column:
    size = F.lit(float("inf"))
    return F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < size))


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and x (longs) of the rows with a finite vector of the commonest length, and that length.

    Of two lengths equally common the greater one counts; empty vectors never do.
    """
    rows = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & _finite(F.col("embedding")))
    size = F.size("embedding")
    first = rows.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    width = first.size if first else 0
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return rows.where(size == width).select("vec_id", x.alias("x")), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    offset, rows = column.offset, len(column)
    return column.values.to_numpy(zero_copy_only=False)[offset * width : (offset + rows) * width].reshape(rows, width)


def packed(x: DataFrame, width: int) -> DataFrame:
    """Each different vector once, in binary blocks of longs."""

    def pack(batches):
        for batch in batches:
            values = _matrix(batch.column(0), width)
            for at in range(0, len(values), PACK_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([values[at : at + PACK_ROWS].tobytes()], pa.binary())], names=["body"])

    return x.select("x").distinct().mapInArrow(pack, "body binary")


def _blocks(batches, width: int):
    for batch in batches:
        for body in batch.column(0):
            yield np.frombuffer(body.as_buffer(), np.int64).reshape(-1, width)


@dataclass
class Moments:
    """Number of vectors and their exact sums."""

    n: int
    sums: list[int]

    def centre(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: the whole part of the mean is taken off exactly, the rest in double."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest


def moments(blocks: DataFrame, width: int) -> Moments:
    """Sums by dimension in two halves of a long each, so that they cannot overflow."""

    def add(batches):
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for x in _blocks(batches, width):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)], names=["place", "n", "high", "low"]
        )

    rows = blocks.mapInArrow(add, "place long, n long, high long, low long").groupBy("place").agg(F.sum("n"), F.sum("high"), F.sum("low"))
    table = sorted(rows.collect())
    return Moments(table[0][1] if table else 0, [(row[2] << 32) + row[3] for row in table])


class Covariance:
    """The covariance of the packed vectors (divisor n) as an operator: products with a block, one pass each."""

    def __init__(self, blocks: DataFrame, width: int, centre: Moments):
        self.blocks, self.width, self.centre, self.passes = blocks, width, centre, 0

    def times(self, block: np.ndarray) -> np.ndarray:
        """Covariance times `block` (width x columns); the last row of cells is the trace."""
        width, centre, columns = self.width, self.centre, block.shape[1]

        def multiply(batches):
            cells, trace = np.zeros((width, columns)), 0.0
            for x in _blocks(batches, width):
                y = centre.centre(x)
                cells += y.T @ (y @ block)
                trace += float((y * y).sum())
            flat = np.append(cells.ravel(), trace) / centre.n
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "value"])

        summed = self.blocks.mapInArrow(multiply, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(width * columns + 1)
        out[summed.column("cell").to_numpy()] = summed.column("value").to_numpy()
        self.passes += 1
        self.trace = float(out[-1])
        return out[:-1].reshape(width, columns)


@dataclass
class Components:
    """Eigenvalues in falling order, unit eigenvectors as columns, and how well they are known."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    certified: bool
    passes: int


def _ritz(block: np.ndarray, image: np.ndarray):
    """Rayleigh-Ritz on an orthonormal block and its image: values in falling order, vectors, their images."""
    small = block.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], block @ turn, image @ turn


def _filtered(operator: Covariance, block: np.ndarray, image: np.ndarray, cut: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial of the covariance times `block`: small on [0, cut], growing fast above."""
    before, current = block, image * (2 / cut) - block
    for _ in range(degree - 1):
        before, current = current, 2 * (operator.times(current) * (2 / cut) - current) - before
    return current


def leading(operator: Covariance, count: int, seed: int = 11) -> Components:
    """The `count` largest eigenvalues and their vectors.

    They are certified when each residual is small against the gap to the other
    values (or at rounding level), and a further round that starts the rest of the
    block from new random columns finds no larger value.
    """
    width, draw = operator.width, np.random.Generator(np.random.PCG64(seed))
    size = min(width, max(BLOCK * count, 1))
    block = np.linalg.qr(draw.standard_normal((width, size)))[0]
    values, vectors, image = _ritz(block, operator.times(block))
    confirmed = None
    for _ in range(MAX_ROUNDS):
        first, found = max(values[0], 0.0), values[:count]
        residuals = np.linalg.norm(image[:, :count] - vectors[:, :count] * found, axis=0)
        gaps = np.array([min((abs(v - w) for j, w in enumerate(values) if j != i), default=first) for i, v in enumerate(found)])
        small = bool((residuals <= np.maximum(AGAINST_GAP * gaps, AGAINST_FIRST * width * first)).all())
        whole = vectors.shape[1] == width
        if small and (whole or confirmed is not None and np.allclose(found, confirmed, rtol=1e-10, atol=1e-12 * first)):
            return Components(found, vectors[:, :count], residuals, operator.trace, True, operator.passes)
        confirmed = found if small else None
        if small:
            fresh = draw.standard_normal((width, vectors.shape[1] - count))
            block = np.linalg.qr(np.concatenate([vectors[:, :count], fresh], axis=1))[0]
            values, vectors, image = _ritz(block, operator.times(block))
            first = max(values[0], 0.0)
        cut = max(values[-1], 1e-2 * values[min(count, len(values)) - 1], 1e-300)
        growth = math.acosh(max(2 * values[min(count, len(values)) - 1] / cut - 1, 1 + 1e-12))
        if growth * FORESEEN < math.log(1 / AGAINST_GAP) and vectors.shape[1] < width:
            more = min(width - vectors.shape[1], max(vectors.shape[1] // 4, 1))
            block = np.linalg.qr(np.concatenate([vectors, draw.standard_normal((width, more))], axis=1))[0]
            values, vectors, image = _ritz(block, operator.times(block))
            continue
        steep = math.acosh(max(2 * first / cut - 1, 1 + 1e-12))
        degree = int(min(max(math.log(2 * GAIN) / steep, 2), MAX_DEGREE))
        block = np.linalg.qr(_filtered(operator, vectors, image, cut, degree))[0]
        values, vectors, image = _ritz(block, operator.times(block))
    log.warning("components are not certified after %d passes, residuals %s", operator.passes, residuals)
    return Components(values[:count], vectors[:, :count], residuals, operator.trace, False, operator.passes)


def _exact_deviation(x: np.ndarray, centre: Moments) -> list[int | None]:
    """Sum of squares of n * x - sums of each row; null where a long cannot hold it."""
    sums = np.array(centre.sums, dtype=object)
    rough = centre.centre(x) * centre.n
    largest = float(np.abs(rough).max(initial=0.0)) + float(np.abs(x.astype(np.float64)).max(initial=0.0)) * centre.n
    if largest < 2.0**62 and (rough * rough).sum(axis=1).max(initial=0.0) < 2.0**62:
        apart = x * centre.n - np.array(centre.sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = [int(((row * centre.n - sums) ** 2).sum()) for row in x.astype(object)]
    return [value if value < 1 << 63 else None for value in exact]


def whiten(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: n, deviation, whitened, explained, identity_error, certified.

    Rows whose vector is null, empty, of another length than the commonest or holds
    null or non-finite entries are left out. Equal vectors count once for
    the fit; all their rows are returned. Rows without vec_id are treated like others. There are
    fewer than `count` components where the vectors span fewer dimensions: one
    vector, or none, gives no row. Of equal eigenvalues any basis may be taken.
    Entries of 2^55 or more in size saturate; a deviation beyond a long is null.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "whitening")
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows, width = usable(embeddings.select("vec_id", "embedding"))
    fields = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, certified boolean"
    if not width:
        return spark.createDataFrame([], fields)
    blocks = scratch.write(packed(rows, width), "blocks")
    centre = moments(blocks, width)
    operator = Covariance(blocks, width, centre)
    found = leading(operator, min(count, width))
    used = [k for k, value in enumerate(found.values) if value > LEAST_SHARE * max(found.trace, 1e-300)]
    if not used:
        return spark.createDataFrame([], fields)
    values, turn = found.values[used], found.vectors[:, used] / np.sqrt(found.values[used])
    error = float(np.abs(turn.T @ operator.times(turn) - np.eye(len(used))).max())
    explained, certified, n = values / found.trace, found.certified, centre.n
    scratch.release("blocks")

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), width)
            white = centre.centre(x) @ turn
            total, each = len(x) * len(used), np.repeat(np.arange(len(x)), len(used))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, len(used) + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(total, n)), pa.array(_exact_deviation(x, centre), pa.int64()).take(pa.array(each)), pa.array(white.ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(total, error)), pa.array(np.full(total, certified)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "certified"],
            )

    return rows.mapInArrow(score, fields)
