"""Operator 11: embedding whitening by a two-pass covariance.

Entries become whole numbers, x = floor(256 * entry). The fit list holds each distinct x-vector
once. The first pass adds up exact whole numbers, which give the mean; the second adds up outer
products of centred vectors, one matrix product for each batch; treeAggregate merges both. The
driver gets one matrix of the dimension's square, LAPACK gives its eigenvectors, and those of the
first components go to the tasks, which project all rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memgrid.llm.common import give_back, written

SCALE, COMPONENTS = 256, 4
#: Vectors of one matrix product.
ROWS = 4096
#: A component has variance if its eigenvalue is above this share of the largest.
RANK_EPS = 1e-13


def clean(embedding: str = "embedding") -> Column:
    """True for a vector that is not null and has only finite entries."""
    c = F.col(embedding)
    return c.isNotNull() & F.forall(c, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))


def whole(embedding: str = "embedding") -> Column:
    """x: each entry, as double, times SCALE, rounded down to a long (beyond a long's range: its limit)."""
    return F.transform(F.col(embedding), lambda v: F.floor(v.cast("double") * F.lit(float(SCALE))).cast("long"))


@dataclass(frozen=True)
class Whitening:
    """What rows are projected by: n and exact sums of the fit list, eigenvalues by fall, eigenvectors as columns."""

    dimension: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0


def matrices(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[np.ndarray]:
    """The vectors x of the batches as matrices of ROWS rows at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            x = batch.column("x").slice(at, ROWS)
            yield x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(x), dimension)


def merged(fit: DataFrame, dimension: int, part: Callable[[Iterator[np.ndarray]], object], merge: Callable):
    """What `part` makes of the vectors of each partition, put together by a tree; None without vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = part(matrices(batches, dimension))
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["part"])
        give_back()

    def both(a, b):
        return b if a is None else a if b is None else merge(a, b)

    return fit.mapInArrow(run, "part binary").rdd.treeAggregate(None, lambda a, row: both(a, pickle.loads(row["part"])), both)


def total(vectors: Iterator[np.ndarray]) -> tuple[int, list[int]] | None:
    """First pass: number and exact sums by dimension; Python's whole numbers where a long may not do."""
    n, sums = 0, None
    for x in vectors:
        safe = len(x) * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) < 1 << 62
        s = (x if safe else x.astype(object)).sum(axis=0).tolist()
        n, sums = n + len(x), s if sums is None else [a + b for a, b in zip(sums, s, strict=True)]
    return (n, sums) if n else None


def centre(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole part q and rest r of each sum over n, and the mean's fraction r / n: x - S/n = (x - q) - r/n."""
    q, r = zip(*(divmod(s, n) for s in sums), strict=True)
    return np.array(q, np.int64), np.array(r, object), np.array([x / n for x in r])


def shifted(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x - q as double: exact before rounding, also where the difference of two longs is none."""
    if x.size == 0 or max(abs(int(x.min())), abs(int(x.max()))) < 1 << 61:
        return (x - q).astype(np.float64)
    return (x.astype(object) - q.astype(object)).astype(np.float64)


def outer(n: int, sums: tuple[int, ...]) -> Callable:
    """Second pass: the sum of the outer products of x - S/n."""
    q, _, fraction = centre(n, sums)

    def part(vectors: Iterator[np.ndarray]) -> np.ndarray | None:
        out = None
        for x in vectors:
            c = shifted(x, q) - fraction
            out = c.T @ c if out is None else out + c.T @ c
        return out

    return part


def moments(project: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """Number, mean and sum of centred outer products of what vectors project to."""

    def part(vectors: Iterator[np.ndarray]):
        out = None
        for x in vectors:
            w = project(x)
            m = w.mean(axis=0)
            one = (len(w), m, (w - m).T @ (w - m))
            out = one if out is None else joined(out, one)
        return out

    return part


def joined(a, b):
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def projection(w: Whitening, components: int) -> Callable[[np.ndarray], np.ndarray]:
    """Vectors x to their whitened components; those without variance are left out."""
    q, _, fraction = centre(w.n, w.sums)
    k = live(w, components)
    base = w.vectors[:, :k] / np.sqrt(w.values[:k])
    return lambda x: (shifted(x, q) - fraction) @ base


def live(w: Whitening, components: int) -> int:
    """How many of the first components have variance."""
    top = w.values[:components]
    return int((top > max(w.values[0], 0.0) * RANK_EPS * w.dimension).sum()) if len(top) else 0


def exact_deviation(x: np.ndarray, n: int, q: np.ndarray, r: np.ndarray) -> list[int]:
    """sum over dimensions of (n * x - S)^2, which is (n * (x - q) - r)^2: exact."""
    far = max((abs(int(x.min()) - int(q.max())), abs(int(x.max()) - int(q.min()))), default=0) if x.size else 0
    if (n * (far + 1)) ** 2 * x.shape[1] < 1 << 62:
        d = n * (x - q) - r.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * (x.astype(object) - q.astype(object)) - r
    return (d * d).sum(axis=1).tolist()


def prepared(embeddings: DataFrame, embedding: str = "embedding") -> DataFrame:
    """vec_id, x of the rows that remain."""
    return embeddings.where(clean(embedding)).select(F.col("vec_id").cast("long").alias("vec_id"), whole(embedding).alias("x"))


def fit(embeddings: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learns from the distinct vectors x of `embeddings`; None if there are none.

    The dimension is that of most distinct vectors (of the larger one, if two are level).
    """
    vectors = written(prepared(embeddings).where(F.size("x") > 0).select("x").distinct(), "fit")
    sizes = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return None
    d = sizes["d"]
    vectors = vectors.where(F.size("x") == d)
    n, sums = merged(vectors, d, total, lambda a, b: (a[0] + b[0], [s + t for s, t in zip(a[1], b[1], strict=True)]))
    sums = tuple(map(int, sums))
    v = merged(vectors, d, outer(n, sums), np.add) / n
    values, base = np.linalg.eigh(v)
    w = Whitening(d, n, sums, values[::-1].copy(), base[:, ::-1].copy(), float(np.trace(v)))
    k = live(w, components)
    if not k:
        return w
    count, _, square = merged(vectors, d, moments(projection(w, components)), joined)
    return Whitening(d, n, sums, w.values, w.vectors, w.trace, float(np.abs(square / count - np.eye(k)).max()))


def whiten(embeddings: DataFrame, w: Whitening | None, components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    embeddings: vec_id, embedding (other columns are not read). Rows whose vector is null or has null
    or non-finite entries are dropped, and so are vectors of another dimension than the fitted one
    (empty ones too), which have no place in its space. Repeated rows give repeated results; a null
    vec_id stays null. deviation is decimal(38, 0), null where that does not hold it. A component
    without variance has whitened null and explained 0, and does not count in identity_error, which
    is 0 where there is none with variance. A table without vectors gives no rows.
    """
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if w is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    d, shown = w.dimension, min(components, w.dimension)
    k = live(w, components)
    project = projection(w, components)
    q, r, _ = centre(w.n, w.sums)
    explained = [float(w.values[i] / w.trace) if i < k else 0.0 for i in range(shown)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = next(matrices(iter([part]), d))
                m = len(x)
                values = np.full((m, shown), np.nan)
                values[:, :k] = project(x)
                deviation = [v if v < 10**38 else None for v in exact_deviation(x, w.n, q, r)]
                again = np.repeat(np.arange(m), shown)
                columns = [
                    part.column("vec_id").take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * shown, w.n)),
                    pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(again)),
                    pa.array(values.ravel(), mask=np.tile(np.arange(shown) >= k, m)),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * shown, w.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        give_back()

    return prepared(embeddings).where(F.size("x") == d).mapInArrow(run, schema)
