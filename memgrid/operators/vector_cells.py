"""Cells of vectors with a radius each, and which of them can hold a partner or a nearer neighbour at all.

A vector belongs to the centre it has the least angle to. Angles on the sphere obey the triangle
inequality, so a vector x at angle a from a centre is no nearer than a - r to any vector of that
centre's cell, r being the cell's radius. What that rules out is never compared; nothing else is left
out, so results are exact whatever the centres are. Centres come from a few rounds of k-means over a
bounded sample; they decide only how much is ruled out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memgrid.operators.blocks import COUNTS, MOST_PER_BLOCK, PAIRS, PARTNERS, PER_BLOCK, SPLIT, Best, Block, counts, first_copies, met, packed, pairs, partners, unpacked
from memgrid.operators.cuts import checkpointed

#: Numbers of the sample that centres are learned from, rounds, and numbers of all centres (16 MB).
SAMPLE_NUMBERS, ROUNDS, CENTRE_NUMBERS = 8_000_000, 8, 2_000_000
#: What rounding of angles may hide, and how far from 1 a unit vector's length may be.
SLACK, UNIT = 1e-5, 1e-3
#: Cells that a search starts with, at least, and blocks of them, at most, if these hold enough.
PROBES, FIRST_BLOCKS = 2, 8
#: Queries of a block of a search, vectors of one, and blocks of vectors that a task sees, at most.
SEARCHED, SEEN, SPAN = 32768, 16384, 64


@dataclass(frozen=True)
class Centres:
    """Unit vectors of one dimension. Vectors of another one, and those that are not of unit length, go to a cell of their own (-1) that rules nothing out."""

    points: np.ndarray

    @property
    def dimension(self) -> int:
        return self.points.shape[1]

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.points.T, -1, 1))

    def fits(self, rows: list) -> np.ndarray:
        return np.array([x is not None and len(x) == self.dimension and abs(sum(c * c for c in x) - 1) < UNIT for x in rows], bool)

    def those(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vectors of this dimension in a column of lists, and these."""
        own = pc.fill_null(pc.equal(pc.list_value_length(column), self.dimension), False)
        x = column.filter(own).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, self.dimension)
        return np.flatnonzero(own.to_numpy(zero_copy_only=False)), x


def learned(vectors: DataFrame, k: int | None = None, per_cell: int = PER_BLOCK) -> Centres:
    """Centres of the vectors' commonest dimension: one for every per_cell vectors, or k, as far as CENTRE_NUMBERS allows."""
    sizes = vectors.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None or not sizes["d"]:
        return Centres(np.zeros((0, 1)))
    d, n = sizes["d"], sizes["n"]
    k = max(1, min(k or n // per_cell + 1, CENTRE_NUMBERS // d, n))
    most = max(k, SAMPLE_NUMBERS // d)
    rows = vectors.where(F.size("embedding") == d)
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("node_id", F.lit(7)), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    x = rows.select("node_id", F.col("embedding").cast("array<double>").alias("embedding")).orderBy("node_id").limit(2 * most).select("embedding").toArrow()  # a bounded sample
    x = x.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    x = x[np.abs((x * x).sum(axis=1) - 1) < UNIT]
    if not len(x):
        return Centres(np.zeros((0, d)))
    rng = np.random.default_rng(11)
    points = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS if k > 1 else 1):
        near = (x @ points.T).argmax(axis=1)
        sums = np.zeros_like(points)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        points = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), points)
    return Centres(points)


def assigned(vectors: DataFrame, centres: Centres) -> DataFrame:
    """vectors (node_id, embedding and other columns) with cell and angle to its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            fit, x = centres.those(batch.column("embedding"))
            unit = np.abs(np.einsum("ij,ij->i", x, x) - 1) < UNIT
            fit, x = fit[unit], x[unit]
            if len(fit) and len(centres.points):
                a = centres.angles(x)
                cell[fit], angle[fit] = a.argmin(axis=1), a.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    return vectors.mapInArrow(run, schema)


#: Blocks of one cell at most; a block's number is its cell's place times this, and its own.
BLOCKS = 1 << 20


def dealt(vectors: DataFrame, threshold: float, by: str | None = None, centres: Centres | None = None, per_cell: int = PER_BLOCK) -> DataFrame:
    """Vectors dealt to pairs of blocks in which they may have a partner: g, d, i, j, b (its own block), node_id, embedding.

    A cell of more than per_cell vectors is split into blocks by a hash, so no pair of blocks has more
    than about twice as many, however alike vectors are. A vector goes to the pairs of its own block
    with each block of a cell that may hold a vector with sim >= threshold.
    """
    group = F.coalesce(F.col(by), F.lit("")) if by else F.lit("")
    df = vectors.where("embedding IS NOT NULL").select("node_id", "embedding", group.alias("g"), F.size("embedding").alias("d"))
    centres = centres or learned(vectors, per_cell=per_cell)
    k = len(centres.points)
    at = assigned(df, centres)
    cells = at.groupBy("g", "d", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("r"))
    cells = cells.groupBy("g", "d").agg(F.sort_array(F.collect_list(F.struct("cell", "r", F.ceil(F.col("n") / per_cell).alias("m")))).alias("cells"))  # no more than there are centres
    wide = float(np.arccos(np.clip(threshold - 1e-6, -1, 1))) + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("embedding").to_pylist()
            own, hashes = batch.column("cell").to_numpy(), batch.column("h").to_numpy()
            fit = np.flatnonzero(own >= 0)
            angles = np.zeros((len(rows), k))
            if len(fit):
                angles[fit] = centres.angles(np.array([rows[i] for i in fit], float))
            block, to, last, known = [], [], None, None
            for i, these in enumerate(batch.column("cells")):
                if last is None or not these.equals(last):
                    last, value = these, these.as_py()
                    known = np.array([c["cell"] for c in value]), np.array([c["r"] for c in value]), np.array([c["m"] for c in value])
                cell, radius, m = known
                mine = int(hashes[i] % m[np.searchsorted(cell, own[i])])
                block.append((int(own[i]) + 1) * BLOCKS + mine)
                # the cell of odd vectors meets all, as angles say nothing about them
                may = (cell < 0) | (own[i] < 0) | (angles[i][np.maximum(cell, 0)] <= wide + radius if k else True)
                to.append([(int(c) + 1) * BLOCKS + x for c, n in zip(cell[may], m[may], strict=True) for x in range(n)])
            names = ["node_id", "embedding", "g", "d", "b", "to"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), pa.array(block, pa.int64()), pa.array(to, pa.list_(pa.int64()))], names)

    rows = at.join(cells, ["g", "d"]).withColumn("h", F.pmod(F.xxhash64("node_id"), F.lit(1 << 40))).select("node_id", "embedding", "g", "d", "cell", "cells", "h")
    kind = "node_id string, embedding array<double>, g string, d int, b long, to array<long>"
    out = rows.mapInArrow(run, kind)
    pair = F.transform("to", lambda x: F.struct(F.least("b", x).alias("i"), F.greatest("b", x).alias("j")))
    return out.select("node_id", "embedding", "g", "d", "b", F.explode(F.array_distinct(pair)).alias("p")).select("*", "p.i", "p.j").drop("p")


def per_block(n: int) -> int:
    """Vectors of a block of n: few blocks, as each travels to as many tasks as there are others."""
    return min(MOST_PER_BLOCK, max(PER_BLOCK, n // SPLIT))


def block_pairs(vectors: DataFrame, threshold: float, tell: Callable, schema: str, by: str | None = None, centres: Centres | None = None, per_cell: int | None = None, links: DataFrame | None = None) -> DataFrame:
    """What tell() says of the pairs with sim >= threshold of each two blocks that may have some; links (source_id, target_id): pairs that are left out, either way.

    A block is one row of up to twice per_cell vectors, packed. Only blocks travel, each to as many
    tasks as there are blocks it may have partners in; within a task a vector meets those that its angle
    allows. What is found is told from there, so pairs travel only as far as tell() makes rows of them.
    """
    group = F.coalesce(F.col(by), F.lit("")) if by else F.lit("")
    df = vectors.where("embedding IS NOT NULL").select("node_id", "embedding", group.alias("g"), F.size("embedding").alias("d"))
    per_cell = per_cell or per_block(df.count())
    centres = centres or learned(df, per_cell=per_cell)
    wide = float(np.arccos(np.clip(threshold - 1e-6, -1, 1))) + SLACK
    at = assigned(df, centres)
    cells = at.groupBy("g", "d", "cell").agg(F.ceil(F.count("*") / per_cell).alias("blocks"))
    rows = at.join(cells, ["g", "d", "cell"]).withColumn("b", (F.col("cell").cast("long") + 1) * BLOCKS + F.pmod(F.xxhash64("node_id"), F.col("blocks"))).drop("blocks")
    if links is None:
        rows = rows.withColumn("links", F.lit(None).cast("array<string>"))
    else:
        both = links.selectExpr("source_id node_id", "target_id other").union(links.selectExpr("target_id", "source_id"))
        rows = rows.join(both.groupBy("node_id").agg(F.collect_set("other").alias("links")), "node_id", "left")

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        m = np.vstack(pdf.embedding.to_numpy()).astype(float)
        known = [(i, x) for i, these in enumerate(pdf.links) if these is not None for x in these]
        row = (*key, int(pdf.cell.iloc[0]), float(pdf.angle.max()), pdf.node_id.tolist(), packed(m), [i for i, _ in known], [x for _, x in known])
        return pd.DataFrame([row], columns=["g", "d", "b", "cell", "r", "ids", "m", "link_at", "link_to"])

    columns = "cell int, r double, ids array<string>, m binary, link_at array<int>, link_to array<string>"
    blocks = checkpointed(vectors.sparkSession)(rows.groupBy("g", "d", "b").applyInPandas(pack, f"g string, d int, b long, {columns}"))

    def pair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        cell, r, b = pdf.cell.to_numpy(), pdf.r.to_numpy(), pdf.b.to_numpy()
        out = []
        for k in range(len(pdf)):
            may = (cell[k:] < 0) | (cell[k] < 0)
            if cell[k] >= 0:
                between = centres.angles(centres.points[[cell[k]]])[0]
                may |= between[np.maximum(cell[k:], 0)] <= wide + r[k] + r[k:] + SLACK
            out += [(*key, int(b[k]), int(j)) for j in b[k:][may]]
        return pd.DataFrame(out, columns=["g", "d", "i", "j"])

    those = checkpointed(vectors.sparkSession)(blocks.select("g", "d", "b", "cell", "r").groupBy("g", "d").applyInPandas(pair, "g string, d int, i long, j long"))
    one = blocks.join(those.withColumn("b", F.col("i")), ["g", "d", "b"])
    two = blocks.join(those.where("i <> j").withColumn("b", F.col("j")), ["g", "d", "b"])

    def may(a: Block, b: Block) -> np.ndarray:
        if a.cell < 0 or b.cell < 0:  # angles say nothing about odd vectors
            return np.ones(len(a.ids), bool)
        return np.arccos(np.clip(a.m @ centres.points[b.cell], -1, 1)) <= wide + b.r

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {row["b"]: Block(row) for batch in batches for row in batch.to_pylist()}
        left, right = sides[min(sides)], sides[max(sides)]
        yield from tell(left, right, met(left, right, threshold, may))

    return one.unionByName(two).groupBy("g", "d", "i", "j").applyInArrow(cell, schema)


def similar_pairs(vectors: DataFrame, threshold: float, by: str | None = None, centres: Centres | None = None, per_cell: int | None = None, links: DataFrame | None = None) -> DataFrame:
    """id_a, id_b, sim of pairs of unit vectors with one size (and one `by`) and sim >= threshold: exact. Without those that links (source_id, target_id) have either way."""
    return block_pairs(vectors, threshold, pairs, PAIRS, by, centres, per_cell, links)


def pair_counts(vectors: DataFrame, thresholds: tuple[float, ...], links: DataFrame | None = None) -> DataFrame:
    """Threshold, n: pairs at or above each threshold, where there are any; no pair leaves the task that finds it."""
    found = block_pairs(vectors, min(thresholds), counts(thresholds), COUNTS, links=links)
    return found.groupBy("threshold").agg(F.sum("n").alias("n")).where("n > 0")


def similar_partners(vectors: DataFrame, threshold: float) -> DataFrame:
    """node_id, others: a node's similar ones, in as many rows as blocks they are found in."""
    return block_pairs(vectors, threshold, partners, PARTNERS)


def comparisons(vectors: DataFrame, threshold: float, by: str | None = None, centres: Centres | None = None, per_cell: int = PER_BLOCK) -> int:
    """How many pairs similar_pairs() compares."""
    sides = dealt(vectors, threshold, by, centres, per_cell).groupBy("g", "d", "i", "j").agg(F.count_if(F.col("b") == F.col("i")).alias("x"), F.count_if(F.col("b") == F.col("j")).alias("y"))
    return sides.select(F.sum(F.when(F.col("i") == F.col("j"), F.expr("x * (x - 1) div 2")).otherwise(F.col("x") * F.col("y"))).alias("n")).first()["n"] or 0


def allowed(q: np.ndarray, bound: np.ndarray, cell: dict, centres: Centres) -> np.ndarray:
    """Which queries may have something within their bound in a cell (cell, low, high)."""
    size = np.linalg.norm(q, axis=1)
    if cell["cell"] < 0 or q.shape[1] != centres.dimension:
        return np.ones(len(q), bool)
    angle = np.arccos(np.clip(q @ centres.points[cell["cell"]] / np.maximum(size, 1e-300), -1, 1))
    least = np.maximum(0, np.maximum(angle - cell["high"], cell["low"] - angle) - SLACK)
    return (size <= 1e-12) | (1 - np.cos(least) <= bound + 1e-7)


STORED = "node_id string, embedding array<double>, cell int, angle double"


@dataclass
class VectorIndex:
    """Vectors stored by cell in a folder that driver and executors share: the nearest ones without reading all."""

    spark: SparkSession
    path: str
    centres: Centres
    #: A row for each cell and dimension: cell, d, n, low, high (its least and largest angle); no more than centres, but for odd dimensions.
    cells: list[dict] = field(default_factory=list)
    #: Vectors that the last search compared with queries, and all there are times the queries; where it was asked to count.
    compared: tuple[int, int] = (0, 0)

    @staticmethod
    def build(vectors: DataFrame, path: str, k: int | None = None, per_cell: int | None = None) -> VectorIndex:
        """Writes vectors (node_id, embedding) by cell, ordered by the angle to the centre."""
        vectors = vectors.where("embedding IS NOT NULL").select("node_id", F.col("embedding").cast("array<double>").alias("embedding"))
        centres = learned(vectors, k, per_cell or per_block(vectors.count()))
        assigned(vectors, centres).repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle").write.mode("overwrite").parquet(path)
        spark = vectors.sparkSession
        stored = spark.read.schema(STORED).parquet(path)
        cells = stored.groupBy("cell", F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        return VectorIndex(spark, path, centres, [r.asDict() for r in cells.collect()])

    def _per_block(self, most: int) -> int:
        return min(most, per_block(sum(c["n"] for c in self.cells)))

    def _parts(self) -> dict[tuple[int, int], int]:
        return {(c["d"], c["cell"]): -(-c["n"] // self._per_block(SEEN)) for c in self.cells}

    def _vectors(self, k: int) -> DataFrame:
        """d, cell, j, n, width, ids, m: the stored vectors in packed blocks, a large cell in several; of equal vectors at least the k with the lowest ids."""
        parts = self.spark.createDataFrame([(*x, n) for x, n in self._parts().items()], "d int, cell int, parts long")
        stored = self.spark.read.schema(STORED).parquet(self.path).select("node_id", "embedding", "cell", F.size("embedding").alias("d"))

        def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for _, own in pdf.sort_values("node_id").groupby("d"):
                    yield own[first_copies(np.vstack(own.embedding.to_numpy()).astype(float), k)]

        def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node_id")
            m = np.vstack(pdf.embedding.to_numpy()).astype(float)
            keep = first_copies(m, k)
            ids = np.array([x.encode() for x in pdf.node_id[keep]])
            return pd.DataFrame([(*key, len(ids), ids.itemsize, ids.tobytes(), packed(m[keep]))], columns=["d", "cell", "j", "n", "width", "ids", "m"])

        v = stored.mapInPandas(thin, stored.schema).join(F.broadcast(parts), ["d", "cell"]).withColumn("j", F.pmod(F.xxhash64("embedding"), F.col("parts")))
        return v.groupBy("d", "cell", "j").applyInPandas(pack, "d int, cell int, j long, n int, width int, ids binary, m binary")

    def _queries(self, queries: DataFrame) -> DataFrame:
        """d, own, i, n, queries, m: queries in packed blocks by the cell that they are nearest to; -1 for those that angles say nothing about."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = np.full(batch.num_rows, -1, np.int32)
                fit, x = centres.those(batch.column("vector"))
                some = np.einsum("ij,ij->i", x, x) > 1e-24
                fit, x = fit[some], x[some]
                if len(fit) and len(centres.points):
                    own[fit] = (x @ centres.points.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pc.list_value_length(batch.column("vector")), pa.array(own)], [*batch.schema.names, "d", "own"])

        q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
        q = checkpointed(self.spark)(q.mapInArrow(run, "query_id long, vector array<double>, d int, own int"))
        size = q.groupBy("d", "own").agg(F.ceil(F.count("*") / self._per_block(SEARCHED)).alias("parts"))
        q = q.join(F.broadcast(size), ["d", "own"]).withColumn("i", F.pmod(F.xxhash64("query_id"), F.col("parts")))

        def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(*key, len(pdf), pdf.query_id.to_numpy(np.int64).tobytes(), packed(np.vstack(pdf.vector.to_numpy()).astype(float)))], columns=["d", "own", "i", "n", "queries", "m"])

        return q.groupBy("d", "own", "i").applyInPandas(pack, "d int, own int, i long, n int, queries binary, m binary")

    def _meet(self, q: DataFrame, v: DataFrame, tasks: list[tuple[tuple, int, list[tuple[int, int]]]], k: int, tell: Callable, schema: str) -> DataFrame:
        """What tell() says of each task's block of queries (d, own, i) after it met the blocks (cell, j) of vectors, one after the other in this order.

        A task is (block, span, blocks of vectors); a span above 0 starts from the bounds alone of what the block has so far.
        """
        by, centres = {(c["d"], c["cell"]): c for c in self.cells}, self.centres
        left = self.spark.createDataFrame([(t, -1, span, *block) for t, (block, span, _) in enumerate(tasks)], "t int, seq int, span int, d int, own int, i long")
        right = self.spark.createDataFrame([(t, seq, block[0], *x) for t, (block, _, those) in enumerate(tasks) for seq, x in enumerate(those)], "t int, seq int, d int, cell int, j long")
        kinds = {"t": "int", "seq": "int", "span": "int", "d": "int", "own": "int", "i": "long", "cell": "int", "n": "int", "width": "int", "ids": "binary", "m": "binary", "queries": "binary", "dist": "binary"}
        one, two = ([df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]) for df in (q.join(F.broadcast(left), ["d", "own", "i"]), v.join(F.broadcast(right), ["d", "cell", "j"]))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row, best = None, None
            for batch in batches:
                for at in range(batch.num_rows):
                    r = {c: batch.column(c)[at].as_py() for c in kinds}
                    m = unpacked(r["m"], r["d"], r["n"])
                    ids = None if r["ids"] is None else np.frombuffer(r["ids"], f"S{r['width']}")
                    if r["queries"] is not None:  # comes first
                        dist = None if r["dist"] is None else np.frombuffer(r["dist"], float).reshape(-1, k)
                        row, best = r, Best(m, k, most=dist[:, -1]) if r["span"] else Best(m, k, dist, ids)
                        continue
                    some = np.flatnonzero(allowed(best.q, best.bound(), by[r["d"], r["cell"]], centres))
                    if len(some):
                        best.see(some, ids, m)
            if row is not None:
                yield from tell(row, best)

        return one.unionByName(two).repartitionById(max(1, len(tasks)), "t").sortWithinPartitions("seq").mapInArrow(run, schema)

    def nearest(self, queries: DataFrame, k: int, probes: int = PROBES, count: bool = False) -> DataFrame:
        """V1: query_id, node_id, distance, rank of the k nearest of each query (query_id, vector), ties by id: as top_k_many(), exact.

        Queries and vectors travel in packed blocks by cell; a task has one block of queries, and blocks
        of vectors pass by. A block of queries meets the cells that are nearest to its own first, until
        they hold k vectors; the k-th distance found there is a query's bound. Then it meets the cells
        that may hold something nearer for some of its queries.
        """
        cut = checkpointed(self.spark)
        q, v = cut(self._queries(queries)), cut(self._vectors(k))
        blocks = q.select("d", "own", "i", "n").collect()  # a row for each block
        held = {(r.d, r.cell, r.j): r.n for r in v.select("d", "cell", "j", "n").collect()}
        of: dict[tuple[int, int], list[int]] = {}
        for d, c, j in sorted(held):
            of.setdefault((d, c), []).append(j)
        near: dict[tuple[int, int], list[int]] = {}
        first: list[tuple[tuple, int, list[tuple[int, int]]]] = []
        for b in blocks:
            if (b.d, b.own) not in near:
                cells = [c["cell"] for c in self.cells if c["d"] == b.d]
                angle = self.centres.points @ self.centres.points[b.own] if b.own >= 0 else None
                near[b.d, b.own] = cells if angle is None else sorted(cells, key=lambda c, angle=angle: (c < 0, -angle[c], c))
            those, n = [], 0
            for at, c in enumerate(near[b.d, b.own]):
                for j in of.get((b.d, c), []):
                    if n < k or (at < probes and len(those) < FIRST_BLOCKS):
                        those.append((c, j))
                        n += held[b.d, c, j]
            first.append(((b.d, b.own, b.i), 0, those))
        cells, centres = self.cells, self.centres

        def bounds(row: dict, best: Best) -> Iterator[pa.RecordBatch]:
            more = [(c["cell"], int(allowed(best.q, best.bound(), c, centres).sum())) for c in cells if c["d"] == row["d"]]
            out = {c: row[c] for c in ("d", "own", "i", "n", "queries", "m")} | {"dist": best.d.tobytes(), "width": best.ids.itemsize, "ids": best.ids.tobytes(), "cells": [c for c, some in more if some], "some": [some for _, some in more if some]}
            yield pa.RecordBatch.from_pylist([out], pa.schema([("d", pa.int32()), ("own", pa.int32()), ("i", pa.int64()), ("n", pa.int32()), ("queries", pa.binary()), ("m", pa.binary()), ("dist", pa.binary()), ("width", pa.int32()), ("ids", pa.binary()), ("cells", pa.list_(pa.int32())), ("some", pa.list_(pa.int64()))]))

        q = cut(self._meet(q, v, first, k, bounds, "d int, own int, i long, n int, queries binary, m binary, dist binary, width int, ids binary, cells array<int>, some array<long>"))
        told = {(r.d, r.own, r.i): dict(zip(r.cells, r.some, strict=True)) for r in q.select("d", "own", "i", "cells", "some").collect()}  # a row for each block
        spans = -(-2 * self.spark.sparkContext.defaultParallelism // len(first)) if 0 < len(first) < self.spark.sparkContext.defaultParallelism else 1
        tasks = []
        for block, _, done in first:
            rest = [(c, j) for c in near[block[:2]] if c in told[block] for j in of.get((block[0], c), []) if (c, j) not in done]
            step = max(1, min(SPAN, -(-len(rest) // spans)))
            tasks += [(block, at // step, rest[at : at + step]) for at in range(0, max(1, len(rest)), step)]
        if count:
            n = {(b.d, b.own, b.i): b.n for b in blocks}
            asked = sum(n[b] * held[b[0], *x] for b, _, those in first for x in those) + sum(told[b][c] * held[b[0], c, j] for b, _, those in tasks for c, j in those)
            self.compared = asked, sum(n.values()) * sum(c["n"] for c in cells)

        def found(row: dict, best: Best) -> Iterator[pa.RecordBatch]:
            ids = np.frombuffer(row["queries"], np.int64)
            for at in range(0, len(ids), 4096):
                d = best.d[at : at + 4096]
                x, y = np.nonzero(d < np.inf)
                names = pa.array(best.ids[at : at + 4096][x, y].astype(object), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 4096][x]), names, pa.array(d[x, y]), pa.array(y.astype(np.int32) + 1)], ["query_id", "node_id", "distance", "rank"])

        best = self._meet(q, v, tasks, k, found, "query_id long, node_id string, distance double, rank int")
        if len(tasks) == len(first):
            return best
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "node_id"))
        return best.withColumn("rank", rank).where(F.col("rank") <= k)
