"""Operator 5: a quality classifier by compression.

Two Zstandard dictionaries are built from good and bad labelled text. A whole text is compressed
with each; by how many bytes the good one saves more, as a share of the text's bytes, is the
normalised difference. A logistic curve of that difference alone, fitted on labelled rows that the
dictionaries have not seen, makes it a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memgrid.llm.common import arrow_map, crc_mod, share, texts_of, written

DICT_BYTES, LEVEL, CHUNK = 112_640, 3, 2048
#: The sample that is fitted on: about so many different labelled texts of each class, and about so many bytes of them.
MAX_PER_CLASS, MAX_BYTES = 1500, 32 << 20


@dataclass
class Model:
    good: bytes
    bad: bytes
    bias: float = 0.0
    slope: float = 0.0
    level: int = LEVEL

    def compressors(self):
        return [zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) if d else zstandard.ZstdCompressor(level=self.level, write_content_size=False) for d in (self.good, self.bad)]

    def differences(self, texts: list[str], compressors) -> np.ndarray:
        """(size by the bad dictionary - size by the good one) / bytes of the text; 0 for an empty text."""
        out = np.zeros(len(texts))
        for i, x in enumerate(texts):
            if data := x.encode():
                good, bad = (len(c.compress(data)) for c in compressors)
                out[i] = (bad - good) / len(data)
        return out

    def scores(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * difference, -30, 30)))


def _dictionary(texts: list[str]) -> bytes:
    samples = [x[i : i + CHUNK] for t in texts for x in [t.encode()] for i in range(0, len(x), CHUNK)]
    samples = [s for s in samples if len(s) >= 16]
    size = min(DICT_BYTES, max(512, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8, threads=0).as_bytes()
    except zstandard.ZstdError:  # too little text for it
        return b"".join(samples)[-DICT_BYTES:]


def _logistic(d: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Bias and slope of the curve, by Newton's method; the difference is scaled to a deviation of 1 meanwhile."""
    scale = d.std() or 1.0
    x = np.stack([np.ones(len(d)), d / scale], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1] / scale)


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """A model from documents with a label 0 or 1, where crc32(doc_id as text) mod 3 is not 1.

    Fitted on about max_per_class different labelled texts of each class and about max_bytes of
    them, chosen by a hash of the doc_id and text; rows that repeat a doc_id and text count once, a
    doc_id with both labels counts for both. The curve is fitted on differences by dictionaries
    from the half of the rows that a text isn't in, and corrected for the classes' true shares; the
    model's own dictionaries are from all rows. With one class only, scores are its share.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(crc_mod(F.col("doc_id"), 3) != 1).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    known = texts.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("size")).join(labels, "doc_id").distinct()
    known = written(known, "labelled")
    sizes = {r.y: (r.n, r.size) for r in known.groupBy("y").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    pick = F.lit(False)
    for y, (n, size) in sizes.items():
        bound = min(max_per_class, n * max_bytes // max(1, len(sizes) * size))
        pick = pick | ((F.col("y") == y) & share(n, bound, F.col("doc_id"), F.col("h")))
    # the sample has about 2 x max_per_class rows, so its keys may be broadcast
    sample = F.broadcast(known.where(pick).select("doc_id", "h", "y"))
    rows = texts.withColumn("h", F.xxhash64("text")).join(sample, ["doc_id", "h"]).groupBy("doc_id", "h", "y").agg(F.first("text").alias("text"))
    rows = rows.select("text", "y", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).alias("part")).collect()
    rows.sort(key=lambda r: (r.part, r.y, r.text))
    kind = {(y, p): [r.text for r in rows if r.y == y and r.part == p] for y in (0, 1) for p in (0, 1)}
    model = Model(*(_dictionary(kind[y, 0] + kind[y, 1]) for y in (1, 0)))
    d, y = [], []
    for p in (0, 1):  # each half's differences by dictionaries from the other
        half = Model(*(_dictionary(kind[c, 1 - p]) for c in (1, 0)))
        d.append(half.differences(kind[1, p] + kind[0, p], half.compressors()))
        y += [1.0] * len(kind[1, p]) + [0.0] * len(kind[0, p])
    d, y = np.concatenate(d), np.array(y)
    if 0 < y.sum() < len(y):
        model.bias, model.slope = _logistic(d, y)
        model.bias += float(np.log((sizes[1][0] / sizes[0][0]) / (y.sum() / (len(y) - y.sum()))))
    elif sizes:  # one class only
        n = [sizes.get(c, (0, 0))[0] for c in (1, 0)]
        model.bias = float(np.log((n[0] + 1) / (n[1] + 1)))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (higher: label 1 likelier), predicted, difference; a row for each row of docs.

    A null text counts as empty; an empty text has difference 0 and the score that goes with it.
    Repeated rows give repeated results. If there were no labels at all, each score is 0.5.
    """

    def make():
        compressors = model.compressors()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            d = model.differences(texts_of(batch), compressors)
            s = model.scores(d)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32()), pa.array(d, pa.float64())], ["doc_id", "score", "predicted", "difference"])

        return f

    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, "doc_id long, score double, predicted int, difference double")
