"""Order-dependent packings as folds over sorted arrays (T9-T12): one row for each group, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def greedy_budget(sizes: Column, budget: int) -> Column:
    """For each size in order whether it still fits what is left; one that doesn't is skipped, not an end."""
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<boolean>").alias("take"))

    def step(s: Column, x: Column) -> Column:
        fits = x <= s["left"]
        return F.struct((s["left"] - F.when(fits, x).otherwise(0)).cast("long").alias("left"), F.concat(s["take"], F.array(fits)).alias("take"))

    return F.aggregate(sizes, start, step, lambda s: s["take"])


def chunks(sizes: Column, limit: int, joiner: int = 0, most: int | None = None) -> Column:
    """The chunk, from 0, of each size in order; a chunk's sizes and joiners stay within limit, its items within most.

    Nothing is split: an item over the limit is a chunk of its own.
    """
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        added = x + F.when(s["n"] > 0, joiner).otherwise(0)
        full = (s["n"] > 0) & (s["size"] + added > limit)
        if most is not None:
            full = full | (s["n"] >= most)
        chunk = s["chunk"] + F.when(full, 1).otherwise(0)
        return F.struct(chunk.alias("chunk"), F.when(full, x).otherwise(s["size"] + added).cast("long").alias("size"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.concat(s["out"], F.array(chunk)).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def document_batches(tokens: Column, budget: int, most: int = 32, special: int = 2) -> Column:
    """The request, from 0, that each document goes into: no more than `most`, and tokens with `special` ones each within budget."""
    return chunks(F.transform(tokens, lambda x: (x + special).cast("long")), budget, 0, most)


def lesson_batches(sizes: Column, budget: int, most: int) -> Column:
    """The call that each lesson goes into, by the size of its evidence and by number; null if one lesson alone is over the budget."""
    return F.when(~F.exists(sizes, lambda x: x > budget), chunks(sizes, budget, 0, most))
