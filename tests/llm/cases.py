"""Small tables with everything that an operator must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that results use, as columns of the input.
CLASHING = ("n_tokens", "class_id", "node", "key", "score", "kept", "words", "held_out", "uid", "h", "spans", "verdict", "label", "quality", "word", "c", "item_id")


def words(rng: random.Random, n: int, letters: str = "aeiourstln") -> str:
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(n))


def odd_rows(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    long = words(rng, 30_000)
    prose = [words(rng, 60) for _ in range(6)]
    return [
        (0, None, "en", "a", None),
        (1, "", "en", "a", 0),
        (2, " \n\t ", None, "a", 4),
        (3, long, "en", "a", len(long)),
        (4, prose[0], "en", None, 5),
        (4, prose[0], "en", None, 5),
        (5, prose[0], "de", "b", 5),
        (None, prose[1], "de", "b", 5),
        (None, None, None, None, None),
        (7, "x" * 40_000, "en", "b", 9),
        (8, "ß漢字 🙂 é \x1c\x85  don't ''s 12345   end", "fr", "b", 9),
        *((10 + i, x, ("en", "de", "fr")[i % 3], "c", len(x)) for i, x in enumerate(prose)),
    ]


def odd(spark, rows=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows() if rows is None else rows, DOCUMENTS)
    return df.withColumns({x: F.lit("clash") for x in CLASHING})
