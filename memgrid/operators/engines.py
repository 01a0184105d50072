"""Engines as plug points: embedders, rerankers and deciders by name, with deterministic ones built in."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())
#: A function of a Series of texts that returns a Series of vectors, null where it can't.
Embedder = Callable[[pd.Series], pd.Series]

_embedders: dict[str, Callable[[int], Embedder]] = {}


def register(name: str, make: Callable[[int], Embedder]) -> None:
    """An embedder by name; make(dimension) is called once for each task."""
    _embedders[name] = make


def hashing(dimension: int, model: str = "hashing") -> Embedder:
    """V4: three signed buckets for each token and a signature of the whole text, of unit length, eight digits."""
    import re

    word = re.compile(r"\w+")

    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def places(token: str):
            if token not in known:
                d = hashlib.blake2b(f"{model}:{token}".encode(), digest_size=24).digest()
                at = np.array([int.from_bytes(d[k : k + 4], "big") % dimension for k in (1, 7, 13)])
                known[token] = at, np.array([-1.0 if d[k + 4] % 2 else 1.0 for k in (1, 7, 13)]) * (1 + d[0] / 255)
            return known[token]

        def one(text: str | None):
            if text is None:
                return None
            v = np.zeros(dimension)
            for t in word.findall(text.casefold()) or ["<empty>"]:
                np.add.at(v, *places(t))
            d = np.frombuffer(hashlib.blake2b(f"{model}|doc|{text}".encode(), digest_size=32).digest(), np.uint8)
            np.add.at(v, np.arange(32) % dimension, d / 255 * 2 - 1)
            n = np.linalg.norm(v)
            return np.round(v / n, 8).tolist() if n else v.tolist()

        return texts.map(one)

    return embed


register("hashing", hashing)


def embedded(text: Column, engine: str = "hashing", dimension: int = 64) -> Column:
    """V4, V6: vectors of texts by a named engine. An engine that fails gives null: a later leg skips it, and no other engine's vectors get mixed in."""
    make = _embedders[engine]

    @F.pandas_udf(VECTOR)
    def f(texts: pd.Series) -> pd.Series:
        try:
            return make(dimension)(texts)
        except (OSError, TimeoutError):
            return pd.Series([None] * len(texts))

    return f(text)


#: A function of two columns, the query and a document, that returns their score as a column.
Reranker = Callable[[Column, Column], Column]
_rerankers: dict[str, Reranker] = {}


def register_reranker(name: str, score: Reranker) -> None:
    """A reranker by name."""
    _rerankers[name] = score


def reranked(query: Column, document: Column, engine: str) -> Column:
    """Scores by a named engine; 0 where none of that name is there, so penalties alone decide."""
    score = _rerankers.get(engine)
    return score(query, document) if score else F.lit(0.0)


def fingerprint(provider: str, model: str, dimension: int | None, base_url: str | None = None, endpoint: str | None = None, api_key_env: str | None = None) -> str:
    """what an index of vectors was made with; another one means that it has to be built anew.

    A provider that is reached over the network is told apart by where it is reached as well.
    """
    settings: dict[str, object] = {"provider": provider, "model": model, "dimension": dimension}
    if provider in ("ollama", "remote_api"):
        settings |= {"base_url": base_url, "endpoint": endpoint}
    if provider == "remote_api":
        settings["api_key_env"] = api_key_env
    return "sha1:" + hashlib.sha1(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def query_chunks(queries: DataFrame, least: int = 24) -> DataFrame:
    """V3: the whole query (chunk 0) and its parts between rules, if they are long enough; each has a vote."""
    parts = F.filter(F.transform(F.split("text", "\n---\n"), lambda c: F.trim(c, F.lit(" \n\t"))), lambda c: (F.length(c) >= least) & (c != F.trim(F.col("text"), F.lit(" \n\t"))))
    return queries.select("query_id", F.posexplode(F.concat(F.array("text"), parts)).alias("chunk", "text"))


def decided(drafts: DataFrame, decide: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Decisions for drafts (draft_id, candidates) by a hook; the stub creates what has no candidate and complements the first otherwise."""
    if decide:
        return decide(drafts)
    some = F.size("candidates") > 0
    none = F.array().cast("array<string>")
    return drafts.select("draft_id", F.when(some, "complement").otherwise("create").alias("action"), F.when(some, F.slice("candidates", 1, 1)).otherwise(none).alias("targets"), F.lit(1.0).alias("confidence"))
