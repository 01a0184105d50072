"""Operator 4: language identification by interpolated Kneser-Ney character models.

One model per language, of orders 1 to ORDER over letters (lower case, each run of anything else
is one blank). The models of all languages are stored together: for each order one sorted array of
n-gram hashes with a row of log probabilities (a column for each language), and one of context
hashes with a row of log back-off weights. An n-gram that some language has seen costs one binary
search for all languages; only n-grams that none has seen go to the next order.

The language is the one with the lowest cross-entropy per character. A part of the training rows
is kept out of the counts and calibrates (a) how fast the posterior sharpens with a text's length
and (b) the rejection. A text's excess is its cross-entropy over its language's median, less ERRORS
standard errors for its length. The limit on it is set by two stated rates: of calibration texts
whose own language is left out of the models (of texts with their letters shuffled, if there is one
language only) no more than LET_PASS may pass, unless more than FALSE_REJECT of the texts with their
own language would be rejected; then the limit is as high as that takes.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memgrid.llm.common import arrow_filter, arrow_map, crc_mod, share, texts_of

ORDER, MAX_PER_LANG, KEEP_OUT = 4, 600, 4
#: Rates that the limit is set by, and the standard errors that a text's length is allowed.
LET_PASS, FALSE_REJECT, ERRORS = 0.25, 0.001, 3.0
#: Texts of one language below which none of it is kept out, and kept-out texts below which nothing is rejected.
LEAST_TEXTS = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def symbols(text: str) -> np.ndarray:
    """Letters of the lower-cased text as code points, runs of others as one 0; starts and ends with 0."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(_letters()[cp], cp, np.uint32(0))
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 0) | (cp[:-1] != 0)
    body = cp[keep]
    if not body.any():
        return np.zeros(0, np.uint64)
    return np.concatenate([[0] * int(body[0] != 0), body, [0] * int(body[-1] != 0)]).astype(np.uint64)


def grams(s: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at each symbol but the first; context starts with blanks."""
    h = np.zeros(len(s) - 1, np.uint64)
    p = np.concatenate([np.zeros(ORDER, np.uint64), s])
    for k in range(n - 1, -1, -1):
        h = (h ^ (p[ORDER + 1 - k : ORDER + len(s) - k] + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
    return h


def context_of(n: int, s: np.ndarray) -> np.ndarray:
    """Hashes of the n - 1 symbols before each symbol but the first."""
    p = np.concatenate([np.zeros(ORDER, np.uint64), s])
    h = np.zeros(len(s) - 1, np.uint64)
    for k in range(n - 1, 0, -1):
        h = (h ^ (p[ORDER + 1 - k : ORDER + len(s) - k] + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray]  # for each order: sorted n-gram hashes
    logp: list[np.ndarray]  # [n-grams, languages]
    contexts: list[np.ndarray]  # for each order: sorted context hashes
    backoff: list[np.ndarray]  # [contexts, languages]
    unseen: float  # log probability of a symbol that no language has seen, below order 1
    medians: np.ndarray | None = None  # for each language, of the cross-entropy of texts that are taken for it
    spread: float = 1.0  # standard deviation of a symbol's log probability
    most: float = float("inf")  # excess above which a text is rejected
    sharp: float = 1.0

    def entropy(self, text: str) -> tuple[np.ndarray, int] | None:
        """Cross-entropy per symbol under each language, in nats, and the number of symbols."""
        s = symbols(text)
        return self.entropy_of(s) if len(s) else None

    def entropy_of(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        h, first, n = np.unique(grams(s, ORDER), return_index=True, return_counts=True)
        total = np.zeros(len(self.langs))
        weight = np.zeros((len(h), len(self.langs)), np.float32)
        left = np.arange(len(h))
        for k in range(ORDER, 0, -1):
            g = (h if k == ORDER else grams(s, k)[first])[left]
            i = np.minimum(np.searchsorted(self.keys[k - 1], g), len(self.keys[k - 1]) - 1)
            hit = self.keys[k - 1][i] == g
            at = left[hit]
            total += (n[at, None] * (weight[at] + self.logp[k - 1][i[hit]])).sum(0)
            left = left[~hit]
            if not len(left):
                break
            c = context_of(k, s)[first][left]
            j = np.minimum(np.searchsorted(self.contexts[k - 1], c), len(self.contexts[k - 1]) - 1)
            seen = self.contexts[k - 1][j] == c
            weight[left[seen]] += self.backoff[k - 1][j[seen]]
        total += (n[left, None] * (weight[left] + self.unseen)).sum(0)
        size = len(s) - 1
        return -total / size, size

    def judge(self, text: str | None) -> tuple[str | None, float, bool, float | None]:
        """(language or None, posterior, rejected, cross-entropy)."""
        found = self.entropy(text) if text and self.langs else None
        if found is None:
            return None, 0.0, True, None
        e, n = found
        best = int(e.argmin())
        z = -(e - e[best]) * n**0.5 * self.sharp
        return self.langs[best], float(1 / np.exp(z).sum()), bool(self.excess(e[best], best, n) > self.most), float(e[best])

    def excess(self, entropy, language, n):
        return entropy - self.medians[language] - ERRORS * self.spread / n**0.5

    def calibrate(self, e: np.ndarray, n: np.ndarray, j: np.ndarray, shuffled: np.ndarray) -> None:
        """e: [texts, languages] cross-entropies; n: symbols; j: the true language; shuffled: [texts] with the letters shuffled."""
        best = e.argmin(1)
        low = e[np.arange(len(e)), best]
        for x in range(len(self.langs)):
            if (best == x).any():
                self.medians[x] = np.median(low[best == x])
        away = np.abs(low - self.medians[best]) * n**0.5
        self.spread = float(np.median(away)) / 0.6745 or 1.0  # the median of |a normal variable| is 0.6745
        own = self.excess(low, best, n)
        if len(self.langs) > 1:
            others = e.copy()
            others[np.arange(len(e)), j] = np.inf
            foreign = self.excess(others.min(1), others.argmin(1), n)
        else:
            foreign = self.excess(shuffled, 0, n)
        self.most = float(max(np.quantile(foreign, LET_PASS), np.quantile(own, 1 - FALSE_REJECT, method="higher")))

        def loss(t: float) -> float:
            z = -(e - e.min(1, keepdims=True)) * (n**0.5)[:, None] * t
            z -= np.log(np.exp(z).sum(1, keepdims=True))
            return -np.maximum(z[np.arange(len(j)), j], -30).mean() + 1e-4 * t

        self.sharp = min((0.05, 0.1, 0.2, 0.4, 0.7, 1.0, 1.5, 2.0, 3.0), key=loss)


def _fit(counts: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]) -> Model:
    """counts: for each language and order (hashes, context hashes, hashes one order lower, counts), one row for each n-gram."""
    langs = sorted(counts)
    if not langs:
        return Model([], [], [], [], [], 0.0)
    keys, ctx = [], []
    for k in range(ORDER):
        rows = {int(h): (int(c), int(low)) for x in langs for h, c, low in zip(*counts[x][k][:3], strict=True)} if k else {}
        if k:
            u = np.array(sorted(rows), np.uint64)
            keys.append((u, np.array([rows[int(x)][0] for x in u], np.uint64), np.array([rows[int(x)][1] for x in u], np.uint64)))
        else:
            u = np.unique(np.concatenate([counts[x][0][0] for x in langs]))
            keys.append((u, np.zeros(len(u), np.uint64), np.zeros(len(u), np.uint64)))
        ctx.append(np.unique(keys[-1][1]))
    vocabulary = len(keys[0][0]) + 1
    logp, backoff, below = [], [], None
    for k in range(ORDER):
        u, c, low = keys[k]
        where = np.searchsorted(ctx[k], c)
        lower = np.full((len(u), len(langs)), 1 / vocabulary) if k == 0 else below[np.searchsorted(keys[k - 1][0], low)]
        p, b = np.empty((len(u), len(langs))), np.empty((len(ctx[k]), len(langs)))
        for j, x in enumerate(langs):
            n = np.zeros(len(u))
            if k == ORDER - 1:
                n[np.searchsorted(u, counts[x][k][0])] = counts[x][k][3]
            else:  # continuation counts: different symbols before the n-gram
                n += np.bincount(np.searchsorted(u, counts[x][k + 1][2]), minlength=len(u))
            ones, twos = (n == 1).sum(), (n == 2).sum()
            d = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            total, kinds = np.bincount(where, n, len(ctx[k])), np.bincount(where, n > 0, len(ctx[k]))
            b[:, j] = np.where(total > 0, d * kinds / np.maximum(total, 1), 1)
            p[:, j] = np.maximum(n - d, 0) / np.maximum(total, 1)[where] + b[where, j] * lower[:, j]
        below = p
        logp.append(np.log(p).astype(np.float32))
        backoff.append(np.log(b).astype(np.float32))
    return Model(langs, [x[0] for x in keys], logp, ctx, backoff, -np.log(vocabulary))


def _counted(rows: DataFrame) -> DataFrame:
    """n-gram counts of each task by language and order, summed over all tasks."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            by: dict[str, list[np.ndarray]] = {}
            for x, lang in zip(texts_of(batch), batch.column("lang").to_pylist(), strict=True):
                if len(s := symbols(x)):
                    by.setdefault(lang, []).append(s)
            out = [[], [], [], [], [], []]
            for lang, texts in by.items():
                for k in range(1, ORDER + 1):
                    h, first, n = np.unique(np.concatenate([grams(s, k) for s in texts]), return_index=True, return_counts=True)
                    c = np.concatenate([context_of(k, s) for s in texts])[first]
                    # one order lower: the n-gram without its first symbol
                    low = np.concatenate([grams(s, k - 1) for s in texts])[first]
                    for column, v in zip(out, (np.full(len(h), lang), np.full(len(h), k), h.view(np.int64), c.view(np.int64), low.view(np.int64), n), strict=True):
                        column.append(v)
            columns = [np.concatenate(c) if c else [] for c in out]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), *[pa.int64()] * 4), strict=True)], ["lang", "k", "h", "context", "low", "n"])

        return f

    parts = arrow_map(rows.select("text", "lang"), make, "lang string, k int, h long, context long, low long, n long")
    return parts.groupBy("lang", "k", "h").agg(F.first("context").alias("context"), F.first("low").alias("low"), F.sum("n").alias("n"))


def train(rows: DataFrame, max_per_lang: int = MAX_PER_LANG) -> Model:
    """A model from rows of text and lang; rows that lack either are left out.

    Fitted on about max_per_lang different texts of each language, chosen by a hash of the text;
    copies of a text count once, and a language with fewer texts uses all of them. One in KEEP_OUT
    calibrates instead of being counted, but none of a language with too few. What comes to the
    driver is bounded by that sample: n-gram counts of the one part, cross-entropies of the other.
    """
    rows = rows.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.countDistinct(F.xxhash64("text")).alias("n")).collect()}
    if not sizes:
        return _fit({})
    pick = F.lit(False)
    for lang, n in sizes.items():
        pick = pick | ((F.col("lang") == lang) & share(n, max_per_lang, F.col("text")))
    sample = rows.where(pick).distinct()
    out = (F.pmod(F.xxhash64("text", F.lit(7)), F.lit(KEEP_OUT)) == 0) & ~F.col("lang").isin([x for x, n in sizes.items() if n < KEEP_OUT * LEAST_TEXTS])
    table = _counted(sample.where(~out)).toPandas()
    if table.empty:  # so few rows that all are kept out
        out = F.lit(True)
        table = _counted(sample).toPandas()
    counts = {lang: [tuple(x.sort_values("h")[c].to_numpy().astype(np.int64).view(np.uint64) if c != "n" else x.sort_values("h")[c].to_numpy() for c in ("h", "context", "low", "n")) for k in range(1, ORDER + 1) for x in [part[part.k == k]]] for lang, part in table.groupby("lang")}
    model = _fit(counts)
    if not model.langs:
        return model

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = []
            for t, x in zip(texts_of(batch), batch.column("lang").to_pylist(), strict=True):
                if x in model.langs and len(text := symbols(t)):
                    e, n = model.entropy_of(text)
                    mixed = np.concatenate([[0], np.random.default_rng(n).permutation(text[1:-1]), [0]]).astype(np.uint64)
                    got.append((model.langs.index(x), e.tolist(), n, model.entropy_of(mixed)[0].min()))
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.float64()))], ["j", "e", "n", "shuffled"])

        return f

    kept = arrow_map(sample.where(out), make, "j int, e array<double>, n long, shuffled double").toPandas()
    model.medians = np.zeros(len(model.langs))
    if len(kept) >= LEAST_TEXTS:
        model.calibrate(np.vstack(kept.e), kept.n.to_numpy(), kept.j.to_numpy(), kept.shuffled.to_numpy())
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text's language, its posterior, whether it is rejected, cross-entropy; a row for each row of docs.

    A text that is null or has no letter, or any text if nothing was learned, is `und` with score 0
    and rejected. A text that fits no language (its excess is above the calibrated limit) is
    rejected too, but keeps the best language; of two as good the first by name. doc_id is only copied.
    """

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [model.judge(x) for x in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] or "und" for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_()), pa.array([g[3] for g in got], pa.float64())], ["doc_id", "lang_pred", "score", "rejected", "cross_entropy"])

        return f

    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, "doc_id long, lang_pred string, score double, rejected boolean, cross_entropy double")


def held_out(doc_id, n: int = 3, rest: int = 1):
    """Whether a doc_id is kept out of training; false for null, which is not trained on either."""
    return F.coalesce(crc_mod(doc_id, n) == rest, F.lit(False))


def train_on(docs: DataFrame, max_per_lang: int = MAX_PER_LANG) -> Model:
    """A model from the documents whose crc32(doc_id as text) mod 3 is not 1."""
    return train(docs.where(crc_mod(F.col("doc_id"), 3) != 1), max_per_lang)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not rejected; null texts and texts without a letter go, repeated rows stay or go together."""
    return arrow_filter(docs, lambda: lambda batch: [not model.judge(x)[2] for x in batch.column("text").to_pylist()])
