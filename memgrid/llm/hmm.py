"""Operator 9: language-model scoring by a hidden Markov model over words.

Words are observed through symbols: the end of a text, one for each word with at least SHARE of all
training tokens, and buckets (a hash of the word) for the others, as many as the square root of the
number of distinct words. So the symbols follow from the training texts: they grow with the
vocabulary, but no more than 1 / SHARE words can have SHARE of the tokens. A hidden state emits
symbols; a bucket's words share its probability by their smoothed counts. So

    log P(text) = log P(symbols) + sum over words in buckets of log((c + 0.1) / mass of the bucket).

Word counts come from all training texts. Baum-Welch runs over all training texts, each as a whole;
each task sums expected counts, and these are summed across tasks by symbol, so the driver gets as
many rows as there are symbols. Scoring runs the scaled forward recursion over whole texts, so the
probability of the symbols is exact.

Texts are computed side by side, as many as hold GROUP tokens, sorted by length. A text of more
than PIECE tokens is cut for that, without loss: the product of a piece's transition and emission
matrices carries the forward vector from its start to its end and the backward vector the other
way, so each piece is computed with the vectors that the whole text has at its ends, and the move
across a cut is counted as any other.

The most frequent words' counts (HEAD at most) go to each task; the others' are joined by word.
Words of the head leave the join, which also takes the hot keys out of it.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memgrid.llm.common import crc_mod, slices, texts_of, written

STATES, ITERATIONS, HEAD, SHARE = 8, 3, 200_000, 1e-5
#: Occurrences that a word needs for a symbol of its own, and the fewest buckets.
LEAST_COUNT, LEAST_BUCKETS = 50, 16
#: Words that a task counts before it hands its counts on.
FLUSH = 400_000
#: Tokens and texts that are computed side by side; tokens of a piece; steps that forward vectors are kept for at a time;
#: pieces whose matrices are multiplied at a time, and steps between two scalings of them.
GROUP, TEXTS, PIECE, BLOCK, MATRICES, SCALE = 1 << 21, 8192, 2048, 64, 1024, 8


def tokens(text: str) -> list[bytes]:
    """Words of the text with A-Z lower-cased, as UTF-8 (bytes know ASCII letters and white space only)."""
    return text.encode().lower().split()


def word_counts(training: DataFrame) -> DataFrame:
    """word, c: how often each word occurs; counted by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for x in batch.column("text").to_pylist():
                counts.update(tokens(x or ""))
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        yield out()

    return training.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Counts of the head, the symbols, and the mass of the buckets."""

    def __init__(self, counts: DataFrame, ends: int, head: int, share: float, buckets: int | None):
        level = F.floor(F.log2("c") * 8).cast("int")
        levels = sorted(((r.k, r.n) for r in counts.groupBy(level.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
        n_words, v_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.ends, self.n, self.v = ends, n_words + ends, v_words + (ends > 0)
        self.buckets = buckets or max(LEAST_BUCKETS, math.isqrt(v_words))
        # the lowest level so that no more than `head` words are on it or above
        self.head_level, left = 1 << 30, head
        for k, n in levels:
            left -= n
            if left < 0:
                break
            self.head_level = k
        own = (level >= self.head_level) & (F.col("c") >= max(LEAST_COUNT, math.ceil(share * self.n)))
        rows = counts.where(level >= self.head_level).select("word", "c", own.alias("top")).toPandas().sort_values(["c", "word"], ascending=[False, True])
        self.head = [w.encode() for w in rows["word"]]
        c, top = rows["c"].to_numpy(float), rows["top"].to_numpy(bool)
        self.log_c = np.log10(c + 0.1)
        n_top = int(top.sum())
        self.first_bucket = 1 + n_top
        self.symbols = self.first_bucket + self.buckets
        self.dtype = "<u2" if self.symbols <= 1 << 16 else "<u4"
        self.symbol = np.array([1 + i if t else self.bucket(w) for i, (t, w) in enumerate(zip(top, self.head, strict=True))], np.int32)
        mass = np.full(self.buckets, 0.1)
        seen = counts.where(~own).groupBy((F.crc32(F.col("word").cast("binary")) % self.buckets).alias("b")).agg((F.sum("c") + 0.1 * F.count("*")).alias("m")).toPandas()
        mass[seen["b"].to_numpy(int)] += seen["m"].to_numpy(float)
        self.log_mass = np.log10(mass)
        unigram = np.concatenate([[ends + 0.1], c[:n_top] + 0.1, mass])
        self.unigram = unigram / unigram.sum()

    def tail(self, counts: DataFrame) -> DataFrame:
        return counts.where(F.floor(F.log2("c") * 8).cast("int") < self.head_level)

    def bucket(self, word: bytes) -> int:
        return self.first_bucket + zlib.crc32(word) % self.buckets


ENCODED = "uid long, doc_id long, held boolean, train boolean, n_tokens long, n_head long, log_head double, log_in_bucket double, log_mass double, obs binary, tail array<struct<word: string, n: int>>"


def encoded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """A row for each text: its symbols, what is known of its words' counts, and the words outside the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i for i, w in enumerate(v.head)}.get
        uid = TaskContext.get().partitionId() << 33
        for big in batches:
            for batch in slices(big):
                out: list[list] = [[] for _ in range(8)]
                for x in texts_of(batch):
                    words = tokens(x)
                    i = np.fromiter(map(index, words, repeat(-1)), np.int32, len(words))
                    known = i >= 0
                    obs = np.zeros(len(words) + 1, np.int32)
                    obs[:-1][known] = v.symbol[i[known]]
                    rest = [words[k] for k in np.flatnonzero(~known)]
                    obs[:-1][~known] = [v.bucket(w) for w in rest]
                    logs = v.log_c[i[known]]
                    inside = obs[:-1] >= v.first_bucket
                    tail = Counter(rest)
                    values = (len(words) + 1, len(logs), logs.sum(), logs[inside[known]].sum(), v.log_mass[obs[:-1][inside] - v.first_bucket].sum(), obs.astype(v.dtype).tobytes(), [{"word": w.decode(), "n": n} for w, n in tail.items()])
                    for column, value in zip(out[1:], values, strict=True):
                        column.append(value)
                    out[0].append(uid)
                    uid += 1
                n, h, a, b, m, o, t = out[1:]
                arrays = [pa.array(out[0], pa.int64()), batch.column("doc_id"), batch.column("held"), batch.column("train"), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array(m, pa.float64()), pa.array(o, pa.binary()), pa.array(t, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())])))]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in ("uid", "doc_id", "held", "train", "n_tokens", "n_head", "log_head", "log_in_bucket", "log_mass", "obs", "tail")])

    return docs.mapInArrow(run, ENCODED)


class Hmm:
    """start [states], move [states, states], emit [states, symbols]."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def random(cls, states: int, unigram: np.ndarray, seed: int = 1, stay: float = 0.98) -> Hmm:
        """Where training starts: states that differ in their words and tend to stay, so that they find kinds of text."""
        rng = np.random.default_rng(seed)
        emit = unigram * (0.02 + rng.exponential(size=(states, len(unigram))))
        move = 1 + rng.random((states, states))
        move = (1 - stay) * move / move.sum(1, keepdims=True) + stay * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    @cached_property
    def by_symbol(self) -> np.ndarray:
        return np.ascontiguousarray(self.emit.T)

    def products(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each piece the product of emission and transition matrices from its first symbol's emission to its last's, scaled, and log10 of the scale."""
        k = len(self.start)
        out, logs = np.empty((len(pieces), k, k)), np.zeros(len(pieces))
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        for at in range(0, len(order), MATRICES):
            part = order[at : at + MATRICES]
            flat, first, active = _side_by_side([pieces[i] for i in part])
            x, log = np.eye(k) * self.by_symbol[flat[first]][:, None, :], np.zeros(len(part))
            for t in range(1, len(active)):
                m = active[t]
                x[:m] = (x[:m].reshape(-1, k) @ self.move).reshape(m, k, k) * self.by_symbol[flat[first[:m] + t]][:, None, :]
                if t % SCALE == 0:
                    s = x[:m].sum((1, 2))
                    x[:m] /= s[:, None, None]
                    log[:m] += np.log10(s)
            s = x.sum((1, 2))
            out[part], logs[part] = x / s[:, None, None], log + np.log10(s)
        return out, logs

    def pieces(self, texts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of all texts, longest first, with what the rest of its text says about each.

        Returns the pieces, whether each begins its text, the states' chances before its first
        symbol, the states at the end of the piece before, and the backward vector at its end.
        """
        k = len(self.start)
        long = [x for x in texts if len(x) > PIECE]
        cut = [x[at : at + PIECE] for x in long for at in range(0, len(x), PIECE)]
        product, _ = self.products(cut)
        short = [x for x in texts if len(x) <= PIECE]
        begins, before, prev, after = np.ones(len(cut), bool), np.tile(self.start, (len(cut), 1)), np.zeros((len(cut), k)), np.ones((len(cut), k))
        at = 0
        for x in long:
            n = -(-len(x) // PIECE)
            for i in range(at + 1, at + n):
                end = before[i - 1] @ product[i - 1]
                prev[i] = end / end.sum()
                begins[i], before[i] = False, prev[i] @ self.move
            for i in range(at + n - 2, at - 1, -1):
                b = self.move @ (product[i + 1] @ after[i + 1])
                after[i] = b / b.sum()
            at += n
        all_ = cut + short
        more = len(short)
        begins, before = np.concatenate([begins, np.ones(more, bool)]), np.vstack([before, np.tile(self.start, (more, 1))])
        prev, after = np.vstack([prev, np.zeros((more, k))]), np.vstack([after, np.ones((more, k))])
        order = sorted(range(len(all_)), key=lambda i: -len(all_[i]))
        return [all_[i] for i in order], begins[order], before[order], prev[order], after[order]

    def expected(self, texts: list[np.ndarray], into: np.ndarray) -> None:
        """Adds expected counts of whole texts to `into`, [symbols + states + 1, states]: emissions, moves, starts.

        Forward vectors are kept at the start of each block of steps and worked out again within a
        block on the way back.
        """
        if not texts:
            return
        k, c, emit, move = len(self.start), self.emit.shape[1], self.by_symbol, self.move
        pieces, begins, before, prev, after = self.pieces(texts)
        flat, first, active = _side_by_side(pieces)
        steps = len(active)
        active = np.append(active, 0)
        kept, end, a = [], np.empty_like(before), before
        for t in range(steps):
            m, n = active[t], active[t + 1]
            if t % BLOCK == 0:
                kept.append(a)
            a = a[:m] * emit[flat[first[:m] + t]]
            a /= a.sum(1)[:, None]
            end[n:m] = a[n:m]
            a = a[:n] @ move
        after = after / (end * after).sum(1)[:, None]
        moves, y, gamma = np.zeros((k, k)), np.empty((0, k)), None
        for start in range((steps - 1) // BLOCK * BLOCK, -1, -BLOCK):
            size, wide = min(BLOCK, steps - start), active[start]
            obs = np.full((size, wide), c, np.int64)
            e, alpha, scale = np.empty((size, wide, k)), np.zeros((size, wide, k)), np.empty((size, wide))
            a = kept.pop()
            for d in range(size):
                m = active[start + d]
                o = obs[d, :m] = flat[first[:m] + start + d]
                e[d, :m] = emit[o]
                a = a[:m] * e[d, :m]
                scale[d, :m] = a.sum(1)
                a /= scale[d, :m, None]
                alpha[d, :m] = a
                a = a[: active[start + d + 1]] @ move
            for d in range(size - 1, -1, -1):
                m, n = active[start + d], active[start + d + 1]
                moves += alpha[d, :n].T @ y
                beta = np.vstack([y @ move.T, after[n:m]])
                y = e[d, :m] * beta / scale[d, :m, None]
                alpha[d, :m] *= beta  # now the states' posterior
            gamma, symbols = alpha[0], obs.ravel()
            for j in range(k):
                into[:c, j] += np.bincount(symbols, alpha[:, :, j].ravel(), c + 1)[:c]
        inner = ~begins
        moves += prev[inner].T @ (gamma[inner] / before[inner])
        into[c : c + k] += moves * move
        into[c + k] += gamma[begins].sum(0)

    def improved(self, counts: np.ndarray, unigram: np.ndarray) -> Hmm:
        k, c = len(self.start), self.emit.shape[1]
        emit, move, start = counts[:c].T + 0.5 * unigram, counts[c : c + k] + 0.1, counts[c + k] + 0.1
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of symbols, by the scaled forward recursion over all of it."""
        out = np.zeros(len(texts))
        order = sorted((i for i in range(len(texts)) if len(texts[i]) <= PIECE), key=lambda i: -len(texts[i]))
        if order:
            flat, first, active = _side_by_side([texts[i] for i in order])
            total, a = np.zeros(len(order)), np.tile(self.start, (len(order), 1))
            for t, m in enumerate(active):
                a = (a[:m] if t == 0 else a[:m] @ self.move) * self.by_symbol[flat[first[:m] + t]]
                s = a.sum(1)
                a /= s[:, None]
                total[:m] += np.log10(s)
            out[order] = total
        long = [i for i in range(len(texts)) if len(texts[i]) > PIECE]
        product, logs = self.products([texts[i][at : at + PIECE] for i in long for at in range(0, len(texts[i]), PIECE)])
        at = 0
        for i in long:
            a = self.start
            for p in range(at, at + -(-len(texts[i]) // PIECE)):
                a = a @ product[p]
                out[i] += np.log10(a.sum()) + logs[p]
                a = a / a.sum() @ self.move
            at = p + 1
        return out


def _side_by_side(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols of texts that come longest first, where each text begins in them, and for each step how many texts get there."""
    sizes = np.array([len(x) for x in texts])
    flat = np.concatenate(texts).astype(np.int32) if texts else np.zeros(0, np.int32)
    steps = int(sizes[0]) if len(sizes) else 0
    return flat, np.cumsum(sizes) - sizes, len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), "right")


def grouped(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Rows of batches with their symbols (column obs), in groups of about GROUP tokens and TEXTS rows at most."""
    rows, obs, n = [], [], 0
    for batch in batches:
        for part in slices(batch):
            rows.append(part)
            new = [np.frombuffer(o, dtype) for o in part.column("obs").to_pylist()]
            obs += new
            n += sum(map(len, new))
            if n >= GROUP or len(obs) > TEXTS - 256:
                yield rows, obs
                rows, obs, n = [], [], 0
    if rows:
        yield rows, obs


def expected_counts(rows: DataFrame, model: Hmm, dtype: str = "<u2") -> np.ndarray:
    """Expected counts over all rows (obs), summed in each task, then across tasks."""
    k, c = len(model.start), model.emit.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((c + k + 1, k))
        for _, obs in grouped(batches, dtype):
            model.expected(obs, total)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(total[some, j], pa.float64()) for j in range(k))], ["i", *(f"v{j}" for j in range(k))])

    schema = "i int, " + ", ".join(f"v{j} double" for j in range(k))
    out = np.zeros((c + k + 1, k))
    got = rows.select("obs").mapInArrow(run, schema).groupBy("i").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(k)]).toPandas()
    out[got["i"].to_numpy(int)] = got[[f"v{j}" for j in range(k)]].to_numpy(float)
    return out


def _forward(rows: DataFrame, model: Hmm, dtype: str) -> DataFrame:
    keep = ("uid", "doc_id", "held", "n_tokens", "n_head", "log_head", "log_in_bucket", "log_mass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, obs in grouped(batches, dtype):
            t = pa.Table.from_batches(parts).select(keep).append_column("ll", pa.array(model.log10(obs), pa.float64()))
            yield from t.combine_chunks().to_batches()

    return rows.select(*keep, "obs").mapInArrow(run, "uid long, doc_id long, held boolean, n_tokens long, n_head long, log_head double, log_in_bucket double, log_mass double, ll double")


@dataclass
class Trained:
    """All that scoring needs: the table of encoded texts, word counts, the vocabulary and the model."""

    table: DataFrame
    counts: DataFrame
    vocabulary: Vocabulary
    model: Hmm


def train(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS, head: int = HEAD, share: float = SHARE, buckets: int | None = None) -> Trained:
    """Counts words, encodes all texts and fits the model on those of doc_ids that are not held out; see score()."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("m", crc_mod(F.col("doc_id"), 10)).select("doc_id", "text", F.coalesce(F.col("m") == 0, F.lit(False)).alias("held"), F.coalesce(F.col("m") != 0, F.lit(False)).alias("train"))
    training = rows.where("train")
    counts = written(word_counts(training), "counts")
    v = Vocabulary(counts, training.count(), head, share, buckets)
    table = written(encoded(rows, v), "encoded")
    model = Hmm.random(states, v.unigram)
    for _ in range(iterations):
        model = model.improved(expected_counts(table.where("train"), model, v.dtype), v.unigram)
    return Trained(table, counts, v, model)


def score(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS, head: int = HEAD, share: float = SHARE, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row for each row of docs.

    docs: doc_id, text (other columns are not read). A null text counts as empty: its only token is
    the end. Texts whose crc32(doc_id as text) mod 10 is 0 are held out; a null doc_id is not
    trained on and not called held out. Without training texts each word has the smoothed
    probability of an empty count. base_score is the smoothed unigram's log10 probability, score
    the model's. The count of distinct words includes the end. buckets: by default the square root
    of the number of distinct words. Repeated rows are trained on and scored as often as they come.
    """
    t = train(docs, states, iterations, head, share, buckets)
    table, counts, v = t.table, t.counts, t.vocabulary
    tail = table.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", "t.n").join(v.tail(counts), "word", "left")
    tail = tail.groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("log_tail"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_tail"))
    all_ = _forward(table, t.model, v.dtype).join(tail, "uid", "left").na.fill(0, ["log_tail", "n_tail"])
    per_token = float(np.log10(v.n + 0.1 * (v.v + 1)))
    base = F.col("log_head") + F.col("log_tail") + float(np.log10(v.ends + 0.1)) - F.col("n_tokens") * per_token
    known = F.col("n_head") + F.col("n_tail") + int(v.ends > 0)
    full = F.col("ll") + F.col("log_in_bucket") + F.col("log_tail") - F.col("log_mass")
    return all_.select("doc_id", F.col("held").alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(int(v.n)).cast("long").alias("train_tokens"), base.alias("base_score"), full.alias("score"))
