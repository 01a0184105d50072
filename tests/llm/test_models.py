"""Operators 4, 5 and 9: held-out accuracy, calibration and brute force."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from memgrid.llm import hmm, language_id, quality, queries
from memgrid.llm.common import read
from tests.llm.cases import odd, odd_rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, SF, "documents")


def test_language_held_out_accuracy(spark, docs):
    rows = queries.op4_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 0.002 * len(rows)


def test_kneser_ney_equals_plain_version(spark):
    """Cross-entropies against interpolated Kneser-Ney over dictionaries, straight from its formula."""
    rng = np.random.default_rng(2)
    texts = [("".join(rng.choice(list(letters), 40)), lang) for lang, letters in (("aa", "abc  "), ("bb", "bcdé ")) for _ in range(12)]
    model = language_id.train(spark.createDataFrame(texts, "text string, lang string"))
    n_order = language_id.ORDER

    def padded(text):
        body = "".join(ch if ch.isalpha() else " " for ch in text.lower())
        return " " * n_order + " ".join(body.split()) + " "

    counts = {lang: [Counter() for _ in range(n_order + 1)] for lang in ("aa", "bb")}
    for t, lang in texts:
        x = padded(t)
        for i in range(n_order, len(x)):
            counts[lang][n_order][x[i - n_order + 1 : i + 1]] += 1
    for c in counts.values():  # below the top: different symbols before the n-gram
        for k in range(n_order - 1, 0, -1):
            every = {x[i - k : i + 1] for t, lang in texts if counts[lang] is c for x in [padded(t)] for i in range(n_order, len(x))}
            c[k] = Counter(g[1:] for g in every)
    vocabulary = len({g for c in counts.values() for g in c[1]}) + 1

    def p(lang, gram):
        k = len(gram)
        if not k:
            return 1 / vocabulary
        c = counts[lang][k]
        ones, twos = (sum(v == n for v in c.values()) for n in (1, 2))
        d = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        rest = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        lower = p(lang, gram[1:])
        return lower if not rest else max(c[gram] - d, 0) / sum(rest.values()) + d * len(rest) / sum(rest.values()) * lower

    for text in ("abca cab", "dbé cc", "aaaa", "zeta abc", "b", *(t for t, _ in texts[:3])):
        x = padded(text)
        want = [-sum(math.log(p(lang, x[i - n_order + 1 : i + 1])) for i in range(n_order, len(x))) / (len(x) - n_order) for lang in model.langs]
        assert model.entropy(text)[0] == pytest.approx(want, rel=1e-4), text
    for gram in ("ab", "b", " a"):  # and what follows a context sums to one, unseen symbols (one share) included
        every = sorted({g for c in counts.values() for g in c[1]})
        assert sum(p("aa", gram + x) for x in every) + p("aa", gram + "?") == pytest.approx(1)


def test_language_rejection_is_calibrated(spark, docs):
    rows = docs.where("text is not null and lang is not null")
    model = language_id.train_on(docs)
    kept = [(model.judge(r.text), len(r.text)) for r in rows.select("text").collect()]
    assert sum(k[0][2] for k in kept) <= 2 * language_id.FALSE_REJECT * len(kept) + 1
    for text in ("日本語の文章がここにあります。" * 20, "xqzv kjwq pfgh zxcv bnmq wrtp lkjh gfds " * 5, "Egy szép nyári napon a kertben ültünk és hallgattuk a madarak énekét amíg a nap lement", "Litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił"):
        assert model.judge(text)[2], text
    passed = []
    for t, lang in rows.where(language_id.held_out(F.col("doc_id"))).select("text", "lang").collect():
        if found := model.entropy(t):  # as if its own language had not been learned
            e, n = found
            e[model.langs.index(lang)] = np.inf
            passed.append(model.excess(e.min(), e.argmin(), n) <= model.most)
    assert len(passed) > 250 and sum(passed) <= 2 * language_id.LET_PASS * len(passed)
    one = language_id.train_on(rows.where("lang = 'en'"))
    assert one.most < 10 and one.judge("xqzv kjwq pfgh zxcv bnmq wrtp lkjh gfds " * 5)[2]


def test_language_odd_rows(spark, docs):
    model = language_id.train_on(docs, 60)
    got = sorted(map(tuple, language_id.identify(odd(spark), model).select("doc_id", "lang_pred", "score", "rejected").collect()), key=str)
    assert len(got) == len(odd_rows())
    und = [g for g in got if g[1] == "und"]
    assert sorted((g[0] for g in und), key=str) == [0, 1, 2, None] and all(g[2] == 0 and g[3] for g in und)
    assert language_id.identify(odd(spark, []), model).collect() == []
    nothing = language_id.train(odd(spark, []))
    assert {r.lang_pred for r in language_id.identify(odd(spark), nothing).collect()} == {"und"}
    few = language_id.train(odd(spark))
    assert {r.lang_pred for r in language_id.identify(odd(spark), few).collect()} <= {"en", "de", "fr", "und"}
    assert model.judge("日本語の文章がここにあります。" * 20)[2] and not model.judge("the thing that was in the heart of all the other ones")[2]



def test_language_copies_count_once(spark):
    texts = [(f"{'zo' * (i % 7 + 1)} wuxi{i} qarel{i * i} {'mip' * (i % 5 + 1)} tondu", "xx") for i in range(20)]
    texts += [(f"the quick fox number {i} runs over {i * 7} lazy dogs {'and on' * (i % 4)}", "en") for i in range(60)]
    kind = "text string, lang string"
    once = language_id.train(spark.createDataFrame(texts, kind), 30)
    copies = language_id.train(spark.createDataFrame(texts + texts[:1] * 3000 + texts[1:20] * 40, kind), 30)
    assert copies.langs == once.langs == ["en", "xx"]
    for a, b in ((copies.keys, once.keys), (copies.logp, once.logp), (copies.backoff, once.backoff)):
        assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    assert np.allclose(copies.medians, once.medians) and (copies.spread, copies.most, copies.sharp) == pytest.approx((once.spread, once.most, once.sharp))
    one = language_id.train(spark.createDataFrame([(f"only text {i}", f"l{i}") for i in range(12)], kind))
    assert len(one.langs) == 12


def test_quality_held_out_accuracy(spark, docs):
    labels = read(spark, SF, "labels")
    rows = queries.op5_quality(spark, SF).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    auc = np.mean([[a > b for b in bad] for a in good])
    assert auc > 0.93 and np.mean([r.predicted == r.quality for r in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_equals_plain_version(spark, docs):
    """Scores from the model's dictionaries by plain compression of each whole text, and the rows that it was fitted on."""
    import zstandard

    labels = read(spark, SF, "labels")
    model = quality.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    good, bad = (zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad))
    for r in quality.score(docs, model).collect():
        data = texts[r.doc_id].encode()
        d = (len(bad.compress(data)) - len(good.compress(data))) / len(data) if data else 0.0
        assert r.difference == pytest.approx(d) and r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, model.bias + model.slope * d)))))
    assert model.slope > 0
    # labels of held-out documents, whatever they say, change nothing; nor do repeated rows
    flipped = labels.withColumn("quality", F.when(language_id.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs.union(docs), flipped.union(flipped))
    assert (again.good, again.bad, again.bias, again.slope) == (model.good, model.bad, model.bias, model.slope)


def test_quality_sample_is_bounded(spark, docs, monkeypatch):
    seen = []
    real = quality._dictionary
    monkeypatch.setattr(quality, "_dictionary", lambda texts: seen.append(sum(len(t.encode()) for t in texts)) or real(texts))
    quality.train(docs, read(spark, SF, "labels"), max_bytes=100_000)
    assert 0 < seen[0] + seen[1] < 300_000


def test_quality_odd_rows(spark, docs):
    labels = read(spark, SF, "labels")
    model = quality.train(docs, labels)
    assert quality.score(odd(spark), model).count() == len(odd_rows()) and quality.score(odd(spark, []), model).collect() == []
    none = quality.train(odd(spark), labels.where("false"))
    assert {r.score for r in quality.score(odd(spark), none).collect()} == {0.5}
    one = spark.createDataFrame([(10, 1, 0), (11, 1, 0), (10, 1, 1), (None, 0, 0), (12, None, 0), (14, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.score(odd(spark), quality.train(odd(spark), one)).collect())


@pytest.mark.parametrize("piece", [2048, 2, 1])
def test_forward_equals_sum_over_paths(piece, monkeypatch):
    monkeypatch.setattr(hmm, "PIECE", piece)
    model = hmm.Hmm.random(3, np.array([0.4, 0.3, 0.2, 0.1]), 7)
    texts = [np.array(x) for x in ([1, 2, 0], [0], [3, 3, 1, 0], [2, 1, 2, 1, 0])]
    for x, got in zip(texts, model.log10(texts), strict=True):
        p = sum(model.start[s[0]] * model.emit[s[0], x[0]] * math.prod(model.move[a, b] * model.emit[b, o] for a, b, o in zip(s, s[1:], x[1:])) for s in itertools.product(range(3), repeat=len(x)))
        assert got == pytest.approx(math.log10(p))


@pytest.mark.parametrize(("piece", "block"), [(2048, 64), (2048, 2), (2, 64), (3, 1), (1, 1)])
def test_expected_counts_equal_sum_over_paths(piece, block, monkeypatch):
    monkeypatch.setattr(hmm, "PIECE", piece)
    monkeypatch.setattr(hmm, "BLOCK", block)
    model = hmm.Hmm.random(2, np.array([0.5, 0.3, 0.2]), 3)
    texts = [np.array(x) for x in ([2, 0], [1, 2, 0], [0], [2, 1, 1, 2, 1, 2, 0], [1, 1, 2, 0])]
    got = np.zeros((3 + 2 + 1, 2))
    model.expected(texts, got)
    want = np.zeros_like(got)
    for x in texts:
        paths = {s: model.start[s[0]] * model.emit[s[0], x[0]] * math.prod(model.move[a, b] * model.emit[b, o] for a, b, o in zip(s, s[1:], x[1:])) for s in itertools.product(range(2), repeat=len(x))}
        z = sum(paths.values())
        for s, p in paths.items():
            want[5, s[0]] += p / z
            for k, o in zip(s, x):
                want[o, k] += p / z
            for a, b in zip(s, s[1:]):
                want[3 + a, b] += p / z
    assert got == pytest.approx(want)


def test_long_texts_are_computed_as_wholes(monkeypatch):
    rng = np.random.default_rng(4)
    model = hmm.Hmm.random(4, np.full(9, 1 / 9), 5)
    texts = [np.append(rng.integers(1, 9, n), 0) for n in (0, 3, 70, 129, 1000, 3000)]
    whole = np.zeros((9 + 4 + 1, 4))
    model.expected(texts, whole)
    assert whole[9:13].sum() == pytest.approx(sum(map(len, texts)) - len(texts)) and whole[:9].sum() == pytest.approx(sum(map(len, texts)))
    scores = model.log10(texts)
    for piece, matrices in ((64, 1024), (50, 3), (700, 2)):
        monkeypatch.setattr(hmm, "PIECE", piece)
        monkeypatch.setattr(hmm, "MATRICES", matrices)
        got = np.zeros_like(whole)
        model.expected(texts, got)
        assert got == pytest.approx(whole) and model.log10(texts) == pytest.approx(scores)


def test_score_equals_sum_over_paths(spark):
    """The whole result, on short texts: paths of states times the words' shares of their buckets."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["the", "of", "a", "x1", "x2", "x3"], rng.integers(0, 6))), None, None, None) for i in range(300)]
    rows += [(300, "never seen the", None, None, None), (301, None, None, None, None)]
    df = odd(spark, rows)
    t = hmm.train(df, states=2, iterations=2, head=4, share=0.2, buckets=2)
    scores = sorted((r.doc_id, r.score) for r in hmm.score(df, states=2, iterations=2, head=4, share=0.2, buckets=2).collect())
    c = Counter(w for d, x, *_ in rows if zlib.crc32(str(d).encode()) % 10 for w in (x or "").split())
    n = sum(c.values()) + sum(zlib.crc32(str(r[0]).encode()) % 10 > 0 for r in rows)
    top = sorted((w for w in t.vocabulary.head for w in [w.decode()] if c[w] >= 0.2 * n), key=lambda w: (-c[w], w))
    assert len(top) < len(c)
    mass = [0.1 + sum(c[w] + 0.1 for w in c if w not in top and zlib.crc32(w.encode()) % 2 == b) for b in (0, 1)]
    m = t.model
    assert m.emit.shape[1] == 1 + len(top) + 2 and np.allclose(m.emit.sum(1), 1) and np.allclose(m.move.sum(1), 1)
    for (d, got), (_, x, *_) in zip(scores, sorted(rows), strict=True):
        o, share = [], 1.0
        for w in (x or "").split():
            b = zlib.crc32(w.encode()) % 2
            o.append(1 + top.index(w) if w in top else 1 + len(top) + b)
            share *= 1.0 if w in top else (c[w] + 0.1) / mass[b]
        o.append(0)
        p = sum(m.start[s[0]] * m.emit[s[0], o[0]] * math.prod(m.move[a, b] * m.emit[b, y] for a, b, y in zip(s, s[1:], o[1:])) for s in itertools.product(range(2), repeat=len(o)))
        assert got == pytest.approx(math.log10(p * share)), d


@pytest.mark.parametrize(("head", "share"), [(200_000, 1e-5), (40, 0.01), (0, 1)])
def test_language_model(spark, docs, head, share):
    rows = [tuple(r) for r in docs.select("doc_id", "text").where("doc_id < 300").collect()] + [r[:2] for r in odd_rows() if r[0] is None or r[0] in (0, 1, 4, 8)]
    df = odd(spark, [(d, t, None, None, None) for d, t in rows])
    train = [t or "" for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 10]
    c = Counter(w for t in train for w in t.encode().lower().split())
    c[None] = len(train)
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        want.append((str(d), d is not None and zlib.crc32(str(d).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    got = hmm.score(df, head=head, share=share, iterations=1).collect()
    key = lambda r: (r[0], r[2], r[5])
    for a, b in zip(sorted([(str(r[0]), *r[1:]) for r in got], key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)


def test_language_model_learns(spark, docs):
    rows = hmm.score(docs).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_language_model_without_training(spark):
    assert hmm.score(odd(spark, [])).collect() == []
    got = hmm.score(odd(spark, [(None, "a b", None, None, None)])).collect()[0]
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, pytest.approx(0)) and got.score <= 0
