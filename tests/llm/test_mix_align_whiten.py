"""Operators 11, 12 and 13 against plain Python, on odd rows and on whole tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from memgrid.llm import alignment, mixing, queries, whitening
from memgrid.llm.common import read
from tests.llm.cases import odd, odd_rows, words
from tests.llm.test_native import no_python

# --- 11

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def whole(v):
    return tuple(math.floor(256 * float(np.float32(c))) for c in v)


def remaining(rows):
    return [(i, whole(v)) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def plain_whitening(rows):
    """vec_id -> deviation, and the covariance of the distinct vectors, exactly."""
    kept = remaining(rows)
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = [[Fraction(x[j]) - Fraction(sums[j], n) for j in range(d)] for x in fit]
    v = [[float(sum(c[i] * c[j] for c in centred) / n) for j in range(d)] for i in range(d)]
    return n, sums, np.array(v), [(i, x, sum((n * x[j] - sums[j]) ** 2 for j in range(d))) for i, x in kept]


def check_whitening(rows, got):
    n, sums, v, expected = plain_whitening(rows)
    values, base = np.linalg.eigh(v)
    values, base = values[::-1], base[:, ::-1]
    shown = min(4, len(sums))
    assert sorted((r.vec_id, r.component, int(r.deviation), r.n) for r in got) == sorted((i, k + 1, dev, n) for i, _, dev in expected for k in range(shown))
    mean = np.array([float(Fraction(s, n)) for s in sums])
    by = defaultdict(list)
    for r in got:
        by[r.component].append((r.vec_id, r.whitened))
    for k in range(shown):
        want = sorted((i, float((np.array(x, float) - mean) @ base[:, k] / math.sqrt(values[k]))) for i, x, _ in expected)
        have = sorted(by[k + 1])
        sign = 1 if sum(a[1] * b[1] for a, b in zip(want, have, strict=True)) > 0 else -1
        assert np.allclose([x[1] for x in want], [sign * x[1] for x in have], rtol=1e-7, atol=1e-9)
    for r in got:
        assert r.identity_error < 1e-9 and abs(r.explained / (values[r.component - 1] / v.trace()) - 1) < 1e-9


def vectors(spark, rows):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], label) for i, v, label in rows]
    return spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("x", "component", "n", "whitened", "part")})


def test_whitening_equals_exact_sums(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, s) for s in (3, 2, 1, 0.5, 0.2, 0.1)], 0) for i in range(300)]
    rows += [(300 + i, rows[0][1], 1) for i in range(150)] + [(i, rows[i][1], 1) for i in range(5)]  # a hot vector, and repeated rows
    bad = [(900, None, 0), (901, [1.0, None, 0, 0, 0, 0], 0), (902, [float("nan")] * 6, 0), (903, [float("inf")] + [0.0] * 5, 0)]
    df = vectors(spark, rows + bad + [(904, [], 0), (905, [1.0, 2.0], 0)])
    check_whitening(rows, whitening.whiten(df, whitening.fit(df)).collect())


def test_whitening_far_from_zero(spark):
    """A mean that is large beside the spread loses nothing, and neither does a deviation beyond a long."""
    rng = random.Random(2)
    rows = [(i, [1e6 + rng.randint(-40, 40) / 16, -3e5 + rng.randint(-9, 9) / 16, rng.random()], 0) for i in range(200)]
    df = vectors(spark, rows)
    check_whitening(rows, whitening.whiten(df, whitening.fit(df)).collect())
    rows = [(i, [rng.choice([-1, 1]) * 1e14, rng.random() * 1e12, 1e11 * (i % 7)], 0) for i in range(40)]
    df = vectors(spark, rows)
    check_whitening(rows, whitening.whiten(df, whitening.fit(df)).collect())
    rows = [(0, [3e38, 1.0], 0), (1, [-3e38, 2.0], 0)]
    df = vectors(spark, rows)
    assert whitening.whiten(df, whitening.fit(df)).count() == 4


def test_whitening_without_variance(spark):
    none = vectors(spark, [])
    assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0
    same = vectors(spark, [(i, [0.5, -0.25], 0) for i in range(3)])
    got = whitening.whiten(same, whitening.fit(same)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == [(i, k, 1, 0, None, 0.0, 0.0) for i in range(3) for k in (1, 2)]
    line = vectors(spark, [(i, [float(i), 2.0 * i, 0.0], 0) for i in range(9)])
    got = whitening.whiten(line, whitening.fit(line)).collect()
    assert {r.component: r.whitened is None for r in got} == {1: False, 2: True, 3: True} and all(r.identity_error < 1e-9 for r in got)


def test_whitening_of_the_table(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").collect()
    check_whitening([tuple(r) for r in rows], queries.op11_whitening(spark, sf_dir).collect())


# --- 12


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens_of(both, text):
    """(id, bytes) of both sides by the libraries, on the whole text; none where bytes differ."""
    if not text:
        return [], []
    a, b = both
    table = {c: bytes([v]) for c, v in alignment.byte_letters().items()}
    e = a.encode(" " + text, add_special_tokens=False)
    ta = [(i, b"".join(table[c] for c in a.id_to_token(i))) for i in e.ids]
    tb = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    data = (" " + text).encode()
    return (ta, tb) if b"".join(x for _, x in ta) == data == b"".join(x for _, x in tb) else ([], [])


def plain_alignment(both, rows):
    groups_of = []
    for _, text, *_ in rows:
        ta, tb = tokens_of(both, text)
        ends_a, ends_b = (set(np.cumsum([len(x) for _, x in t]).tolist()) for t in (ta, tb))
        cuts = sorted(ends_a & ends_b)
        groups = [([], []) for _ in cuts]
        for k, t in enumerate((ta, tb)):
            end, g = 0, 0
            for i, x in t:
                end += len(x)
                groups[g][k].append(i)
                g += end == cuts[g]
        groups_of.append((len(ta), len(tb), groups))
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for _, _, groups in groups_of]
    count = Counter(p for doc in links for p in doc)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (d, *_), (n_a, n_b, groups), doc in zip(rows, groups_of, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((d, n_a, n_b, len(groups), sum(doc.values()), sum(n for p, n in doc.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in doc.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize(("head", "block"), [(1 << 18, 1 << 15), (7, 5), (0, 64)])
def test_alignment_equals_plain_groups(spark, both, head, block, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rng = random.Random(head)
    parts = ["a", "the", " ", "  ", "\n", "\r\n", "\r", "'s", "12", "é", "漢字", " ", " ", "🙂", "aaaa", " \t", "<s>", "<|endoftext|>", "<0x41>", "internationalization", ");\r"]
    rows = [(100 + i, "".join(rng.choices(parts, k=rng.randint(1, 80))), "en", "a", 0) for i in range(60)]
    rows += [(200, "a ▁ b", None, None, 0), (201, "q" * 3000, None, None, 0), (202, "".join(rng.choices("漢字仮名交文章", k=900)), None, None, 0), (None, " ", None, None, 0)] + odd_rows()
    got = alignment.align(odd(spark, rows).repartition(3), head=head)
    assert sorted(map(tuple, got.collect()), key=str) == plain_alignment(both, rows)


def test_large_groups_count_ids_before_pairs(spark, both, monkeypatch):
    monkeypatch.setattr(alignment, "LARGE", 1)
    rows = [(i, x, None, None, 0) for i, x in enumerate(["🙂🙂🙃 漢字" * 20, "the internationalization of zzzzq"])]
    assert sorted(map(tuple, alignment.align(odd(spark, rows)).collect()), key=str) == plain_alignment(both, rows)


def test_units_are_safe(both):
    """Ids by unit are the libraries' ids of the whole text, for each white space beside each kind of character."""
    s = alignment.sides(public_tokenizers.path(alignment.SIDE_A), public_tokenizers.path(alignment.SIDE_B))
    rng = random.Random(3)
    near = ["a", "1", ";", ")", "'", "é", "漢", "🙂", "▁", ""]
    for c in [*alignment.SPACE, "\x1c", "᠎", "​", "﻿", "\0"]:
        for d in ["", *rng.sample(alignment.SPACE, 5), "\r"]:
            text = "".join(f"{x}{c}{d}{y}" for x in near for y in near)
            ta, tb = tokens_of(both, text.replace("▁", "_"))
            ((a, b),) = s.tokens([text.replace("▁", "_")])
            assert (a.tolist(), b.tolist()) == ([i for i, _ in ta], [i for i, _ in tb]), (c, d)


def test_alignment_of_the_table_and_of_none(spark, sf_dir, both):
    docs = read(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op12_alignment(spark, sf_dir).collect()), key=str) == plain_alignment(both, rows)
    assert alignment.align(docs.where("false")).count() == 0


# --- 13

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes: dict) -> dict:
    """Shares by weight, those over three times the size held there and the excess shared again, until none is over."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    held, open_ = {}, set(order)
    while open_:
        left, w = sum(sizes.values()) - sum(held.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if Fraction(left * weight[s], w) > 3 * sizes[s]}
        if not over:
            return held | {s: Fraction(left * weight[s], w) for s in open_}
        held |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return held


def plain_mix(rows):
    docs = [(d, s, len(WORD.findall(t or ""))) for d, t, _, s, _ in rows]
    sizes: dict = defaultdict(int)
    for _, s, n in docs:
        sizes[s] += n
    target = plain_targets(sizes)
    order = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    place = lambda d: int(hashlib.md5(("null" if d is None else str(d)).encode()).hexdigest()[:15], 16)
    queue, done = [], Counter()
    for i, (d, s, n) in sorted(enumerate(docs), key=lambda x: (place(x[1][0]), x[1][0] or 0, x[1][2])):
        done[s] += n
        queue += [((done[s] + k * sizes[s]) / float(target[s]), order[s], n, i) for k in range(3) if n]
    left, taken = sum(sizes.values()), Counter()
    for _, _, n, i in sorted(queue):
        if n > left:
            break
        left -= n
        taken[i] += n
    return sorted(((d, n, sizes[s], float(target[s]), taken[i]) for i, (d, s, n) in enumerate(docs)), key=str)


def mixed(df):
    got = mixing.schedule(df).selectExpr("doc_id", "size", "source_size", "target", "size * taken_turns AS taken")
    no_python(got)
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_mix_equals_plain_queueing(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "TOGETHER", 3)
    rng = random.Random(seed)
    names = ["hot", "é", "z", None, "", "", "\U0001f600", "tiny"]
    rows = odd_rows() + [(1000 + i, words(rng, rng.randint(0, 40)), "en", "hot" if rng.random() < 0.4 else rng.choice(names[:7]), 0) for i in range(300)]
    rows += [(5000, "a b c", None, "tiny", 0)] * 2 + [(None, "same text here", None, "hot", 0)] * 11
    assert mixed(odd(spark, rows)) == plain_mix(rows)


def test_mix_edges(spark):
    assert mixed(odd(spark, [])) == []
    empty = [(1, None, None, "a", 0), (2, " ", None, None, 0)]
    assert mixed(odd(spark, empty)) == plain_mix(empty)
    one = [(i, "a b c d", None, "a", 0) for i in range(5)]
    assert mixed(odd(spark, one)) == plain_mix(one)
    # a document larger than its source's target can't be taken; those of others are
    large = [(1, "w " * 1000, None, "a", 0), (2, "w", None, "b", 0), (3, "w w", None, "c", 0)]
    assert mixed(odd(spark, large)) == plain_mix(large)


def test_mix_of_the_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = sorted(map(tuple, queries.op13_mixing(spark, sf_dir).collect()), key=str)
    assert got == plain_mix(rows)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    r = con.sql(mixing.ORACLE)
    at = [r.columns.index(c) for c in ("doc_id", "size", "source_size", "target", "taken")]
    assert got == sorted((tuple(x[k] for k in at) for x in r.fetchall()), key=str)
    assert all(t <= 3 * n for _, n, _, _, t in got)
    by: dict = defaultdict(lambda: [0.0, 0, 0])
    for d, n, size, target, taken in got:
        e = by[(size, target)]
        e[0], e[1], e[2] = target, e[1] + taken, max(e[2], n)
    assert all(abs(taken - target) <= 2 * largest for target, taken, largest in by.values())


def test_the_mix_in_order(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = mixing.mix(docs).collect()
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    taken = Counter()
    for r in rows:
        taken[r.doc_id] += r["size"]
    assert {k: v for k, v in taken.items() if v} == {r.doc_id: r.taken for r in queries.op13_mixing(spark, sf_dir).collect() if r.taken}
