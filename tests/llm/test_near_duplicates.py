"""Operator 3 against all pairs, and its parts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memgrid.llm import near_duplicates as N
from memgrid.llm.common import read
from tests.llm.cases import odd, words


def plain_classes(rows):
    """Least doc_id for each row, from all pairs of texts."""
    shingles = [N.weighted_shingles(t or "") for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a is not None and b is not None and (a == b or max(N.similarity(shingles[i], shingles[j])) >= N.THRESHOLD):
                label[root(i)] = root(j)
    groups: dict[int, list] = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return [min((d for d in groups[root(i)] if d is not None), default=None) for i in range(len(rows))]


def test_similarity_is_probability_jaccard():
    rng = random.Random(1)
    for _ in range(50):
        a = {k: rng.randint(1, 4) for k in rng.sample(range(30), 12)}
        b = {k: rng.randint(1, 4) for k in rng.sample(range(30), 12)}
        want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in a.keys() & b.keys())
        arrays = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert N.similarity(*arrays)[0] == pytest.approx(want)
        assert N.similarity(*arrays)[1] == len(a.keys() & b.keys()) / len(a.keys() | b.keys())


def test_registers_agree_as_often_as_they_should():
    rng = random.Random(2)
    text = words(rng, 300).split()
    for cut in (30, 120):
        other = text[:-cut] + words(rng, cut).split()
        a, b = N.weighted_shingles(" ".join(text)), N.weighted_shingles(" ".join(other))
        s = N.signatures([a, b], 4000)
        assert (s[0] == s[1]).mean() == pytest.approx(N.similarity(a, b)[0], abs=0.04)
    one = N.signatures([a], 50)
    assert (one == N.signatures([b, a, b], 50)[1]).all()  # whatever else is in the batch


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(3)
    rows, d = [], 0
    for _ in range(12):
        base = words(rng, rng.choice([3, 8, 60, 200])).split()
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            rows.append((d * 7 % 211, " ".join(copy)))
            d += 1
    rows += [(500, None), (501, None), (502, ""), (503, ""), (None, rows[0][1]), (504, "the only one of its kind here"), (505, "x y"), rows[3]]
    docs = odd(spark, [(d, t, "en", "a", 1) for d, t in rows])
    got = N.near_duplicates(docs).collect()
    want = {}
    for (d, t), c in zip(rows, plain_classes(rows)):
        want[d] = c
    assert len(got) == len(rows) and {r.doc_id: r.class_id for r in got} == want
    kept = N.deduplicated(docs)
    assert kept.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(d for d, t in texts if t is not None) == sorted({c for (_, t), c in zip(rows, plain_classes(rows)) if t is not None})
    assert sum(t is None for _, t in texts) == 2


def test_large_buckets_of_texts_that_share_passages(spark, monkeypatch):
    """Texts with a passage in common, as much as 0.7 of each, and some near copies among them."""
    monkeypatch.setattr(N, "PAIRS", 3)
    rng = random.Random(9)
    passage = words(rng, 90)
    rows = []
    for d in range(120):
        own = words(rng, rng.choice([25, 35, 60]))
        rows.append((d, f"{own} {passage}" if d % 2 else f"{passage} {own} {passage}"))
        if d % 5 == 0:
            rows.append((1000 + d, rows[-1][1] + " " + words(rng, 6)))
    got = {r.doc_id: r.class_id for r in N.near_duplicates(odd(spark, [(d, t, "en", "a", 1) for d, t in rows])).collect()}
    assert got == dict(zip([d for d, _ in rows], plain_classes(rows)))


def test_repeated_rows_and_clashing_names(spark):
    rng = random.Random(11)
    text = words(rng, 50)
    rows = [(1, text, "x", "y", 1)] * 3 + [(2, text, "x", "y", 1), (3, None, "x", "y", 1), (3, None, "x", "y", 1), (None, words(rng, 50), "x", "y", 2)] + [(4, words(rng, 30), "x", "y", 2)] * 2 + [(5, words(rng, 30), "x", "y", 2)]
    docs = odd(spark, rows).withColumns({c: F.lit(c) for c in ("n", "doc", "__key", "__doc", "__node", "__n", "row", "N_")})
    out = N.deduplicated(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 3, 3, 4, 5, None] and all(r.node == "clash" and r.row == "row" and r.lang == "x" for r in got)


def test_links_by_sets_alone_are_found(spark):
    """Texts with the same shingles but other repeats: near by sets, far by weights."""
    rng = random.Random(8)
    rows = []
    for d in range(0, 80, 2):
        base, block = words(rng, 60), words(rng, 7)
        rows += [(d, base + f" {block}" * 30), (d + 1, base + f" {block}" * 3)]
    a, b = (N.weighted_shingles(t) for _, t in rows[:2])
    assert N.similarity(a, b)[0] < 0.5 and N.similarity(a, b)[1] == 1
    got = {r.doc_id: r.class_id for r in N.near_duplicates(odd(spark, [(d, t, "en", "a", 1) for d, t in rows])).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_whole_table_equals_all_pairs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()} == dict(zip([d for d, _ in rows], plain_classes(rows)))


def test_empty(spark):
    assert N.near_duplicates(odd(spark, [])).collect() == [] and N.deduplicated(odd(spark, [])).collect() == []


def test_odd_rows(spark):
    assert N.near_duplicates(odd(spark)).count() == odd(spark).count()
    assert N.deduplicated(odd(spark)).select("doc_id").where("doc_id = 4").count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.lab for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
