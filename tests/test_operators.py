"""Operators on small tables with known results, and against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memgrid.functions import folds, knowledge as K, scoring as S, text as T
from memgrid.operators import graph as G, lexical as L, lifecycle as B, nodes as N, vector_cells as C, vectors as V
from memgrid.plans import hybrid as H

NODE = "node_id string, title string, content string, type string, status string, superseded_by string, okf_type string, project string, verified boolean, tags array<string>, sources array<string>, created_at timestamp, last_accessed timestamp, retrieved_count long, injected_count long, used_count long, access_count long"
NOW = "2024-01-31 00:00:00"


def node(spark, *rows):
    import datetime as dt

    base = {"title": "t", "content": "c", "type": "persistent", "status": "active", "superseded_by": None, "okf_type": "fact", "project": "p", "verified": None, "tags": [], "sources": [], "created_at": dt.datetime(2024, 1, 1), "last_accessed": dt.datetime(2024, 1, 1), "retrieved_count": 0, "injected_count": 0, "used_count": 0, "access_count": 0}
    names = [c.split()[0] for c in NODE.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], NODE)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_bigrams_and_terms(spark):
    assert one(spark, T.cjk_bigrams(F.lit("查数据库 db 字"))) == "查数 数据 据库 db 字"
    assert one(spark, T.or_terms(F.lit('the "nodes_vec" sqlite.py a ?? 数据库x the sqlite.py'))) == ["nodes_vec", "sqlite.py", "数据 据库x", "数据 据库"]
    assert len(one(spark, T.or_terms(F.lit(" ".join(f"word{i}" for i in range(40)))))) == 24


def test_fts_phrase_and_ranking(spark):
    nodes = node(spark, {"node_id": "a", "content": "the api gateway restarts"}, {"node_id": "b", "content": "gateway of the api"}, {"node_id": "c", "content": "nothing here", "tags": ["api-gateway"]})
    q = spark.createDataFrame([(1, "api-gateway"), (2, "restarts"), (3, "??")], "query_id long, text string")
    got = {(r.query_id, r.node_id) for r in L.bm25(q, nodes).collect()}
    assert got == {(1, "a"), (1, "c"), (2, "a")}
    assert {r.query_id: r.hits for r in L.hit_count(q, nodes).collect()} == {1: 2, 2: 1, 3: 0}


def test_max_fusion(spark):
    legs = spark.createDataFrame([(1, "x", "alpha", 1), (1, "x", "beta", 2), (1, "y", "beta", 1), (1, "y", "alpha", 2), (1, "y", "gamma", 3)], "query_id long, leg string, node_id string, rank int")
    assert [(r.node_id, round(1 / r.score)) for r in H.fused(legs).orderBy("pos").collect()] == [("alpha", 61), ("beta", 61), ("gamma", 63)]


def test_penalties_never_raise_and_order_holds(spark):
    df = spark.range(0, 300).select((F.col("id") % 7).alias("used"), (F.col("id") % 11).alias("injected"), (F.col("id") * 1.5).alias("clock"))
    assert df.where(~S.activation(F.col("used"), F.col("injected"), F.col("clock")).between(0, 0.6)).isEmpty()
    hub = [r[0] for r in spark.range(0, 50).select(S.hub_penalty(F.col("id"))).collect()]
    assert hub[0] == 0 and hub == sorted(hub, reverse=True)
    assert one(spark, S.status_penalty(F.lit("superseded"))) < one(spark, S.status_penalty(F.lit("disputed"))) < 0


def test_inject_gate(spark):
    df = spark.createDataFrame([(1, 3.0, None), (1, 0.6, True), (1, 0.4, None), (1, 2.9, False), (2, 0.2, True), (2, -1.0, None)], "q long, r double, v boolean")
    got = df.select("q", "r", S.inject(F.col("r"), F.col("v"), "q").alias("i")).orderBy("q", F.desc("r")).collect()
    assert [r.i for r in got] == [True, False, True, False, False, False]


def test_one_hop(spark):
    edges = spark.createDataFrame([("alpha", "beta"), ("alpha", "delta"), ("gamma", "alpha"), ("beta", "delta")], "source_id string, target_id string")
    anchors = spark.createDataFrame([(1, "alpha")], "query_id long, node_id string")
    assert {r.node_id for r in N.neighbours(edges, anchors, 6).collect()} == {"beta", "gamma", "delta"}


@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.84])
@pytest.mark.parametrize(("k", "per_cell"), [(1, 8192), (1, 11), (6, 8192), (6, 3)])
def test_similar_pairs_equal_all_pairs(spark, threshold, k, per_cell):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 16))
    m = np.vstack([base[i % 8] + rng.normal(size=16) * 0.2 for i in range(40)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(f"n{i:02}", v.tolist()) for i, v in enumerate(m)] + [("odd", [1.0, 0.0]), ("none", None)]
    df = spark.createDataFrame(rows, "node_id string, embedding array<double>")
    got = {(r.id_a, r.id_b): r.sim for r in V.similar_pairs(df, threshold, centres=C.learned(df, k), per_cell=per_cell).collect()}
    want = {(f"n{i:02}", f"n{j:02}"): m[i] @ m[j] for i in range(40) for j in range(i + 1, 40) if round(1 - round(1 - m[i] @ m[j], 8), 8) >= threshold}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in got)


def clustered(spark, n=400, d=12, seed=5, copies=60):
    """Vectors around a few directions, many of them alike, and some that are odd."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(9, d))
    m = np.vstack([base[i % 9] * 2 + rng.normal(size=d) * 0.3 for i in range(n)] + [base[0]] * copies)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    odd = [("zero", [0.0] * d), ("long", [3.0] * d), ("other", [1.0, 0.0]), ("none", None), ("empty", [])]
    return spark.createDataFrame([(f"n{i:04}", v.tolist()) for i, v in enumerate(m)] + odd, "node_id string, embedding array<double>")


def test_fewer_pairs_are_compared_as_the_threshold_rises(spark):
    df = clustered(spark)
    centres = C.learned(df, 9)
    seen = [C.comparisons(df, t, centres=centres) for t in (-1.0, 0.5, 0.8, 0.95)]
    assert seen == sorted(seen, reverse=True) and seen[0] >= 460 * 459 // 2 and seen[2] < 0.35 * seen[0]
    assert C.comparisons(df, 0.8, centres=C.learned(df, 1)) >= 460 * 459 // 2


@pytest.mark.parametrize(("k", "per_cell"), [(1, 8192), (9, 8192), (9, 8)])
def test_stored_vectors_give_the_nearest(spark, tmp_path, k, per_cell, monkeypatch):
    monkeypatch.setattr(C, "PER_BLOCK", per_cell)
    df = clustered(spark)
    index = C.VectorIndex.build(df, str(tmp_path / "v"), k=k)
    rng = np.random.default_rng(1)
    queries = [(i, v) for i, v in enumerate(rng.normal(size=(20, 12)).tolist())] + [(100 + i, r.embedding) for i, r in enumerate(df.where("node_id < 'n0010'").collect())] + [(200, [0.0] * 12), (201, [1.0, 1.0]), (202, None), (203, [1.0] * 5)]
    q = spark.createDataFrame(queries, "query_id long, vector array<double>")
    want = sorted(map(tuple, V.top_k_many(df, q, 7).collect()))
    assert sorted(map(tuple, index.nearest(q, 7, count=True).collect())) == want
    assert index.compared[0] <= index.compared[1] and (k == 1 or index.compared[0] < 0.75 * index.compared[1])
    none = C.VectorIndex.build(df.where("false"), str(tmp_path / "none"))
    assert none.nearest(q, 3).count() == 0


def test_complete_linkage_does_not_chain(spark):
    nodes = node(spark, *({"node_id": x} for x in "abc"))
    v = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.92, 0.391918, 0.0]), ("c", [0.64, 0.768375, 0.0])], "node_id string, embedding array<double>")
    got = V.complete_linkage(nodes, v, seed=0.86, floor=0.84).collect()
    assert {(r.cluster, r.node_id) for r in got} == {("a", "a"), ("a", "b")}


@pytest.mark.parametrize("seed", [1, 2])
def test_linkage_in_rounds_equals_one_by_one(spark, seed, monkeypatch):
    monkeypatch.setattr(V, "PEEL", 100)
    rng = np.random.default_rng(seed)
    m = np.vstack([b + rng.normal(size=6) * 0.45 for b in rng.normal(size=(5, 6)) * 1.5 for _ in range(14)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sim = np.round(m @ m.T, 2)  # ties
    rows = [(f"n{i:02}", f"n{j:02}", float(sim[i, j])) for i in range(70) for j in range(i + 1, 70) if sim[i, j] >= 0.8]
    df = spark.createDataFrame(rows, "id_a string, id_b string, sim double")
    want = sorted(map(tuple, V.folded(df.withColumn("label", F.lit("all")), 0.85, 6).collect()))
    got = sorted(map(tuple, V.linked(df, 0.85, 6, component_pairs=0).collect()))
    assert got == want and len({c for c, _ in want}) > 5


def test_connected(spark):
    pairs = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y")], "id_a string, id_b string")
    got = {r.node_id: r.label for r in V.connected(pairs).collect()}
    assert set(got.values()) == {"n000", "x"} and got["n060"] == "n000"


def test_top_k_keeps_ties_by_id(spark):
    v = spark.createDataFrame([(x, [1.0, 0.0]) for x in "dcba"] + [("e", [0.0, 1.0]), ("f", [0.0, 0.0])], "node_id string, embedding array<double>")
    assert [r.node_id for r in V.top_k(v, [2.0, 0.0], 2).collect()] == ["a", "b"]
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<double>")
    got = V.top_k_many(v, q, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.node_id) for r in got] == [(1, "a"), (1, "b"), (2, "e"), (2, "a")]


def test_chains(spark):
    rows = [("a", "b"), ("b", "c"), ("c", None), ("d", "gone"), ("x", "y"), ("y", "x"), ("z", "x")] + [(f"l{i:02}", f"l{i + 1:02}" if i < 62 else None) for i in range(63)]
    nodes = node(spark, *({"node_id": a, "superseded_by": b, "status": "superseded" if b else "active"} for a, b in rows))
    got = {r.node_id: (r.end, r.outcome) for r in G.chain_ends(nodes).collect()}
    assert got["a"] == ("c", "terminal") and got["d"] == ("d", "missing_successor") and got["z"] == (None, "cycle") and got["x"] == (None, "cycle") and got["l00"] == ("l62", "terminal")
    verdict = {r.node_id: r.verdict for r in G.archive_verdicts(nodes).collect()}
    assert verdict["a"] == "archive" and verdict["d"] == "archive" and verdict["x"] == "cyclic_supersession"


def test_provenance(spark):
    rows = [{"node_id": "two", "sources": ["session:a", "session:b"]}, {"node_id": "m1", "sources": ["session:r"]}, {"node_id": "m2", "sources": ["session:r"]}, {"node_id": "n2", "sources": ["m1", "m2"]}, {"node_id": "u", "sources": ["nobody"]}, {"node_id": "c1", "sources": ["c2"]}, {"node_id": "c2", "sources": ["c1"]}]
    stats = {r.node_id: r for r in G.provenance(node(spark, *rows)).collect()}
    assert stats["two"].n_roots == 2 and stats["n2"].n_roots == 1 and stats["u"].unknown and stats["c1"].cyclic and not stats["n2"].unknown
    assert tuple(G.provenance_counts(G.provenance(node(spark, *rows))).first()) == (1, 1, 3)


def test_repointing(spark):
    nodes = node(spark, {"node_id": "old", "status": "superseded", "superseded_by": "new"}, {"node_id": "new"}, {"node_id": "x", "content": "see [[old|the old]] and [[ old ]]", "sources": ["old", "new", "k"]})
    r = G.repointed(nodes).first()
    assert r.content == "see [[new|the old]] and [[new]]" and r.sources == ["new", "k"] and r.hits == 2


def test_folds_equal_plain(spark):
    rng = random.Random(4)
    for _ in range(20):
        sizes = [rng.randint(0, 60) for _ in range(rng.randint(0, 15))]
        c = F.array(*map(F.lit, sizes)).cast("array<bigint>")
        left, take = 100, []
        for s in sizes:
            take.append(s <= left)
            left -= s if s <= left else 0
        chunk, size, n, out = 0, 0, 0, []
        for s in sizes:
            if n and (size + s + 2 > 80 or n >= 4):
                chunk, size, n = chunk + 1, s, 1
            else:
                size, n = size + s + (2 if n else 0), n + 1
            out.append(chunk)
        assert one(spark, folds.greedy_budget(c, 100)) == take and one(spark, folds.chunks(c, 80, 2, 4)) == out


def test_notes(spark):
    body = "## Takeaway\nkeep it\n## Details\n- waits 12 ms for /etc/app/x.conf\n```\ncode\n```\n- plain line\n## Sources\n- mem_1"
    assert one(spark, K.validation_codes(F.lit("ok"), F.lit(body), F.lit("fact"), F.array(F.lit("mem_1")))) == []
    bad = one(spark, K.validation_codes(F.lit("Fact: 数据"), F.lit("## Takeaway\na\nb\n## Takeaway\n"), F.lit("pitfall"), F.array(F.lit("??"))))
    assert bad == sorted(["okf_duplicate_section", "okf_title_non_english", "okf_title_type_prefix", "okf_unresolvable_source", "okf_takeaway_invalid", "okf_missing_section:Sources", "okf_missing_section:Symptom", "okf_missing_section:Cause", "okf_missing_section:Fix"])
    assert one(spark, K.inferred_type(F.lit(body))) == "fact" and one(spark, K.takeaway(F.lit(body), F.lit("t"))) == "keep it"
    assert one(spark, K.anchors(F.lit(body))) == ["/etc/app/x.conf", "12", "12 ms"]
    new = "## Takeaway\nkeep it\n## Details\nwaits 120 ms"
    assert one(spark, K.missing_anchors(F.lit(body), F.lit(new))) == ["/etc/app/x.conf", "12", "12 ms"]
    merged = K.merged(F.lit(body), F.lit(new))
    text = one(spark, merged)
    assert one(spark, K.omitted_lines(F.lit(body), F.lit(text))) == [] and text == body.replace("- plain line\n", "- plain line\n\nwaits 120 ms\n")


def test_transcript(spark):
    text = "marker\n## T3 User\nHello  there\n## T4 Assistant\nI did\n### Tool T4.1 read\ncall: cat f\nresult [ok]: 12: one\n13: two\n## T5 User\nbye"
    turns = one(spark, K.turns(F.lit(text)))
    assert [(t.number, t.role, t.body, len(t.tools)) for t in turns] == [(3, "User", "Hello  there", 0), (4, "Assistant", "I did", 1), (5, "User", "bye", 0)]
    t = K.turns(F.lit(text))[1]
    assert one(spark, K.verified(F.lit("one two"), K.evidence_text(t, F.lit(False)))) and not one(spark, K.verified(F.lit("I did"), K.evidence_text(t, F.lit(False))))
    assert one(spark, K.verified(F.lit("cat f"), K.evidence_text(t, F.lit(True)))) and not one(spark, K.verified(F.lit("cat f"), K.evidence_text(t, F.lit(False))))
    assert [t.number for t in one(spark, K.turns(F.lit("## User\na\n## Assistant\nb")))] == [1, 2]


def test_sections_and_links(spark):
    assert [(s.heading, s.body) for s in one(spark, T.sections(F.lit("pre\n## A\n x \n## B\n## A\ny")))] == [("A", "x"), ("B", "")]
    assert one(spark, T.wiki_links(F.lit("[[a]] [[ b | c ]] [[|x]] [[ ]]"))) == ["a", "b"]


def test_downgrades_and_decisions(spark):
    nodes = node(spark, {"node_id": "k", "sources": ["mem_1"]}, {"node_id": "d", "sources": ["session:1"], "content": "waits 12 ms, 13 ms, 14 ms"}, {"node_id": "e", "sources": ["session:1"]})
    d = spark.createDataFrame([(1, "supersede", "k", "x"), (2, "supersede", "d", "nothing"), (3, "supersede", "e", "new"), (4, "supersede", "e", "newer"), (5, "complement", "e", "c")], "draft_id long, action string, target string, content string")
    got = {r.draft_id: (r.action, r.reason) for r in B.downgraded(d, nodes).collect()}
    assert got == {1: ("complement", "curated"), 2: ("complement", "literals_missing"), 3: ("supersede", None), 4: ("complement", "claimed"), 5: ("complement", None)}


def test_supersede_downgrade_judges_all_drafts(spark, sf_dir):
    from memgrid.plans import q_lifecycle
    from memgrid.sources.logical import Tables

    t = Tables(spark, sf_dir)
    got = {r[0] for r in q_lifecycle.supersede_downgrade(t).select("draft_id").collect()}
    assert got == {r[0] for r in t.nodes().select("seq").collect()}


def test_nearest_in_blocks_equals_nearest_at_once(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"n{i:03d}", [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(150)] + [("other", [1.0, 0.0]), ("none", None)]
    vectors = spark.createDataFrame(rows, "node_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows[:40])] + [(90, [0.0, 1.0]), (91, None)], "query_id long, vector array<double>")
    at_once = sorted(map(tuple, V.top_k_many(vectors, queries, 7).collect()))
    monkeypatch.setattr(V, "PER_QUERY_BLOCK", 16)
    monkeypatch.setattr(V, "PER_BLOCK", 5)
    assert sorted(map(tuple, V.top_k_many(vectors, queries, 7, sent=0).collect())) == at_once
    assert len(at_once) == 40 * 7 + 1 and {r[0] for r in at_once} == {*range(40), 90}
    assert V.top_k_many(vectors, queries.where("false"), 7).collect() == []


def test_search_by_chunks_and_without_reranker(spark):
    from memgrid.operators import engines
    from memgrid.plans import hybrid as H

    none = "cast(array() as array<string>)"
    nodes = spark.createDataFrame([("a", "alpha", "about gates"), ("b", "beta", "about rivers"), ("c", "gamma", "about hills")], "node_id string, title string, content string")
    nodes = nodes.selectExpr("*", "'persistent' type", "'active' status", f"{none} tags", f"{none} sources", "cast(null as string) project", "0 used_count", "0 injected_count", "timestamp'2024-01-01' last_accessed", "cast(null as boolean) verified")
    edges = spark.createDataFrame([], "source_id string, target_id string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.0, 0.0, 1.0])], "node_id string, embedding array<double>")
    queries = spark.createDataFrame([(1, "gates", [1.0, 0.1, 0.05])], "query_id long, text string, vector array<double>")
    run = lambda **k: [tuple(r) for r in H.search(queries, nodes, edges, vectors, "2024-01-02 00:00:00", max_candidates=1, **k).select("node_id", "rerank_score", "is_anchor").collect()]
    assert run()[0][0] == "a" and run()[0][1] > 0
    assert run(reranks=False) == [("a", 0.0, True)]
    chunks = spark.createDataFrame([(1, 1, [0.0, 0.0, 1.0])], "query_id long, chunk int, vector array<double>")
    both = H.search(queries, nodes, edges, vectors, "2024-01-02 00:00:00", max_candidates=2, chunks=chunks).select("node_id").collect()
    assert {r.node_id for r in both} == {"a", "c"}  # c is first for the chunk alone
    engines.register_reranker("length", lambda q, d: F.length(d) * 1.0)
    assert [one(spark, engines.reranked(F.lit("q"), F.lit("four"), x)) for x in ("length", "gone")] == [4.0, 0.0]


def test_fingerprint():
    from memgrid.operators.engines import fingerprint

    assert fingerprint("local", "m", 3) == fingerprint("local", "m", 3, "http://x") != fingerprint("ollama", "m", 3, "http://x") != fingerprint("ollama", "m", 3, "http://y")
    assert fingerprint("local", "m", None).startswith("sha1:")


def reached(links: dict, a: str) -> tuple[set, set, bool]:
    """Nodes and roots behind a, and whether something unknown is."""
    seen, roots, unknown, todo = set(), set(), False, [a]
    while todo:
        for b in links.get(todo.pop()) or []:
            if b.startswith("session:"):
                roots.add(b)
            elif not links.get(b):
                unknown = True
            elif b not in seen:
                seen.add(b)
                todo.append(b)
    return seen, roots, unknown


@pytest.mark.parametrize("seed", range(4))
def test_provenance_in_rounds_equals_a_search(spark, seed):
    rng = random.Random(seed)
    n = 60
    rows = []
    for i in range(n):
        pick = lambda: rng.choice([f"n{rng.randrange(n)}" if seed % 2 else f"n{rng.randrange(max(1, i))}", f"session:{rng.randrange(4)}", "gone"])  # noqa: E731, B023
        rows.append((f"n{i}", [pick() for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]))
    rows += [(f"c{i}", [f"c{(i + 1) % 7}", *(["session:1"] if i == 3 else [])]) for i in range(7)] + [("t", ["c0"]), ("self", ["self"])]
    links = dict(rows)
    behind = {a: reached(links, a) for a in links}
    want = {a: (min(2, len(r)), u, any(x in behind[x][0] for x in {a} | s if x in behind)) for a, (s, r, u) in behind.items()}
    df = node(spark, *({"node_id": a, "sources": s} for a, s in rows))
    assert {r.node_id: (r.n_roots, r.unknown, r.cyclic) for r in G.provenance_states(df).collect()} == want


def test_provenance_of_a_chain_takes_few_rounds(spark):
    n = 5000
    df = spark.range(n).selectExpr("concat('n', id) node_id", "'active' status", "'persistent' type", f"CASE WHEN id = {n - 1} THEN array('session:1') ELSE array(concat('n', id + 1)) END sources")
    rounds: list = []
    stats = G.provenance_states(df, rounds)
    assert stats.where("n_roots = 1 AND NOT unknown AND NOT cyclic").count() == n and len(rounds) <= 15
    assert [a for a, _ in rounds] == sorted((a for a, _ in rounds), reverse=True)


def test_provenance_of_long_chains_and_cycles(spark):
    rows = [(f"m{i:03d}", [f"m{i + 1:03d}"]) for i in range(90)] + [("m090", ["session:1", "session:2"]), ("x", ["y"]), ("y", ["x", "session:3"]), ("z", ["x", "gone"]), ("w", [])]
    nodes = spark.createDataFrame(rows, "node_id string, sources array<string>").selectExpr("*", "'active' status", "'persistent' type")
    got = {r.node_id: tuple(r)[1:] for r in G.provenance(nodes).collect()}
    assert got["m000"] == (1, 2, False, False) and got["m090"] == (2, 2, False, False)
    assert got["x"] == got["y"][:0] + (1, 1, False, True) and got["y"] == (2, 1, False, True) and got["z"] == (2, 1, True, True) and got["w"] == (0, 0, False, False)
