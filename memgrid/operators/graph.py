"""Chains, provenance and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memgrid.functions.text import wiki_links
from memgrid.operators.cuts import checkpointed
from memgrid.operators.nodes import is_root_source, resolve_aliases

MAX_DEPTH = 64


def chain_ends(nodes: DataFrame, pointer: str = "superseded_by", depth: int = MAX_DEPTH) -> DataFrame:
    """node_id, end, outcome: where following the pointer leads in at most `depth` steps.

    Pointer doubling: each join squares the step, so 64 steps take six joins, however many nodes. A
    node without a successor in the table points at itself; what then is no fixed point is on or
    leads to a cycle (end null).
    """
    base = nodes.select("node_id", F.col(pointer).alias("p"))
    known = nodes.select(F.col("node_id").alias("p"), F.lit(True).alias("there"))
    step = base.join(known, "p", "left").select("node_id", "p", F.when(F.col("there"), F.col("p")).otherwise(F.col("node_id")).alias("to"))
    jump = step.select("node_id", "to")
    k = 1
    while k < depth:
        jump = jump.join(jump.select(F.col("node_id").alias("to"), F.col("to").alias("to2")), "to").select("node_id", F.col("to2").alias("to"))
        k *= 2
    last = step.select(F.col("node_id").alias("to"), F.col("p").alias("last_p"), (F.col("to") == F.col("node_id")).alias("fixed"))
    outcome = F.when(~F.col("fixed"), "cycle").when(F.col("last_p").isNull(), "terminal").otherwise("missing_successor")
    return jump.join(last, "to").select("node_id", F.when(F.col("fixed"), F.col("to")).alias("end"), outcome.alias("outcome"))


def archive_verdicts(nodes: DataFrame, has_file: Column | None = None, need_active: bool = True) -> DataFrame:
    """Of each superseded node whether it may go, by what its chain ends in.

    need_active=False is the looser rule of the de-duplication command: any end but a disputed one will do.
    """
    file = has_file if has_file is not None else F.lit(True)
    ends = chain_ends(nodes)
    state = nodes.select(F.col("node_id").alias("end"), F.col("status").alias("end_status"), file.alias("end_file"))
    df = nodes.where("status = 'superseded'").select("node_id", "superseded_by").join(ends, "node_id").join(state, "end", "left")
    verdict = F.when(F.col("superseded_by").isNull(), "archive").when(F.col("outcome") == "cycle", "cyclic_supersession").when(F.col("outcome") == "missing_successor", "archive").when(F.col("end_status") == "disputed", "disputed_superseder")
    if need_active:
        verdict = verdict.when((F.col("end_status") != "active") | ~F.col("end_file"), "invalid_superseder")
    return df.select("node_id", verdict.otherwise("archive").alias("verdict"))


def resolved_labels(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """E5: golden labels (query_id, node_id) by the live end of their chain; stale ones are counted, not kept.

    Only superseded nodes are followed. Returns query_id, node_id, and stale rows with a null node_id.
    """
    followed = nodes.select("node_id", "status", F.when(F.col("status") == "superseded", F.col("superseded_by")).alias("next"))
    ends = chain_ends(followed, "next").join(nodes.select(F.col("node_id").alias("end"), F.col("status").alias("s")), "end", "left")
    live = F.when((F.col("outcome") == "terminal") & (F.col("s") != "superseded"), F.col("end"))
    return labels.join(ends.select("node_id", live.alias("live")), "node_id", "left").select("query_id", F.col("live").alias("node_id")).distinct()


def label_states(golden: DataFrame, nodes: DataFrame) -> DataFrame:
    """E5: of each golden query (query_id, expect_no_result, relevant: ids) its live labels, how many are stale, and whether it counts.

    query_id, must (distinct live ends, sorted), stale (labels whose chain ends in no live node), counted
    (queries whose labels are all stale are left out of the measures) and counted_strict (they count as
    misses). A query that expects no result, or has no labels, has its labels as they are.
    """
    asked = golden.where("NOT expect_no_result AND size(relevant) > 0")
    labels = asked.select("query_id", F.posexplode("relevant").alias("i", "node_id"))
    followed = nodes.select("node_id", "status", F.when(F.col("status") == "superseded", F.col("superseded_by")).alias("next"))
    ends = chain_ends(followed, "next").join(nodes.select(F.col("node_id").alias("end"), F.col("status").alias("s")), "end", "left")
    live = F.when((F.col("outcome") == "terminal") & (F.col("s") != "superseded"), F.col("end"))
    found = labels.join(ends.select("node_id", live.alias("live")), "node_id", "left").groupBy("query_id").agg(F.sort_array(F.collect_set("live")).alias("must"), F.count_if(F.col("live").isNull()).alias("stale"))
    out = golden.select("query_id", "expect_no_result", "relevant").join(found, "query_id", "left")
    must = F.coalesce("must", "relevant", F.array().cast("array<string>"))
    strict = ~F.col("expect_no_result")
    return out.select("query_id", must.alias("must"), F.coalesce("stale", F.lit(0)).alias("stale"), (strict & ~(F.col("must").isNotNull() & (F.size("must") == 0))).alias("counted"), strict.alias("counted_strict"))


def provenance(nodes: DataFrame) -> DataFrame:
    """For each active persistent node its roots, and whether something unknown or a cycle is behind it.

    node_id, n_direct, n_roots, unknown, cyclic. A source that is no root and has no sources of its
    own is unknown. Roots travel from sources to what cites them, each pair of node and root once
    and only as it is new, until none is; unknowns likewise. What is left of the links once those to
    nodes without links have been taken away, again and again, leads to a cycle. Each round is cut
    off, and each ends at its fixed point: as many rounds as the longest chain of sources.
    """
    cut = checkpointed(nodes.sparkSession)
    links = nodes.select(F.col("node_id").alias("a"), F.explode("sources").alias("b")).distinct()
    inner, roots = cut(links.where(~is_root_source(F.col("b")))), links.where(is_root_source(F.col("b")))
    up = inner.select(F.col("a").alias("to"), F.col("b").alias("a"))

    def spread(start: DataFrame) -> DataFrame:
        """start (a, ...) and the same for all nodes from which a is reached."""
        seen = new = cut(start.distinct())
        while not new.isEmpty():
            step = new.join(up, "a").drop("a").withColumnRenamed("to", "a").select(*start.columns).distinct()
            new = cut(step.join(seen, start.columns, "left_anti"))
            seen = cut(seen.union(new))
        return seen

    empty = inner.select(F.col("b").alias("a")).distinct().join(links.select("a").distinct(), "a", "left_anti")
    above = empty.join(up, "a").select(F.col("to").alias("a"))
    left, n = inner, inner.count()
    while n:
        left = cut(left.join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        n, before = left.count(), n
        if n == before:
            break
    n_roots = spread(roots.select("a", "b")).groupBy("a").agg(F.count("*").alias("n_roots"))
    unknown, cyclic = spread(above).withColumn("unknown", F.lit(True)), left.select("a").distinct().withColumn("cyclic", F.lit(True))
    df = nodes.where("status = 'active' AND type = 'persistent'").select(F.col("node_id").alias("a"), F.size("sources").alias("n_direct"))
    out = df.join(n_roots, "a", "left").join(unknown, "a", "left").join(cyclic, "a", "left")
    return out.select(F.col("a").alias("node_id"), "n_direct", F.coalesce("n_roots", F.lit(0)).cast("long").alias("n_roots"), F.coalesce("unknown", F.lit(False)).alias("unknown"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def provenance_states(nodes: DataFrame, rounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """As provenance(), but n_roots is 0, 1 or 2 (two or more), which is all that A20 asks; chains take the logarithm of their length in rounds.

    What is known of a node is the least and the greatest root behind it, and two flags; that adds up
    over paths, however often a path is taken. In a round a node takes in what its sources know. A
    source that is finished (whose own links are gone) is let go; a source with one link left, to
    one that is not finished, is replaced by that, so a chain is half as long each time; a link to
    oneself is a cycle.
    Nodes that finish are put aside, so rounds get smaller. What is left when nothing changes any
    more leads to a cycle. Where each node has several sources, level upon level, a round takes off one level.
    rounds, if given, gets the nodes and links that each round starts with.
    """
    cut = checkpointed(nodes.sparkSession)
    links = nodes.select(F.col("node_id").alias("a"), F.explode("sources").alias("b")).where("b IS NOT NULL").distinct()
    heads = links.select(F.col("a").alias("b")).distinct().withColumn("there", F.lit(True))
    links = cut(links.withColumn("root", is_root_source(F.col("b"))).join(heads, "b", "left").withColumn("there", F.coalesce("there", F.lit(False))))
    root, inner = F.when(F.col("root"), F.col("b")), ~F.col("root") & F.col("there")
    known = links.groupBy("a").agg(F.min(root).alias("lo"), F.max(root).alias("hi"), F.bool_or(~F.col("root") & ~F.col("there")).alias("unknown"), F.bool_or(inner & (F.col("a") == F.col("b"))).alias("cyclic"))
    edges = cut(links.where(inner & (F.col("a") != F.col("b"))).select("a", "b"))

    def with_links(df: DataFrame) -> DataFrame:
        """df with its nodes' number of links, the least target, and whether that has links itself."""
        degrees = edges.groupBy("a").agg(F.count("*").alias("deg"), F.min("b").alias("p"))
        goes_on = degrees.select(F.col("a").alias("p"), F.lit(True).alias("p_open"))
        return df.join(degrees, "a", "left").join(goes_on, "p", "left").na.fill(0, ["deg"])

    state = cut(with_links(known))
    ready, facts, size = [], ["lo", "hi", "unknown", "cyclic"], None
    while True:
        n_links = edges.count()
        if rounds is not None:
            rounds.append((state.count(), n_links))
        if not n_links:
            ready.append(state)
            break
        seen = edges.join(state.select(F.col("a").alias("b"), *[F.col(c).alias(f"b_{c}") for c in facts], F.col("deg").alias("b_deg"), F.col("p").alias("b_p"), F.col("p_open").alias("b_open")), "b")
        to = F.when((F.col("b_deg") == 1) & F.col("b_open"), F.col("b_p")).when(F.col("b_deg") > 0, F.col("b"))
        seen = seen.withColumn("to", to)
        taken = seen.groupBy("a").agg(F.min("b_lo").alias("t_lo"), F.max("b_hi").alias("t_hi"), F.bool_or("b_unknown").alias("t_unknown"), F.bool_or(F.col("b_cyclic") | F.coalesce(F.col("to") == F.col("a"), F.lit(False))).alias("t_cyclic"))
        edges = cut(seen.where("to IS NOT NULL AND to <> a").select("a", F.col("to").alias("b")).distinct())
        # those that had finished before this round have told all that ask, and are put aside
        ready.append(state.where("deg = 0"))
        new = with_links(state.where("deg > 0").drop("deg", "p", "p_open").join(taken, "a", "left"))
        both = [F.least("lo", "t_lo").alias("n_lo"), F.greatest("hi", "t_hi").alias("n_hi"), (F.col("unknown") | F.coalesce("t_unknown", F.lit(False))).alias("n_unknown"), (F.col("cyclic") | F.coalesce("t_cyclic", F.lit(False))).alias("n_cyclic")]
        new = new.select("a", "deg", "p", "p_open", *facts, *both)
        changed = F.lit(False)
        for c in facts:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"n_{c}"))
        new = cut(new.withColumn("changed", changed).select("a", *[F.col(f"n_{c}").alias(c) for c in facts], "deg", "p", "p_open", "changed"))
        now = new.agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"), F.sum("deg").alias("links")).first()
        state = new.drop("changed")
        if now["n"] and not now["changed"] and (now["n"], now["links"]) == size:
            ready.append(state.withColumn("cyclic", F.lit(True)))
            break
        size = now["n"], now["links"]
    every = ready[0].select("a", *facts)
    for df in ready[1:]:
        every = every.unionByName(df.select("a", *facts))
    n_roots = F.when(F.col("lo").isNull(), 0).when(F.col("lo") == F.col("hi"), 1).otherwise(2)
    df = nodes.where("status = 'active' AND type = 'persistent'").select(F.col("node_id").alias("a"), F.size("sources").alias("n_direct")).join(every, "a", "left")
    return df.select(F.col("a").alias("node_id"), "n_direct", n_roots.alias("n_roots"), F.coalesce("unknown", F.lit(False)).alias("unknown"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def provenance_counts(stats: DataFrame) -> DataFrame:
    """Three counts that may overlap, of provenance() or provenance_states()."""
    bad = F.col("unknown") | F.col("cyclic")
    return stats.agg(F.count_if(F.col("n_roots") >= 2).alias("multi_source"), F.count_if((F.col("n_roots") == 1) & (F.col("n_direct") >= 2) & ~bad).alias("same_root"), F.count_if(bad).alias("unknown_or_cyclic"))


def edges_from_text(nodes: DataFrame) -> DataFrame:
    """G1: links of each node's text, resolved; unknown targets and self links are left out."""
    links = nodes.select(F.col("node_id").alias("source_id"), F.explode(wiki_links(F.col("content"))).alias("target"))
    found = resolve_aliases(links, nodes).where("node_id IS NOT NULL AND node_id <> source_id")
    return found.select("source_id", F.col("node_id").alias("target_id")).distinct()


def repointed(nodes: DataFrame) -> DataFrame:
    """Content and sources with superseded nodes replaced by the active end of their chain; `hits` changes."""
    ends = chain_ends(nodes).where("outcome = 'terminal'").join(nodes.select(F.col("node_id").alias("end"), "status"), "end").where("status = 'active'")
    new = nodes.where("status = 'superseded'").select("node_id").join(ends.select("node_id", "end"), "node_id").where("node_id <> end").select(F.col("node_id").alias("old"), F.col("end").alias("new"))
    src = nodes.select("node_id", F.posexplode("sources").alias("i", "old")).join(new, "old", "left")
    src = src.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("new", "old").alias("s")))).alias("x"), F.count("new").alias("moved"))
    hit = nodes.select("node_id", F.explode(wiki_links(F.col("content"))).alias("old")).join(new, "old").groupBy("node_id").agg(F.collect_set(F.struct("old", "new")).alias("swaps"), F.count("*").alias("links"))
    df = nodes.select("node_id", "content", "sources").join(src, "node_id", "left").join(hit, "node_id", "left")
    text = F.aggregate(F.coalesce("swaps", F.array().cast("array<struct<old:string,new:string>>")), F.col("content"), lambda t, s: F.regexp_replace(t, F.concat(F.lit(r"\[\[\s*\Q"), s["old"], F.lit(r"\E\s*(?=[|\]])")), F.concat(F.lit("[["), s["new"])))
    hits = F.greatest(F.coalesce("links", F.lit(0)), F.coalesce("moved", F.lit(0)))
    return df.select("node_id", text.alias("content"), F.array_distinct(F.coalesce(F.transform("x", lambda y: y["s"]), "sources")).alias("sources"), hits.cast("long").alias("hits")).where("hits > 0")
