"""Logical tables of the library over the driver's relational tables.

Each table is a list of SQL expressions that two dialects share but for a few names, so that the
DataFrame (Spark) and the common table expression that an oracle starts from (DuckDB) say the same.
All instants hang on NOW, so results don't depend on the clock.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memgrid.operators.cuts import scratch_folder
from memgrid.operators.lexical_index import LexicalIndex
from memgrid.operators.vector_cells import VectorIndex

NOW = "2024-01-31 00:00:00"
NOW_S = 1_706_659_200


@dataclass(frozen=True)
class Dialect:
    ts: Callable[[str], str]
    array: Callable[[str], str]
    struct: Callable[[dict[str, str]], str]
    json_k: str
    seq: Callable[[str, str, str], str]  # (n, variable, expression): expression for variable = 1..n
    sha1: str


SPARK = Dialect(
    ts=lambda s: f"timestamp_seconds({s})",
    array=lambda x: f"array({x})",
    struct=lambda d: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in d.items()) + ")",
    json_k="cast(get_json_object(props, '$.k') as bigint)",
    seq=lambda n, v, e: f"transform(filter(sequence(0, {n}), z -> z > 0), {v} -> {e})",
    sha1="sha1(cast(cast(user_id as string) as binary))",
)
DUCK = Dialect(
    ts=lambda s: f"make_timestamp(CAST({s} AS BIGINT) * 1000000)",
    array=lambda x: f"[{x}]",
    struct=lambda d: "{" + ", ".join(f"'{k}': {v}" for k, v in d.items()) + "}",
    json_k="CAST(json_extract_string(props, '$.k') AS BIGINT)",
    seq=lambda n, v, e: f"list_transform(range(1, {n} + 1), lambda {v}: {e})",
    sha1="sha1(CAST(user_id AS VARCHAR))",
)


def nid(x: str) -> str:
    return f"concat('n', lpad(cast({x} as string), 8, '0'))"


def node_columns(d: Dialect) -> dict[str, str]:
    i = "doc_id"
    null = "cast(null as string)"
    return {
        "seq": i,
        "node_id": nid(i),
        "content": "text",
        "type": f"CASE WHEN {i} % 5 = 0 THEN 'transient' ELSE 'persistent' END",
        "status": f"CASE {i} % 7 WHEN 0 THEN 'superseded' WHEN 1 THEN 'superseded' WHEN 2 THEN 'disputed' ELSE 'active' END",
        "superseded_by": f"CASE WHEN {i} % 49 = 0 THEN {nid(f'{i} + 1')} WHEN {i} % 49 = 1 THEN {nid(f'{i} - 1')} WHEN {i} % 7 = 0 THEN {nid(f'{i} + 1')} WHEN {i} % 7 = 1 THEN {nid(f'{i} + 2')} WHEN {i} % 14 = 2 THEN {nid(f'{i} + 7')} WHEN {i} % 14 = 9 THEN {nid(f'{i} - 7')} ELSE {null} END",
        "project": f"CASE WHEN {i} % 11 = 0 THEN {null} ELSE source END",
        "okf_type": f"CASE {i} % 6 WHEN 0 THEN 'decision' WHEN 1 THEN 'fact' WHEN 2 THEN 'procedure' WHEN 3 THEN 'pitfall' WHEN 4 THEN 'fact' ELSE {null} END",
        "verified": "CASE WHEN quality = 1 THEN true WHEN quality = 0 THEN false ELSE cast(null as boolean) END",
        "created_at": d.ts(f"{NOW_S} - ({i} * 53 % 120) * 86400 - ({i} % 24) * 3600"),
        "last_accessed": d.ts(f"{NOW_S} - ({i} * 37 % 120) * 86400"),
        "tags": f"CASE WHEN {i} % 50 = 0 THEN {d.array(f"concat('t', cast({i} % 10 as string)), 'dreamer-hub'")} ELSE {d.array(f"concat('t', cast({i} % 10 as string)), concat('u', cast({i} % 7 as string))")} END",
        "sources": f"CASE {i} % 4 WHEN 0 THEN {d.array(f"concat('session:', cast({i} % 40 as string)), concat('session:', cast({i} % 17 as string))")} WHEN 1 THEN {d.array(f"concat('session:', cast({i} % 23 as string))")} WHEN 2 THEN {d.array(f"{nid(f'{i} - 1')}, {nid(f'{i} - 2')}")} ELSE {d.array(f"{nid(f'{i} + 1')}, {nid(f'{i} - 1')}, concat('legacy:', cast({i} % 5 as string))")} END",
        "retrieved_count": "coalesce(retrieved, 0)",
        "injected_count": "coalesce(injected, 0)",
        "used_count": "coalesce(used, 0)",
        "access_count": f"coalesce(injected, 0) + coalesce(used, 0) + {i} % 3",
    }


def search_columns(d: Dialect, n: str) -> dict[str, str]:
    k = d.json_k
    hit = d.struct({"rank": "i", "node_id": nid(f"(event_id * 7 + i * 31) % {n}"), "inject": f"({k} + i) % 3 = 0"})
    return {
        "event_id": "event_id",
        "ts": "ts",
        "source": "event_type",
        "session_hash": f"CASE WHEN user_id % 9 = 0 THEN cast(null as string) ELSE substr({d.sha1}, 1, 12) END",
        "latency_ms": "value",
        "results": d.seq(f"cast({k} % 4 as int)", "i", hit),
    }


def write_columns(d: Dialect) -> dict[str, str]:
    k = d.json_k
    return {
        "event_id": "event_id",
        "created_at": "ts",
        "action": "CASE event_type WHEN 'click' THEN 'create' WHEN 'view' THEN 'supersede' WHEN 'signup' THEN 'complement' ELSE cast(null as string) END",
        "route": "CASE WHEN user_id % 3 = 0 THEN cast(null as string) WHEN user_id % 3 = 1 THEN 'direct' ELSE 'merge' END",
        "sampling_provider": "CASE WHEN user_id % 2 = 0 THEN cast(null as string) ELSE 'stub' END",
        "execution_succeeded": "value >= 25",
        "warning_codes": d.seq(f"cast({k} % 3 as int)", "i", f"concat('w', cast(({k} + i) % 5 as string))"),
    }


def run_columns(d: Dialect) -> dict[str, str]:
    """Runs of the distiller, one for each order."""
    o = "o_orderkey"
    attempt = d.struct(
        {
            "session": f"concat('s', cast(({o} + i) % 50 as string))",
            "outcome": f"CASE ({o} + i) % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'odd' ELSE 'distilled' END",
            "stage": f"CASE ({o} * i) % 3 WHEN 0 THEN 'extract' WHEN 1 THEN 'write' ELSE 'elsewhere' END",
        }
    )
    return {
        "run_id": o,
        "started_at": "o_orderdate",
        "trigger": f"CASE {o} % 4 WHEN 0 THEN cast(null as string) WHEN 1 THEN 'event' ELSE 'clock' END",
        "failures": f"{o} % 3",
        "items_extracted": f"{o} % 11",
        "items_created": f"{o} % 5",
        "items_quarantined": f"{o} % 2",
        "attempts": d.seq(f"cast({o} % 4 as int)", "i", attempt),
    }


#: What a maintenance run counts, besides its duration.
RUN_COUNTERS = (
    "batch_size", "stale_scanned", "superseded_scanned", "disputed_scanned", "missing_link_pairs_scanned", "triage_keep", "triage_condense", "triage_archive", "links_added",
    "conflicts_superseded", "conflicts_both_valid", "archived", "condensed", "warnings", "sampling_failures", "synthesized_hubs", "semantic_merges", "oversized_compacted", "repointed_links",
)


def maintenance_columns(d: Dialect) -> dict[str, str]:
    """Runs of the maintenance, one for each line of an order."""
    k = "(l_orderkey * 8 + l_linenumber)"
    return {"run_id": k, "started_at": "l_shipdate", "duration_ms": f"{k} * 37 % 9001"} | {c: f"{k} * {j + 3} % {j + 7}" for j, c in enumerate(RUN_COUNTERS)}


COUNTERS = {"retrieved": "view", "injected": "click", "used": "purchase"}


#: Folders of the lexical indexes that this application has written, by application and data folder.
_indexes: dict[tuple[str, str], str] = {}
_vectors: dict[tuple[str, str], VectorIndex] = {}


class Tables:
    """DataFrames of the logical tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def nodes(self) -> DataFrame:
        e = self.raw("events").groupBy(F.col("user_id").alias("doc_id")).agg(*[F.count_if(F.col("event_type") == v).alias(k) for k, v in COUNTERS.items()])
        labels = self.raw("labels").select("doc_id", "quality")
        df = self.raw("documents").select("doc_id", "text", "source").join(labels, "doc_id", "left").join(e, "doc_id", "left")
        df = df.selectExpr(*[f"{v} as {k}" for k, v in node_columns(SPARK).items()])
        return df.withColumn("title", F.substring_index("content", "\n", 1)).withColumn("distilled_hash", F.when(F.col("seq") % 3 == 0, F.sha2("content", 256)).when(F.col("seq") % 3 == 1, F.lit("stale")))

    def texts(self) -> DataFrame:
        """The nodes without what other tables say about them (verified and counters): no join, so no text travels."""
        joined = {"verified", "retrieved_count", "injected_count", "used_count", "access_count"}
        df = self.raw("documents").selectExpr(*[f"{v} as {k}" for k, v in node_columns(SPARK).items() if k not in joined])
        return df.withColumn("title", F.substring_index("content", "\n", 1))

    def n(self) -> str:
        """Number of documents, as SQL."""
        return str(max(1, self.raw("documents").count()))

    def edges(self) -> DataFrame:
        n, docs = self.n(), self.raw("documents").select("doc_id")
        a = docs.where("doc_id % 3 <> 0").selectExpr(f"{nid('doc_id')} source_id", f"{nid(f'(doc_id * 13 + 7) % {n}')} target_id")
        b = docs.where("doc_id % 2 = 0").selectExpr(f"{nid('doc_id')} source_id", f"{nid(f'(doc_id * 5 + 1) % {n}')} target_id")
        return a.union(b).where("source_id <> target_id").distinct()

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").selectExpr(f"{nid('vec_id')} node_id", "cast(embedding as array<double>) embedding")

    def lexical_index(self, anew: bool = False) -> LexicalIndex:
        """The stored index of the notes; written once for an application, or `anew`."""
        key = (self.spark.sparkContext.applicationId, self.dir)
        if anew or key not in _indexes:
            path = scratch_folder(self.spark, "lexical")
            LexicalIndex.build(self.texts(), path)
            _indexes[key] = path
        return LexicalIndex.open(self.spark, _indexes[key])

    def vector_index(self) -> VectorIndex:
        """The vectors stored by cell; written once for an application."""
        key = (self.spark.sparkContext.applicationId, self.dir)
        if key not in _vectors:
            _vectors[key] = VectorIndex.build(self.vectors(), scratch_folder(self.spark, "vectors"))
        return _vectors[key]

    def searches(self) -> DataFrame:
        return self.raw("events").selectExpr(*[f"{v} as {k}" for k, v in search_columns(SPARK, self.n()).items()])

    def writes(self) -> DataFrame:
        return self.raw("events").selectExpr(*[f"{v} as {k}" for k, v in write_columns(SPARK).items()])

    def runs(self) -> DataFrame:
        return self.raw("orders").selectExpr(*[f"{v} as {k}" for k, v in run_columns(SPARK).items()])

    def maintenance(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(*[f"{v} as {k}" for k, v in maintenance_columns(SPARK).items()])

    def turns(self) -> DataFrame:
        return self.raw("conversations").select("conv_id", F.col("turn").alias("number"), "role", F.col("text").alias("body"))


def _select(columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in columns.items())


#: Start of every oracle: the logical tables as common table expressions for DuckDB.
CTES = f"""WITH RECURSIVE node_counters AS (SELECT user_id AS doc_id, {", ".join(f"count(*) FILTER (event_type = '{v}') AS {k}" for k, v in COUNTERS.items())} FROM events GROUP BY user_id),
nodes AS (SELECT *, split_part(content, chr(10), 1) AS title, CASE seq % 3 WHEN 0 THEN sha256(content) WHEN 1 THEN 'stale' END AS distilled_hash
  FROM ({_select(node_columns(DUCK))} FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id) LEFT JOIN node_counters USING (doc_id))),
n_docs AS (SELECT greatest(1, count(*)) AS n FROM documents),
edges AS (SELECT DISTINCT * FROM (SELECT {nid("doc_id")} AS source_id, {nid("(doc_id * 13 + 7) % n")} AS target_id FROM documents, n_docs WHERE doc_id % 3 <> 0
  UNION ALL SELECT {nid("doc_id")}, {nid("(doc_id * 5 + 1) % n")} FROM documents, n_docs WHERE doc_id % 2 = 0) WHERE source_id <> target_id),
vectors AS (SELECT {nid("vec_id")} AS node_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings),
searches AS ({_select(search_columns(DUCK, "n"))} FROM events, n_docs),
hits AS (SELECT event_id, ts, source, session_hash, r.rank AS rank, r.node_id AS node_id, r.inject AS inject FROM searches, LATERAL (SELECT unnest(results) AS r)),
writes AS ({_select(write_columns(DUCK))} FROM events),
runs AS ({_select(run_columns(DUCK))} FROM orders),
maintenance AS ({_select(maintenance_columns(DUCK))} FROM lineitem),
turns AS (SELECT conv_id, turn AS number, role, text AS body FROM conversations)
"""


def sql(select: str, *ctes: str) -> str:
    """An oracle: further common table expressions, then a SELECT."""
    return CTES + "".join(f", {c}\n" for c in ctes) + select
