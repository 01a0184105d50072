"""Operator 3: near-duplicate documents by ProbMinHash, banding and verification.

Weights are how often a text has a shingle of five lower-cased words. For each shingle a Poisson
process of that rate, seeded by the shingle, sends arrivals to random registers; each register
keeps its first. A shingle stops once its next arrival is later than the latest register of the
text, so most stop at their first. Two texts agree in a register with the probability of their
probability Jaccard similarity J_P. Bands of registers make buckets. A text that repeats a shingle
gets a second signature with all weights 1, with which J_P is the Jaccard similarity of the sets;
so a link by either measure is found.

Pairs inside a bucket are never listed. In three rounds, a text is held against:
1. of the leaders of its buckets the one that it shares most buckets with; a bucket's leader is the
   text whose buckets are the largest together, so the one most in the middle of a group;
2. its other leaders, if they aren't in its class yet;
3. the texts of other classes in its buckets, where longer signatures agree in EST of FULL registers
   at least (the exact way for what the leaders left; inside one class no link can change
   anything). A pair is looked at in the first bucket that it shares only.
Each pair is verified on the whole texts: J_P, or the Jaccard similarity of the sets, is at least
THRESHOLD. Verified links make classes (connected components).

Loss: a pair at the threshold shares no bucket with probability (1 - 0.8^5)^24 = 7e-5, and falls
short of EST with 7e-5 (in the third round only). Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memgrid.llm.common import arrow_map, fresh, written

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, REGISTERS = 24, 5, 240
#: Registers of the signatures that pairs are compared by before verification, and the share that must agree.
FULL, EST = 360, 0.72
#: Pairs with one text up to which they may be verified in one task.
PAIRS = 2000
#: Keys up to which a side is broadcast (16 MB); beyond it Spark shuffles.
BROADCAST_ROWS = 2_000_000
CACHE = 100_000
#: Edges or labels to a file. Few files are kinder to the shared folder, and to executors: creating one forks a process on some file systems.
FILE_ROWS = 500_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode())
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def weighted_shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles and how often each occurs; a text of fewer words is one shingle."""
    w = text.lower().split()
    h = np.fromiter(map(_words().__getitem__, w), np.uint64, len(w))
    n = max(1, len(w) - words + 1) if w else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(w))):
        out = mix(out + h[k : k + n] + _GOLD)
    return np.unique(out, return_counts=True)


def signatures(shingles: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """For each text the shingle that arrives first in each of m registers, [texts, m]; texts need a shingle each."""
    n = len(shingles)
    element = np.concatenate([s[0] for s in shingles]) if n else np.zeros(0, np.uint64)
    weight = np.concatenate([s[1] for s in shingles]).astype(np.float64) if n else np.zeros(0)
    doc = np.repeat(np.arange(n), [len(s[0]) for s in shingles])
    first, winner = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    at, step = np.zeros(len(element)), 0
    while len(element):
        block = int(min(64, max(1, 16_384 // len(element))))
        draws = mix(element[:, None] + _GOLD * np.arange(step * 2 + 1, step * 2 + 1 + 2 * block, dtype=np.uint64))
        gap = -np.log(((draws[:, 0::2] >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weight[:, None]
        gap[:, 0] += at
        time = np.cumsum(gap, axis=1)
        slot = doc[:, None] * m + ((draws[:, 1::2] >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        flat_slot, flat_time = slot.ravel(), time.ravel()
        early = flat_time < first[flat_slot]
        np.minimum.at(first, flat_slot[early], flat_time[early])
        won = early & (first[flat_slot] == flat_time)
        winner[flat_slot[won]] = np.repeat(element, block)[won]
        last = first.reshape(n, m).max(1)
        go = time[:, -1] < last[doc]
        element, weight, doc, at, step = element[go], weight[go], doc[go], time[go, -1], step + block
    return winner.reshape(n, m)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """[texts, bands] hashes of each band's registers."""
    part = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), part.shape[:2]) * _GOLD
    for k in range(rows):
        key = mix(key + part[:, :, k] + _GOLD)
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(J_P, Jaccard of the sets) of weighted shingles."""
    (ha, va), (hb, vb) = a, b
    if not len(ha) or not len(hb):
        return 0.0, 0.0
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    union = len(ha) + len(hb) - len(both)
    jaccard = len(both) / union
    v, w = va[ia].astype(np.float64), vb[ib].astype(np.float64)
    only_a, only_b = va.sum() - v.sum(), vb.sum() - w.sum()
    total = 0.0
    ratios, each = np.unique(v / w, return_inverse=True)
    for k, r in enumerate(ratios):  # sum over all d' of max(v', r w') is the same for all with one ratio
        total += v[each == k].sum() / (only_a + r * only_b + np.maximum(v, r * w).sum())
    return total, jaccard


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("node"))


def both_signatures(shingles: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Signatures with all weights 1, and by place those with true weights of texts that repeat a shingle.

    With weights of 1 the probability Jaccard is the Jaccard of the sets.
    """
    plain = signatures([(h, np.ones(len(h), np.int64)) for h, _ in shingles], m)
    repeats = [i for i, (_, n) in enumerate(shingles) if n.max() > 1]
    return plain, dict(zip(repeats, signatures([shingles[i] for i in repeats], m), strict=True))


def _banded(docs: DataFrame) -> DataFrame:
    """doc_id, node, keys for each row; keys is null for a text without a word."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = [weighted_shingles(x or "") for x in batch.column("text").to_pylist()]
            places = [i for i, x in enumerate(s) if len(x[0])]
            keys: list[list[int] | None] = [None] * len(s)
            if places:
                plain, weighted = both_signatures([s[i] for i in places])
                for i, k in zip(places, band_keys(plain).tolist(), strict=True):
                    keys[i] = k
                if weighted:
                    for k, more in zip(weighted, band_keys(np.stack(list(weighted.values()))).tolist(), strict=True):
                        keys[places[k]] = list({*keys[places[k]], *more})
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "keys"])

        return f

    df = docs.withColumn("node", F.when(F.col("text").isNotNull(), F.col("node")))
    return arrow_map(df, make, "doc_id long, node long, keys array<long>")


def _coded(signature: np.ndarray) -> np.ndarray:
    """A number for each register: its place and 23 bits of its shingle."""
    code = (signature & np.uint64(0x7FFFFF)).astype(np.int64) | (np.arange(FULL, dtype=np.int64) << 23)
    return code.astype(np.uint32).view(np.int32)


def _signed(texts: DataFrame) -> DataFrame:
    """node, text, sig with weights of 1, wsig with true weights (null if no shingle repeats)."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            plain, weighted = both_signatures([weighted_shingles(x) for x in batch.column("text").to_pylist()], FULL)
            more = [_coded(weighted[i]).tolist() if i in weighted else None for i in range(len(plain))]
            return pa.RecordBatch.from_arrays([batch.column("node"), batch.column("text"), pa.array(_coded(plain).tolist(), pa.list_(pa.int32())), pa.array(more, pa.list_(pa.int32()))], ["node", "text", "sig", "wsig"])

        return f

    return arrow_map(texts, make, "node long, text string, sig array<int>, wsig array<int>")


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) of nodes that are alike."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def of(node: int, text: str):
                if node not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[node] = weighted_shingles(text)
                return known[node]

            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
            keep = [max(similarity(of(p, r), of(q, s))) >= threshold for p, q, r, s in zip(a, b, x, y, strict=True)]
            mask = pa.array(keep, pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

        return f

    pairs = written(pairs, "pairs")  # two numbers each; they may be dear to find
    # a text that is in many pairs, as a leader of a large group, is dealt to several tasks
    many = _small(pairs.groupBy("b").agg((F.floor(F.count("*") / PAIRS) + 1).cast("int").alias("parts")).where("parts > 1"))
    t = texts.select("node", "text")
    left = pairs.join(t.selectExpr("node a", "text x"), "a").join(many, "b", "left").withColumn("part", F.pmod(F.hash("a"), F.coalesce("parts", F.lit(1))))
    right = t.selectExpr("node b", "text y").join(many, "b", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    full = left.join(right, ["b", "part"])
    return arrow_map(full.select("a", "b", "x", "y"), make, "a long, b long")


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """node, lab: the least node of its connected component, for each node of an edge (a, b).

    Each round takes the least label of the neighbours, then the label's own label, so chains
    halve. A round's labels are written, in as few files as their number calls for (files, or one
    for each FILE_ROWS edges): a plan that held all rounds would grow with each.
    """
    files = files or edges.count() // FILE_ROWS + 1
    both = written(edges.union(edges.select("b", "a")).where("a != b").distinct().toDF("node", "other").coalesce(files), "edges")
    labels = written(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("lab")).coalesce(files), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "lab"), "other").groupBy("node").agg(F.min("lab").alias("m"))
        one = labels.join(near, "node").select("node", F.col("lab").alias("old"), F.least("lab", "m").alias("up"))
        own = labels.select(F.col("node").alias("up"), F.col("lab").alias("lab2"))
        new = written(one.join(own, "up", "left").select("node", "old", F.least("up", "lab2").alias("lab")).coalesce(files), "labels")
        labels = new.select("node", "lab")
        if new.where("old != lab").isEmpty():
            return labels


def _relabelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members with `lab`, the class so far of each node."""
    if labels is None:
        return members.withColumn("lab", F.col("node"))
    return members.join(labels, "node", "left").withColumn("lab", F.coalesce("lab", "node"))


def _merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """labels after more edges between nodes; contracts the classes so far."""
    if labels is None:
        return components(edges)
    ends = edges.join(labels.selectExpr("node a", "lab la"), "a", "left").join(labels.selectExpr("node b", "lab lb"), "b", "left")
    top = components(ends.selectExpr("coalesce(la, a) a", "coalesce(lb, b) b").where("a != b"), edges.count() // FILE_ROWS + 1)
    all_ = labels.join(top.selectExpr("node lab", "lab up"), "lab", "left").selectExpr("node", "coalesce(up, lab) lab")
    new = top.join(labels, "node", "left_anti")
    return written(all_.union(new.select("node", "lab")).coalesce(labels.count() // FILE_ROWS + 1), "labels")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node, comp for each row of docs; rows with the same comp are copies or near copies.

    node is the xxhash64 of the text. Copies share a node. A text without a word is alike its exact
    copies only; a null text (node and comp null) is alike none.
    """
    hashed = _hashed(docs)
    rows = written(_banded(hashed), "bands")
    buckets = rows.select("node", F.explode("keys").alias("key"))
    several = buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("key")
    members = buckets.join(several, "key").distinct().persist()
    # a text near the middle of a group is in its large buckets; the leader of a bucket is the one most in the middle
    size = members.groupBy("key").agg(F.count("*").alias("n"))
    weight = members.join(size, "key").groupBy("node").agg(F.sum("n").alias("w"))
    leaders = written(members.join(weight, "node").groupBy("key").agg(F.max(F.struct("w", "node")).alias("m")).select("key", F.col("m.node").alias("leader")), "leaders")
    nodes = weight.select("node")
    few = nodes.count() <= BROADCAST_ROWS
    texts = hashed.select("node", "text").join(F.broadcast(nodes) if few else nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = written(_signed(texts), "texts")

    # 1: the leader that a text shares most buckets with
    led = members.join(leaders, "key").where("node != leader").groupBy("node", "leader").count().persist()
    most = led.groupBy("node").agg(F.max(F.struct("count", "leader")).alias("m"))
    labels = _merged(None, written(_verified(most.selectExpr("node a", "m.leader b"), texts, threshold), "links"))

    # 2: its other leaders that are in another class
    two = _relabelled(led.select("node", "leader"), labels).withColumnRenamed("lab", "la").join(labels.selectExpr("node leader", "lab lb"), "leader", "left")
    pairs = two.where("la != coalesce(lb, leader)").selectExpr("node a", "leader b")
    labels = _merged(labels, written(_verified(pairs, texts, threshold), "links"))
    led.unpersist()

    # 3: texts of different classes in a bucket, if their signatures agree enough; in the first bucket that they share
    placed = _relabelled(members, labels).persist()
    open_ = placed.groupBy("key").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi")).where("lo != hi").select("key")
    pairs = _alike(placed.join(open_, "key", "left_semi").select("key", "node", "lab"), texts.select("node", "sig", "wsig"))
    labels = _merged(labels, written(_verified(pairs, texts, threshold), "links"))
    placed.unpersist()
    members.unpersist()
    return rows.select("doc_id", "node").join(labels, "node", "left").select("doc_id", "node", F.coalesce("lab", "node").alias("comp"))


def _alike(placed: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs of nodes of different classes (lab) that share a key and whose signatures agree enough; each in its first key only."""
    all_keys = placed.groupBy("node").agg(F.collect_set("key").alias("keys"))
    full = placed.join(all_keys, "node").join(signed, "node")
    left, right = (full.selectExpr("key", *[f"{c} {c}_{x}" for c in ("node", "lab", "keys", "sig", "wsig")]) for x in "ab")
    enough = f">= {round(EST * FULL)}"
    weighted = f"(wsig_a IS NOT NULL OR wsig_b IS NOT NULL) AND size(array_intersect(coalesce(wsig_a, sig_a), coalesce(wsig_b, sig_b))) {enough}"
    alike = F.expr(f"lab_a < lab_b AND key = array_min(array_intersect(keys_a, keys_b)) AND (size(array_intersect(sig_a, sig_b)) {enough} OR {weighted})")
    return left.join(right, "key").where(alike).selectExpr("node_a a", "node_b b")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_size, is_kept, node; a row for each row of docs.

    docs: doc_id, text (other columns are not read). class_id is the least doc_id of the class (null
    if its rows have none), class_size its rows. is_kept marks the least doc_id's row, among its
    rows the one with the lowest text hash; rows that repeat both are all marked. A null text is a
    class of its own: class_id is its doc_id, and it is kept.
    """
    rows = classes(docs, threshold)
    # the least (doc_id, node), null ids last; sums up on the way, so one large class is no burden
    rep = rows.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "node")).alias("r"), F.count("*").alias("size"))
    # classes of one row need none; written, so that Spark can split a class that holds many rows
    rep = written(rep.where("size > 1").coalesce(rows.count() // FILE_ROWS + 1), "classes")
    out = rows.join(rep, "comp", "left")
    kept = F.col("size").isNull() | (F.col("doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("node") == F.col("r.node")))
    return out.select("doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("r.doc_id")).alias("class_id"), F.coalesce("size", F.lit(1).cast("long")).alias("class_size"), kept.alias("is_kept"), "node")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, of which each class keeps one.

    It is the row with the least doc_id (among its rows the one with the lowest text hash), and one
    of those that repeat both. Null texts all stay. docs is read again to fetch its rows; what goes
    is looked up by doc_id and text hash, so texts are moved only if that list is too long to send
    to every task.
    """
    n_, doc, node = fresh(docs, "n", "doc", "node")
    found = written(near_duplicates(docs, threshold).where("node is not null").groupBy("doc_id", "node").agg(F.count("*").alias("n"), F.first("is_kept").alias("kept")).where("not kept or n > 1"), "found")
    list_ = _small(found.select(F.col("doc_id").alias(doc), F.col("node").alias(node), F.when(F.col("kept"), F.col("n")).otherwise(0).alias(n_)))
    text = docs["text"]
    same = list_[doc].eqNullSafe(docs["doc_id"].cast("long")) & (list_[node] == F.when(text.isNotNull(), F.xxhash64(text)))
    rows = docs.join(list_, same, "left").where(f"`{n_}` is null or `{n_}` > 0")
    single = rows.where(f"`{n_}` is null").select(*[docs[c] for c in docs.columns])
    if found.where("kept").isEmpty():
        return single
    # rows that repeat: of each doc_id and text one
    first = rows.where(f"`{n_}` > 0").groupBy(doc, node).agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("row"))
    return single.union(first.select("row.*"))
