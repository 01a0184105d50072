"""Operator 13 [native]: mixing sources to target weights by weighted fair queueing.

Sources get targets: shares of all words by weight, held to three times the source's words. Each
source's documents are shuffled (by a digest of doc_id) and queued up to three times over; a copy's
virtual finish time is the words of its source up to its end, divided by the source's target. The
copies of all sources in the order of finish times are the mix, which is truncated at the total
budget: a source has taken its target when the time is 1.

Running sums are worked out in two levels, so that no task gets a source: within ranges of the
shuffled order, of which there are as many as the square root of the documents, and over the sums
of those ranges. The global order likewise: copies fall into narrow ranges of finish time, and only
the range in which the budget ends is sorted, as only there the order decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memgrid.llm.common import WORD, written

WEIGHTS, TIMES = (5, 2, 1), 3
#: The digest's range, and rows of one key that are spread again before they are told apart.
SPACE, TOGETHER = 1 << 60, 4096
#: Sources up to which their table is broadcast (a row is a key of 64 characters and a few numbers).
BROADCAST_SOURCES = 200_000


def n_words(text: Column) -> Column:
    """Words of a text, null counting as empty, without an array of them: each becomes one letter, the rest goes."""
    return F.char_length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w"), " \t\n\x0b\f\r", "")).cast("long")


def place(doc_id: Column) -> Column:
    """The place in the shuffled order: 60 bits of a digest of doc_id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """source, place, doc_id, size, copies: rows that are alike in all of these are one row here."""
    rows = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), n_words(F.col("text")).alias("size"))
    return rows.groupBy("source", place(F.col("doc_id")).alias("place"), "doc_id", "size").agg(F.count("*").alias("copies"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = TIMES) -> DataFrame:
    """source, number (by code point, null last), source_size, target of a table of source, source_size.

    The share of a source is its weight times a level, held to `times` its size, and the level is what
    makes all shares add up to all sizes. In the order of the cap over the weight, a source is held to
    its cap if the level without those before it reaches that. Works on one row for each source, in one task.
    """
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    t = sources.withColumn("number", number).withColumn("weight", weight).withColumn("cap", F.col("source_size") * times)
    order = W.orderBy(F.col("cap") / F.col("weight"), "number").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0))
    t = t.withColumn("left", left).withColumn("rest", rest)
    t = t.withColumn("held", F.col("cap") * F.col("rest") <= F.col("weight") * F.col("left"))
    over = F.coalesce(F.sum(F.when(F.col("held"), F.col("cap"))).over(every), F.lit(0))
    open_ = F.sum(F.when(~F.col("held"), F.col("weight"))).over(every)
    target = F.when(F.col("held"), F.col("cap").cast("double")).otherwise((F.sum("source_size").over(every) - over).cast("double") * F.col("weight") / open_)
    return t.select("source", "number", "source_size", target.alias("target"))


def each_copy(groups: DataFrame) -> DataFrame:
    """A row for each of `copies` rows, with `nth` from 1; a large group is spread over tasks first."""
    one = groups.where(F.col("copies") <= TOGETHER).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    parts = groups.where(F.col("copies") > TOGETHER).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / TOGETHER))))
    parts = parts.repartition("number", "place", "doc_id", "size", "nth")
    first = F.col("nth") * TOGETHER + 1
    many = parts.withColumn("nth", F.explode(F.sequence(first, F.least("copies", first + (TOGETHER - 1)))))
    return one.unionByName(many)


def queued(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = TIMES) -> tuple[DataFrame, int, int]:
    """Documents (doc_id, source, number, size, source_size, target, done, copies) with the words of their source before them, the number of rows, and all words."""
    rows = written(sized(docs), "sized")
    sources = written(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, times), "targets")
    n, n_sources, budget = rows.count(), sources.count(), sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    known = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    rows = rows.withColumnRenamed("source", "of").join(known, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    width = SPACE // max(1, int(n**0.5)) + 1
    rows = rows.withColumn("range", F.expr(f"place div {width}"))
    words = F.col("size") * F.col("copies")
    sums = rows.groupBy("number", "range").agg(F.sum(words).alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("number").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("number", "range", before.alias("before"))
    inside = F.coalesce(F.sum(words).over(W.partitionBy("number", "range").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    done = rows.withColumn("inside", inside).join(sums, ["number", "range"])
    return done.withColumn("done", F.col("before") + F.col("inside")).drop("before", "inside", "range"), n, budget


def finish(done: Column, nth: Column, time: Column) -> Column:
    """Virtual finish time of a copy's `time`-th turn (from 0)."""
    return (done + nth * F.col("size") + time * F.col("source_size")).cast("double") / F.col("target")


def schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = TIMES) -> DataFrame:
    """The queue of documents, and at which finish time the mix ends: a row for each document and the finish times of its turns.

    Returns doc_id, source, size, source_size, target, finish (array of double, `times` long, of the
    turns), taken_turns (how many of them the mix takes). Ordered by an exploded finish, then source,
    the taken turns are the mix. docs: doc_id, text, source (other columns are not read). A null text
    and one without words has size 0: its turns finish with the one before and take nothing. A null
    source is one of its own, the last. Rows with one doc_id and size are told apart by number only;
    a null doc_id counts as one value. Without documents, or words, nothing is taken.
    """
    groups, n, budget = queued(docs, weights, times)
    groups = written(groups, "queue")
    rows = each_copy(groups)
    turns = F.array(*[finish(F.col("done"), F.col("nth"), F.lit(i)) for i in range(times)])
    rows = rows.withColumn("finish", F.when(F.col("size") > 0, turns))
    # narrow ranges of time: even ones up to 1, where the mix is about to end, then by the logarithm
    cells = max(1, int(n**0.5))
    cell = F.when(F.col("t") < 1, F.floor(F.col("t") * cells)).otherwise(F.floor((F.ln("t") + 1) * cells))
    copies = rows.where("size > 0").select("number", "size", F.explode("finish").alias("t")).withColumn("cell", cell)
    sums = copies.groupBy("cell").agg(F.sum("size").alias("words"))
    upto = sums.withColumn("upto", F.sum("words").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)))
    last = upto.where(F.col("upto") > budget).orderBy("cell").first()
    if last is None:
        taken = F.lit(0)
    else:
        order = W.orderBy("t", "number").rowsBetween(W.unboundedPreceding, 0)
        start = last["upto"] - last["words"]
        end = copies.where(F.col("cell") == last["cell"]).withColumn("upto", F.sum("size").over(order) + start).where(F.col("upto") <= budget)
        end = end.orderBy(F.desc("t"), F.desc("number")).first()
        # all of the cells before this one are taken, and of this one those up to `end`
        early = lambda t: F.when(t < 1, F.floor(t * cells)).otherwise(F.floor((F.ln(t) + 1) * cells)) < last["cell"]
        if end is None:
            fits = early
        else:
            fits = lambda t: (t < end["t"]) | ((t == end["t"]) & (F.col("number") <= end["number"]))
        taken = F.coalesce(F.size(F.filter("finish", fits)), F.lit(0))
        taken = F.when(F.col("finish").isNull(), 0).otherwise(taken)
    return rows.select("doc_id", "source", "size", "source_size", "target", "finish", taken.alias("taken_turns"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = TIMES) -> DataFrame:
    """The mix itself: doc_id, source, size, turn (from 1), finish, a row for each taken turn, in the order of finish times (a global range sort)."""
    s = schedule(docs, weights, times).where("taken_turns > 0")
    turns = s.select("doc_id", "source", "size", F.posexplode(F.slice("finish", F.lit(1), F.col("taken_turns"))).alias("turn", "finish"))
    return turns.withColumn("turn", F.col("turn") + 1).orderBy("finish", F.col("source").asc_nulls_last(), "doc_id", "turn")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM d GROUP BY source),
w AS (SELECT *, CASE (number - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, (SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER o, 0) AS rest_size, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0) AS rest_weight FROM w WINDOW o AS (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, cap * rest_weight <= weight * rest_size AS held FROM l),
t AS (SELECT source, number, source_size, CASE WHEN held THEN CAST(cap AS DOUBLE) ELSE CAST((SELECT sum(source_size) FROM h) - (SELECT coalesce(sum(cap), 0) FROM h WHERE held) AS DOUBLE) * weight / (SELECT sum(weight) FROM h WHERE NOT held) END AS target FROM h),
q AS (SELECT doc_id, number, size, source_size, target, row_number() OVER (ORDER BY number, place, doc_id, size) AS uid, sum(size) OVER (PARTITION BY number ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS done FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT uid, number, size, CAST(done + turn * source_size AS DOUBLE) / target AS finish FROM q, range(3) AS r(turn) WHERE size > 0),
u AS (SELECT uid, size, sum(size) OVER (ORDER BY finish, number ROWS UNBOUNDED PRECEDING) AS upto FROM c),
k AS (SELECT uid, sum(size) AS taken FROM u WHERE upto <= (SELECT sum(source_size) FROM s) GROUP BY uid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (uid)
"""
