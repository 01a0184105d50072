"""Texts that begin others: one sorted pass with a stack of open prefixes, no pairs.

Sorted by group and text, all texts that begin with x follow x in one run. A pass over a sorted range
keeps a stack of the texts that begin the one in hand; as each is a prefix of it, their lengths and
what was best in their runs are all there is to keep. When a text does not go on with what is on the
stack, those entries are done, and hand their best on to the one below.

Runs may go on in the ranges that follow. Each range therefore reports how far its texts agree with
its first one, in steps, and what is still open at its end; a few numbers for each range tell which
ranges an open text runs through as a whole and in which it ends, and there the steps decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memgrid.operators.cuts import checkpointed

#: kind: done (a text with the best of its run), open (the same so far, at the end of range p), step (the best of the texts
#: of range p that agree with its first one in n bytes at least), first and last (a range's ends; n: bytes in which all its texts agree).
SWEPT = "kind string, p int, n long, key binary, stamp long, best string, grp string, body binary"
_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.binary()]
_NAMES = [c.split()[0] for c in SWEPT.split(", ")]
#: Before any stamp.
NEVER = (-(1 << 63), "")


def common(a: bytes, b: bytes) -> int:
    """Bytes in which a and b agree from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], and not up to high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _Pass:
    """The pass over one range."""

    def __init__(self, p: int):
        self.p, self.out, self.last, self.first = p, [], None, None
        self.open: list[list] = []  # length, key, best of its run so far
        self.agree, self.step = -1, NEVER  # bytes in which all texts so far agree with the first, best since they do

    def row(self, group: str, body: bytes, key: bytes, own: tuple[int, str]) -> None:
        if self.last == (group, body):  # a copy
            self.open[-1][3] = max(self.open[-1][3], own)
            self.step = max(self.step, own)
            return
        if self.last is None:
            self.first, self.agree, self.step = (group, body), len(body), own
        else:
            same = common(self.last[1], body) if group == self.last[0] else -1
            self.close(same)
            agree = min(self.agree, same)
            if agree < self.agree:
                self.out.append(("step", self.p, self.agree, None, *self.step, None, None))
                self.agree, self.step = agree, NEVER
            self.step = max(self.step, own)
        self.open.append([len(body), key, NEVER, own])
        self.last = (group, body)

    def close(self, same: int) -> None:
        """Takes from the stack what does not begin a text that agrees in `same` bytes."""
        while self.open and self.open[-1][0] > same:
            _, key, best, mine = self.open.pop()
            if best > NEVER:
                self.out.append(("done", self.p, None, key, *best, None, None))
            if self.open:
                self.open[-1][2] = max(self.open[-1][2], best, mine)

    def end(self) -> None:
        if self.last is None:
            return
        self.out.append(("step", self.p, self.agree, None, *self.step, None, None))
        below = NEVER
        for length, key, best, mine in reversed(self.open):  # each also has what is above it on the stack
            best = max(best, below)
            self.out.append(("open", self.p, length, key, *best, None, None))
            below = max(best, mine)
        self.out.append(("first", self.p, self.agree, None, 0, None, *self.first))
        self.out.append(("last", self.p, self.agree, None, 0, None, *self.last))


def swept(keys: DataFrame) -> DataFrame:
    """The pass over keys (grp, body, key, stamp, best), ranges of which are tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _Pass(TaskContext.get().partitionId())

        def given() -> pa.RecordBatch:
            rows, one.out = one.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

        for batch in batches:
            for group, body, key, stamp, best in zip(*(batch.column(c).to_pylist() for c in ("grp", "body", "key", "stamp", "best")), strict=True):
                one.row(group, body, key, (stamp, best))
                if len(one.out) >= 4096:
                    yield given()
        one.end()
        if one.out:
            yield given()

    return keys.repartitionByRange("grp", "body").sortWithinPartitions("grp", "body").mapInArrow(run, SWEPT)


def _ranges(rows: DataFrame) -> list[tuple[int, int, int, tuple[int, str]]]:
    """Of each range its number, bytes in which all its texts agree, bytes in which its last one agrees with the next range's first, its best: a row for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [batch.column(n).to_pylist() for n in ("p", "grp", "body", "next_grp", "next_body")]
            far = [-1 if ng is None or g != ng else common(b, nb) for _, g, b, ng, nb in zip(*c, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(far, pa.int64())], ["p", "far"])

    first, last = (rows.where(F.col("kind") == k) for k in ("first", "last"))
    order = first.select("p", F.lead("p").over(W.orderBy("p")).alias("next"))  # one row for each range
    following = order.where("next IS NOT NULL").join(first.selectExpr("p next", "grp next_grp", "body next_body"), "next").select("p", "next_grp", "next_body")
    far = last.select("p", "grp", "body").join(following, "p", "left").mapInArrow(run, "p int, far long")
    best = rows.where("kind = 'step'").groupBy("p").agg(F.max(F.struct("stamp", "best")).alias("b"))
    out = first.select("p", "n").join(far, "p").join(best, "p").orderBy("p").collect()
    return [(r["p"], r["n"], r["far"], (r["b"]["stamp"], r["b"]["best"])) for r in out]


def newest_longer(texts: DataFrame) -> DataFrame:
    """key, stamp, best: of each text (grp, body, key, stamp, best) that begins others of its group, the greatest (stamp, best) among those.

    Linear in the texts but for sorting, whatever their number in a group and however they nest. All
    copies of a text (one key) are in one range, so many of them should come as one row with their greatest (stamp, best).
    """
    rows = checkpointed(texts.sparkSession)(swept(texts.select("grp", F.col("body").cast("binary").alias("body"), "key", "stamp", "best")))
    ranges = _ranges(rows)
    number = {p: i for i, (p, *_) in enumerate(ranges)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}

        def after(p: int) -> tuple:
            """Of the ranges after p: bytes that texts up to each range's start, and up to its end, agree in with p's last; the best up to its end."""
            if p not in known:
                i, start, end, best = number[p], [], [], []
                agree, top = ranges[i][2], NEVER
                for _, n, far, own in ranges[i + 1 :]:
                    if agree < 0:
                        break
                    start.append(agree)
                    end.append(min(agree, n))
                    top = max(top, own)
                    best.append(top)
                    agree = min(agree, n, far)
                known[p] = np.array(start), np.array(end), best
            return known[p]

        for batch in batches:
            out = []
            for p, n, key, stamp, best in zip(*(batch.column(c).to_pylist() for c in ("p", "n", "key", "stamp", "best")), strict=True):
                start, end, tops = after(p)
                whole = int(np.searchsorted(-end, -n, "right"))  # ranges that agree in n bytes to their end
                top = max((stamp, best), tops[whole - 1] if whole else NEVER)
                part = whole < len(start) and start[whole] >= n
                out.append((key, *top, ranges[number[p] + 1 + whole][0] if part else None, n))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["key", "stamp", "best", "p", "n"])

    left = rows.where("kind = 'open'").select("p", "n", "key", "stamp", "best").mapInArrow(run, "key binary, stamp long, best string, p int, n long")
    left = checkpointed(texts.sparkSession)(left)
    # in the range where a run ends: the best of the steps that agree in as many bytes
    both = left.where("p IS NOT NULL").select("p", "n", "key", F.lit(None).cast("struct<stamp:bigint,best:string>").alias("b")).unionByName(rows.where("kind = 'step'").select("p", "n", F.lit(None).cast("binary").alias("key"), F.struct("stamp", "best").alias("b")))
    upto = F.max("b").over(W.partitionBy("p").orderBy(F.desc("n")).rangeBetween(W.unboundedPreceding, 0))
    ended = both.withColumn("b", upto).where("key IS NOT NULL").select("key", "b.stamp", "b.best")
    done = rows.where("kind = 'done'").select("key", "stamp", "best").unionByName(left.select("key", "stamp", "best")).unionByName(ended)
    top = done.groupBy("key").agg(F.max(F.struct("stamp", "best")).alias("b"))
    return top.select("key", "b.stamp", "b.best").where(F.col("best") != "")
