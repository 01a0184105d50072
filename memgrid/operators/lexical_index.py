"""A stored lexical index: postings in blocks, kept up with changes, and the best notes of each query without the rest.

Notes fall into slots by a hash of their id, and a slot into cells by the notes' length. A block is
what a cell has of one token: how many notes, the highest number of occurrences, the least length,
and the notes by their numbers within the cell with the token's positions. A cell's notes, in the order
of their numbers, are a row of their own: ids, lengths, and which of them live. Notes are dealt out by
slot before they are cut into tokens, so no token travels. Blocks are sorted by token within the files
of an index, so a scan leaves out row groups beyond the range of asked tokens; it never reads a note's text.

The best notes of queries are found by block maxima: what a note of a cell can score at most is the
sum over a query's terms of what the block's maxima allow. The cells with the highest bounds are
scored first; the score of the last note that would still be returned is a threshold, and cells whose
bound is below it for all queries are never read. No note is lost by that. Blocks of a cell meet in
one task, which hands on its best notes of each query and nothing else.

A version of the index is complete once its manifest is written, which names the version that holds
the cells of each part. A change adds cells for what came and rewrites the rows of notes in the parts
that it touches; no block is read or written again, and a run that was cut short leaves the version
before as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memgrid.functions.scoring import reciprocal_rank
from memgrid.functions.text import accents, cjk_bigrams, fts_tokens, has_cjk, or_terms, spaced_tokens
from memgrid.operators.cuts import checkpointed
from memgrid.operators.lexical import B, COLUMN, K1, fields, ranked

#: Notes to a slot, parts at most, classes of length to a slot, and slots from which several are written together.
PER_SLOT, PARTS, CLASSES, BUNDLED = 4096, 1024, 64, 2048
#: Cells of a query that are scored for its threshold; queries of one search, beyond which there are several.
SEEDS, QUERIES = 8, 10_000
#: Tokens that are put into blocks at a time.
TOKENS = 250_000
#: What rounding of scores may hide.
SLACK = 1e-6

BLOCK = "token string, leg int, cell long, n long, max_tf int, min_len0 int, min_len1 int, docs array<int>, tf array<int>, at array<int>, notes array<struct<node_id:string,len0:int,len1:int,live:boolean>>, part int"
POSTINGS = f"{BLOCK}, version int"
CELLS = "cell long, notes array<struct<node_id:string,len0:int,len1:int,live:boolean>>, part int, version int"
#: What no token is: the row of all notes of a cell.
EVERY = ""
#: Bits of a cell's number for its place among those of one slot and length, and for slot and length; above them is the version.
PIECE, PLACE = 20, 28
MANIFEST = "part int, held int, n long, sum0 long, sum1 long, slots int, parts int, version int"
#: Number of the row that has a cell's notes, before those of its phrases.
NOTES = -1
#: leg of a note whose two indexes are the same; else 0 is the plain one and 1 that of bigrams.
SAME = -1


def cut_notes(nodes: DataFrame, slots: int, parts: int) -> DataFrame:
    """part, cell, node_id, plain, bigram: the note's spaced tokens, a text for each field; all notes of a slot are in one task.

    bigram is null where it is the same.
    """
    slot = F.pmod(F.xxhash64("node_id"), F.lit(slots))
    chars = F.length(F.coalesce("content", F.lit("")))
    bundle = F.floor(F.col("slot") / max(1, slots // BUNDLED))
    rows = nodes.select("node_id", "title", "content", "tags", slot.alias("slot"), F.least(F.floor(2 * F.log2(chars + 1)), F.lit(CLASSES - 1)).alias("kind"))
    rows = rows.withColumns({"part": F.pmod(bundle, F.lit(parts)).cast("int"), "cell": F.col("slot") * CLASSES + F.col("kind")}).repartition("part", "slot")
    plain = F.array(*map(spaced_tokens, fields()))
    bigram = F.when(has_cjk(F.concat(*fields())), F.array(*[spaced_tokens(cjk_bigrams(f)) for f in fields()]))
    return rows.select("part", "cell", "node_id", plain.alias("plain"), bigram.alias("bigram"))


def part_of(slots: int, parts: int) -> Column:
    """The part of a note, by its node_id."""
    return F.pmod(F.floor(F.pmod(F.xxhash64("node_id"), F.lit(slots)) / max(1, slots // BUNDLED)), F.lit(parts)).cast("int")


_NOTE = pa.struct([("node_id", pa.string()), ("len0", pa.int32()), ("len1", pa.int32()), ("live", pa.bool_())])
_COLUMNS = [c.split()[0] for c in BLOCK.split(", ")]
_INTS = pa.list_(pa.int32())


def _flags(of: pa.Array) -> np.ndarray:
    return np.asarray(of.to_numpy(zero_copy_only=False), bool)


def _sizes(texts: pa.ListArray) -> np.ndarray:
    """How many spaced tokens each note has; notes without texts are left out."""
    spaced, n = texts.flatten(), len(texts) - texts.null_count
    return (pc.count_substring(spaced, " ").to_numpy() + _flags(pc.not_equal(spaced, ""))).reshape(n, -1).sum(axis=1) if n else np.zeros(0, np.int64)


def folded(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of each token the number of its form without accents, and these forms in their order; only different tokens are looked at."""
    coded = tokens.dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy()
    odd = np.flatnonzero(~_flags(pc.string_is_ascii(words)))
    if len(odd):
        table = str.maketrans(*accents())
        mask = np.zeros(len(words), bool)
        mask[odd] = True
        plain = pa.array([w.translate(table) for w in words.take(pa.array(odd)).to_pylist()], pa.string())
        again = pc.replace_with_mask(words, pa.array(mask), plain).dictionary_encode()
        words, code = again.dictionary, again.indices.to_numpy()[code]
    order = pc.array_sort_indices(words).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[code], words.take(pa.array(order))


def _cut(leg: int, cell: int, part: int, texts: pa.ListArray, notes: np.ndarray, sizes: list[np.ndarray]) -> pa.RecordBatch | None:
    """Blocks of one leg of a cell in the order of tokens: texts are the notes' (numbers in sizes) spaced tokens, one for each field."""
    spaced = texts.flatten()
    none, lists = _flags(pc.equal(spaced, "")), pc.split_pattern(spaced, " ")
    tokens, lengths = lists.flatten(), lists.value_lengths().to_numpy() - none
    tokens = tokens.filter(pc.not_equal(tokens, "")) if none.any() else tokens
    if not len(tokens):
        return None
    each = len(spaced) // len(notes)
    of_field = np.repeat(np.arange(len(spaced)), lengths)
    at = np.arange(len(tokens)) - (np.cumsum(lengths) - lengths)[of_field] + of_field % each * COLUMN
    note = np.repeat(notes, each)[of_field]
    code, words = folded(tokens)
    order = np.argsort(code, kind="stable")  # notes and positions stay in their order within a token
    code, note, at = code[order], note[order], at[order]
    new_doc = np.concatenate([[True], (code[1:] != code[:-1]) | (note[1:] != note[:-1])])
    doc = np.flatnonzero(new_doc)  # where a note's positions start
    doc_end = np.append(doc[1:], len(code))
    new_block = np.concatenate([[True], code[doc[1:]] != code[doc[:-1]]])
    block = np.flatnonzero(new_block)
    block_end = np.append(block[1:], len(doc))
    members, tf = note[doc].astype(np.int32), (doc_end - doc).astype(np.int32)
    len0, len1 = (x[members].astype(np.int32) for x in sizes)
    m, ends = len(block), pa.array(np.append(block, len(doc)), pa.int32())
    columns = [
        words.take(pa.array(code[doc[block]])),
        pa.array(np.full(m, leg, np.int32)),
        pa.array(np.full(m, cell, np.int64)),
        pa.array(block_end - block),
        pa.array(np.maximum.reduceat(tf, block)),
        pa.array(np.minimum.reduceat(len0, block)),
        pa.array(np.minimum.reduceat(len1, block)),
        pa.ListArray.from_arrays(ends, pa.array(members)),
        pa.ListArray.from_arrays(ends, pa.array(tf)),
        pa.ListArray.from_arrays(pa.array(np.append(doc[block], len(code)), pa.int32()), pa.array(at.astype(np.int32))),
        pa.nulls(m, pa.list_(_NOTE)),
        pa.array(np.full(m, part, np.int32)),
    ]
    return pa.RecordBatch.from_arrays(columns, _COLUMNS)


def _all(cell: int, part: int, ids: pa.Array, sizes: list[np.ndarray]) -> pa.RecordBatch:
    """The row of all notes of a cell, those without a token among them."""
    n = len(ids)
    notes = pa.StructArray.from_arrays([ids, *(pa.array(x.astype(np.int32)) for x in sizes), pa.array(np.ones(n, bool))], fields=list(_NOTE))
    columns = [pa.array([EVERY]), pa.array([SAME], pa.int32()), pa.array([cell], pa.int64()), pa.array([n], pa.int64()), pa.array([0], pa.int32())]
    columns += [pa.array([int(x.min())], pa.int32()) for x in sizes] + [pa.array([[]], _INTS)] * 3
    columns += [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), notes, type=pa.list_(_NOTE)), pa.array([part], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, _COLUMNS)


def at_once(sizes: np.ndarray, tokens: int) -> Iterator[slice]:
    """Notes next to each other with so many tokens at most, but one note at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + tokens, "right")))
        yield slice(at, end)
        at = end


def cut_blocks(notes: DataFrame, version: int) -> DataFrame:
    """Blocks of cut notes; a token never leaves the task of its note. The notes themselves are the row EVERY.

    Notes of one slot and length that have many tokens are several cells: no note is in two of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, piece = None, 0
        for batch in batches:
            for place, rows in cells_of(iter([batch])):
                plain, bigram, ids = (rows[0].column(c) for c in ("plain", "bigram", "node_id"))
                same, part = _flags(bigram.is_null()), rows[0].column("part")[0].as_py()
                len0 = _sizes(plain)
                len1 = len0.copy()
                len1[~same] = _sizes(bigram)
                for s in at_once(len1, TOKENS):
                    last, piece = place, piece + 1 if place == last else 0
                    cell = ((version << PLACE) + place << PIECE) + piece
                    sizes = [len0[s], len1[s]]
                    yield _all(cell, part, ids[s], sizes)
                    for leg, texts, own in ((SAME, plain[s], same[s]), (0, plain[s], ~same[s]), (1, bigram[s], ~same[s])):
                        which = np.flatnonzero(own)
                        if len(which) and (out := _cut(leg, cell, part, texts.take(pa.array(which)), which, sizes)) is not None:
                            yield out

    return notes.sortWithinPartitions("part", "cell").mapInArrow(run, BLOCK)


def saturated(tf: np.ndarray, size: np.ndarray, avg: float) -> np.ndarray:
    """BM25's part of a term but for its idf: rises with tf, falls with the note's length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / avg))


@dataclass(frozen=True)
class Asked:
    """The queries of one search, as tasks need them: of each query the numbers of its terms, of each leg the terms' idf."""

    queries: tuple
    phrases: tuple[str, ...]
    terms: np.ndarray  # numbers of phrases, query by query
    starts: np.ndarray  # where each query's terms start
    idf: tuple[np.ndarray, ...]
    avg: tuple[float, ...]
    #: Scores below which nothing is wanted, by leg and query.
    floors: tuple[np.ndarray, ...]

    def bounds(self, most: np.ndarray) -> np.ndarray:
        """Of each query the sum of its terms' values."""
        return np.add.reduceat(most[self.terms], self.starts)


HEADS = "no int, leg int, cell long, n long, max_tf int, min_len0 int, min_len1 int"


def dealt_by_cell(rows: DataFrame) -> DataFrame:
    """Rows with all of a cell in one task, one after the other, in the order of no.

    By a digest of the cell, not the cell: after a join on that in both branches of a union Spark
    would take the rows as dealt already, and then put the branches' partitions together one by one.
    """
    return rows.repartition(F.xxhash64("cell")).sortWithinPartitions("cell", "no")


def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows in the order of cells, a cell at a time."""
    cell, held = None, []
    for batch in batches:
        at = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and at[a] != cell:
                yield cell, held
                held = []
            cell = int(at[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield cell, held


def cell_bounds(asked: Asked, rows: list[pa.RecordBatch], leg: int) -> np.ndarray:
    """What a note of a cell can score at most, by query, from the heads of the cell's blocks."""
    most = np.zeros(len(asked.phrases))
    for r in rows:
        no, of, tf, size = (r.column(c).to_numpy() for c in ("no", "leg", "max_tf", f"min_len{leg}"))
        fits = (of == leg) | (of == SAME)
        no = no[fits]
        # a cell may hold several blocks of a phrase, one for each leg
        np.maximum.at(most, no, asked.idf[leg][no] * saturated(tf[fits].astype(float), size[fits].astype(float), asked.avg[leg]))
    return asked.bounds(most)


def best_cells(asked: Asked, legs: tuple[int, ...], seeds: int) -> Callable:
    """Of each task the cells with the highest bounds of each query: q, leg, cell, most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = {leg: (np.zeros((seeds, len(asked.queries))), np.full((seeds, len(asked.queries)), -1, np.int64)) for leg in legs}
        for cell, rows in cells_of(batches):
            for leg in legs:
                value, which = cell_bounds(asked, rows, leg), np.full(len(asked.queries), cell, np.int64)
                most, cells = top[leg]
                for k in range(seeds):  # an insertion into each query's short list
                    up = value > most[k]
                    most[k], value = np.where(up, value, most[k]), np.where(up, most[k], value)
                    cells[k], which = np.where(up, which, cells[k]), np.where(up, cells[k], which)
        for leg in legs:
            most, cells = top[leg]
            k, q = np.nonzero(cells >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(np.full(len(q), leg, np.int32)), pa.array(cells[k, q]), pa.array(most[k, q])], ["q", "leg", "cell", "most"])

    return run


def open_cells(asked: Asked, legs: tuple[int, ...]) -> Callable:
    """Cells in which some query may find a note above its floor, and of how many queries and legs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in cells_of(batches):
            n = sum(int((((b := cell_bounds(asked, rows, leg)) >= asked.floors[leg]) & (b > 0)).sum()) for leg in legs)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([n], pa.int64())], ["cell", "n"])

    return run


def best_notes(asked: Asked, legs: tuple[int, ...], limit: int) -> Callable:
    """Of each cell the best living notes of each query, with ties at the last place: q, leg, node_id, score.

    The first row of a cell (of number NOTES) has its notes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in cells_of(batches):
            notes = rows[0].column("notes").slice(0, 1).flatten()
            ids, n = notes.field("node_id"), len(notes)
            size = [notes.field(f"len{k}").to_numpy().astype(float) for k in range(2)]
            dead = ~np.asarray(notes.field("live").to_numpy(zero_copy_only=False), bool)
            found: dict[int, dict[int, list]] = {leg: {} for leg in legs}
            for r in (rows[0].slice(1), *rows[1:]):
                docs, offsets = r.column("docs").flatten().to_numpy(), np.concatenate([[0], np.cumsum(r.column("docs").value_lengths().to_numpy())])
                tf = r.column("tf").flatten().to_numpy().astype(float)
                for i, (no, of) in enumerate(zip(r.column("no").to_pylist(), r.column("leg").to_pylist(), strict=True)):
                    at, times = docs[offsets[i] : offsets[i + 1]], tf[offsets[i] : offsets[i + 1]]
                    for leg in legs:
                        if of in (leg, SAME):
                            found[leg].setdefault(no, []).append((at, asked.idf[leg][no] * saturated(times, size[leg][at], asked.avg[leg])))
            for leg in legs:
                most = np.zeros(len(asked.phrases))
                for no, parts in found[leg].items():
                    most[no] = max(float(p.max()) for _, p in parts)
                bounds = asked.bounds(most)
                out = [], [], []
                for q in np.flatnonzero((bounds > 0) & (bounds >= asked.floors[leg])).tolist():
                    end = asked.starts[q + 1] if q + 1 < len(asked.starts) else len(asked.terms)
                    score = np.zeros(n)
                    for no in asked.terms[asked.starts[q] : end].tolist():
                        for at, part in found[leg].get(no, ()):
                            score[at] += part  # a note is in a block once
                    score[dead] = 0
                    hit = np.flatnonzero((score > 0) & (score >= asked.floors[leg][q]))
                    if len(hit) > limit:
                        value = np.round(score[hit], 7)
                        hit = hit[value >= np.partition(value, len(value) - limit)[len(value) - limit]]
                    out[0].extend([q] * len(hit))
                    out[1].extend(ids.take(pa.array(hit)).to_pylist())
                    out[2].extend(score[hit].tolist())
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([leg] * len(out[0]), pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], ["q", "leg", "node_id", "score"])

    return run


@dataclass
class LexicalIndex:
    """An index in a folder that driver and executors share."""

    spark: SparkSession
    path: str
    version: int
    slots: int
    parts: int
    #: What the last search visited, where it was asked to count that.
    visited: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def build(nodes: DataFrame, path: str, per_slot: int = PER_SLOT) -> LexicalIndex:
        """Writes the index of nodes (node_id, title, content, tags) to path."""
        slots = max(1, -(-nodes.count() // per_slot))
        index = LexicalIndex(nodes.sparkSession, path, 0, slots, min(-(-slots // max(1, slots // BUNDLED)), PARTS))
        index._write(cut_blocks(cut_notes(nodes, slots, index.parts), 0), None, None)
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> LexicalIndex:
        """The latest complete version of the index in path."""
        last = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
        return LexicalIndex(spark, path, last["version"], last["slots"], last["parts"])

    def manifest(self) -> DataFrame:
        """A row for each part: the version that holds its cells, its living notes and their lengths' sums."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").where(F.col("version") == self.version)

    def cells(self, only: list[int] | None = None) -> DataFrame:
        """The cells of this version with their notes, or those of some parts."""
        held: dict[int, list[int]] = {}
        for r in self.manifest().select("part", "held").collect():  # no more than PARTS
            if only is None or r["part"] in only:
                held.setdefault(r["held"], []).append(r["part"])
        here = F.lit(False)
        for version, parts in held.items():
            here = here | ((F.col("version") == version) & F.col("part").isin(parts))
        return self.spark.read.schema(CELLS).parquet(f"{self.path}/cells").where(here)

    def postings(self) -> DataFrame:
        """All blocks up to this version. Some may be of notes, or whole cells, that live no more: see living()."""
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings").where((F.col("version") <= self.version) & (F.col("token") != EVERY))

    def living(self, blocks: DataFrame) -> DataFrame:
        """Blocks (cell, docs, n) with n the notes that still live, without blocks of none. Nothing has died before the first change."""
        if not self.version:
            return blocks
        live = self.cells().select("cell", F.col("notes.live").alias("live"))
        n = F.size(F.filter("docs", lambda d: F.get("live", d))).cast("long")
        return blocks.join(live, "cell").withColumn("n", n).drop("live").where("n > 0")

    def _write(self, blocks: DataFrame, only: list[int] | None, old: DataFrame | None) -> None:
        """Writes blocks as a new version, then the cells of the parts it touches (old: cells there were), and then the manifest."""
        version = 0 if only is None else self.version + 1
        blocks.sortWithinPartitions("token", "leg", "cell").write.mode("overwrite").parquet(f"{self.path}/postings/version={version}")
        cells = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings").where((F.col("version") == version) & (F.col("token") == EVERY)).select("cell", "notes", "part")
        cells = cells if old is None else cells.unionByName(old)
        cells.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/cells/version={version}")
        written = self.spark.read.schema(CELLS).parquet(f"{self.path}/cells").where(F.col("version") == version)
        sums = written.select("part", F.explode("notes").alias("d")).where("d.live").groupBy("part").agg(F.count("*").alias("n"), F.sum("d.len0").alias("sum0"), F.sum("d.len1").alias("sum1"))
        every = list(range(self.parts)) if only is None else only
        mine = self.spark.createDataFrame([(p,) for p in every], "part int").join(sums, "part", "left").na.fill(0).withColumn("held", F.lit(version))
        if only is not None:
            mine = mine.unionByName(self.manifest().where(~F.col("part").isin(only)).select("part", "n", "sum0", "sum1", "held"))
        mine = mine.select("part", F.col("held").cast("int").alias("held"), "n", "sum0", "sum1", F.lit(self.slots).alias("slots"), F.lit(self.parts).alias("parts"))
        mine.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        self.version = version

    def changed(self, upserts: DataFrame, deletes: DataFrame) -> LexicalIndex:
        """The index after notes came, changed (upserts: node_id, title, content, tags) or went (deletes: node_id).

        An upsert of a deleted note wins. What came or changed is cut into cells of its own; of the parts
        that hold such notes the rows of notes are written anew, which tell who lives. No token is
        written again. Tokens of notes that live no more stay in their blocks, and slots stay as many as
        they were: after the notes have changed or grown several times over, build anew.
        """
        new = cut_notes(upserts, self.slots, self.parts)
        gone = upserts.select("node_id").union(deletes.select("node_id")).distinct()
        touched = [r[0] for r in gone.select(part_of(self.slots, self.parts).alias("part")).distinct().collect()]  # no more than PARTS
        if not touched:
            return self  # nothing has changed
        rows = self.cells(touched).select("part", "cell", F.posexplode("notes").alias("no", "d")).select("part", "cell", "no", "d.*")
        rows = rows.join(gone.withColumn("gone", F.lit(True)), "node_id", "left").withColumn("live", F.col("live") & F.col("gone").isNull())
        old = rows.groupBy("part", "cell").agg(F.array_sort(F.collect_list(F.struct("no", "node_id", "len0", "len1", "live"))).alias("notes")).where(F.exists("notes", lambda d: d["live"]))
        old = old.withColumn("notes", F.transform("notes", lambda d: d.dropFields("no")))
        self._write(cut_blocks(new, self.version + 1), touched, old)
        return self

    def tokens(self) -> DataFrame:
        """Occurrences of the shadow index by note: node_id, postings, chars."""
        p = self.postings().where(F.col("leg") != 0).select("cell", F.length("token").alias("chars"), F.explode(F.arrays_zip("docs", "tf")).alias("d"))
        p = p.groupBy("cell", F.col("d.docs").alias("no")).agg(F.sum("d.tf").alias("postings"), F.sum(F.col("d.tf") * F.col("chars")).alias("chars"))
        notes = self.cells().select("cell", F.posexplode("notes").alias("no", "d")).where("d.live").select("cell", "no", "d.node_id")
        return notes.join(p, ["cell", "no"]).select("node_id", "postings", "chars")

    def top(self, queries: DataFrame, limit: int, seeds: int = SEEDS, count_visits: bool = False) -> DataFrame:
        """query_id, leg (0 plain, 1 bigrams), node_id, score, rank of the best `limit` notes of each leg.

        queries: query_id, text. A term is a phrase of one or more tokens; a phrase's occurrences are
        counted by positions in all of its cells, as its idf needs their number. Queries are sent to
        the tasks, QUERIES of them at a time.
        """
        n = queries.count()
        if n > QUERIES:
            k = -(-n // QUERIES)
            each = [self.top(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(k)) == i), limit, seeds) for i in range(k)]
            out = each[0]
            for df in each[1:]:
                out = out.unionByName(df)
            return out
        kind = queries.schema["query_id"].dataType.simpleString()
        none = f"query_id {kind}, leg int, node_id string, score double, rank int"
        tokens = F.filter(F.transform(or_terms(F.col("text")), fts_tokens), lambda t: F.size(t) > 0)
        rows = [r for r in queries.select("query_id", F.transform(tokens, lambda t: F.array_join(t, " ")).alias("phrases")).collect() if r["phrases"]]
        total = self.manifest().agg(F.sum("n").alias("n"), F.sum("sum0").alias("sum0"), F.sum("sum1").alias("sum1")).first()
        if not rows or not total["n"]:
            return self.spark.createDataFrame([], none)
        phrases = tuple(sorted({p for r in rows for p in r["phrases"]}))
        number = {p: i for i, p in enumerate(phrases)}
        terms = np.array([number[p] for r in rows for p in r["phrases"]])
        starts = np.cumsum([0] + [len(r["phrases"]) for r in rows])[:-1]

        cut = checkpointed(self.spark)
        held = self.postings().where(F.col("token").isin(sorted({t for p in phrases for t in p.split(" ")})))
        one = F.broadcast(self.spark.createDataFrame([(p, i) for p, i in number.items() if " " not in p], "token string, no int"))
        single = held.join(one, "token")
        heads = self.living(single.select("no", "leg", "cell", "n", "max_tf", "min_len0", "min_len1", "docs")).drop("docs")
        several = self._phrases(held, [(i, p) for p, i in number.items() if " " in p])
        if several is not None:
            several = cut(self.living(several))
            heads = heads.unionByName(several.drop("docs", "tf"))
        heads = cut(heads)
        avg = total["sum0"] / total["n"], total["sum1"] / total["n"]
        df = np.zeros((2, len(phrases)))
        for r in heads.groupBy("no", "leg").agg(F.sum("n").alias("n")).collect():  # no more than phrases, three times over
            for leg in (0, 1):
                df[leg, r["no"]] += r["n"] if r["leg"] in (leg, SAME) else 0
        # both legs are the same where no asked token stands in a note whose bigrams differ
        legs = (0,) if avg[0] == avg[1] and heads.where(F.col("leg") != SAME).isEmpty() else (0, 1)
        idf = tuple(np.maximum(1e-6, np.log((total["n"] - df[leg] + 0.5) / (df[leg] + 0.5))) for leg in (0, 1))
        asked = Asked(tuple(r["query_id"] for r in rows), phrases, terms, starts, idf, avg, (np.zeros(len(rows)), np.zeros(len(rows))))

        by_cell = dealt_by_cell(heads)
        found = by_cell.mapInArrow(best_cells(asked, legs, seeds), "q int, leg int, cell long, most double")
        order = F.row_number().over(W.partitionBy("q", "leg").orderBy(F.desc("most"), "cell"))
        first_cells = [r[0] for r in found.withColumn("o", order).where(F.col("o") <= seeds).select("cell").distinct().collect()]  # `seeds` for each query and leg at most

        blocks = single.select("no", "leg", "cell", "docs", "tf")
        blocks = blocks.unionByName(several.select(*blocks.columns)) if several is not None else blocks
        own = self.cells().select(F.lit(NOTES).alias("no"), F.lit(SAME).alias("leg"), "cell", "notes")
        every = own.unionByName(blocks, allowMissingColumns=True)

        def notes(rows: DataFrame, asked: Asked) -> DataFrame:
            return dealt_by_cell(rows).mapInArrow(best_notes(asked, legs, limit), "q int, leg int, node_id string, score double")

        place = F.row_number().over(W.partitionBy("q", "leg").orderBy(F.desc(F.round("score", 8)), "node_id"))
        first = cut(notes(every.where(F.col("cell").isin(first_cells)), asked).withColumn("rank", place).where(F.col("rank") <= limit))
        floors = np.full((2, len(rows)), 0.0)
        for r in first.where(F.col("rank") == limit).select("q", "leg", "score").collect():  # one for each query and leg
            floors[r["leg"], r["q"]] = r["score"] - SLACK
        asked = Asked(asked.queries, phrases, terms, starts, idf, avg, (floors[0], floors[1]))
        left = cut(by_cell.where(~F.col("cell").isin(first_cells)).mapInArrow(open_cells(asked, legs), "cell long, n long"))
        if count_visits:
            cells = heads.select("cell").distinct().count()
            self.visited = {"cells": cells, "first": len(first_cells), "rest": left.count(), "searches": cells * len(rows) * len(legs), "searched": (left.agg(F.sum("n")).first()[0] or 0) + len(first_cells) * len(rows) * len(legs)}
        out = first.drop("rank").unionByName(notes(every.join(left.select("cell"), "cell", "left_semi"), asked))
        out = out.withColumn("rank", place).where(F.col("rank") <= limit)
        names = F.broadcast(self.spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], f"q int, query_id {kind}"))
        out = out.join(names, "q").select("query_id", "leg", "node_id", "score", "rank")
        return out if len(legs) > 1 else out.withColumn("leg", F.explode(F.array(F.lit(0), F.lit(1))))

    def _phrases(self, held: DataFrame, phrases: list[tuple[int, str]]) -> DataFrame | None:
        """Blocks of phrases of several tokens: no, leg, cell, n, max_tf, min_len0, min_len1, docs, tf; None if none is asked.

        The i-th token at position p votes for a phrase that starts at p - i; a start with all votes is an occurrence.
        A note is at least as long as the least of each token's block.
        """
        if not phrases:
            return None
        want = F.broadcast(self.spark.createDataFrame([(no, len(p.split(" ")), i, t) for no, p in phrases for i, t in enumerate(p.split(" "))], "no int, size int, i int, token string"))
        rows = held.join(want, "token").withColumn("doc", F.flatten(F.zip_with("docs", "tf", lambda d, n: F.array_repeat(d, n))))
        rows = rows.select("no", "size", "i", "leg", "cell", "min_len0", "min_len1", F.explode(F.arrays_zip("doc", "at")).alias("d")).select("no", "size", "i", "leg", "cell", "min_len0", "min_len1", "d.*")
        least = [F.max(c).alias(c) for c in ("min_len0", "min_len1")]
        starts = rows.groupBy("no", "size", "leg", "cell", "doc", (F.col("at") - F.col("i")).alias("start")).agg(F.count("*").alias("votes"), *least).where("votes = size")
        tf = starts.groupBy("no", "leg", "cell", "doc").agg(F.count("*").cast("int").alias("tf"), *least)
        tf = tf.groupBy("no", "leg", "cell").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("min_len0").alias("min_len0"), F.min("min_len1").alias("min_len1"), F.collect_list(F.struct("doc", "tf")).alias("d"))
        return tf.select("no", "leg", "cell", "n", "max_tf", "min_len0", "min_len1", F.col("d.doc").alias("docs"), F.col("d.tf").alias("tf"))


def merged(index: LexicalIndex, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Two legs, the plain and the bigram index, summed by reciprocal rank (times 100)."""
    total = index.top(queries, limit).groupBy("query_id", "node_id").agg((F.sum(reciprocal_rank(F.col("rank"))) * 100).alias("score"))
    return ranked(total, limit)


def hit_count(index: LexicalIndex, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Hits of each query, none included."""
    n = merged(index, queries, limit).groupBy("query_id").agg(F.count("*").alias("hits"))
    return queries.select("query_id").join(n, "query_id", "left").na.fill(0, ["hits"])
