"""Operator 12: cross-tokenizer alignment as an event sweep.

Each token of either tokenizer is an event at the byte where it ends. Events travel in blocks: a row
is a run of tokens of one side (their ids say how long they are) with the byte at which it starts.
Rows of both sides are unioned, repartitioned by document, sorted by offset within partitions, and
streamed through a machine whose state is what has not been cut off yet: the tokens after the last
byte at which both sides end, a running digest and counts. Where both end a group is cut off.

The links of a document are kept as distinct pairs of ids with their number. How many documents hold
a pair is counted over all documents, by partial counts in tasks. The counts of the HEAD commonest
pairs, a bounded table, go to the tasks; a document's links of rarer pairs are joined with theirs.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memgrid.llm.common import give_back, slices, written

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The property White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Units of each of the two generations that a worker remembers, and characters of the longest such unit; tokens of one block.
CACHE, CACHE_CHARS, BLOCK = 200_000, 40, 1 << 15
#: Pairs whose counts go to all tasks: 2^18 rows of 16 bytes.
HEAD = 1 << 18
#: Pairs that a task counts before it gives them out.
COUNTED = 1 << 20
#: Links of one group from which ids are counted before they are paired.
LARGE = 1 << 12


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable Latin-1, else the next one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Sides:
    """Both tokenizers, by unit.

    A unit is a run of white space and of what follows it. Side A's pattern always starts a match at
    such a run and never looks behind; side B merges no piece across its start. White space that
    occurs in some piece after another character (as the carriage return) starts no unit.
    """

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token)}
        self.pattern = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.core = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.pieces.piece_to_id("▁")
        glued = "".join(sorted({c for p in pieces for c in p[1:] if c in SPACE}))
        space = f"[{re.escape(SPACE)}]"
        more = f"(?:[{re.escape(glued)}]{space}*[^{re.escape(SPACE)}]*)*" if glued else ""
        self.unit = re.compile(f"{space}*[^{re.escape(SPACE)}]+{more}|{space}+")
        if any("▁" in p.lstrip("▁") for p in pieces):  # a piece over two words: no unit is safe
            self.unit = re.compile(r"(?s:.+)")
        if len(ranks) < 256 or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("side A has no token for some byte")  # else its bytes are those of the text
        #: Ids of units, those used of late and those before them.
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}
        self.before: dict[str, tuple[bytes, bytes, bool]] = {}
        self.kind_a, self.kind_b = (np.dtype("H" if len(x) <= 1 << 16 else "I") for x in (self.bytes_a, self.bytes_b))
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)

    def ids_b(self, units: list[str]) -> list[list[int]]:
        """Ids of units; the library puts a space before what it is given."""
        out = self.pieces.encode([u[1:] if u[0] == " " else u for u in units])
        for i, u in enumerate(units):
            if u == " ":
                out[i] = [self.blank]
            elif u[0] != " ":
                if out[i][0] != self.blank:
                    raise ValueError("the added space is merged with what follows")
                del out[i][0]
        return out

    def learn(self, units: list[str]) -> dict[str, tuple[bytes, bytes, bool]]:
        """Ids of units that are not remembered yet; those of short ones will be."""
        find, single, bytes_b, found = self.pattern.findall, self.core.encode_single_piece, self.bytes_b, {}
        kind_a, kind_b = self.kind_a.char, self.kind_b.char
        for u, b in zip(units, self.ids_b(units), strict=True):
            a = []
            for p in find(u):
                a += single(p.encode())
            found[u] = array(kind_a, a).tobytes(), array(kind_b, b).tobytes(), b"".join([bytes_b[i] for i in b]) == u.encode()
        return found

    def look_up(self, texts: list[list[str]]) -> dict[str, tuple[bytes, bytes, bool]]:
        """Ids of all units of some texts."""
        wanted = set().union(*texts)
        now = {u: x for u in wanted if (x := self.known.get(u)) is not None}
        missing = wanted.difference(now)
        now |= (more := {u: x for u in missing if (x := self.before.get(u)) is not None})
        more |= self.learn(list(missing.difference(more)))
        now |= more
        if len(self.known) + len(more) > CACHE:
            self.known, self.before = {}, self.known
        self.known.update((u, x) for u, x in more.items() if len(u) <= CACHE_CHARS)
        return now

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of space and text on both sides; none for a null or empty text, or one whose bytes side B does not give back."""
        units = [self.unit.findall(" " + t) if t else [] for t in texts]
        known = self.look_up(units)
        out = []
        for text, of in zip(texts, units, strict=True):
            found = [known[u] for u in of]
            a = np.frombuffer(b"".join([x[0] for x in found]), self.kind_a)
            b = np.frombuffer(b"".join([x[1] for x in found]), self.kind_b)
            if not all([x[2] for x in found]) and b"".join(map(self.bytes_b.__getitem__, b.tolist())) != (" " + text).encode():
                a, b = a[:0], b[:0]
            out.append((a, b))
        return out


@lru_cache(maxsize=4)
def sides(path_a: str, path_b: str) -> Sides:
    return Sides(path_a, path_b)


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True).compress(x.tobytes()) if len(x) else b""


def unpacked(x: bytes, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind) if x else np.empty(0, kind)


EVENTS = "part long, row long, doc_id long, at long, side int, ids binary"


def events(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The union of both sides' blocks of events; a row is known by its task, a digest, and which of its like it is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, part, seen = sides(path_a, path_b), TaskContext.get().partitionId(), {}
        for batch in batches:
            for piece in slices(batch):
                rows = []
                texts = piece.column("text").to_pylist()
                for doc_id, text, (a, b) in zip(piece.column("doc_id").to_pylist(), texts, s.tokens(texts), strict=True):
                    # numbered by content, so that a task that runs again in another order gives the same rows
                    digest = int.from_bytes(hashlib.blake2b(f"{doc_id} {text}".encode(), digest_size=5).digest(), "little")
                    nth = seen[digest] = seen.get(digest, -1) + 1
                    row = digest << 23 | nth
                    rows.append((part, row, doc_id, -1, 0, b""))  # a document without tokens has a row, too
                    for side, ids, lengths in ((0, a, s.length_a), (1, b, s.length_b)):
                        ends = np.cumsum(lengths[ids])
                        for at in range(0, len(ids), BLOCK):
                            rows.append((part, row, doc_id, int(ends[at - 1]) if at else 0, side, packed(ids[at : at + BLOCK])))
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "row", "doc_id", "at", "side", "ids"])
        give_back()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, EVENTS)


class Digits:
    """Decimal ids as rows of letters: up to five digits and a mark, the rest zero bytes."""

    def __init__(self, n: int):
        text = [str(i).encode() for i in range(n)]
        self.size = np.array([len(t) for t in text], np.int64)
        width = int(self.size.max(initial=1)) + 1
        self.table = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in text), np.uint8).reshape(n, width)

    def written(self, ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
        out = self.table[ids]
        out[np.arange(len(ids)), self.size[ids]] = marks
        return out


@lru_cache(maxsize=2)
def digits(n: int) -> Digits:
    return Digits(n)


class Document:
    """State of a document in the sweep: counts, the running digest, distinct pairs with the number of their links."""

    __slots__ = ("doc_id", "groups", "links", "n_a", "n_b", "pairs", "sha", "times")

    def __init__(self, doc_id):
        self.doc_id, self.n_a, self.n_b, self.groups, self.links = doc_id, 0, 0, 0, 0
        self.sha, self.pairs, self.times = None, np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, n_a: int, n_b: int, groups: int, links: int, text: bytes, pairs: np.ndarray, times: np.ndarray) -> None:
        if self.sha is None:
            self.sha = hashlib.sha256(text)
            self.pairs, self.times = pairs, times
        else:
            self.sha.update(b";" + text)
            self.pairs, self.times = summed(np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times]))
        self.n_a, self.n_b, self.groups, self.links = self.n_a + n_a, self.n_b + n_b, self.groups + groups, self.links + links

    def row(self) -> tuple:
        gaps = np.diff(self.pairs, prepend=np.uint64(0))
        return self.doc_id, self.n_a, self.n_b, self.groups, self.links, self.sha.hexdigest() if self.sha else "", packed(gaps), packed(self.times.astype("<u4") if self.times.max(initial=0) < 1 << 32 else self.times)


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


class Sweep:
    """The machine: takes events in order, cuts groups off where both sides end, and gives documents out as they end."""

    def __init__(self, s: Sides, large: int):
        self.s, self.large = s, large
        self.digits = digits(max(len(s.bytes_a), len(s.bytes_b)))
        self.key, self.document = None, None
        # tokens of the document in hand after the last common end: ids and ends
        self.left = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(2)]

    def feed(self, keys: list[tuple], doc_ids: list, at: list[int], side: list[int], blocks: list[bytes]) -> list[tuple]:
        """Rows of documents that ended before the last event."""
        documents, bases, out = [], [], []
        ids: list[list] = [[], []]
        ends: list[list] = [[], []]
        owner: list[list] = [[], []]
        base = 0
        if self.document is not None:
            documents.append(self.document)
            for k in range(2):
                ids[k].append(self.left[k][0])
                ends[k].append(self.left[k][1])
                owner[k].append(np.zeros(len(self.left[k][0]), np.int64))
        bases.append(0)
        for key, doc_id, start, k, block in zip(keys, doc_ids, at, side, blocks, strict=True):
            if key != self.key:
                if self.document is not None:
                    base += 1 << 40  # further than any text's end, so that documents never meet
                    bases.append(base)
                self.key, self.document = key, Document(doc_id)
                documents.append(self.document)
            if start < 0:
                continue
            x = unpacked(block, (self.s.kind_a, self.s.kind_b)[k]).astype(np.int64)
            ids[k].append(x)
            ends[k].append(np.cumsum((self.s.length_a, self.s.length_b)[k][x]) + (start + base))
            owner[k].append(np.full(len(x), len(documents) - 1))
        (a, b), (end_a, end_b), (of_a, of_b) = ([np.concatenate(x) if x else np.empty(0, np.int64) for x in y] for y in (ids, ends, owner))
        cut_a, cut_b = self.cut(documents, a, b, end_a, end_b, of_a)
        self.left = [(a[cut_a:], end_a[cut_a:] - base), (b[cut_b:], end_b[cut_b:] - base)]
        for d in documents[:-1]:
            out.append(d.row())
        return out

    def cut(self, documents: list[Document], a, b, end_a, end_b, of_a) -> tuple[int, int]:
        """Adds all groups that are complete to their documents; how many tokens of either side they hold."""
        if not len(a) or not len(b):
            return 0, 0
        at = np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)
        last_a = np.flatnonzero(end_b[at] == end_a)
        if not len(last_a):
            return 0, 0
        last_b = at[last_a]
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        start_a, start_b = last_a - size_a + 1, last_b - size_b + 1
        n_a, n_b, groups = int(last_a[-1]) + 1, int(last_b[-1]) + 1, len(last_a)
        a, b = a[:n_a], b[:n_b]
        of = of_a[last_a]  # the document of each group
        # the digests' text: A's tokens of a group, B's, and so on
        place_a = np.arange(n_a) + np.repeat(start_b, size_a)
        place_b = np.arange(n_b) + np.repeat(last_a + 1, size_b)
        marks_a, marks_b = np.full(n_a, ord(","), np.uint8), np.full(n_b, ord(","), np.uint8)
        marks_a[last_a], marks_b[last_b] = ord("|"), ord(";")
        letters = np.empty((n_a + n_b, self.digits.table.shape[1]), np.uint8)
        letters[place_a], letters[place_b] = self.digits.written(a, marks_a), self.digits.written(b, marks_b)
        text = letters[letters != 0].tobytes()
        used = np.empty(n_a + n_b, np.int64)
        used[place_a], used[place_b] = self.digits.size[a] + 1, self.digits.size[b] + 1
        upto = np.cumsum(used)
        # links: of each group all of A's tokens with all of B's
        links = size_a * size_b
        keys, of_links, times = self.links(a, b, links, start_a, start_b, size_a, size_b, of)
        # one entry for each document and pair
        order = np.lexsort((keys, of_links))
        keys, of_links, times = keys[order], of_links[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (of_links[1:] != of_links[:-1])]))
        keys, of_links, times = keys[first], of_links[first], np.add.reduceat(times, first)
        found, first_group = np.unique(of, return_index=True)
        next_group = np.append(first_group[1:], groups)
        lo, hi = np.searchsorted(of_links, found, "left"), np.searchsorted(of_links, found, "right")
        sums = np.add.reduceat(links, first_group)
        begin = 0
        for i, d in enumerate(found.tolist()):
            g, h = int(first_group[i]), int(next_group[i])
            end = int(upto[last_a[h - 1] + 1 + last_b[h - 1]])
            documents[d].add(int(last_a[h - 1] + 1 - start_a[g]), int(last_b[h - 1] + 1 - start_b[g]), h - g, int(sums[i]), text[begin : end - 1], keys[lo[i] : hi[i]], times[lo[i] : hi[i]])
            begin = end
        return n_a, n_b

    def links(self, a, b, links, start_a, start_b, size_a, size_b, of):
        """Pairs of ids, their documents and times: one by one in small groups, by counts of ids in large ones."""
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        small = links <= self.large
        n, sa, sb, kb = links[small], start_a[small], start_b[small], size_b[small]
        group = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        keys = [a[sa[group] + i // kb[group]] << np.uint64(32) | b[sb[group] + i % kb[group]]]
        owners, times = [of[small][group]], [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(~small):
            x, nx = np.unique(a[start_a[g] : start_a[g] + size_a[g]], return_counts=True)
            y, ny = np.unique(b[start_b[g] : start_b[g] + size_b[g]], return_counts=True)
            keys.append((x[:, None] << np.uint64(32) | y[None, :]).ravel())
            times.append((nx[:, None] * ny[None, :]).ravel())
            owners.append(np.full(len(x) * len(y), of[g]))
        return np.concatenate(keys), np.concatenate(owners), np.concatenate(times)

    def end(self) -> list[tuple]:
        """The row of the last document."""
        out = [self.document.row()] if self.document is not None else []
        self.key, self.document = None, None
        return out


SWEPT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_SWEPT = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]


def swept(ordered: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Events in order (a document's all in one partition) to a row for each document with its packed links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Sweep(sides(path_a, path_b), LARGE)

        def given(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _SWEPT, strict=True)], [c.split()[0] for c in SWEPT.split(", ")])

        for batch in batches:
            for piece in slices(batch):
                c = {name: piece.column(name).to_pylist() for name in ("part", "row", "doc_id", "at", "side", "ids")}
                rows = machine.feed(list(zip(c["part"], c["row"], strict=True)), c["doc_id"], c["at"], c["side"], c["ids"])
                if rows:
                    yield given(rows)
        if rows := machine.end():
            yield given(rows)
        give_back()

    return ordered.mapInArrow(run, SWEPT)


def links_of(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (A's id in the upper half) and the number of their links, of a row of swept()."""
    p = np.cumsum(unpacked(pairs, np.dtype("<u8")), dtype=np.uint64)
    t = unpacked(times, np.dtype("u1")).tobytes()
    return p, np.frombuffer(t, "<u4" if len(t) == 4 * len(p) else "<i8").astype(np.int64)


def pair_counts(documents: DataFrame) -> DataFrame:
    """a, b, n, best: in how many documents a pair of ids is linked, and whether no pair of its A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = (np.empty(0, np.uint64), np.empty(0, np.int64)), [], 0

        def given(held) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int64)), pa.array(held[1])], ["pair", "n"])

        def joined():
            keys = np.concatenate([held[0], *waiting])
            return summed(keys, np.concatenate([held[1], np.ones(len(keys) - len(held[0]), np.int64)]))

        for batch in batches:
            for piece in slices(batch):
                for p, t in zip(piece.column("pairs").to_pylist(), piece.column("times").to_pylist(), strict=True):
                    waiting.append(links_of(p, t)[0])
                    size += len(waiting[-1])
                    if size >= COUNTED:
                        held, waiting, size = joined(), [], 0
                        if len(held[0]) >= COUNTED:
                            yield given(held)
                            held = (np.empty(0, np.uint64), np.empty(0, np.int64))
        held = joined()
        if len(held[0]):
            yield given(held)
        give_back()

    counts = documents.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    a = F.shiftright("pair", 32)
    # a window holds the pairs of one A id: no more than B has ids
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(W.partitionBy(a))).alias("best"))


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, uid long, rest array<struct<pair:long,times:long>>"


def scored(documents: DataFrame, head: list) -> DataFrame:
    """n_best and count_sum over the links whose pairs are in `head` (pair, n, best), and the other links as rest."""
    pair = np.array([r["pair"] for r in head], np.uint64)
    order = np.argsort(pair)
    pair, n = pair[order], np.array([r["n"] for r in head], np.int64)[order]
    best = np.array([r["best"] for r in head], bool)[order]
    kind = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch):
                n_best, total, uids, offsets, pairs, times = [], [], [], [0], [], []
                for p, t in zip(piece.column("pairs").to_pylist(), piece.column("times").to_pylist(), strict=True):
                    p, t = links_of(p, t)
                    at = np.minimum(np.searchsorted(pair, p), max(0, len(pair) - 1))
                    known = pair[at] == p if len(pair) else np.zeros(len(p), bool)
                    at, tk = at[known], t[known]
                    n_best.append(int(tk[best[at]].sum()))
                    total.append(int((n[at] * tk).sum()))
                    uids.append(part << 40 | row)
                    row += 1
                    pairs.append(p[~known].astype(np.int64))
                    times.append(t[~known])
                    offsets.append(offsets[-1] + len(pairs[-1]))
                both = pa.StructArray.from_arrays([pa.array(np.concatenate(pairs)), pa.array(np.concatenate(times))], fields=list(kind.value_type))
                rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), both, type=kind)
                columns = [piece.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), piece.column("groups_sha256"), pa.array(uids, pa.int64()), rest], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "uid", "rest"])
        give_back()

    return documents.mapInArrow(run, SCORED)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, head: int = HEAD) -> DataFrame:
    """Alignment of both tokenizers over each text: one row for each row of docs.

    docs: doc_id, text (other columns are not read). A null or empty text, and one whose bytes a
    tokenizer does not give back (as with a literal U+2581), has no tokens: zeros and an empty
    groups_sha256. Special strings in texts are plain text. Repeated rows are documents of their own;
    a null doc_id stays null. Without documents there are no rows.
    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    head: pairs whose counts go to all tasks; any number gives the same result.
    """
    a, b = path_a or public_tokenizers.path(SIDE_A), path_b or public_tokenizers.path(SIDE_B)
    ordered = events(docs, a, b).repartition("part", "row").sortWithinPartitions("part", "row", "at", "side")
    documents = written(swept(ordered, a, b), "aligned")
    counts = written(pair_counts(documents), "pairs")
    first = counts.orderBy(F.desc("n"), "pair").limit(head).collect()  # no more than `head` rows
    out = scored(documents, first)
    names = [c.split()[0] for c in SCORED.split(", ")][:8]
    if len(first) < head:  # all pairs are in the head
        return out.select(*names)
    out = written(out, "scored")
    each = out.select("uid", F.explode("rest").alias("r")).select("uid", "r.pair", "r.times")
    more = each.join(counts, "pair").groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    out = out.join(more, "uid", "left")
    return out.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).select(*names)
