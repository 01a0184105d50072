"""Operator 1: byte-level BPE encoding and decoding as a monoid tree reduction.

Two reductions nest. A text is halved down to leaves; a leaf is cut into pattern matches
("pieces"), and neighbours are joined by cutting a window around the seam anew. A piece that is
long is halved as bytes; neighbours are joined by encoding a window of tokens around the seam anew.
Leaves are small, so that all but the shortest texts and pieces go through joins. Either window grows
until what lies outside it is proven to stay:

* A match depends on nothing but the characters from its start to two after its end (one of
  lookahead, two more letters of a contraction). So matches of the left text that end three
  characters before its end stay, and matches of the right text stay from the first place where
  the window's matches end at one of theirs, as a match does not look behind.
* A sequence of tokens is the encoding of its bytes exactly if each pair of neighbours is the
  encoding of its own bytes: the first merge across a seam would take place in the pair alone as
  well. This needs a vocabulary in which each token's bytes are encoded as that token, which
  holds for vocabularies made by merges and is tested for the ones used here.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from memgrid.llm.common import arrow_map, texts_of

RANKS = "byte_bpe_50k.tiktoken"
LEAF_CHARS, LEAF_BYTES, LEAF_TOKENS = 256, 8, 1024
#: Pieces, and pairs of tokens, whose encoding a worker remembers, and bytes of the longest such piece; so the memory is bounded, too.
CACHE, PAIRS, CACHE_BYTES = 60_000, 30_000, 128
#: Characters after its end that a match may depend on, and the first window to the right of a seam.
LOOK, WINDOW = 3, 64


class Bpe:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        # Rust's \s is the property White_Space; so is this class, while Python's \s has four controls more.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # --- a piece: tokens joined up a tree over its bytes

    def stable(self, a: int, b: int) -> bool:
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.core.encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        w = 4
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            mid = self.core.encode_single_piece(b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b])))
            if (a == 0 or self.stable(left[a - 1], mid[0])) and (b == len(right) or self.stable(mid[-1], right[b])):
                return left[:a] + mid + right[b:]
            w *= 2

    def piece_tokens(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.core.encode_single_piece(piece)
        half = len(piece) // 2
        return self.join_tokens(self.piece_tokens(piece[:half]), self.piece_tokens(piece[half:]))

    def piece_ids(self, piece: str) -> bytes:
        data = piece.encode()
        ids = np.array(self.piece_tokens(data), "<u4").tobytes()
        if len(data) <= CACHE_BYTES:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    # --- a text: pieces joined up a tree over its characters

    def join_pieces(self, left: list[str], right: list[str], left_chars: int, right_text: str) -> list[str]:
        kept, end = len(left), left_chars
        while kept and end > left_chars - LOOK:
            kept -= 1
            end -= len(left[kept])
        tail, w = "".join(left[kept:]), WINDOW
        while True:
            window = tail + right_text[:w]
            whole = w >= len(right_text)
            mid, i, at = [], 0, len(tail)
            for m in self.pattern.finditer(window):
                e = m.end()
                if e > len(window) - LOOK and not whole:
                    break
                mid.append(m.group())
                while i < len(right) and at < e:
                    at += len(right[i])
                    i += 1
                if e == at and e >= len(tail):
                    return left[:kept] + mid + right[i:]
            if whole:
                return left[:kept] + mid
            w *= 2

    def pieces(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.pattern.findall(text)
        half = len(text) // 2
        return self.join_pieces(self.pieces(text[:half]), self.pieces(text[half:]), half, text[half:])

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        known, new = self.cache.get, self.piece_ids
        return b"".join([known(p) or new(p) for p in self.pieces(text)])

    def decode(self, ids: bytes) -> bytes:
        return self._decode(np.frombuffer(ids, "<u4"))

    def _decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self._decode(ids[:half]) + self._decode(ids[half:])


@lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes each text and decodes the ids again; one row for each row of docs.

    docs: doc_id, text (other columns are not read). A null text counts as empty: no tokens, the
    digest of no bytes. Repeated rows give repeated results; a null doc_id stays null.
    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids themselves
    (``ids`` binary, little-endian unsigned 32-bit).
    ranks_path: file of ranks that each executor can open; by default the installed 50k file.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def make():
        b = bpe(ranks_path or public_tokenizers.path(RANKS))

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [b.encode(x) for x in texts_of(batch)]
            columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(b.decode(x)).hexdigest() for x in ids], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

        return f

    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, schema)
