"""Operator 8: token counts, by batch encoding in Arrow functions that return lengths only.

A text is split where a byte-level pattern always starts a new match, so that the parts' counts add
up: before white space that follows something else, and within a run without white space after a
letter or a number that something of another kind follows. No alternative of the pattern goes on
there, and none looks behind. (After other characters it may: an apostrophe takes letters with it.)
What has no such place, as a run of nothing but letters, is encoded as it is, whatever its length.
A part's count does not depend on its neighbours, so parts that were seen before are not encoded
again, and new ones are encoded in batches of about equal bytes.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from memgrid.llm.common import arrow_map, texts_of

VOCABULARY = "byte_bpe_50k.json"
LIMIT, BATCH_BYTES = 1024, 1 << 18
#: Units whose counts a worker remembers, and bytes of the longest such unit; so the memory is bounded, too.
CACHE, CACHE_BYTES = 600_000, 96
#: Characters from which a run without white space is split further.
LONG = 64
#: The property White_Space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: A run without white space that is split further.
RUN = re.compile(f"[^{SPACE}]{{{LONG}}}")
#: Parts of a long unit: up to the end of a run of letters or of numbers.
PART = regex.compile(r"[^\p{L}\p{N}]*+(?:\p{L}++|\p{N}++)|[^\p{L}\p{N}]++")


class Counter:
    """Counts tokens as the tokenizers library gives them for a vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}

    def encoded(self, units: list[str]) -> list[int]:
        """Counts of units, encoded in batches balanced by bytes; a long unit is a batch of its own."""
        sizes = [len(u.encode()) for u in units]
        order = sorted(range(len(units)), key=sizes.__getitem__)
        out, batch, size = [0] * len(units), [], 0
        for i in [*order, None]:
            if batch and (i is None or size + sizes[i] > BATCH_BYTES):
                for k, e in zip(batch, self.tokenizer.encode_batch_fast([units[k] for k in batch], add_special_tokens=False), strict=True):
                    out[k] = len(e)
                batch, size = [], 0
            if i is not None:
                batch.append(i)
                size += sizes[i]
        return out

    def units(self, text: str) -> list[str]:
        found = UNIT.findall(text)
        if not RUN.search(text):
            return found
        out = []
        for u in found:
            # a special string is found wherever it stands, so what holds one is not split
            out += [u] if len(u) <= LONG or any(x in u for x in self.special) else PART.findall(u)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        units = [self.units(x) for x in texts]
        new = set().union(*units).difference(self.known) if units else set()
        if new and len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = set().union(*units)
        ordered = list(new)
        known = self.known
        known.update(zip(ordered, self.encoded(ordered), strict=True))
        out = [sum(map(known.__getitem__, u)) for u in units]
        for u in ordered:  # what is long is not remembered
            if len(u) * 4 > CACHE_BYTES and len(u.encode()) > CACHE_BYTES:
                del known[u]
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, limit: int = LIMIT, vocabulary_path: str | None = None) -> DataFrame:
    """Bytes and tokens of each whole text; one row for each row of docs.

    docs: doc_id, text (other columns are not read). A null text counts as empty: 0 bytes, 0 tokens.
    Special strings in a text are handled as the library does by default. Returns doc_id,
    n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).
    """

    def make():
        c = counter(vocabulary_path or public_tokenizers.path(VOCABULARY))

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            n = c.counts(texts)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return f

    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
