"""Operator 2: secrets in text, by patterns and by a token-efficiency test.

Random strings cost a tokenizer more tokens than words of the same length. A run of key characters
with few characters per token is therefore held for a secret, unless it is of a known harmless
shape (digest, UUID, number, date, identifier made of words). Where the whole run has enough of
them, its stretches between separators are judged, so that words glued to a secret don't hide it.
What a pattern's span covers is not added again, but the rest of the run is judged.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from memgrid.llm.bpe import RANKS, bpe
from memgrid.llm.common import arrow_map, arrow_replace, texts_of

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs that the token test looks at.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
#: Words, numbers and versions joined by separators: paths, slugs, constants, dates.
#: Possessive throughout: a run that is no identifier is found out in one pass, whatever its length.
_WORD = r"(?:v?\d++|[A-Z]?[a-z]++|[A-Z]++)"
IDENTIFIER = re.compile(rf"{_WORD}(?:[_/=+-]++{_WORD})*+[_/=+-]*+")
#: Words of two letters or more one after the other, each with a capital or all in capitals, and up to four digits.
CAMEL = re.compile(r"(?=[A-Za-z])(?:[A-Z]*+[a-z]{2,}+)*+(?:[A-Z]{2,}+)?+\d{0,4}+")
#: UUIDs and what stands between separators; a stretch of such parts is what is judged within a run.
PART = re.compile(rf"(?<![A-Za-z0-9]){UUID.pattern}(?![A-Za-z0-9])|[A-Za-z0-9]+")
SEPARATORS, LEAST_CHARS = re.compile(r"[+/_=-]+"), 20
KINDS = ("assign", "access", "hex", "random")
#: Of 20 to 48 random characters in prose, at 1.8, 2.0, 2.2 and 2.4 the token test finds 0.94, 0.98, 0.997 and 1.0
#: on average over seven alphabets (20 lower-case letters: 0.68, 0.90, 0.99, 0.997); of 3,000 whole
#: texts of the documents it adds spans to none, none, none and two.
CHARS_PER_TOKEN, MASK = 2.2, "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, by start, then kind.

    A run of 20 (or 24) characters is what a greedy match of one or more leaves after dropping
    shorter ones; for assignments a short value is matched first, then dropped, as it still hides
    what it overlaps.
    """
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def maximal(costs: list[float]) -> list[tuple[int, int]]:
    """Maximal scoring subsequences (first, one past the last), in order and in one pass.

    Each candidate is kept with the sums before its start and at its end. A new positive cost joins
    all candidates back to the last that starts lower, if that one ends lower than the new one;
    `jump` leads from a candidate to the last earlier one that starts lower.
    """
    found: list[tuple[int, int, float, float]] = []
    jump: list[int] = []
    total = 0.0
    for k, c in enumerate(costs):
        low, total = total, total + c
        if c <= 0:
            continue
        new = (k, k + 1, low, total)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = jump[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                jump.append(j)
                break
            new = (found[j][0], k + 1, found[j][2], new[3])
            del found[j:], jump[j:]
    return [(a, b) for a, b, *_ in found]


class Scanner:
    def __init__(self, path: str, chars_per_token: float = CHARS_PER_TOKEN):
        self.bpe = bpe(path)
        self.least = chars_per_token

    def is_random(self, run: str) -> bool:
        if not any(map(str.isalpha, run)) or DIGEST.fullmatch(run) or UUID.fullmatch(run):
            return False
        if any(map(str.isdigit, run)):
            if IDENTIFIER.fullmatch(run) or CAMEL.fullmatch(run):
                return False
        else:  # names of short words are costly in capitals; what is in one piece is left to the ratio
            parts = [x for x in SEPARATORS.split(run) if x]
            if all(len(x) < LEAST_CHARS and (IDENTIFIER.fullmatch(x) or CAMEL.fullmatch(x)) for x in parts):
                return False
        return 4 * len(run) / len(self.bpe.encode(run)) < self.least

    def cost(self, text: str) -> float:
        """Above 0 where text has fewer characters a token than the threshold."""
        return self.least * len(self.bpe.encode(text)) / 4 - len(text)

    def is_word(self, part: str) -> bool:
        """Whether a part between separators is a word, a number, a digest or a UUID."""
        if DIGEST.fullmatch(part) or UUID.fullmatch(part) or part.isdigit():
            return True
        return bool(IDENTIFIER.fullmatch(part) or CAMEL.fullmatch(part)) and (len(part) < 4 or self.cost(part) <= 0)

    def stretches(self, run: str) -> list[tuple[int, int]]:
        """Random stretches of a run: all of it (unless a part is a digest or UUID), or else those of its parts that stand out.

        Stretches start and end at separators and hold no digest or UUID. They are the maximal
        scoring subsequences of the parts by cost: none can be made dearer by parts more or less at
        an end. Half of a stretch's characters at least are in parts that are no words.
        """
        groups, group = [], []
        for m in PART.finditer(run):
            if DIGEST.fullmatch(m.group()) or UUID.fullmatch(m.group()):
                groups.append(group)
                group = []
            else:
                group.append((m.start(), m.end()))
        if not groups and self.is_random(run):
            return [(0, len(run))]
        out = []
        for ends in (*groups, group):
            parts = [(a, b, self.is_word(run[a:b])) for a, b in ends]
            if not parts or parts[-1][1] - parts[0][0] < LEAST_CHARS or all(w for *_, w in parts):
                continue
            costs = [self.cost(run[parts[i - 1][1] if i else a : b]) for i, (a, b, _) in enumerate(parts)]
            for i, j in maximal(costs):
                a, b = parts[i][0], parts[j - 1][1]
                if b - a >= LEAST_CHARS and 2 * sum(y - x for x, y, w in parts[i:j] if not w) >= b - a and self.is_random(run[a:b]):
                    out.append((a, b))
        return out

    def rests(self, run: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """What is random in a run besides the spans of patterns in it.

        A rest as long as a run is judged like one. A shorter one belongs to the secret if the
        stretch around a span of hex digits or an access key is random, but for words at its end.
        """
        left, at = [], 0
        for a, _, b in base:
            if a > at:
                left.append((at, a))
            at = max(at, b)
        if at < len(run):
            left.append((at, len(run)))
        out = [(a + x, a + y) for a, b in left if b - a >= LEAST_CHARS for x, y in self.stretches(run[a:b])]
        starts, ends = {a for a, k, _ in base if k}, {b for _, k, b in base if k}
        wide, at = self.stretches(run) if starts else [], 0
        for x, y in wide:  # both are in order and neither overlaps itself
            while at < len(left) and left[at][1] <= x:
                at += 1
            for a, b in left[at:]:
                if a >= y:
                    break
                a, b = max(a, x), min(b, y)
                if not 0 < b - a < LEAST_CHARS:
                    continue
                parts = [(a + m.start(), a + m.end()) for m in PART.finditer(run[a:b])]
                own = [p for p in parts if p[1] in starts or p[0] in ends or not self.is_word(run[p[0] : p[1]])]
                if own:
                    out.append((own[0][0], own[-1][1]))
        return sorted(set(out))

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Spans of the patterns, and those with the ones that the token test adds."""
        base, more = base_spans(text), []
        near: list[tuple[int, int, int]] = []
        at_base = 0
        for m in RUN.finditer(text):
            at, end = m.span()
            while at_base < len(base) and base[at_base][0] < end:
                near.append(base[at_base])
                at_base += 1
            near = [s for s in near if s[2] > at]
            inside = [(max(a, at) - at, k, min(b, end) - at) for a, k, b in near]
            more += [(at + a, 3, at + b) for a, b in (self.rests(m.group(), inside) if inside else self.stretches(m.group()))]
        return base, sorted(base + more) if more else base


@lru_cache(maxsize=4)
def scanner(path: str, chars_per_token: float) -> Scanner:
    return Scanner(path, chars_per_token)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = MASK) -> str:
    """text with each run of overlapping spans replaced by mask."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, chars_per_token: float = CHARS_PER_TOKEN, ranks_path: str | None = None) -> DataFrame:
    """Secrets of each whole text; one row for each row of docs.

    docs: doc_id, text (other columns are not read). A null text counts as empty: no spans, the
    digest of nothing. Repeated rows give repeated results. Returns doc_id, n_assign, n_access,
    n_hex, base_sha256, spans, n_random, values (the strings found, in the order of spans).
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long, values array<string>"

    def make():
        s = scanner(ranks_path or public_tokenizers.path(RANKS), chars_per_token)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            found = [s.spans(x) for x in texts]
            counts = [pa.array([sum(y[1] == k for y in more) for _, more in found], pa.int64()) for k in range(4)]
            columns = [batch.column("doc_id"), *counts[:3], pa.array([hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([shown(more) for _, more in found], pa.string()), counts[3], pa.array([[x[a:b] for a, _, b in more] for x, (_, more) in zip(texts, found, strict=True)], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random", "values"])

        return f

    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, schema)


def mask_secrets(docs: DataFrame, chars_per_token: float = CHARS_PER_TOKEN, ranks_path: str | None = None, mask: str = MASK) -> DataFrame:
    """docs, with all columns, and each secret of text replaced by a mask; null stays null, a text without secrets as it is."""

    def make():
        s = scanner(ranks_path or public_tokenizers.path(RANKS), chars_per_token)
        return lambda x: masked(x, s.spans(x)[1], mask) if x else x

    return arrow_replace(docs, "text", make)
