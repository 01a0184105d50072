"""Limits and guards around episodes: lesson caps, shards, prefixes, deferral."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memgrid.functions.knowledge import PROVENANCE
from memgrid.functions.text import once, sections

#: Words that a slug leaves out; kinds by how much they matter.
SLUG_STOPWORDS = (
    "a", "an", "the", "of", "to", "for", "and", "or", "in", "on", "at", "by", "is", "are", "be", "with", "via", "from", "into", "as", "that", "this",
    "it", "its", "when", "then", "than", "if", "but", "not", "no", "do", "does", "did", "can", "could", "should", "would", "will", "was", "were",
    "has", "have", "had", "also", "which", "who", "whom", "whose", "what", "how", "why", "where", "while", "during", "about", "after",
    "before", "between", "under", "over", "again", "further", "once", "here", "there", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "only", "own", "same", "so", "too", "very", "s", "t", "just", "don", "now",
)
PRIORITY = ("pitfall", "decision", "procedure", "fact")


def ascii_letters() -> tuple[str, str]:
    """Characters whose compatibility decomposition has one ASCII letter or digit, and those."""
    pairs = {}
    for i in range(0x80, 0x10000):
        base = [c for c in unicodedata.normalize("NFKD", chr(i)) if c.isascii()]
        if len(base) == 1 and base[0].isalnum():
            pairs[chr(i)] = base[0]
    return "".join(pairs), "".join(pairs.values())


def english_slug(title: Column) -> Column:
    """up to eight telling words and 48 characters; '' if fewer than two words or eight characters are left.

    Characters that do not come down to one of ASCII go, and do not part words.
    """
    a, b = ascii_letters()
    plain = F.lower(F.regexp_replace(F.translate(title, a, b), r"[^\x00-\x7F]+", ""))
    words = F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0))
    telling = F.filter(words, lambda w: ~w.isin(*SLUG_STOPWORDS) & ~F.rlike(w, F.lit(r"^\d+$")))
    chosen = F.when(F.size(telling) > 0, telling).otherwise(words)
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"), F.lit(False).alias("end"))

    def step(acc: Column, w: Column) -> Column:
        longer = F.when(acc["n"] == 0, w).otherwise(F.concat(acc["s"], F.lit("_"), w))
        end = acc["end"] | (acc["n"] >= 8) | (F.length(longer) > 48)
        return F.struct(F.when(end, acc["s"]).otherwise(longer).alias("s"), (acc["n"] + F.when(end, 0).otherwise(1)).alias("n"), end.alias("end"))

    return F.aggregate(chosen, start, step, lambda acc: F.when((acc["n"] < 2) | (F.length(acc["s"]) < 8), "").otherwise(acc["s"]))


def truncated(text: Column, budget: int) -> Column:
    """the longest prefix whose token estimate fits, one character at least."""

    @F.pandas_udf(T.StringType())
    def f(texts: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if not x:
                return x
            cp = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
            cjk = ((cp >= 0x3400) & (cp <= 0x4DBF)) | ((cp >= 0x4E00) & (cp <= 0x9FFF)) | ((cp >= 0x3040) & (cp <= 0x30FF)) | ((cp >= 0xAC00) & (cp <= 0xD7AF))
            c = np.cumsum(cjk)
            cost = c + (np.arange(1, len(cp) + 1) - c + 1) // 2
            return x[: max(1, int(np.searchsorted(cost, budget, side="right")))]

        return texts.map(one)

    return f(text)


def capped_lessons(lessons: Column, source_chars: Column, short: int = 1500, most: int = 3) -> Column:
    """Of a short episode's lessons (kind, evidence count n) the best-founded few, in their old order."""
    kind = lambda x: F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), x["kind"]), F.lit(0))
    keyed = F.transform(lessons, lambda x, i: F.struct((-x["n"]).alias("a"), F.when(kind(x) == 0, 9).otherwise(kind(x)).alias("b"), i.alias("i")))
    keep = F.transform(F.slice(F.array_sort(keyed), 1, most), lambda k: k["i"])
    return F.when((source_chars >= short) | (F.size(lessons) <= most), lessons).otherwise(F.filter(lessons, lambda x, i: F.array_contains(keep, i)))


def shards(content: Column, limit: int | Column) -> Column:
    """Knowledge sections packed into shards of at most `limit` bytes; null where that can't be done.

    Provenance never stands alone (it is left out), nor does the takeaway; a section is never cut.
    """
    return packed(shard_blocks(content), limit)


def shard_blocks(content: Column) -> Column:
    """What shards are packed from: t, the text of a section, and real, whether it may stand alone."""
    kept = F.filter(sections(content), lambda s: ~F.lower(s["heading"]).isin(*PROVENANCE))
    return F.transform(kept, lambda s: F.struct(F.concat(F.lit("## "), s["heading"], F.lit("\n"), s["body"]).alias("t"), (F.lower(s["heading"]) != "takeaway").alias("real")))


def packed(blocks: Column, limit: int | Column) -> Column:
    """shards() of shard_blocks()."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(False).alias("real"), F.lit(False).alias("bad"))

    def pack(blocks: Column, limit: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            over = (acc["now"] != "") & (F.octet_length(acc["now"]) + 2 + F.octet_length(x["t"]) > limit)
            bad = acc["bad"] | (F.octet_length(x["t"]) > limit) | (over & ~acc["real"])
            now = F.when(over | (acc["now"] == ""), x["t"]).otherwise(F.concat(acc["now"], F.lit("\n\n"), x["t"]))
            return F.struct(F.when(over, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), now.alias("now"), (x["real"] | (acc["real"] & ~over)).alias("real"), bad.alias("bad"))

        out = F.aggregate(blocks, start, step, lambda acc: F.when(acc["bad"] | ~acc["real"], None).otherwise(F.concat(acc["done"], F.array(acc["now"]))))
        return F.when(F.size(F.filter(blocks, lambda x: x["real"])) >= 2, once(out, lambda x: F.when(F.size(x) > 1, x)))

    return once(F.struct(blocks.alias("blocks"), (F.lit(limit) if isinstance(limit, int) else limit).alias("limit")), lambda v: pack(v["blocks"], v["limit"]))


def prefix_kept(content: Column, first_pending: Column, previous_hash: Column) -> Column:
    """whether what comes before the first pending turn is what was hashed last time."""
    prefix = F.call_function("regexp_extract", content, F.concat(F.lit(r"(?s)\A(.*?)(?=(?m:^## T"), first_pending.cast("string"), F.lit(r" (?:User|Assistant)[ \t]*$))")), F.lit(1))
    there = F.rlike(content, F.concat(F.lit("(?m)^## T"), first_pending.cast("string"), F.lit(r" (?:User|Assistant)[ \t]*$")))
    same = (F.sha2(prefix, 256) == previous_hash) | (F.sha2(F.regexp_replace(prefix, r"\n+\z", ""), 256) == previous_hash)
    return F.coalesce(there & same, F.lit(False))


def deferred(turns: Column, chars: Column, content_hash: Column, deferred_hash: Column) -> Column:
    """Too short to distil yet, and it stays so until its content changes."""
    return (turns < 2) | (chars < 600) | F.coalesce(content_hash == deferred_hash, F.lit(False))


def update_ladder(ok: Column, merged_ok: Column, repaired_ok: Column) -> Column:
    """What an update ends as: itself, merged, repaired, or set aside."""
    return F.when(ok, "updated").when(merged_ok, "merged").when(repaired_ok, "repaired").otherwise("quarantined")


def stamped(current_hash: Column, seen_hash: Column, old_ids: Column, new_ids: Column) -> Column:
    """The ids produced so far with new ones, if the content is still what was read; else null."""
    return F.when(current_hash == seen_hash, F.array_distinct(F.concat(old_ids, new_ids)))
