"""Operator 10 [native]: quality rules as a short-circuit cascade.

Each rule is a condition under which a text is rejected. On a sample, each rule's run time and the
share that it rejects are measured; the rules are then tried in the order of rejection per cost,
and a CASE stops at the first that rejects: what later rules alone need is never worked out for
that text. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memgrid.llm.common import WORD, written

#: Rows (about) of the sample that costs and selectivities are estimated on; it decides on the order only.
SAMPLE_ROWS = 512
#: Times that a condition is tried on each row of the sample in one run, and runs.
TIMES, REPEATS = 4, 2

#: Counts of a text; `t` is the text with null as empty, `w` its words.
COUNTS = {
    "n_words": "size(w)",
    "word_chars": "char_length(array_join(w, ''))",
    "n_symbols": "regexp_count(t, '[#*$%&|<>]')",
    "n_lines": f"size(filter(split(t, '\\n'), x -> x rlike r'{WORD}'))",
    "n_dup_lines": f"transform(array(filter(split(t, '\\n'), x -> x rlike r'{WORD}')), x -> size(x) - size(array_distinct(x)))[0]",
    # Words in windows of five that occur twice: hash each window; if some hash repeats, sort
    # (hash, place), keep places whose neighbour has the same hash, and add up what they cover.
    "n_repeat_words": """CASE WHEN size(w) < 6 THEN 0 ELSE
        transform(array(transform(w, x -> xxhash64(x))), v -> transform(array(transform(slice(v, 1, size(v) - 4), (x, i) -> xxhash64(x, v[i + 1], v[i + 2], v[i + 3], v[i + 4]))), h -> CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE
            transform(array(array_sort(transform(h, (x, i) -> struct(x, i)))), s ->
                transform(array(array_sort(filter(transform(s, (e, k) -> CASE WHEN get(s, k - 1).x = e.x OR get(s, k + 1).x = e.x THEN e.i END), p -> p IS NOT NULL))), p ->
                    aggregate(transform(p, (q, k) -> least(5, coalesce(get(p, k + 1), q + 5) - q)), 0, (a, b) -> a + b))[0])[0]
        END)[0])[0] END""",
    "n_alpha_words": "size(filter(w, x -> x rlike '\\\\p{L}'))",
    "n_upper": "regexp_count(t, '\\\\p{Lu}')",
    "n_letters": "char_length(regexp_replace(t, '\\\\P{L}+', ''))",
}


@dataclass(frozen=True)
class Rule:
    name: str
    counts: tuple[str, ...]
    rejects: str


#: Whole numbers only, so that every engine agrees.
RULES = (
    Rule("few_words", ("n_words",), "n_words < 10"),
    Rule("repeats", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), "100 * n_symbols > 10 * n_words"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("same_lines", ("n_lines", "n_dup_lines"), "100 * n_dup_lines > 30 * n_lines"),
    Rule("no_letters", ("n_words", "n_alpha_words"), "100 * n_alpha_words < 70 * n_words"),
    Rule("shouting", ("n_upper", "n_letters"), "100 * n_upper > 60 * n_letters"),
)
BASE = ("few_words", "repeats")
#: Counts that are returned unless others are asked for.
REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_counts(docs: DataFrame, names: tuple[str, ...] = tuple(COUNTS)) -> DataFrame:
    """doc_id and the counts named, as long; a null text counts as empty."""
    # text and words are bound as lambda arguments, so that words are extracted once for a text
    fields = ", ".join(f"'{n}', cast({COUNTS[n]} as bigint)" for n in names)
    bound = f"transform(array(coalesce(text, '')), t -> transform(array(regexp_extract_all(t, r'{WORD}', 0)), w -> named_struct({fields}))[0])[0]"
    return docs.select("doc_id", F.expr(bound).alias("counts")).select("doc_id", "counts.*")


def _rejects(rule: Rule, ready: tuple[str, ...]) -> str:
    """SQL for a rule's condition over t, w and the ready counts c; other counts are worked out in place."""
    return re.sub("|".join(rf"\b{n}\b" for n in rule.counts), lambda m: f"c.{m[0]}" if m[0] in ready else f"({COUNTS[m[0]]})", rule.rejects) if rule.counts else rule.rejects


def _counted(names: tuple[str, ...]) -> str:
    return f"named_struct({', '.join(f"'{n}', cast({COUNTS[n]} as bigint)" for n in names)})"


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, report: tuple[str, ...] = REPORT, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """rules by the share of a sample that they reject per second that they cost.

    The sample is drawn from the whole table, each row with the same chance. What a rule costs is the time that its
    condition takes once the reported counts are there, since those are paid for anyway: the best of
    REPEATS runs after one to warm up, less what the same run without a condition takes. The order
    decides on cost only.
    """
    total = docs.count()
    if not total or len(rules) < 2:
        return list(rules)
    rows = docs.sample(fraction=min(1.0, sample_rows / total), seed=7).selectExpr("coalesce(text, '') t").selectExpr("t", f"regexp_extract_all(t, r'{WORD}', 0) w").selectExpr("*", f"{_counted(report)} c")
    sample = written(rows.repartition(1), "sample")
    n = sample.count()
    if not n:
        return list(rules)

    def measured(condition: str) -> tuple[float, int]:
        """Seconds, and the rows that the condition holds for."""
        again = f"sum(aggregate(sequence(1, {TIMES}), 0, (a, k) -> a + CASE WHEN {condition} THEN 1 ELSE 0 END))"
        best = float("inf")
        for run in range(1 + REPEATS):
            began = time.perf_counter()
            hits = sample.selectExpr(f"{again} hits").first().hits
            if run:
                best = min(best, time.perf_counter() - began)
        return best, hits // TIMES

    idle, _ = measured("false")
    value = {}
    for r in rules:
        seconds, hits = measured(_rejects(r, report))
        value[r.name] = (hits + 0.5) / n / max(seconds - idle, 0.02 * idle)
    return sorted(rules, key=lambda r: -value[r.name])


def cascade(rules: list[Rule], ready: tuple[str, ...]) -> str:
    """SQL for the name of the first rule that rejects; a later rule's own counts are in its branch of the CASE, so they are worked out for texts only that get there."""
    return f"CASE {' '.join(f"WHEN {_rejects(r, ready)} THEN '{r.name}'" for r in rules)} END" if rules else "cast(NULL as string)"


def verdict(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, in the order given, or null; over columns with all the counts."""
    out = F
    for r in rules:
        out = out.when(F.expr(r.rejects), r.name)
    return out.otherwise(None) if rules else F.lit(None).cast("string")


def judged(docs: DataFrame, order: list[Rule], report: tuple[str, ...] = REPORT) -> DataFrame:
    """judge() with the rules tried in the order given."""
    inner = f"named_struct('c', c, 'failed_rule', {cascade(order, report)})"
    # text, words and the reported counts are bound as lambda arguments, so that each is worked out once
    bound = f"transform(array(coalesce(text, '')), t -> transform(array(regexp_extract_all(t, r'{WORD}', 0)), w -> transform(array({_counted(report)}), c -> {inner})[0])[0])[0]"
    return docs.select("doc_id", F.expr(bound).alias("j")).select("doc_id", "j.c.*", "j.failed_rule").withColumn("kept", F.col("failed_rule").isNull())


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, report: tuple[str, ...] = REPORT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the counts to report, failed_rule, kept; a row for each row of docs.

    docs: doc_id, text (other columns are not read). A null text counts as empty and has no words,
    so it fails `few_words`. The counts to report (at least one) are worked out for each text; what
    else a rule needs only if no rule before it rejects. failed_rule is the first in the order
    tried, which is measured; kept doesn't depend on it. Word windows are compared by 64-bit hash
    within one text. Repeated rows give repeated results.
    """
    return judged(docs, ordered(docs, rules, report, sample_rows), report)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, list_slice(w, i, i + 4) AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i) WHERE len(w) > 5),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
n AS (SELECT r, sum(least(5, coalesce(nxt, i + 5) - i)) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM p) GROUP BY r),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS BIGINT) AS n_alpha_words,
  CAST(length(regexp_replace(t, '\P{Lu}', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(t, '\P{L}', '', 'g')) AS BIGINT) AS n_letters
  FROM l LEFT JOIN n USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 30 * n_lines
    OR 100 * n_alpha_words < 70 * n_words OR 100 * n_upper > 60 * n_letters) AS kept
FROM b
"""
