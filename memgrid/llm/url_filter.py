"""Operator 6 [native]: URL filters by rules and a ratio of character language models.

URLs that a rule allows and URLs that a rule blocks each train a character model over a small
alphabet that URLs are folded to. Its order varies: a context of two characters is mixed with the
shorter ones by how many different characters followed it (Witten-Bell), and one that was never
seen hands over to them. The alphabet bounds the model, however many URLs there are: one number
for each of A^3 trigrams, the difference of the two models' log probabilities. A URL's mean over
its trigrams adds up in the task that has its row, so it is no burden that URLs repeat. Calibration
is cross-fitted: each half
of the training URLs (by a hash of the URL, so copies stay together) is scored by models of the
other half; the score is the posterior of two normal distributions with those means, their common
variance and the classes' shares. From 0.5 on a URL is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memgrid.llm.common import written

#: The first symbol pads, `0` stands for every digit, the last for every other character.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0/.-_?=&#%:~"
A = len(ALPHABET)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        return ((F.col("host") == self.host) | F.col("host").endswith("." + self.host)) & F.col("path").startswith(self.path)


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    df = pages.select("page_id", "url", F.coalesce(rest, F.lit("")).alias("rest"))
    host = F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER)
    return df.select("page_id", "url", host.alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def longest(rules: tuple[Rule, ...], value: str) -> Column:
    out = F
    for r in sorted(rules, key=lambda r: -len(r.text)):
        out = out.when(r.fits(), getattr(r, value))
    return out.otherwise(None)


def trigrams(url: str = "url") -> Column:
    """Codes of the trigrams of a padded, folded URL."""
    folded = f"concat('^^', regexp_replace(regexp_replace(lower({url}), '[0-9]', '0'), '[^a-z0/._?=&#%:\\\\-]', '~'), '^')"
    codes = f"transform(split({folded}, ''), c -> locate(c, '{ALPHABET}') - 1)"
    return F.expr(f"transform(array({codes}), x -> transform(sequence(0, size(x) - 3), i -> (x[i] * {A} + x[i + 1]) * {A} + x[i + 2]))[0]")


def fold(url: str = "url") -> str:
    """SQL for the half, 0 or 1, that a URL is in."""
    return f"(CASE WHEN substr(md5({url}), 1, 1) < '8' THEN 0 ELSE 1 END)"


def _log_ratio(y1: str, y0: str) -> str:
    """SQL for the difference of log probabilities from the counts that _sums() adds."""
    p = {}
    for y in (y1, y0):
        p1 = f"((c_{y} + tn_{y} / {A}D) / nullif(n_{y} + tn_{y}, 0))"
        p2 = f"(CASE WHEN b_{y} = 0 THEN {p1} ELSE (bc_{y} + tb_{y} * {p1}) / (b_{y} + tb_{y}) END)"
        p[y] = f"(CASE WHEN ab_{y} = 0 THEN {p2} ELSE ({y} + tab_{y} * {p2}) / (ab_{y} + tab_{y}) END)"
    return f"coalesce(ln({p[y1]}) - ln({p[y0]}), 0D)"


def models(training: DataFrame) -> DataFrame:
    """id, both, half0, half1: for each of A^3 trigrams differences of log probabilities.

    training: codes, good (boolean), half (0 or 1). half0 is for URLs of half 0, so it is learned from half 1.
    """
    spark = training.sparkSession
    kinds = ("g0", "g1", "h0", "h1")  # good and bad counts of each half
    of = {f"{k}{h}": (F.col("good") if k == "g" else ~F.col("good")) & (F.col("half") == h) for k in "gh" for h in (0, 1)}
    counts = training.select("good", "half", F.explode("codes").alias("id")).groupBy("id").agg(*[F.count_if(c).alias(k) for k, c in of.items()])
    grid = spark.range(A**3).select(F.col("id").cast("int").alias("id")).join(counts, "id", "left").na.fill(0).coalesce(1)
    grid = grid.selectExpr("id", *kinds, "g0 + g1 g", "h0 + h1 h", f"id div {A * A} a", f"(id div {A}) % {A} b", f"id % {A} c")
    # the grid has A^3 rows whatever the input; what a window needs is made in the step before
    ys = (*kinds, "g", "h")
    grid = grid.selectExpr("*", *[f"sum({y}) over (partition by a, b) ab_{y}" for y in ys], *[f"count_if({y} > 0) over (partition by a, b) tab_{y}" for y in ys], *[f"sum({y}) over (partition by b, c) bc_{y}" for y in ys])
    grid = grid.selectExpr("*", *[f"sum({y}) over (partition by b) b_{y}" for y in ys], *[f"count_if(bc_{y} > 0) over (partition by b) div {A} tb_{y}" for y in ys], *[f"sum({y}) over (partition by c) c_{y}" for y in ys])
    grid = grid.selectExpr("*", *[f"sum({y}) over () n_{y}" for y in ys], *[f"count_if(c_{y} > 0) over () div {A * A} tn_{y}" for y in ys])
    v = grid.selectExpr("id", f"{_log_ratio('g', 'h')} both", f"{_log_ratio('g1', 'h1')} half0", f"{_log_ratio('g0', 'h0')} half1")
    return v


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score; a row for each row of pages.

    pages: page_id, url (other columns are not read). Host: after the first `://` up to `/`, `?`, `#`
    or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end; both empty without
    `://` or for null. The longest rule that fits decides, else the score (block below 0.5). A null
    url has score 0. If no URL, or only one kind of URL, is decided by rules, each other score is
    0.5. Repeated urls count as often as they come, and have the same score.
    """
    df = parsed(pages.select("page_id", "url")).select("*", longest(rules, "text").alias("rule"), longest(rules, "verdict").alias("ruled"), F.expr(fold()).alias("half"))
    training = df.where("ruled is not null and url is not null").select((F.col("ruled") == "allow").alias("good"), "half", trigrams().alias("codes"))
    # a number for each row: no two rows meet under one key, and no row has to be found again
    rows = df.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", "rule", "ruled", F.col("url").isNull().alias("none"), "half", "url")
    rows = rows.select("row", "page_id", "host", "path", "rule", "ruled", "none", "half", F.explode_outer(trigrams()).alias("id"))
    keys = ("row", "page_id", "host", "path", "rule", "ruled", "none")
    # the models have A^3 rows whatever the input, so they may be broadcast
    means = rows.join(F.broadcast(models(training)), "id", "left").groupBy(*keys).agg(F.avg("both").alias("m"), F.avg(F.when(F.col("half") == 0, F.col("half0")).otherwise(F.col("half1"))).alias("held"))
    means = written(means, "url-means")
    held = means.where("ruled is not null and not none")
    of = lambda good, f: f(F.when((F.col("ruled") == "allow") == good, F.col("held")))
    fit = held.groupBy().agg(of(True, F.avg).alias("m1"), of(False, F.avg).alias("m0"), of(True, F.count).alias("n1"), of(False, F.count).alias("n0"), of(True, F.var_pop).alias("v1"), of(False, F.var_pop).alias("v0"))
    fit = fit.withColumn("v", (F.col("n1") * F.col("v1") + F.col("n0") * F.col("v0")) / F.nullif(F.col("n1") + F.col("n0"), F.lit(0)))
    slope = (F.col("m1") - F.col("m0")) / F.col("v")
    line = F.struct(slope.alias("slope"), (F.ln(F.col("n1") / F.col("n0")) - slope * (F.col("m1") + F.col("m0")) / 2).alias("bias"))
    fit = fit.select(F.when((F.col("v") > 0) & (F.col("m1") > F.col("m0")), line).otherwise(F.struct(F.lit(0.0).alias("slope"), F.lit(0.0).alias("bias"))).alias("fit")).scalar()
    score = F.when(F.col("none"), 0.0).otherwise(1 / (1 + F.exp(-(F.col("m") * fit["slope"] + fit["bias"]))))
    df = means.select("page_id", "host", "path", "rule", "ruled", F.round(score, 9).alias("score"))
    return df.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "allow").otherwise("block")).alias("verdict"), "score")


def _oracle() -> str:
    """The same in DuckDB's SQL; without the score, whose last digits depend on the order of sums."""
    fits = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{}}'".replace("{}", f"{r.verdict} {r.text}") for r in sorted(RULES, key=lambda r: -len(r.text)))
    ys = ("g0", "g1", "h0", "h1", "g", "h")
    each = lambda f: ", ".join(f.replace("#", y) for y in ys)

    def ratio(y1: str, y0: str) -> str:
        p = []
        for y in (y1, y0):
            p1 = f"((c_{y} + tn_{y} / CAST({A} AS DOUBLE)) / nullif(n_{y} + tn_{y}, 0))"
            p2 = f"if(b_{y} = 0, {p1}, (bc_{y} + tb_{y} * {p1}) / (b_{y} + tb_{y}))"
            p.append(f"ln(if(ab_{y} = 0, {p2}, ({y} + tab_{y} * {p2}) / (ab_{y} + tab_{y})))")
        return f"coalesce({p[0]} - {p[1]}, 0)"

    return rf"""
WITH u AS (SELECT page_id, url, row_number() OVER () AS r, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, r, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT *, CASE {fits} END AS f, CASE WHEN substr(md5(url), 1, 1) < '8' THEN 0 ELSE 1 END AS half FROM h),
s AS (SELECT r, f, half, '^^' || regexp_replace(regexp_replace(lower(url), '[0-9]', '0', 'g'), '[^a-z0/._?=&#%:\-]', '~', 'g') || '^' AS x FROM d WHERE url IS NOT NULL),
g AS (SELECT r, f, half, (strpos('{ALPHABET}', x[i]) - 1) * {A * A} + (strpos('{ALPHABET}', x[i + 1]) - 1) * {A} + strpos('{ALPHABET}', x[i + 2]) - 1 AS id
  FROM s, LATERAL (SELECT unnest(range(1, length(x) - 1)) AS i)),
n AS (SELECT id, {", ".join(f"count(*) FILTER (f LIKE '{v}%' AND half = {h}) AS {k}{h}" for k, v in (("g", "allow"), ("h", "block")) for h in (0, 1))} FROM g WHERE f IS NOT NULL GROUP BY id),
m AS (SELECT *, g0 + g1 AS g, h0 + h1 AS h FROM (SELECT range AS id, {", ".join(f"coalesce({y}, 0) AS {y}" for y in ys[:4])}, range // {A * A} AS a, (range // {A}) % {A} AS b, range % {A} AS c FROM range({A**3}) LEFT JOIN n ON id = range)),
m1 AS (SELECT *, {each("sum(#) OVER (PARTITION BY a, b) AS ab_#, count(*) FILTER (# > 0) OVER (PARTITION BY a, b) AS tab_#, sum(#) OVER (PARTITION BY b, c) AS bc_#")} FROM m),
m2 AS (SELECT *, {each(f"sum(#) OVER (PARTITION BY b) AS b_#, count(*) FILTER (bc_# > 0) OVER (PARTITION BY b) // {A} AS tb_#, sum(#) OVER (PARTITION BY c) AS c_#")} FROM m1),
m3 AS (SELECT *, {each(f"sum(#) OVER () AS n_#, count(*) FILTER (c_# > 0) OVER () // {A * A} AS tn_#")} FROM m2),
v AS (SELECT id, {ratio("g", "h")} AS v, {ratio("g1", "h1")} AS v0, {ratio("g0", "h0")} AS v1 FROM m3),
e AS (SELECT r, f, avg(v) AS e, avg(CASE WHEN half = 0 THEN v0 ELSE v1 END) AS o FROM g JOIN v USING (id) GROUP BY r, f),
t AS (SELECT avg(o) FILTER (f LIKE 'allow%') AS m1, avg(o) FILTER (f LIKE 'block%') AS m0, count(*) FILTER (f LIKE 'allow%') AS n1, count(*) FILTER (f LIKE 'block%') AS n0, var_pop(o) FILTER (f LIKE 'allow%') AS v1, var_pop(o) FILTER (f LIKE 'block%') AS v0 FROM e WHERE f IS NOT NULL),
k AS (SELECT if(w > 0 AND m1 > m0, (m1 - m0) / w, 0) AS slope, if(w > 0 AND m1 > m0, ln(n1 / n0) - (m1 - m0) / w * (m1 + m0) / 2, 0) AS bias FROM (SELECT *, (n1 * v1 + n0 * v0) / nullif(n1 + n0, 0) AS w FROM t))
SELECT page_id, host, path, substr(d.f, 7) AS rule, CASE WHEN d.f IS NOT NULL THEN substr(d.f, 1, 5) WHEN e * slope + bias >= 0 THEN 'allow' ELSE 'block' END AS verdict
FROM d LEFT JOIN e ON e.r = d.r CROSS JOIN k
"""


ORACLE = _oracle()
