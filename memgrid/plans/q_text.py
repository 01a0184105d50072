"""Queries on text functions; where documents lack a feature (links, headings, CJK), it is written into them."""

from __future__ import annotations

from pyspark.sql import functions as F

from memgrid.functions import folds, knowledge as K, text as T
from memgrid.plans.catalog import query
from memgrid.sources.logical import sql

CJK = "一-鿿"


@query(sql(f"SELECT seq, CAST(len(regexp_extract_all(content, '[A-Za-z0-9]+(?:[''_-][A-Za-z0-9]+)*')) + len(regexp_extract_all(content, '[{CJK}]')) AS INTEGER) AS words FROM nodes"))
def word_count(t):
    return t.nodes().select("seq", T.word_count(F.col("content")).alias("words"))


@query(sql(f"SELECT seq, w AS words, 3500 AS \"limit\", w <= 3500 AS within, greatest(w - 3500, 0) AS overage FROM (SELECT seq, CAST(len(regexp_extract_all(content, '[A-Za-z0-9]+(?:[''_-][A-Za-z0-9]+)*')) + len(regexp_extract_all(content, '[{CJK}]')) AS INTEGER) AS w FROM nodes)"))
def word_limits(t):
    return t.texts().select("seq", T.word_check(F.col("content")).alias("c")).select("seq", "c.*")


_MIX = "CASE seq % 3 WHEN 0 THEN concat(content, '数据库连接') WHEN 1 THEN concat('全部是中文字 ', content, ' a数b') ELSE content END"


@query(sql(f"SELECT seq, round(length(regexp_replace(x, '[^{CJK}぀-ヿ]', '', 'g')) / nullif(length(x), 0), 4) AS ratio FROM (SELECT seq, {_MIX} AS x FROM nodes)"))
def cjk_ratio(t):
    return t.nodes().select("seq", T.cjk_ratio(F.expr(_MIX)).alias("ratio"))


@query(sql(f"SELECT seq, CAST(c + ceil((length(x) - c) / 2) AS BIGINT) AS estimate FROM (SELECT seq, x, len(regexp_extract_all(x, '[㐀-䶿一-鿿぀-ヿ가-힯]')) AS c FROM (SELECT seq, {_MIX} AS x FROM nodes))"))
def token_estimate(t):
    return t.nodes().select("seq", T.token_estimate(F.expr(_MIX)).alias("estimate"))


@query(sql("SELECT seq, sha256(CASE seq % 3 WHEN 0 THEN concat(content, '数据 据库 库连 连接') WHEN 1 THEN concat('全部 部是 是中 中文 文字 ', content, ' a数b') ELSE content END) AS digest FROM nodes"))
def cjk_bigrams(t):
    return t.nodes().select("seq", F.sha2(T.cjk_bigrams(F.expr(_MIX)), 256).alias("digest"))


@query(sql("SELECT a, b, round(coalesce(k / nullif(len(x) + len(y) - k, 0), 0), 6) AS jaccard FROM (SELECT p.seq AS a, q.seq AS b, list_distinct(regexp_extract_all(lower(p.content), '[a-z0-9]{2,}')) AS x, list_distinct(regexp_extract_all(lower(q.content), '[a-z0-9]{2,}')) AS y, len(list_intersect(x, y)) AS k FROM nodes p JOIN nodes q ON q.seq = p.seq + 1)"))
def token_jaccard(t):
    a = t.nodes().select(F.col("seq").alias("a"), T.token_set(F.col("content")).alias("x"))
    b = t.nodes().select((F.col("seq") - 1).alias("a"), F.col("seq").alias("b"), T.token_set(F.col("content")).alias("y"))
    return a.join(b, "a").select("a", "b", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


#: What is written behind every fifth node's text, and what it must become, one for each rule.
_LEAKS = (
    ("key sk-0123456789abcdef0123456789abcdef", "key [REDACTED_API_KEY]"),
    ("mail me@x.org", "mail [REDACTED_EMAIL]"),
    ("host 10.20.30.40", "host [REDACTED_IP]"),
    ("run 123e4567-e89b-12d3-a456-426614174000", "run [REDACTED_UUID]"),
    ("with eyJhbGciOiJI.eyJzdWIiOiIx.sig_1", "with [REDACTED_JWT]"),
    ("APP_TOKEN: opaque1234567890abcd", "APP_TOKEN: [REDACTED_SECRET]"),
    ("Bearer abcdefghijklmnop1234", "Bearer [REDACTED_SECRET]"),
    ("-----BEGIN PRIVATE KEY-----\nMII\n-----END PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    ("pg://app:s3cr3t@db", "pg://app:[REDACTED_CREDENTIAL]@db"),
    ("pwd = hunter2", "pwd = [REDACTED_CREDENTIAL]"),
    ("Basic abcdefghijkl", "Basic [REDACTED_CREDENTIAL]"),
)


def _quoted(x: str) -> str:
    return "'" + x.replace("\n", "' || chr(10) || '") + "'"


def _leaking(t):
    """Nodes whose text ends in leaks; the text before a blank line is the documents' own."""
    tail = F.element_at(F.array(*[F.lit(a) for a, _ in _LEAKS]), (F.col("seq") % len(_LEAKS) + 1).cast("int"))
    return t.nodes().select("seq", F.concat(F.lit("a "), F.regexp_replace("content", r"[^\p{L}\n]+", " "), F.lit("\n\n"), tail).alias("content"))


_TAILS = "CASE seq % 11 " + " ".join(f"WHEN {i} THEN {_quoted(b)}" for i, (_, b) in enumerate(_LEAKS)) + " END"


@query(sql(f"SELECT seq, sha256('a ' || regexp_replace(content, '[^\\p{{L}}\\n]+', ' ', 'g') || chr(10) || chr(10) || {_TAILS}) AS digest FROM nodes"))
def redact_text(t):
    """the documents' words, which hold nothing to redact, and one leak each."""
    return _leaking(t).select("seq", F.sha2(T.redacted(F.col("content")), 256).alias("digest"))


_LABELS = ("api_key", "email", "ip", "uuid", "jwt", "secret_assignment", "authorization", "private_key_block", "url_password", "credential_assignment", "credential_bearer")


@query(sql("SELECT " + ", ".join(f"count(*) FILTER (seq % 11 = {i}) AS {x}" for i, x in enumerate(_LABELS)) + " FROM nodes"))
def redaction_counts(t):
    counts = _leaking(t).select(*T.redaction_counts(F.col("content")))
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns])


@query(sql("SELECT seq, sha256('a ' || w || CASE seq % 4 WHEN 0 THEN ' CLIENT_SECRET=[REDACTED_CREDENTIAL] at 10.0.0.1' WHEN 1 THEN chr(10) || 'stringData:' || chr(10) || '  blob: [REDACTED_CREDENTIAL]' || chr(10) || '  name: svc' WHEN 2 THEN ' password=<yours> me@x.org' ELSE '' END) AS digest FROM (SELECT seq, regexp_replace(content, '[^\\p{L}\\n]+', ' ', 'g') AS w FROM nodes)".replace("\\\\", "\\")))
def scrub_credentials(t):
    """credentials and secret values of a manifest go, addresses and placeholders stay."""
    tail = F.when(F.col("seq") % 4 == 0, " CLIENT_SECRET=3gKp9xQ2 at 10.0.0.1").when(F.col("seq") % 4 == 1, "\nstringData:\n  blob: QUJDREVGR0hJSktMTU5P\n  name: svc").when(F.col("seq") % 4 == 2, " password=<yours> me@x.org").otherwise("")
    text = F.concat(F.lit("a "), F.regexp_replace("content", r"[^\p{L}\n]+", " "), tail)
    return t.nodes().select("seq", F.sha2(T.scrubbed(text), 256).alias("digest"))


@query("SELECT event_id, CASE WHEN user_id % 3 > 0 THEN left(sha1(CAST(user_id AS VARCHAR)), 12) END AS hash FROM events")
def session_hash(t):
    key = F.expr("CASE WHEN user_id % 3 > 0 THEN concat('  ', cast(user_id as string), ' ') ELSE '   ' END")
    return t.raw("events").select("event_id", T.session_hash(key).alias("hash"))


@query(sql("SELECT seq, CASE WHEN length(l) > 40 THEN rtrim(left(l, 39)) || '…' ELSE l END AS title FROM (SELECT seq, trim(split_part(trim(content), chr(10), 1)) AS l FROM nodes)"))
def short_titles(t):
    return t.nodes().select("seq", T.short(F.col("content"), 40).alias("title"))


@query(sql(r"SELECT seq, regexp_replace(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), '^$', '') AS slug, CASE WHEN length(u) >= 3 THEN 'mem_' || strftime(created_at, '%Y%m%d') || '_' || rtrim(left(u, 48), '_') ELSE 'node_' || left(sha1(title), 10) END AS id FROM (SELECT seq, title, created_at, trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') AS u FROM nodes)"))
def slugs(t):
    return t.nodes().select("seq", T.kebab(F.col("title")).alias("slug"), T.knowledge_id(F.col("title"), F.col("created_at")).alias("id"))


_BODY = r"concat('## Takeaway\n', content, '\n\n', CASE seq % 6 WHEN 0 THEN '## Context\nc\n## Decision\nd\n## Consequences\n\n' WHEN 1 THEN '## Details\nx 12 ms\n' WHEN 2 THEN '## Steps\n1. run /usr/bin/x1\n' WHEN 3 THEN '## Symptom\ns\n## Cause\nc\n## Fix\nf\n' ELSE '## Details\n## Details\ny\n' END, CASE WHEN seq % 5 > 0 THEN '## Sources\n- mem_1\n' ELSE '' END)"
_LINES = "list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')"
_CODES = (
    "CASE WHEN seq % 6 > 3 THEN 'okf_duplicate_section' END",
    "CASE WHEN regexp_matches(lower(trim(title)), '^(procedure|decision|fact|pitfall|note|summary):') THEN 'okf_title_type_prefix' END",
    "CASE WHEN seq % 6 = 5 THEN 'okf_missing_type' END",
    "CASE WHEN seq % 4 > 1 THEN 'okf_unresolvable_source' END",
    f"CASE WHEN len({_LINES}) <> 1 OR length({_LINES}[1]) > 200 THEN 'okf_takeaway_invalid' END",
    "CASE WHEN seq % 5 = 0 THEN 'okf_missing_section:Sources' END",
    "CASE WHEN seq % 6 = 0 THEN 'okf_missing_section:Consequences' END",
    "CASE WHEN seq % 6 = 4 THEN 'okf_missing_section:Details' END",
)


@query(sql(f"SELECT seq, array_to_string(list_sort(list_filter([{', '.join(_CODES)}], lambda x: x IS NOT NULL)), ',') AS codes, CASE seq % 6 WHEN 0 THEN 'decision' WHEN 2 THEN 'procedure' WHEN 3 THEN 'pitfall' ELSE 'fact' END AS inferred FROM nodes"))
def okf_validate(t):
    df = t.nodes().select("seq", "title", "okf_type", "sources", F.expr(_BODY).alias("body"))
    return df.select("seq", F.array_join(K.validation_codes(F.col("title"), F.col("body"), F.col("okf_type"), F.col("sources")), ",").alias("codes"), K.inferred_type(F.col("body")).alias("inferred"))


_WORDS = "regexp_replace(content, '[^a-zA-Z]+', ' ', 'g')"
_OLD = r"concat('# N', seq, '\n\n## Takeaway\n\nT.\n\n## Details\n\n- ', w, '\n- common ', seq % 3, '.\n\n## Sources\n\n- mem_1\n')"
_NEW = r"concat('## Takeaway\n\nother\n\n## Details\n\n* Common ', seq % 2, '.\n- NEW ', seq, '.\n- ', upper(w), '\n\n## Sources\n\n- mem_1\n- mem_', seq + 2, '\n')"


@query(sql(f"SELECT seq, sha256(concat('# N', seq, n, n, '## Takeaway', n, n, 'T.', n, n, '## Details', n, n, '- ', w, n, '- common ', seq % 3, '.', n, n, CASE WHEN seq % 2 <> seq % 3 THEN concat('* Common ', seq % 2, '.', n) ELSE '' END, '- NEW ', seq, '.', n, '## Sources', n, n, '- mem_1', n, n, '- mem_', seq + 2)) AS digest, 0 AS lost FROM (SELECT seq, chr(10) AS n, concat('z', {_WORDS}, 'z') AS w FROM nodes)"))
def section_merge(t):
    """a note that says the same again, and something new."""
    df = t.nodes().select("seq", F.concat(F.lit("z"), F.regexp_replace("content", "[^a-zA-Z]+", " "), F.lit("z")).alias("w")).select("seq", F.expr(_OLD).alias("old"), F.expr(_NEW).alias("new"))
    df = df.select("seq", "old", K.merged(F.col("old"), F.col("new")).alias("m"))
    return df.select("seq", F.sha2("m", 256).alias("digest"), F.size(K.omitted_lines(F.col("old"), F.col("m"))).alias("lost"))


@query(sql(f"SELECT seq, array_to_string(list_sort(['/opt/r' || seq || '/x.conf', '--flag_' || seq, 'parsehtml' || seq, CAST(seq AS VARCHAR) || ' seconds', CAST(seq AS VARCHAR), 'opt/r' || seq || '/x.conf']), ' ') AS anchors, CAST(1 AS INTEGER) AS missing FROM nodes".replace("'--flag_' || seq", "'flag_' || seq")))
def anchors(t):
    """The documents' words and six literals, of which a rewrite keeps all but the flag."""
    w = F.regexp_replace(F.lower(F.regexp_replace("content", "[^a-zA-Z]+", " ")), r"\s+", " ")
    body = F.concat(F.lit("## Details\n- "), w, F.expr("concat(' waits ', seq, ' seconds for /opt/r', seq, '/x.conf, `flag_', seq, '` and parseHtml', seq, '\n## Sources\n- mem_77\n')"))
    kept = F.expr("concat('in ', seq, ' SECONDS: parsehtml', seq, ' reads /opt/r', seq, '/x.conf (flag)')")
    df = t.nodes().select("seq", body.alias("body"), kept.alias("kept"))
    return df.select("seq", F.array_join(K.anchors(F.col("body")), " ").alias("anchors"), F.size(K.missing_anchors(F.col("body"), F.col("kept"))).alias("missing"))


@query(sql(f"SELECT seq, CASE WHEN length(l) > 180 THEN left(l, 179) || '…' ELSE l END AS summary FROM (SELECT seq, CASE WHEN seq % 2 = 0 THEN 'in code' ELSE rtrim('z' || {_WORDS}) END AS l FROM nodes)"))
def summary_lines(t):
    """F12."""
    w = F.concat(F.lit("z"), F.regexp_replace("content", "[^a-zA-Z]+", " "))
    text = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("# Head\n---\n```sh\nuser:\nin code\n```\n"), w)).otherwise(F.concat(F.lit("<!-- c -->\n## T1 User\nassistant:\n2. "), w, F.lit("\nmore")))
    return t.nodes().select("seq", K.summary_line(text).alias("summary"))


_DOMAINS = [("own", ["zzz", "Mesh"]), ("grid", ["the", "und"])]


@query(sql("SELECT seq, CASE WHEN project IS NOT NULL THEN project WHEN contains(x, 'zzz') OR contains(x, 'mesh') THEN 'own' WHEN contains(x, 'the') OR contains(x, 'und') THEN 'grid' ELSE 'general' END AS project FROM (SELECT seq, CASE WHEN seq % 2 = 0 THEN project END AS project, lower(concat_ws(' ', node_id, title, content)) AS x FROM nodes)"))
def inferred_projects(t):
    """Half of the nodes by their text."""
    own = F.when(F.col("seq") % 2 == 0, F.col("project"))
    return t.nodes().select("seq", T.inferred_project(own, F.col("node_id"), F.col("title"), F.col("content"), _DOMAINS).alias("project"))


def _transcripts(t):
    block = F.concat(F.lit("## T"), (F.col("number") + 1).cast("string"), F.lit(" "), F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit("\n\n"), F.col("body"), F.when(F.col("number") % 2 == 1, "\n\n### Tool T1.1 read\ncall: cat x\nresult [ok]: 12: alpha beta\n13: gamma\n").otherwise("\n"))
    rows = t.turns().where("role <> 'system'").select("conv_id", F.struct("number", block.alias("b")).alias("x"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n").alias("text"))


@query(sql("SELECT conv_id, CAST(number + 1 AS INTEGER) AS number, CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END AS role, sha256(trim(body, ' ' || chr(10) || chr(9))) AS body, CAST(number % 2 AS INTEGER) AS tools FROM turns WHERE role <> 'system'"))
def transcript_parse(t):
    x = _transcripts(t).select("conv_id", F.explode(K.turns(F.col("text"))).alias("t"))
    return x.select("conv_id", "t.number", "t.role", F.sha2("t.body", 256).alias("body"), F.size("t.tools").alias("tools"))


@query(sql("SELECT conv_id, CAST(number + 1 AS INTEGER) AS number, role = 'user' AS from_body, role <> 'user' AND number % 2 = 1 AS from_tool FROM turns WHERE role <> 'system' AND length(trim(body)) > 0"))
def evidence_check(t):
    x = _transcripts(t).select("conv_id", F.explode(K.turns(F.col("text"))).alias("t"))
    text = K.evidence_text(F.col("t"), F.lit(False))
    return x.where(F.length(F.trim(F.col("t.body"))) > 0).select("conv_id", "t.number", K.verified(F.col("t.body"), text).alias("from_body"), K.verified(F.lit("ALPHA  beta gamma"), F.when(F.col("t.role") != "User", text)).alias("from_tool"))


@query(sql("SELECT conv_id, array_to_string(list(CASE WHEN length(body) > 350 THEN left(body, 347) || '...' ELSE body END ORDER BY number), chr(10)) AS spine FROM turns WHERE role = 'user' GROUP BY conv_id"))
def user_spine(t):
    return K.user_spine(t.turns())


_O = "o AS (SELECT conv_id, number, length(body) + 10 AS s, row_number() OVER (PARTITION BY conv_id ORDER BY number) AS i FROM turns)"


@query(sql("SELECT conv_id, number, CAST(chunk AS INTEGER) AS chunk FROM f", _O, "f AS (SELECT conv_id, number, i, s AS size, 0 AS chunk FROM o WHERE i = 1 UNION ALL SELECT o.conv_id, o.number, o.i, CASE WHEN f.size + o.s + 2 > 2000 THEN o.s ELSE f.size + o.s + 2 END, chunk + CASE WHEN f.size + o.s + 2 > 2000 THEN 1 ELSE 0 END FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)"))
def turn_chunks(t):
    df = t.turns().select("conv_id", F.struct("number", (F.length("body") + 10).alias("s")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    df = df.select("conv_id", F.arrays_zip(F.transform("x", lambda y: y["number"]).alias("number"), folds.chunks(F.transform("x", lambda y: y["s"]), 2000, 2).alias("chunk")).alias("z"))
    return df.select("conv_id", F.explode("z").alias("z")).select("conv_id", "z.number", "z.chunk")


@query(sql("SELECT conv_id, number, take FROM f", _O, "f AS (SELECT conv_id, number, i, s <= 1500 AS take, 1500 - CASE WHEN s <= 1500 THEN s ELSE 0 END AS rest FROM o WHERE i = 1 UNION ALL SELECT o.conv_id, o.number, o.i, o.s <= rest, rest - CASE WHEN o.s <= rest THEN o.s ELSE 0 END FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)"))
def budget_pack(t):
    df = t.turns().select("conv_id", F.struct("number", (F.length("body") + 10).cast("long").alias("s")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    df = df.select("conv_id", F.arrays_zip(F.transform("x", lambda y: y["number"]).alias("number"), folds.greedy_budget(F.transform("x", lambda y: y["s"]), 1500).alias("take")).alias("z"))
    return df.select("conv_id", F.explode("z").alias("z")).select("conv_id", "z.number", "z.take")


@query(sql("SELECT seq, CASE WHEN seq % 9 = 0 THEN left('hint ' || seq, 12) WHEN length(q) > 60 THEN rtrim(left(q, 59)) || '…' ELSE q END AS query FROM (SELECT seq, CASE WHEN seq % 2 = 0 THEN t WHEN l = '' THEN t ELSE t || ' — ' || l END AS q FROM (SELECT seq, 'T ' || seq AS t, trim(regexp_replace(string_split(w, chr(10))[1], '\\s+', ' ', 'g')) AS l FROM (SELECT seq, regexp_replace(content, '[^a-zA-Z\\n]+', ' ', 'g') AS w FROM nodes)))".replace("string_split(w, chr(10))[1]", "coalesce(list_filter(string_split(w, chr(10)), lambda x: trim(x) <> '')[1], '')")))
def write_queries(t):
    """every second note repeats its title in its first line."""
    w = F.regexp_replace("content", r"[^a-zA-Z\n]+", " ")
    title = F.concat(F.lit("T "), F.col("seq").cast("string"))
    text = F.when(F.col("seq") % 2 == 0, F.concat(F.lit(" \n t  "), F.col("seq").cast("string"), F.lit("\n"), w)).otherwise(w)
    hint = F.when(F.col("seq") % 9 == 0, F.concat(F.lit(" hint "), F.col("seq").cast("string")))
    return t.nodes().select("seq", T.write_query(title, text, hint, 60).alias("query"))


@query(sql("SELECT conv_id, number, CAST(batch AS INTEGER) AS batch FROM f", "o AS (SELECT conv_id, number, length(body) // 4 + 2 AS s, row_number() OVER (PARTITION BY conv_id ORDER BY number) AS i FROM turns)", "f AS (SELECT conv_id, number, i, s AS size, 1 AS n, 0 AS batch FROM o WHERE i = 1 UNION ALL SELECT o.conv_id, o.number, o.i, CASE WHEN f.size + o.s > 300 OR n >= 3 THEN o.s ELSE f.size + o.s END, CASE WHEN f.size + o.s > 300 OR n >= 3 THEN 1 ELSE n + 1 END, batch + CASE WHEN f.size + o.s > 300 OR n >= 3 THEN 1 ELSE 0 END FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)"))
def document_batches(t):
    """T10."""
    df = t.turns().select("conv_id", F.struct("number", F.expr("length(body) div 4").alias("s")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    df = df.select("conv_id", F.arrays_zip(F.transform("x", lambda y: y["number"]).alias("number"), folds.document_batches(F.transform("x", lambda y: y["s"]), 300, 3).alias("batch")).alias("z"))
    return df.select("conv_id", F.explode("z").alias("z")).select("conv_id", "z.number", "z.batch")
