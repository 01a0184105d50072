"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4E00}-\x{9FFF}]"
#: Words that a query leaves out.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "is", "are", "was", "for", "on", "it", "this", "that", "with", "as", "be", "at", "by", "from",
    "but", "not", "what", "how", "why", "do", "does", "can", "should", "would", "please", "tell", "me", "about",
    "的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有",
    "看", "好", "自己", "这", "先", "吧", "呢", "吗", "啊", "把", "给", "让", "用", "能", "没", "还", "再", "才", "只", "等", "被", "跟", "对", "下",
    "里", "来",
)
MAX_TERMS = 24


def accents() -> tuple[str, str]:
    """Latin letters that decompose to one ASCII letter and marks, lower-cased, and those letters."""
    pairs = {}
    for i in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(i).lower())
        if len(chr(i).lower()) == 1 and base[0].isascii() and base[0].isalpha() and all(unicodedata.combining(c) for c in base[1:]) and len(base) > 1:
            pairs[chr(i).lower()] = base[0]
    return "".join(pairs), "".join(pairs.values())


def cjk_bigrams(text: Column) -> Column:
    """each run of two or more CJK characters as its overlapping pairs.

    An inner character of a run ends one pair and starts the next, so it is doubled with a blank.
    """
    return F.regexp_replace(text, f"(?<={CJK})({CJK})(?={CJK})", "$1 $1")


def has_cjk(text: Column) -> Column:
    return F.rlike(text, F.lit(CJK))


def fts_tokens(text: Column) -> Column:
    """L2: letters and digits, lower-cased, without Latin accents."""
    a, b = accents()
    return F.regexp_extract_all(F.translate(F.lower(text), a, b), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def spaced_tokens(text: Column) -> Column:
    """The same tokens with a blank between them, and with their accents: a letter stays one letter without it."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{Co}]+", " "))


def or_terms(query: Column, limit: int = MAX_TERMS) -> Column:
    """the terms of a query in order, each once: words and the CJK runs inside them."""
    chunks = F.split(F.trim(query), r"\s+")
    raw = F.flatten(F.transform(chunks, lambda c: F.concat(F.array(c), F.regexp_extract_all(c, F.lit(f"{CJK}+"), F.lit(0)))))
    clean = F.transform(raw, lambda t: F.trim(F.replace(t, F.lit('"'), F.lit(""))))
    kept = F.filter(clean, lambda t: F.rlike(t, F.lit(r"[\p{L}\p{N}_]")) & ~F.lower(t).isin(*STOPWORDS) & (F.length(t) >= 2))
    return F.slice(F.array_distinct(F.transform(kept, cjk_bigrams)), 1, limit)


def word_count(text: Column) -> Column:
    """runs of Latin letters and digits, and each CJK character."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9]+(?:['_-][A-Za-z0-9]+)*")) + F.regexp_count(text, F.lit(CJK))


#: Words that the body of a note should not go beyond.
WORD_LIMIT = 3500


def word_check(text: Column, limit: int = WORD_LIMIT) -> Column:
    """words, limit, within (the limit) and overage (words beyond it); a null text has no words."""
    n = F.coalesce(word_count(text), F.lit(0))
    return F.struct(n.alias("words"), F.lit(limit).alias("limit"), (n <= limit).alias("within"), F.greatest(n - limit, F.lit(0)).alias("overage"))


def cjk_ratio(text: Column) -> Column:
    """F23."""
    n = F.length(F.regexp_replace(text, r"[^\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]", ""))
    return F.when(F.length(text) > 0, F.round(n / F.length(text), 4)).otherwise(0.0)


def token_estimate(text: Column) -> Column:
    """a token for each CJK character, one for two others."""
    cjk = F.regexp_count(text, F.lit(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"))
    return cjk + F.ceil((F.length(text) - cjk) / 2)


def collapsed(text: Column) -> Column:
    """F14."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def token_set(text: Column) -> Column:
    """distinct runs of two or more ASCII letters or digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """U6 over two token sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def short(text: Column, n: int) -> Column:
    """the first line, at most n characters, the last an ellipsis if cut."""
    line = F.trim(F.substring_index(F.trim(text), "\n", 1))
    return F.when(F.length(line) > n, F.concat(F.rtrim(F.substring(line, 1, n - 1)), F.lit("…"))).otherwise(line)


def write_query(title: Column, content: Column, hint: Column | None = None, most: int = 240) -> Column:
    """what a draft is looked up by: a hint, or its title and first line, unless they say the same."""
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    name = plain(title)
    line = plain(F.try_element_at(F.filter(F.split(F.coalesce(content, F.lit("")), "\r\n|\r|\n"), lambda x: plain(x) != ""), F.lit(1)))
    both = F.array_join(F.filter(F.array(name, F.when(F.lower(line) == F.lower(name), "").otherwise(line)), lambda x: x != ""), " — ")
    cut = F.when(F.length(both) > most, F.concat(F.rtrim(F.substring(both, 1, most - 1)), F.lit("…"))).otherwise(both)
    if hint is None:
        return cut
    return F.when(F.coalesce(F.trim(hint), F.lit("")) != "", F.trim(F.substring(F.trim(hint), 1, most))).otherwise(cut)


def wiki_links(text: Column) -> Column:
    """targets of [[target]] and [[target|alias]], trimmed, blanks dropped."""
    inner = F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    return F.filter(F.transform(inner, lambda x: F.trim(F.substring_index(x, "|", 1))), lambda x: x != "")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is worked out once, however often f names it: within a lambda Spark works it out for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sections(text: Column) -> Column:
    """headings of level two and their trimmed bodies; of equal headings the first."""
    parts = F.filter(F.split(text, r"(?m)^(?=## )"), lambda p: p.startswith("## "))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring(F.substring_index(p, "\n", 1), 4, 1 << 20)).alias("heading"), F.trim(F.when(F.instr(p, "\n") > 0, F.regexp_replace(p, r"^[^\n]*\n", "")).otherwise(""), F.lit(" \n\t\r")).alias("body")))
    return once(pairs, lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, F.lit(1), i), lambda y: y["heading"] == x["heading"])))


def session_hash(key: Column) -> Column:
    """twelve digits of the SHA-1 of a trimmed key; null for a blank one."""
    return F.when(F.trim(key) != "", F.substring(F.sha1(F.trim(key).cast("binary")), 1, 12))


def knowledge_id(title: Column, day: Column) -> Column:
    """mem_, day and slug; a title without a usable slug by its hash."""
    slug = F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(F.length(slug) >= 3, F.concat(F.lit("mem_"), F.date_format(day, "yyyyMMdd"), F.lit("_"), F.rtrim(F.substring(slug, 1, 48), F.lit("_")))).otherwise(F.concat(F.lit("node_"), F.substring(F.sha1(title.cast("binary")), 1, 10)))


def kebab(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def clean_slug(node_id: Column) -> Column:
    """an id without its day, or as it is if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(node_id, r"^mem_\d{8}_", ""), F.lit("-_")), F.lit("")), node_id)


def file_stem(node_id: Column) -> Column:
    """what a note's file is called."""
    slug = F.trim(F.translate(F.regexp_replace(clean_slug(node_id), r"[^A-Za-z0-9._-]+", "-"), "_", "-"), F.lit("-."))
    return F.coalesce(F.nullif(slug, F.lit("")), node_id)


NO_PROJECT = "general"


def project_slug(name: Column) -> Column:
    """a project's name as part of a path."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9._/-]+", "-"), F.lit("-.")), F.lit("")), F.lit(NO_PROJECT))


def inferred_project(project: Column, node_id: Column, title: Column, content: Column, domains: list[tuple[str, list[str]]]) -> Column:
    """A node's own project, else the first domain of which a marker is in its id, title or content.

    domains: (project, markers), in order; put those that a user adds before the others.
    """
    text = F.lower(F.concat_ws(" ", node_id, title, content))
    out = F.when(F.trim(project) != "", project_slug(F.trim(project)))
    for name, markers in domains:
        hits = [F.contains(text, F.lit(m.strip().lower())) for m in markers if m.strip()]
        if hits:
            out = out.when(F.greatest(*hits) if len(hits) > 1 else hits[0], name)
    return out.otherwise(NO_PROJECT)


def merged_domains(own: list[dict], others: list[tuple[str, list[str]]]) -> list[tuple[str, list[str]]]:
    """A user's domains ({project, markers}) first; another of the same name gives way, and what has no name or marker is left out."""
    named = [(str(d.get("project") or "").strip().lower(), [str(m) for m in d.get("markers") or [] if str(m).strip()]) for d in own if isinstance(d, dict)]
    named = [(p, m) for p, m in named if p and m]
    return named + [d for d in others if d[0] not in {p for p, _ in named}]


def table_cell(text: Column) -> Column:
    """safe inside a Markdown table."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " "))


#: What is redacted, in this order, and what it becomes.
REDACTIONS = (
    ("API_KEY", r"sk-[a-zA-Z0-9]{32,}", "[REDACTED_API_KEY]"),
    ("EMAIL", r"[^@\s]+@[^@\s]+\.[^@\s]+", "[REDACTED_EMAIL]"),
    ("IP", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "[REDACTED_IP]"),
    ("UUID", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "[REDACTED_UUID]"),
    ("JWT", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[REDACTED_JWT]"),
    ("SECRET_ASSIGNMENT", r"""(?i)(\b[A-Z0-9_]*(?:TOKEN|API[_-]?KEY|ACCESS[_-]?KEY|PRIVATE[_-]?KEY|SECRET|PASSWORD|CREDENTIAL)[A-Z0-9_]*\b(?:\\?["'])?\s*[:=]\s*(?:\\?["'])?)([A-Za-z0-9._~+/=-]{16,})""", "$1[REDACTED_SECRET]"),
    ("AUTHORIZATION", r"(?i)(\b(?:Bearer|Basic)[ \t]+)([A-Za-z0-9._~+/=-]{16,})", "$1[REDACTED_SECRET]"),
    ("PRIVATE_KEY_BLOCK", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    ("URL_PASSWORD", r"(?i)(://[^\s/:@]{1,64}:)([^\s/@]{3,})(@)", "$1[REDACTED_CREDENTIAL]$3"),
    ("CREDENTIAL_ASSIGNMENT", r"""(?i)(\b(?:password|passwd|pwd|passphrase|client[_-]?secret|secret[_-]?key|app[_-]?secret|api[_-]?key|apikey|access[_-]?token|refresh[_-]?token|auth[_-]?token)\b\s*[:=]\s*["']?)(?!\$|\{|<|\[|\*|%)([A-Za-z0-9._~+/=!@#$%^&*\-]{4,})""", "$1[REDACTED_CREDENTIAL]"),
    ("CREDENTIAL_BEARER", r"(?i)(\b(?:Bearer|Basic)\s+)([A-Za-z0-9._~+/=-]{12,})", "$1[REDACTED_CREDENTIAL]"),
)
#: The rules that notes are scrubbed by before they are stored, and the blocks of a manifest with secret values.
CREDENTIALS = ("PRIVATE_KEY_BLOCK", "URL_PASSWORD", "CREDENTIAL_ASSIGNMENT", "CREDENTIAL_BEARER")
MANIFEST_BLOCK, MANIFEST_PAIR, MANIFEST_VALUE = r"^[ \t]*(?:stringData|data):[ \t]*$", r"^([ \t]+)([A-Za-z0-9._\-/]+):[ \t]*(\S.*)$", r"^[A-Za-z0-9+/]{16,}={0,2}$"
#: What each match of a rule contains: a text without it is not searched.
NEEDS = {"API_KEY": "sk-", "EMAIL": "@", "JWT": ".eyJ", "PRIVATE_KEY_BLOCK": "PRIVATE KEY-----", "URL_PASSWORD": "://"}
#: What comes before each leftmost match of a rule: without it a long run without an @ is searched from each of its characters.
STARTS = {"EMAIL": r"(?<![^@\s])"}


def _pattern(label: str, pattern: str) -> str:
    """As Java is to read it: classes and word ends by Unicode."""
    return "(?U)" + STARTS.get(label, "") + pattern


def redacted(text: Column, rules=REDACTIONS) -> Column:
    """the rules one after another; further rules (Z4: label, pattern, replacement with $1) may be added at the end."""
    for label, pattern, to in rules:
        new = F.regexp_replace(text, _pattern(label, pattern), to)
        text = F.when(F.contains(text, F.lit(NEEDS[label])), new).otherwise(text) if label in NEEDS else new
    return text


def redaction_counts(text: Column, rules=REDACTIONS) -> list[Column]:
    """How often each rule applies to what the ones before it left."""
    out = []
    for label, pattern, to in rules:
        out.append(F.regexp_count(text, F.lit(_pattern(label, pattern))).cast("long").alias(label.lower()))
        text = redacted(text, ((label, pattern, to),))
    return out


def scrubbed(text: Column) -> Column:
    """credentials alone, and the secret values of manifest blocks; identifiers stay.

    A block lasts as long as lines are blank or indented deeper than its head; in it a value goes
    that starts with < or looks like Base64.
    """
    hidden = "[REDACTED_CREDENTIAL]"
    text = redacted(text, [r for r in REDACTIONS if r[0] in CREDENTIALS])
    start = F.struct(F.lit(-1).alias("depth"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        indent = F.length(line) - F.length(F.ltrim(line, F.lit(" \t")))
        inside = (s["depth"] >= 0) & ((F.trim(line, F.lit(" \t\r")) == "") | (indent > s["depth"]))
        value = F.regexp_extract(line, MANIFEST_PAIR, 3)
        secret = value.startswith("<") | F.rlike(value, F.lit(MANIFEST_VALUE))
        shown = F.when(inside & (value != "") & secret, F.regexp_replace(line, MANIFEST_PAIR, "$1$2: " + hidden.replace("$", r"\$"))).otherwise(line)
        depth = F.when(inside, s["depth"]).when(F.rlike(line, F.lit(MANIFEST_BLOCK)), indent).otherwise(-1)
        return F.struct(depth.alias("depth"), F.concat(s["out"], F.array(shown)).alias("out"))

    blocks = F.aggregate(F.split(text, "\n"), start, step, lambda s: F.array_join(s["out"], "\n"))
    return F.when(F.rlike(text, F.lit(r"(?m)" + MANIFEST_BLOCK)), blocks).otherwise(text)


def repaired(json: Column) -> Column:
    """JSON text whose escapes of half a surrogate pair are escapes of U+FFFD; to be applied before it is parsed."""
    high, low = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    return F.regexp_replace(F.regexp_replace(json, rf"(?<!\\)((?:\\\\)*){high}(?!{low})", r"$1\\uFFFD"), rf"(?<!{high})(?<!\\)((?:\\\\)*){low}", r"$1\\uFFFD")


def valid_utf8(data: Column) -> Column:
    """F29 for bytes: text in which what is no UTF-8, as half a surrogate pair, is U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


#: Days of the units of a window.
WINDOW_DAYS = {"d": 1, "w": 7, "m": 30}


def window_days(window: Column) -> Column:
    """days of a window as 30d, 12w, 6m or a bare number of days; null for anything else, and for none."""
    n, unit = (F.regexp_extract(F.lower(F.trim(window)), r"^(\d{1,6})\s*([dwm]?)$", k) for k in (1, 2))
    days = F.nullif(n, F.lit("")).cast("int")
    for u, k in WINDOW_DAYS.items():
        days = F.when(unit == u, days * k).otherwise(days)
    return F.when(days > 0, days)
