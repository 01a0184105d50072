"""Parts of a note's body and of a turn: banners, provenance, related links, tools, payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memgrid.functions.knowledge import verified

SPACE = " \n\t\r"
#: The shapes of generated banners.
SUPERSEDED, OUTDATED, SUPERSEDES = "> ⚠️ **SUPERSEDED** by [[", "> This node is retained for historical context but its conclusions are outdated.", "> **Supersedes**: [["
_BANNERS = rf"\A\n*(?:(?:\Q{SUPERSEDED}\E[^\n]*(?:\n\Q{OUTDATED}\E)?|\Q{SUPERSEDES}\E[^\n]*)(?:\n|\z)\n?)+\n*"
_PROVENANCE = r"(?msi)^## (?:Related|Sources|Evidence)[ \t]*$.*?(?=^## |\z)"
#: Tools, and operations of the hub tool, that say nothing.
NOISE_TOOLS, NOISE_OPS = ("todo", "vibe_wait", "vibe_list", "vibe_kill", "vibe_send", "wait"), ("wait", "list", "status", "poll", "kill")


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE))


def without_banners(content: Column) -> Column:
    """generated banners at the start are gone."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(content, "\r\n", "\n"), _BANNERS, ""), r"\A\n+", "")


def with_banners(content: Column, superseded_by: Column, day: Column, supersedes: Column, reason: Column) -> Column:
    """one banner for what replaces a note (null: nothing) and one for each note that it replaces."""
    body = without_banners(content)
    why = F.when(F.coalesce(F.trim(reason), F.lit("")) != "", F.concat(F.lit(" — "), F.trim(reason))).otherwise("")
    first = F.when(superseded_by.isNotNull(), F.array(F.concat(F.lit(SUPERSEDED), superseded_by, F.lit("]] on "), F.date_format(day, "yyyy-MM-dd"), F.lit(".\n" + OUTDATED)))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(first, F.transform(F.filter(supersedes, lambda x: x != ""), lambda x: F.concat(F.lit(SUPERSEDES), x, F.lit("]]"), why)))
    return F.when(F.size(lines) == 0, body).otherwise(F.array_join(F.filter(F.array(F.array_join(lines, "\n"), body), lambda x: x != ""), "\n\n"))


def without_provenance(content: Column) -> Column:
    """sections that say where knowledge comes from are gone."""
    return _trim(F.regexp_replace(content, _PROVENANCE, ""))


def related(content: Column) -> Column:
    """Ids that `## Related` sections link to, in order, each once; no sessions."""
    parts = F.regexp_extract_all(content, F.lit(r"(?msi)^## Related[ \t]*$(.*?)(?=^## |\z)"), F.lit(1))
    ids = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"\[\[(mem_(?!session_)[A-Za-z0-9_-]+)(?:\|[^\]]*)?\]\]"), F.lit(1))))
    return F.array_distinct(ids)


def _bullets(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n")


def with_provenance(content: Column, sources: Column, links: Column | None = None) -> Column:
    """the knowledge, then what it is related to (what the body says, unless given), then its sources."""
    ids = links if links is not None else related(content)
    ids = F.array_distinct(F.filter(ids, lambda x: x.startswith("mem_") & ~x.startswith("mem_session_")))
    rel = F.when(F.size(ids) > 0, F.concat(F.lit("\n\n## Related\n\n"), _bullets(ids))).otherwise("")
    return F.concat(without_provenance(content), rel, F.lit("\n\n## Sources\n\n"), _bullets(sources), F.lit("\n"))


def related_merged(content: Column) -> Column:
    """all `## Related` lists as one at the end, each entry once; other text stays, in its order."""
    pattern = r"(?m)^## Related[ \t]*\n(?:[ \t]*\n|[ \t]*-[ \t][^\n]*(?:\n|\z))*"
    parts = F.regexp_extract_all(content, F.lit(f"({pattern})"), F.lit(1))
    lines = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"(?m)^[ \t]*(-[ \t][^\n]*?)[ \t]*$"), F.lit(1))))
    rest = _trim(F.regexp_replace(F.regexp_replace(content, pattern, ""), r"\n{3,}", "\n\n"))
    block = F.concat(F.lit("## Related\n"), F.array_join(F.array_distinct(lines), "\n"))
    return F.when(F.size(lines) == 0, rest).otherwise(F.array_join(F.filter(F.array(rest, block), lambda x: x != ""), "\n\n"))


def linked(content: Column, ids: Column) -> Column:
    """links that the text lacks, put at the end of its one list."""
    add = F.filter(ids, lambda x: ~F.contains(content, F.concat(F.lit("[["), x, F.lit("]]"))))
    return F.when(F.size(add) == 0, _trim(content)).otherwise(related_merged(F.concat(_trim(content), F.lit("\n\n## Related\n"), _bullets(add))))


def is_noise(tool: Column) -> Column:
    """F32: a tool block that only waits or looks; of the hub tool by the operation that it calls."""
    name = F.lower(F.regexp_extract(tool, r"\A### Tool T\d+\.\d+\s+`?([^\s`]+)", 1))
    op = F.lower(F.coalesce(F.get_json_object(F.regexp_extract(tool, r"(?m)^\s*call:\s*(\{[^\n]*\})", 1), "$.op"), F.lit("")))
    return name.isin(*NOISE_TOOLS) | ((name == "hub") & op.isin(*NOISE_OPS))


def dehydrated(turns: Column) -> Column:
    """F32: turns without noise, and without assistant turns that are empty then."""
    bare = F.transform(turns, lambda t: F.struct(t["number"].alias("number"), t["role"].alias("role"), t["body"].alias("body"), F.filter(t["tools"], lambda x: ~is_noise(x)).alias("tools")))
    return F.filter(bare, lambda t: ~((t["role"] == "Assistant") & (t["body"] == "") & (F.size(t["tools"]) == 0)))


def excerpt(turn: Column, limit: int = 1500) -> Column:
    """a turn within limit: half at least for its words if tools need as much, the rest in fair shares for its tools."""
    tools = turn["tools"]
    need = F.aggregate(tools, F.lit(0), lambda s, x: s + F.length(x)) + F.greatest(F.lit(0), F.size(tools) - 1)
    words = F.substring(turn["body"], 1, F.least(F.length(turn["body"]), F.lit(limit) - F.least(need, F.lit(limit // 2))))
    start = F.struct(F.when(words == "", F.array().cast("array<string>")).otherwise(F.array(words)).alias("parts"), (F.lit(limit) - F.length(words)).cast("int").alias("left"), F.size(tools).alias("n"))

    def step(s: Column, x: Column) -> Column:
        gap = F.when(F.size(s["parts"]) > 0, 1).otherwise(0)
        share = F.greatest(F.lit(0), F.floor((s["left"] - gap * (s["n"] - 1)) / s["n"])).cast("int")
        cut = F.substring(x, 1, share)
        return F.struct(F.when(cut == "", s["parts"]).otherwise(F.concat(s["parts"], F.array(cut))).alias("parts"), F.when(cut == "", s["left"]).otherwise(s["left"] - gap - F.length(cut)).cast("int").alias("left"), (s["n"] - 1).alias("n"))

    whole = F.aggregate(tools, start, step, lambda s: F.substring(F.array_join(s["parts"], "\n"), 1, limit))
    return F.when(F.size(tools) == 0, F.substring(turn["body"], 1, limit)).otherwise(whole)


def evidence_source(turn: Column, quote: Column) -> Column:
    """who says it: user, assistant, tool_result; unknown without a turn."""
    return F.when(turn.isNull(), "unknown").when(turn["role"] == "User", "user").when(verified(quote, turn["body"]), "assistant").when(F.exists(turn["tools"], lambda x: verified(quote, x)), "tool_result").otherwise("assistant")


#: Contracts of model replies: their schemas; what must hold besides is in _rule().
CONTRACTS = {
    "lessons": "lessons array<struct<title:string,okf_type:string,content:string,evidence:array<struct<turn:string,quote:string>>>>",
    "decision": "action string, target_node_ids array<string>, reasoning string, confidence double",
    "normalize": "okf_type string, title string, content string",
    "audit": "grade int, reason string",
}


def payload(reply: Column, contract: str) -> Column:
    """a reply (JSON, bare or in a fence) as a struct, or null where it breaks its contract."""
    text = F.coalesce(F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1), F.lit("")), _trim(reply))
    parsed = F.from_json(text, CONTRACTS[contract], {"mode": "PERMISSIVE"})
    checked = F.transform(F.array(parsed), lambda p: F.when(F.coalesce(_rule(p, contract), F.lit(False)), p))
    return F.element_at(checked, 1)


def _rule(p: Column, contract: str) -> Column:
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    kinds = ("decision", "fact", "procedure", "pitfall")
    if contract == "lessons":
        return p["lessons"].isNotNull() & F.forall(p["lessons"], lambda x: filled(x["title"]) & x["okf_type"].isin(*kinds) & filled(x["content"]))
    if contract == "decision":
        return p["action"].isin("create", "supersede", "complement") & (p["confidence"].isNull() | p["confidence"].between(0, 1))
    if contract == "normalize":
        return p["okf_type"].isin(*kinds) & filled(p["title"]) & filled(p["content"])
    return p["grade"].between(0, 2)
