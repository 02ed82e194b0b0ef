"""The declared side: votes over repeated extractions, guards, deterministic clauses, references of
documents and their closure, steps, and masking of literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from . import graph as G

#: Tools that front matter may allow, and the capability of each (fixed values).
TOOLS = {"Bash": "shell_exec", "Read": "file_read", "Edit": "file_write", "Write": "file_write", "WebSearch": "http_request", "WebFetch": "http_request"}
NOT_FOR = r"[Nn]ot\s+for\s+([^.\n]+)"
NOT_FOR_ZH = r"不(?:用于|适用于|支持)\s*([^。\n]+)"
#: What masks hide, in this order (fixed values).
MASKS = (("MARK", "⟦"), ("URL", r"https?://[^\s)\]\"'<>]+"), ("PATH", r"(?:\.{0,2}/|~/)[A-Za-z0-9_./-]+"), ("ENV", r"\b[A-Z][A-Z0-9]*_[A-Z0-9_]+\b"))


def vote_clauses(samples: DataFrame, keys: list[str], operator: str, voter: str, voters: int, threshold: float = 0.6) -> DataFrame:
    """A2: ``(keys, operator, agreement)``. Each of allowed and prohibited that enough distinct passes
    agree on is a clause, both where both do; a key with neither is unknown, with the best agreement."""
    shares = samples.groupBy(*keys, operator).agg((F.countDistinct(voter) / F.lit(float(voters))).alias("agreement"))
    per = shares.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col(operator).isin("allowed", "prohibited") & (F.col("agreement") >= threshold), F.struct(F.col(operator).alias("operator"), "agreement")))).alias("passed"), F.max("agreement").alias("best"))
    none = F.array(F.struct(F.lit("unknown").alias("operator"), F.col("best").alias("agreement")))
    return per.select(*keys, F.explode(F.when(F.size("passed") > 0, F.col("passed")).otherwise(none)).alias("c")).select(*keys, "c.operator", F.round("c.agreement", 6).alias("agreement"))


def guard(operator: Column, specific: Column, required: Column) -> Column:
    """Of capabilities that need authorization an unknown clause that is specific becomes allowed, and
    an allowed one that is not becomes unknown; prohibitions stay."""
    return F.when(required & (operator == "unknown") & specific, "allowed").when(required & (operator == "allowed") & ~specific, "unknown").otherwise(operator)


def role(operator: Column, rooted: Column, text: Column, specific: Column) -> Column:
    """Policy or knowledge, the first rule that holds: a stance, an order or a norm, a document away from
    the root, an explanation."""
    low = F.lower(text)
    norm = low.rlike(r"\b(?:must|should|never|always|only|do not|required|forbidden)\b|必须|不得|禁止|只能")
    explains = low.rlike(r"\b(?:example|overview|background|for instance|note that|refers to)\b|例如|示例|说明")
    return F.when(operator.isin("allowed", "prohibited"), "policy").when(F.coalesce(norm, F.lit(False)), "policy").when(~rooted & ~specific, "knowledge").when(F.coalesce(explains, F.lit(False)) & ~specific, "knowledge").otherwise("policy")


def allowed_tools(docs: DataFrame, key: str, tools: str) -> DataFrame:
    """``(key, seq, capability, kind, value)`` of every ``name(pattern)`` of an allowed-tools entry; an
    unknown tool runs commands; an empty pattern narrows nothing."""
    found = F.arrays_zip(F.regexp_extract_all(tools, F.lit(r"(\w+)\(([^)]*)\)"), F.lit(1)).alias("tool"), F.regexp_extract_all(tools, F.lit(r"(\w+)\(([^)]*)\)"), F.lit(2)).alias("pattern"))
    rows = docs.select(F.col(key).alias("key"), F.posexplode(found).alias("seq", "m")).select("key", "seq", "m.tool", "m.pattern")
    capability = F.coalesce(*(F.when(F.col("tool") == k, F.lit(v)) for k, v in TOOLS.items()), F.lit("shell_exec"))
    rows = rows.withColumn("capability", capability).withColumn("c", rules.typed_constraint(F.col("capability"), F.col("pattern")))
    surface = rules.clean_surface(F.col("pattern"))
    return rows.select("key", "seq", "capability", F.when(surface.isNotNull(), F.coalesce("c.kind", F.lit("scope"))).alias("kind"), F.coalesce("c.value", surface).alias("value"))


def exclusions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, seq, excluded, start)``: what a description says that it is not for, and where."""
    found = F.concat(F.regexp_extract_all(text, F.lit(NOT_FOR), F.lit(1)), F.regexp_extract_all(text, F.lit(NOT_FOR_ZH), F.lit(1)))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.posexplode(F.transform(found, F.trim)).alias("seq", "excluded"))
    return rows.select("key", "seq", "excluded", (F.instr("text", F.col("excluded")) - 1).alias("start"))


def located(text: Column, part: Column) -> Column:
    """``struct(start, end, how)`` of a part of a text: exact, or but for case, else null places."""
    at = F.instr(text, part)
    low = F.instr(F.lower(text), F.lower(part))
    place = F.when(at > 0, at).when(low > 0, low)
    return F.struct((place - 1).alias("start"), (place - 1 + F.length(part)).alias("end"), F.when(at > 0, "exact").when(low > 0, "folded").otherwise("absent").alias("how"))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, that an offset lies in."""
    return F.length(F.substring(text, F.lit(1), offset)) - F.length(F.replace(F.substring(text, F.lit(1), offset), F.lit("\n"), F.lit(""))) + 1


def documents_closure(root: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, level, parent)`` from the root documents over links whose target is itself a document;
    other targets are reached and not followed. ``links(src, dst, status)``."""
    open_ = links.where("status = 'admitted'").select(F.col("dst").alias("src")).unionByName(root.select(F.col("node").alias("src"))).distinct()
    return G.closure(root, links.where("status <> 'unresolved'").join(open_, "src", "left_semi").select("src", "dst"))


def steps(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, seq, step_type, heading, bound)`` of the lines of a document that say something. A fence is
    bound where the line before it or its heading speaks of running."""
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(text, r"\r?\n")).alias("seq", "line"))
    by = Window.partitionBy("key").orderBy("seq")
    run = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("line").rlike(r"^\s*```")
    lines = lines.withColumns({"fences": F.count_if(fence).over(run), "heading": F.last(F.when(F.col("line").rlike("^#{1,6} "), F.regexp_replace("line", r"^#+\s+", "")), ignorenulls=True).over(run), "said": F.lag(F.col("line")).over(by)})
    low = F.lower("line")
    kind = (
        F.when(fence, "fence").when(F.col("fences") % 2 == 1, "code").when(F.col("line").rlike("^#{1,6} "), "heading").when(F.col("line").rlike(r"^\s*<"), "html")
        .when(low.rlike(r"\b(?:must|never|only|do not|required)\b|必须|不得|禁止|只有"), "policy").when(F.col("line").rlike(r"^\s*(?:[-*+]|\d+[.)])\s"), "list_item").when(low.rlike(r"\b(?:run|use|call|open|execute|write|read)\b|运行|执行|读取"), "instruction").otherwise("context")
    )
    cue = r"(?i)\b(?:run|execute|command|usage|example|script)\b|运行|执行|用法|流程"
    near = F.last(F.when((F.trim("line") != "") & ~fence, F.col("line")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    bound = (fence & (F.col("fences") % 2 == 1)) & (F.coalesce(near, F.lit("")).rlike(cue) | F.coalesce("heading", F.lit("")).rlike(cue))
    return lines.withColumn("bound", bound).where(F.trim("line") != "").select("key", "seq", kind.alias("step_type"), "heading", "bound")


def masked(text: Column) -> Column:
    """``struct(text, values)``: literals replaced by marks and listed by kind in order, so that
    ``unmasked`` gives the text back. What looks like a mark's bracket is masked first."""
    out, lists = text, []
    for name, pattern in MASKS:
        lists.append(F.regexp_extract_all(out, F.lit(f"({pattern})"), F.lit(1)).alias(name.lower()))
        out = F.regexp_replace(out, pattern, f"⟦{name}⟧")
    return F.struct(out.alias("text"), F.struct(*lists).alias("values"))


def unmasked(mask: Column) -> Column:
    """The text that ``masked`` came from: the kinds are put back in reverse, as a literal of an earlier
    kind may hold a mark of a later one only."""
    text = mask["text"]
    for name, _ in reversed(MASKS):
        parts, values = F.split(text, f"⟦{name}⟧", -1), mask["values"][name.lower()]
        text = F.array_join(F.transform(parts, _filled(values)), "")
    return text


def _filled(values: Column):
    """Each part behind the value that stands before it; the first has none."""
    return lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.coalesce(F.get(values, i - 1), F.lit("")), part))
