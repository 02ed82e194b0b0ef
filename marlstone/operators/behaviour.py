"""Behaviour from observations and texts: paths within a unit, bridges between files, commands of
documents and the files they start, resources that a statement names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relational as R

#: Lines between a source and a sink of one unit, and pairs of capabilities with their own distance (fixed values).
GAP = 8
GAPS = {("env_var_read", "http_request"): 16, ("file_read", "http_request"): 16, ("token_file_read", "http_request"): 16, ("env_var_read", "network_request"): 16, ("file_read", "network_request"): 16, ("credential_access", "network_request"): 16}
#: Shapes of the resources that a statement names (fixed values, read alike by Java and RE2).
URL = r"https?://[^\s)\]\"'<>]+"
ENV = r"(?:os\.environ(?:\.get)?[\[(]\s*[\"']|os\.getenv\(\s*[\"']|process\.env\.|\$\{?)([A-Z][A-Z0-9_]{2,})"
QUOTED = r"[\"'`]((?:\.{0,2}/|~/)?[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+|[A-Za-z0-9_-]+\.(?:py|js|ts|sh|json|yaml|yml|md|txt|html|csv|xml|sql|log|cfg|ini))[\"'`]"
REDIRECT = r">>?\s*([A-Za-z0-9_./-]*[A-Za-z0-9_])"
SUBPROCESS = r"\bsubprocess\.(?:run|popen|call|check_call|check_output)|\bchild_process\.(?:spawn|execfile|fork)|\bexeca\(|\bspawn\(|\bexecfile\("
SCRIPT = r"[A-Za-z0-9_./-]+\.(?:py|mjs|js|ts|sh|bash|md)\b"
FENCE = r"(?s)```(?:bash|sh|shell|console)\n(.*?)```"
#: What stands for a resource that a statement does not name.
ABSTRACT = {"http_request": "url", "network_request": "url", "websocket": "url", "smtp_send": "url", "ssh_connect": "url", "file_read": "path", "file_write": "path", "token_file_read": "path", "env_var_read": "env_var", "shell_exec": "command", "subprocess_spawn": "command", "sql_exec": "query"}


def paths_within(events: DataFrame, sources: tuple[str, ...], sinks: tuple[str, ...]) -> DataFrame:
    """``(unit, source_cap, sink_cap, source_event, sink_event, gap)``, the nearest pair of each two
    capabilities of a unit; ties go to the least events. A line of 0 is unknown and meets any line, which
    needs the least event of a capability only, so no unit is joined with itself for it."""
    e = events.select("unit", "event_id", "capability", "line").where("unit is not null")
    src, snk = e.where(F.col("capability").isin(*sources)), e.where(F.col("capability").isin(*sinks))
    widest = max([GAP, *GAPS.values()])
    near = R.range_pairs(src.where("line > 0"), snk.where("line > 0"), ["unit"], "line", widest)
    limit = F.coalesce(*(F.when((F.col("a.capability") == a) & (F.col("b.capability") == b), g) for (a, b), g in GAPS.items()), F.lit(GAP))
    near = near.where((F.col("b_at") - F.col("a_at") <= limit) & (F.col("a.event_id") != F.col("b.event_id")))
    near = near.select("unit", F.col("a.capability").alias("source_cap"), F.col("b.capability").alias("sink_cap"), F.col("a.event_id").alias("source_event"), F.col("b.event_id").alias("sink_event"), (F.col("b_at") - F.col("a_at")).alias("gap"))
    least = lambda df, cap, name: df.groupBy("unit", F.col("capability").alias(cap)).agg(F.min("event_id").alias(name))
    free = []
    for left, right in ((src.where("line = 0"), snk), (src, snk.where("line = 0"))):
        free.append(least(left, "source_cap", "source_event").join(least(right, "sink_cap", "sink_event"), "unit").where("source_event <> sink_event").select("unit", "source_cap", "sink_cap", "source_event", "sink_event", F.lit(0).alias("gap")))
    rows = near.unionByName(free[0]).unionByName(free[1])
    best = F.min(F.struct("gap", "source_event", "sink_event")).alias("b")
    return rows.groupBy("unit", "source_cap", "sink_cap").agg(best).select("unit", "source_cap", "sink_cap", "b.source_event", "b.sink_event", "b.gap")


def bridges(files: DataFrame) -> DataFrame:
    """``(scope, source, target, kind, evidence)``: a file that names another's script, or imports
    another's stem; of several files with the name the least. ``files(scope, file, path, text)``."""
    name = F.element_at(F.split("path", "/"), -1)
    index = files.select("scope", F.col("file").alias("target"), "path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))
    pick = lambda key: index.groupBy("scope", key).agg(F.min_by("target", F.struct("path", "target")).alias("target"))
    said = files.select("scope", F.col("file").alias("source"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(SCRIPT), F.lit(0)), lambda s: F.element_at(F.split(s, "/"), -1)))).alias("name"))
    imported = F.concat(F.regexp_extract_all("text", F.lit(r"(?m)^(?:import|from) +([A-Za-z_]\w*)"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(?:from|require\()\s*[\"']\.{1,2}/(?:[\w.-]+/)*([\w-]+)"), F.lit(1)))
    used = files.select("scope", F.col("file").alias("source"), F.explode(F.array_distinct(imported)).alias("stem"))
    rows = said.join(pick("name"), ["scope", "name"]).select("scope", "source", "target", F.lit("command").alias("kind"), F.col("name").alias("evidence"))
    rows = rows.unionByName(used.join(pick("stem"), ["scope", "stem"]).select("scope", "source", "target", F.lit("static").alias("kind"), F.col("stem").alias("evidence")))
    return rows.where("source <> target")


def commands(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, seq, command, script)`` of each line in the shell fences of a document."""
    blocks = docs.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))).alias("block", "body"))
    lines = blocks.select("key", "block", F.posexplode(F.split("body", "\n")).alias("line", "command")).where(~F.col("command").rlike(r"^\s*(?:#|$)"))
    return lines.select("key", (F.col("block") * 1000 + F.col("line")).alias("seq"), F.trim("command").alias("command"), F.nullif(F.regexp_extract("command", SCRIPT, 0), F.lit("")).alias("script"))


def orchestrations(cmds: DataFrame, files: DataFrame) -> DataFrame:
    """Commands with the file that they start: confirmed where one file has the path, competing where
    only its name is found and in several files, unresolved where none is. ``files(scope, file, path)``."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    c = cmds.where("script is not null").withColumns({"path": F.regexp_replace("script", r"^(?:\./)+", ""), "name": name("script")})
    exact = files.groupBy("scope", "path").agg(F.min("file").alias("exact"))
    named = files.groupBy("scope", name("path").alias("name")).agg(F.countDistinct("file").alias("named"))
    rows = c.join(exact, ["scope", "path"], "left").join(named, ["scope", "name"], "left")
    status = F.when(F.col("exact").isNotNull(), "confirmed").when(F.col("named") > 1, "competing").when(F.col("named") == 1, "inferred").otherwise("unresolved")
    return rows.select("scope", "key", "seq", "script", "exact", F.coalesce("named", F.lit(0)).alias("named"), status.alias("status"))


def resources_of(text: Column, capability: Column) -> Column:
    """Array of ``struct(rtype, value, resolved, origin)`` that a statement names, in order of kind and
    without repeats; one abstract resource of the capability where it names none."""

    def each(pattern: str, group: int, rtype: str, origin):
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.transform(found, lambda v: F.struct(F.lit(rtype).alias("rtype"), (F.rtrim(v, F.lit(".,);")) if rtype == "url" else v).alias("value"), F.lit(True).alias("resolved"), (origin(v) if callable(origin) else F.lit(origin)).alias("origin")))

    placed = lambda v: F.when(F.lower(v).rlike(r"(?:^|/)config/"), "config_file").otherwise("literal")
    found = F.array_distinct(F.concat(each(URL, 0, "url", "literal"), each(ENV, 1, "env_var", "env"), each(QUOTED, 1, "path", placed), each(REDIRECT, 1, "path", "artifact")))
    kind = F.coalesce(*(F.when(capability == k, F.lit(v)) for k, v in ABSTRACT.items()))
    blank = F.array(F.struct(kind.alias("rtype"), F.concat(F.lit("<dynamic-"), F.translate(kind, "_", "-"), F.lit(">")).alias("value"), F.lit(False).alias("resolved"), F.lit("unknown").alias("origin")))
    return F.when(F.size(F.coalesce(found, F.array().cast(found_type()))) > 0, found).when(kind.isNotNull(), blank).otherwise(F.array().cast(found_type()))


def found_type() -> str:
    return "array<struct<rtype:string,value:string,resolved:boolean,origin:string>>"


def refined(capability: Column, text: Column) -> Column:
    """A shell call that starts a process by an API is a spawn."""
    return F.when((capability == "shell_exec") & F.lower(text).rlike(SUBPROCESS), "subprocess_spawn").otherwise(capability)


def posix_path(value: Column, drives: dict[str, str] | None = None) -> Column:
    """Drive, mount and WSL share paths in POSIX form; others as they are. ``drives`` maps drive letters
    to folders, ``/mnt/<letter>`` by default."""
    v = F.translate(F.trim(value), "\\", "/")
    share = F.regexp_extract(v, r"(?i)^//(?:wsl\.localhost|wsl\$)/[^/]+(/.*)$", 1)
    letter = F.lower(F.regexp_extract(v, r"^([A-Za-z]):(?:/|$)", 1))
    mount = F.lower(F.regexp_extract(v, r"^/mnt/([A-Za-z])(?:/|$)", 1))
    roots = [(k.lower().rstrip(":"), r) for k, r in (drives or {}).items()]
    root = lambda d: F.coalesce(*(F.when(d == k, F.lit(r)) for k, r in roots), F.concat(F.lit("/mnt/"), d))
    rest = lambda n: F.rtrim(F.substring(v, F.lit(n), F.length(v)), F.lit("/"))
    return (
        F.when(share != "", share).when(letter != "", F.concat(root(letter), rest(3))).when((mount != "") & (F.lit(False) if not roots else mount.isin(*[k for k, _ in roots])), F.concat(root(mount), rest(7))).otherwise(F.trim(value))
    )
