"""Column builders over strings: tokens, globs, URLs, paths, resources, severities and cues."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic (fixed values).
STOP = ("the", "and", "for", "with", "from", "that", "this", "are", "not", "into", "any", "all")
URL = r"https?://[^\s)\]\"'<>]+"
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)"
#: Capability to family (fixed values of the capability taxonomy).
FAMILIES = {
    "shell_exec": "execution", "subprocess_spawn": "execution", "file_read": "filesystem", "file_write": "filesystem",
    "network_request": "network", "code_download": "network", "credential_access": "secrets", "env_var_read": "secrets",
}
SOURCES = ("file_read", "env_var_read", "credential_access", "code_download")
SINKS = ("file_write", "network_request", "shell_exec", "subprocess_spawn")
#: Capabilities that need a declared permission.
SENSITIVE = ("credential_access", "network_request", "shell_exec", "code_download")


def tokens(text: Column) -> Column:
    """Distinct lower-case ASCII words of three characters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower(F.translate(text, "_", " ")), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP)))


def family(capability: Column) -> Column:
    return F.coalesce(*(F.when(capability == k, F.lit(v)) for k, v in FAMILIES.items()), F.lit("other"))


def host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def glob_regex(glob: str) -> str:
    """A shell pattern as an anchored regular expression that Java, RE2 and Python read alike."""
    out = ""
    for c in glob:
        out += ".*" if c == "*" else "." if c == "?" else re.escape(c) if not c.isalnum() and c not in "_/" else c
    return f"^{out}$"


def domain_matches(pattern: Column, name: Column) -> Column:
    """Equality, or for ``*.suffix`` any name below the suffix but not the suffix itself."""
    suffix = F.substring(pattern, 3, 1_000)
    return F.when(pattern.startswith("*."), name.endswith(F.concat(F.lit("."), suffix))).otherwise(pattern == name)


def resource_kind(value: Column) -> Column:
    """What a literal names, first match wins; a placeholder is dynamic."""
    return (
        F.when(value.isNull(), "none").when(value.startswith("$"), "dynamic").when(value.rlike("^[a-z]+://"), "url").when(value.rlike("^[A-Z][A-Z0-9_]+$"), "env")
        .when(value.startswith("/") | value.startswith("./") | value.startswith("~"), "path").when(value.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"), "domain").otherwise("command")
    )


def stratum(value: Column) -> Column:
    """Risk strata in one spelling."""
    s = F.lower(F.trim(value))
    return F.when(s.isin("med", "medium", "mid"), "medium").when(s.isin("hi", "high"), "high").when(s.isin("lo", "low"), "low").otherwise(F.coalesce(s, F.lit("unstratified")))


#: Cues that weigh two points each in the priority of a line.
CUES = ("do not", "never", "only", "must", "unless", "without")


def cue_score(text: Column) -> Column:
    return sum((F.when(F.lower(text).contains(c), 2).otherwise(0) for c in CUES), F.lit(0))
