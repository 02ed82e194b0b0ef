"""Rules of the reconciliation as columns: constraint types, matches of constraints and resources,
sensitivity of events, severities and labels of external reports. Each takes and gives columns, so
Catalyst sees through all of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: capability classes ----------------------------------------------------------------
NETWORK = ("http_request", "websocket", "smtp_send", "ssh_connect", "data_upload", "data_encode_send", "dns_lookup", "socket_connect", "ftp_transfer", "network_request", "code_download")
READING = ("file_read", "token_file_read", "env_var_read", "api_key_use", "credential_store_access", "directory_list", "credential_access")
WRITING = ("file_write", "temp_file_create", "file_delete", "file_permission_change")
ACTING = ("shell_exec", "subprocess_spawn", "dynamic_import", "process_kill", "cron_schedule")
ENV_USE = ("env_var_read", "api_key_use")
EXECUTION = ("shell_exec", "subprocess_spawn")
FILES = ("file_read", "file_write", "token_file_read", "temp_file_create", "file_delete", "file_permission_change", "directory_list")
# --- fixed values: which resource types a constraint type speaks of ------------------------------------
APPLIES = {
    "path": ("path",), "path_glob": ("path",), "file_glob": ("path",), "domain": ("domain", "url"), "domain_glob": ("domain", "url"), "url": ("url",), "url_glob": ("url",), "env_var": ("env_var",), "env_glob": ("env_var",),
    "command": ("command",), "command_glob": ("command",), "query": ("query",), "user_input_only": ("path", "url", "domain", "command", "env_var", "secret"), "config_bound": ("path", "url", "domain"),
    "side_effect_bound": ("path", "url", "domain", "command", "env_var", "query", "secret"),
}
RESOURCE_TYPES = ("path", "path_glob", "file_glob", "domain", "domain_glob", "url", "url_glob", "env_var", "env_glob", "command", "command_glob", "query")
SCOPE_TYPES = ("user_input_only", "config_bound", "side_effect_bound")
# --- fixed values: wordings ----------------------------------------------------------------------------
USER_INPUT = r"(?i)\buser[- ]provided\b|\buser input\b|\bprovided by the user\b|用户提供|用户输入|任务参数"
NO_NETWORK = r"(?i)\bno network\b|\bnetwork[- ]free\b|\bnever accesses? the network\b|不访问网络|禁止联网"
READ_ONLY = r"(?i)\bread[- ]only\b|\bonly reads?\b|\bdoes not modify\b|只读|仅读取|不修改"
WRITE_ONLY = r"(?i)\bwrite[- ]only\b|\bonly writes?\b|仅写入|只写"
CONFIG = r"(?i)\bconfigured?\b|\bconfig(?:uration)?\b|\blisted in\b|\bdefined in\b|配置|配置文件"
SECRET_ENV = "ACCESS_KEY|ACCESS_TOKEN|APIKEY|API_KEY|AUTH_TOKEN|BEARER|CLIENT_SECRET|COOKIE|CREDENTIAL|PASSWORD|PRIVATE|SECRET|SESSION|TOKEN"
INLINE = r"\b(?:bash|sh)\s+-c\b|\bpython3?\s+-c\b|\bnode\s+-e\b"
SCRIPT = r"(?:^|\s)(?:\./|/)?[a-z0-9_./-]+\.(?:py|js|ts|sh|bash)\b"
SEVERITY = {"none": 0, "safe": 0, "ok": 0, "info": 1, "informational": 1, "note": 1, "warning": 2, "warn": 2, "low": 2, "medium": 3, "moderate": 3, "high": 4, "error": 4, "critical": 5, "unsafe": 5}
UNDECLARED = ("underdeclared", "undeclared", "description-behavior mismatch", "behavior mismatch", "least privilege", "permission", "scope creep", "scope violation", "excessive agency")
COMPOSITION = ("chain", "taint", "pipeline", "flow", "source-to-sink", "tool misuse", "file read to network")
SCOPE = ("scope", "permission", "least privilege", "underdeclared", "undeclared", "wildcard", "overdeclared", "unbounded resource", "excessive agency")
ATOMS = (
    ("network", "network"), ("external transmission", "network"), ("exfiltration", "network"), ("credential", "credential_access"), ("secret", "credential_access"), ("env", "credential_access"), ("file", "filesystem"),
    ("subprocess", "process_execution"), ("shell", "process_execution"), ("exec", "process_execution"), ("eval", "process_execution"), ("permission", "permission"), ("scope", "scope_boundary"), ("prompt injection", "prompt_injection"),
)


# --- patterns and paths --------------------------------------------------------------------------------
def has_glob(v: Column) -> Column:
    return v.rlike(r"[*?\[\]]")


def glob_matches(pattern: Column, value: Column) -> Column:
    """Shell pattern from a column; classes keep their meaning."""
    escaped = F.regexp_replace(pattern, r"([.+(){}|^$\\])", r"\\$1")
    regex = F.concat(F.lit("^(?:"), F.replace(F.replace(F.replace(escaped, F.lit("[!"), F.lit("[^")), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(")$"))
    return F.regexp_like(value, regex)


def plain_path(v: Column) -> Column:
    """Lower case with forward slashes, no repeated or closing slash, no ``.`` component."""
    p = F.regexp_replace(F.lower(F.translate(v, "\\", "/")), "/+", "/")
    p = F.regexp_replace(p, r"(^|/)(?:\./)+", "$1")
    return F.regexp_replace(p, r"(.)/\.?$", "$1")


def base(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def path_matches(target: Column, value: Column) -> Column:
    """Equality; a pattern against the path, its tail of two and its name; a bare name; a folder."""
    t, v = plain_path(target), plain_path(value)
    bare = lambda p: F.ltrim(p, F.lit("./"))
    tail = F.array_join(F.slice(F.split(v, "/"), F.greatest(F.lit(1), F.size(F.split(v, "/")) - 1), F.lit(2)), "/")
    shaped = F.lit(False)
    for pattern in (t, bare(t)):
        for candidate in (v, bare(v), tail, base(v)):
            shaped = shaped | glob_matches(pattern, candidate)
    slash = t.contains("/")
    folder = slash & ~base(t).rlike(r"^.+\.[^.]+$") & v.startswith(F.concat(t, F.lit("/")))
    return F.when(t == v, True).when(has_glob(t), shaped).otherwise(~slash & (t == base(v)) | folder)


def host_of(v: Column) -> Column:
    full = F.when(v.contains("://"), v).otherwise(F.concat(F.lit("h://"), v))
    return F.regexp_extract(F.lower(full), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)


def domain_matches(target: Column, value: Column) -> Column:
    """Equal hosts, a pattern, or for ``*.suffix`` a host below the suffix but not the suffix itself."""
    t, h = F.rtrim(host_of(target), F.lit(".")), host_of(value)
    below = h.endswith(F.substring(t, 2, 1_000)) & (h != F.substring(t, 3, 1_000))
    return (h != "") & F.when(t.startswith("*."), below).when(has_glob(t), glob_matches(t, h)).otherwise(t == h)


def name_matches(target: Column, value: Column) -> Column:
    return F.when(target == value, True).when(has_glob(target), glob_matches(target, value)).otherwise(False)


def constraint_matches(ctype: Column, cvalue: Column, rtype: Column, rvalue: Column) -> Column:
    """Whether a resource lies within a constraint; constraints of scope match nothing by themselves."""
    command = lambda c: base(F.lower(c))
    return (
        F.when(ctype.isin("path", "path_glob", "file_glob"), (rtype == "path") & path_matches(cvalue, rvalue))
        .when(ctype.isin("domain", "domain_glob"), rtype.isin("domain", "url") & domain_matches(cvalue, rvalue))
        .when(ctype.isin("url", "url_glob"), (rtype == "url") & name_matches(F.lower(cvalue), F.lower(rvalue)))
        .when(ctype.isin("env_var", "env_glob"), (rtype == "env_var") & name_matches(F.upper(cvalue), F.upper(rvalue)))
        .when(ctype.isin("command", "command_glob"), (rtype == "command") & name_matches(command(cvalue), command(rvalue)))
        .when(ctype.isin(*SCOPE_TYPES), False)
        .otherwise((ctype == rtype) & (F.lower(cvalue) == F.lower(rvalue)))
    )


def target_matches(target: Column, rtype: Column, rvalue: Column) -> Column:
    """Whether a resource is what a clause's target names."""
    return (
        F.when(rtype == "path", path_matches(target, rvalue)).when(rtype.isin("url", "domain"), domain_matches(target, rvalue)).when(rtype == "env_var", name_matches(F.upper(target), F.upper(rvalue)))
        .when(rtype == "command", name_matches(base(F.lower(target)), base(F.lower(rvalue)))).otherwise(F.lower(target) == F.lower(rvalue))
    )


def applies(ctype: Column, rtype: Column) -> Column:
    found = None
    for kind, types in APPLIES.items():
        found = F.when(ctype == kind, rtype.isin(*types)) if found is None else found.when(ctype == kind, rtype.isin(*types))
    return found.otherwise(ctype == rtype)


def constraint_status(ctype: Column, cvalue: Column, rtype: Column, rvalue: Column, origin: Column, resolved: Column, capability: Column) -> Column:
    """true, false or abstain of one constraint against one resource that it applies to."""
    user = F.when(origin.isin("env", "config_file", "artifact"), "false").when(origin == "user_input", "true").otherwise("abstain")
    config = F.when(origin.isin("env", "user_input", "artifact"), "false").when(origin == "config_file", "true").otherwise("abstain")
    bound = F.lower(F.trim(cvalue))
    effect = (
        F.when(bound == "no_network", F.when(capability.isin(*NETWORK), "false").otherwise("true"))
        .when(bound == "read_only", F.when(capability.isin(*NETWORK, *WRITING, *ACTING), "false").when(capability.isin(*READING), "true").otherwise("abstain"))
        .when(bound == "write_only", F.when(capability.isin(*READING), "false").when(capability.isin(*WRITING), "true").otherwise("abstain"))
        .otherwise("abstain")
    )
    plain = F.when(constraint_matches(ctype, cvalue, rtype, rvalue), "true").otherwise("false")
    return F.when(~resolved, "abstain").when(ctype == "user_input_only", user).when(ctype == "config_bound", config).when(ctype == "side_effect_bound", effect).otherwise(plain)


# --- typing of constraints -----------------------------------------------------------------------------
def clean_surface(v: Column) -> Column:
    """Without outer spaces and one pair of quotes; null where nothing is left."""
    t = F.trim(v)
    return F.nullif(F.trim(F.regexp_replace(t, "(?s)^[`\"'](.*)[`\"']$", "$1")), F.lit(""))


def typed_constraint(capability: Column, value: Column) -> Column:
    """``struct(kind, value)`` of a constraint's wording, null where it has no type. What a wording
    may be depends on the capability; semantic wordings go before all."""
    v = clean_surface(value)
    as_ = lambda kind, val=None: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), (val if val is not None else v).alias("value"))
    glob = has_glob(v)
    semantic = (
        F.when(v.rlike(USER_INPUT), as_("user_input_only", F.lit("user_input_only"))).when(v.rlike(NO_NETWORK), as_("side_effect_bound", F.lit("no_network"))).when(v.rlike(READ_ONLY), as_("side_effect_bound", F.lit("read_only")))
        .when(v.rlike(WRITE_ONLY), as_("side_effect_bound", F.lit("write_only"))).when(v.rlike(CONFIG), as_("config_bound"))
    )
    is_url = v.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    is_domain = v.rlike(r"^(?:\*\.)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?:/[^\s]*)?$") & ~F.substring_index(v, "/", 1).rlike(r"(?i)^(?:\*\.)?[^.]+\.(?:bash|cfg|csv|css|html|ini|js|json|log|md|pdf|png|py|sh|sql|svg|toml|ts|txt|xml|yaml|yml)$")
    is_env = v.rlike(r"^[A-Z][A-Z0-9_]*(?:[*?][A-Z0-9_]*)*$")
    path_like = v.rlike(r"[/\\]") | ~v.startswith("*.") & v.rlike(r"\.[A-Za-z0-9]{1,8}(?:$|[*?])")
    network = F.when(is_url, as_(F.when(glob, "url_glob").otherwise("url"))).when(is_domain, as_(F.when(glob, "domain_glob").otherwise("domain")))
    env = F.when(is_env, as_(F.when(glob, "env_glob").otherwise("env_var")))
    file = F.when(v == "*", as_("path_glob")).when(v.startswith("*.") | v.startswith("**/*."), as_("file_glob")).when(path_like, as_(F.when(glob, "path_glob").otherwise("path")))
    head = F.rtrim(F.regexp_extract(v, r"^(\S+)", 1), F.lit(",:;"))
    runs = head.rlike(r"(?i)^(?:python3?|bash|sh|zsh|uv|pip3?|npm|pnpm|poetry|node|npx)\b|[/\\]|^~/|\.(?:py|sh|bash|js|ts|mjs|cjs)$|[*?\[\]]")
    command = F.when(~is_url & ~is_domain & ~is_env & runs, as_(F.when(has_glob(head), "command_glob").otherwise("command"), head))
    query = F.when(v.rlike(r"(?i)\b(?:select|insert|update|delete|create|alter|drop)\b"), as_("query"))
    by_class = (
        F.when(capability.isin(*ENV_USE), env).when(capability.isin(*NETWORK), network).when(capability.isin(*EXECUTION), command).when(capability.isin(*FILES), file)
        .otherwise(F.coalesce(F.when(capability == "sql_exec", query), network, env, file, command))
    )
    return F.coalesce(semantic, by_class)


# --- sensitivity ---------------------------------------------------------------------------------------
def capability_family(capability: Column, text: Column) -> Column:
    """A label more stable than the capability: secret or plain variables, wrappers or side effects."""
    secret = text.rlike(rf"\b[A-Z0-9_]*(?:{SECRET_ENV})[A-Z0-9_]*\b")
    return F.when(capability == "env_var_read", F.when(secret, "secret_env_var_read").otherwise("config_env_var_read")).when(
        capability.isin(*EXECUTION), F.concat(F.when(wrapper(text), "wrapper_").otherwise("side_effect_"), capability)).otherwise(capability)


def wrapper(text: Column) -> Column:
    """A call that only starts a script or a package's command."""
    low = F.lower(text)
    script = low.rlike("^(?:python3?|node|bash|sh) ") & low.rlike(SCRIPT)
    return F.coalesce(~low.rlike(INLINE) & (script | low.rlike("^(?:uv run|poetry run|npm run|pnpm run|npx) ")), F.lit(False))


def needs_authorization(capability: Column, text: Column, required: tuple[str, ...]) -> Column:
    family = capability_family(capability, text)
    return capability.isin(*required) & ~family.startswith("wrapper_") & (family != "config_env_var_read")


# --- external reports ----------------------------------------------------------------------------------
def severity(value: Column) -> Column:
    """Rank of a severity name, else of the highest one among its words, else 0."""
    words = F.split(F.trim(F.translate(F.lower(value), "_-", "  ")), r"\s+")
    ranks = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    return F.coalesce(F.array_max(F.transform(words, lambda w: F.coalesce(F.try_element_at(ranks, w), F.lit(0)))), F.lit(0))


def mentions(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def report_label(rank: Column, text: Column, unsafe: Column) -> Column:
    low = F.lower(text)
    return F.when((rank >= SEVERITY["high"]) | F.coalesce(mentions(low, UNDECLARED), F.lit(False)) | F.coalesce(unsafe, F.lit(False)), "violation").otherwise("exposure-only")


def report_subtype(text: Column) -> Column:
    low = F.lower(text)
    return F.when(mentions(low, COMPOSITION), "unjustified_composition").when(mentions(low, SCOPE), "scope_violation").otherwise("unsupported_behavior")


def report_atoms(text: Column) -> Column:
    low = F.lower(text)
    return F.array_distinct(F.array_compact(F.array(*(F.when(low.contains(word), F.lit(atom)) for word, atom in ATOMS))))
