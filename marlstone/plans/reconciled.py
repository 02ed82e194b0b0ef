"""Clauses, events and resources of the test tables, and the reconciliation over them, each beside its SQL.

Declared: permissions of a skill's latest manifest allow, prohibitions in its documents forbid, orders
in them leave open. Observed: observations are events, those without a unit being instructions only;
their targets are resources.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as X
from ..operators import graph as G
from ..operators import reconcile as C
from .queries import _FAMILY, _OBS, _PERM, _quoted, observed, permissions, query, t

#: Verbs of the documents to the capability that they speak of (the vocabulary of the test tables).
VERBS = {
    "open": "file_read", "verify": "file_read", "review": "file_read", "check": "file_read", "compare": "file_read", "list": "file_read", "describe": "file_read",
    "update": "file_write", "rename": "file_write", "remove": "file_write", "replace": "file_write", "copy": "file_write", "archive": "file_write", "pin": "file_write", "export": "network_request", "run": "shell_exec",
}
#: Scope that a permission carries.
BOUNDS = {"network_request": ("config_bound", "configured"), "file_write": ("user_input_only", "user_input_only"), "file_read": ("side_effect_bound", "read_only"), "shell_exec": ("side_effect_bound", "no_network")}
REQUIRED = ("credential_access", "network_request", "shell_exec", "subprocess_spawn", "code_download", "env_var_read")


def _verb(column):
    return F.coalesce(*(F.when(column == k, F.lit(v)) for k, v in VERBS.items()))


_VERB = "case " + " ".join(f"when {{0}} = '{k}' then '{v}'" for k, v in VERBS.items()) + " end"


def environment(spark, d):
    """``(skill_id, name, value)`` of the latest manifest of each skill that can be read."""
    s = t(spark, d, "skill_specs").select("skill_id", "spec_id", F.try_parse_json("spec").alias("v"))
    s = s.select("skill_id", "spec_id", F.expr("try_variant_get(v, '$.spec.env', 'map<string,string>')").alias("env")).where("env is not null")
    return s.groupBy("skill_id").agg(F.max_by("env", "spec_id").alias("env")).select("skill_id", F.explode("env").alias("name", "value")).where("value is not null")


def events(spark, d):
    o = observed(spark, d).where("capability is not null")
    text = F.concat_ws(" ", "api_call", "target")
    return o.select("skill_id", F.col("obs_id").alias("event_id"), "unit_id", "capability", "api_call", F.when(F.col("unit_id").isNull(), "instruction").otherwise("code").alias("tier"), F.col("relative_path").alias("file_path"), "line", F.lit(None).cast("string").alias("detail"), rules.capability_family(F.col("capability"), text).alias("family"), rules.needs_authorization(F.col("capability"), text, REQUIRED).alias("needs"))


def resources(spark, d):
    o = observed(spark, d).where("capability is not null and target is not null")
    v = F.col("target")
    kind = X.resource_kind(v)
    rtype = F.when(kind.isin("dynamic", "env"), "env_var").otherwise(kind)
    origin = F.when(v.startswith("$"), "env").when(v.contains(".internal."), "config_file").when(v.startswith("/tmp/"), "artifact").when(v.contains(".invalid"), "user_input").otherwise("literal")
    return o.select("skill_id", F.col("obs_id").alias("event_id"), F.col("obs_id").alias("resource_id"), rtype.alias("rtype"), v.alias("rvalue"), (~v.startswith("$")).alias("resolved"), origin.alias("origin"))


def clauses(spark, d):
    p = permissions(spark, d).select("skill_id", F.concat(F.lit("a|"), "capability").alias("clause_id"), "capability", F.lit("allowed").alias("operator"))
    docs = t(spark, d, "documents").where("skill_id is not null and text is not null").select("skill_id", "text")

    def said(pattern, sign, operator):
        words = docs.select("skill_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("word")).select("skill_id", F.lower("word").alias("word")).distinct()
        return words.select("skill_id", F.concat(F.lit(sign), "word").alias("clause_id"), _verb(F.col("word")).alias("capability"), F.lit(operator).alias("operator")).where("capability is not null")

    rows = p.unionByName(said(r"Do not (\w+)", "p|", "prohibited")).unionByName(said(r"(?:^|[.\n] ?)(Run|Open|Copy|Replace|Check|Compare) ", "u|", "unknown"))
    return rows.withColumns({"target": F.lit(None).cast("string"), "aligned": F.lit(None).cast("boolean")})


def constraints(spark, d):
    p = permissions(spark, d).withColumn("clause_id", F.concat(F.lit("a|"), "capability"))
    bound = F.coalesce(*(F.when(F.col("capability") == k, F.struct(F.lit(a).alias("ctype"), F.lit(b).alias("cvalue"))) for k, (a, b) in BOUNDS.items()))
    scope = p.select("skill_id", "clause_id", bound.alias("b")).where("b is not null").select("skill_id", "clause_id", F.concat_ws("|", "clause_id", "b.ctype").alias("constraint_id"), "b.ctype", "b.cvalue")
    env = environment(spark, d)
    url = env.where(F.col("value").rlike("^https?://")).select("skill_id", F.lit("domain").alias("ctype"), rules.host_of(F.col("value")).alias("cvalue"), F.array(F.lit("network_request"), F.lit("code_download")).alias("caps"))
    path = env.where(F.col("value").startswith("/")).select("skill_id", F.lit("path_glob").alias("ctype"), F.concat(F.regexp_extract("value", "^(/[^/]*)", 1), F.lit("/*")).alias("cvalue"), F.array(F.lit("file_write")).alias("caps"))
    narrow = url.unionByName(path).select("skill_id", F.explode("caps").alias("capability"), "ctype", "cvalue").distinct().join(p, ["skill_id", "capability"])
    return scope.unionByName(narrow.select("skill_id", "clause_id", F.concat_ws("|", "clause_id", "ctype", "cvalue").alias("constraint_id"), "ctype", "cvalue"))


class Stages:
    """The stages of one run. Those that several later ones read are checkpointed, so that each is
    computed once and a lost executor costs no more than its own tasks."""

    def __init__(self, spark, d):
        G.shared_dir(spark)
        self.clauses, self.constraints = clauses(spark, d).checkpoint(), constraints(spark, d).checkpoint()
        self.events, self.resources = events(spark, d), resources(spark, d)
        self.sensitive = self.events.where("needs").select("skill_id", "event_id")

    @cached_property
    def candidates(self):
        return C.candidates(C.hits(self.clauses, self.constraints, self.events, self.resources)).checkpoint()

    @cached_property
    def checks(self):
        return C.scope_checks(self.candidates, self.constraints, self.events, self.resources)

    @cached_property
    def judged(self):
        return C.judged(self.candidates, self.clauses, self.constraints, self.events, self.resources).checkpoint()

    @cached_property
    def edges(self):
        return C.edges(self.judged, self.checks).checkpoint()

    @cached_property
    def certificates(self):
        return C.certificates(self.judged, self.edges, self.events).checkpoint()

    @cached_property
    def findings(self):
        return C.findings(self.certificates, self.events, self.sensitive)

    @cached_property
    def exposures(self):
        return C.exposures(self.edges, self.certificates, self.events, self.sensitive)


_HOST = "regexp_extract(lower(case when contains({0}, '://') then {0} else 'h://' || {0} end), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)"
_PATH = "regexp_replace(regexp_replace(regexp_replace(lower(replace({0}, '\\', '/')), '/+', '/', 'g'), '(^|/)(?:\\./)+', '\\1', 'g'), '(.)/\\.?$', '\\1')"
_BASE = "split_part({0}, '/', -1)"
_SECRETS = rf"\b[A-Z0-9_]*(?:{rules.SECRET_ENV})[A-Z0-9_]*\b"
_FAM = "case when capability = 'env_var_read' then case when regexp_matches({0}, '" + _SECRETS + "') then 'secret_env_var_read' else 'config_env_var_read' end when capability in ('shell_exec', 'subprocess_spawn') then case when not regexp_matches(lower({0}), '" + rules.INLINE + "') and (regexp_matches(lower({0}), '^(?:python3?|node|bash|sh) ') and regexp_matches(lower({0}), '" + rules.SCRIPT + "') or regexp_matches(lower({0}), '^(?:uv run|poetry run|npm run|pnpm run|npx) ')) then 'wrapper_' else 'side_effect_' end || capability else capability end"
_RKIND = "case when starts_with(target, '$') then 'env_var' when regexp_matches(target, '^[a-z]+://') then 'url' when regexp_matches(target, '^[A-Z][A-Z0-9_]+$') then 'env_var' when starts_with(target, '/') or starts_with(target, './') or starts_with(target, '~') then 'path' when regexp_matches(target, '^[a-z0-9-]+(\\.[a-z0-9-]+)+$') then 'domain' else 'command' end"
_NET, _READ, _WRITE, _ACT = (_quoted(x) for x in (rules.NETWORK, rules.READING, rules.WRITING, rules.ACTING))
TABLES = f"""{_OBS}, {_PERM},
ev0 as (select skill_id, obs_id as event_id, unit_id, capability, api_call, target, case when unit_id is null then 'instruction' else 'code' end as tier, relative_path as file_path, concat_ws(' ', api_call, target) as tx from obs where capability is not null),
ev as (select *, {_FAM.format('tx')} as family, {_FAMILY.format('capability')} as group_ from ev0),
sens as (select skill_id, event_id from ev where capability in ({_quoted(REQUIRED)}) and not starts_with(family, 'wrapper_') and family <> 'config_env_var_read'),
re as (select skill_id, obs_id as event_id, obs_id as resource_id, {_RKIND} as rtype, target as rvalue, not starts_with(target, '$') as resolved,
  case when starts_with(target, '$') then 'env' when contains(target, '.internal.') then 'config_file' when starts_with(target, '/tmp/') then 'artifact' when contains(target, '.invalid') then 'user_input' else 'literal' end as origin
  from obs where capability is not null and target is not null),
dw as (select distinct skill_id, lower(unnest(regexp_extract_all(text, 'Do not (\\w+)', 1))) as word from documents where skill_id is not null and text is not null),
uw as (select distinct skill_id, lower(unnest(regexp_extract_all(text, '(?:^|[.\\n] ?)(Run|Open|Copy|Replace|Check|Compare) ', 1))) as word from documents where skill_id is not null and text is not null),
cl as (select skill_id, 'a|' || capability as clause_id, capability, 'allowed' as operator from perm
  union all select skill_id, 'p|' || word, {_VERB.format('word')}, 'prohibited' from dw where {_VERB.format('word')} is not null
  union all select skill_id, 'u|' || word, {_VERB.format('word')}, 'unknown' from uw where {_VERB.format('word')} is not null),
en0 as (select skill_id, arg_max(j, spec_id) as j from (select skill_id, spec_id, json_extract(try_cast(spec as json), '$.spec.env') as j from skill_specs) where j is not null and json_type(j) = 'OBJECT' group by skill_id),
en as (select skill_id, json_extract_string(j, '$."' || k || '"') as value from (select skill_id, j, unnest(json_keys(j)) as k from en0)),
na as (select distinct skill_id, unnest(['network_request', 'code_download']) as capability, 'domain' as ctype, {_HOST.format('value')} as cvalue from en where regexp_matches(value, '^https?://')
  union select distinct skill_id, 'file_write', 'path_glob', regexp_extract(value, '^(/[^/]*)', 1) || '/*' from en where starts_with(value, '/')),
bo(capability, ctype, cvalue) as (values {', '.join(f"('{k}', '{a}', '{b}')" for k, (a, b) in BOUNDS.items())}),
cs as (select skill_id, 'a|' || capability as clause_id, 'a|' || capability || '|' || ctype as constraint_id, ctype, cvalue from perm join bo using (capability)
  union all select skill_id, 'a|' || capability, 'a|' || capability || '|' || ctype || '|' || cvalue, ctype, cvalue from na join perm using (skill_id, capability))"""
_OVER = f"lower(cvalue) = lower(rvalue) or ({_BASE.format(_PATH.format('cvalue'))} <> '' and {_BASE.format(_PATH.format('cvalue'))} = {_BASE.format(_PATH.format('rvalue'))}) or starts_with(rvalue, cvalue) or starts_with(cvalue, rvalue)"
CANDIDATES = f"""{TABLES},
hit as (select distinct c.skill_id, c.clause_id, e.event_id, 'capability' as source from cl c join ev e on c.skill_id = e.skill_id and {_FAMILY.format('c.capability')} = e.group_ where e.group_ <> 'other' or c.capability = e.capability
  union select s.skill_id, s.clause_id, r.event_id, 'literal_overlap' from cs s join re r on s.skill_id = r.skill_id and r.resolved where s.ctype not in ({_quoted(rules.SCOPE_TYPES)}) and ({_OVER})),
cd0 as (select skill_id, clause_id, event_id, string_agg(source, ',' order by source) as sources, sum(case source when 'literal_overlap' then 40 else 30 end) as strength from hit group by 1, 2, 3),
cd as (select * from (select *, row_number() over (partition by skill_id, event_id order by strength desc, clause_id) as place from cd0) where place <= 8)"""
_CMATCH = f"""case when ctype = 'path_glob' then rtype = 'path' and starts_with({_PATH.format('rvalue')}, left(cvalue, length(cvalue) - 1)) when ctype = 'domain' then rtype in ('domain', 'url') and {_HOST.format('rvalue')} <> '' and {_HOST.format('rvalue')} = {_HOST.format('cvalue')} else false end"""
_STATUS = f"""case when not resolved then 'abstain' when ctype = 'user_input_only' then case when origin in ('env', 'config_file', 'artifact') then 'false' when origin = 'user_input' then 'true' else 'abstain' end
  when ctype = 'config_bound' then case when origin in ('env', 'user_input', 'artifact') then 'false' when origin = 'config_file' then 'true' else 'abstain' end
  when cvalue = 'no_network' then case when capability in ({_NET}) then 'false' else 'true' end
  when cvalue = 'read_only' then case when capability in ({_NET}, {_WRITE}, {_ACT}) then 'false' when capability in ({_READ}) then 'true' else 'abstain' end else 'abstain' end"""
JUDGED = f"""{CANDIDATES},
ck as (select d.skill_id, d.clause_id, d.event_id, s.constraint_id, r.resource_id, s.ctype, {_STATUS} as result from cd d join cs s using (skill_id, clause_id) join ev e using (skill_id, event_id) join re r using (skill_id, event_id)
  where s.ctype in ({_quoted(rules.SCOPE_TYPES)}) and case s.ctype when 'config_bound' then r.rtype in ('path', 'url', 'domain') when 'user_input_only' then r.rtype in ('path', 'url', 'domain', 'command', 'env_var', 'secret') else true end),
sh as (select skill_id, clause_id, bool_or(ctype in ({_quoted(rules.RESOURCE_TYPES)})) as narrowed, bool_or(ctype in ({_quoted(rules.SCOPE_TYPES)})) as scoped, count(*) as n_cs from cs group by 1, 2),
mt as (select d.skill_id, d.clause_id, d.event_id, count(distinct r.resource_id) as n_re, bool_or(r.resolved) as resolved, bool_or(r.resolved and coalesce({_CMATCH}, false)) as matched
  from cd d join re r using (skill_id, event_id) left join (select * from cs where ctype in ({_quoted(rules.RESOURCE_TYPES)})) s using (skill_id, clause_id) group by 1, 2, 3),
sc as (select skill_id, clause_id, event_id, count(*) as n_ck, count(*) filter (result = 'false') as failed, count(*) filter (result = 'abstain') as open_, count(*) filter (result = 'true') as passed from ck group by 1, 2, 3),
j0 as (select d.*, c.operator, c.capability as ccap, e.capability as cap_e, e.tier, coalesce(narrowed, false) as given, coalesce(scoped, false) as scoped, coalesce(n_cs, 0) as n_cs, coalesce(n_re, 0) as n_re, coalesce(m.resolved, false) as resolved, coalesce(matched, false) as matched,
   coalesce(n_ck, 0) as n_ck, coalesce(failed, 0) as failed, coalesce(open_, 0) as open_, coalesce(passed, 0) as passed
   from cd d join cl c using (skill_id, clause_id) join ev e using (skill_id, event_id) left join sh using (skill_id, clause_id) left join mt m using (skill_id, clause_id, event_id) left join sc using (skill_id, clause_id, event_id)),
j1 as (select *, case when ccap = cap_e or ({_FAMILY.format('ccap')} <> 'other' and {_FAMILY.format('ccap')} = {_FAMILY.format('cap_e')}) then 'true' else 'false' end as cap, case when tier = 'instruction' then 'abstain' else 'true' end as route,
   case when not given or n_re = 0 or not resolved then 'abstain' when matched then 'true' else 'false' end as res, case when not scoped then 'true' when n_ck = 0 then 'abstain' when failed > 0 then 'false' when open_ > 0 then 'abstain' else 'true' end as scp from j0),
jd as (select *, case when operator = 'allowed' then case when cap <> 'true' then cap when route <> 'true' then route when given and res <> 'true' then res else scp end end as auth,
   case when operator = 'prohibited' then case when cap = 'false' then 'false' when n_cs = 0 then 'true' when res = 'true' then 'true' else 'abstain' end end as prohibited, contains(sources, 'literal_overlap') as anchored,
   cap = 'true' and not (given and res = 'false') and failed = 0 as usable from j1),
jr as (select *, case when auth = 'abstain' then case when route = 'abstain' then 'route_check_abstained' when given and res = 'abstain' then 'resource_compatibility_abstained' else 'scope_check_abstained' end end as reason from jd)"""
EDGES = f"""{JUDGED},
ed as (select skill_id, case when prohibited = 'true' then 'contradicts' when auth = 'true' then 'supports' when auth = 'abstain' and usable and (anchored or given and res = 'true' or passed > 0) then 'potentially_supports' when operator = 'unknown' and usable then 'relates_to' end as relation,
   clause_id, event_id, null::varchar as constraint_id, null::varchar as resource_id from jr
  union all select k.skill_id, case when result = 'true' then 'scope_matches' when result = 'false' and j.operator = 'allowed' and j.cap = 'true' and j.route = 'true' then 'scope_violates' end, k.clause_id, k.event_id, k.constraint_id, cast(k.resource_id as varchar) from ck k join jr j using (skill_id, clause_id, event_id)),
eg as (select distinct * from ed where relation is not null)"""
CERTS = f"""{EDGES},
al as (select e.* from ev e where tier <> 'instruction' and not exists (select 1 from eg g where g.skill_id = e.skill_id and g.event_id = e.event_id and g.relation = 'scope_violates') and not exists (select 1 from jr j where j.skill_id = e.skill_id and j.event_id = e.event_id and j.auth in ('true', 'abstain'))),
ct as (select skill_id, 'no_support' as kind, concat_ws('|', coalesce(unit_id, ''), capability, tier, coalesce(api_call, ''), file_path) as subject, event_id from al
  union all select skill_id, 'blocking_prohibition', clause_id || '|' || cast(event_id as varchar), event_id from eg where relation = 'contradicts'
  union all select skill_id, 'scope_failure', constraint_id || '|' || resource_id, event_id from eg where relation = 'scope_violates'),
bl as (select distinct skill_id, event_id from ct where kind = 'blocking_prohibition' or kind = 'no_support' and (skill_id, event_id) in (select skill_id, event_id from sens))"""
FINDINGS = f"""{CERTS},
fr as (select c.skill_id, c.kind, c.subject, c.event_id, e.family, e.file_path from ct c join ev e using (skill_id, event_id) where c.kind <> 'no_support' or (c.skill_id, c.event_id) in (select skill_id, event_id from sens)),
fe as (select skill_id, kind, subject, case when kind = 'no_support' then concat_ws('|', string_agg(distinct family, ',' order by family), string_agg(distinct file_path, ',' order by file_path)) else subject end as signature from fr group by 1, 2, 3),
fi as (select fe.skill_id, case fe.kind when 'no_support' then 'unsupported_behavior' when 'blocking_prohibition' then 'contradicted_behavior' else 'scope_violation' end as finding_type, signature, case when fe.kind = 'no_support' then 'diagnostic' else 'graph_backed' end as support,
  cast(count(distinct fe.subject) as bigint) as certificates, cast(count(distinct fr.event_id) as bigint) as events from fe join fr using (skill_id, kind, subject) group by 1, 2, 3, 4),
ex as (select g.skill_id, 'declared_sensitive_behavior' as exposure_type, e.family, e.file_path, cast(count(distinct g.event_id) as bigint) as events, cast(count(distinct g.clause_id) as bigint) as clauses, 'strong' as support_strength
  from eg g join ev e using (skill_id, event_id) where g.relation = 'supports' and e.tier <> 'instruction' and (g.skill_id, g.event_id) in (select skill_id, event_id from sens) and (g.skill_id, g.event_id) not in (select skill_id, event_id from bl)
  and not exists (select 1 from eg v where v.skill_id = g.skill_id and v.event_id = g.event_id and v.relation = 'scope_violates') group by 1, 2, 3, 4)"""


@query(f"with {TABLES} select skill_id, clause_id, capability, operator from cl")
def declared_clauses(spark, d):
    return clauses(spark, d).select("skill_id", "clause_id", "capability", "operator")


@query(f"with {TABLES} select skill_id, clause_id, constraint_id, ctype, cvalue from cs")
def declared_constraints(spark, d):
    return constraints(spark, d)


@query(f"with {TABLES} select capability, family, tier, cast(count(*) as bigint) as events, cast(count(*) filter ((skill_id, event_id) in (select skill_id, event_id from sens)) as bigint) as needing from ev group by 1, 2, 3")
def event_sensitivity(spark, d):
    """Events by capability family, and how many of them need authorization."""
    return events(spark, d).groupBy("capability", "family", "tier").agg(F.count("*").alias("events"), F.count_if("needs").alias("needing"))


@query(f"with {TABLES} select rtype, origin, resolved, cast(count(*) as bigint) as uses, cast(count(distinct rvalue) as bigint) as distinct_values from re group by 1, 2, 3")
def resource_uses(spark, d):
    return resources(spark, d).groupBy("rtype", "origin", "resolved").agg(F.count("*").alias("uses"), F.countDistinct("rvalue").alias("distinct_values"))


@query(f"with {CANDIDATES} select skill_id, clause_id, event_id, sources, cast(strength as bigint) as strength, place from cd")
def candidate_pairs(spark, d):
    """The candidate driver: hits by capability family and by literals, merged, eight an event."""
    return Stages(spark, d).candidates.select("skill_id", "clause_id", "event_id", F.array_join("sources", ",").alias("sources"), F.col("strength").cast("bigint").alias("strength"), "place")


@query(f"with {JUDGED} select skill_id, clause_id, event_id, constraint_id, resource_id, result from ck")
def scope_checks(spark, d):
    return Stages(spark, d).checks.select("skill_id", "clause_id", "event_id", "constraint_id", "resource_id", "result")


@query(f"with {JUDGED} select skill_id, clause_id, event_id, operator, cap, route, res, scp, auth, reason, prohibited from jr")
def judgments(spark, d):
    """All results of each candidate, with the reason of an abstention."""
    return Stages(spark, d).judged.select("skill_id", "clause_id", "event_id", "operator", "cap", "route", "res", "scp", "auth", "reason", "prohibited")


@query(f"with {EDGES} select skill_id, relation, clause_id, event_id, constraint_id, resource_id from eg")
def projection_edges(spark, d):
    return Stages(spark, d).edges.drop("strength")


@query(f"with {CERTS} select skill_id, kind, subject, cast(count(distinct event_id) as bigint) as events from ct group by 1, 2, 3")
def certificates(spark, d):
    rows = Stages(spark, d).certificates.select("skill_id", "kind", "subject", F.explode("events").alias("e"))
    return rows.groupBy("skill_id", "kind", "subject").agg(F.countDistinct("e").alias("events"))


@query(f"with {FINDINGS} select skill_id, finding_type, signature, support, certificates, events from fi")
def findings(spark, d):
    """Unsupported, contradicted and out-of-scope behaviour, merged by type and signature."""
    return Stages(spark, d).findings


@query(f"with {FINDINGS} select skill_id, exposure_type, family, file_path, events, clauses, support_strength from ex")
def exposures(spark, d):
    return Stages(spark, d).exposures


@query(f"""with {EDGES},
gp as (select j.skill_id, j.event_id, j.clause_id, e.family, exists (select 1 from eg g where g.skill_id = j.skill_id and g.clause_id = j.clause_id and g.event_id = j.event_id) as backed from jr j join ev e using (skill_id, event_id) where auth = 'abstain' and (j.skill_id, j.event_id) in (select skill_id, event_id from sens)),
pl as (select e.skill_id, e.event_id, e.file_path, e.family, exists (select 1 from eg g where g.skill_id = e.skill_id and g.event_id = e.event_id) as backed from ev e where tier = 'instruction' and (skill_id, event_id) in (select skill_id, event_id from sens)
  and (skill_id, event_id) not in (select skill_id, event_id from gp) and not exists (select 1 from eg g where g.skill_id = e.skill_id and g.event_id = e.event_id and g.relation in ('supports', 'contradicts')))
select skill_id, 'policy_gap' as diagnostic_type, clause_id as subject, family, cast(count(distinct event_id) as bigint) as events, case when bool_or(backed) then 'graph_backed' else 'diagnostic' end as support from gp group by 1, 2, 3, 4
union all select skill_id, 'planned_behavior_gap', file_path, family, cast(count(distinct event_id) as bigint), case when bool_or(backed) then 'graph_backed' else 'diagnostic' end from pl group by 1, 2, 3, 4""")
def diagnostics(spark, d):
    r = Stages(spark, d)
    return C.diagnostics(r.judged, r.edges, r.events, r.sensitive)


@query(f"""with {FINDINGS}, sk as (select distinct skill_id from ev), v as (select skill_id, count(*) as n from fi group by 1), x as (select skill_id, count(*) as n from ex group by 1)
select skill_id, cast(coalesce(v.n, 0) as bigint) as violations, cast(coalesce(x.n, 0) as bigint) as exposures, case when v.n > 0 then 'violation' when x.n > 0 then 'exposure-only' else 'benign' end as label from sk left join v using (skill_id) left join x using (skill_id)""")
def system_reports(spark, d):
    """The label of each skill: violation before exposure-only before benign."""
    r = Stages(spark, d)
    return C.system_report(r.events, r.findings, r.exposures)
