"""Paths, bridges, commands and resources of the test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import behaviour as B
from ..operators import reconcile as C
from .queries import _OBS, _quoted, observed, query, t
from .reconciled import EDGES, TABLES, Stages

_GAPS = "case " + " ".join(f"when a.capability = '{a}' and b.capability = '{b}' then {g}" for (a, b), g in B.GAPS.items()) + f" else {B.GAP} end"
_PATHS = f"""pp as (select a.file_key as unit, a.capability as source_cap, b.capability as sink_cap, a.obs_id as source_event, b.obs_id as sink_event, case when a.line = 0 or b.line = 0 then 0 else b.line - a.line end as gap
   from obs a join obs b on a.file_key = b.file_key and a.obs_id <> b.obs_id where a.capability in ({_quoted(X.SOURCES)}) and b.capability in ({_quoted(X.SINKS)}) and (a.line = 0 or b.line = 0 or b.line - a.line between 0 and {_GAPS})),
pb as (select * from (select *, row_number() over (partition by unit, source_cap, sink_cap order by gap, source_event, sink_event) as r from pp) where r = 1)"""


def _paths(spark, d):
    o = observed(spark, d).where("capability is not null").select(F.col("file_key").alias("unit"), F.col("obs_id").alias("event_id"), "capability", "line")
    return B.paths_within(o, X.SOURCES, X.SINKS)


@query(f"with {_OBS}, {_PATHS} select unit, source_cap, sink_cap, source_event, sink_event, cast(gap as integer) as gap from pb")
def risk_paths(spark, d):
    """The nearest source and sink of each two capabilities in a file; lines of 0 meet any line."""
    return _paths(spark, d)


@query(f"""with {EDGES}, {_PATHS}, st as (select s.skill_id, concat_ws('|', unit, source_cap, sink_cap) as path_id, case when s.unit_id is null or k.unit_id is null then 'abstain' else 'true' end as route, source_event, sink_event from pb join obs s on s.obs_id = source_event join obs k on k.obs_id = sink_event),
sp as (select skill_id, path_id, route, source_event as event_id from st union select skill_id, path_id, route, sink_event from st),
be as (select skill_id, event_id, count(*) filter (relation = 'supports') as strong, count(*) filter (relation in ('potentially_supports', 'relates_to')) as weak, count(*) filter (relation = 'contradicts') as against from eg group by 1, 2),
pr as (select skill_id, path_id, route, count(*) as n, sum(x) as needed, sum(coalesce(against, 0)) as against, sum(case when x = 1 and coalesce(strong, 0) = 0 and coalesce(weak, 0) = 0 then 1 else 0 end) as none_, sum(case when x = 1 and coalesce(strong, 0) = 0 and coalesce(weak, 0) > 0 then 1 else 0 end) as partial_
  from (select sp.*, be.strong, be.weak, be.against, case when (skill_id, event_id) in (select skill_id, event_id from sens) then 1 else 0 end as x from sp left join be using (skill_id, event_id)) group by 1, 2, 3),
re2 as (select *, case when route <> 'true' then route when needed = 0 then 'abstain' when against > 0 then 'false' when none_ > 0 then 'false' when partial_ > 0 then 'abstain' else 'true' end as result from pr)
select skill_id, path_id, route, cast(needed as bigint) as needed, result, case when result = 'abstain' then case when route = 'abstain' then 'route_check_abstained' when needed = 0 then 'open_world_path_only' else 'partial_path_coverage' end end as reason from re2""")
def path_justifications(spark, d):
    """Each risk path against the edges of its events."""
    s = Stages(spark, d)
    o = observed(spark, d).select("obs_id", "skill_id", "unit_id")
    p = _paths(spark, d).join(o.select(F.col("obs_id").alias("source_event"), "skill_id", F.col("unit_id").alias("su")), "source_event").join(o.select(F.col("obs_id").alias("sink_event"), F.col("unit_id").alias("ku")), "sink_event")
    route = F.when(F.col("su").isNull() | F.col("ku").isNull(), "abstain").otherwise("true")
    p = p.select("skill_id", F.concat_ws("|", "unit", "source_cap", "sink_cap").alias("path_id"), route.alias("route"), "source_event", "sink_event")
    return C.path_judgments(p, s.edges, s.sensitive)


_CODE = "ce as (select file_key as file, any_value(bundle_id) as scope, any_value(path) as path, any_value(text) as text from source_excerpts where kind in ('code', 'doc') and text is not null group by file_key), fx as (select scope, file, path, text, split_part(path, '/', -1) as name, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') as stem from ce)"


#: The texts name few files of their own bundle; a closing line names the next one.
_LINKED = _CODE.replace("fx as (", "fy as (") + ", fx as (select scope, file, path, name, stem, text || coalesce(chr(10) || 'see ./' || lead(name) over (partition by scope order by file), '') as text from fy)"


def linked_files(spark, d):
    """The files, the text of each naming the next of its bundle in a closing line."""
    name = F.element_at(F.split("path", "/"), -1)
    after = F.lead(name).over(Window.partitionBy("scope").orderBy("file"))
    return _files(spark, d).withColumn("text", F.concat("text", F.coalesce(F.concat(F.lit("\nsee ./"), after), F.lit(""))))


def _files(spark, d):
    e = t(spark, d, "source_excerpts").where("kind in ('code', 'doc') and text is not null").dropDuplicates(["file_key"])
    return e.select(F.col("bundle_id").alias("scope"), F.col("file_key").alias("file"), "path", "text")


@query(f"""with {_LINKED}, sa as (select distinct scope, file as source, split_part(unnest(regexp_extract_all(text, '{B.SCRIPT}')), '/', -1) as name from fx),
im as (select distinct scope, file as source, unnest(list_concat(regexp_extract_all(text, '(?m)^(?:import|from) +([A-Za-z_]\\w*)', 1), regexp_extract_all(text, '(?:from|require\\()\\s*["'']\\.{{1,2}}/(?:[\\w.-]+/)*([\\w-]+)', 1))) as stem from fx),
bn as (select scope, name, arg_min(file, path || chr(1) || lpad(cast(file as varchar), 20, '0')) as target from fx group by 1, 2), bs as (select scope, stem, arg_min(file, path || chr(1) || lpad(cast(file as varchar), 20, '0')) as target from fx group by 1, 2)
select scope, source, target, 'command' as kind, name as evidence from sa join bn using (scope, name) where source <> target union all select scope, source, target, 'static', stem from im join bs using (scope, stem) where source <> target""")
def file_bridges(spark, d):
    """Files and documents of a bundle that name or import another of its files."""
    return B.bridges(linked_files(spark, d))


_CMDS = f"""dt as (select excerpt_id as key, any_value(bundle_id) as scope, any_value(text) as text from source_excerpts where kind = 'doc' and text is not null group by excerpt_id),
db as (select key, scope, generate_subscripts(bodies, 1) - 1 as block, unnest(bodies) as body from (select key, scope, regexp_extract_all(text, '{B.FENCE}', 1) as bodies from dt)),
dl as (select key, scope, block, generate_subscripts(string_split(body, chr(10)), 1) - 1 as line, unnest(string_split(body, chr(10))) as command from db),
cm as (select key, scope, cast(block * 1000 + line as integer) as seq, trim(command) as command, nullif(regexp_extract(command, '{B.SCRIPT}', 0), '') as script from dl where not regexp_matches(command, '^\\s*(?:#|$)'))"""


def _commands(spark, d):
    docs = t(spark, d, "source_excerpts").where("kind = 'doc' and text is not null").dropDuplicates(["excerpt_id"])
    return B.commands(docs, "excerpt_id", "text").join(docs.select(F.col("excerpt_id").alias("key"), F.col("bundle_id").alias("scope")), "key")


@query(f"with {_CMDS} select key, seq, command, script from cm")
def document_commands(spark, d):
    """Command lines in the shell fences of documents, and the script that each starts."""
    return _commands(spark, d).select("key", "seq", "command", "script")


@query(f"""with {_CODE}, {_CMDS}, cx as (select scope, key, seq, script, regexp_replace(script, '^(?:\\./)+', '') as path, split_part(script, '/', -1) as name from cm where script is not null),
ex as (select scope, path, min(file) as exact from fx group by 1, 2), nm as (select scope, name, count(distinct file) as named from fx group by 1, 2)
select scope, key, seq, script, exact, cast(coalesce(named, 0) as bigint) as named, case when exact is not null then 'confirmed' when named > 1 then 'competing' when named = 1 then 'inferred' else 'unresolved' end as status from cx left join ex using (scope, path) left join nm using (scope, name)""")
def orchestrations(spark, d):
    return B.orchestrations(_commands(spark, d), _files(spark, d))


_KINDS = "case " + " ".join(f"when capability = '{k}' then '{v}'" for k, v in B.ABSTRACT.items()) + " end"
_SAID = f"""so as (select obs_id, any_value(fields['capability']) as capability, any_value(source_text) as tx from raw_observations where source_text is not null and fields is not null group by obs_id),
rs0 as (select obs_id, capability, list_concat(list_concat([{{'rtype': 'url', 'value': rtrim(x, '.,);'), 'origin': 'literal'}} for x in regexp_extract_all(tx, '{B.URL.replace("'", "''")}')], [{{'rtype': 'env_var', 'value': x, 'origin': 'env'}} for x in regexp_extract_all(tx, '{B.ENV.replace("'", "''")}', 1)]),
  list_concat([{{'rtype': 'path', 'value': x, 'origin': case when regexp_matches(lower(x), '(?:^|/)config/') then 'config_file' else 'literal' end}} for x in regexp_extract_all(tx, '{B.QUOTED.replace("'", "''")}', 1)], [{{'rtype': 'path', 'value': x, 'origin': 'artifact'}} for x in regexp_extract_all(tx, '{B.REDIRECT}', 1)])) as l from so),
rs as (select distinct obs_id, capability, u.rtype as rtype, u.value as value, true as resolved, u.origin as origin from (select obs_id, capability, unnest(l) as u from rs0) union all select obs_id, capability, {_KINDS}, '<dynamic-' || replace({_KINDS}, '_', '-') || '>', false, 'unknown' from rs0 where len(l) = 0 and {_KINDS} is not null)"""


@query(f"with {_SAID} select rtype, origin, resolved, cast(count(*) as bigint) as uses, cast(count(distinct obs_id) as bigint) as statements, cast(count(distinct value) as bigint) as distinct_values from rs group by 1, 2, 3")
def statement_resources(spark, d):
    """Resources that observed statements name, abstract ones where a capability needs one and none is named."""
    o = t(spark, d, "raw_observations").where("source_text is not null and fields is not null").dropDuplicates(["obs_id"]).select("obs_id", F.col("fields")["capability"].alias("capability"), "source_text")
    rows = o.select("obs_id", F.explode(B.resources_of(F.col("source_text"), F.col("capability"))).alias("r")).select("obs_id", "r.*")
    return rows.groupBy("rtype", "origin", "resolved").agg(F.count("*").alias("uses"), F.countDistinct("obs_id").alias("statements"), F.countDistinct("value").alias("distinct_values"))


@query(f"with {_SAID} select capability, case when capability = 'shell_exec' and regexp_matches(lower(tx), '{B.SUBPROCESS}') then 'subprocess_spawn' else capability end as refined, cast(count(*) as bigint) as events from so where capability is not null group by 1, 2")
def refined_capabilities(spark, d):
    o = t(spark, d, "raw_observations").where("source_text is not null and fields is not null").dropDuplicates(["obs_id"]).select(F.col("fields")["capability"].alias("capability"), "source_text").where("capability is not null")
    return o.groupBy("capability", B.refined(F.col("capability"), F.col("source_text")).alias("refined")).agg(F.count("*").alias("events"))


@query("""with f as (select distinct file_key, relative_path from file_entries), v as (select file_key, case file_key % 4 when 0 then 'D:\\' || replace(relative_path, '/', '\\') when 1 then '\\\\wsl.localhost\\Ubuntu\\' || replace(relative_path, '/', '\\') when 2 then '/mnt/e/' || relative_path else relative_path end as stored,
   case file_key % 4 when 0 then '/data/d/' || relative_path when 1 then '/' || relative_path when 2 then '/mnt/e/' || relative_path else relative_path end as posix from f) select file_key, stored, posix from v""")
def stored_paths(spark, d):
    """Stored paths of four kinds in POSIX form."""
    f = t(spark, d, "file_entries").select("file_key", "relative_path").distinct()
    back = F.translate("relative_path", "/", "\\")
    kind = F.col("file_key") % 4
    stored = F.when(kind == 0, F.concat(F.lit("D:\\"), back)).when(kind == 1, F.concat(F.lit("\\\\wsl.localhost\\Ubuntu\\"), back)).when(kind == 2, F.concat(F.lit("/mnt/e/"), "relative_path")).otherwise(F.col("relative_path"))
    return f.select("file_key", stored.alias("stored")).withColumn("posix", B.posix_path(F.col("stored"), {"D": "/data/d"}))


@query(f"""with {TABLES}, u as (select file_key, min_by(unit_id, unit_key) as unit_id from code_units where source_doc_id is null group by file_key) select count(*) filter (o.unit_id is not null) as with_unit, count(u.unit_id) as resolved, count(*) filter (o.unit_id = u.unit_id) as agree from obs o left join u using (file_key)""")
def observation_units(spark, d):
    """Observations to the first unit of their file, against the unit that they came with."""
    u = t(spark, d, "code_units").where("source_doc_id is null").groupBy("file_key").agg(F.min_by("unit_id", "unit_key").alias("u"))
    rows = observed(spark, d).join(u, "file_key", "left")
    return rows.agg(F.count("unit_id").alias("with_unit"), F.count("u").alias("resolved"), F.count_if(F.col("unit_id") == F.col("u")).alias("agree"))
