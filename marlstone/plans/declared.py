"""Votes, guards, constraint types, tools, evidence, steps, masks and closures, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as X
from ..operators import behaviour as B
from ..operators import contract as K
from ..operators import reconcile as C
from .behaviour import _LINKED, linked_files
from .queries import _OBS, _quoted, observed, query, t
from .reconciled import JUDGED, REQUIRED, TABLES, Stages

_OPS = {"A": "allowed", "R": "prohibited", "N": "unknown"}


@query("""
with s as (select l_suppkey, l_linestatus, case l_returnflag when 'A' then 'allowed' when 'R' then 'prohibited' else 'unknown' end as operator, count(distinct l_linenumber) / 7.0 as agreement from lineitem group by 1, 2, 3),
p as (select * from s where operator in ('allowed', 'prohibited') and agreement >= 0.6)
select l_suppkey, l_linestatus, operator, round(agreement, 6) as agreement from p
union all select l_suppkey, l_linestatus, 'unknown', round(max(agreement), 6) from s where (l_suppkey, l_linestatus) not in (select l_suppkey, l_linestatus from p) group by 1, 2
""")
def vote_clauses(spark, d):
    """A2: a clause of each operator that enough distinct passes agree on, both where both do."""
    op = F.coalesce(*(F.when(F.col("l_returnflag") == k, F.lit(v)) for k, v in _OPS.items()))
    s = t(spark, d, "lineitem").select("l_suppkey", "l_linestatus", op.alias("operator"), "l_linenumber")
    return K.vote_clauses(s, ["l_suppkey", "l_linestatus"], "operator", "l_linenumber", 7)


@query(f"""with {TABLES}, g as (select c.*, c.capability in ({_quoted(REQUIRED)}) as required, exists (select 1 from cs s where s.skill_id = c.skill_id and s.clause_id = c.clause_id) as specific from cl c)
select operator, case when required and operator = 'unknown' and specific then 'allowed' when required and operator = 'allowed' and not specific then 'unknown' else operator end as guarded, capability, cast(count(*) as bigint) as clauses from g group by 1, 2, 3""")
def clause_guard(spark, d):
    """Clauses of capabilities that need authorization, kept, raised or lowered by how specific they are."""
    s = Stages(spark, d)
    rows = s.clauses.join(s.constraints.select("skill_id", "clause_id", F.lit(True).alias("specific")).distinct(), ["skill_id", "clause_id"], "left").fillna(False, ["specific"])
    return rows.groupBy("operator", K.guard(F.col("operator"), F.col("specific"), F.col("capability").isin(*REQUIRED)).alias("guarded"), "capability").agg(F.count("*").alias("clauses"))


_LIKE_URL = "regexp_matches({v}, '^[A-Za-z][A-Za-z0-9+.-]*://')"
_LIKE_DOMAIN = "(regexp_matches({v}, '^(?:\\*\\.)?[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+(?:/[^\\s]*)?$') and not regexp_matches(split_part({v}, '/', 1), '(?i)^(?:\\*\\.)?[^.]+\\.(?:bash|cfg|csv|css|html|ini|js|json|log|md|pdf|png|py|sh|sql|svg|toml|ts|txt|xml|yaml|yml)$'))"
_LIKE_ENV = "regexp_matches({v}, '^[A-Z][A-Z0-9_]*(?:[*?][A-Z0-9_]*)*$')"
_GLOBBED = "case when regexp_matches({v}, '[*?\\[\\]]') then '{k}_glob' else '{k2}' end"
_HEAD = "rtrim(regexp_extract({v}, '^(\\S+)', 1), ',:;')"


def _typed_sql(v: str) -> str:
    g = lambda k, k2: _GLOBBED.format(v=v, k=k, k2=k2)
    network = f"case when {_LIKE_URL.format(v=v)} then {g('url', 'url')} when {_LIKE_DOMAIN.format(v=v)} then {g('domain', 'domain')} end"
    env = f"case when {_LIKE_ENV.format(v=v)} then {g('env', 'env_var')} end"
    file = f"case when {v} = '*' then 'path_glob' when starts_with({v}, '*.') or starts_with({v}, '**/*.') then 'file_glob' when regexp_matches({v}, '[/\\\\]') or not starts_with({v}, '*.') and regexp_matches({v}, '\\.[A-Za-z0-9]{{1,8}}(?:$|[*?])') then {g('path', 'path')} end"
    head = _HEAD.format(v=v)
    command = f"case when not {_LIKE_URL.format(v=v)} and not {_LIKE_DOMAIN.format(v=v)} and not {_LIKE_ENV.format(v=v)} and regexp_matches({head}, '(?i)^(?:python3?|bash|sh|zsh|uv|pip3?|npm|pnpm|poetry|node|npx)\\b|[/\\\\]|^~/|\\.(?:py|sh|bash|js|ts|mjs|cjs)$|[*?\\[\\]]') then {_GLOBBED.format(v=head, k='command', k2='command')} end"
    semantic = f"case when regexp_matches({v}, '{rules.USER_INPUT}') then 'user_input_only' when regexp_matches({v}, '{rules.NO_NETWORK}') or regexp_matches({v}, '{rules.READ_ONLY}') or regexp_matches({v}, '{rules.WRITE_ONLY}') then 'side_effect_bound' when regexp_matches({v}, '{rules.CONFIG}') then 'config_bound' end"
    by = f"case when capability in ({_quoted(rules.ENV_USE)}) then {env} when capability in ({_quoted(rules.NETWORK)}) then {network} when capability in ({_quoted(rules.EXECUTION)}) then {command} when capability in ({_quoted(rules.FILES)}) then {file} else coalesce({network}, {env}, {file}, {command}) end"
    return f"coalesce({semantic}, {by})"


_SURFACE = "case obs_id % 5 when 0 then target when 1 then replace(target, '.internal.', '*.') when 2 then api_call || '.py --all' when 3 then upper(replace(api_call, '_', '')) || '_' || '*' else 'only reads ' || api_call end"


@query(f"with {_OBS}, w as (select distinct capability, {_SURFACE} as value from obs where capability is not null), y as (select capability, {_typed_sql('value')} as kind from w where value is not null) select capability, kind, cast(count(*) as bigint) as wordings from y group by 1, 2")
def constraint_types(spark, d):
    """What wordings of constraints speak of, under each capability."""
    o = observed(spark, d).where("capability is not null")
    n = F.col("obs_id") % 5
    value = F.when(n == 0, F.col("target")).when(n == 1, F.replace("target", F.lit(".internal."), F.lit("*."))).when(n == 2, F.concat("api_call", F.lit(".py --all"))).when(n == 3, F.concat(F.upper(F.replace("api_call", F.lit("_"), F.lit(""))), F.lit("_*"))).otherwise(F.concat(F.lit("only reads "), "api_call"))
    w = o.select("capability", value.alias("value")).distinct().where("value is not null")
    return w.groupBy("capability", rules.typed_constraint(F.col("capability"), F.col("value"))["kind"].alias("kind")).agg(F.count("*").alias("wordings"))


_GLOB_CASES = (("path_glob", "/tmp/*"), ("path_glob", "/tmp/[a-m]*"), ("path", "/tmp"), ("domain_glob", "*.example"), ("domain_glob", "*.internal.example"), ("domain_glob", "w*s*.example"), ("url_glob", "https://*.invalid"), ("env_glob", "*HOME*"), ("command_glob", "*_cache"), ("user_input_only", "user_input_only"))


@query(f"""with {TABLES}, c(ctype, cvalue) as (values {', '.join(f"('{a}', '{b}')" for a, b in _GLOB_CASES)}), r as (select distinct rtype, rvalue from re), h as (select *, regexp_extract(lower(case when contains(rvalue, '://') then rvalue else 'h://' || rvalue end), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1) as host from r)
select ctype, cvalue, rtype, cast(count(*) as bigint) as pairs, cast(count(*) filter (case ctype when 'path_glob' then rtype = 'path' and lower(rvalue) glob cvalue when 'path' then rtype = 'path' and (rvalue = cvalue or starts_with(rvalue, cvalue || '/'))
  when 'domain_glob' then rtype in ('domain', 'url') and host <> '' and case when starts_with(cvalue, '*.') then ends_with(host, substr(cvalue, 2)) and host <> substr(cvalue, 3) else host glob cvalue end when 'url_glob' then rtype = 'url' and lower(rvalue) glob cvalue
  when 'env_glob' then rtype = 'env_var' and upper(rvalue) glob cvalue when 'command_glob' then rtype = 'command' and lower(rvalue) glob cvalue else false end) as bigint) as matches from c, h group by 1, 2, 3""")
def constraint_matches(spark, d):
    """Ten constraints against every distinct resource, the constraints being a fixed small table."""
    each = F.array(*(F.struct(F.lit(a).alias("ctype"), F.lit(b).alias("cvalue")) for a, b in _GLOB_CASES))
    r = Stages(spark, d).resources.select("rtype", "rvalue").distinct()
    rows = r.withColumn("c", F.explode(each)).select("rtype", "rvalue", "c.*")
    hit = rules.constraint_matches(F.col("ctype"), F.col("cvalue"), F.col("rtype"), F.col("rvalue"))
    return rows.groupBy("ctype", "cvalue", "rtype").agg(F.count("*").alias("pairs"), F.count_if(hit).alias("matches"))


_TOOL_OF = {"shell_exec": "Bash", "file_read": "Read", "file_write": "Write", "network_request": "WebFetch", "subprocess_spawn": "Spawn"}
_TOOL = "case " + " ".join(f"when capability = '{k}' then '{v}'" for k, v in _TOOL_OF.items()) + " end"
_TOOL_CAP = "case tool " + " ".join(f"when '{k}' then '{v}'" for k, v in K.TOOLS.items()) + " else 'shell_exec' end"


@query(f"""with {_OBS}, e as (select distinct {_TOOL} as tool, coalesce(target, '') as pattern, skill_id from obs where {_TOOL} is not null), c as (select skill_id, {_TOOL_CAP} as capability, pattern as value from e), k as (select skill_id, capability, value, {_typed_sql('value')} as kind0 from c)
select capability, case when value <> '' then coalesce(kind0, 'scope') end as kind, cast(count(*) as bigint) as clauses, cast(count(distinct skill_id) as bigint) as skills from k group by 1, 2""")
def allowed_tools(spark, d):
    """Clauses of allowed-tools entries that name the tools and targets of each skill."""
    tool = F.coalesce(*(F.when(F.col("capability") == k, F.lit(v)) for k, v in _TOOL_OF.items()))
    o = observed(spark, d).select("skill_id", F.concat(tool, F.lit("("), F.coalesce("target", F.lit("")), F.lit(")")).alias("entry")).where("entry is not null").distinct()
    docs = o.groupBy("skill_id").agg(F.array_join(F.sort_array(F.collect_list("entry")), ", ").alias("tools"))
    return K.allowed_tools(docs, "skill_id", "tools").groupBy("capability", "kind").agg(F.count("*").alias("clauses"), F.countDistinct("key").alias("skills"))


@query("""
with o as (select distinct obs_id, file_key, source_text from raw_observations where source_text <> ''), e as (select file_key, any_value(text) as text from source_excerpts where text is not null group by file_key),
l as (select obs_id, text, source_text, strpos(text, source_text) as at_, strpos(lower(text), lower(source_text)) as low from o join e using (file_key)),
p as (select obs_id, text, source_text, case when at_ > 0 then 'exact' when low > 0 then 'folded' else 'absent' end as how, nullif(case when at_ > 0 then at_ else low end, 0) - 1 as s from l)
select how, cast(count(*) as bigint) as observations, cast(sum(s) as bigint) as starts, cast(sum(s + length(source_text)) as bigint) as ends, cast(sum(length(left(text, s)) - length(replace(left(text, s), chr(10), '')) + 1) as bigint) as lines from p group by how
""")
def evidence_offsets(spark, d):
    """Where observed statements stand in their files: offsets and lines."""
    o = t(spark, d, "raw_observations").where("source_text <> ''").select("obs_id", "file_key", "source_text").distinct()
    e = t(spark, d, "source_excerpts").where("text is not null").select("file_key", "text").dropDuplicates(["file_key"])
    rows = o.join(e, "file_key").withColumn("p", K.located(F.col("text"), F.col("source_text")))
    return rows.groupBy("p.how").agg(F.count("*").alias("observations"), F.sum(F.col("p.start").cast("bigint")).alias("starts"), F.sum(F.col("p.end").cast("bigint")).alias("ends"), F.sum(K.line_of(F.col("text"), F.col("p.start")).cast("bigint")).alias("lines"))


@query(r"""
with e as (select excerpt_id, any_value(text) as text from source_excerpts where kind = 'doc' and text is not null group by 1), l as (select excerpt_id, generate_subscripts(x, 1) - 1 as seq, unnest(x) as line from (select excerpt_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as x from e)),
w as (select *, count(*) filter (regexp_matches(line, '^\s*```')) over (partition by excerpt_id order by seq rows unbounded preceding) as fences, last_value(case when regexp_matches(line, '^#{1,6} ') then regexp_replace(line, '^#+\s+', '') end ignore nulls) over (partition by excerpt_id order by seq rows unbounded preceding) as heading,
  last_value(case when trim(line) <> '' and not regexp_matches(line, '^\s*```') then line end ignore nulls) over (partition by excerpt_id order by seq rows between unbounded preceding and 1 preceding) as near from l),
k as (select excerpt_id, heading, case when regexp_matches(line, '^\s*```') then 'fence' when fences % 2 = 1 then 'code' when regexp_matches(line, '^#{1,6} ') then 'heading' when regexp_matches(line, '^\s*<') then 'html' when regexp_matches(lower(line), '\b(?:must|never|only|do not|required)\b|必须|不得|禁止|只有') then 'policy'
   when regexp_matches(line, '^\s*(?:[-*+]|\d+[.)])\s') then 'list_item' when regexp_matches(lower(line), '\b(?:run|use|call|open|execute|write|read)\b|运行|执行|读取') then 'instruction' else 'context' end as step_type,
   regexp_matches(line, '^\s*```') and fences % 2 = 1 and (regexp_matches(coalesce(near, ''), '(?i)\b(?:run|execute|command|usage|example|script)\b|运行|执行|用法|流程') or regexp_matches(coalesce(heading, ''), '(?i)\b(?:run|execute|command|usage|example|script)\b|运行|执行|用法|流程')) as bound from w where trim(line) <> '')
select step_type, bound, cast(count(*) as bigint) as steps, cast(count(distinct excerpt_id) as bigint) as docs, cast(count(distinct heading) as bigint) as headings from k group by 1, 2
""")
def step_types(spark, d):
    """Lines of the bundles' documents by what they are, and fences bound by a cue before them."""
    docs = t(spark, d, "source_excerpts").where("kind = 'doc' and text is not null").dropDuplicates(["excerpt_id"])
    return K.steps(docs, "excerpt_id", "text").groupBy("step_type", "bound").agg(F.count("*").alias("steps"), F.countDistinct("key").alias("docs"), F.countDistinct("heading").alias("headings"))


@query("""with m as (select source, text, regexp_extract_all(text, 'https?://[^\\s)\\]"''<>]+') as urls from documents where text is not null) select source, cast(count(*) as bigint) as docs, cast(sum(len(urls)) as bigint) as urls, cast(count(*) as bigint) as restored from m group by source""")
def literal_masks(spark, d):
    """Literals masked and put back: every text is the same again."""
    rows = t(spark, d, "documents").where("text is not null").select("source", "text", K.masked(F.col("text")).alias("m"))
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.size("m.values.url").cast("bigint")).alias("urls"), F.count_if(K.unmasked(F.col("m")) == F.col("text")).alias("restored"))


@query(f"""with recursive {_LINKED}, sa as (select distinct scope, file as source, split_part(unnest(regexp_extract_all(text, '{B.SCRIPT}')), '/', -1) as name from fx), bn as (select scope, name, arg_min(file, path || chr(1) || lpad(cast(file as varchar), 20, '0')) as target from fx group by 1, 2),
lk as (select distinct source, target, regexp_matches(path, '(?i)\\.md$') as is_doc from sa join bn using (scope, name) join (select file, path from fx) p on p.file = target where source <> target),
cl(node, level) as (select file, 0 from fx where path = 'SKILL.md' union select l.target, c.level + 1 from cl c join lk l on l.source = c.node where c.level < 20 and (c.level = 0 or exists (select 1 from fx where fx.file = c.node and regexp_matches(path, '(?i)\\.md$'))))
select level, cast(count(*) as bigint) as files from (select node, min(level) as level from cl group by node) group by level""")
def document_closure(spark, d):
    """Files that the root documents reach; only documents are followed further."""
    files = linked_files(spark, d).withColumn("doc", F.lower("path").endswith(".md"))
    links = B.bridges(linked_files(spark, d)).where("kind = 'command'").select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    links = links.join(files.select(F.col("file").alias("dst"), F.when(F.col("doc"), "admitted").otherwise("resolved").alias("status")), "dst")
    roots = files.where("path = 'SKILL.md'").select(F.col("file").alias("node"))
    return K.documents_closure(roots, links).groupBy("level").agg(F.count("*").alias("files"))


@query(f"with {JUDGED} select coalesce(reason, 'none') as reason, route, cast(count(*) as bigint) as candidates, cast(count(*) filter (anchored) as bigint) as anchored from jr where auth = 'abstain' group by 1, 2")
def abstentions(spark, d):
    """Why authorizations abstain, and how many of them have a strong anchor."""
    j = Stages(spark, d).judged.where("auth = 'abstain'")
    return j.groupBy(F.coalesce("reason", F.lit("none")).alias("reason"), "route").agg(F.count("*").alias("candidates"), F.count_if("anchored").alias("anchored"))


@query(f"""with {TABLES}, l as (select distinct c.skill_id, c.cvalue, r.rvalue from cs c join re r on c.skill_id = r.skill_id where c.ctype not in ({_quoted(rules.SCOPE_TYPES)}) and (lower(cvalue) = lower(rvalue) or starts_with(rvalue, cvalue) or starts_with(cvalue, rvalue) or starts_with(rvalue, regexp_extract(cvalue, '^(/[^*]*)', 1)) and cvalue like '/%'))
select cvalue, cast(count(*) as bigint) as resources, cast(count(distinct skill_id) as bigint) as skills from l group by cvalue""")
def surface_overlaps(spark, d):
    """Literals of constraints, folders without their star, that overlap resources of the skill."""
    s = Stages(spark, d)
    left = s.constraints.where(~F.col("ctype").isin(*rules.SCOPE_TYPES)).select("skill_id", F.col("cvalue").alias("shown"), F.regexp_replace("cvalue", r"\*$", "").alias("cvalue")).distinct()
    right = s.resources.select("skill_id", "rvalue").distinct()
    rows = C.overlaps(left, right, ["skill_id"], "cvalue", "rvalue").where((F.lower("cvalue") == F.lower("rvalue")) | F.col("rvalue").startswith(F.col("cvalue")) | F.col("cvalue").startswith(F.col("rvalue")))
    return rows.select("skill_id", F.col("shown").alias("cvalue"), "rvalue").distinct().groupBy("cvalue").agg(F.count("*").alias("resources"), F.countDistinct("skill_id").alias("skills"))
