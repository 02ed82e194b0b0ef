"""External reports, baselines, ablations and scores against the gold labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as X
from ..operators import evaluation as E
from ..operators import reconcile as C
from ..operators import scanners as S
from ..operators import tri
from .queries import _FAMILY, _OBS, _PERM, _STRATUM, _quoted, observed, permissions, query, t
from .reconciled import FINDINGS, JUDGED, TABLES, Stages

_SEVERITIES = {"credential_access": "HIGH_RISK", "network_request": "warning", "shell_exec": "CRITICAL", "code_download": "medium", "env_var_read": "none", "file_read": "LOW", "file_write": "note", "subprocess_spawn": "error"}
_WORDS = {"credential_access": "reads a secret", "network_request": "undeclared flow to the network", "shell_exec": "runs a shell", "code_download": "fetches code in a pipeline", "env_var_read": "reads env", "file_read": "least privilege of a file", "file_write": "writes a file", "subprocess_spawn": "starts a subprocess chain"}


def _pick(column, table):
    return F.coalesce(*(F.when(column == k, F.lit(v)) for k, v in table.items()))


def _case(column, table):
    return "case " + " ".join(f"when {column} = '{k}' then '{v}'" for k, v in table.items()) + " end"


def _reports(spark, d):
    """A report of each skill in one of four shapes, from its observations."""
    o = observed(spark, d).where("capability is not null").select("skill_id", "capability", "api_call", "relative_path", "line").distinct()
    o = o.withColumns({"sev": _pick(F.col("capability"), _SEVERITIES), "msg": F.concat_ws(" ", "api_call", _pick(F.col("capability"), _WORDS)), "shape": F.length("skill_id") % 4})
    flat = F.struct(F.col("capability").alias("rule_id"), F.col("sev").alias("severity"), F.col("msg").alias("message"), F.col("relative_path").alias("file"), "line")
    sarif = F.struct(F.col("capability").alias("ruleId"), F.col("sev").alias("level"), F.struct(F.col("msg").alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(F.col("relative_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"))
    deep = F.struct(F.col("capability").alias("issue_code"), F.col("sev").alias("severity"), F.col("msg").alias("description"), F.struct(F.col("relative_path").alias("file"), F.col("line").alias("start_line")).alias("location"))
    rows = o.groupBy("skill_id", "shape").agg(F.collect_list(flat).alias("flat"), F.collect_list(sarif).alias("sarif"), F.collect_list(deep).alias("deep"))
    score = F.size("flat").cast("double")
    json = (
        F.when(F.col("shape") == 0, F.to_json(F.struct(score.alias("risk_score"), F.lit("HIGH").alias("risk_severity"), F.col("flat").alias("filtered_findings"))))
        .when(F.col("shape") == 1, F.to_json(F.struct(F.array(F.struct(F.col("sarif").alias("results"))).alias("runs"))))
        .when(F.col("shape") == 2, F.to_json(F.struct(F.lit("done").alias("status"), F.lit("MEDIUM").alias("max_severity"), F.struct(F.col("flat").alias("findings")).alias("results"))))
        .otherwise(F.to_json(F.struct(F.struct(score.alias("score"), F.lit("low").alias("severity")).alias("risk_assessment"), F.col("deep").alias("issues"))))
    )
    return rows.select(F.col("skill_id").alias("key"), F.parse_json(json).alias("payload"))


_RANK = _case("capability", {"credential_access": "4", "network_request": "2", "shell_exec": "5", "code_download": "3", "env_var_read": "0", "file_read": "2", "file_write": "1", "subprocess_spawn": "4"})
_ITEMS = f"""{_OBS}, it as (select distinct skill_id as key, capability, api_call, relative_path as path, line, cast({_RANK} as integer) as severity, lower(capability || ' ' || concat_ws(' ', api_call, {_case('capability', _WORDS)})) as tx from obs where capability is not null),
fd as (select *, case when severity >= 4 or regexp_matches(tx, '{'|'.join(rules.UNDECLARED)}') then 'violation' else 'exposure-only' end as label from it),
fs as (select *, case when label = 'violation' then case when regexp_matches(tx, '{'|'.join(rules.COMPOSITION)}') then 'unjustified_composition' when regexp_matches(tx, '{'|'.join(rules.SCOPE)}') then 'scope_violation' else 'unsupported_behavior' end end as subtype from fd)"""


@query(f"with {_ITEMS} select key, capability as finding, severity, label, subtype, path, line, cast(count(*) as bigint) as items from fs group by all")
def scanner_findings(spark, d):
    """Items of reports of four shapes with their rank, label and subtype."""
    return S.findings(_reports(spark, d)).groupBy("key", "finding", "severity", "label", "subtype", "path", "line").agg(F.count("*").alias("items"))


@query(f"""with {_ITEMS}, p as (select key, count(*) as n, count(*) filter (label = 'violation') as v from fs group by key)
select key, case when v > 0 then 'violation' else 'exposure-only' end as label, cast(n as bigint) as findings, cast(v as bigint) as violations, case when length(key) % 4 in (0, 3) then cast(n as double) end as score,
  case length(key) % 4 when 0 then 'HIGH' when 2 then 'MEDIUM' when 3 then 'low' else case when v > 0 then 'high' else 'low' end end as max_severity from p""")
def scanner_predictions(spark, d):
    return S.predictions(_reports(spark, d))


@query(f"with {_ITEMS}, a as (select key, unnest(list_distinct([x for x in [{', '.join(f'''case when contains(tx, '{w}') then '{a}' end''' for w, a in rules.ATOMS)}] if x is not null])) as atom from fs) select atom, cast(count(*) as bigint) as items, cast(count(distinct key) as bigint) as packages from a group by atom")
def scanner_atoms(spark, d):
    rows = S.findings(_reports(spark, d)).select("key", F.explode("atoms").alias("atom"))
    return rows.groupBy("atom").agg(F.count("*").alias("items"), F.countDistinct("key").alias("packages"))


# --- baselines and ablations ----------------------------------------------------------------------------
@query(f"""with {TABLES}, h as (select e.skill_id, e.event_id, exists (select 1 from perm p where p.skill_id = e.skill_id and p.capability = e.capability) as declared, exists (select 1 from perm p where p.skill_id = e.skill_id and {_FAMILY.format('p.capability')} = e.group_) as related,
  (e.skill_id, e.event_id) in (select skill_id, event_id from sens) as sensitive, e.tier from ev e)
select skill_id, cast(count(*) filter (sensitive and tier = 'code') as bigint) as rule_based, cast(count(*) filter (sensitive and not related) as bigint) as lattice, cast(count(*) filter (not declared and tier = 'code') as bigint) as containment from h group by skill_id""")
def baselines(spark, d):
    """Three plain baselines a skill: sensitive calls in code, sensitive events whose family no
    permission covers, and calls in code whose capability is not declared."""
    s = Stages(spark, d)
    p = permissions(spark, d)
    own = p.withColumn("declared", F.lit(True))
    family = p.select("skill_id", X.family(F.col("capability")).alias("group_")).distinct().withColumn("related", F.lit(True))
    e = s.events.withColumn("group_", X.family(F.col("capability"))).join(own, ["skill_id", "capability"], "left").join(family, ["skill_id", "group_"], "left").fillna(False, ["declared", "related"])
    code = F.col("tier") == "code"
    return e.groupBy("skill_id").agg(F.count_if(F.col("needs") & code).alias("rule_based"), F.count_if(F.col("needs") & ~F.col("related")).alias("lattice"), F.count_if(~F.col("declared") & code).alias("containment"))


@query(f"""with {TABLES}, cv as (select e.skill_id, e.event_id, bool_or(c.operator = 'allowed') as allowed, bool_or(c.operator = 'prohibited') as forbidden, count(c.clause_id) as n from ev e left join cl c on c.skill_id = e.skill_id and {_FAMILY.format('c.capability')} = e.group_ group by 1, 2)
select e.capability, case when n = 0 then 'undocumented' when allowed and forbidden then 'ambiguous' when forbidden then 'contradicted' when allowed then 'consistent' else 'mentioned' end as verdict, cast(count(*) as bigint) as events from cv join ev e using (skill_id, event_id) group by 1, 2""")
def doc_code_consistency(spark, d):
    """Events by what the clauses of their family say."""
    s = Stages(spark, d)
    c = s.clauses.groupBy("skill_id", X.family(F.col("capability")).alias("group_")).agg(F.max(F.col("operator") == "allowed").alias("allowed"), F.max(F.col("operator") == "prohibited").alias("forbidden"))
    rows = s.events.withColumn("group_", X.family(F.col("capability"))).join(c, ["skill_id", "group_"], "left")
    verdict = F.when(F.col("allowed").isNull(), "undocumented").when(F.col("allowed") & F.col("forbidden"), "ambiguous").when(F.col("forbidden"), "contradicted").when(F.col("allowed"), "consistent").otherwise("mentioned")
    return rows.groupBy("capability", verdict.alias("verdict")).agg(F.count("*").alias("events"))


@query(f"with {JUDGED} select auth, case when cap <> 'true' then cap when route <> 'true' then route when given and res <> 'true' then res else 'true' end as without_scope, cast(count(*) as bigint) as candidates from jr where operator = 'allowed' group by 1, 2")
def ablation_scope(spark, d):
    """Authorizations with and without the constraints of scope."""
    s = Stages(spark, d)
    bare = C.judged(s.candidates, s.clauses, C.strip(s.constraints), s.events, s.resources).select("skill_id", "clause_id", "event_id", F.col("auth").alias("without_scope"))
    rows = s.judged.where("operator = 'allowed'").join(bare, ["skill_id", "clause_id", "event_id"])
    return rows.groupBy("auth", "without_scope").agg(F.count("*").alias("candidates"))


@query(f"with {JUDGED} select operator, cast(count(*) as bigint) as candidates, cast(count(*) filter (prohibited = 'true') as bigint) as blocked, cast(count(*) filter (auth = 'true') as bigint) as granted, cast(count(*) filter (tier = 'instruction') as bigint) as planned from jr group by operator")
def candidates_by_operator(spark, d):
    j = Stages(spark, d).judged
    return j.groupBy("operator").agg(F.count("*").alias("candidates"), F.count_if(F.col("prohibited") == tri.T).alias("blocked"), F.count_if(F.col("auth") == tri.T).alias("granted"), F.count_if(F.col("tier") == "instruction").alias("planned"))


# --- scores ---------------------------------------------------------------------------------------------
_GOLD = f"gl as (select skill_id, max_by(gold.label, label_id) as gold, max_by(gold.violation_subtype, label_id) as subtype, max_by({_STRATUM.format('risk_stratum')}, label_id) as stratum from gold_labels where gold.label is not null group by skill_id)"
_SCORE = "round(coalesce({a} / nullif({b}, 0), 0), 6)"


def _gold(spark, d):
    g = t(spark, d, "gold_labels").select("skill_id", "label_id", F.col("gold.label").alias("label"), F.col("gold.violation_subtype").alias("sub"), X.stratum(F.col("risk_stratum")).alias("st")).where("label is not null")
    return g.groupBy("skill_id").agg(*(F.max_by(c, F.struct(F.col(c).isNotNull(), F.col("label_id"))).alias(a) if c == "sub" else F.max_by(c, "label_id").alias(a) for c, a in (("label", "gold"), ("sub", "subtype"), ("st", "stratum"))))


@query(f"""with {_ITEMS}, {_GOLD}, pr as (select key as skill_id, case when count(*) filter (label = 'violation') > 0 then 'violation' else 'exposure-only' end as predicted from fs group by key),
a as (select coalesce(g.skill_id, p.skill_id) as skill_id, coalesce(g.gold = 'violation', false) as g, coalesce(p.predicted = 'violation', false) as p from gl g full join pr p on g.skill_id = p.skill_id),
c as (select cast(count(*) filter (g and p) as bigint) as tp, cast(count(*) filter (not g and p) as bigint) as fp, cast(count(*) filter (g and not p) as bigint) as fn from a)
select tp, fp, fn, {_SCORE.format(a='tp', b='(tp + fp)')} as precision, {_SCORE.format(a='tp', b='(tp + fn)')} as recall, {_SCORE.format(a='2 * tp', b='(2 * tp + fp + fn)')} as f1 from c""")
def violation_prf(spark, d):
    """Gold and predicted violations as sets: each side may lack the other's packages."""
    pred = S.predictions(_reports(spark, d)).select(F.col("key").alias("skill_id"), F.col("label").alias("predicted"))
    rows = _gold(spark, d).join(pred, "skill_id", "full").select(F.coalesce(F.col("gold") == "violation", F.lit(False)).alias("g"), F.coalesce(F.col("predicted") == "violation", F.lit(False)).alias("p"))
    return E.prf(rows, F.col("g"), F.col("p"))


@query(f"""with {FINDINGS}, {_GOLD}, ps as (select distinct skill_id, case finding_type when 'unsupported_behavior' then 'unsupported_behavior' when 'contradicted_behavior' then 'contradicted_behavior' else 'scope_violation' end as subtype from fi),
gs as (select skill_id, subtype from gl where subtype is not null), a as (select coalesce(g.subtype, p.subtype) as subtype, g.skill_id is not null as g, p.skill_id is not null as p from gs g full join ps p on g.skill_id = p.skill_id and g.subtype = p.subtype),
c as (select subtype, cast(count(*) filter (g and p) as bigint) as tp, cast(count(*) filter (not g and p) as bigint) as fp, cast(count(*) filter (g and not p) as bigint) as fn from a group by subtype)
select subtype, tp, fp, fn, {_SCORE.format(a='tp', b='(tp + fp)')} as precision, {_SCORE.format(a='tp', b='(tp + fn)')} as recall, {_SCORE.format(a='2 * tp', b='(2 * tp + fp + fn)')} as f1 from c""".replace("max_by(gold.violation_subtype, label_id)", "arg_max(gold.violation_subtype, label_id)"))
def prf_by_subtype(spark, d):
    """Findings against the gold subtypes, package by package."""
    found = Stages(spark, d).findings.select("skill_id", F.col("finding_type").alias("subtype")).distinct().withColumn("p", F.lit(True))
    gold = _gold(spark, d).where("subtype is not null").select("skill_id", "subtype", F.lit(True).alias("g"))
    rows = gold.join(found, ["skill_id", "subtype"], "full").fillna(False, ["g", "p"])
    return E.prf(rows, F.col("g"), F.col("p"), ["subtype"])


@query(f"""with {FINDINGS}, {_GOLD}, v as (select skill_id, count(*) as n from fi group by 1), x as (select skill_id, count(*) as n from ex group by 1),
p as (select g.gold, case when v.n > 0 then 'violation' when x.n > 0 then 'exposure-only' else 'benign' end as predicted from gl g left join v using (skill_id) left join x using (skill_id)),
l(label) as (values ('violation'), ('exposure-only'), ('benign')), grid as (select a.label as gold, b.label as predicted from l a, l b)
select gold, predicted, cast(count(p.gold) as bigint) as packages from grid left join p using (gold, predicted) group by 1, 2""")
def confusion_grid(spark, d):
    """All nine cells of gold and predicted labels, those without a package too."""
    s = Stages(spark, d)
    report = C.system_report(s.events, s.findings, s.exposures).select("skill_id", F.col("label").alias("predicted"))
    rows = _gold(spark, d).select("skill_id", "gold").join(report, "skill_id", "left").fillna("benign", ["predicted"])
    return E.confusion_cells(rows, "gold", "predicted", ("violation", "exposure-only", "benign"))


@query(f"""with {JUDGED}, e as (select operator, case when prohibited = 'true' or auth = 'true' then 'positive' when prohibited = 'false' or auth = 'false' then 'negative' else 'open' end as kind, anchored from jr)
select operator, cast(count(*) filter (kind = 'positive') as bigint) as positives, cast(count(*) filter (kind = 'negative') as bigint) as negatives, round(avg(cast(anchored as int)) filter (kind = 'positive'), 6) as positive_valid, round(1 - avg(cast(anchored as int)) filter (kind = 'negative'), 6) as negative_rejected,
 round((avg(cast(anchored as int)) filter (kind = 'positive') + 1 - avg(cast(anchored as int)) filter (kind = 'negative')) / 2, 6) as balanced from e group by operator""")
def edge_validity(spark, d):
    """Share of positive edges with a literal anchor, of negative ones without, and their mean; null where a side is empty."""
    j = Stages(spark, d).judged
    kind = F.when((F.col("prohibited") == tri.T) | (F.col("auth") == tri.T), "positive").when((F.col("prohibited") == tri.X) | (F.col("auth") == tri.X), "negative").otherwise("open")
    return E.edge_validity(j.withColumn("kind", kind), ["operator"], F.col("anchored"))
