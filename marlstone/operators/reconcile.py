"""From clauses and observed behaviour to candidates, judgments, edges, certificates and reports.

Tables, each with ``skill_id``: ``clauses(clause_id, capability, operator, target, aligned)``,
``constraints(clause_id, constraint_id, ctype, cvalue)``, ``events(event_id, unit_id, capability,
api_call, tier, file_path, line, detail)``, ``resources(resource_id, event_id, rtype, rvalue, resolved,
origin)``, ``paths(path_id, source_event, sink_event, route)``. Operators are allowed, prohibited and
unknown; results are true, false and abstain. Every step is an equi-join or a grouped aggregate, and
nothing is kept per package in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as X
from . import relational as R
from . import tri

#: Weight of each way in which a clause and an event met; the sum ranks candidates.
STRENGTH = {"literal_overlap": 40, "capability": 30, "package_link": 20, "similarity": 10}
#: Candidates kept for each event, the strongest first.
CANDIDATES = 8
ANCHORS = ("literal_overlap", "package_link", "file_mention", "step_unit_alignment")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rows whose strings are equal but for case, share a last path part, or of which one begins
    with the other. Four equi-joins: prefixes of each side are rows that meet whole values of the other."""
    lv, rv = left.withColumn("_a", F.lower(a)), right.withColumn("_b", F.lower(b))
    name = lambda c: F.nullif(rules.base(rules.plain_path(F.col(c))), F.lit(""))
    heads = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(F.col(c), F.lit(1), i))
    out = [*[F.col(f"l.{c}").alias(c) for c in left.columns], *[F.col(f"r.{c}").alias(c) for c in right.columns if c not in keys]]
    same = lambda x, y: [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col(f"l.{x}") == F.col(f"r.{y}")]
    parts = [
        lv.alias("l").join(rv.alias("r"), same("_a", "_b")).select(out),
        lv.withColumn("_n", name(a)).alias("l").join(rv.withColumn("_n", name(b)).alias("r"), same("_n", "_n")).select(out),
        lv.alias("l").join(rv.where(F.length(b) > 0).withColumn("_h", F.explode(heads(b))).alias("r"), same(a, "_h")).select(out),
        lv.where(F.length(a) > 0).withColumn("_h", F.explode(heads(a))).alias("l").join(rv.alias("r"), same("_h", b)).select(out),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()


def hits(clauses: DataFrame, constraints: DataFrame, events: DataFrame, resources: DataFrame) -> DataFrame:
    """``(skill_id, clause_id, event_id, source)``: J1 by capability family, J2 by literals."""
    c = clauses.select("skill_id", "clause_id", "capability").withColumn("family", X.family(F.col("capability")))
    e = events.select("skill_id", "event_id", F.col("capability").alias("cap")).withColumn("family", X.family(F.col("cap")))
    family = c.join(e, ["skill_id", "family"]).where((F.col("family") != "other") | (F.col("capability") == F.col("cap")))
    surfaces = constraints.where(~F.col("ctype").isin(*rules.SCOPE_TYPES)).select("skill_id", "clause_id", "cvalue").distinct()
    uses = resources.where("resolved").select("skill_id", "event_id", "rvalue")
    literal = overlaps(surfaces, uses, ["skill_id"], "cvalue", "rvalue")
    keys = ["skill_id", "clause_id", "event_id"]
    return family.select(*keys, F.lit("capability").alias("source")).unionByName(literal.select(*keys, F.lit("literal_overlap").alias("source")))


def candidates(found: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The driver: hits merged by clause and event, the strongest ``k`` of each event."""
    weight = F.coalesce(*(F.when(F.col("source") == s, w) for s, w in STRENGTH.items()), F.lit(0))
    merged = found.distinct().groupBy("skill_id", "clause_id", "event_id").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.sum(weight).alias("strength"))
    return R.top_k(merged, ["skill_id", "event_id"], [F.desc("strength"), F.asc("clause_id")], k)


def scope_checks(cands: DataFrame, constraints: DataFrame, events: DataFrame, resources: DataFrame) -> DataFrame:
    """One row for each candidate, scope constraint and resource that it applies to, with its result."""
    c = constraints.where(F.col("ctype").isin(*rules.SCOPE_TYPES))
    rows = cands.select("skill_id", "clause_id", "event_id").join(c, ["skill_id", "clause_id"]).join(events.select("skill_id", "event_id", "capability"), ["skill_id", "event_id"]).join(resources, ["skill_id", "event_id"])
    args = [F.col(x) for x in ("ctype", "cvalue", "rtype", "rvalue", "origin", "resolved", "capability")]
    return rows.where(rules.applies(F.col("ctype"), F.col("rtype"))).select("skill_id", "clause_id", "event_id", "constraint_id", "resource_id", "ctype", rules.constraint_status(*args).alias("result"))


def judged(cands: DataFrame, clauses: DataFrame, constraints: DataFrame, events: DataFrame, resources: DataFrame) -> DataFrame:
    """One row for each candidate with all its results: P1 to P5, authorization with the reason of an
    abstention, and what the clause prohibits."""
    key = ["skill_id", "clause_id", "event_id"]
    some = clauses.select("skill_id").distinct().withColumn("policy", F.lit(True))
    rows = cands.join(clauses.select("skill_id", "clause_id", F.col("capability").alias("clause_cap"), "operator", "target", "aligned"), ["skill_id", "clause_id"])
    rows = rows.join(events.select("skill_id", "event_id", "capability", "tier"), ["skill_id", "event_id"], "left").join(some, "skill_id", "left")
    shape = constraints.groupBy("skill_id", "clause_id").agg(F.max(F.col("ctype").isin(*rules.RESOURCE_TYPES)).alias("narrowed"), F.max(F.col("ctype").isin(*rules.SCOPE_TYPES)).alias("scoped"), F.count("*").alias("constraints"))
    rows = rows.join(shape, ["skill_id", "clause_id"], "left").withColumns({"narrowed": F.coalesce("narrowed", F.lit(False)), "scoped": F.coalesce("scoped", F.lit(False)), "constraints": F.coalesce("constraints", F.lit(0))})
    # Resources of the event against the clause's target or else its constraints, in one aggregate.
    near = cands.select(*key).join(clauses.select("skill_id", "clause_id", "target"), ["skill_id", "clause_id"]).join(resources, ["skill_id", "event_id"]).join(constraints.where(F.col("ctype").isin(*rules.RESOURCE_TYPES)), ["skill_id", "clause_id"], "left")
    r = [F.col("rtype"), F.col("rvalue")]
    hit = F.when(F.col("target").isNotNull(), rules.target_matches(F.col("target"), *r)).otherwise(F.coalesce(rules.constraint_matches(F.col("ctype"), F.col("cvalue"), *r), F.lit(False)))
    met = near.groupBy(*key).agg(F.countDistinct("resource_id").alias("resources"), F.max("resolved").alias("resolved"), F.max(F.col("resolved") & F.coalesce(hit, F.lit(False))).alias("matched"))
    scope = scope_checks(cands, constraints, events, resources).groupBy(*key).agg(F.count("*").alias("checks"), *(F.count_if(F.col("result") == v).alias(n) for v, n in (("false", "failed"), ("abstain", "open"), ("true", "passed"))))
    rows = rows.join(met, key, "left").join(scope, key, "left").fillna(0, ["resources", "checks", "failed", "open", "passed"]).withColumns({"resolved": F.coalesce("resolved", F.lit(False)), "matched": F.coalesce("matched", F.lit(False))})
    same = F.col("clause_cap") == F.col("capability")
    known = X.family(F.col("clause_cap")) != "other"
    member = known & (X.family(F.col("clause_cap")) == X.family(F.col("capability")))
    cap = F.when(F.col("capability").isNull(), tri.X).otherwise(tri.capability(same, member, known, F.col("policy").isNull()))
    route = F.when(F.col("capability").isNull(), tri.X).when(F.col("tier") == "instruction", tri.A).otherwise(tri.T)
    given = F.col("target").isNotNull() | F.col("narrowed")
    res = F.when(~given | (F.col("resources") == 0) | ~F.col("resolved"), tri.A).when(F.col("matched"), tri.T).otherwise(tri.X)
    rows = rows.withColumns({"cap": cap, "route": route, "res": res, "given": given})
    scp = F.when(~F.col("scoped"), tri.T).when(F.col("checks") == 0, tri.A).when(F.col("failed") > 0, tri.X).when(F.col("open") > 0, tri.A).otherwise(tri.T)
    # P3 proper asks the target where no scope constraint is given; prohibitions use it.
    p3 = F.when((F.col("resources") == 0) | ~F.col("resolved"), tri.A).when(F.col("scoped"), F.when(F.col("checks") == 0, tri.A).otherwise(scp)).when(F.col("target").isNotNull(), F.when(F.col("matched"), tri.T).otherwise(tri.X)).otherwise(tri.A)
    rows = rows.withColumns({"scp": scp, "p3": p3})
    base = tri.first_not_true(F.col("cap"), F.col("route"), F.when(F.col("given"), F.col("res")).otherwise(tri.T), F.col("scp"))
    anchored = F.arrays_overlap("sources", F.array(*(F.lit(s) for s in ANCHORS)))
    guard = (base == tri.T) & (F.col("aligned") == False) & ~anchored  # noqa: E712
    reason = (
        F.when(F.col("cap") == tri.A, "capability_overlap_abstained").when(F.col("route") == tri.A, "route_check_abstained").when(F.col("given") & (F.col("res") == tri.A), "resource_compatibility_abstained")
        .when(F.col("scoped") & ((F.col("checks") == 0) | (F.col("open") > 0)), "scope_check_abstained").when(guard, "alignment_mismatch")
    )
    auth = F.when(F.col("operator") == "allowed", F.when(guard, tri.A).otherwise(base))
    prohibited = F.when(F.col("operator") == "prohibited", tri.prohibition(F.col("cap"), F.col("target").isNull() & (F.col("constraints") == 0), F.col("res"), F.col("p3")))
    kept = ["sources", "strength", "operator", "capability", "tier", "cap", "route", "res", "scp", "given", "failed", "passed"]
    return rows.select(*key, *kept, F.col("target").isNotNull().alias("targeted"), anchored.alias("anchored"), auth.alias("auth"), F.when(auth == tri.A, reason).alias("reason"), prohibited.alias("prohibited"))


def edges(j: DataFrame, checks: DataFrame) -> DataFrame:
    """``(skill_id, relation, clause_id, event_id, constraint_id, resource_id, strength)``, each once."""
    usable = (F.col("cap") == tri.T) & (F.col("route") != tri.X) & ~(F.col("given") & (F.col("res") == tri.X)) & (F.col("failed") == 0)
    weak = (F.col("auth") == tri.A) & usable & (F.col("anchored") | (F.col("given") & (F.col("res") == tri.T)) | (F.col("passed") > 0))
    relation = (
        F.when(F.col("prohibited") == tri.T, "contradicts").when(F.col("auth") == tri.T, "supports").when(weak, "potentially_supports").when((F.col("operator") == "unknown") & usable, "relates_to")
    )
    none = F.lit(None).cast("string")
    strength = F.when(F.col("relation") == "supports", F.when(F.col("tier") == "instruction", "weak").otherwise("strong")).when(F.col("relation") == "contradicts", "strong").otherwise("weak")
    own = j.withColumn("relation", relation).where("relation is not null").select("skill_id", "relation", "clause_id", "event_id", none.alias("constraint_id"), none.alias("resource_id"), strength.alias("strength"))
    may = (F.col("operator") == "allowed") & (F.col("cap") == tri.T) & (F.col("route") == tri.T) & (~F.col("targeted") | (F.col("res") == tri.T))
    scope = checks.join(j.select("skill_id", "clause_id", "event_id", "operator", "cap", "route", "res", "targeted"), ["skill_id", "clause_id", "event_id"])
    scope = scope.withColumn("relation", F.when(F.col("result") == tri.T, "scope_matches").when((F.col("result") == tri.X) & may, "scope_violates")).where("relation is not null")
    scope = scope.select("skill_id", "relation", "clause_id", "event_id", "constraint_id", F.col("resource_id").cast("string").alias("resource_id"), F.lit("strong").alias("strength"))
    return own.withColumn("event_id", F.col("event_id")).unionByName(scope).distinct()


def certificates(j: DataFrame, found: DataFrame, events: DataFrame) -> DataFrame:
    """``(skill_id, kind, subject, events)``: events without any support grouped by what they are,
    blocking prohibitions and scope failures one by one. ``subject`` names the group."""
    key = ["skill_id", "event_id"]
    failed = found.where("relation = 'scope_violates'").select(*key).distinct()
    spoken = j.where("auth in ('true', 'abstain')").select(*key).distinct()
    alone = events.where("tier <> 'instruction'").join(failed, key, "left_anti").join(spoken, key, "left_anti")
    what = F.concat_ws("|", F.coalesce("unit_id", F.lit("")), "capability", "tier", F.coalesce("api_call", "detail", F.lit("")), "file_path")
    no_support = alone.groupBy("skill_id", what.alias("subject")).agg(F.sort_array(F.collect_set("event_id")).alias("events")).withColumn("kind", F.lit("no_support"))
    block = found.where("relation = 'contradicts'").select("skill_id", F.concat_ws("|", "clause_id", F.col("event_id").cast("string")).alias("subject"), F.array("event_id").alias("events"), F.lit("blocking_prohibition").alias("kind"))
    scope = found.where("relation = 'scope_violates'").select("skill_id", F.concat_ws("|", "constraint_id", "resource_id").alias("subject"), F.array("event_id").alias("events"), F.lit("scope_failure").alias("kind"))
    return no_support.unionByName(block).unionByName(scope).select("skill_id", "kind", "subject", "events")


def flagged(certs: DataFrame, sensitive: DataFrame) -> DataFrame:
    """``(skill_id, event_id)`` that a certificate names directly: sensitive ones without support, and prohibited ones."""
    rows = certs.where("kind <> 'scope_failure'").select("skill_id", "kind", F.explode("events").alias("event_id"))
    return rows.join(sensitive.withColumn("sensitive", F.lit(True)), ["skill_id", "event_id"], "left").where("kind = 'blocking_prohibition' or sensitive").select("skill_id", "event_id").distinct()


def findings(certs: DataFrame, events: DataFrame, sensitive: DataFrame) -> DataFrame:
    """``(skill_id, finding_type, signature, support, certificates, events)``: findings of one type whose
    events are of the same families in the same files are one; others stand alone."""
    kinds = {"no_support": "unsupported_behavior", "blocking_prohibition": "contradicted_behavior", "scope_failure": "scope_violation"}
    rows = certs.select("skill_id", "kind", "subject", F.explode("events").alias("event_id")).join(events.select("skill_id", "event_id", "family", "file_path"), ["skill_id", "event_id"])
    rows = rows.join(sensitive.withColumn("sensitive", F.lit(True)), ["skill_id", "event_id"], "left").where("kind <> 'no_support' or sensitive")
    each = rows.groupBy("skill_id", "kind", "subject").agg(F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.array_join(F.sort_array(F.collect_set("file_path")), ",").alias("files"), F.collect_set("event_id").alias("events"))
    each = each.withColumn("signature", F.when(F.col("kind") == "no_support", F.concat_ws("|", "families", "files")).otherwise(F.col("subject")))
    merged = each.groupBy("skill_id", "kind", "signature").agg(F.count("*").alias("certificates"), F.size(F.array_distinct(F.flatten(F.collect_list("events")))).cast("bigint").alias("events"))
    name = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in kinds.items()))
    return merged.select("skill_id", name.alias("finding_type"), "signature", F.when(F.col("kind") == "no_support", "diagnostic").otherwise("graph_backed").alias("support"), "certificates", "events")


def exposures(found: DataFrame, certs: DataFrame, events: DataFrame, sensitive: DataFrame) -> DataFrame:
    """Sensitive events that a clause supports and nothing blocks, merged by family and file."""
    key = ["skill_id", "event_id"]
    blocked = flagged(certs, sensitive).unionByName(found.where("relation = 'scope_violates'").select(*key)).distinct()
    rows = found.where("relation = 'supports'").join(sensitive, key, "left_semi").join(blocked, key, "left_anti").join(events.where("tier <> 'instruction'").select(*key, "family", "file_path"), key)
    merged = rows.groupBy("skill_id", "family", "file_path").agg(F.countDistinct("event_id").alias("events"), F.countDistinct("clause_id").alias("clauses"), R.collapse(F.sort_array(F.collect_set("strength"))).alias("support_strength"))
    return merged.select("skill_id", F.lit("declared_sensitive_behavior").alias("exposure_type"), "family", "file_path", "events", "clauses", "support_strength")


def diagnostics(j: DataFrame, found: DataFrame, events: DataFrame, sensitive: DataFrame) -> DataFrame:
    """Open questions: authorizations of sensitive events that abstain, by clause, family and reason, and
    planned sensitive actions of instructions that no clause settles."""
    key = ["skill_id", "event_id"]
    facts = events.select(*key, "family", "file_path", "tier")
    gaps = j.where("auth = 'abstain'").select(*key, "clause_id", "reason").join(sensitive, key, "left_semi").join(facts, key)
    kind = F.when(F.col("reason") == "alignment_mismatch", "alignment_mismatch").otherwise("policy_gap")
    backed = found.select(*key, "clause_id", F.lit(True).alias("backed")).where("event_id is not null").distinct()
    gaps = gaps.join(backed, [*key, "clause_id"], "left")
    policy = gaps.groupBy("skill_id", kind.alias("diagnostic_type"), F.col("clause_id").alias("subject"), "family").agg(F.countDistinct("event_id").alias("events"), F.max(F.coalesce("backed", F.lit(False))).alias("backed"))
    settled = found.where("relation in ('supports', 'contradicts')").select(*key).distinct()
    planned = facts.where("tier = 'instruction'").join(sensitive, key, "left_semi").join(gaps.select(*key).distinct(), key, "left_anti").join(settled, key, "left_anti").join(found.select(*key, F.lit(True).alias("edge")).distinct(), key, "left")
    plan = planned.groupBy("skill_id", F.lit("planned_behavior_gap").alias("diagnostic_type"), F.col("file_path").alias("subject"), "family").agg(F.countDistinct("event_id").alias("events"), F.max(F.coalesce("edge", F.lit(False))).alias("backed"))
    both = policy.unionByName(plan)
    return both.select("skill_id", "diagnostic_type", "subject", "family", "events", F.when(F.col("backed"), "graph_backed").otherwise("diagnostic").alias("support"))


def path_judgments(paths: DataFrame, found: DataFrame, sensitive: DataFrame) -> DataFrame:
    """Each path with its route, the support of its sensitive events and the result: a prohibition on
    any of its events is false, a sensitive event without an edge false, one with a weak edge abstains."""
    steps = paths.select("skill_id", "path_id", "route", F.explode(F.array_distinct(F.array("source_event", "sink_event"))).alias("event_id"))
    key = ["skill_id", "event_id"]
    by_event = found.where("event_id is not null").groupBy(*key).agg(F.count_if(F.col("relation") == "supports").alias("strong"), F.count_if(F.col("relation").isin("potentially_supports", "relates_to")).alias("weak"), F.count_if(F.col("relation") == "contradicts").alias("against"))
    rows = steps.join(by_event, key, "left").join(sensitive.withColumn("sensitive", F.lit(1)), key, "left").fillna(0, ["strong", "weak", "against", "sensitive"])
    need = F.col("sensitive") == 1
    per = rows.groupBy("skill_id", "path_id", "route").agg(F.count("*").alias("events"), F.sum("sensitive").alias("needed"), F.sum("against").alias("against"), F.count_if(need & (F.col("strong") == 0) & (F.col("weak") == 0)).alias("none"), F.count_if(need & (F.col("strong") == 0) & (F.col("weak") > 0)).alias("partial"))
    result = tri.path_result(F.col("route"), F.col("events"), F.col("needed"), F.col("against"), F.col("none"), F.col("partial"))
    reason = F.when(F.col("route") == tri.A, "route_check_abstained").when(F.col("needed") == 0, "open_world_path_only").when((F.col("against") == 0) & (F.col("none") == 0) & (F.col("partial") > 0), "partial_path_coverage")
    return per.select("skill_id", "path_id", "route", "needed", result.alias("result"), F.when(result == tri.A, reason).alias("reason"))


def system_report(skills: DataFrame, found: DataFrame, exposed: DataFrame) -> DataFrame:
    """``(skill_id, violations, exposures, label)`` for every skill."""
    v = found.groupBy("skill_id").agg(F.count("*").alias("violations"))
    x = exposed.groupBy("skill_id").agg(F.count("*").alias("exposures"))
    rows = skills.select("skill_id").distinct().join(v, "skill_id", "left").join(x, "skill_id", "left").fillna(0, ["violations", "exposures"])
    return rows.withColumn("label", tri.label(F.col("violations"), F.col("exposures")))


def strip(constraints: DataFrame) -> DataFrame:
    """The ablation without scope: no constraint of scope is left."""
    return constraints.where(~F.col("ctype").isin(*rules.SCOPE_TYPES))


