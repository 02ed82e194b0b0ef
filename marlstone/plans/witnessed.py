"""Proofs of contradictions and scope violations over the test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import witness as W
from .queries import query
from .reconciled import CERTS, Stages


def _proofs(spark, d):
    """Roots and needs: a certificate rests on its judgment, that on capability and route, those on the
    clause and the event; a scope failure on its check, the constraint and the resource."""
    s = Stages(spark, d)
    e = s.edges.where("relation in ('contradicts', 'scope_violates')").select("skill_id", "relation", "clause_id", "event_id", "constraint_id", "resource_id")
    n = lambda kind, *cols: F.concat_ws("|", F.lit(kind), "skill_id", *cols)
    block, scope = F.col("relation") == "contradicts", F.col("relation") == "scope_violates"
    pair = ("clause_id", F.col("event_id").cast("string"))
    cert = F.when(block, n("cert", *pair)).otherwise(n("cert", "constraint_id", "resource_id"))
    judgment = F.when(block, n("prohibition", *pair)).otherwise(n("scope", "constraint_id", "resource_id"))
    edge = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    cap, route, clause, event = n("cap", *pair), n("route", pair[1]), n("clause", "clause_id"), n("event", pair[1])
    both = [edge(cert, judgment)]
    blocked = [edge(judgment, cap), edge(judgment, route), edge(cap, clause), edge(cap, event), edge(route, event)]
    scoped = [edge(judgment, n("constraint", "constraint_id")), edge(judgment, n("resource", "resource_id"))]
    rows = e.withColumn("edges", F.when(block, F.array(*both, *blocked)).otherwise(F.array(*both, *scoped)))
    needs = rows.select(F.explode("edges").alias("e")).select("e.src", "e.dst").distinct().checkpoint()
    roots = e.select(cert.alias("key"), cert.alias("node"), F.when(scope, "scope_violation").otherwise("contradicted_behavior").alias("finding_type")).distinct().checkpoint()
    return roots, needs


_KEYS = f"""{CERTS}, ky as (select distinct 'contradicted_behavior' as finding_type, concat_ws('|', 'cert', skill_id, clause_id, cast(event_id as varchar)) as key, event_id from eg where relation = 'contradicts'
  union select distinct 'scope_violation', concat_ws('|', 'cert', skill_id, constraint_id, resource_id), cast(resource_id as bigint) from eg where relation = 'scope_violates')"""


@query(f"with {_KEYS} select finding_type, level, cast(count(*) as bigint) as witnesses, cast(sum(n) as bigint) as nodes from (select finding_type, key, unnest(case finding_type when 'scope_violation' then [0, 1, 2] else [0, 1, 2, 3] end) as level, unnest(case finding_type when 'scope_violation' then [1, 1, 2] else [1, 1, 2, 2] end) as n from ky) group by 1, 2")
def witnesses(spark, d):
    """The proof of each contradiction and scope violation, level by level."""
    roots, needs = _proofs(spark, d)
    rows = W.neighborhood(roots, needs).groupBy("key", "level").agg(F.count("*").alias("n")).join(roots.select("key", "finding_type"), "key")
    return rows.groupBy("finding_type", "level").agg(F.count("*").alias("witnesses"), F.sum("n").alias("nodes"))


@query(f"with {_KEYS} select finding_type, case when event_id % 3 <> 0 then 'passed' when finding_type = 'scope_violation' then 'missing' else 'missing' end as outcome, cast(count(*) as bigint) as witnesses from ky group by 1, 2")
def witness_validation(spark, d):
    """Proofs checked for closure and connection; every third event or resource is taken out of its proof."""
    roots, needs = _proofs(spark, d)
    w = W.neighborhood(roots, needs)
    last = F.substring_index("node", "|", -1).cast("bigint")
    spoiled = w.where(~(F.col("node").rlike("^(?:event|resource)[|]") & (last % 3 == 0)))
    checked = W.validate(spoiled, roots, needs, w.select("node")).join(roots.select("key", "finding_type"), "key")
    return checked.groupBy("finding_type", F.when(F.col("passed"), "passed").otherwise(F.substring_index("reason", ":", 1)).alias("outcome")).agg(F.count("*").alias("witnesses"))


@query(f"with {_KEYS} select finding_type, cast(0 as bigint) as removable, cast(count(*) as bigint) as padded from ky group by 1")
def witness_irreducible(spark, d):
    """Nodes that the proofs could do without: none, and just the one that is added to each."""
    roots, needs = _proofs(spark, d)
    w = W.neighborhood(roots, needs).select("key", "node")
    padded = w.unionByName(roots.select("key", F.concat(F.lit("extra|"), "key").alias("node")))
    count = lambda df, name: df.groupBy("key").agg(F.count("*").alias(name))
    rows = roots.select("key", "finding_type").join(count(W.removable(w, roots, needs), "removable"), "key", "left").join(count(W.removable(padded, roots, needs), "padded"), "key", "left").fillna(0, ["removable", "padded"])
    return rows.groupBy("finding_type").agg(F.sum("removable").alias("removable"), F.sum("padded").alias("padded"))
