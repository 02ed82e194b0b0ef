"""Three-valued predicates: the strings true, false and abstain, decided by CASE and never by SQL NULL logic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

T, X, A = "true", "false", "abstain"


def capability(same: Column, family_member: Column, family_known: Column, policy_empty: Column) -> Column:
    """Equal, else member of a known family, else abstain without any policy."""
    return F.when(same, T).when(family_known, F.when(family_member, T).otherwise(X)).when(policy_empty, A).otherwise(X)


def resource(target_given: Column, resources: Column, resolved: Column, matched: Column) -> Column:
    return F.when(~target_given | (resources == 0) | (resolved == 0), A).when(matched > 0, T).otherwise(X)


def scope(constraints: Column, judged: Column, failed: Column, passed: Column) -> Column:
    """Any failed constraint fails, all passed pass, all else abstains."""
    return F.when((constraints == 0) | (judged == 0), A).when(failed > 0, X).when(passed == constraints, T).otherwise(A)


def prohibition(cap: Column, bare: Column, res: Column, scp: Column) -> Column:
    return F.when(cap == X, X).when(cap == A, A).when(bare | (res == T) | (scp == T), T).when((res == A) | (scp == A), A).otherwise(X)


def first_not_true(*results: Column) -> Column:
    """The first result that is not true, else true."""
    return F.coalesce(*(F.when(r != T, r) for r in results), F.lit(T))


def authorization(cap: Column, route: Column, res: Column, scp: Column, target_given: Column, weak_alignment: Column) -> Column:
    base = first_not_true(cap, route, F.when(target_given, res).otherwise(T), scp)
    return F.when((base == T) & weak_alignment, A).otherwise(base)


def path_result(route: Column, events: Column, sensitive: Column, contradicted: Column, none: Column, partial: Column) -> Column:
    return (
        F.when(route != T, route).when((events == 0) | (sensitive == 0), A).when(contradicted > 0, X).when(none > 0, X).when(partial > 0, A).otherwise(T)
    )


def label(violations: Column, exposures: Column) -> Column:
    return F.when(violations > 0, "violation").when(exposures > 0, "exposure-only").otherwise("benign")
