"""Closures, components and bounded searches."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the session names; a local session that names none gets a
    local folder, a cluster must name one that all executors reach."""
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="marlstone-")
    spark.sparkContext.setCheckpointDir(named)


def closure(roots: DataFrame, edges: DataFrame, depth: int | None = None, expand: str | None = None) -> DataFrame:
    """G1: ``(node, level, parent)`` reached from ``roots(node)`` over ``edges(src, dst)``, the first
    reach wins and ties go to the least parent. ``expand`` is a condition on ``edges`` that an edge
    needs to be followed. One join of the frontier a level, until nothing is reached or ``depth``;
    the frontier is checkpointed, so that lineage does not grow."""
    shared_dir(roots.sparkSession)
    edges = edges.where(expand) if expand else edges
    seen = roots.select("node", F.lit(0).alias("level"), F.lit(None).cast(roots.schema["node"].dataType).alias("parent")).distinct().checkpoint()
    frontier, level = seen, 0
    while depth is None or level < depth:
        level += 1
        step = frontier.select(F.col("node").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).alias("level"), "parent").checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``(node, root)``, the least node that each is connected with. Labels spread to neighbours
    and jump to their label's label until nothing changes, about the logarithm of the longest path
    in rounds; an unfinished search raises. The few distinct labels of a round are joined with
    their own labels first, so a giant component is one row there and no hot key."""
    shared_dir(edges.sparkSession)
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")).checkpoint()
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        lower = labels.join(seen, "node").select("node", "root", F.least("root", "seen").alias("new"))
        far = lower.select("new").distinct().join(labels.select(F.col("node").alias("new"), F.col("root").alias("far")), "new")
        new = lower.join(far, "new", "left").select("node", "root", F.least("new", F.coalesce("far", "new")).alias("new")).checkpoint()
        done = new.where("new <> root").isEmpty()
        labels = new.select("node", F.col("new").alias("root"))
        if done:
            return labels
    raise RuntimeError(f"components not settled after {rounds} rounds")


def covers(groups: list[frozenset], chosen: set) -> bool:
    """Whether every requirement has a chosen alternative."""
    return all(chosen & g for g in groups)


def smallest_cover(requirements: list[list[str]], exact: int = 18) -> tuple[str, list[str]]:
    """The least set of facts that meets each requirement, of several the first in order. Facts
    that meet the same requirements are alternatives, the least stands for all of them. Exact up to
    ``exact`` requirements or kinds of fact, beyond that one pass that drops what is not needed."""
    groups = list(dict.fromkeys(frozenset(r) for r in requirements if r))
    facts = sorted(set().union(*groups)) if groups else []
    kinds: dict[int, str] = {}
    for fact in facts:
        kinds.setdefault(sum(1 << i for i, g in enumerate(groups) if fact in g), fact)
    if min(len(kinds), len(groups)) <= exact:

        @cache
        def least(missing: int) -> tuple[str, ...]:
            # One of the facts that meet the lowest missing requirement belongs to any cover.
            low = missing & -missing
            found = (tuple(sorted((fact, *least(missing & ~met)))) for met, fact in kinds.items() if met & low)
            return min(found, key=lambda s: (len(s), s)) if missing else ()

        return "exact", list(least((1 << len(groups)) - 1))
    kept = set(facts)
    for fact in facts:
        if covers(groups, kept - {fact}):
            kept.discard(fact)
    return "greedy", sorted(kept)


def witnesses(df: DataFrame, key: str, requirement: str, fact: str) -> DataFrame:
    """``(key, mode, facts, size)``: a minimal witness of each finding from rows of requirement and
    alternative fact. Only the least fact for each set of requirements that facts meet reaches the
    search, so that a finding costs no more for having many facts; rows without either are left out."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(requirement).cast("string").alias("req"), F.col(fact).cast("string").alias("fact")).where("req is not null and fact is not null")
    kinds = rows.groupBy("key", "fact").agg(F.sort_array(F.collect_set("req")).alias("reqs")).groupBy("key", "reqs").agg(F.min("fact").alias("fact"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        groups: dict[str, list[str]] = {}
        for reqs, name in zip(frame["reqs"], frame["fact"], strict=True):
            for req in reqs:
                groups.setdefault(req, []).append(name)
        mode, facts = smallest_cover([groups[req] for req in sorted(groups)])
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "mode": [mode], "facts": [facts], "size": [len(facts)]})

    return kinds.groupBy("key").applyInPandas(solve, "key string, mode string, facts array<string>, size int")
