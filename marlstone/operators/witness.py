"""Witnesses: the proof of a finding as a set of nodes, its closure, validation and irreducibility.

Nodes are certificates, judgments and facts, named by strings; ``needs(src, dst)`` says what a node
rests on. A witness is rows ``(key, node)``. All checks are joins over all witnesses at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph as G


def neighborhood(roots: DataFrame, needs: DataFrame) -> DataFrame:
    """``(key, node, level)``: all that the roots ``(key, node)`` rest on, by the least distance. One
    join a level until nothing new is reached; the frontier is checkpointed."""
    G.shared_dir(roots.sparkSession)
    seen = roots.select("key", "node", F.lit(0).alias("level")).distinct().checkpoint()
    frontier, level = seen, 0
    while True:
        level += 1
        step = frontier.select("key", F.col("node").alias("src")).join(needs, "src").select("key", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("key", "node"), ["key", "node"], "left_anti").select("key", "node", F.lit(level).alias("level")).checkpoint()
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def _within(witness: DataFrame, needs: DataFrame) -> DataFrame:
    """``(key, src, dst, held)``: each need of a node of the witness, and whether the witness holds it."""
    rows = witness.select("key", F.col("node").alias("src")).distinct().join(needs, "src")
    held = witness.select("key", F.col("node").alias("dst"), F.lit(True).alias("held")).distinct()
    return rows.join(held, ["key", "dst"], "left").fillna(False, ["held"])


def validate(witness: DataFrame, roots: DataFrame, needs: DataFrame, known: DataFrame) -> DataFrame:
    """``(key, passed, reason)`` for each root: its own node is there, every node is known, every need is
    held, and the whole hangs together; the first that fails is the reason, the least node naming it."""
    w = witness.select("key", "node").distinct()
    absent = roots.join(w, ["key", "node"], "left_anti").groupBy("key").agg(F.min("node").alias("absent"))
    strange = w.join(known.select("node").distinct(), "node", "left_anti").groupBy("key").agg(F.min("node").alias("strange"))
    inside = _within(w, needs).checkpoint()
    missing = inside.where("not held").groupBy("key").agg(F.min("dst").alias("missing"))
    name = lambda c: F.concat_ws("\u0001", "key", c)
    parts = G.components(inside.where("held").select(name("src").alias("src"), name("dst").alias("dst")))
    apart = w.select("key", name("node").alias("node")).join(parts, "node", "left").groupBy("key").agg(F.countDistinct(F.coalesce("root", "node")).alias("parts"))
    rows = roots.select("key").distinct()
    for part in (absent, strange, missing, apart):
        rows = rows.join(part, "key", "left")
    reason = (
        F.when(F.col("absent").isNotNull(), F.concat(F.lit("missing_root:"), "absent")).when(F.col("strange").isNotNull(), F.concat(F.lit("unknown:"), "strange"))
        .when(F.col("missing").isNotNull(), F.concat(F.lit("missing:"), "missing")).when(F.col("parts") > 1, "disconnected")
    )
    return rows.select("key", reason.isNull().alias("passed"), reason.alias("reason"))


def removable(witness: DataFrame, roots: DataFrame, needs: DataFrame) -> DataFrame:
    """``(key, node)`` that could be left out: no root, and nothing in the witness needs it. A witness
    without such rows is irreducible."""
    w = witness.select("key", "node").distinct()
    needed = _within(w, needs).where("held").select("key", F.col("dst").alias("node")).distinct()
    return w.join(roots.select("key", "node"), ["key", "node"], "left_anti").join(needed, ["key", "node"], "left_anti")


def contexts(witness: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """``(key, diagnostic, shared)``: diagnostics ``(diagnostic, node)`` that share nodes with a witness;
    witnesses without any have one row with none."""
    met = witness.select("key", "node").distinct().join(diagnostics.select("diagnostic", "node").distinct(), "node").groupBy("key", "diagnostic").agg(F.count("*").alias("shared"))
    return witness.select("key").distinct().join(met, "key", "left").fillna(0, ["shared"])
