"""Joins, groupings, rankings and set operations of the reconciliation, over DataFrames of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


# --- groupings -------------------------------------------------------------------------------------
def best_of_group(df: DataFrame, keys: Sequence[str], rank: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """A1: of each group the row with the least rank; one aggregate with map-side combine."""
    best = F.min_by(F.struct(*cols(keep)), F.struct(*rank))
    return df.groupBy(*keys).agg(best.alias("_best"), F.count("*").alias("merged")).select(*keys, "_best.*", "merged")


def vote(df: DataFrame, keys: Sequence[str], option: str, voter: str, voters: int, threshold: float = 0.6) -> DataFrame:
    """A2: the options that a share of distinct voters agrees on; ``decided`` counts them per group."""
    shares = df.groupBy(*keys, option).agg(F.countDistinct(voter).alias("votes")).withColumn("agreement", F.col("votes") / voters)
    return shares.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("agreement") >= threshold, F.col(option)))).alias("decided"), F.max("agreement").alias("best"))


def conflicts(df: DataFrame, keys: Sequence[str], value: str, pair: tuple[str, str]) -> DataFrame:
    """A3: groups that hold both values of a contradiction."""
    flags = [F.max((F.col(value) == v).cast("int")) for v in pair]
    return df.groupBy(*keys).agg(flags[0].alias("_a"), flags[1].alias("_b"), F.count("*").alias("members")).where("_a = 1 and _b = 1").drop("_a", "_b")


def collapse(strengths: Column) -> Column:
    """No strength is none, one is itself, several are mixed; over a set."""
    return F.when(F.size(strengths) == 0, "none").when(F.size(strengths) == 1, F.element_at(strengths, 1)).otherwise("mixed")


def ordered_union(seq: str, value: str) -> Column:
    """Distinct values in the order of their first sequence number; an aggregate."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(seq, value))), lambda s: s[value]))


# --- joins -----------------------------------------------------------------------------------------
def range_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, gap: int) -> DataFrame:
    """Right rows at most ``gap`` behind left rows of the same key. Positions are binned by the
    gap, so the join is an equi-join with a residual range and a hot key is spread over its bins."""
    width = gap + 1
    a = left.select(*keys, F.col(at).alias("a_at"), F.struct(*[c for c in left.columns if c not in keys]).alias("a"), F.floor(F.col(at) / width).alias("_bin"))
    b = right.select(*keys, F.col(at).alias("b_at"), F.struct(*[c for c in right.columns if c not in keys]).alias("b"), F.explode(F.array(F.floor(F.col(at) / width), F.floor(F.col(at) / width) - 1)).alias("_bin"))
    return a.join(b, [*keys, "_bin"]).where((F.col("b_at") >= F.col("a_at")) & (F.col("b_at") - F.col("a_at") <= gap)).drop("_bin")


def nearest_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], is_anchor: Column, value: Column) -> Column:
    """The value of the last anchor at or before each row, as a column; one sort, no join."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(F.when(is_anchor, value), ignorenulls=True).over(run)


def similarity_topk(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, k: int, least: float) -> DataFrame:
    """Lexical cosine of two token sets within a key; sets meet on their tokens only."""
    a = left.select(*keys, F.col(left_id).alias("l_id"), F.size("tokens").alias("ln"), F.explode("tokens").alias("token"))
    b = right.select(*keys, F.col(right_id).alias("r_id"), F.size("tokens").alias("rn"), F.explode("tokens").alias("token"))
    met = a.join(b, [*keys, "token"]).groupBy(*keys, "l_id", "r_id", "ln", "rn").agg(F.count("*").alias("shared"))
    scored = met.withColumn("score", F.round(F.col("shared") / F.sqrt(F.col("ln") * F.col("rn")), 6)).where(F.col("score") >= least)
    return top_k(scored, [*keys, "l_id"], [F.desc("score"), F.asc("r_id")], k).drop("ln", "rn")


# --- rankings --------------------------------------------------------------------------------------
def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "place") -> DataFrame:
    """Rows of the first k places of each group; Spark limits each group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def budget(df: DataFrame, keys: Sequence[str], position: str, score: Column, head: int, core: int, radius: int) -> DataFrame:
    """The first ``head`` rows, the best scored up to ``core``, and rows within ``radius`` of those."""
    by = Window.partitionBy(*keys)
    rows = df.withColumn("_score", score).withColumn("_pos", F.row_number().over(by.orderBy(position)))
    rows = rows.withColumn("_rank", F.row_number().over(by.orderBy(F.desc("_score"), F.asc("_pos"))))
    rows = rows.withColumn("_core", ((F.col("_pos") <= head) | (F.col("_rank") <= core)).cast("int"))
    near = F.max("_core").over(by.orderBy("_pos").rowsBetween(-radius, radius))
    return rows.withColumn("_near", near).where("_near = 1").withColumn("why", F.when(F.col("_pos") <= head, "head").when(F.col("_core") == 1, "score").otherwise("context")).drop("_score", "_pos", "_rank", "_core", "_near")


def round_robin(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], quota: int) -> DataFrame:
    """One row of each bucket in turn, until the quota of the group is full."""
    rows = df.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)))
    return top_k(rows.where(F.col("_turn") <= quota), keys, [F.asc("_turn"), F.asc(bucket)], quota).drop("_turn")


def largest_remainder(df: DataFrame, weight: str, total: int) -> DataFrame:
    """Integer shares of ``total`` in proportion to a weight; for a table of groups, not of rows."""
    whole = Window.partitionBy()
    rows = df.withColumn("_exact", F.col(weight) * total / F.sum(weight).over(whole)).withColumn("_floor", F.floor("_exact"))
    rows = rows.withColumn("_place", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), *[F.asc(c) for c in df.columns])))
    return rows.withColumn("quota", (F.col("_floor") + (F.col("_place") <= total - F.sum("_floor").over(whole)).cast("int")).cast("bigint")).drop("_exact", "_floor", "_place")


# --- sets ------------------------------------------------------------------------------------------
def except_both_ways(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side only, with the side."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, list(keys), "left_anti").withColumn("side", F.lit("right")))


def first_wins(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """The first row of each key by a sequence."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*cols(seq))).alias("_r")).select(*keys, "_r.*")
