"""Evaluation: precision and recall, confusion, rates, tests and resampling."""

from __future__ import annotations

from math import exp, lgamma, log, log1p, pi, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    """a / b rounded, 0 for an empty denominator."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)


def prf(df: DataFrame, gold: Column, predicted: Column, keys: list[str] | None = None) -> DataFrame:
    counts = df.groupBy(*(keys or [])).agg(F.count_if(gold & predicted).alias("tp"), F.count_if(~gold & predicted).alias("fp"), F.count_if(gold & ~predicted).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r, "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def confusion(df: DataFrame, gold: str, predicted: str, labels: list[str]) -> DataFrame:
    """A row for each gold label that occurs, a column for each predicted one, zeros filled; see ``confusion_cells``."""
    return df.groupBy(F.col(gold).alias("gold")).agg(*(F.count_if(F.col(predicted) == v).alias(v.replace("-", "_")) for v in labels))


def confusion_cells(df: DataFrame, gold: str, predicted: str, labels: tuple[str, ...]) -> DataFrame:
    """``(gold, predicted, packages)`` for every pair of labels, 0 where no row has it."""
    counts = df.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "gold string, predicted string")
    return grid.join(counts, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("packages"))


def edge_validity(df: DataFrame, keys: list[str], valid: Column) -> DataFrame:
    """Share of valid positive edges, of rejected negative ones, and their mean; ``kind`` names the side."""
    share = lambda side: F.avg(F.when(F.col("kind") == side, valid.cast("int")))
    rows = df.groupBy(*keys).agg(F.count_if(F.col("kind") == "positive").alias("positives"), F.count_if(F.col("kind") == "negative").alias("negatives"), share("positive").alias("p"), (1 - share("negative")).alias("n"))
    return rows.select(*keys, "positives", "negatives", F.round("p", 6).alias("positive_valid"), F.round("n", 6).alias("negative_rejected"), F.round((F.col("p") + F.col("n")) / 2, 6).alias("balanced"))


def _stirling(n: int) -> float:
    """What Stirling's formula leaves of log n!."""
    if n < 16:
        return lgamma(n + 1) - (n + 0.5) * log(n) + n - 0.5 * log(2 * pi)
    return (1 - (1 - (1 - 0.75 / (n * n)) / (3.5 * n * n)) / (30 * n * n)) / (12 * n)


def exact_p(n: int, least: int) -> float:
    """Two-sided p of ``least`` or fewer of n fair tosses, capped at 1, for any n. The largest term comes
    from Stirling's formula with its remainder, which loses no digits to large logarithms; each further
    one is a fraction of the one before, and they are added until the sum no longer changes."""
    if not n:
        return 1.0
    if not least:
        return min(1.0, 2.0 * 0.5**n)
    off = (2 * least - n) / n
    apart = n / 2 * ((1 + off) * log1p(off) + (1 - off) * log1p(-off))
    term = total = sqrt(n / (2 * pi * least * (n - least))) * exp(_stirling(n) - _stirling(least) - _stirling(n - least) - apart)
    for k in range(least, 0, -1):
        term *= k / (n - k + 1)
        if total + term == total:
            break
        total += term
    return min(1.0, 2.0 * total)


def mcnemar(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Discordant pairs and the exact two-sided p of the binomial tail, capped at 1; see ``exact_p``."""
    n = df.agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))

    @F.pandas_udf("double")
    def tail(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([exact_p(int(i + j), int(min(i, j))) for i, j in zip(x, y, strict=True)])

    return n.withColumn("p", F.round(tail(F.col("only_a"), F.col("only_b")), 6))


def holm(df: DataFrame, p: str, order: list[str], alpha: float = 0.05) -> DataFrame:
    """Step-down: rejected while p of the i-th smallest stays within alpha / (m - i + 1)."""
    by = Window.orderBy(p, *order)
    rows = df.withColumn("place", F.row_number().over(by)).withColumn("m", F.count("*").over(Window.partitionBy()))
    rows = rows.withColumn("limit", F.lit(alpha) / (F.col("m") - F.col("place") + 1))
    return rows.withColumn("rejected", F.min((F.col(p) <= F.col("limit")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1).drop("m")


def bootstrap(df: DataFrame, value: str, rounds: int = 1000, seed: int = 0, confidence: float = 0.95, key: str | None = None) -> DataFrame:
    """Percentile interval of the mean by a Poisson bootstrap: each row weighs in each round as often
    as a hash of row and round says, so no resample is gathered anywhere. Rounds are columns of
    one pass; only their sums are shuffled. With a ``key`` the interval is the same however the rows are
    partitioned."""
    weights = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda b: _poisson((F.pmod(F.xxhash64(F.col("_id"), b, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))))
    rows = df.select(F.col(value).cast("double").alias("_v"), (F.col(key) if key else F.monotonically_increasing_id()).alias("_id")).where("_v is not null")
    sums = rows.select("_v", F.posexplode(weights).alias("b", "w")).where("w > 0").groupBy("b").agg((F.sum(F.col("_v") * F.col("w")) / F.sum("w")).alias("mean"))
    low = (1 - confidence) / 2
    bounds = sums.agg(F.percentile("mean", F.lit(low)).alias("low"), F.percentile("mean", F.lit(1 - low)).alias("high"), F.count("*").alias("rounds"))
    return bounds


def _poisson(u: Column) -> Column:
    """Poisson(1) by inversion, cut at 6 (its tail beyond is below 1e-4)."""
    total, out, p = 0.0, None, 0.36787944117144233
    for k in range(7):
        total += p
        out = F.when(u < total, F.lit(k)) if out is None else out.when(u < total, F.lit(k))
        p /= k + 1
    return out.otherwise(F.lit(7))
