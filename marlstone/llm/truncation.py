"""Texts that lost their end to a field limit or a broken transfer.

Method: for each source the discrete hazard of each length (texts that end there among those that
reach it) is computed by window functions and tested against the pooled hazard of the neighbouring
lengths by a binomial tail bound; Benjamini-Hochberg over all lengths keeps the false discovery rate
below ``rate``. At a significant length an ending counts as cut unless it is surely complete;
elsewhere (a transfer that broke off at any length) it counts only if it plainly stops inside a
word, a sentence or an open code block.

Null, empty and blank texts are never cut. Everything is Spark SQL; the shuffles carry one row
for each source and length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lengths on each side that serve as the neighbourhood of a length.
NEIGHBOURS = 40
#: False discovery rate over all lengths tested.
RATE = 0.01

_CLOSED = r"(?:[.!?。！？…]|[.!?]?[\"'”’»)\]】」』）*_`]|\.\.\.)"
_MARK = r"\p{So}\p{Sk}\x{FE0F}\x{200D}"
_BLANK = " \t\r\n\f\x0b​﻿ 　   "


def _endings(text: Column) -> dict[str, Column]:
    """Facts about the end of a text, each a boolean column. Patterns see the last line only."""
    body = F.rtrim(text, F.lit(_BLANK))
    last = F.substring_index(body, "\n", -1)
    fences = F.when(body.contains("```"), F.size(F.split(F.concat(F.lit("\n"), body), r"\n[ \t]*```", -1)) - 1).otherwise(0)
    return {
        "blank": F.length(body) == 0,
        "broken": last.endswith("�"),
        "open_code": fences % 2 == 1,
        "closed_code": last.rlike(r"^[ \t]*```[ \t]*$"),
        "closed": last.rlike(_CLOSED + rf"[ \t]*[{_MARK}]*$") | last.rlike(rf"[{_MARK}]$"),
        "ellipsis": last.endswith("…"),
        "signature": last.rlike(r"^-- ?\S{1,40}$"),
        "item": last.rlike(r"^[ \t]*(?:[-*+•]|\d+[.)])[ \t]+\S+$"),
        "url": last.rlike(r"^\s*https?://[^\s/]+/\S+$"),
        "heading": last.rlike(r"^#{1,6} "),
        "comment": last.rlike(r"^<!--.*-->$"),
        "table": last.rlike(r"^\|.*\|$"),
        "short": F.when(F.length(body) < 24, ~body.rlike(r"\S+\s+\S+\s+\S+\s+\S") & ~body.rlike(r"[぀-ヿ一-鿿]{8}")).otherwise(False),
    }


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(key, source, n, cut_end, unsure)`` for each text that is not blank. ``cut_end`` is an ending
    inside a word, a sentence or a code block; ``unsure`` one that is complete as a rule (a heading, a
    list item, an address, an ellipsis) but that a cut leaves behind as well."""
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    rows = rows.select("key", "source", F.length("text").alias("n"), F.struct(*(c.alias(k) for k, c in _endings(F.col("text")).items())).alias("e"))
    e = lambda name: F.col(f"e.{name}")
    loose = e("item") | e("url") | e("heading")
    natural = e("closed") | e("signature") | e("comment") | e("table") | e("short") | loose | e("closed_code")
    torn = e("broken") | (e("open_code") & ~e("closed_code"))
    return rows.where(~e("blank")).select("key", "source", "n", (torn | ~natural).alias("cut_end"), (e("ellipsis") | loose & ~e("closed")).alias("unsure"))


def hazards(rows: DataFrame, neighbours: int = NEIGHBOURS, rate: float = RATE) -> DataFrame:
    """``(source, n, ended, reached, torn, hazard, around, p, significant)`` for each source and
    length that occurs. ``hazard`` is the share of the texts that reach the length and end there,
    ``around`` that of the neighbouring lengths together: their ends over the texts at risk, summed
    over every integer length within ``neighbours``. p bounds the binomial tail (Chernoff)."""
    counts = rows.groupBy("source", "n").agg(F.count("*").alias("ended"), F.count_if(F.col("cut_end") | F.col("unsure")).alias("torn"))
    by = Window.partitionBy("source").orderBy("n")
    near = by.rangeBetween(-neighbours, neighbours)
    reached = F.sum("ended").over(Window.partitionBy("source").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Texts at risk up to a length: between two lengths that occur, all that reach the later one.
    risk = F.sum(F.col("reached") * (F.col("n") - F.coalesce(F.lag("n").over(by), F.lit(0)))).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = counts.withColumn("reached", reached).withColumn("risk", risk)
    first, last = F.first(F.struct("n", "reached", "risk")).over(near), F.last(F.struct("n", "reached", "risk", "ended")).over(near)
    r = r.withColumns({"ends": F.sum("ended").over(near) - F.col("ended"), "a": first, "z": last})
    before = F.col("a.reached") * (1 + F.col("a.n") - F.greatest(F.col("n") - neighbours, F.lit(1)))
    after = (F.col("z.reached") - F.col("z.ended")) * (F.col("n") + neighbours - F.col("z.n"))
    exposed = F.col("z.risk") - F.col("a.risk") + before + after - F.col("reached")
    r = r.withColumn("hazard", F.col("ended") / F.col("reached")).withColumn("around", F.least(F.lit(0.999), (F.col("ends") + 1.0) / (exposed + F.greatest(F.col("reached"), F.lit(2)))))
    h, q = F.col("hazard"), F.col("around")
    apart = h * F.log(h / q) + F.when(h < 1, (1 - h) * F.log((1 - h) / (1 - q))).otherwise(0.0)
    r = r.withColumn("p", F.when(h > q, F.exp(-F.col("reached") * apart)).otherwise(1.0))
    # Benjamini-Hochberg. Only p below the rate can pass; ranks are counted within bins of p, to
    # which the sizes of the bins before them are added, so no task sees all lengths.
    low = r.where(F.col("p") <= rate).withColumn("bin", F.floor(-8 * F.log(F.greatest("p", F.lit(1e-300)))))
    bins = low.groupBy("bin").agg(F.count("*").alias("c")).withColumn("less", F.sum("c").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")).drop("c")
    tests = r.agg(F.count("*").alias("tests"))
    low = low.join(F.broadcast(tests))  # one row
    ranked = low.join(bins, "bin").withColumn("place", F.col("less") + F.row_number().over(Window.partitionBy("bin").orderBy("p", "source", "n")))
    limit = ranked.where(F.col("p") <= rate * F.col("place") / F.col("tests")).agg(F.max("p").alias("limit"))
    return r.join(F.broadcast(limit)).select("source", "n", "ended", "reached", "torn", "hazard", "around", "p", F.coalesce(F.col("p") <= F.col("limit"), F.lit(False)).alias("significant"))


def truncated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **knobs) -> DataFrame:
    """``(key, source, n, at_limit)``: one row for each text that was cut. At a significant length
    an unsure ending counts too; elsewhere a text must plainly stop within something."""
    rows = marked(docs, key, text, source)
    lengths = hazards(rows, **knobs).where("significant").select(F.col("source").alias("at_source"), F.col("n").alias("at_n"), F.lit(True).alias("at_limit"))
    found = rows.where("cut_end or unsure").join(lengths, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("n") == F.col("at_n")), "left").where("cut_end or at_limit")
    return found.select(F.col("key").alias(key), "source", "n", F.coalesce("at_limit", F.lit(False)).alias("at_limit"))


def source_rates(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **knobs) -> DataFrame:
    """``(source, docs, cut, at_limit, rate)`` for each source, those without a cut text too."""
    every = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("docs"))
    cut = truncated(docs, key, text, source, **knobs).groupBy("source").agg(F.count("*").alias("cut"), F.count_if("at_limit").alias("at_limit"))
    cut = cut.withColumnRenamed("source", "cut_source")
    joined = every.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    return joined.select("source", "docs", F.coalesce("cut", F.lit(0)).cast("bigint").alias("cut"), F.coalesce("at_limit", F.lit(0)).cast("bigint").alias("at_limit"), F.round(F.coalesce("cut", F.lit(0)) / F.col("docs"), 6).alias("rate"))
