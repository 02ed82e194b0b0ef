"""Cutting oversized items into overlapping pieces at natural boundaries.

Method: the text's tokens give an offset prefix array; the boundaries of each strength (paragraph,
line, sentence, token) are sorted arrays. For each piece a binary search finds the last boundary of
the strongest kind that fills at least half of the limit; the next piece steps back by exactly the
overlap; where no boundary fits, the piece is cut at the limit.

Pieces cover the item without a gap, each is at most ``limit`` characters, and neighbours share
exactly ``overlap`` characters (less only where the limit leaves no room for it). Null and empty
texts are never oversized. Lengths are code points.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .base import map_batches, once

_TOKEN = re.compile(r"[^ \t\r\n]+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_LINE = re.compile(r"\r?\n")
_SENTENCE = re.compile(r"[.!?…][\"')\]]*[ \t]+|[。！？]")
#: Cumulative characters of a bundle after which a new run of pieces begins, in limits.
SEGMENT = 64
#: Numbers kept for the pieces of a segment; a segment is one excerpt longer than ``SEGMENT`` at most.
SEGMENT_PIECES = 1 << 31


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted cut offsets, strongest kind first."""
    kinds = [np.fromiter((m.end() for m in p.finditer(text)), "int64") for p in (_PARAGRAPH, _LINE, _SENTENCE)]
    return [*kinds, token_offsets(text)[:, 0]]


def token_offsets(text: str) -> np.ndarray:
    """Start and end of each token, a prefix array over the text."""
    return np.array([m.span() for m in _TOKEN.finditer(text)], "int64").reshape(-1, 2)


def longest_run(text: str) -> int:
    """Characters of the longest stretch without space, tab, CR or LF."""
    spans = token_offsets(text)
    return int((spans[:, 1] - spans[:, 0]).max(initial=0))


def cut(size: int, kinds: list[np.ndarray], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the pieces of an item of ``size``."""
    if limit < 1:
        raise ValueError("the limit must be positive")
    overlap = max(0, min(overlap, limit - 1))
    spans, start = [], 0
    while size - start > limit:
        top = start + limit
        end = 0
        for least in (start + max(limit // 2, overlap + 1), start + overlap + 1):
            for found in kinds:
                at = int(np.searchsorted(found, top, "right")) - 1
                if at >= 0 and found[at] >= least:
                    end = int(found[at])
                    break
            if end:
                break
        end = end or top
        spans.append((start, end))
        start = end - overlap
    if size:
        spans.append((start, size))
    return spans


def split_text(text: str | None, limit: int, overlap: int) -> list[tuple[int, int]]:
    return cut(len(text), boundaries(text), limit, overlap) if text else []


def with_limits(excerpts: DataFrame, bundles: DataFrame, configs: DataFrame) -> DataFrame:
    """Each distinct excerpt with the limits of its bundle's build configuration. The configurations
    are a fixed handful of rows; an excerpt without bundle or configuration has no limit and is left out."""
    limits = configs.select("prompt_version", "max_file_chars", "max_total_chars", "overlap_chars").dropDuplicates(["prompt_version"])
    per_bundle = bundles.select("bundle_id", "prompt_version").dropDuplicates(["bundle_id"]).join(F.broadcast(limits), "prompt_version").drop("prompt_version")
    return excerpts.join(per_bundle, "bundle_id")


_PIECES = T.StructType([
    T.StructField("item_kind", T.StringType()), T.StructField("item_id", T.LongType()), T.StructField("piece_no", T.LongType()),
    T.StructField("excerpt_id", T.LongType()), T.StructField("from_char", T.LongType()), T.StructField("to_char", T.LongType()), T.StructField("piece", T.StringType()),
])


def _long(excerpts: DataFrame, bundles: DataFrame, configs: DataFrame) -> DataFrame:
    low = configs.agg(F.min("max_file_chars").alias("low"))  # one row
    long = excerpts.select("excerpt_id", "bundle_id", "text").join(F.broadcast(low), F.length("text") > F.col("low"))
    rows = with_limits(once(long.drop("low"), "excerpt_id"), bundles, configs).where(F.length("text") > F.col("max_file_chars"))
    return rows.select("excerpt_id", "text", "max_file_chars", "overlap_chars")


def excerpt_pieces(excerpts: DataFrame, bundles: DataFrame, configs: DataFrame) -> DataFrame:
    """Pieces of each excerpt above its max_file_chars; offsets are within the excerpt. Only the
    oversized texts leave the JVM, and no text is shuffled but to be joined with its limit."""

    def fn(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for key, text, limit, overlap in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            for no, (a, b) in enumerate(split_text(text, limit, overlap)):
                out.append(("excerpt", key, no, key, a, b, text[a:b]))
        return _rows(out)

    return map_batches(_long(excerpts, bundles, configs), fn, _PIECES.simpleString()[7:-1].replace(":", " "))


def oversized(excerpts: DataFrame, bundles: DataFrame, configs: DataFrame) -> DataFrame:
    """``(item_kind, item_id)``: the items that ``cut`` divides, excerpts and bundles, and as ``run``
    the divided excerpts in whose token offsets one token alone exceeds the limit."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, keys = [], []
        for key, text, limit, overlap in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if len(split_text(text, limit, overlap)) > 1:
                kinds.append("excerpt")
                keys.append(key)
                if longest_run(text) > limit:
                    kinds.append("run")
                    keys.append(key)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.int64())], ["item_kind", "item_id"])

    items = map_batches(_long(excerpts, bundles, configs), fn, "item_kind string, item_id bigint")
    whole = bundle_pieces(excerpts, bundles, configs, brief=True).groupBy("item_kind", "item_id").agg(F.sum("pieces").alias("pieces")).where("pieces > 1").drop("pieces")
    return items.unionByName(whole)


def bundle_pieces(excerpts: DataFrame, bundles: DataFrame, configs: DataFrame, brief: bool = False) -> DataFrame:
    """Pieces of each bundle above its max_total_chars, as spans over the bundle's excerpts in order
    of id: one row for each piece and excerpt that it touches, offsets within the excerpt.

    The bundle is first divided at excerpt ends into segments of about ``SEGMENT`` limits (an
    excerpt's end is a natural boundary), so that no task holds more than that and one excerpt,
    however large the bundle. A later segment begins with the last characters of the excerpts before
    it, as many as the overlap asks for, so that the pieces on both sides of the seam share them.
    ``piece_no`` rises along the bundle, with gaps at the seams. ``brief``: ``(item_kind, item_id,
    segment, pieces)``, the number of pieces of each segment.
    """
    slim = once(excerpts.select("excerpt_id", "bundle_id", "text").where(F.length("text") > 0), "excerpt_id")
    rows = with_limits(slim.select("excerpt_id", "bundle_id", F.length("text").cast("bigint").alias("n")), bundles, configs)
    whole = Window.partitionBy("bundle_id")
    run = whole.orderBy("excerpt_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"total": F.sum("n").over(whole), "before": F.sum("n").over(run) - F.col("n")}).where(F.col("total") > F.col("max_total_chars"))
    cell = SEGMENT * F.col("max_total_chars")
    rows = rows.withColumns({"segment": F.floor(F.col("before") / cell), "skip": F.lit(0).cast("bigint")})
    begins = rows.groupBy("bundle_id", "segment").agg(F.min("before").alias("begin"))
    # The excerpts that reach into the overlap before a segment's begin: it lies in the cell of their end or the next.
    end, step = F.col("before") + F.col("n"), F.greatest(F.lit(0), F.least("overlap_chars", F.col("max_total_chars") - 1))
    near = rows.withColumn("own", F.col("segment")).withColumn("segment", F.explode(F.sequence(F.floor(end / cell), F.floor((end + step) / cell))))
    tails = near.where("segment > own").join(begins, ["bundle_id", "segment"]).where((F.col("begin") >= end) & (F.col("begin") < end + step))
    tails = tails.withColumn("skip", F.greatest(F.lit(0), F.col("begin") - step - F.col("before"))).select(rows.columns)
    rows = rows.unionByName(tails).select("excerpt_id", "bundle_id", "segment", "skip", "max_total_chars", "overlap_chars").join(slim.select("excerpt_id", "text"), "excerpt_id")
    rows = rows.withColumn("text", F.when(F.col("skip") > 0, F.expr("substring(text, cast(skip as int) + 1)")).otherwise(F.col("text")))

    def fn(table: pa.Table) -> pa.Table:
        table = table.sort_by("excerpt_id")
        ids, texts, skips = (table.column(c).to_pylist() for c in ("excerpt_id", "text", "skip"))
        bundle, segment = table.column("bundle_id")[0].as_py(), table.column("segment")[0].as_py()
        limit, overlap = table.column("max_total_chars")[0].as_py(), table.column("overlap_chars")[0].as_py()
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        kinds = [starts[1:-1], *(np.concatenate(x) for x in zip(*([k + s for k in boundaries(t)] for t, s in zip(texts, starts, strict=False)), strict=True))]
        out, spans = [], cut(int(starts[-1]), kinds, limit, overlap)
        if brief:
            return pa.table({"item_kind": ["bundle"], "item_id": pa.array([bundle], pa.int64()), "segment": pa.array([segment], pa.int64()), "pieces": pa.array([len(spans)], pa.int64())})
        for no, (a, b) in enumerate(spans):
            for i in range(int(np.searchsorted(starts, a, "right")) - 1, len(ids)):
                if starts[i] >= b:
                    break
                lo, hi = max(0, a - int(starts[i])), min(len(texts[i]), b - int(starts[i]))
                if hi > lo:
                    out.append(("bundle", bundle, segment * SEGMENT_PIECES + no, ids[i], skips[i] + lo, skips[i] + hi, texts[i][lo:hi]))
        return _rows(out)

    return rows.groupBy("bundle_id", "segment").applyInArrow(fn, "item_kind string, item_id bigint, segment bigint, pieces bigint" if brief else _PIECES)


def _rows(rows: list[tuple]) -> pa.Table:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=_PIECES.names)
