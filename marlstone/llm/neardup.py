"""Near-duplicate texts: all pairs whose sets of character 9-grams reach a Jaccard similarity.

Method: the 9-grams of a text are hashed into groups; the group counts are a point, and the summed
coordinate minima of two points bound the overlap of their texts from above. Count vectors of many
groups concentrate, so one global tree over them prunes little; the points are therefore first placed
in overlapping pages by bands of minimum hashes, each page holds a packed R-tree over its points'
coarse counts, and pairs that survive in two pages or more are verified: by the bound over fine
groups, then exactly. The banding misses a pair at the threshold with a probability below 0.001, and
far less above it (``BANDS``, ``ROWS``); the tree, the bound and the verification miss none.

Exact copies (equal after normalisation) are one point; their pairs are added at the end. Null texts
and texts below nine characters have no 9-grams and no partner. A page that holds more than
``BLOCK`` points is divided into blocks whose pairs are separate tasks, so nothing is dropped and no
group is collected whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, shared_dir
from .base import map_batches, written

GRAM, SIMILARITY = 9, 0.65
#: Bands of minimum hashes and hashes in each; pages in which a pair must meet.
BANDS, ROWS, MEETINGS = 130, 6, 2
#: Groups of the coarse counts in the pages and of the fine counts before exact verification.
COARSE, FINE = 8, 1024
#: Points of a page that one task holds, and entries of a node of the tree.
BLOCK, LEAF = 8192, 16
#: Texts with fewer 9-grams use one exact minimum for each hash, longer ones minima of bins; the
#: overlap of the two ranges covers every pair that can reach the similarity.
_SMALL, _BOTH = 256, 400
_BINS = 60
_ODD = (np.random.default_rng(20240229).integers(1, 1 << 62, BANDS * ROWS, dtype="uint64") << np.uint64(1)) | np.uint64(1)


def normal(text: Column) -> Column:
    """Lower case, each run of space, tab, CR and LF one space."""
    return F.regexp_replace(F.lower(text), "[ \\t\\r\\n]+", " ")


def grams(text: str) -> np.ndarray:
    """Distinct hashes of a normalised text's 9-grams, sorted."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32").astype("uint64")
    n = len(codes) - GRAM + 1
    if n < 1:
        return np.zeros(0, "uint64")
    h = np.zeros(n, "uint64")
    for k in range(GRAM):
        h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def counts(hashes: np.ndarray, groups: int) -> np.ndarray:
    """The point of a text: how many of its hashes fall in each group."""
    return np.bincount((hashes >> np.uint64(40)).astype("int64") % groups, minlength=groups)


def _bands(values: np.ndarray, level: int) -> np.ndarray:
    v = values.reshape(BANDS, ROWS)
    h = np.full(BANDS, 1469598103934665603 + level, "uint64") + np.arange(BANDS, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        h = (h ^ v[:, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
    return h.view("int64")


def pages(hashes: np.ndarray) -> list[np.ndarray]:
    """Page keys of a text, for one or both of the levels that its size belongs to."""
    out = []
    if len(hashes) < _BOTH:
        out.append(_bands(np.array([(hashes * a).min() for a in _ODD]), 0))
    if len(hashes) >= _SMALL:
        minima = []
        for a in _ODD[: BANDS * ROWS // _BINS]:
            h = hashes * a
            h ^= h >> np.uint64(32)
            keyed = np.sort((h % np.uint64(_BINS) << np.uint64(57)) | (h >> np.uint64(7)))
            at = np.searchsorted(keyed, np.arange(_BINS, dtype="uint64") << np.uint64(57))
            # An empty bin takes the next bin's first value, which differs from that bin's own key.
            minima.append(keyed[at % len(keyed)] + np.arange(_BINS, dtype="uint64"))
        out.append(_bands(np.concatenate(minima), 1))
    return out


class CountTree:
    """A packed R-tree over count vectors. Points are sorted by size and largest group and packed
    ``LEAF`` to a node, nodes again, up to one root; a node knows the largest count of each group
    and the range of sizes below it."""

    def __init__(self, points: np.ndarray):
        self.order = np.lexsort((points.argmax(1), points.sum(1)))
        self.points = points[self.order]
        self.size = self.points.sum(1)
        high, small, large = self.points, self.size, self.size
        self.levels = []  # from the leaves' parents to the root
        while len(high) > 1 or not self.levels:
            cuts = np.arange(0, len(high), LEAF)
            high, small, large = np.maximum.reduceat(high, cuts, axis=0), np.minimum.reduceat(small, cuts), np.maximum.reduceat(large, cuts)
            self.levels.append((high, small, large))

    def near(self, point: np.ndarray, similarity: float) -> np.ndarray:
        """Indices of the points whose overlap with ``point`` may reach the similarity: summed minima
        bound the overlap, and a node is left as soon as its box cannot reach it."""
        n = point.sum()
        need = similarity / (1 + similarity)
        held = np.zeros(1, "int64")
        for i in range(len(self.levels) - 1, -1, -1):
            high, small, large = (x[held] for x in self.levels[i])
            ok = (small <= n / similarity) & (large >= n * similarity) & (np.minimum(high, point).sum(1) >= need * (n + small))
            below = len(self.levels[i - 1][1]) if i else len(self.points)
            held = (held[ok][:, None] * LEAF + np.arange(LEAF)).ravel()
            held = held[held < below]
        held = held[np.minimum(self.points[held], point).sum(1) >= need * (n + self.size[held])]
        return self.order[held]


def page_pairs(ids: np.ndarray, points: np.ndarray, side: np.ndarray | None = None, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one page whose bound reaches the similarity; with ``side``, pairs across the sides."""
    if len(ids) == 2:
        low = np.minimum(points[0], points[1]).sum()
        ok = low * (1 + similarity) >= similarity * points.sum() and (side is None or side[0] != side[1])
        pair = np.sort(ids)
        return (pair[:1], pair[1:]) if ok else (ids[:0], ids[:0])
    left, right = [], []
    if side is None:
        tree, queries = CountTree(points), np.arange(len(ids))
        held = ids
    else:
        inner = np.flatnonzero(side == 1)
        if not len(inner) or len(inner) == len(ids):
            return ids[:0], ids[:0]
        tree, queries, held = CountTree(points[inner]), np.flatnonzero(side == 0), ids[inner]
    for q in queries:
        other = held[tree.near(points[q], similarity)]
        if side is None:
            other = other[other > ids[q]]
        left.append(np.full(len(other), ids[q]))
        right.append(other)
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


def placed(reps: DataFrame) -> DataFrame:
    """``(page, id, point)`` of each text, from ``(id, text)`` with normalised texts."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keys, owners, blobs = [], [], []
        for i, t in zip(ids, texts, strict=True):
            h = grams(t)
            if not len(h):
                continue
            blob = counts(h, COARSE).astype("<u4").tobytes()
            for k in pages(h):
                keys.append(k)
                owners += [i] * len(k)
                blobs += [blob] * len(k)
        flat = np.concatenate(keys) if keys else np.zeros(0, "int64")
        return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(owners, pa.int64()), pa.array(blobs, pa.binary())], ["page", "id", "point"])

    return map_batches(reps.select("id", "text"), fn, "page bigint, id bigint, point binary")


def _pairs_of(rows: DataFrame) -> DataFrame:
    """Surviving pairs of each page; rows are streamed page by page in the order of the key."""
    parts = rows.repartition("page", "block").sortWithinPartitions("page", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            keys = table.column("page").to_numpy() ^ (table.column("block").to_numpy() * np.int64(0x1F3D5B79))
            ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
            points = np.frombuffer(b"".join(table.column("point").to_pylist()), "<u4").reshape(-1, COARSE).astype("int64")
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            left, right = [], []
            for a, b in zip(edges, edges[1:], strict=False):
                if b - a > 1:
                    two = bool(side[a:b].any())
                    x, y = page_pairs(ids[a:b], points[a:b], side[a:b] if two else None)
                    left.append(x)
                    right.append(y)
            flat = [np.concatenate(v) if v else np.zeros(0, "int64") for v in (left, right)]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in flat], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            table = pa.Table.from_batches(kept)
            keys, blocks = table.column("page").to_numpy(), table.column("block").to_numpy()
            open_at = int(np.argmax((keys == keys[-1]) & (blocks == blocks[-1])))
            if open_at:
                yield flush(table.slice(0, open_at))
                kept = table.slice(open_at).combine_chunks().to_batches()
        if kept:
            yield flush(pa.Table.from_batches(kept))

    return parts.mapInArrow(run, "a bigint, b bigint")


def similar_reps(reps: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(a, b, similarity)`` of distinct normalised texts ``(id, text)``, a < b."""
    shared_dir(reps.sparkSession)
    rows = written(placed(reps), "pages")
    hot = written(rows.groupBy("page").count().where(F.col("count") > BLOCK).select("page", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot")
    cold, hot_pages = rows, hot.count()
    parts = None
    if hot_pages:
        hot = F.broadcast(hot) if hot_pages <= 100_000 else hot
        cold = rows.join(hot, "page", "left_anti")
        split = rows.join(hot, "page").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        parts = split.select("page", "id", "point", (1 + low.cast("bigint") * F.col("blocks") + high).alias("block"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    cold = cold.withColumns({"block": F.lit(0).cast("bigint"), "side": F.lit(0)})
    met = _pairs_of(cold if parts is None else cold.unionByName(parts)).groupBy("a", "b").count().where(F.col("count") >= MEETINGS)
    texts = reps.select("id", "text")
    both = met.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, list, list] = ([], [], [])
        seen: dict[int, np.ndarray] = {}
        for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if a not in seen:
                seen[a] = grams(x)
            if b not in seen:
                seen[b] = grams(y)
            g, h = seen[a], seen[b]
            need = similarity * (len(g) + len(h)) / (1 + similarity)
            if np.minimum(counts(g, FINE), counts(h, FINE)).sum() < need:
                continue
            both_ = len(np.intersect1d(g, h, assume_unique=True))
            share = both_ / (len(g) + len(h) - both_)
            if share >= similarity:
                for column, value in zip(out, (a, b, share), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["a", "b", "similarity"])

    return map_batches(both.select("a", "b", "ta", "tb"), verify, "a bigint, b bigint, similarity double")


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, rep, text)``: each row once, with the least id among its exact copies after
    normalisation; texts without 9-grams are left out."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), normal(F.col(text)).alias("text")).where(F.length("text") >= GRAM).dropDuplicates(["id"])
    hashed = rows.withColumn("digest", F.sha2("text", 256))
    least = hashed.groupBy("digest").agg(F.min("id").alias("rep"))
    return hashed.join(least, "digest").select("id", "rep", "text")


def near_pairs(df: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """``(a, b, similarity)``: all pairs of rows, exact copies too."""
    rows = classes(df, key, text)
    reps = rows.where("id = rep").select("id", "text")
    members = rows.select("id", "rep")
    found = similar_reps(reps, similarity)
    left, right = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = found.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    twins = members.select(F.col("rep"), F.col("id").alias("a")).join(members.select("rep", F.col("id").alias("b")), "rep").where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return across.unionByName(twins)


def groups(df: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """``(id, class_id, links)``: each row with 9-grams, the least id of its group of near-duplicates
    and the number of other representatives it is linked with; copies are not expanded."""
    rows = classes(df, key, text)
    found = similar_reps(rows.where("id = rep").select("id", "text"), similarity).select("a", "b").checkpoint()
    degree = found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    roots = components(found.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "rep")
    return rows.select("id", "rep").join(roots, "rep", "left").join(degree, "rep", "left").select("id", F.coalesce("root", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
