"""Filling containers of fixed capacity with documents.

Method: bound-certified repacking. Documents are dealt to partitions by a hash; each partition packs
its own by best-fit decreasing, and a dual-feasible-function lower bound on its number of containers
certifies the result or shows a gap. The documents of the containers with room left, of partitions
with a gap, are exchanged into fewer, larger partitions and packed anew; a repacking is kept where it
needs no more containers than before.

A document larger than the capacity fills whole containers and leaves one rest that is packed as an
item; no other is split. Null and empty texts have size 0 and go into the first container of their
partition. Every document comes out for every capacity, repeated keys count once.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import shared_dir
from .encoding import VOCABULARY, token_counts

#: Documents of a partition, and partitions whose open containers are exchanged together.
PARTITION, EXCHANGE = 20_000, 8
#: A container with more than this share of its capacity left is open to exchange.
OPEN = 0.02
#: Rounds of exchange.
ROUNDS = 2


def lower_bound(sizes: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """Containers that any packing needs: the best of the plain bound and of the dual feasible
    functions that round items above C - a up to C, those below a down to 0. ``times`` says how often
    each size occurs; without it each counts once."""
    sizes, times = np.asarray(sizes, "int64"), np.ones(len(sizes), "int64") if times is None else np.asarray(times, "int64")
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    sizes, times = sizes[order], times[order]
    if not len(sizes):
        return 0
    total, count = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes * times, times))
    best = -(-int(total[-1]) // capacity)
    for a in np.unique(sizes[sizes <= capacity // 2]):
        big, low = np.searchsorted(sizes, capacity - a, "right"), np.searchsorted(sizes, a, "left")
        weight = capacity * int(count[-1] - count[big]) + int(total[big] - total[low])
        best = max(best, -(-weight // capacity))
    half = int(times[sizes > capacity / 2].sum())
    for k in range(2, 13):  # the function that counts items in k-ths of the capacity
        scaled = np.where((k + 1) * sizes % capacity == 0, sizes * k, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((scaled * times).sum()) // (k * capacity)))
    return max(best, half)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item by best-fit decreasing; items of size 0 go into the first."""
    out = np.zeros(len(sizes), "int64")
    rooms: list[int] = []  # sorted room left, with the container that has it
    holders: dict[int, list[int]] = {}
    count = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        if size == 0:
            continue
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            bin_ = holders[room].pop()
            if not holders[room]:
                del holders[room]
                rooms.pop(at)
        else:
            room, bin_ = capacity, count
            count += 1
        out[i] = bin_
        left = room - size
        if left:
            if left not in holders:
                insort(rooms, left)
                holders[left] = []
            holders[left].append(bin_)
    return out


def _packed(frame: pd.DataFrame) -> pd.DataFrame:
    """One partition: container numbers, their fill, and whether the count meets the bound."""
    capacity = int(frame["capacity"].iloc[0])
    frame = frame.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    sizes = frame["tokens"].to_numpy("int64")
    bins = best_fit(sizes, capacity)
    used = len(np.unique(bins[sizes > 0])) if (sizes > 0).any() else 0
    fill = np.bincount(bins, weights=sizes)
    return frame.assign(bin=bins, fill=fill[bins].astype("int64"), used=used, bound=lower_bound(sizes, capacity))


_ITEM = "pack_id int, capacity int, doc_id bigint, piece int, tokens bigint, part bigint"
_PACKED = _ITEM + ", bin bigint, fill bigint, used bigint, bound bigint"


def _pack(items: DataFrame) -> DataFrame:
    return items.groupBy("pack_id", "part").applyInPandas(_packed, _PACKED)


def items_of(docs: DataFrame, limits: DataFrame, parts: int) -> DataFrame:
    """Whole documents, and the full containers and the rest of each that exceeds the capacity."""
    caps = limits.select("pack_id", F.col("capacity_tokens").cast("int").alias("capacity")).where("capacity > 0").dropDuplicates(["pack_id"]).collect()
    # A fixed handful of capacities: each document becomes one row for each.
    each = F.array(*(F.struct(F.lit(c.pack_id).cast("int").alias("pack_id"), F.lit(c.capacity).alias("capacity")) for c in caps))
    rows = docs.withColumn("cap", F.explode(each)).select("*", "cap.pack_id", "cap.capacity")
    full = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    rest = F.col("tokens") % F.col("capacity")
    pieces = F.when(F.col("tokens") <= F.col("capacity"), F.array(F.col("tokens"))).otherwise(
        F.concat(F.array_repeat(F.col("capacity").cast("bigint"), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    )
    rows = rows.select("pack_id", "capacity", "doc_id", F.posexplode(pieces).alias("piece", "tokens"))
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))


def pack(docs: DataFrame, limits: DataFrame, partition: int = PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """``(pack_id, doc_id, piece, tokens, container, used_tokens)`` from ``(doc_id, tokens)``. A
    container is named by its partition and number; used_tokens is what it holds."""
    shared_dir(docs.sparkSession)
    docs = docs.dropDuplicates(["doc_id"]).checkpoint()
    parts = max(1, -(-docs.count() // partition))
    done, now = None, _pack(items_of(docs, limits, parts)).checkpoint()
    base = 0
    for step in range(rounds):
        groups = max(1, parts // EXCHANGE ** (step + 1))
        # A container moves whole, items of size 0 with it, so that what a container holds stays true.
        slack = (F.col("used") > F.col("bound")) & (F.col("fill") < F.col("capacity") * (1 - OPEN))
        moved = now.where(slack).select("pack_id", "capacity", "doc_id", "piece", "tokens", F.pmod(F.col("part"), F.lit(groups)).alias("to"), "part", "bin")
        kept = now.where(~slack)
        done = kept if done is None else done.unionByName(kept)
        base += parts + 1
        before = moved.where("tokens > 0").groupBy("pack_id", "to").agg(F.countDistinct("part", "bin").alias("old"))
        again = _pack(moved.select("pack_id", "capacity", "doc_id", "piece", "tokens", F.col("to").alias("part"))).withColumn("part", F.col("part") + base).checkpoint()
        better = before.join(again.groupBy("pack_id", (F.col("part") - base).alias("to")).agg(F.max("used").alias("new")), ["pack_id", "to"]).where("new <= old").select("pack_id", "to")
        took = again.withColumn("to", F.col("part") - base).join(better, ["pack_id", "to"], "left_semi").select(now.columns)
        stay = now.where(slack).withColumn("to", F.pmod(F.col("part"), F.lit(groups))).join(better, ["pack_id", "to"], "left_anti").select(now.columns)
        done = done.unionByName(stay).checkpoint()
        now = took
        parts = groups
    rows = now if done is None else done.unionByName(now)
    name = F.concat_ws("-", F.col("part").cast("string"), F.col("bin").cast("string"))
    return rows.select("pack_id", "doc_id", "piece", "tokens", name.alias("container"), F.col("fill").alias("used_tokens"))


def pack_texts(documents: DataFrame, limits: DataFrame, path: str = VOCABULARY) -> DataFrame:
    return pack(token_counts(documents, "doc_id", "text", path), limits)


def quality(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """``(pack_id, documents, tokens, containers, least, waste)``: least is what the dual feasible
    functions certify for all items together, from the numbers of items of each size (as many rows as
    the capacity at most); waste is the share of the containers' room that stays empty."""
    per = packed.where("tokens > 0").groupBy("pack_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    docs = packed.groupBy("pack_id").agg(F.countDistinct("doc_id").alias("documents"))
    caps = limits.select("pack_id", "capacity_tokens").dropDuplicates(["pack_id"])
    sizes = packed.where("tokens > 0").groupBy("pack_id", "tokens").agg(F.count("*").alias("times")).join(F.broadcast(caps), "pack_id")

    def certify(frame: pd.DataFrame) -> pd.DataFrame:
        least = lower_bound(frame["tokens"].to_numpy(), int(frame["capacity_tokens"].iloc[0]), frame["times"].to_numpy())
        return pd.DataFrame({"pack_id": frame["pack_id"].iloc[:1], "least": [least]})

    least = sizes.groupBy("pack_id").applyInPandas(certify, "pack_id int, least bigint")
    rows = per.join(docs, "pack_id").join(F.broadcast(caps), "pack_id").join(least, "pack_id")
    return rows.select("pack_id", "documents", "tokens", "containers", "least", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("waste"))
