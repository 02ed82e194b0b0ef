import random
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import packing


def _least(sizes, capacity):
    best = len(sizes)
    for places in product(range(len(sizes)), repeat=len(sizes)):
        fill = [0] * len(sizes)
        for s, p in zip(sizes, places):
            fill[p] += s
        if max(fill) <= capacity:
            best = min(best, len(set(places)))
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=5))
def test_bound_and_packing_enclose_the_optimum(sizes):
    sizes = np.array(sizes)
    bins = packing.best_fit(sizes, 10)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 10
    assert packing.lower_bound(sizes, 10) <= _least(sizes, 10) <= len(np.unique(bins))


def test_everything_is_packed_within_capacity(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(0, 90, 600))] + [(1000, 250), (1001, 0), (1001, 0), (1002, 100)]
    limits = spark.createDataFrame([(1, 100, 7), (2, 64, 7)], "pack_id int, capacity_tokens int, tokens int")
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, tokens bigint"), limits, partition=100)
    got = out.collect()
    sizes = dict(rows)
    for pack, capacity in ((1, 100), (2, 64)):
        held, docs, pieces = {}, {}, {}
        for r in got:
            if r.pack_id == pack:
                held[r.container] = held.get(r.container, 0) + r.tokens
                docs[r.doc_id] = docs.get(r.doc_id, 0) + r.tokens
                pieces[r.doc_id] = pieces.get(r.doc_id, 0) + 1
        assert max(held.values()) <= capacity and docs == sizes
        assert all(n == 1 for d, n in pieces.items() if sizes[d] <= capacity)
        assert len([1 for n in held.values() if n]) <= 1.06 * -(-sum(sizes.values()) // capacity) + 2
    q = {r.pack_id: r for r in packing.quality(out, limits).collect()}
    assert q[1].documents == len(sizes)


def test_empty_table(spark):
    limits = spark.createDataFrame([(1, 100)], "pack_id int, capacity_tokens int")
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), limits).collect() == []


def test_used_tokens_are_what_a_container_holds(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, rng.choice([0, 0, rng.randint(20, 70), 300])) for i in range(900)], "doc_id bigint, tokens bigint")
    limits = spark.createDataFrame([(0, 100), (1, 256)], "pack_id int, capacity_tokens int")
    packed = packing.pack(docs, limits, partition=60).cache()
    held = {}
    for r in packed.collect():
        held.setdefault((r.pack_id, r.container, r.used_tokens), []).append(r.tokens)
    assert all(sum(v) == used for (_, _, used), v in held.items()) and len({k[:2] for k in held}) == len(held)
    assert packed.select("pack_id", "doc_id").distinct().count() == 1800
    for r in packing.quality(packed, limits).collect():
        assert r.least <= r.containers and r.documents == 900


def test_bound_over_counted_sizes():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 90, 200)
    kinds, times = np.unique(sizes, return_counts=True)
    assert packing.lower_bound(kinds, 100, times) == packing.lower_bound(sizes, 100)
