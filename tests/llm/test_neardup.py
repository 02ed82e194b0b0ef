import random

import numpy as np
import pytest

from marlstone.llm import neardup


def _texts(seed=1, families=12, size=6):
    rng, out = random.Random(seed), []
    words = [f"w{i:03d}" for i in range(400)]
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(20, 160))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def _brute(texts):
    sets = [set(t.lower()[i : i + 9] for i in range(len(t) - 8)) for t in (" ".join(x.split()) for x in texts)]
    found = {}
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if sets[i] and sets[j]:
                s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if s >= 0.65:
                    found[i, j] = s
    return found


def test_pairs_are_those_of_brute_force(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t.upper() if i % 3 else t.replace(" ", " \n"), "x") for i, t in enumerate(texts)] + [(0, texts[0].replace(" ", " \n"), "x")], "id bigint, text string, rep string").withColumnRenamed("id", "key")
    got = {(r.a, r.b): r.similarity for r in neardup.near_pairs(df, "key", "text").collect()}
    want = _brute(texts)
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_hot_pages_are_divided_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    texts = _texts(2, 4, 14)
    df = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string")
    assert {(r.a, r.b) for r in neardup.near_pairs(df, "key", "text").select("a", "b").collect()} == set(_brute(texts))


def test_the_tree_finds_every_pair_that_the_bound_admits():
    rng = np.random.default_rng(4)
    points = rng.integers(0, 30, (300, 8))
    tree = neardup.CountTree(points)
    for q in points[:40]:
        low, n, sizes = np.minimum(points, q).sum(1), q.sum(), points.sum(1)
        ok = (low >= 0.65 / 1.65 * (n + sizes)) & (sizes <= n / 0.65) & (sizes >= n * 0.65)
        assert set(np.flatnonzero(ok)) <= set(tree.near(q, 0.65))


def test_copies_nulls_and_short_texts(spark):
    long = "the loader reads the open files quietly and writes them again " * 3
    df = spark.createDataFrame([(1, long), (2, long.upper()), (3, long + " x"), (4, None), (5, ""), (6, "abc"), (7, "abc"), (8, "another text that is alone in here")], "key bigint, text string")
    assert {(r.a, r.b) for r in neardup.near_pairs(df, "key", "text").collect()} == {(1, 2), (1, 3), (2, 3)}
    groups = {r.id: (r.class_id, r.links) for r in neardup.groups(df, "key", "text").collect()}
    assert groups == {1: (1, 1), 2: (1, 1), 3: (1, 1), 8: (8, 0)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "key bigint, text string")
    assert neardup.near_pairs(df, "key", "text").collect() == neardup.groups(df, "key", "text").collect() == []


def test_a_tree_of_several_levels_leaves_out_what_cannot_reach(spark):
    rng = np.random.default_rng(5)
    points = rng.integers(0, 400, (3000, 1)) * rng.integers(0, 2, (3000, 8))
    tree = neardup.CountTree(points)
    assert len(tree.levels) == 3 and len(tree.levels[-1][1]) == 1
    asked = [len(tree.near(q, 0.65)) for q in points[:50]]
    assert sum(asked) < 0.5 * 50 * len(points)


def test_counts_above_two_bytes_keep_the_bound():
    point = np.array([[70_000] * 8, [70_000] * 7 + [1]])
    assert list(zip(*neardup.page_pairs(np.array([1, 2]), point))) == [(1, 2)]
