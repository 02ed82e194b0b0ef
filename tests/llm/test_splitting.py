import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import splitting


@settings(max_examples=300, deadline=None)
@given(st.text("ab .\n。", max_size=200), st.integers(1, 40), st.integers(0, 50))
def test_pieces_cover_within_the_limit_and_overlap(text, limit, overlap):
    spans = splitting.split_text(text, limit, overlap)
    step = max(0, min(overlap, limit - 1))
    assert "".join(text[a if i == 0 else spans[i - 1][1] : b] for i, (a, b) in enumerate(spans)) == text
    assert all(0 < b - a <= limit for a, b in spans)
    assert all(spans[i][1] - spans[i + 1][0] == step for i in range(len(spans) - 1))


def test_prefers_the_strongest_boundary():
    text = "word " * 10 + "\n\n" + "word " * 10
    assert splitting.split_text(text, 60, 0)[0] == (0, 52)
    assert splitting.split_text("x" * 25, 10, 2) == [(0, 10), (8, 18), (16, 25)]
    assert splitting.split_text(None, 10, 0) == splitting.split_text("", 10, 0) == []


def _tables(spark):
    excerpts = spark.createDataFrame(
        [(1, 1, "a b " * 10, "n"), (1, 1, "a b " * 10, "n"), (2, 1, "x" * 30, "n"), (3, 1, None, "n"), (4, 1, "", "n"), (5, 2, "y " * 12, "n"), (6, 9, "z" * 99, "n"), (7, None, "q" * 99, "n")],
        "excerpt_id bigint, bundle_id bigint, text string, n string",
    )
    bundles = spark.createDataFrame([(1, "v1", 5), (1, "v1", 5), (2, "v1", 5), (3, None, 5)], "bundle_id bigint, prompt_version string, max_file_chars int")
    configs = spark.createDataFrame([("v1", 25, 60, 4)], "prompt_version string, max_file_chars int, max_total_chars int, overlap_chars int")
    return excerpts, bundles, configs


def test_oversized_items(spark):
    got = sorted((r.item_kind, r.item_id) for r in splitting.oversized(*_tables(spark)).collect())
    assert got == [("bundle", 1), ("excerpt", 1), ("excerpt", 2), ("run", 2)]


def test_pieces_of_excerpts_and_bundles(spark):
    excerpts, bundles, configs = _tables(spark)
    rows = sorted(splitting.excerpt_pieces(excerpts, bundles, configs).collect(), key=lambda r: (r.item_id, r.piece_no))
    assert {r.item_id for r in rows} == {1, 2} and all(len(r.piece) <= 25 and len(r.piece) == r.to_char - r.from_char for r in rows)
    parts = sorted(splitting.bundle_pieces(excerpts, bundles, configs).collect(), key=lambda r: (r.piece_no, r.excerpt_id))
    sizes = {}
    for r in parts:
        sizes[r.piece_no] = sizes.get(r.piece_no, 0) + len(r.piece)
    assert {r.item_id for r in parts} == {1} and max(sizes.values()) <= 60 and sum(sizes.values()) == 70 + 4 * (len(sizes) - 1)


def test_empty_tables(spark):
    tables = [t.limit(0) for t in _tables(spark)]
    assert splitting.oversized(*tables).collect() == splitting.excerpt_pieces(*tables).collect() == splitting.bundle_pieces(*tables).collect() == []


@pytest.mark.parametrize("sizes", [[25] * 40, [90, 2, 1, 3, 400, 1, 90, 2, 2, 2, 80]])
@pytest.mark.parametrize("overlap", [0, 4, 9, 50])
def test_pieces_overlap_across_segments(spark, monkeypatch, sizes, overlap):
    if len(set(sizes)) > 1:
        monkeypatch.setattr(splitting, "SEGMENT", 2)
    rng = random.Random(3)
    texts = {i: "".join(rng.choice("abc  .") for _ in range(n)) for i, n in enumerate(sizes)}
    excerpts = spark.createDataFrame([(i, 1, x) for i, x in texts.items()], "excerpt_id bigint, bundle_id bigint, text string")
    bundles = spark.createDataFrame([(1, "v1")], "bundle_id bigint, prompt_version string")
    configs = spark.createDataFrame([("v1", 99, 10, overlap)], "prompt_version string, max_file_chars int, max_total_chars int, overlap_chars int")
    before, starts = 0, {}
    for i, x in texts.items():
        starts[i], before = before, before + len(x)
    rows = splitting.bundle_pieces(excerpts, bundles, configs).collect()
    assert before > splitting.SEGMENT * 10 and len({r.piece_no // splitting.SEGMENT_PIECES for r in rows}) > 1 and all(r.piece == texts[r.excerpt_id][r.from_char : r.to_char] for r in rows)
    spans = {}
    for r in rows:
        spans.setdefault(r.piece_no, []).append((starts[r.excerpt_id] + r.from_char, starts[r.excerpt_id] + r.to_char))
    pieces = [sorted(spans[no]) for no in sorted(spans)]
    assert all(a[1] == b[0] for p in pieces for a, b in zip(p, p[1:]))
    whole = [(p[0][0], p[-1][1]) for p in pieces]
    assert whole[0][0] == 0 and whole[-1][1] == before and all(b - a <= 10 for a, b in whole)
    assert all(a[1] - b[0] == min(overlap, 9) for a, b in zip(whole, whole[1:]))
