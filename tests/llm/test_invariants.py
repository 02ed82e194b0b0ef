"""The queries over the test tables against what must hold of any right result."""

import os

import pytest
from pyspark.sql import functions as F

from marlstone.llm import queries as Q
from marlstone.llm import syntax

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _once(spark, name, key):
    return spark.read.parquet(f"{DATA}/{name}.parquet").dropDuplicates([key])


def test_passages_stand_where_they_say(spark):
    rows = Q.p1_prose(spark, DATA).where("tab = 'excerpt'").join(_once(spark, "source_excerpts", "excerpt_id").select(F.col("excerpt_id").alias("rec_id"), "text"), "rec_id").collect()
    assert rows and all(0 <= r.from_char < r.to_char <= len(r.text) and 0 < r.share <= 1 for r in rows)
    plain = [r for r in rows if r.to_char - r.from_char == r.chars]
    assert plain and all(r.passage == r.text[r.from_char : r.to_char] for r in plain if "\\" not in r.text[r.from_char : r.to_char] and "\n" not in r.text[r.from_char : r.to_char] and "$" not in r.text[r.from_char : r.to_char] and "\n" not in r.passage)
    shares = Q.p1_shares(spark, DATA).collect()
    assert all(0 <= r.mean_share <= 1 and r.files <= r.code_files for r in shares)


def test_syntax_queries_agree(spark):
    found = {r.file_key for r in Q.p2_found(spark, DATA).collect()}
    files = Q.p2_files(spark, DATA).collect()
    assert {r.file_key for r in files} == found and all(r.edits > 0 and r.cause in ("conflict", "truncation", "mismatch", "local") for r in files)
    assert sum(r.invalid for r in Q.p2_rates(spark, DATA).collect()) == len(found) == sum(r.files for r in Q.p2_labels(spark, DATA).collect())


def test_redaction_changes_the_credentials_only(spark):
    found = {}
    for r in Q.p3_found(spark, DATA).collect():
        found.setdefault((r.tab, r.rec_id), []).append(r.secret)
    texts = {("excerpt", r.excerpt_id): r.text for r in _once(spark, "source_excerpts", "excerpt_id").collect()} | {("observation", r.obs_id): r.source_text for r in _once(spark, "raw_observations", "obs_id").collect()} | {("spec", r.spec_id): r.spec for r in _once(spark, "skill_specs", "spec_id").collect()}
    rows = {(r.tab, r.rec_id): r for r in Q.p3_redacted(spark, DATA).collect()}
    assert set(rows) == set(found)
    for key, values in found.items():
        assert all(v in texts[key] and v not in rows[key].redacted for v in values if len(v) >= 8)
        kept, at = rows[key].redacted.split("REDACTED"), 0
        for part in kept:  # what stands between the marks stands in the text, in this order
            at = texts[key].index(part, at) + len(part)


def test_pieces_rebuild_every_item(spark):
    texts = {r.excerpt_id: r.text for r in _once(spark, "source_excerpts", "excerpt_id").collect()}
    limits = {r.prompt_version: r for r in spark.read.parquet(f"{DATA}/build_configs.parquet").collect()}
    bundles = {r.bundle_id: limits[r.prompt_version] for r in _once(spark, "source_bundles", "bundle_id").collect()}
    of = {r.excerpt_id: r.bundle_id for r in _once(spark, "source_excerpts", "excerpt_id").collect()}
    pieces = {}
    for r in Q.p5_pieces(spark, DATA).collect():
        assert r.piece == texts[r.excerpt_id][r.from_char : r.to_char]
        pieces.setdefault((r.item_kind, r.item_id), {}).setdefault(r.piece_no, []).append((r.excerpt_id, r.from_char, r.piece))
    found = {(r.item_kind, r.item_id) for r in Q.p5_found(spark, DATA).collect() if r.item_kind != "run"}
    assert set(pieces) == found
    for (kind, item), parts in pieces.items():
        config = bundles[of[item] if kind == "excerpt" else item]
        limit, overlap = (config.max_file_chars if kind == "excerpt" else config.max_total_chars), config.overlap_chars
        joined = ["".join(p for _, _, p in sorted(parts[no])) for no in sorted(parts)]
        assert all(len(p) <= limit for p in joined)
        step, whole = min(overlap, limit - 1), joined[0]
        for p in joined[1:]:
            assert whole[len(whole) - step :] == p[:step]
            whole += p[step:]
        assert whole == (texts[item] if kind == "excerpt" else "".join(texts[e] or "" for e in sorted(e for e, b in of.items() if b == item)))


def test_groups_are_the_components_of_the_pairs(spark):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in Q.p6_found(spark, DATA).collect():
        a, b = find(r.excerpt_a), find(r.excerpt_b)
        root[max(a, b)] = min(a, b)
    for r in Q.p6_groups(spark, DATA).collect():
        assert find(r.excerpt_id) == find(r.class_id)


def test_handwritten_and_found_share_all_code_files(spark):
    found = {r.file_key for r in Q.p4_found(spark, DATA).collect()}
    rest = {r.file_key for r in Q.p4_handwritten(spark, DATA).collect()}
    code = {r.file_key for r in spark.read.parquet(f"{DATA}/source_excerpts.parquet").where("kind = 'code' and text is not null").collect()}
    assert not found & rest and found | rest == code


def test_containers_hold_every_document_within_their_room(spark):
    room = {r.pack_id: r.capacity_tokens for r in spark.read.parquet(f"{DATA}/pack_limits.parquet").collect()}
    held, docs = {}, {}
    for r in Q.p8_containers(spark, DATA).collect():
        held.setdefault((r.pack_id, r.container, r.used_tokens), 0)
        held[r.pack_id, r.container, r.used_tokens] += r.tokens
        docs.setdefault(r.pack_id, set()).add(r.doc_id)
    assert all(used == total <= room[pack] for (pack, _, used), total in held.items())
    every = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert all(v == every for v in docs.values())
    for r in Q.p8_quality(spark, DATA).collect():
        assert r.least <= r.containers and r.documents == len(every) and 0 <= r.waste < 1


def test_rates_add_up_to_the_cut_documents(spark):
    rates = Q.p9_rates(spark, DATA).collect()
    assert sum(r.cut for r in rates) == Q.p9_found(spark, DATA).count() and all(r.at_limit <= r.cut <= r.docs for r in rates)


def test_edits_of_the_invalid_files_lie_within_them(spark):
    texts = {r.file_key: r.text for r in spark.read.parquet(f"{DATA}/source_excerpts.parquet").where("kind = 'code' and text is not null").collect()}
    for r in Q.p2_files(spark, DATA).collect():
        assert all(0 <= place <= len(texts[r.file_key]) for _, place in syntax.edits(texts[r.file_key], r.language))
