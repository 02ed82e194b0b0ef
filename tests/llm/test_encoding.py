import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import encoding

tiktoken = pytest.importorskip("tiktoken")
ENCODER = encoding.encoder()
REFERENCE = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in (line.split() for line in open(encoding.VOCABULARY, "rb"))}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_same_as_the_public_encoder(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", "a" * 5000, " \n\t" * 500, "字" * 3000, "<|endoftext|>", "don't  stop\r\n", "ﬁ👩‍👩‍👧 e\u0301"])
def test_long_and_odd_texts(text):
    assert ENCODER.encode(text) == (REFERENCE.encode_ordinary(text) if text else [])
    assert ENCODER.count(text) == len(ENCODER.encode(text))


def test_appending_extends_the_prefix_array():
    data = "unbelievably".encode()
    last = ENCODER.extend(data[:5], [])
    assert ENCODER.read(ENCODER.extend(data, last)) == ENCODER.read(ENCODER.extend(data, []))


@settings(max_examples=300, deadline=None)
@given(st.text("ab '1.\n字s", max_size=40), st.integers(0, 40), st.integers(0, 10), st.text("ab '1.\n字s", max_size=6))
def test_edit_gives_the_ids_of_the_new_text(text, at, removed, added):
    at = min(at, len(text))
    new = ENCODER.edit(ENCODER.start(text), at, min(removed, len(text) - at), added)
    assert new.text == text[:at] + added + text[at + removed :]
    assert new.flat() == REFERENCE.encode_ordinary(new.text) and new.ends == ENCODER.start(new.text).ends


def test_edit_encodes_only_near_the_edit(monkeypatch):
    old, asked = ENCODER.start("the scheduler runs many jobs " * 50), []
    monkeypatch.setattr(ENCODER, "pieces", type("P", (), {"__getitem__": lambda self, k: asked.append(k) or ENCODER._piece(k)})())
    new = ENCODER.edit(old, 700, 3, "loader")
    assert new.flat() == REFERENCE.encode_ordinary(new.text) and len(asked) < 8


def test_null_empty_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hi", "x"), (3, "hi", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encoding.token_ids(rows).collect())
    assert got == [(1, []), (2, []), (3, REFERENCE.encode_ordinary("hi")), (3, REFERENCE.encode_ordinary("hi"))]
    assert encoding.token_ids(rows.limit(0)).collect() == []
