import random

from marlstone.llm import truncation


def _docs(spark):
    rng, rows, i = random.Random(3), [], 0
    for source in ("note", None):
        for _ in range(400):
            sentence = " ".join(rng.choice(["the", "loader", "reads", "many", "open", "files", "quietly"]) for _ in range(rng.randint(3, 60))).capitalize() + "."
            text = sentence[:120] if source else sentence
            rows.append((i, text, source, 0))
            i += 1
    extra = ["", None, "   ", "n/a", "- hallan\n- brimir", "All is done.\n\n-- Veryar", "It works. ✅", "See:\n```sh\nls", "```sh\nls\n```", "Ends in the midd", "Cut \ufffd", "And so on…", "See https://a.example/b", "Done.\n<!-- end -->"]
    rows += [(1000 + k, text, "other", 0) for k, text in enumerate(extra)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n int"), extra


def test_limits_and_endings(spark):
    docs, extra = _docs(spark)
    rows = {r.doc_id: r for r in truncation.truncated(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    cut = {i for i, t in texts.items() if i < 400 and len(t) == 120 and not t.endswith(".")}
    assert cut <= set(rows) and all(rows[i].at_limit for i in cut)
    assert not [i for i in rows if 400 <= i < 800]
    assert {extra[i - 1000] for i in rows if i >= 1000} == {"See:\n```sh\nls", "Ends in the midd", "Cut \ufffd"}


def test_an_unsure_ending_counts_only_at_a_limit(spark):
    docs, _ = _docs(spark)
    head = "Steady words of a note. " * 4 + "\n## " + "Usage of the load"
    more = spark.createDataFrame([(5000, head[:120].ljust(120, "s"), "note", 0), (5001, head[:105], "note", 0)], "doc_id bigint, text string, source string, n int")
    rows = {r.doc_id: r.at_limit for r in truncation.truncated(docs.unionByName(more)).collect()}
    assert rows.get(5000) is True and 5001 not in rows


def test_hazards_are_those_of_a_plain_count(spark):
    docs, _ = _docs(spark)
    rows = truncation.marked(docs).where("source = 'note'")
    lengths = [r.n for r in rows.collect()]
    for r in truncation.hazards(rows, neighbours=15).collect():
        reached = sum(n >= r.n for n in lengths)
        near = [m for m in range(max(1, r.n - 15), r.n + 16) if m != r.n]
        ends, risk = sum(n in near for n in lengths), sum(sum(n >= m for n in lengths) for m in near)
        assert (r.reached, r.ended) == (reached, lengths.count(r.n))
        assert abs(r.around - min(0.999, (ends + 1) / (risk + max(reached, 2)))) < 1e-12 and abs(r.hazard - r.ended / reached) < 1e-12
    assert [r.n for r in truncation.hazards(rows).where("significant").collect()] == [120]


def test_rates_name_every_source(spark):
    docs, _ = _docs(spark)
    rates = {r.source: r for r in truncation.source_rates(docs).collect()}
    assert set(rates) == {"note", None, "other"} and rates[None].cut == 0 and rates["other"].cut == 3 and rates["note"].at_limit == rates["note"].cut > 50


def test_empty_table(spark):
    docs = _docs(spark)[0].limit(0)
    assert truncation.truncated(docs).collect() == truncation.source_rates(docs).collect() == []
