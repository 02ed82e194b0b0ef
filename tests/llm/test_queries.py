from marlstone.llm import queries

LONG = "the loader reads the open files quietly and writes them again " * 3


def _tables(monkeypatch, spark, **tables):
    monkeypatch.setattr(queries, "table", lambda spark, d, name: tables[name])


def test_label_skills_of_every_group_come_out(spark, monkeypatch):
    _tables(
        monkeypatch, spark,
        source_excerpts=spark.createDataFrame([(1, 1, "doc", LONG), (1, 1, "doc", LONG), (2, 2, "doc", LONG + " x"), (3, 3, "doc", "another text that is alone in here"), (4, 4, "doc", LONG.replace("loader", "parser").upper()[::-1]), (5, 5, "doc", LONG.replace("loader", "parser").upper()[::-1])], "excerpt_id bigint, bundle_id bigint, kind string, text string"),
        source_bundles=spark.createDataFrame([(i, f"h{i}") for i in (1, 1, 2, 3, 4, 5)], "bundle_id bigint, source_hash string"),
        gold_labels=spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "b"), ("h3", "c"), ("h5", "d"), ("h9", "e")], "source_hash string, skill_id string"),
    )
    got = {(r.class_id, r.labelled_skill, r.excerpts, r.sources) for r in queries.p6_label_skills(spark, "").collect()}
    assert got == {(1, "a", 1, 1), (1, "b", 1, 1), (4, "d", 1, 1)}


def test_invalid_files_come_from_their_edit_cost(spark, monkeypatch):
    _tables(monkeypatch, spark, source_excerpts=spark.createDataFrame([(1, "s", "a.py", "code", "x = (a b)\n"), (2, "s", "b.sh", "code", "if x; then\n"), (3, "s", "c.ts", "code", "let x: = 1;\n"), (4, "s", "d.js", "code", "f();\n")], "file_key bigint, skill_id string, path string, kind string, text string"))
    found = queries.p2_found(spark, "")
    assert "(edits#" in found._jdf.queryExecution().optimizedPlan().toString()  # rows are chosen by their cost
    costs = {r.file_key: r.edits for r in queries.p2_files(spark, "").collect()}
    assert {r.file_key for r in found.collect()} == set(costs) == {1, 2, 3} and costs[1] == costs[3] == 1
