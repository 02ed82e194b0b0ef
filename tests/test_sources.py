import json

from pyspark.sql import functions as F

from marlstone.sources import readers
from marlstone.streaming import ingest

DOC = "---\nname: a\ndescription: reads: files\n---\n\n# Use\n\nText one\ntext two\n\n- item a\n- item b\n\n```sh\nls\n```\n\n## Deep\n\n| a | b |\nSee [x](docs/x.md), `src/y.py` and [x](docs/x.md).\n"


def test_package_scan(spark, tmp_path):
    for name in ("SKILL.md", "src/a.PY", ".git/x", "node_modules/m.js", "src/__pycache__/a.pyc", "b.mjs"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    got = {r.path: (r.kind, r.size_bytes, r.text) for r in readers.scan_package(spark, str(tmp_path), content=True).collect()}
    assert got == {"SKILL.md": ("markdown", 1, "x"), "src/a.PY": ("python", 1, "x"), "b.mjs": ("javascript", 1, "x")}


def test_markdown(spark):
    df = spark.createDataFrame([(1, DOC), (2, None), (3, "")], "doc bigint, text string")
    blocks = readers.markdown_blocks(df, "doc", "text").orderBy("block_no").collect()
    assert [(b.kind, b.heading) for b in blocks] == [("frontmatter", ""), ("heading", "Use"), ("paragraph", "Use"), ("item", "Use"), ("item", "Use"), ("code", "Use"), ("heading", "Use > Deep"), ("table", "Use > Deep"), ("paragraph", "Use > Deep")]
    assert all(b.content in DOC for b in blocks)
    fields = df.where("doc = 1").select(readers.frontmatter_fields(F.col("text")).alias("m")).first().m
    assert fields == {"name": "a", "description": "reads: files"}
    assert [(r.seq, r.target) for r in readers.references(df, "doc", "text").collect()] == [(0, "src/y.py"), (1, "docs/x.md")]


def test_front_matter_values_continue_on_indented_lines(spark):
    text = "---\nname: a\ndescription: >-\n  reads files\n  and folders\nmore: b\n---\n"
    df = spark.createDataFrame([(text,), (None,), ("no front",)], "text string")
    assert [r.m for r in df.select(readers.frontmatter_fields(F.col("text")).alias("m")).collect()] == [{"name": "a", "description": "reads files and folders", "more": "b"}, None, None]


def test_reports_and_records(spark, tmp_path):
    result = {"ruleId": "r", "level": "error", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 3}}}]}
    (tmp_path / "s.sarif").write_text(json.dumps({"runs": [{"results": [result, {"ruleId": "q"}]}, {"results": []}]}))
    rows = readers.sarif_results(spark, str(tmp_path / "s.sarif")).collect()
    assert [(r.rule, r.path, r.line) for r in rows] == [("r", "a.py", 3), ("q", None, 0)]
    df = spark.createDataFrame([("s1", 1), ("s2", 2)], "skill_id string, n int")
    readers.write_lines(df, str(tmp_path / "lines"))
    assert {r.n for r in readers.records(spark, str(tmp_path / "lines"), "skill_id string, n int").collect()} == {1, 2}
    readers.write_artifacts(df, str(tmp_path / "parts"))
    assert {r.skill_id for r in spark.read.parquet(str(tmp_path / "parts")).collect()} == {"s1", "s2"}
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.json").write_text('{"findings": [{"severity": "LOW"}]}')
    (tmp_path / "v/b.json").write_text("no json")
    severity = readers.payloads(spark, str(tmp_path / "v")).select(F.expr("try_variant_get(payload, '$.findings[0].severity', 'string')").alias("s")).collect()
    assert {r.s for r in severity} == {"LOW", None}
    assert [r.skill_id for r in readers.missing_artifacts(df, df.where("n = 1"), ["skill_id"]).collect()] == ["s2"]
    assert readers.graph_wire(df, df.limit(0)).count() == 2


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2025-01-01 00:10:00", "a"), (1, "2025-01-01 00:20:00", "a"), (2, "2025-01-01 02:00:00", "b")], "obs_id bigint, at string, event_type string").withColumn("loaded_at", F.to_timestamp("at")).withColumn("ts", F.col("loaded_at"))
    rows.write.parquet(str(tmp_path / "in"))

    def run(transform, name, mode):
        stream = transform(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.obs_id for r in run(ingest.deduplicated, "seen", "append")) == [1, 2]
    assert sorted((r.kind, r.rows) for r in run(ingest.windowed_counts, "counts", "complete")) == [("a", 2), ("b", 1)]
