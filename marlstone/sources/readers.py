"""Readers of packages, documents, analyzer reports and record files, and the writers beside them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that a package scan leaves out, and kinds by suffix (fixed values).
SKIP = (".git", "__pycache__", "node_modules", ".venv", ".pytest_cache")
KINDS = {".md": "markdown", ".py": "python", ".js": "javascript", ".mjs": "javascript", ".ts": "typescript", ".sh": "bash", ".bash": "bash", ".json": "json"}
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")


def suffix_kind(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.coalesce(*(F.when(suffix == k, F.lit(v)) for k, v in KINDS.items()), F.lit("other"))


def scan_package(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """``(path, kind, size_bytes[, text])`` of the files below a folder, skipped folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    rows = files.withColumn("rel", rel).where(~F.exists(F.split("rel", "/"), lambda p: p.isin(*SKIP)) & ~F.col("rel").endswith(".pyc"))
    out = [F.col("rel").alias("path"), suffix_kind(F.col("rel")).alias("kind"), F.col("length").alias("size_bytes")]
    return rows.select(*out, *([F.decode("content", "UTF-8").alias("text")] if content else []))


def frontmatter(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n", 1), F.lit(""))


def frontmatter_fields(text: Column) -> Column:
    """Keys and values of the front matter as a map; indented lines continue the value before them."""
    folded = F.regexp_replace(F.regexp_replace(frontmatter(text), r":[ \t]*[>|][-+]?[ \t]*(?=\r?\n)", ":"), r"\r?\n[ \t]+", " ")
    lines = F.filter(F.split(folded, r"\r?\n"), lambda s: s.rlike(r"^[A-Za-z][\w-]*:"))
    return F.map_from_entries(F.array_distinct(F.transform(lines, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)), F.trim(F.regexp_replace(s, r"^[^:]*:", ""))))))


def blocks_of(text: str) -> Iterator[tuple[str, str, int, int, str]]:
    """``(kind, content, start, end, heading path)`` of a Markdown text's blocks."""
    at, stack, block, fence = 0, [], None, None
    lines = text.splitlines(keepends=True)

    def flush():
        nonlocal block
        if block:
            yield (*block, " > ".join(stack))
            block = None

    if text.startswith("---\n") and (end := text.find("\n---\n", 3)) >= 0:
        stop = end + 5
        yield "frontmatter", text[4 : end + 1], 0, stop, ""
    else:
        stop = 0
    for line in lines:
        start, at = at, at + len(line)
        if start < stop:
            continue
        bare = line.rstrip("\r\n")
        if fence is not None:
            block = ("code", block[1] + line, block[2], at)
            if bare.strip() == fence:
                fence = None
                yield from flush()
            continue
        if bare.lstrip().startswith(("```", "~~~")):
            yield from flush()
            fence = bare.lstrip()[:3]
            block = ("code", line, start, at)
        elif m := _HEADING.match(bare):
            yield from flush()
            del stack[len(m[1]) - 1 :]
            stack.extend([""] * (len(m[1]) - 1 - len(stack)))
            stack.append(m[2])
            yield "heading", m[2], start, at, " > ".join(stack)
        elif not bare.strip():
            yield from flush()
        else:
            kind = "item" if _ITEM.match(bare) else "table" if bare.startswith("|") else "html" if bare.startswith("<") else "paragraph"
            if block and (block[0] != kind or kind == "item"):
                yield from flush()
            block = (kind, (block[1] if block else "") + line, block[2] if block else start, at)
    yield from flush()


def markdown_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, block_no, kind, content, start, end, heading)``; null and empty texts have no block."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(k, i, *b) for i, b in enumerate(blocks_of(t or ""))]
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            types = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["key", "block_no", "kind", "content", "start", "end", "heading"])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, block_no int, kind string, content string, start bigint, end bigint, heading string")
    return rows.withColumnRenamed("key", key)


def references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, seq, target)``: paths in code spans, then in Markdown links; the first of each path wins."""
    path = r"([A-Za-z0-9_./-]+\.[A-Za-z0-9]{1,5})"
    found = F.concat(F.regexp_extract_all(text, F.lit(rf"`{path}`"), F.lit(1)), F.regexp_extract_all(text, F.lit(rf"\]\({path}\)"), F.lit(1)))
    return docs.select(F.col(key), F.posexplode(F.array_distinct(found)).alias("seq", "target"))


def sarif_results(spark: SparkSession, path: str) -> DataFrame:
    """``(rule, level, message, path, line)`` of SARIF reports; a result without location stays."""
    schema = "runs array<struct<results: array<struct<ruleId: string, level: string, message: struct<text: string>, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>>>>>"
    runs = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = runs.select(F.explode("runs").alias("run")).select(F.explode("run.results").alias("r"))
    place = F.get("r.locations", F.lit(0)).physicalLocation
    return rows.select(F.col("r.ruleId").alias("rule"), F.col("r.level").alias("level"), F.col("r.message.text").alias("message"), place.artifactLocation.uri.alias("path"), F.coalesce(place.region.startLine, F.lit(0)).alias("line"))


def records(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """Typed JSON lines or JSON arrays; a row that does not fit the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", not lines).json(path)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of unknown shape as variants, null where they are no JSON."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("payload"))


def write_artifacts(df: DataFrame, path: str, partition: str = "skill_id", form: str = "parquet") -> None:
    df.write.mode("overwrite").partitionBy(partition).format(form).save(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def graph_wire(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line for each node and edge."""
    return nodes.select(F.lit("node").alias("part"), F.to_json(F.struct("*")).alias("wire")).unionByName(edges.select(F.lit("edge").alias("part"), F.to_json(F.struct("*")).alias("wire")))


def missing_artifacts(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti")
