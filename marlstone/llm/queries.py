"""The queries of this package over the test tables; names and columns are those of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, neardup, packing, prose, provenance, secrets, splitting, syntax, truncation
from .base import table


def p1_prose(spark: SparkSession, d: str) -> DataFrame:
    return prose.corpus_prose(table(spark, d, "documents"), table(spark, d, "source_excerpts"), table(spark, d, "raw_observations"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_prose(spark, d).select("tab", "rec_id", "lang").distinct()


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of each language's prose in the code files of each skill."""
    return prose.skill_shares(p1_prose(spark, d), table(spark, d, "source_excerpts"))


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid(table(spark, d, "source_excerpts"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_files(spark, d).select("file_key")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "source_excerpts"))


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    """Invalid files by cause, and whether the tables name the language that their path claims."""
    kind = F.lower(F.trim("language"))
    plain = F.when(kind.isin("py", "python3"), "python").when(kind.isin("js", "mjs", "node"), "javascript").when(kind == "ts", "typescript").when(kind.isin("sh", "shell"), "bash").otherwise(kind)
    entries = table(spark, d, "file_entries").select("file_key", plain.alias("entry")).dropDuplicates(["file_key"])
    units = table(spark, d, "code_units").groupBy("file_key").agg(F.min(plain).alias("unit"))
    rows = p2_files(spark, d).join(entries, "file_key", "left").join(units, "file_key", "left")
    same = lambda c: F.coalesce(F.col(c) == F.col("language"), F.lit(False))
    return rows.groupBy("language", "cause", same("entry").alias("entry_agrees"), same("unit").alias("unit_agrees")).agg(F.count("*").alias("files"), F.sum(F.col("edits").cast("bigint")).alias("edits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.corpus_secrets(table(spark, d, "source_excerpts"), table(spark, d, "raw_observations"), table(spark, d, "skill_specs")).select("tab", "rec_id", "secret")


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.corpus_secrets(table(spark, d, "source_excerpts"), table(spark, d, "raw_observations"), table(spark, d, "skill_specs"), redacted=True).select("tab", "rec_id", "found", "redacted")


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(table(spark, d, "source_excerpts"), table(spark, d, "upstream_libs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_files(spark, d).select("file_key")


def p4_handwritten(spark: SparkSession, d: str) -> DataFrame:
    """The code files that remain, with the size that their text really has."""
    return provenance.handwritten(table(spark, d, "file_entries"), table(spark, d, "source_excerpts"), table(spark, d, "upstream_libs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "source_excerpts"), table(spark, d, "source_bundles"), table(spark, d, "build_configs"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    args = table(spark, d, "source_excerpts"), table(spark, d, "source_bundles"), table(spark, d, "build_configs")
    return splitting.excerpt_pieces(*args).unionByName(splitting.bundle_pieces(*args))


def _documents_of_bundles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_excerpts").where("kind = 'doc'")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.near_pairs(_documents_of_bundles(spark, d), "excerpt_id", "text")
    return pairs.select(F.col("a").alias("excerpt_a"), F.col("b").alias("excerpt_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(_documents_of_bundles(spark, d), "excerpt_id", "text").withColumnRenamed("id", "excerpt_id")


def p6_label_skills(spark: SparkSession, d: str) -> DataFrame:
    """One row for each group of two or more excerpts and each skill whose labels share a source with
    one of them, with the number of these excerpts and sources; ``p6_groups`` lists the excerpts."""
    bundles = table(spark, d, "source_bundles").select("bundle_id", "source_hash").dropDuplicates(["bundle_id"])
    labels = table(spark, d, "gold_labels").select("source_hash", F.col("skill_id").alias("labelled_skill")).where("labelled_skill is not null").distinct()
    held = _documents_of_bundles(spark, d).select("excerpt_id", "bundle_id").dropDuplicates(["excerpt_id"]).join(bundles, "bundle_id")
    members = p6_groups(spark, d).select("excerpt_id", "class_id")
    grouped = members.groupBy("class_id").agg(F.count("*").alias("members")).where("members > 1").select("class_id")
    rows = members.join(grouped, "class_id").join(held, "excerpt_id").join(labels, "source_hash")
    return rows.groupBy("class_id", "labelled_skill").agg(F.countDistinct("excerpt_id").alias("excerpts"), F.countDistinct("source_hash").alias("sources"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.token_ids(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p8_quality(spark: SparkSession, d: str) -> DataFrame:
    return packing.quality(p8_containers(spark, d), table(spark, d, "pack_limits"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.source_rates(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_prose, p1_shares, p2_found, p2_files, p2_rates, p2_labels, p3_found, p3_redacted, p4_found, p4_files, p4_handwritten, p5_found, p5_pieces, p6_found, p6_groups, p6_label_skills, p7_ids, p8_containers, p8_quality, p9_found, p9_rates)}

#: Queries that SQL can express over the whole tables.
ORACLE = {
    "p5_found": """
        with lim as (select bundle_id, any_value(prompt_version) as prompt_version from source_bundles group by bundle_id),
        ex as (select excerpt_id, any_value(bundle_id) as bundle_id, any_value(text) as text from source_excerpts group by excerpt_id),
        r as (select ex.*, c.max_file_chars, c.max_total_chars, coalesce(length(ex.text), 0) as n
              from ex join lim using (bundle_id) join build_configs c using (prompt_version))
        select 'excerpt' as item_kind, excerpt_id as item_id from r where n > max_file_chars
        union all
        select 'run', excerpt_id from r where n > max_file_chars
          and list_max([length(x) for x in regexp_split_to_array(text, '[ \\t\\r\\n]')]) > max_file_chars
        union all
        select 'bundle', bundle_id from r group by bundle_id, max_total_chars having sum(n) > max_total_chars
    """,
}
