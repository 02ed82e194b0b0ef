"""Code files that were not written by hand for their repository: tool output, minified or bundled
scripts, copies of other projects' libraries, and data stored as code.

Method: the normalised lines of every file are hashed in short runs, which makes common lines rare.
Files of the same set of runs are one entry. An inverted index keeps, for each hash that occurs in two
repositories or more, two representative entries of different repositories; those that an entry meets
often are compared with it exactly by their sets of runs. As the file that holds most of an entry need
not represent any of its runs, the entry's rarest runs are then looked up in all others: so many that
whatever holds more than was found must hold one of them. A file whose runs are contained in another
repository's file to ``CONTAINED`` or more is a copy, edited or not. Token-composition rules judge the
remaining files.

Files with null or empty text are no cases. A file that was delivered again counts once. A run that no
other repository holds is never looked up, and one that many hold only where an entry's rarer runs do
not decide, so a library that a third of all repositories hold costs little more than its lines.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import map_batches, written

#: Share of a file's distinct runs of lines that another repository's file must hold.
CONTAINED = 0.4
#: Common runs that a copy must have at least, lines of a run, and characters of a line that counts.
LINES, RUN, LINE_CHARS = 5, 3, 4
#: Share of a file's runs that must meet on one representative for the two to be compared at once; it
#: only decides from which containment the search in all files begins.
MEETS = 0.15

# --- fixed values: what tools write at the head of their output ----------------------------------
_MARKER = re.compile(
    r"(?i)\bauto-?generated\b|@generated|<auto-generated|\bgenerated (?:on|by|from|at|using|with|code)\b|code generated|automatically (?:generated|created|produced)|do not (?:edit|modify)\b|must not be (?:changed|edited)|changes will be overwritten|edits here are lost|produced by the \w+ compiler"
    r"|(?:produit|généré|créé) automatiquement|automatisch (?:von \w+ )?(?:erzeugt|generiert|erstellt)|(?:generado|creado|producido) (?:de forma )?autom[aá]tica|(?:автоматически|сгенерирован)|自动生成|自動生成|自動的に生成"
)
#: Every mark above holds one of these; plain substring search finds them.
_MARK_WORDS = ("generat", "do not", "must not be", "be overwritten", "edits here", "produced by", "automat", "automát", "generado", "génér", "автоматически", "сгенерирован", "自动生成", "自動生成", "自動的に生成")
_DECLARED = re.compile(r"^(?:export (?:default )?)?(?:(?:async |abstract )?(?:class|interface|enum|type|function|struct|message|def|const) )?[A-Za-z_][A-Za-z_.]*?(?:_\d+)*?(\d+)(?=\w*[ (<:.])", re.M)
_BLOB = re.compile(r"[A-Za-z0-9+/=\\]{60,}")
_TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|-?\d[\w.]*|[A-Za-z_$][\w$]*")
_FOREIGN = re.compile(r"\s*(?:<!doctype|<html|<\?xml|diff --git )", re.I)
_COMMENT_LINE = re.compile(r"\s*(?:#|//|/?\*|\"\"\"|''')")


def composed(text: str) -> str | None:
    """``generated``, ``minified`` or ``data`` by a file's tokens alone, else None."""
    size = len(text)
    if not size or _FOREIGN.match(text):
        return None
    low = text.lower()
    if any(word in low for word in _MARK_WORDS) and any(_COMMENT_LINE.match(text, text.rfind("\n", 0, m.start()) + 1) for m in _MARKER.finditer(text)):
        return "generated"
    numbers = [int(n) for n in _DECLARED.findall(text) if len(n) < 7]
    if len(numbers) >= 6:
        steps = sum(0 <= b - a <= 1 for a, b in zip(numbers, numbers[1:], strict=False))
        if steps >= 0.8 * (len(numbers) - 1) and len(set(numbers)) >= 5:
            return "generated"
    blob = sum(map(len, _BLOB.findall(text)))
    if blob >= 0.6 * size and size >= 400 and text.count("PRIVATE KEY") + text.count("PUBLIC KEY") < 2:
        return "data"
    tokens = values = spaced = 0
    for m in _TOKEN.finditer(text):
        tokens += 1
        values += text[m.start()] in "\"'-0123456789"
        spaced += " " in m[0]
    if tokens >= 60 and values >= 0.92 * tokens and spaced < 0.2 * tokens:
        return "data"
    space = text.count(" ") + text.count("\n") + text.count("\t")
    if size >= 400:
        long = sum(len(line) for line in text.split("\n") if len(line) > 200)
        if long >= 0.5 * size and space <= 0.12 * size:
            return "minified"
    return None


def _windows(text: Column) -> Column:
    """Hashes of a text's distinct runs of ``RUN`` lines, blank and very short lines left out. A run
    is far rarer than a line: templates share lines, copies share runs."""
    # A lambda of one argument: ``F.trim`` itself would be handed the line's number as what to trim.
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda s: F.trim(s, F.lit(" \t"))), lambda s: F.length(s) >= LINE_CHARS)
    # The outer transform binds the array once; inlined, it would be split anew for every element.
    hashed = lambda bound: F.transform(
        F.slice(bound, F.lit(1), F.greatest(F.size(bound) - (RUN - 1), F.lit(0))),
        lambda s, i: F.xxhash64(s, *(F.get(bound, i + k) for k in range(1, RUN))),
    )
    return F.array_distinct(F.get(F.transform(F.array(lines), hashed), F.lit(0)))


def files(excerpts: DataFrame) -> DataFrame:
    """``(file_key, skill_id, text)``: each code file once, those without text left out."""
    return excerpts.where("kind = 'code' and text is not null and text <> ''").select("file_key", "skill_id", "text")


def _compared(pairs: DataFrame, met: DataFrame, sets: DataFrame) -> DataFrame:
    """``(set, best)``: the most runs that an entry has in common with one of the entries paired with it,
    and the file of another repository that holds them, the first of several."""
    theirs = sets.select(F.col("set").alias("other"), F.col("lines").alias("held"), "low", "high")
    both = pairs.join(met.select("set", "repo", F.col("live.line").alias("lines")), "set").join(theirs, "other")
    of = F.when(F.col("low.repo") == F.col("repo"), F.col("high.file_key")).otherwise(F.col("low.file_key"))
    return both.select("set", F.struct(F.size(F.array_intersect("lines", "held")).alias("common"), F.negative(of).alias("of")).alias("best")).groupBy("set").agg(F.max("best").alias("best"))


def copies(code: DataFrame) -> DataFrame:
    """``(file_key, of, contained)``: files whose lines another repository's file holds, with the file
    that holds most of them."""
    hashed = code.select("file_key", F.xxhash64("skill_id").alias("repo"), _windows(F.col("text")).alias("lines")).where(F.size("lines") >= LINES)
    hashed = written(hashed.withColumn("set", F.xxhash64(F.array_sort("lines"))), "runs")  # hashed once
    # Minimum and maximum by repository: they differ where two repositories hold the set, or the line.
    at = F.struct("repo", "file_key")
    sets = written(hashed.groupBy("set").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.first("lines").alias("lines")), "sets")
    rows = sets.select("set", F.col("low.repo").alias("a"), F.col("high.repo").alias("b"), F.size("lines").alias("n"), F.explode("lines").alias("line"))
    index = rows.groupBy("line").agg(F.min(F.struct("a", "set")).alias("first"), F.max(F.struct("b", "set")).alias("last"), F.count("*").alias("often")).where("first.a <> last.b")
    # The runs of a set of one repository that others hold; one of several repositories is contained in itself.
    rep = F.when(F.col("first.a") == F.col("a"), F.col("last.set")).otherwise(F.col("first.set"))
    live = rows.where("a = b").join(index, "line").groupBy("set", F.col("a").alias("repo"), "n").agg(F.collect_list(F.struct("often", "line", rep.alias("rep"))).alias("live"))
    least = F.greatest(F.lit(LINES), F.ceil(CONTAINED * F.col("n") - 1e-6))
    met = written(live.withColumn("least", least).where(F.size("live") >= F.col("least")), "met")
    often = met.select("set", "n", F.explode("live.rep").alias("other")).groupBy("set", "n", "other").agg(F.count("*").alias("c")).where(F.col("c") >= F.greatest(F.lit(2), MEETS * F.col("n")))
    early = written(_compared(often.select("set", "other"), met, sets), "early")
    # Whoever holds ``more`` of the live runs holds one of the rarest, of which all but more - 1 are looked up.
    more = F.greatest("least", F.coalesce(F.col("best.common") + 1, F.lit(0)))
    open_ = met.join(early, "set", "left").withColumn("more", more).where(F.size("live") >= F.col("more"))
    asked = open_.select("set", "repo", "more", F.explode(F.slice(F.array_sort("live"), F.lit(1), (F.size("live") - F.col("more") + 1).cast("int"))).alias("x")).select("set", "repo", "more", "x.line")
    there = rows.select(F.col("set").alias("other"), "a", "b", "n", "line")
    rest = asked.join(there, "line").where("other <> set and (a <> repo or b <> repo) and n >= more").select("set", "other").distinct()
    best = early.unionByName(_compared(rest, met, sets)).groupBy("set").agg(F.max("best").alias("best"))
    share = F.col("best.common") / F.col("n")
    edited = best.join(met.select("set", "n"), "set").where((F.col("best.common") >= LINES) & (share >= CONTAINED)).select("set", F.negative("best.of").alias("of"), share.alias("contained"))
    whole = sets.where("low.repo <> high.repo").select("set", "low", "high")
    files_ = hashed.select("file_key", "repo", "set").dropDuplicates(["file_key"])
    same = files_.join(whole, "set").select("file_key", F.when(F.col("low.repo") == F.col("repo"), F.col("high.file_key")).otherwise(F.col("low.file_key")).alias("of"), F.lit(1.0).alias("contained"))
    return same.unionByName(files_.join(edited, "set").select("file_key", "of", "contained"))


def judged(code: DataFrame) -> DataFrame:
    """``(file_key, kind)`` of the files whose token composition is not that of hand-written code."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(k, kind) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (kind := composed(t))]
        keys, kinds = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(list(keys), pa.int64()), pa.array(list(kinds), pa.string())], ["file_key", "kind"])

    return map_batches(code.select("file_key", "text"), fn, "file_key bigint, kind string").dropDuplicates(["file_key"])


def bannered(code: DataFrame, libs: DataFrame) -> DataFrame:
    """``(file_key)`` of the files whose first lines name a known library and a version. The list of
    libraries is a fixed table of known size."""
    named = code.select("file_key", F.lower(F.regexp_extract("text", r"^(?:#![^\n]*\n)?\s*(?://|#|/\*!?|\*)\s*(?:@license\s+)?([A-Za-z][\w.-]*)\s+v?\d+\.\d+(?:\.\d+)?\b", 1)).alias("lib")).where("lib <> ''")
    return named.join(F.broadcast(libs.select(F.lower("lib_name").alias("lib")).distinct()), "lib", "left_semi").select("file_key").distinct()


def not_handwritten(excerpts: DataFrame, libs: DataFrame | None = None) -> DataFrame:
    """``(file_key, kind, of, contained)``: one row for each file; a copy is named before a rule."""
    code = files(excerpts)
    rules, copied = judged(code), copies(code)
    rows = copied.withColumnRenamed("file_key", "k").join(rules.withColumnRenamed("file_key", "r"), F.col("k") == F.col("r"), "full")
    out = rows.select(F.coalesce("k", "r").alias("file_key"), F.when(F.col("k").isNotNull(), "vendored").otherwise(F.col("kind")).alias("kind"), "of", "contained")
    if libs is None:
        return out
    named = bannered(code, libs).join(out, "file_key", "left_anti")
    return out.unionByName(named.select("file_key", F.lit("vendored").alias("kind"), F.lit(None).cast("bigint").alias("of"), F.lit(None).cast("double").alias("contained")))


def handwritten(entries: DataFrame, excerpts: DataFrame, libs: DataFrame | None = None) -> DataFrame:
    """The code files that remain, each once, with the size that their text really has. What is code
    the excerpts say, since an entry may lack its language; it stays null there."""
    code = excerpts.where("kind = 'code' and text is not null").select("file_key", F.length("text").alias("chars")).dropDuplicates(["file_key"])
    named = entries.select("file_key", "skill_id", "relative_path", "language", "size_bytes").dropDuplicates(["file_key"])
    rest = code.join(named, "file_key", "left").select("file_key", "skill_id", "relative_path", "language", "size_bytes", "chars")
    return rest.join(not_handwritten(excerpts, libs), "file_key", "left_anti")
