"""Natural language in the comments and string literals of source text.

Method: a character-level hidden Markov model with one state for code and one for each language.
Emissions are smoothed trigram probabilities, trained on a bounded sample of labelled documents and
of code; a switch of state costs a constant. Lexing the whole text yields its comments and literal
values. Outside them the state is code and nothing else is allowed, so the best path of a whole file
is that of each region by itself, any state being free to follow a delimiter; Viterbi decoding is run
over all of a batch's regions at once, and a run of one language state that holds enough words is a
passage. Passages come out with their text,
escapes and margins resolved, and the span of the record that they stand in.

Null and empty texts hold no prose. A record counts once for each language, however often its row
occurs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import map_batches
from .lexing import BASH, JAVASCRIPT, PYTHON, actual, claimed, regions

LANGUAGES = ("en", "de", "fr", "es", "ru", "zh", "ja")
STATES = ("code", *LANGUAGES)
#: Least words of a passage, and characters where the script has no spaces.
WORDS, CHARACTERS = 5, 8
#: Labelled documents of each language and code files that the model is fitted on at most.
SAMPLE = 200
#: Places whose emissions are held at once.
BLOCK = 1 << 16
#: Log cost of a switch of state at a character.
SWITCH = 12.0
_BITS = 18
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|U([0-9a-fA-F]{8})|(\n)|(.))", re.S)
_MARGIN = re.compile(r"[ \t]*\r?\n[ \t]*(?:\*(?!/)|#+(?!\w)|//+)?[ \t]*")
_HOLE = re.compile(r"\$\{[^{}]*\}|\$\w+")
_JOIN = re.compile(r"[\s\"'`+\\]*\n[\s\"'`+\\]*|[\s]*\n[\s]*(?:\#+|//+)\Z")
_QUERY = re.compile(r"\s*(?:SELECT|INSERT INTO|UPDATE|DELETE FROM|CREATE (?:TABLE|INDEX)|ALTER TABLE|WITH \w+ AS|DROP)\b")
_FENCE = re.compile(r"```.*?(?:```|\Z)|^https?://\S+|^-- .*$|<!--.*?-->", re.S | re.M)


def _codes(text: str) -> np.ndarray:
    low = text.lower()
    low = low if len(low) == len(text) else "".join(c.lower()[0] for c in text)  # places must stay those of the text
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "uint32")


def _slots(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table slots of the character, the pair and the triple that end at each place."""
    c = codes.astype("uint64")
    b, a = np.concatenate([[10], c[:-1]]).astype("uint64"), np.concatenate([[10, 10], c[:-2]]).astype("uint64")[: len(c)]
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype("int64")
    return mix(c + np.uint64(1)), mix((b << np.uint64(21)) + c + np.uint64(7)), mix((a << np.uint64(42)) + (b << np.uint64(21)) + c + np.uint64(13))


class Model:
    """Log emission table, one row for each hashed trigram and one column for each state."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def fit(cls, samples: dict[str, list[str]]) -> Model:
        table = np.zeros((1 << _BITS, len(STATES)), "float32")
        for j, state in enumerate(STATES):
            one, two, three = _slots(_codes("\n".join(samples.get(state) or ["\n"])))
            total = len(one)
            size = 1 << _BITS
            uni = (np.bincount(one, minlength=size) + 0.02) / (total + 0.02 * 20_000)
            # Each trigram slot backs off to the pair and the character that were seen with it.
            n3, n2 = np.bincount(three, minlength=size), np.bincount(two, minlength=size)
            table[:, j] = np.log(0.02 / (total + 0.02 * 20_000))
            context = np.bincount(np.concatenate([[0], two[:-1]]), minlength=size)
            pair = (n2[two] + 4 * uni[one]) / (np.bincount(np.concatenate([[0], one[:-1]]), minlength=size)[np.concatenate([[0], one[:-1]])] + 4)
            p = (n3[three] + 4 * pair) / (context[np.concatenate([[0], two[:-1]])] + 4)
            table[three, j] = np.log(np.minimum(p, 1.0))
        return cls(table)

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        return self.table[_slots(codes)[2]]


def decode(model: Model, texts: list[str], switch: float = SWITCH) -> list[np.ndarray]:
    """The most probable state at each character of each text, all texts of like length at once."""
    out: list = [None] * len(texts)
    order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: len(texts[i]))
    for i in range(len(texts)):
        if not texts[i]:
            out[i] = np.zeros(0, "int8")
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and (end - at + 1) * len(texts[order[end]]) <= 400_000 and (end == at or len(texts[order[end]]) <= 1.5 * len(texts[order[at]]) + 16):
            end += 1
        end = max(end, at + 1)
        group = order[at:end]
        at = end
        codes = [_codes(texts[i]) for i in group]
        sizes = [len(c) for c in codes]
        width = max(sizes)

        def scores(start: int) -> np.ndarray:
            """Emissions of ``BLOCK`` places from ``start``, so that a huge literal needs no table of its own size."""
            head = np.array([10, 10], "uint32")  # before a text stands a line's end, whatever else is in the batch
            parts = [np.concatenate([head, c])[start : start + 2 + BLOCK] for c in codes]
            flat, place = model.emissions(np.concatenate(parts)), 0
            out = np.zeros((len(group), min(BLOCK, width - start), len(STATES)), "float32")
            for row, part in enumerate(parts):
                out[row, : max(0, len(part) - 2)] = flat[place + 2 : place + len(part)]
                place += len(part)
            return out

        score = scores(0)
        moved = np.zeros((width, len(group), len(STATES)), bool)
        source = np.zeros((width, len(group)), "int8")
        best = score[:, 0].copy()
        for t in range(1, width):
            if t % BLOCK == 0:
                score = scores(t)
            top = best.argmax(1)
            jump = best[np.arange(len(group)), top][:, None] - switch
            moved[t] = best < jump
            source[t] = top
            best = np.maximum(best, jump) + score[:, t % BLOCK]
        state = best.argmax(1).astype("int8")
        path = np.empty((len(group), width), "int8")
        rows = np.arange(len(group))
        for t in range(width - 1, -1, -1):
            path[:, t] = state
            state = np.where(moved[t, rows, state], source[t], state)
        for row, i in enumerate(group):
            out[i] = path[row, : sizes[row]]
    return out


def _value(m: re.Match) -> str:
    hexed = m[1] or m[2] or m[3] or m[4]
    if hexed:
        n = int(hexed, 16)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else " "
    return "" if m[5] else {"n": "\n", "t": " ", "r": " "}.get(m[6], m[6])


def _may_hold(value: str) -> bool:
    """Whether a value has words or characters enough for a passage."""
    return len(value) >= CHARACTERS and (len(value.split(None, WORDS - 1)) >= WORDS or _WIDE.search(value) is not None) and not _QUERY.match(value)


_EDGE = " \t\r*!#/"


def _held(text: str, language: str) -> list[tuple[str, str, list[tuple[int, int]]]]:
    """``(value, kind, spans)`` of the comments and literals that are long enough to hold prose."""
    joined: list[tuple[str, list[tuple[int, int]]]] = []
    last_end, last_kind = -1, ""
    for kind, start, end in regions(text, language):
        if joined and kind == last_kind and start - last_end < 200 and _JOIN.fullmatch(text[last_end:start]):
            joined[-1][1].append((start, end))
        else:
            joined.append((kind, [(start, end)]))
        last_end, last_kind = end, kind
    found = []
    for kind, places in joined:
        parts = [text[a:b] for a, b in places]
        if kind == "literal":
            parts = [_ESCAPE.sub(_value, x) if "\\" in x else x for x in parts]
        value = " ".join(parts) if len(parts) > 1 else parts[0]
        if "\n" in value:
            value = _MARGIN.sub(" ", value)
        if "$" in value:
            value = _HOLE.sub(" ", value)
        value = value.strip(_EDGE)
        if _may_hold(value):
            found.append((value, kind, places))
    return found


def _tracked(pattern: re.Pattern, put, value: str, at: list[int], to: list[int]) -> tuple[str, list[int], list[int]]:
    """``pattern.sub`` that keeps where each character begins and ends in the record."""
    parts, froms, tos, last = [], [], [], 0
    for m in pattern.finditer(value):
        new = put(m)
        parts += [value[last : m.start()], new]
        froms += at[last : m.start()] + [at[m.start()]] * len(new)
        tos += to[last : m.start()] + [to[m.end() - 1]] * len(new)
        last = m.end()
    return "".join([*parts, value[last:]]), froms + at[last:], tos + to[last:]


def places_of(text: str, kind: str, places: list[tuple[int, int]]) -> tuple[str, list[int], list[int]]:
    """The value that ``_held`` makes of these spans, with the begin and the end of each of its
    characters in ``text``."""
    value, at, to = "", [], []
    for n, (a, b) in enumerate(places):
        part = text[a:b], list(range(a, b)), list(range(a + 1, b + 1))
        if kind == "literal" and "\\" in part[0]:
            part = _tracked(_ESCAPE, _value, *part)
        if n:
            value, at, to = value + " ", [*at, places[n - 1][1]], [*to, a]
        value, at, to = value + part[0], at + part[1], to + part[2]
    for pattern in (_MARGIN, _HOLE):
        value, at, to = _tracked(pattern, lambda m: " ", value, at, to)
    low, high = len(value) - len(value.lstrip(_EDGE)), len(value.rstrip(_EDGE))
    return value[low:high], at[low:high], to[low:high]


def passages_in(text: str, language: str) -> list[str]:
    """Contents of the comments and literals that are long enough to hold prose. Comments on
    consecutive lines, and literals that are joined across lines, count as one."""
    return [value for value, _, _ in _held(text, language)]


def _fragment_held(text: str, claim: str | None) -> list[tuple[str, str, list[tuple[int, int]]]]:
    """``_held`` of a piece of a file; where the claimed language's syntax has none, another's may."""
    tried: list[str] = []
    for language in (claim, PYTHON, JAVASCRIPT, BASH):
        if language and language not in tried:
            tried.append(language)
            found = _held(text, language)
            if found:
                return found
    return []


def fragment_passages(text: str, claim: str | None) -> list[str]:
    """``passages_in`` a piece of a file; where the claimed language's syntax has none, another's may."""
    return [value for value, _, _ in _fragment_held(text, claim)]


def runs(text: str, path: np.ndarray) -> list[tuple[str, int, int]]:
    """``(language, start, end)`` of each run of a language state that is long enough."""
    edges = np.flatnonzero(np.diff(path)) + 1
    found = []
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(path)], strict=True):
        state = int(path[a])
        if state:
            part = text[a:b]
            language = STATES[state]
            enough = len(_WIDE.findall(part)) >= CHARACTERS if language in ("zh", "ja") else len(_WORD.findall(part)) >= WORDS
            if enough:
                found.append((language, a, b))
    return found


def spans(text: str, path: np.ndarray) -> list[tuple[str, int]]:
    """``(language, characters)`` of each run of a language state that is long enough."""
    return [(language, b - a) for language, a, b in runs(text, path)]


def fit(documents: DataFrame, excerpts: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` documents of each language and as many code files, chosen by
    a hash of their keys. Only this bounded sample reaches the driver."""
    lang = F.lower(F.substring("lang", 1, 2))
    docs = documents.where(F.length("text").between(80, 6000) & lang.isin(*LANGUAGES)).select(lang.alias("state"), F.col("doc_id").alias("key"), "text", F.lit(None).cast("string").alias("path"))
    code = excerpts.where((F.col("kind") == "code") & F.length("text").between(80, 20_000)).select(F.lit("code").alias("state"), F.col("excerpt_id").alias("key"), "text", "path")
    rows = docs.unionByName(code).withColumn("h", F.xxhash64("key"))
    counts = {r.state: r["count"] for r in rows.groupBy("state").count().collect()}  # a row for each state
    # About twice the sample by a share of the hash's range, then the first of it by rank in each task.
    shares = F.create_map(*(F.lit(x) for state in STATES for x in (state, min(1.0, 2 * sample / max(1, counts.get(state, 0))))))
    thin = rows.where(F.pmod("h", F.lit(1 << 40)) <= shares[F.col("state")] * float(1 << 40))
    first = thin.withColumn("place", F.row_number().over(Window.partitionBy("state").orderBy("h", "key", "text"))).where(F.col("place") <= sample)
    samples: dict[str, list[str]] = {state: [] for state in STATES}
    for r in sorted(first.collect(), key=lambda r: (r.state, r.place)):
        samples[r.state].append(_code_only(r.text, claimed(r.path)) if r.state == "code" else _FENCE.sub(" ", r.text))
    return Model.fit(samples)


def _code_only(text: str, claim: str | None) -> str:
    """A file without its comments and longer literals."""
    parts, at = [], 0
    for kind, start, end in regions(text, actual(text, claim)):
        if kind == "comment" or _may_hold(text[start:end]):
            parts.append(text[at:start])
            at = end
    return "".join([*parts, text[at:]])


_PASSAGES = (("rec_id", pa.int64(), "bigint"), ("lang", pa.string(), "string"), ("from_char", pa.int32(), "int"), ("to_char", pa.int32(), "int"), ("passage", pa.string(), "string"), ("chars", pa.int32(), "int"), ("share", pa.float64(), "double"))


def prose(df: DataFrame, model: Model, key: str, text: str, path: str, language: str | None, fragments: bool = False) -> DataFrame:
    """``(rec_id, lang, from_char, to_char, passage, chars, share)``: one row for each passage, its
    span in the row's text, and the share of the text's characters that all passages of its language
    have. ``fragments``: the texts are pieces of files, to be lexed as the language named."""
    shared = df.sparkSession.sparkContext.broadcast(model.table)
    columns = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(path).alias("p"), (F.col(language) if language else F.lit(None).cast("string")).alias("l")).where(F.col("t").isNotNull() & (F.length("t") >= CHARACTERS))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = Model(shared.value)
        keys, texts, paths, names = (batch.column(i).to_pylist() for i in range(4))
        parts: dict[str, int] = {}
        holders: list[list[tuple]] = []
        for t, p, n in zip(texts, paths, names, strict=True):
            claim = claimed(p, n)
            found = _fragment_held(t, claim) if fragments else _held(t, actual(t, claim))
            holders.append([(parts.setdefault(x, len(parts)), kind, places) for x, kind, places in found])
        every = list(parts)
        got = [runs(x, path_) for x, path_ in zip(every, decode(own, every), strict=True)]
        rows = []
        for k, t, held in zip(keys, texts, holders, strict=True):
            total: dict[str, int] = {}
            for i, _, _ in held:
                for lang, a, b in got[i]:
                    total[lang] = total.get(lang, 0) + b - a
            for i, kind, places in held:
                if got[i]:
                    value, at, to = places_of(t, kind, places)
                    rows.extend((k, lang, at[a], to[b - 1], value[a:b].encode("utf-8", "replace").decode(), b - a, min(1.0, total[lang] / len(t))) for lang, a, b in got[i])
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(_PASSAGES)
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind, _) in zip(cols, _PASSAGES, strict=True)], [name for name, _, _ in _PASSAGES])

    return map_batches(columns, fn, ", ".join(f"{name} {kind}" for name, _, kind in _PASSAGES)).dropDuplicates(["rec_id", "lang", "from_char", "to_char"])


def corpus_prose(documents: DataFrame, excerpts: DataFrame, observations: DataFrame, model: Model | None = None) -> DataFrame:
    """``prose`` of the code excerpts and of the observations, with ``tab`` naming the table."""
    model = model or fit(documents, excerpts)
    files = prose(excerpts.where("kind = 'code'"), model, "excerpt_id", "text", "path", None)
    pieces = prose(observations, model, "obs_id", "source_text", "relative_path", "language", fragments=True)
    return files.withColumn("tab", F.lit("excerpt")).unionByName(pieces.withColumn("tab", F.lit("observation")))


def skill_shares(passages: DataFrame, excerpts: DataFrame) -> DataFrame:
    """``(skill_id, lang, files, code_files, mean_share)``: the files that hold the language, and its
    share averaged over all code files of the skill, 0 in those without. A skill without any prose
    has one row with no language."""
    code = excerpts.where("kind = 'code' and text is not null").select(F.col("excerpt_id").alias("rec_id"), "skill_id").dropDuplicates(["rec_id"])
    held = passages.where("tab = 'excerpt'").select("rec_id", "lang", "share").distinct().join(code, "rec_id")
    held = held.groupBy("skill_id", "lang").agg(F.count("*").alias("files"), F.sum("share").alias("total"))
    skills = code.groupBy(F.col("skill_id").alias("s")).agg(F.count("*").alias("code_files"))
    rows = skills.join(held, F.col("s").eqNullSafe(F.col("skill_id")), "left")
    return rows.select(F.col("s").alias("skill_id"), "lang", F.coalesce("files", F.lit(0)).cast("bigint").alias("files"), "code_files", F.round(F.coalesce("total", F.lit(0.0)) / F.col("code_files"), 6).alias("mean_share"))
