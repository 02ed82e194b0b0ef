"""Credentials in source text, configuration, manifests and documents, and their redaction.

Method: source text is divided into code, comments and literals by its lexer. Identifiers whose last
words name a credential, header and flag names among them, are tokens of one of these; the tokens behind
an identifier are read in turn, and the literal that is assigned or passed to it is taken; user information of URLs,
authorization schemes and private-key blocks are lexical forms of their own. Literals that are
placeholders, references, digests or plain words are dropped. Only the literal's contents are
replaced, so that delimiters, schemes, addresses and escapes stay as they were.

Null and empty texts hold none. A credential that occurs twice in a record is reported once; a
record that was delivered again counts once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_batches
from .lexing import BASH, actual, claimed, regions

# --- fixed values: words that name a credential when they end an identifier ------------------------
_NAMES = (
    "password passwd passphrase passcode pass pwd pw secret token auth authorization credential credentials bearer apikey "
    "api_key access_key secret_key signing_key private_key encryption_key master_key session_key account_key shared_key "
    "client_secret webhook_secret deploy_key license_key auth_key service_key storage_key hmac_key jwt "
    "contrasena contraseña clave kennwort passwort motdepasse mot_de_passe mdp senha пароль токен 密码 口令 密钥 令牌 パスワード"
).split()
# --- fixed values: words that stand for a value that is still to be filled in ---------------------
_PLACEHOLDER = re.compile(
    r"(?i)(?:change|replace|insert|enter|fill|put|add|set|paste|use|provide)[-_ ]?(?:me|this|it|your|the|a|token|key|password|secret|api|in|with|here)"
    r"|your|\bhere\b|_here\b|goes|not[-_ ]a|real[-_ ]key|example|sample|dummy|placeholder|redacted|removed|hidden|masked|undefined|todo|fixme|tbd|foo|lorem|<[^>]*>|x{4,}|\*{3,}|\.{3}|…|•{3,}|-{4,}|_{4,}|0{8,}|1234567"
)
_REFERENCE = re.compile(r"^(?:\$|%\w+%$|@\w+@$|\{\{|\{%|#\{|<%|!\w+|&\w|ENC\[|vault:|env[:.(]|file:|ref[:+]|arn:|ssm:|op://|secretref:|process\.env|os\.environ|os\.getenv|getenv|import\.meta|System\.|config\.|self\.|this\.|args\.|settings\.|secrets\.)|\$\{|\$\(|\{\{|\}\}")
_DIGEST = re.compile(r"(?i)^(?:sha(?:1|224|256|384|512)?|md5|blake2[bs]?|crc32)[:$-]|^\$(?:1|2[aby]|5|6|argon2id?)\$|^https?://|^ssh-(?:rsa|ed25519|dss) |BEGIN (?:\w+ )*(?:PUBLIC KEY|CERTIFICATE)")

#: Four consonants in a row: words run together seldom have them, random letters mostly do.
_CLUSTER = re.compile(r"(?i)[b-df-hj-np-tv-xz]{4}")
#: Every name above contains one of these; plain substring search finds them.
_STEMS = ("pass", "pwd", "pw", "secret", "token", "key", "auth", "credential", "bearer", "jwt", "contrase", "clave", "kennwort", "mot_de", "motde", "mdp", "senha", "пароль", "токен", "密码", "口令", "密钥", "令牌", "パスワード")
_TAIL = re.compile(r"[\w-]*")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[-.\s]+|_+")
_ENDS = re.compile(rf"(?:^|_)(?:{'|'.join(sorted(_NAMES, key=len, reverse=True))})$")
#: Between a name and its value: what may close the name, a type annotation, and the separator.
_BETWEEN = re.compile(
    r"""(?P<close>\\?["'`]?\]?)[ \t]*
        (?:(?P<typed>\??:[ \t]*[A-Za-z_][\w.<>\[\]|, ]{0,40}?[ \t]*=(?![=>]))|(?P<sep>=>|:=|\?=|\+=|=(?![=~])|:(?!:)|\(|,)|(?P<gap>[ \t]+(?=[^\s=:|&<>])))
        [ \t]*(?:\n[ \t]*(?=["'`]))?(?:\([ \t]*)?(?P<prefix>[brfuBRFU]{1,2}(?=["']))?""",
    re.X,
)
_QUOTED = re.compile(r"""(?P<esc>\\)?(?P<q>"{3}|'{3}|["'`])(?P<v>(?(esc)(?:(?!\\(?P=q))[\s\S])|(?:\\.|(?!(?P=q))[\s\S]))*?)(?(esc)\\)(?P=q)""")
_DEFAULT = re.compile(r":?[-=][\"']?(?P<v>[^}\"'\s]+)")
_BARE = re.compile(r"[^\s\"'`]+")
_SCHEME = re.compile(r"(?i)(?:Bearer|Token|Basic|ApiKey|Api-Key|Digest|Key|Negotiate|AWS4-HMAC-SHA256)[ \t]+(?=\S)")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@\"'`<>]*:(?P<v>[^\s/@\"'`<>]+)@(?=[\w\[$<{])")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_LOGIN = re.compile(r"(?:^|[ \t])(?:-u|--user|--basic)[ =][\"']?[^\s:\"'$]+:(?P<v>[^\s\"'@]+)")
_TOOLS = ("sshpass", "mysql", "mongo", "redis-cli", "ldapsearch")
_CLI = re.compile(r"(?:sshpass|mysql|mysqldump|mongo|redis-cli|ldapsearch)\b[^\n|;&]*?[ \t](?:-p|-w|-a)[ ]?[\"']?(?P<v>[^\s\"'-][^\s\"']*)")


def _stem_ends(low: str) -> list[int]:
    """Where the stems end in a lower-case text, in order."""
    ends = set()
    for stem in _STEMS:
        at = low.find(stem)
        while at >= 0:
            ends.add(at + len(stem))
            at = low.find(stem, at + len(stem))
    return sorted(ends)


@lru_cache(maxsize=65_536)
def names_credential(name: str) -> bool:
    """Whether the last words of an identifier name a credential."""
    words = _CAMEL.sub("_", name.strip("-_.")).lower().strip("_")
    words = re.sub(r"[\d_]+$", "", words)
    return bool(_ENDS.search(words)) and not re.search(r"(?:^|_)(?:public|no|without|skip|use|is|has|max|min|num|count|next|csrf_name)_", words + "_")


def is_credential(value: str, bare: bool) -> bool:
    """Whether a literal may be a working credential: no placeholder, reference, digest or plain word."""
    if len(value) < 6 or _REFERENCE.search(value) or _DIGEST.search(value) or _PLACEHOLDER.search(value):
        return False
    if len(set(value)) < 4 or any(c in value for c in "\n\r") or " " in value.strip():
        return False
    digits, letters = any(c.isdigit() for c in value), any(c.isalpha() for c in value)
    if bare and re.fullmatch(r"[A-Za-z_][\w.]*(?:\(.*|\[.*)", value):  # a call or an index
        return False
    if digits and (letters or len(value) >= 8):
        return True
    mixed = any(c.islower() for c in value) and any(c.isupper() for c in value)
    turns = sum(a.isupper() != b.isupper() for a, b in zip(value, value[1:], strict=False))
    return letters and len(value) >= 8 and (mixed and (len(value) >= 20 or value.isalpha() and (turns >= 5 or turns >= 3 and _CLUSTER.search(value))) or not re.fullmatch(r"[\w .,/-]+", value) and not re.search(r"[(){}\[\]]", value))


class Segments:
    """Where a text is code, comment, literal or plain. Without a language all of it is plain."""

    def __init__(self, text: str, code: str | None):
        self.regions = regions(text, code) if code else []
        self.starts = [r.start for r in self.regions]
        self.code = code

    def at(self, place: int) -> tuple[str, int, int]:
        """``(kind, start, end)`` of the segment of a place; code segments end where the next region's
        content begins."""
        if not self.code:
            return "plain", 0, 1 << 62
        i = bisect_right(self.starts, place) - 1
        if i >= 0 and place < self.regions[i].end:
            return self.regions[i].kind, self.regions[i].start, self.regions[i].end
        return "code", self.regions[i].end if i >= 0 else 0, self.starts[i + 1] if i + 1 < len(self.starts) else 1 << 62

    def literal(self, place: int) -> tuple[int, int] | None:
        """The content of the literal whose opening delimiter is at a place of code."""
        i = bisect_right(self.starts, place)
        for r in self.regions[i : i + 1]:
            if r.kind == "literal" and r.start - place <= 3:
                return r.start, r.end
        return None


def find(text: str, code: str | None = None) -> list[tuple[int, int]]:
    """Spans of the credentials of a text, in order and apart. With a language the text is divided
    into code, comments and literals first. In code a value is the literal token that is assigned or
    passed to the identifier (in shell code a word too); in comments, literals and plain text it is
    the quoted part or the word that follows."""
    spans = [m.span() for m in _PRIVATE.finditer(text)] if "PRIVATE KEY" in text else []
    if "://" in text:
        spans += [m.span("v") for m in _URL.finditer(text) if is_credential(m["v"], False) or (len(m["v"]) >= 6 and not _REFERENCE.search(m["v"]) and not _PLACEHOLDER.search(m["v"]) and not m["v"].isdigit())]
    if "-u" in text or "--user" in text:
        spans += [m.span("v") for m in _LOGIN.finditer(text) if is_credential(m["v"], False)]
    if any(tool in text for tool in _TOOLS):
        spans += [m.span("v") for m in _CLI.finditer(text) if is_credential(m["v"], False)]
    size, done = len(text), 0
    low = text.lower()
    if len(low) != size:  # a few letters change their length
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    ends = _stem_ends(low)
    parts = Segments(text, code) if ends else None
    for stem_end in ends:
        if stem_end <= done:
            continue
        kind, low_at, high_at = parts.at(stem_end - 1)
        end = min(_TAIL.match(text, stem_end).end(), high_at)
        start = stem_end
        while start > low_at and start > stem_end - 80 and (text[start - 1].isalnum() or text[start - 1] in "_-"):
            start -= 1
        done = end
        if end - start > 80 or not names_credential(text[start:end]):
            continue
        if text[start - 2 : start] == "${":
            default = _DEFAULT.match(text, end)
            if default:
                spans += _value(text, *default.span("v"), True)
            continue
        # A literal that is nothing but the name is a key: what follows its delimiter is code again.
        is_key = kind == "literal" and start == low_at and end == high_at
        kind = "code" if is_key else kind
        spans += _assigned(text, start, end, kind, code, parts)
    spans.sort()
    apart: list[tuple[int, int]] = []
    for a, z in spans:
        if a < z and (not apart or a >= apart[-1][1]):
            apart.append((a, z))
    return apart


def _assigned(text: str, start: int, end: int, kind: str, code: str | None, parts: Segments) -> list[tuple[int, int]]:
    """The credential that is assigned or passed to the name ``text[start:end]``: the tokens behind it
    are read one by one, what closes the name, a type, a separator, then the value."""
    b = _BETWEEN.match(text, end)
    if not b:
        return []
    gap, sep, close = b["gap"] is not None, b["sep"], b["close"]
    if gap and not text.startswith("--", start) or sep == "," and not close.strip("\\]") or sep == "(" and close:
        return []
    place = b.end()
    if kind == "code":
        literal = parts.literal(place)
        if literal:
            return _value(text, *literal, False)
        if code != BASH:
            return []
    q = _QUOTED.match(text, place)
    if q:
        return _value(text, *q.span("v"), False)
    bare = _BARE.match(text, place)
    if not bare or sep in ("(", ",") or b["typed"]:
        return []
    a, z = bare.span()
    inside = close.startswith("\\") or kind in ("comment", "literal") or kind == "plain" and _quoted_line(text, start)
    for stop in ";&|" if inside or code == BASH or gap else ";":
        cut = text.find(stop, a, z)
        if cut > a and (inside or code == BASH or gap or cut == z - 1):
            z = cut
    while z > a and text[z - 1] in ",)}]>\\":
        z -= 1
    if _SCHEME.match(text, a, len(text)):
        z = len(text) if (line := text.find("\n", a)) < 0 else line
    return _value(text, a, z, True)


def _value(text: str, a: int, z: int, bare: bool) -> list[tuple[int, int]]:
    """The span of the credential within a literal, past an authorization scheme."""
    scheme = _SCHEME.match(text, a, z)
    if scheme:
        m = _BARE.match(text, scheme.end(), z)
        if not m:
            return []
        a, z = m.span()
        while z > a and text[z - 1] in ",;)}]\\":
            z -= 1
        bare = False
    return [(a, z)] if is_credential(text[a:z], bare) and "://" not in text[a:z] else []


def _quoted_line(text: str, at: int) -> bool:
    """Whether a place of a plain text stands behind a comment sign or within quotes of its line, where
    a separator ends a value."""
    head = text[text.rfind("\n", 0, at) + 1 : at]
    opened = head.lstrip()
    if opened[:1] in ("#", "*") or opened[:2] in ("//", "/*") or " # " in head or " // " in head:
        return True
    quote = ""
    for c in head:
        quote = "" if c == quote else quote or (c if c in "\"'`" else "")
    return bool(quote)


def redact(text: str | None, code: str | None = None, mark: str = "REDACTED") -> str | None:
    """The text with each credential's characters replaced wherever they stand, named or not;
    everything else stays as it was."""
    if not text:
        return text
    spans = find(text, code)
    for value in {text[a:z] for a, z in spans if z - a >= 8}:
        at = text.find(value)
        while at >= 0:
            z = at + len(value)
            if not (text[at - 1 : at].isalnum() or text[z : z + 1].isalnum()):
                spans.append((at, z))
            at = text.find(value, z)
    parts, at = [], 0
    for a, z in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            parts += [text[at:a], mark]
            at = z
    return "".join([*parts, text[at:]])


#: What the JVM looks for before a text is handed to Python: a stem or a URL with user information.
_NEAR = "(?i)" + "|".join(_STEMS) + r"|://[^\s/@]*:|-u |--user|" + "|".join(_TOOLS)


def secrets(df: DataFrame, key: str, text: str, path: str | None, language: str | None = None, redacted: bool = False) -> DataFrame:
    """``(rec_id, secret)``, or with ``redacted`` one row ``(rec_id, found, redacted)`` for each
    record that holds a credential. Rows without a credential-like word never leave the JVM."""
    columns = df.select(
        F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), (F.col(path) if path else F.lit(None).cast("string")).alias("p"), (F.col(language) if language else F.lit(None).cast("string")).alias("l")
    ).where(F.col("t").isNotNull() & F.col("t").rlike(_NEAR))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, values, counts = [], [], []
        for k, t, p, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            claim = claimed(p, n)
            code = actual(t, claim) if claim else None
            spans = find(t, code)
            if redacted and spans:
                keys.append(k)
                counts.append(len(spans))
                values.append(redact(t, code))
            elif spans:
                found = list(dict.fromkeys(t[a:z] for a, z in spans))
                keys += [k] * len(found)
                values += found
        if redacted:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int32()), pa.array(values, pa.string())], ["rec_id", "found", "redacted"])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.string())], ["rec_id", "secret"])

    if redacted:
        return map_batches(columns, fn, "rec_id bigint, found int, redacted string").dropDuplicates(["rec_id"])
    return map_batches(columns, fn, "rec_id bigint, secret string").distinct()


def corpus_secrets(excerpts: DataFrame, observations: DataFrame, specs: DataFrame, redacted: bool = False) -> DataFrame:
    """``secrets`` of all three tables, with ``tab`` naming the table."""
    parts = (
        ("excerpt", secrets(excerpts, "excerpt_id", "text", "path", None, redacted)),
        ("observation", secrets(observations, "obs_id", "source_text", "relative_path", "language", redacted)),
        ("spec", secrets(specs, "spec_id", "spec", None, None, redacted)),
    )
    rows = [df.withColumn("tab", F.lit(tab)) for tab, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
