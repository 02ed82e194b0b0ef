"""Comments and literals of source text, and the language that a text is really written in."""

from __future__ import annotations

import re
from typing import NamedTuple

PYTHON, JAVASCRIPT, TYPESCRIPT, BASH = "python", "javascript", "typescript", "bash"
#: Suffix of a path, lower case, to the language that it claims.
SUFFIXES = {".py": PYTHON, ".js": JAVASCRIPT, ".mjs": JAVASCRIPT, ".ts": TYPESCRIPT, ".sh": BASH, ".bash": BASH}
#: Spellings of language names that occur beside the plain ones.
SPELLINGS = {"py": PYTHON, "python3": PYTHON, "js": JAVASCRIPT, "node": JAVASCRIPT, "nodejs": JAVASCRIPT, "mjs": JAVASCRIPT, "ecmascript": JAVASCRIPT, "ts": TYPESCRIPT, "sh": BASH, "shell": BASH, "shellscript": BASH, "zsh": BASH}


class Region(NamedTuple):
    kind: str  # comment or literal
    start: int  # of the content, without delimiters
    end: int


# Each pattern first runs over what can begin no region, which is one fast class loop.
_PY = re.compile(
    r"""[^"'\#]*+(?:
        \#(?P<c>[^\n]*+)
      | \"{3}(?P<d3>(?:[^"\\]++|\\.|"(?!""))*+)(?:"{3}|\Z)
      | '{3}(?P<q3>(?:[^'\\]++|\\.|'(?!''))*+)(?:'{3}|\Z)
      | "(?P<d1>(?:[^"\\\n]++|\\.)*+)(?:"|(?=\n)|\\?\Z)
      | '(?P<q1>(?:[^'\\\n]++|\\.)*+)(?:'|(?=\n)|\\?\Z)
      | \Z)""",
    re.S | re.X,
)
_JS = re.compile(
    r"""[^/"'`]*+(?:
        "(?P<d1>(?:[^"\\\n]++|\\.)*+)(?:"|(?=\n)|\\?\Z)
      | '(?P<q1>(?:[^'\\\n]++|\\.)*+)(?:'|(?=\n)|\\?\Z)
      | `(?P<t>(?:[^`\\$]++|\\.|\$\{(?:[^{}`]++|\{[^{}]*+\}|`[^`]*+`)*+\}|\$)*+)(?:`|\\?\Z)
      | //(?P<c>[^\n]*+)
      | /\*(?P<b>.*?)(?:\*/|\Z)
      | (?:(?<=[(,=:\[!&|?{};+~^>\n])|(?<=[(,=:\[!&|?{};+~^>]\ )|(?<=return\ )|(?<![\s\S]))/(?P<r>(?:[^/\\\[\n]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++)/[a-z]*+
      | /|\Z)""",
    re.S | re.X,
)
_SH = re.compile(
    r"""[^\\\#<'"]*+(?:
        (?:(?<=[\s;&|(])|(?<![\s\S]))\#(?P<c>[^\n]*+)
      | '(?P<q1>[^']*+)(?:'|\Z)
      | "(?P<d1>(?:[^"\\$]++|\\.|\$\((?:[^()"]++|"[^"]*+"|\([^()]*+\))*+\)|\$)*+)(?:"|\\?\Z)
      | (?<!<)<<(?!<)-?[ \t]*(?P<hq>['"]?)(?P<tag>[A-Za-z_]\w*)(?P=hq)[^\n]*\n(?P<h>.*?)(?:^[ \t]*(?P=tag)[ \t]*$|\Z)
      | \\(?P<e>.)
      | [\#<\\]|\Z)""",
    re.S | re.X | re.M,
)
_GROUPS = {
    PYTHON: (_PY, {"c": "comment", "d3": "literal", "q3": "literal", "d1": "literal", "q1": "literal"}),
    JAVASCRIPT: (_JS, {"c": "comment", "b": "comment", "d1": "literal", "q1": "literal", "t": "literal"}),
    BASH: (_SH, {"c": "comment", "h": "literal", "q1": "literal", "d1": "literal"}),
}
_GROUPS[TYPESCRIPT] = _GROUPS[JAVASCRIPT]


def regions(text: str, language: str) -> list[Region]:
    """Comments and literals in order; an unclosed one runs to the end of its line or text."""
    pattern, kinds = _GROUPS[language]
    found = []
    for m in pattern.finditer(text):
        name = m.lastgroup
        kind = kinds.get(name)
        if kind:
            found.append(Region(kind, m.start(name), m.end(name)))
    return found


#: Line beginnings that tell the languages apart; each line counts for one language.
_MARKS = {
    PYTHON: re.compile(r"^[ \t]*(?:def \w+\(.*:|class \w+(?:\(.*\))?:|from [\w.]+ import |import \w+(?:\.\w+)*(?: as \w+)?$|(?:if|for|while|with|elif) .*:$|(?:try|else|finally):$|except\b.*:$|\"{3}|async def |@\w+)", re.M),
    JAVASCRIPT: re.compile(r"^[ \t]*(?:import .* from [\"']|export |(?:async )?function\b|(?:const|let|var) \w+|\}|\} (?:catch|else|finally)|/\*|//|\*/|.*;$)", re.M),
    BASH: re.compile(r"^[ \t]*(?:set -\w|\w+\(\) *\{|fi$|done$|esac$|echo |(?:if|elif) \[|then$|case .* in$|local |readonly |\w+=\"?\$|for \w+ in .*; do|curl |sed |export \w+=|cat <<)", re.M),
}
_SHEBANG = re.compile(r"#![^\n]*?\b(python|node|deno|bash|sh|zsh)")
_TYPED = re.compile(r"^[ \t]*(?:export )?(?:interface|type|enum|declare|namespace|abstract class) \w+|[\w)\]?]: (?:string|number|boolean|any|unknown|void|Record<|Promise<)|\bas (?:any|const|string|number)\b", re.M)


def claimed(path: str | None, language: str | None = None) -> str | None:
    """The language that a path's suffix claims, else the one that is named."""
    dot = (path or "").rfind(".")
    found = SUFFIXES.get(path[dot:].lower()) if dot >= 0 else None
    name = (language or "").strip().lower()
    return found or SPELLINGS.get(name, name if name in _GROUPS else None)


def actual(text: str, claim: str | None) -> str:
    """The language that ``text`` is written in; the claim decides where the text does not."""
    m = _SHEBANG.match(text)
    if m:
        return PYTHON if m[1] == "python" else JAVASCRIPT if m[1] in ("node", "deno") and claim not in (JAVASCRIPT, TYPESCRIPT) else claim if m[1] in ("node", "deno") else BASH
    base = JAVASCRIPT if claim == TYPESCRIPT else claim
    votes = {k: len(p.findall(text)) for k, p in _MARKS.items()}
    best = max(votes, key=lambda k: (votes[k], k == base))
    if base is None or votes[best] > 2 * votes.get(base, 0) + 1:
        if best == JAVASCRIPT:
            return TYPESCRIPT if claim is None and _TYPED.search(text) else claim if base == JAVASCRIPT else JAVASCRIPT
        return best if votes[best] else claim or PYTHON
    return claim
