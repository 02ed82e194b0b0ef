import os

import pytest

from marlstone.llm import prose

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return prose.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/source_excerpts.parquet"), 120)


CASES = [
    ("# The scheduler restores the open snapshots after the owner confirms.\nx = 1\n", "python", {"en"}),
    ("/* Der Dienst vergleicht den vollständigen Bericht aus dem Archiv. */\nlet x = 1;\n", "javascript", {"de"}),
    ("echo \"La tarea de fondo lee la carpeta común sin pedir permiso.\"\n", "bash", {"es"}),
    ("cat <<'N'\nLe relecteur trie les pièces jointes inconnues pendant la nuit.\nN\n", "bash", {"fr"}),
    ("x = '\\u6e05\\u7406\\u6b65\\u9aa4\\u4f1a\\u8bfb\\u53d6\\u6743\\u9650\\u6e05\\u5355\\u548c\\u62a5\\u544a'\n", "python", {"zh"}),
    ("// このスキルは変更のたびに足りない項目を保存します。\n// Общий кэш сортирует недостающие слова при заполненном диске.\n", "javascript", {"ja", "ru"}),
    ("cur.execute(\"SELECT depth, owner FROM bundle WHERE title = ? AND kind = ?\")\n# cache = fetch(cache, 56)\nx = 'a short tag'\n", "python", set()),
    ("", "python", set()),
]


@pytest.mark.parametrize("text,language,want", CASES)
def test_languages_of_passages(model, text, language, want):
    parts = prose.passages_in(text, language)
    got = {lang for part, path in zip(parts, prose.decode(model, parts)) for lang, _ in prose.spans(part, path)}
    assert got == want


def test_held_out_documents(spark, model):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) between 80 and 600 and lang in ('en', 'de', 'fr', 'es', 'ru', 'zh', 'ja')").orderBy("doc_id").limit(300).collect()
    right = 0
    for r, path in zip(rows, prose.decode(model, [r.text for r in rows])):
        found = {}
        for lang, n in prose.spans(r.text, path):
            found[lang] = found.get(lang, 0) + n
        right += bool(found) and max(found, key=found.get) == r.lang
    assert right >= 0.95 * len(rows)


def test_decoding_is_the_brute_force_best_path(model):
    import itertools

    text = "ab 清"
    scores = model.emissions(prose._codes(text))
    best = max(itertools.product(range(len(prose.STATES)), repeat=len(text)), key=lambda p: sum(float(scores[i, s]) for i, s in enumerate(p)) - prose.SWITCH * sum(a != b for a, b in zip(p, p[1:])))
    assert tuple(prose.decode(model, [text])[0]) == best


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_blocks_do_not_change_the_path(model, monkeypatch, block):
    texts = ["The loader reads 12 open files. 清理步骤会读取权限清单和报告", "x = 1; y = fetch(x)", "清", "Der Dienst vergleicht den Bericht."]
    whole = [p.tolist() for p in prose.decode(model, texts)]
    monkeypatch.setattr(prose, "BLOCK", block)
    assert [p.tolist() for p in prose.decode(model, texts)] == whole


def test_tables(spark, model):
    rows = [(1, CASES[0][0], "a.py", "code", "x"), (1, CASES[0][0], "a.py", "code", "x"), (2, None, "b.js", "code", "x"), (3, "", None, "code", None), (4, CASES[1][0], "c.py", "code", None), (5, CASES[0][0], "d.py", "doc", None)]
    excerpts = spark.createDataFrame(rows, "excerpt_id bigint, text string, path string, kind string, t string")
    seen = spark.createDataFrame([(7, CASES[2][0], None, None), (8, None, "a.sh", "sh")], "obs_id bigint, source_text string, relative_path string, language string")
    got = {(r.tab, r.rec_id, r.lang) for r in prose.corpus_prose(None, excerpts, seen, model).collect()}
    assert got == {("excerpt", 1, "en"), ("excerpt", 4, "de"), ("observation", 7, "es")}
    assert prose.corpus_prose(None, excerpts.limit(0), seen.limit(0), model).collect() == []


def test_values_keep_their_places():
    for text, language, _ in [*CASES, ("x = ('one \\u00e9 two three ${four} five'\n     'six seven')\n", "python", None), ("/**\n * One two three\n * four five six.\n */\n", "javascript", None)]:
        for value, kind, places in prose._held(text, language):
            same, at, to = prose.places_of(text, kind, places)
            assert same == value and len(at) == len(to) == len(value)
            assert all(text[a:b] == c or text[a] in "\\$\n" or c == " " for a, b, c in zip(at, to, value))


def test_passages_come_out_with_text_place_and_share(spark, model):
    escaped = "x = '\\u6e05\\u7406\\u6b65\\u9aa4\\u4f1a\\u8bfb\\u53d6\\u6743\\u9650\\u6e05\\u5355\\u548c\\u62a5\\u544a'\n"
    texts = {1: (CASES[0][0] + "y = 2\n" * 5 + CASES[0][0], "s"), 2: (escaped, "s"), 3: ("x = 1\ny = 2\n", "s"), 4: ("x = 1\ny = 2\n", "t")}
    rows = [(i, t, "a.py", "code", s) for i, (t, s) in texts.items()] * 2
    excerpts = spark.createDataFrame(rows, "excerpt_id bigint, text string, path string, kind string, skill_id string")
    seen = spark.createDataFrame([], "obs_id bigint, source_text string, relative_path string, language string")
    found = prose.corpus_prose(None, excerpts, seen, model)
    got = sorted(found.collect(), key=lambda r: (r.rec_id, r.from_char))
    assert [(r.rec_id, r.lang) for r in got] == [(1, "en"), (1, "en"), (2, "zh")]
    for r in got[:2]:
        assert "restores the open snapshots" in r.passage and texts[1][0][r.from_char : r.to_char] == r.passage
    assert got[2].passage == "清理步骤会读取权限清单和报告" and escaped[got[2].from_char : got[2].to_char] == escaped[5:-2]
    shares = {(r.skill_id, r.lang): (r.files, r.code_files, r.mean_share) for r in prose.skill_shares(found, excerpts).collect()}
    assert shares == {("s", "en"): (1, 3, round(got[0].share / 3, 6)), ("s", "zh"): (1, 3, round(got[2].share / 3, 6)), ("t", None): (0, 1, 0.0)}
