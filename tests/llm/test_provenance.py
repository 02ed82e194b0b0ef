import random

from marlstone.llm import provenance

LIB = "\n".join(f"def helper_{c}(value, other):\n    total = value + {i * 7} - other\n    return total * other" for i, c in enumerate("abcdefghijklmnopqrst"))
GENERATED = "\n".join(f"class Item{i}(_Base):\n    TAG = {i}\n    def get_{i}(self):\n        return self._f[{i}]" for i in range(20))
DATA = "TABLE = {\n" + "".join(f'  "key{i}x": "value{i * 3}y",\n' for i in range(60)) + "}\n"
MIN = "!function(e,t){" + "".join(f"t.a{i}=function(n){{return n.b{i}?n.c:{i}}};" for i in range(60)) + "}(this,{});\n"
HAND = '"""Reads the open files."""\nimport os\n\n\ndef read(path):\n    with open(path) as handle:\n        return handle.read()\n\n\ndef write(path, text):\n    os.makedirs(os.path.dirname(path))\n    with open(path, "w") as handle:\n        handle.write(text)\n'


def test_composition():
    assert provenance.composed(GENERATED) == "generated" and provenance.composed("# Code generated by x v1. DO NOT EDIT.\n" + HAND) == "generated"
    assert provenance.composed("# Ce fichier est produit automatiquement par x\nx = 1\n") == "generated"
    assert provenance.composed(DATA) == "data" and provenance.composed(MIN) == "minified" and provenance.composed("X = '" + "QUJD" * 300 + "'\n") == "data"
    for text in (HAND, LIB, "", "# This helper generates reports.\n" + HAND, "<!DOCTYPE html>\n<p>x</p>"):
        assert provenance.composed(text) is None


def _table(spark):
    edited = LIB.replace("helper_c", "helper_changed").replace("value + 63", "value + 64")
    rows = [(1, "s1", "code", LIB), (1, "s1", "code", LIB), (2, "s2", "code", edited), (3, "s1", "code", HAND), (4, "s3", "code", GENERATED), (5, "s3", "code", None), (6, None, "code", ""), (7, "s4", "doc", LIB), (8, "s5", "code", DATA), (9, "s6", "code", "# Known v1.2.3\nx = 1\n")]
    return spark.createDataFrame(rows, "file_key bigint, skill_id string, kind string, text string"), spark.createDataFrame([(1, "known", "2.0")], "lib_id int, lib_name string, file_key string")


def test_files(spark):
    excerpts, libs = _table(spark)
    assert {r.file_key: r.kind for r in provenance.not_handwritten(excerpts, libs).collect()} == {1: "vendored", 2: "vendored", 4: "generated", 8: "data", 9: "vendored"}


def test_copies_within_a_repository_do_not_count(spark):
    df = spark.createDataFrame([(1, "s1", "code", LIB), (2, "s1", "code", LIB)], "file_key bigint, skill_id string, kind string, text string")
    assert provenance.not_handwritten(df).collect() == []


def test_containment_is_exact(spark):
    excerpts, _ = _table(spark)
    rows = {r.file_key: r for r in provenance.copies(provenance.files(excerpts)).collect()}

    def windows(text):
        lines = [s.strip() for s in text.split("\n") if len(s.strip()) >= 4]
        return {tuple(lines[i : i + 3]) for i in range(len(lines) - 2)}

    a, b = windows(LIB), windows(LIB.replace("helper_c", "helper_changed").replace("value + 63", "value + 64"))
    assert abs(rows[1].contained - len(a & b) / len(a)) < 1e-9 and rows[2].of == 1


def _best(files):
    """By comparing all pairs: ``{file: (common, share)}`` of the most contained ones."""

    def windows(text):
        lines = [s.strip() for s in text.split("\n") if len(s.strip()) >= provenance.LINE_CHARS]
        return {tuple(lines[i : i + provenance.RUN]) for i in range(len(lines) - provenance.RUN + 1)}

    sets = {k: windows(t) for k, _, t in files}
    out = {}
    for k, repo, _ in files:
        most = max((len(sets[k] & sets[j]) for j, other, _ in files if other != repo), default=0)
        if most >= provenance.LINES and most / len(sets[k]) >= provenance.CONTAINED:
            out[k] = most / len(sets[k])
    return out


def test_a_copy_is_found_whoever_represents_its_lines(spark):
    # Half of file 0 stands in file 1, and each sixth of that half also in two files of their own, of other repositories.
    part = lambda tag, n: [f"line {tag} {i}" for i in range(n)]
    for names in ("abcdefghijklmnop", "ponmlkjihgfedcba", "hgpofeabcdijklnm"):
        shared = part("s", 62)
        files = [(0, names[0], "\n".join(shared + part("own", 60))), (1, names[1], "\n".join(part("x", 10) + shared + part("y", 200)))]
        for k in range(6):
            for side in range(2):
                files.append((2 + 2 * k + side, names[2 + 2 * k + side], "\n".join(shared[k * 10 : k * 10 + 12] + part(f"z{k}{side}", 90))))
        code = spark.createDataFrame(files, "file_key bigint, skill_id string, text string")
        got = {r.file_key: (r.of, r.contained) for r in provenance.copies(code).collect()}
        assert {k: v for k, (_, v) in got.items()} == _best(files) and got[0] == (1, 0.5)


def test_lines_are_the_same_at_any_place_and_indent(spark):
    lines = [f"call {k} of {i}" for i, k in enumerate("abcdefghijklmnopqrstuvwxyz")]
    files = [(1, "s1", "\n".join(lines)), (2, "s2", "class X:\n" + "\n".join("\t  " + x for x in lines))]
    got = {r.file_key: (r.of, r.contained) for r in provenance.copies(spark.createDataFrame(files, "file_key bigint, skill_id string, text string")).collect()}
    assert got == {1: (2, 1.0), 2: (1, 24 / 25)}


def test_every_best_link_of_mixed_files(spark):
    rng = random.Random(5)
    for _ in range(3):
        pieces = [[f"piece {k} line {i}" for i in range(rng.randint(2, 9))] for k in range(14)]
        files = []
        for key in range(60):
            lines = [x for k in rng.choices(range(14), [2**-k for k in range(14)], k=rng.randint(1, 6)) for x in pieces[k]]
            lines += [f"own {key} {i}" for i in range(rng.randint(0, 12))]
            files.append((key, f"s{rng.randint(0, 20)}", "\n".join(lines)))
        code = spark.createDataFrame(files + files[:9], "file_key bigint, skill_id string, text string")
        got = provenance.copies(code).collect()
        assert {r.file_key: r.contained for r in got} == _best(files) and len(got) == len({r.file_key for r in got})
        skill = {k: s for k, s, _ in files}
        assert all(skill[r.of] != skill[r.file_key] for r in got)


def test_empty_tables(spark):
    excerpts, libs = _table(spark)
    assert provenance.not_handwritten(excerpts.limit(0), libs.limit(0)).collect() == []


def test_handwritten_files_without_language_remain(spark):
    excerpts, libs = _table(spark)
    entries = spark.createDataFrame([(k, "s", f"f{k}", language, 1) for k, language in ((1, "python"), (3, None), (3, None), (4, None), (5, "python"), (7, None))], "file_key bigint, skill_id string, relative_path string, language string, size_bytes bigint")
    got = {(r.file_key, r.language, r.chars) for r in provenance.handwritten(entries, excerpts, libs).collect()}
    assert got == {(3, None, len(HAND)), (6, None, 0)}
