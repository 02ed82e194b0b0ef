import fnmatch
import itertools
import json
import random
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from marlstone.functions import rules
from marlstone.operators import behaviour as B
from marlstone.operators import contract as K
from marlstone.operators import reconcile as C
from marlstone.operators import scanners as S
from marlstone.operators import witness as W


def _rows(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.withColumns(columns).collect()]


def _path(target, value):
    t, v = (PurePosixPath(x.replace("\\", "/")).as_posix().lower() for x in (target, value))
    tp, vp = PurePosixPath(t), PurePosixPath(v)
    if t == v:
        return True
    if any(c in t for c in "*?[]"):
        shown = {v, v.lstrip("./"), str(PurePosixPath(*vp.parts[-2:])) if len(vp.parts) > 1 else v, vp.name}
        return any(fnmatch.fnmatchcase(s, p) for s in shown for p in (t, t.lstrip("./")))
    return "/" not in t and tp.name == vp.name or "/" in t and not tp.suffix and v.startswith(t + "/")


def test_paths_match_as_patterns_names_and_folders(spark):
    targets = ["/tmp/*", "/tmp", "./src/*.py", "*.md", "a.py", "src/[ab].py", "src//x/", "SRC\\A.py", "data?/*.csv", "readme", "/tmp/x.d"]
    values = ["/tmp/a", "/tmp", "/tmp/b/c.md", "src/a.py", "./src/a.py", "src/x/y", "A.py", "x/a.py", "data1/z.csv", "README", "/tmp/x.d/e", "/tmpx"]
    pairs = list(itertools.product(targets, values))
    got = _rows(spark, pairs, "t string, v string", m=rules.path_matches(F.col("t"), F.col("v")))
    assert {(r["t"], r["v"]): r["m"] for r in got} == {(a, b): _path(a, b) for a, b in pairs}


@pytest.mark.parametrize("target,value,want", [
    ("*.a.example", "https://x.a.example/p", True), ("*.a.example", "a.example", False), ("a.example", "http://u:p@A.example:80/x", True), ("a.example", "b.a.example", False), ("a*.example", "https://abc.example", True), ("a.example.", "a.example", True), ("x", "", False),
])
def test_domains(spark, target, value, want):
    assert _rows(spark, [(target, value)], "t string, v string", m=rules.domain_matches(F.col("t"), F.col("v")))[0]["m"] is want


def test_constraints_against_resources(spark):
    rows = [("env_glob", "AWS_*", "env_var", "aws_key", True), ("env_var", "HOME", "env_var", "home", True), ("env_var", "HOME", "path", "HOME", False), ("command", "/usr/bin/Git", "command", "git", True), ("command_glob", "pip*", "command", "pip3", True), ("url", "https://a/b", "url", "HTTPS://A/b", True), ("url_glob", "https://a/*", "url", "https://a/c", True), ("query", "select 1", "query", "SELECT 1", True), ("user_input_only", "x", "path", "x", False), ("secret", "k", "secret", "K", True)]
    got = _rows(spark, rows, "ct string, cv string, rt string, rv string, want boolean", m=rules.constraint_matches(*(F.col(c) for c in ("ct", "cv", "rt", "rv"))), a=rules.applies(F.col("ct"), F.col("rt")))
    assert [r["m"] for r in got] == [r["want"] for r in got]
    assert [r["a"] for r in got] == [True, True, False, True, True, True, True, True, True, True]


def test_status_of_scope(spark):
    rows = [("user_input_only", "u", "path", "user_input", True, "file_read", "true"), ("user_input_only", "u", "path", "artifact", True, "file_read", "false"), ("user_input_only", "u", "path", "literal", True, "file_read", "abstain"), ("config_bound", "c", "url", "config_file", True, "file_read", "true"), ("config_bound", "c", "url", "env", True, "file_read", "false"), ("side_effect_bound", "no_network", "path", "literal", True, "http_request", "false"), ("side_effect_bound", "read_only", "path", "literal", True, "file_write", "false"), ("side_effect_bound", "read_only", "path", "literal", True, "file_read", "true"), ("side_effect_bound", "write_only", "path", "literal", True, "sql_exec", "abstain"), ("path", "/x", "path", "literal", False, "file_read", "abstain")]
    got = _rows(spark, rows, "ct string, cv string, rt string, o string, r boolean, cap string, want string", s=rules.constraint_status(F.col("ct"), F.col("cv"), F.col("rt"), F.lit("/x/y"), F.col("o"), F.col("r"), F.col("cap")))
    assert [r["s"] for r in got] == [r["want"] for r in got]


def test_typed_constraints(spark):
    rows = [("env_var_read", "API_KEY", "env_var", "API_KEY"), ("env_var_read", "AWS_*", "env_glob", "AWS_*"), ("http_request", "*.a.example", "domain_glob", "*.a.example"), ("http_request", "https://a.b/c", "url", "https://a.b/c"), ("shell_exec", "python3 x.py --a", "command", "python3"), ("shell_exec", "git*", "command_glob", "git*"), ("shell_exec", "hello there", None, None), ("file_read", "`./data/*.csv`", "path_glob", "./data/*.csv"), ("file_read", "*.md", "file_glob", "*.md"), ("file_read", "*", "path_glob", "*"), ("sql_exec", "select a", "query", "select a"), ("file_read", "only user-provided files", "user_input_only", "user_input_only"), ("http_request", "no network", "side_effect_bound", "no_network"), ("file_write", "does not modify", "side_effect_bound", "read_only"), ("file_read", "listed in x", "config_bound", "listed in x"), ("other", "notes.md", "path", "notes.md"), ("other", "  ", None, None), ("other", None, None, None)]
    got = _rows(spark, rows, "cap string, v string, kind string, val string", c=rules.typed_constraint(F.col("cap"), F.col("v")))
    assert [(r["c"]["kind"], r["c"]["value"]) if r["c"] else (None, None) for r in got] == [(r["kind"], r["val"]) for r in got]


def test_sensitivity(spark):
    rows = [("env_var_read", "getenv HOME_DIR", False), ("env_var_read", "getenv API_KEY", True), ("shell_exec", "python3 scripts/run.py", False), ("shell_exec", "bash -c x.sh", True), ("shell_exec", "rm -rf x", True), ("subprocess_spawn", "npm run build", False), ("http_request", "get", True), ("file_read", "x", False)]
    got = _rows(spark, rows, "cap string, tx string, want boolean", n=rules.needs_authorization(F.col("cap"), F.col("tx"), ("env_var_read", "shell_exec", "subprocess_spawn", "http_request")))
    assert [r["n"] for r in got] == [r["want"] for r in got]


PAYLOADS = [
    ("flat", {"risk_score": 72, "risk_severity": "HIGH", "filtered_findings": [{"rule_id": "R1", "severity": "HIGH", "message": "runs shell", "file": "a.py", "line": 3}]}, ("violation", 1, 72.0), ("unsupported_behavior", "a.py", 3)),
    ("sarif", {"runs": [{"results": [{"ruleId": "T", "level": "error", "message": {"text": "taint from file"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "b.py"}, "region": {"startLine": 7}}}]}]}]}, ("violation", 1, None), ("unjustified_composition", "b.py", 7)),
    ("status", {"status": "done", "max_severity": "MEDIUM", "findings": [{"id": "P", "severity": "MEDIUM", "category": "permission", "message": "too wide"}]}, ("violation", 1, None), ("scope_violation", None, None)),
    ("low", {"findings": [{"rule_id": "L", "severity": "LOW", "message": "note"}]}, ("exposure-only", 1, None), (None, None, None)),
    ("composite", {"findings": [{"severity": "HIGH_RISK"}]}, ("violation", 1, None), ("unsupported_behavior", None, None)),
    ("nested", {"risk_assessment": {"score": 30, "severity": "low"}, "issues": [{"issue_code": "N", "severity": "low", "description": "env", "location": {"file": "c.py", "start_line": 9}}]}, ("exposure-only", 1, 30.0), (None, "c.py", 9)),
    ("twice", {"findings": [{"id": "x", "severity": "low"}], "results": {"findings": [{"severity": "low", "id": "x"}]}}, ("exposure-only", 1, None), (None, None, None)),
    ("top only", {"status": "unsafe"}, ("violation", 0, None), None),
    ("clean", {"findings": []}, ("benign", 0, None), None),
    ("list", [{"id": "z", "severity": "critical"}], ("violation", 1, None), ("unsupported_behavior", None, None)),
]


def test_scanner_payloads(spark):
    df = spark.createDataFrame([(k, json.dumps(p)) for k, p, _, _ in PAYLOADS], "key string, j string").select("key", F.parse_json("j").alias("payload"))
    got = {r.key: (r.label, r.findings, r.score) for r in S.predictions(df).collect()}
    assert got == {k: want for k, _, want, _ in PAYLOADS}
    found = {r.key: (r.subtype, r.path, r.line) for r in S.findings(df).collect()}
    assert found == {k: f for k, _, _, f in PAYLOADS if f}
    assert S.predictions(df.limit(0)).collect() == []


def test_overlaps_are_those_of_the_nested_loop(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abAB/") for _ in range(rng.randint(1, 4)))
    left, right = [("s", word()) for _ in range(40)], [("s", word()) for _ in range(40)]
    name = lambda x: (PurePosixPath(x.lower()).name)
    want = {(a, b) for _, a in left for _, b in right if a.lower() == b.lower() or name(a) and name(a) == name(b) or a.startswith(b) or b.startswith(a)}
    rows = C.overlaps(spark.createDataFrame(left, "k string, a string"), spark.createDataFrame(right, "k string, b string"), ["k"], "a", "b").collect()
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(set(rows))


def _world(spark):
    clauses = spark.createDataFrame([("s", "c1", "file_read", "allowed", "/data", None), ("s", "c2", "file_write", "prohibited", None, None), ("s", "c3", "network_request", "allowed", None, False), ("s", "c4", "file_read", "unknown", None, None)], "skill_id string, clause_id string, capability string, operator string, target string, aligned boolean")
    constraints = spark.createDataFrame([("s", "c1", "k1", "side_effect_bound", "read_only"), ("s", "c2", "k2", "path_glob", "/etc/*")], "skill_id string, clause_id string, constraint_id string, ctype string, cvalue string")
    events = spark.createDataFrame([("s", 1, "u", "file_read", "open", "code", "a.py", 1, None, "file_read"), ("s", 2, "u", "file_write", "put", "code", "a.py", 2, None, "file_write"), ("s", 3, "u", "network_request", "get", "code", "a.py", 3, None, "network_request"), ("s", 4, None, "file_read", "see", "instruction", "b.md", 0, None, "file_read"), ("s", 5, "u", "shell_exec", "sh", "code", "a.py", 5, None, "shell_exec")], "skill_id string, event_id bigint, unit_id string, capability string, api_call string, tier string, file_path string, line int, detail string, family string")
    resources = spark.createDataFrame([("s", 1, 11, "path", "/data/x", True, "literal"), ("s", 2, 12, "path", "/etc/p", True, "literal"), ("s", 4, 14, "path", "<dynamic-path>", False, "unknown")], "skill_id string, event_id bigint, resource_id bigint, rtype string, rvalue string, resolved boolean, origin string")
    return clauses, constraints, events, resources


def test_judgments_edges_and_reports(spark):
    clauses, constraints, events, resources = _world(spark)
    hits = [("s", "c1", 1), ("s", "c2", 2), ("s", "c3", 3), ("s", "c1", 4), ("s", "c4", 1), ("s", "c1", 2)]
    cands = C.candidates(spark.createDataFrame([(*h, "capability") for h in hits], "skill_id string, clause_id string, event_id bigint, source string"))
    j = C.judged(cands, clauses, constraints, events, resources)
    got = {(r.clause_id, r.event_id): (r.cap, r.route, r.res, r.auth, r.reason, r.prohibited) for r in j.collect()}
    assert got["c1", 1] == ("true", "true", "true", "true", None, None)
    assert got["c2", 2][5] == "true" and got["c2", 2][3] is None
    assert got["c3", 3][3:5] == ("abstain", "alignment_mismatch")  # not aligned and without an anchor
    assert got["c1", 4][3:5] == ("abstain", "route_check_abstained")
    # Reading covers the family of writing, but the target is elsewhere: false.
    assert got["c1", 2][2:4] == ("false", "false")
    checks = C.scope_checks(cands, constraints, events, resources)
    assert {(r.event_id, r.result) for r in checks.collect()} == {(1, "true"), (4, "abstain"), (2, "false")}
    e = C.edges(j, checks)
    assert {(r.relation, r.clause_id, r.event_id) for r in e.collect()} == {("supports", "c1", 1), ("contradicts", "c2", 2), ("relates_to", "c4", 1), ("scope_matches", "c1", 1)}
    certs = C.certificates(j, e, events)
    assert {(r.kind, tuple(r.events)) for r in certs.collect()} == {("no_support", (2,)), ("no_support", (5,)), ("blocking_prohibition", (2,))}
    sens = spark.createDataFrame([("s", 1), ("s", 3), ("s", 5)], "skill_id string, event_id bigint")
    assert {(r.finding_type, r.events) for r in C.findings(certs, events, sens).collect()} == {("unsupported_behavior", 1), ("contradicted_behavior", 1)}
    assert [(r.family, r.events) for r in C.exposures(e, certs, events, sens).collect()] == [("file_read", 1)]
    assert {(r.diagnostic_type, r.subject) for r in C.diagnostics(j, e, events, sens).collect()} == {("alignment_mismatch", "c3")}
    paths = spark.createDataFrame([("s", "p1", "true", 1, 2), ("s", "p2", "true", 1, 5), ("s", "p3", "abstain", 1, 3), ("s", "p4", "true", 4, 4)], "skill_id string, path_id string, route string, source_event bigint, sink_event bigint")
    assert {r.path_id: (r.result, r.reason) for r in C.path_judgments(paths, e, sens).collect()} == {"p1": ("false", None), "p2": ("false", None), "p3": ("abstain", "route_check_abstained"), "p4": ("abstain", "open_world_path_only")}
    assert C.judged(cands.limit(0), clauses, constraints, events, resources).collect() == []


def test_candidates_are_merged_and_capped(spark):
    rows = [("s", f"c{i}", 1, "capability") for i in range(12)] + [("s", "c11", 1, "literal_overlap"), ("s", "c11", 1, "literal_overlap")]
    got = C.candidates(spark.createDataFrame(rows, "skill_id string, clause_id string, event_id bigint, source string")).orderBy("place").collect()
    assert len(got) == 8 and got[0].clause_id == "c11" and got[0].strength == 70 and list(got[0].sources) == ["capability", "literal_overlap"]


def test_paths_within_units_are_those_of_the_nested_loop(spark):
    rng = random.Random(9)
    rows = [("u" + rng.choice("ab"), i, rng.choice(["file_read", "env_var_read", "network_request", "shell_exec"]), rng.choice([0, *range(1, 60)])) for i in range(60)]
    src, snk = ("file_read", "env_var_read"), ("network_request", "shell_exec")
    best = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] != b[1] and a[2] in src and b[2] in snk:
                free = 0 in (a[3], b[3])
                if free or 0 <= b[3] - a[3] <= B.GAPS.get((a[2], b[2]), B.GAP):
                    rank = (0 if free else b[3] - a[3], a[1], b[1])
                    key = (a[0], a[2], b[2])
                    best[key] = min(best.get(key, rank), rank)
    got = B.paths_within(spark.createDataFrame(rows, "unit string, event_id bigint, capability string, line int"), src, snk).collect()
    assert {(r.unit, r.source_cap, r.sink_cap): (r.gap, r.source_event, r.sink_event) for r in got} == best


def test_bridges_commands_and_resources(spark):
    files = spark.createDataFrame([("b", 1, "src/main.py", "import helper\nrun('x.sh')\n"), ("b", 2, "src/helper.py", "x = 1"), ("b", 3, "x.sh", ""), ("b", 4, "lib/x.sh", ""), ("c", 5, "helper.py", ""), ("b", 6, "a.js", "import {z} from './lib/util'\n"), ("b", 7, "lib/util.ts", None)], "scope string, file bigint, path string, text string")
    assert {(r.source, r.target, r.kind) for r in B.bridges(files).collect()} == {(1, 2, "static"), (1, 4, "command"), (6, 7, "static")}
    docs = spark.createDataFrame([(9, "Run:\n```bash\n# note\npython3 ./src/main.py --a\n\nbash y/x.sh\nbash gone.sh\n```\n"), (8, None)], "id bigint, text string")
    cmds = B.commands(docs, "id", "text")
    assert sorted((r.key, r.script) for r in cmds.collect()) == [(9, "./src/main.py"), (9, "gone.sh"), (9, "y/x.sh")]
    status = {r.script: r.status for r in B.orchestrations(cmds.withColumn("scope", F.lit("b")), files).collect()}
    assert status == {"./src/main.py": "confirmed", "y/x.sh": "competing", "gone.sh": "unresolved"}
    rows = [("open('config/a.yml')", "file_read"), ("requests.get('https://a.example/x').json()", "http_request"), ("os.getenv('API_KEY')", "env_var_read"), ("cat a > out/b.txt", "shell_exec"), ("f(x)", "file_write"), ("f(x)", "credential_access"), ("", "shell_exec")]
    got = [[(x.rtype, x.value, x.resolved, x.origin) for x in r["r"]] for r in _rows(spark, rows, "t string, c string", r=B.resources_of(F.col("t"), F.col("c")))]
    assert got == [[("path", "config/a.yml", True, "config_file")], [("url", "https://a.example/x", True, "literal")], [("env_var", "API_KEY", True, "env")], [("path", "out/b.txt", True, "artifact")], [("path", "<dynamic-path>", False, "unknown")], [], [("command", "<dynamic-command>", False, "unknown")]]


def test_stored_paths(spark):
    rows = [("E:\\data\\x.json", "/mnt/e/data/x.json"), ("E:/data/", "/mnt/e/data"), ("\\\\wsl.localhost\\Ubuntu\\home\\a", "/home/a"), ("//wsl$/Debian/home/b", "/home/b"), ("/mnt/e/x", "/mnt/e/x"), (" /home/c ", "/home/c"), ("rel/x", "rel/x"), (None, None)]
    assert [r["p"] for r in _rows(spark, rows, "v string, want string", p=B.posix_path(F.col("v")))] == [w for _, w in rows]
    assert [r["p"] for r in _rows(spark, [("E:\\a\\b",), ("/mnt/e/a",), ("/mnt/f/a",)], "v string", p=B.posix_path(F.col("v"), {"E": "/srv/e"}))] == ["/srv/e/a/b", "/srv/e/a", "/mnt/f/a"]


def test_votes_guards_and_tools(spark):
    samples = [("k", "allowed", p) for p in (1, 2, 3)] + [("k", "prohibited", p) for p in (2, 3, 4)] + [("m", "allowed", 1), ("m", "unknown", 1), ("m", "unknown", 2), ("n", "allowed", 1), ("n", "allowed", 1)]
    got = {(r.k, r.operator, r.agreement) for r in K.vote_clauses(spark.createDataFrame(samples, "k string, op string, pass int"), ["k"], "op", "pass", 5).collect()}
    assert got == {("k", "allowed", 0.6), ("k", "prohibited", 0.6), ("m", "unknown", 0.4), ("n", "unknown", 0.2)}
    rows = list(itertools.product(["allowed", "prohibited", "unknown"], [True, False], [True, False]))
    for r in _rows(spark, rows, "o string, s boolean, q boolean", g=K.guard(F.col("o"), F.col("s"), F.col("q"))):
        want = "allowed" if r["q"] and r["o"] == "unknown" and r["s"] else "unknown" if r["q"] and r["o"] == "allowed" and not r["s"] else r["o"]
        assert r["g"] == want
    docs = spark.createDataFrame([(1, "Bash(python3 x.py), Read(/tmp/*), Spawn(), WebFetch(*.a.example)"), (2, None)], "id int, tools string")
    assert [(r.seq, r.capability, r.kind, r.value) for r in K.allowed_tools(docs, "id", "tools").orderBy("seq").collect()] == [(0, "shell_exec", "command", "python3"), (1, "file_read", "path_glob", "/tmp/*"), (2, "shell_exec", None, None), (3, "http_request", "domain_glob", "*.a.example")]
    notes = spark.createDataFrame([(1, "Reads files. Not for secrets or keys. 不用于生产环境。")], "id int, text string")
    assert [(r.excluded, r.start) for r in K.exclusions(notes, "id", "text").orderBy("seq").collect()] == [("secrets or keys", 21), ("生产环境", 41)]
    roles = [("allowed", False, "x", False, "policy"), ("unknown", True, "must read", False, "policy"), ("unknown", False, "plain", False, "knowledge"), ("unknown", True, "an overview", False, "knowledge"), ("unknown", True, "an overview", True, "policy"), ("unknown", True, None, False, "policy")]
    assert [r["x"] for r in _rows(spark, roles, "o string, r boolean, t string, s boolean, w string", x=K.role(F.col("o"), F.col("r"), F.col("t"), F.col("s")))] == [r[4] for r in roles]


def test_masks_come_off_again(spark):
    rng = random.Random(6)
    parts = ["see ", "https://a.example/b_C", "/etc/x", "API_KEY", " ⟦URL⟧ ", "⟦", "⟧", "⟦PATH⟧", "\n", "$1", "./y.py", "AB_CD/EF_GH"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(80)]
    df = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("m", K.masked(F.col("t")))
    rows = df.withColumn("back", K.unmasked(F.col("m"))).collect()
    assert all(r.back == r.t for r in rows) and not any("https://" in r.m.text for r in rows)


def test_steps_and_places(spark):
    doc = "# Use\nRun this command:\n```sh\nls\n```\n- item\nYou must stop.\n\n## Other\nplain words here\n```\nx\n```\n"
    rows = K.steps(spark.createDataFrame([(1, doc), (2, None)], "id int, text string"), "id", "text").orderBy("seq").collect()
    assert [(r.step_type, r.heading, r.bound) for r in rows] == [("heading", "Use", False), ("instruction", "Use", False), ("fence", "Use", True), ("code", "Use", False), ("fence", "Use", False), ("list_item", "Use", False), ("policy", "Use", False), ("heading", "Other", False), ("context", "Other", False), ("fence", "Other", False), ("code", "Other", False), ("fence", "Other", False)]
    got = _rows(spark, [("ab\nCd", "Cd"), ("ab\nCd", "CD"), ("ab", "z")], "t string, p string", x=K.located(F.col("t"), F.col("p")))
    assert [(r["x"]["start"], r["x"]["end"], r["x"]["how"]) for r in got] == [(3, 5, "exact"), (3, 5, "folded"), (None, None, "absent")]
    assert [r["n"] for r in _rows(spark, [("a\nb\nc", 0), ("a\nb\nc", 2), ("a\nb\nc", 4)], "t string, o int", n=K.line_of(F.col("t"), F.col("o")))] == [1, 2, 3]


def test_witnesses(spark):
    roots = spark.createDataFrame([("f", "c1"), ("g", "c2")], "key string, node string")
    needs = spark.createDataFrame([("c1", "j1"), ("j1", "e1"), ("j1", "k1"), ("c2", "j2"), ("j2", "j1")], "src string, dst string")
    w = W.neighborhood(roots, needs)
    assert {(r.key, r.node, r.level) for r in w.collect()} == {("f", "c1", 0), ("f", "j1", 1), ("f", "e1", 2), ("f", "k1", 2), ("g", "c2", 0), ("g", "j2", 1), ("g", "j1", 2), ("g", "e1", 3), ("g", "k1", 3)}
    known = w.select("node").unionByName(spark.createDataFrame([("lone",)], "node string"))
    check = lambda rows: {r.key: r.reason for r in W.validate(rows, roots, needs, known).collect()}
    assert check(w) == {"f": None, "g": None}
    assert check(w.where("node <> 'e1'")) == {"f": "missing:e1", "g": "missing:e1"}
    assert check(w.where("node <> 'c1'"))["f"] == "missing_root:c1"
    extra = w.select("key", "node").unionByName(spark.createDataFrame([("f", "lone"), ("g", "odd")], "key string, node string"))
    assert check(extra) == {"f": "disconnected", "g": "unknown:odd"}
    assert {(r.key, r.node) for r in W.removable(extra, roots, needs).collect()} == {("f", "lone"), ("g", "odd")}
    d = spark.createDataFrame([("d1", "k1"), ("d1", "e1"), ("d2", "c2"), ("d3", "x")], "diagnostic string, node string")
    assert {(r.key, r.diagnostic, r.shared) for r in W.contexts(w, d).collect()} == {("f", "d1", 2), ("g", "d1", 2), ("g", "d2", 1)}
