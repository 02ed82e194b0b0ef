import itertools
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import evaluation as E
from marlstone.operators import graph as G
from marlstone.operators import relational as R
from marlstone.operators import tri
from marlstone.plans import queries as core

T3 = ("true", "false", "abstain")


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_range_pairs_are_those_of_the_nested_loop(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randint(1, 60), rng.choice(["src", "dst"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, unit string, line int, kind string")
    got = {(r.a.id, r.b.id) for r in R.range_pairs(df.where("kind = 'src'"), df.where("kind = 'dst'"), ["unit"], "line", 8).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[3] == "src" and b[3] == "dst" and a[1] == b[1] and 0 <= b[2] - a[2] <= 8}
    assert "NestedLoop" not in R.range_pairs(df, df, ["unit"], "line", 8)._jdf.queryExecution().toString()


def test_vote_needs_six_tenths_of_distinct_voters(spark):
    rows = [("g", "yes", v) for v in (1, 2, 3)] + [("g", "yes", 3), ("g", "no", 4), ("h", "yes", 1), ("h", "no", 2)]
    got = {r.k: list(r.decided) for r in R.vote(spark.createDataFrame(rows, "k string, o string, v int"), ["k"], "o", "v", 5).collect()}
    assert got == {"g": ["yes"], "h": []}


def test_conflicts_ignore_nulls(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", None), ("c", "y")], "k string, v string")
    assert [(r.k, r.members) for r in R.conflicts(df, ["k"], "v", ("x", "y")).collect()] == [("a", 2)]


def test_rankings(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "xyz"[i % 3]) for i in range(12)], "id int, g string, b string")
    assert R.top_k(df, ["g"], [F.desc("id")], 2).count() == 4
    assert R.top_k(df, ["g"], [F.desc("id")], 0).count() == 0
    turn = R.round_robin(df, ["g"], "b", [F.asc("id")], 4).where("g = 'a'").orderBy("place").collect()
    assert [r.b for r in turn] == ["x", "y", "z", "x"]
    kept = R.budget(df.select("id", "g"), ["g"], "id", F.col("id"), 1, 1, 1).where("g = 'a'").orderBy("id").collect()
    assert [(r.id, r.why) for r in kept] == [(0, "head"), (2, "context"), (8, "context"), (10, "score")]
    shares = R.largest_remainder(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, w int"), "w", 10).collect()
    assert sorted(r.quota for r in shares) == [3, 3, 4]


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r.k, r.side) for r in R.except_both_ways(a, b, ["k"]).collect()} == {(1, "left"), (3, "right")}
    first = R.first_wins(spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, None)], "k string, seq int, v string"), ["k"], ["seq"])
    assert {(r.k, r.v) for r in first.collect()} == {("a", "x"), ("b", None)}
    joined = spark.createDataFrame([("g", 3, "a"), ("g", 1, "b"), ("g", 2, "a")], "g string, seq int, v string").groupBy("g").agg(R.ordered_union("seq", "v").alias("u")).first()
    assert joined.u == ["b", "a"]


@pytest.mark.parametrize("cap,route,res,scp", itertools.product(T3, repeat=4))
def test_authorization_is_the_first_that_is_not_true(spark, cap, route, res, scp):
    want = next((r for r in (cap, route, res, scp) if r != "true"), "true")
    assert _one(spark, tri.authorization(F.lit(cap), F.lit(route), F.lit(res), F.lit(scp), F.lit(True), F.lit(False))) == want


def test_predicate_tables(spark):
    L = F.lit
    assert _one(spark, tri.capability(L(False), L(False), L(False), L(True))) == "abstain" and _one(spark, tri.capability(L(False), L(False), L(True), L(False))) == "false" and _one(spark, tri.capability(L(False), L(True), L(True), L(False))) == "true"
    assert _one(spark, tri.resource(L(True), L(2), L(0), L(0))) == "abstain" and _one(spark, tri.resource(L(True), L(2), L(1), L(1))) == "true" and _one(spark, tri.resource(L(True), L(2), L(1), L(0))) == "false"
    assert _one(spark, tri.scope(L(2), L(2), L(1), L(1))) == "false" and _one(spark, tri.scope(L(2), L(2), L(0), L(2))) == "true" and _one(spark, tri.scope(L(2), L(1), L(0), L(1))) == "abstain" and _one(spark, tri.scope(L(0), L(1), L(0), L(0))) == "abstain"
    assert _one(spark, tri.prohibition(L("true"), L(True), L("false"), L("false"))) == "true" and _one(spark, tri.prohibition(L("abstain"), L(True), L("true"), L("true"))) == "abstain" and _one(spark, tri.prohibition(L("true"), L(False), L("false"), L("abstain"))) == "abstain"
    assert _one(spark, tri.path_result(L("true"), L(1), L(1), L(0), L(1), L(1))) == "false" and _one(spark, tri.label(L(0), L(1))) == "exposure-only"


def test_text_functions(spark):
    assert _one(spark, X.tokens(F.lit("The Row_Set reads a FILE, the file"))) == ["row", "set", "reads", "file"]
    assert _one(spark, X.host(F.lit("https://u:p@A.Example:80/x"))) == "a.example" and _one(spark, X.host(F.lit("x"))) is None
    assert _one(spark, X.domain_matches(F.lit("*.a.b"), F.lit("x.a.b"))) and not _one(spark, X.domain_matches(F.lit("*.a.b"), F.lit("a.b")))
    kinds = {"$HOME": "dynamic", "https://a.b/c": "url", "API_KEY": "env", "/tmp/x": "path", "a.example": "domain", "ls -l": "command"}
    assert all(_one(spark, X.resource_kind(F.lit(k))) == v for k, v in kinds.items())
    assert [bool(_one(spark, F.lit(p).rlike(X.glob_regex("src/*.p?")))) for p in ("src/a/b.py", "src/a.p", "xsrc/a.py")] == [True, False, False]


def test_evaluation(spark):
    df = spark.createDataFrame([(True, True)] * 3 + [(True, False)] + [(False, True)] * 2 + [(False, False)], "g boolean, p boolean")
    r = E.prf(df, F.col("g"), F.col("p")).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (3, 2, 1, 0.6, 0.75, 0.666667)
    assert E.prf(df.limit(0), F.col("g"), F.col("p")).first().f1 == 0
    m = E.mcnemar(spark.createDataFrame([(True, False)] * 8 + [(False, True)], "a boolean, b boolean"), F.col("a"), F.col("b")).first()
    assert (m.only_a, m.only_b) == (8, 1) and abs(m.p - 2 * 10 / 512) < 1e-6
    h = E.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double"), "p", ["k"]).orderBy("place").collect()
    assert [(r.k, r.rejected) for r in h] == [("a", True), ("c", False), ("b", False)]
    ci = E.bootstrap(spark.createDataFrame([(float(i % 10),) for i in range(400)], "v double"), "v", 200).first()
    assert ci.rounds == 200 and ci.low < 4.5 < ci.high and ci.high - ci.low < 1.2


def test_mcnemar_of_many_pairs(spark):
    m = E.mcnemar(spark.range(7360).select((F.col("id") < 3600).alias("a"), (F.col("id") >= 3600).alias("b")), F.col("a"), F.col("b")).first()
    assert (m.only_a, m.only_b, m.p) == (3600, 3760, 0.063824)
    for n, least in ((1, 0), (2, 1), (9, 1), (40, 13), (751, 222), (1600, 760), (7360, 3600), (7360, 2198), (20001, 10000)):
        term = total = 1
        for k in range(least):
            term = term * (n - k) // (k + 1)
            total += term
        assert E.exact_p(n, least) == pytest.approx(min(1.0, 2 * total / 2**n), rel=1e-9, abs=1e-300)
    assert E.exact_p(10**8, 49_995_000) == pytest.approx(0.317359, abs=1e-6) and E.exact_p(10**8, 5 * 10**7) == 1


def test_closure_and_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (4, 3), (9, 8), (4, 99)], "src bigint, dst bigint")
    got = {r.node: (r.level, r.parent) for r in G.closure(spark.createDataFrame([(1,)], "node bigint"), edges).collect()}
    assert got == {1: (0, None), 2: (1, 1), 4: (1, 1), 3: (2, 2), 99: (2, 4)}
    assert {r.node: r.root for r in G.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 99: 1, 8: 8, 9: 8}
    assert G.closure(spark.createDataFrame([], "node bigint"), edges).collect() == []


def test_long_paths_and_limits(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(90)], "src bigint, dst bigint")
    assert {r.root for r in G.components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        G.components(edges, rounds=1)
    root = spark.createDataFrame([(80,)], "node bigint")
    assert G.closure(root, edges).count() == 11 and G.closure(root, edges, depth=3).count() == 4
    assert G.closure(root, edges, expand="src <> 82").count() == 3


def test_witnesses_are_minimal(spark):
    rng = random.Random(5)
    for _ in range(30):
        groups = [[rng.choice("abcdef") for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 4))]
        mode, facts = G.smallest_cover(groups)
        least = next(n for n in range(7) if any(all(set(s) & set(g) for g in groups) for s in itertools.combinations("abcdef", n)))
        assert mode == "exact" and len(facts) == least
    assert G.smallest_cover([["a", "b"], ["b"]], exact=1) == ("greedy", ["b"])
    df = spark.createDataFrame([("k", "r1", "a"), ("k", "r1", "b"), ("k", "r2", "b")], "k string, r string, f string")
    assert [(r.key, list(r.facts)) for r in G.witnesses(df, "k", "r", "f").collect()] == [("k", ["b"])]


def test_a_call_that_serves_two_capabilities_is_found_wherever_it_sorts(spark, monkeypatch):
    rows = [("s", c, f"{c[0]}{i:02d}") for c in ("network_request", "shell_exec") for i in range(30)] + [("s", "network_request", "z"), ("s", "shell_exec", "z"), ("s", "shell_exec", None)]
    seen = spark.createDataFrame(rows, "skill_id string, capability string, api_call string")
    monkeypatch.setattr(core, "observed", lambda spark, d: seen)
    assert [(r.key, r.mode, list(r.facts)) for r in core.witness_minimal(spark, "").collect()] == [("s", "exact", ["z"])]


def test_covers_beyond_eighteen_facts_are_exact_and_first_in_order():
    rng = random.Random(7)
    for _ in range(20):
        groups = [sorted({f"f{rng.randrange(24):02d}" for _ in range(rng.randint(4, 9))}) for _ in range(4)]
        facts = sorted(set().union(*groups))
        want = next(list(s) for n in range(5) for s in itertools.combinations(facts, n) if all(set(s) & set(g) for g in groups))
        assert G.smallest_cover(groups) == ("exact", want)


def test_bootstrap_query_has_a_thousand_rounds(spark, monkeypatch):
    monkeypatch.setattr(core, "t", lambda spark, d, name: spark.createDataFrame([(i, i % 10) for i in range(50)], "doc_id long, n_chars long"))
    assert core.bootstrap_ci(spark, "").first().rounds == 1000
