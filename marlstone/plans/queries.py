"""The library's queries over the test tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import relational as R
from ..operators import tri
from ..sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def observed(spark: SparkSession, d: str) -> DataFrame:
    """Distinct observations with their capability, call and target."""
    o = t(spark, d, "raw_observations").where("fields is not null")
    return o.select("obs_id", "skill_id", "file_key", "relative_path", "line", "unit_id", F.col("fields")["capability"].alias("capability"), F.col("fields")["api_call"].alias("api_call"), F.col("fields")["target"].alias("target")).dropDuplicates(["obs_id"])


_OBS = """obs as (select obs_id, any_value(skill_id) as skill_id, any_value(file_key) as file_key, any_value(relative_path) as relative_path, any_value(line) as line, any_value(unit_id) as unit_id,
    any_value(fields['capability']) as capability, any_value(fields['api_call']) as api_call, any_value(fields['target']) as target from raw_observations where fields is not null group by obs_id)"""
_FAMILY = "case " + " ".join(f"when {{0}} = '{k}' then '{v}'" for k, v in X.FAMILIES.items()) + " else 'other' end"
_STRATUM = "case when lower(trim({0})) in ('med','medium','mid') then 'medium' when lower(trim({0})) in ('hi','high') then 'high' when lower(trim({0})) in ('lo','low') then 'low' else coalesce(lower(trim({0})), 'unstratified') end"
_TOKENS = f"list_distinct([x for x in regexp_extract_all(lower(replace({{0}}, '_', ' ')), '[a-z0-9]+') if length(x) >= 3 and x not in ({_quoted(X.STOP)})])"


# --- paths and bridges ------------------------------------------------------------------------------
@query("""
with e as (select event_id, user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as pos from events),
p as (select s.user_id, s.event_type as source, k.event_type as sink, s.pos as sp, k.pos as kp, s.event_id as se, k.event_id as ke
      from e s join e k on s.user_id = k.user_id and k.pos - s.pos between 0 and 8 and s.event_id <> k.event_id
      where s.event_type in ('view', 'click', 'signup') and k.event_type in ('purchase', 'error')),
b as (select *, row_number() over (partition by user_id, source, sink order by sp, kp, se, ke) as r from p)
select source, sink, cast(count(*) as bigint) as users, cast(min(kp - sp) as bigint) as min_gap, round(avg(kp - sp), 6) as mean_gap from b where r = 1 group by source, sink
""")
def risk_path_pairs(spark, d):
    """J7 on events: per user the first source-to-sink pair within eight positions, by kinds."""
    e = t(spark, d, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")).select("user_id", "event_id", "event_type", "pos")
    pairs = R.range_pairs(e.where(F.col("event_type").isin("view", "click", "signup")), e.where(F.col("event_type").isin("purchase", "error")), ["user_id"], "pos", 8).where("a.event_id <> b.event_id")
    rows = pairs.select("user_id", F.col("a.event_type").alias("source"), F.col("b.event_type").alias("sink"), (F.col("b_at") - F.col("a_at")).alias("gap"), "a_at", "b_at", F.col("a.event_id").alias("ae"), F.col("b.event_id").alias("be"))
    best = R.best_of_group(rows, ["user_id", "source", "sink"], [F.col("a_at"), F.col("b_at"), F.col("ae"), F.col("be")], ["gap"])
    return best.groupBy("source", "sink").agg(F.count("*").alias("users"), F.min("gap").alias("min_gap"), F.round(F.avg("gap"), 6).alias("mean_gap"))


@query(f"""
with {_OBS}, p as (select a.skill_id, a.capability as source, b.capability as sink from obs a join obs b on a.file_key = b.file_key and a.line > 0 and b.line > 0 and b.line - a.line between 0 and 8 and a.obs_id <> b.obs_id
  where a.capability in ({_quoted(X.SOURCES)}) and b.capability in ({_quoted(X.SINKS)}))
select source, sink, cast(count(*) as bigint) as pairs, cast(count(distinct skill_id) as bigint) as skills from p group by source, sink
""")
def unit_path_pairs(spark, d):
    """J7 on observations: source before sink in the same file within eight lines."""
    o = observed(spark, d).where("line > 0").select("file_key", "obs_id", "skill_id", "capability", "line")
    pairs = R.range_pairs(o.where(F.col("capability").isin(*X.SOURCES)), o.where(F.col("capability").isin(*X.SINKS)), ["file_key"], "line", 8).where("a.obs_id <> b.obs_id")
    return pairs.groupBy(F.col("a.capability").alias("source"), F.col("b.capability").alias("sink")).agg(F.count("*").alias("pairs"), F.countDistinct("a.skill_id").alias("skills"))


@query(f"""
with {_OBS}, w as (select skill_id, target, count(distinct file_key) filter (capability = 'file_write') as writers, count(distinct file_key) filter (capability = 'file_read') as readers,
   count(distinct file_key) filter (capability in ('file_write', 'file_read')) as files from obs where target is not null and capability in ('file_write', 'file_read') group by 1, 2)
select skill_id, target, cast(writers as bigint) as writers, cast(readers as bigint) as readers, cast(writers * readers - (writers + readers - files) as bigint) as bridges from w where writers * readers > writers + readers - files
""")
def bridge_pairs_artifact(spark, d):
    """Files of a skill that write what another reads. The pairs of a value are counted from its
    distinct writers and readers; a value that a third of the files share emits one row."""
    o = observed(spark, d).where(F.col("target").isNotNull() & F.col("capability").isin("file_write", "file_read"))
    per_file = o.groupBy("skill_id", "target", "file_key").agg(F.max((F.col("capability") == "file_write").cast("int")).alias("w"), F.max((F.col("capability") == "file_read").cast("int")).alias("r"))
    n = per_file.groupBy("skill_id", "target").agg(F.sum("w").alias("writers"), F.sum("r").alias("readers"), F.sum(F.col("w") * F.col("r")).alias("both"))
    return n.withColumn("bridges", F.col("writers") * F.col("readers") - F.col("both")).where("bridges > 0").drop("both")


@query("""
with r as (select user_id, event_id, event_type, ts, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as anchor from events)
select event_type, cast(count(*) as bigint) as events, cast(count(anchor) as bigint) as anchored, cast(count(distinct anchor) as bigint) as anchors from r where event_type <> 'view' group by event_type
""")
def bridge_pair_anchor(spark, d):
    """The nearest view before each other event of the user."""
    e = t(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    rows = e.withColumn("anchor", R.nearest_before(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_id")))
    return rows.where("event_type <> 'view'").groupBy("event_type").agg(F.count("*").alias("events"), F.count("anchor").alias("anchored"), F.countDistinct("anchor").alias("anchors"))


# --- groupings --------------------------------------------------------------------------------------
@query(f"""
with {_OBS}, r as (select *, row_number() over (partition by relative_path, capability, line, unit_id order by case when target is not null then 0 else 1 end, api_call, obs_id) as r,
  count(*) over (partition by relative_path, capability, line, unit_id) as merged from obs)
select relative_path, capability, line, unit_id, obs_id, api_call, cast(merged as bigint) as merged from r where r = 1
""")
def observation_dedup(spark, d):
    """A1: one observation of each path, capability, line and unit, one with a target first."""
    return R.best_of_group(observed(spark, d), ["relative_path", "capability", "line", "unit_id"], [F.when(F.col("target").isNotNull(), 0).otherwise(1), F.col("api_call"), F.col("obs_id")], ["obs_id", "api_call"])


@query("""
with s as (select l_suppkey, l_linestatus, l_returnflag, count(distinct l_linenumber) / 7.0 as agreement from lineitem group by 1, 2, 3)
select l_suppkey, l_linestatus, cast(count(*) filter (agreement >= 0.6) as bigint) as decided, case when count(*) filter (agreement >= 0.6) = 1 then min(l_returnflag) filter (agreement >= 0.6) else 'UNKNOWN' end as verdict, round(max(agreement), 6) as best from s group by 1, 2
""")
def consensus_vote(spark, d):
    """A2: flags that at least six tenths of the distinct passes agree on."""
    rows = R.vote(t(spark, d, "lineitem"), ["l_suppkey", "l_linestatus"], "l_returnflag", "l_linenumber", 7)
    return rows.select("l_suppkey", "l_linestatus", F.size("decided").cast("bigint").alias("decided"), F.when(F.size("decided") == 1, F.get("decided", F.lit(0))).otherwise("UNKNOWN").alias("verdict"), F.round("best", 6).alias("best"))


@query("""
select skill_id, cast(count(*) as bigint) as members from gold_labels group by skill_id having count(*) filter (gold.label = 'violation') > 0 and count(*) filter (gold.label = 'benign') > 0
""")
def conflict_groups(spark, d):
    """A3: skills that hold both a violation and a benign label."""
    return R.conflicts(t(spark, d, "gold_labels").select("skill_id", F.col("gold.label").alias("label")), ["skill_id"], "label", ("violation", "benign"))


@query(f"""
with {_OBS}, g as (select skill_id, api_call, count(distinct target) as targets from obs where target is not null group by 1, 2 having count(distinct target) > 1)
select cast(targets as bigint) as targets, cast(count(*) as bigint) as places from g group by targets
""")
def competing_hypotheses(spark, d):
    """Calls of a skill with more than one distinct target, by the number of targets."""
    o = observed(spark, d).where("target is not null")
    return o.groupBy("skill_id", "api_call").agg(F.countDistinct("target").alias("targets")).where("targets > 1").groupBy("targets").agg(F.count("*").alias("places"))


@query(f"""
with {_OBS}, s as (select skill_id, capability, list_sort(list_distinct(list(case when target is null then 'weak' when target like '$%' then 'partial' else 'strong' end))) as strengths, min(obs_id) as first_id, count(*) as n from obs group by 1, 2)
select skill_id, capability, array_to_string(strengths, ',') as strengths, case when len(strengths) = 1 then strengths[1] else 'mixed' end as support, first_id, cast(n as bigint) as events from s
""")
def finding_merge(spark, d):
    """A5: findings of a skill and capability with their collapsed strength."""
    o = observed(spark, d).withColumn("strength", F.when(F.col("target").isNull(), "weak").when(F.col("target").startswith("$"), "partial").otherwise("strong"))
    rows = o.groupBy("skill_id", "capability").agg(F.sort_array(F.collect_set("strength")).alias("s"), F.min("obs_id").alias("first_id"), F.count("*").alias("events"))
    return rows.select("skill_id", "capability", F.array_join("s", ",").alias("strengths"), R.collapse(F.col("s")).alias("support"), "first_id", "events")


@query(f"""
with {_OBS}, f as (select skill_id, capability, min(obs_id) as seq from obs group by 1, 2)
select skill_id, string_agg(capability, ',' order by seq) as capabilities, cast(count(*) as bigint) as n from f group by skill_id
""")
def union_distinct_ordered(spark, d):
    """Distinct capabilities of a skill in the order of their first observation."""
    first = observed(spark, d).groupBy("skill_id", "capability").agg(F.min("obs_id").alias("seq"))
    return first.groupBy("skill_id").agg(F.array_join(R.ordered_union("seq", "capability"), ",").alias("capabilities"), F.count("*").alias("n"))


# --- text -------------------------------------------------------------------------------------------
@query(f"""
select source, cast(count(*) as bigint) as docs, cast(sum(len({_TOKENS.format("text")})) as bigint) as tokens, cast(max(len({_TOKENS.format("text")})) as bigint) as most from documents where text is not null group by source
""")
def token_profile(spark, d):
    rows = t(spark, d, "documents").where("text is not null").select("source", F.size(X.tokens(F.col("text"))).alias("n"))
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("n").cast("bigint")).alias("tokens"), F.max(F.col("n").cast("bigint")).alias("most"))


@query(f"""
with u as (select unit_key, any_value(skill_id) as skill_id, {_TOKENS.format("any_value(heading_context || ' ' || binding_instruction)")} as toks from code_units where binding_instruction is not null and heading_context is not null group by unit_key),
{_OBS}, c as (select distinct skill_id, api_call from obs where api_call is not null), ct as (select skill_id, api_call, {_TOKENS.format("api_call")} as toks from c),
a as (select skill_id, unit_key, len(toks) as ln, unnest(toks) as tok from u), b as (select skill_id, api_call, len(toks) as rn, unnest(toks) as tok from ct),
m as (select a.skill_id, unit_key as l_id, api_call as r_id, ln, rn, count(*) as shared from a join b using (skill_id, tok) group by all),
s as (select *, round(shared / sqrt(ln * rn), 6) as score from m), r as (select *, row_number() over (partition by skill_id, l_id order by score desc, r_id) as place from s where score >= 0.1)
select skill_id, l_id, r_id, cast(shared as bigint) as shared, score, place from r where place <= 3
""")
def lexical_topk(spark, d):
    """Per code unit the three calls of its skill that its instruction resembles most."""
    u = t(spark, d, "code_units").where("binding_instruction is not null and heading_context is not null").dropDuplicates(["unit_key"])
    u = u.select("skill_id", "unit_key", X.tokens(F.concat_ws(" ", "heading_context", "binding_instruction")).alias("tokens"))
    c = observed(spark, d).where("api_call is not null").select("skill_id", "api_call").distinct().withColumn("tokens", X.tokens(F.col("api_call")))
    return R.similarity_topk(u, c, ["skill_id"], "unit_key", "api_call", 3, 0.1)


@query("""
with q as (select * from embeddings where vec_id % 20 = 0),
n as (select vec_id, label, [cast(x as double) for x in embedding] as v from embeddings),
s as (select a.vec_id as query_id, b.vec_id, b.label, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 4) as cosine from n a join n b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as place from s)
select query_id, vec_id, label, cosine, place from r where place <= 5
""")
def dense_cosine_topk(spark, d):
    """The five nearest vectors of every query vector (ids divisible by 20), against all rows."""
    v = t(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    v = v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("norm").alias("qn"))
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = v.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", "label", F.round(dot / F.col("qn") / F.col("norm"), 4).alias("cosine"))
    return R.top_k(scored, ["query_id"], [F.desc("cosine"), F.asc("vec_id")], 5)


@query()
def hashed_vec_topk(spark, d):
    """Feature hashing of tokens and trigrams into 128 signed buckets; per unit the best two calls of
    its skill. Vectors meet on their buckets."""
    u = t(spark, d, "code_units").where("binding_instruction is not null").dropDuplicates(["unit_key"]).select("skill_id", F.col("unit_key").cast("string").alias("id"), X.tokens(F.col("binding_instruction")).alias("tokens"))
    c = observed(spark, d).where("api_call is not null").select("skill_id", F.col("api_call").alias("id")).distinct().withColumn("tokens", X.tokens(F.col("id")))

    def vectors(df, name):
        grams = F.flatten(F.transform("tokens", lambda w: F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit("^"), w, F.lit("$")), i, 3)))))
        rows = df.select("skill_id", "id", F.explode(grams).alias("g")).select("skill_id", "id", F.xxhash64("g").alias("h"))
        rows = rows.groupBy("skill_id", "id", F.pmod("h", F.lit(128)).alias("bucket")).agg(F.sum(F.when(F.shiftright("h", 40) % 2 == 0, 1.0).otherwise(-1.0)).alias("w")).where("w <> 0")
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("skill_id", "id")))
        return rows.select("skill_id", F.col("id").alias(name), "bucket", (F.col("w") / norm).alias(f"w_{name}"))

    met = vectors(u, "unit").join(vectors(c, "call"), ["skill_id", "bucket"]).groupBy("skill_id", "unit", "call").agg(F.round(F.sum(F.col("w_unit") * F.col("w_call")), 6).alias("cosine"))
    return R.top_k(met.where("cosine >= 0.2"), ["skill_id", "unit"], [F.desc("cosine"), F.asc("call")], 2)


@query(f"""
with u as (select doc_id, source, unnest(regexp_extract_all(text, '{X.URL.replace("'", "''")}')) as url from documents where text is not null)
select source, regexp_extract(lower(url), '{X.HOST}', 1) as host, cast(count(*) as bigint) as urls, cast(count(distinct doc_id) as bigint) as docs from u group by 1, 2
""")
def url_host_profile(spark, d):
    u = t(spark, d, "documents").where("text is not null").select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit(X.URL), F.lit(0))).alias("url"))
    return u.groupBy("source", F.regexp_extract(F.lower("url"), X.HOST, 1).alias("host")).agg(F.count("*").alias("urls"), F.countDistinct("doc_id").alias("docs"))


_GLOBS = ("src/*", "*.py", "*/vendor/*", "hooks/*.sh", "dist/?????.js")


@query("with f as (select distinct file_key, relative_path from file_entries) " + " union all ".join(f"select '{g}' as pattern, cast(count(*) as bigint) as files from f where regexp_matches(relative_path, '{X.glob_regex(g)}')" for g in _GLOBS))
def glob_match(spark, d):
    """Files that each shell pattern matches, in one pass."""
    f = t(spark, d, "file_entries").select("file_key", "relative_path").distinct()
    hits = F.array_compact(F.array(*(F.when(F.col("relative_path").rlike(X.glob_regex(g)), F.lit(g)) for g in _GLOBS)))
    counts = f.select(F.explode(hits).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(g,) for g in _GLOBS], "pattern string")
    return every.join(counts, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("files"))


_KIND = "case when {0} is null then 'none' when starts_with({0}, '$') then 'dynamic' when regexp_matches({0}, '^[a-z]+://') then 'url' when regexp_matches({0}, '^[A-Z][A-Z0-9_]+$') then 'env' when starts_with({0}, '/') or starts_with({0}, './') or starts_with({0}, '~') then 'path' when regexp_matches({0}, '^[a-z0-9-]+(\\.[a-z0-9-]+)+$') then 'domain' else 'command' end"


@query(f"with {_OBS} select capability, {_KIND.format('target')} as kind, cast(count(*) as bigint) as events, cast(count(distinct target) as bigint) as targets from obs group by 1, 2")
def typed_constraint(spark, d):
    """Observed resources by what they name."""
    return observed(spark, d).groupBy("capability", X.resource_kind(F.col("target")).alias("kind")).agg(F.count("*").alias("events"), F.countDistinct("target").alias("targets"))


@query("""
with m as (select distinct obs_id, message from raw_observations where message is not null), e as (select cast(json_extract(props, '$.k') as bigint) as k from events)
select 'message' as part, regexp_extract(message, '^(\\w+) at ', 1) as name, cast(count(*) as bigint) as n, cast(sum(try_cast(regexp_extract(message, ':(\\d+)$', 1) as bigint)) as bigint) as total from m group by 1, 2
union all select 'props', 'k', cast(count(k) as bigint), cast(sum(k) as bigint) from e
""")
def message_kv_parse(spark, d):
    """Messages of the form 'capability at path:line', and JSON properties."""
    m = t(spark, d, "raw_observations").where("message is not null").select("obs_id", "message").distinct()
    parts = m.groupBy(F.lit("message").alias("part"), F.regexp_extract("message", r"^(\w+) at ", 1).alias("name")).agg(F.count("*").alias("n"), F.sum(F.expr(r"try_cast(regexp_extract(message, ':(\\d+)$', 1) as bigint)")).alias("total"))
    k = t(spark, d, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return parts.unionByName(k.agg(F.count("k").alias("n"), F.sum("k").alias("total")).select(F.lit("props").alias("part"), F.lit("k").alias("name"), "n", "total"))


@query("""
with o as (select distinct obs_id, file_key, source_text from raw_observations where source_text <> ''), e as (select file_key, any_value(text) as text from source_excerpts where text is not null group by file_key)
select case when contains(text, source_text) then 'exact' when contains(lower(text), lower(source_text)) then 'folded' else 'absent' end as status, cast(count(*) as bigint) as observations from o join e using (file_key) group by 1
""")
def evidence_ground(spark, d):
    """Observed statements located in their files, exactly or but for case."""
    o = t(spark, d, "raw_observations").where("source_text <> ''").select("obs_id", "file_key", "source_text").distinct()
    e = t(spark, d, "source_excerpts").where("text is not null").select("file_key", "text").dropDuplicates(["file_key"])
    status = F.when(F.col("text").contains(F.col("source_text")), "exact").when(F.lower("text").contains(F.lower("source_text")), "folded").otherwise("absent")
    return o.join(e, "file_key").groupBy(status.alias("status")).agg(F.count("*").alias("observations"))


@query("""
with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as no, unnest(string_split(text, chr(10))) as line from documents where text is not null),
h as (select *, last_value(case when regexp_matches(line, '^#{1,6} ') then line end ignore nulls) over (partition by doc_id order by no rows unbounded preceding) as heading from l)
select case when heading is null then 'none' else regexp_extract(heading, '^(#+)', 1) end as level, cast(count(*) as bigint) as lines, cast(count(distinct doc_id) as bigint) as docs from h where trim(line) <> '' group by 1
""")
def section_context(spark, d):
    """The heading that each line of a document stands under."""
    docs = t(spark, d, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    heading = R.nearest_before(lines, ["doc_id"], ["no"], F.col("line").rlike("^#{1,6} "), F.col("line"))
    rows = lines.withColumn("heading", heading).where(F.trim("line") != "")
    return rows.groupBy(F.coalesce(F.regexp_extract("heading", "^(#+)", 1), F.lit("none")).alias("level")).agg(F.count("*").alias("lines"), F.countDistinct("doc_id").alias("docs"))


@query("""
with l as (select doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 as no, unnest(string_split(text, chr(10))) as line from documents where text is not null),
s as (select *, """ + " + ".join(f"case when contains(lower(line), '{c}') then 2 else 0 end" for c in X.CUES) + """ as score from l),
a as (select *, row_number() over (partition by doc_id order by score desc, no) as in_doc from s where score > 0), b as (select *, row_number() over (partition by source order by score desc, doc_id, no) as place from a where in_doc <= 4)
select source, doc_id, cast(no as integer) as no, cast(score as bigint) as score, cast(place as integer) as place from b where place <= 12
""")
def recall_topk_per_doc(spark, d):
    """Lines with policy cues: at most four of a document, then twelve of a source."""
    lines = t(spark, d, "documents").where("text is not null").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    scored = lines.withColumn("score", X.cue_score(F.col("line")).cast("bigint")).where("score > 0").drop("line")
    four = R.top_k(scored, ["doc_id"], [F.desc("score"), F.asc("no")], 4, "in_doc").drop("in_doc")
    return R.top_k(four, ["source"], [F.desc("score"), F.asc("doc_id"), F.asc("no")], 12).select("source", "doc_id", "no", "score", "place")


# --- rankings ---------------------------------------------------------------------------------------
@query(f"""
with {_OBS}, c as (select skill_id, capability, api_call, count(*) as n, count(target) as aimed from obs group by 1, 2, 3),
s as (select *, 40 * cast(aimed > 0 as int) + 10 * cast(n > 1 as int) + 8 * cast(length(api_call) > 12 as int) as strength from c), r as (select *, row_number() over (partition by skill_id, capability order by strength desc, n desc, api_call) as place from s)
select skill_id, capability, api_call, cast(n as bigint) as n, cast(strength as bigint) as strength, place from r where place <= 8
""")
def candidate_merge_cap(spark, d):
    """A4 and the cap: candidates of a skill and capability merged by call, the strongest eight kept."""
    c = observed(spark, d).groupBy("skill_id", "capability", "api_call").agg(F.count("*").alias("n"), F.count("target").alias("aimed"))
    strength = 40 * (F.col("aimed") > 0).cast("bigint") + 10 * (F.col("n") > 1).cast("bigint") + 8 * F.coalesce((F.length("api_call") > 12).cast("bigint"), F.lit(0))
    return R.top_k(c.withColumn("strength", strength).drop("aimed"), ["skill_id", "capability"], [F.desc("strength"), F.desc("n"), F.asc("api_call")], 8)


@query("""
with p as (select event_id, user_id, event_type, value, row_number() over (partition by user_id order by event_id) as pos, row_number() over (partition by user_id order by value desc, event_id) as rnk from events),
c as (select *, cast(pos <= 2 or rnk <= 4 as int) as core from p), n as (select *, max(core) over (partition by user_id order by pos rows between 1 preceding and 1 following) as near from c)
select case when pos <= 2 then 'head' when core = 1 then 'score' else 'context' end as why, cast(count(*) as bigint) as events, cast(sum(event_id) as bigint) as ids from n where near = 1 group by 1
""")
def budget_select(spark, d):
    """The first two events of a user, the four of the highest value, and their neighbours."""
    e = t(spark, d, "events").select("event_id", "user_id", "value")
    rows = R.budget(e, ["user_id"], "event_id", F.col("value"), 2, 4, 1)
    return rows.groupBy("why").agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


@query(f"with {_OBS}, e as (select capability as src, lead(capability) over (partition by file_key order by line, obs_id) as dst from obs where line > 0) select src, dst, cast(count(*) as bigint) as edges from e where dst is not null group by 1, 2")
def step_edges(spark, d):
    """Consecutive observations of a file as edges between capabilities."""
    o = observed(spark, d).where("line > 0").select("file_key", "line", "obs_id", F.col("capability").alias("src"))
    rows = o.withColumn("dst", F.lead("src").over(Window.partitionBy("file_key").orderBy("line", "obs_id"))).where("dst is not null")
    return rows.groupBy("src", "dst").agg(F.count("*").alias("edges"))


@query(f"""
with g as (select label_id, {_STRATUM.format('risk_stratum')} as stratum, coalesce(bucket, 'none') as bucket from gold_labels), r as (select *, row_number() over (partition by stratum, bucket order by label_id) as turn from g),
q as (select *, row_number() over (partition by stratum order by turn, bucket) as place from r where turn <= 20) select stratum, bucket, label_id, place from q where place <= 20
""")
def round_robin_quota(spark, d):
    """Twenty labels of each stratum, one of each bucket in turn."""
    g = t(spark, d, "gold_labels").select("label_id", X.stratum(F.col("risk_stratum")).alias("stratum"), F.coalesce("bucket", F.lit("none")).alias("bucket"))
    return R.round_robin(g, ["stratum"], "bucket", [F.asc("label_id")], 20).select("stratum", "bucket", "label_id", "place")


@query(f"""
with g as (select {_STRATUM.format('risk_stratum')} as stratum, gold.label as label, label_id, row_number() over (partition by {_STRATUM.format('risk_stratum')}, gold.label order by label_id % 97, label_id) as place from gold_labels)
select stratum, label, label_id, place from g where place <= 5
""")
def stratified_quota(spark, d):
    """Five labels of each stratum and label in the order of a hash of their id."""
    g = t(spark, d, "gold_labels").select(X.stratum(F.col("risk_stratum")).alias("stratum"), F.col("gold.label").alias("label"), "label_id")
    return R.top_k(g, ["stratum", "label"], [F.asc(F.col("label_id") % 97), F.asc("label_id")], 5)


@query("""
with c as (select source, count(*) as docs from documents group by source), x as (select *, docs * 100.0 / sum(docs) over () as exact from c), f as (select *, floor(exact) as fl from x),
r as (select *, row_number() over (order by round(exact - fl, 9) desc, source, docs) as place from f) select source, cast(docs as bigint) as docs, cast(fl + case when place <= 100 - sum(fl) over () then 1 else 0 end as bigint) as quota from r
""")
def largest_remainder(spark, d):
    """One hundred places shared among the sources."""
    return R.largest_remainder(t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs")), "docs", 100)


# --- policies and three-valued logic ----------------------------------------------------------------
def permissions(spark: SparkSession, d: str) -> DataFrame:
    """``(skill_id, capability)`` that a skill's latest readable manifest declares; a skill without
    one has none."""
    s = t(spark, d, "skill_specs").select("skill_id", "version", "spec_id", F.try_parse_json("spec").alias("v"))
    s = s.select("skill_id", "spec_id", F.expr("try_variant_get(v, '$.spec.permissions', 'array<string>')").alias("p")).where("p is not null")
    last = s.groupBy("skill_id").agg(F.max_by("p", "spec_id").alias("p"))
    return last.select("skill_id", F.explode("p").alias("capability")).distinct()


_PERM = """perm as (select distinct skill_id, unnest(p) as capability from (select skill_id, arg_max(p, spec_id) as p from (
    select skill_id, spec_id, cast(json_extract(try_cast(spec as json), '$.spec.permissions') as varchar[]) as p from skill_specs) where p is not null group by skill_id))"""


def _judged(spark, d):
    """Events of a skill and capability with capability, resource, scope and route results."""
    o = observed(spark, d).groupBy("skill_id", "capability").agg(
        F.count("*").alias("events"), F.count("target").alias("resources"), F.count_if(F.col("target").isNotNull() & ~F.col("target").startswith("$")).alias("resolved"),
        F.count_if(F.col("target").rlike(r"\.internal\.example|^/tmp/")).alias("matched"), F.count("unit_id").alias("units"),
    ).withColumn("family", X.family(F.col("capability")))
    p = permissions(spark, d)
    own = p.withColumn("same", F.lit(1))
    fam = p.select("skill_id", X.family(F.col("capability")).alias("family")).distinct().withColumn("member", F.lit(1))
    some = p.select("skill_id").distinct().withColumn("policy", F.lit(1))
    rows = o.join(own, ["skill_id", "capability"], "left").join(fam, ["skill_id", "family"], "left").join(some, "skill_id", "left")
    cap = tri.capability(F.col("same").isNotNull(), F.col("member").isNotNull(), F.col("policy").isNotNull() & F.col("member").isNotNull(), F.col("policy").isNull())
    res = tri.resource(F.col("resources") > 0, F.col("resources"), F.col("resolved"), F.col("matched"))
    scp = tri.scope(F.col("resources"), F.col("resolved"), F.col("resolved") - F.col("matched"), F.col("matched"))
    route = F.when(F.col("units") == 0, "false").when(F.col("units") < F.col("events"), "abstain").otherwise("true")
    return rows.select("skill_id", "capability", "events", "resources", cap.alias("cap"), res.alias("res"), scp.alias("scp"), route.alias("route"))


_JUDGED = f"""{_OBS}, {_PERM}, ev as (select skill_id, capability, count(*) as events, count(target) as resources, count(*) filter (target is not null and not starts_with(target, '$')) as resolved,
    count(*) filter (regexp_matches(target, '\\.internal\\.example|^/tmp/')) as matched, count(unit_id) as units from obs group by 1, 2),
j0 as (select ev.*, exists (select 1 from perm p where p.skill_id = ev.skill_id and p.capability = ev.capability) as same, exists (select 1 from perm p where p.skill_id = ev.skill_id and {_FAMILY.format('p.capability')} = {_FAMILY.format('ev.capability')}) as member,
    exists (select 1 from perm p where p.skill_id = ev.skill_id) as policy from ev),
j as (select skill_id, capability, events, resources, case when same or member then 'true' when not policy then 'abstain' else 'false' end as cap,
    case when resources = 0 or resolved = 0 then 'abstain' when matched > 0 then 'true' else 'false' end as res,
    case when resources = 0 or resolved = 0 then 'abstain' when resolved - matched > 0 then 'false' when matched = resources then 'true' else 'abstain' end as scp,
    case when units = 0 then 'false' when units < events then 'abstain' else 'true' end as route from j0)"""
_AUTH = "case when cap <> 'true' then cap when route <> 'true' then route when resources > 0 and res <> 'true' then res when resources > 0 and scp <> 'true' then scp else 'true' end"


@query(f"with {_JUDGED} select capability, cap, cast(count(*) as bigint) as pairs, cast(sum(events) as bigint) as events from j group by 1, 2")
def tri_capability(spark, d):
    return _judged(spark, d).groupBy("capability", "cap").agg(F.count("*").alias("pairs"), F.sum("events").alias("events"))


@query(f"with {_JUDGED} select res, scp, case when cap = 'false' then 'false' when cap = 'abstain' then 'abstain' when resources = 0 or res = 'true' or scp = 'true' then 'true' when res = 'abstain' or scp = 'abstain' then 'abstain' else 'false' end as prohibited, cast(count(*) as bigint) as pairs from j group by 1, 2, 3")
def tri_scope(spark, d):
    j = _judged(spark, d)
    return j.groupBy("res", "scp", tri.prohibition(F.col("cap"), F.col("resources") == 0, F.col("res"), F.col("scp")).alias("prohibited")).agg(F.count("*").alias("pairs"))


def _authorized(spark, d):
    j = _judged(spark, d)
    scp = F.when(F.col("resources") > 0, F.col("scp")).otherwise("true")
    return j.withColumn("auth", tri.authorization(F.col("cap"), F.col("route"), F.col("res"), scp, F.col("resources") > 0, F.lit(False)))


@query(f"with {_JUDGED} select cap, route, {_AUTH} as auth, cast(count(*) as bigint) as pairs from j group by 1, 2, 3")
def tri_authorization(spark, d):
    return _authorized(spark, d).groupBy("cap", "route", "auth").agg(F.count("*").alias("pairs"))


@query(f"with {_JUDGED} select skill_id, string_agg(capability, ',' order by capability) as unsupported, cast(count(*) as bigint) as n from j where capability in ({_quoted(X.SENSITIVE)}) and {_AUTH} = 'false' group by skill_id")
def no_support(spark, d):
    """Sensitive capabilities of a skill without any support."""
    rows = _authorized(spark, d).where(F.col("capability").isin(*X.SENSITIVE) & (F.col("auth") == "false"))
    return rows.groupBy("skill_id").agg(F.array_join(F.sort_array(F.collect_set("capability")), ",").alias("unsupported"), F.count("*").alias("n"))


@query(f"""
with {_JUDGED}, a as (select skill_id, count(*) as events, count(*) filter (capability in ({_quoted(X.SENSITIVE)})) as sensitive, count(*) filter ({_AUTH} = 'false') as contradicted, count(*) filter ({_AUTH} = 'abstain') as partial, min(route) as route from j group by 1)
select case when route <> 'true' then route when sensitive = 0 then 'abstain' when contradicted > 0 then 'false' when partial > 0 then 'abstain' else 'true' end as result, cast(count(*) as bigint) as skills, cast(sum(events) as bigint) as events from a group by 1
""")
def path_justification(spark, d):
    a = _authorized(spark, d).groupBy("skill_id").agg(F.count("*").alias("events"), F.count_if(F.col("capability").isin(*X.SENSITIVE)).alias("sensitive"), F.count_if(F.col("auth") == "false").alias("contradicted"), F.count_if(F.col("auth") == "abstain").alias("partial"), F.min("route").alias("route"))
    result = tri.path_result(F.col("route"), F.col("events"), F.col("sensitive"), F.col("contradicted"), F.lit(0), F.col("partial"))
    return a.groupBy(result.alias("result")).agg(F.count("*").alias("skills"), F.sum("events").alias("events"))


@query(f"with {_JUDGED} select skill_id, string_agg(capability, ',' order by capability) filter ({_AUTH} = 'true') as granted, string_agg(capability, ',' order by capability) filter ({_AUTH} = 'abstain') as review, string_agg(capability, ',' order by capability) filter ({_AUTH} = 'false') as denied from j group by skill_id")
def permission_manifest(spark, d):
    pick = lambda v: F.nullif(F.array_join(F.sort_array(F.collect_list(F.when(F.col("auth") == v, F.col("capability")))), ","), F.lit(""))
    return _authorized(spark, d).groupBy("skill_id").agg(pick("true").alias("granted"), pick("abstain").alias("review"), pick("false").alias("denied"))


@query(f"with {_OBS}, {_PERM} select o.capability as behavior, p.capability as clause, cast(count(*) as bigint) as pairs, cast(count(distinct o.skill_id) as bigint) as skills from (select distinct skill_id, capability, api_call from obs) o join perm p on o.skill_id = p.skill_id and {_FAMILY.format('o.capability')} = {_FAMILY.format('p.capability')} group by 1, 2")
def family_overlap_join(spark, d):
    """Declared capabilities and behaviours of the same skill and family."""
    o = observed(spark, d).select("skill_id", "capability", "api_call").distinct().withColumn("family", X.family(F.col("capability")))
    p = permissions(spark, d).select("skill_id", F.col("capability").alias("clause")).withColumn("family", X.family(F.col("clause")))
    return o.join(p, ["skill_id", "family"]).groupBy(F.col("capability").alias("behavior"), "clause").agg(F.count("*").alias("pairs"), F.countDistinct("skill_id").alias("skills"))


@query("""
with u as (select skill_id, lower(trim(language)) as lang, count(distinct unit_key) as units from code_units where source_doc_id is not null and language is not null group by 1, 2),
o as (select skill_id, lower(trim(any_value(language))) as lang, any_value(fields['capability']) as capability from raw_observations where fields is not null and language is not null group by obs_id, skill_id),
e as (select skill_id, lang, capability, count(*) as events from o group by 1, 2, 3)
select capability, cast(sum(events) as bigint) as events, cast(sum(events * units) as bigint) as pairs, cast(count(distinct skill_id) as bigint) as skills from u join e using (skill_id, lang) group by 1
""")
def link_provenance(spark, d):
    """Units that a document of the skill gives, and what is observed in code of their language. The
    pairs of both are counted from the two sides, so that a hot skill emits one row a capability."""
    u = t(spark, d, "code_units").where("source_doc_id is not null and language is not null").groupBy("skill_id", F.lower(F.trim("language")).alias("lang")).agg(F.countDistinct("unit_key").alias("units"))
    o = t(spark, d, "raw_observations").where("fields is not null and language is not null").dropDuplicates(["obs_id"]).groupBy("skill_id", F.lower(F.trim("language")).alias("lang"), F.col("fields")["capability"].alias("capability")).agg(F.count("*").alias("events"))
    return u.join(o, ["skill_id", "lang"]).groupBy("capability").agg(F.sum("events").alias("events"), F.sum(F.col("events") * F.col("units")).alias("pairs"), F.countDistinct("skill_id").alias("skills"))


@query(f"""
with {_OBS}, v as (select distinct skill_id, capability, target from obs where target is not null and not starts_with(target, '$')), w as (select * from v where capability = 'file_write'), r as (select * from v where capability = 'file_read'),
m as (select w.skill_id, w.target as a, r.target as b from w join r on w.skill_id = r.skill_id and (w.target = r.target or regexp_extract(w.target, '([^/]*)$', 1) = regexp_extract(r.target, '([^/]*)$', 1)))
select skill_id, a, b from m group by all
""")
def literal_overlap_join(spark, d):
    """Written and read resources of a skill that are equal or share a base name; a union of
    equi-joins in place of a theta join."""
    v = observed(spark, d).where("target is not null and not startswith(target, '$')").select("skill_id", "capability", "target").distinct().withColumn("base", X.basename(F.col("target")))
    w = v.where("capability = 'file_write'").select("skill_id", F.col("target").alias("a"), "base")
    r = v.where("capability = 'file_read'").select("skill_id", F.col("target").alias("b"), "base")
    same = w.join(r.drop("base").withColumn("a", F.col("b")), ["skill_id", "a"]).select("skill_id", "a", "b")
    return same.unionByName(w.join(r, ["skill_id", "base"]).select("skill_id", "a", "b")).distinct()


@query("""
with u as (select unit_key, any_value(skill_id) as skill_id, any_value(file_key) as file_key, any_value(source_doc_id) as doc, any_value(binding_instruction) as instr, any_value(heading_context) as head from code_units group by unit_key),
f as (select distinct file_key, skill_id, file_id, relative_path from file_entries),
h as (select u.unit_key, f.file_key, 1 as priority, 'link' as source from u join f on u.file_key = f.file_key union all select u.unit_key, f.file_key, 2, 'block' from u join f on u.skill_id = f.skill_id and u.doc = f.file_id)
select unit_key, file_key, cast(min(priority) as integer) as priority, string_agg(distinct source, ',' order by source) as sources from h group by 1, 2
""")
def alignment_candidates(spark, d):
    """Units and files that meet by link or by block, merged with the least priority."""
    u = t(spark, d, "code_units").dropDuplicates(["unit_key"]).select("unit_key", "skill_id", "file_key", F.col("source_doc_id").alias("file_id"))
    f = t(spark, d, "file_entries").select("file_key", "skill_id", "file_id").distinct()
    link = u.join(f.select("file_key"), "file_key").select("unit_key", "file_key", F.lit(1).alias("priority"), F.lit("link").alias("source"))
    block = u.drop("file_key").join(f, ["skill_id", "file_id"]).select("unit_key", "file_key", F.lit(2).alias("priority"), F.lit("block").alias("source"))
    return link.unionByName(block).groupBy("unit_key", "file_key").agg(F.min("priority").alias("priority"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


# --- evaluation -------------------------------------------------------------------------------------
def predictions(spark, d):
    """Gold labels with the label that the unsupported and the sensitive events of the skill give."""
    a = _authorized(spark, d).groupBy("skill_id").agg(F.count_if(F.col("capability").isin(*X.SENSITIVE) & (F.col("auth") == "false")).alias("v"), F.count_if(F.col("capability").isin(*X.SENSITIVE)).alias("x"))
    g = t(spark, d, "gold_labels").select("label_id", "skill_id", F.col("gold.label").alias("gold"), F.col("gold.violation_subtype").alias("subtype"), X.stratum(F.col("risk_stratum")).alias("stratum"), F.coalesce("bucket", F.lit("none")).alias("bucket"))
    return g.join(a.select("skill_id", tri.label(F.col("v"), F.col("x")).alias("predicted"), "v", "x"), "skill_id", "left")


_PRED = f"""{_JUDGED}, a as (select skill_id, count(*) filter (capability in ({_quoted(X.SENSITIVE)}) and {_AUTH} = 'false') as v, count(*) filter (capability in ({_quoted(X.SENSITIVE)})) as x from j group by 1),
g as (select label_id, l.skill_id, gold.label as gold, gold.violation_subtype as subtype, {_STRATUM.format('risk_stratum')} as stratum, coalesce(bucket, 'none') as bucket, case when v > 0 then 'violation' when x > 0 then 'exposure-only' when v is not null then 'benign' end as predicted, v, x from gold_labels l left join a on l.skill_id = a.skill_id)"""
_PRF = "cast(count(*) filter (p and q) as bigint) as tp, cast(count(*) filter (not p and q) as bigint) as fp, cast(count(*) filter (p and not q) as bigint) as fn, round(coalesce(count(*) filter (p and q) / nullif(count(*) filter (q), 0), 0.0), 6) as precision, round(coalesce(count(*) filter (p and q) / nullif(count(*) filter (p), 0), 0.0), 6) as recall, round(coalesce(2 * count(*) filter (p and q) / nullif(count(*) filter (p) + count(*) filter (q), 0), 0.0), 6) as f1"
_PQ = "select *, gold = 'violation' as p, coalesce(predicted = 'violation', false) as q from g"


def _is(c, v):
    return F.coalesce(F.col(c) == v, F.lit(False))


@query(f"with {_PRED} select {_PRF} from ({_PQ})")
def prf_overall(spark, d):
    return E.prf(predictions(spark, d), _is("gold", "violation"), _is("predicted", "violation"))


@query(f"with {_PRED} select stratum, {_PRF} from ({_PQ}) group by stratum")
def prf_by_group(spark, d):
    return E.prf(predictions(spark, d), _is("gold", "violation"), _is("predicted", "violation"), ["stratum"])


@query(f"with {_PRED} select gold, cast(count(*) filter (predicted = 'violation') as bigint) as violation, cast(count(*) filter (predicted = 'exposure-only') as bigint) as exposure_only, cast(count(*) filter (predicted = 'benign') as bigint) as benign from g group by gold")
def confusion_matrix(spark, d):
    return E.confusion(predictions(spark, d), "gold", "predicted", ["violation", "exposure-only", "benign"])


@query(f"with {_PRED} select stratum, cast(count(*) as bigint) as labels, cast(count(predicted) as bigint) as covered, round(avg(case when gold <> 'violation' then cast(coalesce(predicted = 'violation', false) as int) end), 6) as false_rate, cast(count(*) filter (subtype is not null) as bigint) as typed from g group by stratum")
def boundary_rate(spark, d):
    """Labels, coverage and the rate of false violations of each stratum."""
    p = predictions(spark, d)
    return p.groupBy("stratum").agg(F.count("*").alias("labels"), F.count("predicted").alias("covered"), F.round(F.avg(F.when(F.col("gold") != "violation", _is("predicted", "violation").cast("int"))), 6).alias("false_rate"), F.count("subtype").alias("typed"))


@query(f"with {_PRED} select coalesce(subtype, 'none') as subtype, cast(count(*) as bigint) as labels, cast(count(*) filter (v > 0) as bigint) as found, cast(count(*) filter (x > 0) as bigint) as exposed, round(count(*) filter (v > 0) / count(*), 6) as yield from g group by 1")
def discovery_yield(spark, d):
    p = predictions(spark, d)
    return p.groupBy(F.coalesce("subtype", F.lit("none")).alias("subtype")).agg(F.count("*").alias("labels"), F.count_if(F.col("v") > 0).alias("found"), F.count_if(F.col("x") > 0).alias("exposed"), E.ratio(F.count_if(F.col("v") > 0), F.count("*")).alias("yield"))


@query("select distinct b.skill_id, b.version from source_bundles b where not exists (select 1 from gold_labels g where g.source_hash = b.source_hash)")
def coverage_antijoin(spark, d):
    """Bundles without a label."""
    b, g = t(spark, d, "source_bundles"), t(spark, d, "gold_labels")
    return b.join(g.select("source_hash").distinct(), "source_hash", "left_anti").select("skill_id", "version").distinct()


@query(f"with {_PRED} select subtype, stratum, cast(count(*) as bigint) as labels, round(avg(v), 6) as mean_unsupported from (select coalesce(subtype, 'none') as subtype, stratum, v from g) group by rollup (subtype, stratum)")
def fidelity_rollup(spark, d):
    p = predictions(spark, d).withColumn("subtype", F.coalesce("subtype", F.lit("none")))
    return p.rollup("subtype", "stratum").agg(F.count("*").alias("labels"), F.round(F.avg("v"), 6).alias("mean_unsupported"))


@query("""
with s as (select 'source' as section, source as label, n_chars from documents union all select 'lang', coalesce(lower(substr(lang, 1, 2)), 'none'), n_chars from documents union all select 'skill', case when skill_id is null then 'without' else 'with' end, n_chars from documents)
select section, label, cast(count(*) as bigint) as docs, round(avg(n_chars), 6) as mean_chars from s group by 1, 2 having count(*) >= 3
""")
def profile_grouping(spark, d):
    """Stacked dimensions of the documents, groups of three rows or more."""
    x = t(spark, d, "documents")
    parts = F.array(F.struct(F.lit("source").alias("section"), F.col("source").alias("label")), F.struct(F.lit("lang").alias("section"), F.coalesce(F.lower(F.substring("lang", 1, 2)), F.lit("none")).alias("label")), F.struct(F.lit("skill").alias("section"), F.when(F.col("skill_id").isNull(), "without").otherwise("with").alias("label")))
    rows = x.select("n_chars", F.explode(parts).alias("p")).groupBy(F.col("p.section").alias("section"), F.col("p.label").alias("label"))
    return rows.agg(F.count("*").alias("docs"), F.round(F.avg("n_chars"), 6).alias("mean_chars")).where("docs >= 3")


@query("select source, cast(count(*) as bigint) as n, min(n_chars) as least, round(quantile_cont(n_chars, 0.5), 4) as median, round(quantile_cont(n_chars, 0.9), 4) as p90, max(n_chars) as most from documents group by source")
def distribution_p90(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.round(F.percentile("n_chars", F.lit(0.5)), 4).alias("median"), F.round(F.percentile("n_chars", F.lit(0.9)), 4).alias("p90"), F.max("n_chars").alias("most"))


@query("select o_orderpriority, round(sum(o_totalprice), 2) as total, round(sum(o_totalprice) / sum(sum(o_totalprice)) over (), 6) as share from orders group by 1")
def stage_share(spark, d):
    rows = t(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("s"))
    return rows.select("o_orderpriority", F.round("s", 2).alias("total"), F.round(F.col("s") / F.sum("s").over(Window.partitionBy()), 6).alias("share"))


@query("with c as (select skill_id, gold.label as label, count(*) as n from gold_labels group by 1, 2), s as (select skill_id, sum(n) as labels, max(n) as top from c group by 1) select cast(labels as bigint) as labels, cast(count(*) as bigint) as skills, round(avg(top / labels), 6) as agreement from s where labels >= 2 group by labels")
def agreement_majority(spark, d):
    """Share of the most frequent label among the labels of a skill, by their number."""
    c = t(spark, d, "gold_labels").groupBy("skill_id", F.col("gold.label").alias("label")).agg(F.count("*").alias("n"))
    s = c.groupBy("skill_id").agg(F.sum("n").alias("labels"), F.max("n").alias("top")).where("labels >= 2")
    return s.groupBy("labels").agg(F.count("*").alias("skills"), F.round(F.avg(F.col("top") / F.col("labels")), 6).alias("agreement"))


@query(f"""with {_PRED}, c as (select count(*) filter (coalesce(gold = 'violation', false) = coalesce(v > 0, false) and coalesce(gold = 'violation', false) <> coalesce(x > 0, false)) as a, count(*) filter (coalesce(gold = 'violation', false) <> coalesce(v > 0, false) and coalesce(gold = 'violation', false) = coalesce(x > 0, false)) as b from g)
select cast(a as bigint) as only_a, cast(b as bigint) as only_b, case when a + b = 0 then 1.0 else round(least(1.0, 2 * list_sum([exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - (a + b) * ln(2)) for k in range(0, least(a, b) + 1)])), 6) end as p from c""")
def mcnemar(spark, d):
    """Two systems on the same labels: unsupported events against sensitive ones."""
    p = predictions(spark, d)
    gold = _is("gold", "violation")
    return E.mcnemar(p, gold == F.coalesce(F.col("v") > 0, F.lit(False)), gold == F.coalesce(F.col("x") > 0, F.lit(False)))


@query("""
with p as (select source, 1.0 / (1 + count(*) filter (n_chars > 2000)) as p from documents group by source), r as (select *, row_number() over (order by p, source) as place, count(*) over () as m from p), l as (select *, 0.05 / (m - place + 1) as lim from r)
select source, round(p, 6) as p, cast(place as integer) as place, round(lim, 6) as "limit", min(cast(p <= lim as int)) over (order by p, source rows unbounded preceding) = 1 as rejected from l
""")
def holm(spark, d):
    """Holm's correction over one value for each source."""
    p = t(spark, d, "documents").groupBy("source").agg((1.0 / (1 + F.count_if(F.col("n_chars") > 2000))).alias("p"))
    return E.holm(p, "p", ["source"]).select("source", F.round("p", 6).alias("p"), "place", F.round("limit", 6).alias("limit"), "rejected")


@query()
def bootstrap_ci(spark, d):
    """Interval of the mean length of the documents by 1,000 resampling rounds."""
    return E.bootstrap(t(spark, d, "documents"), "n_chars", rounds=1000, key="doc_id")


# --- graphs -----------------------------------------------------------------------------------------
@query("""
with recursive e as (select p_partkey as dst, p_partkey // 3 as src from part where p_partkey > 1), c(node, level, parent) as (select cast(1 as bigint), 0, cast(null as bigint) union all select e.dst, c.level + 1, e.src from c join e on e.src = c.node)
select level, cast(count(*) as bigint) as nodes, cast(sum(node) as bigint) as ids from c group by level
""")
def reference_closure(spark, d):
    """G1: what the first part reaches over links from a third of each key, by depth."""
    e = t(spark, d, "part").where("p_partkey > 1").select(F.floor(F.col("p_partkey") / 3).cast("bigint").alias("src"), F.col("p_partkey").alias("dst"))
    roots = spark.createDataFrame([(1,)], "node bigint")
    return G.closure(roots, e).groupBy("level").agg(F.count("*").alias("nodes"), F.sum("node").alias("ids"))


@query("""
with l as (select distinct l_orderkey, l_partkey from lineitem) select p.p_brand, cast(count(*) as bigint) as premises, cast(count(distinct o.o_custkey) as bigint) as conclusions from orders o join l on l.l_orderkey = o.o_orderkey join part p on p.p_partkey = l.l_partkey where o.o_orderstatus = 'F' group by 1
""")
def premise_closure(spark, d):
    """Conclusions over judgments to premises, of bounded depth, as unrolled joins."""
    o = t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    l = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).distinct()  # noqa: E741
    p = t(spark, d, "part").select("p_partkey", "p_brand")
    return o.join(l, "o_orderkey").join(p, "p_partkey").groupBy("p_brand").agg(F.count("*").alias("premises"), F.countDistinct("o_custkey").alias("conclusions"))


@query(f"""with recursive {_OBS}, e0 as (select distinct skill_id as s, 'r:' || target as r from obs where target is not null and not starts_with(target, '$')), e as (select s as a, r as b from e0 union select r, s from e0),
w(node, start) as (select a, a from e where not starts_with(a, 'r:') union select e.b, w.start from w join e on e.a = w.node), c as (select start, min(node) as root, count(*) as n from w group by start), d as (select distinct root, n from c)
select cast(n as bigint) as nodes, cast(count(*) as bigint) as components from d group by n""")
def connected_components(spark, d):
    """Skills that share a resolved resource, by the size of their component."""
    o = observed(spark, d).where("target is not null and not startswith(target, '$')").select(F.col("skill_id").alias("src"), F.concat(F.lit("r:"), "target").alias("dst")).distinct()
    return G.components(o).groupBy("root").agg(F.count("*").alias("nodes")).groupBy("nodes").agg(F.count("*").alias("components"))


@query()
def witness_minimal(spark, d):
    """The least set of calls that shows every sensitive capability of a skill."""
    o = observed(spark, d).where(F.col("capability").isin(*X.SENSITIVE))
    return G.witnesses(o, "skill_id", "capability", "api_call")


@query(f"""
with {_OBS}, f as (select skill_id, capability, min(line) filter (line > 0) as first_line from obs group by 1, 2), s as (select skill_id, string_agg(capability, '>' order by first_line, capability) as chain from f where first_line is not null and capability in ('file_read', 'network_request', 'file_write') group by 1)
select chain, cast(count(*) as bigint) as skills from s group by chain
""")
def clause_sequence(spark, d):
    """The order in which a skill's capabilities first appear."""
    f = observed(spark, d).where(F.col("capability").isin("file_read", "network_request", "file_write") & (F.col("line") > 0)).groupBy("skill_id", "capability").agg(F.min("line").alias("seq"))
    return f.groupBy("skill_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "capability"))), lambda s: s["capability"]), ">").alias("chain")).groupBy("chain").agg(F.count("*").alias("skills"))


# --- sets, sources and sinks ------------------------------------------------------------------------
@query("select skill_id, 'left' as side from (select skill_id from gold_labels except select skill_id from skill_specs) union all select skill_id, 'right' from (select skill_id from skill_specs except select skill_id from gold_labels)")
def except_both_ways(spark, d):
    return R.except_both_ways(t(spark, d, "gold_labels"), t(spark, d, "skill_specs"), ["skill_id"])


@query("""
with s as (select spec_id, any_value(try_cast(spec as json)) as j, any_value(spec) as spec from skill_specs group by spec_id)
select case when spec is null then 'null' when j is null then 'broken' else coalesce(json_extract_string(j, '$.spec.runtime'), 'unset') end as runtime, cast(count(*) as bigint) as specs, cast(count(json_extract_string(j, '$.metadata.name')) as bigint) as named, cast(count(json_extract_string(j, '$.spec.env.KNOWFUN_API_KEY')) as bigint) as keyed from s group by 1
""")
def json_variant_normalise(spark, d):
    """Manifests of any shape read as variants."""
    s = t(spark, d, "skill_specs").dropDuplicates(["spec_id"]).select("spec", F.try_parse_json("spec").alias("v"))
    get = lambda p: F.expr(f"try_variant_get(v, '{p}', 'string')")
    runtime = F.when(F.col("spec").isNull(), "null").when(F.col("v").isNull(), "broken").otherwise(F.coalesce(get("$.spec.runtime"), F.lit("unset")))
    return s.groupBy(runtime.alias("runtime")).agg(F.count("*").alias("specs"), F.count(get("$.metadata.name")).alias("named"), F.count(get("$.spec.env.KNOWFUN_API_KEY")).alias("keyed"))


@query("""
select coalesce(f.kind, 'unknown') as kind, cast(count(*) as bigint) as files, cast(count(e.file_key) as bigint) as present, cast(count(*) - count(e.file_key) as bigint) as missing from (select distinct file_key, kind from file_entries) f left join (select distinct file_key from source_excerpts) e on e.file_key = f.file_key group by 1
""")
def completeness_audit(spark, d):
    """Files with and without an excerpt, by kind."""
    f = t(spark, d, "file_entries").select("file_key", "kind").distinct()
    e = t(spark, d, "source_excerpts").select("file_key", F.col("file_key").alias("has")).distinct()
    return f.join(e, "file_key", "left").groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("files"), F.count("has").alias("present"), (F.count("*") - F.count("has")).alias("missing"))


@query("""
with b as (select bundle_id, any_value(prompt_version) as prompt_version from source_bundles group by 1), e as (select excerpt_id, any_value(bundle_id) as bundle_id, any_value(kind) as kind, any_value(path) as path, any_value(text) as text from source_excerpts group by 1),
r as (select e.bundle_id, e.excerpt_id, c.max_source_files, c.max_total_chars, least(length(text), c.max_file_chars) as n, row_number() over (partition by e.bundle_id order by case kind when 'doc' then 0 when 'code' then 1 else 2 end, path, excerpt_id) as place from e join b using (bundle_id) join build_configs c using (prompt_version) where text is not null),
s as (select *, sum(n) over (partition by bundle_id order by place rows unbounded preceding) as upto from r where place <= max_source_files), k as (select *, greatest(0, least(n, max_total_chars - (upto - n))) as kept from s)
select bundle_id, cast(count(*) filter (kept > 0) as bigint) as files, cast(sum(kept) as bigint) as chars, cast(count(*) filter (kept > 0 and kept < n) as bigint) as trimmed from k group by bundle_id
""")
def source_bundle_excerpts(spark, d):
    """The labelling bundle: files in order under caps of a file's and of all characters; the last
    file that fits in part is trimmed."""
    c = t(spark, d, "build_configs").select("prompt_version", "max_file_chars", "max_source_files", "max_total_chars")
    b = t(spark, d, "source_bundles").dropDuplicates(["bundle_id"]).select("bundle_id", "prompt_version")
    e = t(spark, d, "source_excerpts").where("text is not null").select("excerpt_id", "bundle_id", "kind", "path", F.length("text").alias("size")).dropDuplicates(["excerpt_id"])
    r = e.join(b, "bundle_id").join(F.broadcast(c), "prompt_version").withColumn("n", F.least("size", "max_file_chars"))
    by = Window.partitionBy("bundle_id").orderBy(F.when(F.col("kind") == "doc", 0).when(F.col("kind") == "code", 1).otherwise(2), "path", "excerpt_id")
    r = r.withColumn("place", F.row_number().over(by)).where("place <= max_source_files").withColumn("upto", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    r = r.withColumn("kept", F.greatest(F.lit(0), F.least(F.col("n"), F.col("max_total_chars") - (F.col("upto") - F.col("n")))))
    return r.groupBy("bundle_id").agg(F.count_if(F.col("kept") > 0).alias("files"), F.sum("kept").alias("chars"), F.count_if((F.col("kept") > 0) & (F.col("kept") < F.col("n"))).alias("trimmed"))


@query("""
with e as (select excerpt_id, any_value(bundle_id) as bundle_id, any_value(path) as path, any_value(text) as text from source_excerpts group by 1)
select bundle_id, sha256(string_agg(path || chr(0) || sha256(coalesce(text, '')), chr(10) order by path, excerpt_id)) as fingerprint, cast(count(*) as bigint) as files from e group by bundle_id
""")
def package_fingerprint(spark, d):
    """SHA-256 of a bundle's paths and contents in order; whole texts are hashed before the shuffle."""
    e = t(spark, d, "source_excerpts").select("excerpt_id", "bundle_id", "path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).dropDuplicates(["excerpt_id"])
    rows = F.array_sort(F.collect_list(F.struct("path", "excerpt_id", F.concat("path", F.lit("\x00"), "h").alias("line"))))
    return e.groupBy("bundle_id").agg(F.sha2(F.array_join(F.transform(rows, lambda s: s["line"]), "\n"), 256).alias("fingerprint"), F.count("*").alias("files"))


@query("select skill_id, arg_max(version, (spec_id, version)) as version, cast(count(distinct spec_id) as bigint) as versions from skill_specs group by skill_id")
def version_latest(spark, d):
    return t(spark, d, "skill_specs").groupBy("skill_id").agg(F.max_by("version", F.struct("spec_id", "version")).alias("version"), F.countDistinct("spec_id").alias("versions"))


@query()
def markdown_blocks(spark, d):
    """Blocks of the documents of bundles, by kind."""
    docs = t(spark, d, "source_excerpts").where("kind = 'doc' and text is not null").select("excerpt_id", "text").dropDuplicates(["excerpt_id"])
    return readers.markdown_blocks(docs, "excerpt_id", "text").groupBy("kind").agg(F.count("*").alias("blocks"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query("""
with e as (select excerpt_id, any_value(text) as text from source_excerpts where kind = 'doc' and text is not null group by 1), f as (select regexp_extract(text, '^---\\n((?s:.*?))\\n---\\n', 1) as fm from e)
select cast(count(*) filter (fm <> '') as bigint) as with_frontmatter, cast(count(*) as bigint) as docs, cast(count(*) filter (contains(fm, 'description:')) as bigint) as described from f
""")
def frontmatter_slice(spark, d):
    e = t(spark, d, "source_excerpts").where("kind = 'doc' and text is not null").select("excerpt_id", "text").dropDuplicates(["excerpt_id"]).select(readers.frontmatter(F.col("text")).alias("fm"))
    return e.agg(F.count("fm").alias("with_frontmatter"), F.count("*").alias("docs"), F.count_if(F.coalesce(F.col("fm").contains("description:"), F.lit(False))).alias("described"))


@query("select capability, cast(count(*) as bigint) as events, cast(count(*) filter (capability in (" + _quoted(X.SENSITIVE) + ")) as bigint) as sensitive from (with " + _OBS + " select * from obs) group by capability")
def sensitivity_family(spark, d):
    return observed(spark, d).groupBy("capability").agg(F.count("*").alias("events"), F.count_if(F.col("capability").isin(*X.SENSITIVE)).alias("sensitive"))


@query(f"""
with {_OBS}, f as (select skill_id, capability, row_number() over (partition by skill_id order by capability) as r from (select distinct skill_id, capability from obs)), s as (select *, capability in ('network_request', 'code_download') as semantic from f),
c as (select *, min(case when r >= 3 and semantic then r end) over (partition by skill_id) as cutoff from s) select skill_id, cast(count(*) as bigint) as kept from c where r <= coalesce(cutoff, r) group by skill_id
""")
def alignment_cutoff(spark, d):
    """A limit that depends on the data: stop after three hits at the first semantic one."""
    f = observed(spark, d).select("skill_id", "capability").distinct().withColumn("r", F.row_number().over(Window.partitionBy("skill_id").orderBy("capability")))
    cut = F.min(F.when((F.col("r") >= 3) & F.col("capability").isin("network_request", "code_download"), F.col("r"))).over(Window.partitionBy("skill_id"))
    return f.withColumn("cutoff", cut).where("r <= coalesce(cutoff, r)").groupBy("skill_id").agg(F.count("*").alias("kept"))
