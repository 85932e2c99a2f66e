"""Queries of site records, validation and run records, each with DuckDB SQL of the same columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkgate.operators import runs, sites, validation
from sparkgate.plans.catalogue import table


#: Order, line, part and supplier tell lines apart; order and line alone don't.
AT = "CAST(((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS BIGINT)"


def found(spark, sf):
    """A record of every line: two in seven are wrapper definitions, files and ids repeat."""
    k = F.col("l_orderkey")
    raw = F.substring(F.sha2((F.col("l_partkey") % 40).cast("string"), 256), 1, 12)
    return table(spark, sf, "lineitem").select(F.expr(AT).alias("at"), F.when(k % 7 < 2, "wrapper_definition").otherwise("occurrence").alias("kind"), F.concat(F.lit("src/f"), F.col("l_suppkey") % 50, F.lit(".py")).alias("file"), (F.col("l_partkey") % 30 + 1).cast("int").alias("line"), F.col("l_quantity").cast("int").alias("byte"), raw.alias("id")).distinct()


FOUND = f"""f AS (
  SELECT DISTINCT {AT} AS "at", CASE WHEN l_orderkey % 7 < 2 THEN 'wrapper_definition' ELSE 'occurrence' END AS kind, 'src/f' || (l_suppkey % 50) || '.py' AS file,
         CAST(l_partkey % 30 + 1 AS INTEGER) AS line, CAST(l_quantity AS INTEGER) AS byte, substr(sha256(CAST(l_partkey % 40 AS VARCHAR)), 1, 12) AS id FROM lineitem)"""


def s03(spark, sf):
    return sites.report(found(spark, sf)).select("at", "unique_id", "position")


def s04(spark, sf):
    return found(spark, sf).groupBy("file").agg(F.count_if(F.col("kind") == "wrapper_definition").alias("wrapper_definitions"), F.count_if(F.col("kind") == "occurrence").alias("occurrences"))


def s05(spark, sf):
    own = found(spark, sf).withColumn("origin", F.when(F.col("at") % 5 == 0, "agent_hook").otherwise("source")).withColumn("id", F.concat(F.when(F.col("origin") == "source", "source:").otherwise("agent:"), F.col("id")))
    return sites.legacy(own).select("at", "id", "file", "line")


def s06(spark, sf):
    k = F.col("p_partkey")
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    tier = F.element_at(F.array(*map(F.lit, ("sure", "likely", "review", "not_decision"))), (k % 4 + 1).cast("int"))
    a = sites.assessed(tier, F.when(k % 3 == 0, texts("a")).otherwise(texts()), F.when(k % 5 == 0, texts("c1", "c2")).otherwise(texts()), F.when(k % 2 == 0, F.array("p_brand", "p_name")), F.when(k % 7 == 0, F.col("p_type")))
    p = table(spark, sf, "part").select("p_partkey", a.alias("a"))
    return p.select("p_partkey", "a.tier", F.array_join("a.reasons", ";").alias("reasons"), F.array_join("a.outputs", ";").alias("outputs"))


def s07(spark, sf):
    k = F.col("p_partkey")
    reasons = F.array_compact(F.array(F.when(k % 2 == 0, "two Free-Text fields"), F.when(k % 3 == 0, "a free-text field"), F.when(k % 5 == 0, "Parameter p: CONFLICT"), F.when(k % 7 == 0, "unresolved name"), F.when(k % 11 == 0, "unresolved parameter")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(sites.review_questions(reasons), ",").alias("questions"))


def drafted(spark, sf):
    k = F.col("p_partkey")
    option = lambda name, d: F.struct(name.alias("name"), d.alias("description"))
    level = lambda v, d: F.struct(v.cast("double").alias("value"), d.alias("description"))
    none = F.lit(None).cast("string")
    shape = F.element_at(F.array(*map(F.lit, ("choice", "yes_no", "labels", "score"))), (k % 4 + 1).cast("int"))
    return table(spark, sf, "part").select(
        k.alias("site"), F.when(k % 3 != 0, F.concat(F.lit("n"), k % 9)).alias("name"), F.when(k % 10 == 0, F.col("p_type")).alias("description"), shape.alias("shape"), (k % 8 == 0).alias("nullable"),
        F.array(option(F.col("p_brand"), F.when(k % 5 != 0, F.col("p_name"))), option(F.lit("x"), none)).alias("options"), F.array(level(F.col("p_size"), none), level(F.lit(99.5), F.col("p_brand"))).alias("levels"),
        F.when(k % 7 != 0, F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \n ")), F.lit("\t"))).alias("prompt"),
    )


def s08(spark, sf):
    return sites.drafts(drafted(spark, sf)).select("site", "key", "kind", "instructions", F.array_join("criteria", ";").alias("criteria"))


def s09(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(sites.snippet(F.col("text"), (F.col("doc_id") % 60).cast("int")), 256).alias("snippet_sha256"))


def s10(spark, sf):
    li = table(spark, sf, "lineitem")
    chain = F.array(F.col("l_returnflag"), F.col("l_linestatus"), F.concat(F.lit("s"), F.col("l_suppkey") % 2), F.concat(F.lit("q"), F.col("l_partkey") % 2))
    cut = F.slice(chain, F.lit(1), (F.lit(4) - F.when(F.col("l_partkey") % 9 == 0, 2).otherwise(0)).cast("int"))
    return sites.divergence(li.select(F.col("l_orderkey").alias("occ"), F.expr(AT).alias("alt"), cut.alias("chain")))


def s11(spark, sf):
    d = table(spark, sf, "documents")
    form = sites.canonical(F.col("source"), F.col("lang"), (F.col("n_chars") % 2).cast("string"), F.lit(None).cast("string"), F.col("text"))
    return d.groupBy(form.alias("c")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).select("first_id", "n")


def s12(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("definition"), F.col("p_partkey").alias("position"), F.concat(F.lit("o"), F.col("p_partkey")).alias("name"), F.element_at(F.array(*map(F.lit, ("choice", "yes_no", "labels", "score"))), (F.col("p_size") % 4 + 1).cast("int")).alias("shape"), F.array("p_brand", "p_type", "p_name").alias("options"))
    return sites.strata(rows, 3)


def v01(spark, sf):
    k = F.col("p_partkey")
    version = F.concat(F.element_at(F.array(*map(F.lit, ("1", "2", "01", "", "1"))), (k % 5 + 1).cast("int")), F.lit("."), k % 3)
    return table(spark, sf, "part").select("p_partkey", validation.version_state(version).alias("version"), F.coalesce(validation.is_registry_id(F.lower("p_brand")), F.lit(False)).alias("bare"), validation.is_registry_id(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))).alias("registry_id"), validation.is_name(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"), validation.is_site_id(F.concat(F.when(k % 2 == 0, "agent:").otherwise("hook:"), F.when(k % 3 != 0, F.col("p_brand")).otherwise(F.lit("a b")))).alias("site_id"))


def v02(spark, sf):
    k = F.col("l_partkey")
    c = lambda m, v, other: F.when(k % m == 0, v).otherwise(other)
    origin = F.element_at(F.array(*map(F.lit, ("source", "agent_hook", "runtime"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    s = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", origin.alias("origin"))
    s = s.withColumns({
        "schema_version": c(29, "1.2", c(31, "x", F.lit("1.1"))), "kind": c(11, "wrapper_definition", F.lit("occurrence")), "id": c(13, F.lit("source:a b"), F.concat(F.element_at(F.array(*map(F.lit, ("source:", "agent:", "runtime:"))), (F.col("l_linenumber") % 3 + 1).cast("int")), k)),
        "has_source": (F.col("origin") == "source") & (k % 17 != 0), "has_agent": (F.col("origin") == "agent_hook") | (k % 19 == 0), "source_revision": F.when((F.col("origin") == "source") & (k % 23 != 0), c(37, F.lit("zz"), F.sha2(k.cast("string"), 256))),
        "provenance": F.when(k % 41 == 0, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>")), "line": (k % 43).cast("int"), "reviewed": k % 2 == 0,
    })
    return s.select("l_orderkey", "l_linenumber", validation.site_problem().alias("problem"))


def v03(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("accepted", "deferred", "error", "lost"))), F.when(k % 53 == 0, 4).otherwise(k % 3 + 1).cast("int"))
    r = e.select("event_id", status.alias("status"))
    s = lambda name: F.col("status") == name
    reason = F.when(s("deferred"), "low_confidence").when(s("error"), "invalid_input")
    r = r.withColumns({
        "protocol_version": F.when(k % 59 == 0, "2").otherwise("1"), "request_id": F.when(k % 7 != 0, k.cast("string")), "site_id": F.when(k % 11 == 0, "nowhere").otherwise("source:x"), "policy_id": F.when(k % 13 == 0, "Bad Id").when(k % 5 != 0, "p1"),
        "evidence": F.lit("measured"), "passed": s("accepted") != (k % 17 == 0), "reasons": F.when(reason.isNotNull() & (k % 19 != 0), F.array(F.when(k % 23 == 0, "timeout").otherwise(reason))).otherwise(F.array().cast("array<string>")), "fallback": ~s("accepted"),
        "provider": F.when(k % 29 == 0, "").when(k % 31 != 0, "m"), "error_code": F.when(s("error"), F.when(k % 37 == 0, "timeout").otherwise("invalid_input")), "error_message": F.when(s("error"), F.repeat(F.lit("x"), F.when(k % 41 == 0, 600).otherwise(5))), "answers": F.array(F.when(k % 43 == 0, "1st").otherwise("route")),
    })
    return r.select("event_id", validation.response_problem().alias("problem"))


def defined(spark, sf):
    """A definition per customer, a question per order of it and an output per line, planted with every broken rule."""
    k = F.col("c_custkey")
    d = table(spark, sf, "customer").select(k.alias("definition"), F.when(k % 31 == 0, "2.0").otherwise("1.0").alias("schema_version"), F.when(k % 37 == 0, "Bad").otherwise(F.concat(F.lit("d"), k)).alias("id"), F.when(k % 41 == 0, "d").otherwise("source:d").alias("site_id"), F.when(k % 43 == 0, "r").when(k % 2 == 0, F.sha2(k.cast("string"), 256)).alias("revision"))
    o = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("choice", "yes_no", "score"))), (o % 3 + 1).cast("int"))
    q = table(spark, sf, "orders").select(F.col("o_custkey").alias("definition"), F.concat(F.lit("q"), o).alias("question"), kind.alias("kind"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("criteria"))
    n, x = F.col("l_linenumber"), F.col("l_partkey")
    shape = F.element_at(F.array(*map(F.lit, ("choice", "yes_no", "score", "labels"))), F.when((o % 3 == 1) & (x % 2 == 0), 4).when(x % 13 == 0, 1).otherwise(o % 3 + 1).cast("int"))
    values = F.when(x % 3 == 0, F.array(F.lit(3.0), F.lit(2.0), F.lit(1.0))).when(x % 11 == 0, F.array(F.lit(1.0), F.lit(1.0), F.lit(2.0))).when(x % 17 == 0, F.array(F.lit(1.0), F.lit(2e15), F.lit(3e15))).when(x % 19 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)))
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == o)
    out = lines.select(F.col("o_custkey").alias("definition"), F.concat(F.when(x % 29 == 0, "1").otherwise("o"), o, F.lit("_"), F.when(x % 23 == 0, 1).otherwise(n)).alias("output"), shape.alias("shape"), F.concat(F.lit("q"), F.when(x % 47 == 0, -1).otherwise(o)).alias("question"), F.when(x % 5 == 0, 1.5).otherwise(0.5).alias("cutoff"), F.when(x % 7 == 0, "z").when(x % 2 == 0, "a").alias("null_option"), values.alias("level_values"))
    return d, q, out


def v04(spark, sf):
    _, q, out = defined(spark, sf)
    return validation.output_problems(out, q)


def v05(spark, sf):
    return validation.definition_problems(*defined(spark, sf))


def v06(spark, sf):
    p = table(spark, sf, "part")
    x = F.array((F.col("p_partkey") % 3).cast("double"), (F.col("p_partkey") % 5).cast("double"), (F.col("p_size") % 4).cast("double"))
    return p.select("p_partkey", validation.monotonic(x).alias("monotonic"))


def calls(spark, sf):
    """Answered calls of five kinds, each from a table of its own."""
    part = lambda name, key, cost, m: table(spark, sf, name).select(F.when(F.col(key) % m != 0, F.round(F.col(cost) * 100).cast("long")).alias("cost"), (F.col(key) % 4 == 0).alias("hit"), (F.col(key) % 500).cast("long").alias("ms"))
    return [part("orders", "o_orderkey", "o_totalprice", 7), part("lineitem", "l_partkey", "l_extendedprice", 11), part("events", "event_id", "value", 13), part("customer", "c_custkey", "c_acctbal", 3), part("supplier", "s_suppkey", "s_acctbal", 5)]


def m19(spark, sf):
    return runs.call_totals(runs.answered_calls(*calls(spark, sf)), 100.0)


def m20(spark, sf):
    return runs.label_balance(table(spark, sf, "labels"), "quality")


def m21(spark, sf):
    return table(spark, sf, "events").select("event_id", runs.utc_date(F.col("ts").cast("timestamp")).alias("day"), runs.utc_timestamp(F.col("ts").cast("timestamp")).alias("stamp"))


def j09(spark, sf):
    policies = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("definition_id"))
    return runs.in_use(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), policies)


def j10(spark, sf):
    s = table(spark, sf, "supplier").select((F.col("s_nationkey") * 3).cast("int").alias("id"), F.element_at(F.array(F.lit("project"), F.lit("user")), (F.col("s_suppkey") % 2 + 1).cast("int")).alias("scope")).distinct()
    return runs.key_policies(s, ["project", "user"])


def j11(spark, sf):
    r = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("site"))
    return runs.planned(r, table(spark, sf, "customer").select(F.col("c_custkey").alias("site"), F.col("c_nationkey").alias("plan")), "site")


def j12(spark, sf):
    li = table(spark, sf, "lineitem")
    edges = li.groupBy(F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("wrapper")).agg(F.min("l_linenumber").alias("depth")).where("depth < 5")
    alts = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("wrapper"))
    return runs.edges_of(alts, edges).select("l_orderkey", "l_linenumber", "depth")


def j13(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    ask = e.select(k.alias("request_id"), (k % 4).alias("policy_id"))
    reply = e.select((k + F.when(k % 19 == 0, 1).otherwise(0)).alias("request_id"), (k % 4).alias("policy_id"), F.when(k % 3 == 0, "deferred").otherwise("accepted").alias("status"), F.when(k % 5 == 0, "experimental").otherwise("measured").alias("evidence"), (k % 7 != 0).alias("passed"), (k % 11 == 0).alias("fallback"), F.element_at(F.array(*map(F.lit, ("explore", "debug", "other"))), (k % 3 + 1).cast("int")).alias("route"))
    return runs.accepted_routes(ask, reply, ["explore", "debug", "review"]).select("request_id", "route")


def j14(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.when(F.col("event_id") % 3 == 0, "own_").otherwise(""), "event_type").alias("tool"))
    return runs.allowed_tools(e, "tool", ["error", "own_click", "own_view", "view", "click"], ["own_"])


def r09(spark, sf):
    files = found(spark, sf).select(F.col("file").alias("rel"), "at", "id")
    return runs.first_of(files, "rel", ["at"])


def r10(spark, sf):
    imports = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("target"), F.when(F.col("l_linenumber") % 3 == 0, "default").otherwise(F.col("l_returnflag")).alias("remote"))
    exports = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("target"), F.when(F.col("s_nationkey") < 13, F.col("s_name")).alias("name"))
    return runs.default_exports(imports, exports).select("l_orderkey", "l_linenumber", "remote")


def r11(spark, sf):
    own = table(spark, sf, "orders").select((F.col("o_custkey") % 300).alias("file"), F.concat(F.lit("n"), F.col("o_orderkey") % 40).alias("name"), (F.col("o_orderkey") % 3 != 0).alias("module"))
    imports = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 300).alias("file"), F.expr(AT).alias("at"), F.concat(F.lit("n"), F.col("l_partkey") % 60).alias("local"), F.concat(F.lit("x"), F.col("l_partkey") % 7).alias("remote"), (F.col("l_suppkey") % 20).alias("target"))
    symbols = table(spark, sf, "supplier").select((F.col("s_suppkey") % 20).alias("target"), F.concat(F.lit("x"), F.col("s_nationkey") % 5).alias("name")).distinct()
    return runs.scope(own, imports, symbols)


def r12(spark, sf):
    used = table(spark, sf, "lineitem").select(F.expr(AT).alias("use"), F.col("l_partkey").alias("file"), F.concat(F.lit("n"), F.col("l_suppkey") % 3).alias("name"), (F.col("l_orderkey") % 1000).cast("long").alias("byte"))
    start = (F.col("o_custkey") % 20 * 50).cast("long")
    defs = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 8).alias("file"), F.concat(F.lit("n"), F.col("o_custkey") % 3).alias("name"), start.alias("start"), (start + F.col("o_custkey") % 7 * 100 + 10).alias("end"), F.col("o_orderkey").cast("long").alias("def"))
    imports = table(spark, sf, "supplier").select((F.col("s_suppkey") * 17).alias("file"), F.concat(F.lit("n"), F.col("s_nationkey") % 3).alias("name"), F.col("s_suppkey").cast("long").alias("def"))
    return runs.bound_names(used, defs, imports, ["use"])


QUERIES = {
    "s03_report_order": s03, "s04_wrapper_definitions": s04, "s05_legacy_sites": s05, "s06_assessed": s06, "s07_review_questions": s07, "s08_drafts": s08, "s09_snippets": s09, "s10_divergence": s10, "s11_canonical_forms": s11, "s12_strata": s12,
    "v01_ids_and_versions": v01, "v02_site_rules": v02, "v03_response_rules": v03, "v04_output_rules": v04, "v05_definition_rules": v05, "v06_monotonic": v06, "m19_call_totals": m19, "m20_label_balance": m20, "m21_utc_stamps": m21,
    "j09_definitions_in_use": j09, "j10_key_policies": j10, "j11_runs_and_plans": j11, "j12_edges_of_alternatives": j12, "j13_accepted_routes": j13, "j14_allowed_tools": j14, "r09_first_files": r09, "r10_default_exports": r10, "r11_scope": r11, "r12_bound_names": r12,
}

_pick = lambda values, k: "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({k} AS BIGINT) + 1]"
_shape = _pick(("choice", "yes_no", "labels", "score"), "{0} % 4")
_spaces = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_collapsed = lambda c: f"trim(regexp_replace({c}, '{_spaces}', ' ', 'g'), ' ')"
_first = lambda *rules: "CASE " + " ".join(f"WHEN coalesce({c}, false) THEN '{name}'" for c, name in rules) + " END"
_registry = r"regexp_full_match({0}, '[a-z0-9][a-z0-9._-]{{0,127}}')".format
_name = r"regexp_full_match({0}, '[A-Za-z_][A-Za-z0-9_-]{{0,63}}')".format
_token = r"regexp_full_match({0}, '(source|agent|runtime):[^\x00-\x20\x7F-\xA0]+') AND length({0}) <= 256".format
_version = r"CASE WHEN NOT regexp_full_match({0}, '(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)') THEN 'invalid' WHEN {0} LIKE '1.%' THEN 'ok' ELSE 'incompatible' END".format
_mono = "(({0}[1] < {0}[2] AND {0}[2] < {0}[3]) OR ({0}[1] > {0}[2] AND {0}[2] > {0}[3]))".format

_defined = f"""d AS (
  SELECT c_custkey AS definition, CASE WHEN c_custkey % 31 = 0 THEN '2.0' ELSE '1.0' END AS schema_version, CASE WHEN c_custkey % 37 = 0 THEN 'Bad' ELSE 'd' || c_custkey END AS id, CASE WHEN c_custkey % 41 = 0 THEN 'd' ELSE 'source:d' END AS site_id,
         CASE WHEN c_custkey % 43 = 0 THEN 'r' WHEN c_custkey % 2 = 0 THEN sha256(CAST(c_custkey AS VARCHAR)) END AS revision FROM customer),
q AS (SELECT o_custkey AS definition, 'q' || o_orderkey AS question, {_pick(("choice", "yes_no", "score"), "(o_orderkey % 3)")} AS kind, ['a', 'b', 'c'] AS criteria FROM orders),
o AS (
  SELECT o_custkey AS definition, CASE WHEN l_partkey % 29 = 0 THEN '1' ELSE 'o' END || o_orderkey || '_' || CASE WHEN l_partkey % 23 = 0 THEN 1 ELSE l_linenumber END AS output,
         CASE WHEN o_orderkey % 3 = 1 AND l_partkey % 2 = 0 THEN 'labels' WHEN l_partkey % 13 = 0 THEN 'choice' ELSE {_pick(("choice", "yes_no", "score"), "(o_orderkey % 3)")} END AS shape,
         'q' || CASE WHEN l_partkey % 47 = 0 THEN -1 ELSE o_orderkey END AS question, CASE WHEN l_partkey % 5 = 0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS cutoff,
         CASE WHEN l_partkey % 7 = 0 THEN 'z' WHEN l_partkey % 2 = 0 THEN 'a' END AS null_option,
         CASE WHEN l_partkey % 3 = 0 THEN [3.0::DOUBLE, 2, 1] WHEN l_partkey % 11 = 0 THEN [1.0::DOUBLE, 1, 2] WHEN l_partkey % 17 = 0 THEN [1.0::DOUBLE, 2e15, 3e15] WHEN l_partkey % 19 = 0 THEN [1.0::DOUBLE, 2] ELSE [1.0::DOUBLE, 2, 4] END AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT definition, output, count(*) AS n FROM o GROUP BY 1, 2),
w AS (
  SELECT o.definition, o.output, {_first((f"NOT {_name('o.output')}", "name"), ("n > 1", "duplicate"), ("q.kind IS NULL", "unknown_question"), ("q.kind <> CASE WHEN shape = 'labels' THEN 'yes_no' ELSE shape END", "question_kind"),
    ("shape = 'choice' AND null_option = 'z'", "null_option"), ("shape IN ('yes_no', 'labels') AND cutoff > 1", "cutoff"), ("shape = 'score' AND len(v) <> 3", "level_count"), ("shape = 'score' AND list_max(v) > 1e15", "level_range"), (f"shape = 'score' AND NOT {_mono('v')}", "level_order"))} AS problem
  FROM o JOIN c ON c.definition = o.definition AND c.output = o.output LEFT JOIN q ON q.definition = o.definition AND q.question = o.question),
p AS (SELECT DISTINCT * FROM w WHERE problem IS NOT NULL)"""

SQL = {
    "s03_report_order": f"""WITH {FOUND},
      o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, line, "at") AS i FROM f WHERE kind = 'occurrence'),
      u AS (SELECT *, CASE WHEN i = 1 THEN id ELSE id || '-' || i END AS unique_id FROM o),
      m AS (SELECT id, max(i) AS m FROM o GROUP BY 1),
      w AS (SELECT f.*, row_number() OVER (PARTITION BY f.id ORDER BY file, line, byte, "at") + coalesce(m, 0) AS i FROM f LEFT JOIN m ON m.id = f.id WHERE kind = 'wrapper_definition'),
      a AS (SELECT "at", kind, file, line, id, unique_id FROM u UNION ALL SELECT "at", kind, file, line, id, CASE WHEN i = 1 THEN id ELSE id || '-' || i END FROM w)
      SELECT "at", unique_id, row_number() OVER (ORDER BY file, line, id, kind, "at") AS position FROM a""",
    "s04_wrapper_definitions": f"WITH {FOUND} SELECT file, count(*) FILTER (kind = 'wrapper_definition') AS wrapper_definitions, count(*) FILTER (kind = 'occurrence') AS occurrences FROM f GROUP BY 1",
    "s05_legacy_sites": f"""WITH {FOUND} SELECT "at", id, file, line FROM f WHERE kind = 'occurrence' AND "at" % 5 <> 0""",
    "s06_assessed": f"""WITH p AS (SELECT p_partkey, p_partkey % 5 = 0 AS conflict, CASE WHEN p_partkey % 5 = 0 THEN 'review' ELSE {_pick(("sure", "likely", "review", "not_decision"), "(p_partkey % 4)")} END AS tier, p_brand, p_name, p_type FROM part),
      o AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ';' || p_name WHEN tier = 'likely' AND p_partkey % 7 = 0 THEN p_type ELSE '' END AS outputs FROM p)
      SELECT p_partkey, tier, array_to_string(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'a' END, CASE WHEN conflict THEN 'c1;c2' END, CASE WHEN tier = 'likely' AND outputs = '' THEN 'answer labels not found in the prompt' END], lambda x: x IS NOT NULL), ';') AS reasons, outputs FROM o""",
    "s07_review_questions": "SELECT p_partkey, 'bounded_decision' || CASE WHEN p_partkey % 3 = 0 THEN ',free_text_role' ELSE '' END || CASE WHEN p_partkey % 5 = 0 OR p_partkey % 11 = 0 THEN ',parameter_role' ELSE '' END AS questions FROM part",
    "s08_drafts": f"""WITH p AS (SELECT *, {_shape.format('p_partkey')} AS shape, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN 'n' || (p_partkey % 9) END, 'decision') AS k,
        CASE WHEN p_partkey % 10 = 0 THEN p_type WHEN p_partkey % 7 <> 0 THEN p_name WHEN p_partkey % 3 <> 0 THEN '[rough] What is the correct `n' || (p_partkey % 9) || '` for this input?' ELSE '[rough] What is the correct answer for this input?' END AS ask FROM part)
      SELECT p_partkey AS site, k AS key, shape AS kind, ask AS instructions, CASE shape WHEN 'yes_no' THEN '' WHEN 'score' THEN '[rough] level ' || p_size || ';' || p_brand
        ELSE p_brand || CASE WHEN p_partkey % 5 <> 0 THEN ': ' || p_name ELSE '' END || ';x' || CASE WHEN p_partkey % 8 = 0 THEN ';none_of_the_above: None of the other options fits' ELSE '' END END AS criteria FROM p WHERE shape <> 'labels'
      UNION ALL SELECT p_partkey, k || '__' || p_brand, 'yes_no', ask || chr(10) || chr(10) || 'Does the label `' || p_brand || '` apply?' || CASE WHEN p_partkey % 5 <> 0 THEN ' (' || p_name || ')' ELSE '' END, '' FROM p WHERE shape = 'labels'
      UNION ALL SELECT p_partkey, k || '__x', 'yes_no', ask || chr(10) || chr(10) || 'Does the label `x` apply?', '' FROM p WHERE shape = 'labels'""",
    "s09_snippets": r"""WITH l AS (SELECT doc_id, greatest(doc_id % 60 - 41, 0) AS first, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
      t AS (SELECT doc_id, first, list_transform(CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END, lambda x: regexp_replace(x, '
$', '')) AS l FROM l),
      w AS (SELECT doc_id, first, string_split(array_to_string(l[first + 1:first + 81], chr(10)), chr(10)) AS l FROM t),
      c AS (SELECT doc_id, first, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM w),
      n AS (SELECT doc_id, list_transform(range(1, len(l) + 1), lambda i: lpad(CAST(CAST(i + first AS BIGINT) AS VARCHAR), 5, ' ') || ' ' || l[i] || chr(10)) AS n FROM c),
      s AS (SELECT doc_id, n, list_transform(range(1, len(n) + 1), lambda i: list_sum(list_transform(n[1:i], lambda x: strlen(x)))) AS s FROM n)
      SELECT doc_id, sha256(coalesce(array_to_string(n[1:len(list_filter(s, lambda x: x <= 16384))], ''), '')) AS snippet_sha256 FROM s UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""",
    "s10_divergence": f"""WITH c AS (SELECT DISTINCT l_orderkey AS occ, {AT} AS alt, [l_returnflag, l_linestatus, 's' || (l_suppkey % 2), 'q' || (l_partkey % 2)][1:CASE WHEN l_partkey % 9 = 0 THEN 2 ELSE 4 END] AS chain FROM lineitem),
      f AS (SELECT occ, arg_min(chain, alt) AS first, list(chain) AS chains FROM c GROUP BY 1),
      s AS (SELECT occ, first, list_min(list_filter(range(1, len(first) + 1), lambda i: len(list_filter(chains, lambda x: x[i] IS DISTINCT FROM first[i])) > 0)) AS i FROM f)
      SELECT occ, CAST(i - 1 AS INTEGER) AS at, first[i] AS id FROM s""",
    "s11_canonical_forms": f"WITH c AS (SELECT doc_id, source, lang, n_chars % 2 AS t, {_collapsed('text')} AS x FROM documents) SELECT min(doc_id) AS first_id, count(*) AS n FROM c GROUP BY source, lang, t, x",
    "s12_strata": f"""WITH f AS (SELECT p_brand AS definition, arg_min('o' || p_partkey, p_partkey) AS name, arg_min({_shape.format('p_size')}, p_partkey) AS shape, arg_min([p_brand, p_type, p_name], p_partkey) AS o FROM part GROUP BY 1),
      s AS (SELECT definition, list_append(CASE shape WHEN 'yes_no' THEN [name || '=true', name || '=false'] WHEN 'score' THEN list_transform(range(0, 3), lambda i: name || '=level' || CAST(i AS BIGINT)) ELSE list_transform(o, lambda x: name || '=' || x) END, 'edge_cases') AS s FROM f),
      e AS (SELECT definition, len(s) AS k, unnest(range(0, len(s))) AS i, unnest(s) AS stratum FROM s)
      SELECT definition, CAST(i AS INTEGER) AS i, stratum, CAST(3 // k + CASE WHEN i < 3 % k THEN 1 ELSE 0 END AS BIGINT) AS size FROM e WHERE 3 // k + CASE WHEN i < 3 % k THEN 1 ELSE 0 END > 0""",
    "v01_ids_and_versions": f"""WITH p AS (SELECT *, {_pick(("1", "2", "01", "", "1"), "(p_partkey % 5)")} || '.' || (p_partkey % 3) AS version, CASE WHEN p_partkey % 2 = 0 THEN 'agent:' ELSE 'hook:' END || CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE 'a b' END AS site FROM part)
      SELECT p_partkey, {_version('version')} AS version, {_registry('lower(p_brand)')} AS bare, {_registry("replace(lower(p_brand), '#', '-')")} AS registry_id, {_name("replace(p_name, ' ', '_')")} AS name, {_token('site')} AS site_id FROM p""",
    "v02_site_rules": f"""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey AS k, {_pick(("source", "agent_hook", "runtime"), "(l_linenumber % 3)")} AS origin, {_pick(("source:", "agent:", "runtime:"), "(l_linenumber % 3)")} AS prefix FROM lineitem),
      s AS (SELECT *, CASE WHEN k % 29 = 0 THEN '1.2' WHEN k % 31 = 0 THEN 'x' ELSE '1.1' END AS version, CASE WHEN k % 13 = 0 THEN 'source:a b' ELSE prefix || k END AS id, origin = 'source' AND k % 17 <> 0 AS source, origin = 'agent_hook' OR k % 19 = 0 AS agent,
        CASE WHEN origin = 'source' AND k % 23 <> 0 THEN CASE WHEN k % 37 = 0 THEN 'zz' ELSE 'ok' END END AS revision FROM o)
      SELECT l_orderkey, l_linenumber, {_first(("version = 'x'", "invalid_version"), ("version = '1.2'", "incompatible_version"), ("id LIKE '% %'", "id_prefix"), ("origin = 'source' AND NOT source", "missing:source"), ("origin = 'source' AND agent", "unexpected:agent"),
        ("origin = 'source' AND revision IS NULL", "missing:source_revision"), ("origin = 'runtime' AND agent", "unexpected:agent"), ("origin <> 'source' AND k % 11 = 0", "kind_not_allowed"), ("origin <> 'source' AND k % 41 = 0", "unexpected_provenance"),
        ("revision = 'zz'", "invalid:source_revision"), ("source AND k % 43 = 0", "invalid:source.line"))} AS problem FROM s""",
    "v03_response_rules": f"""WITH r AS (SELECT event_id AS k, CASE WHEN event_id % 53 = 0 THEN 'lost' ELSE {_pick(("accepted", "deferred", "error"), "(event_id % 3)")} END AS status FROM events),
      s AS (SELECT *, k % 7 <> 0 AS request, k % 13 = 0 OR k % 5 <> 0 AS policy, (status = 'accepted') <> (k % 17 = 0) AS passed, CASE WHEN status IN ('deferred', 'error') AND k % 19 <> 0 THEN CASE WHEN k % 23 = 0 THEN 'timeout' WHEN status = 'deferred' THEN 'low_confidence' ELSE 'invalid_input' END END AS reason,
        k % 29 = 0 OR k % 31 <> 0 AS provider FROM r)
      SELECT k AS event_id, {_first(("k % 59 = 0", "protocol_version"), ("k % 11 = 0", "site_id"), ("k % 13 = 0", "policy_id"), ("k % 29 = 0", "provider"), ("status = 'error' AND k % 41 = 0", "error_message"), ("k % 43 = 0", "answers"),
        ("status = 'accepted' AND NOT (request AND provider AND policy AND passed)", "accepted"), ("status = 'deferred' AND NOT (request AND NOT passed AND reason IS NOT NULL)", "deferred"),
        ("status = 'error' AND (k % 37 = 0 OR passed OR reason IS DISTINCT FROM 'invalid_input')", "error"), ("status = 'lost'", "status"))} AS problem FROM s""",
    "v04_output_rules": f"WITH {_defined} SELECT definition, output, problem FROM p",
    "v05_definition_rules": f"""WITH {_defined}, x AS (SELECT definition, min(output || ':' || problem) AS wrong FROM p GROUP BY 1), n AS (SELECT definition, count(*) AS n FROM q GROUP BY 1), g AS (SELECT definition, count(DISTINCT output) AS g FROM o GROUP BY 1),
      r AS (SELECT d.definition, coalesce({_first(("schema_version <> '1.0'", "schema_version"), ("id = 'Bad'", "id"), ("site_id = 'd'", "site_id"), ("revision = 'r'", "revision"), ("coalesce(n, 0) NOT BETWEEN 1 AND 64", "questions"), ("coalesce(g, 0) NOT BETWEEN 1 AND 64", "outputs"))}, wrong) AS problem
        FROM d LEFT JOIN n ON n.definition = d.definition LEFT JOIN g ON g.definition = d.definition LEFT JOIN x ON x.definition = d.definition) SELECT * FROM r WHERE problem IS NOT NULL""",
    "v06_monotonic": f"WITH x AS (SELECT p_partkey, [p_partkey % 3, p_partkey % 5, p_size % 4] AS v FROM part) SELECT p_partkey, {_mono('v')} AS monotonic FROM x",
    "m19_call_totals": "WITH "
    + ", ".join(f"c{i} AS (SELECT CASE WHEN {k} % {m} <> 0 THEN CAST(round({c} * 100) AS BIGINT) END AS cost, {k} % 4 = 0 AS hit, {k} % 500 AS ms FROM {t})" for i, (t, k, c, m) in enumerate([("orders", "o_orderkey", "o_totalprice", 7), ("lineitem", "l_partkey", "l_extendedprice", 11), ("events", "event_id", "value", 13), ("customer", "c_custkey", "c_acctbal", 3), ("supplier", "s_suppkey", "s_acctbal", 5)]))
    + ", a AS (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4) SELECT CAST(sum(cost) AS BIGINT) / 100::DOUBLE AS cost, count(*) FILTER (cost IS NULL) AS unpriced, count(*) AS calls, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, CAST(sum(ms) AS BIGINT) AS ms FROM a",
    "m20_label_balance": "SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1",
    "m21_utc_stamps": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events",
    "j09_definitions_in_use": "SELECT p_partkey AS id, count(*) AS policies FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1",
    "j10_key_policies": "SELECT DISTINCT CAST(s_nationkey * 3 AS INTEGER) AS id FROM supplier",
    "j11_runs_and_plans": "SELECT CASE WHEN o_orderkey % 9 = 0 THEN -o_custkey ELSE o_custkey END AS site, o_orderkey, c_nationkey AS plan, c_custkey IS NOT NULL AS planned FROM orders LEFT JOIN customer ON c_custkey = CASE WHEN o_orderkey % 9 = 0 THEN -o_custkey ELSE o_custkey END",
    "j12_edges_of_alternatives": "WITH e AS (SELECT l_partkey, l_suppkey, min(l_linenumber) AS depth FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, depth FROM lineitem JOIN e USING (l_partkey, l_suppkey) WHERE depth < 5",
    "j13_accepted_routes": "WITH r AS (SELECT event_id AS k, event_id + CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS request_id, event_id % 4 AS p, ['explore', 'debug', 'other'][event_id % 3 + 1] AS route FROM events) SELECT request_id, route FROM r JOIN events e ON e.event_id = request_id AND e.event_id % 4 = p WHERE k % 3 <> 0 AND k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 AND route <> 'other'",
    "j14_allowed_tools": "SELECT event_id, event_type AS tool FROM events WHERE event_id % 3 <> 0 AND event_type IN ('error', 'view', 'click')",
    "r09_first_files": f"""WITH {FOUND} SELECT file AS rel, min("at") AS "at", arg_min(id, "at") AS id FROM f GROUP BY 1""",
    "r10_default_exports": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN coalesce(CASE WHEN s_nationkey < 13 THEN s_name END, 'default') ELSE l_returnflag END AS remote FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey",
    "r11_scope": f"""WITH o AS (SELECT o_custkey % 300 AS file, 'n' || (o_orderkey % 40) AS name, bool_or(o_orderkey % 3 <> 0) AS module FROM orders GROUP BY 1, 2),
      i AS (SELECT l_orderkey % 300 AS file, {AT} AS "at", 'n' || (l_partkey % 60) AS name, 'x' || (l_partkey % 7) AS remote, l_suppkey % 20 AS target FROM lineitem),
      y AS (SELECT DISTINCT s_suppkey % 20 AS target, 'x' || (s_nationkey % 5) AS remote FROM supplier),
      a AS (SELECT file, name, CASE WHEN module THEN 0 ELSE 1 END AS p, 0 AS "at", CASE WHEN module THEN 'own' ELSE 'local' END AS found FROM o WHERE module OR NOT EXISTS (SELECT 1 FROM i WHERE i.file = o.file AND i.name = o.name)
            UNION ALL SELECT file, name, 2, "at", target || ':' || remote FROM i JOIN y USING (target, remote))
      SELECT file, name, found FROM (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY p, "at", found) AS n FROM a) WHERE n = 1""",
    "r12_bound_names": f"""WITH u AS (SELECT {AT} AS use, l_partkey AS file, 'n' || (l_suppkey % 3) AS name, l_orderkey % 1000 AS byte FROM lineitem),
      d AS (SELECT o_orderkey // 8 AS file, 'n' || (o_custkey % 3) AS name, o_custkey % 20 * 50 AS s, o_custkey % 20 * 50 + o_custkey % 7 * 100 + 10 AS e, o_orderkey AS def FROM orders),
      b AS (SELECT use, def FROM (SELECT use, def, row_number() OVER (PARTITION BY use ORDER BY s DESC, e, def DESC) AS n FROM u JOIN d ON d.file = u.file AND d.name = u.name AND s <= byte AND byte < e) WHERE n = 1),
      m AS (SELECT s_suppkey * 17 AS file, 'n' || (s_nationkey % 3) AS name, min(s_suppkey) AS def FROM supplier GROUP BY 1, 2)
      SELECT u.use, coalesce(b.def, m.def) AS def, CASE WHEN b.def IS NOT NULL THEN 'scope' WHEN m.def IS NOT NULL THEN 'import' END AS how FROM u LEFT JOIN b ON b.use = u.use LEFT JOIN m ON m.file = u.file AND m.name = u.name""",
}
