"""Queries whose inputs are texts: prompts, answers, batches and imports, written from whole tables with every case planted, each with DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sparkgate.functions import schemas
from sparkgate.functions import text as T
from sparkgate.operators import answers, inputs, resolve, runs
from sparkgate.plans.catalogue import dealt, table
from sparkgate.plans.records import AT


def case(k, *values):
    """The value of the case k, from 0; the last one for all others."""
    out = F.when(k == 0, values[0])
    for n, v in enumerate(values[1:-1], 1):
        out = out.when(k == n, v)
    return out.otherwise(values[-1])


def fill(template: str, **columns):
    """template with {name} replaced by columns, which are cast to text; other braces stay."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[columns[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def t01(spark, sf):
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    many = F.lit("Pick from " + ", ".join(f"l{i}" for i in range(21)))
    text = case(
        k % 12, F.lit("Answer yes or no."), F.lit("Reply TRUE / false only"), fill("Choose from: {b}, {t} or {n}.", b=F.col("p_brand"), t=F.col("p_type"), n=name), fill("Please categorise {n}", n=name), fill("Rate {n} from {s} to {k}", n=name, s=size, k=k % 60),
        F.lit("Give a single-word label"), fill("one of the {n}", n=name), name, fill("{n}: yes or no; classify; one word; scale 1-9", n=name), many, fill("exactly one of: {n}, an answer of four words", n=name), fill("one of: {n} and {x}", n=name, x=F.repeat("p_brand", 9)),
    )
    s = T.prompt_signals(text)
    return table(spark, sf, "part").select(k.alias("id"), F.array_join(s, ";").alias("signals"), T.implied_space(s).alias("space"))


OUTPUTS = [("team", "choice", {"options": ["billing", "support"], "null_option": "none"}), ("urgent", "yes_no", {}), ("tags", "labels", {"options": ["bug", "docs"]}), ("stars", "score", {"levels": [1.0, 2.0, 3.0]})]


def i10(spark, sf):
    """Answers to orders: one in fourteen of each kind of fault, among them nulls, and right ones with the order's own values."""
    k = F.col("o_orderkey")
    team, stars, word = F.when(k % 2 == 0, "billing").otherwise("support"), k % 201 / 100 + 1, F.col("o_orderpriority")
    fields = dict(t=team, s=stars, w=word, u=F.when(k % 3 == 0, "true").otherwise("false"))
    good = '{"team": "{t}", "urgent": {u}, "tags": ["docs", "bug", "docs"], "stars": {s}}'
    shapes = [good, good.replace("{t}", "none"), good.replace('"{t}"', "null"), good.replace("{t}", "{w}"), good.replace("{u}", '"{u}"'), good.replace("bug", "{w}"), good.replace("{s}", "3.5"), good.replace(', "stars": {s}', ""), good[:-1] + ', "more": 1}', "[{s}]", "not {w}", good.replace('["docs", "bug", "docs"]', "[]"), good.replace('["docs", "bug", "docs"]', '["bug"]')]

    a = answers.canonical_answer(case(k % 14, *[fill(x, **fields) for x in shapes], F.lit(None).cast("string")), OUTPUTS)
    return table(spark, sf, "orders").withColumn("a", a).select("o_orderkey", "a.reason", "a.team", "a.urgent", F.array_join("a.tags", ",").alias("tags"), F.round("a.stars", 6).alias("stars"))


def i11(spark, sf):
    """Batches of tickets: plain, fenced, with items that are no tickets, and other texts."""
    k = F.col("c_custkey")
    item = lambda v: F.concat(F.lit('{"ticket": "'), v.cast("string"), F.lit('"}'))
    plain = F.concat(F.lit('{"inputs": ['), item(k), F.lit(', "{\\"ticket\\": \\"b\\"}", {"ticket": 5, "x": 1}, '), (k % 10).cast("string"), F.lit(", null]}"))
    fenced = F.concat(F.lit(' ```json\n{"inputs": ['), F.array_join(F.transform(F.sequence(F.lit(1), F.col("c_nationkey") + 1), item), ", "), F.lit("]}\n``` "))
    text = case(k % 6, plain, fenced, F.lit('```{"inputs": []}```'), F.concat(F.lit("sorry "), "c_name"), F.concat(F.lit('{"items": ["'), "c_name", F.lit('"]}')), F.lit(None).cast("string"))
    b = answers.batch_inputs(text, {"ticket": ("string", True)}, 2)
    return dealt(table(spark, sf, "customer"), "c_custkey").withColumn("b", b).select("c_custkey", F.array_join("b.inputs", ";").alias("inputs"), "b.rejected")


def i03(spark, sf):
    """Inputs that don't have their hash (every 97th document) and rows in the wrong half (every 89th) are found."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    split = inputs.half_split(d.select(F.sha2("text", 256).alias("hash")).distinct())
    rows = d.select("doc_id", "text", F.sha2("text", 256).alias("hash")).join(split, "hash")
    other = F.when(F.col("split") == "held_out", "calibration").otherwise("held_out")
    return inputs.verify_split(rows.select(F.when(k % 97 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("input"), "hash", F.when(k % 89 == 0, other).otherwise(F.col("split")).alias("split")))


def i06(spark, sf):
    return inputs.unknown_keys(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "supplier"), "s_suppkey")


def r01(spark, sf):
    """Imports by parts of modules by suppliers; libraries hold some modules once, some twice; some folders are packages."""
    n, s = F.col("s_nationkey"), F.col("s_suppkey")
    name = lambda *x: F.array_compact(F.array(*x))
    files = table(spark, sf, "supplier").select(F.explode(name(fill("p{n}/m{s}.py", n=n, s=s), F.when(s % 3 == 0, fill("lib1/deep/m{s}.py", s=s)), F.when(s % 6 == 0, fill("lib2/deep/m{s}.py", s=s)), F.when(n % 5 == 0, fill("p{n}/__init__.py", n=n)), F.when(s % 7 == 0, fill("src/m{s}.py", s=s)))).alias("rel")).distinct()
    k, m, y = F.col("p_partkey"), F.col("p_partkey") % 120, F.col("p_partkey") % 25
    module = case(k % 7, fill("m{m}", m=m), fill("p{y}.m{m}", y=y, m=m), fill("m{m}", m=m), fill("openai.m{m}", m=m), fill("m{m}", m=m), fill("deep.m{m}", m=m), F.lit(""))
    level = case(k % 7, F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit(3), F.lit(0), F.lit(1))
    exact, suffixes, package = resolve.python_candidates(fill("p{y}/user.py", y=y), level, module, ["openai", "anthropic"])
    return resolve.resolve_imports(table(spark, sf, "part").select(k.alias("id"), exact.alias("exact"), suffixes.alias("suffixes"), package.alias("package")), files)


def r02(spark, sf):
    n, s = F.col("s_nationkey"), F.col("s_suppkey")
    files = table(spark, sf, "supplier").select(F.when(s % 2 == 0, fill("w{n}/m{s}.ts", n=n, s=s)).otherwise(fill("w{n}/m{s}/index.tsx", n=n, s=s)).alias("own"), F.when(s % 10 == 0, fill("x/m{s}.ts", s=s)).alias("more")).select(F.explode(F.array_compact(F.array("own", "more"))).alias("rel")).distinct()
    k, m, y = F.col("p_partkey"), F.col("p_partkey") % 120, F.col("p_partkey") % 25
    spec = case(k % 7, fill("./m{m}", m=m), fill("./m{m}.js", m=m), fill("@/w{y}/m{m}", y=y, m=m), fill("../w{y}/./m{m}", y=y, m=m), fill("m{m}", m=m), fill("../../w{y}/m{m}", y=y, m=m), fill("~/m{m}", m=m))
    exact, suffixes, package = resolve.ts_candidates(fill("w{y}/u.ts", y=y), spec)
    return resolve.resolve_imports(table(spark, sf, "part").select(k.alias("id"), exact.alias("exact"), suffixes.alias("suffixes"), package.alias("package")), files)


def t06(spark, sf):
    k = F.col("page_id")
    head = case(k % 7, F.lit("import OpenAI from 'openai';"), F.lit('const a = require("@anthropic-ai/sdk/x")'), F.lit("import { x } from 'ai'\nimport 'langchain/y'"), F.lit("import {y} from \"@langchain/core\""), F.lit("// openai"), F.lit("import x from 'openai-edge'"), F.lit("from'openai/z'"))
    return table(spark, sf, "pages").select("page_id", F.array_join(T.imported_ts_packages(F.concat(head, F.lit("\n"), F.coalesce("html", F.lit("")))), ",").alias("packages"))


def schema_texts():
    """A JSON Schema of each part, in every envelope, with properties of every kind."""
    k, size, brand, name = F.col("p_partkey"), F.col("p_size"), F.col("p_brand"), F.col("p_name")
    a = case(k % 5, fill('{"enum": ["{b}", "x", 3, "{n}"], "description": "d {b}"}', b=brand, n=name), fill('{"type": ["string", "null"], "enum": ["{b}", "x"]}', b=brand), fill('{"anyOf": [{"enum": ["{b}", "{n}"]}, {"type": "null"}]}', b=brand, n=name), F.lit('{"enum": ["one"], "type": "string"}'), F.lit('{"oneOf": [{"type": "boolean"}, {"type": "string"}]}'))
    b = case(k % 3, F.lit('{"type": "boolean"}'), fill('{"type": "integer", "minimum": {s}, "maximum": {t}}', s=size, t=size + k % 13), fill('{"type": "array", "items": {"enum": ["{b}", "{n}"]}}', b=brand, n=name))
    body = F.concat(F.lit('{"type": "object", "properties": {"a": '), a, F.lit(', "b": '), b, F.lit("}}"))
    wrapped = case(k % 8, body, *[F.concat(F.lit(x), body, F.lit(y)) for x, y in (('{"type": "json_schema", "json_schema": {"name": "n", "schema": ', "}}"), ('{"format": {"type": "json_schema", "schema": ', "}}"), ('{"name": "f", "input_schema": ', "}"), ('{"type": "function", "function": {"name": "f", "parameters": ', "}}"))], F.lit('{"type": "json_object"}'), F.lit('{"properties": {"a": {"$ref": "#/x"}}}'), a)
    return F.when(k % 17 == 0, F.concat(F.lit('{"enum": ["'), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(256)), lambda i: i.cast("string")), '", "'), F.lit('"]}'))).when(k % 19 == 0, "no json").otherwise(wrapped)


def x13(spark, sf):
    rows = schemas.answer_spaces(dealt(table(spark, sf, "part"), "p_partkey").select("p_partkey", schema_texts().alias("schema")), "p_partkey")
    return rows.select("id", "state", "name", "description", "kind", F.array_join("options", "|").alias("options"), "nullable", F.array_join(F.transform("levels", lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("levels"))


def g08(spark, sf):
    """Calls of every line against wrappers of every part: plain names, modules imported whole, and methods."""
    k, s, n = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_partkey")
    names = F.array(*map(F.lit, ("run", "ask", "route", "create", "grade", "pick")))
    name = lambda c: F.concat(F.element_at(names, (c % 6 + 1).cast("int")), F.when(c % 1000 < 3, "").otherwise(F.concat(F.lit("_"), c % 1000)))
    calls = table(spark, sf, "lineitem").select(F.expr(AT).alias("call"), (s % 50).alias("file"), (n % 2 == 0).alias("python"), name(n).alias("name"), case(F.col("l_linenumber") % 3, F.lit(None).cast("string"), fill("m{s}", s=s % 4), F.lit("client")).alias("object"), (n % 100).cast("long").alias("byte"), (k % 2 == 0).alias("schema_keyword"))
    p = F.col("p_partkey")
    wrappers = table(spark, sf, "part").select(p.alias("wrapper"), (p % 50).alias("file"), (p % 60).cast("long").alias("start"), (p % 60 + 30).cast("long").alias("end"), (p % 4 < 2).alias("python"), name(p).alias("name"), (p % 3 == 0).alias("method"))
    bound = table(spark, sf, "lineitem").select(F.expr(AT).alias("call"), (n % 50).alias("target"), (n % 60).cast("long").alias("start"))
    spaces = table(spark, sf, "supplier").select((F.col("s_suppkey") % 50).alias("file"), fill("m{n}", n=F.col("s_nationkey") % 3).alias("local"), (F.col("s_nationkey") % 50).alias("target")).distinct()
    modules = wrappers.where(~F.col("method")).select(F.col("file").alias("target"), "name", "start").distinct()
    return runs.callers(calls, bound, spaces, modules, wrappers)


def g09(spark, sf):
    p = F.col("p_partkey")
    roles = F.array_compact(F.array(F.when(p % 5 == 0, "schema"), F.when(p % 7 == 0, "model"), F.when(p % 11 == 0, "forward"), F.when(p % 2 == 0, "prompt")))
    tier = F.element_at(F.array(*map(F.lit, ("sure", "likely", "review", "not_decision"))), (p % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", runs.eligible(F.when(p % 13 == 0, "").otherwise(F.col("p_name")), roles, tier, F.when(p % 3 == 0, "text")).alias("eligible"))


QUERIES = {"t06_ts_import_gate": t06, "x13_answer_spaces": x13, "g08_callers": g08, "g09_eligible": g09, "t01_prompt_signals": t01, "i03_verify_split": i03, "i06_unknown_site": i06, "i10_canonical_answer": i10, "i11_batch_inputs": i11, "r01_python_imports": r01, "r02_ts_imports": r02}

SQL = {
    "t01_prompt_signals": """WITH p AS (SELECT *, p_partkey % 12 AS c, CASE WHEN p_partkey % 60 > p_size THEN 'rating:' || p_size || ':' || (p_partkey % 60) END AS rate FROM part)
      SELECT p_partkey AS id, CASE c WHEN 0 THEN 'yes_no' WHEN 1 THEN 'true_false' WHEN 2 THEN 'one_of:' || p_brand || '|' || p_type || '|' || p_name WHEN 3 THEN 'classify' WHEN 4 THEN coalesce(rate, '') WHEN 5 THEN 'one_word' WHEN 8 THEN 'yes_no;classify;rating:1:9;one_word' ELSE '' END AS signals,
             CASE c WHEN 0 THEN 'yes_no' WHEN 1 THEN 'yes_no' WHEN 2 THEN 'one_of:' || p_brand || '|' || p_type || '|' || p_name WHEN 4 THEN rate WHEN 8 THEN 'yes_no' END AS space FROM p""",
    "i03_verify_split": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN text || 'x' ELSE text END AS input, sha256(text) AS hash FROM documents),
      h AS (SELECT hash, CASE WHEN row_number() OVER (ORDER BY hash) <= count(*) OVER () // 2 THEN 'calibration' ELSE 'held_out' END AS rule FROM (SELECT DISTINCT hash FROM d)),
      r AS (SELECT d.*, rule, CASE WHEN doc_id % 89 = 0 THEN CASE rule WHEN 'held_out' THEN 'calibration' ELSE 'held_out' END ELSE rule END AS split FROM d JOIN h USING (hash))
      SELECT count(*) FILTER (sha256(input) <> hash) AS rehash, count(*) - count(DISTINCT hash) AS duplicates, count(*) FILTER (split <> rule) AS misplaced FROM r""",
    "i06_unknown_site": "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "i10_canonical_answer": """WITH o AS (SELECT o_orderkey, o_orderkey % 14 AS c, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'billing' ELSE 'support' END AS team, o_orderkey % 3 = 0 AS urgent, round(o_orderkey % 201 / 100::DOUBLE + 1, 6) AS stars FROM orders),
      r AS (SELECT *, CASE c WHEN 3 THEN 'outside:team' WHEN 4 THEN 'outside:urgent' WHEN 5 THEN 'outside:tags' WHEN 6 THEN 'outside:stars' WHEN 7 THEN 'missing:stars' WHEN 8 THEN 'unknown_output' WHEN 9 THEN 'not_an_object' WHEN 10 THEN 'not_an_object' WHEN 13 THEN 'not_an_object' END AS reason FROM o)
      SELECT o_orderkey, reason, CASE WHEN reason IS NULL AND c NOT IN (1, 2) THEN team END AS team, CASE WHEN reason IS NULL THEN urgent END AS urgent, CASE WHEN reason IS NULL THEN CASE c WHEN 11 THEN '' WHEN 12 THEN 'bug' ELSE 'bug,docs' END END AS tags, CASE WHEN reason IS NULL THEN stars END AS stars FROM r""",
    "i11_batch_inputs": """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '{"ticket":"' || c_custkey || '"};{"ticket": "b"}' WHEN 1 THEN '{"ticket":"1"}' || CASE WHEN c_nationkey > 0 THEN ';{"ticket":"2"}' ELSE '' END WHEN 2 THEN '' END AS inputs,
      CAST(CASE c_custkey % 6 WHEN 0 THEN 3 WHEN 1 THEN greatest(c_nationkey - 1, 0) WHEN 2 THEN 0 END AS INTEGER) AS rejected FROM customer""",
    "r01_python_imports": """WITH f AS (SELECT DISTINCT unnest(list_filter(['p' || s_nationkey || '/m' || s_suppkey || '.py', CASE WHEN s_suppkey % 3 = 0 THEN 'lib1/deep/m' || s_suppkey || '.py' END, CASE WHEN s_suppkey % 6 = 0 THEN 'lib2/deep/m' || s_suppkey || '.py' END,
          CASE WHEN s_nationkey % 5 = 0 THEN 'p' || s_nationkey || '/__init__.py' END, CASE WHEN s_suppkey % 7 = 0 THEN 'src/m' || s_suppkey || '.py' END], lambda x: x IS NOT NULL)) AS rel FROM supplier),
      i AS (SELECT p_partkey AS id, p_partkey % 7 AS c, 'm' || (p_partkey % 120) || '.py' AS m, 'p' || (p_partkey % 25) AS y FROM part),
      e AS (SELECT id, CASE c WHEN 0 THEN [y || '/' || m] WHEN 1 THEN [y || '/' || m] WHEN 2 THEN CASE WHEN y || '/__init__.py' IN (SELECT rel FROM f) THEN [m, 'src/' || m] ELSE [y || '/' || m, m, 'src/' || m] END WHEN 6 THEN [y || '/__init__.py'] ELSE [] END AS t,
            CASE WHEN c = 1 THEN y || '/' || m WHEN c = 5 THEN 'deep/' || m END AS suffix FROM i),
      x AS (SELECT id, min(k) AS k FROM (SELECT id, unnest(t) AS rel, unnest(range(1, len(t) + 1)) AS k FROM e) JOIN f USING (rel) GROUP BY 1),
      s AS (SELECT suffix, CASE WHEN count(*) = 1 THEN min(rel) END AS hit FROM (SELECT DISTINCT suffix FROM e WHERE suffix IS NOT NULL) JOIN f ON rel = suffix OR ends_with(rel, '/' || suffix) GROUP BY 1)
      SELECT e.id, coalesce(t[x.k], hit) AS target FROM e LEFT JOIN x ON x.id = e.id LEFT JOIN s ON s.suffix = e.suffix""",
    "r02_ts_imports": """WITH f AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'w' || s_nationkey || '/m' || s_suppkey || '.ts' ELSE 'w' || s_nationkey || '/m' || s_suppkey || '/index.tsx' END AS rel FROM supplier UNION SELECT 'x/m' || s_suppkey || '.ts' FROM supplier WHERE s_suppkey % 10 = 0),
      i AS (SELECT p_partkey AS id, p_partkey % 7 AS c, 'm' || (p_partkey % 120) AS m, 'w' || (p_partkey % 25) AS y FROM part),
      b AS (SELECT id, c, m, CASE WHEN c IN (0, 1, 2, 3) THEN y || '/' || m END AS base FROM i),
      x AS (SELECT id, min(rel) AS hit FROM b JOIN f ON rel = base || '.ts' OR (c <> 1 AND rel = base || '/index.tsx') GROUP BY 1),
      s AS (SELECT m, CASE WHEN count(*) FILTER (ends_with(rel, '.ts')) = 1 THEN min(rel) FILTER (ends_with(rel, '.ts')) WHEN count(*) FILTER (ends_with(rel, '.ts')) = 0 AND count(*) = 1 THEN min(rel) END AS hit
            FROM (SELECT DISTINCT m FROM b) JOIN f ON ends_with(rel, '/' || m || '.ts') OR ends_with(rel, '/' || m || '/index.tsx') GROUP BY 1)
      SELECT b.id, CASE WHEN c = 6 THEN s.hit ELSE x.hit END AS target FROM b LEFT JOIN x ON x.id = b.id LEFT JOIN s ON s.m = b.m""",
    "t06_ts_import_gate": "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'ai_sdk,langchain' WHEN 3 THEN 'langchain' WHEN 6 THEN 'openai' ELSE '' END AS packages FROM pages",
    "x13_answer_spaces": """WITH p AS (SELECT p_partkey AS id, p_partkey AS k, p_brand AS b, p_name AS n, p_size AS s, p_partkey % 8 AS w,
        CASE WHEN p_partkey % 17 = 0 THEN 'unresolved:options' WHEN p_partkey % 19 = 0 THEN 'none' WHEN p_partkey % 8 = 5 THEN 'none' WHEN p_partkey % 8 = 6 THEN 'unresolved:$ref' ELSE 'resolved' END AS state FROM part),
      a AS (SELECT id, state, CASE WHEN w <> 7 THEN 'a' END AS name, CASE WHEN k % 5 = 0 THEN 'd ' || b END AS description, CASE WHEN k % 5 < 3 THEN 'choice' ELSE 'free' END AS kind,
        CASE k % 5 WHEN 0 THEN b || '|x|' || n WHEN 1 THEN b || '|x' WHEN 2 THEN b || '|' || n ELSE '' END AS options, k % 5 IN (1, 2) AS nullable, '' AS levels FROM p WHERE state = 'resolved'),
      r AS (SELECT *, s + k % 13 AS t FROM p),
      l AS (SELECT *, CASE WHEN k % 3 = 1 AND t > s THEN CASE WHEN t - s + 1 <= 10 THEN list_transform(range(0, t - s + 1), lambda i: CAST((s + i) * 100 AS BIGINT)) ELSE list_transform(range(0, 5), lambda i: CAST((s + (t - s) * i / 4::DOUBLE) * 100 AS BIGINT)) END END AS v FROM r),
      c AS (SELECT id, state, 'b' AS name, NULL AS description, CASE k % 3 WHEN 0 THEN 'yes_no' WHEN 1 THEN CASE WHEN v IS NULL THEN 'free' ELSE 'score' END ELSE 'labels' END AS kind, CASE WHEN k % 3 = 2 THEN b || '|' || n ELSE '' END AS options, false AS nullable, coalesce(array_to_string(v, ','), '') AS levels FROM l WHERE state = 'resolved' AND w <> 7)
      SELECT * FROM a UNION ALL SELECT * FROM c UNION ALL SELECT id, state, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE state <> 'resolved'""",
    "g08_callers": f"""WITH names AS (SELECT ['run', 'ask', 'route', 'create', 'grade', 'pick'] AS v),
      c AS (SELECT DISTINCT {AT} AS call, l_suppkey % 50 AS file, l_partkey % 2 = 0 AS python, v[l_partkey % 6 + 1] || CASE WHEN l_partkey % 1000 < 3 THEN '' ELSE '_' || (l_partkey % 1000) END AS name, CASE l_linenumber % 3 WHEN 1 THEN 'm' || (l_suppkey % 4) WHEN 2 THEN 'client' END AS object, l_partkey % 100 AS byte, l_orderkey % 2 = 0 AS kw, l_partkey % 50 AS t, l_partkey % 60 AS s FROM lineitem, names),
      w AS (SELECT p_partkey AS wrapper, p_partkey % 50 AS file, p_partkey % 60 AS start, p_partkey % 60 + 30 AS stop, p_partkey % 4 < 2 AS python, v[p_partkey % 6 + 1] || CASE WHEN p_partkey % 1000 < 3 THEN '' ELSE '_' || (p_partkey % 1000) END AS name, p_partkey % 3 = 0 AS method FROM part, names),
      n AS (SELECT DISTINCT s_suppkey % 50 AS file, 'm' || (s_nationkey % 3) AS object, s_nationkey % 50 AS target FROM supplier),
      m AS (SELECT DISTINCT file AS target, name, start FROM w WHERE NOT method),
      a AS (SELECT c.*, w.wrapper, w.file AS wf, w.start, w.stop, w.python AS wp, 'plain' AS how FROM c JOIN w ON w.file = c.t AND w.start = c.s WHERE object IS NULL AND NOT method
        UNION ALL SELECT c.*, w.wrapper, w.file, w.start, w.stop, w.python, 'namespace' FROM c JOIN n ON n.file = c.file AND n.object = c.object JOIN m ON m.target = n.target AND m.name = c.name JOIN w ON w.file = m.target AND w.start = m.start WHERE NOT method
        UNION ALL SELECT c.*, w.wrapper, w.file, w.start, w.stop, w.python, 'method' FROM c JOIN w ON w.name = c.name WHERE method AND c.object IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.file = c.file AND n.object = c.object) AND (c.name NOT IN ('invoke', 'ainvoke', 'run', 'arun', 'call', 'acall', 'create', 'generate', 'agenerate', 'complete', 'acomplete', 'chat', 'achat', 'predict', 'query', 'stream', 'astream', 'send', 'request', 'execute') OR kw))
      SELECT DISTINCT call, wrapper, how FROM a WHERE python = wp AND NOT (file = wf AND start <= byte AND byte < stop)""",
    "g09_eligible": "SELECT p_partkey, p_partkey % 13 <> 0 AND (p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR (p_partkey % 2 = 0 AND (p_partkey % 4 > 1 OR p_partkey % 3 <> 0))) AS eligible FROM part",
}
