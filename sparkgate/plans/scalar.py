"""Queries of scalar functions, normalized answers, pairs and reports, each with DuckDB SQL of the same columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkgate.functions import scalars as S
from sparkgate.operators import graph, metrics, normalize, runs, sites, validation
from sparkgate.plans.catalogue import SWEEP, sweep_of, table, valid
from sparkgate.plans.tabled import case, fill


def f01(spark, sf):
    d, x = table(spark, sf, "documents"), F.col("text")
    sha = lambda c, n: F.sha2(c, 256).alias(n)
    return d.select("doc_id", sha(S.compact(x), "compact"), S.short(x).alias("short"), sha(S.bounded(x), "bounded"), sha(S.cell(x), "cell"))


def f02(spark, sf):
    k = F.col("o_orderkey")
    template = case(k % 4, F.lit("To {{ name }}: {{total}} and {{gone}}."), F.lit("{{name}}{{name}} {{open"), F.lit("none }}"), F.lit("{{a\nb}}x{{ total}}"))
    fields = F.create_map(F.lit("name"), F.col("o_orderpriority"), F.lit("total"), k.cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", S.filled(template, fields).alias("text"))


def f03(spark, sf):
    n = F.octet_length("text")
    cost = S.chat_estimate(n, F.lit(100), F.lit(0.25), F.lit(0.5))
    return table(spark, sf, "conversations").select("conv_id", "turn", S.tokens(n).alias("tokens"), cost.alias("cost"), S.round_up(cost / 1e7).alias("shown"))


REASONS = ("invalid_input", "low_confidence", "timeout", "protocol_mismatch", "policy_stale", "authentication_failed")


def f04(spark, sf):
    reason = F.element_at(F.array(*map(F.lit, REASONS), F.lit(None).cast("string")), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf, "events").groupBy(reason.alias("reason"), S.status_of(reason).alias("status"), S.exit_code(S.status_of(reason)).alias("exit_code")).agg(F.count("*").alias("n"))


def f05(spark, sf):
    k = F.col("event_id")
    request = F.when(k % 13 == 0, "nope").otherwise(fill('{"z": {k}.50, "a": [1, "{t}"]}', k=k, t=F.col("event_type")))
    return table(spark, sf, "events").select("event_id", S.cache_key(F.lit("https://x/y"), F.concat(F.lit('m"'), F.col("event_type")), request, (k % 3).cast("int")).alias("key"))


OUTPUTS = [("team", "choice", {"required": True}), ("note", "choice", {"required": False}), ("tags", "labels", {"required": ["a", "b"]}), ("stars", "score", {"levels": [1.0, 2.0, 4.0]})]


def f06(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    texts = lambda *x: F.array(*map(F.lit, x))
    a = {"team": F.when(k % 11 != 0, F.lit("x")), "note": F.lit("n"), "tags": F.when(k % 3 == 0, texts("a", "c")).otherwise(texts("b")), "stars": (s % 4).cast("double")}
    b = {"team": F.when(k % 5 == 0, "y").otherwise("x"), "note": F.lit("m"), "tags": F.when(k % 7 == 0, texts("b", "a")).when(k % 3 == 0, texts("a")).otherwise(texts("c", "b")), "stars": (s % 3).cast("double") + 0.5}
    return table(spark, sf, "part").select("p_partkey", S.agree(a, b, OUTPUTS).alias("agrees"), S.same_set(a["tags"], b["tags"]).alias("same_tags"))


def n01(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    p = {"a": (s % 11) / F.lit(10.0), "b": F.when(k % 13 == 0, 1.5).otherwise((k % 10) / F.lit(10.0)), "c": (k % 7) / F.lit(8.0)}
    x = normalize.labels(p, {"a": 0.5, "b": 0.3, "c": 0.7}, {"a", "b"})
    rows = table(spark, sf, "part").select("p_partkey", x.alias("x"))
    return rows.select("p_partkey", F.array_join("x.value", ",").alias("labels"), F.round("x.gate", 9).alias("gate"), F.round(normalize.row_gate(F.col("x.gate"), F.lit(0.8)), 9).alias("row_gate"))


def n02(spark, sf):
    e = table(spark, sf, "embeddings")
    p = F.transform(F.slice("embedding", 1, 4), lambda v: F.when(F.col("vec_id") % 17 == 0, v.cast("double") * 9).otherwise(F.floor(F.abs(v) * 16).cast("double") / 16))
    x = normalize.score(p, [1.0, 2.0, 4.0, 8.0], F.lit(0.75))
    return e.select("vec_id", F.round(x["value"], 9).alias("value"), x["level"].alias("level"), x["gate"].alias("gate"))


def n04(spark, sf):
    k = F.col("p_partkey")
    labels = F.slice(F.array("p_brand", "p_type", "p_name", *map(F.lit, "abcdef")), F.lit(1), (k % 9 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", graph.short_path(labels).alias("path"))


def m22(spark, sf):
    gate = metrics.pick_gate(sweep_of(spark, sf)).select((F.col("threshold") + 0.2).alias("threshold"))
    tagged = metrics.triage(valid(spark, sf, "held_out").join(F.broadcast(gate)), F.col("threshold"))
    return sites.positioned(tagged, F.col("tag") != "confident_miss", F.col("hash")).select("hash", "tag", "position")


def m23(spark, sf):
    """Supplied labels as the reference, documents' own language as the candidate, of inputs that both know."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    ref = lab.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("hash"), (F.col("quality") == 1).alias("value"), (F.col("doc_id") % 23 != 0).alias("ok"))
    cand = d.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("hash"), (F.col("n_chars") % 2 == 0).alias("value"), (F.col("doc_id") % 19 != 0).alias("ok"))
    both = metrics.paired(ref, cand)
    return both.groupBy("ref_ok", "cand_ok").agg(F.count("*").alias("n"), F.count_if(F.col("ref_value") == F.col("cand_value")).alias("agreed"))


def k04(spark, sf):
    return S.markdown(table(spark, sf, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, F.lit("a|b\nc")).when(F.col("c_custkey") % 7 != 0, F.col("c_name"))), ["c_custkey", "c_name", "c_mktsegment"], "c_custkey")


def k07(spark, sf):
    return runs.preview(table(spark, sf, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], 50)


def g10(spark, sf):
    """Edges in the order of caller, wrapper, depth and label."""
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("caller"), F.concat(F.lit("w"), F.col("l_suppkey")).alias("wrapper"), F.col("l_linenumber").alias("depth"), F.col("l_returnflag").alias("label")).distinct()
    return sites.positioned(e, *map(F.col, ("caller", "wrapper", "depth", "label")))


def j15(spark, sf):
    """Registry entries by id, then project before user."""
    e = table(spark, sf, "customer").select(F.concat(F.lit("r"), F.col("c_custkey") % 700).alias("id"), F.when(F.col("c_custkey") % 3 == 0, "project").otherwise("user").alias("scope")).distinct()
    return sites.positioned(e, F.col("id"), F.col("scope") != "project")


def g11(spark, sf):
    k = F.col("p_partkey")
    w = table(spark, sf, "part").select(F.concat(F.lit("f"), k % 300).alias("name"), (k % 2 == 0).alias("python"), (k % 3 == 0).alias("method"), fill("lib/{b}/mod{k}.{x}", b=k % 9, k=k % 70, x=F.when(k % 2 == 0, "py").otherwise("d.ts")).alias("file"), (k % 5 != 0).alias("default"))
    return runs.frontier_words(w)


def s07(spark, sf):
    """A JSON document per customer, planted with every kind of fault; some are no JSON."""
    k = F.col("c_custkey")
    body = fill(
        '{"schema_version": "{v}", "id": "d{k}", "site_id": "{s}", "questions": {"q": {"type": "choice", "criteria": {"a": "x", "b": null}}, "r": {"type": "score", "criteria": ["low", "high"]}}, "outputs": [{"name": "o", "type": "choice", "question": "{q}", "nullable_option": "{n}"}, {"name": "{o}", "type": "score", "question": "r", "level_values": [{l}, 2.0]}]}',
        v=F.when(k % 11 == 0, "2.0").otherwise("1.0"), k=k, s=F.when(k % 7 == 0, "x").otherwise("source:x"), q=F.when(k % 5 == 0, "gone").when(k % 13 == 0, "r").otherwise("q"), n=F.when(k % 3 == 0, "c").otherwise("a"), o=F.when(k % 17 == 0, "o").otherwise("p"), l=F.when(k % 2 == 0, "1.0").otherwise("2.0"),
    )
    return validation.definition_problems(*runs.definition_tables(table(spark, sf, "customer").select(k, F.when(k % 19 == 0, "nope").otherwise(body).alias("json")), "c_custkey", "json"))


QUERIES = {"k07_preview": k07, "g10_edge_order": g10, "j15_registry_order": j15, "g11_frontier_words": g11, "s14_definition_documents": s07, "f01_strings": f01, "f02_filled": f02, "f03_estimates": f03, "f04_statuses": f04, "f05_cache_keys": f05, "f06_agree": f06, "n01_labels": n01, "n02_scores": n02, "n04_short_paths": n04, "m22_triage_order": m22, "m23_pairs": m23, "k04_report_table": k04}

_spaces = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_near = lambda x: f"list_position(list_transform([1::DOUBLE, 2, 4], lambda v: abs(v - {x})), list_min(list_transform([1::DOUBLE, 2, 4], lambda v: abs(v - {x}))))"

SQL = {
    "f01_strings": f"WITH c AS (SELECT doc_id, text, trim(regexp_replace(text, '{_spaces}', ' ', 'g'), ' ') AS x FROM documents) SELECT doc_id, sha256(replace(x, ' ', '')) AS compact, CASE WHEN length(x) > 60 THEN x[1:60] || '…' ELSE x END AS short, sha256(text[1:512]) AS bounded, sha256(replace(replace(text, '|', '\\|'), chr(10), ' ')) AS cell FROM c",
    "f02_filled": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'To ' || o_orderpriority || ': ' || o_orderkey || ' and .' WHEN 1 THEN o_orderpriority || o_orderpriority || ' {{open' WHEN 2 THEN 'none }}' ELSE 'x' || o_orderkey END AS text FROM orders",
    "f03_estimates": "WITH n AS (SELECT conv_id, turn, CAST(ceil(strlen(text) / 3::DOUBLE) AS BIGINT) AS t FROM conversations) SELECT conv_id, turn, t AS tokens, t * 0.25::DOUBLE + 50 AS cost, ceil((t * 0.25::DOUBLE + 50) / 1e7::DOUBLE * 1e6::DOUBLE) / 1e6::DOUBLE AS shown FROM n",
    "f04_statuses": "WITH r AS (SELECT ['invalid_input', 'low_confidence', 'timeout', 'protocol_mismatch', 'policy_stale', 'authentication_failed', NULL][event_id % 7 + 1] AS reason FROM events), s AS (SELECT reason, CASE WHEN reason IS NULL THEN 'accepted' WHEN reason IN ('low_confidence', 'timeout', 'policy_stale') THEN 'deferred' ELSE 'error' END AS status FROM r) SELECT reason, status, CASE WHEN status = 'error' THEN 1 ELSE 0 END AS exit_code, count(*) AS n FROM s GROUP BY ALL",
    "f05_cache_keys": """SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN sha256('{"endpoint":"https://x/y","model":"m\\"' || event_type || '","repeat":' || (event_id % 3) || ',"request":{"a":[1,"' || event_type || '"],"z":' || event_id || '.5}}') END AS key FROM events""",
    "f06_agree": f"""WITH p AS (SELECT p_partkey, p_partkey AS k, p_size % 4 AS x, p_size % 3 + 0.5::DOUBLE AS y, CASE WHEN p_partkey % 3 = 0 THEN ['a', 'c'] ELSE ['b'] END AS s, CASE WHEN p_partkey % 7 = 0 THEN ['b', 'a'] WHEN p_partkey % 3 = 0 THEN ['a'] ELSE ['c', 'b'] END AS t FROM part)
      SELECT p_partkey, k % 11 <> 0 AND k % 5 <> 0 AND list_contains(s, 'a') = list_contains(t, 'a') AND list_contains(s, 'b') = list_contains(t, 'b') AND {_near('x')} = {_near('y')} AS agrees, list_sort(s) = list_sort(t) AS same_tags FROM p""",
    "n01_labels": """WITH p AS (SELECT p_partkey, (p_size % 11) / 10::DOUBLE AS a, CASE WHEN p_partkey % 13 = 0 THEN 1.5::DOUBLE ELSE (p_partkey % 10) / 10::DOUBLE END AS b, (p_partkey % 7) / 8::DOUBLE AS c FROM part),
      x AS (SELECT *, round(least(greatest(a, 1 - a), greatest(b, 1 - b)), 9) AS g FROM p)
      SELECT p_partkey, CASE WHEN b <= 1 THEN array_to_string(list_filter([CASE WHEN a >= 0.5 THEN 'a' END, CASE WHEN b >= 0.3::DOUBLE THEN 'b' END, CASE WHEN c >= 0.7::DOUBLE THEN 'c' END], lambda v: v IS NOT NULL), ',') END AS labels, CASE WHEN b <= 1 THEN g END AS gate, CASE WHEN b <= 1 THEN least(g, 0.8::DOUBLE) ELSE 0.8::DOUBLE END AS row_gate FROM x""",
    "n02_scores": """WITH p AS (SELECT vec_id, list_transform(embedding[1:4], lambda v: CASE WHEN vec_id % 17 = 0 THEN v::DOUBLE * 9 ELSE floor(abs(v) * 16) / 16::DOUBLE END) AS p FROM embeddings),
      q AS (SELECT *, list_sum(p) AS t, len(list_filter(p, lambda v: v < 0 OR v > 1)) = 0 AND list_sum(p) > 0 AS ok FROM p)
      SELECT vec_id, CASE WHEN ok THEN round((p[1] + 2 * p[2] + 4 * p[3] + 8 * p[4]) / t, 9) END AS value, CASE WHEN ok THEN CAST(list_position(p, list_max(p)) - 1 AS INTEGER) END AS level, CASE WHEN ok THEN 0.75::DOUBLE END AS gate FROM q""",
    "n04_short_paths": "WITH l AS (SELECT p_partkey, [p_brand, p_type, p_name, 'a', 'b', 'c', 'd', 'e', 'f'][1:p_partkey % 9 + 1] AS l FROM part) SELECT p_partkey, array_to_string(l[1:5], ' > ') || CASE WHEN len(l) > 5 THEN ' > +' || (len(l) - 5) || ' more' ELSE '' END AS path FROM l",
    "m22_triage_order": f"WITH {SWEEP}, t AS (SELECT hash, CASE WHEN r.gate >= g.threshold + 0.2::DOUBLE THEN 'confident_miss' ELSE 'low_confidence' END AS tag FROM records r, gate g WHERE ref_ok AND cand_ok AND split = 'held_out' AND NOT agrees) SELECT hash, tag, row_number() OVER (ORDER BY tag <> 'confident_miss', hash) AS position FROM t",
    "m23_pairs": "SELECT d.doc_id % 23 <> 0 AS ref_ok, d.doc_id % 19 <> 0 AS cand_ok, count(*) AS n, count(*) FILTER ((quality = 1) = (n_chars % 2 = 0)) AS agreed FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2",
    "k04_report_table": """SELECT CAST(-1 AS BIGINT) AS position, '| c_custkey | c_name | c_mktsegment |' AS line UNION ALL SELECT 0, '| --- | --- | --- |' UNION ALL
      SELECT row_number() OVER (ORDER BY c_custkey), '| ' || c_custkey || ' | ' || CASE WHEN c_custkey % 5 = 0 THEN 'a\\|b c' WHEN c_custkey % 7 = 0 THEN '—' ELSE c_name END || ' | ' || c_mktsegment || ' |' FROM customer""",
    "k07_preview": "SELECT o_totalprice, o_orderkey FROM orders ORDER BY 1, 2 LIMIT 50",
    "g10_edge_order": "WITH e AS (SELECT DISTINCT l_partkey AS caller, 'w' || l_suppkey AS wrapper, l_linenumber AS depth, l_returnflag AS label FROM lineitem) SELECT *, row_number() OVER (ORDER BY caller, wrapper, depth, label) AS position FROM e",
    "j15_registry_order": "WITH e AS (SELECT DISTINCT 'r' || (c_custkey % 700) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'project' ELSE 'user' END AS scope FROM customer) SELECT *, row_number() OVER (ORDER BY id, scope) AS position FROM e",
    "g11_frontier_words": "SELECT DISTINCT 'f' || (p_partkey % 300) AS word FROM part UNION SELECT 'mod' || (p_partkey % 70) FROM part WHERE p_partkey % 2 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0",
    "s14_definition_documents": """WITH c AS (SELECT c_custkey AS k, c_custkey % 17 = 0 AS twice FROM customer),
      o AS (SELECT k, CASE WHEN twice THEN 'o:duplicate' WHEN k % 5 = 0 THEN 'o:unknown_question' WHEN k % 13 = 0 THEN 'o:question_kind' WHEN k % 3 = 0 THEN 'o:null_option' END AS a, CASE WHEN twice THEN NULL WHEN k % 2 <> 0 THEN 'p:level_order' END AS b FROM c),
      r AS (SELECT k AS definition, CASE WHEN k % 19 = 0 THEN 'schema_version' WHEN k % 11 = 0 THEN 'schema_version' WHEN k % 7 = 0 THEN 'site_id' ELSE coalesce(a, b) END AS problem FROM o)
      SELECT * FROM r WHERE problem IS NOT NULL""",
}
