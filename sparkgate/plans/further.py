"""Further queries, each with DuckDB SQL of the same columns: evidence, answers, resolving joins, dispositions and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkgate.operators import evidence, graph, judge, metrics, resolve
from sparkgate.plans.catalogue import ALL_EDGES, RECORDS, all_edges, table, tries, valid
from sparkgate.session import materialize, scratch_path
from sparkgate.sources import files
from sparkgate.streaming import flows, ledger


def m14(spark, sf):
    v = valid(spark, sf, "held_out").withColumn("passed", F.col("gate") >= 0.8)
    one = lambda name, same: F.struct(F.lit(name).alias("output"), same.alias("same"))
    long = v.select("passed", F.explode(F.array(one("quality", F.col("agrees")), one("toxic", F.col("toxic") == (1 - F.col("p") >= 0.3)))).alias("x")).select("passed", "x.*")
    return evidence.output_agreement(long)


def m15(spark, sf):
    k = F.col("first_id")
    rows = valid(spark, sf, "held_out").select("agrees", F.when(k % 4 == 1, "failed").when(k % 4 > 1, "ok").alias("verdict_status"), F.element_at(F.array(*map(F.lit, ("reference", "candidate", "both", "neither"))), (k % 7 % 4 + 1).cast("int")).alias("sided_with"))
    return evidence.adjudication(rows)


def m16(spark, sf):
    li, price = table(spark, sf, "lineitem"), F.round("l_extendedprice").cast("long")
    return evidence.run_estimate(li.select(F.col("l_orderkey").alias("site"), F.col("l_linenumber").alias("at"), F.concat("l_returnflag", "l_linenumber").alias("stage"), F.col("l_quantity").cast("long").alias("requests"), F.col("l_quantity").cast("long").alias("concurrent"), price.alias("expected"), (price * 2).alias("worst"), price.alias("reservation")))


def m17(spark, sf):
    priced = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_suppkey") % 10 != 0, F.col("l_returnflag")).alias("price"))
    return priced.groupBy("l_orderkey").agg(evidence.unanimous(F.col("price")).alias("price"))


def m18(spark, sf):
    by = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 20).alias("hits"))
    low, _ = metrics.wilson(F.col("hits"), F.col("n"))
    u = F.col("user_id")
    reasons = evidence.policy_blockers(u % 5 != 0, F.when(u % 3 != 0, F.lit(0.8)), low, F.col("n"), 0.5, 100, u % 11 == 0)
    return by.select("user_id", F.array_join(reasons, ",").alias("reasons"))


def j08(spark, sf):
    """A policy gives every fourth key of its definition under another number."""
    p, key = F.col("p_partkey"), F.col("p_size").cast("long")
    k = table(spark, sf, "part").select((p % 100).cast("long").alias("id"), key.alias("key"), F.when(p % 4 == 0, key + 100).otherwise(key).alias("given"))
    return evidence.coverage_problems(k.select("id", "key"), k.select("id", F.col("given").alias("key")))


def i08(spark, sf):
    return evidence.order_violations(table(spark, sf, "events").select("event_id", "value"), "event_id", "value").select("event_id")


def i09(spark, sf):
    return evidence.field_names(table(spark, sf, "events"), "props")


def i12(spark, sf):
    k = F.col("c_custkey")
    line = (
        F.when(k % 6 == 0, F.format_string('{"site": "s%d", "input": {"k":%d}}', k, k)).when(k % 6 == 1, F.format_string('{"site": "s%d", "input": {"k":1}, "reference": {"a":%d}}', k, k))
        .when(k % 6 == 2, "  ").when(k % 6 == 3, '{"site": 5, "input": {}}').when(k % 6 == 4, "[1]").otherwise('{"site": "s", "input": {"k":1}, "x": 1}')
    )
    path = scratch_path(spark, "supplied")
    table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return files.supplied_rows(files.numbered_lines(spark, path)).select("site", "input", "reference", "invalid")


def cache_tables(spark, sf):
    e = table(spark, sf, "events")
    entries = e.select(F.sha2(F.when(F.length("props") == 8, F.concat("props", F.lit("x"))).otherwise(F.col("props")), 256).alias("key"), F.col("props").alias("request"), F.upper("props").alias("response")).distinct()
    return e.select("event_id", F.sha2("props", 256).alias("key")), entries


def r03(spark, sf):
    requests, cache = cache_tables(spark, sf)
    return resolve.cached(requests, cache).select("event_id", "response", "hit")


def r04(spark, sf):
    """Replies to orders in the cache, newer ones of customers under some of its keys and some of their own."""
    key = lambda c: F.sha2(c.cast("string"), 256).alias("key")
    cache = table(spark, sf, "orders").select(key(F.col("o_custkey") % 100), F.lit("old").alias("request"), F.format_string("%09d", "o_orderkey").alias("response"))
    return resolve.upserted(cache, table(spark, sf, "customer").select(key(F.col("c_custkey") % 70 + 50), F.col("c_mktsegment").alias("request"), F.format_string("%09d", "c_custkey").alias("response")))


def models(spark, sf):
    k = F.col("c_custkey")
    price = F.when(k % 7 == 0, "x").when(k % 5 == 0, "-1").otherwise(k.cast("string"))
    return table(spark, sf, "customer").select(k.alias("at"), F.when(k % 13 != 0, F.concat(F.lit("m"), k % 400)).alias("id"), price.alias("prompt"), F.when(k % 2 == 0, "0.5").alias("completion"))


def r05(spark, sf):
    return resolve.first_models(models(spark, sf))


def r06(spark, sf):
    calls = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("m"), F.col("o_custkey") % 500).alias("model"))
    return resolve.resolve_model(calls, models(spark, sf).where("id is not null"), "default").select("o_orderkey", "catalogue_id")


def r07(spark, sf):
    k = F.col("o_custkey").cast("string")
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("source:"), k)).otherwise(k).alias("site"))
    return resolve.rows_of_sites(rows, table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))).select("o_orderkey", "site_id")


def r08(spark, sf):
    return resolve.unmatched(table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("id")), table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), ["id"])


def g06(spark, sf):
    li = table(spark, sf, "lineitem")
    return graph.occurrence_status(li.select(F.col("l_orderkey").alias("occ"), (F.col("l_returnflag") == "N").alias("fold"), F.col("l_linestatus").alias("canonical"), (F.col("l_suppkey") % 2).alias("definition")))


def g07(spark, sf):
    return disposed(materialize(all_edges(spark, sf), "edges"))


def disposed(e):
    ends = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    k = F.col("node")
    status = F.when(k % 6 == 0, "ambiguous").when(k % 6 == 1, "multiple_decisions").when(k % 6 < 4, "folded").otherwise("distinct")
    called = e.select(F.col("dst").alias("node")).distinct().withColumn("wrapper", F.lit(True))
    nodes = ends.join(called, "node", "left").select("node", (k % 7 == 0).alias("direct"), F.coalesce("wrapper", F.lit(False)).alias("wrapper"), (k % 11 == 3).alias("exceeded"), F.when(k % 5 != 4, status).alias("status"))
    return graph.dispositions(nodes, e)


def arrivals(spark, sf, name):
    """A table as a stream. A stream reads a folder, so the table is written to one."""
    rows, path = table(spark, sf, name), scratch_path(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def x01(spark, sf):
    stream = flows.in_order(tries(spark, sf), spark, "events", "seq")
    return flows.drained(flows.admitted(stream, 100_000), spark, "admitted").select("run", F.col("seq").alias("event_id"), "admitted")


def x02(spark, sf):
    stream = arrivals(spark, sf, "conversations")
    n = F.octet_length("text")
    judged = judge.judged(stream, [("invalid_request", n == 0), ("invalid_input", n > 3000)], [("policy_missing", F.col("conv_id") % 11 == 0), ("low_confidence", n % 4 == 0)])
    return flows.drained(judged.select("conv_id", "turn", "status", "reason"), spark, "judged")


def spending(spark, sf):
    """Ledger events of a table of events: each user's purchases hold an amount, later events of the same attempt settle it, fail it or let it go, some users cancel."""
    k, v = F.col("event_id"), (F.col("value") * 100).cast("long")
    kind = F.when(k % 5 < 2, "reserve").when(k % 5 == 2, "settle").when(k % 5 == 3, "fail").when(k % 97 == 4, "cancel").otherwise("release")
    amount = F.when(k % 11 == 0, F.lit(None).cast("long")).when(k % 13 == 0, -v).otherwise(v)
    return table(spark, sf, "events").select(F.col("user_id").cast("long").alias("run"), k.cast("long").alias("seq"), F.timestamp_seconds(F.lit(1_700_000_000) + k).alias("at"), kind.alias("kind"), (F.floor(k / 5) % 3).alias("attempt"), amount.alias("amount"), F.when(k % 3 > 0, (F.lit(200) + k % 4 * 104).cast("int")).alias("status"))


def x03(spark, sf):
    was = spark.conf.get(ledger.PROVIDER)
    spark.conf.set(ledger.PROVIDER, ledger.ROCKS)
    try:
        return flows.drained(ledger.ledger(flows.in_order(spending(spark, sf), spark, "spending", "seq"), 100_000, 600_000), spark, "ledger")
    finally:
        spark.conf.set(ledger.PROVIDER, was)


QUERIES = {
    "m14_output_agreement": m14, "m15_adjudication": m15, "m16_run_estimate": m16, "m17_recorded_price": m17, "m18_policy_blockers": m18, "j08_policy_coverage": j08, "i08_order_violations": i08,
    "i09_field_names": i09, "i12_supplied_rows": i12, "r03_cache_lookup": r03, "r04_cache_upsert": r04,
    "r05_model_catalogue": r05, "r06_resolve_model": r06, "r07_rows_of_sites": r07, "r08_unmatched_keys": r08, "g06_occurrence_status": g06, "g07_dispositions": g07, "x01_stream_admission": x01, "x02_stream_judge": x02, "x03_stream_ledger": x03,
}

Z2 = repr(metrics.Z * metrics.Z) + "::DOUBLE"
_low = f"greatest(0::DOUBLE, ((hits / n::DOUBLE) + {Z2} / (2 * n)) / (1 + {Z2} / n) - {metrics.Z!r}::DOUBLE * sqrt((hits / n::DOUBLE) * (1 - hits / n::DOUBLE) / n + {Z2} / (4::DOUBLE * n * n)) / (1 + {Z2} / n))"
_held = f"WITH {RECORDS}, v AS (SELECT * FROM records WHERE ref_ok AND cand_ok AND split = 'held_out')"
_models = "m AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 13 <> 0 THEN 'm' || (c_custkey % 400) END AS id, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 THEN CAST(c_custkey AS DOUBLE) END AS prompt, CASE WHEN c_custkey % 2 = 0 THEN 0.5::DOUBLE END AS completion FROM customer)"

SQL = {
    "m14_output_agreement": f"{_held}, x AS (SELECT 'quality' AS output, agrees AS same, gate >= 0.8::DOUBLE AS passed FROM v UNION ALL SELECT 'toxic', toxic = (1 - p >= 0.3::DOUBLE), gate >= 0.8::DOUBLE FROM v) SELECT output, count(*) FILTER (passed) AS accepted, count(*) FILTER (passed AND same) AS accepted_same, count(*) AS valid, count(*) FILTER (same) AS valid_same FROM x GROUP BY 1",
    "m15_adjudication": f"{_held}, x AS (SELECT first_id % 4 AS s, first_id % 7 % 4 AS w FROM v WHERE NOT agrees) SELECT count(*) AS disagreements, count(*) FILTER (s > 1) AS adjudicated, count(*) FILTER (s = 1) AS failed, count(*) FILTER (s = 0) AS not_run, count(*) FILTER (s > 1 AND w = 0) AS sided_reference, count(*) FILTER (s > 1 AND w = 1) AS sided_candidate, count(*) FILTER (s > 1 AND w = 2) AS sided_both, count(*) FILTER (s > 1 AND w = 3) AS sided_neither FROM x",
    "m16_run_estimate": "WITH s AS (SELECT *, CAST(round(l_extendedprice) AS BIGINT) AS e, CAST(l_quantity AS BIGINT) AS q FROM lineitem), t AS (SELECT l_returnflag || l_linenumber AS stage, least(q, 8) * e AS held FROM s ORDER BY least(q, 8) * e DESC, l_orderkey, l_linenumber LIMIT 1) SELECT CAST(sum(e) AS BIGINT) AS expected, CAST(sum(2 * e) AS BIGINT) AS worst, CAST(sum(q) AS BIGINT) AS requests, (SELECT stage FROM t) AS largest_stage, (SELECT held FROM t) AS in_flight FROM s",
    "m17_recorded_price": "WITH p AS (SELECT l_orderkey, CASE WHEN l_suppkey % 10 <> 0 THEN l_returnflag END AS p FROM lineitem) SELECT l_orderkey, CASE WHEN count(p) = count(*) AND min(p) = max(p) THEN min(p) END AS price FROM p GROUP BY 1",
    "m18_policy_blockers": f"WITH b AS (SELECT user_id, count(*) AS n, count(*) FILTER (value >= 20) AS hits FROM events GROUP BY 1), w AS (SELECT *, {_low} AS low FROM b) SELECT user_id, array_to_string(list_filter([CASE WHEN user_id % 5 = 0 THEN 'not_completed' END, CASE WHEN user_id % 3 = 0 THEN 'defer_all' END, CASE WHEN low < 0.5 THEN 'below_target' END, CASE WHEN n < 100 THEN 'too_few_accepted' END, CASE WHEN user_id % 11 = 0 THEN 'prompt_reconstructed' END], lambda x: x IS NOT NULL), ',') AS reasons FROM w",
    "j08_policy_coverage": "WITH n AS (SELECT CAST(p_partkey % 100 AS BIGINT) AS id, CAST(p_size AS BIGINT) AS key FROM part), g AS (SELECT CAST(p_partkey % 100 AS BIGINT) AS id, CAST(p_size + CASE WHEN p_partkey % 4 = 0 THEN 100 ELSE 0 END AS BIGINT) AS key FROM part) SELECT *, 'missing' AS problem FROM (SELECT * FROM n EXCEPT SELECT * FROM g) UNION ALL SELECT *, 'unknown' FROM (SELECT * FROM g EXCEPT SELECT * FROM n)",
    "i08_order_violations": "SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (ORDER BY event_id) AS b FROM events) WHERE b >= value",
    "i09_field_names": "SELECT DISTINCT unnest(json_keys(props)) AS name FROM events",
    "i12_supplied_rows": """SELECT CASE WHEN c_custkey % 6 < 2 THEN 's' || c_custkey END AS site, CASE c_custkey % 6 WHEN 0 THEN '{"k":' || c_custkey || '}' WHEN 1 THEN '{"k":1}' END AS input, CASE WHEN c_custkey % 6 = 1 THEN '{"a":' || c_custkey || '}' END AS reference, c_custkey % 6 > 1 AS invalid FROM customer WHERE c_custkey % 6 <> 2""",
    "r03_cache_lookup": "SELECT e.event_id, c.response, c.request IS NOT NULL AS hit FROM events e LEFT JOIN (SELECT DISTINCT props AS request, upper(props) AS response FROM events WHERE length(props) <> 8) c ON c.request = e.props",
    "r04_cache_upsert": "WITH b AS (SELECT sha256(CAST(o_custkey % 100 AS VARCHAR)) AS key, 0 AS new, 'old' AS request, format('{:09d}', o_orderkey) AS response FROM orders UNION ALL SELECT sha256(CAST(c_custkey % 70 + 50 AS VARCHAR)), 1, c_mktsegment, format('{:09d}', c_custkey) FROM customer) SELECT key, request, response FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY new DESC, request DESC, response DESC) AS i FROM b) WHERE i = 1",
    "r05_model_catalogue": f"WITH {_models} SELECT id, prompt, completion FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS i FROM m WHERE id IS NOT NULL) WHERE i = 1",
    "r06_resolve_model": f"WITH {_models} SELECT o_orderkey, CASE WHEN 'm' || (o_custkey % 500) IN (SELECT id FROM m WHERE id IS NOT NULL) THEN 'm' || (o_custkey % 500) ELSE 'default' END AS catalogue_id FROM orders",
    "r07_rows_of_sites": "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT s_suppkey FROM supplier) THEN CAST(o_custkey AS VARCHAR) END AS site_id FROM orders",
    "r08_unmatched_keys": "WITH a AS (SELECT c_custkey * 2 AS id FROM customer), b AS (SELECT DISTINCT o_custkey AS id FROM orders) SELECT id, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT id, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "g06_occurrence_status": "SELECT l_orderkey AS occ, CASE WHEN count(*) FILTER (l_returnflag <> 'N') = 0 THEN 'folded' WHEN count(DISTINCT l_linestatus) FILTER (l_returnflag <> 'N') = 1 THEN 'distinct' WHEN count(DISTINCT l_suppkey % 2) FILTER (l_returnflag <> 'N') = 1 THEN 'multiple_decisions' ELSE 'ambiguous' END AS status FROM lineitem GROUP BY 1",
    "g07_dispositions": f"WITH RECURSIVE {ALL_EDGES}, ends AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), n AS (SELECT node, node % 7 = 0 AS direct, node IN (SELECT dst FROM edges) AS wrapper, node % 11 = 3 AS exceeded, CASE WHEN node % 5 <> 4 THEN CASE WHEN node % 6 = 0 THEN 'ambiguous' WHEN node % 6 = 1 THEN 'multiple_decisions' WHEN node % 6 < 4 THEN 'folded' ELSE 'distinct' END END AS status FROM ends), sound AS (SELECT e.*, n.status FROM edges e JOIN n ON n.node = e.src WHERE NOT direct AND NOT exceeded AND status IN ('folded', 'distinct')), ground(node) AS (SELECT node FROM ends WHERE node NOT IN (SELECT dst FROM sound) UNION SELECT e.dst FROM ground g JOIN sound e ON e.src = g.node), rep(node) AS (SELECT e.dst FROM sound e JOIN ground g ON g.node = e.src WHERE e.status = 'distinct' UNION SELECT e.dst FROM rep r JOIN sound e ON e.src = r.node), live(node) AS (SELECT node FROM ends WHERE node NOT IN (SELECT node FROM rep) UNION SELECT e.dst FROM live l JOIN sound e ON e.src = l.node AND e.fold), d AS (SELECT node, CASE WHEN direct THEN CASE WHEN NOT wrapper THEN 'direct' WHEN node NOT IN (SELECT dst FROM sound) THEN 'no_callers' WHEN node IN (SELECT node FROM live) THEN 'represented' ELSE 'hidden' END WHEN exceeded THEN 'depth_exceeded' WHEN status = 'distinct' AND node NOT IN (SELECT node FROM live) THEN 'hidden' ELSE status END AS disposition FROM n) SELECT * FROM d WHERE disposition IS NOT NULL",
    "x02_stream_judge": "WITH r AS (SELECT conv_id, turn, CASE WHEN strlen(text) = 0 THEN 'invalid_request' WHEN strlen(text) > 3000 THEN 'invalid_input' WHEN conv_id % 11 = 0 THEN 'policy_missing' WHEN strlen(text) % 4 = 0 THEN 'low_confidence' END AS reason FROM conversations) SELECT conv_id, turn, CASE WHEN reason IS NULL THEN 'accepted' WHEN reason LIKE 'invalid%' THEN 'error' ELSE 'deferred' END AS status, reason FROM r",
}
