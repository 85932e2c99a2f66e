"""Queries of exports and their verification, each with DuckDB SQL of the same columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkgate.operators import evidence, export, judge, metrics, runs
from sparkgate.plans.catalogue import SWEEP, attempts, m01, m02, m04, table
from sparkgate.plans.records import SQL as RECORD_SQL
from sparkgate.plans.records import calls
from sparkgate.session import materialize


def records(spark, sf):
    """A record of every event; its input is JSON that is not canonical."""
    k = F.col("event_id")
    split = F.lit("")
    e = table(spark, sf, "events").select(k, F.format_string('{"z": %d.0, "a": "%s"}', k, F.col("event_type")).alias("input"), F.sha2(F.format_string('{"a":"%s","z":%d}', F.col("event_type"), k), 256).alias("input_hash"), F.lit("supplied").alias("origin"), split.alias("split"), F.when(k % 5 == 0, "not_run").otherwise("ok").alias("reference_status"), F.when(k % 5 != 0, F.format_string('{"v" : %d}', k % 3)).alias("reference"))
    ranked = export.numbered(e)
    total = ranked.agg(F.count("*").alias("_n"))
    return ranked.join(F.broadcast(total)).withColumn("split", F.when(F.col("at") <= F.floor(F.col("_n") / 2), "calibration").otherwise("held_out")).drop("_n")


_records = """r AS (
  SELECT event_id, '{"a":"' || event_type || '","z":' || event_id || '}' AS input, CASE WHEN event_id % 5 = 0 THEN 'not_run' ELSE 'ok' END AS status, CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '{"v":' || (event_id % 3) || '}' END AS reference FROM events),
n AS (SELECT *, sha256(input) AS hash, row_number() OVER (ORDER BY sha256(input)) AS i, count(*) OVER () AS n FROM r),
l AS (SELECT *, '"input_hash":"' || hash || '","origin":"supplied","reference":' || reference || ',"reference_status":"' || status || '","split":"' || CASE WHEN i <= n // 2 THEN 'calibration' ELSE 'held_out' END || '"}' AS rest FROM n)"""
_digest = lambda c, name: f"{name}1 AS (SELECT (i - 1) // 1024 AS k, sha256(string_agg(sha256({c}), '' ORDER BY i)) AS h FROM l GROUP BY 1), {name} AS (SELECT sha256(string_agg(h, '' ORDER BY k)) AS h FROM {name}1)"
_digests = f"{_records}, {_digest(chr(39) + '{' + chr(34) + 'input' + chr(34) + ':' + chr(39) + ' || input || ' + chr(39) + ',' + chr(39) + ' || rest', 'd')}, {_digest(chr(39) + '{' + chr(39) + ' || rest', 'e')}"


def e01(spark, sf):
    return export.dataset_lines(records(spark, sf)).select("at", "input_hash", "line")


def e02(spark, sf):
    return export.digests(records(spark, sf))


PROTOCOL, REFERENCE = '{"target": 0.9, "split_rule": "hash_order_half"}', '{"model": "r"}'


def recorded(spark, sf):
    """The records, what results say of them, and a policy that agrees."""
    rows = records(spark, sf)
    fixed = {"split_rule": export.SPLIT_RULE, "reference": REFERENCE, "protocol": PROTOCOL, "policy_evidence": "measured", "target": 0.9, "min_accepted": 20, "threshold": 0.8, "model": "m", "definition_revision": "d"}
    made = export.digests(rows)
    results = made.select("dataset", export.revision(F.col("evidence"), F.lit(REFERENCE), F.lit(PROTOCOL)).alias("revision"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    results = materialize(results, "results")
    policy = results.select("revision", "dataset", F.lit("measured").alias("evidence"), "target", "min_accepted", "model", "definition_revision", F.create_map(F.lit("team"), F.lit(0.8), F.lit("stars"), F.lit(0.8)).alias("thresholds"))
    return rows, results, policy


def e03(spark, sf):
    return export.verify(*recorded(spark, sf))


def e04(spark, sf):
    """Changed inputs (every 97th), repeated lines (every 83rd), rows in the wrong half (every 89th), and a policy of another target and threshold."""
    rows, results, policy = recorded(spark, sf)
    k = F.col("event_id")
    again = rows.unionByName(rows.where(k % 83 == 0).withColumn("origin", F.lit("again")))
    ranked = export.global_rank(again.drop("at", "split"), ["input_hash", F.col("origin") == "again"], "at")
    total = ranked.agg(F.count("*").alias("_n"))
    rule = F.col("at") <= F.floor(F.col("_n") / 2)
    split = F.when(rule == (k % 89 != 0), "calibration").otherwise("held_out")
    planted = ranked.join(F.broadcast(total)).withColumn("split", split).withColumn("input", F.when(k % 97 == 0, F.replace("input", F.lit('"a"'), F.lit('"b"'))).otherwise(F.col("input"))).drop("_n")
    return export.verify(planted, results, policy.withColumn("target", F.lit(0.5)).withColumn("thresholds", F.create_map(F.lit("team"), F.lit(0.8), F.lit("stars"), F.lit(0.7))))


def e05(spark, sf):
    return export.results_json(e02(spark, sf), m02(spark, sf), m04(spark, sf), m01(spark, sf))


def e06(spark, sf):
    return export.run_json(runs.call_totals(runs.answered_calls(*calls(spark, sf)), 100.0), judge.ledger_totals(attempts(spark, sf)))


def e07(spark, sf):
    by = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 20).alias("hits"))
    low, _ = metrics.wilson(F.col("hits"), F.col("n"))
    u = F.col("user_id")
    return export.policies(by.select(u.alias("id"), "n", evidence.policy_blockers(u % 5 != 0, F.when(u % 3 != 0, F.lit(0.8)), low, F.col("n"), 0.1, 2).alias("reasons")))


QUERIES = {"e01_dataset_lines": e01, "e02_digests": e02, "e03_verify_clean": e03, "e04_verify_planted": e04, "e05_results": e05, "e06_run_record": e06, "e07_policies": e07}

_checks = lambda values: "SELECT * FROM (VALUES " + ", ".join(f"('{c}', CAST(({v}) AS BIGINT))" for c, v in values.items()) + ') t("check", n)'
_names = ["rehash", "order", "split", "split_rule", "dataset", "revision", "policy_exists", "policy_revision", "policy_dataset", "policy_evidence", "policy_target", "policy_min_accepted", "policy_threshold", "policy_model", "policy_definition"]
_planted = dict.fromkeys(_names, "0") | {
    "rehash": "SELECT count(*) + count(*) FILTER (event_id % 83 = 0) FROM events WHERE event_id % 97 = 0", "order": "SELECT count(*) FROM events WHERE event_id % 83 = 0", "split": "SELECT count(*) + count(*) FILTER (event_id % 83 = 0) FROM events WHERE event_id % 89 = 0",
    "dataset": "1", "revision": "1", "policy_revision": "1", "policy_dataset": "1", "policy_target": "1", "policy_threshold": "1",
}
_low = f"greatest(0::DOUBLE, ((hits / n::DOUBLE) + {metrics.Z * metrics.Z!r}::DOUBLE / (2 * n)) / (1 + {metrics.Z * metrics.Z!r}::DOUBLE / n) - {metrics.Z!r}::DOUBLE * sqrt((hits / n::DOUBLE) * (1 - hits / n::DOUBLE) / n + {metrics.Z * metrics.Z!r}::DOUBLE / (4::DOUBLE * n * n)) / (1 + {metrics.Z * metrics.Z!r}::DOUBLE / n))"

SQL = {
    "e01_dataset_lines": f"WITH {_records} SELECT i AS \"at\", hash AS input_hash, '{{\"input\":' || input || ',' || rest AS line FROM l",
    "e02_digests": f"WITH {_digests} SELECT (SELECT count(*) FROM l) AS n, d.h AS dataset, e.h AS evidence FROM d, e",
    "e03_verify_clean": _checks(dict.fromkeys(_names, "0")),
    "e04_verify_planted": _checks(_planted),
    "e05_results": f"""WITH {SWEEP}, {_digests.replace('r AS (', 'ev AS (', 1).replace('FROM r)', 'FROM ev)', 1)},
      s AS (SELECT string_agg('{{"split":"' || split || '","unique_inputs":' || u || ',"valid":' || v || ',"ref_failed":' || r || ',"cand_failed":' || c || '}}', ',' ORDER BY split) AS s
        FROM (SELECT split, count(*) AS u, count(*) FILTER (ref_ok AND cand_ok) AS v, count(*) FILTER (NOT ref_ok) AS r, count(*) FILTER (NOT cand_ok) AS c FROM records GROUP BY 1)),
      h AS (SELECT count(*) AS n, count(*) FILTER (r.gate >= g.threshold) AS accepted, count(*) FILTER (r.gate >= g.threshold AND agrees) AS agreed FROM records r, gate g WHERE ref_ok AND cand_ok AND split = 'held_out')
      SELECT '{{"dataset":{{"n":' || (SELECT count(*) FROM l) || ',"sha256":"' || d.h || '"}},"evidence":"' || e.h || '","gate":{{"gate_k":' || coalesce(CAST(k AS VARCHAR), 'null') || ',"defer_all":' || CASE WHEN defer_all THEN 'true' ELSE 'false' END || '}},"held_out":{{"n":' || h.n || ',"accepted":' || h.accepted || ',"agreed":' || h.agreed || '}},"splits":[' || s || ']}}' AS json FROM d, e, gate, h, s""",
    "e06_run_record": "WITH t AS (" + RECORD_SQL["m19_call_totals"] + "), x AS (SELECT CAST(round(value * 100) AS BIGINT) AS reserved, CASE WHEN event_id % 4 <> 0 THEN CAST(floor(CAST(round(value * 100) AS BIGINT) * 2 / 3::DOUBLE) AS BIGINT) END AS actual, event_type = 'error' AS failed, CASE WHEN event_id % 6 <> 0 THEN [200, 400, 401, 408, 429, 500][event_id % 6 + 1] END AS status FROM events), c AS (SELECT *, CASE WHEN failed THEN CASE WHEN status IS NOT NULL AND NOT status BETWEEN 200 AND 299 AND status <> 408 AND status < 500 THEN 0 ELSE reserved END ELSE coalesce(actual, reserved) END AS c FROM x), g AS (SELECT CAST(sum(c) AS BIGINT) AS charged, CAST(sum(c) FILTER (NOT failed AND actual IS NULL) AS BIGINT) AS estimated, CAST(sum(actual) FILTER (NOT failed) AS BIGINT) AS actual, count(*) FILTER (failed) AS failed FROM c) SELECT '{\"cache\":{\"calls\":' || calls || ',\"hits\":' || hits || ',\"misses\":' || misses || '},\"call_duration_ms\":' || ms || ',\"ledger\":{\"actual\":' || actual || ',\"charged\":' || charged || ',\"estimated\":' || estimated || ',\"failed\":' || failed || '},\"unpriced\":' || unpriced || '}' AS json FROM t, g",
    "e07_policies": f"WITH b AS (SELECT user_id, count(*) AS n, count(*) FILTER (value >= 20) AS hits FROM events GROUP BY 1) SELECT user_id AS id, n FROM b WHERE user_id % 5 <> 0 AND user_id % 3 <> 0 AND {_low} >= 0.1 AND n >= 2",
}
