"""Queries over the test tables for the reference's operators, each with DuckDB SQL of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgate.functions import text as T
from sparkgate.operators import graph, inputs, judge, metrics, normalize
from sparkgate.session import materialize

TARGET = 0.9


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by key: a table of one block feeds all tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key))


# --- An evaluation over documents and labels. The candidate is a fixed arithmetic rule on the text; it only exercises the operators.

RECORDS = r"""
base AS (
  SELECT sha256(d.text) AS hash, d.doc_id, l.quality, l.toxic, CAST(d.n_chars AS BIGINT) AS c,
         CAST(length(d.text) - length(translate(d.text, '#*$%&|', '')) AS BIGINT) AS sym
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
grouped AS (
  SELECT hash, count(*) AS occurrences, min(doc_id) AS first_id, arg_min(quality, doc_id) = 1 AS ref, arg_min(toxic, doc_id) = 1 AS toxic,
         arg_min(c, doc_id) AS c, arg_min(sym, doc_id) AS sym FROM base GROUP BY hash),
ranked AS (SELECT *, row_number() OVER (ORDER BY hash) AS rank, count(*) OVER () AS total FROM grouped),
scored AS (
  SELECT *, CASE WHEN rank <= total // 2 THEN 'calibration' ELSE 'held_out' END AS split,
         greatest(0.02::DOUBLE, least(0.98::DOUBLE, 0.6::DOUBLE + (c % 380) / 1000::DOUBLE - 4 * sym / greatest(c, 1)::DOUBLE)) AS p FROM ranked),
records AS (
  SELECT hash, occurrences, first_id, split, ref, toxic, p, c % 23 <> 0 AS ref_ok, c % 17 <> 0 AS cand_ok, p >= 0.5 AS cand, greatest(p, 1 - p) AS gate,
         (p >= 0.5) = ref AS agrees, c % 7 <> 0 AS rerun_agrees FROM scored)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    base = docs.join(labels, "doc_id").select(F.sha2("text", 256).alias("hash"), "doc_id", "quality", "toxic", F.col("n_chars").cast("long").alias("c"), (F.length("text") - F.length(F.translate("text", "#*$%&|", ""))).cast("long").alias("sym"))
    first = lambda c: F.min_by(c, "doc_id")
    grouped = base.groupBy("hash").agg(F.count("*").alias("occurrences"), F.min("doc_id").alias("first_id"), (first("quality") == 1).alias("ref"), (first("toxic") == 1).alias("toxic"), first("c").alias("c"), first("sym").alias("sym"))
    split = inputs.half_split(grouped)
    p = F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.lit(0.6) + (F.col("c") % 380) / F.lit(1000.0) - 4 * F.col("sym") / F.greatest(F.col("c"), F.lit(1)).cast("double")))
    answer = split.withColumn("p", p).withColumn("a", normalize.yes_no(F.col("p")))
    return answer.select("hash", "occurrences", "first_id", "split", "ref", "toxic", "p", (F.col("c") % 23 != 0).alias("ref_ok"), (F.col("c") % 17 != 0).alias("cand_ok"), F.col("a.value").alias("cand"), F.col("a.gate").alias("gate"), (F.col("a.value") == F.col("ref")).alias("agrees"), (F.col("c") % 7 != 0).alias("rerun_agrees"))


def valid(spark: SparkSession, sf: str, split: str) -> DataFrame:
    return records(spark, sf).where(F.col("ref_ok") & F.col("cand_ok") & (F.col("split") == split))


SWEEP = (
    RECORDS
    + f""",
cal AS (SELECT * FROM records WHERE ref_ok AND cand_ok AND split = 'calibration'),
sweep AS (
  SELECT CAST(k AS INTEGER) AS k, k / 20::DOUBLE AS threshold, count(*) FILTER (gate >= k / 20::DOUBLE) AS accepted, count(hash) AS n,
         count(*) FILTER (gate >= k / 20::DOUBLE AND agrees) AS agreed FROM range(21) t(k) LEFT JOIN cal ON true GROUP BY k),
swept AS (SELECT *, CASE WHEN accepted > 0 THEN agreed / accepted::DOUBLE END AS rate, coalesce(agreed / nullif(accepted, 0)::DOUBLE >= {TARGET}, false) AS qualifies FROM sweep),
gate AS (SELECT min(k) FILTER (qualifies) AS k, min(k) FILTER (qualifies) / 20::DOUBLE AS threshold, count(*) FILTER (qualifies) = 0 AS defer_all FROM swept)"""
)


def wilson_sql(c: str, n: str) -> tuple[str, str]:
    z2 = repr(metrics.Z * metrics.Z) + "::DOUBLE"
    p, m = f"({c} / {n}::DOUBLE)", f"{n}::DOUBLE"
    mid = f"({p} + {z2} / (2 * {m})) / (1 + {z2} / {m})"
    half = f"{metrics.Z!r}::DOUBLE * sqrt({p} * (1 - {p}) / {m} + {z2} / (4 * {m} * {m})) / (1 + {z2} / {m})"
    return f"CASE WHEN {n} > 0 THEN round(greatest(0::DOUBLE, {mid} - {half}), 12) END", f"CASE WHEN {n} > 0 THEN round(least(1::DOUBLE, {mid} + {half}), 12) END"


def sweep_of(spark, sf):
    return metrics.threshold_sweep(valid(spark, sf, "calibration"), TARGET)


def m01(spark, sf):
    gate = metrics.pick_gate(sweep_of(spark, sf))
    out = metrics.held_out_agreement(valid(spark, sf, "held_out"), gate)
    return out.withColumns({c: F.round(c, 12) for c in ("wilson_low", "wilson_high")})


def m02(spark, sf):
    n = lambda c, name: F.count_if(c).alias(name)
    r, c = F.col("ref_ok"), F.col("cand_ok")
    return records(spark, sf).groupBy("split").agg(F.count("*").alias("unique_inputs"), F.sum(F.col("occurrences") - 1).alias("duplicates"), n(r & c, "valid"), n(~r, "ref_failed"), n(~c, "cand_failed"))


def m03(spark, sf):
    return sweep_of(spark, sf)


def m04(spark, sf):
    return metrics.pick_gate(sweep_of(spark, sf))


def m05(spark, sf):
    by = table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") >= 50).alias("hits"), F.count("*").alias("n"))
    low, high = metrics.wilson(F.col("hits"), F.col("n"))
    return by.select("event_type", "hits", "n", F.round(low, 12).alias("low"), F.round(high, 12).alias("high"))


def m06(spark, sf):
    """How many agreements each part's target of 0.0002 to 0.9998 needs."""
    rows = table(spark, sf, "part").select("p_partkey", ((F.col("p_partkey") % 4999 + 1) / F.lit(5000.0)).alias("target"))
    return rows.select("p_partkey", "target", metrics.rows_needed(F.col("target")).alias("n"))


def m07(spark, sf):
    e = table(spark, sf, "embeddings")
    names = [str(k) for k in range(10)]
    raw = F.transform(F.slice("embedding", 1, 10), lambda x: (1 + x) / 2)
    probabilities = F.map_from_arrays(F.array(*map(F.lit, names)), F.transform(raw, lambda x: x.cast("double")))
    stated = F.element_at(F.array(*map(F.lit, names)), F.array_position(raw, F.array_max(raw)).cast("int"))
    answer = normalize.choice(probabilities, names, stated, F.array_max(raw).cast("double"))
    rows = e.select(F.col("label").cast("string").alias("reference"), answer["value"].alias("candidate")).where("candidate is not null")
    return metrics.confusion(rows, spark.createDataFrame([(n,) for n in names], "label string"))


def m08(spark, sf):
    r = records(spark, sf)
    toxic = normalize.probability_ok(F.col("p")) & (1 - F.col("p") >= 0.3)
    long = r.select(F.explode(F.array(F.struct(F.lit("quality").alias("label"), F.col("ref").alias("ref"), F.col("cand").alias("cand")), F.struct(F.lit("toxic").alias("label"), F.col("toxic").alias("ref"), toxic.alias("cand")))).alias("x")).select("x.*")
    grid = spark.createDataFrame([(lab, a, b) for lab in ("quality", "toxic") for a in (False, True) for b in (False, True)], "label string, ref boolean, cand boolean")
    counts = long.groupBy("label", "ref", "cand").agg(F.count("*").alias("n"))
    return grid.join(counts, ["label", "ref", "cand"], "left").fillna(0, ["n"])


LEVELS = [1.0, 13.25, 25.5, 37.75, 50.0]


def m09(spark, sf):
    other = (F.col("p_partkey") * 7) % 50 + 1
    level = table(spark, sf, "part").select(metrics.nearest_level(F.col("p_size"), LEVELS).alias("level_ref"), metrics.nearest_level(other, LEVELS).alias("level_cand"))
    return level.groupBy("level_ref", "level_cand").agg(F.count("*").alias("n")).withColumn("within_one", F.abs(F.col("level_ref") - F.col("level_cand")) <= 1)


def m10(spark, sf):
    gate = metrics.pick_gate(sweep_of(spark, sf)).select("threshold")
    rows = valid(spark, sf, "held_out").crossJoin(F.broadcast(gate))
    return metrics.triage(rows, F.col("threshold")).select("hash", "tag", "gate")


def m11(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 1997 != 0, F.round(F.col("value") * 100).cast("long")).alias("cand"), (F.col("event_id") % 300 + 50).alias("cand_ms"), F.when(F.col("event_id") % 5 != 0, F.round(F.col("value") * 900).cast("long")).alias("ref"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 900 + 100).alias("ref_ms"), (F.col("event_id") % 3 == 0).alias("deferred"), (F.col("event_id") % 5 != 0).alias("has_ref"))
    side = lambda name, keep, cost, ms: F.struct(F.lit(name).alias("side"), keep.alias("keep"), cost.cast("long").alias("cost"), ms.cast("long").alias("ms"))
    yes = F.lit(True)
    both = F.when(F.col("deferred"), F.col("cand") + F.col("ref")).otherwise(F.col("cand"))
    both_ms = F.when(F.col("deferred"), F.col("cand_ms") + F.col("ref_ms")).otherwise(F.col("cand_ms"))
    long = e.select("event_type", F.explode(F.array(side("candidate", yes, F.col("cand"), F.col("cand_ms")), side("reference", F.col("has_ref"), F.col("ref"), F.col("ref_ms")), side("cascade", yes, both, both_ms))).alias("x")).select("event_type", "x.*").where("keep")
    return long.groupBy("event_type", "side").agg(metrics.tally(F.col("cost"), 1e6).alias("usd"), (F.sum("ms") / F.count("ms")).alias("mean_ms"), F.count_if(F.col("ms").isNull()).alias("unmeasured"))


def m12(spark, sf):
    return metrics.self_agreement(records(spark, sf).where("ref_ok and split = 'held_out'"))


def m13(spark, sf):
    hashed = table(spark, sf, "documents").select(metrics.presentation_order(F.sha2("text", 256)).alias("order"))
    return hashed.groupBy("order").agg(F.count("*").alias("n"))


def i01(spark, sf):
    return inputs.group_inputs(table(spark, sf, "documents"), "text", "doc_id", "lang").select("hash", "occurrences", "first_id", "conflicting")


def i02(spark, sf):
    return inputs.half_split(table(spark, sf, "documents").select(F.sha2("text", 256).alias("hash")).distinct())


def i04(spark, sf):
    return inputs.strata_batches(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stratum")).distinct(), 123)


def i05(spark, sf):
    e = table(spark, sf, "events")
    state = F.when(F.col("event_id") % 5 == 0, F.replace("props", F.lit('"k"'), F.lit('"q"'))).when(F.col("event_id") % 7 == 0, F.lit("{}")).when(F.col("event_id") % 11 == 0, F.lit('{"k": "x"}')).when(F.col("event_id") % 13 == 0, F.lit("[1]")).otherwise(F.col("props"))
    return e.select("event_id", inputs.invalid_reason(state, {"k": ("integer", True)}).alias("invalid_reason"))


def i07(spark, sf):
    return inputs.select_capped(table(spark, sf, "supplier"), F.col("s_acctbal") > 1000, ["s_nationkey", "s_suppkey"], 25).select(F.col("s_suppkey").alias("id"), "selected", "skip_reason")


def j01(spark, sf):
    c = table(spark, sf, "conversations")
    n = F.octet_length("text")
    errors = [("invalid_request", n == 0), ("invalid_input", n > 3000), ("invalid_definition", F.col("role") == "system")]
    deferrals = [("policy_missing", F.col("conv_id") % 11 == 0), ("policy_stale", F.col("conv_id") % 7 == 0), ("budget_exhausted", F.col("turn") > 5), ("low_confidence", n % 4 == 0)]
    return judge.judged(c, errors, deferrals).select("conv_id", "turn", "status", "reason")


def j02(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.sha2("p_name", 256).alias("revision"))
    p = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 4 == 0, -F.col("p_partkey") - 1).otherwise(F.col("p_partkey")).alias("id"), F.sha2(F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_name")), 256).alias("revision"))
    return judge.policy_state(d, p)


def j03(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), judge.price(F.when(k % 3 != 0, F.col("p_retailprice")), F.when(k % 5 != 0, F.col("p_size") * F.lit(40.0)), F.when(k % 2 != 0, F.lit(1000.0))).alias("price"))


def j04(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey") % 400).alias("id"), F.element_at(F.array(F.lit("project"), F.lit("user"), F.lit("system")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("scope")).distinct()
    return judge.shadowed(c, ["project", "user", "system"])


def attempts(spark, sf):
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf, "events").select("event_type", "event_id", "ts", cents.alias("reserved"), F.when(F.col("event_id") % 4 != 0, F.floor(cents * 2 / 3).cast("long")).alias("actual"), (F.col("event_type") == "error").alias("failed"), F.when(F.col("event_id") % 6 != 0, F.element_at(F.array(*map(F.lit, (200, 400, 401, 408, 429, 500))), (F.col("event_id") % 6 + 1).cast("int"))).alias("status"))


def j05(spark, sf):
    return judge.ledger_totals(attempts(spark, sf))


def tries(spark, sf):
    return attempts(spark, sf).select((F.col("event_id") % 10).alias("run"), F.col("event_id").alias("seq"), F.col("reserved").alias("amount"))


def j06(spark, sf):
    return judge.admit(tries(spark, sf), 100_000).select("run", F.col("seq").alias("event_id"), "admitted")


def j07(spark, sf):
    return attempts(spark, sf).select(judge.failure_class(F.col("status"), F.col("event_id") % 2 == 0).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def t02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.regexp_replace("text", T.HEX_LITERAL, "$1" + T.REDACTED + "$2"), 256).alias("redacted_sha256"))


def t02_full(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("redacted_sha256"))


def t03(spark, sf):
    return T.byte_entropy(table(spark, sf, "pages"), "page_id", "html")


WORDS = ["license", "Licensed", "rights", "Version"]


def t04(spark, sf):
    return table(spark, sf, "documents").where(T.has_word(F.col("text"), WORDS)).select("doc_id")


def t05(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("import os\n"), F.when(F.col("page_id") % 3 == 0, "import openai\n").otherwise(""), F.when(F.col("page_id") % 5 == 0, "  from anthropic.types import X\n").otherwise("# import litellm\n"), F.col("html")).alias("s"))
    return p.select("page_id", F.array_join(T.imported_packages(F.col("s")), ",").alias("packages"))


def all_edges(spark, sf):
    """An edge of every line. A caller and its callee agree in p % 5; callees lie below 1500, so what is above is a root. A part with p % 5 = 0 calls itself and perhaps its neighbour, so no root reaches it. A third of the callees are never folded, else none would be hidden."""
    p, s = F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long")
    dst = F.when(p % 5 == 0, p + 5 * (s % 2)).otherwise(5 * ((p * 13 + s) % 300) + p % 5)
    lines = table(spark, sf, "lineitem").select(p.alias("src"), dst.alias("dst"), (s % 2 == 0).alias("even"))
    k = F.floor(F.col("dst") / 5) % 3
    return lines.select("src", "dst", ((k == 0) | ((k == 1) & F.col("even"))).alias("fold")).distinct()


ALL_EDGES = """
lines AS (
  SELECT CAST(l_partkey AS BIGINT) AS src, CAST(CASE WHEN l_partkey % 5 = 0 THEN l_partkey + 5 * (l_suppkey % 2) ELSE 5 * ((l_partkey * 13 + l_suppkey) % 300) + l_partkey % 5 END AS BIGINT) AS dst, l_suppkey % 2 = 0 AS even
  FROM lineitem),
edges AS (SELECT DISTINCT src, dst, dst // 5 % 3 = 0 OR dst // 5 % 3 = 1 AND even AS fold FROM lines),
roots AS (SELECT src AS node FROM edges EXCEPT SELECT dst FROM edges),
grounded(node) AS (SELECT node FROM roots UNION SELECT e.dst FROM grounded g JOIN edges e ON e.src = g.node)"""


def g01(spark, sf):
    return graph.grounded(all_edges(spark, sf).select("src", "dst").distinct())


def part_nodes(e):
    n = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    return n.withColumn("status", F.when(F.col("node") % 3 == 0, "distinct").when(F.col("node") % 3 == 1, "folded").otherwise("ambiguous"))


def g02(spark, sf):
    e = materialize(all_edges(spark, sf), "edges")
    return graph.represented_and_live(part_nodes(e), e).select("node", "represented", "live")


def nation_edges(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_nationkey").cast("long").alias("src"), ((F.col("s_nationkey") + F.col("s_suppkey")) % 25).cast("long").alias("dst")).where("src < dst").distinct()


NATION_EDGES = "edges AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS src, CAST((s_nationkey + s_suppkey) % 25 AS BIGINT) AS dst FROM supplier WHERE s_nationkey < (s_nationkey + s_suppkey) % 25)"


def g03(spark, sf):
    return graph.closure(nation_edges(spark, sf))


def g04(spark, sf):
    cyclic = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("long").alias("dst"))
    more = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") + 2) % 5).cast("long").alias("dst"))
    return graph.bounded_paths(spark.range(0, 5).select(F.col("id").alias("node")), cyclic.union(more).distinct())


def g05(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_custkey")).alias("id"), "o_orderkey")
    return graph.suffix_ids(o, "id", ["o_orderkey"]).select("o_orderkey", F.col("unique_id").alias("id"))


def tiers(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    signals = F.when(k % 6 == 0, F.array(F.lit("classify"))).otherwise(F.array().cast("array<string>"))
    t = T.tier(F.when(k % 4 != 0, k % 3).cast("int"), (k % 5).cast("int"), k % 31 == 0, signals, F.when(k % 8 != 0, F.col("p_name")).otherwise(""), F.when(k % 20 == 4, 8))
    return p.select(t.alias("tier"), (k % 9 == 0).alias("excluded"))


def s01(spark, sf):
    n = lambda t: F.count_if(F.col("tier") == t).alias(t)
    counted = F.count_if(~F.col("excluded"))
    decisions = F.count_if(~F.col("excluded") & F.col("tier").isin("sure", "likely"))
    return tiers(spark, sf).agg(F.count("*").alias("total"), n("sure"), n("likely"), n("review"), n("not_decision"), counted.alias("counted"), decisions.alias("decisions"), F.when(counted > 0, F.round(decisions * 1000 / counted) / 10).otherwise(F.lit(0.0)).alias("decision_pct"))


def s02(spark, sf):
    """A copy of an example source for each supplier."""
    from sparkgate.sources.python_calls import EXAMPLES, python_calls

    examples = spark.createDataFrame([(k, *x) for k, x in enumerate(EXAMPLES)], "k int, name string, text string")
    own = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % len(EXAMPLES)).cast("int").alias("k")).join(examples, "k")
    return python_calls(own.select(F.concat_ws("/", F.concat(F.lit("s"), "s_suppkey"), "name").alias("path"), "text"))


QUERIES = {
    "m01_heldout_agreement": m01, "m02_split_counts": m02, "m03_threshold_sweep": m03, "m04_gate_choice": m04, "m05_wilson_table": m05, "m06_rows_needed": m06,
    "m07_choice_confusion": m07, "m08_multilabel_metrics": m08, "m09_score_levels": m09, "m10_triage": m10, "m11_cascade_cost": m11, "m12_self_agreement": m12,
    "m13_adjudication_order": m13, "i01_group_inputs": i01, "i02_half_split": i02, "i04_strata_batches": i04, "i05_validate_state": i05,
    "i07_select_capped": i07, "j01_judge_reasons": j01, "j02_policy_state": j02, "j03_price_precedence": j03, "j04_registry_shadow": j04,
    "j05_ledger_totals": j05, "j06_budget_admission": j06, "j07_failure_class": j07, "t02_redact": t02, "t02_redact_full": t02_full,
    "t03_entropy": t03, "t04_whole_word_filter": t04, "t05_import_gate": t05, "g01_grounded": g01, "g02_represented_live": g02, "g03_folded_closure": g03,
    "g04_bounded_paths": g04, "g05_suffix_ids": g05, "s01_scan_summary": s01, "s02_python_scan": s02,
}

_low, _high = wilson_sql("agreed", "accepted")
_low5, _high5 = wilson_sql("hits", "n")
_level = lambda x: "CAST(list_position(list_transform([1.0::DOUBLE, 13.25, 25.5, 37.75, 50], lambda v: abs(v - " + x + ")), list_min(list_transform([1.0::DOUBLE, 13.25, 25.5, 37.75, 50], lambda v: abs(v - " + x + ")))) - 1 AS INTEGER)"
_state = """CASE WHEN event_id % 5 = 0 THEN replace(props, '"k"', '"q"') WHEN event_id % 7 = 0 THEN '{}' WHEN event_id % 11 = 0 THEN '{"k": "x"}' WHEN event_id % 13 = 0 THEN '[1]' ELSE props END"""
_attempts = """
a AS (
  SELECT event_id, event_type, CAST(round(value * 100) AS BIGINT) AS reserved, CASE WHEN event_id % 4 <> 0 THEN CAST(floor(CAST(round(value * 100) AS BIGINT) * 2 / 3::DOUBLE) AS BIGINT) END AS actual,
         event_type = 'error' AS failed, CASE WHEN event_id % 6 <> 0 THEN [200, 400, 401, 408, 429, 500][event_id % 6 + 1] END AS status FROM events)"""

def _redact_sql() -> str:
    """The steps of redaction as common table expressions; RE2 has no lookaround and writes references with a backslash."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    lines = lambda c: f"array_to_string(list_transform(string_split({c}, chr(10)), lambda l: '<redacted>'), chr(10))"
    swap = lambda c, p, use: f"array_to_string(list_transform(list_zip(string_split_regex({c}, {quoted(p)}), regexp_extract_all({c}, {quoted(p)})), lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' ELSE {use('z[2]')} END), '')"
    head = f"regexp_extract(text, {quoted('(?s)^(.*?' + T.KEY_END + ')')}, 1)"
    steps = [f"a AS (SELECT doc_id, text, {head} AS head FROM documents)", f"b AS (SELECT doc_id, CASE WHEN head <> '' AND NOT regexp_matches(head, {quoted(T.KEY_BEGIN)}) THEN {lines('head')} || {swap('substr(text, length(head) + 1)', T.KEY_BLOCK, lines)} ELSE {swap('text', T.KEY_BLOCK, lines)} END AS x FROM a)"]
    name = "b"
    for k, (pattern, kept, _) in enumerate(T.SECRET_SHAPES):
        steps.append(f"s{k} AS (SELECT doc_id, regexp_replace(x, {quoted(pattern)}, {quoted(kept.replace('$', chr(92)))}, 'g') AS x FROM {name})")
        name = f"s{k}"
    inner = lambda h: f"substr({h}, 2, length({h}) - 2)"
    chars = lambda h: f"string_split({inner(h)}, '')"
    bits = lambda h: f"log2(length({h}) - 2) - list_sum(list_transform(list_distinct({chars(h)}), lambda c: len(list_filter({chars(h)}, lambda y: y = c)) * log2(len(list_filter({chars(h)}, lambda y: y = c))))) / (length({h}) - 2)"
    digit = lambda h: f"regexp_matches({inner(h)}, '[0-9]')"
    high = lambda h: f"CASE WHEN regexp_full_match({inner(h)}, '[0-9a-fA-F]*') THEN {digit(h)} AND regexp_matches({inner(h)}, '[a-fA-F]') WHEN NOT ({digit(h)} AND regexp_matches({inner(h)}, '[A-Z]') AND regexp_matches({inner(h)}, '[a-z]')) THEN false ELSE {bits(h)} >= 4.0 END"
    literal = lambda h: f"CASE WHEN {high(h)} THEN {h}[1] || '<redacted>' || {h}[-1] ELSE {h} END"
    steps.append(f"z AS (SELECT doc_id, {swap('x', T.LONG_LITERAL, literal)} AS x FROM {name})")
    return f"WITH {', '.join(steps)} SELECT doc_id, sha256(x) AS redacted_sha256 FROM z"


REDACT_SQL = _redact_sql()

SQL = {
    "m01_heldout_agreement": f"WITH {SWEEP}, h AS (SELECT count(*) AS n, count(*) FILTER (r.gate >= g.threshold) AS accepted, count(*) FILTER (r.gate >= g.threshold AND agrees) AS agreed, max(g.threshold) AS threshold FROM records r, gate g WHERE ref_ok AND cand_ok AND split = 'held_out') SELECT n, accepted, agreed, threshold, {_low} AS wilson_low, {_high} AS wilson_high FROM h",
    "m02_split_counts": f"WITH {RECORDS} SELECT split, count(*) AS unique_inputs, CAST(sum(occurrences - 1) AS BIGINT) AS duplicates, count(*) FILTER (ref_ok AND cand_ok) AS valid, count(*) FILTER (NOT ref_ok) AS ref_failed, count(*) FILTER (NOT cand_ok) AS cand_failed FROM records GROUP BY split",
    "m03_threshold_sweep": f"WITH {SWEEP} SELECT * FROM swept",
    "m04_gate_choice": f"WITH {SWEEP} SELECT * FROM gate",
    "m05_wilson_table": f"WITH t AS (SELECT event_type, count(*) FILTER (value >= 50) AS hits, count(*) AS n FROM events GROUP BY 1) SELECT event_type, hits, n, {_low5} AS low, {_high5} AS high FROM t",
    "m06_rows_needed": f"WITH t AS (SELECT p_partkey, (p_partkey % 4999 + 1) / 5000.0::DOUBLE AS target FROM part), d AS (SELECT DISTINCT target FROM t), n AS (SELECT target, (SELECT min(x) FROM range(1, 60000) r(x) WHERE x / (x + {metrics.Z * metrics.Z!r}::DOUBLE) >= target) AS n FROM d) SELECT p_partkey, target, n FROM t JOIN n USING (target)",
    "m07_choice_confusion": "WITH r AS (SELECT CAST(label AS VARCHAR) AS reference, CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS VARCHAR) AS candidate FROM embeddings), l AS (SELECT CAST(x AS VARCHAR) AS label FROM range(10) t(x)) SELECT a.label AS reference, b.label AS candidate, count(r.reference) AS n FROM l a CROSS JOIN l b LEFT JOIN r ON r.reference = a.label AND r.candidate = b.label GROUP BY 1, 2",
    "m08_multilabel_metrics": f"WITH {RECORDS}, x AS (SELECT 'quality' AS label, ref, cand FROM records UNION ALL SELECT 'toxic', toxic, 1 - p >= 0.3::DOUBLE FROM records), g AS (SELECT * FROM (VALUES ('quality'), ('toxic')) a(label), (VALUES (false), (true)) b(ref), (VALUES (false), (true)) c(cand)) SELECT g.label, g.ref, g.cand, count(x.label) AS n FROM g LEFT JOIN x ON x.label = g.label AND x.ref = g.ref AND x.cand = g.cand GROUP BY 1, 2, 3",
    "m09_score_levels": f"WITH l AS (SELECT {_level('p_size')} AS level_ref, {_level('((p_partkey * 7) % 50 + 1)')} AS level_cand FROM part) SELECT level_ref, level_cand, count(*) AS n, abs(level_ref - level_cand) <= 1 AS within_one FROM l GROUP BY ALL",
    "m10_triage": f"WITH {SWEEP} SELECT hash, CASE WHEN r.gate >= g.threshold THEN 'confident_miss' ELSE 'low_confidence' END AS tag, r.gate FROM records r, gate g WHERE ref_ok AND cand_ok AND split = 'held_out' AND NOT agrees",
    "m11_cascade_cost": "WITH e AS (SELECT event_type, CASE WHEN event_id % 1997 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS cand, event_id % 300 + 50 AS cand_ms, CASE WHEN event_id % 5 <> 0 THEN CAST(round(value * 900) AS BIGINT) END AS ref, CASE WHEN event_id % 5 <> 0 THEN event_id % 900 + 100 END AS ref_ms, event_id % 3 = 0 AS deferred, event_id % 5 <> 0 AS has_ref FROM events), x AS (SELECT event_type, 'candidate' AS side, cand AS cost, cand_ms AS ms FROM e UNION ALL SELECT event_type, 'reference', ref, ref_ms FROM e WHERE has_ref UNION ALL SELECT event_type, 'cascade', CASE WHEN deferred THEN cand + ref ELSE cand END, CASE WHEN deferred THEN cand_ms + ref_ms ELSE cand_ms END FROM e) SELECT event_type, side, CASE WHEN count(*) FILTER (cost IS NULL) = 0 THEN CAST(sum(cost) AS BIGINT) / 1e6::DOUBLE END AS usd, CAST(sum(ms) AS BIGINT) / count(ms)::DOUBLE AS mean_ms, count(*) FILTER (ms IS NULL) AS unmeasured FROM x GROUP BY 1, 2",
    "m12_self_agreement": f"""WITH {RECORDS}, v AS (SELECT *, row_number() OVER (ORDER BY hash) AS i FROM records WHERE ref_ok AND split = 'held_out'), x AS (SELECT 'first' AS "group", rerun_agrees FROM v WHERE i <= 20 UNION ALL SELECT 'disagreement', rerun_agrees FROM v WHERE NOT agrees), g AS (SELECT unnest(['first', 'disagreement']) AS "group") SELECT g."group", count(*) FILTER (rerun_agrees) AS agreed, count(x."group") AS n FROM g LEFT JOIN x ON x."group" = g."group" GROUP BY 1""",
    "m13_adjudication_order": """SELECT CASE WHEN CAST('0x' || sha256(text)[1] AS BIGINT) % 2 = 0 THEN 'reference_first' ELSE 'candidate_first' END AS "order", count(*) AS n FROM documents GROUP BY 1""",
    "i01_group_inputs": "SELECT sha256(text) AS hash, count(*) AS occurrences, min(doc_id) AS first_id, coalesce(min(lang) <> max(lang), false) OR (count(lang) > 0 AND count(lang) < count(*)) AS conflicting FROM documents GROUP BY 1",
    "i02_half_split": "WITH h AS (SELECT DISTINCT sha256(text) AS hash FROM documents) SELECT hash, CASE WHEN row_number() OVER (ORDER BY hash) <= count(*) OVER () // 2 THEN 'calibration' ELSE 'held_out' END AS split FROM h",
    "i04_strata_batches": "WITH s AS (SELECT stratum, row_number() OVER (ORDER BY stratum) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT o_orderpriority AS stratum FROM orders)), c AS (SELECT stratum, 123 // k + CASE WHEN i < 123 % k THEN 1 ELSE 0 END AS c FROM s) SELECT stratum, CAST(b AS BIGINT) AS batch, CAST(least(20, c - 20 * b) AS BIGINT) AS size FROM c, range(100) t(b) WHERE b * 20 < c",
    "i05_validate_state": f"WITH s AS (SELECT event_id, {_state} AS s FROM events) SELECT event_id, CASE WHEN s LIKE '[%' THEN 'not_an_object' WHEN s LIKE '%\"q\"%' THEN 'unknown_key' WHEN s = '{{}}' THEN 'missing:k' WHEN s LIKE '%\"x\"%' THEN 'kind:k' END AS invalid_reason FROM s",
    "i07_select_capped": "WITH r AS (SELECT *, s_acctbal > 1000 AS ok, row_number() OVER (PARTITION BY s_acctbal > 1000 ORDER BY s_nationkey, s_suppkey) AS i FROM supplier) SELECT s_suppkey AS id, ok AND i <= 25 AS selected, CASE WHEN NOT ok THEN 'not_eligible' WHEN i > 25 THEN 'over_limit' END AS skip_reason FROM r",
    "j01_judge_reasons": "WITH r AS (SELECT conv_id, turn, CASE WHEN strlen(text) = 0 THEN 'invalid_request' WHEN strlen(text) > 3000 THEN 'invalid_input' WHEN role = 'system' THEN 'invalid_definition' WHEN conv_id % 11 = 0 THEN 'policy_missing' WHEN conv_id % 7 = 0 THEN 'policy_stale' WHEN turn > 5 THEN 'budget_exhausted' WHEN strlen(text) % 4 = 0 THEN 'low_confidence' END AS reason FROM conversations) SELECT conv_id, turn, CASE WHEN reason IS NULL THEN 'accepted' WHEN reason LIKE 'invalid%' THEN 'error' ELSE 'deferred' END AS status, reason FROM r",
    "j02_policy_state": "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'missing' WHEN p_partkey % 3 = 0 AND p_type <> p_name THEN 'stale' ELSE 'ok' END AS state FROM part",
    "j03_price_precedence": "WITH x AS (SELECT p_partkey AS id, greatest(CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END, CASE WHEN p_partkey % 5 <> 0 THEN p_size * 40.0::DOUBLE END) AS b, CASE WHEN p_partkey % 2 <> 0 THEN 1000.0::DOUBLE END AS m FROM part) SELECT id, CASE WHEN b IS NOT NULL THEN greatest(b, m) END AS price FROM x",
    "j04_registry_shadow": "WITH c AS (SELECT DISTINCT 'c' || (c_custkey % 400) AS id, ['project', 'user', 'system'][c_custkey % 3 + 1] AS scope FROM customer) SELECT id, scope, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY list_position(['project', 'user', 'system'], scope)) = 1 THEN 'active' ELSE 'shadowed' END AS state FROM c",
    "j05_ledger_totals": f"WITH {_attempts}, c AS (SELECT *, CASE WHEN failed THEN CASE WHEN status IS NOT NULL AND NOT status BETWEEN 200 AND 299 AND status <> 408 AND status < 500 THEN 0 ELSE reserved END ELSE coalesce(actual, reserved) END AS c FROM a) SELECT CAST(sum(c) AS BIGINT) AS charged, CAST(sum(c) FILTER (NOT failed AND actual IS NULL) AS BIGINT) AS estimated, CAST(sum(actual) FILTER (NOT failed) AS BIGINT) AS actual, count(*) FILTER (failed) AS failed FROM c",
    "j06_budget_admission": "WITH RECURSIVE a AS (SELECT event_id % 10 AS run, event_id AS seq, CAST(round(value * 100) AS BIGINT) AS amount, row_number() OVER (PARTITION BY event_id % 10 ORDER BY event_id) AS i FROM events), f AS (SELECT run, seq, i, amount <= 100000 AS admitted, CASE WHEN amount <= 100000 THEN amount ELSE 0 END AS spent FROM a WHERE i = 1 UNION ALL SELECT a.run, a.seq, a.i, f.spent + a.amount <= 100000, CASE WHEN f.spent + a.amount <= 100000 THEN f.spent + a.amount ELSE f.spent END FROM f JOIN a ON a.run = f.run AND a.i = f.i + 1) SELECT run, seq AS event_id, admitted FROM f",
    "j07_failure_class": f"WITH {_attempts} SELECT CASE WHEN status IN (401, 403) THEN 'authentication' WHEN status = 400 AND event_id % 2 = 0 THEN 'unknown_model' WHEN status IN (408, 429) OR status >= 500 THEN 'unavailable' WHEN status BETWEEN 400 AND 499 THEN 'rejected' ELSE 'unavailable' END AS class, count(*) AS n FROM a GROUP BY 1",
    "t02_redact": """SELECT doc_id, sha256(coalesce(array_to_string(list_transform(string_split_regex(text, '["''`][0-9a-fA-F]{32,}["''`]'), lambda x: x), '"<redacted>"'), '')) AS redacted_sha256 FROM documents""",
    "t02_redact_full": REDACT_SQL,
    "t03_entropy": "WITH b AS (SELECT page_id, unnest(regexp_extract_all(hex(encode(html)), '..')) AS b FROM pages), c AS (SELECT page_id, b, count(*) AS c FROM b GROUP BY 1, 2), s AS (SELECT page_id, sum(c) AS n, sum(c * log2(c)) AS s FROM c GROUP BY 1) SELECT page_id, round(log2(n) - s / n, 9) AS bits FROM s",
    "t04_whole_word_filter": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_$])(license|Licensed|rights|Version)($|[^A-Za-z0-9_$])')",
    "t05_import_gate": "SELECT page_id, array_to_string(list_filter([CASE WHEN page_id % 5 = 0 THEN 'anthropic' END, CASE WHEN page_id % 3 = 0 THEN 'openai' END], lambda x: x IS NOT NULL), ',') AS packages FROM pages",
    "g01_grounded": f"WITH RECURSIVE {ALL_EDGES} SELECT node FROM grounded",
    "g02_represented_live": f"WITH RECURSIVE {ALL_EDGES}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), sound AS (SELECT * FROM edges WHERE src % 3 <> 2), ground(node) AS (SELECT node FROM nodes WHERE node NOT IN (SELECT dst FROM sound) UNION SELECT e.dst FROM ground g JOIN sound e ON e.src = g.node), rep(node) AS (SELECT e.dst FROM sound e JOIN ground g ON g.node = e.src WHERE e.src % 3 = 0 UNION SELECT e.dst FROM rep r JOIN sound e ON e.src = r.node), live(node) AS (SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM rep) UNION SELECT e.dst FROM live l JOIN sound e ON e.src = l.node AND e.fold) SELECT node, node IN (SELECT node FROM rep) AS represented, node IN (SELECT node FROM live) AS live FROM nodes",
    "g03_folded_closure": f"WITH RECURSIVE {NATION_EDGES}, c(start, reached) AS (SELECT src, dst FROM edges UNION SELECT c.start, e.dst FROM c JOIN edges e ON e.src = c.reached) SELECT * FROM c",
    "g04_bounded_paths": "WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey * 3 + 1) % 25 AS BIGINT) AS dst FROM nation UNION SELECT CAST(n_nationkey AS BIGINT), CAST((n_nationkey + 2) % 5 AS BIGINT) FROM nation), p(p, depth, recursive) AS (SELECT [CAST(x AS BIGINT)], 0, false FROM range(5) t(x) UNION ALL SELECT list_append(p, dst), depth + 1, list_contains(p, dst) FROM p JOIN e ON e.src = p[len(p)] WHERE NOT recursive AND depth < 5) SELECT array_to_string(p, '>') AS path, depth, recursive FROM p WHERE depth > 0",
    "g05_suffix_ids": "WITH r AS (SELECT o_orderkey, 'o' || o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) SELECT o_orderkey, CASE WHEN i = 1 THEN id ELSE id || '-' || i END AS id FROM r",
    "s01_scan_summary": "WITH t AS (SELECT p_partkey % 9 = 0 AS excluded, CASE WHEN p_partkey % 31 = 0 THEN 'review' WHEN p_partkey % 4 <> 0 AND p_partkey % 3 = 0 THEN 'not_decision' WHEN p_partkey % 4 <> 0 AND p_partkey % 5 <= 1 THEN 'sure' WHEN p_partkey % 4 <> 0 THEN 'likely' WHEN p_partkey % 6 = 0 THEN 'likely' WHEN p_partkey % 20 = 4 THEN 'review' WHEN p_partkey % 8 <> 0 AND trim(p_name) <> '' THEN 'not_decision' ELSE 'review' END AS tier FROM part), s AS (SELECT count(*) AS total, count(*) FILTER (tier = 'sure') AS sure, count(*) FILTER (tier = 'likely') AS likely, count(*) FILTER (tier = 'review') AS review, count(*) FILTER (tier = 'not_decision') AS not_decision, count(*) FILTER (NOT excluded) AS counted, count(*) FILTER (NOT excluded AND tier IN ('sure', 'likely')) AS decisions FROM t) SELECT *, CASE WHEN counted > 0 THEN round(decisions * 1000 / counted::DOUBLE) / 10 ELSE 0 END AS decision_pct FROM s",
}
