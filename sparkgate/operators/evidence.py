"""Evidence of an evaluation beyond the gate: agreement per output, adjudication, estimates, prices, policy blockers and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgate.operators.rank import global_rank
from sparkgate.session import materialize

#: Requests of one stage that run at once.
CONCURRENCY = 8


def output_agreement(rows: DataFrame) -> DataFrame:
    """rows (output, same, passed), one per output and valid row: (output, accepted, accepted_same, valid, valid_same). A null same or passed is false."""
    same, passed = F.coalesce("same", F.lit(False)), F.coalesce("passed", F.lit(False))
    return rows.groupBy("output").agg(F.count_if(passed).alias("accepted"), F.count_if(passed & same).alias("accepted_same"), F.count("*").alias("valid"), F.count_if(same).alias("valid_same"))


def adjudication(rows: DataFrame) -> DataFrame:
    """One row over rows (agrees, verdict_status, sided_with): disagreements, adjudicated, failed, not_run, and how often each side won.

    verdict_status is ok, failed or null (not run). Rows that agree are not adjudicated.
    """
    won = lambda side: F.count_if((F.col("verdict_status") == "ok") & (F.col("sided_with") == side)).alias(f"sided_{side}")
    return rows.where(~F.col("agrees")).agg(
        F.count("*").alias("disagreements"), F.count_if(F.col("verdict_status") == "ok").alias("adjudicated"), F.count_if(F.col("verdict_status") == "failed").alias("failed"),
        F.count_if(F.col("verdict_status").isNull()).alias("not_run"), *[won(s) for s in ("reference", "candidate", "both", "neither")],
    )


def run_estimate(stages: DataFrame) -> DataFrame:
    """One row over stages (site, at, stage, requests, concurrent, expected, worst, reservation; money in integer parts of a unit).

    Sums of expected, worst and requests, and the stage that reserves most for its concurrent requests (at most CONCURRENCY of
    them); the first by (site, at) wins ties, and a stage that reserves nothing is none. Sums of no stages are 0.
    """
    held = F.least(F.col("concurrent"), F.lit(CONCURRENCY)) * F.col("reservation")
    most = F.max(F.when(held > 0, F.struct(held.alias("held"), (-F.col("site")).alias("s"), (-F.col("at")).alias("a"), "stage")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return stages.agg(total("expected"), total("worst"), total("requests"), most.alias("m")).select("expected", "worst", "requests", F.col("m.stage").alias("largest_stage"), F.coalesce("m.held", F.lit(0)).alias("in_flight"))


def unanimous(value: Column) -> Column:
    """Aggregate: the value if every row has it, else null."""
    return F.when((F.count(value) == F.count("*")) & (F.min(value) == F.max(value)), F.min(value))


def policy_blockers(completed: Column, threshold: Column, wilson_low: Column, accepted: Column, target: float, min_accepted: int, reconstructed: Column | None = None) -> Column:
    """Why a run gives no measured policy, as an array in fixed order; empty if it does."""
    reasons = [
        F.when(~completed, "not_completed"), F.when(threshold.isNull(), "defer_all"), F.when(wilson_low.isNull(), "nothing_accepted"),
        F.when(wilson_low < target, "below_target"), F.when(accepted < min_accepted, "too_few_accepted"),
    ]
    if reconstructed is not None:
        reasons.append(F.when(reconstructed, "prompt_reconstructed"))
    return F.array_compact(F.array(*reasons))


def coverage_problems(needed: DataFrame, given: DataFrame) -> DataFrame:
    """(id, key, problem): keys (id, key) that a policy lacks (missing) or should not have (unknown). Empty if every policy covers its definition exactly."""
    missing = needed.select("id", "key").join(given, ["id", "key"], "left_anti").withColumn("problem", F.lit("missing"))
    unknown = given.select("id", "key").join(needed, ["id", "key"], "left_anti").withColumn("problem", F.lit("unknown"))
    return missing.union(unknown).distinct()


def order_violations(rows: DataFrame, at: str, key: str) -> DataFrame:
    """Rows whose key is not greater than the key of the row before, in the order of at. at tells rows apart; gaps in it don't matter: rows
    are ranked first, so that the row before is an equi-join and not a sort in one task."""
    ranked = materialize(global_rank(rows, at, "_rank"), "ranked")
    before = ranked.select((F.col("_rank") + 1).alias("_rank"), F.col(key).alias("_before"))
    return ranked.join(before, "_rank").where(F.col("_before") >= F.col(key)).drop("_before", "_rank")


def field_names(rows: DataFrame, json_col: str) -> DataFrame:
    """Distinct member names (name) of JSON objects; text that is no object has none."""
    return rows.select(F.explode(F.json_object_keys(json_col)).alias("name")).distinct()
