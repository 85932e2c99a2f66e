"""Agreement of gated answers: rates with intervals, threshold sweep, gate, confusion, triage, self-agreement, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution, and the steps of the threshold sweep.
Z = 1.959963984540054
STEPS = 20


def paired(reference: DataFrame, candidate: DataFrame, hash_col: str = "hash") -> DataFrame:
    """Rows of both sides by input hash, one of each: an input that one side lacks is no row. Columns of a side are value, ok, and what else it has under names of its own."""
    own = lambda df, side: df.select(hash_col, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != hash_col])
    return own(reference, "ref").join(own(candidate, "cand"), hash_col)


def wilson(count: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval of count / n; null at n = 0, within [0, 1]."""
    c, m, z2 = count.cast("double"), n.cast("double"), Z * Z
    p = c / m
    middle = (p + z2 / (2 * m)) / (1 + z2 / m)
    half = F.lit(Z) * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m)) / (1 + z2 / m)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def rows_needed(target: Column) -> Column:
    """The least n for which n agreements of n have a lower bound of at least target; null outside (0, 1)."""
    z2 = F.lit(Z * Z)
    n = F.ceil(z2 * target / (1 - target))
    ok = lambda x: x / (x + z2) >= target
    n = F.when((n > 1) & ok(n - 1), n - 1).when(ok(n), n).otherwise(n + 1)
    return F.when((target > 0) & (target < 1), n.cast("long"))


def step_of(gate: Column) -> Column:
    """The largest k of 0..STEPS with gate >= k / STEPS, by the same comparison as the gate itself; -1 if there is none (NaN and null too)."""
    passed = F.filter(F.sequence(F.lit(0), F.lit(STEPS)), lambda k: gate >= k / F.lit(float(STEPS)))
    return F.when(gate.isNull() | F.isnan(gate), F.lit(-1)).otherwise(F.size(passed) - 1)


def threshold_sweep(rows: DataFrame, target: float, gate_col: str = "gate", agrees_col: str = "agrees") -> DataFrame:
    """(k, threshold, accepted, n, agreed, rate, qualifies) for k = 0..STEPS, also where nothing is accepted.

    Rows are counted once by their own step in a partial aggregate; the 21 thresholds are sums over that small table.
    """
    counted = rows.groupBy(step_of(F.col(gate_col)).alias("k")).agg(F.count("*").alias("rows"), F.count_if(F.col(agrees_col)).alias("good"))
    every = rows.sparkSession.range(-1, STEPS + 1).select(F.col("id").cast("int").alias("k")).join(counted, "k", "left").fillna(0, ["rows", "good"])
    down = Window.orderBy(F.col("k").desc())
    out = every.select("k", F.sum("rows").over(down).alias("accepted"), F.sum("rows").over(Window.partitionBy()).alias("n"), F.sum("good").over(down).alias("agreed")).where("k >= 0")
    rate = F.when(F.col("accepted") > 0, F.col("agreed") / F.col("accepted"))
    return out.select("k", (F.col("k") / F.lit(float(STEPS))).alias("threshold"), "accepted", "n", "agreed", rate.alias("rate"), F.coalesce(rate >= target, F.lit(False)).alias("qualifies"))


def pick_gate(sweep: DataFrame) -> DataFrame:
    """One row: the lowest qualifying k and its threshold, or nulls and defer_all."""
    k = F.min(F.when(F.col("qualifies"), F.col("k")))
    return sweep.agg(k.alias("k")).select("k", (F.col("k") / F.lit(float(STEPS))).alias("threshold"), F.col("k").isNull().alias("defer_all"))


def held_out_agreement(held_out: DataFrame, gate: DataFrame, gate_col: str = "gate", agrees_col: str = "agrees") -> DataFrame:
    """One row: n, accepted, agreed, threshold and the Wilson interval of agreed / accepted. No gate accepts nothing."""
    joined = held_out.crossJoin(F.broadcast(gate))
    passed = F.coalesce(F.col(gate_col) >= F.col("threshold"), F.lit(False))
    out = joined.agg(F.count("*").alias("n"), F.count_if(passed).alias("accepted"), F.count_if(passed & F.col(agrees_col)).alias("agreed"), F.max("threshold").alias("threshold"))
    low, high = wilson(F.col("agreed"), F.col("accepted"))
    return out.withColumns({"wilson_low": low, "wilson_high": high})


def confusion(rows: DataFrame, labels: DataFrame, reference: str = "reference", candidate: str = "candidate") -> DataFrame:
    """(reference, candidate, n) for every pair of labels, zeros included. labels is the answer space (at most 255 options), a column `label`."""
    counts = rows.groupBy(F.col(reference).alias("reference"), F.col(candidate).alias("candidate")).agg(F.count("*").alias("n"))
    every = labels.select(F.col("label").alias("reference")).crossJoin(labels.select(F.col("label").alias("candidate")))
    return every.join(counts, ["reference", "candidate"], "left").fillna(0, ["n"])


def nearest_level(value: Column, levels: list[float]) -> Column:
    """The index of the nearest level; ties go to the lower index."""
    gaps = F.array(*[F.abs(value.cast("double") - F.lit(float(x))) for x in levels])
    return F.when(value.isNotNull(), F.array_position(gaps, F.array_min(gaps)).cast("int") - 1)


def triage(rows: DataFrame, threshold: float | Column, gate_col: str = "gate", agrees_col: str = "agrees") -> DataFrame:
    """Disagreements, each tagged confident_miss (the gate let it pass) or low_confidence."""
    passed = F.coalesce(F.col(gate_col) >= threshold, F.lit(False))
    return rows.where(~F.col(agrees_col)).withColumn("tag", F.when(passed, "confident_miss").otherwise("low_confidence"))


def tally(cost: Column, unit: float) -> Column:
    """Sum of integer costs in parts of a unit; null if any cost is unknown."""
    return F.when(F.count_if(cost.isNull()) == 0, F.coalesce(F.sum(cost), F.lit(0)) / F.lit(unit))


def self_agreement(rows: DataFrame, first: int = 20, hash_col: str = "hash", agrees_col: str = "agrees", rerun_col: str = "rerun_agrees") -> DataFrame:
    """(group, agreed, n): reruns of the first rows by hash, and of the disagreements; a row may be in both."""
    top = rows.orderBy(hash_col).limit(first).select(F.lit("first").alias("group"), rerun_col)
    other = rows.where(~F.col(agrees_col)).select(F.lit("disagreement").alias("group"), rerun_col)
    groups = rows.sparkSession.createDataFrame([("first",), ("disagreement",)], "group string")
    counts = top.union(other).groupBy("group").agg(F.count_if(F.col(rerun_col)).alias("agreed"), F.count("*").alias("n"))
    return groups.join(counts, "group", "left").fillna(0, ["agreed", "n"])


def presentation_order(hash_: Column) -> Column:
    """Which answer an adjudicator sees first: reference on an even first hex digit, or one that is no digit."""
    digit = F.conv(F.when(hash_.rlike("^[0-9a-fA-F]"), F.substring(hash_, 1, 1)).otherwise("0"), 16, 10).cast("int")
    return F.when(digit % 2 == 0, "reference_first").otherwise("candidate_first")
