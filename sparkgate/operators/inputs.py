"""Inputs of an evaluation: identity, grouping, split, strata, validation and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgate.operators.rank import global_rank


def group_inputs(rows: DataFrame, input_col: str, order_col: str, label_col: str) -> DataFrame:
    """One row per distinct input: hash, occurrences, first_id, label (of the first occurrence) and conflicting (a label that differs from the first, null included)."""
    hashed = rows.select(F.sha2(F.col(input_col), 256).alias("hash"), F.col(order_col).alias("o"), F.col(label_col).alias("l"))
    # Labels differ if two distinct values occur, or a null beside a value: all of it in one partial aggregate.
    return hashed.groupBy("hash").agg(
        F.count("*").alias("occurrences"), F.min("o").alias("first_id"), F.min_by("l", "o").alias("label"),
        ((F.min("l") != F.max("l")) | ((F.count("l") > 0) & (F.count("l") < F.count("*")))).alias("c"),
    ).withColumn("conflicting", F.coalesce("c", F.lit(False))).drop("c")


def half_split(groups: DataFrame, hash_col: str = "hash") -> DataFrame:
    """groups with split: the first half by hash, rounded down, is calibration, the rest held_out."""
    ranked = global_rank(groups, hash_col, "_rank")
    total = ranked.agg(F.count("*").alias("_total"))
    return ranked.crossJoin(F.broadcast(total)).withColumn("split", F.when(F.col("_rank") <= F.floor(F.col("_total") / 2), "calibration").otherwise("held_out")).drop("_rank", "_total")


def verify_split(rows: DataFrame, input_col: str = "input", hash_col: str = "hash", split_col: str = "split") -> DataFrame:
    """One row: rehash (inputs whose hash is wrong), duplicates (hashes seen before) and misplaced (rows whose split breaks the rule)."""
    first = rows.groupBy(hash_col).agg(F.count("*").alias("n"))
    again = half_split(first.select(hash_col), hash_col).withColumnRenamed("split", "_split")
    joined = rows.join(again, hash_col)
    bad = joined.agg(F.count_if(F.sha2(F.col(input_col), 256) != F.col(hash_col)).alias("rehash"), F.count_if(F.col(split_col) != F.col("_split")).alias("misplaced"))
    return bad.crossJoin(first.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))).select("rehash", "duplicates", "misplaced")


def strata_batches(strata: DataFrame, samples: int, batch: int = 20) -> DataFrame:
    """(stratum, batch, size): samples divided evenly over the ordered strata, the rest to the first, in batches of at most `batch`."""
    ranked = strata.withColumn("_i", F.row_number().over(Window.orderBy("stratum")) - 1).withColumn("_k", F.count("*").over(Window.partitionBy()))
    count = F.floor(F.lit(samples) / F.col("_k")) + F.when(F.col("_i") < F.lit(samples) % F.col("_k"), 1).otherwise(0)
    cut = ranked.withColumn("_c", count).where("_c > 0").select("stratum", "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_c") / batch) - 1)).alias("batch"))
    return cut.select("stratum", "batch", F.least(F.lit(batch).cast("long"), F.col("_c") - batch * F.col("batch")).alias("size"))


def invalid_reason(state: Column, fields: dict[str, tuple[str, bool]], most_bytes: int = 98_304) -> Column:
    """Why a JSON object breaks an input schema {name: (kind, required)}: size, not an object, an unknown key, then fields in order; null if it doesn't."""
    keys = F.json_object_keys(state)
    value = lambda n: F.get_json_object(state, f"$.{n}")
    kinds = {"string": F.lit(True), "integer": None, "number": None, "boolean": None}
    kinds_of = lambda n, k: {"string": F.lit(True), "integer": value(n).rlike(r"^-?[0-9]+(\.0+)?$"), "number": value(n).rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "boolean": value(n).isin("true", "false")}[k]
    assert all(k in kinds for k, _ in fields.values())
    rules = [F.when(F.octet_length(state) > most_bytes, "too_large"), F.when(keys.isNull(), "not_an_object"), F.when(F.size(F.array_except(keys, F.array(*[F.lit(n) for n in fields]))) > 0, "unknown_key")]
    for name, (kind, required) in fields.items():
        rules.append(F.when(value(name).isNull() & F.lit(required), f"missing:{name}"))
        rules.append(F.when(value(name).isNotNull() & ~kinds_of(name, kind), f"kind:{name}"))
    return F.coalesce(*rules)


def unknown_keys(rows: DataFrame, row_key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Distinct keys of rows that known does not have."""
    return rows.select(F.col(row_key).alias("id")).distinct().join(known.select(F.col(known_key).alias("id")), "id", "left_anti")


def select_capped(sites: DataFrame, eligible: Column, order: list[str], most: int) -> DataFrame:
    """sites with selected and skip_reason: the first `most` eligible ones in order; the others say why not."""
    ok = sites.withColumn("_ok", eligible)
    top = ok.where("_ok").orderBy(*order).limit(most).select(*[F.col(c).alias(f"_{c}") for c in order], F.lit(True).alias("_top"))
    cond = None
    for c in order:
        cond = F.col(c).eqNullSafe(F.col(f"_{c}")) if cond is None else cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = ok.join(F.broadcast(top), cond, "left").drop(*[f"_{c}" for c in order])
    reason = F.when(~F.col("_ok"), "not_eligible").when(F.col("_top").isNull(), "over_limit")
    return joined.withColumn("selected", reason.isNull()).withColumn("skip_reason", reason).drop("_ok", "_top")
