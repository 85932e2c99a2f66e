"""Judging requests: ordered reasons, policy state, registry shadowing, prices, ledger and budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgate.session import materialize

# Failure classes by status.
AUTHENTICATION, UNAVAILABLE = (401, 403), (408, 429)


def first_reason(*stages: tuple[str, Column]) -> Column:
    """The reason of the first failing stage in order, null if all pass; a null condition does not fail."""
    return F.coalesce(*[F.when(F.coalesce(failed, F.lit(False)), F.lit(name)) for name, failed in stages])


def judged(requests: DataFrame, errors: list[tuple[str, Column]], deferrals: list[tuple[str, Column]]) -> DataFrame:
    """requests with status (accepted, deferred or error) and reason. Stages run in order, all errors before all deferrals unless interleaved by the caller."""
    reason = first_reason(*errors, *deferrals)
    names = [n for n, _ in errors]
    return requests.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "accepted").when(F.col("reason").isin(names), "error").otherwise("deferred"))


def policy_state(definitions: DataFrame, policies: DataFrame) -> DataFrame:
    """(id, state) per definition (id, revision) against policies (id, revision): ok, stale or missing."""
    p = policies.select(F.col("id"), F.col("revision").alias("_r"), F.lit(True).alias("_has"))
    joined = definitions.join(p, "id", "left")
    return joined.select("id", F.when(F.col("_has").isNull(), "missing").when(F.col("revision").eqNullSafe(F.col("_r")), "ok").otherwise("stale").alias("state"))


def price(listed: Column, user: Column, project: Column) -> Column:
    """The dearer of listed and user price, or the one there is; a project price can only raise it. Unknown stays null."""
    return F.when(F.greatest(listed, user).isNotNull(), F.greatest(listed, user, project))


def shadowed(entries: DataFrame, scopes: list[str]) -> DataFrame:
    """entries (id, scope) with state: active in the first scope that has the id, shadowed in later ones."""
    order = F.array_position(F.array(*[F.lit(s) for s in scopes]), F.col("scope"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(order))
    return entries.withColumn("state", F.when(rank == 1, "active").otherwise("shadowed"))


def failed_charge(status: Column, reserved: Column) -> Column:
    """What a failed attempt costs: nothing for a received status other than 2xx, 408 and 5xx, else its reservation."""
    free = status.isNotNull() & ~status.between(200, 299) & (status != 408) & (status < 500)
    return F.when(free, F.lit(0)).otherwise(reserved)


def ledger_totals(attempts: DataFrame) -> DataFrame:
    """One row over attempts (reserved, actual, failed, status; integer parts of a unit): charged, estimated (charged without a reported cost), actual, failed."""
    charge = F.when(F.col("failed"), failed_charge(F.col("status"), F.col("reserved"))).otherwise(F.coalesce("actual", "reserved"))
    return attempts.withColumn("_c", charge).agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("charged"),
        F.coalesce(F.sum(F.when(~F.col("failed") & F.col("actual").isNull(), F.col("_c"))), F.lit(0)).alias("estimated"),
        F.coalesce(F.sum(F.when(~F.col("failed"), F.col("actual"))), F.lit(0)).alias("actual"),
        F.count_if(F.col("failed")).alias("failed"),
    )


def admit(attempts: DataFrame, budget: int, run_col: str = "run", order_col: str = "seq", amount_col: str = "amount") -> DataFrame:
    """attempts with admitted: an attempt is let in while the sum of what was let in before, with its own amount, stays within the budget of its run.

    A refusal leaves room for a smaller attempt later. A round takes, with `left` of a run's budget, attempts of at most half of it for let in
    and larger ones for refused, up to the first that this is wrong for: a large one that fits or a small one that doesn't. From there on less than
    half is left, so rounds grow with the bits of the budget only. Sums run within sub-ranges of a run; between them go only totals. Null and negative amounts are refused.
    """
    pos, amount, left = F.col("_pos"), F.col("_a"), F.col("_left")
    dealt = attempts.select(F.col(run_col).alias("_run"), F.col(order_col).alias("_seq"), F.col(amount_col).cast("long").alias("_a"))
    # Positions in order of run and seq: the upper bits are the number of the range.
    dealt = materialize(dealt.repartitionByRange("_run", "_seq", "_a").sortWithinPartitions("_run", "_seq", "_a").withColumn("_pos", F.monotonically_increasing_id()), "attempts").withColumn("_part", F.shiftright(pos, 33))
    state = materialize(dealt.select("_run").distinct().select("_run", F.lit(-1).cast("long").alias("_at"), F.lit(budget).cast("long").alias("_left")), "budgets")
    small = 2 * amount <= left
    rounds = None
    while not state.isEmpty():
        s = state.withColumnRenamed("_run", "_r")
        open_ = dealt.join(s, F.col("_run").eqNullSafe(F.col("_r"))).where((pos > F.col("_at")) & (amount >= 0) & (amount <= left)).drop("_r").withColumn("_own", F.when(small, amount).otherwise(0))
        totals = open_.groupBy("_run", "_part").agg(F.sum("_own").alias("_t"))
        base = totals.select(F.col("_run").alias("_r"), F.col("_part").alias("_p"), (F.sum("_t").over(Window.partitionBy("_run").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).alias("_base"))
        within = F.sum("_own").over(Window.partitionBy("_run", "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
        summed = open_.withColumn("_w", within).join(base, F.col("_run").eqNullSafe(F.col("_r")) & (F.col("_part") == F.col("_p"))).withColumn("_s", F.col("_w") + F.col("_base"))
        wrong = F.when(small, F.col("_s") > left).otherwise(F.col("_s") + amount <= left)
        rest = F.when(small, left - (F.col("_s") - amount)).otherwise(left - F.col("_s") - amount)
        cut = summed.where(wrong).groupBy(F.col("_run").alias("_r")).agg(F.min(F.struct("_pos", rest.alias("_rest"))).alias("_c"))
        done = materialize(state.join(cut, F.col("_run").eqNullSafe(F.col("_r")), "left").select("_run", "_at", "_left", F.col("_c._pos").alias("_to"), F.col("_c._rest").alias("_rest")), "rounds")
        rounds = done if rounds is None else rounds.union(done)
        state = done.where("_to is not null").select("_run", F.col("_to").alias("_at"), F.col("_rest").alias("_left"))
    if rounds is None:
        return attempts.select(run_col, order_col, F.lit(False).alias("admitted"))
    # A row is decided in the first round that ends at or after it; a run has few rounds.
    ends = rounds.groupBy(F.col("_run").alias("_r")).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_to", F.lit((1 << 63) - 1)).alias("to"), "_left"))).alias("_rounds"))
    own = dealt.join(ends, F.col("_run").eqNullSafe(F.col("_r"))).withColumn("_x", F.element_at(F.filter("_rounds", lambda r: r["to"] >= F.col("_pos")), 1)).withColumn("_left", F.col("_x._left"))
    let_in = F.when(small, pos != F.col("_x.to")).otherwise(pos == F.col("_x.to")) & (amount >= 0) & (amount <= left)
    return own.select(F.col("_run").alias(run_col), F.col("_seq").alias(order_col), F.coalesce(let_in, F.lit(False)).alias("admitted"))


def failure_class(status: Column, names_unknown_model: Column) -> Column:
    """authentication, unknown_model, unavailable or rejected."""
    return (
        F.when(status.isin(*AUTHENTICATION), "authentication")
        .when((status == 400) & names_unknown_model, "unknown_model")
        .when(status.isin(*UNAVAILABLE) | (status >= 500), "unavailable")
        .when(status.between(400, 499), "rejected")
        .otherwise("unavailable")
    )
