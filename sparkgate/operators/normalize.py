"""From raw candidate answers to canonical values with a gate confidence, per answer shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far the stated choice may lie below the largest probability.
TOLERANCE = 0.005


def probability_ok(p: Column) -> Column:
    return F.coalesce(~F.isnan(p) & (p >= 0) & (p <= 1), F.lit(False))


def yes_no(p: Column, cutoff: float = 0.5) -> Column:
    """struct(value, gate): null unless p is a probability."""
    return F.when(probability_ok(p), F.struct((p >= cutoff).alias("value"), F.greatest(p, 1 - p).alias("gate")))


def choice(probabilities: Column, options: list[str], stated: Column, confidence: Column, null_option: str | None = None) -> Column:
    """struct(value, gate) of one option of many; probabilities is a map.

    Its keys must be the options, all values probabilities, and the stated option within TOLERANCE of the largest. The value is the
    first option, in the given order, of the largest probability; null_option is answered as null.
    """
    ps = F.array(*[F.element_at(probabilities, F.lit(o)) for o in options])
    names = F.array(*[F.lit(o) for o in options])
    same = (F.size(F.array_except(F.map_keys(probabilities), names)) == 0) & (F.size(F.array_except(names, F.map_keys(probabilities))) == 0)
    valid = same & F.forall(ps, probability_ok) & probability_ok(confidence) & (F.element_at(probabilities, stated) >= F.array_max(ps) - TOLERANCE)
    best = F.element_at(names, F.array_position(ps, F.array_max(ps)).cast("int"))
    return F.when(F.coalesce(valid, F.lit(False)), F.struct(F.when(best != F.lit(null_option or ""), best).alias("value"), confidence.alias("gate")))


def labels(probabilities: dict[str, Column], cutoffs: dict[str, float], required: set[str]) -> Column:
    """struct(value array, gate): labels at or above their cutoffs, gate the least over required labels (1 if there are none)."""
    valid = F.lit(True)
    for p in probabilities.values():
        valid = valid & probability_ok(p)
    value = F.array_compact(F.array(*[F.when(p >= cutoffs[k], F.lit(k)) for k, p in probabilities.items()]))
    gates = [F.greatest(p, 1 - p) for k, p in probabilities.items() if k in required]
    gate = F.lit(1.0) if not gates else gates[0] if len(gates) == 1 else F.least(*gates)
    return F.when(valid, F.struct(value.alias("value"), gate.alias("gate")))


def score(probabilities: Column, levels: list[float], confidence: Column) -> Column:
    """struct(value, level, gate): the mean of the level values weighted by an array of probabilities, and the most probable level, ties to the lowest."""
    values = F.array(*[F.lit(float(x)) for x in levels])
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + p)
    weighted = F.aggregate(F.zip_with(probabilities, values, lambda p, v: p * v), F.lit(0.0), lambda a, x: a + x)
    valid = (F.size(probabilities) == len(levels)) & F.forall(probabilities, probability_ok) & probability_ok(confidence) & (total > 0)
    return F.when(F.coalesce(valid, F.lit(False)), F.struct((weighted / total).alias("value"), (F.array_position(probabilities, F.array_max(probabilities)).cast("int") - 1).alias("level"), confidence.alias("gate")))


def row_gate(*gates: Column) -> Column:
    """Confidence of a row: the least over its required outputs, 1 if there are none."""
    return F.lit(1.0) if not gates else gates[0] if len(gates) == 1 else F.least(*gates)
