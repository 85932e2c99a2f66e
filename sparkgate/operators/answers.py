"""Answers as JSON text against the outputs of a definition, and batches of synthetic inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkgate.functions.text import let
from sparkgate.operators.inputs import invalid_reason

Output = tuple[str, str, dict]


def canonical_answer(answer: Column, outputs: list[Output]) -> Column:
    """struct(reason, one canonical value per output) of a JSON object.

    outputs are (name, shape, detail): choice (options, null_option), yes_no, labels (options), score (levels). reason is the first failure: not an object,
    an unknown output, then outputs in order, missing or outside the answer space; the values are null then. A choice of null_option is null;
    labels come in the order of options, once each.
    """
    v, keys = F.try_parse_json(answer), F.json_object_keys(answer)
    names = F.array(*[F.lit(n) for n, _, _ in outputs])
    rules = [F.when(keys.isNull(), "not_an_object"), F.when(F.size(F.array_except(keys, names)) > 0, "unknown_output")]
    values = []
    for name, shape, detail in outputs:
        member = F.try_variant_get(v, f"$.{name}", "variant")
        kind = F.schema_of_variant(member)
        if shape == "choice":
            null = detail.get("null_option")
            value = F.when(kind == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
            ok = value.isin(*detail["options"], *([null] if null else [])) | ((kind == "VOID") & F.lit(null is not None))
            value = F.when(value != F.lit(null or ""), value)
        elif shape == "yes_no":
            ok, value = kind == "BOOLEAN", F.when(kind == "BOOLEAN", F.try_variant_get(v, f"$.{name}", "boolean"))
        elif shape == "labels":
            options = F.array(*[F.lit(o) for o in detail["options"]])
            items = F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(v, f"$.{name}", "array<string>"))
            ok, value = F.size(F.array_except(items, options)) == 0, F.array_intersect(options, items)
        elif shape == "score":
            value = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, f"$.{name}", "double"))
            ok = value.between(min(detail["levels"]), max(detail["levels"]))
        else:
            raise ValueError(f"unknown shape {shape}")
        rules += [F.when(~F.array_contains(keys, name), f"missing:{name}"), F.when(~F.coalesce(ok, F.lit(False)), f"outside:{name}")]
        values.append((name, value))
    reason = F.coalesce(*rules)
    return F.struct(reason.alias("reason"), *[F.when(reason.isNull(), value).alias(name) for name, value in values])


def unfenced(text: Column) -> Column:
    """JSON text of a model answer without the blanks and the Markdown fence around it; null if it is not JSON."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    whole = lambda c: F.when((c != "") & F.try_parse_json(c).isNotNull(), c)
    return let(bare(text), lambda plain: F.coalesce(whole(plain), let(bare(F.regexp_extract(plain, r"(?s)^```(?:json)?(.*)```$", 1)), whole)))


def batch_inputs(text: Column, fields: dict[str, tuple[str, bool]], count: int) -> Column:
    """struct(inputs, rejected) of a model answer {"inputs": [...]}: the first `count` items that are objects, or text of objects, of the input schema; the other items are rejected. Null without such a list."""

    def split(items: Column) -> Column:
        good = F.slice(F.filter(items, lambda x: invalid_reason(x, fields).isNull()), 1, count)
        return let(good, lambda g: F.when(items.isNotNull(), F.struct(g.alias("inputs"), (F.size(items) - F.size(g)).alias("rejected"))))

    return let(F.from_json(unfenced(text), "inputs array<string>")["inputs"], split)
