"""JSON Schema texts as answer spaces, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgate.functions.text import let

# The most options of a choice, and the most levels that an integer range gives one by one.
MAX_OPTIONS, MAX_LEVELS = 255, 10
#: How many envelopes, and how many schemas within schemas, are looked into.
DEPTH = 2
SPACE = "struct<kind:string,options:array<string>,nullable:boolean,levels:array<double>>"


def _at(text: Column, *path: str) -> Column:
    return F.get_json_object(text, "$" + "".join(f".{p}" for p in path))


def unwrapped(text: Column, depth: int = DEPTH) -> Column:
    """The JSON Schema itself, out of the envelopes that providers put around it."""

    def inner(v: Column, left: int) -> Column:
        again = (lambda x: let(x, lambda y: inner(y, left - 1))) if left else (lambda x: x)
        return F.coalesce(
            _at(v, "json_schema", "schema"), F.when(_at(v, "type") == "json_schema", _at(v, "schema")), again(_at(v, "format")), _at(v, "input_schema"),
            again(_at(v, "function")), F.when(_at(v, "name").isNotNull(), _at(v, "parameters")), v,
        )

    return let(text, lambda v: F.when(v.isNotNull(), inner(v, depth)))


def _types(text: Column) -> Column:
    t = _at(text, "type")
    return F.array_compact(F.coalesce(F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.array(t)), F.array().cast("array<string>")))


def levels(low: Column, high: Column, integer: Column) -> Column:
    """One level for each value of a short range of integers, else five evenly spaced ones; null for an empty range."""
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.least((high - low).cast("long"), F.lit(MAX_LEVELS))), lambda i: low + i)
    five = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: low + (high - low) * i / 4.0)
    return F.when(high > low, F.when(integer & (high - low + 1 <= MAX_LEVELS), each).otherwise(five))


def _space(kind: Column | str, options: Column | None = None, nullable: Column | bool = False, values: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    nullable = F.lit(nullable) if isinstance(nullable, bool) else nullable
    return F.struct(kind.alias("kind"), (none if options is None else options).alias("options"), nullable.alias("nullable"), (F.array().cast("array<double>") if values is None else values).alias("levels")).cast(SPACE)


def space(schema: Column, depth: int = DEPTH) -> Column:
    """struct(kind, options, nullable, levels) of one property: kind is choice, yes_no, labels, score or free."""

    def shape(p: Column, left: int) -> Column:
        def own(types: Column) -> Column:
            values = F.from_json(_at(p, "enum"), "array<variant>")
            options = F.transform(F.filter(values, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.variant_get(x, "$", "string"))
            nullable = F.array_contains(types, "null") | F.coalesce(F.exists(values, lambda x: F.is_variant_null(x)), F.lit(False))
            integer = F.array_contains(types, "integer")
            low, high = (_at(p, n).try_cast("double") for n in ("minimum", "maximum"))
            steps = levels(low, high, integer)
            items = let(shape(_at(p, "items"), left - 1), lambda s: F.when(s["kind"] == "choice", _space("labels", s["options"]))) if left else F.lit(None).cast(SPACE)
            return F.coalesce(
                F.when(F.size(options) >= 2, _space("choice", options, nullable)), F.when(F.array_contains(types, "boolean"), _space("yes_no")),
                F.when(integer | F.array_contains(types, "number"), F.coalesce(F.when(steps.isNotNull(), _space("score", None, False, steps)), _space("free"))),
                F.when(F.array_contains(types, "array"), items), _space("free"),
            )

        variants = F.from_json(F.coalesce(_at(p, "anyOf"), _at(p, "oneOf")), "array<string>")
        one = lambda vs: F.filter(vs, lambda v: ~F.coalesce(_types(v) == F.array(F.lit("null")), F.lit(False)))

        def either(vs: Column) -> Column:
            alone = (F.size(one(vs)) == 1) & (F.size(vs) > 1)
            chosen = let(shape(F.get(one(vs), 0), left - 1), lambda s: _space(s["kind"], s["options"], s["nullable"] | (s["kind"] == "choice"), s["levels"])) if left else _space("free")
            return F.when(alone, chosen).otherwise(_space("free"))

        return F.when(variants.isNotNull(), let(variants, either)).otherwise(let(_types(p), own))

    return let(schema, lambda p: F.when(p.isNotNull(), shape(p, depth)))


def answer_spaces(schemas: DataFrame, id_col: str = "id", schema_col: str = "schema") -> DataFrame:
    """(id, state, position, name, description, kind, options, nullable, levels): a row per property of each schema, or one without a name for a bare schema.

    state is none (the answer is any JSON or text, or there is no schema), unresolved:$ref, unresolved:options (more than MAX_OPTIONS) or resolved; only
    resolved schemas have properties, the others one row of nulls. Text that is no JSON counts as no schema.
    """
    inner = schemas.select(F.col(id_col).alias("id"), unwrapped(F.when(F.try_parse_json(schema_col).isNotNull(), F.col(schema_col))).alias("s"))
    free = _at(F.col("s"), "type").isin("json_object", "text")
    state = F.when(F.col("s").isNull() | F.coalesce(free, F.lit(False)), "none").when(F.col("s").rlike(r'"\$ref"\s*:'), "unresolved:$ref")
    props = F.map_entries(F.from_json(_at(F.col("s"), "properties"), "map<string,string>"))
    bare = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("s").alias("value")))
    fields = F.transform(F.coalesce(props, bare), lambda e, i: F.struct(i.alias("position"), e["key"].alias("name"), _at(e["value"], "description").alias("description"), space(e["value"]).alias("x")))
    read = inner.select("id", state.alias("state"), F.when(state.isNull(), fields).alias("f"))
    many = F.exists("f", lambda x: (x["x"]["kind"] == "choice") & (F.size(x["x"]["options"]) > MAX_OPTIONS))
    final = read.withColumn("state", F.coalesce("state", F.when(many, "unresolved:options"), F.lit("resolved")))
    flat = final.select("id", "state", F.explode_outer(F.when(F.col("state") == "resolved", F.col("f"))).alias("f"))
    return flat.select("id", "state", "f.position", "f.name", "f.description", "f.x.kind", "f.x.options", "f.x.nullable", "f.x.levels")
