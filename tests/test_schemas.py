"""Answer spaces of JSON Schemas. Cases are made from small tables of rules, so that each kind meets each envelope and each place."""

import itertools
import json

from sparkgate.functions.schemas import answer_spaces

COLOURS = ["red", "green", "blue"]
#: A schema of each kind, and its (kind, options, nullable, levels).
KINDS = {
    "choice": ({"enum": COLOURS}, ("choice", COLOURS, False, [])),
    "flag": ({"type": "boolean"}, ("yes_no", [], False, [])),
    "grade": ({"type": "integer", "minimum": 4, "maximum": 7}, ("score", [], False, [4.0, 5.0, 6.0, 7.0])),
    "share": ({"type": "number", "minimum": -1, "maximum": 3}, ("score", [], False, [-1.0, 0.0, 1.0, 2.0, 3.0])),
    "marks": ({"type": "array", "items": {"enum": COLOURS}}, ("labels", COLOURS, False, [])),
    "note": ({"type": "string"}, ("free", [], False, [])),
    "fixed": ({"type": "integer", "minimum": 9, "maximum": 9}, ("free", [], False, [])),
}
#: How providers wrap a schema, as functions of it.
ENVELOPES = {
    "bare": lambda s: s,
    "response format": lambda s: {"json_schema": {"strict": True, "schema": s}, "type": "json_schema"},
    "text format": lambda s: {"format": {"schema": s, "type": "json_schema"}},
    "flat format": lambda s: {"strict": False, "type": "json_schema", "schema": s},
    "input schema": lambda s: {"description": "picks", "name": "pick", "input_schema": s},
    "nested function": lambda s: {"function": {"parameters": s, "name": "pick", "strict": True}, "type": "function"},
    "flat function": lambda s: {"strict": True, "parameters": s, "name": "pick", "type": "function"},
}


def spaces(spark, schemas: list) -> list:
    """Of each schema (an object, a text or null) its rows in order: (name, kind, options, nullable, levels), or the state where there is none."""
    texts = [(k, json.dumps(s) if isinstance(s, dict) else s) for k, s in enumerate(schemas)]
    found = answer_spaces(spark.createDataFrame(texts, "id int, schema string")).orderBy("id", "position").collect()
    rows = [[(r.name, r.kind, r.options, r.nullable, r.levels) if r.state == "resolved" else r.state for r in own] for _, own in itertools.groupby(found, key=lambda r: r.id)]
    assert len(rows) == len(schemas)
    return rows


def record(names) -> dict:
    return {"type": "object", "properties": {n: KINDS[n][0] for n in names}, "required": list(names)}


def test_every_kind_alone_and_together(spark):
    alone = spaces(spark, [schema for schema, _ in KINDS.values()])
    assert alone == [[(None, *space)] for _, space in KINDS.values()]
    pairs = list(itertools.permutations(KINDS, 2))
    assert spaces(spark, [record(p) for p in pairs]) == [[(n, *KINDS[n][1]) for n in p] for p in pairs]


def test_every_envelope_around_every_pair_of_kinds(spark):
    cases = [(envelope, pair) for envelope in ENVELOPES.values() for pair in itertools.combinations(KINDS, 2)]
    assert spaces(spark, [envelope(record(pair)) for envelope, pair in cases]) == [[(n, *KINDS[n][1]) for n in pair] for _, pair in cases]


def test_null_beside_a_kind(spark):
    """Null as an option, as an alternative and as a second type: only a choice becomes nullable."""
    optional = lambda n, key: {key: [KINDS[n][0], {"type": "null"}]}
    got = spaces(spark, [{"enum": [None, *COLOURS]}, optional("choice", "anyOf"), optional("choice", "oneOf"), {"type": ["null", "number"], "minimum": 2, "maximum": 6}, {"anyOf": [KINDS["flag"][0], KINDS["note"][0]]}])
    assert got[:3] == [[(None, "choice", COLOURS, True, [])]] * 3
    assert got[3][0][1:2] + got[3][0][4:] == ("score", [2.0, 3.0, 4.0, 5.0, 6.0]) and got[4] == [(None, "free", [], False, [])]


def test_what_stays_unresolved(spark):
    """Too many options and references, at the top and in a field; the word in a description is none."""
    long = {"enum": [f"o{k}" for k in range(256)]}
    reference = {"$ref": "#/definitions/colour"}
    field = lambda s: {"type": "object", "properties": {"colour": s}}
    got = spaces(spark, [long, field(long), {"enum": long["enum"][:255]}, field(reference), {"type": "boolean", "description": "see '$ref': elsewhere"}])
    assert got[0] == got[1] == ["unresolved:options"] and len(got[2][0][2]) == 255
    assert got[3] == ["unresolved:$ref"] and got[4] == [(None, *KINDS["flag"][1])]


def test_what_is_no_schema(spark):
    assert spaces(spark, ["{", "", None, '{"type": "json_object"}']) == [["none"]] * 4
    assert spaces(spark, [{"enum": [1.5, True]}, {"enum": ["one"]}]) == [[(None, "free", [], False, [])]] * 2
