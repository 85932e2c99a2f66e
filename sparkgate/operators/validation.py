"""Validation of versions, ids, sites, responses and definitions: the first broken rule as a text, null if all hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Versions, prefixes and limits of the contracts.
SITE_VERSIONS, REVIEW_VERSION, PROTOCOL_VERSION = ("1.0", "1.1"), "1.1", "1"
PREFIXES = {"source": "source:", "agent_hook": "agent:", "runtime": "runtime:"}
MAX_SITE_ID, MAX_REQUEST_ID, MAX_MESSAGE, MAX_QUESTIONS, MAX_OUTPUTS, MAX_LABELS, MAX_LEVEL = 256, 128, 512, 64, 64, 64, 1e15
DEFERRED = ("low_confidence", "policy_missing", "policy_stale", "unsupported", "timeout", "provider_unavailable", "budget_exhausted", "model_mismatch", "spend_not_authorized")
#: White space and control characters, which no id holds.
SEPARATOR = r"[\x00-\x20\x7F-\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
REGISTRY_ID, NAME, REVISION = r"\A[a-z0-9][a-z0-9._-]{0,127}\z", r"\A[A-Za-z_][A-Za-z0-9_-]{0,63}\z", r"\A[0-9a-f]{64}\z"


def _no(cond: Column) -> Column:
    """The negation; what is unknown does not hold."""
    return ~F.coalesce(cond, F.lit(False))


def rules(*broken: tuple[Column, str]) -> Column:
    """The name of the first broken rule in order, null if none is."""
    return F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in broken])


def version_state(version: Column) -> Column:
    """ok for a canonical version 1.x, incompatible for another major number, else invalid."""
    good = version.rlike(r"\A(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\z")
    return F.when(_no(good), "invalid").when(version.startswith("1."), "ok").otherwise("incompatible")


def is_registry_id(x: Column) -> Column:
    return x.rlike(REGISTRY_ID)


def is_name(x: Column) -> Column:
    return x.rlike(NAME)


def is_site_id(x: Column) -> Column:
    """A namespace, then a token without white space and control characters, MAX_SITE_ID characters at most."""
    return (F.length(x) <= MAX_SITE_ID) & x.rlike(r"(?s)\A(source|agent|runtime):.+\z") & ~x.rlike(SEPARATOR)


def site_problem() -> Column:
    """Over sites (schema_version, origin, kind, id, has_source, has_agent, source_revision, provenance, line, reviewed): the first broken rule of the site's origin."""
    c = F.col
    source, hook, runtime = (c("origin") == o for o in PREFIXES)
    prefix = F.coalesce(*[F.when(c("origin") == o, p) for o, p in PREFIXES.items()])
    good_id = c("id").startswith(prefix) & (c("id") != prefix) & ~c("id").rlike(SEPARATOR)
    version = version_state(c("schema_version"))
    return rules(
        (version == "invalid", "invalid_version"), (_no(c("schema_version").isin(*SITE_VERSIONS)), "incompatible_version"), (_no(good_id), "id_prefix"),
        (source & _no(c("has_source")), "missing:source"), (source & c("has_agent"), "unexpected:agent"), (source & c("source_revision").isNull(), "missing:source_revision"),
        (~source & c("has_source"), "unexpected:source"), (~source & c("source_revision").isNotNull(), "unexpected:source_revision"),
        (hook & _no(c("has_agent")), "missing:agent"), (runtime & c("has_agent"), "unexpected:agent"),
        (~source & (c("kind") != "occurrence"), "kind_not_allowed"), (~source & (F.size("provenance") > 0), "unexpected_provenance"),
        (c("source_revision").isNotNull() & _no(c("source_revision").rlike(REVISION)), "invalid:source_revision"), (c("has_source") & (c("line") == 0), "invalid:source.line"),
        (c("reviewed") & (c("schema_version") != REVIEW_VERSION), "invalid:review_version"),
    )


def response_problem() -> Column:
    """Over responses (protocol_version, request_id, site_id, status, policy_id, evidence, passed, reasons, fallback, provider, error_code, error_message, answers): the first broken rule of the envelope.

    answers is an array of output names; error_code is null without an error.
    """
    c = F.col
    deferred = lambda r: r.isin(*DEFERRED)
    error = c("error_code").isNotNull() | c("error_message").isNotNull()
    named = c("request_id").isNotNull() & c("site_id").isNotNull()
    some, all_deferred, all_errors = F.size("reasons") > 0, F.forall("reasons", deferred), F.forall("reasons", lambda r: ~deferred(r))
    accepted = named & c("provider").isNotNull() & c("policy_id").isNotNull() & c("evidence").isNotNull() & c("passed") & ~some & ~c("fallback") & ~error
    held = named & ~c("passed") & some & all_deferred & c("fallback") & ~error
    failed = c("error_code").isNotNull() & ~deferred(c("error_code")) & ~c("passed") & some & all_errors & c("fallback")
    return rules(
        (_no(c("protocol_version") == PROTOCOL_VERSION), "protocol_version"), (c("request_id").isNotNull() & _no(F.length("request_id").between(1, MAX_REQUEST_ID)), "request_id"),
        (c("site_id").isNotNull() & _no(is_site_id(c("site_id"))), "site_id"), (c("policy_id").isNotNull() & _no(is_registry_id(c("policy_id"))), "policy_id"),
        (c("provider").isNotNull() & (c("provider") == ""), "provider"), (F.length("error_message") > MAX_MESSAGE, "error_message"),
        (F.exists("answers", lambda a: _no(is_name(a))), "answers"),
        ((c("status") == "accepted") & _no(accepted), "accepted"), ((c("status") == "deferred") & _no(held), "deferred"), ((c("status") == "error") & _no(failed), "error"),
        (_no(c("status").isin("accepted", "deferred", "error")), "status"),
    )


def monotonic(values: Column) -> Column:
    """Are the values strictly increasing or strictly decreasing? Fewer than two are."""
    pairs = F.zip_with(F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, F.lit(2), F.greatest(F.size(values), F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.forall(pairs, lambda p: p["a"] < p["b"]) | F.forall(pairs, lambda p: p["a"] > p["b"])


def output_problems(outputs: DataFrame, questions: DataFrame) -> DataFrame:
    """(definition, output, problem) of outputs (definition, output, shape, question, cutoff, null_option, level_values) against questions (definition, question, kind, criteria): every output that breaks a rule, with the first one.

    A question must exist and be of the output's shape; a null option must be one of its criteria; cutoffs lie in [0, 1]; a score has a finite, bounded value
    for each level, strictly monotonic. An output name that repeats in its definition is a duplicate.
    """
    kinds = {"choice": "choice", "yes_no": "yes_no", "labels": "yes_no", "score": "score"}
    want = F.coalesce(*[F.when(F.col("shape") == s, k) for s, k in kinds.items()])
    q = questions.select("definition", "question", "kind", "criteria")
    many = outputs.groupBy("definition", "output").agg(F.count("*").alias("_n"))
    joined = outputs.join(q, ["definition", "question"], "left").join(many, ["definition", "output"])
    c, score = F.col, F.col("shape") == "score"
    problem = rules(
        (_no(is_name(c("output"))), "name"), (c("_n") > 1, "duplicate"), (c("kind").isNull(), "unknown_question"), (c("kind") != want, "question_kind"),
        ((c("shape") == "choice") & c("null_option").isNotNull() & _no(F.array_contains("criteria", c("null_option"))), "null_option"),
        (c("shape").isin("yes_no", "labels") & _no(c("cutoff").between(0, 1)), "cutoff"),
        (score & _no(F.size("level_values") == F.size("criteria")), "level_count"),
        (score & F.exists("level_values", lambda v: F.isnan(v) | (F.abs(v) > MAX_LEVEL)), "level_range"), (score & _no(monotonic(c("level_values"))), "level_order"),
    )
    return joined.select("definition", "output", problem.alias("problem")).where("problem is not null").distinct()


def definition_problems(definitions: DataFrame, questions: DataFrame, outputs: DataFrame) -> DataFrame:
    """(definition, problem) of definitions (definition, schema_version, id, site_id, revision): the first broken rule of those that break one, problems of outputs last."""
    asked = questions.groupBy("definition").agg(F.count("*").alias("_q"), F.count_if(_no(is_name(F.col("question")))).alias("_bad"))
    given = outputs.groupBy("definition").agg(F.countDistinct("output").alias("_o"))
    wrong = output_problems(outputs, questions).groupBy("definition").agg(F.min(F.concat_ws(":", "output", "problem")).alias("_wrong"))
    all_ = definitions.join(asked, "definition", "left").join(given, "definition", "left").join(wrong, "definition", "left")
    c = F.col
    problem = F.coalesce(
        rules(
            (version_state(c("schema_version")) != "ok", "schema_version"), (_no(is_registry_id(c("id"))), "id"), (_no(is_site_id(c("site_id"))), "site_id"),
            (c("revision").isNotNull() & _no(c("revision").rlike(REVISION)), "revision"), (_no(c("_q").between(1, MAX_QUESTIONS)), "questions"),
            (c("_bad") > 0, "question_name"), (_no(c("_o").between(1, MAX_OUTPUTS)), "outputs"),
        ),
        c("_wrong"),
    )
    return all_.select("definition", problem.alias("problem")).where("problem is not null")
