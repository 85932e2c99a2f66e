"""Scalar functions: shortened and filled texts, estimates, statuses, comparable values, report cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgate.functions.text import jcs, let
from sparkgate.operators.metrics import nearest_level
from sparkgate.operators.sites import collapsed, positioned
from sparkgate.operators.validation import DEFERRED

# Bytes of a token in estimates, the length of short texts and of messages.
BYTES_PER_TOKEN, SHORT, BOUNDED = 3, 60, 512


def compact(text: Column) -> Column:
    """text without white space."""
    return F.replace(collapsed(text), F.lit(" "), F.lit(""))


def short(text: Column) -> Column:
    """text on one line, with an ellipsis after SHORT characters."""
    return let(collapsed(text), lambda x: F.when(F.length(x) > SHORT, F.concat(F.substring(x, 1, SHORT), F.lit("…"))).otherwise(x))


def bounded(text: Column) -> Column:
    return F.substring(text, 1, BOUNDED)


def cell(text: Column) -> Column:
    """text as a cell of a Markdown table."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


MARK = r"(?s)\{\{.*?\}\}"


def filled(template: Column, fields: Column) -> Column:
    """template with every {{name}} replaced by its value in fields, a map of texts; a name that it lacks gives nothing, an open mark stays."""
    marks, gaps = F.regexp_extract_all(template, F.lit(MARK), F.lit(0)), F.split(template, MARK, -1)
    name = lambda m: F.trim(F.substring(m, F.lit(3), F.length(m) - 4))
    value = lambda m: F.when(m.isNull(), "").otherwise(F.coalesce(F.try_element_at(fields, name(m)), F.lit("")))
    return F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), marks.alias("m")), lambda x: F.concat(x["g"], value(x["m"]))), "")


def tokens(size: Column) -> Column:
    """How many tokens so many bytes may be, rounded up."""
    return F.ceil(size / BYTES_PER_TOKEN)


def chat_estimate(prompt_bytes: Column, most_tokens: Column, prompt_price: Column, completion_price: Column) -> Column:
    """The worst cost of a chat attempt: all of its prompt and the most it may answer."""
    return tokens(prompt_bytes) * prompt_price + most_tokens * completion_price


def round_up(amount: Column) -> Column:
    """amount at six decimals, never less."""
    return F.ceil(amount * 1e6) / 1e6


def status_of(reason: Column) -> Column:
    """accepted without a reason, deferred for those that a fallback can answer, else error."""
    return F.when(reason.isNull(), "accepted").when(reason.isin(*DEFERRED), "deferred").otherwise("error")


def exit_code(status: Column) -> Column:
    return F.when(status.isin("accepted", "deferred"), 0).otherwise(1)


def cache_key(endpoint: Column, model: Column, request: Column, repeat: Column) -> Column:
    """The key of a cached call: SHA-256 of endpoint, model, repeat and request (JSON) as canonical JSON; null if the request is no JSON."""
    text = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    return F.sha2(F.concat(F.lit('{"endpoint":'), text(endpoint), F.lit(',"model":'), text(model), F.lit(',"repeat":'), repeat.cast("string"), F.lit(',"request":'), jcs(request), F.lit("}")), 256)


def required_labels(chosen: Column, required: list[str]) -> Column:
    """The required labels that were chosen, in their order."""
    return F.array_intersect(F.array(*map(F.lit, required)), chosen)


def agree(a: dict[str, Column], b: dict[str, Column], outputs: list[tuple[str, str, dict]]) -> Column:
    """Do two sets of answers agree on every required output (name, shape, detail)? A value that is missing on either side disagrees.

    Scores are compared at their nearest levels, labels at the required ones only.
    """
    out = F.lit(True)
    for name, shape, detail in outputs:
        x, y = a[name], b[name]
        if shape == "labels":
            if not detail["required"]:
                continue
            x, y = required_labels(x, detail["required"]), required_labels(y, detail["required"])
        elif not detail.get("required", True):
            continue
        elif shape == "score":
            x, y = nearest_level(x, detail["levels"]), nearest_level(y, detail["levels"])
        out = out & F.coalesce(x == y, F.lit(False))
    return out


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def markdown(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(position, line): a Markdown table of rows in the order of a column that tells them apart: a head, a rule, a line each."""
    head = rows.sparkSession.createDataFrame([(-1, "| " + " | ".join(columns) + " |"), (0, "|" + " --- |" * len(columns))], "position long, line string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.coalesce(F.col(c).cast("string"), F.lit("—"))) for c in columns]), F.lit(" |"))
    return head.union(positioned(rows, F.col(order)).select(F.col("position").cast("long"), line.alias("line")))
