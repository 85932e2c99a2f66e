"""Preference formatting: one prompt from the longest common turn prefix, two masked completions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgate.session import materialize

#: Marks of the chat template, and what their opening becomes inside roles and texts so that no text can forge a turn.
START, END = "<|im_start|>", "<|im_end|>"
OPENING, BROKEN = "<|", "< |"


def _clean(x: Column) -> Column:
    return F.replace(F.coalesce(x, F.lit("")), F.lit(OPENING), F.lit(BROKEN))


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation by turn, then role, then text. Rows without conv_id belong to none."""
    own = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.where("conv_id is not null").groupBy("conv_id").agg(F.transform(own, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns are the same in role and text; nulls equal nulls."""
    first_difference = F.array_position(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"].eqNullSafe(p["y"])), False)
    least = F.least(F.size(a), F.size(b))
    return F.when(first_difference > 0, F.least(first_difference.cast("int") - 1, least)).otherwise(least)


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), _clean(t["role"]), F.lit("\n"), _clean(t["text"]), F.lit(f"{END}\n"))), "")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _spans(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Spans of the trained turns, from the lengths of heads and bodies: running sums, so a long conversation takes time in proportion to it."""
    for heads, bodies, trained in parts:
        out = []
        for h, b, t in zip(heads, bodies, trained):
            h, b, t = np.asarray(h, dtype=np.int64), np.asarray(b, dtype=np.int64), np.asarray(t, dtype=bool)
            start = np.cumsum(h + b + 1) - b - 1
            out.append([{"start": int(x), "end": int(x + n)} for x, n in zip(start[t], b[t])])
        yield pd.Series(out, dtype=object)


def trained_spans(turns: Column, trained_role: str) -> Column:
    """The mask of a completion: [start, end) in code points of what is trained on, the text and end mark of each turn of the trained role."""
    heads = F.transform(turns, lambda t: F.length(_clean(t["role"])) + len(START) + 1)
    bodies = F.transform(turns, lambda t: F.length(_clean(t["text"])) + len(END))
    return _spans(heads, bodies, F.transform(turns, lambda t: F.coalesce(t["role"] == trained_role, F.lit(False))))


def format_pairs(pairs: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """pairs (pair_id, c, r, status), c and r being arrays of turns, as format_preferences() gives them. Row by row, nothing is shuffled."""
    both = pairs.withColumn("n", common_prefix(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    both = both.select("pair_id", "status", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    out = both.select("pair_id", "status", F.col("n").alias("n_prompt_turns"), render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"), trained_spans(F.col("c"), trained_role).alias("chosen_spans"), trained_spans(F.col("r"), trained_role).alias("rejected_spans"))
    return out.withColumn("usable", (F.col("status") == "paired") & (F.size("chosen_spans") > 0) & (F.size("rejected_spans") > 0))


def format_preferences(turns: DataFrame, pairs: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per pair: pair_id, status, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans, usable.

    turns has conv_id, turn, role and text; pairs has pair_id, chosen and rejected (conversation ids). The prompt is the longest common
    prefix of turns, rendered once; chosen and rejected are the rest of each conversation, possibly empty. Spans are the mask: code points
    of a completion that are trained on, those of the trained role. status is paired, or which conversation is missing: no_chosen,
    no_rejected or neither. usable says that the pair is whole and both completions have a trained span.

    A conversation that is missing has no turns. Null roles and texts equal nulls and are rendered empty. Repeated turns all count; repeated pairs
    give repeated rows. Empty tables give an empty result or pairs without turns. A row holds one conversation whole, as its output
    does; nothing else is gathered. Other columns are not carried.
    """
    conv = conversations_of(turns)
    of = lambda side: conv.select(F.col("conv_id").alias(side), F.col("turns").alias(f"_{side}"))
    both = pairs.select("pair_id", "chosen", "rejected").join(of("chosen"), "chosen", "left").join(of("rejected"), "rejected", "left")
    none = F.array().cast(conv.schema["turns"].dataType)
    c, r = F.col("_chosen").isNotNull(), F.col("_rejected").isNotNull()
    status = F.when(c & r, "paired").when(r, "no_chosen").when(c, "no_rejected").otherwise("neither")
    return format_pairs(both.select("pair_id", status.alias("status"), F.coalesce("_chosen", none).alias("c"), F.coalesce("_rejected", none).alias("r")), trained_role)


def reply_pairs(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Pairs (pair_id, c, r, status) for format_pairs(), one per conversation: the conversation is chosen; rejected is the same one with its last reply, the
    text of its last turn of the trained role, replaced by the last reply of the next conversation by id, or of the one before if there is none.

    status is paired, no_reply where a conversation has none to replace, and no_other where neither neighbour has one; c and r are equal then.
    Only last replies are joined, not conversations.
    """
    conv = conversations_of(turns)
    place = F.array_position(F.transform("turns", lambda t: F.coalesce(t["role"] == trained_role, F.lit(False))), True)
    backward = F.array_position(F.transform(F.reverse("turns"), lambda t: F.coalesce(t["role"] == trained_role, F.lit(False))), True)
    last = F.when(place > 0, F.size("turns") - backward.cast("int"))
    conv = conv.withColumn("last", last)
    # The last reply is the greatest of its turns: a partial aggregate, so that conversations are gathered once.
    trained = turns.where((F.col("role") == trained_role) & F.col("conv_id").isNotNull())
    replies = trained.groupBy(F.col("conv_id").alias("of")).agg(F.max(F.struct("turn", "role", "text")).alias("x")).select("of", F.col("x.text").alias("reply"))
    replies = materialize(replies, "replies")
    near = lambda step, name: replies.select((F.col("of") - step).alias("conv_id"), F.struct("reply").alias(name))
    both = conv.join(near(1, "after"), "conv_id", "left").join(near(-1, "before"), "conv_id", "left").withColumn("other", F.coalesce("after", "before"))
    status = F.when(F.col("last").isNull(), "no_reply").when(F.col("other").isNull(), "no_other").otherwise("paired")
    swapped = F.transform("turns", lambda t, i: F.when(i == F.col("last"), F.struct(t["role"].alias("role"), F.col("other.reply").alias("text"))).otherwise(t))
    return both.select(F.col("conv_id").alias("pair_id"), status.alias("status"), F.col("turns").alias("c"), F.when(status == "paired", swapped).otherwise(F.col("turns")).alias("r"))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_pairs(reply_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(c)
    return out.select("pair_id", "status", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), "prompt", "chosen", "rejected", text("chosen_spans"), text("rejected_spans"), "usable")


OP4_SQL = """
WITH t AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
a AS (SELECT *, list_max(list_filter(range(1, len(l) + 1), lambda i: l[i].role = 'assistant')) AS last FROM t),
b AS (SELECT conv_id AS o, l[last].text AS reply FROM a WHERE last IS NOT NULL),
j AS (
  SELECT a.*, x.o IS NOT NULL OR y.o IS NOT NULL AS other, CASE WHEN x.o IS NOT NULL THEN x.reply ELSE y.reply END AS reply
  FROM a LEFT JOIN b x ON x.o = a.conv_id + 1 LEFT JOIN b y ON y.o = a.conv_id - 1),
p AS (
  SELECT conv_id AS pair_id, CASE WHEN last IS NULL THEN 'no_reply' WHEN NOT other THEN 'no_other' ELSE 'paired' END AS status,
         list_transform(l, lambda x: {'role': x.role, 'text': x.text}) AS c,
         list_transform(range(1, len(l) + 1), lambda i: {'role': l[i].role, 'text': CASE WHEN i = last AND other THEN reply ELSE l[i].text END}) AS r FROM j),
n AS (
  SELECT *, CAST(coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i:
    c[i].role IS DISTINCT FROM r[i].role OR c[i].text IS DISTINCT FROM r[i].text)) - 1, least(len(c), len(r))) AS BIGINT) AS n FROM p),
e AS (
  SELECT pair_id, status, n,
    list_transform(c, lambda x: {'role': x.role, 'head': '<|im_start|>' || replace(coalesce(x.role, ''), '<|', '< |') || chr(10), 'body': replace(coalesce(x.text, ''), '<|', '< |') || '<|im_end|>'}) AS c,
    list_transform(r, lambda x: {'role': x.role, 'head': '<|im_start|>' || replace(coalesce(x.role, ''), '<|', '< |') || chr(10), 'body': replace(coalesce(x.text, ''), '<|', '< |') || '<|im_end|>'}) AS r
  FROM n),
s AS (
  SELECT pair_id, status, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM e),
o AS (
  SELECT *, list_transform(range(1, len(c) + 1), lambda i: coalesce(list_sum(list_transform(c[1:i - 1], lambda x: length(x.head) + length(x.body) + 1)), 0)) AS ca,
            list_transform(range(1, len(r) + 1), lambda i: coalesce(list_sum(list_transform(r[1:i - 1], lambda x: length(x.head) + length(x.body) + 1)), 0)) AS ra FROM s),
f AS (
  SELECT pair_id, status, n AS n_prompt_turns,
    coalesce(array_to_string(list_transform(p, lambda x: x.head || x.body || chr(10)), ''), '') AS prompt,
    coalesce(array_to_string(list_transform(c, lambda x: x.head || x.body || chr(10)), ''), '') AS chosen,
    coalesce(array_to_string(list_transform(r, lambda x: x.head || x.body || chr(10)), ''), '') AS rejected,
    coalesce(array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i:
      CAST(CAST(ca[i] + length(c[i].head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(ca[i] + length(c[i].head) + length(c[i].body) AS BIGINT) AS VARCHAR)), ','), '') AS chosen_spans,
    coalesce(array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i:
      CAST(CAST(ra[i] + length(r[i].head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(ra[i] + length(r[i].head) + length(r[i].body) AS BIGINT) AS VARCHAR)), ','), '') AS rejected_spans
  FROM o)
SELECT *, status = 'paired' AND chosen_spans <> '' AND rejected_spans <> '' AS usable FROM f
"""
