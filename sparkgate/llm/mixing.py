"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgate.llm.quality import let
from sparkgate.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Bins of the sampling order per source; one bin per source is put in exact order.
BINS = 4096


def unit_hash(key: Column, seed: str) -> Column:
    """A double in (0, 1) from 52 bits of SHA-256 over seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, size): the total share of all sizes is divided by weight, weights repeat over
    the sources by code point with null last, no target exceeds `most` times its source, and what is cut off goes to the others by weight.

    Only the list of distinct sources is put in order, never documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("weight", F.element_at(kinds, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("weight"))
    # Sources fill up in the order of cap / weight; the level is the first at which the next source is not yet full.
    filled = Window.orderBy(F.col("full_at"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rest = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(Window.partitionBy())["level"]
    return ranked.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * level), F.col("cap")).alias("target"))


def inclusion(size: Column, c: Column) -> Column:
    """The inclusion probability of one more copy: in proportion to size, 1 at most."""
    return F.least(F.lit(1.0), c * size)


def _order(u: Column, p: Column) -> Column:
    """The Pareto variable, random odds over inclusion odds: 0 where a copy is certain, null where none is drawn."""
    return F.when(p > 0, (u / (1 - u)) * ((1 - p) / p))


def _bin(order: Column) -> Column:
    return F.floor(order / (1 + order) * BINS)


def inclusion_rates(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(r, c) per source r with words to draw: c such that inclusion probabilities min(1, c * size) draw `need` words in expectation.

    The longest documents are certain as far as c * size would pass 1. One row per source and distinct size is put in order, from a
    partial aggregate: as many rows as the longest document has words, at most.
    """
    sizes = sized.where("size > 0").groupBy(F.col("source").alias("r"), "size").agg(F.count("*").alias("n"))
    sizes = sizes.join(plan.select("s", "need"), F.col("r").eqNullSafe(F.col("s"))).where("need > 0")
    down = Window.partitionBy("r").orderBy(F.col("size").desc())
    words = F.col("n").cast("decimal(20,0)") * F.col("size")
    before = F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    rest = F.sum((words * F.col("size")).cast("decimal(38,0)")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("double")
    tried = sizes.select("r", "size", ((F.col("need") - before) / rest).alias("c"))
    return tried.groupBy("r").agg(F.coalesce(F.max_by("c", F.when(F.col("c") * F.col("size") <= 1, F.col("size"))), F.lit(1.0)).alias("c"))


def draw_plan(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per source of sized (doc_id, source, size, u): source_size, target, whole (certain copies), c (inclusion probability of one
    more copy, per word of a document), and where the draw ends: cut_bin and cut, the last (order, doc_id) taken in that bin.

    The order is cut by a histogram of BINS bins per source; only the bin where the missing words run out is sorted, so no source meets in one task.
    """
    plan = source_targets(sized, weights, share, most)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(copies).cast("long")).withColumn("need", F.col("target") - F.floor(copies) * F.col("source_size"))
    plan = materialize(plan.withColumnRenamed("source", "s"), "targets")
    plan = plan.join(inclusion_rates(sized, plan), F.col("s").eqNullSafe(F.col("r")), "left").drop("r").withColumn("c", F.coalesce("c", F.lit(0.0)))
    plan = materialize(plan, "rates")
    placed = sized.join(plan.select("s", "c", "need"), F.col("source").eqNullSafe(F.col("s"))).withColumn("order", _order(F.col("u"), inclusion(F.col("size"), F.col("c")))).withColumn("bin", _bin(F.col("order"))).where("bin is not null")
    bins = placed.groupBy("s", "bin").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    upto = F.sum("words").over(Window.partitionBy("s").orderBy("bin"))
    ends = bins.withColumn("upto", upto).where("upto > need").groupBy("s").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
    ends = materialize(ends.select("s", F.col("end.bin").alias("cut_bin"), F.col("end.before").alias("before")), "ends")
    near = placed.join(ends.withColumnRenamed("s", "e"), F.col("s").eqNullSafe(F.col("e")) & (F.col("bin") == F.col("cut_bin")))
    # Rows of one id have one rank: the default frame takes them together.
    run = F.sum("size").over(Window.partitionBy("s").orderBy("order", "doc_id"))
    last = near.withColumn("run", run).where(F.col("before") + F.col("run") - F.col("size") / 2 <= F.col("need")).groupBy("s").agg(F.max(F.struct("order", "doc_id")).alias("cut"))
    last = last.withColumnRenamed("s", "l")
    full = plan.join(ends.withColumnRenamed("s", "e"), F.col("s").eqNullSafe(F.col("e")), "left").join(last, F.col("s").eqNullSafe(F.col("l")), "left")
    return materialize(full.drop("e", "l", "before", "need"), "plan")


def _copies(u: Column, id_: Column, size: Column) -> Column:
    order = _order(u, inclusion(size, F.col("c")))
    b = _bin(order)
    key = F.struct(order.alias("order"), id_.alias("doc_id"))
    extra = b.isNotNull() & (F.col("cut_bin").isNull() | (b < F.col("cut_bin")) | ((b == F.col("cut_bin")) & F.col("cut").isNotNull() & (key <= F.col("cut"))))
    return F.col("whole") + F.when(extra, 1).otherwise(0)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _sized(docs: DataFrame, seed: str, text_col: str, source_col: str, id_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    return materialize(base.withColumn("u", unit_hash(F.col("doc_id"), seed)), "sizes")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: str = "mix", text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """How often to take each document so that sources reach their target weights.

    A source with target t and size s is worth f = t / s copies of each of its documents. floor(f) copies are certain. The words
    still missing come from one more copy of some documents: the inclusion probability p of a document is in proportion to its
    size, 1 at most, so that the expected words are those missing. Documents are ranked by the Pareto variable
    (u / (1 - u)) / (p / (1 - p)) with u hashed from the id, and the smallest are taken until the missing words are
    reached, so that each source misses its target by at most half a document.

    One row per input row: doc_id, source, size, source_size, target, copies and taken = copies * size. A
    null text has size 0 and is never drawn beyond certain copies; a null source is a source of its own; a null id is a key like any other. Rows that repeat an id have one
    rank and are drawn together. An empty table gives an empty result. Other columns of docs are not carried.
    """
    sized = _sized(docs, seed, text_col, source_col, id_col)
    plan = draw_plan(sized, weights, share, most)
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", _copies(F.col("u"), F.col("doc_id"), F.col("size")))
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: str = "mix", text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The mix itself: each row of docs as often as mix_sources() says, with the columns of docs.

    Texts are not shuffled: each row meets the plan of its source, one row per source, and decides for itself.
    """
    names = docs.columns
    plan = draw_plan(_sized(docs, seed, text_col, source_col, id_col), weights, share, most).select("s", "whole", "c", "cut_bin", "cut")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("held"), F.col(source_col).alias("_source"))
    joined = held.join(plan, F.col("_source").eqNullSafe(F.col("s")))
    own = F.struct(unit_hash(F.col(f"held.`{id_col}`"), seed).alias("u"), size_of(F.col(f"held.`{text_col}`")).alias("size"))
    copies = let(own, lambda x: _copies(x["u"], F.col(f"held.`{id_col}`"), x["size"]))
    # No filter on the copies, which would count the words anew: a null sequence gives no rows.
    repeats = let(copies, lambda n: F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))))
    return joined.select("held", F.explode(repeats).alias("copy")).select("held.*")


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS weight,
         source_size * 2::DOUBLE AS cap FROM totals),
levels AS (
  SELECT *, cap / weight AS full_at,
         ((SELECT sum(source_size) FROM totals)::DOUBLE * 1.5::DOUBLE
           - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
chosen AS (SELECT arg_min(level, full_at) AS level FROM levels WHERE level <= full_at),
targets AS (
  SELECT source, source_size, least(cap, weight * chosen.level) AS target FROM levels, chosen),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0::DOUBLE END AS f FROM targets),
counted AS (SELECT source, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY 1, 2),
wanted AS (SELECT *, target - floor(f) * source_size AS need FROM parts),
tried AS (
  SELECT c.source, c.size, (w.need - coalesce(sum(c.n * c.size) OVER (PARTITION BY c.source ORDER BY c.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(c.n * c.size * c.size) OVER (PARTITION BY c.source ORDER BY c.size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS c
  FROM counted c JOIN wanted w ON c.source IS NOT DISTINCT FROM w.source WHERE w.need > 0),
rates AS (SELECT source, coalesce(arg_max(c, size) FILTER (c * size <= 1), 1::DOUBLE) AS c FROM tried GROUP BY 1),
odds AS (
  SELECT d.doc_id, d.source, d.size, d.u, w.source_size, w.target, w.need, CAST(floor(w.f) AS BIGINT) AS whole, least(1::DOUBLE, coalesce(r.c, 0::DOUBLE) * d.size) AS p
  FROM sized d JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source LEFT JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
pareto AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS pareto FROM odds),
ordered AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY pareto NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM pareto)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN pareto IS NOT NULL AND run - size / 2::DOUBLE <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""
