"""Files: source trees, JSON lines with strict keys, ordered datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgate.session import materialize
from sparkgate.sources.tree import MAX_FILE_BYTES, all_files, ignore_rules, not_ignored

# Grammars by extension.
GRAMMARS = {"py": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript"}


def grammar(path: Column) -> Column:
    """The grammar of a path by its extension; null for others and for .d.ts."""
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    chosen = F.coalesce(*[F.when(ext == e, g) for e, g in GRAMMARS.items()])
    return F.when(~path.endswith(".d.ts"), chosen)


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(rel, grammar, bytes, state, text) of the source files under root.

    state is ok, too_large or not_utf8; text is null unless ok. Hidden files and folders, vendored folders and what ignore files exclude are left out; empty files are listed. Only the
    contents of files within the size limit leave the reader.
    """
    found = all_files(spark, root).withColumn("text", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")))
    seen = not_ignored(found.where(grammar(F.col("rel")).isNotNull() & ~F.col("rel").rlike(r"(^|/)\.[^/]*$")), ignore_rules(found))
    state = F.when(F.col("bytes") > MAX_FILE_BYTES, "too_large").when(F.col("text").isNotNull(), "ok").otherwise("not_utf8")
    return seen.select("rel", grammar(F.col("rel")).alias("grammar"), "bytes", state.alias("state"), "text")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value), line from 1 in each file. Lines are numbered in their split, and a table with one row per split gives the offsets."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = materialize(read, "lines")
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(splits.withColumn("before", before), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def supplied_rows(lines: DataFrame) -> DataFrame:
    """lines (line, value, ...) as (line, site, input, reference, invalid), blank lines left out.

    A row is {"site": text, "input": object, "reference": object or null, optional} and nothing else; of others only the line is told.
    """
    v, keys = F.try_parse_json("value"), F.json_object_keys("value")
    kind = lambda n: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")), F.lit("-"))
    known = F.size(F.array_except(keys, F.array(F.lit("site"), F.lit("input"), F.lit("reference")))) == 0
    good = F.coalesce(v.isNotNull() & known & (kind("site") == "STRING") & kind("input").startswith("OBJECT") & (kind("reference").startswith("OBJECT") | kind("reference").isin("-", "VOID")), F.lit(False))
    text = lambda n: F.when(good, F.get_json_object("value", f"$.{n}")).alias(n)
    return lines.where(~F.col("value").rlike(r"^\s*$")).select("line", text("site"), text("input"), text("reference"), (~good).alias("invalid"))


def write_dataset(rows: DataFrame, path: str, key: str = "hash") -> None:
    """JSON lines in order of key, over as many part files as the sort has partitions; the order of part names is the order of keys."""
    rows.orderBy(key).select(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)])).alias("value")).write.text(path)
