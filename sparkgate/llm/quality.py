"""Quality rules with a hashed n-gram log-likelihood ratio. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgate.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use() repeats it or puts it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Words as array<string>. Texts whose only white space is blanks and line feeds, nearly all, take the split at one character."""
    text = F.coalesce(text, F.lit(""))
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\f")) | F.contains(text, F.lit("\r"))
    plain = F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ", -1), "")
    return F.when(odd, F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).otherwise(plain)


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda x: F.xxhash64(x))


def pair_hashes(h: Column) -> Column:
    """A 64-bit hash of each word with the next one."""
    return F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1)))


def grams_of(h: Column, pairs: Column, orders: tuple[int, ...]) -> Column:
    """The hashes that are counted: words (order 1), pairs of words (order 2) or both."""
    kinds = [{1: h, 2: pairs}[n] for n in orders]
    return kinds[0] if len(kinds) == 1 else F.concat(*kinds)


def repeated_words(h: Column, pairs: Column) -> Column:
    """How many words lie in a 5-word window that occurs twice or more in the text; from 64-bit hashes of words and pairs.

    Texts without a repeated window stop at a hash set of their windows; the others sort them once, so a very long or very
    repetitive text takes n log n.
    """
    windows = F.transform(F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 3, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(pairs, i + 2), F.get(h, i + 4)))

    def covered(ordered):
        same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        twice = F.sort_array(F.transform(F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
        return F.aggregate(twice, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda acc, i: F.struct((i + 5).alias("end"), (acc["n"] + i + 5 - F.greatest(i, acc["end"])).alias("n")))["n"]

    def count(w):
        # Only windows whose hash is one of the repeated ones are sorted with their places.
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ordered, covered))

    return let(windows, count)


def trusted_sample(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` ids of trusted documents (quality 1, not toxic) in the order of a hash of the id: bounded, so it may be broadcast."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int, most_trusted: int, smoothing: float, orders: tuple[int, ...] = (1, 2), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(bucket, ratio) for every one of the `buckets` hash buckets: log of the trusted over the raw share of the bucket.

    The raw multinomial counts every n-gram of every document. The trusted one counts those of a bounded sample of the labelled
    trusted documents. Both come from one pass whose shuffle holds a row per bucket and task.
    """
    good = trusted_sample(labels, most_trusted).select(F.col("doc_id").alias("_good"))
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(good), F.col("_id") == F.col("_good"), "left")
    pairs = let(word_hashes(words(F.col("_text"))), lambda h: grams_of(h, pair_hashes(h), orders))
    hashed = marked.select(F.col("_good").isNotNull().cast("long").alias("good"), F.explode(pairs).alias("gram"))
    grams = hashed.select("good", F.col("gram").bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int").alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("trusted"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "trusted"])
    total = every.agg(F.sum("raw").alias("raw_all"), F.sum("trusted").alias("trusted_all"))
    share = lambda n, of: F.log((F.col(n) + smoothing) / (F.col(of) + smoothing * buckets))
    return every.join(F.broadcast(total)).select("bucket", F.when(F.col("trusted_all") > 0, share("trusted", "trusted_all") - share("raw", "raw_all")).otherwise(F.lit(0.0)).alias("ratio"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = -0.1, buckets: int = 1 << 15, most_trusted: int = 20_000, smoothing: float = 1.0, orders: tuple[int, ...] = (1, 2), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    score is the mean over a document's words and pairs of neighbouring words of the log-ratio of their hash bucket between trusted and raw
    documents; kept is false where base_failed, else score >= threshold, for every document alike. The table of ratios has
    `buckets` rows at any input size and reaches the tasks as one array.

    One row per input row, with all its columns; columns of docs named like a result are replaced. A null or empty text has no words, score 0
    and fails the base. Labels with null ids or quality are ignored; without any trusted label all ratios
    and scores are 0. Ids repeated in docs count once for each row. An empty table gives an empty result. Very long texts take n log n at most.
    """
    spark = docs.sparkSession
    table = materialize(log_ratios(docs, labels, buckets, most_trusted, smoothing, orders, text_col, id_col), "ratios")
    ratios = table.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x["ratio"]).alias("r"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    held = [c for c in docs.columns if c not in names]
    carried = [F.col(f"`{c}`") for c in held]
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    read = docs.select(*carried, words(F.col(text_col)).alias("_w"), F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"), dup_lines.cast("long").alias("n_dup_lines"))
    hashed = read.select(*carried, "n_symbols", "n_dup_lines", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), word_hashes(F.col("_w")).alias("_h"))
    paired = hashed.withColumn("_p", pair_hashes(F.col("_h"))).withColumn("_r", ratios.scalar())
    mask = F.lit(buckets - 1).cast("long")
    grams = grams_of(F.col("_h"), F.col("_p"), orders)
    total = F.aggregate(grams, F.lit(0.0), lambda acc, x: acc + F.get(F.col("_r"), x.bitwiseAND(mask).cast("int")))
    n_grams = sum({1: F.size("_h"), 2: F.size("_p")}[n] for n in orders)
    score = F.when(n_grams > 0, total / n_grams).otherwise(F.lit(0.0))
    counted = paired.select(*carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("_h"), F.col("_p")).cast("long").alias("n_repeat_words"), score.alias("score"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # The partition number keeps a filter on kept above this projection: pushed below, it would compute the array expressions anew inside lambdas.
    kept = ~F.col("base_failed") & (F.col("score") >= threshold) & (F.spark_partition_id() >= 0)
    return counted.withColumn("base_failed", failed).withColumn("kept", kept)


def op5_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
