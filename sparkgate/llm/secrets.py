"""Secret scan with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgate.session import materialize

# The base patterns, each with the group that holds the secret and the least length of match and of group.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}+"
#: Well-known credential formats beyond the base kinds.
PROVIDER = r"gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{20,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
#: Kinds in the order that breaks ties of equal starts.
KINDS = ("assign", "access", "hex", "provider", "live", "example")
SPAN = "struct<start:int,end:int,kind:string>"
#: Code points of a text that redact() cuts at a time.
BLOCK = 1000


def _matches(text: Column, pattern: str, row) -> Column:
    """Leftmost non-overlapping matches as an array of row(place, gap, hit), gap being the code points between a match and the one before.

    Only lengths are kept; where a match starts is a running sum over them, which candidates() makes.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    placed = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit")), lambda x, i: row(i, x["gap"], x["hit"]))
    return F.when(text.rlike(pattern), placed)


def _found(text: Column) -> Column:
    """All matches: array<struct<kind, i, gap, size, ok, skip, length, hash, alive>>, the secret being `length` code points after `skip` of the match."""

    def kind(name, secret, ok):
        def row(i, gap, hit):
            value = secret(hit)
            return F.struct(F.lit(name).alias("kind"), i.alias("i"), gap.alias("gap"), F.length(hit).alias("size"), ok(hit, value).alias("ok"), (F.length(hit) - F.length(value)).alias("skip"), F.length(value).alias("length"), F.sha2(value, 256).alias("hash"), _looks_live(value).alias("alive"))

        return row

    whole, yes = lambda hit: hit, lambda hit, value: F.lit(True)
    assign = _matches(text, ASSIGN, kind("assign", lambda hit: F.regexp_extract(hit, ASSIGN, 2), lambda hit, value: F.length(value) >= 8))
    access = _matches(text, ACCESS, kind("access", whole, lambda hit, value: F.length(hit) >= 16))
    parts = [assign, access, _matches(text, HEX, kind("hex", whole, yes)), _matches(text, PROVIDER, kind("provider", whole, yes))]
    return F.flatten(F.array_compact(F.array(*parts)))


def candidates(base: DataFrame) -> DataFrame:
    """One row per candidate of base (row, repository, owner, found): row, repository, owner and x (start, end, kind, at, length, hash, alive).

    Starts are running sums in a window over the matches of one kind in one text: lengths only, in n log n.
    """
    each = base.where(F.size("found") > 0).select("row", "repository", "owner", F.inline("found"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).where("ok")
    return placed.select("row", "repository", "owner", F.struct("start", "end", "kind", (F.col("start") + F.col("skip")).alias("at"), "length", "hash", "alive").alias("x"))


def _looks_live(secret: Column) -> Column:
    """Letters and digits, at least 6 distinct characters and no placeholder word."""
    distinct = F.size(F.array_distinct(F.split(secret, "")))
    return secret.rlike("[A-Za-z]") & secret.rlike("[0-9]") & (distinct >= 6) & ~secret.rlike(r"(?i)example|changeme|placeholder|your|dummy|xxxx|sample|1234567")


def span_text(spans: Column) -> Column:
    """kind:start:end by start, then kind in the order of KINDS, comma-joined."""
    rank = {k: i for i, k in enumerate(KINDS)}
    order = F.create_map(*[x for k, i in rank.items() for x in (F.lit(k), F.lit(i))])
    keyed = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), order[x["kind"]].alias("k"), x["end"].alias("e"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def _distinct(spans: Column) -> Column:
    """Distinct spans in order. Structs have no hash set in array_distinct, so equal ones are found side by side."""
    alone = lambda ordered: F.filter(ordered, lambda x, i: (i == 0) | (x != F.get(ordered, i - 1)))
    return F.element_at(F.transform(F.array(F.sort_array(spans)), alone), 1)


def scan_secrets(docs: DataFrame, shared_owners: int = 3, shared_repositories: int = 3, text_col: str = "text", id_col: str = "doc_id", repository_col: str = "source", owner_col: str = "source") -> DataFrame:
    """Secrets of each text, each told apart by how many owners and repositories hold the same value.

    Candidates are hashed; a hash held by at least `shared_owners` distinct owners or `shared_repositories` distinct repositories
    is a widely copied example, and gets a span of kind `example` around its value. A hash below both that looks
    live (see _looks_live) gets one of kind `live`. Base spans (assign, access, hex, and provider formats) always stay.

    One row per input row: row, the id, found (array of start, end, kind, at, secret hash, owners, repositories, class) and spans
    (array of start, end, kind with the added kinds). A null text is empty. Null owners and repositories count as no owner. Repeated
    rows give repeated rows. An empty table gives an empty result. Positions are code points, end exclusive. Other columns of docs are not carried.

    Texts are read once and never shuffled: only candidates are, in two partial aggregates (distinct holders, then counts) and
    one equi-join on the hash that the skew join can split.
    """
    found = _found(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(repository_col).alias("repository"), F.col(owner_col).alias("owner"), found.alias("found"))
    base = materialize(base, "secrets")
    each = materialize(candidates(base), "candidates")
    holders = each.select(F.col("x.hash").alias("hash"), F.explode(F.array(F.struct(F.lit("owner").alias("role"), F.col("owner").alias("name")), F.struct(F.lit("repository").alias("role"), F.col("repository").alias("name")))).alias("h")).select("hash", "h.role", "h.name").distinct()
    counts = holders.groupBy("hash").agg(F.count(F.when((F.col("role") == "owner"), F.col("name"))).alias("owners"), F.count(F.when(F.col("role") == "repository", F.col("name"))).alias("repositories"))
    shared = (F.col("owners") >= shared_owners) | (F.col("repositories") >= shared_repositories)
    judged = each.select("row", "x", F.col("x.hash").alias("hash")).join(counts, "hash")
    judged = judged.withColumn("class", F.when(shared, "example").when(F.col("x.alive"), "live").otherwise("other"))
    by_row = judged.groupBy("row").agg(F.collect_list(F.struct("x.start", "x.end", "x.kind", "x.at", "x.length", "hash", "owners", "repositories", "class")).alias("found"))
    out = base.select("row", "doc_id", "owner", "repository").join(by_row, "row", "left")
    out = out.withColumn("found", F.coalesce("found", F.array().cast(by_row.schema["found"].dataType)))
    plain = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")).cast(SPAN))
    added = F.transform(F.filter("found", lambda x: x["class"] != "other"), lambda x: F.struct(x["at"].alias("start"), (x["at"] + x["length"]).alias("end"), x["class"].alias("kind")).cast(SPAN))
    # Two kinds may hold the same value; what ownership adds is listed once.
    return out.withColumn("spans", F.concat(plain, _distinct(added)))


def op3_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def _blocks(cuts: DataFrame) -> DataFrame:
    """(_key, i, cuts) of spans (_key, start, end): overlapping and touching spans are one, and are dealt to the blocks of BLOCK code points they lie in.

    cuts are (start, end, first) within the block, in order; first is true in the block where the span starts.
    """
    order = Window.partitionBy("_key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(F.col("start") > F.col("reach"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = cuts.withColumn("reach", reach).withColumn("group", group).groupBy("_key", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    first, last = F.floor(F.col("start") / BLOCK).cast("int"), F.floor((F.col("end") - 1) / BLOCK).cast("int")
    dealt = merged.select("_key", "start", "end", first.alias("first"), F.explode(F.sequence(first, last)).alias("i"))
    local = F.struct(F.greatest(F.col("start") - F.col("i") * BLOCK, F.lit(0)).alias("start"), F.least(F.col("end") - F.col("i") * BLOCK, F.lit(BLOCK)).alias("end"), (F.col("i") == F.col("first")).alias("first"))
    return dealt.groupBy("_key", "i").agg(F.sort_array(F.collect_list(local)).alias("cuts"))


def redact(docs: DataFrame, kinds: tuple[str, ...] = ("live",), mark: str = "[SECRET]", text_col: str = "text", repository_col: str = "source", owner_col: str = "source", **options) -> DataFrame:
    """docs with every span of the given kinds replaced by a mark: same columns, same rows. A null text stays null.

    Only texts with a candidate are shuffled, keyed by their SHA-256; all others pass through. A text with something to cut is cut in
    blocks of BLOCK code points, so that very many spans in a very long text take time in proportion to it. Overlapping and touching
    spans are cut as one. Repeated rows are redacted alike.
    """
    any_hit = F.coalesce(F.col(text_col).rlike(f"{ASSIGN}|{ACCESS}|{HEX}|{PROVIDER}"), F.lit(False))
    flagged = docs.where(any_hit).withColumn("_key", F.sha2(F.col(text_col), 256))
    source = flagged.select(F.col("_key"), F.col(text_col).alias("_text"), F.col(repository_col).alias("_repository"), F.col(owner_col).alias("_owner"))
    spans = scan_secrets(source, text_col="_text", id_col="_key", repository_col="_repository", owner_col="_owner", **options)
    cuts = spans.select(F.col("doc_id").alias("_key"), F.explode(F.filter("spans", lambda x: x["kind"].isin(*kinds))).alias("x")).select("_key", "x.start", "x.end").distinct()
    blocks = materialize(_blocks(cuts), "cuts")
    texts = source.select("_key", "_text").join(blocks.select("_key").distinct(), "_key", "left_semi").dropDuplicates(["_key"])
    pieces = texts.select("_key", F.posexplode(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("i", "piece")).join(blocks, ["_key", "i"], "left")
    # From the right, so that positions hold.
    cut = F.aggregate(F.reverse("cuts"), F.col("piece"), lambda acc, x: F.concat(F.substring(acc, F.lit(1), x["start"]), F.when(x["first"], F.lit(mark)).otherwise(F.lit("")), F.substring(acc, x["end"] + 1, F.lit(2**31 - 1))))
    whole = pieces.select("_key", "i", F.when(F.col("cuts").isNull(), F.col("piece")).otherwise(cut).alias("piece")).groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("i", "piece"))).alias("p"))
    clean = whole.select("_key", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("_clean"))
    redacted = flagged.join(clean, "_key", "left").withColumn(text_col, F.coalesce("_clean", text_col)).select(*docs.columns)
    return docs.where(~any_hit).unionByName(redacted)
