"""Joins that resolve names: imports to files, requests to cached replies, models to a catalogue, rows to sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a TypeScript import may leave out, in search order, and the sources behind an emitted extension.
TS_ENDINGS = ["", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.jsx", "/index.mts", "/index.cts", "/index.mjs", "/index.cjs", "/index.js"]
EMITTED = [(".js", ".ts"), (".js", ".tsx"), (".jsx", ".tsx"), (".mjs", ".mts"), (".cjs", ".cts")]


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _pairs(left: Column, right: Column) -> Column:
    """All a + b, in order of left and then of right."""
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, b))))


def _under(folder: Column) -> Column:
    return F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/")))


def python_candidates(path: Column, level: Column, module: Column, sdk_packages: list[str]) -> tuple[Column, Column, Column]:
    """(exact, suffixes, package): paths to try in order, those that may match the end of a path, and the __init__ file whose presence rules out the importer's own folder (exact then starts with two of that folder)."""
    file = F.replace(module, F.lit("."), F.lit("/"))
    ends = F.when(file == "", _texts("__init__.py")).otherwise(F.array(F.concat(file, F.lit(".py")), F.concat(file, F.lit("/__init__.py"))))
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    up = F.size(folders) - (level - 1)
    base = F.array_join(F.slice(folders, 1, F.greatest(up, F.lit(0))), "/")
    own = F.array_join(folders, "/")
    short = ~module.contains(".") | module.startswith("langchain_")
    inside = F.size(folders) > 0
    none = _texts()
    exact = (
        F.when((level > 0) & (up < 0), none).when(level > 0, _pairs(F.array(_under(base)), ends)).when(F.substring_index(module, ".", 1).isin(sdk_packages), none)
        .when(short & inside, _pairs(F.array(_under(own), F.lit(""), F.lit("src/")), ends)).when(short, _pairs(_texts("", "src/"), ends)).otherwise(ends)
    )
    suffixes = F.when((level > 0) | short | F.substring_index(module, ".", 1).isin(sdk_packages), none).otherwise(ends)
    return exact, suffixes, F.when((level == 0) & short & inside, F.concat(_under(own), F.lit("__init__.py")))


def normalized(path: Column) -> Column:
    """path without empty, . and .. segments; null if it climbs above the root."""
    start = F.array().cast("array<string>")
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def ts_candidates(path: Column, spec: Column) -> tuple[Column, Column, Column]:
    """As python_candidates for a TypeScript or JavaScript import; only relative specs and the aliases @/ and ~/ name project files."""
    alias = F.when(spec.startswith("@/") | spec.startswith("~/"), F.substring(spec, 3, 1 << 30))
    relative = spec.rlike(r"^(\.|\.\.)$|^\.\.?/")
    folder = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    bases = F.when(relative, F.array_compact(F.array(normalized(F.concat(folder, F.lit("/"), spec))))).when(alias.isNotNull(), F.array(alias, F.concat(F.lit("src/"), alias))).otherwise(_texts())

    def stems(b: Column) -> Column:
        swapped = [F.when(b.endswith(old), F.regexp_replace(b, "\\" + old + "$", new)) for old, new in EMITTED]
        return F.array_compact(F.array(b, *swapped))

    ends = _texts(*TS_ENDINGS)
    exact = _pairs(F.flatten(F.transform(bases, stems)), ends)
    return exact, F.when(alias.isNotNull() & ~relative, _pairs(stems(alias), ends)).otherwise(_texts()), F.lit(None).cast("string")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(id, target): the file each import means, null if none or several do.

    imports (id, exact, suffixes, package), ids distinct; files (rel), distinct. The first exact path that exists wins. Else the first suffix
    that ends any path decides: its file if it is the only one. Suffixes of paths are grouped once, so that an ending with many files (index.ts) is
    one row of the join.
    """
    names = files.select("rel")
    packaged = imports.join(names.select(F.col("rel").alias("package"), F.lit(True).alias("_p")), "package", "left")
    # An importer in a package does not search its own folder: the two paths of that folder go.
    usable = packaged.select("id", "suffixes", F.when(F.col("_p").isNotNull(), F.slice("exact", 3, 1 << 30)).otherwise(F.col("exact")).alias("exact"))
    tried = usable.select("id", F.posexplode("exact").alias("pos", "rel")).join(names, "rel")
    found = tried.groupBy("id").agg(F.min_by("rel", "pos").alias("exact_hit"))
    parts = F.split("rel", "/")
    ends = names.select("rel", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, 1 << 30), "/"))).alias("end"))
    wanted = usable.join(found, "id", "left_anti").select("id", F.posexplode("suffixes").alias("pos", "end"))
    counted = ends.join(wanted.select("end").distinct(), "end", "left_semi").groupBy("end").agg(F.when(F.count("*") == 1, F.min("rel")).alias("hit"))
    ended = wanted.join(counted, "end").groupBy("id").agg(F.min(F.struct("pos", "hit"))["hit"].alias("suffix_hit"))
    return usable.select("id").join(found, "id", "left").join(ended, "id", "left").select("id", F.coalesce("exact_hit", "suffix_hit").alias("target"))


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (key, ...) with response and hit. An entry filed under a key that is not the SHA-256 of its request is no hit."""
    good = cache.where(F.sha2("request", 256) == F.col("key")).groupBy("key").agg(F.max("response").alias("response"), F.lit(True).alias("_hit"))
    return requests.join(good, "key", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def upserted(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """cache (key, request, response) with entries in place of older ones of the same key. One row per key; of several new ones the largest (request, response) stays."""
    both = cache.select("key", F.lit(0).alias("new"), "request", "response").union(entries.select("key", F.lit(1), "request", "response"))
    return both.groupBy("key").agg(F.max(F.struct("new", "request", "response")).alias("x")).select("key", "x.request", "x.response")


def first_models(models: DataFrame) -> DataFrame:
    """models (at, id, prompt, completion): one row per id, the first by at; a price that is no number, or is negative, is null. Rows without an id are dropped."""
    price = lambda c: F.when(F.expr(f"try_cast({c} AS double)") >= 0, F.expr(f"try_cast({c} AS double)")).alias(c)
    first = models.where("id is not null").groupBy("id").agg(F.min(F.struct("at", "prompt", "completion")).alias("x")).select("id", "x.*")
    return first.select("id", price("prompt"), price("completion"))


def resolve_model(calls: DataFrame, models: DataFrame, default: str) -> DataFrame:
    """calls (model, ...) with catalogue_id: the model if the catalogue has its id, else default."""
    return calls.join(models.select(F.col("id").alias("catalogue_id")).distinct(), F.col("model") == F.col("catalogue_id"), "left").withColumn("catalogue_id", F.coalesce("catalogue_id", F.lit(default)))


def rows_of_sites(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """rows (site, ...) with site_id, the site (id) they name, with or without the prefix source:, null if there is none."""
    known = sites.select(F.col("id").alias("site_id")).distinct()
    return rows.join(known, F.regexp_replace("site", "^source:", "") == F.col("site_id"), "left")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys on one side only, with side: empty if both sides have exactly the same keys."""
    marked = left.select(*keys, F.lit(True).alias("_l")).distinct().join(right.select(*keys, F.lit(True).alias("_r")).distinct(), keys, "full_outer")
    return marked.where("_l is null or _r is null").select(*keys, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("side"))
