"""Records of runs and of what a scan binds: calls and their cost, plans, registries, scopes and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgate.operators.judge import shadowed
from sparkgate.session import materialize


def answered_calls(*parts: DataFrame) -> DataFrame:
    """All paid calls (cost, hit, ms) of a run, whatever asked for them."""
    return reduce(DataFrame.unionByName, [p.select("cost", "hit", "ms") for p in parts])


def call_totals(calls: DataFrame, unit: float) -> DataFrame:
    """One row over calls (cost in integer parts of a unit or null, hit, ms): the known cost, the calls without one, cache hits and misses, summed duration."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return calls.agg((zero("cost") / F.lit(unit)).alias("cost"), F.count_if(F.col("cost").isNull()).alias("unpriced"), F.count("*").alias("calls"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), zero("ms").alias("ms"))


def label_balance(rows: DataFrame, label: str) -> DataFrame:
    """(label, n), null labels too."""
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def utc_date(time: Column) -> Column:
    """A timestamp's day, YYYY-MM-DD, in the session's time zone, which is UTC."""
    return F.date_format(time, "yyyy-MM-dd")


def utc_timestamp(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def in_use(definitions: DataFrame, policies: DataFrame) -> DataFrame:
    """(id, policies) of definitions (id) that policies (definition_id) refer to and that can't be removed."""
    counts = policies.groupBy(F.col("definition_id").alias("id")).agg(F.count("*").alias("policies"))
    return definitions.select("id").distinct().join(counts, "id")


def key_policies(entries: DataFrame, scopes: list[str]) -> DataFrame:
    """Distinct ids of entries (id, scope) that no earlier scope shadows."""
    return shadowed(entries, scopes).where("state = 'active'").select("id").distinct()


def planned(runs: DataFrame, plans: DataFrame, site: str) -> DataFrame:
    """runs with the columns of the plan of their site, and planned, false where there is none."""
    return runs.join(plans.withColumn("planned", F.lit(True)), site, "left").withColumn("planned", F.coalesce("planned", F.lit(False)))


def edges_of(alternatives: DataFrame, edges: DataFrame) -> DataFrame:
    """alternatives with the edge (caller, wrapper, ...) they come through."""
    return alternatives.join(edges, ["caller", "wrapper"])


def accepted_routes(requests: DataFrame, replies: DataFrame, routes: list[str]) -> DataFrame:
    """Replies that may be acted on: accepted, measured, passed, without fallback, of the request and policy asked for, with a known route."""
    good = replies.where((F.col("status") == "accepted") & (F.col("evidence") == "measured") & F.col("passed") & ~F.col("fallback") & F.col("route").isin(*routes))
    return requests.select("request_id", "policy_id").join(good, ["request_id", "policy_id"])


def allowed_tools(rows: DataFrame, tool: str, allowed: list[str], own_prefixes: list[str]) -> DataFrame:
    """Rows whose tool is on the list and is none of our own."""
    own = reduce(lambda a, b: a | b, [F.col(tool).startswith(p) for p in own_prefixes])
    return rows.where(F.col(tool).isin(*allowed) & ~own)


def first_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by order: a partial aggregate, so a hot key isn't gathered."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_x")).select(key, "_x.*").select(*rows.columns)


def default_exports(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """imports (target, remote, ...) with `default` replaced by the name that its target exports by default (exports: target, name), where it has one."""
    named = imports.join(exports.select("target", F.col("name").alias("_name")), "target", "left")
    return named.withColumn("remote", F.when(F.col("remote") == "default", F.coalesce("_name", "remote")).otherwise(F.col("remote"))).drop("_name")


def scope(own: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, name, found): what each name of a file means. own (file, name, module), imports (file, at, local, remote, target), symbols (target, name).

    Names of the file's own module level win (own); a name of a function is hidden by any import of that name, else it stands (local); of the imports whose
    target has the remote name the first counts (target:remote).
    """
    names = own.groupBy("file", "name").agg(F.max("module").alias("module"))
    brought = imports.select("file", F.col("local").alias("name")).distinct().withColumn("_i", F.lit(True))
    held = names.join(brought, ["file", "name"], "left").where(F.col("module") | F.col("_i").isNull())
    mine = held.select("file", "name", F.when(F.col("module"), 0).otherwise(1).alias("p"), F.lit(0).cast("long").alias("at"), F.when(F.col("module"), "own").otherwise("local").alias("found"))
    known = imports.join(symbols.select("target", F.col("name").alias("remote")), ["target", "remote"])
    theirs = known.select("file", F.col("local").alias("name"), F.lit(2).alias("p"), F.col("at").cast("long"), F.concat_ws(":", "target", "remote").alias("found"))
    return mine.unionByName(theirs).groupBy("file", "name").agg(F.min(F.struct("p", "at", "found")).alias("x")).select("file", "name", "x.found")


def bound_names(used: DataFrame, definitions: DataFrame, imports: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, def, how): the definition that each use (ids, file, name, byte) of a name means.

    The innermost range [start, end) of definitions (file, name, start, end, def) that holds the use counts, the larger def of equal ranges; else the least
    import (file, name, def); how is scope, import or null. An equi-join on file and name with the range as a condition, then a partial aggregate.
    """
    ranges = definitions.select("file", "name", "start", "end", "def")
    inner = used.join(ranges, ["file", "name"]).where((F.col("start") <= F.col("byte")) & (F.col("byte") < F.col("end")))
    best = inner.groupBy(*ids).agg(F.max(F.struct("start", (-F.col("end")).alias("e"), "def")).alias("x")).select(*ids, F.col("x.def").alias("_scope"))
    outer = imports.groupBy("file", "name").agg(F.min("def").alias("_import"))
    out = used.join(best, ids, "left").join(outer, ["file", "name"], "left")
    return out.select(*ids, F.coalesce("_scope", "_import").alias("def"), F.when(F.col("_scope").isNotNull(), "scope").when(F.col("_import").isNotNull(), "import").alias("how"))


# Method names too common to mean a wrapper by themselves.
GENERIC_METHODS = ["invoke", "ainvoke", "run", "arun", "call", "acall", "create", "generate", "agenerate", "complete", "acomplete", "chat", "achat", "predict", "query", "stream", "astream", "send", "request", "execute"]


def callers(calls: DataFrame, bound: DataFrame, namespaces: DataFrame, modules: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(call, wrapper, how): the wrappers that each call may mean.

    calls (call, file, python, name, object, byte, schema_keyword), object being null for a plain call; bound (call, target, start), the definition a plain name
    means; namespaces (file, local, target), modules imported whole; modules (target, name, start), their top-level functions; wrappers (wrapper, file, start, end,
    python, name, method). Plain and namespace calls mean functions by where they are defined, other calls methods by name; common method names need a schema
    keyword too. A call within the wrapper's own range means nothing.

    The result is as large as calls times wrappers of a place or name, so it is never shuffled: rows are made distinct before the joins. Only those of calls or
    wrappers whose id has several rows are made distinct after them. Calls are sent to what their names are bound to and to wrappers, not for ids that repeat or
    for modules where those are few: such tables are written and counted first.
    """
    again_c, again_w = (_few(rows.groupBy(F.col(key).alias("_id")).count().where("count > 1").select("_id"), "repeated") for rows, key in ((calls, "call"), (wrappers, "wrapper")))
    fixed = bound.select("call", "target", "start").repartition("call").distinct(), _few(namespaces.select("file", "local", "target").distinct(), "namespaces")[0], _few(modules.select("target", "name", "start").distinct(), "modules")[0]
    among = lambda rows, key, ids, how: rows.join(ids, F.col(key).eqNullSafe(F.col("_id")), how)
    pairs = lambda c, w: caller_pairs(c, *fixed, w)
    once_c, once_w, again = calls, wrappers, []
    if again_c[1]:
        once_c = among(calls, "call", again_c[0], "left_anti")
        again.append(pairs(among(calls, "call", again_c[0], "left_semi"), wrappers))
    if again_w[1]:
        once_w = among(wrappers, "wrapper", again_w[0], "left_anti")
        again.append(pairs(once_c, among(wrappers, "wrapper", again_w[0], "left_semi")))
    out = pairs(once_c, once_w)
    return out.unionByName(reduce(DataFrame.unionByName, again).distinct()) if again else out


def _few(rows: DataFrame, name: str, most: int = 10_000) -> tuple[DataFrame, int]:
    """rows, written, and their number: broadcast where they are few, and else never."""
    rows = materialize(rows, name)
    n = rows.count()
    return (F.broadcast(rows) if n <= most else rows.hint("merge")), n


def caller_pairs(calls: DataFrame, bound: DataFrame, namespaces: DataFrame, modules: DataFrame, wrappers: DataFrame) -> DataFrame:
    """callers() of tables without repeated rows, with a row for each way that a pair of a call and a wrapper comes about."""
    w = wrappers.select("wrapper", F.col("file").alias("w_file"), "start", "end", F.col("python").alias("w_python"), F.col("name").alias("w_name"), "method")
    plain = calls.where("object is null").join(bound, "call").select(*calls.columns, "target", F.col("start").alias("at"), F.lit("plain").alias("how"))
    spaces = namespaces.select("file", F.col("local").alias("object"), "target")
    within = calls.where("object is not null").join(spaces, ["file", "object"])
    spaced = within.join(modules.select("target", "name", F.col("start").alias("at")), ["target", "name"]).select(*calls.columns, "target", "at", F.lit("namespace").alias("how"))
    defined = plain.unionByName(spaced)
    same = F.col("python") == F.col("w_python")
    by_place = defined.join(w.where(~F.col("method")), (F.col("target") == F.col("w_file")) & (F.col("at") == F.col("start")) & same)
    others = calls.where("object is not null").join(spaces.select("file", "object").distinct(), ["file", "object"], "left_anti").select(*calls.columns, F.lit("method").alias("how"))
    by_name = others.where(~F.col("name").isin(GENERIC_METHODS) | F.col("schema_keyword")).join(w.where("method"), (F.col("name") == F.col("w_name")) & same)
    inside = (F.col("file") == F.col("w_file")) & (F.col("start") <= F.col("byte")) & (F.col("byte") < F.col("end"))
    found = [x.where(~inside).select("call", "wrapper", "how") for x in (by_place, by_name)]
    return found[0].unionByName(found[1])


def eligible(name: Column, roles: Column, tier: Column, static_prompt: Column) -> Column:
    """May a function stand for the calls in it? A schema, model or forwarded argument depends on a parameter, or a prompt does and the answers are open or no text is static."""
    has = lambda r: F.array_contains(roles, r)
    open_ = tier.isin("review", "not_decision") | static_prompt.isNull()
    return (F.length(name) > 0) & (has("schema") | has("model") | has("forward") | (has("prompt") & open_))


def preview(rows: DataFrame, order: list[str], most: int = 20) -> DataFrame:
    """The first rows in order, 100 at most: a top-k, not a sort of all."""
    return rows.orderBy(*order).limit(max(0, min(most, 100)))


def frontier_words(wrappers: DataFrame) -> DataFrame:
    """Distinct words (word) that a file must hold to call a wrapper (name, python, method, file, default): its name, and the module name of a script file whose default export is a function."""
    module = F.regexp_extract("file", r"([^/.]+)\.[^/]*$", 1)
    more = F.when(~F.col("python") & ~F.col("method") & F.col("default"), module)
    return wrappers.select(F.explode(F.array_compact(F.array("name", more))).alias("word")).distinct()


def definition_tables(documents: DataFrame, id_col: str, json_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """definitions, questions and outputs, as validation.definition_problems() takes them, of JSON documents (id, json).

    {"schema_version", "id", "site_id", "definition_revision", "questions": {name: {"type", "criteria": object or array}}, "outputs": [{"name", "type", "question",
    "cutoff", "nullable_option", "level_values"}]}. Text that is no JSON object gives a definition of nulls.
    """
    d = documents.select(F.col(id_col).alias("definition"), F.from_json(json_col, "schema_version string, id string, site_id string, definition_revision string, questions map<string,string>, outputs array<struct<name:string,type:string,question:string,cutoff:double,nullable_option:string,level_values:array<double>>>").alias("j"))
    definitions = d.select("definition", "j.schema_version", "j.id", "j.site_id", F.col("j.definition_revision").alias("revision"))
    asked = d.select("definition", F.explode("j.questions").alias("question", "q"))
    criteria = F.get_json_object("q", "$.criteria")
    names = F.when(criteria.startswith("["), F.from_json(criteria, "array<string>")).otherwise(F.json_object_keys(criteria))
    questions = asked.select("definition", "question", F.get_json_object("q", "$.type").alias("kind"), F.coalesce(names, F.array().cast("array<string>")).alias("criteria"))
    given = d.select("definition", F.explode("j.outputs").alias("o"))
    outputs = given.select("definition", F.col("o.name").alias("output"), F.col("o.type").alias("shape"), F.col("o.question").alias("question"), F.col("o.cutoff").alias("cutoff"), F.col("o.nullable_option").alias("null_option"), F.col("o.level_values").alias("level_values"))
    return definitions, questions, outputs
