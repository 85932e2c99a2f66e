"""Queries over Python sources: a file per part, written from the table, so that the tree grows with it; each with DuckDB SQL of what the files must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkgate.operators import resolve, trees
from sparkgate.plans.catalogue import dealt, table
from sparkgate.plans.tabled import case, fill
from sparkgate.session import materialize, settled
from sparkgate.sources import python_symbols, python_tree, tree
from sparkgate.sources.python_calls import python_calls

BODY = '''import os, json as js
from openai import OpenAI
from .m{m} import x as y, z
from ..pkg import w
from enum import Enum
from typing import Annotated, List, Literal, Optional, Union
from pydantic import BaseModel, Field

MODEL = "m{k}"
LIMITS = {"b": [1, {s}], "a": None}
TWICE = 1
TWICE = 2
MADE = js.loads("{}")


class Team(Enum):
    A = "{b}"
    B = "other"


class Base(BaseModel):
    ok: bool


class Out(Base):
    team: Team
    kind: Literal["{t}", "x", None]
    maybe: "Optional[Team]"
    tags: List[Literal["p{s}", "q"]]
    stars: int = Field(ge=1, le={l})
    noted: Annotated[float, Field(ge=0, le=1)]
    either: Union[str, int]
    why: str


def ask(text, *rest, limit={s}, model=MODEL, **more):
    count = {s}
    def inner(a, b=1):
        return a
    return OpenAI().chat.completions.create(model="m{k}", messages=[{"role": "user", "content": "{p}"}], max_tokens={s}{schema})


class Client:
    async def run(self, q: str):
        try:
            from late import thing
        except ImportError:
            pass
        return {call}
'''


def files(spark, sf):
    """(path, text, ...): one source per part; every 29th doesn't parse, every 31st imports no package."""
    k, s = F.col("p_partkey"), F.col("p_size")
    prompt = case(k % 4, F.lit("Answer yes or no."), fill("Write about {n}", n=F.col("p_name")), fill("Choose from: {b} or {n}", b=F.col("p_brand"), n=F.col("p_name")), F.lit(" "))
    schema = F.when(k % 3 == 0, ", response_format=Out").when(k % 7 == 0, ", response_format=far").otherwise("")
    call = F.when(k % 2 == 0, 'self.c.responses.create(input="Rate it 1 to 5", model=name)').otherwise("self.c.threads.messages.create(input=q)")
    text = fill(BODY, m=k % 10, k=k, s=s, l=k % 5 + 2, b=F.col("p_brand"), t=F.col("p_type"), p=prompt, schema=schema, call=call)
    text = F.when(k % 29 == 0, F.concat(text, F.lit("def (:\n"))).when(k % 31 == 0, F.replace(text, F.lit("from openai import OpenAI\n"), F.lit("\n"))).otherwise(text)
    return table(spark, sf, "part").select(fill("p{x}/f{k}.py", x=k % 20, k=k).alias("path"), text.alias("text"))


def s13(spark, sf):
    return python_calls(dealt(files(spark, sf), "path"))


def parsed(spark, sf, of=files, only=None):
    return materialize(python_tree.nodes(of(spark, sf), only=only), "nodes")


def x20(spark, sf):
    return settled(lambda: trees.functions(parsed(spark, sf, only=trees.FUNCTION_NODES)), spark, "functions")


def x22(spark, sf):
    return settled(lambda: trees.imports(parsed(spark, sf, only=trees.IMPORT_NODES)), spark, "imports")


def x07(spark, sf):
    return settled(lambda: trees.names(parsed(spark, sf, only=trees.NAME_NODES)), spark, "names")


def x15(spark, sf):
    return python_symbols.fields(dealt(files(spark, sf), "path"))


BINDS = ['m = "m{k}"', 'm, n = "a", "b"', 'm = "x"\n{i}m += "y"', "for m in names: pass", "m = MODEL", "pass"]
#: Where a name is bound and where it is used: {b} and {u} stand for the lines.
PLACES = [
    "    {b}\n    {u}\n", "    if p:\n        {b}\n        {u}\n", "    if p:\n        {b}\n    {u}\n", "    try:\n        {b}\n    except E:\n        {u}\n",
    "    with open(p) as w:\n        {b}\n    {u}\n", "    {b}\n    def inner(q):\n        {u}\n",
]


def project(spark, sf):
    """A file per part that binds a model's name in one of six ways in one of six places and takes it from a library of a supplier, which takes it from another file. Every third library and its file take it from each other."""
    k, j = F.col("p_partkey"), F.col("s_suppkey")
    b, w = k % 6, F.floor(k / 6) % 6
    source = [F.concat(F.lit('from lib{j} import MODEL, Base\nclass Mid(Base):\n    why: Team\nclass Out(Mid):\n    own: bool\ndef ask(p, names, m):\n'), F.lit(place)) for place in PLACES]
    indent = F.when(w.isin(0, 5), "    ").otherwise("        ")
    bound = F.replace(F.element_at(F.array(*map(F.lit, BINDS)), (b + 1).cast("int")), F.lit("{i}"), indent)
    # The last way binds nothing: the name is the parameter.
    text = F.element_at(F.array(*source), (w + 1).cast("int"))
    for key, value in (("{b}", bound), ("{u}", F.lit('client.run(model=m, input="{k}")')), ("{j}", F.col("j").cast("string")), ("{k}", k.cast("string"))):
        text = F.replace(text, F.lit(key), value)
    most = table(spark, sf, "supplier").agg(F.max("s_suppkey").alias("most"))
    parts = table(spark, sf, "part").crossJoin(most).withColumn("j", k % F.col("most") + 1).select(fill("f{k}.py", k=k).alias("path"), text.alias("text"))
    library = fill("from base{j} import NAME as MODEL, Root as Base\n", j=j)
    base = F.when(j % 3 == 0, fill("from lib{j} import MODEL as NAME, Base as Root\n", j=j)).otherwise(fill('NAME = "g{j}"\nclass Root:\n    ok: bool\n    why: str\n', j=j))
    suppliers = table(spark, sf, "supplier")
    return parts.unionByName(suppliers.select(fill("lib{j}.py", j=j).alias("path"), library.alias("text"))).unionByName(suppliers.select(fill("base{j}.py", j=j).alias("path"), base.alias("text")))


def linked(nodes):
    """(the ends of all chains of names) of a tree: its imports resolved to files, chains followed."""
    froms = nodes.where("kind = 'ImportFrom'").select("path", "node", F.col("extra").cast("int").alias("level"), F.coalesce("name", F.lit("")).alias("module"))
    exact, suffixes, package = resolve.python_candidates(F.col("path"), F.col("level"), F.col("module"), ["openai", "anthropic"])
    wanted = froms.select(F.concat_ws(":", "path", "node").alias("id"), exact.alias("exact"), suffixes.alias("suffixes"), package.alias("package"))
    files_ = nodes.select(F.col("path").alias("rel")).distinct()
    found = resolve.resolve_imports(wanted, files_).where("target is not null").select(F.regexp_extract("id", "^(.*):[0-9]+$", 1).alias("path"), F.regexp_extract("id", ":([0-9]+)$", 1).cast("int").alias("import"), "target")
    return materialize(trees.followed(trees.module_links(nodes, found)), "ends")


def x09(spark, sf):
    def make():
        nodes = parsed(spark, sf, project)
        return trees.keyword_values(nodes, ["model", "input"], linked(nodes), trees.module_values(nodes)).select("path", "key", "value", "state")

    return settled(make, spark, "models")


def x16(spark, sf):
    def make():
        nodes = parsed(spark, sf, project)
        return trees.inherited(trees.annotated_fields(nodes), trees.class_bases(nodes, linked(nodes)), ["note"])

    return settled(make, spark, "fields")


IGNORED = {".gitignore": "*.txt\nd3/\n!d3/e1/\n", "d1/.gitignore": "e2/*\n!e2/*1.py\n", "d5/.gitignore": "!*.txt\n", "d7/e0/.gitignore": "*\n", "d8/.gitignore": "*.py\n", "d8/.ignore": "!f*5.py\n"}


def s17(spark, sf):
    """Files of parts in a tree whose ignore files exclude, bring back, and can't bring back."""
    k = F.col("p_partkey")
    listed = table(spark, sf, "part").select(F.concat(fill("d{d}/e{e}/f{k}.", d=k % 9, e=F.floor(k / 9) % 4, k=k), F.when(k % 5 == 0, "txt").otherwise("py")).alias("rel"))
    rules = spark.createDataFrame(list(IGNORED.items()), "rel string, text string")
    return tree.not_ignored(listed, tree.ignore_rules(rules))


QUERIES = {"s17_ignored_tree": s17, "s13_python_tree": s13, "x20_functions": x20, "x22_imports": x22, "x07_names": x07, "x15_class_fields": x15, "x09_values_by_name": x09, "x16_inherited_fields": x16}

_parsed = "p AS (SELECT *, p_partkey AS k, 'p' || (p_partkey % 20) || '/f' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 29 <> 0)"
_line = {x: n for n, x in enumerate(BODY.split("\n"), 1)}
_at = lambda start: next(n for x, n in _line.items() if x.strip().startswith(start))
_rows = lambda values: "(VALUES " + ", ".join("(" + ", ".join(v) + ")" for v in values) + ")"
_q = lambda x: "NULL" if x is None else f"'{x}'"
_end = len(BODY.rstrip("\n").split("\n"))
_imports = [("import os", "0", "os", None, "os"), ("import os", "0", "json", None, "js"), ("from openai", "0", "openai", "OpenAI", "OpenAI"), ("from .m", "1", "m*", "x", "y"), ("from .m", "1", "m*", "z", "z"), ("from ..pkg", "2", "pkg", "w", "w"), ("from enum", "0", "enum", "Enum", "Enum"), *[("from typing", "0", "typing", x, x) for x in ("Annotated", "List", "Literal", "Optional", "Union")], ("from pydantic", "0", "pydantic", "BaseModel", "BaseModel"), ("from pydantic", "0", "pydantic", "Field", "Field"), ("from late", "0", "late", "thing", "thing")]

SQL = {
    "s13_python_tree": f"""WITH {_parsed}, c AS (SELECT *, k % 4 AS c, CASE k % 4 WHEN 0 THEN 'yes_no' WHEN 2 THEN 'one_of:' || p_brand || '|' || p_name ELSE '' END AS signals FROM p WHERE k % 31 <> 0)
      SELECT path, {_at('return OpenAI()')} AS line, 'openai' AS sdk, 'm' || k AS model, CASE WHEN k % 3 = 0 THEN 'likely' WHEN k % 7 = 0 THEN 'review' WHEN c IN (0, 2) THEN 'likely' WHEN p_size <= 16 THEN 'review' WHEN c = 1 THEN 'not_decision' ELSE 'review' END AS tier, signals, false AS dynamic, CAST(p_size AS BIGINT) AS max_tokens FROM c
      UNION ALL SELECT path, {_end}, 'openai', NULL, 'likely', 'rating:1:5', false, NULL FROM c WHERE k % 2 = 0""",
    "x20_functions": f"""WITH {_parsed}, f AS (SELECT path, k, p_size, n.* FROM p, {_rows([(_q(n), _q(s), str(_at(a)), str(_at(b) if b else _end), m) for n, s, a, b, m in [('ask', '', 'def ask', 'return OpenAI()', 'false'), ('inner', 'ask', 'def inner', 'return a', 'false'), ('run', 'Client', 'async def run', None, 'true')]])} n(name, scope, line, end_line, method))
      SELECT path, name, scope, CAST(line AS INTEGER) AS line, CAST(end_line AS INTEGER) AS end_line, method, CASE name WHEN 'ask' THEN 'text,*rest,limit=' || p_size || ',model=MODEL,**more' WHEN 'inner' THEN 'a,b=1' ELSE 'self,q' END AS params FROM f""",
    "x22_imports": f"""WITH {_parsed} SELECT path, CAST(line AS INTEGER) AS line, CAST(level AS INTEGER) AS level, CASE WHEN module = 'm*' THEN 'm' || (k % 10) ELSE module END AS module, name, local FROM p, {_rows([(str(_at(a)), lv, _q(m), _q(n), _q(lo)) for a, lv, m, n, lo in _imports])} i(line, level, module, name, local) WHERE module <> 'openai' OR k % 31 <> 0""",
    "x07_names": f"""WITH {_parsed} SELECT path, scope, name, CAST(line AS INTEGER) AS line, single, CASE name WHEN 'MODEL' THEN '"m' || k || '"' WHEN 'LIMITS' THEN '{{"a":null,"b":[1,' || p_size || ']}}' WHEN 'count' THEN CAST(p_size AS VARCHAR) END AS value
      FROM p, {_rows([(_q(s), _q(n), str(line), t) for s, n, line, t in [('', 'MODEL', _at('MODEL'), 'true'), ('', 'LIMITS', _at('LIMITS'), 'true'), ('', 'TWICE', _at('TWICE = 1'), 'false'), ('', 'TWICE', _at('TWICE = 2'), 'false'), ('', 'MADE', _at('MADE'), 'true'), ('ask', 'count', _at('count'), 'true')]])} n(scope, name, line, single)""",
    "x15_class_fields": f"""WITH {_parsed} SELECT path, class, field, kind, CASE field WHEN 'team' THEN p_brand || '|other' WHEN 'maybe' THEN p_brand || '|other' WHEN 'kind' THEN p_type || '|x' WHEN 'tags' THEN 'p' || p_size || '|q' WHEN 'stars' THEN '1|' || (k % 5 + 2) WHEN 'noted' THEN '0|1' ELSE '' END AS options, field IN ('kind', 'maybe') AS nullable
      FROM p, {_rows([(_q(c), _q(f), _q(x)) for c, f, x in [('Base', 'ok', 'yes_no'), ('Out', 'ok', 'yes_no'), ('Out', 'team', 'choice'), ('Out', 'kind', 'choice'), ('Out', 'maybe', 'choice'), ('Out', 'tags', 'labels'), ('Out', 'stars', 'score'), ('Out', 'noted', 'score'), ('Out', 'either', 'free'), ('Out', 'why', 'free')]])} f(class, field, kind)""",
    "x09_values_by_name": """WITH f AS (SELECT p_partkey AS k, p_partkey % 6 AS b, p_partkey // 6 % 6 AS w, p_partkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS j FROM part),
      s AS (SELECT *, CASE WHEN b = 5 THEN 'parameter' WHEN b = 2 OR w IN (2, 3) THEN 'several' WHEN b IN (1, 3) THEN 'unpacked' WHEN b = 0 THEN 'local' WHEN j % 3 = 0 THEN 'unknown' ELSE 'name' END AS state FROM f)
      SELECT 'f' || k || '.py' AS path, 'model' AS key, CASE state WHEN 'local' THEN '"m' || k || '"' WHEN 'name' THEN '"g' || j || '"' END AS value, state FROM s
      UNION ALL SELECT 'f' || k || '.py', 'input', '"' || k || '"', 'literal' FROM s""",
    "x16_inherited_fields": """WITH f AS (SELECT 'f' || p_partkey || '.py:' AS p, (p_partkey % (SELECT max(s_suppkey) FROM supplier) + 1) % 3 <> 0 AS held FROM part)
      SELECT p || 'Mid' AS class, 'why' AS field, 0 AS depth, 'Team' AS note FROM f UNION ALL SELECT p || 'Out', 'own', 0, 'bool' FROM f UNION ALL SELECT p || 'Out', 'why', 1, 'Team' FROM f
      UNION ALL SELECT p || 'Mid', 'ok', 1, 'bool' FROM f WHERE held UNION ALL SELECT p || 'Out', 'ok', 2, 'bool' FROM f WHERE held
      UNION ALL SELECT 'base' || s_suppkey || '.py:Root', unnest(['ok', 'why']), 0, unnest(['bool', 'str']) FROM supplier WHERE s_suppkey % 3 <> 0""",
    "s17_ignored_tree": """WITH f AS (SELECT p_partkey AS k, p_partkey % 9 AS d, p_partkey // 9 % 4 AS e, CASE WHEN p_partkey % 5 = 0 THEN 'txt' ELSE 'py' END AS x FROM part)
      SELECT 'd' || d || '/e' || e || '/f' || k || '.' || x AS rel FROM f
      WHERE d <> 3 AND NOT (d = 7 AND e = 0) AND CASE WHEN d = 1 AND e = 2 THEN x = 'py' AND k % 10 = 1 WHEN d = 5 THEN true WHEN d = 8 THEN x = 'py' AND k % 10 = 5 ELSE x = 'py' END""",
}
