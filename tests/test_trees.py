"""Names in numbered trees against the Python parser's own trees, walked one after the other."""

import ast
import random

from sparkgate.operators import trees
from sparkgate.sources import python_symbols
from sparkgate.sources.python_tree import nodes, rows_of


def tree(spark, sources: dict):
    return nodes(spark.createDataFrame(list(sources.items()), "path string, text string"), 3)


def test_nodes_are_numbered_like_the_tree(spark):
    text = "import a as b\n@d(1)\ndef f(x, *, y=[1, -2]):\n    if x:\n        return {'k': (1, None)}\n    z: int = g(x.q)\nclass C(B): pass\n"
    rows = rows_of("p", text)
    assert [r[1] for r in rows] == list(range(len(rows))) and rows[0][2] == len(rows) - 1
    for _, node, last, parent, *_ in rows[1:]:
        assert rows[parent][1] < node <= rows[parent][2] and last <= rows[parent][2]
    kinds = [r[4] for r in rows]
    want = [type(x).__name__ for x in ast.walk(ast.parse(text)) if not isinstance(x, (ast.expr_context, ast.unaryop))]
    assert sorted(kinds) == sorted(want)
    by = lambda kind, **k: [r for r in rows if r[4] == kind and all(r[{"field": 5, "name": 7}[a]] == b for a, b in k.items())]
    assert by("alias")[0][7:9] == ["a", "b"] and by("Dict")[0][9] == '{"k":[1,null]}' and by("List")[0][9] == "[1,-2]" and by("Name", name="z")[0][8] == "Store"
    assert all(r[9] is None for r in by("Tuple")), "below a literal nothing is said again"


def test_files_that_do_not_parse(spark):
    got = tree(spark, {"a": "def (:", "b": "x = 1", "c": None, "d": "-" * 100_000 + "1", "e": "c" + ".x()" * 20_000})
    paths = {r.path for r in got.select("path").distinct().collect()}
    assert "b" in paths and not paths & {"a", "d"}


def plain_values(text: str) -> dict:
    """{(line, column of the use): (state, line of the value)} of all names read, by walking functions and control statements."""
    module = ast.parse(text)
    parent = {c: p for p in ast.walk(module) for c in ast.iter_child_nodes(p)}

    def chain(n):
        while n in parent:
            n = parent[n]
            yield n

    functions = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
    control = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.ExceptHandler, ast.match_case)

    def owner(n):
        child = n
        for p in chain(n):
            if isinstance(p, functions) and not (hasattr(p, "decorator_list") and child in p.decorator_list):
                yield p
            child = p

    def part(place, function):
        """The (statement, field, handler) that place is in, innermost."""
        child = place
        for p in chain(place):
            if p is function:
                return None
            if isinstance(p, control):
                field = next(f for f, v in ast.iter_fields(p) if v is child or (isinstance(v, list) and child in v))
                return p, field, child if field == "handlers" else None
            child = p

    def in_part(n, where):
        p, field, handler = where
        below = [n, *chain(n)]
        held = getattr(p, field)
        return any(x in below for x in ([handler] if handler else held if isinstance(held, list) else [held]))

    definitions = {}
    for s in ast.walk(module):
        if not isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.For, ast.AsyncFor)):
            continue
        function = next(owner(s), None)
        for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
            whole = isinstance(t, ast.Name)
            for n in [t] if whole else [x for x in ast.walk(t) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)]:
                value = s.value if whole and isinstance(s, (ast.Assign, ast.AnnAssign)) else None
                definitions.setdefault((function, n.id), []).append((value, part(s, function) if function else None, not isinstance(s, ast.AugAssign)))
    out = {}
    for u in ast.walk(module):
        if not (isinstance(u, ast.Name) and isinstance(u.ctx, ast.Load)):
            continue
        state, value = "free", None
        for f in owner(u):
            own = definitions.get((f, u.id), [])
            a = f.args
            names = {x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg] if x}
            if any(d for *_, d in own):
                reaches = own[0][1] is None or in_part(u, own[0][1])
                state = "several" if len(own) > 1 or not reaches else "unpacked" if own[0][0] is None else "value"
                value = own[0][0].lineno if state == "value" else None
            elif u.id in names:
                state = "parameter"
            else:
                continue
            break
        out[u.lineno, u.col_offset, u.id] = (state, value)
    return out


PATHS = """
a = 1
@deco(a)
def f(p, q=a, *rest, key=None, **more):
    x = 1
    use(x, p, a)
    if p:
        y = 2
        use(y)
        while y:
            use(y, x)
    else:
        use(y)
    use(y)
    for i, (j, k) in rest:
        use(i, j, k)
        z = i
    use(z, i)
    try:
        t = 1
        use(t)
    except E as e:
        use(t)
        u = 3
    except (A, B):
        use(u)
    finally:
        use(t, u)
    with open(q) as w:
        v = w
    use(v, w)
    n = 0
    n += 1
    use(n)
    m += 1
    use(m)
    s: int = 5
    o: int
    use(s, o)
    c = d = x
    use(c, d)
    match p:
        case 1:
            g = 1
            use(g)
        case _:
            use(g)
    if q:
        return use(x)
    elif key:
        h = 7
        use(h)
    else:
        h = 8
    use(h)
    async def inner(x2, p):
        use(x, p, x2, y, a)
        x2 = 3
        use(x2)
        async for b in x2:
            use(b)
    run(lambda p, l=x: use(p, l, x, y))
    [x for x in p]
    obj.attr = x
    use(obj)
class K:
    fld = 1
    def m(self):
        use(self, fld)
"""


def seen(spark, sources: dict) -> dict:
    table = trees.materialize(tree(spark, sources), "nodes")
    uses = table.where("kind = 'Name' and extra = 'Load'").select("path", "node", "name")
    found = trees.local_values(table, uses)
    lines = {(r.path, r.node): r.line for r in table.collect()}
    out: dict = {}
    for r in found.collect():
        out.setdefault(r.path, []).append((r.node, r.state, lines.get((r.path, r.value))))
    return {p: [x[1:] for x in sorted(v)] for p, v in out.items()}


def in_order(text: str) -> list:
    """The plain version's answers in the order of the tree's nodes."""
    known = plain_values(text)
    order: list = []
    todo = [ast.parse(text)]
    while todo:
        n = todo.pop()
        if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
            order.append(known[n.lineno, n.col_offset, n.id])
        todo += reversed(list(ast.iter_child_nodes(n)))
    return order


def drawn(seed: int) -> str:
    """A function of nested control statements that bind and use few names."""
    rng = random.Random(seed)
    lines: list = []

    def block(indent: str, depth: int) -> None:
        for _ in range(rng.randrange(1, 4)):
            n = rng.choice("abcd")
            kind = rng.randrange(9 if depth else 4)
            if kind < 2:
                lines.append(f"{indent}use({n}, {rng.choice('abcd')})")
            elif kind == 2:
                lines.append(f"{indent}{n} = {rng.randrange(9)}")
            elif kind == 3:
                lines.append(indent + rng.choice([f"{n} += 1", f"{n}, x = y", f"{n}: int = 2", f"with w: {n} = 1"]))
            else:
                head = rng.choice([f"if {n}:", f"while {n}:", f"for {n} in z:", "try:", f"def g{len(lines)}({n}):", "match q:"])
                lines.append(indent + head)
                if head == "match q:":
                    lines.append(f"{indent}  case 1:")
                    block(indent + "    ", depth - 1)
                    continue
                block(indent + "  ", depth - 1)
                if head == "try:":
                    lines.append(f"{indent}except E:")
                    block(indent + "  ", depth - 1)
                elif head[0] == "i" and rng.random() < 0.5:
                    lines.append(f"{indent}else:")
                    block(indent + "  ", depth - 1)

    lines.append("def f(d):")
    block("  ", 3)
    return "\n".join(lines) + "\n"


def test_values_on_all_paths_like_a_walk(spark):
    sources = {"paths": PATHS} | {f"drawn{k}": drawn(k) for k in range(60)}
    got = seen(spark, sources)
    for path, text in sources.items():
        assert got.get(path, []) == in_order(text), text
    states = {s for own in got.values() for s, _ in own}
    assert states == {"value", "several", "unpacked", "parameter", "free"}


def test_chains_are_followed_and_cycles_end(spark):
    rng = random.Random(2)
    links = {f"a{k}": f"a{k + 1}" for k in range(70)} | {"c0": "c1", "c1": "c2", "c2": "c0", "into": "c1", "self": "self"}
    links |= {f"r{k}": f"r{rng.randrange(120)}" for k in range(80)}
    want = {}
    for key in links:
        at, seen_keys = key, set()
        while at in links and at not in seen_keys:
            seen_keys.add(at)
            at = links[at]
        want[key] = None if at in links else at
    got = {r.key: r.end for r in trees.followed(spark.createDataFrame(list(links.items()), "key string, next string")).collect()}
    assert got == want and got["a0"] == "a70" and got["into"] is None
    assert trees.followed(spark.createDataFrame([], "key string, next string")).count() == 0


def test_fields_are_inherited_by_depth(spark):
    fields = [("A", "x", 1), ("A", "y", 2), ("B", "x", 3), ("C", "y", 4), ("D", "z", 5), ("L1", "p", 6), ("L2", "q", 7), ("S", "s", 8)]
    bases = [("B", 0, "A"), ("D", 0, "B"), ("D", 1, "C"), ("L1", 0, "L2"), ("L2", 0, "L1"), ("E", 0, "D"), ("S", 0, "S"), ("M", 0, "Gone")]
    got = {(r["class"], r.field): (r.depth, r.note) for r in trees.inherited(spark.createDataFrame(fields, "class string, field string, note int"), spark.createDataFrame(bases, "class string, at int, base string"), ["note"]).collect()}
    assert got[("D", "x")] == (1, 3) and got[("D", "y")] == (1, 4) and got[("E", "x")] == (2, 3) and got[("B", "y")] == (1, 2) and got[("L1", "q")] == (1, 7) and got[("S", "s")] == (0, 8)
    assert len(got) == 2 + 2 + 1 + 3 + 3 + 2 + 2 + 1


def test_names_two_files_away_and_cycles(spark):
    sources = {
        "a.py": "from b import Base as B, MODEL\nfrom loop1 import X\nclass Out(B):\n    own: Team\ndef f(m):\n    k = MODEL\n    run(model=k, model_name=X)\n    run(model=m, modelName='lit')\n    run(model=f(1), input=LATE)\n",
        "b.py": "from c import Base, NAME\nMODEL = NAME\n", "c.py": "class Base:\n    ok: bool\n    own: str\nNAME = 'gpt'\n", "loop1.py": "from loop2 import X\n", "loop2.py": "from loop1 import X\n",
    }
    table = trees.materialize(tree(spark, sources), "nodes")
    targets = table.where("kind = 'ImportFrom'").selectExpr("path", "node as import", "concat(name, '.py') as target")
    ends = trees.materialize(trees.followed(trees.module_links(table, targets)), "ends")
    assert {r.key: r.end for r in ends.collect()} == {"a.py:B": "c.py:Base", "a.py:MODEL": "c.py:NAME", "a.py:X": None, "b.py:Base": "c.py:Base", "b.py:NAME": "c.py:NAME", "b.py:MODEL": "c.py:NAME", "loop1.py:X": None, "loop2.py:X": None}
    bases = trees.class_bases(table, ends)
    fields = {(r["class"], r.field): (r.depth, r.note) for r in trees.inherited(trees.annotated_fields(table), bases, ["note"]).collect()}
    assert fields == {("c.py:Base", "ok"): (0, "bool"), ("c.py:Base", "own"): (0, "str"), ("a.py:Out", "ok"): (1, "bool"), ("a.py:Out", "own"): (0, "Team")}
    found = trees.keyword_values(table, ["model", "model_name", "modelName", "input"], ends, trees.module_values(table)).collect()
    assert sorted(((r.key, r.value, r.state) for r in found), key=str) == sorted([("model", '"gpt"', "name"), ("model_name", None, "unknown"), ("model", None, "parameter"), ("modelName", '"lit"', "literal"), ("model", None, "made"), ("input", None, "unknown")], key=str)


def test_definitions_like_the_parser(spark):
    """Functions, imports and names by joins give what a walk of each file gives."""
    sources = {"p": PATHS, "q": "import a.b as c, d\nfrom ..e import f as g, h\nX = {'b': [1], 'a': None}\nX = 2\nclass C:\n  Y = 1\n  def m(self, *, k=1, j, n=X, s='t'):\n    Z: int = 3\n    def i(a, b=g(), /, c=2, *d, **e): W = 4\n  async def o(self): pass\n"} | {f"drawn{k}": drawn(k) for k in range(20)}
    files = spark.createDataFrame(list(sources.items()), "path string, text string")
    table = trees.materialize(tree(spark, sources), "nodes")
    for by_joins, by_walk in ((trees.imports, python_symbols.imports), (trees.names, python_symbols.names)):
        walked = by_walk(files)
        key = lambda rows: sorted((tuple(r) for r in rows), key=str)
        assert key(by_joins(table).select(*walked.columns).collect()) == key(walked.collect())
    got = {(r.path, r.name, r.scope): r for r in trees.functions(table).collect()}
    walked = python_symbols.functions(files).collect()
    assert len(walked) == len(got) and all((got[r.path, r.name, r.scope].line, got[r.path, r.name, r.scope].method) == (r.line, r.method) for r in walked if not r.path.startswith("drawn"))
    assert got["q", "m", "C"].params == "self,k=1,j,n=X,s=\"t\"" and got["q", "i", "C.m"].params == "a,b=...,c=2,*d,**e" and got["q", "o", "C"].params == "self"
