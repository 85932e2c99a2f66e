import pytest

from sparkgate.operators import trees
from sparkgate.sources import python_tree

TEXT = '''import os, json as js
from . import a
@wrap(lambda z=1: z)
def ask(x, /, y=2, *r, k, l=lambda w: w, m="s", **q):
    from late import b as c
    def inner(p=(1, 2)):
        n = {"b": [1, q], "a": 1}
        n: int = 3
        return n
    try:
        u = -1
    except E as e:
        u += 1
    match x:
        case [1, v]:
            t, s = 1, 2
class C(B):
    f: int = 1
    async def run(self, d=[x for x in y]):
        with o as g:
            h = i = "x"
'''


@pytest.mark.parametrize("read, only", [(trees.imports, trees.IMPORT_NODES), (trees.names, trees.NAME_NODES), (trees.functions, trees.FUNCTION_NODES)])
def test_the_nodes_that_a_table_needs_are_enough(spark, read, only):
    files = spark.createDataFrame([("a.py", TEXT), ("b.py", "def (:"), ("c.py", None), ("d.py", "import x\nx = 1\ndef f(): pass\n")], "path string, text string")
    some, every = python_tree.nodes(files, 2, only), python_tree.nodes(files, 2)
    assert some.count() < every.count() / 3
    found = sorted(map(str, read(some).collect()))
    assert found and found == sorted(map(str, read(every).collect()))


@pytest.mark.parametrize("only", [None, trees.FUNCTION_NODES])
def test_functions_send_no_table_to_the_driver(spark, only):
    """Nodes pack so well that Spark takes large tables of them for small ones; none is broadcast, and parameters come in order."""
    text = "def f(a, b=1, /, c=2, d=g(), *e, h, i=x, j='s', **k): pass\ndef n(*, a=1): pass\ndef o(): pass\nasync def p(a, /, b, c=d): pass\n"
    nodes = trees.materialize(python_tree.nodes(spark.createDataFrame([("a.py", text)], "path string, text string"), 2, only), "nodes")
    found = trees.functions(nodes)
    params = {r.name: r.params for r in found.collect()}
    assert params == {"f": 'a,b=1,c=2,d=...,*e,h,i=x,j="s",**k', "n": "a=1", "o": "", "p": "a,b,c=d"}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_the_collector_rests_while_files_are_parsed():
    import gc

    with python_tree.uncollected():
        assert not gc.isenabled()
    assert gc.isenabled()
