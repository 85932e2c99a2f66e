"""Python sources as a table of numbered tree nodes: one parse per file, everything else is joins."""

from __future__ import annotations

import ast
import gc
import json
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "path string, node int, last int, parent int, kind string, field string, at int, name string, extra string, value string, line int, end_line int"
KINDS = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
#: The attribute of a node that is its name, and a second one.
NAME = {"Name": "id", "Attribute": "attr", "arg": "arg", "keyword": "arg", "FunctionDef": "name", "AsyncFunctionDef": "name", "ClassDef": "name", "alias": "name", "ImportFrom": "module", "ExceptHandler": "name"}
EXTRA = {"alias": "asname", "ImportFrom": "level", "Name": "ctx"}
LITERAL = (ast.Constant, ast.List, ast.Tuple, ast.Dict, ast.Set, ast.UnaryOp)


@contextmanager
def uncollected() -> Iterator[None]:
    """Within it, the garbage collector rests: trees hold no cycles, and it would look through the one at hand again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _literal(node: ast.expr) -> str | None:
    try:
        return json.dumps(ast.literal_eval(node), sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":"))
    except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
        return None


def rows_of(path: str, text: str, only: dict[str, list[str]] | None = None) -> list[list]:
    """The nodes of a file in order; none if it doesn't parse. only: see nodes()."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[list] = []
    todo: list = [(tree, None, None, None, False, only is None)]
    number = 0
    while todo:
        node, parent, field, at, within, kept = todo.pop()
        if node is None:  # all below a row's node is numbered
            parent[2] = number - 1
            continue
        kind = type(node).__name__
        row, value = None, None
        if kept or (only is not None and kind in only):
            extra = getattr(node, EXTRA[kind], None) if kind in EXTRA else None
            extra = type(extra).__name__ if kind == "Name" else None if extra is None else str(extra)
            value = None if within or not isinstance(node, LITERAL) else _literal(node)
            row = [path, number, number, parent, kind, field, at, getattr(node, NAME[kind], None) if kind in NAME else None, extra, value, getattr(node, "lineno", None), getattr(node, "end_lineno", None)]
            out.append(row)
        own, number = number, number + 1
        if only is not None and isinstance(node, ast.expr):
            continue
        below = []
        wanted = () if only is None else only.get(kind, ())
        for name in node._fields:
            held = getattr(node, name, None)
            keeps = only is None or name in wanted
            if isinstance(held, list):
                below += [(x, own, name, k, within or value is not None, keeps) for k, x in enumerate(held) if isinstance(x, ast.AST)]
            elif isinstance(held, ast.AST) and not isinstance(held, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)):
                below.append((held, own, name, None, within or value is not None, keeps))
        if below:
            if row is not None:
                todo.append((None, row, None, None, False, False))
            todo += reversed(below)
    return out


def nodes(files: DataFrame, partitions: int | None = None, only: dict[str, list[str]] | None = None) -> DataFrame:
    """The nodes of files (path, text), numbered in each file in the order of the source tree.

    The nodes below a node are those numbered node + 1 to last. kind is the kind of syntax, field and at the place in the parent, name and extra what the node itself
    says (an import's local name and level, whether a name is stored), value a literal as JSON with sorted members. Files that don't parse, and null texts, give no row; a file gives all its rows or none. Files are
    dealt out by path before they are parsed, as a few large blocks of input may hold them all.

    only: the kinds of nodes that are wanted, each with the fields of its children that are wanted too; nothing below an expression is then looked at, and numbers count what is. None: all nodes.
    """
    n = partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(KINDS)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], names=[x.split()[0] for x in NODES.split(", ")])

        for batch in batches:
            held: list[list] = []
            for path, text in zip(batch.column(0), batch.column(1)):
                with uncollected():
                    held += rows_of(path.as_py(), text.as_py() or "", only)
                if len(held) > 50_000:
                    yield out(held)
                    held = []
            yield out(held)

    return files.select("path", "text").repartition(n, F.xxhash64("path")).mapInArrow(run, NODES)
