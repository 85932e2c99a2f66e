"""What Python sources define, as tables: functions, imports, names with literal values, and fields of classes as answer spaces. One parse per file in the tasks."""

from __future__ import annotations

import ast
import json
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from sparkgate.sources.python_tree import uncollected

FUNCTIONS = "path string, name string, scope string, line int, end_line int, method boolean, params string"
IMPORTS = "path string, line int, level int, module string, name string, local string"
NAMES = "path string, scope string, name string, line int, single boolean, value string"
FIELDS = "path string, class string, field string, kind string, options string, nullable boolean"


def _scoped(tree: ast.Module) -> Iterator[tuple[ast.AST, str, bool]]:
    """(node, name of the scope it is in, is that scope a class?) for every statement."""
    todo: list[tuple[ast.AST, str, bool]] = [(x, "", False) for x in tree.body]
    while todo:
        node, scope, in_class = todo.pop()
        yield node, scope, in_class
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            name = f"{scope}.{node.name}" if scope else node.name
            todo += [(x, name, isinstance(node, ast.ClassDef)) for x in node.body]
        else:
            todo += [(x, scope, in_class) for x in ast.iter_child_nodes(node) if isinstance(x, (ast.stmt, ast.ExceptHandler, ast.match_case))]


def _functions(path: str, tree: ast.Module) -> Iterator[tuple]:
    for node, scope, in_class in _scoped(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            plain = [*a.posonlyargs, *a.args]
            given = [None] * (len(plain) - len(a.defaults)) + a.defaults
            slots = [x.arg + (f"={ast.unparse(d)}" if d else "") for x, d in zip(plain, given)] + ([f"*{a.vararg.arg}"] if a.vararg else [])
            slots += [x.arg + (f"={ast.unparse(d)}" if d else "") for x, d in zip(a.kwonlyargs, a.kw_defaults)] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
            yield path, node.name, scope, node.lineno, node.end_lineno, in_class, ",".join(slots)


def _imports(path: str, tree: ast.Module) -> Iterator[tuple]:
    for node, _, _ in _scoped(tree):
        if isinstance(node, ast.Import):
            for x in node.names:
                yield path, node.lineno, 0, x.name, None, x.asname or x.name
        elif isinstance(node, ast.ImportFrom):
            for x in node.names:
                yield path, node.lineno, node.level, node.module or "", x.name, x.asname or x.name


def _literal(node: ast.expr | None) -> str | None:
    """A literal as JSON with sorted members; null for what is made at run time or has no JSON."""
    try:
        return json.dumps(ast.literal_eval(node), sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":"))
    except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
        return None


def _names(path: str, tree: ast.Module) -> Iterator[tuple]:
    found = []
    for node, scope, in_class in _scoped(tree):
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, (ast.AnnAssign, ast.AugAssign)) else []
        value = None if isinstance(node, ast.AugAssign) else getattr(node, "value", None)
        found += [(scope, t.id, node.lineno, value) for t in targets if isinstance(t, ast.Name) and not in_class]
    times = Counter((scope, name) for scope, name, _, _ in found)
    for scope, name, line, value in sorted(found, key=lambda x: (x[0], x[1], x[2])):
        single = times[scope, name] == 1
        yield path, scope, name, line, single, _literal(value) if single and value is not None else None


Space = tuple[str, list[str], bool]


def _space(note: ast.expr, value: ast.expr | None, enums: dict[str, list[str]]) -> Space:
    """(kind, options, nullable) of an annotation: choice, yes_no, labels, score or free; a quoted annotation is read too."""
    last = lambda x: ast.unparse(x).rpartition(".")[2]
    if isinstance(note, ast.Constant) and isinstance(note.value, str):
        try:
            return _space(ast.parse(note.value, mode="eval").body, value, enums)
        except SyntaxError:
            return "free", [], False
    if isinstance(note, ast.BinOp) and isinstance(note.op, ast.BitOr):
        sides = [x for x in (note.left, note.right) if not (isinstance(x, ast.Constant) and x.value is None)]
        if len(sides) == 1:
            kind, options, nullable = _space(sides[0], value, enums)
            return kind, options, nullable or kind == "choice"
        return "free", [], False
    if isinstance(note, ast.Subscript):
        name, inner = last(note.value), note.slice
        items = inner.elts if isinstance(inner, ast.Tuple) else [inner]
        if name == "Annotated":
            return _space(items[0], next((x for x in items[1:] if isinstance(x, ast.Call)), value), enums)
        if name == "Optional":
            kind, options, nullable = _space(inner, value, enums)
            return kind, options, nullable or kind == "choice"
        if name == "Union":
            sides = [x for x in items if not (isinstance(x, ast.Constant) and x.value is None)]
            if len(sides) == 1 < len(items):
                kind, options, nullable = _space(sides[0], value, enums)
                return kind, options, nullable or kind == "choice"
            return "free", [], False
        if name == "Literal":
            texts = [x.value for x in items if isinstance(x, ast.Constant) and isinstance(x.value, str)]
            null = any(isinstance(x, ast.Constant) and x.value is None for x in items)
            return ("choice", texts, null) if len(texts) >= 2 else ("free", [], False)
        if name.lower() in ("list", "set", "sequence", "tuple"):
            kind, options, _ = _space(items[0], None, enums)
            return ("labels", options, False) if kind == "choice" else ("free", [], False)
        return "free", [], False
    name = last(note)
    if name in enums:
        return ("choice", enums[name], False) if len(enums[name]) >= 2 else ("free", [], False)
    if name == "bool":
        return "yes_no", [], False
    if name in ("int", "float") and isinstance(value, ast.Call):
        bounds = {k.arg: k.value for k in value.keywords}
        if all(isinstance(bounds.get(k), ast.Constant) and isinstance(bounds[k].value, (int, float)) for k in ("ge", "le")) and bounds["ge"].value < bounds["le"].value:
            return "score", [str(bounds["ge"].value), str(bounds["le"].value)], False
    return "free", [], False


def _fields(path: str, tree: ast.Module) -> Iterator[tuple]:
    classes = {x.name: x for x, _, _ in _scoped(tree) if isinstance(x, ast.ClassDef)}
    enums = {n: [a.value.value for a in c.body if isinstance(a, ast.Assign) and isinstance(a.value, ast.Constant) and isinstance(a.value.value, str)] for n, c in classes.items() if any(ast.unparse(b).endswith("Enum") for b in c.bases)}

    def own(c: ast.ClassDef, seen: frozenset[str]) -> dict[str, ast.AnnAssign]:
        """Annotated fields, those of bases in the same file first."""
        out: dict[str, ast.AnnAssign] = {}
        for b in c.bases:
            base = classes.get(ast.unparse(b))
            if base is not None and base.name not in seen:
                out |= own(base, seen | {base.name})
        return out | {a.target.id: a for a in c.body if isinstance(a, ast.AnnAssign) and isinstance(a.target, ast.Name)}

    for name, c in sorted(classes.items()):
        if name not in enums:
            for field, a in own(c, frozenset({name})).items():
                kind, options, nullable = _space(a.annotation, a.value, enums)
                yield path, name, field, kind, "|".join(options), nullable


def _table(files: DataFrame, schema: str, rows: Callable[[str, ast.Module], Iterator[tuple]]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for frame in frames:
            out = []
            for path, text in zip(frame["path"], frame["text"]):
                try:
                    with uncollected():
                        out += list(rows(path, ast.parse(text or "")))  # a file gives all its rows or none
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "text").mapInPandas(run, schema)


def functions(files: DataFrame) -> DataFrame:
    """Functions of files (path, text): name, scope (names of the functions and classes around it), lines, whether it is a method, and its parameters with defaults. Files that don't parse have none."""
    return _table(files, FUNCTIONS, _functions)


def imports(files: DataFrame) -> DataFrame:
    """Imports: level and module, the name taken from it (null: the module itself) and the local name."""
    return _table(files, IMPORTS, _imports)


def names(files: DataFrame) -> DataFrame:
    """Assignments to names outside classes; the value is JSON where the name is assigned once in its scope, and to a literal."""
    return _table(files, NAMES, _names)


def fields(files: DataFrame) -> DataFrame:
    """Annotated fields of classes that are no enumerations, with those of bases in the same file, as answer spaces."""
    return _table(files, FIELDS, _fields)
