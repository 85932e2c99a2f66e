"""Model calls in Python sources: a gate by import, then one parse per file inside the tasks."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgate.functions.text import imported_packages, prompt_signals, tier
from sparkgate.sources.python_tree import uncollected

# Call path endings by package, in the order in which they are tried.
ENDINGS = {
    "openai": ["chat.completions.create", "chat.completions.parse", "chat.completions.stream", "responses.create", "responses.parse", "responses.stream", "ChatCompletion.create", "completions.create"],
    "anthropic": ["messages.create", "messages.parse", "messages.stream"],
    "litellm": ["completion", "acompletion"],
    "langchain": ["with_structured_output"],
}
#: Methods that are Instructor's when response_model is given.
INSTRUCTOR = ["create", "create_with_completion", "create_partial", "create_iterable"]
# Keywords of a call; the first that is there counts, and of prompts all.
PROMPT_KEYS = ["system", "instructions", "messages", "input", "prompt"]
LIMIT_KEYS = ["max_tokens", "max_completion_tokens", "max_output_tokens", "max_tokens_to_sample", "maxOutputTokens", "maxTokens"]
SCHEMA_KEYS = ["response_format", "text_format", "output_format", "output_config", "text"]
MODEL_KEYS = ["model", "model_name", "modelName"]
SCHEMA = "path string, line int, sdk string, model string, prompt string, dynamic boolean, max_tokens long, fields int, free_text int, unresolved boolean"

EXAMPLES = [
    ("a/yesno.py", 'import openai\nclient = openai.OpenAI()\nclient.chat.completions.create(model="m", messages=[{"role": "user", "content": "Answer yes or no."}])\n'),
    ("a/free.py", 'from openai import OpenAI\nOpenAI().responses.create(model="m", input="Write a poem")\n'),
    ("b/schema.py", 'import anthropic\nfrom enum import Enum\nfrom pydantic import BaseModel\nclass Team(Enum):\n    A = "a"\n    B = "b"\nclass Out(BaseModel):\n    team: Team\n    why: str\nc = anthropic.Anthropic()\nc.messages.create(model=MODEL, messages=[{"content": f"route {x}"}], response_format=Out)\n'),
    ("b/small.py", "import litellm\nlitellm.completion(model=m, max_tokens=4, messages=build())\n"),
    ("d/endings.py", "import openai\nc.chat.completions.stream(input='a')\nc.responses.stream(input='a')\nopenai.ChatCompletion.create(prompt='a')\nopenai.completions.create(prompt='a')\nc.beta.threads.messages.create(input='a')\n"),
    ("d/more.py", "import anthropic, litellm\nimport litellm\nc.messages.parse(system='Classify it.')\nc.messages.stream(system='a', messages=[{'content': 'Answer yes or no.'}])\nlitellm.acompletion(max_completion_tokens=3, **kw)\n"),
    ("d/chain.py", "from langchain_openai import ChatOpenAI\nfrom pydantic import BaseModel\nclass Out(BaseModel):\n    ok: bool\nChatOpenAI(model='m').with_structured_output(Out)\nx.with_structured_output(schema=Out)\n"),
    ("d/structured.py", "import instructor\nfrom enum import Enum\nclass Team(Enum):\n    A = 'a'\nc.create(response_model=Team)\nc.messages.create_with_completion(response_model=Team)\nc.create_partial(response_model=Team)\nc.create_iterable(response_model=Far)\nc.create(x=1)\n"),
    ("c/none.py", "import os\nos.system('x')\n"),
    ("c/broken.py", "import openai\ndef (:\n"),
]


def _path(node: ast.expr) -> str:
    parts = []
    while True:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        else:
            return ".".join(reversed(parts + ([node.id] if isinstance(node, ast.Name) else [])))


def _text(node: ast.AST) -> tuple[str, bool]:
    """Static text below a node, and whether some of it is made at run time."""
    out, dynamic = [], False
    todo: list[ast.AST] = [node]
    while todo:
        x = todo.pop()
        below = list(ast.iter_child_nodes(x))
        if isinstance(x, ast.Dict):
            held = [v for k, v in zip(x.keys, x.values) if isinstance(k, ast.Constant) and k.value in ("content", "text")]
            for v in held:
                t, d = _text(v)
                out.append(t)
                dynamic |= d
            below = [v for v in below if v not in held]  # what was read is not read again
        elif isinstance(x, ast.JoinedStr) and not out:
            out += [v.value for v in x.values if isinstance(v, ast.Constant)]
            dynamic |= any(isinstance(v, ast.FormattedValue) for v in x.values)
        elif isinstance(x, (ast.Call, ast.Name)):
            dynamic = True
        todo += reversed(below)
    if not out and isinstance(node, ast.Constant) and isinstance(node.value, str):
        out.append(node.value)
    return "\n".join(out), dynamic


def _closed(note: ast.expr, classes: dict[str, ast.ClassDef]) -> bool | None:
    """Does an annotation have a closed set of answers? None: it is free text."""
    if isinstance(note, ast.Name):
        if note.id in classes:
            return any(_path(b).endswith("Enum") for b in classes[note.id].bases) or None
        return True if note.id == "bool" else None
    if isinstance(note, ast.Subscript) and _path(note.value).endswith("Literal"):
        return True
    return None


def _sdk(name: str, named: dict[str, ast.expr], sdks: list[str]) -> str | None:
    if "instructor" in sdks and "response_model" in named and name.rpartition(".")[2] in INSTRUCTOR:
        return "instructor"
    return next((s for s, endings in ENDINGS.items() if s in sdks and any(name == e or name.endswith("." + e) for e in endings)), None)


def _first(named: dict[str, ast.expr], keys: list[str]) -> ast.expr | None:
    return next((named[k] for k in keys if k in named), None)


def _model(named: dict[str, ast.expr]) -> str | None:
    model = _first(named, MODEL_KEYS)
    return model.value if isinstance(model, ast.Constant) and isinstance(model.value, str) else None


def _named(call: ast.Call) -> dict[str, ast.expr]:
    return {k.arg: k.value for k in call.keywords if k.arg}


def calls_of(path: str, text: str, sdks: list[str]) -> list[tuple]:
    """The calls of a file; none if it doesn't parse or is nested deeper than Python goes."""
    try:
        return list(_calls(path, ast.parse(text), sdks))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


def _calls(path: str, tree: ast.Module, sdks: list[str]) -> Iterator[tuple]:
    classes = {x.name: x for x in ast.walk(tree) if isinstance(x, ast.ClassDef)}
    for call in sorted((x for x in ast.walk(tree) if isinstance(x, ast.Call)), key=lambda c: (c.lineno, c.col_offset)):
        args = _named(call)
        sdk = _sdk(_path(call.func), args, sdks)
        if sdk is None or ".threads." in ast.unparse(call.func):
            continue
        texts = [_text(args[k]) for k in PROMPT_KEYS if k in args] or [("", True)]
        prompt, dynamic = "\n".join(t for t, _ in texts if t.strip()), any(d for _, d in texts)
        limit = _first(args, LIMIT_KEYS)
        limit = limit.value if isinstance(limit, ast.Constant) and type(limit.value) is int and limit.value >= 0 else None
        if sdk == "instructor":
            form = args["response_model"]
        elif sdk == "langchain":
            form = next((x for x in call.args if not isinstance(x, ast.Starred)), args.get("schema"))
        else:
            form = _first(args, SCHEMA_KEYS)
            form = None if isinstance(form, ast.Constant) and form.value is None else form
        forwarded = any(isinstance(x, ast.Starred) for x in call.args) or any(k.arg is None for k in call.keywords)
        fields = free = None
        if isinstance(form, ast.Name) and form.id in classes:
            # An enumeration is one closed field of its own.
            kinds = [True] if _closed(form, classes) else [_closed(x.annotation, classes) for x in classes[form.id].body if isinstance(x, ast.AnnAssign)]
            fields, free = kinds.count(True), kinds.count(None)
        model = _model(args)
        if model is None and isinstance(call.func, ast.Attribute) and isinstance(call.func.value, ast.Call):
            model = _model(_named(call.func.value))
        yield path, call.lineno, sdk, model, prompt, dynamic, limit, fields, free, (form is not None or forwarded) and fields is None


def python_calls(files: DataFrame) -> DataFrame:
    """One row per call in files (path, text), with signals and tier. Files that import none of the packages, and those that don't parse, give no row; the gate runs before Python."""
    gated = files.select("path", "text", imported_packages(F.col("text")).alias("sdks")).where(F.size("sdks") > 0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for frame in frames:
            with uncollected():
                rows = [r for p, t, s in zip(frame["path"], frame["text"], frame["sdks"]) for r in calls_of(p, t, list(s))]
            yield pd.DataFrame(rows, columns=names).astype({"max_tokens": "Int64", "fields": "Int32", "free_text": "Int32"})

    calls = gated.mapInPandas(run, SCHEMA)
    signals = prompt_signals(F.col("prompt"))
    kind = tier(F.col("fields"), F.col("free_text"), F.col("unresolved"), signals, F.col("prompt"), F.col("max_tokens"))
    return calls.select("path", "line", "sdk", "model", kind.alias("tier"), F.array_join(signals, ";").alias("signals"), "dynamic", "max_tokens")
