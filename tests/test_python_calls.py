"""Calls in Python sources: every ending and key of the table."""

import pytest

from sparkgate.sources.python_calls import ENDINGS, EXAMPLES, INSTRUCTOR, LIMIT_KEYS, PROMPT_KEYS, calls_of, python_calls
from sparkgate.sources.python_symbols import imports


@pytest.mark.parametrize("sdk, ending", [(s, e) for s, endings in ENDINGS.items() for e in endings])
def test_every_ending_is_a_call(sdk, ending):
    assert [c[2] for c in calls_of("f", f"c.{ending}()\nc.other()\nc.threads.{ending}()\nc[0].threads.{ending}()\n", [sdk])] == [sdk]


def test_instructor_needs_its_model():
    for m in INSTRUCTOR:
        assert [c[2] for c in calls_of("f", f"c.x.{m}(response_model=A)\nc.x.{m}(a=1)\n", ["instructor"])] == ["instructor"]
        assert not calls_of("f", f"c.x.{m}(response_model=A)\n", ["litellm"])


def test_keys():
    call = lambda args: calls_of("f", f"c.responses.create({args})", ["openai"])[0]
    assert call(", ".join(f"{k}='{k}'" for k in reversed(PROMPT_KEYS)))[4] == "\n".join(PROMPT_KEYS)
    assert [call(f"{k}=7")[6] for k in LIMIT_KEYS] == [7] * 6
    assert [call(x)[9] for x in ("text=F", "output_config=F", "output_format=F", "response_format=None", "response_model=F", "**kw")] == [True, True, True, False, False, True]


def test_fixture(spark):
    got = sorted((r.path, r.line, r.sdk, r.model, r.tier, r.max_tokens) for r in python_calls(spark.createDataFrame(EXAMPLES, "path string, text string")).collect() if r.path.startswith("d/"))
    assert got == [
        ("d/chain.py", 5, "langchain", "m", "sure", None), ("d/chain.py", 6, "langchain", None, "sure", None),
        ("d/endings.py", 2, "openai", None, "not_decision", None), ("d/endings.py", 3, "openai", None, "not_decision", None), ("d/endings.py", 4, "openai", None, "not_decision", None), ("d/endings.py", 5, "openai", None, "not_decision", None),
        ("d/more.py", 3, "anthropic", None, "likely", None), ("d/more.py", 4, "anthropic", None, "likely", None), ("d/more.py", 5, "litellm", None, "review", 3),
        ("d/structured.py", 5, "instructor", None, "sure", None), ("d/structured.py", 6, "instructor", None, "sure", None), ("d/structured.py", 7, "instructor", None, "sure", None), ("d/structured.py", 8, "instructor", None, "review", None),
    ]


def test_nested_content_is_read_once():
    text = 'c.responses.create(messages=[{"role": "user", "content": [{"type": "text", "text": "Answer yes or no."}, {"type": "text", "text": f"of {x}"}]}])'
    (call,) = calls_of("f", text, ["openai"])
    assert call[4] == "Answer yes or no.\nof " and call[5]


def test_deep_sources_give_nothing_and_stop_nothing(spark):
    chained = "c" + ".x()" * 300_000 + "\n"
    deep = ["import openai\n" + "-" * 100_000 + "1\n", "import openai\n" + chained, "import openai\nx = " + "[" * 5000 + "]" * 5000 + "\n"]
    good = "import openai\nc" + ".x()" * 300 + "\nc.responses.create(input='a')\n"
    rows = [(f"f{k}", t) for k, t in enumerate([*deep, good])]
    frame = spark.createDataFrame(rows, "path string, text string")
    assert [r.line for r in python_calls(frame).collect()][-1:] in ([], [3])
    assert {r.path for r in imports(frame).collect()} <= {r[0] for r in rows}
