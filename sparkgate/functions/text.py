"""Text functions: prompt signals, import gate, whole-word filter, redaction, byte entropy, canonical JSON."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import lru_cache
from json.encoder import encode_basestring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Decision phrases, each with its signal, in the order in which signals are listed. (?U) makes classes Unicode-aware.
YES_NO = r"(?iU)\b(?:yes|no)\s*(?:or|/)\s*(?:no|yes)\b"
TRUE_FALSE = r"(?iU)\b(?:true|false)\s*(?:or|/)\s*(?:false|true)\b"
ONE_OF = r"(?iU)\b(?:exactly one of|one of|choose from|pick from)\b\s*(?:the following)?\s*[:\-]?\s*(.+)"
CLASSIFY = r"(?iU)\b(?:classify|categori[sz]e)\b"
RATE = r"(?iU)\b(?:rate|score|rating|scale)\b[^.\n]{0,60}?\b(\d{1,3})\s*(?:-|–|to)\s*(\d{1,3})\b"
ONE_WORD = r"(?iU)\b(?:one|single)[ -]word\b|\bonly (?:the )?(?:label|category)\b"

# Packages whose import marks a file.
PYTHON_PACKAGES = {"anthropic": "anthropic", "instructor": "instructor", "langchain": r"langchain(?:_\w+)?", "litellm": "litellm", "openai": "openai"}
TS_PACKAGES = {"openai": r"openai(?:/[^'\"]*)?", "anthropic": r"@anthropic-ai/sdk(?:/[^'\"]*)?", "ai_sdk": "ai", "langchain": r"@langchain/[^'\"]+|langchain(?:/[^'\"]*)?"}

# The mark, and secret shapes in the order in which they are replaced.
REDACTED = "<redacted>"
KEY_BLOCK = r"(?s)-----BEGIN [A-Z0-9 ]*KEY-----.*?(?:-----END [A-Z0-9 ]*KEY-----|\z)"
KEY_BEGIN, KEY_END = r"-----BEGIN [A-Z0-9 ]*KEY-----", r"-----END [A-Z0-9 ]*KEY-----"
BEARER = r"(?i)\b(bearer\s+)[A-Za-z0-9._~+/=-]{8,}"
QUOTED_SECRET = r"""(?i)((?:authorization|api[_-]?key|x-api-key|secret(?:[_-]?key)?|access[_-]?token|auth[_-]?token|password)["']?\s*[:=]\s*)(["'`])([^"'`\n]+)(["'`])"""
BARE_API_KEY = r"(?i)((?:api[_-]?key|x-api-key)\s*[:=]\s*)([A-Za-z0-9_\-]{12,})\b"
GENERIC_SECRET_ASSIGN = r"""(?i)(\b[A-Za-z_][A-Za-z0-9_]*(?:key|token|secret|password))(\s*[:=]\s*)(?:(["'`])([^"'`\n]+)(["'`])|([A-Za-z0-9_-]{8,})(\z|[^(.\[A-Za-z0-9_-]))"""
KEY_FORMAT = r"\b(?:sk-[A-Za-z0-9_\-]{8,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{8,})"
AWS_KEY = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
GITHUB_PAT = r"\bgithub_pat_[A-Za-z0-9_]{22,}\b"
GITHUB_TOKEN = r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"
SLACK_TOKEN = r"\bxox[abprs]-[0-9A-Za-z-]{10,}\b"
JWT = r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
GOOGLE_API_KEY = r"\bAIza[0-9A-Za-z_-]{35}\b"
LONG_LITERAL = r"""(["'`])([A-Za-z0-9+/=_\-]{32,})(["'`])"""
#: Each shape with what stays of a match and a cheap expression that every text with a match holds, so that other texts pass by.
SECRET_SHAPES = [
    (BEARER, "$1" + REDACTED, "(?i)bearer"), (QUOTED_SECRET, "$1$2" + REDACTED + "$4", r"""(?i)(?:authorization|key|secret|token|password)["']?[\s\u0085\p{Z}]*[:=]"""),
    (BARE_API_KEY, "$1" + REDACTED, "(?i)api[_-]?key"), (GENERIC_SECRET_ASSIGN, "$1$2$3" + REDACTED + "$5$7", r"(?i)(?:key|token|secret|password)[\s\u0085\p{Z}]*[:=]"),
    (KEY_FORMAT, REDACTED, "sk-|_live_|_test_"), (AWS_KEY, REDACTED, "AKIA|ASIA"), (GITHUB_PAT, REDACTED, "github_pat_"), (GITHUB_TOKEN, REDACTED, "gh[pousr]_"),
    (SLACK_TOKEN, REDACTED, "xox[abprs]-"), (JWT, REDACTED, "eyJ"), (GOOGLE_API_KEY, REDACTED, "AIza"),
]
#: A quoted literal of 32 or more hex digits with both a digit and a letter.
HEX_LITERAL = r"""(["'`])(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}(["'`])"""


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use() repeats it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def label_list(rest: Column) -> Column:
    """Labels of "a, b or c": 2 to 20 of at most 40 bytes and 3 words, else null."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"(?U)^\s+|\s+$", ""), r"[.;]+$", ""), " or | and ", ",")
    parts = F.filter(F.transform(F.split(text, r"[,/|]"), lambda p: F.regexp_replace(p, r"""(?U)^[\s"'`\[\](){}*]+|[\s"'`\[\](){}*]+$""", "")), lambda p: p != "")
    good = F.size(parts).between(2, 20) & F.forall(parts, lambda p: (F.octet_length(p) <= 40) & (F.size(F.split(p, r"(?U)\s+")) <= 3))
    return F.when(good, parts)


def prompt_signals(text: Column) -> Column:
    """array<string> of the signals of a prompt, in fixed order; one_of carries its labels, rating its range."""
    labels = label_list(F.regexp_extract(text, ONE_OF, 1))
    low, high = (F.regexp_extract(text, RATE, g).try_cast("int") for g in (1, 2))
    return F.array_compact(
        F.array(
            F.when(text.rlike(YES_NO), "yes_no"),
            F.when(text.rlike(TRUE_FALSE), "true_false"),
            F.when(text.rlike(ONE_OF) & labels.isNotNull(), F.concat(F.lit("one_of:"), F.array_join(labels, "|"))),
            F.when(text.rlike(CLASSIFY), "classify"),
            F.when(text.rlike(RATE) & (high > low), F.concat_ws(":", F.lit("rating"), low, high)),
            F.when(text.rlike(ONE_WORD), "one_word"),
        )
    )


def implied_space(signals: Column) -> Column:
    """The answer space that signals imply: labels before yes/no before a rating; null if none."""
    first = lambda p: F.element_at(F.filter(signals, lambda s: s.rlike(p)), 1)
    yes_no = F.when(F.arrays_overlap(signals, F.array(F.lit("yes_no"), F.lit("true_false"))), "yes_no")
    pick = lambda p: F.when(F.exists(signals, lambda s: s.rlike(p)), first(p))
    return F.coalesce(pick("^one_of:"), yes_no, pick("^rating:"))


def tier(fields: Column, free_text: Column, unresolved: Column, signals: Column, prompt: Column, max_tokens: Column) -> Column:
    """Evidence tier of a call: fields and free_text count a resolved schema's fields (null: no schema)."""
    return (
        F.when(unresolved, "review")
        .when(fields == 0, "not_decision")
        .when(fields.isNotNull() & (free_text <= 1), "sure")
        .when(fields.isNotNull(), "likely")
        .when(F.size(signals) > 0, "likely")
        .when(max_tokens <= 16, "review")
        .when(prompt.rlike(r"(?U)\S"), "not_decision")
        .otherwise("review")
    )


def imported_packages(source: Column, packages: dict[str, str] = PYTHON_PACKAGES) -> Column:
    """Sorted names of the packages that a Python source imports at the start of a line."""
    rule = r"(?m)^[ \t]*(?:from[ \t]+{0}(?:\.[\w.]+)?[ \t]+import\b|import[ \t]+{0}\b)"
    return F.array_compact(F.array(*[F.when(source.rlike(rule.format(p)), n) for n, p in sorted(packages.items())]))


def imported_ts_packages(source: Column, packages: dict[str, str] = TS_PACKAGES) -> Column:
    """Sorted names of the packages that a TypeScript or JavaScript source imports or requires."""
    rule = r"""(?:\bfrom\s*|\bimport\s*|\brequire\(\s*)['"](?:{0})['"]"""
    return F.array_compact(F.array(*[F.when(source.rlike(rule.replace("{0}", p)), n) for n, p in sorted(packages.items())]))


def has_word(text: Column, words: list[str]) -> Column:
    """Does the text hold one of the words, not as part of a longer name? One regular expression for all of them."""
    import re

    return text.rlike(r"(?<![\p{Alnum}_$])(?:" + "|".join(map(re.escape, words)) + r")(?![\p{Alnum}_$])")


def high_entropy(literal: Column) -> Column:
    """Does an ASCII literal look like a secret? Hex with digits and letters, or a digit, letters of both cases and at least 4 bits a character."""

    def bits(chars: Column) -> Column:
        n = F.size(chars)
        each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)))
        return F.log2(n) - F.aggregate(each, F.lit(0.0), lambda acc, k: acc + k * F.log2(k)) / n

    digits = literal.rlike("[0-9]")
    mixed = digits & literal.rlike("[A-Z]") & literal.rlike("[a-z]")
    return F.when(literal.rlike(r"\A[0-9a-fA-F]*\z"), digits & literal.rlike("[a-fA-F]")).when(~mixed, False).otherwise(let(F.split(literal, ""), bits) >= 4.0)


def replaced(text: Column, pattern: str, use: Callable[[Column], Column]) -> Column:
    """text with every match of pattern replaced by use(match), in time proportional to the text."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")), lambda x: F.concat(x["g"], F.when(x["h"].isNull(), "").otherwise(use(x["h"]))))
    return F.array_join(parts, "")


def redacted_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda _: F.lit(REDACTED)), "\n")


def _shape(pattern: str, kept: str, anchor: str) -> Callable[[Column], Column]:
    return lambda x: F.when(x.rlike(anchor), F.regexp_replace(x, "(?U)" + pattern, kept)).otherwise(x)


def redact(text: Column) -> Column:
    """text without what looks like a secret: key blocks, also the tail of one that began before the text, line by line; then the shapes in
    order; then long literals that look random. No Python, every step bound once, and texts without a step's anchor pass it by. (?U) makes classes Unicode-aware.
    """
    head = lambda x: F.regexp_extract(x, rf"(?s)\A(.*?{KEY_END})", 1)
    tail = lambda x: let(head(x), lambda h: F.when((h != "") & ~h.rlike(KEY_BEGIN), F.concat(redacted_lines(h), replaced(F.substring(x, F.length(h) + 1, F.lit(1 << 30)), KEY_BLOCK, redacted_lines))).otherwise(replaced(x, KEY_BLOCK, redacted_lines)))
    out = let(text, lambda x: F.when(x.contains("KEY-----"), tail(x)).otherwise(x))
    for pattern, kept, anchor in SECRET_SHAPES:
        out = let(out, _shape(pattern, kept, anchor))
    literal = lambda h: F.when(high_entropy(F.substring(h, F.lit(2), F.length(h) - 2)), F.concat(F.substring(h, 1, 1), F.lit(REDACTED), F.substring(h, -1, 1))).otherwise(h)
    return let(out, lambda x: F.when(x.rlike(LONG_LITERAL), replaced(x, LONG_LITERAL, literal)).otherwise(x))


def byte_entropy(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bits): Shannon entropy of the bytes of each text. One row per byte value and text reaches the shuffle."""
    hexed = rows.select(F.col(id_col), F.hex(F.encode(F.col(text_col), "UTF-8")).alias("h"))
    each = hexed.select(id_col, F.explode(F.regexp_extract_all("h", F.lit(".."), F.lit(0))).alias("b"))
    counts = each.groupBy(id_col, "b").agg(F.count("*").alias("c"))
    sums = counts.groupBy(id_col).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return sums.select(id_col, F.round(F.log2("n") - F.col("s") / F.col("n"), 9).alias("bits"))


def _number(x: float) -> str:
    """A double as ECMAScript prints it."""
    if x == 0:
        return "0"
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    sign, digits = ("-" if x < 0 else ""), repr(abs(x))
    mantissa, _, exp = digits.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    ds = (whole + part).lstrip("0")
    point = len(whole) + int(exp or 0) - (len(whole + part) - len(ds))
    ds = ds.rstrip("0")
    k = len(ds)
    if k <= point <= 21:
        body = ds + "0" * (point - k)
    elif 0 < point <= 21:
        body = f"{ds[:point]}.{ds[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + ds
    else:
        e = point - 1
        body = (ds if k == 1 else f"{ds[0]}.{ds[1:]}") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return sign + body


def canonical_json(value: object) -> str:
    """RFC 8785: members in the order of their names' UTF-16 units, shortest numbers, no white space."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, str):
        return encode_basestring(value)
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    return _number(float(value))


@F.pandas_udf(StringType())
def jcs(texts: pd.Series) -> pd.Series:
    """Canonical form of a JSON text; null for what is no JSON or is nested deeper than Python's parser goes."""

    @lru_cache(64)
    def one(t):
        try:
            return None if t is None else canonical_json(json.loads(t))
        except (ValueError, OverflowError, RecursionError, MemoryError):
            return None

    return texts.map(one)
