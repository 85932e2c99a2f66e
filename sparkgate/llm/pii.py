"""Personal data by anchor expansion: an Aho-Corasick automaton finds anchors, local parsers expand and check them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order that breaks ties of equal starts: the base kinds, then what the method adds.
KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))

# Anchors, in either case, and the shapes around them.
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
STREETS = (" street", " avenue", " road", " boulevard", " lane", " drive", " square", " court")
SUFFIXES = ("straße", "strasse")
ACCOUNTS = ("iban", "account no", "account number", "ssn", "kontonummer", "passport no")
#: Words of a street's name before its kind.
MOST_WORDS = 4
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"(?:[A-Za-z0-9._~%!$&'*+,;=:-]+@[A-Za-z0-9.-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?::[0-9]{1,5})?(?:/[^\x20\x09-\x0D\"'<>]*)?")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz.'-")
HOUSE = re.compile(r"\x20[0-9]{1,5}[A-Za-z]?(?![A-Za-z0-9])")
ASCII_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
IBAN = re.compile(r"[\x20:#.]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
NUMBER = re.compile(r"(?:\x20?(?:number|no)\.?)?[\x20:#.]{1,4}([A-Z]{0,2}[0-9](?:[\x20-]?[0-9]){5,19})(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@cache
def anchors():
    """The automaton; each hit gives the kind of its anchor and the anchor's length."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for group, kind in ((("@",), "at"), (("+",), "plus"), (tuple("0123456789"), "digit"), (SCHEMES, "scheme"), (STREETS, "street"), (SUFFIXES, "suffix"), (ACCOUNTS, "account")):
        for word in group:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def folded(text: str) -> str:
    """text in lower case, position by position."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(ASCII_LOWER)


def house_before(text: str, left: int, at: int) -> int | None:
    """Where a house number starts that stands before up to MOST_WORDS capitalised words which end at `at`, the farthest if there are several; nothing before left is read."""
    found = None
    for _ in range(MOST_WORDS):
        start = at
        while start > left and text[start - 1] in NAME:
            start -= 1
        if start == at or not "A" <= text[start] <= "Z" or start <= left or text[start - 1] != " ":
            break
        at = start - 1
        number = at
        if number > left and "A" <= text[number - 1].upper() <= "Z" and text[number - 1].isascii():
            number -= 1
        digits = number
        while digits > left and "0" <= text[digits - 1] <= "9" and number - digits < 6:
            digits -= 1
        if 1 <= number - digits <= 5:
            found = digits
    return found


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of one text, by start and kind. Work is in proportion to the text: no parser goes back over what its kind has read."""
    spans: list[tuple[int, int, str]] = []
    after = dict.fromkeys(KINDS, 0)  # where each kind may match again
    for last, (kind, size) in anchors().iter(folded(text)):
        at = last - size + 1
        if kind == "digit":
            if at >= after["ip"] and not (at and "0" <= text[at - 1] <= "9" and at - 1 >= after["ip"]) and (m := IP.match(text, at)):
                after["ip"] = m.end()
                if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.groups()):
                    spans.append((*m.span(), "ip"))
            if at >= after["card"] and (m := CARD.match(text, at)):
                after["card"] = m.end()
                if m.end() - at <= 40 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                    spans.append((*m.span(), "card"))
        elif kind == "at":
            start = at
            while start > after["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                after["email"] = m.end()
                spans.append((start, m.end(), "email"))
        elif kind == "plus":
            if at >= after["phone"] and (m := PHONE.match(text, at)):
                after["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append((*m.span(), "phone"))
        elif kind == "scheme":
            if at >= after["address"] and (m := URL.match(text, last + 1)):
                after["address"] = m.end()
                spans.append((at, m.end(), "address"))
        elif kind == "street":
            if (last + 1 == len(text) or not text[last + 1].isalpha()) and (start := house_before(text, after["address"], at)) is not None:
                after["address"] = last + 1
                spans.append((start, last + 1, "address"))
        elif kind == "suffix" and at >= after["address"]:
            start = at
            while start > after["address"] and text[start - 1].isalpha():
                start -= 1
            if text[start].isupper() and (m := HOUSE.match(text, last + 1)):
                after["address"] = m.end()
                spans.append((start, m.end(), "address"))
        elif kind == "account" and at >= after["account"] and not (at and text[at - 1].isalnum()):
            if m := IBAN.match(text, last + 1):
                if iban_ok(m[1]):
                    after["account"] = m.end()
                    spans.append((*m.span(1), "account"))
            elif m := NUMBER.match(text, last + 1):
                after["account"] = m.end()
                spans.append((*m.span(1), "account"))
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with pii_spans, an array of (start, end, kind) by start and kind; positions in code points, end exclusive.

    Base kinds: email, ip, card, phone. The method adds address (links with user data or a bare address as host, house numbers
    before up to MOST_WORDS capitalised words and a kind of street, street names with a number behind) and account (IBAN with a right checksum, numbers behind an account cue). Schemes, streets and cues count in either case. One row per input row, in whole texts. A null text is empty; an
    empty table gives an empty result; a column named pii_spans is replaced. Narrow: no shuffle, a batch of texts in memory.
    """
    held = docs.drop("pii_spans")
    schema = T.StructType([*held.schema.fields, T.StructField("pii_spans", SPANS)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("start", "end", "kind"), x)) for x in find_spans(t or "")] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "pii_spans"])

    at = held.columns.index(text_col)
    return held.mapInArrow(scan, schema)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def mask_pii(docs: DataFrame, kinds: tuple[str, ...] = KINDS, text_col: str = "text") -> DataFrame:
    """docs with each span of the given kinds replaced by its kind in brackets; overlapping spans become one mark. A null text stays null."""
    at = docs.columns.index(text_col)

    def mask(text: str | None) -> str | None:
        if text is None:
            return None
        out, last = [], 0
        for start, end, kind in find_spans(text):
            if kind in kinds and end > last:
                if start >= last:
                    out += [text[last:start], f"[{kind.upper()}]"]
                last = end
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([mask(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op2_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    of = lambda kind: F.size(F.filter("pii_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("pii_spans")).alias("spans"))
