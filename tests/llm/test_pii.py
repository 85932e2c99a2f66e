import hashlib
import random
import re

from sparkgate.llm.pii import BASE, KINDS, find_pii, find_spans, iban_ok, mask_pii, op2_anchor_pii

BASES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def good(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    out = [(m.start(), BASE.index(k), m.end(), k) for k, p in BASES.items() for m in re.finditer(p, text or "") if good(k, m[0])]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_base_spans_match_regular_expressions():
    rng = random.Random(11)
    parts = ["a", "b.c", "@", "@x.org", ".", "1", "12", "255", "256", "1.2.3.4", "0001.2.3.4", " ", "-", "+", "+1 (499) 555-6503", "4111 1111 1111 1111", "4111111111111111", "é", "😀", "\n", "(", ")", "%", "_"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 16)))
        assert [x for x in find_spans(text) if x[2] in BASE] == brute(text), text


def test_added_kinds():
    text = "see https://bob:pw@host.example/x or http://10.0.0.1/a at 12 Old Mill Road. IBAN: GB82 WEST 1234 5698 7654 32, account no: 12345678"
    added = [(text[s:e], k) for s, e, k in find_spans(text) if k not in BASE]
    assert added == [("https://bob:pw@host.example/x", "address"), ("http://10.0.0.1/a", "address"), ("12 Old Mill Road", "address"), ("GB82 WEST 1234 5698 7654 32", "account"), ("12345678", "account")]
    assert [x for x in find_spans("IBAN: GB82 WEST 1234 5698 7654 33") if x[2] == "account"] == []
    assert [x for x in find_spans("the account is https://example.org on our street") if x[2] not in BASE] == []


ADDED = {
    "address": r"""(?i:https?://|ftp://|ssh://)(?:[A-Za-z0-9._~%!$&'*+,;=:-]+@[A-Za-z0-9.-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?::[0-9]{1,5})?(?:/[^\x20\x09-\x0D"'<>]*)?"""
    r"""|(?<![0-9])[0-9]{1,5}[A-Za-z]?\x20(?:[A-Z][A-Za-z.'-]*\x20){0,3}?[A-Z][A-Za-z.'-]*(?i:\x20(?:street|avenue|road|boulevard|lane|drive|square|court))(?![^\W\d_])"""
    r"""|(?<![^\W\d_])(?=[A-ZÄÖÜ])[^\W\d_]*?(?i:straße|strasse)\x20[0-9]{1,5}[A-Za-z]?(?![A-Za-z0-9])""",
    "account": r"(?<![^\W_])(?i:iban|account\x20no|account\x20number|ssn|kontonummer|passport\x20no)(?:[\x20:#.]{0,4}(?P<iban>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])|(?:\x20?(?:number|no)\.?)?[\x20:#.]{1,4}(?P<number>[A-Z]{0,2}[0-9](?:[\x20-]?[0-9]){5,19})(?![A-Za-z0-9]))",
}


def test_added_spans_match_regular_expressions():
    """Addresses and accounts against one expression each, in any order of parts and in either case."""
    rng = random.Random(7)
    parts = ["12", "7b", "123456", " ", " ", " ", "Old", "Mill", "O'Hara", "x", " Road", " STREET", " lane", " Roads", "Haupt", "straße", "STRASSE 5", " 12a", "\n", "Https://", "ssh://", "me:pw@host.example", "10.0.0.1", "/path?q", ":8080"]
    cues = ["IBAN", "Iban", "ssn", "assn", "Account No", "ACCOUNT NUMBER", "Kontonummer", ": ", " ", "# ", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433", "12345678", "078-05-1120", "AB123456", "no", "x", "\n"]
    seen = set()
    for k in range(6000):
        text = "".join(rng.choices(parts if k % 2 else cues, k=rng.randrange(1, 14)))
        want = [(*m.span(), "address") for m in re.finditer(ADDED["address"], text)]
        at = 0
        while m := re.compile(ADDED["account"]).search(text, at):
            group = "number" if m["number"] else "iban"
            at = m.start() + 1  # a wrong IBAN hides no cue within it
            if group == "number" or iban_ok(m["iban"]):
                want.append((*m.span(group), "account"))
                at = m.end()
        got = [x for x in find_spans(text) if x[2] in ADDED]
        assert got == sorted(want), text
        seen |= {(kind, m[0][0]) for kind, p in ADDED.items() for m in re.finditer(p, text)}
    assert len(seen) > 12


def test_long_names_take_linear_time():
    assert find_spans("A" * 400_000 + " Road Road " + "12 " + "B" * 300_000 + " street") == [(400_011, 700_021, "address")]
    assert len(find_spans("1 A Street " * 50_000)) == 50_000


def test_rows_nulls_long_texts_and_clashes(spark):
    long = "x" * 300_000 + " me@site.org " + "1" * 50_000
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, long, None), (4, "me@site.org", 5), (4, "me@site.org", 5)], "doc_id long, text string, pii_spans int")
    got = find_pii(docs).collect()
    assert [len(r.pii_spans) for r in sorted(got, key=lambda r: r.doc_id)] == [0, 0, 1, 1, 1]
    assert [r.text for r in mask_pii(docs).orderBy("doc_id").collect()][3] == "[EMAIL]"
    assert mask_pii(docs).where("text is null").count() == 1
    assert find_pii(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_anchor_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = ",".join(f"{k}:{s}:{e}" for s, e, k in brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.n_email == want.count("email:")
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))
    assert KINDS[:4] == BASE
