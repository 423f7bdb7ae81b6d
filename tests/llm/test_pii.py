import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = "".join(c for c in m[0] if c in "0123456789")
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def base(text):
    return [x[:3] for x in pii.find_spans(text) if x[0] in pii.BASE_KINDS]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1+@.-_% 0245()9é\n", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert base(text) == brute(text)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in pii.digest(pii.detect(docs)).collect()}
    found = 0
    for r in docs.collect():
        spans = brute(r.text)
        found += len(spans)
        g = got[r.doc_id]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(s[0] == k for s in spans) for k in PATTERNS]
        assert g.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    assert len(got) == docs.count() and found > 50


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "9" * 200_000 + " a@" * 50_000, "x"), (4, "mail a@b.co", "x"), (4, "mail a@b.co", "x"), (None, "1.2.3.4", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.digest(pii.detect(docs)).collect()
    assert len(got) == 6 and [r.spans for r in got if r.doc_id == 4] == ["email:5:11"] * 2
    assert [r.n_ip for r in got if r.doc_id is None] == [1]
    assert pii.digest(pii.detect(docs.limit(0))).collect() == []


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("1234567890123456")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert [x[0] for x in pii.find_spans("bank GB82 WEST 1234 5698 7654 32")] == ["iban"]
    plain, helped = pii.find_spans("x 10.0.0.1"), pii.find_spans("server ip 10.0.0.1")
    assert plain[0][3] < helped[0][3]


def test_redaction_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "call +1 (555) 555-0100 now", "en", "s", 26), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(pii.redact(docs).collect())
    assert out[0].text == "call <phone> now" and out[0].n_chars == 16 and out[1].text is None and pii.redact(docs).columns == docs.columns


def test_context_decides_on_further_kinds():
    kinds = lambda text: [x[0] for x in pii.find_spans(text)]
    assert kinds("GB82 WEST 1234 5698 7654 32 PLEASE") == ["iban"] and pii.find_spans("GB82 WEST 1234 5698 7654 32 PLEASE")[0][1:3] == (0, 27)
    assert kinds("for example GB82 WEST 1234 5698 7654 32") == [] and kinds("example of a bank account GB82WEST12345698765432") == ["iban"]
    assert kinds("number 219-09-9999") == [] and kinds("his SSN is 219-09-9999") == ["ssn"] and kinds("ssn 000-09-9999") == []
    assert kinds("session=abcdef0123456789ab") == [] and kinds("login with session=abcdef0123456789ab") == ["secret"]
    assert kinds("api_key = abcdefghijklmnopqrst") == ["secret"] and kinds('{"token": "ABCDEF0123456789XY"}') == ["secret"]
    assert kinds("a sample password=abcdefghijklmnop") == []


def test_scores_are_returned(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or server 10.0.0.1")], "doc_id long, text string")
    assert [r.scores for r in pii.digest(pii.detect(docs)).collect()] == ["1.0,0.8"]
