"""Personal data in whole texts: patterns propose spans, checksums confirm them, nearby words move the score.

Base kinds (always returned when they pass their own test, whatever the score):

* email, ip (parts at most 255), card (16 to 19 digits that pass Luhn), phone (8 to 15 digits);
* matches are leftmost and non-overlapping within a kind, and a match that fails its test is dropped without a retry.

Further kinds, which need a score of `min_score`, so that context decides on them:

* iban: mod-97 confirms it; one of its country's length is accepted alone, unless words such as "example" stand before
  it; other lengths are accepted only where nothing speaks against them;
* secret: 16 or more key characters assigned to a name, where the name or the words before it speak of a key, token or
  password;
* ssn: a number of that shape in its valid ranges, where a word before it says what it is.

A score is the prior of the kind, plus `RAISE` for each context word of the kind and less `LOWER` for a word that marks an
example, within `window` characters before the span (for secrets, the name included), held to 0 to 1.

A null or empty text has no spans; a very long text is searched whole, in linear time. Kinds may overlap and are all told;
equal starts of one kind cannot occur. Rows are independent: repeated rows get equal results, an empty table gives an
empty result, and columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret", "ssn")

_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: An address cannot begin inside a run of digits from whose start it fails, so each run is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ALNUM = re.compile("[A-Za-z0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z][A-Za-z0-9_-]{0,99})[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/=-]{16,})")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_HINT = re.compile("[@+0-9=:]")

CONTEXT = {
    "email": ("mail", "contact", "address", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "secret": ("key", "token", "secret", "password", "passwd", "auth", "access", "login"),
    "ssn": ("ssn", "social security", "social"),
}
#: Words that mark what follows as no one's data.
EXAMPLE = ("example", "sample", "dummy", "placeholder")
#: What a confirmed pattern is worth before its context is read. A checksum is stronger evidence than a shape.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.7, "other_iban": 0.5, "secret": 0.3, "ssn": 0.3}
RAISE, LOWER = 0.2, 0.3
#: Lengths of account numbers by country, ISO 13616.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 13616: the first four characters move to the end, letters count from 10, the remainder must be 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ can end one local part only: the run before it, as far as the last match allows."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _BEFORE_AT.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _accounts(text: str) -> Iterator[tuple[str, int, int]]:
    """(iban or other_iban, start, end): cut at the length of the country, else the longest run."""
    at = 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        at = end
        length = IBAN_LENGTH.get(m[0][:2])
        cut, seen = start, 0
        while length and cut < end and seen < length:
            seen += text[cut] != " "
            cut += 1
        if length and seen == length and not (cut < len(text) and _ALNUM.match(text[cut])) and mod97(text[start:cut].replace(" ", "")):
            at = cut
            yield "iban", start, cut
        elif mod97(m[0].replace(" ", "")):
            yield "other_iban", start, end
        else:
            at = start + 4


def _named(name: str) -> bool:
    return any(w in name.lower() for w in ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey"))


def _keylike(value: str) -> bool:
    """Not one word or number: characters of two of the classes letters, digits and signs at least."""
    return sum((any(c.isalpha() for c in value), any(c.isdigit() for c in value), any(not c.isalnum() for c in value))) > 1


def _score(kind: str, near: str) -> float:
    words = CONTEXT["iban" if kind == "other_iban" else kind]
    score = PRIOR[kind] + RAISE * sum(w in near for w in words) - LOWER * any(w in near for w in EXAMPLE)
    return round(min(1.0, max(0.0, score)), 6)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_spans(text: str, window: int = 40, min_score: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in the order of KINDS, then by start. Positions are code points, the end is exclusive."""
    found: list[tuple[str, int, int]] = []
    if not text or not _HINT.search(text):
        return []
    if "@" in text:
        found += [("email", *x) for x in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= m.end() - m.start() and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    out = [(kind, start, end, _score(kind, text[max(0, start - window) : start].lower())) for kind, start, end in found]
    further = [(kind, start, end, max(0, start - window)) for kind, start, end in _accounts(text)]
    if "=" in text or ":" in text:
        further += [("secret", *m.span(2), max(0, m.start() - window)) for m in _SECRET.finditer(text) if _named(m[1]) or _keylike(m[2])]
    if "-" in text:
        further += [("ssn", *m.span(), max(0, m.start() - window)) for m in _SSN.finditer(text)]
    for kind, start, end, since in further:
        score = _score(kind, text[since:start].lower())
        if score >= min_score:
            out.append(("iban" if kind == "other_iban" else kind, start, end, score))
    return out


def joined(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, _ in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 40, min_score: float = 0.5) -> DataFrame:
    """One row per document: its id and `spans`, an array of (kind, start, end, score, match)."""
    fields = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("match", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for text in b.column(1):
                text = text.as_py() or ""
                spans.append([{"kind": k, "start": s, "end": e, "score": x, "match": text[s:e]} for k, s, e, x in find_spans(text, window, min_score)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(fields))], ["doc_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double,match:string>>")


def digest(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans as one string, and their scores."""
    named = lambda xs: F.array_join(F.transform(xs, lambda x: F.format_string("%s:%d:%d", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return spans.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda x: F.format_string("%.1f", x["score"])), ",").alias("scores"), F.size("spans").cast("long").alias("n_spans"))


def mask(text: str | None, window: int = 40, min_score: float = 0.5) -> str | None:
    """The text with every span replaced by the name of its kind; of overlapping spans the earlier and longer wins."""
    if not text:
        return text
    out, done = [], 0
    for kind, start, end, _ in sorted(find_spans(text, window, min_score), key=lambda x: (x[1], -x[2])):
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
            done = end
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", window: int = 40, min_score: float = 0.5) -> DataFrame:
    """The same rows and columns with masked texts; a column of text lengths follows where its text changed."""
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = names.index(text_col)
            texts = b.column(at).to_pylist()
            masked = [mask(t, window, min_score) for t in texts]
            columns = list(b.columns)
            columns[at] = pa.array(masked, b.schema.field(at).type)
            if chars_col in names:
                k = names.index(chars_col)
                columns[k] = pa.array([n if a == m else len(m) for a, m, n in zip(texts, masked, b.column(k).to_pylist(), strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, schema)
