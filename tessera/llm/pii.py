"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Every span is ``(kind, start, end, score)``, in code points, end exclusive.
The base kinds (email, ip, card, phone) follow fixed rules and always stay.
The method adds kinds that a pattern alone can't decide:

* ``iban``: country, check digits and 11 to 30 more characters, confirmed by mod 97;
* ``ssn``: ddd-dd-dddd in an issued range, only where a word such as "ssn" stands near;
* ``local_phone``: a national number without "+", only where a word such as "tel" stands near.

A span starts with its kind's prior; a passed checksum and a context word
within ``CONTEXT`` characters raise it.  Added kinds need ``ACCEPT``.

Edge cases: null is the empty text (no spans); repeated rows each give a row;
an empty table gives an empty result; every pattern runs in time linear in the
text, so a very long text or a long run of one class costs no more than its
length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "local_phone")
ORDER = {kind: i for i, kind in enumerate(KINDS)}
#: Where each kind's score starts, what a checksum and a context word add.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.7, "iban": 0.5, "ssn": 0.3, "local_phone": 0.3}
CHECKSUM, NEAR, ACCEPT, CONTEXT = 0.35, 0.3, 0.6, 40
#: Words that make a kind likelier when near.
WORDS = {
    "email": r"e-?mail|contact|mailto|courriel|correo",
    "ip": r"ip|server|host|address|adresse",
    "card": r"card|visa|mastercard|amex|credit|carte|karte|tarjeta",
    "phone": r"phone|tel|call|fax|mobile|telefon|téléphone|teléfono",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social security|social",
    "local_phone": r"phone|tel|call|fax|mobile|telefon|téléphone|teléfono",
}
_NEAR = {kind: re.compile(rf"(?<!\w)(?:{words})(?!\w)", re.I) for kind, words in WORDS.items()}

_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Possessive runs: the next part can't start inside a run, so nothing is lost and nothing is tried again.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

SPAN = "struct<kind:string,start:int,end:int,score:double>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the number with its first four characters at the end leaves 1."""
    compact = iban.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def emails(text: str):
    """Leftmost, non-overlapping: each "@" with the longest name run before it, after the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _NAME:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", *span) for span in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def _near(kind: str, text: str, start: int, end: int) -> bool:
    return bool(_NEAR[kind].search(text[max(0, start - CONTEXT) : start]) or _NEAR[kind].search(text[end : end + CONTEXT]))


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans of one text, by start and then kind."""
    if not text:
        return []
    base = base_spans(text)
    added = []
    if _DIGIT.search(text):
        taken = _merged([(s, e) for _, s, e in base])
        proposed = [("iban", m) for m in _IBAN.finditer(text) if mod97(m[0])] + [("ssn", m) for m in _SSN.finditer(text)] + [("local_phone", m) for m in _LOCAL.finditer(text)]
        for kind, m in sorted(proposed, key=lambda x: (x[1].start(), ORDER[x[0]])):
            if not _overlaps(taken, *m.span()) and (not added or added[-1][2] <= m.start()):
                score = PRIOR[kind] + CHECKSUM * (kind == "iban") + NEAR * _near(kind, text, *m.span())
                if score >= ACCEPT:
                    added.append((kind, *m.span(), min(1.0, score)))
    out = [(k, s, e, min(1.0, PRIOR[k] + CHECKSUM * (k == "card") + NEAR * _near(k, text, s, e))) for k, s, e in base]
    return sorted(out + added, key=lambda x: (x[1], ORDER[x[0]]))


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _overlaps(taken: list[list[int]], start: int, end: int) -> bool:
    """Does a span meet one of these disjoint, sorted ones?"""
    i = bisect_left(taken, [end])
    return i > 0 and taken[i - 1][1] > start


def _find(texts: pa.Array) -> pa.Array:
    rows = [[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in spans(t)] for t in texts.to_pylist()]
    return pa.array(rows, pa.list_(_SPAN))


def pii_spans(text: Column) -> Column:
    """All spans of a text column, by start and then kind."""
    return F.arrow_udf(_find, f"array<{SPAN}>")(text)


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans share the first's."""
    found = spans(text)
    if not found:
        return text
    out, done = [], 0
    for kind, start, end, _ in found:
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _mask(texts: pa.Array) -> pa.Array:
    return pa.array([mask(t) for t in texts.to_pylist()], pa.string())


def masked(text: Column) -> Column:
    return F.arrow_udf(_mask, "string")(text)


def _digest(texts: pa.Array) -> pa.Array:
    counts: list[list[int]] = [[] for _ in BASE_KINDS]
    hashes, joined = [], []
    for text in texts.to_pylist():
        found = spans(text)
        base = [x for x in found if x[0] in BASE_KINDS]
        for kind, column in zip(BASE_KINDS, counts, strict=True):
            column.append(sum(x[0] == kind for x in base))
        hashes.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, _ in base).encode()).hexdigest())
        joined.append(",".join(f"{k}:{s}:{e}" for k, s, e, _ in found))
    columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(joined, pa.string())]
    return pa.StructArray.from_arrays(columns, names=[*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, their digest, and all spans."""
    kind = "struct<" + ",".join(f"n_{k}:long" for k in BASE_KINDS) + ",base_sha256:string,spans:string>"
    return docs.select("doc_id", F.arrow_udf(_digest, kind)("text").alias("__pii")).select("doc_id", "__pii.*")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span masked and n_chars, where there is one, made to fit."""
    out = docs.withColumn("text", masked(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
