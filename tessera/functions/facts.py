"""Identifiers, header rules and answer formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import normalize
from tessera.functions.bind import let

#: Words in a header and the predicate they mean, in the order they are tried.
HEADERS = (
    ("contract_value", ("contract value", "contract amount")),
    ("amount", ("amount", "price", "total", "value", "cost")),
    ("rate", ("rate",)),
    ("quantity", ("quantity", "qty")),
    ("item_number", ("item", "sr no", "s no", "s/no")),
    ("description", ("description", "details", "particulars")),
    ("date", ("date", "day", "month", "year")),
    ("unit", ("unit", "uom")),
)
#: The types of value that each predicate takes.
ACCEPTS = {
    "amount": ("currency_inr", "number"),
    "contract_value": ("currency_inr", "number"),
    "rate": ("number", "currency_inr", "percentage"),
    "quantity": ("number",),
    "date": ("date",),
    "unit": ("unit", "text"),
    "description": ("text",),
    "item_number": ("text", "number"),
}


def stable_hex(*parts: Column) -> Column:
    """SHA-256 of the parts' text, one after the other; null is "None"."""
    return F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]).cast("binary"), 256)


def checksum(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def column_index(address: Column) -> Column:
    """A = 1, Z = 26, AA = 27, from a cell's address; 0 without letters."""
    letters = F.split(F.upper(F.regexp_replace(F.coalesce(address, F.lit("")), "[^A-Za-z]", "")), "")
    return F.aggregate(F.array_remove(letters, ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)


def row_number(address: Column) -> Column:
    """The row of a cell's address; 0 without digits."""
    return F.coalesce(F.regexp_replace(address, "[^0-9]", "").try_cast("int"), F.lit(0))


def header_predicate(header: Column) -> Column:
    """What the values under a header mean, or null."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.lower(header), r"[()%₹,.]", ""), r"\s+", " "))
    return let(text, lambda t: F.coalesce(*[F.when(F.greatest(*[t.contains(w).cast("int") for w in (*words, words[0])]) == 1, F.lit(name)) for name, words in HEADERS]))


def predicate_accepts(predicate: Column, raw: Column) -> Column:
    """Does a value have a type that its predicate takes?"""
    kind = normalize.infer(raw)["type"]

    def accepts(v: Column) -> Column:
        shown = F.when(v["kind"].isNotNull(), v["kind"]).when(F.trim(v["raw"]) != "", F.lit("text"))
        rule = F.when(v["predicate"] == "computed_value", v["raw"].isNotNull())
        for name, kinds in ACCEPTS.items():
            rule = rule.when(v["predicate"] == name, shown.isin(*kinds))
        return F.coalesce(rule, F.lit(False))

    return let(F.struct(kind.alias("kind"), raw.alias("raw"), predicate.alias("predicate")), accepts)


def label_before(page: Column, value: Column) -> Column:
    """The label that stands before "label: value" on a page, or null."""
    # A value is taken literally: its own end marks are split.
    quoted = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.nullif(F.call_function("regexp_extract", page, F.concat(F.lit(r"(?i)([^\n:]+):\s*"), quoted), F.lit(1)), F.lit(""))


def coerce_number(answer: Column) -> Column:
    """A number from an answer's text: plain, or as ``infer`` reads it; null where there is none."""
    plain = F.regexp_replace(F.trim(answer), ",", "").try_cast("double")
    return F.coalesce(plain, normalize.infer(answer)["number"].cast("double"))


def format_answer(value: Column, kind: Column) -> Column:
    """Percentages with two decimals, whole numbers without, others with at most six significant digits."""
    rounded = F.round(value, 6)
    whole = rounded == F.floor(rounded)
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.abs(rounded))))
    short = F.regexp_replace(F.regexp_replace(F.round(rounded.cast("decimal(38,12)"), 6).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    significant = F.coalesce(*[F.when(digits == d, F.regexp_replace(F.regexp_replace(F.round(rounded.cast("decimal(38,12)"), d).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")) for d in range(12)], short)
    return F.when(value.isNull(), F.lit("0")).when(kind == "percent", F.format_string("%.2f", F.bround(value, 2))).when(whole, F.format_string("%.0f", rounded)).otherwise(significant)


def score_answer(gold: Column, got: Column) -> Column:
    """1 less the relative error, at least 0; a gold of 0 takes only 0; no answer is 0."""
    gold, got = gold.cast("double"), got.cast("double")
    near = F.greatest(F.lit(0.0), 1 - F.abs(got - gold) / F.abs(F.when(gold != 0, gold)))
    return F.coalesce(F.when(gold == 0, (got == 0).cast("double")).otherwise(near), F.lit(0.0))
