"""Money, percentages, dates, units and numbers from text, as column expressions.

Every function returns a struct (value, number, day, type, unit, status); status
is "valid" or "failed", and a failed value is null.  Nothing raises on bad text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.bind import let

MONEY = "decimal(38,6)"
#: Spellings and their factors, in the order they are tried.
FACTORS = (
    (r"(?i)(?<![A-Za-z])(?:crore|cr)(?![A-Za-z])\.?", 10_000_000),
    (r"(?i)(?<![A-Za-z])(?:lakh|lacs|lac)(?![A-Za-z])\.?", 100_000),
    (r"(?i)(?<![A-Za-z0-9])m(?![A-Za-z])", 1_000_000),
    (r"(?i)(?<![A-Za-z0-9])k(?![A-Za-z])", 1_000),
)
CURRENCY = r"(?i)(?:Rs\.?|INR|Rupees?|₹)\s*"
#: Units and the spellings that stand for them.
UNITS = {
    "sqm": r"^(?:sq\s*m|sqm)$",
    "m": r"^m$",
    "km": r"^km$",
    "days": r"^days?$",
    "months": r"^months?$",
    "years": r"^years?$",
    "lakh": r"^(?:lakh|lac|lacs)$",
    "crore": r"^(?:crore|cr\.?)$",
}
_DMY = r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})"
_YMD = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
_D_MONTH_Y = r"(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})"
_MONTH_D_Y = r"([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})"


def _clean(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(raw, "  ", "  "), r"\s+", " "))


def decimal(text: Column) -> Column:
    """A plain number without grouping commas, or null."""
    plain = F.trim(F.regexp_replace(_clean(text), ",", ""))
    return let(plain, lambda p: F.when(p.rlike(r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"), p.try_cast(MONEY)))


def _result(ok: Column, kind: Column | str, unit: Column | str | None = None, number: Column | None = None, day: Column | None = None, text: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    unit = F.lit(unit).cast("string") if not isinstance(unit, Column) else unit
    number = F.lit(None).cast(MONEY) if number is None else number.cast(MONEY)
    day = F.lit(None).cast("date") if day is None else day
    text = F.lit(None).cast("string") if text is None else text
    parts = F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), kind.alias("kind"), unit.alias("unit"), number.alias("number"), day.alias("day"), text.alias("text"))

    def result(r: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(r["number"].cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return F.struct(
            F.when(r["ok"], F.coalesce(r["text"], r["day"].cast("string"), plain)).alias("value"),
            F.when(r["ok"], r["number"]).alias("number"),
            F.when(r["ok"], r["day"]).alias("day"),
            F.when(r["ok"], r["kind"]).alias("type"),
            F.when(r["ok"], r["unit"]).alias("unit"),
            F.when(r["ok"], F.lit("valid")).otherwise(F.lit("failed")).alias("status"),
        )

    return let(parts, result)


def money(raw: Column) -> Column:
    """Rupees as a whole number, half to even; crore, lakh, M and K scale it."""

    def amount(text: Column) -> Column:
        factor, rest = F.lit(1), text
        for pattern, by in reversed(FACTORS):
            factor = F.when(text.rlike(pattern), F.lit(by)).otherwise(factor)
            rest = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "")).otherwise(rest)
        return F.bround((decimal(rest) * factor.cast("decimal(10,0)")).cast("decimal(38,6)"), 0)

    found = let(F.regexp_replace(_clean(raw), CURRENCY, ""), amount)
    return let(found, lambda x: _result(x.isNotNull(), "currency_inr", "INR", x))


def percentage(raw: Column) -> Column:
    """The number before a percent sign or word, out of 100."""
    return let(decimal(F.regexp_replace(raw, r"%|percentage|percent", "")), lambda x: _result(x.isNotNull(), "percentage", "%", x))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.when(year != "", F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))


def _month_day(name: Column, year: Column, day: Column) -> Column:
    short = F.initcap(F.lower(F.substring(name, 1, 3)))
    return F.when(year != "", F.try_to_date(F.concat_ws(" ", F.lpad(day, 2, "0"), short, year), "dd MMM yyyy"))


def date_value(raw: Column) -> Column:
    """The first date in a text: day-month-year, year-month-day, or with the month's name; null where it doesn't exist."""
    text = _clean(raw)
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    return F.coalesce(
        _day(part(rf"(?<!\d){_DMY}(?!\d)", 3), part(rf"(?<!\d){_DMY}(?!\d)", 2), part(rf"(?<!\d){_DMY}(?!\d)", 1)),
        _day(part(rf"(?<!\d){_YMD}(?!\d)", 1), part(rf"(?<!\d){_YMD}(?!\d)", 2), part(rf"(?<!\d){_YMD}(?!\d)", 3)),
        _month_day(part(rf"(?<!\d){_D_MONTH_Y}(?!\d)", 2), part(rf"(?<!\d){_D_MONTH_Y}(?!\d)", 3), part(rf"(?<!\d){_D_MONTH_Y}(?!\d)", 1)),
        _month_day(part(rf"{_MONTH_D_Y}(?!\d)", 1), part(rf"{_MONTH_D_Y}(?!\d)", 3), part(rf"{_MONTH_D_Y}(?!\d)", 2)),
    )


def date(raw: Column) -> Column:
    return let(date_value(raw), lambda x: _result(x.isNotNull(), "date", day=x))


def month_date(raw: Column) -> Column:
    """``date_value`` and also dotted dates and "Month Year", the first of that month."""
    text = F.regexp_replace(_clean(raw), r"(?<=\d)\.(?=\d)", "-")
    text = F.regexp_replace(text, r"([A-Za-z]+),\s*(\d{4})", "$1 $2")
    alone = F.regexp_extract(text, r"^([A-Za-z]+) (\d{4})$", 1)
    return F.coalesce(date_value(text), _month_day(alone, F.regexp_extract(text, r"^([A-Za-z]+) (\d{4})$", 2), F.lit("1")))


def unit(raw: Column) -> Column:
    """The code of a unit's spelling."""
    text = F.lower(F.trim(raw))
    found = F.coalesce(*[F.when(text.rlike(pattern), F.lit(code)) for code, pattern in UNITS.items()])
    return _result(found.isNotNull(), "unit", found, text=found)


def number(raw: Column) -> Column:
    """A number with an optional rupee sign and a Cr, Lakh, M or K at its end."""
    text = F.regexp_replace(F.regexp_replace(_clean(raw), r"₹|INR|Rs\.?", ""), ",", "")
    factor = F.when(text.rlike(r"Cr\.?$"), 10_000_000).when(text.rlike(r"(?:Lakh|Lacs|Lac)\.?$"), 100_000).when(text.rlike(r"\d\s*M$"), 1_000_000).when(text.rlike(r"\d\s*K$"), 1_000).otherwise(1)
    value = (decimal(F.regexp_replace(text, r"\s*(?:Cr|Lakh|Lacs|Lac|M|K)\.?$", "")) * factor.cast("decimal(10,0)")).cast(MONEY)
    return _result(value.isNotNull(), "number", number=value)


def currency(raw: Column) -> Column:
    """``number`` as whole rupees, half to even."""
    return F.bround(number(raw)["number"], 0).cast("long")


_IS_MONEY = r"(?i)(?:(?<![A-Za-z])(?:Rs\.?|INR|Rupees?)(?![A-Za-z])|₹|(?<![A-Za-z])(?:Cr|Crore|Lakh|Lac|M|K)(?![A-Za-z]))"
_IS_DATE = rf"{_DMY}|{_YMD}|{_MONTH_D_Y}|{_D_MONTH_Y}"


def infer(raw: Column) -> Column:
    """The first of money, percentage, date and number whose sign the text shows; a failure there is final."""
    return let(raw, _infer)


def _infer(raw: Column) -> Column:
    plain = decimal(raw)
    return (
        F.when(raw.isNull() | (F.trim(raw) == ""), _result(F.lit(False), "text"))
        .when(raw.rlike(_IS_MONEY), money(raw))
        .when(raw.rlike("(?i)%|percent"), percentage(raw))
        .when(raw.rlike(_IS_DATE), date(raw))
        .when(F.trim(raw).rlike(r"^-?[\d,]+(?:\.\d+)?$"), let(plain, lambda x: _result(x.isNotNull(), "number", number=x)))
        .otherwise(_result(F.lit(False), "text"))
    )
