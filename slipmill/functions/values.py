"""Numbers and dates out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipmill.functions.text import let

MONEY = "decimal(12,2)"


def number(c: Column) -> Column:
    """Digits, point and minus of a text as a number; null if they aren't one."""
    return F.regexp_replace(c, r"[^\d.\-]", "").try_cast("decimal(18,4)")


def grouped_number(c: Column) -> Column:
    """A number with commas between groups, or several points of which the last is the decimal one."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\d.\-]", ""), r"\.(?=.*\.)", "").try_cast("decimal(18,4)")


def repaired_number(c: Column) -> Column:
    """A number in which letters may stand for digits beside digits, or for all digits of an amount with two decimals; a
    text without such a place is null."""
    token = F.regexp_replace(F.upper(c), r"[\s,]", "")
    as_digits = grouped_number(F.translate(token, "OQDILZSBG", "000112586"))
    return F.when(token.rlike(r"^-?(?:[\dOQDILZSBG.]*\d[\dOQDILZSBG.]*|[OQDILZSBG]+\.[OQDILZSBG]{2})$"), as_digits)


def calendar_date(c: Column, short_years: bool = False, low: int = 2020, high: int = 2030) -> Column:
    """Day, month and year between slashes, dashes or points, if the year is in range; two-digit years if asked for."""

    def dated(parts: Column) -> Column:
        year = F.get(parts, F.lit(2)).try_cast("int")
        if short_years:
            year = F.when(F.length(year.cast("string")) == 2, year + 2000).otherwise(year)
        text = lambda y: F.concat_ws("-", F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int"), y)
        return F.when(F.size(parts) == 3, let(year, lambda y: F.when(y.between(low, high), F.try_to_timestamp(text(y), F.lit("d-M-yyyy")).cast("date"))))

    return let(c, lambda x: F.coalesce(*[F.when(x.contains(sep), let(F.split(x, f"{escape}{sep}"), dated)) for sep, escape in (("/", ""), ("-", ""), (".", "\\"))]))


def compact_date(c: Column) -> Column:
    """The first DDMMYYYY of a text."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(c, r"\b(\d{2}\d{2}20\d{2})\b", 1), F.lit("")), F.lit("ddMMyyyy")).cast("date")


#: What a deduction of each type is expected to be at most.
EXPECTED_MOST = {"Unloading": 150, "L/F Cash": 400, "Commission": 1000, "Less for Damages": 500, "Other": 500}


def deduction_scale(amount: Column, kind: str) -> Column:
    """An amount far above what its type is expected to be lost its decimal point: a hundredth or a tenth of it."""
    most = EXPECTED_MOST.get(kind, 1000)
    return F.when(amount < 100, amount).when(amount > 10 * most, amount / 100).when(amount > 5 * most, amount / 10).otherwise(amount)


def repaired_item(quantity: Column, price: Column, amount: Column) -> tuple[Column, Column]:
    """Price and amount after their decimal points were put right, swapped if they fit better that way."""
    price = F.when((price > 1000) & (amount < price * 0.1), price / 100).otherwise(price)
    expected = quantity * price
    amount = F.when((amount > 10000) & (amount > expected * 10), amount / 100).otherwise(amount)
    slack = F.greatest(expected * 0.25, F.lit(5))
    swap = (F.abs(amount - expected) > slack) & (F.abs(price - expected) <= slack)
    return F.when(swap, amount).otherwise(price), F.when(swap, price).otherwise(amount)


DATE_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy", "d-M-yy", "d.M.yy", "yyyy-M-d", "d MMM yyyy", "d MMMM yyyy", "ddMMyyyy")


def any_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The date of a text in the first format that fits it whole; two-digit years are of this century."""
    read = lambda x: F.when(x.isNotNull(), F.coalesce(*[F.try_to_timestamp(x, F.lit(f)).cast("date") for f in formats]))
    return let(F.initcap(F.trim(c)), read)


def region_number(c: Column, hundredths: bool = False) -> Column:
    """A number whose comma is a decimal one before one or two last digits, else a group's; if asked for, the last two
    of four digits or more without a point are decimals."""
    c = F.regexp_replace(F.regexp_replace(c, " ", ""), "[·•‚]", ".")
    c = F.when(~c.contains(".") & c.rlike(r",\d{1,2}$"), F.replace(c, F.lit(","), F.lit("."))).otherwise(F.replace(c, F.lit(",")))
    if hundredths:
        c = F.regexp_replace(c, r"^(\d{2,})(\d{2})$", "$1.$2")
    return c.try_cast("decimal(18,4)")
