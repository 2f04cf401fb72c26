"""More rule profiles beside v2 and quality: v1, adaptive, robust, enhanced, base, and one over the regions of a page.

A profile gives, for each head field, tries: values with a confidence. The surest that found something is taken, the
first of equals. Items and deductions come from lines; totals that are missing come from them. Null or empty text has
no field. Everything is a built-in expression over one row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmill.functions.text import first, keep_ascii, let, lines, once, replaced
from slipmill.functions.values import MONEY, any_date, calendar_date, number, region_number
from slipmill.operators.extract import ITEM, TOTAL_LINE, largest_amount, v2_items

FIELDS = ("voucher_number", "voucher_date", "supplier_name", "gross_total")
DMY = r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}"
TABLE_WORDS = r"(?i)\b(qty|price|amount|total)\b"
DEDUCTION = "array<struct<deduction_type:string,amount:decimal(12,2)>>"


def pick(*tries: tuple[Column, int | Column]) -> Column:
    """(confidence, ord, value) of the surest value that isn't null.

    With fixed confidences tries are made from the surest on, and those after the one that found something are not made.
    """
    if all(isinstance(c, int) for _, c in tries):
        row = lambda i, c: lambda v: F.when(v.isNotNull(), F.struct(F.lit(c).cast("int").alias("confidence"), F.lit(-i).alias("ord"), v.alias("value")))
        return F.coalesce(*[let(v, row(i, c)) for i, (v, c) in sorted(enumerate(tries), key=lambda x: -x[1][1])])
    made = [F.struct((F.lit(c) if isinstance(c, int) else c).cast("int").alias("confidence"), F.lit(-i).alias("ord"), v.alias("value")) for i, (v, c) in enumerate(tries)]
    return F.array_max(F.filter(F.array(*made), lambda s: s["value"].isNotNull()))


def head(found: Column) -> Column:
    return F.get(found, F.lit(0))


def first_of(ln: Column, f: Callable[..., Column]) -> Column:
    """What f gives for the first line for which it gives something; f takes a line, or a line and its index."""
    return head(F.filter(F.transform(ln, f), lambda x: x.isNotNull()))


def first_found(ln: Column, f: Callable[..., Column], kind: str) -> Column:
    """first_of(), for what f gives as `kind`: lines after the one for which it gives something aren't looked at."""
    return F.aggregate(ln, F.lit(None).cast(kind), lambda acc, x: F.coalesce(acc, f(x).cast(kind)))


def each(t: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern), F.lit(group))


def no_tail(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"[\d\W]+$", "")


def long_enough(c: Column, least: int = 2) -> Column:
    return F.when(F.length(c) >= least, c)


def not_a_date_part(n: Column, t: Column) -> Column:
    """n, unless the text has it beside a slash or dash with one or two more digits."""
    return F.when(~F.regexp_like(t, F.concat(F.lit(r"\d{1,2}[/-]"), n, F.lit("|"), n, F.lit(r"[/-]\d{1,2}"))), n)


def below(ln: Column, i: Column, avoid: str = TABLE_WORDS, most: int = 30) -> Column:
    """The line after i, if it can be a name."""
    x = F.get(ln, i + 1)
    return F.when(~x.rlike(avoid) & F.length(x).between(2, most) & ~x.rlike(r"^\d+$"), x)


def started(keyword: str) -> str:
    """A keyword that begins with a letter, with a class for that letter: Java passes by at once where it isn't."""
    return f"[{keyword[0]}]{keyword[1:]}"


def by_type(t: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], amount: str, low: float, high: float, change: Callable[[str, Column, Column], tuple[Column, Column]] | None = None, fits: Callable[[Column], Column] | None = None) -> Column:
    """One deduction of each type at most: the first amount in range after one of its keywords, on the keyword's line.

    change(kind, amount, whole match) gives type and amount to be kept; fits(amount) may reject more.
    """
    low_, high_ = F.lit(low).cast(MONEY), F.lit(high).cast(MONEY)
    made = []
    for kind, keywords in rules:
        found = []
        for k in keywords:
            pattern = rf"(?i){started(k)}.*?({amount})"
            read = lambda w: F.struct(F.replace(F.regexp_extract(w, pattern, 1), F.lit(",")).try_cast(MONEY).alias("a"), w.alias("w"))
            fit = lambda x: x["a"].between(low_, high_) & (fits(x["a"]) if fits else F.lit(True))
            found.append(head(F.filter(F.transform(each(t, pattern, 0), read), fit)))
        named = lambda got: (change(kind, got["a"], got["w"]) if change else (F.lit(kind), got["a"]))
        row = lambda got: F.when(got.isNotNull(), F.struct(named(got)[0].alias("deduction_type"), F.bround(named(got)[1], 2).cast(MONEY).alias("amount")))
        made.append(let(F.coalesce(*found), row))
    return F.array_compact(F.array(*made)).cast(DEDUCTION)


def added(found: Column, field: str) -> Column:
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0).cast("decimal(18,2)"), lambda acc, x: (acc + x[field]).cast("decimal(18,2)")).cast(MONEY))


# --- v1 --------------------------------------------------------------------------------------------------------


def v1_heads(t: Column, ln: Column) -> dict[str, Column]:
    early = F.slice(ln, 1, 15)
    label = F.array_position(F.transform(early, lambda x: F.replace(F.lower(x), F.lit(" ")).contains("vouchernumber")), True).cast("int")
    before = F.array_join(F.when(label > 0, F.slice(early, F.lit(1), F.greatest(label - 1, F.lit(0)))).otherwise(early), "\n")
    named = lambda p: long_enough(F.regexp_replace(no_tail(first(t, p)), r"(?i)\s*(?:qty|price|amount).*$", ""))

    def beside(x: Column, i: Column) -> Column:
        same = long_enough(no_tail(F.get(F.split(x, r"(?i)(?:nane|lane|name|ane)[:\s]*"), F.lit(1))))
        value = F.struct(F.coalesce(same, below(ln, i)).alias("v"), F.when(same.isNotNull(), 75).otherwise(70).alias("c"))
        return F.when(x.rlike(r"(?i)\b(nane|lane|name|ane)\b") & value["v"].isNotNull(), value)

    near = first_of(ln, beside)
    gross = F.array_max(F.filter(F.transform(each(t, r"(?im)[at](?:(?<=(?:^|[\st])a)l|(?<=(?:^|[\st])t)al)\s*(?:\d+|\?)?\s*(\d{1,5}\.\d{2})"), lambda x: x.cast(MONEY)), lambda x: x > 10))
    last = F.element_at(F.concat(F.array(F.lit(None).cast(MONEY)), F.filter(F.transform(each(t, r"\b(\d{3,5}\.\d{2})\b"), lambda x: x.cast(MONEY)), lambda x: x > 50)), -1)
    return {
        "voucher_number": pick(
            (first(t, r"(?i)[n](?<=(?:^|[\sr])n)u[mao]?ber[:\s]*(\d{2,4})"), 85),
            (head(F.filter(F.transform(each(before, r"\b(\d{2,4})\b"), lambda n: not_a_date_part(n, before)), lambda n: n.isNotNull())), 75),
            (head(F.filter(F.slice(ln, 1, 8), lambda x: x.rlike(r"^\d{3}$"))), 60),
        ),
        "voucher_date": pick(
            (calendar_date(first(t, r"(?i)r?date[\s:]*(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4})")), 90),
            (first_of(F.slice(ln, 1, 10), lambda x: calendar_date(first(x, r"(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4})"), low=1, high=9999)), 80),
        ),
        "supplier_name": F.coalesce(  # what stands near a label is less sure than what is beside it
            pick(
                (named(r"(?i)[nl](?:(?<=(?:^|[\sp])n)a[nm]e|(?<=(?:^|[\sp])l)ane)[\s:]*(.{2,30}?)(?=\n|$|qty|date|voucher)"), 80),
                (named(r"(?i)[an](?:(?<=(?:^|\s)a)ne|(?<=(?:^|\s)n)(?:m|an)e)[\s:]*(.{2,30}?)(?=\n|$|qty)"), 80),
            ),
            let(near, lambda s: F.when(s.isNotNull(), F.struct(s["c"].cast("int").alias("confidence"), F.lit(-2).alias("ord"), s["v"].alias("value")))),
        ),
        "gross_total": pick((gross, 75), (F.when(v1_said(t).isNull(), last), 75)),
    }


def v1_said(t: Column) -> Column:
    net = first(t, r"(?i)[gt](?:(?<=g)rand\s*total|(?<=t)otal)[\s:]*(\d{1,5}\.\d{2})").cast(MONEY)
    return F.when(net > 10, net)


V1_RULES = (
    ("Commission", ("comm", "comission", r"com?\s*\d")), ("Damage", ("damage", "damages", r"less\s*for\s*damage")), ("Unloading", ("unload", "unloading", "unld")), ("L/F Cash", (r"l[/\s]*f", r"lf\s+and\s+cash", "lfandcash")),
)


def v1_deductions(t: Column, ln: Column, gross: Column) -> Column:
    """A percent sign or an amount with 4.00 in it, of any type, stands for a commission of 4 %."""

    def change(kind: str, a: Column, whole: Column) -> tuple[Column, Column]:
        percent = gross.isNotNull() & (whole.contains("%") | a.cast("string").contains("4.00") | whole.contains("4.008"))
        return F.when(percent, "Commission @4.0%").otherwise(kind), F.when(percent, gross * F.expr("0.04BD")).otherwise(a)

    return by_type(t, V1_RULES, r"\d{1,5}\.?\d{0,2}", 0.1, 5000, change)


def v1_net(t: Column, gross: Column, ded: Column) -> Column:
    """What the total line says, unless it is off by more than 100 from gross less deductions."""
    near = lambda said, made: pick((F.when(F.coalesce(F.abs(made - said), F.lit(0)) <= 100, said), 70), (F.coalesce(made, said).cast(MONEY), F.when(said.isNull(), 50).otherwise(70)), (gross, 50))
    return let(v1_said(t), lambda said: let(gross - ded, lambda made: near(said, made)))


# --- adaptive --------------------------------------------------------------------------------------------------


def adaptive_heads(t: Column, ln: Column) -> dict[str, Column]:
    ok = lambda n: (F.length(n) <= 4) & ~n.try_cast("int").between(2020, 2030)
    numbers = lambda p: head(F.filter(each(t, p), ok))
    early = F.filter(F.slice(ln, 1, 5), lambda x: x.rlike("(?i)voucher|number|nuaber|nunber"))
    dated = lambda p: head(F.filter(F.transform(each(t, p), lambda x: calendar_date(x, short_years=True)), lambda d: d.isNotNull()))
    names = lambda p: head(F.filter(F.transform(each(t, p), no_tail), lambda x: F.length(x) >= 2))
    labelled = lambda x: x.rlike(r"(?i)\b(nane|name|nme)\b")
    totals = F.filter(F.transform(each(t, TOTAL_LINE, 2), lambda x: x.cast(MONEY)), lambda a: a.between(10, 100000))
    return {
        "voucher_number": pick(
            (numbers(r"(?i)voucher\s*(?:number|no|#)?[:\s]*(\d{2,4})\b"), 70), (numbers(r"(?i)(?:nuaber|nunber|nunmber|nuamber|number)[:\s]*(\d{2,4})\b"), 60),
            (numbers(r"(?i)\bv[\s.]*(?:no|num|#)?[:\s]*(\d{2,4})\b"), 60), (first_of(early, lambda x: head(F.filter(each(x, r"\b(\d{3,4})\b"), ok))), 50),
        ),
        "voucher_date": pick((dated(rf"(?i)voucherdate[:\s]*({DMY})"), 85), (dated(rf"(?i)(?:voucher\s*date|date)[:\s]*({DMY})"), 75), (dated(r"(\d{1,2}[/\-]\d{1,2}[/\-]20\d{2})"), 75)),
        "supplier_name": pick(
            (names(r"(?i)(?:supp\s*name|suppname|suppnane|suppnare)[:\s]*(.{2,30}?)(?=\n|$|qty|total|price)"), 80), (names(r"(?i)(?:supp|supplier)[:\s]*(.{2,30}?)(?=\n|$|qty)"), 80),
            (first_of(ln, lambda x: F.when(labelled(x), long_enough(no_tail(F.get(F.split(x, r"(?i)(?:nane|name|nme)[:\s]*"), F.lit(1)))))), 70),
            (names(r"(?i)name[:\s]*(.{2,30}?)(?=\n|$|qty|total|price)"), 65), (first_of(ln, lambda x, i: F.when(labelled(x), below(ln, i))), 60),
        ),
        "gross_total": pick((head(totals), 90), (largest_amount(t), 50)),
    }


ADAPTIVE_RULES = (("Commission", ("comm", "comission")), ("Damage", ("damage", "damages")), ("Unloading", ("unload", "unloading")), ("L/F Cash", (r"l[/\s]*f", "lfandcash")))


def adaptive_deductions(t: Column, ln: Column, gross: Column) -> Column:
    """At most half of gross; a commission under 100 stands for 4 % of gross."""

    def change(kind: str, a: Column, _: Column) -> tuple[Column, Column]:
        share = gross.isNotNull() & (a < 100) if kind == "Commission" else F.lit(False)
        return F.when(share, "Commission @4%").otherwise(kind), F.when(share, gross * F.expr("0.04BD")).otherwise(a)

    return by_type(t, ADAPTIVE_RULES, r"\d{1,5}\.?\d{0,2}", 0.1, 5000, change, lambda a: F.coalesce(a * 2 <= gross, F.lit(True)))


# --- robust ----------------------------------------------------------------------------------------------------

ROBUST_NUMBERS = (
    r"(?i)[v](?:oucher|ouch|ou|ouc)\s*(?:no|num|number|#)?[:\s]*#?(\d{3,})", r"(?i)[v](?:ou)?[.\s]*(?:no|number)?[:\s]*(\d{3,})", r"(?i)(?:bill|invoice|receipt)\s*(?:no|number)?[:\s]*(\d{3,})",
    r"(?i)\b(?:no|#)[:\s]*(\d{3,})\b", r"(?i)[v](?:oucher\s*number|oucher\s*no)[:\s]*(\d{3,})",
)
ROBUST_DATES = (
    r"(?i)[d](?:ate|ated|t)[:\s]*(\d{1,2}[\-/.\s]\d{1,2}[\-/.\s]\d{2,4})", r"(?i)[d](?:ate|ated)[:\s]*(\d{1,2}[\-/.\s]\w+[\-/.\s]\d{2,4})", r"(\d{1,2}[\-/.\s]\d{1,2}[\-/.\s]\d{4})", r"(\d{1,2}[\-/.\s]\d{1,2}[\-/.\s]\d{2})", r"(\d{8})",
)
ROBUST_SUPPLIERS = (r"(?i)[s](?:upp|upplier|up)[.\s]*(?:name|nam|nm)?[:\s]*(.{3,50})", r"(?i)[s](?:upp|upplier)[:\s]*(.{3,50})", r"(?i)(?:from|sold\s*by)[:\s]*(.{3,50})")
ROBUST_AMOUNTS = (
    r"(?i)[ta](?:(?<=t)ot(?:al)?|(?<=a)mount|(?<=a)mt)[:\s]*([\d,]+\.?\d{0,2})", r"(?i)[gn](?:(?<=g)rand\s*total|(?<=n)et\s*total|(?<=g)ross)[:\s]*([\d,]+\.?\d{0,2})",
    r"(?i)[r₹](?:(?<=r)s\.?|(?<=₹))\s*([\d,]+\.?\d{0,2})", r"(?i)[t](?<=\bt)otal\b.*?([\d,]+\.\d{2})",
)


def robust_amounts(t: Column) -> Column:
    """All amounts after a label, and those of three digits or more with decimals; the largest first."""
    read = lambda p, least: F.filter(F.transform(each(t, p), lambda x: F.replace(x, F.lit(",")).try_cast(MONEY)), lambda a: a > least)
    return F.sort_array(F.concat(*[read(p, 0) for p in ROBUST_AMOUNTS], read(r"(\d(?<=\b\d)\d{2,}\.\d{2})\b", 10)), asc=False)


def robust_heads(t: Column, ln: Column) -> dict[str, Column]:
    fits = lambda n: F.length(n) <= 20
    dates = lambda p, marked: head(F.filter(F.transform(F.filter(each(t, p), lambda x: x.rlike("[/-]") == marked), lambda x: any_date(x)), lambda d: d.isNotNull()))
    titled = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w.rlike(r"^\p{Lu}"))) >= F.size(F.split(x, r"\s+")) * 0.7
    return {
        "voucher_number": pick(
            *[(head(F.filter(each(t, p), fits)), 100) for p in ROBUST_NUMBERS],
            (head(F.filter(F.transform(F.slice(each(t, r"\b(\d{3,6})\b"), 1, 5), lambda n: F.when(n.cast("int") < 100000, not_a_date_part(n, t))), lambda n: n.isNotNull())), 40),
        ),
        "voucher_date": pick(*[(dates(p, True), 90) for p in ROBUST_DATES], *[(dates(p, False), 80) for p in ROBUST_DATES]),
        "supplier_name": pick(
            *[(long_enough(no_tail(first(t, p))), 75) for p in ROBUST_SUPPLIERS],
            (head(F.filter(F.slice(ln, 1, 5), lambda x: ~x.rlike(r"(?i)^(date|voucher|bill|invoice|no|#)") & F.length(x).between(3, 50) & ~x.rlike(r"^\d+$"))), 50),
            (head(F.filter(ln, lambda x: F.size(F.split(x, r"\s+")).between(2, 6) & titled(x) & ~x.rlike(r"\d"))), 35),
        ),
        "gross_total": pick((F.get(robust_amounts(t), F.lit(1)), 65)),
    }


ROBUST_RULES = (
    ("Commission", ("comm", "comission", "com", r"comm\.", "commission")), ("Damage", ("damage", "dmg", "damages", "less for damage")), ("Unloading", ("unload", "unloading", "unld", "loading")),
    ("Lf Cash", ("l/f", "lf", "l/f and cash", "cash")), ("Other", ("other", "misc", "miscellaneous")),
)


def robust_deductions(t: Column, ln: Column, gross: Column) -> Column:
    return by_type(t, ROBUST_RULES, r"[\d,]+\.?\d{0,2}", 0.01, 9_999_999_999)


def robust_items(t: Column, ln: Column) -> Column:
    """Name, quantity, price and amount, wherever they follow one another in the text."""
    pattern = r"(.{3,40})\s+(\d{1,5})\s+(\d+\.?\d{0,2})\s+(\d+\.?\d{0,2})"
    # The text is looked through once; a match has its groups where it stands alone, too, since nothing around it counts.
    part = lambda x, g: F.regexp_extract(x, pattern, g)
    return F.transform(each(t, pattern, 0), lambda x: F.struct(F.trim(part(x, 1)).alias("item_name"), part(x, 2).try_cast("decimal(10,2)").alias("quantity"), part(x, 3).try_cast("decimal(10,2)").alias("unit_price"), part(x, 4).try_cast(MONEY).alias("line_amount")))


def robust_net(t: Column, gross: Column, ded: Column) -> Column:
    return pick((head(robust_amounts(t)), 70))


# --- enhanced --------------------------------------------------------------------------------------------------

LABELS = (
    (r" +", " "), (r"(?i)\bvouc[hn]?er\b", "Voucher"), (r"(?i)\bsupp\.?\s*name\b", "Supp Name"), (r"(?i)\bdate[\s:&&[^\n]]*", "Date "), (r"(?i)\btotal\b", "Total"),
    *[(rf"{a}(?=\d|\s*[=:]\s*\d)", b) for a, b in (("O", "0"), ("l", "1"), ("I", "1"), ("S", "5"), ("B", "8"), ("Z", "2"))],
)


def canonical_labels(c: Column) -> Column:
    """Labels in one spelling, and digits for letters that stand before digits."""
    return replaced(c, LABELS)


def enhanced_heads(t: Column, ln: Column) -> dict[str, Column]:
    numbers = (
        (r"(?im)(?:voucher|vouch|vou|v\.?)[\s#:]*(?:no|num|number)?[\s#:]*(\d{3,10})(?!\d)", 90), (r"(?im)vouchernumber\s*(\d{3,10})(?!\d)", 85), (r"(?im)(?:no\.?|#)\s*:?\s*(\d{3,10})(?!\d)", 75),
        (r"(?im)(?:bill|inv|voucher|receipt|no)[:\s]*(\d{3,10})(?!\d)", 65), (r"(?im)^\s*(\d{3,5})\s*$", 50),
    )
    early = lambda p: F.when(F.regexp_instr(t, F.lit(p)) - 1 < F.length(t) * 0.3, 10).otherwise(0)
    section = F.regexp_extract(t, r"(?i)(?:date|dated)[\s:]*(.*?)(?:\n|$)", 1)
    labelled = t.rlike(r"(?i)(?:date|dated)[\s:]*(.*?)(?:\n|$)")
    part = F.when(labelled, section).otherwise(t)
    base = F.when(labelled, 80).otherwise(70)
    dates = ((r"(\d{1,2}[\-/]\d{1,2}[\-/]\d{4})", 5), (r"(\d{1,2}[\-/]\d{1,2}[\-/]\d{2})", 0), (r"(\d{4}[\-/]\d{1,2}[\-/]\d{1,2})", 0), (r"(\d{1,2}\.\d{1,2}\.\d{4})", 0), (r"(?i)(\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4})", 0))
    formats = ("d-M-yyyy", "d-M-yy", "yyyy-M-d", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy")
    read = lambda p: first_of(each(part, p), lambda x: (lambda d: F.when(F.year(d) >= 2000, d))(any_date(F.regexp_replace(F.regexp_replace(x, "/", "-"), r"\s+", " "), formats)))
    avoid = r"(?i)\b(date|voucher|no|total|amount)\b"
    names = (r"(?i)(?:supp\.?|supplier)[\s:]*(?:name|nm)?[\s:]*(.{2,60}?)(?=\n|$|date|voucher)", r"(?i)(?:from|sold by)[:\s]*(.{2,60}?)(?=\n|$)")

    def beside(x: Column, i: Column) -> Column:
        same = F.trim(F.substring_index(x, ":", -1))
        same = F.when(x.contains(":") & ~same.rlike(r"^\d+$"), long_enough(same))
        value = F.struct(F.coalesce(same, F.when(i > 0, below(ln, i - 2, avoid, 50)), below(ln, i, avoid, 50)).alias("v"), F.when(same.isNotNull(), 75).otherwise(70).alias("c"))
        return F.when(x.rlike(r"(?i)\bsupp") & value["v"].isNotNull(), value)

    near = first_of(ln, beside)
    company = head(F.filter(F.slice(ln, 1, 5), lambda x: (x == F.upper(x)) & (x != F.lower(x)) & F.length(x).between(3, 40) & ~x.rlike("(?i)date|voucher|total|amount|no")))
    return {
        "voucher_number": pick(*[(first(t, p), F.least(F.lit(95), c + early(p))) for p, c in numbers]),
        "voucher_date": pick(*[(read(p), base + more) for p, more in dates], (any_date(first(part, r"\b(\d{8})\b"), ("ddMMyyyy",)), 60)),
        "supplier_name": pick(*[(long_enough(F.trim(no_tail(first(t, p)))), 80) for p in names], (near["v"], near["c"]), (F.initcap(F.lower(company)), 50)),
        "gross_total": let(enhanced_totals(t), lambda found: pick((found["gross"], 70), (found["net"], 50))),
    }


def enhanced_totals(t: Column) -> Column:
    """(net, gross) of amounts by the words within 50 characters; else the largest, and the next above half of it."""
    money = r"\b(\d{1,6}\.\d{2})\b"
    pieces = F.split(t, r"(?<![\w])(?=\d{1,6}\.\d{2}\b)")
    starts = F.aggregate(pieces, F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array((F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), acc), -1), F.lit(0)) + F.length(p)).cast("int"))))
    at = F.filter(F.transform(F.concat(F.array(F.lit(0)), starts), lambda s: F.struct(first(F.substring(t, s + 1, F.lit(9)), "^" + money).try_cast(MONEY).alias("a"), (-s).alias("s"), F.lower(F.substring(t, F.greatest(s - 49, F.lit(1)), F.lit(50) + F.least(s, F.lit(50)))).alias("near"))), lambda x: x["a"].isNotNull())
    is_net = lambda x: x["near"].rlike("grand total|net total|net amount|payable")
    net_of = lambda r: F.coalesce(head(F.filter(r, is_net)), head(F.filter(F.slice(r, 1, 5), lambda x: x["near"].contains("total") | (x["a"] > 100))), head(r))["a"]
    gross_of = lambda r, net: F.coalesce(head(F.filter(r, lambda x: ~is_net(x) & x["near"].rlike("gross|sub total|subtotal|total amount"))), head(F.filter(F.slice(r, 2, 4), lambda x: (x["a"] < net) & (x["a"] > net * 0.5))))["a"]
    return let(F.sort_array(at, asc=False), lambda r: let(net_of(r), lambda net: F.struct(net.alias("net"), gross_of(r, net).alias("gross"))))


ENHANCED_RULES = (("Commission", ("comm", "comission")), ("Damage", ("damage", "damages", "less for damage")), ("Unloading", ("unload", "unloading")), ("L/F Cash", (r"l[/\s]*f", "cash")), ("Other", ("other", "misc")))


def enhanced_deductions(t: Column, ln: Column, gross: Column) -> Column:
    return by_type(t, ENHANCED_RULES, r"\d+\.?\d*", 0.01, 99999.99)


def enhanced_items(t: Column, ln: Column) -> Column:
    """Lines whose last three numbers multiply, within 1 or a twentieth; the rest is the name, of two letters at least."""

    def one(x: Column) -> Column:
        n = each(x, r"\b(\d+\.?\d*)\b")
        part = lambda k: F.get(n, F.size(n) - k).try_cast("decimal(12,2)")
        name = F.trim(F.regexp_replace(F.regexp_replace(x, r"(?:\b\d+\.?\d*\b\D*){3}$", ""), r"[^\w\s]", ""))
        return F.when(F.size(n) >= 3, F.struct(name.alias("item_name"), part(3).cast("decimal(10,2)").alias("quantity"), part(2).cast("decimal(10,2)").alias("unit_price"), part(1).cast(MONEY).alias("line_amount")))

    off = lambda i: F.abs(i["line_amount"] - i["quantity"] * i["unit_price"])
    return F.filter(F.transform(ln, one), lambda i: (F.length(i["item_name"]) >= 2) & ((off(i) < 1) | (off(i) < F.greatest(i["line_amount"], F.lit(1)) * 0.05)))


def enhanced_net(t: Column, gross: Column, ded: Column) -> Column:
    return pick((enhanced_totals(t)["net"], 75), ((gross - ded).cast(MONEY), 60), (gross, 55))


# --- base ------------------------------------------------------------------------------------------------------

BASE_LABELS = r"(?i)Total|Amount|Price|Qty|Voucher|Date|Supp"


def base_heads(t: Column, ln: Column) -> dict[str, Column]:
    def named(at: Column) -> Column:
        x, i = at["x"], at["i"]
        value = F.regexp_replace(F.trim(first(x, r"(?i)Supp\s*(?:Name|Nam[3e])?\s*[:\-\s]\s*(.+)")), r"(?i)^None\s+", "")
        beside = F.coalesce(F.when(i > 0, below(ln, i - 2, r"(?i)^(?:Total|Qty|Price|Amount|Date|Voucher|Phone)", 100)), below(ln, i, r"(?i)^(?:Total|Qty|Price|Amount|Supp|Date|Voucher)", 100))
        return F.coalesce(F.nullif(value, F.lit("")), F.when(x.rlike(r"(?i)^Supp\s*(?:Name|Nam[3e])?\s*$"), beside))

    numbered = F.transform(ln, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    label = r"(?i)(?:Date|DATED|Dt)\s*[:\-]?\s*([\d/.\-]+)"
    gross = lambda x: F.coalesce(number(first(x, r"(?i)(?:Gross\s*Total|Gross|Sub\s*Total)\s*[:\-]?\s*([0-9,.]+)")), F.when(x.rlike(r"(?i)^Total\s*[:\-]?\s*\d*\s*[0-9,.]+") & ~x.rlike("(?i)Grand"), (lambda n: F.when(n > 10, n))(number(first(x, r"\s(\S+)$")))))
    return {
        "voucher_number": pick((first_found(ln, lambda x: F.coalesce(*[first(x, p) for p in (r"(?i)VoucherNumber(\d+)", r"(?i)(?:Voucher|Invoice|Bill|Vouch|Inv)\s*(?:No|Number|Num|#)?\s*[:\-]?\s*#?(\d+)", r"(?i)No\s*[:\-.]\s*(\d{3,})")]), "string"), 70)),
        "voucher_date": pick((first_found(ln, lambda x: any_date(F.when(x.rlike(label), first(x, label)).otherwise(first(x, rf"({DMY})"))), "date"), 70)),
        "supplier_name": pick((first_found(numbered, named, "string"), 70)),
        "gross_total": pick((first_found(F.reverse(ln), gross, "decimal(18,4)").cast(MONEY), 70)),  # the last one
    }


def vendor(ln: Column, words: str = "Store|Traders|Bros|Company|Ltd|Ent|Sons") -> Column:
    """The first of five lines that is a business's name: in capitals, or with a word of such names."""
    return head(F.filter(F.slice(ln, 1, 5), lambda x: (F.length(x) > 4) & ~x.rlike(r"(?i)Date|Voucher|Inv|No\.|^\d+$") & ((x == F.upper(x)) & (x != F.lower(x)) | x.rlike(f"(?i){words}"))))


def in_deductions(ln: Column, start: str = r"(?i)^(?:Less|Deductions?|Ded|\(-\))") -> Column:
    """By line: whether a deduction section began, on it or before, and no net or grand total came since."""
    places = lambda p: F.filter(F.transform(ln, lambda x, i: F.when(x.rlike(p), i)), lambda i: i.isNotNull())
    last = lambda found, i: F.coalesce(F.array_max(F.filter(found, lambda k: k <= i)), F.lit(-1))
    at = F.struct(places(start).alias("begins"), places(r"(?i)Net\s*Total|Grand\s*Total").alias("ends"))
    return let(at, lambda p: F.transform(ln, lambda x, i: last(p["begins"], i) > last(p["ends"], i)))


def base_deductions(t: Column, ln: Column, gross: Column) -> Column:
    """The last number of each line in the section, under what stands before it."""

    def one(x: Column, inside: Column) -> Column:
        x = F.trim(F.replace(x, F.lit("(-)"), F.lit("")))
        percent = number(first(x, r"(?i)Comm.*?(\d+\.?\d*)\s*%"))
        label, amount = F.trim(F.regexp_extract(x, r"^(.*)\s\S+$", 1)), number(F.regexp_extract(x, r"(\S+)$", 1))
        known = label.rlike(r"(?i)Comm|Damages?|Unloading|L\s*/?\s*F|Cash|Tax|VAT|Discount|Fee|Charge|Other")
        share = percent.isNotNull() & gross.isNotNull()
        name = F.when(share, F.concat(F.lit("Commission @ "), percent.cast("double").cast("string"), F.lit("%"))).when(known | (F.length(label) >= 3), label).otherwise("Other")
        value = F.when(share, gross * percent / 100).otherwise(amount)
        return F.when(inside & value.isNotNull(), F.struct(name.alias("deduction_type"), F.bround(value, 2).cast(MONEY).alias("amount")))

    return F.array_compact(F.zip_with(ln, in_deductions(ln), one)).cast(DEDUCTION)


def base_items(t: Column, ln: Column) -> Column:
    """Lines outside the section, without a label, that end in quantity, price and amount; a name may stand before."""
    n = r"(\d{1,6}(?:[,.]?\d{1,6})?)"
    pattern = rf"^(.*?)\s*(?<!\S){n}\s+{n}\s+([0-9,.]+)$"

    def one(x: Column, inside: Column) -> Column:
        part = lambda g: number(first(x, pattern, g))
        row = F.struct(F.coalesce(F.trim(first(x, pattern, 1)), F.lit("Item")).alias("item_name"), part(2).cast("decimal(10,2)").alias("quantity"), part(3).cast("decimal(10,2)").alias("unit_price"), part(4).cast(MONEY).alias("line_amount"))
        return F.when(~inside & ~x.rlike(BASE_LABELS) & (part(4) > 0), row)

    return F.array_compact(F.zip_with(ln, in_deductions(ln), one))


def base_net(t: Column, gross: Column, ded: Column) -> Column:
    said = F.transform(each(t, r"(?i)[npg](?:(?<=n)et\s*(?:Total|Amount|Payable)|(?<=p)ayable|(?<=g)rand\s*Total)[ \t]*[:\-]?[ \t]*([0-9,.]+)"), lambda x: number(x).cast(MONEY))
    return pick((head(F.reverse(said)), 70), ((gross - ded).cast(MONEY), 60), (gross, 55))


def computed_net(t: Column, gross: Column, ded: Column) -> Column:
    return pick(((gross - F.coalesce(ded, F.lit(0))).cast(MONEY), 70))


#: Of each profile: cleaning, head fields, items, deductions, net total.
PROFILES = {
    "v1": (lambda c: c, v1_heads, lambda t, ln: v2_items(ln, 0.05), v1_deductions, v1_net),
    "adaptive": (lambda c: c, adaptive_heads, lambda t, ln: v2_items(ln, 0.1), adaptive_deductions, computed_net),
    "robust": (lambda c: c, robust_heads, robust_items, robust_deductions, robust_net),
    "enhanced": (canonical_labels, enhanced_heads, enhanced_items, enhanced_deductions, enhanced_net),
    "base": (lambda c: c, base_heads, base_items, base_deductions, base_net),
}


def extract(docs: DataFrame, profile: str, heads_only: bool = False) -> DataFrame:
    """docs (voucher_id, raw_ocr_text, ...) with the profile's fields: values, items, deductions, confidences.

    A gross total that isn't found is the items' sum. `overall` weighs the mean of the four head fields' confidences
    with 0.6 and the least of them with 0.4. With heads_only the same values of the head fields, of gross and net total
    and `overall` are given alone: items and deductions are made where a total needs them.
    """
    clean, heads, items, deductions, net = PROFILES[profile]
    t, ln = F.col("_t"), F.col("_ln")
    docs = once(once(docs, {"_t": clean(F.coalesce("raw_ocr_text", F.lit("")))}), {"_ln": lines(t)})
    if heads_only:
        docs = once(docs, {f"_{f}": v for f, v in heads(t, ln).items()})
        summed = lambda rows, field: let(rows, lambda found: added(found, field))
        docs = once(docs, {"gross_total": F.coalesce(F.col("_gross_total.value"), summed(items(t, ln), "line_amount")).cast(MONEY)})
        docs = once(docs, {"_net": net(t, F.col("gross_total"), summed(deductions(t, ln, F.col("gross_total")), "amount"))})
        four = [F.coalesce(F.col(f"_{f}.confidence"), F.lit(0)) for f in FIELDS]
        made = {f: F.col(f"_{f}.value") for f in FIELDS[:3]} | {"net_total": F.col("_net.value"), "overall": (sum(four[1:], four[0]) / 4 * 0.6 + F.least(*four) * 0.4).cast("double")}
        return docs.withColumns(made).drop("_t", "_ln", "_net", *[f"_{f}" for f in FIELDS])
    docs = once(docs, {f"_{f}": v for f, v in heads(t, ln).items()} | {"items": items(t, ln), "vendor_details": vendor(ln)})
    gross = F.coalesce(F.col("_gross_total.value"), added(F.col("items"), "line_amount"))
    docs = docs.withColumns({f: F.col(f"_{f}.value") for f in FIELDS[:3]} | {"gross_total": gross.cast(MONEY)})
    docs = once(docs, {"deductions": deductions(t, ln, F.col("gross_total"))})
    docs = docs.withColumn("total_deductions", added(F.col("deductions"), "amount"))
    docs = once(docs, {"_net": net(t, F.col("gross_total"), F.col("total_deductions"))})
    sure = {f: F.coalesce(F.col(f"_{f}.confidence"), F.lit(0)) for f in FIELDS}
    n, d = F.size("items"), F.size("deductions")
    more = {"net_total": F.coalesce("_net.confidence", F.lit(0)), "items": F.when(n > 0, F.least(F.lit(90), n * 25)).otherwise(20), "deductions": F.when(d > 0, F.least(F.lit(85), d * 40)).otherwise(30)}
    four = list(sure.values())
    docs = docs.withColumns({
        "net_total": F.col("_net.value"), "confidence": F.create_map(*[x for f, c in (sure | more).items() for x in (F.lit(f), c)]),
        "overall": (sum(four[1:], four[0]) / 4 * 0.6 + F.least(*four) * 0.4).cast("double"),
    })
    return docs.drop("_t", "_ln", "_net", *[f"_{f}" for f in FIELDS])


# --- regions ---------------------------------------------------------------------------------------------------


def region_fields(docs: DataFrame) -> DataFrame:
    """docs with fields out of the texts of page regions: header_text, deductions_text, totals_text."""
    h, d, s = (lines(keep_ascii(F.coalesce(c, F.lit("")))) for c in ("header_text", "deductions_text", "totals_text"))
    date = r"(?i)Voucher\s*(?:Dated|Date|Dt)?\s*[:\-.]?\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2})"
    said = r"(?i)Supp\s*(?:Name)?\s*[:\-\s]\s*(.+)"
    last = lambda x: region_number(first(x, r"([\d,]+(?:[.,]\d{1,2})?)$"))
    total = lambda p: head(F.filter(F.transform(s, lambda x: F.when(x.rlike(p), last(x))), lambda n: n.isNotNull())).cast(MONEY)

    def deduction(x: Column) -> Column:
        label = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(x, r"^(.*?)\s*[:\-\s]\s*[\d,]+(?:[.,]\d{1,2})?$", 1), r"[?()\[\]]", " "), r"(?:\s+\d+(?:[.,]\d+)?%?)+\s*$", ""))
        amount = region_number(first(x, r"[:\-\s]\s*([\d,]+(?:[.,]\d{1,2})?)$"), hundredths=True)
        return F.when(amount.isNotNull(), F.struct(label.alias("deduction_type"), amount.cast(MONEY).alias("amount")))

    return docs.withColumns({
        "vendor_details": head(F.filter(h, lambda x: (F.length(x) > 4) & ~x.rlike(r"(?i)Date|Voucher|Supp|Phone|GST|Inv|No\.|:") & ((x == F.upper(x)) & (x != F.lower(x)) | x.rlike("(?i)Bros|Traders|Company|Ltd|Enterprises|Sons|Agent|Agency|Services")))),
        "voucher_number": first_of(h, lambda x: first(x, r"(?i)Voucher\s*(?:Number|No|#)?\s*[:\-.]?\s*#?\s*(\d+)")),
        "voucher_date": first_of(h, lambda x: any_date(first(x, date))),
        "supplier_name": first_of(h, lambda x: F.when(x.rlike(r"(?i)(?:M/s|Mr\.|Mrs\.|Shri|Sri)\b"), x).otherwise((lambda v: F.when(~v.contains("COMM AGENT"), v))(F.trim(first(x, said))))),
        "deductions": F.array_compact(F.transform(d, deduction)).cast(DEDUCTION),
        "net_total": total(r"(?i)Net|Grand"), "gross_total": total(r"(?i)Gross|Sub\s*Total|^Total"),
    })


def region_items(text: Column) -> Column:
    """Items out of a region's lines: the last number is the amount, the two before it price and quantity.

    Of two numbers the first is the price if it is 1, a quantity if the amount is a multiple of it (within a hundredth),
    else the price. The name is what stands before the first digit. Lines that begin with a column's title are left out.
    """
    title = r"(?i)^(?:Qty|Price|Amount|Item|Name|Total|Particulars)"

    def one(x: Column) -> Column:
        found = each(x, r"([\d,]+(?:[.,]\d{1,2})?)")
        n = F.size(found)
        at = lambda back, hundredths=True: region_number(F.get(found, n - back), hundredths)
        amount, other = at(1), F.when(n >= 2, at(2))
        single = F.abs(other * amount - amount) < 0.01
        counted = ~single & (other != 0) & (F.abs(F.try_mod(amount / other, F.lit(1))) < 0.01)
        quantity = F.when(n >= 3, at(3, False)).when((n == 2) & counted, other)
        price = F.when((n == 2) & counted, F.try_divide(amount, other)).otherwise(other)
        name = F.trim(F.regexp_extract(x, r"^([^\d]*)", 1))
        row = F.struct(F.when(F.length(name) >= 2, name).otherwise("Item").alias("item_name"), quantity.cast("decimal(10,2)").alias("quantity"), price.cast("decimal(10,2)").alias("unit_price"), amount.cast(MONEY).alias("line_amount"))
        return F.when(~x.rlike(title) & (amount > 0), row)

    return F.array_compact(F.transform(lines(keep_ascii(F.coalesce(text, F.lit("")))), one))
