"""Fields out of voucher text, by rule profiles. A strategy is an expression; a profile orders them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmill.functions.text import first, fix_global, let, lines, once, shared
from slipmill.functions.values import MONEY, calendar_date, compact_date, deduction_scale, repaired_item

# Patterns that are looked for in whole texts begin with a class, even of one letter: where it isn't, Java passes by at once,
# while words in both cases or alternatives of them are compared at every character.
NUMBER_PATTERNS = (r"[v]oucher\s*n(?:umber|o)[\s:]*(\d{2,4})\b", r"[n](?:u[a-z]*ber|o)[\s:]*(\d{2,4})\b", r"[n#](?:(?<=n)um(?:ber)?|(?<=#))[\s:]*(\d{2,4})\b")
NO_DATE_FOLLOWS = r"(?![\s\S]{0,19}[/\-])"
DATE = r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}"
TOTAL_LINE = r"(?im)[ot](?:(?<=(?:^|[\st])o)tal|(?<=(?:^|[\st])t)al)\s*(\d+)\s*(\d{1,5}\.\d{2})"
NET_LINE = r"(?i)[gn](?:(?<=g)rand|(?<=n)et)[\s\w]*total[\s:]*(-?\d{1,7}(?:\.\d{2})?)"


def _line(found: Column) -> Column:
    return F.get(found, F.lit(0))


def _clean_tail(c: Column) -> Column:
    return F.regexp_replace(c, r"[\d\W]+$", "")


# --- profile v2 ------------------------------------------------------------------------------------------------


def v2_number(t: Column) -> Column:
    ok = lambda x: ~x.cast("int").between(2020, 2030)
    return F.coalesce(*[_line(F.filter(F.regexp_extract_all(t, F.lit(f"(?i){p}{NO_DATE_FOLLOWS}"), F.lit(1)), ok)) for p in NUMBER_PATTERNS])


def v2_dates(t: Column, ln: Column) -> tuple[Column, Column]:
    """The date beside its label, and the first one in the first lines."""
    labelled = F.coalesce(*[calendar_date(first(t, p)) for p in (rf"(?i)[v]oucher\s*date[\s:]*({DATE})", rf"(?i)[d](?<=\bd)ate[\s:]*({DATE})")])
    general = _line(F.filter(F.transform(F.slice(ln, 1, 10), lambda x: calendar_date(first(x, r"(\d{1,2}/\d{1,2}/\d{4})"))), lambda x: x.isNotNull()))
    return labelled, general


def v2_suppliers(t: Column, ln: Column, has_date: Column) -> tuple[Column, Column, Column]:
    """The supplier beside its label in the text, the one by lines with its confidence, and the one after the date."""
    patterns = (
        r"(?i)[s]upp(?:\s*name|nane|nare)[\s:]*(.{2,30}?)(?=\n|$|qty|total)",
        r"(?i)[s]upp[\s:]*(.{2,30}?)(?=\n|$|qty)",
        r"(?i)[n](?:a[nrm])?e[\s:]*([A-Z]{2,30}(?:/[A-Z])?)(?=\n|$|qty)",
    )
    fits = lambda c: let(c, lambda x: F.when(F.length(x) >= 2, x))
    label = F.coalesce(*[fits(_clean_tail(F.trim(first(t, p)))) for p in patterns])
    labelled = r"(?i)supp\s*(?:name|nane|nare)"

    def beside(x: Column, i: Column) -> Column:
        """Of a line with the label: what follows on it, else the next line; with its confidence."""
        same = F.when(x.contains(":") | (F.size(F.split(x, r"\s+")) > 2), fits(_clean_tail(F.trim(F.get(F.split(x, labelled + r"[:\s]*"), F.lit(1))))))
        below = F.get(ln, i + 1)
        below = F.when(~below.rlike(r"(?i)\b(qty|price|amount|total)\b") & F.length(below).between(2, 30) & ~below.rlike(r"^\d+$"), below)
        return F.when(x.rlike(labelled), let(same, lambda s: F.struct(F.coalesce(s, below).alias("value"), F.when(s.isNotNull(), 75).otherwise(70).alias("confidence"))))

    near = _line(F.filter(F.transform(ln, beside), lambda s: s["value"].isNotNull()))
    at = F.array_position(F.transform(ln, lambda x: x.rlike(DATE)), True).cast("int")
    after = F.transform(F.slice(ln, F.greatest(at, F.lit(1)) + 1, F.lit(2)), lambda x: F.regexp_replace(x, r"^[a-z]{1,2}\s+", ""))
    upper = lambda x: (x == F.upper(x)) & (x != F.lower(x))
    placed = F.when(has_date & (at > 0), _line(F.filter(after, lambda x: ~x.rlike(r"(?i)\b(qty|price|amount|total|comm)\b") & F.length(x).between(2, 30) & (upper(x) | x.contains("/")))))
    return label, near, placed


def largest_amount(t: Column) -> Column:
    return F.array_max(F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"\b(\d{3,5}\.\d{2})\b"), F.lit(1)), lambda x: x.cast(MONEY)), lambda x: x.between(50, 100000)))


ITEM = r"(\d{1,3})\s+(\d{1,5}\.\d{2})\s+(\d{1,5}\.\d{2})"


def v2_items(ln: Column, share: float = 0.1) -> Column:
    """Lines of quantity, price and amount that multiply, within 1 or a share of the amount."""

    def one(x: Column) -> Column:
        part = lambda g: first(x, ITEM, g)
        name = F.regexp_replace(F.trim(F.regexp_extract(x, rf"^(.*?){ITEM}", 1)), r"^[^a-zA-Z]*", "")
        return F.struct(
            F.coalesce(F.nullif(name, F.lit("")), F.lit("Item")).alias("item_name"), part(1).cast("decimal(10,2)").alias("quantity"), part(2).cast("decimal(10,2)").alias("unit_price"), part(3).cast(MONEY).alias("line_amount")
        )

    def fits(i: Column) -> Column:
        off = F.abs(i["line_amount"] - i["quantity"] * i["unit_price"])
        return (off < 1) | (off < F.greatest(i["line_amount"], F.lit(1)) * share)

    return F.filter(F.transform(F.filter(ln, lambda x: x.rlike(ITEM)), one), fits)


V2_DEDUCTIONS = (("Commission", ("[c]omm", "[c]omission")), ("Damage", ("[d]amage", "[d]amages")), ("Unloading", ("[u]nload", "[u]nloading")), ("L/F Cash", (r"[l][/\s]*f", r"[l]f\s+and\s+cash")))


def v2_deductions(docs: DataFrame, t: Column, gross: Column) -> DataFrame:
    """docs with deductions, one of each type at most: the first keyword with an amount from 0.1 to 500 after it on its line.

    A keyword is looked for once a row; a later one of its type only where the ones before gave nothing, within one
    expression, since the code that Spark makes of all steps has to stay small enough to be compiled (8000 bytes).
    """
    kept, kinds = [c for c in docs.columns if c not in ("deductions", "total_deductions")], range(len(V2_DEDUCTIONS))
    pattern = lambda keyword: rf"(?i){keyword}.*?(\d{{1,5}}\.?\d{{0,2}})"
    is_percent = lambda whole, said, a: (whole.contains("%") | (said.contains("4.00") & (a < 100))) & gross.isNotNull() & (a < 100)
    value = lambda percent, a: F.when(a.between(F.expr("0.1BD"), 500), F.bround(F.when(percent, gross * F.expr("0.04BD")).otherwise(a), 2).cast(MONEY))

    def later(keyword: str) -> Column:
        p = pattern(keyword)
        made = lambda whole, said, a: let(is_percent(whole, said, a), lambda percent: F.struct(value(percent, a).alias("v"), percent.alias("p")))
        some = lambda whole: let(F.regexp_extract(whole, p, 1), lambda said: let(said.try_cast(MONEY), lambda a: made(whole, said, a)))
        return let(let(F.regexp_extract(t, p, 0), some), lambda one: F.when(one["v"].isNotNull(), one))

    first_of = [pattern(keywords[0]) for _, keywords in V2_DEDUCTIONS]
    docs = shared(docs, {f"_d{i}w": F.regexp_extract(t, p, 0) for i, p in enumerate(first_of)})
    docs = shared(docs, {f"_d{i}t": F.regexp_extract(f"_d{i}w", p, 1) for i, p in enumerate(first_of)})
    docs = shared(docs, {f"_d{i}a": F.col(f"_d{i}t").try_cast(MONEY) for i in kinds})
    docs = shared(docs, {f"_d{i}p": is_percent(*[F.col(f"_d{i}{x}") for x in "wta"]) for i in kinds})
    docs = shared(docs, {f"_d{i}v": value(F.col(f"_d{i}p"), F.col(f"_d{i}a")) for i in kinds})
    docs = shared(docs, {f"_d{i}l": F.when(F.col(f"_d{i}v").isNull(), F.coalesce(*[later(k) for k in keywords[1:]])) for i, (_, keywords) in enumerate(V2_DEDUCTIONS)})
    docs = shared(docs, {f"_d{i}": F.coalesce(f"_d{i}v", f"_d{i}l.v") for i in kinds})
    percent = lambda i: F.when(F.col(f"_d{i}v").isNotNull(), F.col(f"_d{i}p")).otherwise(F.col(f"_d{i}l.p"))
    one = lambda i, kind: F.when(F.col(f"_d{i}").isNotNull(), F.struct(F.when(percent(i), "Commission @4%").otherwise(kind).alias("deduction_type"), F.col(f"_d{i}").alias("amount")))
    total = reduce(lambda x, y: x + y, [F.coalesce(F.col(f"_d{i}"), F.lit(0).cast(MONEY)) for i in kinds])
    return docs.select(
        *[F.col(f"`{c}`") for c in kept], F.array_compact(F.array(*[one(i, kind) for i, (kind, _) in enumerate(V2_DEDUCTIONS)])).alias("deductions"),
        F.when(F.coalesce(*[F.col(f"_d{i}") for i in kinds]).isNotNull(), total.cast(MONEY)).alias("total_deductions"),
    )


def extract_v2(docs: DataFrame) -> DataFrame:
    """docs (voucher_id, raw_ocr_text, ...) with the fields of profile v2: values, items, deductions, confidences.

    Null text has no field and confidence 0. All in built-in expressions; no shuffle.
    """
    t, ln = F.col("_t"), F.col("_ln")
    docs = shared(docs, {"_raw": F.coalesce("raw_ocr_text", F.lit(""))})
    docs = shared(shared(shared(docs, {"_low": F.lower("_raw")}), {"_t": fix_global(F.col("_raw"), F.col("_low"))}), {"_ln": lines(t)})
    by_lines = lambda f: let(lines(t), f)  # noqa: E731  lines of their own for what is seldom asked for
    labelled, general = v2_dates(t, ln)[0], by_lines(lambda own: v2_dates(t, own)[1])
    docs = shared(docs, {"_dl": labelled, "_tl": first(t, TOTAL_LINE, 2)})
    docs = shared(docs, {"_dg": F.when(F.col("_dl").isNull(), general), "_tl": F.col("_tl").try_cast(MONEY)})
    docs = shared(docs, {"_tl": F.when(F.col("_tl") > 10, F.col("_tl"))})
    docs = shared(docs, {"_lg": F.when(F.col("_tl").isNull(), largest_amount(t))})
    docs = shared(docs, {
        "voucher_number": v2_number(t), "voucher_date": F.coalesce("_dl", "_dg"), "_dc": F.when(F.col("_dl").isNotNull(), 90).when(F.col("_dg").isNotNull(), 80).otherwise(0),
        "gross_total": F.coalesce("_tl", "_lg"), "_gc": F.when(F.col("_tl").isNotNull(), 85).when(F.col("_lg").isNotNull(), 60).otherwise(0), "items": v2_items(ln),
    })
    dated = F.col("voucher_date").isNotNull()
    label, near, placed = v2_suppliers(t, ln, dated)[0], by_lines(lambda own: v2_suppliers(t, own, dated)[1]), by_lines(lambda own: v2_suppliers(t, own, dated)[2])
    docs = shared(docs, {"_sl": label})
    docs = shared(docs, {"_sn": F.when(F.col("_sl").isNull(), near)})
    docs = shared(docs, {"_sp": F.when(F.col("_sl").isNull() & F.col("_sn").isNull(), placed)})
    supplier_c = F.when(F.col("_sl").isNotNull(), 80).when(F.col("_sn").isNotNull(), F.col("_sn.confidence")).when(F.col("_sp").isNotNull(), 60).otherwise(0)
    docs = shared(docs, {"supplier_name": F.coalesce("_sl", "_sn.value", "_sp"), "_sc": supplier_c})
    docs = v2_deductions(docs, t, F.col("gross_total"))
    rest = F.col("gross_total") - F.coalesce("total_deductions", F.lit(0))
    docs = shared(docs, {"_rest": rest, "_said": first(t, NET_LINE).try_cast(MONEY)})
    said, rest = F.col("_said"), F.col("_rest")
    docs = shared(docs, {"_said": F.when(F.abs(said - rest) <= F.greatest(rest * 0.2, F.lit(50)), said)})
    number_c = F.when(F.col("voucher_number").isNotNull(), 85).otherwise(0)
    n = F.size("items")
    docs = docs.withColumns({
        "net_total": F.coalesce(said, rest).cast(MONEY),
        "confidence": F.create_map(
            F.lit("voucher_number"), number_c, F.lit("voucher_date"), F.col("_dc"), F.lit("supplier_name"), F.col("_sc"), F.lit("gross_total"), F.col("_gc"),
            F.lit("net_total"), F.when(said.isNotNull(), 90).when(F.col("gross_total").isNotNull(), 70).otherwise(0),
            F.lit("items"), F.when(n > 0, F.least(F.lit(90), n * 25)).otherwise(20), F.lit("deductions"), F.when(F.size("deductions") > 0, F.least(F.lit(85), F.size("deductions") * 40)).otherwise(30),
        ),
    })
    four = [number_c, F.col("_dc"), F.col("_sc"), F.col("_gc")]
    return docs.withColumn("overall", (sum(four[1:], four[0]) / 4 * 0.6 + F.least(*four) * 0.4).cast("double")).drop("_raw", "_low", "_t", "_ln", "_dl", "_dg", "_dc", "_tl", "_lg", "_gc", "_sl", "_sn", "_sp", "_sc", "_rest", "_said")


# --- profile quality -------------------------------------------------------------------------------------------


def clean_supplier(c: Column) -> Column:
    return F.trim(F.regexp_replace(_clean_tail(F.trim(c)), r"(?i)\s*(?:qty|price|amount|total).*$", ""))


def quality_strategies(t: Column, ln: Column, extended: bool = False) -> list[tuple[str, str, int, Column]]:
    """(field, strategy, base confidence, value as text), in the order in which they are tried."""
    each = lambda f: _line(F.filter(F.transform(ln, f), lambda x: x.isNotNull()))
    dated = lambda c: calendar_date(c, short_years=True).cast("string")
    upper = lambda x: (x == F.upper(x)) & (x != F.lower(x))
    general = _line(F.filter(F.transform(F.slice(ln, 1, 10), lambda x: calendar_date(first(x, r"(\d{1,2}[/\-]\d{1,2}[/\-]20\d{2})"), low=2000, high=2099)), lambda x: x.isNotNull()))
    below = F.transform(ln, lambda x, i: F.when(x.rlike(r"(?i)\b(supp|name|nane)\b") & ~F.get(ln, i + 1).rlike(r"(?i)\b(qty|price|amount|total)\b"), F.get(ln, i + 1)))
    total = first(t, TOTAL_LINE, 2).try_cast(MONEY)
    found = [
        ("voucher_number", "VoucherNumber label", 90, first(t, r"(?i)[v]oucher\s*number[:\s]*(\d{2,4})\b")),
        ("voucher_number", "Nuaber/Nunber variants", 75, first(t, r"(?i)[n#](?:(?<=n)u[a-z]*ber|(?<=n)o|(?<=n)um|(?<=#))[:\s]*(\d{2,4})\b")),
        ("voucher_number", "Standalone number early", 60, _line(F.filter(F.slice(ln, 1, 5), lambda x: x.rlike(r"^\d{2,4}$")))),
        ("voucher_number", "Number after voucher", 70, first(t, r"(?i)[v]oucher[:\s#]*(\d{2,4})\b")),
        ("voucher_date", "VoucherDate label", 90, dated(first(t, rf"(?i)[v]oucher\s*date[:\s]*({DATE})"))),
        ("voucher_date", "Date pattern general", 70, general.cast("string")),
        ("voucher_date", "DD/MM/YYYY pattern", 65, compact_date(t).cast("string")),
        ("supplier_name", "Supp Name label", 85, clean_supplier(first(t, r"(?i)[sn](?:(?<=s)upp\s*name|(?<=s)uppnane|(?<=n)a[nr]e|(?<=n)e)[:\s]*([A-Z]{2,30}(?:/[A-Z])?|.{2,30}?)(?=\n|$|qty|total|price)"))),
        ("supplier_name", "Name line after label", 75, clean_supplier(each(lambda x: first(x, r"(?i)[n](?:a[mn]|m)e[:\s]*(.{2,30}?)(?=\n|$|qty|total)")))),
        ("supplier_name", "Line after Supp", 65, clean_supplier(_line(F.filter(below, lambda x: x.isNotNull())))),
        ("supplier_name", "Capitalized text", 50, clean_supplier(_line(F.filter(F.slice(ln, 1, 5), lambda x: upper(x) & F.length(x).between(3, 30) & ~F.lower(x).rlike("date|voucher|total|qty"))))),
        ("gross_total", "Total line pattern", 90, F.when(total.between(10, 100000), total).cast("string")),
        ("gross_total", "Largest amount", 60, largest_amount(t).cast("string")),
    ]
    if extended:
        found.append(("net_total", "Explicit net", 50, first(t, NET_LINE).try_cast(MONEY).cast("string")))
    return found


def tried(docs: DataFrame, as_of: str, extended: bool) -> DataFrame:
    """docs with the text `_t`, its lines `_ln` and `_tried`: what each strategy that found something gave, with its
    confidence, whether it is valid, and its errors."""
    from slipmill.operators.validate import adjusted_confidence, field_errors

    t, ln = F.col("_t"), F.col("_ln")
    kept = docs.columns
    docs = once(docs.withColumn("_t", F.coalesce("raw_ocr_text", F.lit(""))), {"_ln": lines(t)})
    strategies = quality_strategies(t, ln, extended)
    docs = once(docs, {f"_v{i}": value for i, (*_, value) in enumerate(strategies)})
    docs = once(docs, {f"_e{i}": field_errors(field, F.col(f"_v{i}"), as_of) for i, (field, *_) in enumerate(strategies)})
    made = []
    for i, (field, strategy, base, _) in enumerate(strategies):
        value, errors = F.col(f"_v{i}"), F.col(f"_e{i}")
        row = F.struct(F.lit(field).alias("field"), F.lit(strategy).alias("strategy"), F.lit(i).alias("ord"), value.alias("value"), adjusted_confidence(field, F.lit(base), value, errors).alias("confidence"), (F.size(errors) == 0).alias("valid"), errors.alias("errors"))
        made.append(F.when(F.nullif(value, F.lit("")).isNotNull(), row))
    return docs.select(*[F.col(f"`{c}`") for c in kept], "_t", "_ln", F.array_compact(F.array(*made)).alias("_tried"))


def candidates(docs: DataFrame, as_of: str = "2031-01-01", extended: bool = False) -> DataFrame:
    """A row per voucher, field and strategy that found something: value, confidence, valid, errors.

    as_of takes the place of today in the date rule. Null text has no candidate. No shuffle: rows are exploded.
    """
    return tried(docs, as_of, extended).select("voucher_id", F.inline("_tried"))


def best_candidates(found: DataFrame) -> DataFrame:
    """A row per voucher and field: the best valid candidate, else the best invalid one; ties go to the first strategy."""
    rank = F.struct(F.col("valid").cast("int"), "confidence", -F.col("ord"))
    best = found.groupBy("voucher_id", "field").agg(F.max_by(F.struct("value", "confidence", "valid", "strategy", "errors"), rank).alias("b"), F.count("*").alias("n_attempts"))
    from slipmill.operators.validate import status

    return best.select("voucher_id", "field", "b.*", "n_attempts").withColumn("status", status(F.col("valid"), F.col("confidence")))


# What begins and ends the items' table, what isn't an item, the forms of an item's line.
TABLE_HEAD = r"(?i)(?:qty|quantity|qty|q)[\s\-._]*(?:price|pr|p)[\s\-._]*(?:amount|amt|amnt)"
TABLE_END = r"(?i)^(?:\(\s*-\s*\)|comm|damage|less|unloading|lf|grand\s*total|deduction)|^(?:total|subtotal)\s*$"
SUMMARY = r"(?i)^(?:total|subtotal|grand|sum)"
NO_ITEM = r"(?i)^(?:total|date|voucher|supplier|qty|price|amount)"
NAMED_ITEM = r"^(.*?)\s+(\d{1,4})\s+(\d{1,6}(?:\.\d{1,2})?)\s+(\d{1,7}(?:\.\d{1,2})?)$"
REVERSED_ITEM = r"^(.*?)\s+(\d{1,7}(?:\.\d{1,2})?)\s+(\d{1,6}(?:\.\d{1,2})?)\s+(\d{1,4})$"
NAMELESS_ITEM = r"^()(\d{1,4})\s+(\d{1,6}(?:\.\d{1,2})?)\s+(\d{1,7}(?:\.\d{1,2})?)$"
ANY_ITEM = r"\b(\d{1,4})\s+(\d{1,6}(?:\.\d{1,2})?)\s+(\d{1,7}(?:\.\d{1,2})?)\b"


def _without_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[^\w]*", "")


def _item(name: Column, quantity: Column, price: Column, amount: Column) -> Column:
    return F.struct(name.alias("item_name"), quantity.cast("decimal(10,2)").alias("quantity"), F.bround(price, 2).cast("decimal(10,2)").alias("unit_price"), F.bround(amount, 2).cast(MONEY).alias("line_amount"))


def _amounts(x: Column, pattern: str, *groups: int) -> list[Column]:
    return [first(x, pattern, g).try_cast("decimal(14,4)") for g in groups]


def _table(ln: Column) -> Column:
    """Where the items' table begins (`head`: the place of its heading, from 1, or 0) and how many lines it has (`n`).

    It ends at the first deduction or bare total after a heading, else at the first line with fewer than two numbers.
    Of several headings before that end the last one counts.
    """
    ends = lambda opened: F.transform(ln, lambda x, i: (i >= opened) & ~x.rlike(TABLE_HEAD) & x.rlike(TABLE_END))
    bare = lambda x: (F.size(F.regexp_extract_all(x, F.lit(r"\d+(?:\.\d{2})?"), F.lit(0))) < 2) & ~x.rlike("(?i)(?:item|product|name)")
    place = lambda flags: F.array_position(flags, True).cast("int")

    def last_head(heads: Column, closed: Column) -> Column:
        before = F.when(closed > 0, closed - 1).otherwise(F.size(ln))
        return before + 1 - place(F.reverse(F.slice(heads, F.lit(1), before)))

    def size(head: Column, closed: Column) -> Column:
        runs_out = lambda rest: let(place(F.transform(rest, bare)), lambda p: F.when(p > 0, p - 1).otherwise(F.size(rest)))
        return F.when(closed > 0, closed - 1 - head).otherwise(let(F.slice(ln, head + 1, F.size(ln)), runs_out))

    def bounds(heads: Column, opened: Column) -> Column:
        whole = lambda closed: let(last_head(heads, closed), lambda head: F.struct(head.alias("head"), size(head, closed).alias("n")))
        return F.when(opened > 0, let(place(ends(opened)), whole)).otherwise(F.struct(F.lit(0).alias("head"), F.lit(0).alias("n")))

    return let(F.transform(ln, lambda x: x.rlike(TABLE_HEAD)), lambda heads: let(place(heads), lambda opened: bounds(heads, opened)))


def _table_item(x: Column, above: Column) -> Column:
    """The item of a table's line: name, quantity, price and amount; the same reversed; or without a name."""

    def fits(i: Column) -> Column:
        off = F.abs(i["line_amount"] - i["quantity"] * i["unit_price"])
        inside = i["quantity"].between(1, 10000) & (i["unit_price"] > 0) & (i["unit_price"] <= 100000) & (i["line_amount"] > 0) & (i["line_amount"] <= 1000000)
        return inside & (off <= F.greatest(i["quantity"] * i["unit_price"] * F.expr("0.5BD"), F.lit(1)))

    def named(c: Column) -> Column:
        own = F.regexp_replace(_without_marks(F.trim(c)), r"(?i)\s*(?:qty|price|amount|total|\d+\.\d{2}).*$", "")
        over = F.when(~above.rlike(r"\d{2,}") | above.rlike(r"^[A-Za-z\s]+$"), _without_marks(F.trim(above)))
        return F.substring(F.regexp_replace(F.trim(F.coalesce(F.nullif(own, F.lit("")), over, F.lit(""))), r"\s+", " "), 1, 100)

    def form(pattern: str, q: int, price: int, amount: int) -> Column:
        said = F.struct(*[c.alias(name) for c, name in zip(_amounts(x, pattern, q, price, amount), ("q", "price", "amount"))])
        name = F.lit("") if pattern == NAMELESS_ITEM else named(F.regexp_extract(x, pattern, 1))
        close = lambda s: F.abs(s["amount"] - s["q"] * s["price"]) <= F.greatest(s["q"] * s["price"] * F.expr("0.3BD"), F.lit(10)) if pattern == REVERSED_ITEM else F.lit(True)
        made = lambda s: F.when(close(s), let(_item(name, s["q"], *repaired_item(s["q"], s["price"], s["amount"])), lambda i: F.when(fits(i), i)))
        return F.when(x.rlike(pattern), let(said, made))

    return F.coalesce(form(NAMED_ITEM, 2, 3, 4), form(REVERSED_ITEM, 4, 3, 2), form(NAMELESS_ITEM, 2, 3, 4))


def _loose_item(x: Column) -> Column:
    """The first three numbers of a line of which the product is within 40 % of the third."""

    def one(part: Column) -> Column:
        at = F.concat(F.lit(r"^(.*?)\b"), part[0], F.lit(r"\s+"), F.replace(part[1], F.lit("."), F.lit(r"\.")))
        number = lambda i: part[i].try_cast("decimal(14,4)")
        return _item(_without_marks(F.trim(F.call_function("regexp_extract", x, at, F.lit(1)))), number(0), number(1), number(2))

    def fits(i: Column) -> Column:
        expected = i["quantity"] * i["unit_price"]
        return (expected > 0) & (i["line_amount"] > 0) & i["line_amount"].between(expected * F.expr("0.6BD"), expected * F.expr("1.4BD"))

    return _line(F.filter(F.transform(F.transform(F.regexp_extract_all(x, F.lit(ANY_ITEM), F.lit(0)), lambda w: F.split(w, r"\s+")), one), fits))


def quality_items(ln: Column) -> Column:
    """Items of the table, else of any line: name (the one above where a line has marks for it, else Item and its
    place), quantity, price, amount. Null lines have none."""

    def numbered(found: Column) -> Column:
        name = lambda i, k: F.coalesce(F.nullif(i["item_name"], F.lit("")), F.concat(F.lit("Item "), (k + 1).cast("string")))
        return F.transform(F.filter(found, lambda i: i.isNotNull()), lambda i, k: F.struct(name(i, k).alias("item_name"), i["quantity"].alias("quantity"), i["unit_price"].alias("unit_price"), i["line_amount"].alias("line_amount")))

    def from_table(ln: Column, at: Column) -> Column:
        pairs = F.transform(F.slice(ln, at["head"] + 1, at["n"]), lambda x, k: F.struct(x.alias("line"), F.get(ln, at["head"] + k - 1).alias("above")))
        return numbered(F.transform(F.filter(pairs, lambda p: ~p["line"].rlike(SUMMARY)), lambda p: _table_item(p["line"], p["above"])))

    loose = lambda ln: numbered(F.transform(F.filter(ln, lambda x: ~x.rlike(NO_ITEM)), _loose_item))
    either = lambda ln: let(let(_table(ln), lambda at: from_table(ln, at)), lambda table: F.when(F.size(table) > 0, table).otherwise(loose(ln)))
    return let(F.coalesce(ln, F.array().cast("array<string>")), either)


#: Of each deduction its cap, its typical range and its patterns in the order in which they are tried.
QUALITY_DEDUCTIONS = (
    ("Unloading", 200, 10, 150, (
        r"[u]nl(?:oading|oad|d|od|odin)[^\d\n]*(-?\s*[\d,]+\.?\d{0,2})",
        r"[u]nload(?:ing)?[^\d\n]*\(?\s*-\s*\)?[^\d\n]*([\d,]+\.?\d{0,2})",
    )),
    ("L/F Cash", 500, 20, 400, (
        r"[l](?:[/\s]*f|\.f)[^\d\n]*(?:and)?[^\d\n]*(?:cash)?[^\d\n]*(-?\s*[\d,]+\.?\d{0,2})",
        r"[l]f(?:andcash|cash|\s+cash)[^\d\n]*(-?\s*[\d,]+\.?\d{0,2})",
        r"[c]ash[^\d\n]*(?:lf)?[^\d\n]*(-?\s*[\d,]+\.?\d{0,2})",
        r"\(\s*-\s*\)[^\d\n]*(?:l[/\s]*f|lf)[^\d\n]*(-?\s*[\d,]+\.?\d{0,2})",
    )),
    ("Commission", 5000, 10, 1000, (
        r"[c]om(?:m|ission|mision)?[^\d\n]*(?:@)?[^\d\n]*(-?\s*[\d,]+\.?\d{0,2})\s*(?:%)?",
        r"[c]om(?:m|ission)[^\d\n]*(?:@)?[^\d\n]*(?:4\.?\d*)?\s*(?:%)?[^\d\n]*(-?\s*[\d,]+\.?\d{0,2})",
        r"\(\s*-\s*\)[^\d\n]*(?:comm|com)[^\d\n]*(-?\s*[\d,]+\.?\d{0,2})",
    )),
    ("Less for Damages", 1000, 20, 500, (
        r"[ld](?:(?<=l)ess\s*for\s*damages|(?<=d)amages?)[^\d\n]*(-?\s*[\d,]+\.?\d{0,2})",
        r"[l]ess\s*for[^\d\n]*(?:damages)?[^\d\n]*(-?\s*[\d,]+\.?\d{0,2})",
        r"\(\s*-\s*\)[^\d\n]*(?:damage|less)[^\d\n]*(-?\s*[\d,]+\.?\d{0,2})",
    )),
)


def quality_deductions(t: Column, gross: Column) -> Column:
    """One deduction of each type, no amount read twice: of each pattern the first amount in range that no pattern
    before it took, of each type its first pattern's; commission (4 %) and damages (5 %) of gross where none was found.

    A percentage of a commission is taken of gross and named in the type; damages with one are 5 % of gross.
    """
    gross = F.when(gross > 0, gross)
    share = lambda rate: F.bround(gross * rate, 2).cast(MONEY)

    def read(rule: int, kind: str, most: int, low: int, high: int, pattern: str) -> Column:
        def rated(said: Column, whole: Column) -> Column:
            percent = (said < 100) & whole.contains("%") & gross.isNotNull() if kind in ("Commission", "Less for Damages") else F.lit(False)
            rate = said / 100 if kind == "Commission" else F.expr("0.05BD")
            name = F.when(percent, F.concat(F.lit("Commission @"), said.cast("int").cast("string"), F.lit("%"))).otherwise(kind) if kind == "Commission" else F.lit(kind)
            return F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), name.alias("deduction_type"), said.alias("said"), F.when(percent, share(rate)).otherwise(said).alias("amount"))

        number = lambda w: F.regexp_replace(F.regexp_extract(w, f"(?i){pattern}", 1), r"[,\-\s]", "").try_cast("decimal(14,4)")
        scaled = lambda w: let(number(w), lambda n: F.bround(deduction_scale(n, kind), 2).cast(MONEY))
        one = lambda w: let(scaled(w), lambda said: rated(said, w))
        return F.filter(F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(f"(?i){pattern}"), F.lit(0)), one), lambda x: x["amount"].between(low, min(most, 2 * high)))

    def without(clash):
        """Of an array, each element that clashes with none kept before it."""
        none = F.array().cast("array<struct<rule:int,kind:string,deduction_type:string,said:decimal(12,2),amount:decimal(12,2)>>")
        return lambda found: F.aggregate(found, none, lambda acc, x: F.when(F.exists(acc, lambda a: clash(a, x)), acc).otherwise(F.concat(acc, F.array(x))))

    rules = [(kind, *bounds, p) for kind, *bounds, patterns in QUALITY_DEDUCTIONS for p in patterns]
    taken = without(lambda a, x: (a["rule"] == x["rule"]) | (a["said"] == x["said"]))(F.concat(*[read(i, *rule) for i, rule in enumerate(rules)]))
    due = lambda kind, name, rate: F.struct(F.lit(len(rules)).alias("rule"), F.lit(kind).alias("kind"), F.lit(name).alias("deduction_type"), share(F.expr(rate)).alias("said"), share(F.expr(rate)).alias("amount"))
    added = F.filter(F.array(due("Commission", "Commission @4%", "0.04BD"), due("Less for Damages", "Less for Damages", "0.05BD")), lambda x: x["amount"].isNotNull())
    of_type = without(lambda a, x: a["kind"] == x["kind"])(F.concat(taken, added))
    return F.transform(of_type, lambda x: F.struct(x["deduction_type"].alias("deduction_type"), x["amount"].alias("amount")))


QUALITY_FIELDS = ("voucher_number", "voucher_date", "supplier_name", "gross_total", "net_total")


def extract_quality(docs: DataFrame, as_of: str = "2031-01-01", extended: bool = False) -> DataFrame:
    """docs (voucher_id, raw_ocr_text, ...) with all that profile quality gives: `fields` (of each field its value,
    confidence, status, strategy, recommendation), `items`, `deductions`, `overall`, `requires_review`.

    A net total above its gross total has failed. Null text has no field, no item and overall 0, and asks for no
    review. In built-in expressions within the row; no shuffle.
    """
    from slipmill.operators.validate import recommendation, status

    kept = [c for c in docs.columns if c not in ("fields", "items", "deductions", "overall", "requires_review")]
    every = F.col("_tried")
    best = lambda f: F.array_max(F.transform(F.filter(every, lambda x: x["field"] == f), lambda x: F.struct(x["valid"].cast("int").alias("valid"), x["confidence"].alias("confidence"), (-x["ord"]).alias("place"), x["value"].alias("value"), x["strategy"].alias("strategy"), x["errors"].alias("errors"))))
    docs = once(tried(docs.select(*[F.col(f"`{c}`") for c in kept]), as_of, extended), {f"_b_{f}": best(f) for f in QUALITY_FIELDS})
    amount = lambda f: F.col(f"_b_{f}.value").try_cast("decimal(14,2)")
    above = F.coalesce((amount("net_total") > amount("gross_total")) & (amount("gross_total") != 0), F.lit(False))
    made = []
    for f in QUALITY_FIELDS:
        b = F.col(f"_b_{f}")
        state, why = status(b["valid"] == 1, b["confidence"]), F.concat(F.lit("Validation failed: "), F.array_join(b["errors"], ", "), F.lit(". Manual review required."))
        if f == "net_total":
            state, why = F.when(above, "validation_failed").otherwise(state), F.when(above, "Net > Gross - verify deductions").otherwise(why)
        made += [F.lit(f), F.struct(b["value"].alias("value"), F.coalesce(b["confidence"], F.lit(0)).alias("confidence"), state.alias("status"), b["strategy"].alias("strategy"), recommendation(state, why).alias("recommendation"))]
    docs = once(docs, {"fields": F.create_map(*made), "items": quality_items(F.col("_ln")), "deductions": quality_deductions(F.col("_t"), amount("gross_total"))})
    sure = F.filter(F.transform(F.map_values("fields"), lambda x: x["confidence"].cast("long")), lambda c: c > 0)
    overall = F.when(F.size(sure) > 0, F.floor(F.aggregate(sure, F.lit(0).cast("long"), lambda a, c: a + c) / F.size(sure))).otherwise(0).cast("long")
    review = F.exists(F.map_values("fields"), lambda x: x["status"].isin("medium", "low", "validation_failed"))
    return docs.select(*[F.col(f"`{c}`") for c in kept], "fields", "items", "deductions", overall.alias("overall"), review.alias("requires_review"))
