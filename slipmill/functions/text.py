"""Cleaning of recognised text. Every function is Column -> Column and stays in built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Misreads and what they stand for, in the order in which they apply.
GLOBAL_FIXES = (
    (r"(\d{2})7(\d{2})7(20\d{2})", "$1/$2/$3"),
    (r"(?i)[6S]rand\s*Total", "GrandTotal"),
    (r"(?i)1ess\s*For\s*Da[mn]", "LessForDam"),
    (r"(?i)Un1oading", "UnLoading"),
    (r"(?i)(?:1YF|1/F).*Cash", "L/FAndCash"),
)
TERMS = (
    ("Voucner", "Voucher"), ("Vouchcr", "Voucher"), ("V0ucher", "Voucher"), ("Vouch3r", "Voucher"), ("Vouch3rNumb3r", "VoucherNumber"),
    ("VoucberDate", "Voucher Date"), ("VYoucherDate", "Voucher Date"), ("Date", "Date"), ("Dat3", "Date"),
    ("SuppName", "Supp Name"), ("SuppNanm3", "Supp Name"), ("SuppNam3", "Supp Name"), ("SuppNane", "Supp Name"), ("SuppNanme", "Supp Name"),
    ("Comm", "Comm"), ("CommW", "Comm"), ("Commision", "Commission"), ("LessForDamnages", "Less For Damages"), ("LessForDamages", "Less For Damages"),
    ("UnLoadin", "UnLoading"), ("Unloading", "UnLoading"), ("LFAndCash", "L/F and Cash"),
    ("brandTotal", "Grand Total"), ("GrandTotal", "Grand Total"), ("Tota", "Total"), ("NetTotal", "Net Total"),
    ("Amount", "Amount"), ("Anount", "Amount"), ("Price", "Price"), ("Qty", "Qty"),
)
LABEL_FIXES = ((r"(?i)Vouch3rNumb3r", "VoucherNumber"), (r"(?i)Vouch3r", "Voucher"), (r"(?i)Youch3r", "Voucher"), (r"(?i)Youch3rDat3", "VoucherDate"))
DIGITS_FOR = {"O": "0", "D": "0", "Q": "0", "I": "1", "L": "1", "|": "1", "!": "1", "Z": "2", "S": "5", "$": "5", "B": "8", "&": "8", "G": "6"}
DECIMAL_FIXES = (
    (r"(\d+)[oO0][nN]", "$1.00"), (r"(\d+)[hH]", "$1.00"), (r"(\d+)[dD][oO0]$", "$1.00"), (r"(\d{4,})[oO0][nN]", "$1.00"),
    (r"(\d{4,})[dD][oO0][nN]", "$1.00"), (r"(\d{4,})(\d{4,})(\d{2,})\.00", "$1 $2.$3"), (r"(\d{3,})[hH]$", "$1.00"), (r"(\d{3,})[dD]$", "$1.00"),
    (r"([a-zA-Z])\.00", " 0.00"), (r"([a-zA-Z])00$", " 0.00"), (r"(\d{3,})[hH](?!\d)", "$1.00"), (r"(\d{3,})[oO]0$", "$1.00"),
    (r"(\d{4,})[oO0][nN]$", "$1.00"), (r"[pP][oO0][dD][oO0][nN]", "50.00"), (r"(\d+)\.(?!\d)", "$1.00"), (r"(?<=\s)(\d{4,})(?=\s|$)", "$1.00"),
)
#: What a text has somewhere if any of DECIMAL_FIXES, or of the fixes of points, matches in it or in one of its lines.
DECIMAL_MISREADS = r"\d(?:[oO0][nN]|[hHdD]|[oO]0|\.(?!\d))|[a-zA-Z]\.?00|[pP][oO0][dD]|\s\d{4,}(?![\d.])|\d{10}\.00"
POINT_MISREADS = r"\.(?:\d+\.|\d{3})"
POINT_FIXES = ((r"(\d+)\.(\d{2,3})\.00", "$1.$2"), (r"(\d+)\.(\d+)\.(\d{2})", "$1.$2$3"), (r"(\d{2})\.(\d{3,})", "$1$2.00"), (r"(\d+)\.000\.00", "$1.00"))
WHOLE_FIXES = (
    (r"(?i)([tacdl](?:(?<=t)otal|(?<=a)mount|(?<=c)omm|(?<=d)amages|(?<=l)oading|(?<=c)ash)\s+)(\d{3,})(?!\.|\d\d)", "$1$2.00"),
    (r"(?i)([ldgn](?:(?<=l)ess|(?<=d)eduction|(?<=g)rand|(?<=n)et|(?<=g)ross)\s+)(\d{3,})(?!\.|\d\d)", "$1$2.00"),
)
ALLOWED = {"numbers": "0-9.", "text": "A-Za-z ", "alphanumeric": "A-Za-z0-9 ", "currency": "0-9.,₹$ -", "dates": "0-9/.-", "general": "A-Za-z0-9 .,:/()@%&-"}


def replaced(c: Column, fixes: tuple[tuple[str, str], ...]) -> Column:
    """c after regular-expression replacements, one after another."""
    return reduce(lambda acc, f: F.regexp_replace(acc, f[0], f[1]), fixes, c)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once a row, whatever refers to them: the optimizer doesn't copy what a
    generator made into later expressions. A projection before it shares what is common within them."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    made = df.select(*[F.col(f"`{c}`") for c in df.columns], *[v.alias(f"_once_{k}") for k, v in columns.items()])
    return made.select(*rest, F.inline(F.array(F.struct(*[F.col(f"`_once_{k}`").alias(k) for k in columns]))))


def unnested(df: DataFrame, column: str, key: str = "voucher_id") -> DataFrame:
    """(key, ...) of an array of structs, a row for each. The array is made once: that it has elements is asked for below
    the generator, where all that the array is made of would be copied into the filter, step by step and twofold."""
    return once(df.select(key, column), {column: F.col(column)}).select(key, F.inline(column))


def shared(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once a row where several expressions refer to them, and not at all where none
    does: for values of a few expressions each, which the optimizer keeps apart or drops."""
    return df.withColumns(columns)


def let(value: Column, f) -> Column:
    """f of a value that is computed once and stands once in the expression, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


BLANKS = " \t\n\x0b\f\r"


def lines(c: Column) -> Column:
    """Trimmed lines without the blank ones; null text has none."""
    c = F.coalesce(c, F.lit(""))
    odd = reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in (" \n", "\n ", "\t", "\x0b", "\f", "\r")])
    # Most texts have nothing but ends of lines to split at, which needs no pattern; blank lines go in both ways.
    bare = F.btrim(c, F.lit(BLANKS))
    return F.array_remove(F.when(odd, F.split(bare, r"\s*[\n\r\f]\s*")).otherwise(F.split(bare, "\n")), "")


def fix_global(c: Column, low: Column | None = None) -> Column:
    """c after GLOBAL_FIXES; a text without any of their beginnings, as most are, is not looked through for each. `low`
    is c in lower case, if that is there."""
    low = F.lower(c) if low is None else low
    begun = [F.contains(low, F.lit(x)) for x in ("6rand", "srand", "1ess", "un1oading", "1yf", "1/f")]
    return F.when(reduce(lambda a, b: a | b, begun, F.contains(c, F.lit("720"))), replaced(c, GLOBAL_FIXES)).otherwise(c)


def clean_blanks(c: Column) -> Column:
    return F.regexp_replace(replaced(c, ((r" +", " "), (r"\s*([:,])\s*", "$1 "), (r" *\n", "\n"))), r"^\s+|\s+$", "")


def fix_terms(c: Column) -> Column:
    """Misread terms, except where the right one would stand before three digits."""

    def one(acc: Column, old: str, new: str) -> Column:
        keep = lambda before: lambda done: F.when(done.rlike(new + r"\s*\d{3,}"), before).otherwise(done)
        return let(acc, lambda before: let(F.regexp_replace(before, rf"(?i)[{old[0]}](?<=\b{old[0]}){old[1:]}\b", new), keep(before)))

    # Patterns stand in the expression, and so are compiled once and not for each text; they begin with a class, since Java
    # would look for a word's edge at every character.
    return reduce(lambda acc, t: one(acc, *t), TERMS, c)


def _tagged(line: Column, number: Column) -> Column:
    """Every standalone occurrence of the number in the line gets the label in front of it."""
    return F.when(number.isNull(), line).otherwise(F.regexp_replace(line, F.concat(F.lit(r"\b"), number, F.lit(r"\b")), F.concat(F.lit("VoucherNumber"), number)))


def tag_early_numbers(c: Column) -> Column:
    def one(line: Column, i: Column) -> Column:
        fits = (i < 3) & ~line.rlike(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}")
        return F.when(fits, let(first(line, r"\b(\d{3,})\b"), lambda n: _tagged(line, n))).otherwise(line)

    return F.array_join(F.transform(F.split(c, "\n"), one), "\n")


def fix_labels(c: Column) -> Column:
    return replaced(c, LABEL_FIXES)


def tag_voucher_numbers(c: Column) -> Column:
    c = let(c, lambda whole: let(first(whole, r"Voucher.*?(\d{3,})"), lambda n: _tagged(whole, n)))

    def one(line: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(r"\b(\d{3,})\b"), F.lit(1))
        return F.when(line.rlike(r"(?i)Voucher|Vouch|Number"), F.aggregate(found, line, _tagged)).otherwise(line)

    return F.array_join(F.transform(F.split(c, "\n"), one), "\n")


def fix_digits(c: Column) -> Column:
    """Letters read for digits. Whether a letter is one is decided where it first stands in the text, for all of it."""

    def approved(letter: str) -> Column:
        at = F.instr(c, F.lit(letter))
        near = F.concat(F.substring(c, F.greatest(at - 2, F.lit(1)), F.least(at - 1, F.lit(2))), F.lit(" "), F.substring(c, at + 1, F.lit(2)))
        around = F.lower(F.substring(c, F.greatest(at - 10, F.lit(1)), F.least(at - 1, F.lit(10)) + 10))
        return (at > 0) & near.rlike(r"[\d.]") & ~around.rlike("vouch|date|supp")

    taken = [(F.when(approved(k), F.lit(k)).otherwise(F.lit("")), F.when(approved(k), F.lit(v)).otherwise(F.lit(""))) for k, v in DIGITS_FOR.items()]
    return F.call_function("translate", c, F.concat(*[x for x, _ in taken]), F.concat(*[x for _, x in taken]))


def fix_amounts(c: Column) -> Column:
    return replaced(c, ((r"(?i)(Amount|Price|Total|Comm|Damages|Loading|Cash)\s+(\d{3,})(?!\.\d)", "$1 $2.00"), (r"\b(\d{3,})00(?!\.\d)\b", "$1.00")))


def is_amount_line(c: Column) -> Column:
    return (
        c.rlike(r"(?i)(?:Qty|Quantity|Price|Amount|Total|Comm|Damages|Loading|Cash|Fee|Less|Deduction|Commission|Grand|Net|Gross|Sub)|^\s*[\d-]+.*[\d-]+\s*$")
        | (F.regexp_count(c, F.lit(r"\b\d+(?:\.\d{2})?\b")) == 3)
        | c.rlike(r"^\s*\d+.*\b\d+\.\d{2}\b")
    )


def fix_decimals(c: Column) -> Column:
    return replaced(c, DECIMAL_FIXES)


def correct_decimals(c: Column) -> Column:
    """Decimal misreads, line by line and then over the text, and the clean-up after them.

    A text in which none of the fixes can match, as most are, is looked through once and not for each.
    """
    fixed = lambda x: fix_decimals(F.array_join(F.transform(F.split(x, "\n"), fix_decimals), "\n"))
    c = let(c, lambda x: F.when(x.rlike(DECIMAL_MISREADS), fixed(x)).otherwise(x))
    c = let(c, lambda x: F.when(x.rlike(POINT_MISREADS), replaced(x, POINT_FIXES)).otherwise(x))
    c = replaced(c, WHOLE_FIXES)
    c = let(c, lambda x: F.when(x.contains("\t") | x.contains("  "), F.regexp_replace(x, r"[ \t]+", " ")).otherwise(x))
    return F.regexp_replace(replaced(c, ((r"\n\s*\n", "\n"), (r"-\s+", "- "))), r"^\s+|\s+$", "")


def keep_ascii(c: Column) -> Column:
    return replaced(c, ((r"[^\x20-\x7E\n]", ""), (r"[ \t]+", " ")))


def letters_between_digits(c: Column) -> Column:
    return replaced(c, ((r"(\d)[Oo](\d)", "$10$2"), (r"(\d)[Ss](\d)", "$15$2"), (r"(\d)[lI](\d)", "$11$2")))


def only(c: Column, kind: str) -> Column:
    """The characters that a field of this kind may have (a name of ALLOWED)."""
    return F.regexp_replace(c, f"[^{ALLOWED[kind]}]", "")


def amounts(c: Column) -> Column:
    """All amounts over 0.01 in the corrected text, by three patterns in order."""
    c = correct_decimals(c)
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (r"\b(\d{1,3}[,\s]?\d{3}(?:\.\d{2})?)\b", r"\b(\d{4,}(?:\.\d{2})?)\b", r"\b(\d{1,6}(?:\.\d{2})?)\b")])
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(",")).try_cast("decimal(18,2)")), lambda x: x > 0.01)


def correct_text(docs: DataFrame, column: str = "raw_ocr_text") -> DataFrame:
    """The receipt-term chain over a text column, in stages that keep the plan small; null stays null."""
    for step in (clean_blanks, fix_terms, tag_early_numbers, fix_labels, tag_voucher_numbers, fix_digits, fix_amounts, clean_blanks):
        docs = once(docs, {column: step(F.col(column))})
    return docs


def split_labels(c: Column) -> Column:
    """A line of its own for a value that a label runs into."""
    return replaced(c, ((r"(?i)(Voucher ?Number)(\d)", "$1\n$2"), (r"(?i)(Voucher ?Date)(\d)", "$1\n$2"), (r"(?i)(Supp ?Name)([A-Z])", "$1\n$2")))


def split_merged(c: Column) -> Column:
    """By line: a date label run into a number label and digits that begin with a date (after leading zeros) is split
    into a line for the date and one for what follows; other lines get a blank where a capital follows a small letter."""
    label = r"(?i)voucher\s*date\s*voucher\s*(?:number|no)(\d{6,10})"

    def one(line: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(line, label, 1), "^0+", "")
        day, month, year = (F.substring(digits, a, n) for a, n in ((1, 2), (3, 2), (5, 4)))
        dated = (F.length(digits) >= 8) & day.try_cast("int").between(1, 31) & month.try_cast("int").between(1, 12) & year.try_cast("int").between(2020, 2030)
        rest = F.nullif(F.trim(F.regexp_replace(line, rf"^.*?{label}", "")), F.lit(""))
        split = F.concat(F.lit("VoucherDate "), F.concat_ws("/", day, month, year), F.lit("\n"), F.coalesce(rest, F.lit("VoucherNumber ")))
        return F.when(dated, split).otherwise(F.replace(F.regexp_replace(line, "([a-z])([A-Z])", "$1 $2"), F.lit("  "), F.lit(" ")))

    return F.array_join(F.transform(F.split(c, "\n"), one), "\n")
