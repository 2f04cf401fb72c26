"""Literal documents with known answers."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from slipmill.functions import fuzzy, text, values
from slipmill.operators import extract, learn, publish, validate


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,want", [("S0.00", "50.00"), ("2O0", "200"), ("1,234.56", "1234.56"), ("l23", "123"), ("None", None), (None, None), ("Total", None)])
def test_repaired_numbers(spark, raw, want):
    assert one(spark, raw, values.repaired_number) == (None if want is None else Decimal(want))


@pytest.mark.parametrize("raw,want", [("lOlO.Ol", "1010.01"), ("-O.SO", "-0.50"), ("SOIL", None), ("B.D", None), ("l.OO.", None)])
def test_amounts_of_letters_alone(spark, raw, want):
    assert one(spark, raw, values.repaired_number) == (None if want is None else Decimal(want))


@pytest.mark.parametrize("raw,want", [("9/1/2026", (2026, 1, 9)), ("31/02/2024", None), ("05-12-2021", (2021, 12, 5)), ("05.12.2031", None), ("05/12/24", None), (None, None), ("x", None)])
def test_dates(spark, raw, want):
    assert one(spark, raw, values.calendar_date) == (datetime.date(*want) if want else None)
    assert one(spark, "05/12/24", lambda c: values.calendar_date(c, short_years=True)) == datetime.date(2024, 12, 5)


def test_text_steps(spark):
    assert one(spark, "0970172026 6rand Total", text.fix_global) == "09/01/2026 GrandTotal"
    assert one(spark, " a  b : c ,d \n e ", text.clean_blanks) == "a b: c, d\n e"
    assert one(spark, "Voucner SuppNam3 X", text.fix_terms) == "Voucher Supp Name X"
    assert one(spark, "1O5 2l3 4S5", text.letters_between_digits) == "105 213 455"
    assert one(spark, None, text.lines) == [] and one(spark, "a\r\n\n b ", text.lines) == ["a", "b"]
    assert one(spark, "PO 45 x", text.fix_digits) == "P0 45 x"


VOUCHER = "AHMED & BROS\nVoucherNumber 115\nVoucherDate 09/01/2026\nSupp Name VANITHA/D\nQty Price Amount\n10 200.00 2000.00\n5 98.00 490.00\nTotal 8 2490.00\n(-) Comm 99.60\n(-) LessForDamages 124.50\n(-) UnLoading 64.00\n(-) L/F And Cash 86.00\n"


def test_voucher_115(spark):
    r = extract.extract_v2(spark.createDataFrame([(1, VOUCHER), (2, None), (3, "")], "voucher_id long, raw_ocr_text string")).orderBy("voucher_id").collect()
    a = r[0]
    assert a["voucher_number"] is None  # a date follows within 20 characters
    assert (a["voucher_date"], a["supplier_name"], a["gross_total"]) == (datetime.date(2026, 1, 9), "VANITHA/D", Decimal("2490.00"))
    # 64.00 has "4.00" in it, so by the profile's rule it counts as a percentage: 4 % of gross.
    assert [d["amount"] for d in a["deductions"]] == [Decimal(x) for x in ("99.60", "124.50", "99.60", "86.00")] and a["net_total"] == Decimal("2080.30")
    assert [i["line_amount"] for i in a["items"]] == [Decimal("2000.00"), Decimal("490.00")]
    assert all(x["gross_total"] is None and x["overall"] == 0 and x["items"] == [] for x in r[1:])
    best = extract.best_candidates(extract.candidates(spark.createDataFrame([(1, VOUCHER)], "voucher_id long, raw_ocr_text string"))).collect()
    assert {b["field"]: b["value"] for b in best}["voucher_number"] == "115"


def test_rules(spark):
    assert one(spark, "2024", validate.number_errors) == ["Value is a year (2020-2030), not a voucher number"]
    assert one(spark, "x", validate.number_errors) == ["Must be numeric"] and one(spark, "", validate.number_errors) == ["Empty value"]
    assert one(spark, "115", validate.number_errors) == [] and one(spark, "Grand", validate.supplier_errors) == ["Contains non-supplier keywords"]
    assert one(spark, "2030-01-01", lambda c: validate.date_errors(c, "2026-01-01")) == ["Date is in the future"]


def test_learning(spark):
    assert one(spark, "x\nVoucher Number: 115\ny", lambda c: learn.anchor(c, F.lit("115"))) == "Voucher Number"
    assert one(spark, "abcd", lambda c: fuzzy.ratio(c, F.lit("abxd"))) == 0.75
    blocks = one(spark, "R4VI", lambda c: fuzzy.replaced_blocks(c, F.lit("RAVI")))
    assert [(b["bad"], b["good"]) for b in blocks] == [("4", "A")]
    diffs = spark.createDataFrame([(1, "f", "a", "x"), (2, "f", "a", "y"), (3, "g", "b", "z")], "voucher_id long, field string, auto string, corrected string")
    got = {r["auto"]: r for r in learn.best(learn.value_model(diffs), ["field", "auto"], "corrected").collect()}
    assert got["a"]["corrected"] == "x" and got["a"]["share"] == 0.5 and got["b"]["share"] == 1


def test_buckets_and_upsert(spark):
    assert [one(spark, k, publish.bucket) for k in ("Commission @4%", "Damage", "Unloading", "Unload", "L/F Cash")] == ["commission", "damage", "unloading", "other", "lf_cash"]
    a = spark.createDataFrame([(1, "old"), (2, "two")], "k long, v string")
    b = spark.createDataFrame([(1, "new")], "k long, v string")
    assert sorted(map(tuple, publish.upsert(publish.upsert(a, b, "k"), b, "k").collect())) == [(1, "new"), (2, "two")]


def test_v2_looks_once_for_each_keyword(spark):
    """No expression of the v2 profile holds a pattern as often as its value is used; fields that aren't asked for go."""
    docs = spark.createDataFrame([(1, VOUCHER)], "voucher_id long, raw_ocr_text string")
    plan = extract.extract_v2(docs).select("voucher_id", "total_deductions")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)(?:comm).*?") <= 2 and plan.count("otal|tal") <= 1 and extract.ITEM not in plan
    assert "Generate" not in plan
