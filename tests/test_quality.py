"""Profile quality's items, deductions and one-call result on literal vouchers."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from slipmill.functions import text
from slipmill.operators import extract


def items(spark, voucher):
    got = spark.createDataFrame([(voucher,)], "x string").select(extract.quality_items(text.lines(F.col("x"))).alias("i")).first()["i"]
    return [(i.item_name, float(i.quantity), float(i.unit_price), float(i.line_amount)) for i in got]


@pytest.mark.parametrize(
    "voucher,want",
    [
        (None, []),
        ("", []),
        ("Qty Price Amount", []),
        ("Qty Price Amount\n10 200.00 2000.00\n5 98.00 490.00\nTotal 8 2490.00\n(-) Comm 3 4.00 12.00", [("Item 1", 10, 200, 2000), ("Item 2", 5, 98, 490)]),
        ("Qty Price Amount\nApple 2 50.00 100.00\nPear 300.00 60.00 5\nTotal", [("Apple", 2, 50, 100), ("Pear", 5, 60, 300)]),
        ("Qty Price Amount\nLong name\n- 2 50.00 100.00\nless 1", [("Long name", 2, 50, 100)]),
        ("Qty Price Amount\nFig 2 5000.00 100.00\nTotal", [("Fig", 2, 50, 100)]),
        ("Qty Price Amount\nFig 2 50.00 900.00\nTotal", []),
        ("Qty Price Amount\nFig 2 50.00 100.00\nthe end\nKiwi 2 50.00 100.00", [("Fig", 2, 50, 100)]),
        ("Qty Price Amount\nFig 2 50.00 100.00\nQty Price Amount\nKiwi 3 50.00 150.00\nTotal", [("Kiwi", 3, 50, 150)]),
        ("Fig 2 50.00 100.00 x\nTotal 2 50.00 100.00\n1 1 900 3 5 15", [("Fig", 2, 50, 100), ("1 1 900", 3, 5, 15)]),
    ],
)
def test_items(spark, voucher, want):
    assert items(spark, voucher) == want


def deductions(spark, voucher, gross):
    got = spark.createDataFrame([(voucher, gross)], "x string, g decimal(12,2)").select(extract.quality_deductions(F.col("x"), F.col("g")).alias("d")).first()["d"]
    return {d.deduction_type: float(d.amount) for d in got}


@pytest.mark.parametrize(
    "voucher,gross,want",
    [
        (None, None, {}),
        ("nothing", 1000, {"Commission @4%": 40, "Less for Damages": 50}),
        ("UnLoading 64.00\nL/F And Cash 64.00", None, {"Unloading": 64}),
        ("UnLoading 64.00\nL/F And Cash 64.00\ncash 86.00", None, {"Unloading": 64, "L/F Cash": 86}),
        ("Comm @ 4%", 2490, {"Commission @4%": 99.6, "Less for Damages": 124.5}),
        ("Comm 99.60\nDamage 124.50\nUnloading 6400", 2490, {"Commission": 99.6, "Less for Damages": 124.5, "Unloading": 64}),
        ("cash 30.00\ncash 31.00", 0, {"L/F Cash": 30}),
    ],
)
def test_deductions(spark, voucher, gross, want):
    assert deductions(spark, voucher, None if gross is None else Decimal(gross)) == want


def test_one_call(spark):
    good = "VoucherNumber 115\nVoucherDate 09/01/2026\nSupp Name VANITHA/D\nQty Price Amount\n10 200.00 2000.00\nTotal 8 2000.00\n(-) Comm 80.00\nGrand Total 1920.00"
    rows = [(1, good, "a"), (2, None, "b"), (3, good.replace("1920", "2920"), "c"), (4, good.replace("115", "15"), "d"), (5, "", "e")]
    got = {r.voucher_id: r for r in extract.extract_quality(spark.createDataFrame(rows, "voucher_id int, raw_ocr_text string, overall string"), extended=True).collect()}
    one = got[1]
    assert one.fields["voucher_number"].value == "115" and one.fields["gross_total"].recommendation == "[OK] Auto-accept" and one.fields["net_total"].status == "medium"
    assert (one.overall, one.requires_review, len(one["items"])) == (91, True, 1) and {d.deduction_type for d in one.deductions} == {"Commission", "Less for Damages"}
    for k in (2, 5):
        assert (got[k].overall, got[k].requires_review, got[k]["items"], got[k].deductions) == (0, False, [], []) and got[k].fields["net_total"].recommendation == "[X] Not found - manual entry required"
    assert got[3].fields["net_total"].recommendation == "[X] Validation failed: Net > Gross - verify deductions"
    assert got[4].fields["voucher_number"].recommendation.startswith("[X] Validation failed: Validation failed: Value looks like a day/month")
    plain = extract.extract_quality(spark.createDataFrame(rows[:1], "voucher_id int, raw_ocr_text string, overall string")).first()
    assert plain.fields["net_total"].status == "not_found" and not plain.requires_review
