"""Profiles on texts with known answers, null and empty ones; suggestions, spans and small rules."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from slipmill.operators import context, evaluate, profiles, publish

TEXT = "RAVI TRADERS\nVoucher Number 412\nWHOLESALE FRUIT PURCHASER\nVoucher Date 09/01/2026\nSupp Name VANITHA/D\nQty Price Amount\n2 600.00 1200.00\n3 430.00 1290.00\nTotal 2 2490.00\n(-) Comm 99.60\n(-) Damages 124.50\n(-) UnLoading 64.00\n(-) L/F And Cash 86.00\nGrand Total 2115.90"
SCHEMA = "voucher_id long, raw_ocr_text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "qwe rty\n- - -"), (5, TEXT)], SCHEMA)


@pytest.mark.parametrize("profile", list(profiles.PROFILES))
def test_profile_on_known_and_empty_texts(docs, profile):
    got = {r["voucher_id"]: r for r in profiles.extract(docs, profile).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    r = got[1]
    assert (r["voucher_number"], r["voucher_date"], r["supplier_name"]) == ("412", date(2026, 1, 9), "VANITHA/D")
    assert len(r["deductions"]) == 4 and r["deductions"][1]["amount"] == Decimal("124.50")
    if profile != "enhanced":
        assert r["gross_total"] == Decimal("2490.00")
    assert [r[c] for c in r.asDict() if c != "voucher_id"] == [got[5][c] for c in r.asDict() if c != "voucher_id"]
    for k in (2, 3):
        assert [got[k][c] for c in (*profiles.FIELDS, "net_total", "total_deductions")] == [None] * 6
        assert got[k]["items"] == [] and got[k]["deductions"] == [] and got[k]["overall"] == 0
    assert got[4]["gross_total"] is None and got[4]["voucher_date"] is None


def test_profile_of_an_empty_table(spark):
    assert profiles.extract(spark.createDataFrame([], SCHEMA), "v1").count() == 0


def test_base_section_and_percent(spark):
    text = "Total 2 1000.00\nLess:\nComm @ 4.00 %\nTax 12.50\nNet Total 947.50\nFreight 3 10.00 30.00"
    r = profiles.extract(spark.createDataFrame([(1, text)], SCHEMA), "base").first()
    assert [(d["deduction_type"], d["amount"]) for d in r["deductions"]] == [("Commission @ 4.0%", Decimal("40.00")), ("Tax", Decimal("12.50"))]
    assert r["net_total"] == Decimal("947.50") and [i["item_name"] for i in r["items"]] == ["Freight"]


def example(k, auto, corrected, supplier="S", field="supplier_name"):
    return (k, field, auto, corrected, "Supp Name x", supplier)


def test_suggestions(spark):
    cols = "voucher_id long, field string, auto string, corrected string, raw_ocr_text string, supplier_name string"
    seen = [*[example(k, "R4VI", "RAVI") for k in (1, 2, 4)], example(3, "SUN", "SUNNY", "T")]
    rows = [example(10, "r4vi ", None), example(11, "unknown", None, "T"), example(12, None, None, None), example(13, "R4VI", None, None, "other")]
    got = {r["voucher_id"]: r for r in context.suggestions(spark.createDataFrame(rows, cols).drop("corrected"), spark.createDataFrame(seen, cols)).collect()}
    assert (got[10]["suggestion"], got[10]["source"], got[10]["confidence"]) == ("RAVI", "combined", pytest.approx(0.98))
    # Its supplier's only correction (0.95) is surer than the context's best (3 of 4, weighed 0.9).
    assert (got[11]["suggestion"], got[11]["source"], [a["value"] for a in got[11]["alternatives"]]) == ("SUNNY", "supplier", ["RAVI"])
    assert (got[12]["suggestion"], got[12]["source"]) == (None, "context")
    assert (got[13]["suggestion"], got[13]["source"], got[13]["confidence"]) == (None, None, 0.0)
    assert context.suggestions(spark.createDataFrame(rows, cols).drop("corrected"), spark.createDataFrame([], cols)).where("suggestion IS NOT NULL").count() == 0


def test_spans_without_overlap(spark):
    rows = spark.createDataFrame([(1, "Ravi paid 250.00 of 1250", "RAVI", Decimal("250.00"), Decimal("1250.00")), (2, None, "RAVI", None, None)], "voucher_id long, raw_ocr_text string, supplier_name string, gross_total decimal(12,2), net_total decimal(12,2)")
    got = [tuple(r) for r in context.spans(rows).collect()]
    assert got == [(1, 0, 4, "ORG"), (1, 10, 16, "MONEY"), (1, 20, 24, "MONEY")]


def test_small_rules(spark):
    kinds = spark.createDataFrame([([("Commission @4%", 1), ("Damage", 2)], [("commission", 3), ("Less for Damages", 4), ("Other", 5)])], "a array<struct<deduction_type:string,n:int>>, b array<struct<deduction_type:string,n:int>>")
    assert [d["n"] for d in kinds.select(publish.one_of_each_kind(F.col("a"), F.col("b"))).first()[0]] == [1, 2, 5]
    pairs = spark.createDataFrame([("1.001", "1.00"), (" A", "a"), (None, None), (None, "a"), ("1", "2")], "a string, b string")
    assert [r[0] for r in pairs.select(evaluate.values_match(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, False]
    texts = spark.createDataFrame([(None,), ("",), ("voucher date total",), ("VoucherNumber12345678",)], "t string")
    assert [r[0] for r in texts.select(evaluate.structure_quality(F.col("t"))).collect()] == [0, 0, 100, 55]
