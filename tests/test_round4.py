"""What round 4 found: work that was left out, and plans in which extraction was repeated."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from slipmill.functions import text
from slipmill.operators import evaluate, extract, learn, profiles
from slipmill.plans import queries, records, vouchers  # noqa: F401  records adds its queries


def compared(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, sf)
    r = con.execute(queries.SQL[name])
    names = [d[0] for d in r.description]
    return {row.model: (row.rows, row.samples) for row in df.collect()}, {row[names.index("model")]: (row[names.index("rows")], row[names.index("samples")]) for row in r.fetchall()}


def test_all_ten_models_are_trained(spark, sf):
    got, want = compared(spark, sf, "trained_models")
    assert set(got) == {"values", "substitutions", "anchors", "sources", "patterns", "contexts", "suppliers", "places", "neighbours", "crops"}
    assert got == want and all(n > 0 for n, _ in got.values())


def plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_deductions_are_made_once(spark, sf):
    assert plan_size(queries.QUERIES["v2_deductions"](spark, sf)) < 60_000  # 8,100,000 where a filter repeated them


def test_numeric_accuracy_repeats_nothing(spark, sf):
    df = queries.QUERIES["numeric_accuracy"](spark, sf)  # its plan wasn't made within minutes where a filter repeated extraction
    assert plan_size(df) < 60_000
    got, con = df.first(), duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    want = con.execute(f"SELECT n, mae, mape, accuracy FROM ({queries.SQL['numeric_accuracy']})").fetchone()
    assert got.n == want[0] and all(abs(g - float(w)) < 1e-9 for g, w in zip((got.mae, got.mape, got.accuracy), want[1:], strict=True))


def test_numeric_accuracy_of_nulls_and_zeros(spark):
    rows = spark.createDataFrame([("a", 1.0, None), ("a", None, 2.0), ("b", 3.0, 0.0), ("b", 4.0, 8.0)], "field string, predicted double, actual double")
    assert [tuple(r) for r in evaluate.numeric_accuracy(rows).collect()] == [("b", 2, 3.5, 0.5, 0.5)]


def test_missing_fields_repeat_nothing(spark, sf):
    assert plan_size(queries.QUERIES["missing_fields"](spark, sf)) < 60_000  # 3,150,000 where a filter repeated extraction


def test_missing_fields_of_few_rows(spark):
    rows = spark.createDataFrame([(None, None, "x"), (None, "y", "x"), ("z", "y", "x")], "a string, b string, c string")
    assert sorted(tuple(r) for r in evaluate.missing_fields(rows, ("a", "b", "c")).collect()) == [("a", 2, 1.0), ("b", 1, 0.5)]
    assert evaluate.missing_fields(rows.where("false"), ("a", "b", "c")).count() == 0


def test_items_are_made_once(spark, sf):
    assert plan_size(queries.QUERIES["v2_items"](spark, sf)) < 30_000  # 81,000 where a filter repeated them


@pytest.mark.parametrize("profile", ["v1", "base", "robust"])
def test_heads_alone_are_those_of_whole_extraction(spark, sf, profile):
    v = vouchers.rendered(spark, sf, noisy=True).where("voucher_id % 40 < 3")
    odd = F.when(F.col("voucher_id") % 40 == 0, F.regexp_replace("raw_ocr_text", r"(?m)^(Total|Grand|Supp|Voucher).*$", "x rs 55.00 ttal ? 12.50 amt: 5 net payable 9")).otherwise(F.col("raw_ocr_text"))
    v = v.withColumn("raw_ocr_text", odd)
    columns = ("voucher_id", *queries.SCORED, "overall")
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(profiles.extract(v, profile, heads_only=True)) == rows(profiles.extract(v, profile))


def test_robust_items_of_one_pass(spark):
    shown = "Mango 1 2.50 2.50\nGrape\n12 1 12"
    made = spark.createDataFrame([(shown,)], "t string").select(F.inline(profiles.robust_items(F.col("t"), F.lit(None)))).collect()
    assert [(r.item_name, float(r.quantity), float(r.unit_price), float(r.line_amount)) for r in made] == [("Mango", 1, 2.5, 2.5), ("Grape", 12, 1, 12)]


def test_anchors_of_several_lengths_share_windows(spark):
    """Equal and near windows are found for anchors of one word and of two; those of other lengths of words aren't."""
    rows = spark.createDataFrame([(1, "s", "Voucher Nunber 123\nTotal 5"), (2, "S ", "Voucher Number 77\nTotai 6"), (3, "t", "Voucher Number 5")], "voucher_id long, supplier_name string, raw_ocr_text string")
    model = spark.createDataFrame([("S", "voucher_number", "Voucher Number", 3, 1), ("S", "gross_total", "Total", 2, 1), ("S", "net_total", "Grand Total", 2, 1)], "supplier_key string, field string, anchor string, n long, first_seen long")
    assert sorted((r.voucher_id, r.field, r.value) for r in learn.find_all(rows, model, 0.75).collect()) == [(1, "gross_total", "5"), (1, "voucher_number", "123"), (2, "gross_total", "6"), (2, "voucher_number", "77")]


def test_decimal_misreads_are_seen_wherever_a_fix_matches(spark):
    """The one pattern that lets texts by matches in each text in which a fix matches, as a whole or in one of its lines."""
    made = ["12on", "x\n45h", "77do\ny", "123d", "1234567890123.00", "a.00", "b00", "999o0", "podon", "8. x", "8.\nx", "x 1234 y", "x 1234\u0085", "x\n1234", "1.234.00", "1.2.34", "12.345", "5.000.00"]
    docs = spark.createDataFrame([(x,) for x in made], "t string")
    fixes = (*text.DECIMAL_FIXES, *text.POINT_FIXES)
    hit = lambda c: F.greatest(*[c.rlike(p).cast("int") for p, _ in fixes]) == 1
    seen = F.col("t").rlike(text.DECIMAL_MISREADS) | F.col("t").rlike(text.POINT_MISREADS)
    assert docs.where(hit(F.col("t")) | F.exists(F.split("t", "\n"), hit)).count() == len(made)
    assert docs.where(~seen).count() == 0
    assert spark.range(1).where(F.lit("Total 3 1234.56\n(-) Un1oading 10.07").rlike(text.DECIMAL_MISREADS)).count() == 0


def test_patterns_of_deductions_begin_with_a_class():
    """Where a pattern begins with alternatives or letters in both cases, Java compares them at every character."""
    assert all(p.startswith(("[", r"\(")) for *_, patterns in extract.QUALITY_DEDUCTIONS for p in patterns)
