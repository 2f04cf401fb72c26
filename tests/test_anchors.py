"""Anchors: what stands before a value's last place, found without a pattern where none is needed."""

from pyspark.sql import functions as F

from slipmill.operators import learn

PAD = "x" * 29
ODD = [
    ("Voucher Number 123\nTotal 4 123.45", "123"), ("123 only first", "123"), ("No 123", "123"), ("aa 11 11 11 11 bb", "11"), ("ab 1111 c", "11"), (f"No 77 {PAD} 77", "77"), (f"Nr 77{PAD}x77", "77"), (f"Nr 77{PAD}77", "77"),
    ("No: RaviA/K then ravia/k", "RAVIA/K"), ("Supp Name RAVIA/K\nQty", "ravia/k"), ("Éa No 55 é", "55"), ("Name \u212aumar x", "kumar"), ("one two three four five 99", "99"), ("a\nb 9.5", "9.5"), ("x" * 80 + " last words - 12/03/2021", "12/03/2021"),
    ("abc \\E5 x", "\\E5"), ("abc", ""), ("", ""), ("abc", "zz"), (None, "a"), ("a", None), ("№ \U0001f600 two words 42 end", "42"), ("İ Name RAVI", "RAVI"), ("line\r\nNumber 31", "31"), ("tab\tNo.= 8080 80", "80"),
]


def searched(text, value):
    """The anchor by a pattern alone."""
    before = F.regexp_extract_all(text, F.concat(F.lit(r"(?is)(.{1,30})\Q"), F.replace(value, F.lit("\\E"), F.lit("")), F.lit(r"\E")), F.lit(1))
    last = F.regexp_replace(F.element_at(F.concat(F.array(F.lit("")), before), -1), r"^[\s\S]*\n", "")
    words = F.filter(F.split(F.regexp_replace(last, r"[\s:\-=.]+$", ""), r"\s+"), lambda w: w != "")
    made = F.array_join(F.slice(words, F.greatest(F.size(words) - 3, F.lit(1)), F.lit(4)), " ")
    return F.when(F.lower(text).contains(F.lower(value)) & (F.length(made) > 2), made)


def test_anchors_are_those_of_the_pattern(spark):
    parts = ["12", "1", "21 ", "\n", "ab ", "x" * 27, "No: ", "é"]
    made = [("".join(parts[(i * 7919 + j * 104729 + i * j) % len(parts)] for j in range(9)), v) for i in range(120) for v in ("12", "1", "21")]
    rows = spark.createDataFrame(ODD + made, "t string, v string")
    got = rows.select("t", "v", learn.anchor(F.col("t"), F.col("v")).alias("a"), searched(F.col("t"), F.col("v")).alias("b"))
    assert got.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == []


def test_plain_places_need_no_pattern(spark, monkeypatch):
    failing = lambda *_: F.raise_error(F.lit("a pattern was looked for")).cast("array<string>")
    rows = spark.createDataFrame([("Voucher Number 123\nTotal 4 123.45\nNet 88.10", "88"), ("Supp Name RAVI\nQty", "ravi")], "t string, v string")
    monkeypatch.setattr(learn.F, "regexp_extract_all", failing)
    made = rows.select(learn.anchor(F.col("t"), F.col("v")).alias("a")).collect()
    assert [r.a for r in made] == ["Net", "Supp Name"]


def test_few_pairs_meet_the_matcher(spark, monkeypatch):
    """Windows as long as an anchor, but of other characters, are told apart without the matcher."""
    rows = spark.createDataFrame([(1, "Voucher Number 123\n299.52 1198.08\n1 299.52 1198.08", "RAVI"), (2, "Vaucher Number 55\n11", "RAVI")], "voucher_id long, raw_ocr_text string, supplier_name string")
    model = spark.createDataFrame([("RAVI", "voucher_number", "Voucher Number", 3, 1)], "supplier_key string, field string, anchor string, n long, first_seen long")
    assert {(r.voucher_id, r.value) for r in learn.find_by_anchor(rows, model, "voucher_number").collect()} == {(1, "123"), (2, "55")}
    monkeypatch.setattr(learn, "ratio", lambda a, b: F.raise_error(F.lit("compared")).cast("double"))
    assert [r.value for r in learn.find_by_anchor(rows.where("voucher_id = 1"), model, "voucher_number").collect()] == ["123"]
