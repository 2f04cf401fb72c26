"""Small cases with known answers: merged labels, short lines, region items, the backup profile, sessions, gains."""

from decimal import Decimal

from pyspark.sql import functions as F

from slipmill.functions import text
from slipmill.operators import backup, context, evaluate, history, learn, profiles


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_split_merged(spark):
    split = lambda t: one(spark, t, text.split_merged)
    assert split("VoucherDate VoucherNumber10012026") == "VoucherDate 10/01/2026\nVoucherNumber "
    assert split("voucher date voucher no0010012026 113\nx") == "VoucherDate 10/01/2026\n113\nx"
    assert split("VoucherDate VoucherNumber1070172026") == "Voucher Date Voucher Number1070172026"  # no such month
    assert split("VoucherDate VoucherNumber05012023") == "Voucher Date Voucher Number05012023"  # its zero is a prefix
    assert split("SuppName  x") == "Supp Name x"
    assert split(None) is None and split("") == ""


def test_correct_lines(spark):
    model = spark.createDataFrame([("I5", "15", 8, 1), ("I5", "I6", 2, 2), ("a", "b", 1, 3), ("a", "c", 1, 4), ("longer", "x", 9, 5)], "bad string, good string, n long, first_seen long")
    rows = spark.createDataFrame([(1, "No\nI5\na\n\nlonger"), (2, None), (3, "I5I5"), (4, "I5\nI5")], "voucher_id long, raw_ocr_text string")
    got = {r.voucher_id: r.raw_ocr_text for r in learn.correct_lines(rows, model).collect()}
    assert got == {1: "No\n15\na\n\nlonger", 2: None, 3: "I5I5", 4: "15\n15"}


def test_region_items(spark):
    made = one(spark, "Qty Price Amount\nApples 3 10.00 30.00\n4 12.00\nPears 7.00 40.00\n1 25.00\nnothing\n1234", profiles.region_items)
    d = Decimal
    assert [tuple(i) for i in made] == [
        ("Apples", d("3"), d("10.00"), d("30.00")), ("Item", d("4.00"), d("3.00"), d("12.00")), ("Pears", None, d("7.00"), d("40.00")),
        ("Item", None, d("1.00"), d("25.00")), ("Item", None, None, d("12.34")),
    ]
    assert one(spark, None, profiles.region_items) == []


def test_near_words_and_names(spark):
    docs = spark.createDataFrame([(1, "Dat3 6rand  T0tal"), (2, "nothing here"), (3, None)], "voucher_id long, raw_ocr_text string")
    got = {r.voucher_id: r.near for r in backup.near_words(docs).collect()}
    assert got == {1: {"dat3": "date", "6rand": "grand", "t0tal": "total"}, 2: None, 3: None}
    names = spark.createDataFrame([("Aman Trcders",), ("abc",), ("Quite Other",), (None,)], "name string")
    known = spark.createDataFrame([("Aman Traders",), ("Aman Traders",), ("Bman Traders",), (None,), ("abd",)], "known string")
    assert [(r.name, r.known) for r in backup.near_names(names, known).collect()] == [("Aman Trcders", "Aman Traders")]
    fixed = backup.fix_names(names, "name", known).collect()
    assert sorted(str(r.name) for r in fixed) == ["Aman Traders", "None", "Quite Other", "abc"]


def test_backup_profile(spark):
    shown = "BIG TRADERS 123456\nVouch#421\nDat3 03/04/2024\nSupp Name: None RAVI/K\n2 10.00 20.00\nPears 1 5.00 5.00\nTotal 2 25.00\n(-)\nComm 4.00\nfoo 1.50\n7\n6rand T0tal 12.50\nGrand Total 13.00"
    rows = spark.createDataFrame([(1, shown), (2, None), (3, "")], "voucher_id long, raw_ocr_text string")
    got = {r.voucher_id: r for r in backup.extract(rows, corrected=False).collect()}
    r = got[1]
    assert (r.voucher_number, str(r.voucher_date), r.supplier_name, r.vendor_details) == ("421", "2024-04-03", "RAVI/K", "BIG TRADERS")
    assert [i.item_name for i in r["items"]] == ["Item 1", "Pears"] and r.gross_total == 25 and r.net_total == 13
    assert [(x.deduction_type, float(x.amount)) for x in r.deductions] == [("Commission", 4.0), ("foo", 1.5), ("Other", 7.0), ("6rand T0tal", 12.5)]
    assert float(r.total_deductions) == 25.0 and float(r.mismatch) == 13.0 and r.parse_confidence == 91.67
    assert all(got[k].voucher_number is None and got[k]["items"] == [] and got[k].parse_confidence == 0 for k in (2, 3))


def test_sessions(spark):
    rows = [(1, 10, "f", "a", "b"), (2, 20, "f", "a", "b"), (2, 20, "f", None, "c"), (3, 30, "g", "x", "y")]
    c = spark.createDataFrame(rows, "session long, ts long, field string, auto string, corrected string")
    p = history.learned(c)
    made = history.sessions(c, p)
    assert sorted(tuple(r) for r in made.collect()) == [(1, 10, 1, 1), (2, 20, 2, 1), (3, 30, 1, 1)]
    assert tuple(history.summary(made).first()) == (3, 4, 3, 30)
    assert [r.session for r in history.recent_sessions(made, 2).collect()] == [3, 2]
    assert sorted((r.field, r.corrected) for r in history.last_patterns(p, 1).collect()) == [("f", "c"), ("g", "y")]
    used, every = (spark.createDataFrame(x, "id long") for x in ([(1,), (1,)], [(1,), (2,)]))
    assert [r.id for r in history.not_trained(every, used).collect()] == [2]
    empty = history.sessions(c.limit(0), history.learned(c.limit(0)))
    assert tuple(history.summary(empty).first()) == (0, 0, 0, None)


def test_gains(spark):
    schema = "field string, n long, accuracy double"
    before = spark.createDataFrame([("a", 20, 0.5), ("b", 20, 0.0), ("c", 20, 0.0), ("d", 9, 0.1)], schema)
    after = spark.createDataFrame([("a", 20, 0.75), ("b", 20, 0.25), ("c", 20, 0.0), ("d", 9, 0.9)], schema)
    rows = evaluate.improvement(before, after)
    got = {r.field: (r.before, r.after, r.absolute, r.percent) for r in rows.collect()}
    assert got == {"a": (50.0, 75.0, 25.0, 50.0), "b": (0.0, 25.0, 25.0, 100.0), "c": (0.0, 0.0, 0.0, 0.0)}
    assert tuple(evaluate.improvement_summary(rows).first()) == (3, 50.0, "b")


def test_places_of_values(spark):
    t = "aaa\nName RAVI/K x\nRavi/k"
    assert one(spark, t, lambda c: evaluate.around(c, F.lit("ravi/K"), 3)) == "me RAVI/K x\n"
    assert one(spark, t, lambda c: evaluate.contexts(c, F.lit("RAVI/K"), 2)) == ["e ravi/k x", "ravi/k"]
    assert one(spark, t, lambda c: evaluate.line_with(c, F.lit("RAVI/K"))) == "Name RAVI/K x"
    assert one(spark, t, lambda c: evaluate.around(c, F.lit("zzz"))) is None and one(spark, None, lambda c: evaluate.line_with(c, F.lit("a"))) is None


def test_field_accuracy(spark):
    schema = "voucher_id long, supplier_name string, gross_total string"
    made = spark.createDataFrame([(1, " Ravi", "90.00"), (2, None, None), (3, "x", "5.00"), (4, "", "7")], schema)
    right = spark.createDataFrame([(1, "RAVI ", "100.00"), (2, "a", "1.00"), (3, "x", "0.00"), (4, None, "7.00")], schema)
    got = {r.field: (r.n, round(r.accuracy, 6)) for r in evaluate.field_accuracy(made, right, ("supplier_name", "gross_total")).collect()}
    assert got == {"supplier_name": (4, 0.75), "gross_total": (3, 0.95)}


def test_merged_deductions(spark):
    d = Decimal
    rows = [([("A", d(1)), ("B", d(2)), ("A", d(3))], {"B": d(5), "C": d(6)}), ([], {"Z": d(1), "Y": d(2)}), (None, {"Z": d(1)}), ([("A", d(1))], None), (None, None)]
    df = spark.createDataFrame(rows, "d array<struct<deduction_type:string,amount:decimal(12,2)>>, f map<string,decimal(12,2)>")
    got = [r.x and [(d.deduction_type, int(d.amount)) for d in r.x] for r in df.select(context.merged_deductions(F.col("d"), F.col("f")).alias("x")).collect()]
    assert got == [[("A", 3), ("B", 5), ("C", 6)], [("Y", 2), ("Z", 1)], [("Z", 1)], [("A", 1)], None]


def test_anchors_of_all_fields_in_one_pass(spark):
    text = "Vouch No: 77\nNet Tota1 12.00\nComm 3.50\nDate\n03/04/2024"
    rows = spark.createDataFrame([(1, text, "s"), (2, text, "other"), (3, None, "S"), (4, text, None)], "voucher_id long, raw_ocr_text string, supplier_name string")
    model = spark.createDataFrame([("S", "voucher_number", "Vouch No", 5), ("S", "net_total", "Net Total", 3), ("S", "deduction_Comm", "Comm", 1), ("S", "voucher_date", "Date", 2), ("S", "gross_total", "Net Total", 1)], "supplier_key string, field string, anchor string, n long")
    got = {(r.voucher_id, r.field): r["value"] for r in learn.find_all(rows, model).collect()}
    assert got == {(1, "voucher_number"): "77", (1, "net_total"): "12.00", (1, "gross_total"): "12.00", (1, "deduction_Comm"): "3.50", (1, "voucher_date"): "03/04/2024"}


def test_labels_beside_other_letters(spark):
    docs = spark.createDataFrame([("élan 5 Élan 6 x_ab 7 İ 8 no\u000b9",), (None,)], "text string")
    got = [tuple(r) for r in evaluate.frequent_labels(docs, "text").collect()]
    assert got == [("lan", 2), ("i", 1)]
