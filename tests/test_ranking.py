"""Places of large and null groups; pages by offset and by the last row agree."""

import random

from pyspark.sql import functions as F

from slipmill.operators import ranking


def test_places(spark):
    rng = random.Random(1)
    rows = [("hot", i, rng.random()) for i in range(3000)] + [(g, i, rng.random()) for g in ("a", "b", None) for i in range(40)] + [("c", None, 1.0)]
    rng.shuffle(rows)
    got = ranking.placed(spark.createDataFrame(rows, "g string, i long, x double").repartition(7), "g", ("i",)).collect()
    want = {}
    for g, i, _ in sorted(rows, key=lambda r: (str(r[0]), r[1] or 0)):
        want.setdefault(g, []).append(i)
    assert len(got) == len(rows) and all(want[r.g][r.place - 1] == r.i for r in got)
    assert ranking.placed(spark.createDataFrame([], "g string, i long"), "g", ("i",)).count() == 0


def test_pages_agree(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *range(5)])) for i in range(103)]
    df = spark.createDataFrame(rows, "id long, day long")
    order, last, seen = ("day", "id"), None, []
    while page := ranking.page_after(df, last, 10, order).collect():
        number = len(seen) // 10 + 1
        assert page == ranking.page(df, number, 10, F.col("day").desc_nulls_last(), F.col("id").desc()).collect()
        seen += page
        last = page[-1].asDict()
    assert len(seen) == 103


def test_batches_without_vouchers(spark):
    batches = spark.createDataFrame([("B1", "done"), ("B2", "empty")], "batch_id string, status string")
    vouchers = spark.createDataFrame([("B1", 2, 5), ("B1", 1, 5), ("B1", 3, 4), ("gone", 9, 1), (None, 8, 1)], "batch_id string, voucher_id long, created_at long")
    got = sorted((r.batch_id, r.status, r.place, r.voucher_id) for r in ranking.batches_with_vouchers(batches, vouchers).collect())
    assert got == [("B1", "done", 1, 3), ("B1", "done", 2, 1), ("B1", "done", 3, 2), ("B2", "empty", None, None)]
