"""Three sessions give the models that one gives, and the models of training at once."""

import pytest
from pyspark.sql import functions as F

from slipmill.operators import continuous, history, learn
from slipmill.plans import queries

AS_OF = "2024-06-01 00:00:00"


def rows(df):
    return sorted((str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect()))


@pytest.fixture(scope="module")
def made(spark, sf, tmp_path_factory):
    e = queries.examples(spark, sf).withColumns({"id": F.concat_ws("/", "voucher_id", "field"), "ts": F.timestamp_seconds(1_700_000_000 + F.col("voucher_id") * 60), "source": F.when(F.col("voucher_id") % 2 == 0, "a").otherwise("b")}).persist()
    b = queries.boxes(spark, sf).dropDuplicates(["id"]).persist()
    stores = {}
    for name, sessions in (("three", (1, 2, 3)), ("one", (3,))):
        store = stores[name] = continuous.ModelStore(spark, f"file://{tmp_path_factory.mktemp(name)}")
        for s in sessions:
            continuous.train_more(store, e.where(F.col("voucher_id") % 3 < s), b.where(F.col("id") % 3 < s), s, AS_OF)
    return stores, e, b


def test_three_sessions_equal_one(made):
    three, one = (continuous.models(s) for s in (made[0]["three"], made[0]["one"]))
    assert set(three) == {*continuous.MODELS, "crops"}
    for name in three:
        assert rows(three[name]) == rows(one[name]), name


def test_equal_training_at_once(made):
    stores, e, b = made
    got, want = continuous.models(stores["three"]), learn.train_all(e, b)
    for name, model in want.items():
        columns = model.columns
        if name == "patterns":  # none is old enough to go here but those that are unsure
            want_rows = rows(model.where("confidence >= 0.3").select(columns))
            assert rows(got[name].where("confidence >= 0.3").select(columns)) == want_rows
        else:
            assert rows(got[name].select(columns)) == rows(model.select(columns)), name


def test_sessions_and_repeats(spark, made):
    store, e, b = made[0]["three"], made[1], made[2]
    before = store.manifest()
    continuous.train_more(store, e, b, 3, AS_OF)  # that session is in
    assert store.manifest() == before
    s = {r.session: r for r in continuous.sessions(store).collect()}
    assert sum(r.n_corrections for r in s.values()) == e.count() and sum(r.n_boxes for r in s.values()) == b.count()
    assert sum(r.n_patterns for r in s.values()) == learn.value_model(e).count()
    assert history.summary(continuous.sessions(store).drop("n_boxes")).first()["n_sessions"] == 3
    want = rows(continuous.models(store)["values"])
    store.compact()
    assert rows(continuous.models(store)["values"]) == want and store.applied("training") == 3
    continuous.train_more(store, e, b, 4, AS_OF)  # nothing new
    assert rows(continuous.models(store)["values"]) == want and continuous.sessions(store).where("session = 4").first()["n_corrections"] == 0


def test_pruned_patterns_come_back(spark, tmp_path):
    columns = "id long, ts timestamp, voucher_id long, field string, auto string, corrected string, raw_ocr_text string, supplier_name string, source string"
    old, new = "2023-01-01", "2024-05-20"
    make = lambda data: spark.createDataFrame(data, columns.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    first = make([(i, old, i, "supplier_name", "X", f"name {i}", "t", None, "a") for i in range(4)] + [(9, old, 9, "supplier_name", "Y", "sure", None, "s", None)])
    none = spark.createDataFrame([], "id long, user_crop struct<x:double,y:double,width:double,height:double>, auto_crop struct<x:double,y:double,width:double,height:double>")
    store = continuous.ModelStore(spark, f"file://{tmp_path}")
    continuous.train_more(store, first, none, 1, AS_OF)
    assert [r.key for r in continuous.models(store)["patterns"].collect()] == ["supplier_name:y"]
    continuous.train_more(store, make([(20, new, 20, "supplier_name", "x ", "name 0", "t", None, "a")]), none, 2, AS_OF)
    p = {r.key: r for r in continuous.models(store)["patterns"].collect()}
    assert p["supplier_name:x"].corrected == "name 0" and p["supplier_name:x"].total == 5
    assert continuous.models(store)["crops"].first()["n"] == 0
