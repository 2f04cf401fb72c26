"""Commits of several tables: all or nothing, one record a key, batches once."""

import pytest
from pyspark.sql import functions as F

from slipmill.sources.snapshots import Snapshots


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/store")


def tables(spark, rows):
    """rows: {voucher_id: [item, ...]}; the leader has how many items there are."""
    master = spark.createDataFrame([(k, len(v)) for k, v in rows.items()], "voucher_id long, n long")
    items = spark.createDataFrame([(k, i) for k, v in rows.items() for i in v], "voucher_id long, item string")
    return {"master": master, "items": items}


def read(store, version=None):
    t = store.read(version)
    found = {r.voucher_id: [] for r in t["master"].collect()}
    assert sum(len(v) for v in found.values()) == 0 and t["master"].count() == len(found)
    for r in t["items"].collect():
        found[r.voucher_id].append(r["item"])
    return {k: sorted(v) for k, v in found.items()}


def test_records_are_replaced_whole(spark, store):
    assert store.manifest()["layers"] == []
    with pytest.raises(ValueError, match="nothing was committed"):
        store.read()
    assert store.commit(tables(spark, {1: ["a", "b"], 2: ["c"], 3: []})) == 1
    assert store.commit(tables(spark, {2: [], 3: ["d"], None: ["x"]})) == 2
    now = {1: ["a", "b"], 2: [], 3: ["d"], None: ["x"]}
    assert read(store) == now and read(store, 1) == {1: ["a", "b"], 2: ["c"], 3: []}
    assert store.compact() == 3 and len(store.manifest()["layers"]) == 1 and read(store) == now and read(store, 2) == now
    assert store.compact() == 3
    store.expire(1)
    assert store.versions() == [3] and read(store) == now
    layers = store._path("layers")
    assert len(store._fs().listStatus(layers)) == 1


def test_failed_write_leaves_the_old_tables(spark, store):
    store.commit(tables(spark, {1: ["a"]}))
    new = tables(spark, {1: ["b"], 2: ["c"]})
    with pytest.raises(Exception, match="no such item"):
        store.commit(new | {"items": new["items"].withColumn("item", F.raise_error(F.lit("no such item")).cast("string"))})
    assert read(store) == {1: ["a"]} and store.versions() == [1]
    with pytest.raises(ValueError, match="the tables here are"):
        store.commit({"master": new["master"]})
    with pytest.raises(ValueError, match="needs the table master"):
        store.commit({"items": new["items"]})


def test_batches_enter_once(spark, store):
    store.commit(tables(spark, {1: ["a"]}), "stream", 0)
    assert store.commit(tables(spark, {1: ["again"]}), "stream", 0) == 1
    store.commit(tables(spark, {1: ["other"]}), "other stream", 0)
    store.commit(tables(spark, {2: ["b"]}), "stream", 1)
    assert read(store) == {1: ["other"], 2: ["b"]} and store.manifest()["applied"] == {"stream": 1, "other stream": 0}
    store.compact()
    assert store.applied("stream") == 1 and store.applied("none") == -1


def test_two_writers_take_different_numbers(spark, store):
    store.commit(tables(spark, {1: ["a"]}))
    taken, first = store._put, []

    def late(manifest):
        if not first:  # another writer commits between the look at the last manifest and the new one
            first.append(Snapshots(spark, store.folder).commit(tables(spark, {2: ["b"]})))
        return taken(manifest)

    store._put = late
    assert store.commit(tables(spark, {3: ["c"]})) == 3 and first == [2]
    assert read(store) == {1: ["a"], 2: ["b"], 3: ["c"]}
