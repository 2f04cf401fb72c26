"""Training that goes on: what new examples add to the counts of all models, kept as layers of one versioned store.

Every model is a table of counts, and counts add up. A session writes what its new examples count, their ids, and a row
about itself, in one commit; earlier layers aren't read but for the ids and the patterns that are known. The models are
the sums of all layers, so that sessions one after another give what one session over all examples gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmill.operators import context, history
from slipmill.operators.learn import anchor, best, crop_examples, substitutions
from slipmill.sources.snapshots import Snapshots

#: The models, the names of their keys and of what is counted for a key.
MODELS = {
    "values": (("field", "auto"), "corrected"), "substitutions": (("bad",), "good"), "anchors": (("supplier_key", "field"), "anchor"), "sources": (("source",), None), "patterns": (("key",), "corrected"),
    "contexts": (("field", "context"), "corrected"), "suppliers": (("supplier_key", "field"), "corrected"), "places": (("field",), "place"), "neighbours": (("field", "side"), "word"),
}
SIDES = ("x", "y", "width", "height")


class ModelStore(Snapshots):
    """Layers of counts (model, key, value, n, first_seen, last_seen), moments (of crops), trained (id, session) and sessions.

    Read as sums of the layers; compact() writes those sums.
    """

    def __init__(self, spark, folder: str):
        super().__init__(spark, folder, key="session", leader="sessions")

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        t = self.every(version)
        return t | {
            "counts": t["counts"].groupBy("model", "key", "value").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")),
            "moments": t["moments"].agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(kind).alias(c) for c, kind in t["moments"].dtypes]),
        }


def facts(examples: DataFrame) -> DataFrame:
    """(model, key, value, voucher_id, ts): what each example (id, ts, voucher_id, field, auto, corrected, raw_ocr_text,
    supplier_name, source) counts for, but substitutions."""
    supplier = F.upper(F.trim("supplier_name"))
    e = examples.withColumns({"supplier_key": supplier, "context": context.context_key(F.col("field"), F.col("raw_ocr_text"))})
    right, both = F.col("corrected").isNotNull(), F.col("auto").isNotNull() & F.col("corrected").isNotNull()
    differ = (F.coalesce("auto", F.lit("")) != "") & (F.coalesce("corrected", F.lit("")) != "") & (F.col("auto") != F.col("corrected"))
    found = F.when(F.coalesce("corrected", F.lit("")) != "", anchor(F.col("raw_ocr_text"), F.col("corrected")))

    def fact(model: str, holds: Column, key: tuple[Column, ...], value: Column) -> Column:
        made = F.struct(F.lit(model).alias("model"), F.array(*[k.cast("string") for k in key]).alias("key"), value.cast("string").alias("value"))
        return F.when(reduce(lambda a, k: a & k.isNotNull(), key[:-1] if model == "sources" else key, holds), made)

    c = F.col
    own = F.array_compact(F.array(
        fact("values", differ, (c("field"), c("auto")), c("corrected")), fact("patterns", both, (F.concat("field", F.lit(":"), F.lower(F.trim("auto"))),), c("corrected")),
        fact("contexts", right, (c("field"), c("context")), c("corrected")), fact("suppliers", right, (c("supplier_key"), c("field")), c("corrected")),
        fact("anchors", c("_anchor").isNotNull(), (c("supplier_key"), c("field")), c("_anchor")), fact("sources", F.lit(True), (c("source"),), F.lit("")),
    ))
    rows = e.withColumn("_anchor", found).select("voucher_id", "ts", F.inline(own))
    keyed = lambda df, model, key, value: df.select("voucher_id", "ts", F.lit(model).alias("model"), F.array(*key).alias("key"), F.col(value).alias("value"))
    return rows.unionByName(keyed(context.placed(examples), "places", ("field",), "place")).unionByName(keyed(context.neighbours(examples), "neighbours", ("field", "side"), "word"))


def counts(examples: DataFrame) -> DataFrame:
    """(model, key, value, n, first_seen, last_seen) of examples."""
    plain = facts(examples).groupBy("model", "key", "value").agg(F.count("*").alias("n"), F.min("voucher_id").alias("first_seen"), F.max("ts").alias("last_seen"))
    subs = substitutions(examples).select(F.lit("substitutions").alias("model"), F.array("bad").alias("key"), F.col("good").alias("value"), "n", "first_seen", F.lit(None).cast("timestamp").alias("last_seen"))
    return plain.withColumn("last_seen", F.col("last_seen").cast("timestamp")).unionByName(subs)


def moments(boxes: DataFrame) -> DataFrame:
    """One row of sums over annotated boxes: n, and of each side's difference the sum and the sum of squares."""
    sums = [F.coalesce(F.sum(f), F.lit(0.0)).alias(f"{name}_{s}") for s in SIDES for name, f in (("sum", F.col(f"d_{s}")), ("square", F.col(f"d_{s}") * F.col(f"d_{s}")))]
    return crop_examples(boxes).agg(F.count("*").alias("n"), *sums)


def train_more(store: ModelStore, examples: DataFrame, boxes: DataFrame, session: int, as_of: str) -> None:
    """One session: what no earlier one used of examples and boxes (by id) is added to the models, and the session recorded.

    Sessions have ascending numbers; one that is in the store already changes nothing. Examples of one id count once.
    """
    if session <= store.applied("training"):
        return
    first = not store.versions()
    known = None if first else store.every()
    ids = lambda prefix, df: df.withColumn("id", F.concat(F.lit(prefix), F.col("id").cast("string"))).dropDuplicates(["id"])
    new, crops = (df if first else history.not_trained(df, known["trained"]) for df in (ids("e:", examples), ids("c:", boxes)))
    new, crops = new.persist(), crops.persist()
    try:
        added = counts(new).persist()
        fresh = added.where("model = 'values'").select("key", "value")
        if not first:
            fresh = fresh.join(known["counts"].where("model = 'values'").select("key", "value").distinct(), ["key", "value"], "left_anti")
        n, boxes_, patterns = new.count(), crops.count(), fresh.count()
        row = store.spark.range(1).select(
            F.lit(session).cast("long").alias("session"), F.lit(as_of).cast("timestamp").alias("ts"), F.lit(n).cast("long").alias("n_corrections"), F.lit(boxes_).cast("long").alias("n_boxes"), F.lit(patterns).cast("long").alias("n_patterns")
        )
        trained = new.select("id").unionByName(crops.select("id")).withColumn("session", F.lit(session).cast("long"))
        store.commit({"counts": added, "moments": moments(crops), "trained": trained, "sessions": row}, "training", session)
        added.unpersist()
    finally:
        new.unpersist()
        crops.unpersist()


def models(store: ModelStore, version: int | None = None) -> dict[str, DataFrame]:
    """All models by name, as of a version: count tables with their own key columns, patterns with their confidence, crops.

    Patterns that were last seen 90 days before the last session, and are unsure, aren't among them; one that is seen
    again comes back with all that it counted.
    """
    t = store.read(version)
    out = {}
    for name, (keys, value) in MODELS.items():
        rows = t["counts"].where(F.col("model") == name)
        out[name] = rows.select(*[F.col("key")[i].alias(k) for i, k in enumerate(keys)], *([F.col("value").alias(value)] if value else []), "n", "first_seen", "last_seen")
    seen = out["patterns"].groupBy("key").agg(F.max("last_seen").alias("last_seen"), F.count("*").alias("values"))
    sure = best(out["patterns"], ["key"], "corrected").join(seen, "key")
    confidence = F.when((F.col("values") == 1) & (F.col("total") >= 3), F.least(F.lit(0.95), F.col("share") + 0.1)).otherwise(F.col("share"))
    as_of = t["sessions"].agg(F.max("ts")).first()[0]
    out["patterns"] = context.pruned(sure.select("key", "corrected", "n", "total", confidence.alias("confidence"), "last_seen"), str(as_of))
    mean = {s: F.col(f"sum_{s}") / F.nullif("n", F.lit(0)) for s in SIDES}
    spread = {s: F.sqrt(F.greatest(F.lit(0.0), F.col(f"square_{s}") / F.nullif("n", F.lit(0)) - mean[s] * mean[s])) for s in SIDES}
    out["crops"] = t["moments"].select("n", *[c.alias(f"{name}_{s}") for s in SIDES for name, c in (("mean", mean[s]), ("std", spread[s]))])
    return out


def sessions(store: ModelStore) -> DataFrame:
    return store.every()["sessions"]
