"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas."""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipmill.llm.common import KEYS_ROWS, numbered, packed, stored, text_key, unpacked

SHARDS, ROUNDS, SLACK, BUCKETS, SUB_ROWS = 24, 8, 0.02, 1024, 20_000
#: Units of more rows than SALT_ROWS are dealt over SALTS tasks. A unit is a group, or a part of one of more than 1 / PART of a shard.
SALT_ROWS, SALTS, PART = 200, 64, 4
#: Rounds end when less than this share of linked bytes moves. Shards may differ by this share of their mean, then links are cut.
STILL, UNEVEN = 0.001, 0.005


def measured(docs: DataFrame) -> DataFrame:
    """The user's columns but text, packed, with doc_id, size, text_crc32, the two halves of the text's key and _n among equal rows."""
    a, b = text_key(F.col("text"))
    keep = [c for c in docs.columns if c not in ("text", "size", "text_crc32", "shard", "slot", "law", "grown_shard")]
    rows = docs.select(
        packed(keep), "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), a.alias("_a"), b.alias("_b"), F.col("text").isNotNull().alias("_linked"),
    )
    return numbered(stored(rows, "measured"), ["doc_id", "_a", "_b", "_linked"])


def bucket(count: int, seed: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(count)).cast("int")


def units(rows: DataFrame, part: float) -> DataFrame:
    """(_a, _b, pieces, n) of groups of equal texts: those of more than `part` bytes go in pieces, dealt by a hash of the row."""
    groups = rows.where("_linked").groupBy("_a", "_b").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where("n > 1")
    return groups.select("_a", "_b", F.ceil(F.col("bytes") / max(part, 1.0)).cast("int").alias("pieces"), "n")


def with_units(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with pieces (null for a text that stands once), _piece, and _salt, by which the rows of large units are dealt to tasks."""
    dealt = groups.select("_a", "_b", "pieces", F.when(F.col("n") > SALT_ROWS, SALTS).otherwise(1).alias("salts"))
    # Rows of large groups are told first, by a table of those alone: they are dealt over salts before they meet their group.
    large = stored(dealt.where("salts > 1").select(F.col("_a").alias("_la"), F.col("_b").alias("_lb"), F.col("salts").alias("_ls")), "large")
    n = large.count()
    if n:
        told = rows.join(F.broadcast(large) if n <= KEYS_ROWS else large, F.col("_linked") & (F.col("_a") == F.col("_la")) & (F.col("_b") == F.col("_lb")), "left").drop("_la", "_lb")
    else:
        told = rows.withColumn("_ls", F.lit(None).cast("int"))
    salted = told.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_n", F.lit(3)), F.when(F.col("_linked"), F.coalesce("_ls", F.lit(1))).otherwise(SALTS)).cast("int")).drop("_ls")
    each = dealt.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("_a", "_b", "_salt", "pieces", F.lit(True).alias("_linked"))
    met = salted.join(each, ["_a", "_b", "_salt", "_linked"], "left")
    return met.withColumn("_piece", F.pmod(F.xxhash64("doc_id", "_n", F.lit(4)), F.coalesce("pieces", F.lit(1))).cast("int"))


def propagate(linked: DataFrame, alone: np.ndarray, shards: int, rounds: int, slack: float) -> DataFrame:
    """(_a, _b, _piece, _to): the shard of each unit, after rounds in which units move towards their group's fullest shard.

    linked: (_a, _b, _piece, _shard, bytes), what a unit has in each shard; alone: bytes of texts that stand once. In a round
    each unit wants the shard that holds most of its group's bytes (ties by a hash of both, so that small groups don't all
    want the same), and a shard admits moves up to its quota: what is left of its capacity and what wants to leave it.
    Rounds end when few bytes move. What is scattered still goes to the shard it wants; moves() makes up for that.
    """
    want = F.struct("w", F.xxhash64("_a", "_b", "_shard"))
    state = linked
    for k in range(rounds + 1):
        state = stored(state, "units")
        group = state.groupBy("_a", "_b", "_shard").agg(F.sum("bytes").alias("w")).groupBy("_a", "_b").agg(F.max_by("_shard", want).alias("best"))
        wanted = stored(state.join(group, ["_a", "_b"]), "wanted")
        if k == rounds:
            break
        flows = wanted.groupBy("_shard", "best").agg(F.sum("bytes").alias("bytes")).collect()  # shards x shards at most
        load, inflow, outflow = alone.copy(), np.zeros(shards), np.zeros(shards)
        for f in flows:
            load[f["_shard"]] += f["bytes"]
            if f["best"] != f["_shard"]:
                inflow[f["best"]] += f["bytes"]
                outflow[f["_shard"]] += f["bytes"]
        capacity = (1 + slack) * load.sum() / shards
        rate = [float(min(1, max(0, (capacity - load[i] + outflow[i]) / inflow[i]))) if inflow[i] else 0.0 for i in range(shards)]
        if float(np.dot(rate, inflow)) <= STILL * sum(f["bytes"] for f in flows):
            break
        chance = F.element_at(F.array(*map(F.lit, rate)), F.col("best") + 1)
        accept = bucket(1 << 20, 10 + k, "_a", "_b", "_piece") / float(1 << 20) < chance
        moved = wanted.withColumn("_shard", F.when(accept, F.col("best")).otherwise(F.col("_shard")))
        state = moved.groupBy("_a", "_b", "_piece", "_shard").agg(F.sum("bytes").alias("bytes"))
    return wanted.groupBy("_a", "_b", "_piece").agg(F.when(F.count("*") == 1, F.first("_shard")).otherwise(F.first("best")).alias("_to"))


def moves(cells: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(shard, kind, bucket, new shard): cells that leave the fullest shard for the emptiest while this evens them out.

    cells: (shard, kind, bucket, bytes), shards x 2 x BUCKETS at most. Unlinked documents (kind 0) move first.
    """
    load = np.zeros(shards)
    own: dict[tuple[int, int], list] = {}
    for s, kind, bucket, size in sorted(cells):
        load[s] += size
        own.setdefault((s, kind), []).append((size, bucket))
    for x in own.values():
        x.sort()
    where: dict[tuple[int, int, int], int] = {}
    stop = max(1.0, 0.0005 * load.mean())
    for _ in range(20 * shards * BUCKETS):
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        if gap <= stop:
            break
        for kind in (0, 1):
            x = own.get((high, kind), [])
            # The largest cell of at most half the gap; else the smallest if the gap is larger than it.
            i = bisect.bisect_right(x, (gap / 2, BUCKETS)) - 1
            i = 0 if i < 0 and x and x[0][0] < gap else i
            if i >= 0:
                break
        else:
            break
        size, bucket = x.pop(i)
        load[high] -= size
        load[low] += size
        where[(high, kind, bucket)] = low
    return [(*k, v) for k, v in where.items()]


def evened(rows: DataFrame, shards: int, kind: Column, own: Column, least: float) -> DataFrame:
    """rows with some cells (kind, bucket) moved from full shards to others, if these differ by more than `least` of their mean."""
    rows = rows.withColumns({"_kind": kind.cast("int"), "_bucket": own})
    cells = [tuple(c) for c in rows.groupBy("_shard", "_kind", "_bucket").agg(F.sum("size").alias("bytes")).collect()]
    load = np.zeros(shards)
    for s, _, _, size in cells:
        load[s] += size
    moved = moves(cells, shards) if load.max() - load.min() > least * load.mean() else []
    if not moved:
        return rows
    to = rows.sparkSession.createDataFrame(moved, "_shard int, _kind int, _bucket int, _to int")  # cells are shards x 2 x BUCKETS at most
    return rows.join(F.broadcast(to), ["_shard", "_kind", "_bucket"], "left").withColumn("_shard", F.coalesce("_to", "_shard")).drop("_to")


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """Every document's shard and slot under the law `bytes`: sizes near equal, few groups of equal texts cut.

    Returns docs' columns but text, with size, text_crc32, law, shard, slot (gapless from 0 in each shard) and
    grown_shard (null). Null text has size 8, crc32 0 and no link; a null doc_id counts like a value. Repeated rows
    are separate rows with slots of their own, which may part. Groups of more than a quarter of a shard go in pieces. An
    empty table gives an empty one. Reruns agree.
    """
    rows = stored(measured(docs), "numbered")
    rows = rows.withColumn("_shard", bucket(shards, 1, "doc_id", "_a", "_n"))
    part = (rows.agg(F.sum("size")).first()[0] or 0) / shards / PART
    rows = stored(with_units(rows, stored(units(rows, part), "groups")), "dealt")
    single = F.col("pieces").isNull()
    alone = np.zeros(shards)
    for r in rows.where(single).groupBy("_shard").agg(F.sum("size").alias("bytes")).collect():
        alone[r["_shard"]] = r["bytes"]
    linked = rows.where(~single).groupBy("_a", "_b", "_piece", "_shard").agg(F.sum("size").alias("bytes"))
    placed = propagate(linked, alone, shards, rounds, slack)
    to = placed.join(rows.where(~single).groupBy("_a", "_b", "_piece", "_salt").count().drop("count"), ["_a", "_b", "_piece"])
    there = rows.where(~single).join(to, ["_a", "_b", "_piece", "_salt"]).withColumn("_shard", F.col("_to")).select(rows.columns)
    rows = stored(rows.where(single).unionByName(there), "drawn")
    linked_bucket = F.when(single, bucket(BUCKETS, 5, "_b", "doc_id", "_n")).otherwise(bucket(BUCKETS, 6, "_a", "_b", "_piece"))
    rows = evened(rows, shards, ~single, linked_bucket, 0.0)
    # Whole units may be too coarse for even shards: then some rows go on their own.
    rows = stored(evened(rows, shards, F.lit(0), bucket(BUCKETS, 7, "_b", "doc_id", "_n"), UNEVEN), "evened")
    subs = max(1, -(-rows.count() // (shards * SUB_ROWS)))
    rows = rows.withColumn("_sub", bucket(subs, 8, "_a", "doc_id", "_n"))
    before = Window.partitionBy("_shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_shard", "_sub").count().withColumn("_from", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inner = F.row_number().over(Window.partitionBy("_shard", "_sub").orderBy("doc_id", "_a", "_b", "_n"))
    slot = (F.col("_from") + inner - 1).cast("long").alias("slot")
    return rows.join(offsets, ["_shard", "_sub"]).select(*unpacked(rows.schema["user"].dataType.names), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), slot, F.lit(None).cast("int").alias("grown_shard"))


def links_kept(sharded: DataFrame, *text: str) -> DataFrame:
    """One row: pairs of equal texts (columns text), how many of them are in one shard, groups, and how many of these are whole."""
    per = sharded.groupBy(*text, "shard").agg(F.count("*").alias("n")).groupBy(*text).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("kept"), F.count("*").alias("parts")).where("n > 1")
    return per.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("links"), F.sum("kept").cast("long").alias("kept"), F.count("*").alias("groups"), F.count_if(F.col("parts") == 1).alias("whole"))


def op4_shard(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
