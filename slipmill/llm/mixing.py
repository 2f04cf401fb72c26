"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipmill.llm.common import numbered, packed, unpacked

#: The weights of the sources in their order, repeated; how often a source's words may be taken at most.
WEIGHTS, MOST = (5, 2, 1), 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blank and the five control characters of white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row per source: source, source_size, target.

    Targets share the sum of all sizes by weight; a source whose share is above `most` times its size stops there,
    and the excess is shared again by weight until none is above. That fixpoint is found in one pass: sources in
    ascending order of limit by weight are capped as long as the rest's share is above their limit.
    One row per source is ranked, never documents. Sizes of 0 give targets of 0.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_code) - 1) % n + 1).cast("int"))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight.cast("double"))
    limit = (F.col("source_size") * most).cast("double")
    per = per.withColumns({"limit": limit, "ratio": limit / F.col("weight")})
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumns({
        "capped": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "rest": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "total": F.sum("source_size").over(everything).cast("double"),
    })
    # The source is capped if the share of those from it onwards is above its own limit.
    per = per.withColumn("stops", F.col("limit") * F.col("rest") < (F.col("total") - F.col("capped")) * F.col("weight"))
    free = per.withColumns({
        "free_words": F.col("total") - F.sum(F.when(F.col("stops"), F.col("limit")).otherwise(0.0)).over(everything),
        "free_weight": F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(everything),
    })
    share = F.when(F.col("stops"), F.col("limit")).otherwise(F.col("free_words") * F.col("weight") / F.col("free_weight"))
    return free.select("source", "source_size", share.alias("target"))


def draw(doc_id: Column, n: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on seed, doc_id and the place among rows of this id (52 bits of an MD5)."""
    place = F.when(n > 0, F.concat(F.lit(":"), n.cast("string"))).otherwise("")
    hexes = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), place)), 1, 13)
    return F.conv(hexes, 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Each document's columns with size, source_size, target, rate and copies.

    rate: its source's target by its size; copies: floor(rate), and one more if draw() is below the fraction.
    Null text has size 0 and is a document like others. A null source is one source, the last. A null doc_id counts like
    a value. Rows that share a doc_id are drawn apart, by their place in the order of source and text's hash, so that
    repeats and null ids come near the target too. An empty table gives an empty one. Columns of docs named like these are replaced.
    """
    made = ("size", "source_size", "target", "rate", "copies")
    names = [c for c in docs.columns if c not in made]
    sized = docs.select(packed(names), "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5("text").alias("_md5"))
    per = source_targets(sized.select("source", "size"), weights, most)
    per = per.withColumnsRenamed({c: f"_mix_{c}" for c in per.columns})
    out = numbered(sized, ["doc_id"], ("source", "_md5")).join(per, F.col("source").eqNullSafe(F.col("_mix_source")))
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return out.select(
        *unpacked(names), "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), rate.alias("rate"),
        (whole + F.when(draw(F.col("doc_id"), F.col("_n"), seed) < rate - whole, 1).otherwise(0)).alias("copies"),
    )


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as mix() says, with the columns of docs, whatever their names and values."""
    mixed = mix(docs.select(packed(docs.columns), "doc_id", "source", "text"), **options).where("copies > 0")
    return mixed.select("user", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*unpacked(docs.columns))


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY source NULLS FIRST, md5(text) NULLS FIRST) - 1 AS place, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, (3 * source_size)::DOUBLE AS lim,
         coalesce(sum((3 * source_size)::DOUBLE) OVER before, 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest,
         (sum(source_size) OVER ())::DOUBLE AS total
  FROM per WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopped AS (SELECT *, lim * rest < (total - capped) * weight AS stops FROM ranked),
shared AS (
  SELECT source, source_size,
         CASE WHEN stops THEN lim ELSE (total - sum(CASE WHEN stops THEN lim ELSE 0 END) OVER ()) * weight
              / sum(CASE WHEN stops THEN 0 ELSE weight END) OVER () END AS target
  FROM stopped),
rated AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '') || CASE WHEN d.place > 0 THEN ':' || d.place::VARCHAR ELSE '' END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN shared s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM rated
"""
