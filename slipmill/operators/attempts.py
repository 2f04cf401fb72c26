"""One text out of several recognition attempts per voucher (voucher_id, attempt, text, confidence, word_count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipmill.functions.fuzzy import ratio
from slipmill.sources.folders import by_size, written


def _top(attempts: DataFrame, score) -> DataFrame:
    return attempts.groupBy("voucher_id").agg(F.max_by(F.struct("attempt", "text", "confidence"), F.struct(score, -F.col("attempt"))).alias("b")).select("voucher_id", "b.*")


def best_by_confidence(attempts: DataFrame) -> DataFrame:
    return _top(attempts, F.col("confidence"))


def best_by_words(attempts: DataFrame) -> DataFrame:
    """The highest confidence x (1 + words / 100)."""
    return _top(attempts, F.col("confidence") * (1 + F.col("word_count") / 100))


def voted(attempts: DataFrame) -> DataFrame:
    """The most common text's most confident attempt; if no text comes twice, the most confident attempt."""
    votes = attempts.groupBy("voucher_id", "text").agg(F.count("*").alias("votes"), F.max_by(F.struct("attempt", "confidence"), F.struct("confidence", -F.col("attempt"))).alias("b"))
    top = votes.groupBy("voucher_id").agg(F.max_by(F.struct("text", "votes", "b"), F.struct(F.when(F.col("votes") > 1, F.col("votes")).otherwise(1), "b.confidence", -F.col("b.attempt"))).alias("t"))
    return top.select("voucher_id", "t.b.attempt", "t.text", "t.b.confidence", "t.votes")


def merged_confidence(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("voucher_id").agg((0.6 * F.max("confidence") + 0.4 * F.avg("confidence")).alias("confidence"))


def until_good(attempts: DataFrame, good: float = 85, most: int = 3) -> DataFrame:
    """Attempts up to the first of confidence `good`, at most `most`."""
    w = Window.partitionBy("voucher_id").orderBy("attempt")
    return attempts.withColumns({"_n": F.row_number().over(w), "_m": F.max("confidence").over(w.rowsBetween(Window.unboundedPreceding, -1))}).where((F.col("_n") <= most) & (F.coalesce("_m", F.lit(0)) < good)).drop("_n", "_m")


def line_vote(attempts: DataFrame) -> DataFrame:
    """(voucher_id, text): of each line number the variant with the best score: confidence, length up to 10, printable
    share x 10, and 5 for each other attempt's line by their similarity; ties go to the earlier attempt.

    A voucher's attempts, which are few, stand side by side in a row. Only lines in which they differ leave it, and of
    their pairs each distinct one is compared once.
    """
    own = F.array_sort(F.collect_list(F.struct("attempt", "confidence", F.split("text", "\n").alias("ls"))))
    rows = attempts.where("text IS NOT NULL").groupBy("voucher_id").agg(own.alias("t"))
    n = F.array_max(F.transform("t", lambda a: F.size(a["ls"])))
    variants = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(F.transform("t", lambda a: F.struct(a["attempt"].alias("attempt"), a["confidence"].alias("confidence"), F.get(a["ls"], i).alias("x"))), lambda v: F.coalesce(F.trim(v["x"]), F.lit("")) != ""))
    rows = written(rows.select("voucher_id", variants.alias("v")), "variants")
    differ = lambda v: F.size(F.array_distinct(F.transform(v, lambda a: a["x"]))) > 1
    open_ = rows.select("voucher_id", F.posexplode("v").alias("line", "v")).where(differ(F.col("v")))
    each = open_.select("voucher_id", "line", "v", F.inline("v"))
    others = each.select("voucher_id", "line", "attempt", "confidence", "x", F.explode(F.filter("v", lambda o: o["attempt"] != F.col("attempt"))).alias("o")).withColumn("y", F.col("o.x")).drop("o")
    known = by_size(others.where("x <> y").select("x", "y").distinct().withColumn("r", ratio(F.col("x"), F.col("y"))))
    like = others.where("x = y").withColumn("r", F.lit(1.0)).unionByName(others.where("x <> y").join(known, ["x", "y"]).select(*others.columns, "r"))
    plain = F.length(F.regexp_replace("x", r"[^\x20-\x7E]", "")) / F.length("x")
    score = F.col("confidence") + F.least(F.length("x") / 2, F.lit(10)) + plain * 10 + 5 * F.col("like")
    scored = like.groupBy("voucher_id", "line", "attempt", "confidence", "x").agg(F.sum("r").alias("like"))
    best = scored.groupBy("voucher_id", "line").agg(F.max_by("x", F.struct(score, -F.col("attempt"))).alias("x"))
    chosen = best.groupBy("voucher_id").agg(F.map_from_entries(F.collect_list(F.struct("line", "x"))).alias("best"))
    lines = F.array_compact(F.transform("v", lambda v, i: F.coalesce(F.try_element_at("best", i), F.get(v, F.lit(0))["x"])))
    voted = rows.join(chosen, "voucher_id", "left").select("voucher_id", F.array_join(lines, "\n").alias("text"))
    return voted.where("text <> ''")


def field_confidence(text: Column, n_attempts: Column) -> Column:
    """Map of field to confidence by what the text shows; more attempts add 5 each, 20 at most, up to 95."""
    amounts = F.regexp_count(text, F.lit(r"\d+\.\d{2}"))
    base = {
        "voucher_number": F.when(text.rlike(r"(?i)voucher\s*(?:no|number|#)?[:\s]*\d+"), 75).when(text.rlike(r"\b\d{3,}\b"), 60).otherwise(50),
        "date": F.when(text.rlike(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"), 75).when(text.rlike("(?i)date"), 65).otherwise(50),
        "supplier": F.when(text.rlike("(?i)supp"), 70).otherwise(50), "amounts": F.when(amounts >= 3, 80).when(amounts >= 1, 65).otherwise(50), "items": F.lit(50),
    }
    bonus = F.when(n_attempts > 1, F.least(F.lit(20), n_attempts * 5)).otherwise(0)
    return F.create_map(*[x for f, c in base.items() for x in (F.lit(f), F.when(bonus > 0, F.least(F.lit(95), c + bonus)).otherwise(c).cast("int"))])


def compared_modes(attempts: DataFrame, one: str, other: str) -> DataFrame:
    """One row: vouchers tried in both modes, wins of each, ties, and their mean confidences (columns voucher_id, mode, confidence)."""
    both = attempts.where(F.col("mode").isin(one, other)).groupBy("voucher_id").agg(F.max(F.when(F.col("mode") == one, F.col("confidence"))).alias("a"), F.max(F.when(F.col("mode") == other, F.col("confidence"))).alias("b"))
    ok = both.where("a IS NOT NULL AND b IS NOT NULL")
    return ok.agg(F.count("*").alias("n"), F.count_if(F.expr("a > b")).alias("wins"), F.count_if(F.expr("b > a")).alias("losses"), F.count_if(F.expr("a = b")).alias("ties"), F.avg("a").alias("mean"), F.avg("b").alias("other_mean"))
