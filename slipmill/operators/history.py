"""What training sessions used and learned: sessions, patterns by the session that first saw them, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def learned(corrections: DataFrame) -> DataFrame:
    """(field, auto, corrected, session, ts): each pattern once, with the session that had it first.

    Corrections are rows (session, ts, field, auto, corrected); ties in time go to the lesser session.
    """
    first = corrections.groupBy("field", "auto", "corrected").agg(F.min(F.struct("ts", "session")).alias("s"))
    return first.select("field", "auto", "corrected", "s.session", "s.ts")


def sessions(corrections: DataFrame, patterns: DataFrame) -> DataFrame:
    """(session, ts, n_corrections, n_patterns) of every session."""
    used = corrections.groupBy("session").agg(F.min("ts").alias("ts"), F.count("*").alias("n_corrections"))
    new = patterns.groupBy("session").agg(F.count("*").alias("n_patterns"))
    return used.join(new, "session", "left").withColumn("n_patterns", F.coalesce("n_patterns", F.lit(0).cast("long")))


def summary(made: DataFrame) -> DataFrame:
    """One row: sessions, corrections used, patterns learned, the last session's time."""
    return made.agg(F.count("*").alias("n_sessions"), F.coalesce(F.sum("n_corrections"), F.lit(0)).alias("n_corrections"), F.coalesce(F.sum("n_patterns"), F.lit(0)).alias("n_patterns"), F.max("ts").alias("last_training"))


def by_field(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("field").agg(F.count("*").alias("n"))


def recent_sessions(made: DataFrame, most: int = 5) -> DataFrame:
    """The last `most` sessions, latest first."""
    return made.orderBy(F.col("ts").desc(), F.col("session").desc()).limit(most)


def last_patterns(patterns: DataFrame, most: int = 3) -> DataFrame:
    """The last `most` patterns of each field, by session and then by value."""
    w = Window.partitionBy("field").orderBy(F.col("ts").desc(), F.col("session").desc(), F.col("auto").desc_nulls_last(), F.col("corrected").desc_nulls_last())
    return patterns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def not_trained(corrections: DataFrame, used: DataFrame) -> DataFrame:
    """Corrections whose id isn't among those that a session used before."""
    return corrections.join(used.select("id").distinct(), "id", "left_anti")
