"""The robust path: voted text, known lines put right, the robust profile, learned values, and a route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipmill.operators import attempts, context, learn, profiles, validate
from slipmill.sources.folders import written

CRITICAL = ("voucher_number", "voucher_date", "net_total")


def routed(tries: DataFrame, substitutions: DataFrame, values: DataFrame, anchors: DataFrame, fields: tuple[str, ...] = CRITICAL[:2]) -> DataFrame:
    """A row per voucher of recognition attempts (voucher_id, attempt, text, confidence), with its extracted and learned
    fields, both confidences, field_confidence, warnings (critical fields below 50) and action.

    The attempts' texts are voted by line; `substitutions`, `values` and `anchors` are learned models.
    """
    read = attempts.merged_confidence(tries).withColumnRenamed("confidence", "ocr_confidence")
    n = tries.groupBy("voucher_id").agg(F.count("*").alias("_tries"))
    text = attempts.line_vote(tries).withColumnRenamed("text", "raw_ocr_text").join(read, "voucher_id").join(n, "voucher_id")
    text = learn.correct_lines(text, substitutions)
    made = profiles.extract(written(text, "voted"), "robust").withColumn("_cues", attempts.field_confidence(F.col("raw_ocr_text"), F.col("_tries")))
    warnings = F.array_compact(F.array(*[F.when(F.coalesce(F.try_element_at("confidence", F.lit(f)), F.lit(0)) < 50, F.lit(f)) for f in CRITICAL]))
    made = made.withColumns({"field_confidence": validate.merged_confidence(F.col("_cues"), F.col("confidence")), "warnings": warnings})
    made = made.withColumn("action", validate.route(F.col("ocr_confidence"), F.col("overall"), F.col("warnings"))).drop("_cues", "_tries")
    return context.apply_learned(written(made, "extracted"), values, anchors, fields=fields)
