"""Preference formatting with DataFrame functions only: a shared prompt, and paired masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered; the model is trained on what an assistant says and on the end mark after it.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LEARNER = "assistant"


def _turns(rows: DataFrame, side: int) -> DataFrame:
    """pair_id, turn and a struct of side, role and text; a turn without number or pair has no place and goes."""
    return rows.where("pair_id IS NOT NULL AND turn IS NOT NULL").select(
        "pair_id", F.struct(F.col("turn").cast("long").alias("turn"), F.lit(side).alias("side"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )


def _rendered(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))


def _spans(turns: Column) -> Column:
    """Character ranges of the joined rendering on which the loss is taken."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["role"]) + len(OPEN) + len(CLOSE)
        end = begin + F.length(t["text"]) + len(END)
        own = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(t["role"] == LEARNER, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda acc: acc["spans"])


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """A row per pair_id of two tables (pair_id, turn, role, text): the longest common prefix of turns rendered once.

    Returns pair_id, n_prompt_turns, n_chosen_turns, n_rejected_turns (of the completions), prompt, chosen, rejected,
    chosen_spans and rejected_spans (what the loss is taken on, as character ranges of the completion).
    Turns are in the order of their numbers, then of role and text; repeated equal rows count once. A null role is
    `unknown`, a null text empty. A side without turns has an empty completion; equal sides are all prompt.
    """
    # Turn structs meet once per conversation: one shuffle, and a conversation is a row of the result in any case.
    both = _turns(chosen, 0).unionByName(_turns(rejected, 1)).groupBy("pair_id").agg(F.array_sort(F.collect_set("t")).alias("t"))
    bare = lambda side: F.transform(F.filter("t", lambda x: x["side"] == side), lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text")))
    both = both.select("pair_id", bare(0).alias("c"), bare(1).alias("r"))
    differs = F.zip_with("c", "r", lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(differs, True)
    both = both.withColumn("p", F.when(first == 0, F.size("c")).otherwise(first - 1).cast("int"))
    rest = lambda side: F.slice(F.col(side), F.col("p") + 1, F.greatest(F.size(side) - F.col("p"), F.lit(0)))
    both = both.withColumns({"head": F.slice("c", F.lit(1), F.col("p")), "c": rest("c"), "r": rest("r")})
    text = lambda turns: F.array_join(F.transform(turns, _rendered), "")
    return both.select(
        "pair_id", F.col("p").cast("long").alias("n_prompt_turns"), F.size("c").cast("long").alias("n_chosen_turns"), F.size("r").cast("long").alias("n_rejected_turns"),
        text("head").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"), _spans(F.col("c")).alias("chosen_spans"), _spans(F.col("r")).alias("rejected_spans"),
    )


def branched(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from a table of single conversations: chosen is the conversation, rejected the one that leaves it at
    turn conv_id mod 4 and goes on as its neighbour (conv_id xor 1) does from there."""
    own = F.col("conv_id")
    other = own.bitwiseXOR(F.lit(1))
    chosen = turns.select(own.alias("pair_id"), "turn", "role", "text")
    to = F.array(F.when(F.col("turn") < F.pmod(own, F.lit(4)), own), F.when(F.col("turn") >= F.pmod(other, F.lit(4)), other))
    rejected = turns.select(F.explode(F.array_compact(to)).alias("pair_id"), "turn", "role", "text")
    return chosen, rejected.join(turns.select(own.alias("pair_id")).distinct(), "pair_id", "left_semi")


def _text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6_preference_format(spark, sf_dir: str) -> DataFrame:
    pairs = format_pairs(*branched(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return pairs.withColumns({"chosen_spans": _text("chosen_spans"), "rejected_spans": _text("rejected_spans")})


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
sides AS (
  SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM t
  UNION SELECT conv_id, 1, turn, role, text FROM t WHERE turn < conv_id % 4
  UNION SELECT xor(conv_id, 1::BIGINT), 1, turn, role, text FROM t WHERE turn >= xor(conv_id, 1::BIGINT) % 4 AND xor(conv_id, 1::BIGINT) IN (SELECT conv_id FROM t)),
placed AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS i,
                  '<|' || role || E'|>\n' || text || E'<|end|>\n' AS seg FROM sides),
same AS (SELECT pair_id, a.i FROM placed a JOIN placed b USING (pair_id, i) WHERE a.side = 0 AND b.side = 1 AND a.turn = b.turn AND a.role = b.role AND a.text = b.text),
prefix AS (SELECT pair_id, count(*) AS n FROM (SELECT pair_id, i, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS k FROM same) WHERE i = k GROUP BY pair_id),
cut AS (SELECT p.*, coalesce(n, 0) AS n FROM placed p LEFT JOIN prefix USING (pair_id)),
ends AS (SELECT *, sum(CASE WHEN i > n THEN length(seg) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY i) AS stop FROM cut)
SELECT pair_id, any_value(n)::BIGINT AS n_prompt_turns,
       count(*) FILTER (side = 0 AND i > n)::BIGINT AS n_chosen_turns, count(*) FILTER (side = 1 AND i > n)::BIGINT AS n_rejected_turns,
       coalesce(string_agg(seg, '' ORDER BY i) FILTER (side = 0 AND i <= n), '') AS prompt,
       coalesce(string_agg(seg, '' ORDER BY i) FILTER (side = 0 AND i > n), '') AS chosen,
       coalesce(string_agg(seg, '' ORDER BY i) FILTER (side = 1 AND i > n), '') AS rejected,
       coalesce(string_agg((stop - length(text) - 8)::BIGINT || '-' || stop::BIGINT, ',' ORDER BY i) FILTER (side = 0 AND i > n AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((stop - length(text) - 8)::BIGINT || '-' || stop::BIGINT, ',' ORDER BY i) FILTER (side = 1 AND i > n AND role = 'assistant'), '') AS rejected_spans
FROM ends GROUP BY pair_id
"""
