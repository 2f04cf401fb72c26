"""The same work over streams: extraction of new files, running counters, corrections, rolling accuracy."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipmill.operators.extract import extract_v2
from slipmill.operators.records import one_per_id, write_vouchers
from slipmill.sources.folders import work_folder
from slipmill.sources.snapshots import Snapshots

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def extract_stream(texts: DataFrame) -> DataFrame:
    """Extraction of streamed (voucher_id, raw_ocr_text, ...): the same columns as in a batch."""
    return extract_v2(texts)


def query_id(spark: SparkSession, state: str) -> str:
    """The id under which a streaming query goes on, as its checkpoint folder has it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/metadata")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def upsert_to_end(texts: DataFrame, store: Snapshots, state: str, after: Callable[[int], None] | None = None, most_layers: int = 8) -> None:
    """Extracts streamed texts (voucher_id, raw_ocr_text, ...) into the store, over what is there now, one commit a micro-batch.

    Each voucher is there once, as it came last: a micro-batch and its number enter the tables in one commit, so that one
    that Spark runs again after a failure is known and left out, and a voucher that comes in two batches is replaced. The
    ledger goes by the query's own id: a query with a new checkpoint folder numbers its batches anew. `after` is called
    with each batch's number once it is in. The layers are compacted as soon as there are more than most_layers. Texts are
    dealt over all tasks, however few files they came in, and which of a voucher's texts stands is settled before extraction.
    """

    def apply(batch: DataFrame, number: int) -> None:
        dealt = batch.repartition(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")), "voucher_id")
        write_vouchers(extract_stream(one_per_id(dealt)), store, query_id(batch.sparkSession, state), number)
        if len(store.manifest()["layers"]) > most_layers:
            store.compact()
        if after:
            after(number)

    texts.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def batch_counts(events: DataFrame) -> DataFrame:
    """Running counters per batch (here: user mod 40). Feed it deduplicated() in a query of its own if files may come twice."""
    return events.groupBy((F.col("user_id") % 40).alias("batch")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"))


def deduplicated(events: DataFrame) -> DataFrame:
    """Each event once, if it comes again within a day."""
    return events.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])


def correction_counts(events: DataFrame) -> DataFrame:
    """How often each (field, value) was corrected to another, as events come in."""
    return events.groupBy(F.col("event_type").alias("field"), F.floor(F.col("value") / 10).alias("auto"), F.floor(F.col("value")).alias("corrected")).agg(F.count("*").alias("n"))


def rolling_accuracy(events: DataFrame) -> DataFrame:
    """Accuracy over 7 days, each day anew; events up to a day late count."""
    right = (F.col("event_type") != "error").cast("double")
    return events.withWatermark("ts", "1 day").groupBy(F.window("ts", "7 days", "1 day")).agg(F.count("*").alias("n"), F.sum(right).alias("right")).select(F.col("window.start").alias("start"), "n", (F.col("right") / F.col("n")).alias("accuracy"))


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now, and returns its result as a table.

    Each micro-batch has a folder of its own, or the whole result one, and is written over what a failed run left there.
    """
    spark = stream.sparkSession
    out = work_folder(spark, name)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", work_folder(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out) if mode == "complete" else spark.read.parquet(out).drop("batch")
