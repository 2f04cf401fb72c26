"""What several operators of this subpackage share: stored tables, word codes, a bounded membership filter."""

from __future__ import annotations

import ctypes
import functools
import inspect
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIX = 0x9E3779B97F4A7C15
WORD_LIMIT = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local session may leave it unset, where a temporary folder is shared by all; a cluster's must name it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="slipmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, compression: str = "snappy", batch_rows: int | None = None) -> DataFrame:
    """df, written once as Parquet in the shared folder; columns can be pruned when it is read. It goes when the driver ends.

    batch_rows bounds the Arrow batches of this one write, for functions over wide rows; the session's setting comes back.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    usual = spark.conf.get(BATCH_ROWS)
    if batch_rows:
        spark.conf.set(BATCH_ROWS, str(min(batch_rows, int(usual)) if int(usual) > 0 else batch_rows))
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(BATCH_ROWS, usual)
    store, where = _folder(spark, path)
    store.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Removes what stored() wrote; no plan that is still to run may read it."""
    store, where = _folder(df.sparkSession, df.stored_at)
    store.delete(where, True)


#: Bytes of an Arrow batch of whole texts; it is set where the session has Spark's own bound.
BATCH_BYTES, SPARKS_BYTES, TEXT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "64MB", "8m"


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches, on both sides of the pipe; a bound that a user has set stays."""
    if spark.conf.get(BATCH_BYTES, SPARKS_BYTES).upper() in (SPARKS_BYTES, "67108864B", "67108864"):
        spark.conf.set(BATCH_BYTES, TEXT_BYTES)


def give_back() -> None:
    """Returns freed memory of this process to the system: idle workers stay for a minute, and what they keep counts."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def lean(f):
    """f, an Arrow function over columns or over batches, after which (over batches: at whose end) memory is given back."""

    @functools.wraps(f)
    def over_columns(*columns):
        try:
            return f(*columns)
        finally:
            give_back()

    @functools.wraps(f)
    def over_batches(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return over_batches if inspect.isgeneratorfunction(f) else over_columns


def ranked(df: DataFrame, group: str, order: list[str], name: str = "ranked") -> DataFrame:
    """df, stored, with _pos, a row's place from 0 among those of its group in ascending order (nulls first), and _n, their number.

    Range partitions are counted by group, and the counts before a partition are its offset: a group may span any number of
    tasks, and none holds it whole. Rows equal in group and order are placed in any order, so that they should be alike.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    dealt = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), name)
    per = dealt.groupBy(F.col(group).alias("_of"), F.col("_part").alias("_in")).agg(F.min("_row").alias("_first"), F.count("*").alias("_c"))
    whole = Window.partitionBy("_of")
    before = whole.orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_of", "_in", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_c").over(whole).alias("_n"))
    placed = dealt.join(per, F.col(group).eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_in")))
    return placed.select(*df.columns, (F.col("_row") + F.col("_shift")).alias("_pos"), "_n")


#: Rows up to which numbered() broadcasts the keys of repeated rows.
KEYS_ROWS = 100_000


def numbered(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """rows with _n, a row's place from 0 among those with the same values of keys (nulls alike), in the order's, so that repeats differ.

    Repeated keys are found by counts; only their rows are placed, by ranges, so that any number of repeats is dealt out.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_c")).where("_c > 1").drop("_c")
    again = stored(counted.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.monotonically_increasing_id().alias("_k")), "again")
    n = again.count()
    if not n:
        return rows.withColumn("_n", F.lit(0).cast("long"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    marked = rows.join(F.broadcast(again) if n <= KEYS_ROWS else again, same, "left").select(*rows.columns, "_k")
    once = marked.where("_k IS NULL").select(*rows.columns, F.lit(0).cast("long").alias("_n"))
    return once.unionByName(ranked(marked.where("_k IS NOT NULL"), "_k", list(order), "repeats").select(*rows.columns, F.col("_pos").alias("_n")))


def packed(columns: list[str]) -> Column:
    """A user's columns as one struct, `user`: whatever their names are, they clash with none that an operator makes."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]).alias("user")


def unpacked(columns: list[str]) -> list[Column]:
    """The columns of `user` again."""
    return [F.col("user").getField(c).alias(c) for c in columns]


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for equal texts (with the length, over 128 bits)."""
    return [F.xxhash64(text, F.lit(1)), F.xxhash64(F.lit(2), text)]


def fold(h: np.ndarray) -> np.ndarray:
    """Mixes 64-bit values; every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class WordCodes(dict):
    """Word (bytes) to 64-bit hash; forgets all when it holds WORD_LIMIT words, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_LIMIT:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def slices(texts: pa.Array, most: int = 1_000_000):
    """(start, stop, texts) of stretches of an Arrow array of about `most` bytes, or one text; few are Python objects at once."""
    total = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, side="right")))
        yield start, stop, texts.slice(start, stop - start).to_pylist()
        start = stop


#: Bits of the largest membership filter (16 MB); it bounds what is broadcast, whatever the number of keys.
FILTER_BITS = 1 << 27


def membership_filter(keys: DataFrame, column: str, n: int, most_bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of two bits a key over well-mixed 64-bit keys, as an array of 64-bit words.

    It has 16 to 32 bits a key, but never more than most_bits. A full filter lets more keys pass; it loses none.
    """
    bits = 1 << 16
    while bits < 16 * n and bits < most_bits:
        bits *= 2
    k = F.col(column)
    at = F.explode(F.array(k.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(k, 32).bitwiseAND(F.lit(bits - 1)))).alias("at")
    rows = keys.select(at).groupBy(F.shiftrightunsigned("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold."""
    mask, one, six = np.uint64(len(words) * 64 - 1), np.uint64(1), np.uint64(6)
    found = np.ones(len(keys), bool)
    for at in (keys & mask, (keys >> np.uint64(32)) & mask):
        found &= (words[at >> six] >> (at & np.uint64(63))) & one == one
    return found


def may_hold(spark: SparkSession, words: np.ndarray, key: Column) -> Column:
    """passes() as a column over a column of 64-bit keys."""
    held = spark.sparkContext.broadcast(words)
    return F.arrow_udf(lean(lambda keys: pa.array(passes(held.value, keys.to_numpy().view(np.uint64)))), T.BooleanType())(key)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id isn't in ids (one column, doc_id). Texts that a bounded filter clears aren't shuffled."""
    keyed = cut(ids.select("doc_id", F.xxhash64("doc_id").alias("_k")))
    may = may_hold(docs.sparkSession, membership_filter(keyed, "_k", keyed.count()), F.xxhash64("doc_id"))
    rows = docs.select(packed(docs.columns), "doc_id", may.alias("may"))
    gone = keyed.select("doc_id").distinct()
    return rows.where("NOT may").unionByName(rows.where("may").join(gone, "doc_id", "left_anti").select(rows.columns)).select(*unpacked(docs.columns))
