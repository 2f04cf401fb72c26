"""Benchmark decontamination: a broadcast set of the benchmark's normalised n-grams, scanned over every document."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipmill.llm.common import MIX, bound_batches, lean, packed, slices, stored, text_key, unpacked, utf8

N = 10
#: UTF-8 bytes of benchmark text in one broadcast set; a larger benchmark is scanned in blocks of about this size.
BLOCK_BYTES = 32_000_000
#: Lower-cases A-Z; keeps 0-9, a-z and bytes of other characters; makes a blank of the rest.
FOLD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams_words(text: str | None) -> list[bytes]:
    return utf8(text).translate(FOLD_TABLE).split()


class GramSet:
    """The windows of a block of items: sorted hashes by window length, each with its item and place, for verification.

    It holds the items' words once (equal words are one object) and 16 bytes a window.
    """

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        held: dict[bytes, bytes] = {}
        self.ids = [item for item, _ in items]
        self.words = [[held.setdefault(w, w) for w in grams_words(text)] for _, text in items]
        self.codes = {w: xxhash.xxh3_64_intdigest(w) | 1 for w in held}
        found: dict[int, list[tuple]] = defaultdict(list)
        for k, words in enumerate(self.words):
            if words:
                size = min(n, len(words))
                h = self.rolled(np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words)), size)
                found[size].append((h, np.full(len(h), k, np.int32), np.arange(len(h), dtype=np.int32)))
        self.grams = {}
        for size, parts in found.items():
            h, item, at = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.grams[size] = h[order], item[order], at[order]

    @staticmethod
    def rolled(codes: np.ndarray, size: int) -> np.ndarray:
        """A hash of each window of `size` codes."""
        h = np.zeros(max(0, len(codes) - size + 1), np.uint64)
        for j in range(size):
            h *= np.uint64(MIX)
            h += codes[j : len(codes) - size + 1 + j]
        return h

    def find(self, words: list[bytes], ends: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """Verified windows in the words of several documents; ends has, for each word, where its document ends."""
        codes = np.fromiter((self.codes.get(w, 0) for w in words), np.uint64, len(words))
        for size, (known, item, place) in self.grams.items():
            if len(codes) < size:
                continue
            at = np.flatnonzero(codes[: len(codes) - size + 1])
            at = at[at + size <= ends[at]]
            if not len(at):
                continue
            h = self.rolled(codes, size)[at]
            low = np.searchsorted(known, h)
            hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == h)
            for p, a, b in zip(at[hit].tolist(), low[hit].tolist(), np.searchsorted(known, h[hit], side="right").tolist(), strict=True):
                window = words[p : p + size]
                found = {self.ids[k] for k, x in zip(item[a:b].tolist(), place[a:b].tolist(), strict=True) if self.words[k][x : x + size] == window}
                if found:
                    yield p, p + size, found


_HELD: dict[tuple[str, int], GramSet] = {}


def _held(name: str, items: list, n: int) -> GramSet:
    """The set of a broadcast block, made once in each worker process; only the last one is kept."""
    if (name, n) not in _HELD:
        _HELD.clear()
        _HELD[name, n] = GramSet(items, n)
    return _HELD[name, n]


SCANNED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanner(grams, n: int):
    """An Arrow function from texts to their scan results."""
    name = uuid.uuid4().hex

    @lean
    def scan(texts: pa.Array) -> pa.Array:
        known, out = _held(name, grams.value, n), []
        for _, _, values in slices(texts):
            each = [grams_words(t) for t in values]
            first = np.cumsum([0, *map(len, each)])
            words = [w for x in each for w in x]
            ends = np.repeat(first[1:], np.diff(first))
            spans, items = defaultdict(list), defaultdict(set)
            for p, q, found in known.find(words, ends):
                d = int(np.searchsorted(first, p, side="right")) - 1
                spans[d].append((p - int(first[d]), q - int(first[d])))
                items[d] |= found
            for d, x in enumerate(each):
                own = merged(spans[d]) if d in spans else []
                out.append({"n_words": len(x), "n_hit": sum(q - p for p, q in own), "spans": [{"start": p, "end": q} for p, q in own], "items": sorted(items[d]) if d in items else []})
        return pa.array(out, ARROW)

    return F.arrow_udf(scan, SCANNED)


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Callable]:
    """The number of blocks of (item, text), each of about block_bytes, and a function that broadcasts one of them."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    sc = benchmark.sparkSession.sparkContext
    return n, lambda i: sc.broadcast([(r["item"], r["text"]) for r in dealt.where(F.col("block") == i).toLocalIterator()])


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct `scan`: n_words, n_hit, spans (merged word ranges that are hit) and items (with a window there).

    Windows are n consecutive words of an item; a shorter item with words is one window. A null text, on either
    side, has no words; a null item_id counts as the id ''. Repeated documents or items give the same results for
    each. An empty benchmark hits nothing. If the benchmark is larger than block_bytes, each block is broadcast and
    scanned in its own pass, and the passes are added up by text.
    """
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "scan"]
    n_blocks, block = _blocks(benchmark, block_bytes)
    if n_blocks == 1:
        return docs.select(*[F.col(f"`{c}`") for c in names], _scanner(block(0), n)(F.col("text")).alias("scan"))
    a, b = text_key(F.col("text"))
    keyed = docs.select(packed(names), "text", a.alias("_a"), b.alias("_b"))
    texts = keyed.select("_a", "_b", "text").dropDuplicates(["_a", "_b"])
    rows = None
    for i in range(n_blocks):  # one block at a time is held by the driver and the workers
        held = block(i)
        found = stored(texts.select("_a", "_b", _scanner(held, n)(F.col("text")).alias("s")), "scan")
        held.destroy()
        rows = found if rows is None else rows.unionByName(found)

    def add(spans: pa.Array) -> pa.Array:
        own = [merged([(s["start"], s["end"]) for s in x or []]) for x in spans.to_pylist()]
        return pa.array([[{"start": p, "end": q} for p, q in x] for x in own], ARROW.field("spans").type)

    added = rows.groupBy("_a", "_b").agg(F.max("s.n_words").alias("n"), F.flatten(F.collect_list("s.spans")).alias("sp"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s.items")))).alias("it"))
    added = added.withColumn("sp", F.arrow_udf(add, SCANNED["spans"].dataType)("sp"))
    hit = F.aggregate("sp", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    added = added.select("_a", "_b", F.struct(F.col("n").alias("n_words"), hit.alias("n_hit"), F.col("sp").alias("spans"), F.col("it").alias("items")).alias("scan"))
    return keyed.join(added, ["_a", "_b"]).select(*unpacked(names), "scan")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """docs without contaminated documents, or (remove='spans') with their hit words cut out; same columns.

    Cut texts are their normalised words that are left, joined by blanks; clean texts stay as they are.
    """
    # A column of docs named scan goes along packed.
    found = scan(docs.select(packed(docs.columns), "text"), benchmark, **options)
    if remove == "documents":
        return found.where("scan.n_hit = 0").select(*unpacked(docs.columns))

    def left(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, sp in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if sp:
                words = grams_words(t)
                gone = {i for s in sp for i in range(s["start"], s["end"])}
                t = b" ".join(w for i, w in enumerate(words) if i not in gone).decode("utf-8", "replace")
            out.append(t)
        return pa.array(out, pa.string())

    text = F.arrow_udf(left, T.StringType())(F.col("text"), F.col("scan.spans"))
    return found.withColumn("cut", text).select(*[F.col("cut").alias(c) if c == "text" else F.col("user").getField(c).alias(c) for c in docs.columns])


def items_digest(items: Column) -> Column:
    """The ids, sorted as strings and joined by commas, as a SHA-256."""
    return F.sha2(F.concat_ws(",", items), 256)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "scan.n_words", "scan.n_hit", F.size("scan.items").cast("long").alias("n_items"),
        items_digest(F.col("scan.items")).alias("items_sha256"), (F.col("scan.n_hit") > 0).alias("contaminated"),
    )


WORDS_SQL = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({WORDS_SQL.format("text")}, []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {WORDS_SQL.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
grams AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
          FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM grams),
windows AS (SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
            FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT rid, i, n, item FROM windows JOIN grams USING (n, g)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
found AS (SELECT rid, list(DISTINCT item ORDER BY item) AS items FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
"""
