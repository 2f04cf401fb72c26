"""Substring dedup with prefix-partitioned suffix trees over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipmill.llm.common import MIX, WordCodes, bound_batches, fold, lean, may_hold, membership_filter, packed, passes, slices, stored, unpacked, utf8

WINDOW = 50
#: Words of the gram that ends a suffix's prefix, the least-hashed one in its first WINDOW words; where a prefix's group is
#: too large, the next of these takes its place. Each leaves a power of two of grams to choose from; the last is the window.
GRAMS = (19, 35, 43, 47, 50)
#: Words of distinct runs that one prefix may hold before it grows; windows of one run.
GROUP_WORDS, RUN_WINDOWS = 250_000, 1024
LAST = (1 << 63) - 1
INVERSE = pow(MIX, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than blank and the control characters 9 to 13."""
    return utf8(text).split()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """For each window of a sequence of words: the hash of the gram that ends its suffix's prefix."""

    def __init__(self, gram: int):
        self.gram, self.codes = gram, WordCodes()
        self.up, self.down = _powers(MIX, 0), _powers(INVERSE, 0)

    def of(self, words: list[bytes]) -> np.ndarray:
        n, gram = len(words), self.gram
        if n > len(self.up):
            self.up, self.down = _powers(MIX, 2 * n), _powers(INVERSE, 2 * n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.codes.of(words) * self.up[:n])])
        low = fold((sums[gram:] - sums[:-gram]) * self.down[: n - gram + 1])
        step = 1
        while step < WINDOW - gram + 1:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        return fold(low)


def _runs(each: list[list[bytes]], anchors: Anchors):
    """Words of the texts end to end, and the runs of windows with one anchor: text, first word, windows, anchor.

    A run has RUN_WINDOWS windows at most; where the prefix is the window, it has one.
    """
    first = np.cumsum([0, *map(len, each)])
    words = [w for x in each for w in x]
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return words, first, none, none, none, none.view(np.uint64)
    key = anchors.of(words)
    doc = np.repeat(np.arange(len(each)), np.diff(first))[: len(key)]
    whole = np.arange(len(key)) + WINDOW <= first[doc + 1]
    starts = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])])
    most = 1 if anchors.gram == WINDOW else RUN_WINDOWS
    at = np.arange(len(key))
    starts |= (at - np.maximum.accumulate(np.where(starts, at, 0))) % most == 0
    begins = np.flatnonzero(starts)
    sizes = np.diff(np.append(begins, len(key)))
    ok = whole[begins]
    return words, first, doc[begins[ok]], begins[ok], sizes[ok], key[begins[ok]]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch["doc"].to_numpy(zero_copy_only=False).astype(np.int64)


@lean
def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = Anchors(GRAMS[0])
    for batch in batches:
        ids = _ids(batch)
        for a, b, texts in slices(batch["text"]):
            *_, doc, _, _, key = _runs([words_of(t) for t in texts], anchors)
            if not len(key):
                continue
            own = ids[a:b][doc]
            order = np.lexsort((own, key))
            key, own = key[order], own[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            end = np.append(at[1:], len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(own[at]), pa.array(own[end - 1])], ["anchor", "low", "high"])


#: A run under its prefix, the text or run it is taken from (of_a, of_b), and its first window's place there.
SUFFIXES = "prefix long, run_a long, run_b long, of_a long, of_b long, start long, windows long, low long, words binary"


def _emit(each: list[list[bytes]], of: list[tuple[int, int]], lows: list[int], anchors: Anchors, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The suffixes that begin the texts' windows, as runs under their prefix, some thousands of rows at a time.

    A run's words travel once a batch of rows, with its least document; each place where it stands is a row.
    """
    words, first, docs, begins, sizes, key = _runs(each, anchors)
    if bits is not None:
        shared = passes(bits, key)
        docs, begins, sizes, key = docs[shared], begins[shared], sizes[shared], key[shared]
    for i in range(0, len(docs), 8192):
        j = slice(i, i + 8192)
        rows, low, texts = [], {}, {}
        for d, begin, n, k in zip(docs[j].tolist(), begins[j].tolist(), sizes[j].tolist(), key[j].view(np.int64).tolist(), strict=True):
            text = b" ".join(words[begin : begin + n + WINDOW - 1])
            digest = xxhash.xxh3_128_digest(text)
            run = int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)
            low[run] = min(low.get(run, LAST), lows[d])
            texts.setdefault(run, text)
            rows.append((k, *run, *of[d], begin - int(first[d]), n))
        runs = [r[1:3] for r in rows]
        columns = [*zip(*rows, strict=True), [low[r] for r in runs], [texts.pop(r, None) for r in runs]]
        types = [pa.int64()] * 8 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in SUFFIXES.split(", ")])


def _suffix_runs(bits):
    """A function over documents: runs of the suffixes that begin windows with a shared prefix."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(GRAMS[0])
        for batch in batches:
            ids, keys = _ids(batch).tolist(), batch["text_key"].to_pylist()
            for a, b, texts in slices(batch["text"]):
                yield from _emit([words_of(t) for t in texts], list(zip(ids[a:b], keys[a:b], strict=True)), ids[a:b], anchors, bits.value)

    return lean(emit)


def _longer_prefixes(gram: int):
    """A function over distinct runs: the same windows as runs under the longer prefix."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(gram)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                a, b, low, words = (batch[c].slice(i, 1024).to_pylist() for c in ("run_a", "run_b", "low", "words"))
                yield from _emit([w.split() for w in words], list(zip(a, b, strict=True)), low, anchors, None)

    return lean(emit)


def deep_nodes(runs: list[list[bytes]], windows: list[int], depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix that begins one of a run's first windows, in order: its deep node's number, and the node's depth.

    The suffixes are sorted as the leaves of their suffix tree are, by prefix doubling: ranks by the first 1, 2, 4, ...
    words, until all differ (a mark of its own ends each run). The ranks, from the longest down, also give the longest
    common prefix of each two neighbours. A stretch of neighbours with `depth` words in common or more is the leaves below
    one internal node; the least of their common prefixes is its depth. What its leaves have in common is a maximal
    repeat: no word can follow all of them. A leaf that shares less with both neighbours is a node of its own, of depth 0.
    """
    code: dict[bytes, int] = {}
    ends = np.cumsum([len(r) + 1 for r in runs])
    flat = np.empty(int(ends[-1]), np.int64)
    begins = ends - [len(r) + 1 for r in runs]
    for k, (r, x) in enumerate(zip(runs, begins.tolist(), strict=True)):
        flat[x : x + len(r)] = np.fromiter((code.setdefault(w, len(code)) for w in r), np.int64, len(r))
        flat[x + len(r)] = -1 - k
    ranks, size = [np.unique(flat, return_inverse=True)[1]], 1
    while True:
        rank = ranks[-1]
        pair = rank * np.int64(len(flat) + 1)
        pair[: len(pair) - size] += rank[size:] + 1
        values, rank = np.unique(pair, return_inverse=True)
        if len(values) == len(flat):
            break
        ranks.append(rank)
        size *= 2
    leaves = np.concatenate([np.arange(x, x + n) for x, n in zip(begins.tolist(), windows, strict=True)])
    order = np.argsort(rank[leaves], kind="stable")
    at = leaves[order]
    i, j, common = at[:-1].copy(), at[1:].copy(), np.zeros(max(0, len(at) - 1), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (i < len(flat)) & (j < len(flat))
        same = inside.copy()
        same[inside] = ranks[k][i[inside]] == ranks[k][j[inside]]
        step = same * (1 << k)
        common, i, j = common + step, i + step, j + step
    breaks = np.concatenate([[True], common < depth])
    node = np.cumsum(breaks) - 1
    least = np.full(int(node[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node[1:][~breaks[1:]], common[~breaks[1:]])
    least[least == np.iinfo(np.int64).max] = 0
    out = np.empty(len(order), np.int64)
    out[order] = node
    return out, least[out]


OWNED = "run_a long, run_b long, at long, windows long, owner long, depth long"


@lean
def _build_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees of a partition that is sorted by prefix, a memory-sized group of prefixes at a time.

    Yields each run's windows with the least document below their deep node, as stretches of one owner, with the depth
    of the deepest of their nodes.
    """
    held: dict[tuple[int, int], list] = {}
    total, prefix = 0, None

    def close() -> pa.RecordBatch:
        runs = list(held)
        words = [held[r][0].split() for r in runs]
        sizes = [held[r][1] for r in runs]
        node, depth = deep_nodes(words, sizes)
        low = np.repeat(np.array([held[r][2] for r in runs], np.int64), sizes)
        owner = np.full(int(node.max()) + 1, LAST, np.int64)
        np.minimum.at(owner, node, low)
        owner = owner[node]
        run = np.repeat(np.arange(len(runs)), sizes)
        begins = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (run[1:] != run[:-1])]))
        first = np.cumsum([0, *sizes])[:-1]
        keys = np.array(runs, np.int64)[run[begins]]
        columns = keys[:, 0], keys[:, 1], begins - first[run[begins]], np.diff(np.append(begins, len(run))), owner[begins], np.maximum.reduceat(depth, begins)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], [x.split()[0] for x in OWNED.split(", ")])

    for batch in batches:
        for p, a, b, n, low, text in zip(*(batch[c].to_pylist() for c in ("prefix", "run_a", "run_b", "windows", "low", "words")), strict=True):
            if p != prefix and total >= GROUP_WORDS:
                yield close()
                held, total = {}, 0
            prefix = p
            if (a, b) in held:
                held[a, b][2] = min(held[a, b][2], low)
            else:
                held[a, b] = [text, n, low]
                total += n + WINDOW - 1
    if held:
        yield close()


def _distinct(suffixes: DataFrame, name: str) -> DataFrame:
    """Each run once, with the least document it stands in: a passage that is everywhere is one row."""
    content = suffixes.where("words IS NOT NULL").groupBy("prefix", "run_a", "run_b")
    return stored(content.agg(F.first("windows").alias("windows"), F.min("low").alias("low"), F.first("words").alias("words")), name)


def memory_sized(suffixes: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """(suffixes, runs) for each of GRAMS as far as needed: runs are those whose prefix is no longer than that.

    Prefixes whose distinct runs have more than GROUP_WORDS words grow: their runs are taken anew under the next of GRAMS.
    At the last, a prefix is a window, and its group one run. What grows depends on the prefix alone (a filter that may
    name others too), so that equal windows always meet.
    """
    spark, out = suffixes.sparkSession, []
    for gram in (*GRAMS[1:], None):
        runs = _distinct(suffixes, "runs")
        large = runs.groupBy("prefix").agg(F.sum(F.col("windows") + WINDOW - 1).alias("n")).where(F.col("n") > GROUP_WORDS)
        large = stored(large.select("prefix"), "large") if gram else None
        n = large.count() if gram else 0
        if not n:
            return [*out, (suffixes, runs)]
        grows = may_hold(spark, membership_filter(large, "prefix", n), F.col("prefix"))
        marked = runs.withColumn("_grows", grows)
        out.append((suffixes, marked.where("NOT _grows").drop("_grows")))
        suffixes = stored(marked.where("_grows").select("run_a", "run_b", "low", "words").mapInArrow(_longer_prefixes(gram), SUFFIXES), "longer")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, text_key, spans): for each document with such windows, where windows begin that also begin in a document
    with a smaller doc_id, as stretches (at, windows, depth); depth is that of the deepest node, in words: the length of
    the longest maximal repeat that begins in the stretch, as far as its run of windows goes."""
    spark = docs.sparkSession
    counted = docs.select("doc", "text").mapInArrow(_count_anchors, "anchor long, low long, high long")
    shared = counted.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    shared = stored(shared.select("anchor"), "anchors")
    bits = spark.sparkContext.broadcast(membership_filter(shared, "anchor", shared.count()))
    places = None
    for suffixes, runs in reversed(memory_sized(stored(docs.mapInArrow(_suffix_runs(bits), SUFFIXES), "suffixes"))):
        trees = runs.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_build_trees, OWNED)
        if places is not None:  # what was found under longer prefixes, at its place in the run it was taken from
            trees = trees.unionByName(places.select(F.col("of_a").alias("run_a"), F.col("of_b").alias("run_b"), (F.col("start") + F.col("at")).alias("at"), "windows", "owner", "depth"))
        places = suffixes.select("run_a", "run_b", "of_a", "of_b", "start").join(trees, ["run_a", "run_b"])
    found = places.withColumnsRenamed({"of_a": "doc", "of_b": "text_key"}).where("owner < doc")
    return found.groupBy("doc", "text_key").agg(F.collect_list(F.struct((F.col("start") + F.col("at")).alias("at"), "windows", "depth")).alias("spans"))


CUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())])
CUT_ARROW = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _cutter(with_text: bool):
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            words = words_of(text)
            n = len(words)
            if own:
                gone = np.zeros(n + 1, np.int64)
                for s in own:
                    gone[s["at"]] += 1
                    gone[s["at"] + s["windows"] + WINDOW - 1] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:n] == 0).tolist()]
            kept = b" ".join(words)
            out.append({"n_words": n, "n_removed": n - len(words), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode("utf-8", "surrogatepass") if with_text else None})
        return pa.array(out, CUT_ARROW)

    return F.arrow_udf(run, CUT)


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and kept (the words left, joined by blanks; null unless with_text).

    Removed are the words of each window of 50 words of a document that also stands in one with a smaller doc_id.
    A null text has no words; a null doc_id is larger than all others, and null ones don't repeat each other; rows
    of one doc_id don't either. Columns of docs with these names are replaced.
    """
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_sha256", "kept")]
    keyed = docs.select(packed(names), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_doc"), F.xxhash64("text", F.lit(7)).alias("_key"))
    found = stored(repeats(keyed.select(F.col("_doc").alias("doc"), F.col("_key").alias("text_key"), "text")), "repeats")
    ids = found.select(F.xxhash64("doc", "text_key").alias("k"))
    may = may_hold(docs.sparkSession, membership_filter(ids, "k", found.count()), F.xxhash64("_doc", "_key"))
    split = keyed.withColumn("_may", may)
    hit = split.where("_may").join(found.withColumnsRenamed({"doc": "_doc", "text_key": "_key"}), ["_doc", "_key"], "left")
    clean = split.where("NOT _may").withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType))
    whole = hit.unionByName(clean).withColumn("_cut", _cutter(with_text)(F.col("text"), F.col("spans")))
    return whole.select(*unpacked(names), "_cut.*")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
