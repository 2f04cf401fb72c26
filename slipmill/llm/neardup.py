"""Near-duplicates by ProbMinHash: signatures of weighted shingles, bands, and verified probability Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipmill.llm.common import MIX, WordCodes, bound_batches, cut, fold, forget, lean, may_hold, membership_filter, passes, slices, stored, utf8, without_ids

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares a band with a probability of 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.99995.
BANDS, ROWS = 25, 5
#: Pairs whose signatures agree less are not verified: over four standard deviations below 0.8.
LEAST_AGREEMENT = 0.64
#: Members of a bucket that are compared with each other at a time.
CHUNK = 1024
#: Links that a row proposes to other classes of its bucket in the first exact round; later rounds take GROWTH times as many.
PARTNERS, GROWTH = 64, 16
#: Rows of an Arrow batch where rows hold whole shingle sets.
WIDE_ROWS = 500
#: What the hashes' first halves, by which blocks compare sets, may be wrong by; entries that are compared at a time.
MARGIN, ENTRIES = 0.01, 1_000_000


def shingles(words: list[bytes], codes: WordCodes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of consecutive words, hashed, with their counts; fewer words than `size` are one shingle."""
    c = codes.of(words)
    n = min(size, len(c))
    h = np.zeros(len(c) - n + 1, np.uint64)
    for j in range(n):
        h = (h * np.uint64(MIX)) + c[j : len(c) - n + 1 + j]
    return np.unique(fold(h), return_counts=True)


def words_of(text: str | None) -> list[bytes]:
    return utf8(text.lower() if text else text).split()


def prob_min_hash(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """The ProbMinHash signatures (n_docs x m) of weighted elements, given flat with the index of their document.

    Every element is a Poisson process whose rate is its weight; its arrivals, drawn from its hash, fall on random
    components. A component keeps the element that came first. An element stops as soon as its next arrival is later
    than all of its document's components.
    """
    first, who = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    limit, t = np.full(n_docs, np.inf), np.zeros(len(elements))
    live, k = np.arange(len(elements)), 0
    while len(live):
        k += 1
        r = fold(elements[live] + np.uint64(k * MIX & 0xFFFFFFFFFFFFFFFF))
        t[live] -= np.log(((r >> np.uint64(11)) + 0.5) * 2.0**-53) / weights[live]
        keep = t[live] < limit[doc[live]]
        live, r = live[keep], r[keep]
        at, time = doc[live] * m + (fold(r) % np.uint64(m)).astype(np.int64), t[live]
        np.minimum.at(first, at, time)
        won = first[at] == time
        who[at[won]] = elements[live[won]]
        limit = first.reshape(n_docs, m).max(axis=1)
    return who.reshape(n_docs, m)


SIGNED = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])
SIGNED_ARROW = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


@lean
def _sign(texts: pa.Array) -> pa.Array:
    codes, m, out = WordCodes(), BANDS * ROWS, []
    for a, b, values in slices(texts):
        parts, keys, index = [], [], []
        for i, t in enumerate(values):
            words = words_of(t)
            if words:
                h, n = shingles(words, codes, SHINGLE)
                parts.append((h, n))
                key = xxhash.xxh3_128_digest(h.tobytes() + n.tobytes())
                keys.append((int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True)))
                index.append(i)
        rows: list = [None] * (b - a)
        if parts:
            doc = np.repeat(np.arange(len(parts)), [len(h) for h, _ in parts])
            sig = prob_min_hash(np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts]).astype(float), doc, len(parts), m)
            by_band = sig.reshape(len(parts), BANDS, ROWS)
            key = np.broadcast_to(fold(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(parts), BANDS))
            for j in range(ROWS):
                key = fold(key * np.uint64(MIX) + by_band[:, :, j])
            short = (fold(sig) >> np.uint64(48)).astype(np.uint16)
            for i, (x, y), bands, s in zip(index, keys, key.view(np.int64), short, strict=True):
                rows[i] = {"a": x, "b": y, "bands": bands.tolist(), "sig": s.tobytes()}
        out += rows
    return pa.array(out, SIGNED_ARROW)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many components of signatures agree, for each row of a and each of b."""
    if len(a) * len(b) <= 256:
        return (a[:, None, :] == b[None, :, :]).sum(axis=2)
    out = np.zeros((len(a), len(b)), np.min_scalar_type(a.shape[1]))
    for j in range(a.shape[1]):
        out += a[:, j, None] == b[None, :, j]
    return out


def _spanning(sig: np.ndarray) -> list[tuple[int, int, float]]:
    """The maximum spanning forest by agreement among rows of signatures (Prim's algorithm): the first links to verify.

    Agreement is an estimate, so what these leave apart is settled by the exact rounds.
    """
    n, m = sig.shape
    agree = _agreement(sig, sig).astype(np.int64)
    np.fill_diagonal(agree, -1)
    best, source, out = agree[0].copy(), np.zeros(n, np.int64), []
    done = np.zeros(n, bool)
    done[0] = True
    for _ in range(n - 1):
        i = int(np.where(done, -2, best).argmax())
        done[i] = True
        if best[i] >= np.ceil(LEAST_AGREEMENT * m - 1e-9):
            out.append((i, int(source[i]), float(best[i] / m)))
        better = agree[i] > best
        best[better], source[better] = agree[i][better], i
    return out


def _grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], names: tuple[str, ...]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Groups of equal `by` of a partition that is sorted by it."""
    current, rows = None, {}
    for batch in batches:
        # Columns become Python objects a batch at a time; batches are small where rows are wide.
        for key, row in zip(zip(*(batch[c].to_pylist() for c in by), strict=True), zip(*(batch[c].to_pylist() for c in names), strict=True), strict=True):
            if key != current:
                if current is not None:
                    yield current, rows
                current, rows = key, {c: [] for c in names}
            for c, v in zip(names, row, strict=True):
                rows[c].append(v)
    if current is not None:
        yield current, rows


def _batches(found: Iterator[list[np.ndarray]], names: list[str], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of about `most` rows out of columns that come in pieces."""
    held, n = [], 0
    for columns in found:
        held.append(columns)
        n += len(columns[0])
        if n >= most:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)


@lean
def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first links (x > y) within the parts (key, part) of a partition that is sorted by them."""

    def found() -> Iterator[list[np.ndarray]]:
        for _, rows in _grouped(batches, ("key", "part"), ("doc", "sig")):
            if len(rows["doc"]) > 1:
                doc = np.array(rows["doc"], np.int64)
                links = _spanning(np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(doc), -1))
                if links:
                    i, j = (doc[[x[k] for x in links]] for k in (0, 1))
                    yield [np.maximum(i, j), np.minimum(i, j)]

    yield from _batches(found(), ["x", "y"])


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets (sorted elements, weights): the sum over shared d of 1 / sum of max(a'/a_d, b'/b_d)."""
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.concatenate([[0], np.cumsum(y)])[np.searchsorted(ratio, ratio, side="left")]
    above = x.sum() - np.concatenate([[0], np.cumsum(x)])[np.searchsorted(ratio, ratio, side="left")]
    both = (x > 0) & (y > 0)
    return float((1 / (above[both] / x[both] + below[both] / y[both])).sum())


SET = T.StructType([T.StructField("h", T.BinaryType()), T.StructField("n", T.BinaryType()), T.StructField("half", T.BinaryType())])


@lean
def _shingled(texts: pa.Array) -> pa.Array:
    """Each text's shingles (8 bytes each, sorted), their counts (4 bytes each; none if all are 1), and their first halves."""
    codes, out = WordCodes(), []
    for _, _, values in slices(texts):
        for t in values:
            words = words_of(t)
            h, n = shingles(words, codes, SHINGLE) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            out.append({"h": h.tobytes(), "n": b"" if (n == 1).all() else n.astype(np.uint32).tobytes(), "half": (h >> np.uint64(32)).astype(np.uint32).tobytes()})
    return pa.array(out, pa.struct([("h", pa.binary()), ("n", pa.binary()), ("half", pa.binary())]))


def _weighted(h: bytes, n: bytes, kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    elements = np.frombuffer(h, kind)
    return elements, np.frombuffer(n, np.uint32).astype(float) if n else np.ones(len(elements))


@lean
def _similar(xs: pa.Array, ys: pa.Array) -> pa.Array:
    return pa.array([probability_jaccard(_weighted(**x), _weighted(**y)) for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True)], pa.float64())


class Sets:
    """The shingle sets of a block's rows, end to end, with first halves of hashes as indices of a common table."""

    def __init__(self, sets: list[dict]):
        each = [_weighted(x["half"], x["n"], np.uint32) for x in sets]
        size = np.array([len(h) for h, _ in each])
        values, self.codes = np.unique(np.concatenate([h for h, _ in each]), return_inverse=True)
        self.weights = np.concatenate([w for _, w in each])
        self.size, self.start = size, np.cumsum(size) - size
        self.total = np.array([w.sum() for _, w in each])
        self.unit = bool((self.weights == 1).all())
        self.table = np.zeros(len(values), np.uint8 if self.unit else float)

    def bounds(self, i: int, others: np.ndarray) -> np.ndarray:
        """The probability Jaccard of row i and others, from above; exact where all counts are 1.

        The sum over unshared elements is exact; over shared ones the greater of both sums stands for the sum of the greater.
        """
        own = slice(self.start[i], self.start[i] + self.size[i])
        if self.unit:
            self.table[self.codes[own]] = 1
            both = np.add.reduceat(self.table[self.codes], self.start, dtype=np.int64)[others]
            self.table[self.codes[own]] = 0
            return both / (self.size[i] + self.size[others] - both)
        self.table[self.codes[own]] = self.weights[own]
        stops = np.searchsorted(np.cumsum(self.size[others]) // ENTRIES, np.arange(self.size[others].sum() // ENTRIES + 1), side="right")
        parts = [self._bound(i, x) for x in np.split(others, stops[:-1]) if len(x)]
        self.table[self.codes[own]] = 0
        return np.concatenate(parts)

    def _bound(self, i: int, others: np.ndarray) -> np.ndarray:
        size = self.size[others]
        of = np.repeat(np.arange(len(others)), size)
        at = np.arange(len(of)) + np.repeat(self.start[others] - np.cumsum(size) + size, size)
        x = self.table[self.codes[at]]
        shared = x > 0
        x, y, of = x[shared], self.weights[at[shared]], of[shared]
        xs, ys = np.bincount(of, x, len(others)), np.bincount(of, y, len(others))
        below = (self.total[i] - xs)[of] / x + (self.total[others] - ys)[of] / y + np.maximum(xs[of] / x, ys[of] / y)
        return np.bincount(of, 1 / below, len(others))


def _needed(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The sets that a bounded filter over docs (doc) doesn't rule out: all that a join with docs needs, and few others."""
    docs = docs.distinct()
    return sets.where(may_hold(sets.sparkSession, membership_filter(docs.select(F.xxhash64("doc").alias("k")), "k", docs.count()), F.xxhash64("doc")))


def _verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (x, y, ...) whose shingle sets are similar enough, stored.

    Each end of a link fetches its set, and a link is a group of its two ends, so that a document with many links is
    no hot key; the join that fetches is of two stored tables, whose hot partitions Spark splits.
    """
    more = [c for c in links.columns if c not in ("x", "y")]
    ends = links.withColumn("doc", F.explode(F.array("x", "y")))
    ends = ends.join(_needed(sets, ends.select("doc")).select("doc", F.struct("set.h", "set.n").alias("set")), "doc")
    end = lambda c: F.max(F.when(F.col("doc") == F.col(c), F.col("set")))
    both = ends.groupBy("x", "y", *more).agg(end("x").alias("sx"), end("y").alias("sy"))
    s = F.arrow_udf(_similar, T.DoubleType())(F.col("sx"), F.col("sy"))
    return stored(both.select("x", "y", *more, s.alias("s")).where(F.col("s") >= similarity - 1e-12).drop("s"), "verified", batch_rows=WIDE_ROWS)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (x, y) as stars (node, least node) of what is connected within about EDGES edges of the partition."""

    def stars(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        i, j = at[: len(x)], at[len(x) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, label[i], low)
            np.minimum.at(new, label[j], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        other = label != np.arange(len(nodes))
        return [nodes[other], nodes[label[other]]]

    def found() -> Iterator[list[np.ndarray]]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([batch[c].to_numpy() for c in ("x", "y")])
                n += batch.num_rows
            if n >= EDGES:
                yield stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, n = [], 0
        if held:
            yield stars(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return _batches(found(), ["x", "y"])


#: Edges that are contracted at a time in a task.
EDGES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component of edges (x, y), by alternating large and small stars.

    What is connected within a task is contracted first, which shortens paths, so few rounds are left.
    """
    edges = edges.where("x <> y").select("x", "y").mapInArrow(_contract, "x long, y long")
    seen, edges = None, stored(edges, "edges")
    while True:
        both = edges.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.*")
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y")
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.explode(F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct("x", F.col("m").alias("y")))).alias("e")).select("e.*")
        last, edges = edges, stored(small.where("x <> y").distinct(), "edges")
        forget(last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
        seen = now


MET = "key long, a long, b long, doc long, root long, part long, open long, sig binary"
PROPOSED = "doc long, other long, rx long, ry long, rest boolean"


def _sides(a: int, b: int, part: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block that are compared: each on the left with each on the right."""
    if a != b:
        return np.flatnonzero(part == a), np.flatnonzero(part == b)
    # Members of the most frequent class needn't meet each other.
    _, inverse, n = np.unique(root, return_inverse=True, return_counts=True)
    return np.flatnonzero(inverse != n.argmax()), np.arange(len(root))


def _partners(left: np.ndarray, right: np.ndarray, root: np.ndarray, open_: np.ndarray, sig: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of left with those rows of right that are of other classes and whose signatures agree enough.

    A pair that shares several bands is compared in the bucket of the first one alone; one of its rows must be open.
    """
    bands = sig.reshape(len(sig), -1, ROWS)
    own = int((bands == bands[0]).all(axis=(0, 2)).argmax())  # at most the band whose bucket this is: all its rows agree there
    may = _agreement(sig[left], sig[right]) >= np.ceil(LEAST_AGREEMENT * sig.shape[1] - 1e-9)
    may &= root[left][:, None] != root[right][None, :]
    for i in np.flatnonzero(may.any(axis=1)).tolist():
        at = right[may[i]]
        at = at if open_[left[i]] else at[open_[at] > 0]
        at = at[~(bands[at, :own] == bands[left[i], :own]).all(axis=2).any(axis=1)]
        if len(at):
            yield int(left[i]), at


@lean
def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block (key, a, b) of a partition that is sorted by them: the rows that have a partner in it."""

    def found() -> Iterator[list[pa.Array]]:
        for (key, a, b), rows in _grouped(batches, ("key", "a", "b"), ("doc", "root", "part", "open", "sig")):
            root, part, open_ = (np.array(rows[c], np.int64) for c in ("root", "part", "open"))
            left, right = _sides(a, b, part, root)
            if len(left) and len(right):
                kept = np.zeros(len(root), bool)
                for i, at in _partners(left, right, root, open_, np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(root), -1)):
                    kept[i] = kept[at] = True
                own = np.flatnonzero(kept).tolist()
                for k in range(0, len(own), 4 * WIDE_ROWS):
                    some = own[k : k + 4 * WIDE_ROWS]
                    yield [[x] * len(some) for x in (key, a, b)] + [[rows[c][i] for i in some] for c in ("doc", "root", "part", "open", "sig")]

    names = [x.split()[0] for x in MET.split(", ")]
    for columns in found():
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if x == "sig" else pa.int64()) for c, x in zip(columns, names, strict=True)], names)


def _proposals(left: np.ndarray, right: np.ndarray, doc: np.ndarray, root: np.ndarray, open_: np.ndarray, sig: np.ndarray, sets: Sets, most: int, least: float) -> Iterator[list[np.ndarray]]:
    """Links of rows of left to rows of right in other classes that may be similar: of each row all, or `most`.

    Pairs whose signatures or sets rule it out are settled here. Where a row has more than `most`, rest is true in its links.
    """
    for i, at in _partners(left, right, root, open_, sig):
        bounds = sets.bounds(i, at)
        at, bounds = at[bounds >= least], bounds[bounds >= least]
        rest = len(at) > most
        if rest:
            at = at[np.argpartition(-bounds, most)[:most]]
        if len(at):
            yield [np.full(len(at), doc[i]), doc[at], np.full(len(at), root[i]), root[at], np.full(len(at), rest)]


def _blocks(most: int, similarity: float):
    """Compares the rows of each block (key, a, b) of a partition that is sorted by them."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[np.ndarray]]:
            for (_, a, b), rows in _grouped(batches, ("key", "a", "b"), ("doc", "root", "part", "open", "sig", "set")):
                doc, root, part, open_ = (np.array(rows[c], np.int64) for c in ("doc", "root", "part", "open"))
                left, right = _sides(a, b, part, root)
                if len(left) and len(right):
                    sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(doc), -1)
                    yield from _proposals(left, right, doc, root, open_, sig, Sets(rows["set"]), most, similarity - MARGIN)

        yield from _batches(found(), ["doc", "other", "rx", "ry", "rest"])

    return run


def _across(state: DataFrame, sets: DataFrame, most: int, similarity: float) -> DataFrame | None:
    """PROPOSED links between rows of state (doc, keys, sig, root, open) that share a bucket, are of different classes, and one is open.

    Each pair of such rows is compared once in a bucket, whatever its size: buckets of more than CHUNK rows are cut into
    parts, and each two parts are a block of their own, but for those within the most frequent class of the bucket.
    Signatures are compared first; only rows that have a partner then fetch their sets. None if no row has one.
    """
    sizes = state.select(F.explode("keys").alias("key"), "root", "open").groupBy("key", "root").agg(F.count("*").alias("n"), F.max("open").alias("open"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"), F.max("open").alias("open")).where("classes > 1 AND open = 1")
    mixed = stored(mixed.select("key", "n", F.col("top.root").alias("most"), F.col("top.n").alias("n_most")), "mixed")
    if mixed.isEmpty():
        return None
    part = lambda n: F.ceil(n / F.lit(CHUNK))
    rows = state.select(F.explode("keys").alias("key"), "doc", "root", "open", "sig").join(mixed, "key")
    met = rows.withColumns({"few": part(F.col("n") - F.col("n_most")), "many": part(F.col("n_most")), "h": F.xxhash64("doc", "key")})
    whole, most_ = F.col("n") <= CHUNK, F.col("root") == F.col("most")
    met = met.withColumn("part", F.when(whole, F.lit(0)).when(most_, F.col("few") + F.pmod("h", "many")).otherwise(F.pmod("h", "few")))
    last = F.when(whole, F.lit(0)).when(most_, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1)
    met = met.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    met = met.select("key", F.least("part", "q").alias("a"), F.greatest("part", "q").alias("b"), "doc", "root", "part", "open", "sig")
    met = met.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_open_rows, MET)
    met = stored(met, "met", batch_rows=4 * WIDE_ROWS)
    if met.isEmpty():
        return None
    met = met.join(_needed(sets, met.select("doc")).select("doc", F.struct("set.half", "set.n").alias("set")), "doc")
    return met.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_blocks(most, similarity), PROPOSED)


def _linked(docs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the documents of reps that are of one class with another one: root is the class's least id.

    First the links of forests within buckets are verified; then, in rounds, those between classes that are left, of
    each row a bounded number at a time and more in the next round, until no row holds any back: then each pair that
    shares a bucket, may be similar and may join two classes has been verified.
    """
    spark = docs.sparkSession
    shared = stored(reps.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    bits = spark.sparkContext.broadcast(membership_filter(shared, "key", shared.count()))

    @lean
    def keep(bands: pa.Array) -> pa.Array:
        keys = np.array(bands.to_pylist(), np.int64).reshape(-1, BANDS)
        ok = passes(bits.value, keys.reshape(-1).view(np.uint64)).reshape(keys.shape)
        return pa.array([k[o].tolist() for k, o in zip(keys, ok, strict=True)], pa.list_(pa.int64()))

    met = reps.select(F.col("doc_id").alias("doc"), F.arrow_udf(keep, T.ArrayType(T.LongType()))(F.col("bands")).alias("keys"), "sig")
    met = stored(met.where(F.size("keys") > 0), "met")
    may = may_hold(spark, membership_filter(met.select(F.xxhash64("doc").alias("k")), "k", met.count()), F.xxhash64("doc_id"))
    # Repeated rows of an id are one document: the greatest text stands for it.
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").where(may).groupBy("doc_id").agg(F.max("text").alias("text"))
    sets = stored(texts.select(F.col("doc_id").alias("doc"), F.arrow_udf(_shingled, SET)(F.col("text")).alias("set")), "sets", batch_rows=WIDE_ROWS)

    heavy = stored(shared.where(F.col("n") > CHUNK).select("key", F.ceil(F.col("n") / CHUNK).alias("parts")), "heavy")
    rows = met.select(F.explode("keys").alias("key"), "doc", "sig")
    if heavy.isEmpty():
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    else:  # a large bucket is dealt in parts, anew in each band
        rows = rows.join(heavy, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc", "key"), F.col("parts")), F.lit(0).cast("long"))).drop("parts")
    found = rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_forests, "x long, y long")
    root = components(_verified(stored(found.distinct(), "forests"), sets, similarity))
    most, held = PARTNERS, None
    while True:
        state = met.join(root, F.col("doc") == F.col("node"), "left").select("doc", "keys", "sig", F.coalesce("root", "doc").alias("root"))
        # All rows are open in the first round, then those of which links were held back.
        state = state.withColumn("open", F.lit(1).cast("long")) if held is None else state.join(held, "doc", "left").withColumn("open", F.coalesce("open", F.lit(0).cast("long")))
        state = stored(state, "state")
        proposed = _across(state, sets, most, similarity)
        if proposed is None:
            return root
        pair = proposed.groupBy(F.greatest("doc", "other").alias("x"), F.least("doc", "other").alias("y"))
        fresh = stored(pair.agg(F.max(F.least("rx", "ry")).alias("ra"), F.max(F.greatest("rx", "ry")).alias("rb"), F.max("rest").alias("rest")), "fresh", batch_rows=WIDE_ROWS)
        held = fresh.where("rest").select(F.explode(F.array("x", "y")).alias("doc")).distinct().withColumn("open", F.lit(1).cast("long"))
        more = not held.isEmpty()
        sure = _verified(fresh.drop("rest"), sets, similarity)
        if not sure.isEmpty():
            top = components(sure.select(F.col("rb").alias("x"), F.col("ra").alias("y")))
            ids = state.select("doc", "root").join(top.withColumnRenamed("root", "to"), F.col("root") == F.col("node"), "left")
            root = stored(ids.select(F.col("doc").alias("node"), F.coalesce("to", "root").alias("root")).where("node <> root"), "root")
        forget(state)
        if not more:
            return root
        most *= GROWTH


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every row: class_id is the least doc_id that is linked to it, directly or in steps.

    Texts are linked if the probability Jaccard of their five-word shingles (lower-cased words between white space,
    weighted by count; fewer than five words are one shingle) is at least `similarity`. A text without words is
    linked to none. Rows of the same doc_id are one document. A null doc_id has no class: class_id is null.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = stored(docs.withColumn("s", F.arrow_udf(_sign, SIGNED)(F.col("text"))).select("doc_id", "s.*"), "signed", batch_rows=4 * WIDE_ROWS)
    # Equal shingle sets are one class from the start; its least id stands for it.
    own = signed.where("doc_id IS NOT NULL AND a IS NOT NULL")
    reps = stored(own.groupBy("a", "b").agg(F.min(F.struct("doc_id", "bands", "sig")).alias("r")).select("a", "b", "r.*"), "reps")
    root = _linked(docs, reps, similarity)
    top = reps.select("a", "b", F.col("doc_id").alias("rep")).join(root, F.col("rep") == F.col("node"), "left").select("a", "b", F.coalesce("root", "rep").alias("top"))
    out = signed.select("doc_id", "a", "b").join(top, ["a", "b"], "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "doc_id")).alias("class_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class: the one of the least doc_id. Repeated rows of it are one document."""
    found = cut(classes(docs, similarity))
    kept = without_ids(docs, found.where("doc_id <> class_id").select("doc_id"))
    twice = cut(found.where("doc_id = class_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    again = kept.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return without_ids(kept, twice).unionByName(again)


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
