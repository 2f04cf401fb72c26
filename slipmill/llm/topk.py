"""Exact top-k search by inner product: columnar branch and bound over blocks of dimensions in vertical layout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipmill.llm.common import lean, stored

K = 20
#: Rows of a block of candidates, and queries of a block: a task holds one of each. Together they bound its memory.
CANDIDATE_ROWS, QUERY_ROWS = 16_384, 1_024
#: Components of a block of dimensions; cells of partial scores that are held at once.
DIMENSIONS, CELLS = 16, 1 << 21
#: Sums of products below this are exact as doubles. What stands for a null id, before all others.
EXACT, NO_ID = float(1 << 53), -(2**63)


def components(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as double; null where the vector is null, or a component is null or not finite.

    Components beyond a long end at its bounds.
    """
    x = embedding.cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(sound, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("double")))


def matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of components, ended by zeros up to width."""
    arrays = vectors.chunks if isinstance(vectors, pa.ChunkedArray) else [vectors]
    out, at = np.zeros((len(vectors), width)), 0
    for a in arrays:
        lengths = pc.list_value_length(a).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = a.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        rows = np.repeat(np.arange(len(a)), lengths)
        out[at + rows, np.arange(len(flat)) - starts[rows]] = flat
        at += len(a)
    return out


class Columns:
    """A block of candidates by columns: blocks of dimensions, heaviest first, and what mass each row has after each block."""

    def __init__(self, rows: np.ndarray, keys: np.ndarray, ids: np.ndarray):
        self.ids, self.keys, self.rows = ids, keys, rows
        self.order = np.argsort(-np.square(rows).sum(axis=0), kind="stable")
        vertical = np.ascontiguousarray(rows[:, self.order].T)
        width = vertical.shape[0]
        self.cuts = [*range(0, max(1, width), DIMENSIONS), width]
        self.blocks = [vertical[a:b] for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        # Norms of what is left after each block, a little too large rather than too small.
        mass = np.cumsum([np.square(b).sum(axis=0) for b in self.blocks][::-1], axis=0)[::-1]
        self.rest = [*(np.sqrt(m) * (1 + 1e-9) for m in mass[1:]), np.zeros(len(ids))]
        self.most = np.abs(rows).max(axis=1, initial=0)

    def search(self, queries: np.ndarray, keys: np.ndarray, k: int):
        """(query's place, candidate's id, score) of each query's k best here, ties to smaller ids; keys tell a query's own row.

        A block of dimensions is added for all queries at once at first, then for the candidates that are left alone: those
        whose score can still reach the k-th best of what all others have for certain. The bound is Cauchy-Schwarz on the rest.
        Rows too large for exact doubles are reckoned in whole numbers.
        """
        vertical, step = queries[:, self.order], max(1, CELLS // max(1, len(self.ids)))
        for at in range(0, len(queries), step):
            q = vertical[at : at + step]
            first = q[:, : self.cuts[1]] @ self.blocks[0]
            norms = [np.sqrt(np.square(q[:, c:]).sum(axis=1)) * (1 + 1e-9) for c in self.cuts[1:]]
            for i in range(len(q)):
                large = self.most * np.abs(q[i]).max(initial=0) * q.shape[1] >= EXACT
                other = self.keys != keys[at + i]
                alive = np.flatnonzero(other & ~large)
                part = first[i][alive]
                for b in range(len(self.blocks)):
                    if b:
                        part = part + q[i, self.cuts[b] : self.cuts[b + 1]] @ self.blocks[b][:, alive]
                    if len(alive) > k:
                        slack = norms[b][i] * self.rest[b][alive]
                        kth = np.partition(part - slack, len(alive) - k)[len(alive) - k]
                        keep = part + slack >= kth
                        alive, part = alive[keep], part[keep]
                best = np.lexsort((self.ids[alive], -part))[:k]
                found = [(-int(s), int(v)) for s, v in zip(part[best], self.ids[alive[best]], strict=True)]
                if large.any():
                    whole = [int(v) for v in queries[at + i]]
                    sums = ((j, sum(x * int(y) for x, y in zip(whole, self.rows[j], strict=True))) for j in np.flatnonzero(other & large))
                    found = sorted([*found, *((-max(-(2**63), min(2**63 - 1, s)), int(self.ids[j])) for j, s in sums)])[:k]
                for score, vec in found:
                    yield at + i, vec, -score


def searched(k: int):
    @lean
    def of_pair(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        """The k best of a block of candidates for each query of a block."""
        places, vecs, scores = [], [], []
        if len(candidates) and len(queries):
            width = max(pc.max(pc.list_value_length(t["x"])).as_py() for t in (candidates, queries))
            block = Columns(matrix(candidates["x"], width), candidates["key"].to_numpy(), pc.fill_null(candidates["vec_id"], NO_ID).to_numpy())
            for place, vec, score in block.search(matrix(queries["x"], width), queries["key"].to_numpy(), k):
                places.append(place)
                vecs.append(None if vec == NO_ID else vec)
                scores.append(score)
        taken = pa.array(places, pa.int64())
        return pa.table({"key": queries["key"].take(taken), "query_id": queries["vec_id"].take(taken), "vec_id": pa.array(vecs, pa.int64()), "score": pa.array(scores, pa.int64())})

    return lambda candidates, queries: of_pair(candidates, queries)


def search(vectors: DataFrame, asks: Column, k: int = K, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of vectors (vec_id, embedding) where `asks` holds its k best others.

    Scores are exact inner products of floor(64 * component); ties go to smaller ids (null before all), equal ones to any.
    Vectors that are null, or hold a null or a component that isn't finite, take no part. A shorter vector counts as ended by
    zeros, an empty one scores 0 with all. Repeated ids are vectors of their own: a query leaves out its own row alone.
    A score beyond a long ends at its bounds, where it ties with others. Columns other than the two aren't looked at. An empty table gives an empty one.

    Each pair of a block of candidates and a block of queries is a task of bounded size; what leaves it are k rows a query.
    """
    rows = vectors.select("vec_id", components(F.col("embedding")).alias("x"), F.coalesce(asks, F.lit(False)).alias("asks")).where("x IS NOT NULL")
    rows = stored(rows.withColumn("key", F.monotonically_increasing_id()), "vectors")
    n, m = rows.agg(F.count("*"), F.count_if("asks")).first()
    # Blocks are dealt by a hash, so that they are about even; as many as keep them below the bound on average.
    blocks, groups = max(1, -(-n // candidate_rows)), max(1, -(-m // query_rows))
    deal = lambda count, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = rows.select("key", "vec_id", "x", deal(blocks, 1).alias("c"), every(groups).alias("g"))
    queries = rows.where("asks").select("key", "vec_id", "x", every(blocks).alias("c"), deal(groups, 2).alias("g"))
    pairs = candidates.groupBy("c", "g").cogroup(queries.groupBy("c", "g"))
    found = pairs.applyInArrow(searched(k), "key long, query_id long, vec_id long, score long")
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op12_exact_topk(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id NULLS FIRST))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
