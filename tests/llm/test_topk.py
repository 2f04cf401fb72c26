import math
import random

import numpy as np
from pyspark.sql import functions as F

from slipmill.llm import topk


def brute(rows, asks, k=20):
    sound = [(i, [max(-(2**63), min(2**63, math.floor(64 * x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(sound):
        if not asks(i):
            continue
        sums = [(j, sum(x * y for x, y in zip(q, v))) for b, (j, v) in enumerate(sound) if b != a]  # noqa: B905  zip ends with the shorter
        scored = [(-max(-(2**63), min(2**63 - 1, s)), j is not None, j or 0) for j, s in sums]
        out += [(i, r, j if known else None, -s) for r, (s, known, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(spark, rows, asks, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("x", "key", "asks", "c", "g", "rank")})
    return sorted(map(tuple, topk.search(df, asks, **options).collect()), key=str)


def by_twenty(i):
    return i is not None and i % 20 == 0


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1 / (1 + j)) for j in range(40)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 40) for i in range(300)]  # ties beyond k
    rows += [(20, rows[20][1]), (40, [0.1] * 40), (None, [0.9] * 40), (2000, None), (2020, [0.1, None]), (2040, [float("nan")] * 40), (2060, [float("inf")]), (2080, []), (2100, [1.0, -2.0]), (2101, [3.0] * 55), (2120, [0.0] * 40)]
    want = brute(rows, by_twenty)
    for options in ({}, {"candidate_rows": 90, "query_rows": 7}):
        assert got(spark, rows, F.col("vec_id") % 20 == 0, **options) == want


def test_large_components(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1.0, -1.0, 2.5]) * 10.0 ** rng.randrange(0, 18) for _ in range(5)]) for i in range(60)] + [(60, [1e300, -1e300, 1.0, 0.0, 0.0]), (80, [1e12 + 1] * 5)]
    assert got(spark, rows, F.col("vec_id") % 20 == 0, k=5) == brute(rows, by_twenty, 5)


def test_small(spark):
    assert got(spark, [], F.col("vec_id") % 20 == 0) == []
    assert got(spark, [(20, [1.0])], F.col("vec_id") % 20 == 0) == []
    assert got(spark, [(20, [1.0]), (21, [-1.0])], F.col("vec_id") % 20 == 0) == [(20, 1, 21, -4096)]


def test_bounds_leave_few():
    rng = np.random.default_rng(1)
    rows = np.floor(64 * rng.normal(size=(2000, 64)) / np.arange(1, 65))
    block = topk.Columns(rows, np.arange(2000), np.arange(2000))
    sizes = []
    for b in range(1, len(block.blocks)):
        q = rows[0, block.order]
        part = sum(q[block.cuts[x] : block.cuts[x + 1]] @ block.blocks[x] for x in range(b))
        slack = np.sqrt(np.square(q[block.cuts[b] :]).sum()) * block.rest[b - 1]
        sizes.append(int((part + slack >= np.sort(part - slack)[-20]).sum()))
    assert sizes == sorted(sizes, reverse=True) and sizes[0] < 400
