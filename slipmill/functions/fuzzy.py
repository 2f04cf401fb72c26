"""The two functions that need Python: a matcher's ratio, and the blocks in which two strings differ."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: Column, b: Column) -> Column:
    """difflib's ratio of two strings; null with null. Use it on distinct pairs that ratio_bound() lets by."""
    run = lambda x, y: pa.array([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())
    return F.arrow_udf(run, T.DoubleType())(a, b)


def ratio_bound(a: Column, b: Column) -> Column:
    """What the ratio is at most, from the lengths alone."""
    return 2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


BLOCKS = T.ArrayType(T.StructType([T.StructField("bad", T.StringType()), T.StructField("good", T.StringType())]))


def replaced_blocks(a: Column, b: Column, longest: int = 4) -> Column:
    """Where b has something else in the place of a stretch of a, both of `longest` characters at most."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True):
            found = SequenceMatcher(None, p or "", q or "").get_opcodes()
            out.append([{"bad": p[i:j], "good": q[k:m]} for tag, i, j, k, m in found if tag == "replace" and j - i <= longest and m - k <= longest])
        return pa.array(out, pa.list_(pa.struct([("bad", pa.string()), ("good", pa.string())])))

    return F.arrow_udf(run, BLOCKS)(a, b)
