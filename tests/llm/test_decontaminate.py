import hashlib
import re

import pytest

from slipmill.llm import decontaminate


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    grams = {}
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for p in range(len(w) - n + 1):
                if g := grams.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= g
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short Item"), (10, "short, item!"), (3, None), (4, " .. "), (None, "only é9 here"), (5, "One two three four five six seven eight nine ten eleven twelve")]
DOCS = [(1, "x ONE two-three four; five six seven eight nine ten. eleven y"), (2, None), (3, ""), (4, "a short\nitem b short item"), (5, "only É9 here only é9 here"), (6, "two three four five six seven eight nine ten"),
        (7, "z " * 50_000 + "one two three four five six seven eight nine ten eleven twelve"), (8, "short"), (8, "short item"), (8, "short item"), (None, "item short item")]


@pytest.mark.parametrize("block", [32_000_000, 20])
def test_brute_force(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("scan", decontaminate.F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.scan(docs, items, block_bytes=block).select("doc_id", "scan.n_words", "scan.n_hit", "scan.items").collect()
    rows = [(r[0], r[1], r[2], len(r[3]), hashlib.sha256(",".join(r[3]).encode()).hexdigest(), r[2] > 0) for r in got]
    assert sorted(rows, key=str) == brute(DOCS, ITEMS)


def test_removal(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.decontaminate(docs, items).collect()
    assert len(kept) == sum(not r[-1] for r in brute(DOCS, ITEMS))
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items, remove="spans").collect()}
    assert cut[1] == "x y" and cut[4] == "a b" and cut[2] is None and cut[6] == DOCS[5][1]


def test_empty(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, items).count() == len(DOCS)
    assert decontaminate.decontaminate(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
