"""Against a brute-force version over all windows."""

import hashlib
import random
import re

from pyspark.sql import Row

from slipmill.llm import substrings


def brute(docs):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in docs]
    ids = [i if i is not None else 1 << 62 for i, _ in docs]
    owner = {}
    for i, w in zip(ids, words):
        for p in range(len(w) - 49):
            g = tuple(w[p : p + 50])
            owner[g] = min(owner.get(g, i), i)
    out = []
    for (doc_id, _), i, w in zip(docs, ids, words):
        gone = {q for p in range(len(w) - 49) if owner[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        kept = b" ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, docs):
    df = spark.createDataFrame([Row(doc_id=i, text=t, n_words="clash") for i, t in docs], "doc_id long, text string, n_words string")
    got = [tuple(r) for r in substrings.dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute(docs)
    return got


def fixture():
    rng = random.Random(5)
    vocab = [f"w{i}é" for i in range(300)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared, loop = make(80), make(3) * 60
    docs = [(10, "a b"), (11, None), (12, ""), (13, " \t\x0b "), (None, " ".join(shared)), (None, " ".join(shared[:60]))]
    docs += [(20 + i, " ".join(make(30) + shared[i : i + 55] + make(20))) for i in range(12)]
    docs += [(40, " ".join(loop)), (39, "\n".join(loop + make(9))), (41, " ".join(make(49))), (42, " ".join(shared[:50])), (43, " ".join(shared[:49]))]
    docs += [(50, "x " * 400), (51, "x " * 60), (51, "x " * 60), (52, " ".join(make(5000) + shared))]
    return docs


def test_brute_force(spark):
    got = check(spark, fixture())
    assert sum(r[2] for r in got) > 500


def test_prefixes_grow(spark, monkeypatch):
    """Every prefix grows to the whole window; some do."""
    for group in (10, 300):
        monkeypatch.setattr(substrings, "GROUP_WORDS", group)
        check(spark, fixture())


def test_groups_are_bounded(spark, monkeypatch):
    """One periodic text of many lengths, and one passage in many surroundings: no prefix holds more words than it may."""
    monkeypatch.setattr(substrings, "GROUP_WORDS", 3000)
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    loop, passage = [word() for _ in range(3)], [word() for _ in range(50)]
    docs = [(i, " ".join(loop * rng.randrange(20, 200))) for i in range(40)]
    docs += [(100 + i, " ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)])) for i in range(60)]
    check(spark, docs)
    found = []
    real = substrings.memory_sized
    monkeypatch.setattr(substrings, "memory_sized", lambda s: found.append(real(s)) or found[-1])
    substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string")).count()
    assert len(found[0]) > 1
    for suffixes, runs in found[0]:
        sums = {}
        for r in runs.collect():
            assert len(r.words.split()) == r.windows + 49
            sums[r.prefix] = sums.get(r.prefix, 0) + r.windows + 49
        assert all(n <= 3000 for n in sums.values())


def test_runs_are_bounded():
    for gram, most in ((19, substrings.RUN_WINDOWS), (50, 1)):
        _, _, texts, begins, sizes, key = substrings._runs([[b"x"] * 5000, [b"y"] * 10, [b"x"] * 60], substrings.Anchors(gram))
        assert sizes.max() == most and set(key.tolist()) == {int(key[0])}
        places = sorted(p for x, n in zip(begins.tolist(), sizes.tolist()) for p in range(x, x + n))
        assert places == [*range(4951), *range(5010, 5021)] and set(texts.tolist()) == {0, 2}


def test_empty(spark):
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in substrings.op2_substring_dedup(spark, sf).collect()), key=str)
    assert got == brute([tuple(r) for r in rows])


def test_node_depth():
    a, b = [b"x%d" % i for i in range(60)], [b"x%d" % i for i in range(55)] + [b"y"] * 5
    n = substrings.deep_nodes([a, b], [11, 11])[0].tolist()
    assert n[:6] == n[11:17] and not set(n[6:11]) & set(n[17:])


def test_deep_nodes():
    """Against all pairs of suffixes: who shares a node, and its depth (the least that its leaves have in common)."""
    import numpy as np

    rng = random.Random(8)
    for depth in (2, 3, 5):
        runs = [[rng.choice((b"a", b"b")) for _ in range(rng.randrange(depth, 14))] for _ in range(rng.randrange(1, 6))] + [[b"a"] * 30]
        windows = [len(r) - depth + 1 for r in runs]
        node, deep = substrings.deep_nodes(runs, windows, depth)
        suffixes = [r[i:] for r, n in zip(runs, windows) for i in range(n)]
        common = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        for i, x in enumerate(suffixes):
            same = [j for j, y in enumerate(suffixes) if j != i and common(x, y) >= depth]
            assert same == [j for j in np.flatnonzero(node == node[i]).tolist() if j != i]
            group = [i, *same]
            assert deep[i] == (min(common(suffixes[a], suffixes[b]) for a in group for b in group if a != b) if same else 0)
