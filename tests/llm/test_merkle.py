import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from slipmill.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """The top of a list of nodes, and each one's siblings by level as (before, after)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p // 8 * 8
            steps[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 8])))
            at[i] = p // 8
        nodes = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], steps


def brute(rows, tampered):
    langs, tops, out = {}, [], []
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    for lang in order:
        own = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tops.append((own, *climb([leaf(r) for r in own])))
    root, more = climb([t[1] for t in tops])
    for (own, top, steps), extra in zip(tops, more, strict=True):
        for r, s in zip(own, steps, strict=True):
            changed = (*r[:4], r[4] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))
            d = leaf(changed) if tampered(r) else leaf(r)
            for b, a in [*s, *extra]:
                d = h(b, d, a)
            out.append((r[0], leaf(r), top, root, h(*[b + a for b, a in [*s, *extra]]), d, d == root))
    return sorted(out, key=str)


def by_id(r):
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0


ROWS = [(i, f"s{i % 3}", "en", i * 7, f"Text {i} É" if i % 5 else None) for i in range(4700)]
ROWS += [(10_000 + i, None, [None, "de", "é", "z", "Z", "😀", "￿"][i % 7], None, "Ab" * (i % 40)) for i in range(400)]
ROWS += [(9, "s", "en", 1, "Same"), (9, "s", "en", 1, "Same"), (9, "s", "en", 1, "other"), (None, None, None, None, None), (None, "x", "en", 0, ""), (1, "long", "lone", 5, "Q" * 300_000), (77, "a", "", 1, "-")]


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, COLUMNS).withColumns({c: F.lit("clash") for c in ("_g", "_pos", "_n", "node", "id", "steps", "root", "a.b")})
    got = merkle.manifest(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, by_id)


@pytest.mark.parametrize("rows", [[], ROWS[:1], ROWS[:8], ROWS[:9]])
def test_small(spark, rows):
    got = sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, COLUMNS)).collect()), key=str)
    assert got == (brute(rows, lambda r: False) if rows else []) and all(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 512])
def test_witnesses_grow_with_later_siblings(n):
    nodes = [h(str(i)) for i in range(n)]
    tree = merkle.Appender()
    held = [tree.append(d) for d in nodes]
    top, steps = climb(nodes)
    assert tree.finish(merkle.height(n)) == top and [w.steps() for w in held] == steps


def test_partial_witness_is_extended():
    tree = merkle.Appender()
    first = tree.append("a")
    assert first.steps() == []
    for d in "bcdefgh":
        tree.append(d)
    assert first.steps() == [("", "bcdefgh")]  # its run is closed, the one above is open
