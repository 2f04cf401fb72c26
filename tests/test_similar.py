"""The similarity join against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from slipmill.operators import similar


def frames(spark, names, known):
    return spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(k,) for k in known], "known string")


def brute(names, known, least):
    out = {}
    for n in {x for x in names if x is not None}:
        best = min(((-SequenceMatcher(None, n.lower(), k.lower()).ratio(), k) for k in known if k is not None), default=(0, ""))
        if -best[0] > least:
            out[n] = (best[1], -best[0])
    return out


def misread(rng, s):
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + rng.choice("abKé4/ ") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("XY1") + s[i + 1 :]])
    return s


@pytest.mark.parametrize("least", [0.82, 0.6, 0.3])
def test_against_all_pairs(spark, least):
    rng = random.Random(7)
    known = [f"RAVI{''.join(rng.choice('ABCDEFGHIJ') for _ in range(rng.randrange(1, 6)))}/K" for _ in range(60)] + ["Aman Traders", "AMAN TRADERS", "", "x", "ab", "aaaaaaaaaa", None, "Zoë & Söhne", "long " * 60]
    names = [misread(rng, rng.choice([k for k in known if k])) for _ in range(150)] + [None, "", "q", "aaaaaaa", "aman traders", "long " * 59 + "lang "]
    got = {r["name"]: (r["known"], r["ratio"]) for r in similar.similar(*frames(spark, names, known), least).collect()}
    assert got == brute(names, known, least)


def test_few_pairs_meet(spark):
    """Names with one ending and one beginning in common, of few lengths: few of all pairs have their ratio computed."""
    rng = random.Random(8)
    known = sorted({f"ravi{rng.randrange(10**6):06d}/k" for _ in range(1500)})
    names = sorted({misread(rng, rng.choice(known)) for _ in range(1500)})
    text = lambda xs: spark.createDataFrame([(x,) for x in xs], "text string")
    met = [tuple(r) for r in similar.meeting(text(names), text(known), 0.82).collect()]
    assert len(met) == len(set(met)) < 0.1 * len(names) * len(known)
    assert sorted(met) == sorted(map(tuple, similar.meeting(text(names), text(known), 0.82, key_rows=20).collect()))


def test_empty(spark):
    for names, known in (([], ["abcd"]), (["abcd"], []), ([], [])):
        assert similar.similar(*frames(spark, names, known), 0.82).count() == 0


def test_names_are_extracted_once(spark, sf):
    """The plan begins at stored names: extraction isn't in it, let alone once for each branch."""
    from slipmill.plans.queries import QUERIES

    assert "SHARMA" not in QUERIES["fixed_names"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
