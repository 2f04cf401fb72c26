import random
import re
import zlib
from functools import cache
from hashlib import sha256
from itertools import product

import pytest
from pyspark.sql import functions as F

from slipmill.llm import repair

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def cheapest(rows):
    """(cost, audit, output) of rows (role, text, fault): a recursion over places and initials given out so far."""

    @cache
    def best(i, last, inserts):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        for role in ("user", "assistant"):
            if (role == "assistant") == (last == "u") and inserts < 3:
                c, a, o = best(i, role[0], inserts + 1)
                options.append((c + 3, "I" + a, ((role, ""), *o)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, o = best(i + 1, last, 0)
            options.append((c + 4, "D" + a, o))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for edit, to, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if to[:1] == "s" and last == "" or to[:1] == "u" and last in ("", "s", "a") or to[:1] == "a" and last == "u":
                        c, a, o = best(i + 1, to[:1], 0)
                        options.append((c + price + more, edit + a, ((to, text), *o)))
        return min(options, default=(10**9, "~", ()))

    for i in range(len(rows), -1, -1):  # from the end on, so that no call goes deep
        for last in ("", "s", "u", "a"):
            best(i, last, 0)
    return best(0, "", 0)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        t = text.rstrip(SPACE)
        out.append("blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Damage, then faults and repair, of (conv_id, turn, role, text) rows in the order in which they stand within a turn."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        found = faults(own)
        cost, audit, output = cheapest(tuple((r, t, f) for (_, r, t), f in zip(own, found, strict=True)))
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))  # noqa: B905
        text = "\n".join(f"{r}:{t}" for r, t in output)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def query(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("conv", "seg", "pos", "own", "h1", "copy", "code", "start")})
    out = repair.repaired(repair.damaged(df), df)
    return sorted(map(tuple, out.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "a. b", "Well.\n", None, "é…", "x. ", "Same."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}.") for c in range(400) for t in sorted(rng.sample(range(12), rng.randrange(1, 9)))]
    rows += [(None, t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(6)] + [(5000, None, "user", "q?"), (5000, 9, "assistant", "a."), (5001, None, "assistant", None)]
    rows += [(6000, i, "user" if i % 2 == 0 else "assistant", "L" * 200_000 + f"{i}.") for i in range(4)]
    rows += [(7000, 3, "user", "twice."), (7000, 3, "user", "twice."), (7001, -(2**63), "user", "far."), (7001, 2**63 - 1, "assistant", "near.")]
    want = [r if r[0] != 7001 else (*r[:1], min(r[1], 2**63 - 1), *r[2:]) for r in brute(rows)]
    assert query(spark, rows) == want


def test_long_conversation_spans_segments(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["cut", f"whole {t}.", f"w {t}!", f"v {t}?"])) for c in (1, 2) for t in range(1500)]
    assert query(spark, rows) == brute(rows)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, repair.op13_repair_conversations(spark, sf).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert query(spark, []) == []


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_all_edits_of_short_rows(length):
    """Every way to edit, checked by the pattern itself."""
    for symbols in product("suaoUAx", repeat=length):
        found = []
        choices = [[("D", "", 4)] + ([] if s == "x" else [(e, r, p + 3 * s.isupper()) for e, r, p in (("K", s.lower(), 0), ("R", "u", 3), ("R", "a", 3))]) for s in symbols]
        for inserts in product(["", "u", "a", "ua", "au"], repeat=length + 1):
            for picked in product(*choices):
                out = inserts[0] + "".join(r + n for (_, r, _), n in zip(picked, inserts[1:], strict=True))
                if re.fullmatch("(s?(ua)+)?", out):
                    audit = "I" * len(inserts[0]) + "".join(e + "I" * len(n) for (e, _, _), n in zip(picked, inserts[1:], strict=True))
                    found.append((sum(p for _, _, p in picked) + 3 * len("".join(inserts)), audit))
        audit, cost, _ = repair.traced("".join(symbols), repair.END, repair.NOTHING, True)
        assert (cost, audit) == min(found)


def test_tables_are_small_and_right():
    known, vectors, blocks = repair.tables()
    assert len(vectors) < 100 and len(blocks) == 9 + 81 + 729
    rng = random.Random(1)
    for _ in range(300):
        symbols = "".join(rng.choice(repair.SYMBOLS) for _ in range(rng.randrange(1, 30)))
        v = repair.END
        for s in reversed(symbols):
            v = repair.before(s, v)
        number, off = repair.starts_of_blocks(symbols, known[repair.normal(repair.END)[0]])[0]
        assert tuple(x + off for x in vectors[number]) == v
