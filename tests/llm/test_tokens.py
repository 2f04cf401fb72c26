"""Against counting the edited text from scratch."""

import random
import re

import pytest

from slipmill.llm import tokens


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.VOCABULARY)


def apply(text, edits):
    for a, b, new in sorted(edits, reverse=True):
        text = text[:a] + new + text[b:]
    return text


def test_random_edits(counter):
    rng = random.Random(4)
    bits = [" ", "  ", "\n", " \n ", "'s", "'", "ll", "a", "Zürich", "word", "123", "4", "!!", ".", "'ve", "’", "\t", "x" * 70, "日本"]
    for k in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.choice((0, 1, 5, 60, 300))))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randrange(6))))
        edits = [(a, b, "".join(rng.choice(bits) for _ in range(rng.randrange(4)))) for a, b in zip(cuts[::2], cuts[1::2])]
        tree = tokens.PretokenTree(text, counter)
        assert tree.total == len(counter.encode(text))
        for e in reversed(edits):
            tree.edit(*e)
        new = apply(text, edits)
        assert "".join(tree.leaves) == new, k
        assert (tree.total, tree.length) == (len(counter.encode(new)), len(new)), (k, text, edits)
        joined = tokens.PretokenTree(text, counter)
        for e in reversed(tokens.regions(text, edits)):
            joined.edit(*e)
        assert "".join(joined.leaves) == new and joined.total == tree.total


def test_ascii_pattern(counter):
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(map(chr, rng.choices(range(128), k=200))) + "".join(rng.choices(" \n\t\x1c'sdlv9a.", k=100))
        assert counter._ascii(text) == counter._any(text)


def test_only_the_region(counter):
    text = "the quick brown fox " * 2000
    tree = tokens.PretokenTree(text, counter)
    tree.edit(20000, 20003, "SLOW")
    assert tree.total == len(counter.encode(text[:20000] + "SLOW" + text[20003:])) and tree.encoded < 60


def test_query(spark, sf, counter):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pattern = re.compile(tokens.EDIT_PATTERN)
    got = tokens.op3_token_counts(spark, sf).collect()
    assert len(got) == len(docs) and sum(r["n_edits"] for r in got) > 20
    for r in got:
        new = apply(docs[r["doc_id"]], tokens.edits_of(docs[r["doc_id"]], pattern))
        assert (r["n_tokens"], r["n_tokens_after"], r["n_chars_after"]) == (len(counter.encode(docs[r["doc_id"]])), len(counter.encode(new)), len(new))


def test_edge_cases(spark, counter):
    rows = [(1, None, None), (2, "", [(0, 0, "new words")]), (3, "mail a@b.org now", None), (3, "mail a@b.org now", None), (4, "1234567!!!! x" * 20000, [(5, 9, "")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>")
    got = sorted(tuple(r) for r in tokens.count_edited(df).select("doc_id", "n_tokens", "n_edits", "n_tokens_after").collect())
    assert got[0] == (1, 0, 0, 0) and got[1] == (2, 0, 1, len(counter.encode("new words"))) and got[2] == got[3]
    assert got[4][3] == len(counter.encode(apply(rows[4][1], [(5, 9, "")])))
    plain = tokens.count_edited(df.drop("edits").withColumn("n_tokens", df.doc_id)).where("doc_id = 3").first()
    assert plain["n_edits"] == 1 and plain["n_tokens_after"] == len(counter.encode("mail <email> now"))
    assert tokens.count_edited(df.limit(0)).count() == 0
