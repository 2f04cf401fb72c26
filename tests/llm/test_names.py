"""Extra columns with the names that operators use inside: they come out as they went in."""

import pytest
from pyspark.sql import functions as F

from slipmill.llm import decontaminate, langid, mixing, neardup, sharding, substrings, tokens, transport

HOSTILE = ("n", "best", "all", "user", "spans", "_may", "may", "_a", "_b", "_doc", "_key", "_cut", "_c", "_p", "_shard", "_sub", "_mix_source", "_mix_size", "key", "doc", "x", "y", "root", "block", "_linked", "_single", "salts", "_salt", "a.b")
TEXT = "the quick brown fox jumps over the lazy dog and runs away from the old grey wolf"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT, "en", "s"), (2, TEXT, "en", "s"), (3, None, None, None), (4, "", "de", "t"), (None, "Wort für Wort", "de", "t"), (5, "one two three", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in HOSTILE})


def kept(df):
    return sorted((tuple(r) for r in df.select("doc_id", *[F.col(f"`{c}`") for c in HOSTILE]).collect()), key=str)


@pytest.mark.parametrize("name", ["dedup", "count_edited", "shard", "store", "mix", "scan", "scan_blocks", "identify"])
def test_columns_stay(spark, docs, name):
    bench = spark.createDataFrame([("b1", "entirely different words that stand nowhere else in here at all ever"), ("b2", "short one")], "item_id string, text string")
    made = {
        "dedup": lambda: substrings.dedup(docs), "count_edited": lambda: tokens.count_edited(docs), "shard": lambda: sharding.shard(docs, shards=2), "store": lambda: transport.read(transport.store(docs)),
        "mix": lambda: mixing.mix(docs), "scan": lambda: decontaminate.scan(docs, bench), "scan_blocks": lambda: decontaminate.scan(docs, bench, block_bytes=20), "identify": lambda: langid.identify(docs),
    }[name]()
    assert kept(made) == kept(docs)


def test_stages_keep_columns(spark, docs):
    bench = spark.createDataFrame([("b2", "one two three")], "item_id string, text string")
    clash = docs.withColumns({"copies": F.lit("mine"), "size": F.lit("own"), "rate": F.lit("r"), "target": F.lit("t"), "scan": F.lit("s"), "class_id": F.lit("c")})
    for f in (neardup.keep_one, mixing.emit, langid.keep_identified, lambda d: decontaminate.decontaminate(d, bench), lambda d: decontaminate.decontaminate(d, bench, remove="spans")):
        out = f(clash)
        assert out.columns == clash.columns
        rows = out.collect()
        assert rows and all((r["copies"], r["size"], r["scan"], r["class_id"]) == ("mine", "own", "s", "c") for r in rows)
        assert {r["a.b"] for r in rows} <= {r["a.b"] for r in clash.collect()}
