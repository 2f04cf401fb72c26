import hashlib
import uuid

from slipmill.llm import warc
from slipmill.llm.common import shared_dir


def build(spark, rows, lines=3):
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(pages, folder)
    return pages, manifest, warc.write_index(manifest, folder, lines)


ROWS = [(i, f"http://h{i % 4}.example.com/p/{i}?q=é", f"<p>{'body ' * 30}{i % 6}</p>") for i in range(40)]
ROWS += [(100, None, None), (101, "", ""), (102, "http://h1.example.com/p/1?q=é", "small"), (103, "x", "small"), (None, "http://n/", ROWS[0][2]), (7, ROWS[7][1], ROWS[7][2]), (104, "http://big/", "z" * 3_000_000), (105, "HTTP://user@H.Com:8080/A\r\nB", "ü" * 60)]


def expected(rows):
    first = {}
    for i, _, h in rows:
        d = hashlib.sha256((h or "").encode()).hexdigest()
        if i is not None:
            first[d] = min(first.get(d, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        d = hashlib.sha256(data).hexdigest()
        refers = first[d] if len(data) >= 100 and d in first and first[d] != i else None
        out.append((i, len(data), d, "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_round_trip(spark):
    for pieces in (500_000, 2):
        pages, _, directory = build(spark, ROWS)
        assert directory.count() >= len(ROWS) // 3
        found = warc.look_up(pages.select(warc.surt_udf("url").alias("surt"), "page_id"), directory, directory_rows=pieces).collect()
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str) == expected(ROWS)
        html = {r[0]: r[2] for r in ROWS}
        assert all(bytes(r["payload"]).decode() == (html[r["page_id"]] or "") for r in found if r["record_type"] == "response")


def test_look_up_by_key(spark):
    _, _, directory = build(spark, ROWS + [(200 + i, "http://h1.example.com/p/1?q=é", f"again {i}") for i in range(20)])
    keys = spark.createDataFrame([(warc.surt("http://h1.example.com/p/1?q=é"),), (warc.surt("http://h1.example.com/nothing"),), (warc.surt("http://h1.example.com/p/1?q=é"),)], "surt string")
    assert sorted(r["page_id"] for r in warc.look_up(keys, directory).collect()) == [1, 102, *range(200, 220)]


def test_empty(spark):
    pages, manifest, directory = build(spark, [])
    assert manifest.count() == 0 and directory.count() == 0
    assert warc.look_up(pages.select(warc.surt_udf("url").alias("surt"), "page_id"), directory).count() == 0


def test_surt():
    assert warc.surt("http://www.Example.com/a/b?x=1") == "com,example,www)/a/b?x=1"
    assert warc.surt("https://example.com:8443") == "com,example:8443)/" and warc.surt("http://e.org:80/") == "org,e)/"
    assert warc.surt(None) == "-)" and warc.surt("http://[bad/") .startswith("-)")
