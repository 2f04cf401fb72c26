"""WARC archives with a two-level capture index: sorted, compressed blocks of lines, and a sparse directory of blocks."""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipmill.llm.common import cut, membership_filter, passes, shared_dir, utf8

#: The smallest payload that is stored once; lines of a block; directory rows that one broadcast may hold.
LEAST, LINES, DIRECTORY_ROWS = 100, 512, 500_000
#: Index blocks, and so up to LINES times as many range reads, of a task.
BLOCKS_A_TASK = 128
DATE = "2024-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """The URL with its host reversed, as in `com,example,www)/path?query`; a null or hostless one as it is after `-)`."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        parts, host, port = None, "", None
    if not host:
        return "-)" + quote(url or "", safe="/:?&=%#@+,;~!$'()*[]")
    own = "" if port in (None, 80, 443) else f":{port}"
    tail = quote((parts.path or "/") + ("?" + parts.query if parts.query else ""), safe="/:?&=%@+,;~!$'()*")
    return ",".join(reversed(quote(host, safe="").split("."))) + own + ")" + tail


surt_udf = F.arrow_udf(lambda urls: pa.array([surt(u) for u in urls.to_pylist()], pa.string()), T.StringType())


def record(url: str | None, payload: bytes, digest: str, kind: str, refers: int | None, page_id: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="/:?&=%#@+,;~!$'()*[]"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The headers of a record, those of its HTTP block (names in lower case) and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = lambda raw: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])}
    headers = named(head)
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"warc": headers, "http": named(http), "payload": payload}


def kinds(pages: DataFrame, least: int) -> DataFrame:
    """pages with digest and refers_to (null for responses).

    Of equal payloads of at least `least` bytes the smallest page_id is the response. Repeated digests alone are
    looked up: a bounded filter lets the rest, most pages, by without a shuffle.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.withColumns({"digest": F.sha2(body.cast("binary"), 256), "_large": F.octet_length(body) >= least})
    owners = cut(pages.where("_large").groupBy("digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner", F.xxhash64("digest").alias("key")))
    bits = pages.sparkSession.sparkContext.broadcast(membership_filter(owners, "key", owners.count()))
    may = F.arrow_udf(lambda keys: pa.array(passes(bits.value, keys.to_numpy().view("uint64"))), T.BooleanType())
    pages = pages.withColumn("_may", F.col("_large") & may(F.xxhash64("digest")))
    joined = pages.where("_may").join(owners.drop("key"), "digest", "left")
    joined = joined.withColumn("refers_to", F.when(~F.col("owner").eqNullSafe(F.col("page_id")), F.col("owner"))).drop("owner")
    rest = pages.where("NOT _may").withColumn("refers_to", F.lit(None).cast("long"))
    return joined.unionByName(rest).drop("_may", "_large")


MANIFEST = "surt string, page_id long, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files in a folder, a compressed member for each record; returns where
    each record is. A task writes files of its own; only those of the attempt that counts are in the result.

    Null html is an empty payload; a null url has no target header. Equal page_ids with equal payloads are all
    responses, and a null page_id revisits the smallest id that there is.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, out, at = "", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(base, recursive=True)
                own = f"{uuid.uuid4().hex}.warc.gz"
                name, out = f"{folder}/{own}", store.open_output_stream(f"{base}/{own}", compression=None)
            rows, places = batch.to_pydict(), []
            for page_id, url, html, digest, refers in zip(rows["page_id"], rows["url"], rows["html"], rows["digest"], rows["refers_to"], strict=True):
                data = record(url, utf8(html), digest, "response" if refers is None else "revisit", refers, page_id)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(data) + packer.flush()
                out.write(data)
                places.append((surt(url), page_id, name, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*places, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["surt", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    rows = kinds(pages.select("page_id", "url", "html"), least).select("page_id", "url", "html", "digest", "refers_to")
    return cut(rows.mapInArrow(write, MANIFEST))


def order(page_id: int | None) -> int:
    return -(1 << 63) if page_id is None else page_id


DIRECTORY = "first_surt string, first_id long, file string, offset long, length long, lines long"


def write_index(manifest: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Writes the capture index: lines sorted by reversed-host key and page_id, in compressed blocks; returns the
    sparse directory, a row for each block with its first key."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, out, at, held, made = "", None, 0, [], []

        def block() -> None:
            nonlocal name, out, at
            if out is None:
                store.create_dir(base, recursive=True)
                own = f"{uuid.uuid4().hex}.cdx.gz"
                name, out = f"{folder}/{own}", store.open_output_stream(f"{base}/{own}", compression=None)
            data = "\n".join(json.dumps(x) for x in held).encode()
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = packer.compress(data) + packer.flush()
            out.write(data)
            made.append((held[0][0], order(held[0][1]), name, at, len(data), len(held)))
            at += len(data)
            held.clear()

        for batch in batches:
            rows = batch.to_pydict()
            for x in zip(*(rows[c] for c in ("surt", "page_id", "file", "offset", "length")), strict=True):
                held.append(x)
                if len(held) == lines:
                    block()
        if held:
            block()
        if out is not None:
            out.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["first_surt", "first_id", "file", "offset", "length", "lines"])

    low = F.coalesce("page_id", F.lit(-(1 << 63)))
    return cut(manifest.repartitionByRange("surt", low).sortWithinPartitions("surt", low).mapInArrow(write, DIRECTORY))


FOUND = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
])
FOUND_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


class Broken(ValueError):
    """An archive that doesn't say what its index or headers say."""


def _captured(data: bytes, page_id: int | None, with_payload: bool) -> tuple:
    r = parse(zlib.decompress(data, 31))
    kind, digest = r["warc"]["warc-type"], r["warc"]["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (hashlib.sha256(r["payload"]).hexdigest() != digest or len(r["payload"]) != int(r["http"]["content-length"])):
        raise Broken(f"the payload of page {page_id} isn't what its headers say")
    refers = int(r["warc"]["warc-refers-to"][10:-1]) if kind == "revisit" else None
    return page_id, r["warc"].get("warc-target-uri"), kind, refers, int(r["http"]["content-length"]), digest, r["payload"] if with_payload and kind == "response" else None


def look_up(wanted: DataFrame, directory: DataFrame, with_payload: bool = True, directory_rows: int = DIRECTORY_ROWS) -> DataFrame:
    """The captures of wanted (surt, and page_id or none for all captures of the key).

    Binary search in the directory gives the blocks that may hold a key; each is read by its range once a task, and
    so is each record. A directory of more rows than directory_rows is searched in bounded pieces, one pass each.
    Repeated rows of wanted count once; a key that isn't there gives no row.
    """
    spark = wanted.sparkSession
    by_id = "page_id" in wanted.columns
    wanted = wanted.select("surt", "page_id" if by_id else F.lit(None).cast("long").alias("page_id")).distinct()
    total = directory.count()
    if not total:
        return spark.createDataFrame([], FOUND)
    pieces = -(-total // directory_rows)
    # By the directory's size: keys are small, and merging them by size would leave all range reads to one task.
    tasks = min(total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCKS_A_TASK)))
    dealt = directory if pieces == 1 else cut(directory.repartitionByRange(pieces, "first_surt", "first_id").withColumn("piece", F.spark_partition_id()))
    out = None
    for k in range(pieces):
        rows = (dealt if pieces == 1 else dealt.where(F.col("piece") == k)).toArrow().to_pylist()
        rows.sort(key=lambda r: (r["first_surt"], r["first_id"]))
        held = spark.sparkContext.broadcast([tuple(r[c] for c in ("first_surt", "first_id", "file", "offset", "length")) for r in rows])
        found = _search(wanted, held, by_id, with_payload, tasks)
        out = found if out is None else out.unionByName(found)
    return out


def _search(wanted: DataFrame, held, by_id: bool, with_payload: bool, tasks: int) -> DataFrame:
    def blocks(surts: pa.Array, ids: pa.Array) -> pa.Array:
        firsts = [(s, i) for s, i, *_ in held.value]
        out = []
        for s, i in zip(surts.to_pylist(), ids.to_pylist(), strict=True):
            low, high = ((s, order(i)), (s, order(i))) if by_id else ((s, -(1 << 63)), (s, (1 << 63) - 1))
            # From the block before the first that begins at or after the key, to the last that begins at or before it.
            out.append(list(range(max(0, bisect.bisect_left(firsts, low) - 1), bisect.bisect_right(firsts, high))))
        return pa.array(out, pa.list_(pa.int32()))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, pa.NativeFile] = {}

        def ranged(name: str, offset: int, length: int) -> bytes:
            if name not in files:
                if len(files) >= 32:
                    files.pop(next(iter(files))).close()
                files[name] = open_file(name)
            return files[name].read_at(length, offset)

        current, lines = None, []
        for batch in batches:
            rows, got = batch.to_pydict(), []
            for k, s, i in zip(rows["block"], rows["surt"], rows["page_id"], strict=True):
                if k != current:
                    _, _, name, offset, length = held.value[k]
                    lines = [json.loads(x) for x in zlib.decompress(ranged(name, offset, length), 31).split(b"\n")]
                    keys, current = [(x[0], order(x[1])) for x in lines], k
                low = bisect.bisect_left(keys, (s, order(i) if by_id else -(1 << 63)))
                high = bisect.bisect_right(keys, (s, order(i) if by_id else (1 << 63) - 1))
                for _, page_id, name, offset, length in lines[low:high]:
                    got.append(_captured(ranged(name, offset, length), page_id, with_payload))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), FOUND_ARROW, strict=True)], schema=FOUND_ARROW)

    n = F.arrow_udf(blocks, T.ArrayType(T.IntegerType()))(F.col("surt"), F.col("page_id"))
    placed = wanted.withColumn("block", F.explode(n))
    return placed.repartition(tasks, "block").sortWithinPartitions("block", "surt", "page_id").mapInArrow(fetch, FOUND)


def open_file(name: str):
    """A file of an archive or index, at its path or URI, for reads by range."""
    store, path = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)
    return store.open_input_file(path)


def op9_capture_index(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    manifest = write_archives(pages, folder)
    directory = write_index(manifest, folder)
    found = look_up(pages.select(surt_udf("url").alias("surt"), "page_id"), directory, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha256(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, digest, min(page_id) OVER (PARTITION BY digest) AS owner FROM p)
SELECT page_id, payload_bytes, digest AS payload_digest,
       CASE WHEN payload_bytes >= 100 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND owner <> page_id THEN owner END AS refers_to
FROM q
"""
