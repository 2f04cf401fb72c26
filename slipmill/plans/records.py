"""Queries of records, logs, models and reports, over vouchers as the tables say them, and the SQL for each."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipmill.functions import text, values
from slipmill.operators import attempts, context, continuous, evaluate, extract, history, learn, profiles, publish, ranking, records, validate
from slipmill.plans import vouchers as vo
from slipmill.plans.queries import ALL_DEDUCTIONS, BOXES_SQL, DIFFS_SQL, HEADS, ITEMS, NET, PAIRS_SQL, boxes, examples, pairs, predictions, query
from slipmill.sources import tables
from slipmill.sources.folders import written
from slipmill.sources.snapshots import Snapshots
from slipmill.streaming import streams

KINDS = (("Commission", "commission"), ("Damage", "damages"), ("Unloading", "unloading"), ("L/F Cash", "cash"))
BOOKED_SQL = f"""SELECT voucher_id, 'B' || (voucher_id % 40)::VARCHAR AS batch_id, voucher_number, voucher_date, supplier_name, 'SHARMA' AS vendor_details,
 gross_total, {ALL_DEDUCTIONS} AS total_deductions, {NET} AS net_total, commission, damages, unloading, cash, n_items FROM ({HEADS})"""
ITEM_ROWS_SQL = f"""SELECT voucher_id, CAST(row_number() OVER (PARTITION BY voucher_id ORDER BY line, part, supp, quantity, unit_price, line_amount) - 1 AS INT) AS position,
 'Item ' || part::VARCHAR AS item_name, CAST(quantity AS DECIMAL(10,2)) AS quantity, CAST(unit_price AS DECIMAL(10,2)) AS unit_price, line_amount FROM ({ITEMS})"""
DEDUCTION_ROWS_SQL = " UNION ALL ".join(f"SELECT voucher_id, CAST({i} AS INT) AS position, '{kind}' AS deduction_type, {c} AS amount FROM ({HEADS})" for i, (kind, c) in enumerate(KINDS))
MASTER = ("voucher_id", "batch_id", "voucher_number", "voucher_date", "supplier_name", "vendor_details", "gross_total", "total_deductions", "net_total")
ITEM_TYPE = "array<struct<item_name:string,quantity:decimal(10,2),unit_price:decimal(10,2),line_amount:decimal(12,2)>>"


def booked(spark, sf_dir) -> DataFrame:
    """Vouchers as they would be parsed, from the tables: header, items, deductions."""
    t, k = vo.truth(spark, sf_dir), F.col("voucher_id")
    less = sum((F.col(c) for _, c in KINDS[1:]), F.col("commission"))
    item = lambda x: F.struct(F.concat(F.lit("Item "), x["part"].cast("string")).alias("item_name"), x["quantity"].alias("quantity"), x["unit_price"].alias("unit_price"), x["line_amount"].alias("line_amount"))
    return t.select(
        "voucher_id", F.concat(F.lit("B"), (k % 40).cast("string")).alias("batch_id"), F.timestamp_seconds(1_700_000_000 + k * 60).cast("timestamp_ntz").alias("created_at"), "voucher_number", "voucher_date", "supplier_name",
        F.lit("SHARMA").alias("vendor_details"), "gross_total", less.cast("decimal(12,2)").alias("total_deductions"), (F.col("gross_total") - less).cast("decimal(12,2)").alias("net_total"),
        F.transform("items", item).cast(ITEM_TYPE).alias("items"), F.array(*[F.struct(F.lit(kind).alias("deduction_type"), F.col(c).alias("amount")) for kind, c in KINDS]).alias("deductions"),
    )


def stale(df: DataFrame) -> DataFrame:
    """The same vouchers as an earlier run had them: no net total, one item, no deduction."""
    return df.withColumns({"net_total": F.lit(None).cast("decimal(12,2)"), "items": F.slice("items", 1, 1), "deductions": F.slice("deductions", 1, 0)})


# --- records ---------------------------------------------------------------------------------------------------


@query(f"SELECT b.voucher_id, net_total, i.n AS n_items, total, CAST(4 AS BIGINT) AS n_deductions FROM ({BOOKED_SQL}) b JOIN (SELECT voucher_id, count(*) AS n, CAST(sum(line_amount) AS DECIMAL(12,2)) AS total FROM ({ITEM_ROWS_SQL}) GROUP BY 1) i USING (voucher_id)")
def written_vouchers(spark, sf_dir):
    """Three tables, written together and read back."""
    t = stored(spark, booked(spark, sf_dir)).read()
    items = t["items"].groupBy("voucher_id").agg(F.count("*").alias("n_items"), F.sum("line_amount").cast("decimal(12,2)").alias("total"))
    less = t["deductions"].groupBy("voucher_id").agg(F.count("*").alias("n_deductions"))
    return t["master"].select("voucher_id", "net_total").join(items, "voucher_id").join(less, "voucher_id")


def stored(spark, vouchers: DataFrame) -> Snapshots:
    """A store of its own that has the vouchers."""
    store = Snapshots(spark, streams.work_folder(spark, "vouchers"))
    records.write_vouchers(vouchers, store)
    return store


@query(f"SELECT voucher_id, CAST(NULL AS DECIMAL(12,2)) AS net_total, CAST(1 AS BIGINT) AS n_items, CAST(0 AS BIGINT) AS n_deductions, CAST(1 AS BIGINT) AS versions FROM ({HEADS})")
def unbroken_vouchers(spark, sf_dir):
    """A commit whose third table fails while it is written: all three are as before."""
    b = booked(spark, sf_dir)
    store = stored(spark, stale(b))
    broken = b.select("voucher_id", F.raise_error(F.lit("the third write fails")).cast("string").alias("deduction_type"))
    try:
        store.commit(records.voucher_tables(b) | {"deductions": broken})
    except Exception as e:
        if "the third write fails" not in str(e):
            raise
    t = store.read()
    items = t["items"].groupBy("voucher_id").agg(F.count("*").alias("n_items"))
    less = t["deductions"].groupBy("voucher_id").agg(F.count("*").alias("n_deductions"))
    out = t["master"].select("voucher_id", "net_total").join(items, "voucher_id").join(less, "voucher_id", "left")
    return out.withColumns({"n_deductions": F.coalesce("n_deductions", F.lit(0)).cast("long"), "versions": F.lit(len(store.versions())).cast("long")})


REPLACED_SQL = f"SELECT voucher_id, position, item_name, quantity, unit_price, line_amount FROM ({ITEM_ROWS_SQL}) WHERE voucher_id % 3 = 1 OR position = 0"


@query(REPLACED_SQL)
def replaced_items(spark, sf_dir):
    """Vouchers of each third number extracted anew, twice: their items are there once, the others' as before."""
    return thrice_replaced(spark, sf_dir).read()["items"]


def thrice_replaced(spark, sf_dir) -> Snapshots:
    """A store with stale vouchers, and on top of them, twice, each third of them as it should be."""
    b = booked(spark, sf_dir)
    store = stored(spark, stale(b))
    for _ in range(2):
        records.write_vouchers(b.where("voucher_id % 3 = 1"), store)
    return store


@query(DEDUCTION_ROWS_SQL.replace(f"FROM ({HEADS})", f"FROM ({HEADS}) WHERE voucher_id % 3 = 1"))
def replaced_deductions(spark, sf_dir):
    """As replaced_items, after the layers were made one and the old ones removed."""
    store = thrice_replaced(spark, sf_dir)
    store.compact()
    store.expire(1)
    return store.read()["deductions"]


@query(DEDUCTION_ROWS_SQL.replace(f"FROM ({HEADS})", f"FROM ({HEADS}) WHERE voucher_id % 3 = 1"))
def joined_replacement(spark, sf_dir):
    """The same replacement of tables that are in no store, by joins."""
    b = booked(spark, sf_dir)
    return records.replace_parse(records.voucher_tables(stale(b)), b.where("voucher_id % 3 = 1"))["deductions"]


@query(f"SELECT voucher_id, CASE WHEN batch_id = 'B7' THEN net_total END AS net_total, CASE WHEN batch_id = 'B7' THEN n_items ELSE 1 END AS n_items FROM ({BOOKED_SQL})")
def reprocessed_batch(spark, sf_dir):
    """One batch extracted again from its texts, in place."""
    old = records.voucher_tables(stale(booked(spark, sf_dir)).select("voucher_id", "batch_id", "net_total", "items", "deductions"))
    made = records.reprocess(old, vo.rendered(spark, sf_dir), "B7", extract.extract_v2)
    return made["master"].select("voucher_id", "net_total").join(made["items"].groupBy("voucher_id").agg(F.count("*").alias("n_items")), "voucher_id")


# --- learned values --------------------------------------------------------------------------------------------


def misread_items(spark, sf_dir) -> DataFrame:
    """Vouchers whose item names have a wrong first letter, and whose quantities are 100 too large."""
    wrong = F.transform("items", lambda i: F.struct(F.replace(i["item_name"], F.lit("Item"), F.lit("ltem")).alias("item_name"), (i["quantity"] + 100).cast("decimal(10,2)").alias("quantity"), i["unit_price"].alias("unit_price"), i["line_amount"].alias("line_amount")))
    return booked(spark, sf_dir).withColumn("wrong", wrong)


TAUGHT = f"(SELECT * FROM ({ITEM_ROWS_SQL}) WHERE voucher_id % 3 = 1)"


@query(f"""SELECT voucher_id, position, CASE WHEN item_name IN (SELECT item_name FROM {TAUGHT}) THEN item_name ELSE replace(item_name, 'Item', 'ltem') END AS item_name,
 CASE WHEN quantity IN (SELECT quantity FROM {TAUGHT}) THEN quantity ELSE quantity + 100 END AS quantity, line_amount FROM ({ITEM_ROWS_SQL})""")
def learned_items(spark, sf_dir):
    """Items with the names and quantities that a third of the vouchers, corrected, teaches; names that it lacks stay misread."""
    v = misread_items(spark, sf_dir)
    taught = v.where("voucher_id % 3 = 1").select("voucher_id", F.struct(F.col("wrong").alias("items")).alias("original"), F.struct("items").alias("corrected"))
    values = learn.value_model(learn.item_diffs(taught).withColumn("field", F.concat(F.lit("item_"), "field")))
    out = context.learned_items(v.select("voucher_id", F.col("wrong").alias("items")), values)
    return out.select("voucher_id", F.posexplode("items").alias("position", "i")).select("voucher_id", "position", "i.item_name", "i.quantity", "i.line_amount")


def deduction_anchors(spark, sf_dir, misread: bool = False) -> DataFrame:
    """Anchors of each type of deduction, from the lines of deductions alone."""
    text_ = F.array_join(F.filter(F.split("raw_ocr_text", "\n"), lambda x: x.startswith("(-)")), "\n")
    if misread:
        text_ = F.replace(text_, F.lit("(-) Comm"), F.lit("(-) C0nn"))
    t = vo.truth(spark, sf_dir).select("voucher_id", "supplier_name", *[F.col(c).alias(f"deduction_{kind}") for kind, c in KINDS])
    return learn.anchors(vo.rendered(spark, sf_dir).select("voucher_id", text_.alias("raw_ocr_text")).join(t, "voucher_id"), tuple(f"deduction_{kind}" for kind, _ in KINDS))


@query(f"SELECT voucher_id, CASE WHEN voucher_id % 4 = 1 THEN 'Damage,Unloading,L/F Cash,Commission' WHEN voucher_id % 4 = 2 THEN 'Commission,Damage,Unloading,L/F Cash' ELSE 'Commission,Damage,L/F Cash,Unloading' END AS kinds, {ALL_DEDUCTIONS} AS total FROM ({HEADS})")
def learned_deductions(spark, sf_dir):
    """Deductions of which the machine missed the first, misread all, or found none: anchors of their types find them again."""
    k, b = F.col("voucher_id"), booked(spark, sf_dir)
    off = F.transform("deductions", lambda d: F.struct(d["deduction_type"].alias("deduction_type"), (d["amount"] + 1).cast("decimal(12,2)").alias("amount")))
    machine = F.when(k % 4 == 1, F.slice("deductions", 2, 3)).when(k % 4 == 2, off).otherwise(F.slice("deductions", 1, 0))
    v = b.select("voucher_id", "supplier_name", machine.alias("deductions")).join(vo.rendered(spark, sf_dir).select("voucher_id", "raw_ocr_text"), "voucher_id")
    none = spark.createDataFrame([], "field string, auto string, corrected string, n long, first_seen long")
    out = context.apply_learned(v, none, deduction_anchors(spark, sf_dir), fields=())
    return out.select("voucher_id", F.array_join(F.transform("deductions", lambda d: d["deduction_type"]), ",").alias("kinds"), records.total(F.col("deductions"), "amount").alias("total"))


@query(f"""SELECT voucher_id, CASE WHEN batch_id = 'B7' THEN commission END AS commission, CASE WHEN batch_id = 'B7' THEN n_items ELSE 1 END AS n_items, vendor_details FROM ({BOOKED_SQL})""")
def reprocessed_learned(spark, sf_dir):
    """One batch extracted again, with what was learned: its commissions stand beside a misread label, and an anchor of that label finds them."""
    marks = deduction_anchors(spark, sf_dir, misread=True)
    none = spark.createDataFrame([], "field string, auto string, corrected string, n long, first_seen long")
    store = stored(spark, stale(booked(spark, sf_dir)).select("voucher_id", "batch_id", "vendor_details", "net_total", "items", "deductions"))
    texts = vo.rendered(spark, sf_dir).withColumn("raw_ocr_text", F.replace("raw_ocr_text", F.lit("(-) Comm"), F.lit("(-) C0nn")))
    records.reprocess_in_store(store, texts, "B7", lambda t: context.apply_learned(extract.extract_v2(t).drop("vendor_details"), none, marks, fields=()))
    t = store.read()
    found = t["deductions"].where("deduction_type = 'Commission'").select("voucher_id", F.col("amount").alias("commission"))
    return t["master"].select("voucher_id", "vendor_details").join(found, "voucher_id", "left").join(t["items"].groupBy("voucher_id").agg(F.count("*").alias("n_items")), "voucher_id")


def reviewed(spark, sf_dir) -> DataFrame:
    """Vouchers with status, the parsed header and, for most of them, the first machine output."""
    k = F.col("voucher_id")
    head = F.struct("voucher_number", "supplier_name", "net_total")
    b = booked(spark, sf_dir)
    return b.select("voucher_id", "batch_id", "created_at", F.when(k % 3 == 0, "PENDING").otherwise("VALIDATED").alias("status"), head.alias("parsed"), F.when(k % 5 != 0, head).alias("original"))


@query(f"SELECT voucher_id, voucher_number FROM ({BOOKED_SQL}) WHERE voucher_id % 3 <> 0 AND voucher_id % 5 <> 0 ORDER BY voucher_id DESC LIMIT 500")
def validated_vouchers(spark, sf_dir):
    """The newest 500 vouchers to learn from, the feature's limit."""
    return records.validated_vouchers(reviewed(spark, sf_dir), 500).select("voucher_id", "original.voucher_number")


@query(f"SELECT voucher_id, supplier_name FROM ({BOOKED_SQL})")
def backfilled_original(spark, sf_dir):
    return records.backfill_original(reviewed(spark, sf_dir)).select("voucher_id", "original.supplier_name")


@query(f"SELECT voucher_id, CASE WHEN voucher_id % 4 = 1 THEN 'EDITED' ELSE voucher_number END AS voucher_number, CASE WHEN voucher_id % 5 <> 0 OR voucher_id % 4 = 1 THEN voucher_number END AS first_number FROM ({BOOKED_SQL})")
def saved_edits(spark, sf_dir):
    """Edited values in place; the first machine output stays beside them."""
    r = reviewed(spark, sf_dir)
    edits = r.where("voucher_id % 4 = 1").select("voucher_id", F.struct(F.lit("EDITED").alias("voucher_number"), "parsed.supplier_name", "parsed.net_total").alias("parsed"))
    return publish.save_validated(r, edits).select("voucher_id", "parsed.voucher_number", F.col("original.voucher_number").alias("first_number"))


@query(f"SELECT * FROM ({BOOKED_SQL}) JOIN (SELECT voucher_id, string_agg(item_name, '|' ORDER BY position) AS names FROM ({ITEM_ROWS_SQL}) GROUP BY 1) USING (voucher_id) WHERE voucher_id = (SELECT min(l_orderkey) FROM lineitem)".replace("SELECT * FROM", "SELECT voucher_id, voucher_number, net_total, names, CAST(4 AS BIGINT) AS n_deductions FROM"))
def one_voucher(spark, sf_dir):
    """The voucher of the least number, looked up with its children."""
    least = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.min("l_orderkey")).first()[0]
    v = records.voucher_by_id(records.voucher_tables(booked(spark, sf_dir)), least)
    return v.select("voucher_id", "voucher_number", "net_total", F.array_join(F.transform("items", lambda i: i["item_name"]), "|").alias("names"), F.size("deductions").cast("long").alias("n_deductions"))


EDITED_SQL = f"SELECT voucher_id, CASE WHEN position % 3 = 1 THEN '  ' ELSE item_name END AS name, CASE WHEN position % 2 = 1 THEN 0 ELSE line_amount END AS amount FROM ({ITEM_ROWS_SQL})"


@query(f"""SELECT voucher_id, n AS n_items, gross AS gross_total, less AS total_deductions, CAST(gross - less AS DECIMAL(12,2)) AS net_total, CAST(3 AS BIGINT) AS n_deductions
FROM (SELECT voucher_id, count(*) AS n, CAST(sum(amount) AS DECIMAL(12,2)) AS gross FROM ({EDITED_SQL}) WHERE trim(name) <> '' OR amount > 0 GROUP BY 1)
JOIN (SELECT voucher_id, CAST(damages + cash AS DECIMAL(12,2)) AS less FROM ({HEADS})) USING (voucher_id)""")
def validated_totals(spark, sf_dir):
    """Totals of edited lists without their empty rows; a deduction without type or amount goes too."""
    edited = F.transform("items", lambda x, i: F.struct(F.when(i % 3 == 1, F.lit("  ")).otherwise(x["item_name"]).alias("item_name"), F.when(i % 2 == 1, 0).otherwise(x["line_amount"]).cast("decimal(12,2)").alias("line_amount")))
    less = F.transform("deductions", lambda x, i: F.struct(F.when(i == 0, "").otherwise(x["deduction_type"]).alias("deduction_type"), F.when(i % 2 == 0, 0).otherwise(x["amount"]).cast("decimal(12,2)").alias("amount")))
    v = booked(spark, sf_dir).select("voucher_id", records.nonempty(edited, "item_name", "line_amount").alias("items"), records.nonempty(less, "deduction_type", "amount").alias("deductions"))
    return v.select("voucher_id", F.size("items").cast("long").alias("n_items"), F.size("deductions").cast("long").alias("n_deductions"), *[c.alias(n) for n, c in records.validated_totals(F.col("items"), F.col("deductions")).items()])


@query(f"SELECT voucher_id, count(*) AS n, CAST(sum(amount) AS DECIMAL(12,2)) AS total FROM (SELECT voucher_id, CASE WHEN position <= 1 THEN ' ' ELSE deduction_type END AS kind, CASE WHEN position % 2 = 0 THEN 0 ELSE amount END AS amount FROM ({DEDUCTION_ROWS_SQL})) WHERE trim(kind) <> '' OR amount <> 0 GROUP BY voucher_id")
def kept_deductions(spark, sf_dir):
    less = F.transform("deductions", lambda x, i: F.struct(F.when(i <= 1, " ").otherwise(x["deduction_type"]).alias("deduction_type"), F.when(i % 2 == 0, 0).otherwise(x["amount"]).cast("decimal(12,2)").alias("amount")))
    v = booked(spark, sf_dir).select("voucher_id", records.kept_deductions(less).alias("d"))
    return v.select("voucher_id", F.size("d").cast("long").alias("n"), records.total(F.col("d"), "amount").alias("total"))


@query(f"SELECT voucher_id, position, item_name, unit_price FROM (SELECT voucher_id, position, CASE WHEN position % 2 = 0 THEN item_name WHEN position % 4 = 1 THEN 'D' || item_name END AS item_name, unit_price, CASE WHEN position % 4 = 3 THEN 0 ELSE line_amount END AS amount FROM ({ITEM_ROWS_SQL})) WHERE item_name IS NOT NULL OR amount <> 0")
def kept_items(spark, sf_dir):
    """Edited items under either name for name and price; those with neither name nor amount go."""
    item = lambda x, i: F.struct(
        F.when(i % 2 == 0, x["item_name"]).otherwise("").alias("item_name"), F.when(i % 4 == 1, F.concat(F.lit("D"), x["item_name"])).alias("item_description"), x["quantity"].alias("quantity"),
        F.when(i % 2 == 0, x["unit_price"]).alias("unit_price"), x["unit_price"].alias("rate"), F.when(i % 4 == 3, 0).otherwise(x["line_amount"]).cast("decimal(12,2)").alias("line_amount"), i.alias("position"),
    )
    v = booked(spark, sf_dir).select("voucher_id", F.transform("items", item).alias("items"))
    # Positions aren't kept by the operator, so that each item is filtered as a list of its own.
    rows = v.select("voucher_id", F.posexplode("items").alias("position", "i")).select("voucher_id", "position", publish.kept_items(F.array("i")).alias("k"))
    return rows.select("voucher_id", "position", F.inline("k")).select("voucher_id", "position", "item_name", "unit_price")


@query(f"""SELECT voucher_id, CASE WHEN voucher_id % 2 = 0 THEN 'P' || voucher_number ELSE voucher_number END AS voucher_number,
CASE WHEN voucher_id % 3 = 0 THEN 1 ELSE n_items END AS n_items, CASE WHEN voucher_id % 5 = 0 THEN 1 ELSE 4 END::BIGINT AS n_deductions FROM ({BOOKED_SQL})""")
def shown_vouchers(spark, sf_dir):
    """What a page shows where the parsed JSON lacks the header, items or deductions of some vouchers."""
    k, b = F.col("voucher_id"), booked(spark, sf_dir)
    head = F.when(k % 2 == 0, F.struct(F.concat(F.lit("P"), "voucher_number").alias("voucher_number"), *[F.col(c) for c in records.HEADER[1:]]))
    v = b.withColumn("parsed", F.struct(head.alias("master"), F.when(k % 3 == 0, F.slice("items", 1, 1)).otherwise(F.slice("items", 1, 0)).alias("items"), F.when(k % 5 == 0, F.slice("deductions", 1, 1)).alias("deductions")))
    s = records.shown(v.withColumnsRenamed({"items": "stored_items", "deductions": "stored_deductions"}))
    return s.select("voucher_id", "voucher_number", F.size("items").cast("long").alias("n_items"), F.size("deductions").cast("long").alias("n_deductions"))


@query(f"SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM ({HEADS})")
def voucher_pages(spark, sf_dir):
    return records.page_count(booked(spark, sf_dir), 20)


@query(f"SELECT batch_id, count(*) AS total FROM ({BOOKED_SQL}) GROUP BY batch_id ORDER BY min(voucher_id) DESC, batch_id DESC LIMIT 10 OFFSET 10")
def batch_page(spark, sf_dir):
    """The second page of the batches, by when they began."""
    b = booked(spark, sf_dir).groupBy("batch_id").agg(F.min("created_at").alias("created_at"), F.count("*").alias("total"))
    return ranking.page(b, 2, 10, F.col("created_at").desc(), F.col("batch_id").desc()).select("batch_id", "total")


@query(f"SELECT supplier_name, count(*) AS n FROM ({BOOKED_SQL}) WHERE batch_id = 'B3' GROUP BY 1")
def batch_suppliers(spark, sf_dir):
    return records.suppliers_in_batch(booked(spark, sf_dir), "B3")


@query(f"SELECT ocr_voucher_id, receipt_date, net_total FROM (SELECT voucher_id AS ocr_voucher_id, CASE WHEN voucher_id % 4 <> 0 THEN voucher_date END AS receipt_date, net_total, supplier_name FROM ({BOOKED_SQL})) WHERE supplier_name = 'RAVIB/K' ORDER BY receipt_date DESC NULLS LAST, ocr_voucher_id DESC")
def supplier_history(spark, sf_dir):
    r = booked(spark, sf_dir).select(F.col("voucher_id").alias("ocr_voucher_id"), F.when(F.col("voucher_id") % 4 != 0, F.col("voucher_date")).alias("receipt_date"), "created_at", "net_total", "supplier_name")
    return records.supplier_history(r, "RAVIB/K").select("ocr_voucher_id", "receipt_date", "net_total")


@query(f"SELECT name AS supplier_name, count(v.voucher_id) AS n_receipts, CAST(coalesce(sum(net_total), 0) AS DECIMAL(18,2)) AS total_spend FROM (SELECT 'RAVI' || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || '/K' AS name FROM supplier) s LEFT JOIN (SELECT * FROM ({BOOKED_SQL}) WHERE voucher_id % 9 = 0) v ON v.supplier_name = s.name GROUP BY 1".replace("SELECT * FROM (SELECT voucher_id,", "SELECT voucher_id, supplier_name, net_total FROM (SELECT voucher_id,"))
def all_suppliers(spark, sf_dir):
    """Spend of every supplier, also of those without any receipt (only vouchers of each ninth number count here)."""
    from slipmill.plans.queries import dictionary

    return records.all_suppliers(dictionary(spark, sf_dir).select(F.col("known").alias("supplier_name")), booked(spark, sf_dir).where("voucher_id % 9 = 0"))


@query(f"SELECT voucher_id, net_total, CASE WHEN voucher_id % 3 = 0 THEN 'f' || voucher_id::VARCHAR END AS file_path FROM ({BOOKED_SQL}) WHERE batch_id = 'B5'")
def tracked_files(spark, sf_dir):
    b = booked(spark, sf_dir)
    files = b.where("voucher_id % 3 = 0").select("voucher_id", F.lit("text").alias("ocr_output"), F.concat(F.lit("f"), F.col("voucher_id").cast("string")).alias("file_path"))
    return records.with_files(b, files, "B5").select("voucher_id", "net_total", "file_path")


@query(f"SELECT voucher_id, CAST(7 - CASE WHEN voucher_id % 2 = 0 THEN 1 ELSE 0 END - CASE WHEN voucher_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n FROM ({HEADS})")
def found_fields(spark, sf_dir):
    k = F.col("voucher_id")
    return booked(spark, sf_dir).withColumns({"voucher_number": F.when(k % 2 != 0, F.col("voucher_number")), "voucher_date": F.when(k % 3 != 0, F.col("voucher_date"))}).select("voucher_id", records.n_found().alias("n"))


@query(f"SELECT voucher_id, 'UPLOAD FAILED' AS supplier_name, 'not a number: x' || voucher_id::VARCHAR AS vendor_details, CAST(0 AS DECIMAL(12,2)) AS net_total FROM ({HEADS}) WHERE voucher_id % 50 = 1")
def dead_letters(spark, sf_dir):
    """Rows whose amount can't be read become placeholders with the reason."""
    rows = booked(spark, sf_dir).select("voucher_id", F.when(F.col("voucher_id") % 50 == 1, F.concat(F.lit("x"), F.col("voucher_id").cast("string"))).otherwise(F.col("net_total").cast("string")).alias("shown"))
    bad = rows.where(F.col("shown").try_cast("decimal(12,2)").isNull()).withColumn("error", F.concat(F.lit("not a number: "), "shown"))
    return publish.dead_letters(bad, "error")


# --- files and logs --------------------------------------------------------------------------------------------


def scanned(spark, sf_dir) -> DataFrame:
    """The manifest of a folder with a file for each supplier, its name's group inside."""
    folder = streams.work_folder(spark, "files")
    shown = F.concat(F.lit("group "), (F.col("s_suppkey") % 7).cast("string"))
    spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", shown.alias("value")).repartition(4, "s_suppkey").write.partitionBy("s_suppkey").text(folder)
    return tables.file_manifest(spark, folder, "B1", "*.txt").withColumn("s_suppkey", F.regexp_extract("file_path", r"s_suppkey=(\d+)", 1).cast("long"))


@query("SELECT s_suppkey, CAST(length('group ' || (s_suppkey % 7)::VARCHAR) + 1 AS BIGINT) AS file_size_bytes, md5('group ' || (s_suppkey % 7)::VARCHAR || chr(10)) AS file_hash, 'B1' AS upload_batch_id, 'pending' AS processing_status FROM supplier")
def file_manifest(spark, sf_dir):
    return scanned(spark, sf_dir).select("s_suppkey", "file_size_bytes", "file_hash", "upload_batch_id", "processing_status")


@query("SELECT s_suppkey % 7 AS grp, count(*) - 1 AS n_copies FROM supplier GROUP BY 1 HAVING count(*) > 1")
def duplicate_files(spark, sf_dir):
    m = scanned(spark, sf_dir)
    return tables.duplicate_files(m).join(m.select("file_path", (F.col("s_suppkey") % 7).alias("grp")), "file_path").groupBy("grp").agg(F.count("*").alias("n_copies"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'processed' ELSE 'pending' END AS processing_status, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 10 END AS voucher_id FROM supplier")
def processed_files(spark, sf_dir):
    m = scanned(spark, sf_dir)
    made = m.where("s_suppkey % 2 = 0").select("file_path", (F.col("s_suppkey") * 10).alias("voucher_id"))
    return tables.mark_processed(m, made).select("s_suppkey", "processing_status", "voucher_id")


def logged(spark, sf_dir) -> DataFrame:
    """Correction records of all vouchers; those of each second number without a correction."""
    k = F.col("voucher_id")
    change = F.struct(F.lit("old").alias("original"), F.col("voucher_number").alias("corrected"))
    return booked(spark, sf_dir).select(
        F.concat(F.lit("r"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "batch").otherwise("regular").alias("source"), "voucher_id", F.col("created_at").alias("timestamp"),
        F.when(k % 2 == 0, F.create_map(F.lit("voucher_number"), change)).otherwise(F.create_map().cast("map<string,struct<original:string,corrected:string>>")).alias("corrections"),
    )


def read_log(spark, sf_dir, limit: int | None = None) -> DataFrame:
    folder = streams.work_folder(spark, "feedback")
    tables.append_feedback(logged(spark, sf_dir), folder)
    return tables.read_feedback(spark, [folder], limit)


@query(f"SELECT voucher_id, 'r' || voucher_id::VARCHAR AS id, voucher_number AS corrected FROM ({HEADS}) WHERE voucher_id % 2 = 0 ORDER BY voucher_id DESC LIMIT 1000")
def last_feedback(spark, sf_dir):
    """The last 1000 records of a correction log, written and read; the limit is the feature."""
    return read_log(spark, sf_dir, 1000).select("voucher_id", "id", F.col("corrections")["voucher_number"]["corrected"].alias("corrected"))


@query(f"SELECT CASE WHEN voucher_id % 3 = 0 THEN 'batch' ELSE 'regular' END AS source, count(*) AS n, CAST(max(1700000000 + voucher_id * 60) AS BIGINT) AS last_updated FROM ({HEADS}) WHERE voucher_id % 2 = 0 GROUP BY 1")
def dataset_stats(spark, sf_dir):
    s = learn.dataset_stats(read_log(spark, sf_dir))
    return s.select("source", "n", F.unix_timestamp(F.col("last_updated").cast("timestamp")).alias("last_updated"))


def annotated(spark, sf_dir) -> DataFrame:
    """Annotated boxes, written as a log and read back; each seventh record lacks the user's box and is left out."""
    folder = streams.work_folder(spark, "crops")
    b = boxes(spark, sf_dir).withColumns({"original_filename": F.concat(F.lit("f"), F.col("id").cast("string")), "timestamp": F.timestamp_seconds("id").cast("timestamp_ntz"), "user_crop": F.when(F.col("id") % 7 != 0, F.col("user_crop"))})
    tables.append_crop_annotations(b.withColumn("id", F.col("id").cast("string")), folder)
    return tables.read_crop_annotations(spark, folder)


@query(f"SELECT count(*) AS n, avg(uw) AS width, avg(uh) AS height FROM ({BOXES_SQL}) WHERE id % 7 <> 0")
def crop_annotations(spark, sf_dir):
    return learn.size_model(annotated(spark, sf_dir))


@query(f"SELECT count(*) AS total, count(*) FILTER (floor(aw) >= 20 AND floor(ah) >= 20) AS kept, count(*) FILTER (floor(aw) < 20 OR floor(ah) < 20) AS removed FROM ({BOXES_SQL})")
def cleaned_annotations(spark, sf_dir):
    return learn.cleaning_report(boxes(spark, sf_dir))


@query(f"SELECT field, count(*) AS n, CAST(sum(n) AS BIGINT) AS used FROM (SELECT field, auto, corrected, count(*) AS n FROM ({DIFFS_SQL}) WHERE auto IS NOT NULL GROUP BY 1, 2, 3) GROUP BY field")
def kept_model(spark, sf_dir):
    """A model table written under its version and read back."""
    folder = streams.work_folder(spark, "models")
    tables.write_model(learn.value_model(learn.header_diffs(pairs(spark, sf_dir))), folder, "1")
    return tables.read_model(spark, folder, "1").groupBy("field").agg(F.count("*").alias("n"), F.sum("n").alias("used"))


# --- learning --------------------------------------------------------------------------------------------------


def paired(spark, sf_dir) -> DataFrame:
    """Vouchers whose first output missed a deduction, had a wrong amount, or missed an item, by number."""
    k, b = F.col("voucher_id"), booked(spark, sf_dir)
    less = F.when(k % 4 == 1, F.slice("deductions", 1, 3)).when(k % 4 == 2, F.transform("deductions", lambda d: F.struct(d["deduction_type"].alias("deduction_type"), (d["amount"] + 1).cast("decimal(12,2)").alias("amount")))).otherwise(F.col("deductions"))
    return b.select("voucher_id", "supplier_name", F.struct(less.alias("deductions"), F.when(k % 5 == 1, F.slice("items", F.lit(2), F.size("items"))).otherwise(F.col("items")).alias("items")).alias("original"), F.struct("deductions", "items").alias("corrected"))


@query(f"SELECT voucher_id, 'deduction_' || deduction_type AS field, '' AS auto, CAST(amount AS VARCHAR) AS corrected FROM ({DEDUCTION_ROWS_SQL}) WHERE voucher_id % 4 IN (1, 2)")
def deduction_examples(spark, sf_dir):
    return learn.deduction_examples(paired(spark, sf_dir))


@query(f"SELECT voucher_id, 'deduction_' || deduction_type AS field, '' AS auto, CAST(amount AS VARCHAR) AS corrected FROM ({DEDUCTION_ROWS_SQL}) WHERE voucher_id % 4 = 1")
def deduction_count_examples(spark, sf_dir):
    return learn.deduction_examples(paired(spark, sf_dir), by_count=True)


@query(f"SELECT voucher_id, n_items - 1 AS original, n_items AS corrected FROM ({HEADS}) WHERE voucher_id % 5 = 1")
def item_counts(spark, sf_dir):
    return learn.item_counts(paired(spark, sf_dir))


@query(f"SELECT voucher_id, 'supplier_name' AS field, 'X' AS auto, supplier_name AS corrected FROM ({HEADS}) WHERE voucher_id % 3 = 0")
def logged_diffs(spark, sf_dir):
    """Differences of fields that both versions have: a missing number is none."""
    k = F.col("voucher_id")
    versions = lambda name, with_number: F.create_map(*[x for f, c in (("supplier_name", name), *((("voucher_number", F.col("voucher_number")),) if with_number else ())) for x in (F.lit(f), c)])
    wrong = F.when(k % 3 == 0, "X").otherwise(F.col("supplier_name"))
    v = booked(spark, sf_dir).select("voucher_id", F.when(k % 2 == 0, versions(wrong, False)).otherwise(versions(wrong, True)).alias("original"), versions(F.col("supplier_name"), True).alias("corrected"))
    return learn.logged_diffs(v)


FEEDBACK_SQL = f"""SELECT voucher_id, 'voucher_number' AS field, 'old' AS auto, voucher_number AS corrected, 'batch' AS source FROM ({HEADS}) WHERE voucher_id % 2 = 0
 UNION ALL SELECT voucher_id, 'item_quantity', '0', CAST(quantity AS VARCHAR), 'batch' FROM ({ITEM_ROWS_SQL}) WHERE position = 0
 UNION ALL SELECT voucher_id, 'deduction_Commission', '', CAST(commission AS VARCHAR), 'batch' FROM ({HEADS}) WHERE voucher_id % 3 = 0"""


@query(FEEDBACK_SQL)
def feedback_examples(spark, sf_dir):
    k = F.col("voucher_id")
    change = F.create_map(F.lit("voucher_number"), F.struct(F.lit("old").alias("original"), F.col("voucher_number").alias("corrected")))
    item = F.array(F.struct(F.lit("quantity").alias("field"), F.lit("0").alias("original"), F.col("items")[0]["quantity"].cast("string").alias("corrected")))
    log = booked(spark, sf_dir).select("voucher_id", F.lit("").alias("raw_ocr_text"), F.lit("batch").alias("source"), F.when(k % 2 == 0, change).alias("corrections"), item.alias("items"), F.when(k % 3 == 0, F.slice("deductions", 1, 1)).alias("deductions"))
    return learn.feedback_examples(log).drop("raw_ocr_text")


# What the ten models hold, of all examples. A matcher's replaced stretches are what is left of two strings where their longest
# common stretch (the first one of the first string) is taken out, and so on before and after it, until nothing is common.
_TAUGHT = f"SELECT d.*, h.supplier_name FROM ({DIFFS_SQL}) d JOIN (SELECT voucher_id, supplier_name FROM ({HEADS})) h USING (voucher_id)"
_SHOWN = f"SELECT d.*, h.supplier_name, string_split(text, chr(10)) AS l, text FROM ({DIFFS_SQL}) d JOIN ({vo.TEXT_SQL}) h USING (voucher_id)"
_STRETCH = "[x FOR x IN flatten([[a[i : i + k - 1] FOR i IN range(1, length(a) - k + 2)] FOR k IN range(least(length(a), length(b)), 0, -1)]) IF contains(b, x)][1]"
_LEFT = f"""WITH RECURSIVE s AS (SELECT a, b, n, {_STRETCH} AS m FROM (SELECT auto AS a, corrected AS b, count(*) AS n FROM ({DIFFS_SQL}) WHERE auto <> corrected GROUP BY 1, 2)
 UNION ALL SELECT a, b, n, {_STRETCH} FROM (SELECT n, unnest([a[: strpos(a, m) - 1], a[strpos(a, m) + length(m) :]]) AS a, unnest([b[: strpos(b, m) - 1], b[strpos(b, m) + length(m) :]]) AS b FROM s WHERE m IS NOT NULL))
 SELECT a AS bad, b AS good, n FROM s WHERE m IS NULL AND length(a) BETWEEN 1 AND 4 AND length(b) BETWEEN 1 AND 4"""
_MARKED = rf"SELECT *, regexp_replace(regexp_replace(regexp_extract_all(text, '(?is)(.{{1,30}})\Q' || corrected || '\E', 1)[-1], '^[\s\S]*\n', ''), '[\s:\-=.]+$', '') AS last FROM ({_SHOWN})"
_MARKED = rf"SELECT upper(trim(supplier_name)) AS supplier_key, field, array_to_string(words[greatest(len(words) - 3, 1):], ' ') AS anchor FROM (SELECT *, [w FOR w IN string_split_regex(last, '\s+') IF w <> ''] AS words FROM ({_MARKED}))"
_PLACES = f"SELECT field, list_position([coalesce(contains(x, auto), false) OR contains(x, corrected) FOR x IN l], true) - 1 AS p, len(l) AS lines FROM ({_SHOWN})"
_BESIDE = f"SELECT field, corrected, [x FOR x IN l IF contains(x, corrected)][1] AS x FROM ({_SHOWN})"
_BESIDE = rf"SELECT field, unnest(['before', 'after']) AS side, unnest([string_split_regex(trim(x[: strpos(x, corrected) - 1]), '\s+')[-1], string_split_regex(trim(x[strpos(x, corrected) + length(corrected) :]), '\s+')[1]]) AS word FROM ({_BESIDE})"
_TRAINED = {
    "values": f"SELECT count(*) AS n FROM ({DIFFS_SQL}) WHERE auto IS NOT NULL GROUP BY field, auto, corrected", "substitutions": f"SELECT sum(n) AS n FROM ({_LEFT}) GROUP BY bad, good",
    "anchors": f"SELECT count(*) AS n FROM ({_MARKED}) WHERE length(anchor) > 2 GROUP BY supplier_key, field, anchor", "sources": f"SELECT count(*) AS n FROM ({DIFFS_SQL}) GROUP BY voucher_id % 2",
    "patterns": f"SELECT max(n) AS n FROM (SELECT field, lower(trim(auto)) AS key, count(*) AS n FROM ({DIFFS_SQL}) WHERE auto IS NOT NULL GROUP BY field, key, corrected) GROUP BY field, key",
    "contexts": f"SELECT count(*) AS n FROM ({DIFFS_SQL}) GROUP BY field, corrected", "suppliers": f"SELECT count(*) AS n FROM ({_TAUGHT}) GROUP BY supplier_name, field, corrected",
    "places": f"SELECT count(*) AS n FROM ({_PLACES}) WHERE p >= 0 GROUP BY field, CASE WHEN p / lines < 0.3 THEN 1 WHEN p / lines < 0.7 THEN 2 ELSE 3 END",
    "neighbours": f"SELECT count(*) AS n FROM ({_BESIDE}) WHERE word <> '' GROUP BY field, side, word", "crops": f"SELECT count(*) AS n FROM ({BOXES_SQL}) WHERE aw >= 20 AND uw >= 20 AND ah >= 20 AND uh >= 20",
}


@query(" UNION ALL ".join(f"SELECT '{m}' AS model, CAST(count(*) AS BIGINT) AS rows, CAST(coalesce(sum(n), 0) AS BIGINT) AS samples FROM ({made})" for m, made in _TRAINED.items()))
def trained_models(spark, sf_dir):
    """All ten models out of one table of examples, and what each holds."""
    e = examples(spark, sf_dir).withColumn("source", F.when(F.col("voucher_id") % 2 == 0, "database").otherwise("feedback"))
    return learn.model_summary(learn.train_all(written(e), boxes(spark, sf_dir)))  # each model reads the examples


SUPPLIER_DIFFS = f"(SELECT d.*, 1700000000 + 60 * voucher_id AS ts FROM ({DIFFS_SQL}) d WHERE field = 'supplier_name')"
#: Seconds of the time at which the sessions of continued() are said to be: patterns seen 90 days before may go.
LAST_SESSION = 1_700_000_000 + 120 * 86_400


def continued(spark, sf_dir) -> continuous.ModelStore:
    """Three sessions over growing logs of corrected suppliers and boxes: each has all that the one before had, and more."""
    k = F.col("voucher_id")
    e = written(examples(spark, sf_dir).where("field = 'supplier_name'").withColumns({"id": k, "ts": F.timestamp_seconds(1_700_000_000 + k * 60), "source": F.when(k % 2 == 0, "database").otherwise("feedback")}))  # each session reads it
    b = boxes(spark, sf_dir).withColumns({"third": F.col("id") % 3, "id": F.concat_ws(":", "id", F.to_json(F.struct("auto_crop", "user_crop")))})  # ids of lines come twice
    store = continuous.ModelStore(spark, streams.work_folder(spark, "models"))
    for session in (1, 2, 3):
        continuous.train_more(store, e.where(k % 3 < session), b.where(F.col("third") < session), session, str(datetime.fromtimestamp(LAST_SESSION + session, UTC).replace(tzinfo=None)))
    return store


_COUNTED = (
    ("values", "auto, corrected", "SELECT * FROM {d}"), ("sources", "voucher_id % 2", "SELECT * FROM {d}"), ("contexts", "corrected", "SELECT * FROM {d}"), ("suppliers", "corrected", "SELECT * FROM {d}"),
    ("anchors", "corrected", "SELECT * FROM {d}"), ("neighbours", "field", "SELECT * FROM {d}"), ("places", "n_items = 1", "SELECT * FROM {d} JOIN (SELECT voucher_id, n_items FROM ({heads})) USING (voucher_id)"),
    ("substitutions", "left(auto, 2) || (auto = 'TOTAL')::VARCHAR || (auto LIKE 'R4%')::VARCHAR", "SELECT * FROM {d}"),
)


@query(" UNION ALL ".join(f"SELECT '{m}' AS model, CAST(count(*) AS BIGINT) AS rows, CAST(coalesce(sum(n), 0) AS BIGINT) AS samples FROM (SELECT count(*) AS n FROM ({src.format(d=SUPPLIER_DIFFS, heads=HEADS)}) GROUP BY {by})" for m, by, src in _COUNTED)
 + f""" UNION ALL SELECT 'patterns', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT max(n) AS n, CASE WHEN count(*) = 1 AND sum(n) >= 3 THEN 0.95 ELSE max(n) / sum(n) END AS confidence, max(ts) AS ts
 FROM (SELECT lower(trim(auto)) AS key, corrected, count(*) AS n, max(ts) AS ts FROM {SUPPLIER_DIFFS} GROUP BY 1, 2) GROUP BY key) WHERE NOT (ts < {LAST_SESSION + 3 - 90 * 86_400} AND confidence < 0.3)
 UNION ALL SELECT 'crops', 1, count(*) FROM (SELECT DISTINCT * FROM ({BOXES_SQL})) WHERE aw >= 20 AND uw >= 20 AND ah >= 20 AND uh >= 20""")
def continued_models(spark, sf_dir):
    """What all ten models hold after three sessions, none of which counts again what an earlier one used."""
    return learn.model_summary(continuous.models(continued(spark, sf_dir)))


@query(f"""SELECT CAST(1 + s AS BIGINT) AS session, n AS n_corrections, n_boxes, coalesce(p, 0) AS n_patterns
FROM (SELECT voucher_id % 3 AS s, count(*) AS n FROM {SUPPLIER_DIFFS} GROUP BY 1) JOIN (SELECT id % 3 AS s, count(*) AS n_boxes FROM (SELECT DISTINCT * FROM ({BOXES_SQL})) GROUP BY 1) USING (s)
LEFT JOIN (SELECT s, count(*) AS p FROM (SELECT min(voucher_id % 3) AS s FROM {SUPPLIER_DIFFS} GROUP BY auto, corrected) GROUP BY 1) USING (s)""")
def continued_sessions(spark, sf_dir):
    """What each of the three sessions recorded: corrections and boxes that were new to it, and patterns that none had before."""
    return continuous.sessions(continued(spark, sf_dir)).select("session", "n_corrections", "n_boxes", "n_patterns")


@query(f"""SELECT key, n AS total, confidence FROM (SELECT key, sum(n) AS n, CASE WHEN count(*) = 1 AND sum(n) >= 3 THEN 0.95 ELSE max(n) / sum(n) END AS confidence FROM (SELECT field || ':' || lower(trim(auto)) AS key, corrected, count(*) AS n FROM ({DIFFS_SQL}) WHERE auto IS NOT NULL GROUP BY 1, 2) GROUP BY key)
WHERE confidence >= 0.8 AND n >= 3 ORDER BY confidence DESC, n DESC, key LIMIT 10""".replace("n AS total", "CAST(n AS BIGINT) AS total"))
def reliable_patterns(spark, sf_dir):
    return learn.reliable_patterns(learn.pattern_model(learn.header_diffs(pairs(spark, sf_dir)))).select("key", "total", "confidence")


def predicted(spark, sf_dir) -> DataFrame:
    p = pairs(spark, sf_dir)
    return p.select("voucher_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"original.{f}").alias("predicted"), F.col(f"corrected.{f}").alias("actual")) for f in ("supplier_name", "voucher_number")])))


@query(f"SELECT field, count(*) FILTER (ok) AS \"right\", count(*) FILTER (NOT ok) AS wrong, avg(ok::INT::DOUBLE) AS accuracy FROM (SELECT 'supplier_name' AS field, supplier_auto = supplier_name AS ok FROM ({PAIRS_SQL}) UNION ALL SELECT 'voucher_number', number_auto IS NOT NULL FROM ({PAIRS_SQL})) GROUP BY field")
def prediction_outcomes(spark, sf_dir):
    return learn.outcomes(predicted(spark, sf_dir))


@query(f"SELECT voucher_id, field, auto, corrected FROM ({DIFFS_SQL}) WHERE field <> 'net_total'")
def wrong_predictions(spark, sf_dir):
    return learn.wrong_predictions(predicted(spark, sf_dir))


@query(f"SELECT count(*) AS n, count(*) AS recovered FROM ({HEADS})")
def self_recovered(spark, sf_dir):
    """Suppliers found again by the anchors that the same texts gave."""
    rows = vo.rendered(spark, sf_dir).join(vo.truth(spark, sf_dir).select("voucher_id", "supplier_name"), "voucher_id")
    return learn.self_recovery(rows, "supplier_name")


@query("SELECT event_id, field FROM (SELECT event_id, event_type AS field, ts, value / 100 - floor(value / 100) AS confidence FROM events) WHERE NOT (ts < TIMESTAMP '2024-06-01' - INTERVAL 90 DAY AND confidence < 0.3)")
def pruned_patterns(spark, sf_dir):
    return context.pruned(predictions(spark, sf_dir).withColumn("last_seen", F.col("ts")), "2024-06-01").select("event_id", "field")


@query(f"SELECT voucher_id, field FROM ({DIFFS_SQL}) WHERE voucher_id % 2 = 1")
def not_trained(spark, sf_dir):
    """Corrections that no earlier session used."""
    d = learn.header_diffs(pairs(spark, sf_dir)).withColumn("id", F.xxhash64("voucher_id", "field"))
    return history.not_trained(d, d.where("voucher_id % 2 = 0")).select("voucher_id", "field")


# --- reports ---------------------------------------------------------------------------------------------------


@query(f"""SELECT error, n, n / total AS share FROM (SELECT count(*) AS total, count(*) FILTER (voucher_id % 5 = 0) AS a, count(*) FILTER (voucher_id % 5 <> 0 AND voucher_id % 4 = 0) AS b, count(*) FILTER (voucher_id % 7 = 0) AS c, count(*) FILTER (voucher_id % 6 = 0) AS d, count(*) FILTER (voucher_id % 8 = 0) AS e FROM ({HEADS})),
LATERAL (SELECT unnest(['voucher_number_missed', 'voucher_number_wrong', 'date_missed', 'supplier_missed', 'total_wrong']) AS error, unnest([a, b, c, d, e]) AS n)""")
def error_tallies(spark, sf_dir):
    k, fields = F.col("voucher_id"), ("voucher_number", "voucher_date", "supplier_name", "gross_total")
    parsed = F.struct(
        F.when(k % 5 == 0, None).when(k % 4 == 0, "wrong").otherwise(F.col("voucher_number")).alias("voucher_number"), F.when(k % 7 != 0, F.col("voucher_date")).alias("voucher_date"),
        F.when(k % 6 != 0, F.col("supplier_name")).alias("supplier_name"), F.when(k % 8 == 0, F.col("gross_total") + 11).otherwise(F.col("gross_total") + 9).alias("gross_total"),
    )
    return evaluate.error_tallies(booked(spark, sf_dir).select(parsed.alias("parsed"), F.struct(*fields).alias("actual")))


@query("SELECT l_orderkey AS voucher_id, coalesce(round_even(avg(CASE WHEN c > 0 THEN c END), 2), 0) AS confidence FROM (SELECT l_orderkey, (l_partkey % 100 - 20)::DOUBLE AS c FROM lineitem) GROUP BY 1")
def mean_confidence(spark, sf_dir):
    """Token confidences from line items; those of 0 or less don't count."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return evaluate.mean_confidence(li.select(F.col("l_orderkey").alias("voucher_id"), (F.col("l_partkey") % 100 - 20).cast("double").alias("conf")))


METRICS = {"brightness": "l_partkey % 256", "contrast": "l_suppkey % 60", "sharpness": "(l_partkey + l_suppkey) % 40", "noise_level": "l_orderkey % 60", "skew_angle": "l_linenumber - 4", "width": "500 + l_orderkey % 1000"}
SCORE_SQL = "100 - CASE WHEN brightness < 80 OR brightness > 220 THEN 15 ELSE 0 END - CASE WHEN contrast < 30 THEN 20 ELSE 0 END - CASE WHEN sharpness < 20 THEN 15 ELSE 0 END - CASE WHEN noise_level > 30 THEN 20 ELSE 0 END - CASE WHEN abs(skew_angle) > 2 THEN 10 ELSE 0 END - CASE WHEN width < 1000 THEN 10 ELSE 0 END"


@query(f"SELECT id, score, CASE WHEN score >= 70 THEN 'optimal,enhanced,simple' WHEN score >= 40 THEN 'optimal,aggressive,enhanced,experimental' ELSE 'aggressive,experimental,optimal,enhanced' END AS modes FROM (SELECT l_orderkey * 10 + l_linenumber AS id, ({SCORE_SQL})::DOUBLE AS score FROM (SELECT l_orderkey, l_linenumber, {', '.join(f'{e} AS {n}' for n, e in METRICS.items())} FROM lineitem))")
def image_quality(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    m = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *[F.expr(e).alias(n) for n, e in METRICS.items()])
    return evaluate.image_quality(m).select("id", "score", F.array_join("modes", ",").alias("modes"))


@query(f"SELECT voucher_id, substr('SHARMA TRADING MARKET' || chr(10) || CASE WHEN voucher_id % 6 = 5 THEN 'Voucher Nunber ' ELSE 'Voucher Number ' END || voucher_number || chr(10) || 'WHOLESALE', 1, 40) AS snippet FROM ({HEADS}) WHERE voucher_id % 6 IN (1, 5) ORDER BY voucher_id LIMIT 100")
def failing_examples(spark, sf_dir):
    """At most 100 texts in which the base profile misses a field; the limit is the feature."""
    made = profiles.extract(vo.rendered(spark, sf_dir, noisy=True), "base")
    return evaluate.failing_examples(made, ("voucher_number", "voucher_date", "supplier_name", "net_total"), snippet=40)


@query(f"SELECT outcome, count(*) AS n FROM (SELECT unnest(CASE voucher_id % 5 WHEN 0 THEN ['label_without_value', 'length_none'] WHEN 1 THEN ['too_short', 'length_short'] WHEN 2 THEN ['has_vendor'] WHEN 3 THEN ['length_long'] ELSE ['ok'] END) AS outcome FROM ({HEADS})) GROUP BY outcome")
def issue_report(spark, sf_dir):
    """What is wrong with suppliers' names, after the correction chain and the base profile."""
    k = F.col("voucher_id") % 5
    v = profiles.extract(text.correct_text(vo.rendered(spark, sf_dir, noisy=True)), "base")
    name = F.when(k == 0, None).when(k == 1, "A").when(k == 2, F.concat(F.lit("OF "), "vendor_details")).when(k == 3, F.repeat(F.lit("N"), 60)).otherwise(F.col("supplier_name"))
    return evaluate.issue_report(v.withColumn("supplier_name", name))


@query(f"SELECT parsing, ocr, CASE WHEN parsing > 1.5 * ocr THEN 'parsing' WHEN ocr > 1.5 * parsing THEN 'ocr' ELSE 'mixed' END AS dominant FROM (SELECT count(*) FILTER (voucher_id % 4 = 0) AS parsing, count(*) FILTER (voucher_id % 4 = 1) AS ocr FROM ({HEADS}))")
def dominant_cause(spark, sf_dir):
    """Numbers that weren't taken: of each fourth voucher one that its text has, of as many one that it hasn't."""
    k = F.col("voucher_id")
    actual = F.when(k % 4 == 0, F.col("voucher_number")).when(k % 4 == 1, "nowhere")
    v = booked(spark, sf_dir).select(evaluate.failure_class(F.lit(None).cast("string"), actual, F.concat(F.lit("Voucher Number "), "voucher_number")).alias("cause"))
    return evaluate.dominant_cause(v.where("cause IS NOT NULL").groupBy("cause").agg(F.count("*").alias("n")))


STATES = ("high", "medium", "low", "validation_failed", "not_found")


@query(f"SELECT recommendation, count(*) AS n FROM (SELECT ['[OK] Auto-accept', '[WARN] Verify this field', '[X] Low confidence - manual entry', '[X] Validation failed', '[X] Not found - manual entry required'][1 + (voucher_id % 5)::INT] AS recommendation FROM ({HEADS})) GROUP BY 1")
def recommendations(spark, sf_dir):
    """A recommendation for each status; confidences and validity are such that each status occurs."""
    k = F.col("voucher_id") % 5
    state = validate.status(F.when(k == 4, None).otherwise(k != 3), F.when(k == 0, 85).when(k == 1, 84).when(k == 2, 59).otherwise(95))
    return booked(spark, sf_dir).select(validate.recommendation(state).alias("recommendation")).groupBy("recommendation").agg(F.count("*").alias("n"))


@query(f"SELECT voucher_id, CASE WHEN voucher_id % 3 = 0 THEN 'validation_failed' ELSE 'high' END AS status, CASE WHEN voucher_id % 3 = 0 THEN 'Net > Gross - verify deductions' END AS note FROM ({HEADS})")
def cross_checked(spark, sf_dir):
    """Net totals, of which those above their gross total fail."""
    net = F.when(F.col("voucher_id") % 3 == 0, F.col("gross_total") + 1).otherwise(F.col("net_total"))
    rows = booked(spark, sf_dir).select("voucher_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), c.cast("string").alias("value"), F.lit("high").alias("status")) for f, c in (("gross_total", F.col("gross_total")), ("net_total", net))])))
    return validate.cross_checked(rows).where("field = 'net_total'").select("voucher_id", "status", "note")


@query(f"SELECT voucher_id, 0.3 * (voucher_id % 100)::DOUBLE + 0.7 * 50 AS number_confidence, 0.3 * 50 + 0.7 * (voucher_id % 90)::DOUBLE AS date_confidence FROM ({HEADS})")
def merged_field_confidences(spark, sf_dir):
    k = F.col("voucher_id")
    m = validate.merged_confidence(F.create_map(F.lit("number"), (k % 100).cast("double")), F.create_map(F.lit("date"), (k % 90).cast("double")))
    return booked(spark, sf_dir).select("voucher_id", m["number"].alias("number_confidence"), m["date"].alias("date_confidence"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey > 9999 OR o_orderkey < 10 OR o_orderkey BETWEEN 2020 AND 2030 THEN 1 ELSE 0 END AS BIGINT) AS number_errors, CAST(CASE WHEN o_totalprice::DECIMAL(14,2) NOT BETWEEN 10 AND 100000 THEN 1 ELSE 0 END AS BIGINT) AS amount_errors FROM orders")
def adaptive_rules(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = lambda f, c: F.size(validate.adaptive_errors(f, c)).cast("long")
    return o.select("o_orderkey", n("voucher_number", F.col("o_orderkey").cast("string")).alias("number_errors"), n("gross_total", F.col("o_totalprice").cast("decimal(14,2)").cast("string")).alias("amount_errors"))


@query(f"SELECT voucher_id, CAST(100 + voucher_id % 900 + (voucher_id % 90 + 10) / 100.0 AS DECIMAL(18,2)) AS first_amount, CAST(1 AS BIGINT) AS n FROM ({HEADS})")
def listed_amounts(spark, sf_dir):
    k = F.col("voucher_id")
    shown = F.concat(F.lit("Amount "), (100 + k % 900).cast("string"), F.lit("."), (k % 90 + 10).cast("string"))
    a = text.amounts(shown)
    return booked(spark, sf_dir).select("voucher_id", F.get(a, F.lit(0)).alias("first_amount"), F.size(a).cast("long").alias("n"))


@query(f"SELECT voucher_id, 'Voucher Number' || chr(10) || voucher_number || chr(10) || 'SuppName' || chr(10) || supplier_name AS shown FROM ({HEADS})")
def split_labels(spark, sf_dir):
    return booked(spark, sf_dir).select("voucher_id", text.split_labels(F.concat(F.lit("Voucher Number"), "voucher_number", F.lit("\nSuppName"), "supplier_name")).alias("shown"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,4)) AS value FROM lineitem")
def cleaned_amounts(spark, sf_dir):
    """Amounts whose zeros and ones were read as letters."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values.repaired_number(F.translate(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), "01", "Ol")).cast("decimal(18,4)").alias("value"))


def text_files(spark, sf_dir) -> DataFrame:
    """A stream of files of texts, two a micro-batch; a twelfth of the vouchers come twice, in different files."""
    folder, k = streams.work_folder(spark, "texts"), F.col("voucher_id")
    texts = vo.rendered(spark, sf_dir).select("voucher_id", "created_at", "raw_ocr_text")
    texts.withColumn("part", k % 5).unionByName(texts.where(k % 12 == 7).withColumn("part", F.lit(5).cast("long"))).repartition(6, "part").write.parquet(folder)
    return spark.readStream.schema("voucher_id long, created_at timestamp_ntz, raw_ocr_text string, part long").option("maxFilesPerTrigger", 2).parquet(folder).drop("part")


def with_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = tables["items"].groupBy("voucher_id").agg(F.count("*").alias("n_items"))
    return tables["master"].select("voucher_id", "voucher_number", "net_total").join(counts, "voucher_id")


@query(f"SELECT voucher_id, voucher_number, net_total, n_items FROM ({BOOKED_SQL})")
def extracted_stream(spark, sf_dir):
    """Texts that come as files of a stream, extracted and upserted batch by batch."""
    store = Snapshots(spark, streams.work_folder(spark, "vouchers"))
    streams.upsert_to_end(text_files(spark, sf_dir), store, streams.work_folder(spark, "state"))
    return with_counts(store.read())


@query(f"SELECT voucher_id, voucher_number, net_total, n_items FROM ({BOOKED_SQL})")
def replayed_stream(spark, sf_dir):
    """The same stream, which stops after its first batch is in the tables but before Spark knows; then it goes on."""
    store, state, texts = Snapshots(spark, streams.work_folder(spark, "vouchers")), streams.work_folder(spark, "state"), text_files(spark, sf_dir)

    def stop(number: int) -> None:
        raise RuntimeError("stopped after the write")

    try:
        streams.upsert_to_end(texts, store, state, stop)
    except StreamingQueryException as e:
        if "stopped after the write" not in str(e):
            raise
    streams.upsert_to_end(texts, store, state, most_layers=2)
    return with_counts(store.read())


@query("SELECT user_id % 40 AS batch, count(*) AS total FROM events GROUP BY 1")
def streamed_once(spark, sf_dir):
    """Events that come twice count once."""
    e = streams.event_stream(spark, sf_dir)
    once = streams.run_to_end(streams.deduplicated(e.union(e)).select("event_id", "user_id"), "once", "append")
    return once.groupBy((F.col("user_id") % 40).alias("batch")).agg(F.count("*").alias("total"))


# --- checks and tallies ------------------------------------------------------------------------------------------------


@query(f"""SELECT voucher_id, gross_total, CAST({NET} + CASE WHEN form = 6 THEN 50 ELSE 0 END AS DECIMAL(12,2)) AS net_total,
 CASE WHEN form = 2 THEN 'items differ from gross_total' WHEN form IN (5, 6) THEN 'gross_total less deductions is not net_total' ELSE '' END AS warnings,
 CASE form WHEN 1 THEN 'gross_total from items' WHEN 2 THEN 'gross_total corrected to items' WHEN 3 THEN 'net_total from gross_total' WHEN 4 THEN 'gross_total from net_total' WHEN 5 THEN 'net_total corrected from gross_total' ELSE '' END AS corrections
 FROM (SELECT *, voucher_id % 7 AS form FROM ({HEADS}))""")
def checked_totals(spark, sf_dir):
    """By form: a gross that is missing or ten times too large, a missing net, both a gross and items missing, a wrong net with and without items."""
    form, b = F.col("voucher_id") % 7, booked(spark, sf_dir)
    v = b.withColumns({
        "items": F.when(form.isin(4, 6), F.slice("items", 1, 0)).otherwise(F.col("items")), "gross_total": F.when(form == 2, F.col("gross_total") * 10).when(~form.isin(1, 4), F.col("gross_total")).cast("decimal(14,2)"),
        "net_total": F.when(form.isin(5, 6), F.col("net_total") + 50).when(form != 3, F.col("net_total")).cast("decimal(12,2)"),
    })
    return validate.checked_totals(v).select("voucher_id", "gross_total", "net_total", F.array_join("warnings", "; ").alias("warnings"), F.array_join("corrections", "; ").alias("corrections"))


#: Texts in both dialects: numbers run into their label, marks before values, a misread supplier label.
MESSY = """CASE voucher_id % 4 WHEN 0 THEN 'Voucher #' || voucher_number || ' Date: 12/03 Supp. Name ' || supplier_name || ' Total 5' WHEN 1 THEN 'VoucherNumber' || CAST(100000 + voucher_id % 50 AS STRING) || ' Nane ' || supplier_name
 WHEN 2 THEN 'Supplier ' || supplier_name || ' No ' || voucher_number || ' Comm ' || CAST(voucher_id % 9 AS STRING) ELSE 'Supp Name ' || supplier_name || ' date ' || voucher_number END"""
_TALLIED = " UNION ALL ".join(f"SELECT '{kind}' AS kind, {'left(t, 20)' if kind == 'indicator' else 't'} AS token FROM (SELECT unnest(regexp_extract_all(x, '{p}', {g})) AS t FROM messy)" for kind, patterns in evaluate.TALLIED.items() for p, g in patterns)


@query(f"""WITH messy AS (SELECT lower({MESSY.replace("STRING", "VARCHAR")}) AS x FROM ({HEADS})) SELECT kind, token, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, token) AS r FROM
 (SELECT kind, token, count(*) AS n FROM ({_TALLIED}) GROUP BY 1, 2)) WHERE r <= 20""")
def frequent_tokens(spark, sf_dir):
    """The 20 most frequent labels, field indicators, garbled numbers and supplier labels of all texts; the limit is the feature."""
    return evaluate.tallies(vo.truth(spark, sf_dir).select(F.expr(MESSY).alias("text")), "text")


@query(f"""SELECT count(*) AS n, count(*) FILTER (k <> 2) AS has_voucher_number, count(*) FILTER (k NOT IN (2, 3)) AS has_supplier_name, count(*) FILTER (k NOT IN (2, 4)) AS has_gross_total,
 count(*) FILTER (k NOT IN (2, 5)) AS has_items, count(*) FILTER (k NOT IN (2, 6)) AS has_deductions, count(*) FILTER (k = 2) AS unparsed FROM (SELECT voucher_id % 7 AS k FROM ({HEADS}))""")
def receipt_coverage(spark, sf_dir):
    """Vouchers that lack a field, have an empty one, a total of 0, no items, no deductions, or weren't parsed."""
    k = F.col("voucher_id") % 7
    cut = lambda name, form: F.when(k == form, F.slice(name, 1, 0)).otherwise(F.col(name)).alias(name)
    parsed = F.struct("voucher_number", F.when(k == 3, "").otherwise(F.col("supplier_name")).alias("supplier_name"), F.when(k == 4, 0).otherwise(F.col("gross_total")).cast("decimal(12,2)").alias("gross_total"), cut("items", 5), cut("deductions", 6))
    return evaluate.receipt_coverage(booked(spark, sf_dir).select(F.when(k != 2, parsed).alias("parsed")), ("voucher_number", "supplier_name", "gross_total"))


@query(f"SELECT 'b' AS parser, count(*) FILTER (voucher_id % 4 <> 0) / count(*) AS share FROM ({HEADS})")
def best_parser(spark, sf_dir):
    """Of four parsers, two with the same and the largest share, the surer one; of those that are as sure, the first by name."""
    k = F.col("voucher_id")
    tries = [("a", 3, 60), ("b", 4, 80), ("c", 4, 80), ("d", 4, 70)]
    rows = booked(spark, sf_dir).select("voucher_id", F.inline(F.array(*[F.struct(F.lit(p).alias("parser"), F.lit("voucher_number").alias("field"), F.when(k % m != 0, F.col("voucher_number")).alias("predicted"), F.col("voucher_number").alias("actual"), F.lit(c).cast("double").alias("confidence")) for p, m, c in tries])))
    return evaluate.best_parser(evaluate.parser_scores(rows)).select("parser", "share")


@query(f"SELECT DISTINCT id, aw AS width, ah AS height FROM ({BOXES_SQL}) WHERE least(aw, ah) < 20 ORDER BY id, width, height LIMIT 5")
def small_boxes(spark, sf_dir):
    """Five examples of automatic boxes with a side below 20; the limit is the feature."""
    return learn.small_boxes(boxes(spark, sf_dir).distinct()).select("id", "auto_crop.width", "auto_crop.height")


@query(f"""SELECT field, count(*) AS n, avg(b::INT::DOUBLE) AS before, avg(a::INT::DOUBLE) AS after FROM (
 SELECT 'item_item_name' AS field, FALSE AS b, item_name IN (SELECT item_name FROM {TAUGHT}) AS a FROM ({ITEM_ROWS_SQL}) WHERE position = 0
 UNION ALL SELECT 'item_quantity', FALSE, quantity IN (SELECT quantity FROM {TAUGHT}) FROM ({ITEM_ROWS_SQL}) WHERE position = 0
 UNION ALL SELECT 'item_line_amount', TRUE, TRUE FROM ({ITEM_ROWS_SQL}) WHERE position = 0) GROUP BY field""")
def validated_items(spark, sf_dir):
    """How right the fields of first items are before and after learned values."""
    v = misread_items(spark, sf_dir)
    taught = v.where("voucher_id % 3 = 1").select("voucher_id", F.struct(F.col("wrong").alias("items")).alias("original"), F.struct("items").alias("corrected"))
    model = learn.value_model(learn.item_diffs(taught).withColumn("field", F.concat(F.lit("item_"), "field")))
    fields = ("item_name", "quantity", "line_amount")
    first = lambda df: evaluate.first_items(df, fields)
    machine, right, names = v.select("voucher_id", F.col("wrong").alias("items")), first(v), tuple(f"item_{f}" for f in fields)
    before, after = (evaluate.field_accuracy(first(x), right, names) for x in (machine, context.learned_items(machine, model)))
    return before.select("field", "n", F.col("accuracy").alias("before")).join(after.select("field", F.col("accuracy").alias("after")), "field")


# --- cases of single rules, dealt to vouchers by number ----------------------------------------------------------------


def _spelled(case: str, spark: bool):
    """A case's text for a voucher, {n} its number and {s} its supplier: a column, or SQL."""
    pieces = [{"{n}": "voucher_number", "{s}": "supplier_name"}.get(x, x) if i % 2 else x for i, x in enumerate(re.split(r"(\{[ns]\})", case))]
    if spark:
        return F.concat(*[F.col(x) if i % 2 else F.lit(x) for i, x in enumerate(pieces)])
    return " || ".join(x if i % 2 else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for i, x in enumerate(pieces))


def dealt(spark, sf_dir, cases, f) -> DataFrame:
    """(voucher_id, shown): each voucher with f of one of the cases' texts."""
    k = F.col("voucher_id") % len(cases)
    value = F.element_at(F.array(*[_spelled(c, True) for c, _ in cases]), (k + 1).cast("int"))
    return vo.truth(spark, sf_dir).select("voucher_id", value.alias("value")).select("voucher_id", f(F.col("value")).alias("shown"))


def dealt_sql(cases) -> str:
    return f"SELECT voucher_id, [{', '.join(_spelled(want, False) for _, want in cases)}][1 + (voucher_id % {len(cases)})::INT] AS shown FROM ({HEADS})"


STEPS = {
    "global": (text.fix_global, (("6rand Total {n}", "GrandTotal {n}"), ("1essForDam {n}", "LessForDam {n}"), ("Un1oading 5", "UnLoading 5"), ("on 0570372024", "on 05/03/2024"), ("1YFAndCash 7", "L/FAndCash 7"))),
    "terms": (text.fix_terms, (("Vouch3r No", "Voucher No"), ("SuppNane {s}", "Supp Name {s}"), ("Dat3 1/2", "Date 1/2"), ("GrandTotal", "Grand Total"), ("Tota {n}", "Tota {n}"), ("Tota 12", "Total 12"), ("LessForDamnages x", "Less For Damages x"))),
    "early_numbers": (text.tag_early_numbers, (("No {n}\nx 12\n{n} and 5", "No VoucherNumber{n}\nx 12\nVoucherNumber{n} and 5"), ("Date 01/02/2024 {n}", "Date 01/02/2024 {n}"), ("a\nb\nc\n{n}", "a\nb\nc\n{n}"))),
    "labels": (text.fix_labels, (("Vouch3rNumb3r 5", "VoucherNumber 5"), ("Youch3r {n}", "Voucher {n}"), ("Youch3rDat3 x", "VoucherDat3 x"), ("vouch3r", "Voucher"))),
    "voucher_numbers": (text.tag_voucher_numbers, (("Voucher No {n}", "Voucher No VoucherNumber{n}"), ("Number {n} 4567", "Number VoucherNumber{n} VoucherNumber4567"), ("Sum {n}", "Sum {n}"), ("Voucher {n}\nagain {n}", "Voucher VoucherNumber{n}\nagain VoucherNumber{n}"))),
    "digits": (text.fix_digits, (("Amt 1O.5O", "Amt 10.50"), ("Date 1O", "Date 1O"), ("B7 x B", "87 x 8"), ("{s}", "{s}"), ("$4 and 2Z", "54 and 22"))),
    "amounts": (text.fix_amounts, (("Total {n}", "Total {n}.00"), ("x 12300", "x 123.00"), ("Cash 12300", "Cash 12300.00"), ("Qty {n}", "Qty {n}"), ("Comm 7.5", "Comm 7.5"))),
    "decimals": (text.fix_decimals, (("12on", "12.00"), ("45h", "45.00"), ("77do", "77.00"), ("8. x", "8.00 x"), ("x 1234 y", "x 1234.00 y"), ("podon", "50.00"))),
    "all_decimals": (text.correct_decimals, (("Total {n}on", "Total {n}.00"), ("a  b\n\n45h", "a b\n45.00"), ("-   5", "- 5"), ("  {s}  ", "{s}"))),
    "chain": (None, (("SuppNane   {s}", "Supp Name {s}"), ("Cash  {n}", "Cash VoucherNumber{n}"), ("Vouch3r  Numb3r : {n}", "Voucher Numb3r: VoucherNumber{n}"), ("a\nb\nc\nCash  {n}", "a\nb\nc\nCash {n}.00"))),
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS step, voucher_id, shown FROM ({dealt_sql(cases)})" for name, (_, cases) in STEPS.items()))
def correction_steps(spark, sf_dir):
    """Each step of the correction chains, and one chain as a whole, on its own misreads."""
    rows = []
    for name, (step, cases) in STEPS.items():
        made = dealt(spark, sf_dir, cases, step) if step else text.correct_text(dealt(spark, sf_dir, cases, lambda c: c), "shown")
        rows.append(made.select(F.lit(name).alias("step"), "voucher_id", "shown"))
    return reduce(DataFrame.unionByName, rows)


#: What stands in the texts, and the confidences (number, date, supplier, amounts) of it before attempts add to them.
SHOWN = {"whole": (75, 75, 70, 80), "some": (60, 65, 50, 50), "few": (50, 50, 70, 65), "empty": (50, 50, 50, 50), "null": (50, 50, 50, 50)}
BONUS_SQL = "CASE WHEN tries > 1 THEN least(20, tries * 5) ELSE 0 END"
CONFIDENCE_SQL = ", ".join(f"CAST(least(95, [{', '.join(str(c[i]) for c in SHOWN.values())}][1 + voucher_id % 5] + {BONUS_SQL}) AS INT) AS {f}" for i, f in enumerate(("voucher_number", "date", "supplier", "amounts")))


@query(f"SELECT voucher_id, {CONFIDENCE_SQL}, CAST(50 + {BONUS_SQL} AS INT) AS items FROM (SELECT voucher_id, 1 + voucher_id % 7 AS tries FROM ({HEADS}))")
def field_confidence_cases(spark, sf_dir):
    """Confidence of fields by what a text shows, over whole, cut, empty and null texts and one to seven attempts."""
    t = F.col("raw_ocr_text")
    some = F.concat(F.lit("Sum "), F.regexp_extract(t, r"Number (\d+)", 1), F.lit("\nDate due"))
    few = F.concat(F.regexp_extract(t, r"Supp Name \S+", 0), F.lit("\n"), F.regexp_extract(t, r"Comm (\d+\.\d+)", 1))
    k = F.col("voucher_id")
    shown = F.element_at(F.array(t, some, few, F.lit(""), F.lit(None).cast("string")), (k % 5 + 1).cast("int"))
    c = attempts.field_confidence(shown, (k % 7 + 1).cast("int"))
    return vo.rendered(spark, sf_dir).withColumn("c", c).select("voucher_id", *[F.col(f"c.{f}").alias(f) for f in ("voucher_number", "date", "supplier", "amounts", "items")])


RULES = {
    "voucher_number": (("{n}", ""), ("7", "Too short (minimum 2 digits);Value looks like a day/month"), ("123456", "Too long (maximum 5 digits);Outside reasonable voucher number range"), ("2024", "Value is a year (2020-2030), not a voucher number"), ("12", "Value looks like a day/month"), ("12a", "Must be numeric"), ("", "Empty value")),
    "voucher_date": (("2024-03-05", ""), ("2019-01-01", "Year outside reasonable range (2020-2030)"), ("2025-12-31", "Date is in the future"), ("2031-01-01", "Year outside reasonable range (2020-2030);Date is in the future"), ("{s}", "Invalid date format"), ("", "Empty value")),
    "supplier_name": (("{s}", ""), ("A", "Too short (minimum 2 characters)"), ("N" * 51, "Too long (maximum 50 characters)"), ("{n}", "Cannot be purely numeric;Must contain at least one letter"), ("--", "Must contain at least one letter"), ("Grand {s}", "Contains non-supplier keywords"), ("", "Empty value")),
    "net_total": (("{n}.50", ""), ("-5", "Cannot be negative;Too small (minimum 0.01)"), ("0.001", "Too small (minimum 0.01);Too many decimal places"), ("100000.01", "Too large (maximum 100000)"), ("{n}.125", "Too many decimal places"), ("", "Empty value")),
}


@query(" UNION ALL ".join(f"SELECT '{field}' AS field, voucher_id, shown FROM ({dealt_sql(cases)})" for field, cases in RULES.items()))
def rule_cases(spark, sf_dir):
    """Every rule of numbers, dates, suppliers and amounts, as of a fixed day."""
    rows = [dealt(spark, sf_dir, cases, lambda c, field=field: F.array_join(validate.field_errors(field, c, "2025-06-30"), ";")).select(F.lit(field).alias("field"), "voucher_id", "shown") for field, cases in RULES.items()]
    return reduce(DataFrame.unionByName, rows)


AMOUNTS = (("Sum 1,234.56", "1234.56;1.00;234.56"), ("x 12345.67 y", "12345.67;12345.67;12345.67"), ("7.50", "7.50"), ("0.00", ""), ("{s}", ""), ("No {n}.25", "{n}.25"))


@query(dealt_sql(AMOUNTS))
def amount_forms(spark, sf_dir):
    """Amounts with a mark of thousands, of five digits, small ones, none; by all three patterns."""
    return dealt(spark, sf_dir, AMOUNTS, lambda c: F.array_join(F.transform(text.amounts(c), lambda a: a.cast("string")), ";"))


@query(" UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, md5(regexp_replace(text, '[^{allowed}]', '', 'g')) AS digest FROM documents" for kind, allowed in text.ALLOWED.items()))
def only_kinds(spark, sf_dir):
    """What each of the six kinds of fields leaves of every document."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d.select("doc_id", F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.md5(text.only(F.col("text"), kind)).alias("digest")) for kind in text.ALLOWED])))
