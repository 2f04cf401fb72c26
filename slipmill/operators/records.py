"""Vouchers as records: a master table with its items and deductions, written, replaced, looked up and listed together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmill.sources.snapshots import Snapshots

CHILDREN = {"items": ("item_name", "quantity", "unit_price", "line_amount"), "deductions": ("deduction_type", "amount")}
HEADER = ("voucher_number", "voucher_date", "supplier_name", "vendor_details", "gross_total", "total_deductions", "net_total")


def voucher_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """master, items and deductions of parsed vouchers (arrays items and deductions); children keep their order in `position`."""
    out = {"master": parsed.drop(*CHILDREN)}
    for name, fields in CHILDREN.items():
        rows = parsed.select("voucher_id", F.posexplode(name).alias("position", "c"))
        out[name] = rows.select("voucher_id", "position", *[F.col(f"c.{f}").alias(f) for f in fields])
    return out


def write_vouchers(parsed: DataFrame, store: Snapshots, source: str | None = None, batch: int | None = None) -> int:
    """Commits the three tables as one: each voucher takes the place of the one of its id, children too.

    What was extracted is computed once for all three. A batch that a source has committed before changes nothing.
    """
    if source is not None and batch <= store.applied(source):
        return store.manifest()["version"]
    held = parsed.persist()
    try:
        return store.commit(voucher_tables(held), source, batch)
    finally:
        held.unpersist()


def one_per_id(parsed: DataFrame) -> DataFrame:
    """One row of each voucher_id, where some came twice: the latest by created_at if there is one, then the greatest text."""
    order = [c for c in ("created_at", "raw_ocr_text") if c in parsed.columns]
    if not order:
        return parsed.dropDuplicates(["voucher_id"])
    best = parsed.groupBy("voucher_id").agg(F.max_by(F.struct(*[c for c in parsed.columns if c != "voucher_id"]), F.struct(*order)).alias("_r"))
    return best.select("voucher_id", "_r.*").select(*parsed.columns)


def replace_parse(tables: dict[str, DataFrame], parsed: DataFrame) -> dict[str, DataFrame]:
    """The tables with parsed vouchers in the place of those of the same id, children too; doing it twice is doing it once."""
    new, ids = voucher_tables(parsed), parsed.select("voucher_id").distinct()
    return {name: table.join(ids, "voucher_id", "left_anti").unionByName(new[name].select(table.columns)) for name, table in tables.items()}


def reprocess(tables: dict[str, DataFrame], texts: DataFrame, batch_id: str, extract: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """The tables with the vouchers of one batch extracted anew from their texts (voucher_id, batch_id, raw_ocr_text)."""
    made = extract(texts.where(F.col("batch_id") == batch_id))
    return replace_parse(tables, made.select(*tables["master"].columns, *CHILDREN))


def reprocess_in_store(store: Snapshots, texts: DataFrame, batch_id: str, extract: Callable[[DataFrame], DataFrame]) -> int:
    """Extracts one batch's vouchers anew from their texts (voucher_id, batch_id, raw_ocr_text) and commits them in their place.

    Give an `extract` that applies what was learned to have it in the tables. Columns that the store's master lacks aren't
    written; those that extraction doesn't give are kept from the voucher as it was.
    """
    master = store.read()["master"]
    made = extract(texts.where(F.col("batch_id") == batch_id))
    kept = [c for c in master.columns if c not in made.columns]
    if kept:
        made = made.join(master.where(F.col("batch_id") == batch_id).select("voucher_id", *kept), "voucher_id", "left")
    return write_vouchers(made.select(*master.columns, *CHILDREN), store)


def validated_vouchers(vouchers: DataFrame, limit: int | None = None) -> DataFrame:
    """Vouchers to learn from: validated, with the first machine output kept; the newest `limit`, ties by id."""
    ok = vouchers.where("status = 'VALIDATED' AND original IS NOT NULL")
    return ok if limit is None else ok.orderBy(F.col("created_at").desc(), F.col("voucher_id").desc()).limit(limit)


def backfill_original(vouchers: DataFrame) -> DataFrame:
    """vouchers whose missing `original` is what was parsed."""
    return vouchers.withColumn("original", F.coalesce("original", "parsed"))


def voucher_by_id(tables: dict[str, DataFrame], voucher_id: int) -> DataFrame:
    """The master row of a voucher with its children as arrays in their order, empty where it has none."""
    key = F.col("voucher_id") == voucher_id
    out = tables["master"].where(key)
    for name, fields in CHILDREN.items():
        rows = tables[name].where(key).groupBy("voucher_id").agg(F.array_sort(F.collect_list(F.struct("position", *fields))).alias(name))
        out = out.join(rows, "voucher_id", "left")
    return out.withColumns({name: F.coalesce(name, F.array()) for name in CHILDREN})


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def kept_deductions(deductions: Column) -> Column:
    """Deductions with a type or an amount."""
    return F.filter(deductions, lambda d: (_text(d["deduction_type"]) != "") | (F.coalesce(d["amount"], F.lit(0)) != 0))


def nonempty(rows: Column, name: str, amount: str) -> Column:
    """Rows of an edited list that have a name, or an amount above 0."""
    return F.filter(rows, lambda r: (_text(r[name]) != "") | (F.coalesce(r[amount], F.lit(0)) > 0))


def total(rows: Column, field: str) -> Column:
    return F.aggregate(rows, F.lit(0).cast("decimal(18,2)"), lambda acc, r: (acc + F.coalesce(r[field], F.lit(0))).cast("decimal(18,2)")).cast("decimal(12,2)")


def validated_totals(items: Column, deductions: Column) -> dict[str, Column]:
    """gross_total, total_deductions and net_total of validated lists."""
    gross, less = total(items, "line_amount"), total(deductions, "amount")
    return {"gross_total": gross, "total_deductions": less, "net_total": (gross - less).cast("decimal(12,2)")}


def shown(vouchers: DataFrame) -> DataFrame:
    """vouchers as a page shows them: the parsed header else the columns; parsed items and deductions unless empty, else the stored ones.

    Columns: parsed (a struct with master, items, deductions, or null), the header's columns, stored_items, stored_deductions.
    """
    whole = F.col("parsed.master").isNotNull()
    fields = [c for c in HEADER if c in vouchers.columns]
    pick = lambda name: F.when(F.size(f"parsed.{name}") > 0, F.col(f"parsed.{name}")).otherwise(F.coalesce(f"stored_{name}", F.array()))
    return vouchers.select("voucher_id", *[F.when(whole, F.col(f"parsed.master.{c}")).otherwise(F.col(c)).alias(c) for c in fields], *[pick(name).alias(name) for name in CHILDREN])


def page_count(rows: DataFrame, size: int) -> DataFrame:
    """One row: how many rows, and how many pages of `size`."""
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def suppliers_in_batch(vouchers: DataFrame, batch_id: str) -> DataFrame:
    """(supplier_name, n) of a batch; vouchers without a supplier are a group of their own."""
    return vouchers.where(F.col("batch_id") == batch_id).groupBy("supplier_name").agg(F.count("*").alias("n"))


def supplier_history(receipts: DataFrame, supplier: str) -> DataFrame:
    """A supplier's receipts, latest date first and those without a date last; then by creation and id."""
    return receipts.where(F.col("supplier_name") == supplier).orderBy(F.col("receipt_date").desc_nulls_last(), F.col("created_at").desc(), F.col("ocr_voucher_id").desc())


def all_suppliers(suppliers: DataFrame, receipts: DataFrame) -> DataFrame:
    """(supplier_name, n_receipts, total_spend) of every supplier, those without receipts too."""
    spent = receipts.groupBy("supplier_name").agg(F.count("*").alias("n_receipts"), F.sum("net_total").alias("total_spend"))
    out = suppliers.join(spent, "supplier_name", "left")
    return out.select("supplier_name", F.coalesce("n_receipts", F.lit(0)).cast("long").alias("n_receipts"), F.coalesce("total_spend", F.lit(0)).cast("decimal(18,2)").alias("total_spend"))


def with_files(vouchers: DataFrame, files: DataFrame, batch_id: str) -> DataFrame:
    """The vouchers of a batch with what is tracked of their files (voucher_id, ocr_output, file_path), if anything is."""
    return vouchers.where(F.col("batch_id") == batch_id).join(files.select("voucher_id", "ocr_output", "file_path"), "voucher_id", "left")


def n_found(fields: tuple[str, ...] = HEADER) -> Column:
    """How many of the fields aren't null."""
    return sum((F.col(f).isNotNull().cast("long") for f in fields), F.lit(0).cast("long"))
