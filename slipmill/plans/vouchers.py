"""Vouchers with known answers, rendered from orders, lineitem and supplier by DataFrame code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The same derivation as SQL, for tests and for comparison: what the rendered text says.
ITEMS_SQL = """
SELECT l_orderkey AS voucher_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, 1 + l_partkey % 9 AS quantity,
       CAST((10000 + (l_partkey * 37 + l_suppkey * 11 + l_linenumber * 7) % 90000) / 100.0 AS DECIMAL(12,2)) AS unit_price,
       CAST((1 + l_partkey % 9) * (10000 + (l_partkey * 37 + l_suppkey * 11 + l_linenumber * 7) % 90000) / 100.0 AS DECIMAL(12,2)) AS line_amount
FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL AND l_linenumber IS NOT NULL"""
HEADS_SQL = f"""
SELECT voucher_id, CAST(100 + voucher_id % 900 AS VARCHAR) AS voucher_number,
       CAST(CAST(2020 + voucher_id % 6 AS VARCHAR) || '-' || lpad(CAST(1 + voucher_id % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + voucher_id % 28 AS VARCHAR), 2, '0') AS DATE) AS voucher_date,
       'RAVI' || translate(CAST(min(supp) AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || '/K' AS supplier_name,
       CAST(sum(line_amount) AS DECIMAL(12,2)) AS gross_total, count(*) AS n_items,
       CAST((1005 + 10 * (voucher_id % 90)) / 100.0 AS DECIMAL(12,2)) AS commission, CAST((2505 + 10 * (voucher_id % 70)) / 100.0 AS DECIMAL(12,2)) AS damages,
       CAST((1007 + 10 * (voucher_id % 50)) / 100.0 AS DECIMAL(12,2)) AS unloading, CAST((2009 + 10 * (voucher_id % 30)) / 100.0 AS DECIMAL(12,2)) AS cash
FROM ({ITEMS_SQL}) GROUP BY voucher_id"""

#: Misreads by the voucher's key mod 6: what stands in the place of what; key 0 is clean.
MISREADS = {1: (("Supp Name", "SuppNane"),), 2: (("Grand Total", "6rand Total"), ("UnLoading", "Un1oading")), 3: (("LessForDam", "1essForDam"),), 4: (("L/FAndCash", "1YFAndCash"),), 5: (("Voucher Number", "Voucher Nunber"),)}

TEXT_SQL = f"""
SELECT h.*, concat_ws(chr(10), 'SHARMA TRADING MARKET', 'Voucher Number ' || voucher_number, 'WHOLESALE FRUIT PURCHASER', 'Voucher Date ' || strftime(voucher_date, '%d/%m/%Y'),
       'Supp Name ' || supplier_name, 'Qty Price Amount', shown, 'Total ' || n_items || ' ' || gross_total, '(-) Comm ' || commission, '(-) LessForDamages ' || damages,
       '(-) UnLoading ' || unloading, '(-) L/FAndCash ' || cash, 'Grand Total ' || CAST(gross_total - commission - damages - unloading - cash AS DECIMAL(12,2))) AS text
FROM ({HEADS_SQL}) h JOIN (SELECT voucher_id, string_agg(quantity || ' ' || unit_price || ' ' || line_amount, chr(10) ORDER BY line, part, supp) AS shown FROM ({ITEMS_SQL}) GROUP BY voucher_id) USING (voucher_id)"""
NOISY_SQL = f"SELECT * REPLACE (CASE voucher_id % 6 {{}} ELSE text END AS text) FROM ({TEXT_SQL})"
for _key, _fixes in MISREADS.items():
    _made = "text"
    for _old, _new in _fixes:
        _made = f"replace({_made}, '{_old}', '{_new}')"
    NOISY_SQL = NOISY_SQL.replace("{}", f"WHEN {_key} THEN {_made} {{}}")
NOISY_SQL = NOISY_SQL.replace("{}", "")


def _cents(c: Column) -> Column:
    return (c / 100).cast("decimal(12,2)")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(voucher_id, line, part, supp, quantity, unit_price, line_amount): a row per line item."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").dropna()
    price = 10000 + (F.col("l_partkey") * 37 + F.col("l_suppkey") * 11 + F.col("l_linenumber") * 7) % 90000
    quantity = 1 + F.col("l_partkey") % 9
    return li.select(
        F.col("l_orderkey").alias("voucher_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        quantity.alias("quantity"), _cents(price).alias("unit_price"), _cents(quantity * price).alias("line_amount"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per voucher: what its text says, with the items in their order."""
    k = F.col("voucher_id")
    # Dealt here by number: groups are small and what follows is work on each, so partitions aren't to be merged by size.
    dealt = items(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "voucher_id")
    rows = dealt.groupBy("voucher_id").agg(
        F.sort_array(F.collect_list(F.struct("line", "part", "supp", "quantity", "unit_price", "line_amount"))).alias("items"), F.min("supp").alias("supp"), F.sum("line_amount").cast("decimal(12,2)").alias("gross_total")
    )
    return rows.select(
        "voucher_id", (100 + k % 900).cast("string").alias("voucher_number"), F.make_date(2020 + k % 6, 1 + k % 12, 1 + k % 28).alias("voucher_date"),
        F.concat(F.lit("RAVI"), F.translate(F.col("supp").cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit("/K")).alias("supplier_name"), "items", "gross_total",
        _cents(1005 + 10 * (k % 90)).alias("commission"), _cents(2505 + 10 * (k % 70)).alias("damages"), _cents(1007 + 10 * (k % 50)).alias("unloading"), _cents(2009 + 10 * (k % 30)).alias("cash"),
    )


def rendered(spark: SparkSession, sf_dir: str, noisy: bool = False) -> DataFrame:
    """(voucher_id, batch_id, created_at, raw_ocr_text) of every voucher; misread by MISREADS if noisy."""
    t = truth(spark, sf_dir)
    net = F.col("gross_total") - F.col("commission") - F.col("damages") - F.col("unloading") - F.col("cash")
    item = F.transform("items", lambda x: F.concat_ws(" ", x["quantity"].cast("string"), x["unit_price"].cast("string"), x["line_amount"].cast("string")))
    text = F.concat_ws(
        "\n", F.lit("SHARMA TRADING MARKET"), F.concat(F.lit("Voucher Number "), F.col("voucher_number")), F.lit("WHOLESALE FRUIT PURCHASER"),
        F.concat(F.lit("Voucher Date "), F.date_format("voucher_date", "dd/MM/yyyy")), F.concat(F.lit("Supp Name "), F.col("supplier_name")), F.lit("Qty Price Amount"), item,
        F.concat_ws(" ", F.lit("Total"), F.size("items").cast("string"), F.col("gross_total").cast("string")),
        *[F.concat_ws(" ", F.lit(f"(-) {label}"), F.col(c).cast("string")) for label, c in (("Comm", "commission"), ("LessForDamages", "damages"), ("UnLoading", "unloading"), ("L/FAndCash", "cash"))],
        F.concat_ws(" ", F.lit("Grand Total"), net.cast("decimal(12,2)").cast("string")),
    )
    if noisy:
        for key, fixes in MISREADS.items():
            for old, new in fixes:
                text = F.when(F.col("voucher_id") % 6 == key, F.replace(text, F.lit(old), F.lit(new))).otherwise(text)
    k = F.col("voucher_id")
    return t.select("voucher_id", F.concat(F.lit("B"), (k % 40).cast("string")).alias("batch_id"), F.timestamp_seconds(1_700_000_000 + k * 60).cast("timestamp_ntz").alias("created_at"), text.alias("raw_ocr_text"))
