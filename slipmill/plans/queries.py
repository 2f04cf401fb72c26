"""One query per operator or group of operators, over vouchers rendered from the tables, and the SQL for each."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipmill.functions import fuzzy, text, values
from slipmill.operators import attempts, backup, context, evaluate, extract, history, learn, profiles, publish, ranking, robust, validate
from slipmill.plans import vouchers as vo
from slipmill.sources.folders import written
from slipmill.streaming import streams

HEADS, ITEMS = vo.HEADS_SQL, vo.ITEMS_SQL
NET = "CAST(gross_total - commission - damages - unloading - cash AS DECIMAL(12,2))"
ALL_DEDUCTIONS = "CAST(commission + damages + unloading + cash AS DECIMAL(12,2))"
HEAD_FIELDS = ("voucher_number", "voucher_date", "supplier_name", "gross_total", "total_deductions", "net_total")
FIELDS_SQL = f"SELECT voucher_id, voucher_number, voucher_date, supplier_name, gross_total, {ALL_DEDUCTIONS} AS total_deductions, {NET} AS net_total FROM ({HEADS})"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def parsed(spark: SparkSession, sf_dir: str, noisy: bool = False) -> DataFrame:
    return extract.extract_v2(vo.rendered(spark, sf_dir, noisy))


# --- extraction ------------------------------------------------------------------------------------------------


@query(FIELDS_SQL)
def v2_fields(spark, sf_dir):
    return parsed(spark, sf_dir).select("voucher_id", *HEAD_FIELDS)


@query(FIELDS_SQL)
def v2_noisy_fields(spark, sf_dir):
    return parsed(spark, sf_dir, noisy=True).select("voucher_id", *HEAD_FIELDS)


@query(f"SELECT voucher_id, 'Item' AS item_name, CAST(quantity AS DECIMAL(10,2)) AS quantity, CAST(unit_price AS DECIMAL(10,2)) AS unit_price, line_amount FROM ({ITEMS})")
def v2_items(spark, sf_dir):
    return text.unnested(parsed(spark, sf_dir), "items")


@query(" UNION ALL ".join(f"SELECT voucher_id, '{kind}' AS deduction_type, {c} AS amount FROM ({HEADS})" for kind, c in (("Commission", "commission"), ("Damage", "damages"), ("Unloading", "unloading"), ("L/F Cash", "cash"))))
def v2_deductions(spark, sf_dir):
    return text.unnested(parsed(spark, sf_dir), "deductions")


@query(f"SELECT voucher_id, CAST(83.0 AS DOUBLE) AS overall, CAST(90 AS INT) AS net_confidence, CAST(least(90, n_items * 25) AS INT) AS items_confidence FROM ({HEADS})")
def v2_confidence(spark, sf_dir):
    return parsed(spark, sf_dir).select("voucher_id", "overall", F.col("confidence.net_total").alias("net_confidence"), F.col("confidence.items").alias("items_confidence"))


@query(" UNION ALL ".join(f"SELECT voucher_id, '{f}' AS field, CAST({f} AS VARCHAR) AS value, CAST({c} AS INT) AS confidence, 'high' AS status, '{s}' AS strategy FROM ({HEADS})" for f, c, s in (("voucher_number", 100, "VoucherNumber label"), ("voucher_date", 100, "VoucherDate label"), ("supplier_name", 95, "Supp Name label"), ("gross_total", 100, "Total line pattern"))))
def quality_fields(spark, sf_dir):
    return extract.best_candidates(extract.candidates(vo.rendered(spark, sf_dir))).select("voucher_id", "field", "value", "confidence", "status", "strategy")


@query(f"SELECT voucher_id, CAST(98 AS BIGINT) AS overall, false AS requires_review FROM ({HEADS})")
def quality_overall(spark, sf_dir):
    return validate.voucher_quality(extract.best_candidates(extract.candidates(vo.rendered(spark, sf_dir))))


@query(" UNION ALL ".join(f"SELECT voucher_id, '{kind}' AS deduction_type, {c} AS amount FROM ({HEADS})" for kind, c in (("Commission", "commission"), ("Less for Damages", "damages"), ("Unloading", "unloading"), ("L/F Cash", "cash"))))
def quality_deductions(spark, sf_dir):
    v = vo.rendered(spark, sf_dir)
    return v.select("voucher_id", F.inline(extract.quality_deductions(F.col("raw_ocr_text"), extract.largest_amount(F.col("raw_ocr_text")))))


@query(f"SELECT voucher_id, CAST(count(*) AS BIGINT) AS n_items, CAST(sum(line_amount) AS DECIMAL(12,2)) AS total FROM ({ITEMS}) GROUP BY voucher_id")
def quality_items(spark, sf_dir):
    v = vo.rendered(spark, sf_dir).withColumn("i", extract.quality_items(text.lines(F.col("raw_ocr_text"))))
    return v.select("voucher_id", F.size("i").cast("long").alias("n_items"), F.aggregate("i", F.lit(0).cast("decimal(12,2)"), lambda a, x: (a + x["line_amount"]).cast("decimal(12,2)")).alias("total"))


_PLACED = f"SELECT *, row_number() OVER (PARTITION BY voucher_id ORDER BY line, part, supp) AS place FROM ({ITEMS})"


@query(f"SELECT voucher_id, CASE WHEN voucher_id % 5 IN (1, 2) THEN 'Mango' WHEN voucher_id % 5 = 4 THEN CASE WHEN place = 1 THEN 'Qty Price Amount' ELSE 'Item ' || CAST(place AS VARCHAR) END ELSE 'Item ' || CAST(place AS VARCHAR) END AS item_name, CAST(quantity AS DECIMAL(10,2)) AS quantity, CAST(unit_price AS DECIMAL(10,2)) AS unit_price, line_amount FROM ({_PLACED})")
def quality_item_forms(spark, sf_dir):
    """Items without names, with names, reversed, without a heading, and with marks in place of a name."""
    t, key = F.col("raw_ocr_text"), F.col("voucher_id") % 5
    line = r"(?m)^(\d+) (\d+\.\d{2}) (\d+\.\d{2})$"
    forms = F.when(key == 1, F.regexp_replace(t, line, "Mango $1 $2 $3")).when(key == 2, F.regexp_replace(t, line, "Mango $3 $2 $1")).when(key == 3, F.replace(t, F.lit("Qty Price Amount"), F.lit("Goods"))).when(key == 4, F.regexp_replace(t, line, "* $1 $2 $3")).otherwise(t)
    return vo.rendered(spark, sf_dir).select("voucher_id", F.inline(extract.quality_items(text.lines(forms))))


_CALLED = f"SELECT voucher_id, n_items, voucher_id % 4 AS form, CAST('9' || CAST({NET} AS VARCHAR) AS DECIMAL(14,2)) > 100000 AS too_large FROM ({HEADS})"


@query(f"""SELECT voucher_id, CAST(CASE form WHEN 1 THEN 86 WHEN 2 THEN CASE WHEN too_large THEN 83 ELSE 91 END WHEN 3 THEN 84 ELSE 91 END AS BIGINT) AS overall, true AS requires_review,
 CASE WHEN form = 1 THEN 'medium' ELSE 'high' END AS number_status, CASE WHEN form = 3 THEN 'medium' ELSE 'high' END AS supplier_status, CASE WHEN form = 2 THEN 'validation_failed' ELSE 'medium' END AS net_status,
 CASE WHEN form = 2 THEN '[X] Validation failed: Net > Gross - verify deductions' ELSE '[WARN] Verify this field' END AS net_advice, n_items, CAST(4 AS BIGINT) AS n_deductions FROM ({_CALLED})""")
def quality_vouchers(spark, sf_dir):
    """All of profile quality in one call; by form a number without its label, a net total above gross, no supplier line."""
    t, key = F.col("raw_ocr_text"), F.col("voucher_id") % 4
    forms = F.when(key == 1, F.replace(t, F.lit("Voucher Number "), F.lit(""))).when(key == 2, F.replace(t, F.lit("Grand Total "), F.lit("Grand Total 9"))).when(key == 3, F.regexp_replace(t, r"(?m)^Supp Name .*\n", "")).otherwise(t)
    v = extract.extract_quality(vo.rendered(spark, sf_dir).withColumn("raw_ocr_text", forms), extended=True)
    of = lambda f, part: F.col("fields")[f][part]
    return v.select(
        "voucher_id", "overall", "requires_review", of("voucher_number", "status").alias("number_status"), of("supplier_name", "status").alias("supplier_status"), of("net_total", "status").alias("net_status"),
        of("net_total", "recommendation").alias("net_advice"), F.size("items").cast("long").alias("n_items"), F.size("deductions").cast("long").alias("n_deductions"),
    )


# --- text and values -------------------------------------------------------------------------------------------


def _docs(spark, sf_dir, f) -> DataFrame:
    out = f(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.length(out).cast("long").alias("n"), F.md5(out).alias("digest"))


def _docs_sql(expr: str) -> str:
    return f"SELECT doc_id, CAST(length(x) AS BIGINT) AS n, md5(x) AS digest FROM (SELECT doc_id, {expr} AS x FROM documents)"


@query(_docs_sql(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\s*([:,])\s*', '\1 ', 'g'), ' *\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')"))
def clean_blanks(spark, sf_dir):
    return _docs(spark, sf_dir, text.clean_blanks)


@query(_docs_sql(r"regexp_replace(regexp_replace(text, '[^\x20-\x7E\n]', '', 'g'), '[ \t]+', ' ', 'g')"))
def keep_ascii(spark, sf_dir):
    return _docs(spark, sf_dir, text.keep_ascii)


@query(_docs_sql(r"regexp_replace(regexp_replace(regexp_replace(text, '(\d)[Oo](\d)', '\g<1>0\2', 'g'), '(\d)[Ss](\d)', '\g<1>5\2', 'g'), '(\d)[lI](\d)', '\g<1>1\2', 'g')".replace(r"\g<1>", r"\1")))
def letters_between_digits(spark, sf_dir):
    return _docs(spark, sf_dir, text.letters_between_digits)


@query(_docs_sql("regexp_replace(text, '[^A-Za-z0-9 .,:/()@%&-]', '', 'g')"))
def only_general(spark, sf_dir):
    return _docs(spark, sf_dir, lambda c: text.only(c, "general"))


@query(r"SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n')) AS x FROM documents) WHERE regexp_matches(x, '[^\s]') GROUP BY doc_id")
def document_lines(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.size(text.lines(F.col("text"))).cast("long").alias("n_lines")).where("n_lines > 0")


# What the chains give on these texts: labels in front of standalone numbers (the voucher's own one wherever it stands, then
# all in lines with a label), and cents for the last total's digits but one, where it has four or more before the point.
LAST_TOTAL = r"regexp_replace({}, 'Total (\d{{3,}})(\d\.\d\d)$', 'Total \1.00\2')"
TERMS_SQL = f"SELECT voucher_id, voucher_number, replace(replace(text, 'SuppNane', 'Supp Name'), ' LessForDamages', ' Less For Damages') AS text FROM ({vo.NOISY_SQL})"
TERMS_SQL = rf"SELECT voucher_id, string_split(regexp_replace(text, '\b' || voucher_number || '\b', 'VoucherNumber' || voucher_number, 'g'), chr(10)) AS l FROM ({TERMS_SQL})"
TERMS_SQL = rf"SELECT voucher_id, array_to_string([CASE WHEN contains(x, 'Voucher') THEN regexp_replace(x, '\b(\d{{3,}})\b', 'VoucherNumber\1', 'g') ELSE x END FOR x IN l], chr(10)) AS text FROM ({TERMS_SQL})"
TERMS_SQL = f"SELECT voucher_id, {LAST_TOTAL.format('text')} AS text FROM ({TERMS_SQL})"


@query(f"SELECT voucher_id, md5(text) AS digest, length(text) AS n FROM ({TERMS_SQL})")
def corrected_terms(spark, sf_dir):
    return text.correct_text(vo.rendered(spark, sf_dir, noisy=True)).select("voucher_id", F.md5("raw_ocr_text").alias("digest"), F.length("raw_ocr_text").cast("long").alias("n"))


@query(f"SELECT voucher_id, md5({LAST_TOTAL.format('text')}) AS digest FROM ({vo.NOISY_SQL})")
def corrected_decimals(spark, sf_dir):
    return vo.rendered(spark, sf_dir, noisy=True).select("voucher_id", F.md5(text.correct_decimals(F.col("raw_ocr_text"))).alias("digest"))


@query(f"SELECT voucher_id, CAST(n_items + 7 AS BIGINT) AS n_amount_lines FROM ({HEADS})")
def amount_lines(spark, sf_dir):
    v = vo.rendered(spark, sf_dir)
    plain = F.filter(text.lines(F.col("raw_ocr_text")), lambda x: text.is_amount_line(x) & ~x.rlike("(?i)voucher|supp"))
    return v.select("voucher_id", F.size(plain).cast("long").alias("n_amount_lines"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,4)) AS value FROM lineitem")
def grouped_numbers(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shown = F.concat(F.lit("Rs "), F.format_number("l_extendedprice", 2))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values.grouped_number(shown).alias("value"))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) % 10 = 9 THEN NULL ELSE CAST(CAST(2020 + year(o_orderdate) % 10 AS VARCHAR) || strftime(o_orderdate, '-%m-') || lpad(CAST(least(28, day(o_orderdate)) AS VARCHAR), 2, '0') AS DATE) END AS d FROM orders")
def calendar_dates(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    y = F.year("o_orderdate") % 10
    sep = F.element_at(F.array(F.lit("/"), F.lit("-"), F.lit(".")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    shown = F.concat_ws("", F.least(F.lit(28), F.day("o_orderdate")), sep, F.month("o_orderdate"), sep, F.when(y == 9, 1999).otherwise(2020 + y))
    return o.select("o_orderkey", values.calendar_date(shown).alias("d"))


# --- validation ------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(CASE WHEN v < 10 THEN 2 WHEN v <= 31 OR v BETWEEN 2020 AND 2030 OR v > 99999 THEN 1 ELSE 0 END + CASE WHEN v = 0 THEN 0 WHEN v > 99999 THEN 1 ELSE 0 END AS BIGINT) AS n_errors FROM (SELECT o_orderkey, o_orderkey AS v FROM orders)")
def number_rules(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", F.size(validate.number_errors(F.col("o_orderkey").cast("string"))).cast("long").alias("n_errors"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice > 100000 AS is_bad FROM lineitem")
def amount_rules(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.size(validate.amount_errors(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))) > 0).alias("is_bad"))


@query(f"SELECT voucher_id, gross_total, {NET} AS net_total, CAST(CASE WHEN voucher_id % 5 = 1 THEN 1 ELSE 0 END + CASE WHEN voucher_id % 7 = 2 OR voucher_id % 5 = 1 AND voucher_id % 7 <> 2 AND FALSE THEN 1 ELSE 0 END AS BIGINT) AS n_corrections FROM ({HEADS})")
def repaired_totals(spark, sf_dir):
    t = parsed(spark, sf_dir)
    k = F.col("voucher_id")
    broken = t.select("voucher_id", "total_deductions", F.aggregate("items", F.lit(0).cast("decimal(12,2)"), lambda a, x: (a + x["line_amount"]).cast("decimal(12,2)")).alias("items_total"), F.when(k % 5 == 1, F.col("gross_total") * 10).otherwise(F.col("gross_total")).cast("decimal(14,2)").alias("gross_total"), F.when(k % 7 == 2, None).otherwise(F.col("net_total")).alias("net_total"))
    return validate.repair_totals(broken).select("voucher_id", "gross_total", "net_total", F.size("corrections").cast("long").alias("n_corrections"))


@query(f"SELECT route, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN voucher_id * 7 % 100 < 30 THEN 'reject' WHEN voucher_id * 7 % 100 >= 80 THEN 'auto_accept' ELSE 'review' END AS route FROM ({HEADS})) GROUP BY route")
def route_rates(spark, sf_dir):
    v = parsed(spark, sf_dir)
    r = validate.route(F.col("voucher_id") * 7 % 100, F.col("overall"), F.array())
    return v.groupBy(r.alias("route")).agg(F.count("*").alias("n"))


# --- publishing ------------------------------------------------------------------------------------------------

RECEIPTS_SQL = f"SELECT voucher_id AS ocr_voucher_id, supplier_name, voucher_number AS receipt_number, voucher_date AS receipt_date, gross_total, {ALL_DEDUCTIONS} AS total_deductions, {NET} AS net_total, CAST(commission AS DECIMAL(10,2)) AS commission, CAST(damages AS DECIMAL(10,2)) AS damage, CAST(unloading AS DECIMAL(10,2)) AS unloading, CAST(cash AS DECIMAL(10,2)) AS lf_cash, CAST(0 AS DECIMAL(10,2)) AS other FROM ({HEADS})"


@query(f"SELECT supplier_name, count(*) AS n_receipts, CAST(sum(net_total) AS DECIMAL(18,2)) AS total_spend FROM ({FIELDS_SQL}) GROUP BY supplier_name")
def supplier_spend(spark, sf_dir):
    return publish.supplier_spend(parsed(spark, sf_dir))


@query(RECEIPTS_SQL)
def receipts(spark, sf_dir):
    return publish.receipts(parsed(spark, sf_dir))


@query(RECEIPTS_SQL)
def receipts_published_twice(spark, sf_dir):
    made = written(publish.receipts(parsed(spark, sf_dir)))  # three sides of the joins read it
    stale = made.withColumn("net_total", F.lit(0).cast("decimal(12,2)"))
    return publish.upsert(publish.upsert(stale, made, "ocr_voucher_id"), made, "ocr_voucher_id")


DICTIONARY_SQL = "SELECT 'RAVI' || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || '/K' AS known, s_acctbal FROM supplier"


def dictionary(spark, sf_dir) -> DataFrame:
    """The name of every supplier as vouchers print it."""
    shown = F.concat(F.lit("RAVI"), F.translate(F.col("s_suppkey").cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit("/K"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(shown.alias("known"), "s_acctbal")


@query(f"SELECT DISTINCT supplier_name AS name FROM ({HEADS}) WHERE supplier_name NOT IN (SELECT known FROM ({DICTIONARY_SQL}) WHERE s_acctbal >= 5000)")
def new_suppliers(spark, sf_dir):
    """Names on vouchers that are not among the suppliers with a large balance."""
    known = dictionary(spark, sf_dir).where("s_acctbal >= 5000").select(F.col("known").alias("name"))
    return publish.new_suppliers(parsed(spark, sf_dir), known).select("name")


OUTCOME = "CASE WHEN voucher_id % 97 = 0 THEN 'failed' WHEN voucher_id % 89 = 0 THEN 'skipped' ELSE 'ok' END"


@query(f"""SELECT batch_id, count(*) AS total, count(*) FILTER (o = 'failed') AS failed, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'ok') AS validated, count(*) AS processed,
CASE WHEN count(*) FILTER (o = 'failed') > 0 THEN 'partial_failure' ELSE 'completed' END AS status FROM (SELECT 'B' || (voucher_id % 40)::VARCHAR AS batch_id, {OUTCOME} AS o FROM ({HEADS})) GROUP BY batch_id""")
def batch_counters(spark, sf_dir):
    return publish.batch_counters(vo.rendered(spark, sf_dir).withColumn("outcome", F.expr(OUTCOME)))


@query(f"SELECT 'B' || (voucher_id % 40)::VARCHAR AS batch_id, count(*) AS total, count(*) FILTER (voucher_id % 97 = 0) AS failed, count(*) FILTER (voucher_id % 97 <> 0) AS validated FROM ({HEADS}) GROUP BY 1")
def rebuilt_counters(spark, sf_dir):
    v = parsed(spark, sf_dir).withColumn("supplier_name", F.when(F.col("voucher_id") % 97 == 0, publish.FAILED).when(F.col("voucher_id") % 13 == 1, None).otherwise(F.col("supplier_name")))
    return publish.rebuilt_counters(v)


LISTED_SQL = f"""SELECT voucher_id AS id, 'v' || voucher_id::VARCHAR || '.png' AS file_name, voucher_number, voucher_date, supplier_name, gross_total, {NET} AS net_total,
 CASE WHEN voucher_id % 3 = 0 THEN 'PENDING' ELSE 'VALIDATED' END AS validation_status, CASE WHEN voucher_id % 4 = 0 THEN 'optimal' ELSE 'default' END AS ocr_mode, CAST(1700000000 + voucher_id * 60 AS BIGINT) AS created FROM ({HEADS})"""


def listed(spark, sf_dir) -> DataFrame:
    """The ten columns of a listing: a voucher's file, header, state, mode of reading and time of creation."""
    v, k = parsed(spark, sf_dir), F.col("voucher_id")
    return v.select(
        k.alias("id"), F.concat(F.lit("v"), k.cast("string"), F.lit(".png")).alias("file_name"), *HEAD_FIELDS[:4], "net_total", F.when(k % 3 == 0, "PENDING").otherwise("VALIDATED").alias("validation_status"),
        F.when(k % 4 == 0, "optimal").otherwise("default").alias("ocr_mode"), F.unix_timestamp(F.col("created_at").cast("timestamp")).alias("created"),
    )


@query(f"{LISTED_SQL} ORDER BY created DESC, id DESC LIMIT 20 OFFSET 40")
def voucher_page(spark, sf_dir):
    return ranking.page(listed(spark, sf_dir), 3, 20, F.col("created").desc_nulls_last(), F.col("id").desc())


@query(f"SELECT id, voucher_date, supplier_name FROM ({LISTED_SQL}) ORDER BY voucher_date DESC, id DESC LIMIT 20 OFFSET 40")
def page_after_page(spark, sf_dir):
    """The third page by date and id, each page found from the last row of the one before."""
    rows, last = written(listed(spark, sf_dir).select("id", "voucher_date", "supplier_name")), None  # each page reads it
    for _ in range(2):
        last = ranking.page_after(rows, last, 20, ("voucher_date", "id")).collect()[-1].asDict()
    return ranking.page_after(rows, last, 20, ("voucher_date", "id"))


@query(f"""SELECT batch_id, total, status, voucher_id, row_number() OVER (PARTITION BY batch_id ORDER BY voucher_id) AS place
FROM (SELECT batch_id, count(*) AS total, CASE WHEN count(*) FILTER (o = 'failed') > 0 THEN 'partial_failure' ELSE 'completed' END AS status FROM (SELECT 'B' || (voucher_id % 40)::VARCHAR AS batch_id, {OUTCOME} AS o FROM ({HEADS})) GROUP BY batch_id)
JOIN (SELECT voucher_id, 'B' || (voucher_id % 40)::VARCHAR AS batch_id FROM ({HEADS})) USING (batch_id)""")
def batch_vouchers(spark, sf_dir):
    """Each batch's counters with its vouchers in their order of creation; a batch may be of any size."""
    v = vo.rendered(spark, sf_dir).select("batch_id", "voucher_id", "created_at")
    batches = publish.batch_counters(v.withColumn("outcome", F.expr(OUTCOME)))
    return ranking.batches_with_vouchers(batches, v).select("batch_id", "total", "status", "voucher_id", "place")


# --- learning --------------------------------------------------------------------------------------------------

PAIRS_SQL = f"""SELECT voucher_id, voucher_number, voucher_date, supplier_name, gross_total, {NET} AS net_total,
 CASE WHEN voucher_id % 5 = 1 THEN replace(supplier_name, 'RAVI', 'R4VI') WHEN voucher_id % 5 = 2 THEN replace(supplier_name, 'RAVI', 'RAV1') WHEN voucher_id % 25 = 3 THEN 'TOTAL' ELSE supplier_name END AS supplier_auto,
 CASE WHEN voucher_id % 7 = 2 THEN NULL ELSE voucher_number END AS number_auto, CASE WHEN voucher_id % 11 = 3 THEN CAST({NET} + 10 AS DECIMAL(12,2)) ELSE {NET} END AS net_auto FROM ({HEADS})"""
DIFFS_SQL = f"""SELECT voucher_id, 'supplier_name' AS field, supplier_auto AS auto, supplier_name AS corrected FROM ({PAIRS_SQL}) WHERE supplier_auto <> supplier_name
 UNION ALL SELECT voucher_id, 'voucher_number', NULL, voucher_number FROM ({PAIRS_SQL}) WHERE number_auto IS NULL
 UNION ALL SELECT voucher_id, 'net_total', CAST(net_auto AS VARCHAR), CAST(net_total AS VARCHAR) FROM ({PAIRS_SQL}) WHERE net_auto <> net_total"""


def pairs(spark, sf_dir) -> DataFrame:
    """Vouchers with a machine version that errs by rule, and the right one."""
    v, k, s = parsed(spark, sf_dir), F.col("voucher_id"), F.col("supplier_name")
    fixed = "voucher_date", "gross_total"
    machine = F.struct(
        F.when(k % 5 == 1, F.replace(s, F.lit("RAVI"), F.lit("R4VI"))).when(k % 5 == 2, F.replace(s, F.lit("RAVI"), F.lit("RAV1"))).when(k % 25 == 3, "TOTAL").otherwise(s).alias("supplier_name"),
        F.when(k % 7 == 2, None).otherwise(F.col("voucher_number")).alias("voucher_number"), F.when(k % 11 == 3, F.col("net_total") + 10).otherwise(F.col("net_total")).cast("decimal(12,2)").alias("net_total"),
        F.transform("items", lambda i, n: F.struct(i["item_name"].alias("item_name"), F.when((k % 13 == 4) & (n == 0), i["quantity"] + 1).otherwise(i["quantity"]).cast("decimal(10,2)").alias("quantity"), i["unit_price"].alias("unit_price"), i["line_amount"].alias("line_amount"))).alias("items"), *fixed,
    )
    return v.select("voucher_id", "raw_ocr_text", machine.alias("original"), F.struct("supplier_name", "voucher_number", "net_total", "items", *fixed).alias("corrected"))


@query(DIFFS_SQL)
def header_diffs(spark, sf_dir):
    return learn.header_diffs(pairs(spark, sf_dir))


@query(f"SELECT voucher_id, 0 AS item_index, 'quantity' AS field, CAST(CAST(arg_min(quantity, (line, part, supp)) + 1 AS DECIMAL(10,2)) AS VARCHAR) AS auto, CAST(CAST(arg_min(quantity, (line, part, supp)) AS DECIMAL(10,2)) AS VARCHAR) AS corrected FROM ({ITEMS}) WHERE voucher_id % 13 = 4 GROUP BY voucher_id")
def item_diffs(spark, sf_dir):
    return learn.item_diffs(pairs(spark, sf_dir))


MODEL_SQL = f"SELECT field, auto, corrected, count(*) AS n, min(voucher_id) AS first_seen FROM ({DIFFS_SQL}) WHERE auto IS NOT NULL GROUP BY field, auto, corrected"
BEST_SQL = f"SELECT field, auto, arg_max(corrected, n * 1000000000000 - first_seen) AS corrected, max(n) AS n, CAST(sum(n) AS BIGINT) AS total, max(n) / sum(n) AS share FROM ({MODEL_SQL}) GROUP BY field, auto"


@query(MODEL_SQL)
def value_model(spark, sf_dir):
    return learn.value_model(learn.header_diffs(pairs(spark, sf_dir)))


@query(BEST_SQL)
def best_values(spark, sf_dir):
    return learn.best(learn.value_model(learn.header_diffs(pairs(spark, sf_dir))), ["field", "auto"], "corrected")


@query(f"SELECT voucher_id, supplier_auto AS supplier_name, b.corrected AS supplier_name_suggested FROM ({PAIRS_SQL}) p LEFT JOIN (SELECT * FROM ({BEST_SQL}) WHERE field = 'supplier_name' AND share > 0.7) b ON b.auto = p.supplier_auto")
def suggested_values(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return learn.suggest(p.select("voucher_id", "original.supplier_name"), learn.value_model(learn.header_diffs(p)), "supplier_name")


@query(f"SELECT CASE auto WHEN 'TOTAL' THEN 'TOT' ELSE CASE WHEN auto LIKE 'R4%' THEN '4' ELSE '1' END END AS bad, CASE auto WHEN 'TOTAL' THEN 'R' ELSE CASE WHEN auto LIKE 'R4%' THEN 'A' ELSE 'I' END END AS good, count(*) AS n, min(voucher_id) AS first_seen FROM ({DIFFS_SQL}) WHERE field = 'supplier_name' GROUP BY 1, 2")
def substitutions(spark, sf_dir):
    return learn.substitutions(learn.header_diffs(pairs(spark, sf_dir), ("supplier_name",)))


@query(f"SELECT voucher_id, CASE supplier_auto WHEN 'TOTAL' THEN 'RAL' ELSE supplier_name END AS supplier_name FROM ({PAIRS_SQL})")
def applied_substitutions(spark, sf_dir):
    p = written(pairs(spark, sf_dir).select("voucher_id", *[F.struct(F.col(f"{side}.supplier_name")).alias(side) for side in ("original", "corrected")]))  # model and texts read it
    model = learn.substitutions(learn.header_diffs(p, ("supplier_name",)))
    return learn.apply_substitutions(p.select("voucher_id", "original.supplier_name"), model, "supplier_name")


# The words before each value's last place, by field; dates stand in the text day first.
ANCHORS_SQL = " UNION ALL ".join(f"SELECT voucher_id, supplier_name, '{field}' AS field, regexp_extract_all(text, '(?is)(.{{1,30}})' || {shown}, 1)[-1] AS before FROM ({vo.TEXT_SQL})" for field, shown in (("voucher_number", "voucher_number"), ("voucher_date", "strftime(voucher_date, '%d/%m/%Y')")))
ANCHORS_SQL = rf"SELECT *, regexp_replace(regexp_replace(before, '^[\s\S]*\n', ''), '[\s:\-=.]+$', '') AS last FROM ({ANCHORS_SQL})"
ANCHORS_SQL = rf"SELECT *, [w FOR w IN string_split_regex(last, '\s+') IF w <> ''] AS words FROM ({ANCHORS_SQL})"
ANCHORS_SQL = f"SELECT upper(trim(supplier_name)) AS supplier_key, field, array_to_string(words[greatest(len(words) - 3, 1):], ' ') AS anchor, voucher_id FROM ({ANCHORS_SQL})"


@query(f"SELECT supplier_key, field, anchor, count(*) AS n, min(voucher_id) AS first_seen FROM ({ANCHORS_SQL}) WHERE length(anchor) > 2 GROUP BY supplier_key, field, anchor")
def anchors(spark, sf_dir):
    return learn.anchors(parsed(spark, sf_dir).select("voucher_id", "raw_ocr_text", "supplier_name", "voucher_number", "voucher_date"), ("voucher_number", "voucher_date"))


@query(f"SELECT voucher_id, voucher_number AS value FROM ({HEADS})")
def anchored_numbers(spark, sf_dir):
    rows = written(parsed(spark, sf_dir).select("voucher_id", "raw_ocr_text", "supplier_name", "voucher_number"))  # anchors and texts read it
    return learn.find_by_anchor(rows, learn.anchors(rows, ("voucher_number",)), "voucher_number").select("voucher_id", "value")


@query(f"SELECT key, arg_max(corrected, n * 1000000000000 - first_seen) AS corrected, max(n) AS n, CAST(sum(n) AS BIGINT) AS total, CASE WHEN count(*) = 1 AND sum(n) >= 3 THEN 0.95 ELSE max(n) / sum(n) END AS confidence FROM (SELECT field || ':' || lower(trim(auto)) AS key, corrected, count(*) AS n, min(voucher_id) AS first_seen FROM ({DIFFS_SQL}) WHERE auto IS NOT NULL GROUP BY 1, 2) GROUP BY key")
def pattern_model(spark, sf_dir):
    return learn.pattern_model(learn.header_diffs(pairs(spark, sf_dir)))


@query(f"SELECT field, auto, corrected, CASE WHEN bool_or(voucher_id % 2 = 0) THEN 'validated' ELSE 'feedback' END AS source FROM ({DIFFS_SQL}) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY field, auto, corrected"))
def united_sources(spark, sf_dir):
    d = learn.header_diffs(pairs(spark, sf_dir)).withColumn("even", F.col("voucher_id") % 2 == 0)
    return learn.union_sources(("validated", d.where("even").select("field", "auto", "corrected")), ("feedback", d.where("NOT even").select("field", "auto", "corrected")))


@query(f"SELECT field, count(*) AS n, avg(CASE WHEN lower(trim(coalesce(p, ''))) = lower(trim(coalesce(a, ''))) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM (SELECT 'supplier_name' AS field, supplier_auto AS p, supplier_name AS a FROM ({PAIRS_SQL}) UNION ALL SELECT 'voucher_number', number_auto, voucher_number FROM ({PAIRS_SQL})) GROUP BY field")
def text_accuracy(spark, sf_dir):
    p = pairs(spark, sf_dir)
    rows = p.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"original.{f}").alias("predicted"), F.col(f"corrected.{f}").alias("actual")) for f in ("supplier_name", "voucher_number")])))
    return evaluate.text_accuracy(rows)


@query(f"SELECT 'net_total' AS field, count(*) AS n, avg(off) AS mae, avg(off / a) AS mape, greatest(0, 1 - avg(off / a)) AS accuracy FROM (SELECT abs(net_auto - net_total)::DOUBLE AS off, net_total::DOUBLE AS a FROM ({PAIRS_SQL}))")
def numeric_accuracy(spark, sf_dir):
    return evaluate.numeric_accuracy(pairs(spark, sf_dir).select(F.lit("net_total").alias("field"), F.col("original.net_total").alias("predicted"), F.col("corrected.net_total").alias("actual")))


@query(f"SELECT cause, count(*) AS n FROM (SELECT CASE WHEN number_auto IS NULL THEN 'PARSING_FAILURE' END AS cause FROM ({PAIRS_SQL}) UNION ALL SELECT CASE WHEN supplier_auto <> supplier_name THEN 'WRONG_EXTRACTION' END FROM ({PAIRS_SQL})) WHERE cause IS NOT NULL GROUP BY cause")
def failure_causes(spark, sf_dir):
    p = pairs(spark, sf_dir)
    cause = lambda f: evaluate.failure_class(F.col(f"original.{f}"), F.col(f"corrected.{f}"), F.col("raw_ocr_text"))
    return p.select(F.explode(F.array_compact(F.array(cause("voucher_number"), cause("supplier_name")))).alias("cause")).groupBy("cause").agg(F.count("*").alias("n"))


@query(f"SELECT field, count(*) AS n, count(*) / (SELECT count(*) FROM ({HEADS}) WHERE voucher_id % 7 = 2 OR voucher_id % 3 = 1) AS share FROM (SELECT 'voucher_number' AS field FROM ({HEADS}) WHERE voucher_id % 7 = 2 UNION ALL SELECT 'supplier_name' FROM ({HEADS}) WHERE voucher_id % 3 = 1) GROUP BY field")
def missing_fields(spark, sf_dir):
    k = F.col("voucher_id")
    v = parsed(spark, sf_dir).withColumns({"voucher_number": F.when(k % 7 != 2, F.col("voucher_number")), "supplier_name": F.when(k % 3 != 1, F.col("supplier_name"))})
    return evaluate.missing_fields(v, ("voucher_number", "supplier_name", "voucher_date", "gross_total"))


@query(f"SELECT count(*) AS n, count(*) AS has_voucher_number, count(*) AS has_voucher_date, count(*) AS has_supplier_name, count(*) AS has_gross_total, count(*) AS has_net_total FROM ({HEADS})")
def field_coverage(spark, sf_dir):
    return evaluate.coverage(parsed(spark, sf_dir, noisy=True), ("voucher_number", "voucher_date", "supplier_name", "gross_total", "net_total"))


@query(r"""SELECT doc_id, greatest(0.0, least(100.0, 50 + """ + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 5 ELSE 0 END" for w in ("date", "supp", "total", "qty", "price", "amount", "voucher")) + r""" + CASE WHEN regexp_matches(text, '\d{1,2}[/-]\d{1,2}[/-]\d{2,4}') THEN 10 ELSE 0 END
 + CASE WHEN regexp_matches(text, '\d+\.\d{2}') THEN 10 ELSE 0 END - 30 * (length(regexp_replace(text, '[A-Za-z0-9\s.,:/()%@&-]', '', 'g'))::DOUBLE / greatest(length(text), 1))))::DOUBLE AS quality FROM documents WHERE text IS NOT NULL""")
def text_quality(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", evaluate.text_quality(F.col("text")).alias("quality"))


READ_SQL = f"SELECT voucher_id, CASE WHEN voucher_id % 2 = 1 THEN replace(supplier_name, 'RAVI', 'R4VI') ELSE supplier_name END AS name, supplier_name AS known FROM ({HEADS})"


def read_names(spark, sf_dir) -> DataFrame:
    """Every voucher's supplier, of each second voucher with a letter misread."""
    v = parsed(spark, sf_dir)
    return v.select("voucher_id", F.when(F.col("voucher_id") % 2 == 1, F.replace("supplier_name", F.lit("RAVI"), F.lit("R4VI"))).otherwise(F.col("supplier_name")).alias("name"))


@query(f"SELECT DISTINCT name, known, CASE WHEN name = known THEN 1.0 ELSE (length(known) - 1.0) / length(known) END::DOUBLE AS ratio FROM ({READ_SQL})")
def similar_parts(spark, sf_dir):
    """Names as they were read, against the dictionary of suppliers."""
    return backup.near_names(read_names(spark, sf_dir), dictionary(spark, sf_dir))


@query(f"SELECT voucher_id, known AS name FROM ({READ_SQL})")
def fixed_names(spark, sf_dir):
    return backup.fix_names(written(read_names(spark, sf_dir)), "name", dictionary(spark, sf_dir))  # names alone, and the rows with them


# --- attempts --------------------------------------------------------------------------------------------------

ATTEMPTS_SQL = f"SELECT voucher_id, a AS attempt, CAST((voucher_id * 31 + a * 17) % 100 AS DOUBLE) AS confidence, CAST(20 + (voucher_id + a * 7) % 60 AS BIGINT) AS word_count, CASE WHEN (voucher_id + a) % 3 = 0 THEN 'v' ELSE 'w' || (a % 2)::VARCHAR END AS text FROM ({HEADS}), range(4) r(a)"


def tried(spark, sf_dir) -> DataFrame:
    """Four attempts per voucher, with texts and confidences by rule."""
    v = vo.truth(spark, sf_dir).select("voucher_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("attempt"))
    k, a = F.col("voucher_id"), F.col("attempt")
    return v.select("*", ((k * 31 + a * 17) % 100).cast("double").alias("confidence"), (20 + (k + a * 7) % 60).alias("word_count"), F.when((k + a) % 3 == 0, "v").otherwise(F.concat(F.lit("w"), (a % 2).cast("string"))).alias("text"))


@query(f"SELECT voucher_id, arg_max(attempt, confidence * 10 - attempt) AS attempt, arg_max(text, confidence * 10 - attempt) AS text, max(confidence) AS confidence FROM ({ATTEMPTS_SQL}) GROUP BY voucher_id")
def best_attempts(spark, sf_dir):
    return attempts.best_by_confidence(tried(spark, sf_dir))


@query(f"SELECT voucher_id, arg_max(attempt, confidence * (1 + word_count / 100)) AS attempt, arg_max(text, confidence * (1 + word_count / 100)) AS text, arg_max(confidence, confidence * (1 + word_count / 100)) AS confidence FROM ({ATTEMPTS_SQL}) GROUP BY voucher_id")
def best_attempts_by_words(spark, sf_dir):
    return attempts.best_by_words(tried(spark, sf_dir))


@query(f"SELECT voucher_id, 0.6 * max(confidence) + 0.4 * avg(confidence) AS confidence FROM ({ATTEMPTS_SQL}) GROUP BY voucher_id")
def merged_attempts(spark, sf_dir):
    return attempts.merged_confidence(tried(spark, sf_dir))


@query(f"SELECT voucher_id, arg_max(attempt, s) AS attempt, arg_max(text, s) AS text, arg_max(confidence, s) AS confidence, arg_max(votes, s) AS votes FROM (SELECT *, CASE WHEN votes > 1 THEN votes ELSE 1 END * 100000.0 + confidence * 100 - attempt AS s FROM (SELECT *, count(*) OVER (PARTITION BY voucher_id, text) AS votes FROM ({ATTEMPTS_SQL}))) GROUP BY voucher_id")
def voted_attempts(spark, sf_dir):
    return attempts.voted(tried(spark, sf_dir))


@query(f"SELECT voucher_id, attempt, confidence FROM (SELECT *, coalesce(max(confidence) OVER (PARTITION BY voucher_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM ({ATTEMPTS_SQL})) WHERE m < 85 AND attempt < 3")
def attempts_until_good(spark, sf_dir):
    return attempts.until_good(tried(spark, sf_dir)).select("voucher_id", "attempt", "confidence")


@query(f"SELECT voucher_id, voucher_number FROM ({HEADS})")
def line_votes(spark, sf_dir):
    """Three readings of each voucher, one of them misread: the voted text has the number again."""
    clean = vo.rendered(spark, sf_dir)
    text_ = F.col("raw_ocr_text")
    tries = [(0, text_), (1, F.replace(text_, F.lit("Voucher Number"), F.lit("V0ucher Numb"))), (2, text_)]
    rows = clean.select("voucher_id", F.inline(F.array(*[F.struct(F.lit(i).alias("attempt"), t.alias("text"), F.lit(70.0).alias("confidence")) for i, t in tries])))
    return attempts.line_vote(rows).select("voucher_id", extract.v2_number(F.col("text")).alias("voucher_number"))


# --- boxes -----------------------------------------------------------------------------------------------------

BOXES_SQL = "SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS ax, l_quantity * 2 AS ay, 15 + l_quantity * 3 AS aw, 100 + l_quantity AS ah, l_quantity + l_partkey % 7 AS ux, l_quantity * 2 + l_suppkey % 11 AS uy, 15 + l_quantity * 3 + 4 AS uw, 100 + l_quantity - 6 AS uh FROM lineitem"
DELTAS_SQL = f"SELECT *, ux - ax AS dx, uy - ay AS dy, uw - aw AS dw, uh - ah AS dh FROM ({BOXES_SQL}) WHERE aw >= 20 AND uw >= 20 AND ah >= 20 AND uh >= 20"


def boxes(spark, sf_dir) -> DataFrame:
    li, q = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("l_quantity")
    box = lambda *c: F.struct(*[x.cast("double").alias(n) for x, n in zip(c, ("x", "y", "width", "height"), strict=True)])
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), box(q, q * 2, 15 + q * 3, 100 + q).alias("auto_crop"), box(q + F.col("l_partkey") % 7, q * 2 + F.col("l_suppkey") % 11, 19 + q * 3, 94 + q).alias("user_crop"))


@query("SELECT count(*) AS n, " + ", ".join(f"avg(d{a}) AS mean_{b}, stddev_pop(d{a}) AS std_{b}" for a, b in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))) + f" FROM ({DELTAS_SQL})")
def crop_model(spark, sf_dir):
    return learn.crop_model(learn.crop_examples(boxes(spark, sf_dir)))


@query(f"WITH m AS (SELECT avg(dx) AS mx, avg(dy) AS my, avg(dw) AS mw, avg(dh) AS mh FROM ({DELTAS_SQL})) SELECT id, greatest(0, round_even(ax + mx, 0)) AS x, greatest(0, round_even(ay + my, 0)) AS y, greatest(10, round_even(aw + mw, 0)) AS width, greatest(10, round_even(ah + mh, 0)) AS height FROM ({BOXES_SQL}), m")
def suggested_crops(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return learn.apply_crop(b, learn.crop_model(learn.crop_examples(b))).select("id", "suggested.*")


# --- logs and streams ------------------------------------------------------------------------------------------

PREDICTIONS_SQL = "SELECT ts, event_type AS field, value / 100 - floor(value / 100) AS confidence, user_id % 4 <> 0 AS correct, user_id, event_id FROM events"


def predictions(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("ts", F.col("event_type").alias("field"), (F.col("value") / 100 - F.floor(F.col("value") / 100)).alias("confidence"), (F.col("user_id") % 4 != 0).alias("correct"), "user_id", "event_id")


@query(f"SELECT field, count(*) AS n, avg(correct::INT::DOUBLE) AS accuracy FROM ({PREDICTIONS_SQL}) WHERE ts BETWEEN TIMESTAMP '2024-01-10' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-10' GROUP BY field")
def recent_accuracy(spark, sf_dir):
    return learn.recent_accuracy(predictions(spark, sf_dir), "2024-01-10")


@query(f"SELECT CAST(least(9, floor(confidence * 10)) AS BIGINT) AS bin, count(*) AS n, avg(correct::INT::DOUBLE) AS actual, CAST(least(9, floor(confidence * 10)) AS BIGINT) / 10 + 0.05 AS expected FROM ({PREDICTIONS_SQL}) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 4"))
def calibration(spark, sf_dir):
    return learn.calibration(predictions(spark, sf_dir))


@query(f"SELECT event_id, field FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY event_id DESC) AS n FROM ({PREDICTIONS_SQL})) WHERE n <= 50")
def latest_predictions(spark, sf_dir):
    return learn.last_n(predictions(spark, sf_dir), 50, "event_id", "field").select("event_id", "field")


@query("SELECT user_id % 40 AS batch, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def streamed_counters(spark, sf_dir):
    return streams.run_to_end(streams.batch_counts(streams.event_stream(spark, sf_dir)), "counters")


@query("SELECT event_type AS field, CAST(floor(value / 10) AS BIGINT) AS auto, CAST(floor(value) AS BIGINT) AS corrected, count(*) AS n FROM events GROUP BY 1, 2, 3")
def streamed_corrections(spark, sf_dir):
    return streams.run_to_end(streams.correction_counts(streams.event_stream(spark, sf_dir)), "corrections")


@query("SELECT start, count(*) AS n, sum(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0 END) / count(*) AS accuracy FROM (SELECT event_type, unnest([date_trunc('day', ts) - to_days(i::INT) FOR i IN range(7)]) AS start FROM events) GROUP BY start")
def streamed_accuracy(spark, sf_dir):
    return streams.run_to_end(streams.rolling_accuracy(streams.event_stream(spark, sf_dir)), "accuracy")


# --- more profiles ---------------------------------------------------------------------------------------------


def profiled(spark, sf_dir, profile: str) -> DataFrame:
    return profiles.extract(vo.rendered(spark, sf_dir), profile)


#: 4 % of gross, rounded half to even, in whole cents.
FOUR_PERCENT = "CAST(((g4 // 100) + CASE WHEN g4 % 100 > 50 OR g4 % 100 = 50 AND (g4 // 100) % 2 = 1 THEN 1 ELSE 0 END) / 100.0 AS DECIMAL(12,2))"
ADAPTIVE_SQL = f"SELECT *, CAST(c4 + damages + unloading + cash AS DECIMAL(12,2)) AS total FROM (SELECT *, {FOUR_PERCENT} AS c4 FROM (SELECT *, 4 * CAST(gross_total * 100 AS BIGINT) AS g4 FROM ({HEADS})))"
REGION_LABELS = (("Comm", "commission"), ("LessForDamages", "damages"), ("UnLoading", "unloading"), ("L/FAndCash", "cash"))
LABELLED_SQL = " UNION ALL ".join(f"SELECT voucher_id, '{kind}' AS deduction_type, {c} AS amount FROM ({HEADS})" for kind, c in REGION_LABELS)


@query(FIELDS_SQL)
def v1_fields(spark, sf_dir):
    return profiled(spark, sf_dir, "v1").select("voucher_id", *HEAD_FIELDS)


@query(f"SELECT voucher_id, voucher_number, voucher_date, supplier_name, gross_total, total AS total_deductions, CAST(gross_total - total AS DECIMAL(12,2)) AS net_total, CAST(75.25 AS DOUBLE) AS overall FROM ({ADAPTIVE_SQL})")
def adaptive_fields(spark, sf_dir):
    """Small commissions stand for 4 % of gross; a deduction above half of gross goes, which none of these is."""
    return profiled(spark, sf_dir, "adaptive").select("voucher_id", *HEAD_FIELDS, "overall")


@query(f"SELECT voucher_id, voucher_number, voucher_date, supplier_name, gross_total, {ALL_DEDUCTIONS} AS total_deductions, gross_total AS net_total FROM ({HEADS})")
def robust_fields(spark, sf_dir):
    """The largest amount is the net total and the second the gross one: here the same, as the total is found twice."""
    return profiled(spark, sf_dir, "robust").select("voucher_id", *HEAD_FIELDS)


@query(f"SELECT voucher_id, voucher_number, voucher_date, supplier_name, CAST(95 AS INT) AS number_confidence FROM ({HEADS})")
def enhanced_heads(spark, sf_dir):
    return profiled(spark, sf_dir, "enhanced").select("voucher_id", "voucher_number", "voucher_date", "supplier_name", F.col("confidence.voucher_number").alias("number_confidence"))


# Within 50 characters of the last total's label stand net, cash and unloading; the second to fifth largest amounts of all follow.
ENHANCED_SQL = f"SELECT h.*, greatest({NET}, cash, unloading) AS net, list_sort(list_concat(i.amounts, [gross_total, commission, damages, unloading, cash, {NET}]), 'DESC')[2:5] AS others FROM ({HEADS}) h JOIN (SELECT voucher_id, list_concat(list(unit_price), list(line_amount)) AS amounts FROM ({ITEMS}) GROUP BY voucher_id) i USING (voucher_id)"


@query(f"SELECT voucher_id, coalesce([a FOR a IN others IF a < net AND a > net * 0.5][1], net) AS gross_total, net AS net_total, {ALL_DEDUCTIONS} AS total_deductions FROM ({ENHANCED_SQL})")
def enhanced_totals(spark, sf_dir):
    return profiled(spark, sf_dir, "enhanced").select("voucher_id", "gross_total", "net_total", "total_deductions")


@query(FIELDS_SQL.replace("SELECT voucher_id,", "SELECT voucher_id, 'SHARMA TRADING MARKET' AS vendor_details,", 1))
def base_fields(spark, sf_dir):
    return profiled(spark, sf_dir, "base").select("voucher_id", "vendor_details", *HEAD_FIELDS)


@query(LABELLED_SQL)
def base_deductions(spark, sf_dir):
    return profiled(spark, sf_dir, "base").select("voucher_id", F.inline("deductions"))


@query(f"SELECT voucher_id, 'Item' AS item_name, CAST(quantity AS DECIMAL(10,2)) AS quantity, CAST(unit_price AS DECIMAL(10,2)) AS unit_price, line_amount FROM ({ITEMS})")
def base_items(spark, sf_dir):
    return profiled(spark, sf_dir, "base").select("voucher_id", F.inline("items"))


def regions(spark, sf_dir) -> DataFrame:
    t = F.col("raw_ocr_text")
    kept = lambda p, want: F.array_join(F.filter(F.split(t, "\n"), lambda x: x.rlike(p) == want), "\n")
    return vo.rendered(spark, sf_dir).select(
        "voucher_id", F.substring_index(t, "\nQty Price", 1).alias("header_text"), F.replace(kept(r"^\(-\)", True), F.lit("(-) "), F.lit("")).alias("deductions_text"), kept("Total", True).alias("totals_text"),
    )


@query(f"SELECT voucher_id, 'SHARMA TRADING MARKET' AS vendor_details, voucher_number, voucher_date, supplier_name, gross_total, {NET} AS net_total FROM ({HEADS})")
def region_fields(spark, sf_dir):
    return profiles.region_fields(regions(spark, sf_dir)).select("voucher_id", "vendor_details", "voucher_number", "voucher_date", "supplier_name", "gross_total", "net_total")


@query(LABELLED_SQL)
def region_deductions(spark, sf_dir):
    return profiles.region_fields(regions(spark, sf_dir)).select("voucher_id", F.inline("deductions"))


SCORED = ("voucher_number", "voucher_date", "supplier_name", "gross_total", "net_total")


@query(" UNION ALL ".join(f"SELECT '{p}' AS parser, 5 * count(*) AS n, CAST(sum({hits}) AS BIGINT) AS correct, sum({hits}) / (5 * count(*)) AS share FROM ({HEADS})" for p, hits in (("v2", "5"), ("v1", "5"), ("base", "5"), ("robust", "4"))))
def parser_scores(spark, sf_dir):
    """How many of five fields each profile gets right; the right values come from the tables."""
    t = vo.truth(spark, sf_dir)
    right = t.withColumn("net_total", (F.col("gross_total") - F.col("commission") - F.col("damages") - F.col("unloading") - F.col("cash")).cast("decimal(12,2)")).select("voucher_id", *[F.col(f).cast("string").alias(f"right_{f}") for f in SCORED])
    v, rows = written(vo.rendered(spark, sf_dir).select("voucher_id", "raw_ocr_text").join(right, "voucher_id")), None  # each profile reads texts and right values
    for name in ("v2", "v1", "base", "robust"):
        made = extract.extract_v2(v) if name == "v2" else profiles.extract(v, name, heads_only=True)
        made = made.select("voucher_id", F.lit(name).alias("parser"), F.col("overall").alias("confidence"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("predicted"), F.col(f"right_{f}").alias("actual")) for f in SCORED])))
        rows = made if rows is None else rows.unionByName(made)
    return evaluate.parser_scores(rows).select("parser", "n", "correct", "share")


# --- contexts, suggestions, spans ------------------------------------------------------------------------------


def examples(spark, sf_dir) -> DataFrame:
    p = written(pairs(spark, sf_dir))  # both sides of the join read it
    return learn.header_diffs(p).join(p.select("voucher_id", "raw_ocr_text", F.col("corrected.supplier_name").alias("supplier_name")), "voucher_id")


CONTEXT_SQL = r"CASE field WHEN 'supplier_name' THEN 'name|supp\s*name' WHEN 'voucher_number' THEN 'voucher\s*number' ELSE 'grand' END"
EXAMPLES_SQL = f"SELECT d.*, p.supplier_name FROM ({DIFFS_SQL}) d JOIN ({PAIRS_SQL}) p USING (voucher_id)"


@query(f"SELECT field, {CONTEXT_SQL} AS context, corrected, count(*) AS n, min(voucher_id) AS first_seen FROM ({DIFFS_SQL}) GROUP BY 1, 2, 3")
def context_model(spark, sf_dir):
    return context.context_model(examples(spark, sf_dir))


@query(f"SELECT supplier_name AS supplier_key, field, corrected, count(*) AS n, min(voucher_id) AS first_seen FROM ({EXAMPLES_SQL}) GROUP BY 1, 2, 3")
def supplier_model(spark, sf_dir):
    return context.supplier_model(examples(spark, sf_dir))


@query(f"SELECT field, CASE WHEN field = 'supplier_name' AND n_items = 1 THEN 'middle' ELSE 'beginning' END AS place, count(*) AS n FROM ({DIFFS_SQL}) JOIN (SELECT voucher_id, n_items FROM ({HEADS})) USING (voucher_id) WHERE field <> 'net_total' GROUP BY 1, 2")
def position_model(spark, sf_dir):
    return context.position_model(examples(spark, sf_dir).where("field <> 'net_total'"))


@query(f"SELECT field, 'before' AS side, CASE field WHEN 'supplier_name' THEN 'Name' ELSE 'Number' END AS word, count(*) AS n FROM ({DIFFS_SQL}) WHERE field <> 'net_total' GROUP BY 1, 2, 3")
def neighbour_model(spark, sf_dir):
    return context.neighbour_model(examples(spark, sf_dir).where("field <> 'net_total'"))


_TOP = "arg_max(corrected, n * 1000000000000 - first_seen)"


def suggestions_sql(examples: str, rows: str) -> str:
    """SQL of suggestions: examples (voucher_id, field, auto, corrected, context, supplier_key); rows (voucher_id, place, field, auto, context, supplier_key)."""
    counted = lambda keys: f"SELECT {keys}, corrected, count(*) AS n, min(voucher_id) AS first_seen FROM ({examples}) GROUP BY ALL"
    return f"""
SELECT voucher_id, place, field, auto, CASE WHEN top.c >= 0.7 THEN top.v END AS suggestion, coalesce(top.c, 0) AS confidence, top.s AS source, offers, top.v AS best FROM (
 SELECT *, list_sort(CASE WHEN len(same) > 0 THEN list_concat(offers, [{{c: least(0.98, list_max([x.c FOR x IN same]) + 0.1), o: 3, v: same[1].v, s: 'combined'}}]) ELSE offers END)[-1] AS top FROM (
  SELECT *, [x FOR x IN offers IF len([y FOR y IN offers IF y.v = x.v]) > 1] AS same FROM (
   SELECT r.*, [x FOR x IN [
     CASE WHEN p.c >= 0.5 THEN {{c: p.c::DOUBLE, o: 0, v: p.v, s: 'pattern'}} END, CASE WHEN x.c >= 0.5 THEN {{c: (x.c * 0.9)::DOUBLE, o: -1, v: x.v, s: 'context'}} END,
     CASE WHEN s.c >= 0.4 THEN {{c: (s.c * 0.95)::DOUBLE, o: -2, v: s.v, s: 'supplier'}} END] IF x IS NOT NULL] AS offers
   FROM ({rows}) r
   LEFT JOIN (SELECT key, {_TOP} AS v, CASE WHEN count(*) = 1 AND sum(n) >= 3 THEN 0.95::DOUBLE ELSE max(n) / sum(n) END AS c FROM ({counted("field || ':' || lower(trim(auto)) AS key")}) WHERE key IS NOT NULL GROUP BY key) p ON p.key = r.field || ':' || lower(trim(r.auto))
   LEFT JOIN (SELECT field, context, {_TOP} AS v, max(n) / sum(n) AS c FROM ({counted("field, context")}) WHERE context IS NOT NULL GROUP BY 1, 2) x ON x.field = r.field AND x.context = r.context
   LEFT JOIN (SELECT supplier_key, field, {_TOP} AS v, max(n) / sum(n) AS c FROM ({counted("supplier_key, field")}) WHERE supplier_key IS NOT NULL GROUP BY 1, 2) s ON s.supplier_key = r.supplier_key AND s.field = r.field)))"""


KEYED_SQL = f"SELECT voucher_id, field, field AS place, auto, corrected, {CONTEXT_SQL} AS context, supplier_name AS supplier_key FROM ({EXAMPLES_SQL})"


@query(f"SELECT voucher_id, field, auto, suggestion, round(confidence, 9) AS confidence, source, len([x FOR x IN offers IF x.v <> best]) AS n_alternatives FROM ({suggestions_sql(KEYED_SQL, KEYED_SQL)})".replace("len([x FOR", "CAST(len([x FOR").replace("<> best]) AS", "<> best]) AS INT) AS"))
def suggestions(spark, sf_dir):
    e = written(examples(spark, sf_dir))
    made = context.suggestions(e.drop("corrected"), e)
    return made.select("voucher_id", "field", "auto", "suggestion", F.round("confidence", 9).alias("confidence"), "source", F.size("alternatives").alias("n_alternatives"))


#: A machine's header, and its items, whose names the even vouchers teach.
HEADED_SQL = f"SELECT voucher_id, 'supplier_name' AS place, 'supplier_name' AS field, supplier_auto AS auto, 'name|supp\\s*name' AS context, supplier_auto AS supplier_key FROM ({PAIRS_SQL}) UNION ALL SELECT voucher_id, 'voucher_number', 'voucher_number', number_auto, 'voucher\\s*number', supplier_auto FROM ({PAIRS_SQL})".replace("\\\\", "\\")
CELLS_SQL = f"SELECT i.voucher_id, 'items[' || (place - 1)::VARCHAR || '].item_name' AS place, 'item_item_name' AS field, 'ltem ' || (part % 50)::VARCHAR AS auto, 'Item ' || (part % 50)::VARCHAR AS corrected, NULL::VARCHAR AS context, supplier_auto AS supplier_key FROM ({_PLACED}) i JOIN ({PAIRS_SQL}) USING (voucher_id)"
TAUGHT_SQL = f"SELECT voucher_id, field, auto, corrected, context, supplier_key FROM ({KEYED_SQL}) WHERE field IN ('supplier_name', 'voucher_number') AND voucher_id % 2 = 0 UNION ALL SELECT voucher_id, field, auto, corrected, context, NULL FROM ({CELLS_SQL}) WHERE voucher_id % 2 = 0"


@query(f"""SELECT h.voucher_id, coalesce(n, 0) AS n, coalesce(places, '') AS places, round(coalesce(mean, 0), 9) AS model_confidence FROM ({HEADS}) h LEFT JOIN (
 SELECT voucher_id, count(*) AS n, string_agg(place || '=' || suggestion, '|' ORDER BY place) AS places, avg(confidence) AS mean FROM (
 {suggestions_sql(TAUGHT_SQL, f"{HEADED_SQL} UNION ALL SELECT voucher_id, place, field, auto, context, supplier_key FROM ({CELLS_SQL})")}) WHERE suggestion IS NOT NULL GROUP BY 1) USING (voucher_id)""")
def voucher_suggestions(spark, sf_dir):
    """Every voucher's suggestions for its header and items, out of what the even ones' corrections teach, with their mean confidence."""
    p = written(pairs(spark, sf_dir))
    part = vo.truth(spark, sf_dir).select("voucher_id", F.transform("items", lambda i: F.struct(F.concat(F.lit("ltem "), (i["part"] % 50).cast("string")).alias("item_name"), F.lit(None).cast("string").alias("quantity"), F.lit(None).cast("string").alias("unit_price"), F.lit(None).cast("string").alias("line_amount"))).alias("items"))
    even = examples(spark, sf_dir).where("voucher_id % 2 = 0 AND field IN ('supplier_name', 'voucher_number')")
    taught = part.where("voucher_id % 2 = 0").select("voucher_id", F.explode("items").alias("i")).select("voucher_id", F.lit("item_item_name").alias("field"), F.col("i.item_name").alias("auto"), F.replace("i.item_name", F.lit("ltem"), F.lit("Item")).alias("corrected"), F.lit(None).cast("string").alias("raw_ocr_text"), F.lit(None).cast("string").alias("supplier_name"))
    v = p.select("voucher_id", "raw_ocr_text", "original.supplier_name", "original.voucher_number").join(part, "voucher_id")
    made = context.voucher_suggestions(v, even.unionByName(taught))
    told = F.array_sort(F.transform(F.map_entries("suggestions"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["suggestion"])))
    return made.select("voucher_id", F.size("suggestions").cast("long").alias("n"), F.array_join(told, "|").alias("places"), F.round("model_confidence", 9).alias("model_confidence"))


@query(f"SELECT voucher_id, CAST(101 AS INT) AS start, CAST(101 + length(supplier_name) AS INT) AS \"end\", 'ORG' AS label FROM ({HEADS})")
def supplier_spans(spark, sf_dir):
    return context.spans(parsed(spark, sf_dir)).where("label = 'ORG'")


@query(f"SELECT voucher_id, CASE WHEN number_auto IS NULL AND supplier_auto <> supplier_name THEN NULL ELSE voucher_number END AS voucher_number, voucher_date, supplier_auto AS supplier_name FROM ({PAIRS_SQL})")
def applied_models(spark, sf_dir):
    """Numbers that the machine missed, found again by anchors of the supplier, where its name was read right."""
    p = written(pairs(spark, sf_dir))  # each model and each field reads it
    values = learn.value_model(learn.header_diffs(p))
    right = p.select("voucher_id", "raw_ocr_text", "corrected.supplier_name", "corrected.voucher_number", "corrected.voucher_date")
    machine = p.select("voucher_id", "raw_ocr_text", "original.supplier_name", "original.voucher_number", "original.voucher_date", "original.gross_total", "original.net_total")
    marks = written(learn.anchors(right, ("voucher_number", "voucher_date")))
    return context.apply_learned(machine, values, marks, fields=("voucher_number", "voucher_date")).select("voucher_id", "voucher_number", "voucher_date", "supplier_name")


ODD_SQL = r"len(regexp_extract_all(text, '[^\p{L}\p{N}_ \t\n\r\f./\-(),]')) / greatest(length(text), 1)"


@query(rf"""SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(0, 100 - CASE WHEN regexp_matches(text, '(?i)vouchernumber\d{{8,}}') THEN 20 ELSE 0 END - 5 * len(regexp_extract_all(text, '\d{{5,}}\.\d{{2}}'))
 - CASE WHEN contains(lower(text), 'date') THEN 0 ELSE 15 END - CASE WHEN contains(lower(text), 'total') THEN 0 ELSE 10 END - CASE WHEN contains(lower(text), 'voucher') THEN 0 ELSE 15 END
 - CASE WHEN {ODD_SQL} > 0.1 THEN CAST(floor({ODD_SQL} * 100) AS BIGINT) ELSE 0 END) END AS BIGINT) AS quality FROM documents""")
def structure_quality(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", evaluate.structure_quality(F.col("text")).alias("quality"))


@query(f"SELECT issue, count(*) AS n FROM (SELECT CASE WHEN voucher_id % 7 = 1 THEN 'label_without_value' WHEN voucher_id % 7 = 2 THEN 'too_short' WHEN voucher_id % 7 = 3 THEN 'has_vendor' END AS issue FROM ({HEADS})) WHERE issue IS NOT NULL GROUP BY issue")
def supplier_issues(spark, sf_dir):
    k = F.col("voucher_id") % 7
    v = profiled(spark, sf_dir, "base").withColumn("supplier_name", F.when(k == 1, None).when(k == 2, "AS").when(k == 3, F.concat("supplier_name", F.lit(" "), F.lower("vendor_details"))).otherwise(F.col("supplier_name")))
    return v.select(F.explode(evaluate.supplier_issues(F.col("raw_ocr_text"), F.col("supplier_name"), F.col("vendor_details"))).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query(f"SELECT kind, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS total FROM (SELECT CASE deduction_type WHEN 'Comm' THEN 'Commission' WHEN 'LessForDamages' THEN 'Less For Damages' WHEN 'L/FAndCash' THEN 'L/F and Cash' ELSE 'UnLoading' END AS kind, amount FROM ({LABELLED_SQL})) GROUP BY kind")
def canonical_deductions(spark, sf_dir):
    d = profiles.region_fields(regions(spark, sf_dir)).select(F.inline("deductions"))
    return d.groupBy(publish.canonical_kind(F.col("deduction_type")).alias("kind")).agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(18,2)").alias("total"))


@query(f"SELECT voucher_id, CAST(5 AS BIGINT) AS n, CAST({ALL_DEDUCTIONS} + 1 AS DECIMAL(12,2)) AS total FROM ({HEADS})")
def deduplicated_deductions(spark, sf_dir):
    """Four types that were found stay; of the computed ones only the type that none of them has."""
    v = profiles.region_fields(regions(spark, sf_dir)).withColumn("found", F.transform("deductions", lambda d: F.struct(publish.canonical_kind(d["deduction_type"]).alias("deduction_type"), d["amount"].alias("amount"))))
    computed = F.array(*[F.struct(F.lit(k).alias("deduction_type"), F.lit(1).cast("decimal(12,2)").alias("amount")) for k in ("Commission @4%", "Damage", "Other")])
    return v.withColumn("d", publish.one_of_each_kind(F.col("found"), computed)).select("voucher_id", F.size("d").cast("long").alias("n"), profiles.added(F.col("d"), "amount").alias("total"))


@query(f"SELECT count(*) AS n, count(*) FILTER (a > b) AS wins, count(*) FILTER (b > a) AS losses, count(*) FILTER (a = b) AS ties, avg(a) AS mean, avg(b) AS other_mean FROM (SELECT voucher_id, max(confidence) FILTER (attempt = 0) AS a, max(confidence) FILTER (attempt = 3) AS b FROM ({ATTEMPTS_SQL}) GROUP BY voucher_id)")
def compared_modes(spark, sf_dir):
    return attempts.compared_modes(tried(spark, sf_dir).withColumn("mode", F.concat(F.lit("m"), F.col("attempt").cast("string"))), "m0", "m3")


@query(f"SELECT voucher_id, CAST(95 AS INT) AS voucher_number, CAST(95 AS INT) AS date, CAST(90 AS INT) AS supplier, CAST(95 AS INT) AS amounts, CAST(70 AS INT) AS items FROM ({HEADS})")
def field_confidences(spark, sf_dir):
    c = attempts.field_confidence(F.col("raw_ocr_text"), F.lit(4))
    return vo.rendered(spark, sf_dir).withColumn("c", c).select("voucher_id", *[F.col(f"c.{f}").alias(f) for f in ("voucher_number", "date", "supplier", "amounts", "items")])


@query(f"SELECT count(*) AS n, count(*) AS with_auto, 0 AS without_auto, count(*) FILTER (least(aw, uw, ah, uh) < 20) AS n_small FROM ({BOXES_SQL})".replace("0 AS without", "CAST(0 AS BIGINT) AS without"))
def crop_scan(spark, sf_dir):
    return learn.crop_scan(boxes(spark, sf_dir))


@query(r"SELECT label, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\b([a-z]+)[\s:]*\d', 1)) AS label FROM documents) GROUP BY label ORDER BY n DESC, label LIMIT 20")
def frequent_labels(spark, sf_dir):
    return evaluate.frequent_labels(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")


# --- merged labels, lines, sessions, validation, the robust and the backup path ----------------------------------------


@query(_docs_sql(r"replace(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), '  ', ' ')"))
def split_merged(spark, sf_dir):
    return _docs(spark, sf_dir, text.split_merged)


@query(f"SELECT voucher_id, CASE WHEN day(voucher_date) >= 10 THEN voucher_date END AS voucher_date FROM ({HEADS})")
def split_merged_dates(spark, sf_dir):
    """Dates run into the number's label come back, but for those whose day's zero is taken for a prefix."""
    shown = F.col("raw_ocr_text")
    merged = F.regexp_replace(shown, r"Voucher Date (\d+)/(\d+)/(\d+)", "VoucherDate VoucherNumber$1$2$3")
    v = text.once(vo.rendered(spark, sf_dir), {"raw_ocr_text": text.split_merged(merged)})
    return v.select("voucher_id", values.calendar_date(text.first(shown, r"VoucherDate (\d+/\d+/\d+)")).alias("voucher_date"))


#: The vouchers that models learn from.
LEARNED_FROM = "('0x' || substr(md5(voucher_id::VARCHAR), 1, 8))::BIGINT % 100 < 80"


@query(f"WITH h AS (SELECT voucher_id, voucher_number FROM ({HEADS})) SELECT voucher_id, CASE WHEN voucher_number IN (SELECT voucher_number FROM h WHERE {LEARNED_FROM}) THEN voucher_number ELSE translate(voucher_number, '15', 'IS') END AS voucher_number FROM h WHERE NOT {LEARNED_FROM}")
def corrected_lines(spark, sf_dir):
    """The number on a line of its own, misread by rule, put right by what other vouchers taught of whole short lines.

    Four fifths of the vouchers teach, and the lines of the last fifth, which a hash sets apart, are corrected.
    """
    v = vo.truth(spark, sf_dir).select("voucher_id", "voucher_number")
    misread, taught = F.translate("voucher_number", "15", "IS"), evaluate.in_training(F.col("voucher_id"))
    diffs = v.where(taught).select("voucher_id", F.lit("voucher_number").alias("field"), misread.alias("auto"), F.col("voucher_number").alias("corrected")).where("auto <> corrected")
    # Whole lines stand for stretches: every letter of the model is learned in its line.
    model = learn.value_model(diffs).select(F.col("auto").alias("bad"), F.col("corrected").alias("good"), "n", "first_seen")
    texts = v.where(~taught).select("voucher_id", F.concat_ws("\n", F.lit("Voucher Number"), misread, F.lit("Date")).alias("raw_ocr_text"))
    return learn.correct_lines(texts, model).select("voucher_id", F.get(F.split("raw_ocr_text", "\n"), F.lit(1)).alias("voucher_number"))


@query(f"WITH m AS (SELECT avg(uw) AS w, avg(uh) AS h FROM ({DELTAS_SQL})) SELECT id, CASE WHEN abs(aw - w) > w * 0.1 THEN floor(w) ELSE aw END::DOUBLE AS width, CASE WHEN abs(ah - h) > h * 0.1 THEN floor(h) ELSE ah END::DOUBLE AS height FROM ({BOXES_SQL}), m")
def suggested_sizes(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return learn.suggest_size(b, learn.size_model(learn.crop_examples(b))).select("id", "sized.*")


TRAINED_SQL = f"SELECT voucher_id % 40 AS session, voucher_id % 40 AS ts, field, auto, corrected FROM ({DIFFS_SQL})"
LEARNED_SQL = f"SELECT field, auto, corrected, min(session) AS session, min(ts) AS ts FROM ({TRAINED_SQL}) GROUP BY 1, 2, 3"
SESSIONS_SQL = f"SELECT session, ts, n_corrections, coalesce(n_patterns, 0) AS n_patterns FROM (SELECT session, min(ts) AS ts, count(*) AS n_corrections FROM ({TRAINED_SQL}) GROUP BY session) LEFT JOIN (SELECT session, count(*) AS n_patterns FROM ({LEARNED_SQL}) GROUP BY session) USING (session)"


def trained(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Corrections by session (a batch of vouchers), and the patterns they gave."""
    c = written(learn.header_diffs(pairs(spark, sf_dir)).withColumns({"session": F.col("voucher_id") % 40, "ts": F.col("voucher_id") % 40}).drop("voucher_id"))
    return c, history.learned(c)


@query(SESSIONS_SQL)
def training_sessions(spark, sf_dir):
    return history.sessions(*trained(spark, sf_dir))


@query(f"SELECT count(*) AS n_sessions, CAST(sum(n_corrections) AS BIGINT) AS n_corrections, CAST(sum(n_patterns) AS BIGINT) AS n_patterns, max(ts) AS last_training FROM ({SESSIONS_SQL})")
def training_summary(spark, sf_dir):
    return history.summary(history.sessions(*trained(spark, sf_dir)))


@query(f"SELECT field, count(*) AS n FROM ({LEARNED_SQL}) GROUP BY field")
def patterns_by_field(spark, sf_dir):
    return history.by_field(trained(spark, sf_dir)[1])


@query(f"SELECT session, ts, n_corrections, n_patterns FROM ({SESSIONS_SQL}) ORDER BY ts DESC, session DESC LIMIT 5")
def recent_sessions(spark, sf_dir):
    return history.recent_sessions(history.sessions(*trained(spark, sf_dir)))


@query(f"SELECT field, auto, corrected, session, ts FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY ts DESC, session DESC, auto DESC NULLS LAST, corrected DESC NULLS LAST) AS k FROM ({LEARNED_SQL})) WHERE k <= 3")
def last_patterns(spark, sf_dir):
    return history.last_patterns(trained(spark, sf_dir)[1])


@query(f"SELECT count(*) AS n, count(*) FILTER (voucher_id * 7 % 100 >= 60) AS well_read, count(*) FILTER (voucher_id % 6 NOT IN (1, 5)) AS parsed, count(*) FILTER (voucher_id * 7 % 100 >= 60) - count(*) FILTER (voucher_id % 6 NOT IN (1, 5)) AS gap FROM ({HEADS})")
def quality_gap(spark, sf_dir):
    v = profiles.extract(vo.rendered(spark, sf_dir, noisy=True), "base").withColumn("confidence", F.col("voucher_id") * 7 % 100)
    return evaluate.quality_gap(v, SCORED)


@query(f"SELECT count(*) AS n, " + ", ".join(f"count(*) AS has_{f}" for f in ("voucher_number", "voucher_date", "supplier_name", "net_total")) + f" FROM ({HEADS}) WHERE voucher_id % 6 IN (1, 5)")
def recovered(spark, sf_dir):
    """What the v2 profile finds in the texts in which the base one missed a field."""
    lost = evaluate.failed(profiles.extract(vo.rendered(spark, sf_dir, noisy=True), "base"), SCORED)
    return evaluate.coverage(extract.extract_v2(lost), ("voucher_number", "voucher_date", "supplier_name", "net_total"))


@query(f"SELECT voucher_id, 'Supp Name ' || supplier_name AS line, lower('Supp Name ' || supplier_name) AS context, CAST(1 AS BIGINT) AS n, strftime(voucher_date, 'R\nVoucher Date %d/%m/%Y') AS head FROM ({HEADS})".replace("R\\n", "R\n"))
def supplier_contexts(spark, sf_dir):
    t, s = F.col("raw_ocr_text"), F.col("supplier_name")
    c = evaluate.contexts(t, s, 25)
    head = F.substring_index(F.substring_index(evaluate.around(t, s), "\nSupp", 1), "PURCHASE", -1)
    return parsed(spark, sf_dir).select("voucher_id", evaluate.line_with(t, s).alias("line"), F.get(c, F.lit(0)).alias("context"), F.size(c).cast("long").alias("n"), head.alias("head"))


VALIDATED = ("voucher_number", "voucher_date", "supplier_name", "gross_total")


def validation(spark, sf_dir, held_out: bool) -> tuple[DataFrame, DataFrame]:
    """Accuracy by field of the base profile over misread texts, without and with what the corrections teach.

    With held_out, models learn from four fifths of the vouchers, and accuracy is that of the fifth that a hash of the
    key sets apart; else models learn from all vouchers, and all are scored.
    """
    right = written(vo.truth(spark, sf_dir).select("voucher_id", *VALIDATED))
    made = written(profiles.extract(vo.rendered(spark, sf_dir, noisy=True), "base", heads_only=True).select("voucher_id", "raw_ocr_text", *VALIDATED, "net_total"))
    both = made.select("voucher_id", "raw_ocr_text", F.struct(*VALIDATED).alias("original")).join(right.select("voucher_id", F.struct(*VALIDATED).alias("corrected")), "voucher_id")
    if held_out:
        both = both.where(evaluate.in_training(F.col("voucher_id")))
    model = learn.value_model(learn.header_diffs(both, VALIDATED))
    marks = written(learn.anchors(both.select("voucher_id", "raw_ocr_text", "corrected.*"), VALIDATED[:2]))  # each field reads the small model
    if held_out:
        made = made.where(~evaluate.in_training(F.col("voucher_id")))
    after = context.apply_learned(made, model, marks, fields=VALIDATED[:2])
    return evaluate.field_accuracy(made, right, VALIDATED), evaluate.field_accuracy(after, right, VALIDATED)


#: Misread names leave the supplier out, and with it the anchors; a misread number is found by the supplier's anchor.
@query(" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS n, avg({before}) AS before, avg({after}) AS after FROM ({HEADS})" for f, before, after in (("voucher_number", "(voucher_id % 6 <> 5)::INT::DOUBLE", "1.0::DOUBLE"), ("supplier_name", "(voucher_id % 6 <> 1)::INT::DOUBLE", "(voucher_id % 6 <> 1)::INT::DOUBLE"), ("voucher_date", "1.0::DOUBLE", "1.0::DOUBLE"), ("gross_total", "1.0::DOUBLE", "1.0::DOUBLE"))))
def validated_fields(spark, sf_dir):
    before, after = validation(spark, sf_dir, held_out=False)
    return before.select("field", "n", F.col("accuracy").alias("before")).join(after.select("field", F.col("accuracy").alias("after")), "field")


TRAINING = "('0x' || substr(md5(voucher_id::VARCHAR), 1, 8))::BIGINT % 100 < 80"
SHARES_SQL = " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS n, avg({a}) AS a, avg({b}) AS b FROM ({HEADS}) WHERE NOT {TRAINING}" for f, a, b in (("voucher_number", "(voucher_id % 6 <> 5)::INT::DOUBLE", "1.0::DOUBLE"), ("supplier_name", "(voucher_id % 6 <> 1)::INT::DOUBLE", "(voucher_id % 6 <> 1)::INT::DOUBLE"), ("voucher_date", "1.0::DOUBLE", "1.0::DOUBLE"), ("gross_total", "1.0::DOUBLE", "1.0::DOUBLE")))
IMPROVED_SQL = f"SELECT field, n, round_even(a * 100, 1) AS before, round_even(b * 100, 1) AS after, round_even((b - a) * 100, 1) AS absolute, round_even(CASE WHEN a > 0 THEN (b - a) / a * 100 WHEN b = 0 THEN 0 ELSE 100 END, 1) AS percent FROM ({SHARES_SQL}) WHERE n >= 10"


@query(IMPROVED_SQL)
def training_improvement(spark, sf_dir):
    """What the models of four fifths of the vouchers give on the fifth that they never saw."""
    return evaluate.improvement(*validation(spark, sf_dir, held_out=True)).select("field", "n", "before", "after", "absolute", "percent")


@query(f"SELECT count(*) AS n_fields, round_even(avg(percent), 1) AS mean_percent, arg_min(field, (-percent, field)) AS best_field FROM ({IMPROVED_SQL})")
def improvement_summary(spark, sf_dir):
    return evaluate.improvement_summary(evaluate.improvement(*validation(spark, sf_dir, held_out=True)))


@query(f"SELECT voucher_id, voucher_number, voucher_date, 'review' AS action, CAST(0 AS BIGINT) AS n_warnings FROM ({HEADS})")
def robust_path(spark, sf_dir):
    """Three readings of each voucher, one of them misread, through the robust path."""
    clean, t = vo.rendered(spark, sf_dir), F.col("raw_ocr_text")
    tries = [(0, t), (1, F.replace(t, F.lit("Voucher Number"), F.lit("V0ucher Numb"))), (2, t)]
    rows = clean.select("voucher_id", F.inline(F.array(*[F.struct(F.lit(i).alias("attempt"), x.alias("text"), F.lit(70.0).alias("confidence")) for i, x in tries])))
    p = written(pairs(spark, sf_dir))
    diffs = learn.header_diffs(p)
    right = p.select("voucher_id", "raw_ocr_text", "corrected.supplier_name", "corrected.voucher_number", "corrected.voucher_date")
    marks = written(learn.anchors(right, ("voucher_number", "voucher_date")))  # each field reads the small model
    made = robust.routed(rows, learn.substitutions(diffs), learn.value_model(diffs), marks)
    return made.select("voucher_id", "voucher_number", "voucher_date", "action", F.size("warnings").cast("long").alias("n_warnings"))


@query(f"SELECT voucher_id, voucher_number, voucher_date, CASE WHEN voucher_id % 6 <> 1 THEN supplier_name END AS supplier_name, gross_total, CAST(total_deductions + CASE WHEN voucher_id % 6 = 2 THEN net_total ELSE 0 END AS DECIMAL(12,2)) AS total_deductions, net_total FROM ({FIELDS_SQL})")
def backup_fields(spark, sf_dir):
    """Over misread texts as they are. A misread grand total is found by its likeness, yet doesn't end the deductions."""
    return backup.extract(vo.rendered(spark, sf_dir, noisy=True), dictionary(spark, sf_dir), corrected=False).select("voucher_id", *HEAD_FIELDS)


# After the chain: net with two noughts before its last digit where it has four before the point (a net that is tagged as
# the voucher's number is lost), items untagged, and a last total misread as a deduction (key 2) counted among them.
LARGE_NET = f"CASE WHEN {NET} < 1000 THEN {NET} ELSE floor({NET} / 10) * 1000 + {NET} - floor({NET} / 10) * 10 END"
BACKUP_NOISY_SQL = f"SELECT h.*, i.n AS plain, floor({NET}) = CAST(voucher_number AS INT) AS tagged, CAST({LARGE_NET} AS DECIMAL(12,2)) AS net FROM ({HEADS}) h JOIN (SELECT voucher_id, count(*) FILTER (WHERE 100 + voucher_id % 900 NOT IN (floor(unit_price), floor(line_amount))) AS n FROM ({ITEMS}) GROUP BY voucher_id) i USING (voucher_id)"
BACKUP_NOISY_SQL = f"SELECT *, CASE WHEN NOT tagged OR voucher_id % 6 = 2 THEN net END AS net_total, voucher_id % 6 = 2 AND NOT tagged AS counted FROM ({BACKUP_NOISY_SQL})"
BACKUP_NOISY_SQL = f"SELECT *, CAST({ALL_DEDUCTIONS} + CASE WHEN counted THEN net ELSE 0 END AS DECIMAL(12,2)) AS total_deductions FROM ({BACKUP_NOISY_SQL})"
BACKUP_NOISY_SQL = f"SELECT *, abs(gross_total - total_deductions - net_total) AS off, 60 + CASE WHEN net_total IS NULL THEN 0 ELSE 20 END + least(20, 5 * plain) AS points FROM ({BACKUP_NOISY_SQL})"


@query(f"SELECT voucher_id, voucher_number, CAST(NULL AS DATE) AS voucher_date, supplier_name, gross_total, total_deductions, net_total, round(points / 120 * 100, 2) AS parse_confidence, CASE WHEN off > 1 THEN off END AS mismatch, CAST(plain AS INT) AS n_items, CAST(4 + CAST(counted AS INT) AS INT) AS n_deductions FROM ({BACKUP_NOISY_SQL})")
def backup_noisy_fields(spark, sf_dir):
    """After the correction chain, which takes years beside a voucher's label for numbers, and so loses dates."""
    made = backup.extract(vo.rendered(spark, sf_dir, noisy=True), dictionary(spark, sf_dir))
    return made.select("voucher_id", *HEAD_FIELDS, "parse_confidence", "mismatch", F.size("items").alias("n_items"), F.size("deductions").alias("n_deductions"))


@query(f"SELECT voucher_id, 'Item' AS item_name, CAST(quantity AS DECIMAL(10,2)) AS quantity, CAST(unit_price AS DECIMAL(10,2)) AS unit_price, line_amount FROM ({ITEMS})")
def region_items(spark, sf_dir):
    table = F.substring_index(F.substring_index("raw_ocr_text", "\nTotal", 1), "\nSupp", -1)
    v = vo.rendered(spark, sf_dir).select("voucher_id", F.regexp_replace(table, r"^[^\n]*\n", "").alias("t"))
    return v.select("voucher_id", F.inline(profiles.region_items(F.col("t"))))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier spend recovered from text."""
    return supplier_spend(spark, sf_dir)
