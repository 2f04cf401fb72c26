"""What surrounds a corrected value: label contexts, suppliers, places, neighbouring words; suggestions out of them.

Examples are rows (voucher_id, field, auto, corrected, raw_ocr_text, supplier_name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmill.functions.values import MONEY, any_date, number
from slipmill.operators.learn import best, find_all, pattern_model, suggest
from slipmill.sources.folders import by_size

#: The labels whose presence makes a field's context.
MARKERS = {
    "voucher_number": (r"voucher\s*number", r"vouchernumber", r"nuaber", r"nunber"), "voucher_date": (r"voucher\s*date", r"voucherdate", r"date"),
    "supplier_name": (r"supp\s*name", r"suppname", r"name", r"nane", r"supplier"), "gross_total": (r"gross", r"total", r"amount"), "net_total": (r"net", r"grand", r"final"),
}


def context_key(field: Column, text: Column) -> Column:
    """The field's labels that are in the text, sorted; null without any."""
    found = lambda marks: F.array_join(F.array_compact(F.array(*[F.when(text.rlike(f"(?i){m}"), F.lit(m)) for m in sorted(marks)])), "|")
    key = F.lit(None).cast("string")
    for name, marks in MARKERS.items():
        key = F.when(field == name, found(marks)).otherwise(key)
    return F.nullif(key, F.lit(""))


def counted(examples: DataFrame, *keys: str) -> DataFrame:
    """(keys, corrected, n, first_seen) of examples whose keys aren't null."""
    ok = examples.where("corrected IS NOT NULL").dropna(subset=list(keys))
    return ok.groupBy(*keys, "corrected").agg(F.count("*").alias("n"), F.min("voucher_id").alias("first_seen"))


def context_model(examples: DataFrame) -> DataFrame:
    return counted(examples.withColumn("context", context_key(F.col("field"), F.col("raw_ocr_text"))), "field", "context")


def supplier_model(examples: DataFrame) -> DataFrame:
    return counted(examples.withColumn("supplier_key", F.upper(F.trim("supplier_name"))), "supplier_key", "field")


def _line(examples: DataFrame, holds: Column) -> tuple[DataFrame, Column]:
    rows = examples.withColumn("_lines", F.split("raw_ocr_text", "\n"))
    return rows.withColumn("_at", F.array_position(F.transform("_lines", lambda x: holds(x)), True) - 1), F.get("_lines", F.col("_at").cast("int"))


def placed(examples: DataFrame) -> DataFrame:
    """examples whose text has a line with the value, with `place`: beginning (first 0.3), middle (to 0.7) or end of the lines."""
    rows, _ = _line(examples, lambda x: F.coalesce(x.contains(F.col("auto")), F.lit(False)) | F.coalesce(x.contains(F.col("corrected")), F.lit(False)))
    ratio = F.col("_at") / F.size("_lines")
    return rows.where("_at >= 0").withColumn("place", F.when(ratio < 0.3, "beginning").when(ratio < 0.7, "middle").otherwise("end")).drop("_at", "_lines")


def position_model(examples: DataFrame) -> DataFrame:
    """(field, place, n): whether values stand at the beginning, middle or end of their texts."""
    return placed(examples).groupBy("field", "place").agg(F.count("*").alias("n"))


def neighbours(examples: DataFrame) -> DataFrame:
    """examples by the words (side, word) right before and after the corrected value, on the first line that has it."""
    rows, line = _line(examples.where("corrected <> ''"), lambda x: x.contains(F.col("corrected")))
    at = F.instr(F.col("_x"), F.col("corrected"))
    before, after = F.trim(F.substring("_x", F.lit(1), at - 1)), F.trim(F.substring("_x", at + F.length("corrected"), F.length("_x")))
    word = lambda c, i: F.nullif(F.element_at(F.split(c, r"\s+"), i), F.lit(""))
    both = F.array(F.struct(F.lit("before").alias("side"), word(before, -1).alias("word")), F.struct(F.lit("after").alias("side"), word(after, 1).alias("word")))
    return rows.where("_at >= 0").withColumn("_x", line).select(*examples.columns, F.inline(both)).where("word IS NOT NULL")


def neighbour_model(examples: DataFrame) -> DataFrame:
    """(field, side, word, n): the words right before and after corrected values."""
    return neighbours(examples).groupBy("field", "side", "word").agg(F.count("*").alias("n"))


def pruned(patterns: DataFrame, as_of: str, days: int = 90, least: float = 0.3) -> DataFrame:
    """patterns (confidence, last_seen) without those that are older than so many days and unsure."""
    old = F.col("last_seen") < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return patterns.where(~(old & (F.col("confidence") < least)))


def suggestions(rows: DataFrame, examples: DataFrame, *keep: str) -> DataFrame:
    """(voucher_id, keep, field, auto, suggestion, confidence, source, alternatives) for rows like examples without corrected.

    Three models offer a value: patterns of the field's value (0.5 or surer), its context (0.5, weighed 0.9), its
    supplier (0.4, weighed 0.95). Where models agree, the value is worth 0.1 more than the surest, up to 0.98. The
    surest is suggested from 0.7 on; ties go to the order above. The models' best values are joined on their keys.
    """
    offer = lambda v, c, least, weight, source, i: F.when(F.col(c) >= least, F.struct(F.col(v).alias("value"), (F.col(c) * weight).alias("confidence"), F.lit(source).alias("source"), F.lit(-i).alias("ord")))
    keyed = rows.withColumns({"key": F.concat("field", F.lit(":"), F.lower(F.trim("auto"))), "context": context_key(F.col("field"), F.col("raw_ocr_text")), "supplier_key": F.upper(F.trim("supplier_name"))})
    p = pattern_model(examples).select("key", F.col("corrected").alias("_pv"), F.col("confidence").alias("_pc"))
    c = best(context_model(examples), ["field", "context"], "corrected").select("field", "context", F.col("corrected").alias("_cv"), F.col("share").alias("_cc"))
    s = best(supplier_model(examples), ["supplier_key", "field"], "corrected").select("supplier_key", "field", F.col("corrected").alias("_sv"), F.col("share").alias("_sc"))
    found = keyed.drop("raw_ocr_text").join(by_size(p), "key", "left").join(by_size(c), ["field", "context"], "left").join(by_size(s), ["supplier_key", "field"], "left")
    offers = F.array_compact(F.array(offer("_pv", "_pc", 0.5, 1.0, "pattern", 0), offer("_cv", "_cc", 0.5, 0.9, "context", 1), offer("_sv", "_sc", 0.4, 0.95, "supplier", 2)))

    def agreed(x: Column) -> Column:
        same = F.filter("_o", lambda y: y["value"] == x["value"])
        sure = F.least(F.lit(0.98), F.array_max(F.transform(same, lambda y: y["confidence"])) + 0.1)
        return F.when(F.size(same) > 1, F.struct(x["value"].alias("value"), sure.alias("confidence"), F.lit("combined").alias("source"), F.lit(-3).alias("ord")))

    found = found.withColumn("_o", offers).withColumn("_all", F.concat("_o", F.array_distinct(F.array_compact(F.transform("_o", agreed)))))
    top = F.array_max(F.transform("_all", lambda x: F.struct(x["confidence"].alias("confidence"), x["ord"].alias("ord"), x["value"].alias("value"), x["source"].alias("source"))))
    found = found.withColumn("_b", top)
    others = F.slice(F.transform(F.filter("_all", lambda x: x["value"] != F.col("_b.value")), lambda x: F.struct(x["value"].alias("value"), x["confidence"].alias("confidence"))), 1, 3)
    return found.select("voucher_id", *keep, "field", "auto", F.when(F.col("_b.confidence") >= 0.7, F.col("_b.value")).alias("suggestion"), F.coalesce("_b.confidence", F.lit(0.0)).alias("confidence"), F.col("_b.source").alias("source"), others.alias("alternatives"))


ITEM_FIELDS = ("item_name", "quantity", "unit_price", "line_amount")
HEAD_FIELDS = ("supplier_name", "voucher_date", "voucher_number", "gross_total", "net_total")


def voucher_suggestions(vouchers: DataFrame, examples: DataFrame, least: float = 0.7) -> DataFrame:
    """vouchers (voucher_id, raw_ocr_text, header fields, items) with `suggestions` and model_confidence.

    suggestions is a map from a place (a header field, or items[i].field) to the value, confidence and source that
    suggestions() gives for it, of `least` confidence; nothing is applied. model_confidence is their mean, 0 without any.
    Item fields are looked up as item_<field>. A voucher's fields meet the models as rows without its text.
    """
    row = lambda place, field, auto: F.struct(place.alias("place"), field.alias("field"), auto.cast("string").alias("auto"))
    heads = [row(F.lit(f), F.lit(f), F.col(f)) for f in HEAD_FIELDS if f in vouchers.columns]
    cells = F.array().cast("array<struct<place:string,field:string,auto:string>>")
    if "items" in vouchers.columns:
        own = lambda i, n: F.array(*[row(F.concat(F.lit("items["), n.cast("string"), F.lit(f"].{f}")), F.lit(f"item_{f}"), i[f]) for f in ITEM_FIELDS])
        cells = F.coalesce(F.flatten(F.transform("items", own)), cells)
    rows = vouchers.select("voucher_id", "raw_ocr_text", "supplier_name", F.inline(F.concat(F.array(*heads), cells)))
    sure = suggestions(rows, examples, "place").where(F.col("suggestion").isNotNull() & (F.col("confidence") >= least))
    told = F.map_from_entries(F.array_sort(F.collect_list(F.struct("place", F.struct("suggestion", "confidence", "source").alias("v")))))
    made = sure.groupBy("voucher_id").agg(told.alias("suggestions"), F.avg("confidence").alias("model_confidence"))
    none = F.create_map().cast("map<string,struct<suggestion:string,confidence:double,source:string>>")
    return vouchers.join(made, "voucher_id", "left").withColumns({"suggestions": F.coalesce("suggestions", none), "model_confidence": F.coalesce("model_confidence", F.lit(0.0))})


LABELS = {"supplier_name": "ORG", "voucher_date": "DATE", "gross_total": "MONEY", "net_total": "MONEY", "total_deductions": "MONEY"}


def spans(rows: DataFrame) -> DataFrame:
    """(voucher_id, start, end, label): where trusted values first stand in the text, whatever their case.

    Amounts are looked for with two decimals, then whole. A span that overlaps one of an earlier field is left out.
    """
    text = F.lower("raw_ocr_text")

    def place(query: Column, label: str) -> Column:
        at = F.instr(text, F.lower(query)) - 1
        return F.when((F.length(query) > 0) & (at >= 0), F.struct(at.cast("int").alias("start"), (at + F.length(query)).cast("int").alias("end"), F.lit(label).alias("label")))

    kinds = dict(rows.dtypes)
    tries = []
    for f, label in LABELS.items():
        if f in kinds:
            value = F.col(f).cast("string")
            queries = [value] if label != "MONEY" else [F.col(f).cast(MONEY).cast("string"), F.bround(F.col(f), 0).cast("long").cast("string")]
            tries.append(F.array_compact(F.array(*[place(q, label) for q in queries])))

    def add(acc: Column, options: Column) -> Column:
        free = F.filter(options, lambda o: ~F.exists(acc, lambda s: (o["start"] < s["end"]) & (o["end"] > s["start"])))
        return F.concat(acc, F.slice(free, 1, 1))

    made = F.aggregate(F.array(*tries), F.array().cast("array<struct<start:int,end:int,label:string>>"), add)
    return rows.select("voucher_id", F.inline(made))


#: How the value behind an anchor is read, by field.
READ = {"voucher_number": lambda v: F.regexp_extract(v, r"^(\S+)", 1), "voucher_date": any_date, "gross_total": lambda v: number(v).cast(MONEY), "net_total": lambda v: number(v).cast(MONEY)}


def learned_items(vouchers: DataFrame, values: DataFrame, least: float = 0.7) -> DataFrame:
    """vouchers whose items have the values that people put in the place of theirs, where a model value (item_<field>) is sure.

    Only values that the model knows are joined back, as a map of each voucher's few changes.
    """
    known = by_size(best(values.where(F.col("field").startswith("item_")), ["field", "auto"], "corrected").where(F.col("share") > least).select("field", "auto", "corrected"))
    kinds = {f.name: f.dataType for f in vouchers.schema["items"].dataType.elementType.fields}
    cells = F.array(*[F.struct(F.lit(f"item_{f}").alias("field"), F.col(f"i.{f}").cast("string").alias("auto")) for f in ITEM_FIELDS])
    rows = vouchers.select("voucher_id", F.posexplode("items").alias("at", "i")).select("voucher_id", "at", F.inline(cells)).where("auto IS NOT NULL")
    changes = rows.join(known, ["field", "auto"]).groupBy("voucher_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "at", "field"), "corrected"))).alias("_c"))
    found = lambda f, n: F.try_element_at("_c", F.concat_ws(":", n, F.lit(f"item_{f}")))
    fixed = F.transform("items", lambda i, n: F.struct(*[F.coalesce(found(f, n).try_cast(kind), i[f]).alias(f) if f in ITEM_FIELDS else i[f].alias(f) for f, kind in kinds.items()]))
    return vouchers.join(changes, "voucher_id", "left").withColumn("items", F.when(F.col("_c").isNull(), F.col("items")).otherwise(fixed)).drop("_c")


def merged_deductions(deductions: Column, found: Column) -> Column:
    """Deductions with the amounts of `found` (a map by type), in the place of theirs or after them; one of each type, the last."""
    own = F.coalesce(deductions, F.array().cast("array<struct<deduction_type:string,amount:decimal(12,2)>>"))
    last = F.transform(F.array_distinct(F.transform(own, lambda d: d["deduction_type"])), lambda t: F.element_at(F.filter(own, lambda d: d["deduction_type"].eqNullSafe(t)), -1))
    kept = F.transform(last, lambda d: F.struct(d["deduction_type"].alias("deduction_type"), F.coalesce(F.try_element_at(found, d["deduction_type"]), d["amount"]).cast(MONEY).alias("amount")))
    more = F.filter(F.array_sort(F.map_keys(found)), lambda t: ~F.exists(last, lambda d: d["deduction_type"].eqNullSafe(t)))
    added = F.transform(more, lambda t: F.struct(t.alias("deduction_type"), F.try_element_at(found, t).cast(MONEY).alias("amount")))
    return F.when(found.isNull(), deductions).otherwise(F.concat(kept, added))


def apply_learned(vouchers: DataFrame, values: DataFrame, anchors: DataFrame, least: float = 0.8, fields: tuple[str, ...] = tuple(READ)) -> DataFrame:
    """vouchers with supplier_name_suggested, and `fields` (of number, date and totals) as learned anchors find them (surer than
    `least`); what no anchor finds stays as it was.

    If there are items, values that the model is sure of (0.7) take the place of theirs; if there are deductions, those
    that an anchor of their type finds above 0 do, and types that are only found so are added. All anchors are looked for
    in one pass, and come back by one join.
    """
    wanted = F.col("field").isin(*fields) | (F.col("field").startswith("deduction_") if "deductions" in vouchers.columns else F.lit(False))
    found = find_all(vouchers.select("voucher_id", "raw_ocr_text", "supplier_name"), anchors.where(wanted)).where(F.col("confidence") > least)
    found = found.groupBy("voucher_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_found"))
    out = suggest(vouchers, values, "supplier_name").join(found, "voucher_id", "left")
    out = out.withColumns({f: F.coalesce(READ[f](F.try_element_at("_found", F.lit(f))), F.col(f)) for f in fields})
    if "deductions" in vouchers.columns:
        less = F.transform(F.filter(F.map_entries("_found"), lambda e: e["key"].startswith("deduction_")), lambda e: F.struct(F.substring(e["key"], 11, 1000).alias("key"), number(e["value"]).cast(MONEY).alias("value")))
        out = out.withColumn("deductions", merged_deductions(F.col("deductions"), F.map_from_entries(F.filter(less, lambda e: e["value"] > 0))))
    out = out.drop("_found")
    return learned_items(out, values) if "items" in vouchers.columns else out
