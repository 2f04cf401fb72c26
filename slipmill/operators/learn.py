"""Corrections into model tables, and the tables applied again. Models are counts; the best value is picked by window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipmill.functions.fuzzy import ratio, replaced_blocks
from slipmill.functions.text import let, once
from slipmill.operators.similar import matching
from slipmill.sources.folders import by_size, written

FIELDS = ("supplier_name", "voucher_date", "voucher_number", "gross_total", "net_total")


def header_diffs(pairs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(voucher_id, field, auto, corrected) where both versions of a voucher differ (columns original and corrected)."""
    rows = F.array_compact(F.array(*[
        F.when(~F.col(f"original.{f}").eqNullSafe(F.col(f"corrected.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"original.{f}").cast("string").alias("auto"), F.col(f"corrected.{f}").cast("string").alias("corrected")))
        for f in fields
    ]))
    return pairs.select("voucher_id", F.inline(rows))


def item_diffs(pairs: DataFrame) -> DataFrame:
    """(voucher_id, item_index, field, auto, corrected) of items paired by position, up to the shorter list."""
    both = F.arrays_zip(F.col("original.items").alias("o"), F.col("corrected.items").alias("c"))
    n = F.least(F.size("original.items"), F.size("corrected.items"))
    rows = pairs.select("voucher_id", F.posexplode(F.slice(both, F.lit(1), F.greatest(n, F.lit(0)))).alias("item_index", "p"))
    each = F.array_compact(F.array(*[
        F.when(~F.col(f"p.o.{f}").eqNullSafe(F.col(f"p.c.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"p.o.{f}").cast("string").alias("auto"), F.col(f"p.c.{f}").cast("string").alias("corrected")))
        for f in ("item_name", "quantity", "unit_price", "line_amount")
    ]))
    return rows.select("voucher_id", "item_index", F.inline(each))


def value_model(diffs: DataFrame) -> DataFrame:
    """(field, auto, corrected, n, first_seen): how often a value was corrected to another; both non-empty."""
    ok = diffs.where("coalesce(auto, '') <> '' AND coalesce(corrected, '') <> '' AND auto <> corrected")
    return ok.groupBy("field", "auto", "corrected").agg(F.count("*").alias("n"), F.min("voucher_id").alias("first_seen"))


def best(model: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A row per key: the value of the highest count (the earliest seen on ties), the key's total, and its share."""
    return model.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first_seen"))).alias(value), F.max("n").alias("n"), F.sum("n").alias("total")).withColumn("share", F.col("n") / F.col("total"))


def suggest(rows: DataFrame, model: DataFrame, field: str, least: float = 0.7) -> DataFrame:
    """rows with <field>_suggested: the model's best value for the field where its share is over `least`, else null."""
    m = best(model.where(F.col("field") == field), ["auto"], "corrected").where(F.col("share") > least).select(F.col("auto").alias(field), F.col("corrected").alias(f"{field}_suggested"))
    return rows.join(by_size(m), field, "left")


def substitutions(diffs: DataFrame) -> DataFrame:
    """(bad, good, n, first_seen): short stretches that corrections replaced, from distinct pairs weighed by count."""
    pairs = diffs.where("auto IS NOT NULL AND corrected IS NOT NULL AND auto <> corrected").groupBy("auto", "corrected").agg(F.count("*").alias("w"), F.min("voucher_id").alias("first_seen"))
    blocks = pairs.select(F.inline(replaced_blocks(F.col("auto"), F.col("corrected"))), "w", "first_seen")
    return blocks.groupBy("bad", "good").agg(F.sum("w").alias("n"), F.min("first_seen").alias("first_seen"))


def apply_substitutions(rows: DataFrame, model: DataFrame, column: str, least: float = 0.8, uses: int = 2, longest: int = 4) -> DataFrame:
    """rows with learned substitutions folded over a text column, in the order in which they were first seen.

    Each distinct text meets those of its stretches (of `longest` characters at most, as substitutions() makes them) that
    the model knows, by a join; texts that change are looked up again, for stretches that only replacements make, until
    none gets a new one. So no text is folded over more than its own substitutions, however large the model.
    """
    model = written(model, "model")
    firsts = model.groupBy("bad").agg(F.min("first_seen").alias("first_seen"))
    sure = written(best(model, ["bad"], "good").join(firsts, "bad").where((F.col("share") >= least) & (F.col("total") >= uses)).select("bad", "good", "first_seen"), "sure")  # each round reads it
    fold = lambda text, subs: F.aggregate(subs, text, lambda acc, s: F.replace(acc, s["bad"], s["good"]))
    stretch = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_now") - n + 1, F.lit(1))), lambda i: F.substring("_now", i, F.lit(n)))
    none = F.array().cast("array<struct<first_seen:bigint,bad:string,good:string>>")
    texts = rows.select(F.col(column).alias("_text")).where("_text IS NOT NULL").distinct().select("_text", F.col("_text").alias("_now"), none.alias("_subs"))
    while True:
        parts = texts.select("_text", F.explode(F.array_distinct(F.flatten(F.array(*[stretch(n) for n in range(1, longest + 1)])))).alias("bad"))
        own = parts.join(sure, "bad").groupBy("_text").agg(F.collect_set(F.struct(F.col("first_seen").cast("long").alias("first_seen"), "bad", "good")).alias("_own"))
        every = F.array_sort(F.array_union("_subs", F.coalesce("_own", none)))
        step = texts.join(own, "_text", "left").select("_text", F.size("_subs").alias("_had"), every.alias("_subs")).withColumn("_now", fold(F.col("_text"), F.col("_subs")))
        texts = written(step, "texts")  # distinct texts of a field; each round's plan begins there
        if texts.where("size(_subs) > _had").isEmpty():
            break
        texts = texts.drop("_had")
    return rows.join(texts.select(F.col("_text").alias(column), "_now"), column, "left").withColumn(column, F.coalesce("_now", column)).select(rows.columns)


def _before(text: Column, value: Column, reach: int = 30) -> Column:
    """Of a text that has the value, the characters before its last place, `reach` at most; null where it stands first.

    Matches of a pattern don't overlap, so a place of the value within reach before the last one may cut what is before
    it. Only there, and where letters beyond ASCII are to be compared in any case, the pattern itself is looked for;
    all other places are found by string functions.
    """
    found = F.regexp_extract_all(text, F.concat(F.lit(rf"(?is)(.{{1,{reach}}})\Q"), F.replace(value, F.lit("\\E"), F.lit("")), F.lit(r"\E")), F.lit(1))
    searched = F.try_element_at(found, F.lit(-1))
    ascii_ = lambda c: F.octet_length(c) == F.length(c)
    folded = F.when((value != "") & ~value.contains("\\E"), F.when(ascii_(text) & ascii_(value), F.lower(text)).when(value.rlike(r"^[\d\s/.,:\-]+$"), text))
    size = F.length(value)

    def placed(hay: Column) -> Column:
        at = F.length(hay) - F.length(F.call_function("substring_index", hay, F.lower(value), F.lit(-1))) - size  # characters before the last place

        def cut(p: Column) -> Column:
            low = F.greatest(p - reach - size + 1, F.lit(0))
            alone = F.instr(F.substring(hay, low + 1, p + size - low), F.lower(value)) == p - low + 1
            start = F.greatest(p - reach, F.lit(0))
            return F.when(p > 0, F.when(alone, F.substring(text, start + 1, p - start)).otherwise(searched))

        return let(at, cut)

    return let(folded, lambda hay: F.when(hay.isNull(), searched).otherwise(placed(hay)))


def anchor(text: Column, value: Column) -> Column:
    """The last four words of the 30 characters before the value's last place in the text; null if shorter than 3."""
    last = F.substring_index(_before(text, value), "\n", -1)
    words = lambda before: F.array_remove(F.split(F.regexp_replace(before, r"[\s:\-=.]+$", ""), r"\s+"), "")
    made = let(let(last, words), lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - 3, F.lit(1)), F.lit(4)), " "))
    # The search is costly where it fails, so it starts only where the value is.
    return F.when(F.lower(text).contains(F.lower(value)), let(made, lambda m: F.when(F.length(m) > 2, m)))


def anchors(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(supplier_key, field, anchor, n, first_seen) from vouchers with their text and right values."""
    kinds, patterns = dict(rows.dtypes), ("dd/MM/yyyy", "dd-MM-yyyy", "d/M/yyyy", "dd.MM.yyyy", "dd/MM/yy")
    # Made once: filters on what is found, and what refers to a value in several ways, would have extraction repeated.
    rows = once(rows.select("voucher_id", "raw_ocr_text", "supplier_name", *fields), {c: F.col(f"`{c}`") for c in ("voucher_id", "raw_ocr_text", "supplier_name", *fields)})
    shown = lambda f: [F.col(f"`{f}`").cast("string"), *([F.date_format(F.col(f"`{f}`"), p) for p in patterns] if kinds[f] == "date" else [])]
    marks = lambda f: F.coalesce(*[let(x, lambda v: anchor(F.col("raw_ocr_text"), v)) for x in shown(f)])
    each = once(rows, {"_each": F.array_compact(F.array(*[F.when(F.col(f"`{f}`").isNotNull(), F.struct(F.lit(f).alias("field"), marks(f).alias("anchor"))) for f in fields]))})
    found = each.where("supplier_name IS NOT NULL").select("voucher_id", F.upper(F.trim("supplier_name")).alias("supplier_key"), F.inline("_each")).where("anchor IS NOT NULL")
    return found.groupBy("supplier_key", "field", "anchor").agg(F.count("*").alias("n"), F.min("voucher_id").alias("first_seen"))


def find_all(rows: DataFrame, model: DataFrame, least: float = 0.82) -> DataFrame:
    """(voucher_id, field, value, confidence): of each field that the voucher's supplier has anchors for, what follows one.

    A voucher meets its supplier's anchors of all fields at once, each kind of words once whatever the number of fields.
    Its lines are looked through for windows of as many words as an anchor has; equal windows are hits, other pairs are
    compared where their lengths allow it, each distinct pair once. The value is the rest of the line, else the next
    line, up to two blanks; the most frequent anchor counts, then the first line.
    """
    from slipmill.functions.text import lines

    of_field = F.collect_list(F.struct("field", "n"))
    marks = model.groupBy("supplier_key", F.lower("anchor").alias("key"), F.size(F.split("anchor", " ")).alias("k")).agg(of_field.alias("fields"))
    marks = marks.groupBy("supplier_key", "k").agg(F.collect_list(F.struct("key", F.length("key").alias("size"), "fields")).alias("keys")).groupBy("supplier_key").agg(F.collect_list(F.struct("k", "keys")).alias("marks"))
    words = lambda ln: F.transform(ln, lambda x, i: F.struct(F.split(x, r"\s+").alias("w"), F.get(ln, i + 1).alias("below")))
    own = once(rows.select("voucher_id", "supplier_name", "raw_ocr_text"), {"supplier_key": F.upper(F.trim("supplier_name")), "each": let(lines(F.col("raw_ocr_text")), words)})
    own = own.select("voucher_id", "supplier_key", "each").where("supplier_key IS NOT NULL").join(by_size(marks), "supplier_key").drop("supplier_key")
    at = own.select("voucher_id", "marks", F.posexplode("each").alias("line", "l")).select("voucher_id", "line", "l", F.explode("marks").alias("m")).where("size(l.w) >= m.k")
    # A row for each window, not a function over an array of them, which Spark would interpret; a window is made once for all anchors of its words.
    at = at.withColumn("p", F.explode(F.sequence(F.lit(1), F.size("l.w") - F.col("m.k") + 1))).withColumn("window", F.lower(F.array_join(F.slice("l.w", F.col("p"), F.col("m.k")), " ")))
    at = at.withColumn("size", F.length("window")).select("*", F.explode("m.keys").alias("a"))
    # What doesn't match is deleted or inserted, which edits do in no more steps: so few pairs are left to the matcher. Edits
    # beyond those steps aren't counted, and none are where no step is left.
    key, window = F.col("a.key"), F.col("window")
    both = F.col("a.size") + F.col("size")
    unmatched = (both - 2 * matching(F.col("a.size"), F.col("size"), least)).cast("int")
    near = (unmatched > 0) & (F.call_function("levenshtein", key, window, unmatched) >= 0)
    at = at.where((2 * F.least("a.size", "size") / both > least) & ((key == window) | near))
    past = F.col("p") + F.col("m.k")
    rest = F.array_join(F.slice("l.w", past, F.greatest(F.size("l.w") - past + 1, F.lit(0))), " ")
    value = F.regexp_replace(F.coalesce(F.nullif(F.regexp_replace(rest, r"^[\s:\-=.]+", ""), F.lit("")), F.col("l.below")), r"\s{2,}[\s\S]*$", "")
    at = written(at.select("voucher_id", "line", "p", key.alias("key"), "window", "a.fields", value.alias("value")), "windows").where("value IS NOT NULL")  # few are left, and three branches read them
    pairs = at.where("key <> window").select("key", "window").distinct().withColumn("ratio", ratio(F.col("key"), F.col("window"))).where(F.col("ratio") > least).select("key", "window")
    hits = at.where("key = window").unionByName(at.where("key <> window").join(by_size(pairs), ["key", "window"]).select(at.columns))
    told = hits.select("voucher_id", "line", "p", "value", F.inline("fields"))
    chosen = told.groupBy("voucher_id", "field").agg(F.max_by(F.struct("value", "n"), F.struct("n", -F.col("line"), -F.col("p"))).alias("b"))
    return chosen.select("voucher_id", "field", "b.value", (0.85 + F.least(F.col("b.n"), F.lit(10)) / 100).alias("confidence"))


def find_by_anchor(rows: DataFrame, model: DataFrame, field: str, least: float = 0.82) -> DataFrame:
    """(voucher_id, value, confidence) of one field, as find_all() finds it."""
    return find_all(rows, model.where(F.col("field") == field), least).drop("field")


def pattern_model(diffs: DataFrame) -> DataFrame:
    """Continuous patterns: (key, corrected, n, total, confidence) per field and lower-cased value; a single correction
    used three times or more is worth 0.1 more, up to 0.95."""
    keyed = diffs.where("auto IS NOT NULL AND corrected IS NOT NULL").withColumn("key", F.concat("field", F.lit(":"), F.lower(F.trim("auto"))))
    counts = keyed.groupBy("key", "corrected").agg(F.count("*").alias("n"), F.min("voucher_id").alias("first_seen"))
    b = best(counts, ["key"], "corrected")
    return b.select("key", "corrected", "n", "total", F.when((F.col("n") == F.col("total")) & (F.col("n") >= 3), F.least(F.lit(0.95), F.col("share") + 0.1)).otherwise(F.col("share")).alias("confidence"))


def recent_accuracy(predictions: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """(field, n, accuracy) of predictions (ts, field, correct, ...) in the days before as_of."""
    return predictions.where(F.col("ts").between(F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)), F.lit(as_of).cast("timestamp"))).groupBy("field").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def calibration(predictions: DataFrame) -> DataFrame:
    """(bin, n, expected, actual) in bins of a tenth of confidence."""
    b = F.least(F.floor(F.col("confidence") * 10), F.lit(9))
    return predictions.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("actual")).withColumn("expected", F.col("bin") / 10 + 0.05)


def last_n(rows: DataFrame, n: int, by: str, *keys: str) -> DataFrame:
    """The latest n rows of each key (of all without keys); ties by the other columns, so that reruns agree."""
    order = [F.col(by).desc(), *[F.col(c).desc() for c, kind in rows.dtypes if c != by and not kind.startswith("map")]]
    if not keys:
        return rows.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def union_sources(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Corrections of several sources with the source's name; a pattern counts once, under the first source that has it."""
    rows = reduce(DataFrame.unionByName, [df.withColumns({"source": F.lit(name), "_rank": F.lit(i)}) for i, (name, df) in enumerate(sources)])
    return rows.groupBy("field", "auto", "corrected").agg(F.min_by("source", "_rank").alias("source"))


def crop_examples(boxes: DataFrame, least: float = 20) -> DataFrame:
    """Annotations with both boxes, all sides of at least `least`, with their deltas."""
    sides = [F.col(f"{b}.{s}") >= least for b in ("user_crop", "auto_crop") for s in ("width", "height")]
    ok = boxes.where(reduce(lambda a, b: a & b, sides))
    return ok.withColumns({f"d_{s}": F.col(f"user_crop.{s}") - F.col(f"auto_crop.{s}") for s in ("x", "y", "width", "height")})


def crop_model(examples: DataFrame) -> DataFrame:
    """One row: the number of examples, and mean and population deviation of each delta."""
    return examples.agg(F.count("*").alias("n"), *[f(f"d_{s}").alias(f"{name}_{s}") for s in ("x", "y", "width", "height") for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


def apply_crop(boxes: DataFrame, model: DataFrame) -> DataFrame:
    """boxes (auto_crop) shifted by the model's means; places at 0 at least, sides at 10 at least; with a confidence."""
    m = boxes.join(F.broadcast(model), how="cross")
    spread = sum((F.col(f"std_{s}") for s in ("y", "width", "height")), F.col("std_x"))
    moved = {s: F.greatest(F.lit(low).cast("double"), F.bround(F.col(f"auto_crop.{s}") + F.col(f"mean_{s}"))) for s, low in (("x", 0), ("y", 0), ("width", 10), ("height", 10))}
    sure = 0.6 * F.least(F.lit(0.95), F.col("n") / 50) + 0.4 * (1 - F.least(F.lit(0.5), spread / 100))
    return m.select(*boxes.columns, F.struct(*[v.alias(k) for k, v in moved.items()]).alias("suggested"), sure.alias("confidence"))


def crop_scan(boxes: DataFrame, least: float = 20) -> DataFrame:
    """One row: annotations, those with and without an automatic box, and those with a side below `least`."""
    small = F.least("user_crop.width", "user_crop.height", "auto_crop.width", "auto_crop.height") < least
    return boxes.agg(F.count("*").alias("n"), F.count("auto_crop").alias("with_auto"), F.count_if(F.col("auto_crop").isNull()).alias("without_auto"), F.count_if(small).alias("n_small"))


def small_boxes(boxes: DataFrame, least: float = 20, most: int = 5) -> DataFrame:
    """(id, auto_crop): the first `most` annotations by id whose automatic box has a side below `least`, as examples."""
    side = lambda s: F.col(f"auto_crop.{s}")
    small = (side("width") != 0) & (side("height") != 0) & (F.least(side("width"), side("height")) < least)
    return boxes.where(small).select("id", "auto_crop").orderBy("id", "auto_crop").limit(most)


def size_model(examples: DataFrame) -> DataFrame:
    """One row: the number of examples and the mean sides of the boxes that people drew."""
    return examples.agg(F.count("*").alias("n"), F.avg("user_crop.width").alias("width"), F.avg("user_crop.height").alias("height"))


def suggest_size(boxes: DataFrame, model: DataFrame, share: float = 0.1) -> DataFrame:
    """boxes with `sized` (width, height) and its confidence: a side that is off from the mean by more than `share` of
    it becomes the mean, cut to a whole number; without examples boxes stay as they are, at confidence 0."""
    m = boxes.join(F.broadcast(model.select(*[F.col(c).alias(f"_{c}") for c in ("n", "width", "height")])), how="cross")
    side = lambda s: F.when((F.col(f"_{s}") > 0) & (F.abs(F.col(f"auto_crop.{s}") - F.col(f"_{s}")) > F.col(f"_{s}") * share), F.floor(f"_{s}").cast("double")).otherwise(F.col(f"auto_crop.{s}"))
    return m.select(*boxes.columns, F.struct(side("width").alias("width"), side("height").alias("height")).alias("sized"), F.least(F.lit(0.9), F.coalesce("_n", F.lit(0)) / 100).alias("sized_confidence"))


def correct_lines(rows: DataFrame, model: DataFrame, column: str = "raw_ocr_text", least: float = 0.7, longest: int = 4) -> DataFrame:
    """rows (voucher_id, column, ...) whose lines are replaced where the substitutions know the whole line.

    The model's stretches are of `longest` characters at most (as substitutions() makes them), so only lines that short
    are looked up; each voucher's answers come back as a map of its few distinct short lines.
    """
    sure = best(model, ["bad"], "good").where((F.col("share") > least) & (F.length("bad") <= longest)).select("bad", "good")
    short = rows.select("voucher_id", F.explode(F.array_distinct(F.filter(F.split(column, "\n"), lambda x: F.length(x).between(1, longest)))).alias("bad"))
    known = short.join(sure, "bad").groupBy("voucher_id").agg(F.map_from_entries(F.collect_set(F.struct("bad", "good"))).alias("_known"))
    fixed = F.array_join(F.transform(F.split(column, "\n"), lambda x: F.coalesce(F.try_element_at("_known", x), x)), "\n")
    return rows.join(known, "voucher_id", "left").withColumn(column, F.when(F.col("_known").isNull(), F.col(column)).otherwise(fixed)).drop("_known")


def logged_diffs(pairs: DataFrame) -> DataFrame:
    """(voucher_id, field, auto, corrected) where maps `original` and `corrected` both have a field and differ in it."""
    both = F.array_intersect(F.map_keys("original"), F.map_keys("corrected"))
    rows = F.transform(both, lambda f: F.struct(f.alias("field"), F.col("original")[f].alias("auto"), F.col("corrected")[f].alias("corrected")))
    return pairs.select("voucher_id", F.inline(F.filter(rows, lambda r: ~r["auto"].eqNullSafe(r["corrected"]))))


def item_counts(pairs: DataFrame) -> DataFrame:
    """(voucher_id, original, corrected) of vouchers whose numbers of items differ."""
    o, c = F.coalesce(F.size("original.items"), F.lit(0)), F.coalesce(F.size("corrected.items"), F.lit(0))
    return pairs.select("voucher_id", o.cast("long").alias("original"), c.cast("long").alias("corrected")).where("original <> corrected")


def deduction_examples(pairs: DataFrame, by_count: bool = False) -> DataFrame:
    """(voucher_id, field, auto, corrected): each corrected deduction of a voucher whose deductions were changed, as a
    positive example (auto is empty). With by_count only a changed number of deductions counts as a change."""
    o, c = F.col("original.deductions"), F.col("corrected.deductions")
    changed = F.coalesce(F.size(o), F.lit(0)) != F.coalesce(F.size(c), F.lit(0)) if by_count else ~o.eqNullSafe(c)
    return pairs.where(changed).select("voucher_id", F.explode(c).alias("d")).select("voucher_id", F.concat(F.lit("deduction_"), "d.deduction_type").alias("field"), F.lit("").alias("auto"), F.col("d.amount").cast("string").alias("corrected"))


def feedback_examples(log: DataFrame) -> DataFrame:
    """(voucher_id, field, auto, corrected, raw_ocr_text, source) from a correction log: its header fields (a map
    `corrections`), items (an array of field, original, corrected) and deductions (an array of type and amount)."""
    row = lambda field, auto, corrected: F.struct(field.alias("field"), auto.alias("auto"), corrected.alias("corrected"))
    heads = F.transform(F.map_entries("corrections"), lambda e: row(e["key"], e["value"]["original"], e["value"]["corrected"]))
    items = F.transform("items", lambda i: row(F.concat(F.lit("item_"), i["field"]), i["original"], i["corrected"]))
    less = F.transform("deductions", lambda d: row(F.concat(F.lit("deduction_"), d["deduction_type"]), F.lit(""), d["amount"].cast("string")))
    every = F.flatten(F.array_compact(F.array(heads, items, less)))
    return log.select("voucher_id", "raw_ocr_text", "source", F.inline(every)).select("voucher_id", "field", "auto", "corrected", "raw_ocr_text", "source")


def train(examples: DataFrame) -> dict[str, DataFrame]:
    """Model tables out of examples (voucher_id, field, auto, corrected, raw_ocr_text, supplier_name, source): values,
    substitutions, anchors, and the number of examples by source. Examples without a supplier make no anchors."""
    spotted = examples.where("coalesce(corrected, '') <> ''").withColumn("anchor", anchor(F.col("raw_ocr_text"), F.col("corrected")))
    marks = spotted.where("anchor IS NOT NULL AND supplier_name IS NOT NULL").groupBy(F.upper(F.trim("supplier_name")).alias("supplier_key"), "field", "anchor").agg(F.count("*").alias("n"), F.min("voucher_id").alias("first_seen"))
    return {"values": value_model(examples), "substitutions": substitutions(examples), "anchors": marks, "sources": examples.groupBy("source").agg(F.count("*").alias("n"))}


def train_all(examples: DataFrame, boxes: DataFrame) -> dict[str, DataFrame]:
    """All models out of one table of examples, with the context models and the crop model of annotated boxes."""
    from slipmill.operators import context

    more = {"patterns": pattern_model(examples), "contexts": context.context_model(examples), "suppliers": context.supplier_model(examples), "places": context.position_model(examples), "neighbours": context.neighbour_model(examples)}
    return train(examples) | more | {"crops": crop_model(crop_examples(boxes))}


def model_summary(models: dict[str, DataFrame]) -> DataFrame:
    """(model, rows, samples) of count models: how many patterns each holds, and how many examples stand behind them."""
    each = [m.agg(F.lit(name).alias("model"), F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("samples")) for name, m in models.items()]
    return reduce(DataFrame.unionByName, each)


def reliable_patterns(model: DataFrame, least: float = 0.8, uses: int = 3, most: int = 10) -> DataFrame:
    """The surest patterns of pattern_model: of confidence `least`, used `uses` times or more; ties by use, then by key."""
    ok = model.where((F.col("confidence") >= least) & (F.col("total") >= uses))
    return ok.orderBy(F.col("confidence").desc(), F.col("total").desc(), "key").limit(most)


def outcomes(predictions: DataFrame) -> DataFrame:
    """(field, right, wrong, accuracy) of predictions (field, predicted, actual)."""
    same = F.col("predicted").eqNullSafe(F.col("actual"))
    return predictions.groupBy("field").agg(F.count_if(same).alias("right"), F.count_if(~same).alias("wrong"), F.avg(same.cast("double")).alias("accuracy"))


def wrong_predictions(predictions: DataFrame) -> DataFrame:
    """Predictions that were wrong, as corrections (voucher_id, field, auto, corrected) to learn from."""
    return predictions.where(~F.col("predicted").eqNullSafe(F.col("actual"))).select("voucher_id", "field", F.col("predicted").alias("auto"), F.col("actual").alias("corrected"))


def dataset_stats(logs: DataFrame) -> DataFrame:
    """(source, n, last_updated) of logs (source, timestamp)."""
    return logs.groupBy("source").agg(F.count("*").alias("n"), F.max("timestamp").alias("last_updated"))


def cleaned_annotations(boxes: DataFrame, least: int = 20) -> DataFrame:
    """Annotations whose automatic box has both sides of at least `least`; a missing side counts as 0."""
    side = lambda s: F.coalesce(F.floor(f"auto_crop.{s}"), F.lit(0)) >= least
    return boxes.where(side("width") & side("height"))


def cleaning_report(boxes: DataFrame, least: int = 20) -> DataFrame:
    """One row: annotations, kept and removed ones."""
    kept = cleaned_annotations(boxes, least).agg(F.count("*").alias("kept"))
    return boxes.agg(F.count("*").alias("total")).join(F.broadcast(kept), how="cross").withColumn("removed", F.col("total") - F.col("kept"))


def self_recovery(rows: DataFrame, field: str) -> DataFrame:
    """One row: vouchers (voucher_id, raw_ocr_text, supplier_name, field) that gave an anchor, and of how many the
    anchors find the field's value again in the same text."""
    found = find_by_anchor(rows, anchors(rows, (field,)), field)
    both = rows.where(anchor(F.col("raw_ocr_text"), F.col(field).cast("string")).isNotNull()).select("voucher_id", F.col(field).cast("string").alias("own")).join(found, "voucher_id", "left")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("value") == F.col("own")).alias("recovered"))
