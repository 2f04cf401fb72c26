"""Language ID in two steps: the family first, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipmill.llm.common import bound_batches, lean, packed, slices, unpacked, utf8

#: Families of languages by their ISO 639-1 codes. A language that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "uralic": ("fi", "et", "hu"), "baltic": ("lt", "lv"), "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ur", "ne"), "semitic": ("ar", "he", "mt"), "celtic": ("ga", "cy", "gd", "br"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
BUCKETS = 1 << 14
#: The training sample: at most this many distinct texts of each language, those of the least hashes.
PER_LANGUAGE = 300
EPOCHS, COST = 8, 4.0
LETTER = re.compile(r"[^\W\d_]")
#: Letters and bytes of other characters stay; the rest is a blank.
LETTERS = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the whole lower-cased text: buckets and their weights (roots of counts, unit length)."""
    counts = np.zeros(BUCKETS, np.int64)
    step = 1 << 20
    for at in range(0, max(1, len(text)), step):  # a chunk at a time, with two characters of overlap
        b = LETTERS[np.frombuffer(utf8(" " + text[max(0, at - 2) : at + step].lower() + " "), np.uint8)].astype(np.uint32)
        b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
        if len(b) < 3:
            continue
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        h ^= h >> np.uint32(15)
        counts += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(18), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    w = np.sqrt(counts[at])
    return at.astype(np.int32), (w / (np.sqrt((w * w).sum()) or 1)).astype(np.float32)


def train_svm(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge), by dual coordinate descent; the last one is the bias."""
    w, alpha = np.zeros(BUCKETS + 1), np.zeros(len(rows))
    n = {1.0: sum(y > 0 for *_, y in rows), -1.0: sum(y < 0 for *_, y in rows)}
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            soft = 0.5 / (COST * len(rows) / (2 * n[y]))  # both classes weigh alike
            g = y * (w[at] @ x + w[-1]) - 1 + soft * alpha[i]
            new = max(0.0, alpha[i] - g / (2.0 + soft))
            if step := new - alpha[i]:
                w[at] += step * y * x
                w[-1] += step * y
                alpha[i] = new
    return w


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """per_language distinct texts of each language, or all if it has fewer: those of the least hashes.

    Only hashes are counted: a text counts once however often it stands, so copies can't fill the sample, and each
    language keeps a text. The hash below which about four times as many lie bounds what is ranked.
    """
    spread = 1 << 40
    keyed = labelled.select("lang", F.pmod(F.xxhash64("text"), F.lit(spread)).alias("h"))
    counts = {r["lang"]: r["n"] for r in keyed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return labelled.limit(0)
    below = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(spread, -(-4 * per_language * spread // max(1, n)))))])
    few = keyed.where(F.col("h") < below[F.col("lang")]).distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= per_language)
    most = {r["lang"]: r["h"] for r in few.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    last = F.create_map(*[x for lang, h in most.items() for x in (F.lit(lang), F.lit(h))])
    chosen = labelled.where(F.pmod(F.xxhash64("text"), F.lit(spread)) <= last[F.col("lang")])
    return chosen.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text")).select("text", "lang")


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """The model of a table (text, lang): languages by family, and a weight vector for each pair to be told apart.

    The sample is bounded (per_language), and so is the group of each pair; pairs are trained as Spark tasks.
    """
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    sample = _sample(labelled, per_language)

    def extract(batches):
        for batch in batches:
            texts, langs = batch["text"].to_pylist(), batch["lang"].to_pylist()
            kept = [(lang, *features(t)) for t, lang in zip(texts, langs, strict=True) if LETTER.search(t)]
            yield pa.record_batch([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1].tobytes() for k in kept], pa.binary()), pa.array([k[2].tobytes() for k in kept], pa.binary())], ["lang", "at", "x"])

    from slipmill.llm.common import cut

    rows = cut(sample.mapInArrow(extract, "lang string, at binary, x binary"))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    family = {lang: FAMILY_OF.get(lang, lang) for lang in langs}
    families = {f: [x for x in langs if family[x] == f] for f in sorted(set(family.values()))}
    pairs = [("family", a, b) for a, b in itertools.combinations(families, 2)]
    pairs += [("lang", a, b) for members in families.values() for a, b in itertools.combinations(members, 2)]
    if not pairs:
        return {"families": families, "pairs": [], "weights": np.zeros((BUCKETS + 1, 0), np.float32)}
    spark = labelled.sparkSession
    tasks = spark.createDataFrame([(i, lang, y) for i, (kind, a, b) in enumerate(pairs) for side, y in ((a, 1.0), (b, -1.0)) for lang in (families[side] if kind == "family" else [side])], "pair int, lang string, y double")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["lang", "at", "x"])
        w = train_svm([(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32), y) for a, x, y in zip(group["at"], group["x"], group["y"], strict=True)])
        return pd.DataFrame({"pair": [group["pair"].iloc[0]], "w": [w.astype(np.float32).tobytes()]})

    found = {r["pair"]: np.frombuffer(r["w"], np.float32) for r in rows.join(F.broadcast(tasks), "lang").groupBy("pair").applyInPandas(fit, "pair int, w binary").collect()}
    return {"families": families, "pairs": pairs, "weights": np.stack([found[i] for i in range(len(pairs))], axis=1)}


def decide(model: dict, margins: np.ndarray) -> tuple[str, float]:
    """Language and score of one text from the margins of all pairs: the family by its mean probability, then the language."""
    p = 1 / (1 + np.exp(-4 * margins))

    def best(kind: str, names: list[str]) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        score = dict.fromkeys(names, 0.0)
        for (k, a, b), q in zip(model["pairs"], p, strict=True):
            if k == kind and a in score and b in score:
                score[a] += q
                score[b] += 1 - q
        top = max(names, key=lambda x: score[x])
        return top, score[top] / (len(names) - 1)

    family, s = best("family", list(model["families"]))
    lang, t = best("lang", model["families"][family])
    return lang, float(s * t)


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred and score (0 to 1), from the whole text alone.

    A text that is null or has no letter, and any text if the model has no language, is `und` with score 0.
    Equal texts get equal results; margins of 0 go to the later name of a pair, equal scores to the first name.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(texts: pa.Array) -> pa.Array:
        m = held.value
        weights, out = m["weights"], []
        for t in (t for _, _, values in slices(texts) for t in values):
            if t is None or not m["families"] or not LETTER.search(t):
                out.append({"lang_pred": "und", "score": 0.0})
                continue
            at, x = features(t)
            lang, score = decide(m, x @ weights[at] + weights[-1])
            out.append({"lang_pred": lang, "score": score})
        return pa.array(out, pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(packed(names), F.arrow_udf(run, PREDICTED)(F.col("text")).alias("predicted")).select(*unpacked(names), "predicted.*")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """docs with held_out, lang_pred and score; the model learns from documents that aren't held out."""
    model = train(docs.where(~is_held_out(F.col("doc_id"))), per_language)
    return predict(docs.drop("held_out"), model).withColumn("held_out", is_held_out(F.col("doc_id")))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs whose language was found; those with `und` (no text, or no letter in it) go."""
    # Columns of docs go along packed, so that those named like a result stay.
    rows = docs.select(packed(docs.columns), "doc_id", "text", "lang")
    return identify(rows).where("lang_pred <> 'und'").select(*unpacked(docs.columns))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
