from slipmill.llm import langid

SAMPLES = {
    "en": "the house and the garden are where they were when this was written with thought and other things",
    "de": "das haus und der garten sind dort wo sie waren als dies geschrieben wurde mit gedanken und anderen dingen",
    "fr": "la maison et le jardin sont là où ils étaient quand cela fut écrit avec des pensées et autres choses",
    "es": "la casa y el jardín están donde estaban cuando esto fue escrito con pensamientos y otras cosas",
}


def table(spark):
    rows, k = [], 0
    for lang, text in SAMPLES.items():
        words = text.split()
        for i in range(30):
            rows.append((k, " ".join(words[(i * 5 + j * (1 + i % 7)) % len(words)] for j in range(9)), lang))
            k += 1
    extra = [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 !!", "fr"), (1003, "The Garden", None), (None, "der garten und das haus", None), (1004, "x" * 3_000_000, None)]
    return spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")


def test_learns_and_rejects(spark):
    got = {r["doc_id"]: r for r in langid.identify(table(spark)).collect()}
    held = [r for r in got.values() if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(held) > 10 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.9
    assert {got[k]["lang_pred"] for k in (1000, 1001, 1002)} == {"und"} and got[1000]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["lang_pred"] == "de"
    assert langid.keep_identified(table(spark)).count() == len(got) - 3


def test_labels_are_no_input(spark):
    df = table(spark)
    model = langid.train(df)
    a = langid.predict(df.select("doc_id", "text"), model).collect()
    b = langid.predict(df.withColumn("lang", langid.F.lit("en")).withColumn("score", langid.F.lit("clash")), model).collect()
    assert [(r["doc_id"], r["lang_pred"], r["score"]) for r in a] == [(r["doc_id"], r["lang_pred"], r["score"]) for r in b]


def test_few_languages(spark):
    df = table(spark)
    assert langid.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(df.where("lang = 'en'")).collect()} == {"en", "und"}


def test_chunks_see_the_whole_text():
    a = langid.features("abc " * 300_000)
    b = langid.features("abc " * 300)
    assert set(b[0].tolist()) <= set(a[0].tolist())


def test_held_out_accuracy(spark):
    got = langid.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
