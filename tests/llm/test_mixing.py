from slipmill.llm import mixing


def waterfill(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(target.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


def test_targets_and_copies(spark):
    rows = [(i, " ".join(["w"] * (i % 90)), ["b", "a", None, "c", "é", "tiny"][min(5, i % 7)] if i % 50 else "rare") for i in range(4000)] + [(9000, None, "none"), (9001, None, None), (5, "dup dup", "a"), (5, "dup dup", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", mixing.F.lit("clash"))
    got = mixing.mix(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = waterfill(sizes), {}
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] and r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] + 200 for s in want)
    assert mixing.emit(df).count() == sum(r["copies"] for r in got) and mixing.emit(df).columns == df.columns


def test_capped_sources(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "b " * 50, "b"), (3, "c " * 50, "c"), (4, None, "d")], "doc_id long, text string, source string")
    got = {r["source"]: r["target"] for r in mixing.mix(df).collect()}
    assert got["a"] == 3 and got["d"] == 0 and abs(got["b"] + got["c"] - 98) < 1e-9


def test_null_and_repeated_ids(spark):
    """Sources whose ids are all null or all the same, and equal rows, come near their targets too."""
    rows = [(None, f"null {i % 400} w w w w w w w w", "b") for i in range(2000)] + [(5, f"same {i} w w", "a") for i in range(500)] + [(9, "equal rows here", "c")] * 3000 + [(i, "z " * 30, "d") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    want, taken = waterfill({s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abcd"}), {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 0.1 * want[s] for s in want)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_no_python(spark, sf):
    plan = mixing.op7_mix_sources(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
