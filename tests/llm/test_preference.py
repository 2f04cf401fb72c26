from slipmill.llm import preference as pf

SCHEMA = "pair_id long, turn long, role string, text string"


def run(spark, chosen, rejected):
    return {r["pair_id"]: r for r in pf.format_pairs(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA)).collect()}


def test_prefix_and_masks(spark):
    c = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "ok")]
    r = c[:2] + [(1, 2, "user", "less"), (1, 3, "assistant", "no"), (1, 3, "assistant", "no")]
    got = run(spark, c, r)[1]
    assert got["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n" and got["n_prompt_turns"] == 2
    assert got["chosen"] == "<|user|>\nmore<|end|>\n<|assistant|>\nok<|end|>\n"
    assert [got["chosen"][s["start"] : s["end"]] for s in got["chosen_spans"]] == ["ok<|end|>\n"]
    assert [got["rejected"][s["start"] : s["end"]] for s in got["rejected_spans"]] == ["no<|end|>\n"]


def test_edge_cases(spark):
    c = [(1, 0, None, None), (2, 0, "user", "a"), (3, 0, "user", "b"), (3, 1, "assistant", "c"), (None, 0, "user", "x"), (5, None, "user", "x"), (6, 0, "assistant", "é" * 100_000)]
    got = run(spark, c, [(2, 0, "user", "a"), (3, 0, "user", "b"), (4, 0, "assistant", "z")])
    assert set(got) == {1, 2, 3, 4, 6}
    assert got[1]["chosen"] == "<|unknown|>\n<|end|>\n" and got[2]["chosen"] == "" and got[2]["prompt"].startswith("<|user|>")
    assert got[3]["n_prompt_turns"] == 1 and got[3]["rejected"] == "" and got[4]["chosen"] == "" and got[4]["rejected_spans"][0]["start"] == 14
    assert run(spark, [], []) == {}


def test_no_python(spark, sf):
    plan = pf.op6_preference_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
