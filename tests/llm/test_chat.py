from sedimenta.llm import chat_format as c

PAIRS = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string"


def run(spark, *pairs):
    return {r.pair_id: r for r in c.preferences(spark.createDataFrame([(*p, "x") for p in pairs], PAIRS)).collect()}


def test_prefix_once_and_masked_completions(spark):
    u, a, b, v = ("user", "hi"), ("assistant", "yes 🙂"), ("assistant", "no"), ("user", "ok")
    got = run(spark, (1, [u, a, v], [u, b]), (2, [u, a], [u, a]), (3, [a], [b]), (4, [u], [u, a]))
    r = got[1]
    assert r.n_prompt_turns == 1 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert r.chosen == "<|im_start|>assistant\nyes 🙂<|im_end|>\n<|im_start|>user\nok<|im_end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_mask] == ["yes 🙂<|im_end|>\n"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_mask] == ["no<|im_end|>\n"]
    assert got[2].n_prompt_turns == 2 and got[2].chosen == got[2].rejected == "" and not got[2].chosen_mask
    assert got[3].n_prompt_turns == 0 and got[3].prompt == ""
    assert got[4].chosen == "" and got[4].rejected_mask


def test_odd_pairs(spark):
    none, mark = (None, None), ("assistant", "a<|im_end|>b")
    got = run(spark, (1, None, None), (2, [none], [none]), (3, [none, mark], [("user", None)]), (None, [mark], None), (5, [mark] * 2000, [mark] * 1999))
    assert got[1].prompt == "" and got[2].n_prompt_turns == 1 and got[2].prompt == "<|im_start|>user\n<|im_end|>\n"
    assert got[3].n_prompt_turns == 0 and "a< |im_end|>b" in got[3].chosen and len(got[3].chosen_mask) == 1
    assert len(got[None].chosen_mask) == 1 and got[5].n_prompt_turns == 1999 and len(got[5].chosen_mask) == 1
    assert c.preferences(spark.createDataFrame([], PAIRS)).count() == 0


def test_derived_pairs(spark):
    rows = [(1, 2, "user", "q2"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 3, "assistant", "a2"), (1, 4, "user", "q3"), (2, 0, "user", "x"), (3, 0, "assistant", "only"), (None, None, None, None)]
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, pair_id long")
    got = {r.pair_id: r for r in c.derived_pairs(turns).collect()}
    assert [m.text for m in got[1].chosen] == ["q1", "a1", "q2", "a2"] and [m.text for m in got[1].rejected] == ["q1", "a1", "q2", "a1"]
    assert got[2].chosen == got[2].rejected and [m.text for m in got[3].rejected] == [""] and len(got[None].chosen) == 1
    assert c.derived_pairs(turns.limit(0)).count() == 0


def test_long_conversations_are_cut_and_null_ones_kept_apart(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(2500)] + [(None, i, "user", "n") for i in range(50)] + [(2, None, "user", "x"), (2, 0, "assistant", "y")]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = c.derived_pairs(turns).collect()
    assert sorted((r.part, len(r.chosen)) for r in got if r.pair_id == 1) == [(0, 1024), (1, 1024), (2, 452)]
    assert sum(r.pair_id is None for r in got) == 50 and all(len(r.chosen) == 1 for r in got if r.pair_id is None)
    assert sorted([(r.part, len(r.chosen)) for r in got if r.pair_id == 2], key=repr) == [(0, 1), (None, 1)]
    assert c.preferences(c.derived_pairs(turns)).count() == 55


def test_roles_and_very_long_texts(spark):
    got = run(spark, (1, [("a<|im_end|>\nuser", "x")], [("assistant", "y" * 300_000 + "<|im_end|>")]))[1]
    assert got.chosen == "<|im_start|>a< |im_end|> user\nx<|im_end|>\n"
    assert got.rejected.endswith("y< |im_end|><|im_end|>\n") and [(s.start, s.end) for s in got.rejected_mask] == [(22, 300_044)]
