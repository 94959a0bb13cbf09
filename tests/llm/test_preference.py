from compare import same
from pyspark.sql import functions as F

from scenewright.llm import preference

SCHEMA = "conv_id long, turn long, role string, text string, prompt string, pair_id int"


def render(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)
    out = preference.format_pairs(df, pair=F.floor(F.col("conv_id") / 2), is_chosen=F.col("conv_id") % 2 == 0)
    return {r.pair_id: r for r in out.collect()}


def test_prefix_completions_and_masks(spark):
    rows = [(0, 0, "system", "be brief"), (0, 1, "user", "hi"), (0, 2, "assistant", "good"), (0, 3, "user", "more"), (0, 4, "assistant", "ü漢"), (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "bad")]
    r = run(spark, rows)[0]
    assert r.n_prompt_turns == 2 and r.prompt == render([("system", "be brief"), ("user", "hi")])
    assert r.prompt + r.chosen == render([t[2:] for t in rows[:5]]) and r.prompt + r.rejected == render([t[2:] for t in rows[5:]])
    assert [r.chosen[s.start : s.end] for s in r.chosen_mask] == ["good<|im_end|>\n", "ü漢<|im_end|>\n"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_mask] == ["bad<|im_end|>\n"]


def test_edges(spark):
    rows = [
        (0, 0, "user", "a"), (1, 0, "user", "a"),  # equal
        (2, 0, "user", "a"), (3, 0, "user", "b"),  # nothing in common
        (4, 0, "user", None), (4, 1, None, "x"), (5, 0, "user", ""), (5, 1, "assistant", "x" * 100_000),
        (6, 0, "user", "alone"),
        (8, 5, "user", "late"), (8, None, "user", "first"), (8, 5, "user", "late"), (9, 1, "user", "first"), (9, 7, "user", "late"),
        (None, 0, "user", "lost"), (11, 0, "assistant", "only rejected"),
    ]
    got = run(spark, rows)
    assert (got[0].n_prompt_turns, got[0].chosen, got[0].rejected) == (1, "", "")
    assert (got[1].n_prompt_turns, got[1].prompt) == (0, "") and got[1].chosen_mask == []
    assert got[2].n_prompt_turns == 1 and got[2].chosen == render([("", "x")]) and len(got[2].rejected_mask) == 1
    assert (got[3].n_prompt_turns, got[3].rejected, got[3].chosen) == (0, "", render([("user", "alone")]))
    assert got[4].n_prompt_turns == 2 and got[4].chosen == render([("user", "late")]) and got[4].rejected == ""
    assert (got[5].chosen, len(got[5].rejected_mask)) == ("", 1) and set(got) == {0, 1, 2, 3, 4, 5}
    assert run(spark, []) == {}


def test_oracle(spark):
    assert same(spark, preference.op9_preference_format, preference.ORACLE, "/root/testdata/sf0.01") == 50


def test_oracle_with_common_turns(spark, tmp_path):
    rows = [(k, t, r, f"{r} {t} {k // 2 if t < k % 5 else k}") for k in range(40) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"][: 2 + k % 4])]
    spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA).drop("prompt", "pair_id").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    out = preference.op9_preference_format(spark, str(tmp_path))
    assert out.filter("n_prompt_turns > 0").count() > 5
    same(spark, preference.op9_preference_format, preference.ORACLE, str(tmp_path))
