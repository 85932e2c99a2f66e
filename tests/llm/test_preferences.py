import duckdb

from sparkgate.llm.preferences import OP4_SQL, format_pairs, format_preferences, op4_preferences, reply_pairs

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a😀"), (1, 2, "user", "q"), (1, 3, "assistant", "good"),
    (2, 1, "assistant", "a😀"), (2, 0, "user", "hi"), (2, 2, "user", "q"), (2, 3, "assistant", "bad <|im_end|>"),
    (3, 0, None, None), (4, 0, None, None), (4, 1, "assistant", ""), (None, 0, "user", "lost"), (5, 0, "user", "x"), (5, 0, "user", "x"),
]


def test_prefix_completions_and_masks(spark):
    turns = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, prompt string")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 3, 4), (3, 5, 99), (4, 1, 1), (4, 1, 1)], "pair_id long, chosen long, rejected long")
    got = {r.pair_id: r for r in format_preferences(turns, pairs).collect()}
    r = got[1]
    assert r.n_prompt_turns == 3 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na😀<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"
    assert r.rejected == "<|im_start|>assistant\nbad < |im_end|><|im_end|>\n" and r.usable
    (s,) = r.chosen_spans
    assert r.chosen[s.start : s.end] == "good<|im_end|>"
    assert got[2].n_prompt_turns == 1 and got[2].chosen == "" and not got[2].usable
    assert [got[k].status for k in (1, 2, 3, 4)] == ["paired", "paired", "no_rejected", "paired"] and not got[3].usable
    assert got[3].n_prompt_turns == 0 and got[3].rejected == "" and got[3].chosen.count("x") == 2
    assert got[4].n_prompt_turns == 4 and got[4].chosen == got[4].rejected == ""
    assert format_preferences(turns, pairs).count() == 5
    assert format_preferences(turns.limit(0), pairs.limit(0)).count() == 0


def test_reply_pairs_keep_every_conversation(spark):
    turns = spark.createDataFrame(TURNS + [(9, 0, "assistant", "alone"), (4, 2, "user", None)], "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in format_pairs(reply_pairs(turns)).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "paired", 2: "paired", 3: "no_reply", 4: "no_other", 5: "no_reply", 9: "no_other"}
    assert got[1].n_prompt_turns == got[2].n_prompt_turns == 3 and got[1].usable and not got[4].usable
    assert got[1].rejected == "<|im_start|>assistant\nbad < |im_end|><|im_end|>\n" and got[2].rejected.count("good") == 1
    assert got[4].n_prompt_turns == 3 and got[4].chosen == got[4].rejected == "" and got[4].prompt.endswith("user\n<|im_end|>\n")
    assert format_pairs(reply_pairs(turns.limit(0))).count() == 0


def test_a_very_long_conversation(spark):
    n = 40_000
    turns = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t', id) text").union(spark.createDataFrame([(2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string"))
    (r,) = format_preferences(turns, spark.createDataFrame([(1, 1, 2)], "pair_id long, chosen long, rejected long")).collect()
    assert r.n_prompt_turns == 0 and len(r.chosen_spans) == n // 2 and all(r.chosen[s.start : s.end] == f"t{2 * k + 1}<|im_end|>" for k, s in enumerate(r.chosen_spans))


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got = op4_preferences(spark, sf)
    want = con.execute(OP4_SQL).fetchall()
    assert [d[0] for d in con.execute(OP4_SQL).description] == got.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 10
    most = [r.n_prompt_turns > 0 for r in got.where("status = 'paired'").collect()]
    assert len(most) > 0.9 * len(want) and sum(most) > 0.9 * len(most)
